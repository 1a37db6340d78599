"""Packing documents into token windows, neighbours by BM25 retrieval side by side."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: BM25 saturation and length normalisation; neighbours fetched at once.
K1, B, NEIGHBOURS = 1.2, 0.75, 64
#: Bytes that a document counts as at least when shards are filled, so that a shard of short texts holds a bounded number of them.
LEAST_SIZE = 400
#: Terms of more of a shard's items than one in so many are kept as a full row of weights.
DENSE = 8


def _postings(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(item, term, count)`` of every distinct term of each item, by item and term."""
    sizes = np.array([len(i) for i in items], np.int64)
    terms = np.concatenate([*items, np.zeros(0, items[0].dtype if items else np.uint32)])
    # Few items of short ids: half the bytes to sort.
    kind, half = (np.uint32, 16) if terms.dtype.itemsize < 4 and len(items) < 1 << 16 else (np.uint64, 32)
    keys = np.repeat(np.arange(len(items), dtype=kind) << kind(half), sizes) | terms.astype(kind)
    keys.sort()
    first = common.runs(keys)
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> kind(half)).astype(np.int64), (keys & kind((1 << half) - 1)).astype(np.int64), count


@dataclass
class Statistics:
    """How many items each term is in, how many items there are, and their mean length."""

    df: np.ndarray
    n: int
    mean: float

    @staticmethod
    def of(items: list[np.ndarray]) -> Statistics:
        return Statistics(np.bincount(_postings(items)[1]), len(items), sum(map(len, items)) / max(len(items), 1))

    def weights(self, item: np.ndarray, term: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """BM25 weight of each posting."""
        idf = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))
        damp = K1 * (1 - B + B * sizes / max(self.mean, 1))
        return idf[term] * count * (K1 + 1) / (count + damp[item])


class Bm25:
    """Inverted index over the token lists of one shard, weighted by the statistics of all shards."""

    def __init__(self, items: list[np.ndarray], statistics: Statistics | None = None):
        n = len(items)
        item, term, count = _postings(items)
        weight = (statistics or Statistics.of(items)).weights(item, term, count, np.array([len(i) for i in items], np.int64)).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.item, self.weight, term = item[order].astype(np.int32), weight[order], term[order]
        self.df, self.n = np.bincount(term), n
        self.starts = np.append(0, np.cumsum(self.df))
        common_terms = np.flatnonzero(self.df * DENSE > n)
        self.row = np.full(len(self.df), -1)
        self.row[common_terms] = np.arange(len(common_terms))
        self.dense = np.zeros((len(common_terms), n), np.float32)
        at = self.row[term] >= 0
        self.dense[self.row[term[at]], self.item[at]] = self.weight[at]

    def neighbours(self, item_tokens: np.ndarray, used: np.ndarray) -> list[int]:
        """Unused items of positive score, best first (ties: earlier item), by all terms shared with the query."""
        terms = np.unique(item_tokens)
        terms = terms[self.df[terms] > 1]
        row = self.row[terms]
        sparse = terms[row < 0]
        at = common.ragged_arange(self.starts[sparse], self.df[sparse])
        score = np.bincount(self.item[at], self.weight[at], minlength=self.n) + np.add.reduce(self.dense[row[row >= 0]], axis=0)
        score[used] = 0
        best = np.argpartition(-score, NEIGHBOURS)[:NEIGHBOURS] if self.n > NEIGHBOURS else np.arange(self.n)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))].tolist()


def pack_shard(ids: list[np.ndarray], window: int, statistics: Statistics | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one shard's documents.

    Documents longer than a window fill whole windows of their own first. Then each window takes
    a seed, its unused neighbours best first and, when they run out, the next document in order;
    the document that reaches the edge is cut there and seeds the next window. Scores use
    ``statistics`` of the whole table (without them, those of the shard).
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    start, left, doc = [], [], []
    for d, own in enumerate(ids):
        whole = len(own) // window
        for k in range(whole):
            pieces.append((d, k * window, window, sequence, 0))
            sequence += 1
        if len(own) % window:
            doc.append(d)
            start.append(whole * window)
            left.append(len(own) - whole * window)
    if not doc:
        return pieces
    items = [ids[d][s:] for d, s in zip(doc, start, strict=True)]
    index = Bm25(items, statistics)
    used = np.zeros(len(doc), bool)
    following, cut = 0, None
    while True:
        if cut is None:
            while following < len(doc) and used[following]:
                following += 1
            if following == len(doc):
                return pieces
            cut = following
        room, queue, now, cut = window, None, cut, None
        while now is not None:
            used[now] = True
            take = min(room, left[now])
            pieces.append((doc[now], start[now], take, sequence, window - room))
            room -= take
            start[now] += take
            left[now] -= take
            if left[now]:
                cut = now
            if not room:
                break
            if queue is None:
                queue = index.neighbours(items[now], used)[::-1]
            seed, now = now, None
            while queue:
                if not used[queue[-1]]:
                    now = queue.pop()
                    break
                queue.pop()
            if now is None:
                queue = index.neighbours(items[seed], used)[::-1]
                if queue:
                    now = queue.pop()
                else:
                    while following < len(doc) and used[following]:
                        following += 1
                    now = following if following < len(doc) else None
        sequence += 1


def _tails(column: pa.Array, window: int, kind: str) -> list[np.ndarray]:
    """What whole windows leave of each document's ids."""
    ids = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return [i[len(i) - len(i) % window :] for i in ids]


def statistics_of(coded: DataFrame, window: int, kind: str) -> Statistics:
    """Term statistics of what whole windows leave of all documents; the driver gets a row a term of the vocabulary."""

    def count(batches):
        tokens.forget()
        common.release()
        df, n, total = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            items = [i for i in _tails(batch.column("ids"), window, kind) if len(i)]
            more = np.bincount(_postings(items)[1], minlength=len(df))
            more[: len(df)] += df
            df, n, total = more, n + len(items), total + sum(map(len, items))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(term, -1), "docs": np.append(df[term], n), "tokens": np.append(0 * term, total)})

    found = coded.select("ids").mapInArrow(count, "term long, docs long, tokens long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    term, docs, tokens_ = (np.asarray(c, np.int64) for c in found.toArrow().select(["term", "docs", "tokens"]).columns)
    df = np.zeros(max(term.max(initial=0) + 1, 1), np.int64)
    df[term[term >= 0]] = docs[term >= 0]
    n = int(docs[term < 0].sum())
    return Statistics(df, n, int(tokens_.sum()) / max(n, 1))


def strongest_terms(items: list[np.ndarray], statistics: Statistics, least: float = 2) -> tuple[np.ndarray, np.ndarray]:
    """The two terms of highest weight of each item, of those that ``least`` items share, then of those that two share.

    Ties take the smaller term, and -1 stands for no term.
    """
    item, term, count = _postings(items)
    weight = statistics.weights(item, term, count, np.array([len(i) for i in items], np.int64))
    shared = statistics.df[term]
    weight = np.where(shared >= max(least, 2), weight + weight.max(initial=0), np.where(shared >= 2, weight, -1))
    starts = common.runs(item)
    out = []
    for _ in range(2):
        best = np.full(len(items), -1, np.int64)
        if len(starts):
            most = np.maximum.reduceat(weight, starts)
            at = np.flatnonzero((weight == np.repeat(most, np.diff(np.append(starts, len(item))))) & (weight >= 0))
            at = at[common.runs(item[at])]
            best[item[at]] = term[at]
            weight[at] = -1
        out.append(best)
    return out[0], out[1]


def lay_out(cells: list[tuple[int, int, int]], shard_bytes: int) -> list[tuple[int, int, int, int]]:
    """``(term, part, first shard, shards)`` of ``(term, part, bytes)`` cells; small cells fill shards in order, a large one has several."""
    out, shard, filled = [], 0, 0
    for term, part, size in sorted(cells):
        if filled and filled + size > shard_bytes:
            shard, filled = shard + 1, 0
        several = max(1, -(-size // shard_bytes))
        out.append((term, part, shard, several))
        if several > 1:
            shard += several
        else:
            filled += size
    return out


def place(termed: DataFrame, shard_bytes: int) -> DataFrame:
    """Adds ``shard``: documents of one strongest term together, those of a hot one by their second term, and only then by a hash.

    ``termed`` is read twice: once for the sizes of its pairs of terms, which are kept, and once for its rows.
    """
    spark = termed.sparkSession
    sizes = common.checkpoint(termed.groupBy("term", "second").agg(F.sum("size").alias("size")))
    hot = sizes.groupBy("term").agg(F.sum("size").alias("s")).where(F.col("s") > shard_bytes).collect()
    parts = spark.createDataFrame([(r["term"], -(-r["s"] // shard_bytes)) for r in hot], "t long, parts long")
    part = F.pmod(F.xxhash64("second"), F.coalesce("parts", F.lit(1)))
    in_parts = lambda df: df.join(F.broadcast(parts), df["term"] == parts["t"], "left").withColumn("part", part).drop("t", "parts")
    cells = [(r["term"], r["part"], r["s"]) for r in in_parts(sizes).groupBy("term", "part").agg(F.sum("size").alias("s")).collect()]
    dealt = in_parts(termed)
    where = spark.createDataFrame(lay_out(cells, shard_bytes), "t long, p long, first long, several long")
    joined = dealt.join(F.broadcast(where), (dealt["term"] == where["t"]) & (dealt["part"] == where["p"]))
    return joined.select("doc_id", "ids", (F.col("first") + F.pmod(F.xxhash64("doc_id", "ids"), F.col("several"))).alias("shard"))


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 6 << 20) -> DataFrame:
    """Pack whole documents into sequences of at most ``window`` tokens.

    Returns a row per piece: ``doc_id, start, length, ids`` (binary, little-endian unsigned 32-bit),
    ``doc_tokens, sequence_id, offset``. Every document's ids are those of the tokenizer and then
    ``end_id``; a null or empty text is the end id alone. Term statistics are those of all
    documents. Documents go to shards of up to about ``shard_bytes`` by content: by the term of
    highest weight that enough documents share to fill a shard, the next one where that term is
    hot, and a hash of id and ids where both are. A seed's neighbours are searched by all shared
    terms, but in its own shard only; only a shard's last sequence may be short. Repeated rows are packed each time; rows
    with a null id are packed like others; an empty table gives no rows.
    """
    kept = common.only(docs, doc_id=doc_id, text=text)
    id_type = kept.schema["doc_id"].dataType.simpleString()
    kind = "<u2" if max(tokens.encoder(tokenizer).tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"

    def encode(batches):
        common.release()
        coder = tokens.encoder(tokenizer)
        for batch in batches:
            for a, b, ids, ends in coder.encode(batch.column("text")):
                ends = ends + np.arange(len(ends))  # an end id behind each document
                full = np.empty(int(ends[-1]), kind)
                full[ends[1:] - 1] = end_id
                full[common.ragged_arange(ends[:-1], np.diff(ends) - 1)] = ids
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("size")[a:b], common.binary_column(full, ends * full.itemsize)], ["doc_id", "size", "ids"])

    sized = kept.withColumn("size", F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(LEAST_SIZE)).cast("long") + 1)
    coded = common.checkpoint(sized.mapInArrow(encode, f"doc_id {id_type}, size long, ids binary"))
    statistics = statistics_of(coded, window, kind)
    # A term of fewer documents than a shard holds would leave them among documents of any other terms.
    least = statistics.n * shard_bytes / max(coded.agg(F.sum("size")).first()[0] or 0, shard_bytes)

    def strongest(batches):
        tokens.forget()
        common.release()
        for batch in batches:
            first, second = strongest_terms(_tails(batch.column("ids"), window, kind), statistics, least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(second)], ["doc_id", "size", "ids", "term", "second"])

    # Not checkpointed: the ids are there in coded, and finding the terms again costs less than a second copy of them.
    termed = coded.mapInArrow(strongest, f"doc_id {id_type}, size long, ids binary, term long, second long")

    def run(key, table):
        tokens.forget()
        common.release()
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(x, kind) for x in table.column("ids").to_pylist()]
        pieces = pack_shard(ids, window, statistics)
        d, start, length, sequence, offset = (list(x) for x in zip(*pieces, strict=True))
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(pa.array(d, pa.int64())),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids": pa.array([ids[x][s : s + n].astype("<u4").tobytes() for x, s, n in zip(d, start, length, strict=True)], pa.binary()),
                "doc_tokens": pa.array([len(ids[x]) for x in d], pa.int64()),
                "sequence_id": pa.array(np.array(sequence, np.int64) + (key[0].as_py() << 32)),
                "offset": pa.array(offset, pa.int64()),
            }
        )

    return place(termed, shard_bytes).groupBy("shard").applyInArrow(run, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
