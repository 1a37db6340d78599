"""Exact n-gram Jaccard join and its linked components, by T-occurrence search (DivideSkip).

1. Every distinct shingle set sends its shingle hashes to buckets, which pass on only shingles
   that two or more sets share. Buckets know a set by its slice of text and its number there; slices get
   their sets' shared shingles back, and name the sets. A set whose shared shingles are fewer than the overlap
   any partner needs drops out.
2. The shared shingles have one order, rare first. To reach T of them a partner must occur in one of
   a set's short lists (all but its T - 1 longest). Sets that meet in a short list form a candidate cluster.
3. Each cluster joins on its own: short lists are merged, long lists are probed by binary
   search in the candidate's sorted set, and pairs that are already connected are skipped.
Exact copies are one set, and no step lists all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Text bytes handled at a time, and text bytes for each bucket of shingles.
SLICE_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: A shingle in this many different sets of one slice is dealt apart from its bucket; in fewer of them where there are so many slices that a bucket's
#: task could get more than HOT_IN_ALL of one shingle.
HOT_IN_SLICE, HOT_IN_ALL, SALTS = 64, 2_000_000, 64
#: Bits of a shingle's hash that name its bucket, at most: 2 ** 26 buckets of BUCKET_BYTES are 500 TB of text.
MOST_BITS = 26
#: Sets of a join cell; clusters beyond it are cut into blocks, and each pair of blocks is a cell.
CELL_SETS, MOST_BLOCKS, BLOCK_ITEMS = 256, 32, 4_000_000
WITNESS = 0xFFFF
#: Sets that several rows hold, up to so many, are told to every task (16 bytes each), and one of their rows sends the shingles; beyond it each slice sends them.
COPIED_SETS = 2_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _multipliers(n: int) -> list[np.uint64]:
    return _ODD[:n] if n <= len(_ODD) else _ODD + [(common.mix64(np.arange(i, i + 1, dtype=np.uint64) * common.GOLDEN) | np.uint64(1))[0] for i in range(len(_ODD), n)]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and the rows' offsets among them."""
    hashes, at = common.word_hashes(raw, offsets)
    count = np.diff(at)
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    odd = _multipliers(words)
    ends = np.append(0, np.cumsum(n))
    out = np.empty(int(ends[-1]), np.uint64)
    whole = count >= words
    first = common.ragged_arange(at[:-1][whole], n[whole])
    value = np.zeros(len(first), np.uint64)
    for j in range(words):
        value += hashes[first + j] * odd[j]
    out[common.ragged_arange(ends[:-1][whole], n[whole])] = common.mix64(value)
    for r in np.flatnonzero((count > 0) & ~whole):
        own = hashes[at[r] : at[r + 1]]
        total = np.full(1, count[r], np.uint64) * common.MIX_B
        for j in range(len(own)):
            total += own[j : j + 1] * odd[j]
        out[ends[r]] = common.mix64(total)[0]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.append(True, out[1:] != out[:-1]) if len(out) else np.zeros(0, bool)
    keep[ends[:-1][n > 0]] = True
    return out[keep], np.append(0, np.cumsum(keep))[ends] if len(out) else ends


def fingerprints(items: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, 0 for an empty one."""
    sums = np.append(np.uint64(0), np.cumsum(common.mix64(items + common.GOLDEN), dtype=np.uint64))
    n = np.diff(ends).astype(np.uint64)
    return np.where(n > 0, common.mix64(sums[ends[1:]] - sums[ends[:-1]] + n * common.MIX_B), 0).astype(np.uint64)


def set_table(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, n_shingles, set_key)`` of every row; the key is null for an empty set."""
    kept = common.only(docs, doc_id=doc_id, text=text)

    def run(batches):
        common.release()
        for batch in batches:
            for a, b, raw, offsets in common.row_slices(batch.column(1), SLICE_BYTES, WITNESS - 1):
                items, ends = shingle_sets(raw, offsets, words)
                key = fingerprints(items, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(ends)), pa.array(key.view(np.int64), mask=key == 0)], ["doc_id", "n_shingles", "set_key"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_key long")


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Fewest shared shingles of a set of size n with any partner."""
    return -(-percent * n // 100)


def copied_sets(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys, in order, of the sets that several rows ``(doc_id, set_key)`` hold, and the least hashed id of each one's rows; none where they are too many to tell."""
    held = rows.where("set_key is not null").groupBy("set_key").agg(F.count("*").alias("rows"), F.min(F.xxhash64("doc_id")).alias("own")).where("rows > 1").select("set_key", "own")
    held = common.checkpoint(held)
    if held.count() > COPIED_SETS:
        held = held.limit(0)
    found = held.toArrow()
    keys, own = found.column("set_key").to_numpy().view(np.uint64), found.column("own").to_numpy()
    order = np.argsort(keys)
    return keys[order], own[order]


def shared_sets(docs: DataFrame, words: int, percent: int, doc_id: str, text: str, copied: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(set_key, n, items)`` of sets that may have a partner: items are their shared shingles, rare first.

    A set of several rows that :func:`copied_sets` doesn't tell may come more than once, with all that its rows share.
    """
    total = common.total_bytes(docs, text)
    told_sets = docs.sparkSession.sparkContext.broadcast(copied)
    bits = min(MOST_BITS, int(np.log2(common.power_of_two_at_least(total / BUCKET_BYTES))))
    hot_from = int(np.clip(HOT_IN_ALL * SLICE_BYTES // max(total, 1), 2, HOT_IN_SLICE))
    groups = max(1, 1 << max(0, bits - 1))

    def post(batches):
        common.release()
        known, sender = told_sets.value
        for batch in batches:
            own_id = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, raw, offsets in common.row_slices(batch.column(0), SLICE_BYTES, WITNESS - 1):
                items, ends = shingle_sets(raw, offsets, words)
                keys, n = fingerprints(items, ends), np.diff(ends)
                sends = n > 0
                if len(known):  # of a copied set only the row of the least id
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    sends &= (known[at] != keys) | (sender[at] == own_id[a:b])
                sends = np.flatnonzero(sends)
                first = sends[np.unique(keys[sends], return_index=True)[1]]  # one of the slice's copies
                if not len(first):
                    continue
                place = common.ragged_arange(ends[first], n[first])
                item, owner = items[place], np.repeat(np.arange(len(first), dtype=np.uint16), n[first])
                order = np.argsort(item)
                item, owner = item[order], owner[order]
                start = common.runs(item)
                held = np.diff(np.append(start, len(item)))
                hot = np.repeat(held >= hot_from, held)
                told = start[held >= hot_from]
                salt = 1 + int(keys[first[0]] % np.uint64(SALTS))
                rest_item, rest_owner = np.append(item[~hot], item[told]), np.append(owner[~hot], np.full(len(told), WITNESS, np.uint16))
                order = np.argsort(rest_item, kind="stable")
                out = []
                for which, i, o in ((0, rest_item[order], rest_owner[order]), (salt, item[hot], owner[hot])):
                    bucket = (i >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
                    low = (i << np.uint64(bits)) >> np.uint64(16)
                    for a, b in common.run_spans(bucket):
                        own = low[a:b]
                        out.append((int(bucket[a]), which, (own >> np.uint64(16)).astype(np.uint32).tobytes(), own.astype(np.uint16).tobytes(), o[a:b].tobytes()))
                # The slice is named by its sets; their keys and sizes go to its group, once.
                mark = int(common.mix64(np.sum(common.mix64(keys[first] + np.arange(1, len(first) + 1, dtype=np.uint64) * common.GOLDEN), keepdims=True, dtype=np.uint64)).view(np.int64)[0])
                out.append((-1 - mark % groups, 0, keys[first].tobytes(), n[first].astype(np.uint32).tobytes(), b""))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[2:]], pa.array([mark] * len(out), pa.int64())], ["bucket", "salt", "high", "low", "owner", "slice"])

    names = ("slice", "keys", "sizes", "owner", "each", "items", "rarity")

    def passed_on(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.table({c: pa.array(v, pa.int64() if c == "slice" else pa.binary()) for c, v in zip(names, columns, strict=True)})

    def share(key, table):
        common.release()
        bucket, salt = key[0].as_py(), key[1].as_py()
        slices = np.array(table.column("slice"))
        columns = [table.column(c).to_pylist() for c in ("high", "low", "owner")]
        if bucket < 0:
            return passed_on([(mark, keys, sizes, None, None, None, None) for mark, keys, sizes in zip(slices.tolist(), *columns[:2], strict=True)])
        marks, number = np.unique(slices, return_inverse=True)
        item, owner = [], []
        for high, low, own, of in zip(*columns, number.tolist(), strict=True):
            item.append(np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(low, np.uint16))
            own = np.frombuffer(own, np.uint16)
            owner.append(np.where(own == WITNESS, np.uint64(0), np.uint64(of + 1 << 16) | own))
        item, owner = np.concatenate(item), np.concatenate(owner)
        order = np.argsort(item, kind="stable")
        item, owner = item[order], owner[order]
        at = common.runs(item)
        n = np.diff(np.append(at, len(item)))
        low, high = np.minimum.reduceat(owner, at), np.maximum.reduceat(owner, at)
        told = low == 0
        rarity = np.where(told | (salt > 0), 255, np.minimum(np.log2(n) * 8, 200)).astype(np.uint8)
        keep = np.repeat((low != high) | told | (salt > 0), n) & (owner != 0)
        # The bucket's bits and up to 48 behind them.
        item = (item << np.uint64(16) >> np.uint64(bits)) | np.uint64(bucket << (64 - bits) if bits else 0)
        item, owner, rarity = item[keep], owner[keep], np.repeat(rarity, n)[keep]
        order = np.argsort(owner, kind="stable")
        item, owner, rarity = item[order], owner[order], rarity[order]
        rows = []
        for a, b in common.run_spans(owner >> np.uint64(16)):
            own = common.runs(owner[a:b])
            each = np.diff(np.append(own, b - a)).astype(np.uint32)
            rows.append((int(marks[int(owner[a] >> np.uint64(16)) - 1]), None, None, owner[a:b][own].astype(np.uint16).tobytes(), each.tobytes(), item[a:b].tobytes(), rarity[a:b].tobytes()))
        return passed_on(rows)

    def gather(key, table):
        common.release()
        named = [(np.frombuffer(k, np.uint64), np.frombuffer(z, np.uint32)) for k, z in zip(table.column("keys").to_pylist(), table.column("sizes").to_pylist(), strict=True) if k is not None]
        if not named:
            raise RuntimeError(f"slice {key[0].as_py()} came without its sets: the table gave other rows when it was read again")
        keys, sizes = named[0]  # slices of the same mark are the same sets
        owner, each, items, rarity = (np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x is not None), d) for c, d in (("owner", np.uint16), ("each", np.uint32), ("items", np.uint64), ("rarity", np.uint8)))
        owner = np.repeat(owner, each)
        order = np.lexsort((items, rarity, owner))
        owner, items = owner[order], items[order]
        new = np.append(True, (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])) if len(items) else np.zeros(0, bool)
        owner, items = owner[new], items[new]
        at = common.runs(owner)
        n = np.diff(np.append(at, len(owner)))
        enough = np.flatnonzero(n >= least_overlap(sizes[owner[at]].astype(np.int64), percent))
        of = owner[at[enough]]
        return pa.table(
            {
                "set_key": pa.array(keys[of].view(np.int64)),
                "n": pa.array(sizes[of].astype(np.int64)),
                "items": pa.array([items[at[i] : at[i] + n[i]].tobytes() for i in enough], pa.binary()),
            }
        )

    sent = docs.select(F.col(text).alias("text"), F.xxhash64(doc_id).alias("own"))
    blobs = sent.mapInArrow(post, "bucket long, salt long, high binary, low binary, owner binary, slice long")
    shared = blobs.groupBy("bucket", "salt").applyInArrow(share, "slice long, keys binary, sizes binary, owner binary, each binary, items binary, rarity binary")
    return shared.groupBy("slice").applyInArrow(gather, "set_key long, n long, items binary")


def short_lists(sets: DataFrame, percent: int) -> DataFrame:
    """``(item, set_key)`` of each set's short lists: all but its T - 1 longest."""

    def run(batches):
        common.release()
        for batch in batches:
            n = np.array(batch.column(1))
            need = least_overlap(n, percent)
            item, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key, t, blob in zip(batch.column(0).to_pylist(), need.tolist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(blob, np.int64)
                item.append(own[: len(own) - t + 1])
                owner.append(np.full(len(own) - t + 1, key, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(item)), pa.array(np.concatenate(owner))], ["item", "set_key"])

    return sets.select("set_key", "n", "items").mapInArrow(run, "item long, set_key long")


def candidate_clusters(sets: DataFrame, percent: int) -> DataFrame:
    """``(set_key, cluster)`` of sets that meet another one in a short list."""
    lists = short_lists(sets, percent)
    met = lists.groupBy("item").agg(F.min("set_key").alias("hub"), F.max("set_key").alias("other")).where("hub <> other").select(F.col("item").alias("i"), "hub")
    edges = lists.join(met, lists["item"] == met["i"]).where("set_key <> hub").select(F.col("set_key").alias("a"), F.col("hub").alias("b")).distinct()
    return common.connected_components(edges).select(F.col("node").alias("k"), F.col("component").alias("cluster"))


def divide_skip(sets: list[np.ndarray], n: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Component of each set under links of at least ``percent`` per cent Jaccard similarity.

    ``sets`` are in the common order, rare items first. ``side``: only sets of different sides
    are compared, all if every side is 0.
    """
    m = len(sets)
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    need = least_overlap(n, percent)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    names, number = np.unique(flat, return_inverse=True)
    ends = np.append(0, np.cumsum(sizes))
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(number, kind="stable")
    posting = owner[order]
    start = np.searchsorted(number[order], np.arange(len(names) + 1))
    ranked = [np.sort(number[ends[i] : ends[i + 1]]) for i in range(m)]
    component = np.arange(m)
    both = bool(side.any())
    for u in range(m):
        own = number[ends[u] : ends[u + 1]]
        short = own[: len(own) - need[u] + 1]
        long = own[len(own) - need[u] + 1 :]
        met = posting[common.ragged_arange(start[short], start[short + 1] - start[short])]
        count = np.bincount(met, minlength=m) if len(met) > m else None
        if count is None:
            met.sort()
            at = common.runs(met)
            partner, got = met[at], np.diff(np.append(at, len(met)))
        else:
            partner = np.flatnonzero(count)
            got = count[partner]
        fit = (partner > u) if not both else ((side[partner] != side[u]) & (partner > u))
        fit &= (100 * n[partner] >= percent * n[u]) & (100 * n[u] >= percent * n[partner])
        # An earlier set's short lists may miss a later set's; both orders are tried, as each needs its own T.
        goal = -(-percent * (n[u] + n[partner]) // (100 + percent))
        fit &= got + np.minimum(len(long), sizes[partner] - got) >= goal
        mine = find(u)
        for v, c, t in zip(partner[fit].tolist(), got[fit].tolist(), goal[fit].tolist(), strict=True):
            other = find(v)
            if other == mine:
                continue
            probe = ranked[v]
            place = np.searchsorted(probe, long)
            place[place == len(probe)] = 0
            if c + int((probe[place] == long).sum()) >= t:
                root[max(mine, other)] = min(mine, other)
                mine = min(mine, other)
    for i in range(m):
        component[i] = find(i)
    return component


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """``(k, root)``: sets linked with another one, and one set that stands for their component."""
    clusters = candidate_clusters(sets, percent)
    placed = common.checkpoint(sets.join(clusters, sets["set_key"] == clusters["k"]).dropDuplicates(["set_key"]).select("set_key", "n", "items", "cluster"))
    per = placed.groupBy("cluster").agg(F.count("*").alias("members"), F.sum(F.octet_length("items") / 8).alias("volume"))
    cells = max(1, -(-placed.count() // CELL_SETS))
    blocks = F.greatest(F.least(F.ceil(F.col("members") / CELL_SETS), F.lit(MOST_BLOCKS)), F.ceil(F.col("volume") / BLOCK_ITEMS)).cast("int")
    large = per.where((F.col("members") > CELL_SETS) | (F.col("volume") > BLOCK_ITEMS)).select(F.col("cluster").alias("c"), blocks.alias("blocks"))
    # A row for every CELL_SETS sets at most: sent to every task, so that the sets travel once.
    joined = placed.join(F.broadcast(large), placed["cluster"] == large["c"], "left")
    block = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = joined.withColumn("block", block).withColumn("other", other)
    cell = F.when(F.col("blocks").isNull(), F.concat(F.lit("all "), F.pmod(F.xxhash64("cluster"), F.lit(cells)).cast("string"))).otherwise(
        F.concat_ws(" ", F.col("cluster").cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    )
    side = F.when(F.col("blocks").isNull() | (F.col("block") == F.col("other")), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(cell.alias("cell"), "set_key", "n", "items", side.alias("side"))

    def join(key, table):
        common.release()
        keys, n, side = (np.array(table.column(c)) for c in ("set_key", "n", "side"))
        if side.any() and len(np.unique(side)) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        order = np.lexsort((keys, n))
        held = table.column("items").to_pylist()
        component = divide_skip([np.frombuffer(held[i], np.uint64) for i in order], n[order], side[order], percent)
        on = np.flatnonzero(component != np.arange(len(component)))
        return pa.table({"a": pa.array(keys[order][on]), "b": pa.array(keys[order][component[on]])})

    links = dealt.groupBy("cell").applyInArrow(join, "a long, b long")
    return common.connected_components(links).select(F.col("node").alias("k"), F.col("component").alias("root"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row, one row each.

    Words are runs of characters other than space and control white space, A-Z lower-cased; a set
    holds the distinct ``words``-word shingles of the whole text, the whole sequence if it has fewer words. Two rows link
    when 100 * intersection >= percent * union; ``component_id`` is the smallest id reachable by links. Null, empty or blank
    texts have an empty set, link with nothing and are their own component. Rows with a null id
    take part, and their component has its smallest known id (null if none). Sets are told apart by 64-bit
    hashes, shingles by 48 bits and the bucket's. An empty table gives no rows.
    """
    rows = common.checkpoint(set_table(docs, words, doc_id, text))
    sets = common.checkpoint(shared_sets(docs, words, percent, doc_id, text, copied_sets(rows)))
    links = common.checkpoint(linked_sets(sets, percent))
    classes = rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(links, classes["set_key"] == links["k"], "left").select("set_key", "least", F.coalesce("root", "set_key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    named = common.checkpoint(rooted.join(least, rooted["root"] == least["r"]).select(F.col("set_key").alias("k"), "component_id"))
    joined = rows.join(named, rows["set_key"] == named["k"], "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
