"""Ranked lexical search by the Best Position Algorithm: impact lists read in parallel, with direct accesses and contiguous seen positions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Terms (with repeats) of the items that are searched together: 8 bytes each in every worker. More items go in further blocks, each a pass over the documents.
BLOCK_TERMS = 2_000_000
#: Postings of a shard, about: some 60 bytes each while it is searched.
SHARD_POSTINGS = 500_000
FIRST_READ, MOST_READ = 16, 4096
#: Bytes that belong to no term: ASCII that is neither letter nor digit.
APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def _terms(column: pa.Array):
    """Hashes of the terms of some rows at a time, and the rows' offsets in them."""
    for _, _, raw, offsets in common.row_slices(column, 8 << 20):
        hashes, starts, _ = common.word_spans(raw, offsets, blank=APART)
        yield hashes, np.searchsorted(starts, offsets)


def _item_terms(batches):
    for batch in batches:
        ends, found = [np.zeros(1, np.int64)], []
        for hashes, at in _terms(batch.column("text")):
            found.append(hashes.view(np.int64))
            ends.append(at[1:] + ends[-1][-1])
        terms = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
        yield pa.RecordBatch.from_arrays([batch.column("item"), terms], ["item", "terms"])


def _counter(known):
    """Counts of the terms ``known`` (a broadcast sorted array) in each document, as pairs of term number and count."""

    def count(batches):
        terms = known.value
        for batch in batches:
            lengths, ends, numbers, counts = [], [np.zeros(1, np.int64)], [], []
            for hashes, at in _terms(batch.column("text")):
                n = len(at) - 1
                where = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
                hit = terms[where] == hashes if len(terms) else np.zeros(len(hashes), bool)
                key, times = np.unique(np.repeat(np.arange(n), np.diff(at))[hit] * len(terms) + where[hit], return_counts=True)
                lengths.append(np.diff(at))
                numbers.append((key % max(len(terms), 1)).astype(np.int32))
                counts.append(times.astype(np.int32))
                ends.append(np.searchsorted(key, np.arange(1, n + 1) * len(terms)) + ends[-1][-1])
            ends, join = pa.array(np.concatenate(ends), pa.int32()), lambda parts, kind: pa.array(np.concatenate([np.zeros(0, kind), *parts]))
            columns = [batch.column("doc_id"), join(lengths, np.int64), pa.ListArray.from_arrays(ends, join(numbers, np.int32)), pa.ListArray.from_arrays(ends, join(counts, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])
            common.release()

    return count


class Shard:
    """Impact lists of some documents: by falling impact for reading in order, and by (term, document) for direct access."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs = n_docs
        at = np.lexsort((docs, -impacts, terms))
        self.doc, self.impact = docs[at], impacts[at]
        self.starts = np.searchsorted(terms[at], np.arange(n_terms + 1))
        key = terms[at].astype(np.int64) * n_docs + self.doc
        order = np.argsort(key)
        self.key, self.place = key[order], order
        self.seen, self.met = np.zeros(len(at), bool), np.zeros(n_docs, bool)

    def direct(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Places of the documents (columns) in the lists of the terms (rows); -1 where a document lacks the term."""
        asked = terms[:, None].astype(np.int64) * self.n_docs + docs[None, :]
        found = np.minimum(np.searchsorted(self.key, asked), max(len(self.key) - 1, 0))
        return np.where(self.key[found] == asked, self.place[found], -1)

    def search(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of the ``k`` highest scores above 0 (equal scores by number) with their scores, and how many places were read in order.

        A document not met yet stands beyond the best position of every list, the last of the contiguous places seen there by reading or by direct
        access; so what the next places would add together bounds its score. Reading stops once that is strictly below the k-th score.
        """
        has = self.starts[terms + 1] > self.starts[terms]
        terms, times = terms[has], times[has]
        first, last = self.starts[terms], self.starts[terms + 1]
        best, read, step = first.copy(), first.copy(), FIRST_READ
        docs, scores, marked = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        while len(terms):
            to = np.minimum(read + step, last)
            new = np.unique(self.doc[common.ragged_arange(read, to - read)])
            new = new[~self.met[new]]
            read, step = to, min(2 * step, MOST_READ)
            if len(new):
                self.met[new] = True
                places = self.direct(terms, new)
                there = places >= 0
                scores = np.concatenate([scores, np.where(there, self.impact[places], 0).T @ times])
                docs = np.concatenate([docs, new])
                marked.append(places[there])
                self.seen[marked[-1]] = True
            for j in range(len(terms)):  # best positions move over what is seen
                while best[j] < last[j] and self.seen[best[j]]:
                    ahead = self.seen[best[j] : min(best[j] + 256, last[j])]
                    best[j] += len(ahead) if ahead.all() else int(ahead.argmin())
            open_ = best < last
            bound = int(self.impact[best[open_]] @ times[open_])
            kth = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0
            if bound <= 0 or bound < kth:
                break
        for places in marked:
            self.seen[places] = False
        self.met[docs] = False
        docs, scores = docs[scores > 0], scores[scores > 0]
        top = np.lexsort((docs, -scores))[:k]
        return docs[top], scores[top], int((read - first).sum())


def _searcher(items, weights, documents: int, length: int, k: int):
    def search(table: pa.Table) -> pa.Table:
        ids, starts, terms, times = items.value
        table = table.combine_chunks()
        order = pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending")])  # null ids last
        table = table.take(order)
        doc_ids, n = table.column("doc_id").combine_chunks(), table.column("n").to_numpy()
        lists = table.column("terms").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        numbers, counts = lists.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        docs = np.repeat(np.arange(len(sizes)), sizes)
        m = 25 + (75 * n * documents) // max(length, 1)
        impacts = weights.value[numbers] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[docs]))
        shard = Shard(numbers, docs, impacts, len(sizes), len(weights.value))
        out = [(np.zeros(0, np.int64),) * 3]
        for i in range(len(ids)):
            span = slice(starts[i], starts[i + 1])
            found, scores, _ = shard.search(terms[span], times[span], k)
            out.append((np.full(len(found), ids[i]), found, scores))
        item, found, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        common.release()
        return pa.table({"item": item, "doc_id": doc_ids.take(pa.array(found)), "score": scores})

    return search


def _block(spark, docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``(item, doc_id, score)``: the best documents of each item in each shard."""
    rows = items.toPandas()  # at most BLOCK_TERMS terms or so
    each = [np.unique(np.asarray(t, np.int64).view(np.uint64), return_counts=True) for t in rows["terms"]]
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t for t, _ in each]]))
    sc = spark.sparkContext
    found = common.checkpoint(docs.mapInArrow(_counter(sc.broadcast(known)), "doc_id long, n long, terms array<int>, counts array<int>").where("n > 0"))
    documents, length, postings = found.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms").cast("long"))).first()
    df = np.zeros(len(known), np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    starts = np.cumsum([0, *[len(t) for t, _ in each]])
    terms, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.searchsorted(known, t) for t, _ in each], [c for _, c in each]))
    search = _searcher(sc.broadcast((rows["item"].to_numpy(np.int64), starts, terms, times)), sc.broadcast(weights), documents, length or 0, k)
    shards = max(1, -(-(postings or 0) // SHARD_POSTINGS))
    dealt = found.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))  # of written rows, so a repeated task deals them alike
    return dealt.groupBy("shard").applyInArrow(lambda key, table: search(table), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring rows of ``docs(doc_id, text)`` for every row of ``items(item_id, text)``.

    Scores as the contract of op11 states them, over whole texts; only scores above 0 count. Null texts have no terms; a document or item
    without terms is in no result. Equal scores go by ascending doc_id, null ids last; repeated rows are documents or items each. Empty tables give
    no rows. Terms are told apart by 64-bit hashes. Items beyond ``block_terms`` terms are searched in blocks, each over all documents. Documents are
    dealt to shards row by row, so that no id, term or group of copies weighs on one of them.
    """
    spark = docs.sparkSession
    asked = common.checkpoint(common.only(items, item_id="item_id", text="text").withColumn("item", F.monotonically_increasing_id()))
    terms = common.checkpoint(asked.select("item", "text").mapInArrow(_item_terms, "item long, terms array<long>").where(F.size("terms") > 0))
    total = terms.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    rows, blocks = common.only(docs, doc_id="doc_id", text="text"), max(1, -(-total // block_terms))
    found = [_block(spark, rows, terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k) for b in range(blocks)]
    best = found[0]
    for x in found[1:]:
        best = best.union(x)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
