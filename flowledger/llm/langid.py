"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order byte context tree; a symbol that a context hasn't seen costs an
escape and is coded in the next shorter context. Statistics are frozen after fitting, so the code
length of every (context, symbol) is a constant: contexts and symbols of all languages are kept in
one hash table for each order, with a row of code lengths a language each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Longest context in bytes; documents and bytes of training text a language, at most.
ORDER, SAMPLE_DOCS, SAMPLE_BYTES = 4, 400, 1_000_000
#: Documents of a label that are ordered, for each one of the sample.
SPARE = 8
#: Prediction for texts without a letter.
UNDETERMINED = "und"
#: Bytes scored at a time.
SLICE = 1 << 18


@dataclass
class Table:
    """Open hash table from 64-bit keys (never 0) to row numbers."""

    keys: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(keys: np.ndarray) -> Table:
        size = common.power_of_two_at_least(4 * len(keys) + 16)
        held, rows = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        slot = Table.slot(keys, size)
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = held[at] == 0
            held[at[free]] = keys[left[free]]  # of several for one slot, one stays
            won = held[at] == keys[left]
            rows[at[won]] = left[won]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (size - 1)
        return Table(held, rows)

    @staticmethod
    def slot(keys: np.ndarray, size: int) -> np.ndarray:
        return ((keys * common.GOLDEN) >> np.uint64(64 - int(math.log2(size)))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it isn't there."""
        size = len(self.keys)
        slot = self.slot(keys, size)
        held = self.keys[slot]
        out = np.where(held == keys, self.rows[slot], -1)
        on = np.flatnonzero((held != keys) & (held != 0))
        while len(on):
            slot[on] = (slot[on] + 1) & (size - 1)
            held = self.keys[slot[on]]
            hit = held == keys[on]
            out[on[hit]] = self.rows[slot[on[hit]]]
            on = on[~hit & (held != 0)]
        return out


@dataclass
class Model:
    """Languages; for each order the table of contexts with escape costs, and of context-symbol strings with code lengths."""

    languages: list[str]
    grams: list[Table]
    costs: list[np.ndarray]
    contexts: list[Table]
    escapes: list[np.ndarray]


def _grams(raw: np.ndarray, length: int) -> np.ndarray:
    """Key of the ``length`` bytes that end at each place (places before the first whole one are left out)."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.ones(n, np.uint64)
    for i in range(length):
        key = (key << np.uint64(8)) | raw[i : i + n]
    return key


def fit_texts(samples: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """Fit from texts of each language: method C escapes (a context with t distinct symbols in n escapes with t / (n + t))."""
    languages = sorted(samples)
    if not languages:
        return Model([], [], [], [], [])
    counted: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for name in languages:
        by_order = []
        for k in range(order + 1):
            keys = [_grams(np.frombuffer(b"\n" + t, np.uint8), k + 1) for t in samples[name]]
            by_order.append(np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True))
        counted.append(by_order)
    grams, costs, contexts, escapes = [], [], [], []
    lower: np.ndarray | None = None
    for k in range(order + 1):
        union = np.unique(np.concatenate([c[k][0] for c in counted]))
        outer = np.unique(union >> np.uint64(8))
        escape = np.zeros((len(outer) + 1, len(languages)), np.float32)  # the last row: unseen by all
        cost = np.zeros((len(union), len(languages)), np.float32)
        parent = np.searchsorted(outer, union >> np.uint64(8))
        # Code length at the next shorter order, where a language hasn't seen the symbol here.
        shorter = np.full((len(union), len(languages)), 8.0, np.float32)  # below order 0: all bytes alike
        if k:
            short = (union & np.uint64((1 << (8 * k)) - 1)) | np.uint64(1 << (8 * k))
            shorter = lower[np.searchsorted(lower_keys, short)]
        for j, (keys, n) in enumerate(c[k] for c in counted):
            at = np.searchsorted(outer, keys >> np.uint64(8))
            total, distinct = np.bincount(at, n, len(outer)), np.bincount(at, minlength=len(outer))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape[:-1, j] = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            cost[:, j] = escape[parent, j] + shorter[:, j]
            place = np.searchsorted(union, keys)
            cost[place, j] = -np.log2(n / (total + distinct)[at])
        grams.append(Table.of(union))
        costs.append(cost)
        contexts.append(Table.of(outer))
        escapes.append(escape)
        lower, lower_keys = cost, union
    return Model(languages, grams, costs, contexts, escapes)


def code_lengths(model: Model, raw: np.ndarray) -> np.ndarray:
    """Code length in bits of each byte of ``raw`` in each language (rows: bytes). Contexts start at each text's leading newline."""
    out = np.full((len(raw), len(model.languages)), 8.0, np.float32)
    todo = np.arange(len(raw))
    added = None
    for k in range(len(model.grams) - 1, -1, -1):
        if not len(todo):
            break
        able = todo >= k
        key = np.ones(len(todo), np.uint64)
        for i in range(k, -1, -1):
            key = (key << np.uint64(8)) | raw[np.maximum(todo - i, 0)]
        row = model.grams[k].find(key)
        row[~able] = -1
        hit = row >= 0
        cost = model.costs[k][row[hit]]
        out[todo[hit]] = cost if added is None else cost + added[hit]
        miss = ~hit
        escaped = model.escapes[k][model.contexts[k].find(key[miss] >> np.uint64(8))]  # -1: the row of zeros
        escaped[~able[miss]] = 0
        added = escaped if added is None else added[miss] + escaped
        todo = todo[miss]
    if len(todo):
        out[todo] += added
    return out


def text_bits(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Total code length of each row's bytes in each language, in slices of bounded size."""
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    back, n, at = len(model.grams) - 1, len(raw), 0
    while at < n:
        stop = min(at + SLICE, n)
        first, last = int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, stop))
        rows = np.arange(first, last)
        rows = rows[offsets[rows] < offsets[rows + 1]]
        starts = offsets[rows]
        # A newline stands before each text, and a text that began earlier brings its last bytes along.
        begins = np.maximum(starts, at - back)
        sizes = np.minimum(offsets[rows + 1], stop) - begins
        whole = begins == starts
        length = sizes + whole
        place = np.cumsum(length) - length
        part = np.full(int(length.sum()), 10, np.uint8)
        part[common.ragged_arange(place + whole, sizes)] = raw[common.ragged_arange(begins, sizes)]
        bits = code_lengths(model, part)
        lead = whole + np.maximum(at - begins, 0)
        # No context reaches over a text's leading newline: the bytes just behind it are coded by what follows it.
        for back_at in range(1, back):
            some = np.flatnonzero(whole & (sizes >= back_at))
            if not len(some):
                break
            short = place[some] + back_at
            bits[short] = _short_context(model, part, short, back_at)
        bits[common.ragged_arange(place, lead)] = 0
        total[rows] += np.add.reduceat(bits, place, axis=0, dtype=np.float64)
        at = stop
    return total


def _short_context(model: Model, part: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Code lengths of bytes whose contexts hold ``most`` bytes at most (the leading newline included)."""
    added = np.zeros((len(at), len(model.languages)), np.float32)
    out = np.full((len(at), len(model.languages)), 8.0, np.float32)
    todo = np.arange(len(at))
    for k in range(min(most, len(model.grams) - 1), -1, -1):
        key = np.ones(len(todo), np.uint64)
        for i in range(k, -1, -1):
            key = (key << np.uint64(8)) | part[at[todo] - i]
        row = model.grams[k].find(key)
        hit = row >= 0
        out[todo[hit]] = model.costs[k][row[hit]] + added[todo[hit]]
        todo, key = todo[~hit], key[~hit]
        added[todo] += model.escapes[k][model.contexts[k].find(key >> np.uint64(8))]
    out[todo] += added[todo]
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample_docs`` texts, and ``sample_bytes`` bytes, of each label.

    Null labels, texts and ids and empty texts are left out; of rows of one id and label the least text counts. The documents of each label are those of smallest
    id hash, used whole; texts of over a twentieth of ``sample_bytes`` come after all others, so that they can't displace them. A label that has only such
    texts is learned from ten windows of its first. Only documents whose hash lies under a bound that a label's number of ids sets are
    ordered, so no task gets more than some SPARE * ``sample_docs`` of a label, and the driver gets no more than the sample.
    """
    kept = common.only(labelled, doc_id=doc_id, lang=lang, text=text).where("lang is not null and text is not null and doc_id is not null and text <> ''")
    hashed = F.xxhash64("doc_id")
    # A row a label, as the model has as well: small enough to broadcast.
    many = kept.groupBy(F.col("lang").alias("l")).agg(F.approx_count_distinct("doc_id").alias("ids"))
    near = kept.join(F.broadcast(many), kept["lang"] == many["l"]).where(F.shiftrightunsigned(hashed, 11) / 2.0**53 * F.col("ids") <= SPARE * sample_docs)
    one = near.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    size = F.octet_length("text")
    first = Window.partitionBy("lang").orderBy("long", "h", "doc_id")
    ranked = one.withColumns({"h": hashed, "b": size, "long": size > sample_bytes / 20}).withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample_docs)
    chosen = ranked.withColumn("sum", F.sum("b").over(first)).where((F.col("sum") <= sample_bytes) | (F.col("r") == 1))
    part = sample_bytes // 40  # characters, of up to four bytes
    windows = F.concat_ws("\n", *[F.substring(F.col("text"), (F.length("text") * i / 10).cast("int") + 1, F.lit(part)) for i in range(10)])
    rows = chosen.select("lang", F.when(F.col("b") > sample_bytes, windows).otherwise(F.col("text")).alias("text")).collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return fit_texts(samples)


def annotate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte`` of every whole text.

    ``lang_pred`` is the label of least code length (ties: the first in order), and ``score`` its
    share of the languages' probabilities for an average hundred bytes of the text. A text that is
    null or has no letter gets ``und`` with score 0, as does every text if there was nothing to
    learn from. Columns of these three names are replaced; an empty table gives no rows.
    """
    added = ("lang_pred", "score", "bits_per_byte")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's bytes
    columns = [c for c in docs.columns if c not in added]
    kept = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    at = columns.index(text)

    def run(batches):
        common.release()
        own = shared.value
        for batch in batches:
            raw, offsets = common.text_buffer(batch.column(at))
            n = batch.num_rows
            letters = np.array([has_letter(t) for i in range(0, n, 256) for t in batch.column(at).slice(i, 256).to_pylist()], bool)
            if not own.languages:
                letters[:] = False
                best, score, rate = np.zeros(n, int), np.zeros(n), np.zeros(n)
            else:
                bits = text_bits(own, raw, offsets)
                size = np.maximum(np.diff(offsets), 1)
                best, least = bits.argmin(axis=1), bits.min(axis=1)
                gap = (bits - least[:, None]) * (np.minimum(size, 100) / size)[:, None]
                score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
                rate = least / size
            pred = [own.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(rate)], [*batch.schema.names, *added])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    done = kept.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], *added)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, bits_per_byte)`` of every whole text; see :func:`annotate`."""
    return annotate(common.only(docs, doc_id=doc_id, text=text), model).drop("text")
