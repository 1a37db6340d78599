"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays that workers map.

Counting: tasks aggregate their bigrams, deal them to shards by the history's hash (histories with
many tokens by the whole bigram's), and each shard writes its sorted bigram keys and counts to the
shared folder. A second shuffle by word sums what smoothing needs of each word. Scoring maps those
files and looks every event up by binary search.
"""

from __future__ import annotations

import mmap
import os
import shutil
import sys
import tempfile
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashes that stand for a text's begin and end.
BEGIN, END = np.uint64(1), np.uint64(2)
#: A history with more than this share of the tokens is dealt by the whole bigram; at most 1 / HOT_SHARE such words exist.
HOT_SHARE = 1 / 500
#: Text bytes handled at a time inside a task, and text bytes for each shard of the model.
SLICE_BYTES, SHARD_BYTES = 4 << 20, 8 << 20
#: Model files that a worker keeps mapped at once.
MAPPED_FILES = 20_000
#: Columns of a word's row in the model.
COUNT, AFTER, ONE, TWO, MORE, BEFORE = range(6)


@dataclass(frozen=True)
class Model:
    """What a task needs to score: the files' folder and a few totals."""

    folder: str
    bits: int
    hot: tuple[int, ...]
    train_tokens: int
    vocabulary: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    bigram_types: int
    low_gamma: float


def events(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History and word hash of each event of each text, and the texts' event offsets: its words, then one end."""
    words, at = common.word_hashes(raw, offsets)
    rows = len(offsets) - 1
    ends = at + np.arange(rows + 1)
    word = np.empty(len(words) + rows, np.uint64)
    word[np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(at))] = words
    word[ends[1:] - 1] = END
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[ends[:-1]] = BEGIN
    return history, word, ends


def bigram_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return common.mix64(common.mix64(history + common.GOLDEN) * common.MIX_B + word)


def _shards(history: np.ndarray, keys: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """Shard of each bigram: by its history, or by the whole bigram where the history is hot."""
    spread = common.mix64(history ^ common.GOLDEN)
    at = np.minimum(np.searchsorted(hot, history), max(len(hot) - 1, 0))
    if len(hot):
        spread = np.where(hot[at] == history, keys, spread)
    return (spread >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)


def _word_shards(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays to one file, under its final name at once, so that a repeated task leaves the same file.

    The file holds the number of arrays, then of each its type, rows and columns, then their bytes, all in eights.
    """
    head = [len(arrays)]
    for x in arrays:
        head += [ord(x.dtype.kind) << 8 | x.dtype.itemsize, x.shape[0], x.shape[1] if x.ndim > 1 else 0]
    parts = [np.array(head, np.int64).tobytes()]
    for x in arrays:
        body = np.ascontiguousarray(x).tobytes()
        parts.append(body + bytes(-len(body) % 8))
    part = f"{name}.{uuid.uuid4().hex}.part"
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        os.makedirs(url.path, exist_ok=True)
        with open(f"{url.path}/{part}", "wb") as out:
            out.writelines(parts)
        os.replace(f"{url.path}/{part}", f"{url.path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{part}") as out:
        for body in parts:
            out.write(body)
    store.move(f"{path}/{part}", f"{path}/{name}")


def _map(file) -> mmap.mmap:
    """Map an open file; the map keeps no descriptor where Python can do without."""
    if sys.version_info >= (3, 13):
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


def _mapped(folder: str, name: str) -> list[np.ndarray]:
    """Memory-map a file's arrays; from a store without local paths, by an unlinked local copy."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        with open(f"{url.path}/{name}", "rb") as file:
            held = _map(file)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{path}/{name}") as source, tempfile.TemporaryFile() as copy:
            while block := source.read(1 << 22):
                copy.write(block)
            copy.flush()
            held = _map(copy)
    n = int(np.frombuffer(held, np.int64, 1)[0])
    head = np.frombuffer(held, np.int64, 3 * n, 8).reshape(n, 3).tolist()
    at, out = 8 + 24 * n, []
    for kind, rows, columns in head:
        dtype = np.dtype(f"{chr(kind >> 8)}{kind & 255}")
        size = rows * max(columns, 1)
        own = np.frombuffer(held, dtype, size, at)
        out.append(own.reshape(rows, columns) if columns else own)
        at += -(-size * dtype.itemsize // 8) * 8
    return out


def frequent_words(train: DataFrame, text: str) -> tuple[int, ...]:
    """Hashes of words that hold more than HOT_SHARE of the tokens: slices report words above half that share."""

    def heavy(batches):
        for batch in batches:
            for _, _, raw, offsets in common.row_slices(batch.column(0), SLICE_BYTES):
                history, _, _ = events(raw, offsets)
                history.sort()
                first = common.runs(history)
                n = np.diff(np.append(first, len(history)))
                kept = n >= max(2, len(history) * HOT_SHARE / 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(history[first][kept], 0).view(np.int64)), pa.array(np.append(n[kept], len(history)))], ["word", "n"])

    counted = train.select(text).mapInArrow(heavy, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    tokens = F.max(F.when(F.col("word") == 0, F.col("n"))).over(_whole())
    rows = counted.withColumn("tokens", tokens).where((F.col("word") != 0) & (F.col("n") > F.col("tokens") * HOT_SHARE)).select("word").collect()  # at most 1 / HOT_SHARE rows
    return tuple(sorted(r["word"] & (2**64 - 1) for r in rows))


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts, kept inside (0, count)."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(np.clip(x, 0.05, k - 0.05)) for k, x in zip((1, 2, 3), d, strict=True))


def fit(train: DataFrame, text: str = "text") -> Model:
    """Count a bigram model over every row of ``train`` and write it to the shared checkpoint folder."""
    spark = train.sparkSession
    bits = int(np.log2(common.power_of_two_at_least(common.total_bytes(train, text) / SHARD_BYTES)))
    hot = frequent_words(train, text)
    folder = f"{common.checkpoint_dir(spark).rstrip('/')}/bigram-model-{uuid.uuid4().hex}"

    def count(batches):
        hot_words = np.array(hot, np.uint64)
        for batch in batches:
            for _, _, raw, offsets in common.row_slices(batch.column(0), SLICE_BYTES):
                history, word, _ = events(raw, offsets)
                keys = bigram_keys(history, word)
                shard = _shards(history, keys, hot_words, bits)
                order = np.lexsort((keys, shard)) if bits else np.argsort(keys)
                keys, history, word, shard = keys[order], history[order], word[order], shard[order]
                first = common.runs(keys)
                n = np.diff(np.append(first, len(keys))).astype(np.uint32)
                history, word, shard = history[first], word[first], shard[first]
                spans = common.run_spans(shard)
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([shard[a] for a, _ in spans]), cut(history), cut(word), cut(n)], ["shard", "history", "word", "n"])

    def merge(key, table):
        history, word, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in (("history", np.uint64), ("word", np.uint64), ("n", np.uint32)))
        keys = bigram_keys(history, word)
        order = np.argsort(keys, kind="stable")
        keys, history, word = keys[order], history[order], word[order]
        first = common.runs(keys)
        n = np.add.reduceat(n[order].astype(np.int64), first)
        keys, history, word = keys[first], history[first], word[first]
        name = f"bigrams-{key[0].as_py():06d}"
        large = n > 254
        _save(folder, name, keys, np.where(large, 255, n).astype(np.uint8), keys[large], n[large])
        # What smoothing needs of each word, as history and as word.
        order = np.argsort(history)
        h, m = history[order], n[order]
        at = common.runs(h)
        add = lambda x: np.add.reduceat(x.astype(np.int64), at)
        left = np.stack([np.zeros(len(at), np.int64), add(m), add(m == 1), add(m == 2), add(m > 2), np.zeros(len(at), np.int64)])
        order = np.argsort(word)
        w, m2 = word[order], n[order]
        at2 = common.runs(w)
        right = np.zeros((6, len(at2)), np.int64)
        right[COUNT] = np.add.reduceat(m2, at2)
        right[BEFORE] = np.diff(np.append(at2, len(w)))
        words, rows = _merged(np.concatenate([h[at], w[at2]]), np.concatenate([left, right], axis=1))
        return _word_table(words, rows, [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n)])

    def _merged(words, rows):
        order = np.argsort(words)
        words, rows = words[order], rows[:, order]
        at = common.runs(words)
        return words[at], np.add.reduceat(rows, at, axis=1)

    def _word_table(words, rows, types):
        part = _word_shards(words, bits)
        spans = common.run_spans(part)
        small = rows.astype(np.uint32) if rows.max(initial=0) < 2**32 else rows
        return pa.table(
            {
                "part": pa.array([int(part[a]) for a, _ in spans] + [-1]),
                "words": pa.array([words[a:b].tobytes() for a, b in spans] + [b""], pa.binary()),
                "stats": pa.array([np.ascontiguousarray(small[:, a:b]).tobytes() for a, b in spans] + [np.array(types, np.int64).tobytes()], pa.binary()),
                "wide": pa.array([small.dtype.itemsize == 8] * (len(spans) + 1)),
            }
        )

    def words(key, table):
        part = key[0].as_py()
        held, stats, wide = (table.column(c).to_pylist() for c in ("words", "stats", "wide"))
        totals = np.zeros(13, np.int64)
        if part < 0:  # each bigram shard's counts of counts
            totals[:5] = np.sum([np.frombuffer(s, np.int64) for s in stats], axis=0)
        else:
            found, rows = _merged(
                np.concatenate([np.frombuffer(x, np.uint64) for x in held]),
                np.concatenate([np.frombuffer(s, np.int64 if x else np.uint32).reshape(6, len(h) // 8).astype(np.int64) for s, x, h in zip(stats, wide, held, strict=True)], axis=1),
            )
            _save(folder, f"words-{part:06d}", found, (rows.astype(np.uint32) if rows.max(initial=0) < 2**32 else rows).T)
            seen = rows[BEFORE]
            totals[5:] = [rows[COUNT].sum(), (rows[COUNT] > 0).sum(), *[(seen == k).sum() for k in (1, 2, 3, 4)], (seen > 2).sum(), seen.sum()]
        return pa.table({f"t{i}": pa.array([int(x)]) for i, x in enumerate(totals)})

    # Every shard and part gets an empty row, so that each writes a file and a missing one is an error, not an empty shard.
    every = spark.range(1 << bits)
    none = F.lit(b"").cast("binary")
    blobs = train.select(text).mapInArrow(count, "shard long, history binary, word binary, n binary").union(every.select("id", none, none, none))
    per_word = blobs.groupBy("shard").applyInArrow(merge, "part long, words binary, stats binary, wide boolean").union(every.select("id", none, none, F.lit(False)))
    # The shards' counts of counts (part -1) are a row each; spread by a part of their own each is not needed: 40 bytes a row.
    totals = per_word.groupBy("part").applyInArrow(words, ", ".join(f"t{i} long" for i in range(13))).agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(13)]).first()
    t = [int(x or 0) for x in totals]
    low = _discounts(*t[7:11])
    types = max(t[12], 1)
    gamma = (low[0] * t[7] + low[1] * t[8] + low[2] * t[11]) / types
    return Model(folder, bits, hot, t[5], t[6], _discounts(*t[:4]), low, types, gamma if t[12] else 1.0)


_OPENED: dict[str, dict[str, list[np.ndarray]]] = {}


def _arrays(model: Model, name: str) -> list[np.ndarray]:
    """A model file mapped by this worker, the latest ones kept. Each shard has a file; a missing or short one raises."""
    if model.folder not in _OPENED:
        _OPENED.clear()
        _OPENED[model.folder] = {}
    held = _OPENED[model.folder]
    if name not in held:
        if len(held) >= MAPPED_FILES:
            held.pop(next(iter(held)))
        held[name] = _mapped(model.folder, name)
    return held[name]


def delete(model: Model) -> None:
    """Remove a model's files, once nothing that scores with it will run again."""
    url = urlparse(model.folder)
    if url.scheme in ("", "file"):
        shutil.rmtree(url.path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(model.folder)
    store.delete_dir(path)


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def word_rows(model: Model, asked: np.ndarray) -> np.ndarray:
    """Statistics of sorted distinct words, zeros where a word wasn't seen."""
    out = np.zeros((len(asked), 6), np.int64)
    part = _word_shards(asked, model.bits)
    for a, b in common.run_spans(part):
        held = _arrays(model, f"words-{part[a]:06d}")
        at, ok = _found(held[0], asked[a:b])
        out[a:b][ok] = held[1][at[ok]]
    return out


def bigram_counts(model: Model, shard: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts of bigrams ordered by shard and key, 0 where one wasn't seen."""
    out = np.zeros(len(keys), np.int64)
    for a, b in common.run_spans(shard):
        held = _arrays(model, f"bigrams-{shard[a]:06d}")
        at, ok = _found(held[0], keys[a:b])
        n = np.zeros(b - a, np.int64)
        n[ok] = held[1][at[ok]]
        large = np.flatnonzero(n == 255)
        if len(large):
            n[large] = held[3][np.searchsorted(held[2], keys[a:b][large])]
        out[a:b] = n
    return out


def log_probabilities(model: Model, history: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each event, and the count of each event's word in training."""
    if not len(word):
        return np.zeros(0), np.zeros(0, np.int64)
    uniform = 1.0 / (model.vocabulary + 1)
    low_d, d = np.array((0.0, *model.low_discounts)), np.array((0.0, *model.discounts))
    both, _, number = common.distinct(np.concatenate([history, word]))
    stats = word_rows(model, both)
    of_history, of_word = number[: len(word)], number[len(word) :]
    before = stats[:, BEFORE]
    lower = (before - low_d[np.minimum(before, 3)]) / model.bigram_types + model.low_gamma * uniform
    keys = bigram_keys(history, word)
    shard = _shards(history, keys, np.array(model.hot, np.uint64), model.bits)
    order = np.lexsort((keys, shard)) if model.bits else np.argsort(keys)
    ordered = keys[order]
    first = common.runs(ordered)
    counts = bigram_counts(model, shard[order][first], ordered[first])
    n = np.empty(len(keys), np.int64)
    n[order] = np.repeat(counts, np.diff(np.append(first, len(keys))))
    after = stats[:, AFTER]
    with np.errstate(divide="ignore", invalid="ignore"):
        gamma = np.where(after > 0, (d[1] * stats[:, ONE] + d[2] * stats[:, TWO] + d[3] * stats[:, MORE]) / after, 1.0)
        own = np.where(after[of_history] > 0, (n - d[np.minimum(n, 3)]) / after[of_history], 0.0)
    return np.log10(own + gamma[of_history] * lower[of_word]), stats[:, COUNT][of_word]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text: ``(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity)``.

    Tokens are the words and one end; a null or empty text is the end alone. ``base_score`` is the
    add-half unigram score. Rows stay one for one; an empty table gives none.
    """
    kept = common.only(docs, doc_id=doc_id, text=text)

    def run(batches):
        log_base = np.log10(model.train_tokens + 0.5 * (model.vocabulary + 1))
        for batch in batches:
            for a, b, raw, offsets in common.row_slices(batch.column(1), SLICE_BYTES):
                history, word, ends = events(raw, offsets)
                logs, count = log_probabilities(model, history, word)
                n = np.diff(ends)
                total = np.add.reduceat(logs, ends[:-1])
                base = np.add.reduceat(np.log10(count + 0.5) - log_base, ends[:-1])
                known = np.add.reduceat((count > 0).astype(np.int64), ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n), pa.array(known), pa.array(np.full(b - a, model.train_tokens)), pa.array(base), pa.array(total), pa.array(10.0 ** np.minimum(-total / n, 300))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

