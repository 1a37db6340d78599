"""Word-level BPE encoding by whitespace words, and the exact token-length histogram.

The tokenizer drops white space before it merges, so a text's ids are the ids of its
space-separated words end to end. Each worker encodes a distinct word once and keeps its ids, by
the word's 64-bit hash, in arrays of bounded size.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words a worker keeps (some 25 bytes each), and text bytes encoded at a time.
CACHE_WORDS, SLICE_BYTES = 1 << 20, 2 << 20
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


class WordEncoder:
    """Ids of texts by the library's tokenizer at ``path`` (no special tokens added).

    Needs a normaliser that works character by character and a pre-tokenizer that drops white
    space and cuts letters from marks, as ``word_bpe_49k.json`` has.
    """

    #: Latin letters, which the pre-tokenizer never cuts and whose small letters are letters too.
    latin = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words that are normal already: small Latin letters, composed, or other ASCII.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.cache_words = cache_words
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first row, end row, ids, offsets)`` of ranges of rows of a text column: row i has the ids between offsets i and i + 1.

        Ids are unsigned 32-bit; a null text counts as empty.
        """
        for a, b, raw, offsets in common.row_slices(column, SLICE_BYTES):
            ids, ends = self._slice(raw, offsets)
            odd = self._odd_rows(raw, offsets)
            if len(odd):  # the library sees the whole text
                parts = [ids[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                for r in odd.tolist():
                    text = raw[offsets[r] : offsets[r + 1]].tobytes().decode()
                    parts[r] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                ids, ends = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
            yield a, b, ids, ends

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each of a list of texts."""
        out = []
        for _, _, ids, ends in self.encode(pa.array(texts, pa.string())):
            out += [ids[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return out

    @staticmethod
    def _odd_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that may spell out a special token, or hold a combining mark, which composes with a capital otherwise than with its small letter."""
        at = np.flatnonzero((raw == 0xCC) | (raw == 0xCD))
        if len(raw) > 1:
            at = np.concatenate([at, np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))])
        return np.unique(np.searchsorted(offsets, at, "right") - 1)

    def _slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # A closing mark is a word of its own: the pre-tokenizer cuts it from the letter before it.
        apart = np.zeros(len(raw), bool)
        if len(raw) > 2:
            apart[1:-1] = _LETTER[raw[:-2]] & _MARK[raw[1:-1]] & common.is_blank(raw[2:])
            apart[offsets[offsets < len(raw)]] = False
        words, start, length = common.word_spans(raw, offsets, apart)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        key, place, number = common.distinct(words)
        row, known = self._find(key)
        if not known.all():
            new = np.flatnonzero(~known)
            low = common.lower_ascii(raw).tobytes()
            spelt = [low[s : s + n] for s, n in zip(start[place[new]].tolist(), length[place[new]].tolist(), strict=True)]
            if len(self.keys) + len(new) > self.cache_words:  # of the words so far, those of this slice stay
                row = row[known]
                first, count = self.first[row], self.count[row]
                self.ids = self.ids[common.ragged_arange(first, count)]
                self.keys, self.first, self.count = key[known], (np.cumsum(count) - count).astype(np.int32), count
            self._keep(key[new], *self.learn(spelt))
            row, _ = self._find(key)
        first, count = self.first[row][number], self.count[row][number]
        ends = np.append(0, np.cumsum(count, dtype=np.int64))
        return self.ids[common.ragged_arange(first, count)], ends[np.searchsorted(start, offsets)]

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return row, self.keys[row] == key

    def _keep(self, key: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        at = np.searchsorted(self.keys, key)
        first = len(self.ids) + np.cumsum(count) - count
        self.keys, self.first, self.count = np.insert(self.keys, at, key), np.insert(self.first, at, first), np.insert(self.count, at, count)
        self.ids = np.concatenate([self.ids, ids])

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (A-Z lower-cased) end to end, and how many each has; Latin words are coded many to a call."""
        latin = self.latin.fullmatch
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, w in enumerate(words):
            kinds[(0 if w.isalpha() else 1) if w.isascii() else 0 if latin(w.decode()) else 2].append(i)
        plain, ascii_only, others = kinds
        count, parts = np.zeros(len(words), np.int64), []
        groups = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        joined = [b" ".join([words[i] for i in g]).decode().lower() for g in groups]
        for group, coded in zip(groups, self.bare.encode_batch(joined, add_special_tokens=False), strict=True):
            count[group] = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(group))
            parts.append(np.array(coded.ids, np.uint32))
        for some, coder in ((ascii_only, self.bare), (others, self.tokenizer)):
            for i, coded in zip(some, coder.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False), strict=True):
                count[i] = len(coded)
                parts.append(np.array(coded.ids, np.uint32))
        ids = np.concatenate(parts)
        order = np.array(plain + ascii_only + others, np.int64)
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return ids[common.ragged_arange(first, count)], count


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder for a tokenizer file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop the worker's encoders, with their tokenizers and words, where later stages need none."""
    _ENCODERS.clear()


def encoded_lengths(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, length)``: the number of ids of each whole text (null or empty: 0)."""

    def lengths(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            for a, b, _, ends in coder.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(ends))], ["doc_id", "length"])

    kept = common.only(docs, doc_id=doc_id, text=text)
    return kept.mapInArrow(lengths, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, length long")


def length_histogram(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_ids: int = 0) -> DataFrame:
    """Exact histogram of encoded lengths with suffix sums, one row per distinct length.

    ``end_ids`` is added to every length (for end-of-text ids). Columns: ``length``, ``n_docs``,
    ``docs_at_least`` and ``tokens_at_least`` (documents this long or longer),
    ``docs_at_most``, ``truncated_tokens`` (all tokens if the context limit is ``length``).
    A null or empty text has length ``end_ids``; repeated rows count each time; an empty table
    gives no rows. Suffix sums run inside ranges of 1,024 lengths and over the ranges' totals,
    so no task holds more than the distinct lengths of a range or one row per range.
    """
    hist = encoded_lengths(docs, tokenizer, doc_id, text).groupBy((F.col("length") + end_ids).alias("length")).agg(F.count("*").alias("n_docs"))
    return suffix_sums(hist)


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Suffix sums of ``hist(length, n_docs)``; see :func:`length_histogram`."""
    from pyspark.sql import Window

    hist = common.checkpoint(hist.withColumn("span", F.shiftright("length", 10)))
    totals = hist.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        F.col("span").alias("s"),
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(everything).alias("d_all"),
        F.sum("t").over(everything).alias("t_all"),
    )
    inside = Window.partitionBy("span").orderBy(F.desc("length"))
    at_least = F.sum("n_docs").over(inside) + F.col("d_above")
    tokens = F.sum(F.col("n_docs") * F.col("length")).over(inside) + F.col("t_above")
    joined = hist.join(totals, hist["span"] == totals["s"]).withColumns({"docs_at_least": at_least, "tokens_at_least": tokens})
    return joined.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (F.col("t_all") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("length")).alias("truncated_tokens"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, tokens)``: all tokens kept when each document is cut at each context limit (null if there are no documents).

    One pass over the suffix sums: what lies beyond a limit is read off the row of the least length above it.
    """
    asked = sorted({int(x) for x in limits})
    above = [F.min_by(F.struct("tokens_at_least", "docs_at_least"), F.when(F.col("length") > x, F.col("length"))) for x in asked]
    found = sums.agg(F.max("tokens_at_least").alias("all"), *[a.alias(f"a{i}") for i, a in enumerate(above)])
    over = lambda i, x: F.coalesce(F.col(f"a{i}.tokens_at_least") - F.col(f"a{i}.docs_at_least") * x, F.lit(0))
    rows = F.array(*[F.struct(F.lit(x).cast("long").alias("context_limit"), (F.col("all") - over(i, x)).cast("long").alias("tokens")) for i, x in enumerate(asked)])
    return found.select(F.explode(rows).alias("r")).select("r.*")


def length_quantile(sums: DataFrame, q: float) -> int | None:
    """Smallest length that at least a share ``q`` of the documents don't exceed (None if there are none)."""
    total = sums.agg(F.sum("n_docs")).first()[0]
    if not total:
        return None
    need = max(1, int(np.ceil(q * total)))
    return sums.where(F.col("docs_at_most") >= need).agg(F.min("length")).first()[0]
