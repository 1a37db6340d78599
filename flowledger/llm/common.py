"""Shared pieces of the corpus operators: table access, checkpoints, column hygiene, components."""

from __future__ import annotations

import ctypes
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Project to ``new=old`` columns, so that extra columns of any name can't clash with working names."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where it is unset, a temporary one if all runs on this machine.

    Raises on a cluster that names none: machines don't see each other's temporary folders.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    own = tempfile.mkdtemp(prefix="flowledger-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    shared = checkpoint_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def id_remainder(doc_id: str, divisor: int):
    """crc32 of the id's text modulo ``divisor``; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(divisor)), F.lit(0))


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in the table, used to choose numbers of shards that grow with the input."""
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def power_of_two_at_least(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
    else:
        column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(1)
def _trim():
    """The C library's call that gives freed memory back, where there is one."""
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except (OSError, TypeError):  # no such library on this system
        return None


def release() -> None:
    """Give the system back what this worker has freed: a worker serves many groups and stages, and each would leave its buffers to the next."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def run_spans(ordered: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    at = runs(ordered)
    return list(zip(at.tolist(), np.append(at, len(ordered))[1:].tolist(), strict=True))


def ragged_arange(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + l)`` for each pair."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


#: Odd multipliers of the 64-bit mixing steps below (splitmix64's published constants).
MIX_A, MIX_B, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and products of hashes spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    have = _POWERS[0]
    while len(have) < n:
        have = np.concatenate([have, have * (have[-1:] * GOLDEN)])
        _POWERS[0] = have
    return have[:n]


def _slices(raw: np.ndarray, offsets: np.ndarray, size: int, blank: np.ndarray):
    """Ranges of about ``size`` bytes that end at a row's start or at a blank, so that no word is cut."""
    n, at = len(raw), 0
    while at < n:
        stop = min(at + size, n)
        if stop < n:
            row = offsets[np.searchsorted(offsets, stop)]
            while stop < row and not blank[raw[stop]]:
                ahead = np.flatnonzero(blank[raw[stop : min(row, stop + 65536)]])
                stop = stop + int(ahead[0]) if len(ahead) else min(int(row), stop + 65536)
        yield at, stop
        at = stop


def _slice_words(raw: np.ndarray, row_starts: np.ndarray, apart: np.ndarray | None, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~blank[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[row_starts] = inside[row_starts]
    if apart is not None:
        begins |= apart
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    at = np.flatnonzero(inside)
    lengths = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    values = _RANDOM_BYTES[_LOWER[raw[at]]]
    values *= _powers(int(lengths.max()))[at - np.repeat(starts, lengths)]
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return mix64(sums + lengths.astype(np.uint64) * MIX_A), starts, lengths


def word_spans(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray | None = None, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length in bytes of the words ``[^ \\t-\\r]+`` of all rows, A-Z lower-cased; ``apart`` marks further places where a word starts, ``blank`` the bytes of no word.

    Works in slices, so that its own arrays stay small however long a text is.
    """
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    for a, b in _slices(raw, offsets, 1 << 18, blank):
        i, j = np.searchsorted(row_starts, [a, b])
        hashes, starts, lengths = _slice_words(raw[a:b], row_starts[i:j] - a, None if apart is None else apart[a:b], blank)
        parts.append((hashes, starts + a, lengths))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every row (see :func:`word_spans`), and each row's word offsets."""
    hashes, starts, _ = word_spans(raw, offsets)
    return hashes, np.searchsorted(starts, offsets)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def is_blank(raw: np.ndarray) -> np.ndarray:
    return _BLANK[raw]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, one place of each and the distinct value's number of every value."""
    order = np.argsort(values)
    ordered = values[order]
    first = runs(ordered)
    number = np.empty(len(values), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(values))))
    return ordered[first], order[first], number


def row_slices(column: pa.Array, limit: int, most_rows: int = 1 << 31):
    """Row ranges of a text column of about ``limit`` bytes, with their bytes and offsets."""
    raw, offsets = text_buffer(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        stop = min(stop, at + most_rows, rows)
        yield at, stop, raw[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that stand end to end in ``data``; ``ends`` are byte offsets, one more than values."""
    kind, width = (pa.binary(), np.int32) if ends[-1] < 2**31 else (pa.large_binary(), np.int64)
    found = pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(np.ascontiguousarray(data))])
    return found if kind == pa.binary() else found.cast(pa.binary())


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of undirected ``edges(a, b)``: rows ``(node, component)``.

    Alternating large-star and small-star rounds; each keeps at most as many edges as it was given,
    hubs are pre-aggregated by the partial minimum, and each round's edges are checkpointed.
    Nodes without an edge to another node don't appear. An empty table gives an empty table.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        kept = large.join(least, large["a"] == least["n"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpoint(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(roots.select("component", "component").distinct())
