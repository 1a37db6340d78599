"""Removal of repeated passages of at least a given number of bytes, by suffix arrays of content-dealt shards.

Every window of ``length`` bytes belongs to the stretch of windows that share its least gram hash,
so equal windows lie in stretches of one hash. Stretches whose hash occurs once can't repeat and go no further.
The others travel, with their bytes, to the shard of their hash; a chunk sends equal stretches once.
A shard sorts its suffixes by induced sorting, computes their permuted common prefixes and keeps each window's earliest start.
Where very many different stretches share one hash (the surroundings of a very common line), no shard gets
them all: their windows are dealt one by one, by two 64-bit hashes of all their bytes, and of a chunk's equal windows only the earliest travels with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of a gram; text bytes of a chunk of documents, for each shard, and of the slices inside a task.
GRAM, CHUNK_BYTES, SHARD_BYTES, SLICE = 32, 2 << 20, 1 << 20, 1 << 18
#: Stretches of one hash beyond this number are hot: their windows are dealt by their own hashes instead.
HOT_STRETCHES = 500
_TABLES = [common.mix64(np.arange(1, 257, dtype=np.uint64) * m) for m in (common.MIX_B, common.MIX_A)]
_BASES = (int(common.GOLDEN), 0xD6E8FEB86659FD93)
#: Words of eight symbols compared at once, at most.
_MOST_WORDS = 1 << 10
NO_ID = np.iinfo(np.int64).max


def rolling_hash(raw: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Polynomial hash of every ``length`` bytes, from hashes of powers of two."""
    power = lambda n: np.uint64(pow(_BASES[which], n, 1 << 64))
    part, size, done, held, left = _TABLES[which][raw], 1, None, 0, length
    while left:
        if left & size:
            if done is None:
                done, held = part.copy(), size
            else:
                n = min(len(done), len(part) - held)
                done = done[:n] * power(size) + part[held : held + n]
                held += size
            left -= size
        if left:
            part = part[:-size] * power(size) + part[size:]
            size *= 2
    return common.mix64(done)


def stretches(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one least gram hash: first window, number of windows, hash, and whether windows inside may be equal."""
    grams = min(GRAM, length)
    span = length - grams + 1
    out = [[], [], [], []]
    for at in range(0, max(len(raw) - length + 1, 0), SLICE):
        stop = min(at + SLICE, len(raw) - length + 1)
        part = raw[at : stop + length - 1]
        gram = rolling_hash(part, grams)
        least, size = gram, 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            rest = span - size
            least = np.minimum(least[: len(least) - rest], least[rest:])
        least = least[: stop - at]
        rows = np.arange(max(int(np.searchsorted(offsets, at, "right")) - 1, 0), int(np.searchsorted(offsets, stop)))
        begin, end = np.maximum(offsets[rows], at), np.minimum(offsets[rows + 1] - length + 1, stop)
        some = end > begin
        if not some.any():
            continue
        window = common.ragged_arange(begin[some] - at, (end - begin)[some])
        value = least[window]
        new = np.append(True, (value[1:] != value[:-1]) | (window[1:] != window[:-1] + 1))
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(window)))
        # The least gram leaves the window and stays the least: the stretch holds it twice.
        twice = np.append((gram[window[:-1]] == value[:-1]) & ~new[1:], False)
        # Least values crowd near 0: mixed again, they deal evenly.
        for held, x in zip(out, (window[start] + at, count, common.mix64(value[start] + common.GOLDEN), np.add.reduceat(twice, start) > 0), strict=True):
            held.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.uint64, bool), strict=True))


# --- induced sorting -------------------------------------------------------------------------


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last symbol must be the only least one."""
    differ = np.flatnonzero(text[:-1] != text[1:])
    smaller = text[differ] < text[differ + 1]
    return np.append(np.repeat(smaller, np.diff(np.append(-1, differ))), True)


def _named_substrings(text: np.ndarray, places: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Names, in order of size, of the substrings between leftmost-smaller ``places``, and where each place's first name stands.

    Symbols of ``bits`` bits are packed, up to seven to a name; longer substrings are cut. Of two names that agree, the one that ends first is larger.
    """
    most = min(7, 60 // bits)
    gap = np.diff(np.append(places, len(text)))
    gap[-1] = 1
    pieces = -(-gap // most)  # the last piece takes in the next place's symbol if it is shorter
    sample = common.ragged_arange(np.zeros(len(places), np.int64), pieces) * most + np.repeat(places, pieces)
    rest = np.repeat(places + gap, pieces) - sample
    padded = np.append(text, np.zeros(most + 1, text.dtype))
    whole = rest > most - 1
    size = np.where(whole, most, rest + 1)
    key = np.zeros(len(sample), np.uint64)
    for i in range(most):
        key = key << np.uint64(bits) | np.where(i < size, padded[np.minimum(sample + i, len(padded) - 1)], (1 << bits) - 1).astype(np.uint64)
    key = key << np.uint64(4) | np.where(whole, 0, most + 1 - size).astype(np.uint64)
    return common.distinct(key)[2], np.append(0, np.cumsum(pieces)[:-1])


def _sort_leftmost(text: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    """Leftmost-smaller ``places`` in order of their suffixes: their substrings are named, and the string of names is sorted by recursion."""
    if len(places) < 2:
        return places
    names, heads = _named_substrings(text, places, bits)
    single = np.bincount(names)[names] == 1
    # No comparison goes beyond a name that stands nowhere else, so that of a run of such names only the first is kept.
    kept = np.flatnonzero(~(single & np.append(True, single[:-1])))
    rank = np.zeros(len(names), np.int64)
    rank[kept[_sort_names(names[kept])]] = np.arange(len(kept))
    return places[np.lexsort((rank[heads], names[heads]))]


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Suffixes of a string of numbers in order (the end is less than any), by induced sorting."""
    text = np.append(common.distinct(names)[2] + 1, 0)
    smaller = suffix_types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return _induced(text, smaller, _sort_leftmost(text, leftmost, int(text.max() + 1).bit_length()))[1:]


def _induced(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order of all suffixes induced from ``seeds``, the order of the leftmost-smaller ones.

    One by one: the alphabet of a string of names is about as large as the string, so that there are no buckets to speak of.
    """
    n = len(text)
    ends = np.cumsum(np.bincount(text))
    own = text[seeds]
    first = common.runs(own)
    each = np.diff(np.append(first, len(own)))
    order = np.full(n, -1)
    order[np.repeat(ends[own[first]] - each - first, each) + np.arange(len(own))] = seeds
    placed = order.tolist()
    # By suffix: the symbol before it, and whether the suffix that starts there is of a type; the last entry stands for empty places.
    before = np.append(0, text[:-1]).tolist()
    to_larger = np.concatenate([[False], ~smaller[:-1], [False]]).tolist()
    to_smaller = np.concatenate([[False], smaller[:-1], [False]]).tolist()
    heads, tails = np.append(0, ends[:-1]).tolist(), ends.tolist()
    for suffix in placed:
        if to_larger[suffix]:
            symbol = before[suffix]
            placed[heads[symbol]] = suffix - 1
            heads[symbol] += 1
    for suffix in reversed(placed):
        if to_smaller[suffix]:
            symbol = before[suffix]
            tails[symbol] -= 1
            placed[tails[symbol]] = suffix - 1
    return np.array(placed, np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a byte string in order, by induced sorting.

    The last symbol must be 0 and the only 0. Leftmost-smaller suffixes are sorted first: their substrings are named,
    and the string of names is sorted the same way. One pass
    over the buckets from the least symbol up induces the larger-type suffixes, one from the
    greatest down the smaller-type ones. A bucket is handled at once: its suffixes' predecessors
    are split by symbol with a stable sort.
    """
    smaller = suffix_types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    seeds = _sort_leftmost(text, leftmost, 8)
    symbol = text[seeds]
    cut = np.searchsorted(symbol, np.arange(257))
    starts = np.append(0, np.flatnonzero(text[1:] != text[:-1]) + 1)
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    ups: list[np.ndarray] = [np.zeros(0, np.int64)] * 256

    for c in range(256):
        ups[c] = _along_runs(text, np.concatenate(larger[c]) if larger[c] else ups[c], c, starts)
        own_seeds = seeds[cut[c] : cut[c + 1]]
        if len(ups[c]) or len(own_seeds):
            before = np.concatenate([ups[c], own_seeds])
            before = before[before > 0] - 1
            before = before[~smaller[before]]
            before = before[text[before] != c]
            _deal(text, before, larger)
    downs: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * 256
    for c in range(255, -1, -1):
        wave = np.concatenate(downs[c]) if downs[c] else np.zeros(0, np.int64)
        if c == 0:
            wave = np.array([len(text) - 1])
        own = _along_runs(text, wave, c, starts)
        before = np.concatenate([own, ups[c][::-1]])
        before = before[before > 0] - 1
        before = before[smaller[before]]
        before = before[text[before] != c]
        _deal(text, before, downs)
        out[c] = np.concatenate([ups[c], own[::-1]])
    return np.concatenate(out)


#: Steps along runs of one symbol that are taken one by one.
SHORT_RUN = 8


def _along_runs(text: np.ndarray, wave: np.ndarray, c: int, starts: np.ndarray) -> np.ndarray:
    """Suffixes of a bucket and, step by step, those before them that start with the same symbol (and so are of the same type).

    ``starts`` are where runs of equal symbols start: what is left of long runs is written out by their lengths at once.
    """
    seen = [np.zeros(0, np.int64)]
    for _ in range(SHORT_RUN):
        if not len(wave):
            break
        seen.append(wave)
        before = wave[wave > 0] - 1
        wave = before[text[before] == c]
    if len(wave):
        left = wave - starts[np.searchsorted(starts, wave, "right") - 1] + 1
        step = common.ragged_arange(np.zeros(len(wave), np.int64), left)
        seen.append((np.repeat(wave, left) - step)[np.argsort(step, kind="stable")])
    return np.concatenate(seen)


def _deal(text: np.ndarray, suffixes: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append suffixes to the buckets of their first symbols, in their present order."""
    if not len(suffixes):
        return
    own = text[suffixes]
    order = np.argsort(own, kind="stable")
    suffixes, own = suffixes[order], own[order]
    for a, b in common.run_spans(own):
        into[own[a]].append(suffixes[a:b])


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each position, the symbols its suffix shares with the one before it in the complete suffix array ``order``.

    Where a suffix and the one before it follow the same symbol, its value is one less than its left neighbour's.
    Only at the other positions (one for each run of the preceding symbols in ``order``) are suffixes compared, in words
    of eight and, the longer they agree, in more words at once.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    there = np.maximum(before, 1)
    follows = np.append(False, (before[1:] > 0) & (text[:-1] == text[there[1:] - 1]))
    compared = np.flatnonzero(~follows)
    shared = np.zeros(n, np.int64)
    left = compared[before[compared] >= 0]
    padded = np.zeros(n + 8 * _MOST_WORDS + 8, np.uint8)
    padded[:n] = text
    packed = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    done, words = 0, 1
    while len(left):
        ahead = done + 8 * np.arange(words)
        still = []
        for part in np.array_split(left, max(1, len(left) * words >> 20)):
            # The last symbol stands nowhere else, so that two suffixes differ before either ends.
            differ = packed[part[:, None] + ahead] ^ packed[before[part][:, None] + ahead]
            found = differ != 0
            first = found.argmax(axis=1)
            ends = found[np.arange(len(part)), first]
            word = differ[np.arange(len(part)), first][ends]
            lowest = word & (~word + np.uint64(1))
            shared[part[ends]] = done + 8 * first[ends] + (np.bitwise_count(lowest - np.uint64(1)) >> 3)
            still.append(part[~ends])
        left, done, words = np.concatenate(still), done + 8 * words, min(2 * words, _MOST_WORDS)
    origin = np.repeat(compared, np.diff(np.append(compared, n)))
    return shared[origin] - (np.arange(n) - origin)


def later_windows(regions: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """``(region, first, end)`` bytes of windows that start earlier elsewhere; regions stand in order of their starts."""
    sizes = np.array([len(r) for r in regions], np.int64)
    raw = np.frombuffer(b"".join(regions), np.uint8)
    # Symbols: 0 ends the text, 1 ends a region; UTF-8 leaves bytes 0xC0 and 0xC1 unused, so all fit a byte.
    starts = np.append(0, np.cumsum(sizes + 1))
    text = np.ones(int(starts[-1]) + 1, np.uint8)
    text[common.ragged_arange(starts[:-1], sizes)] = np.where(raw < 0xC0, raw + 2, raw)
    text[-1] = 0
    order = suffix_array(text)
    valid = np.zeros(len(text), bool)
    valid[common.ragged_arange(starts[:-1], np.maximum(sizes - length + 1, 0))] = True
    shared = common_prefixes(text, order)
    # A suffix that shares a whole window with a window's has that window itself: none is left out between two.
    order = order[valid[order]]
    equal = shared[order] >= length
    if not equal.any():
        return []
    group = np.flatnonzero(~equal)
    least = np.minimum.reduceat(order, group)
    later = np.sort(order[order != np.repeat(least, np.diff(np.append(group, len(order))))])
    region = np.searchsorted(starts, later, "right") - 1
    new = np.flatnonzero(np.append(True, (later[1:] != later[:-1] + 1) | (region[1:] != region[:-1])))
    last = np.append(new[1:], len(later)) - 1
    base = starts[region[new]]
    return list(zip(region[new].tolist(), (later[new] - base).tolist(), (later[last] - base + length).tolist(), strict=True))


# --- the distributed operator ----------------------------------------------------------------


def _chunk_rows(table: pa.Table, doc_id: str, text: str):
    """A chunk's rows in order of id (equal ids by text), with bytes, offsets, ids and the ordinal among equal ids."""
    table = table.sort_by([(doc_id, "ascending"), (text, "ascending")])
    raw, offsets = common.text_buffer(table.column(text))
    ids = np.array(table.column(doc_id).cast(pa.int64()).fill_null(NO_ID))
    at = common.runs(ids)
    nth = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids))))
    return table, raw, offsets, ids, nth


def remove_repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, with ``removed_spans`` (byte ranges) and ``kept_bytes`` (what is left).

    With ``as_text`` the last column is ``kept_text`` instead, without the parts of characters that a span cut.

    Removes every byte covered by a ``length``-byte string that also starts earlier: in a document of
    smaller id or earlier in the same one; overlaps count. Texts are UTF-8 bytes, null ones are empty; matches never cross
    documents and are judged on the input. Rows of one id stand in order of their texts; rows with
    a null id come last. Texts shorter than ``length`` stay whole. An empty table gives no rows.
    ``kept_bytes`` may hold parts of characters where a span cuts one. Ids must be integers.
    Columns of the added names are replaced.
    """
    rest = "kept_text" if as_text else "kept_bytes"
    docs = docs.select(*[c for c in docs.columns if c not in ("removed_spans", rest)])
    total = common.total_bytes(docs, text)
    chunks = max(1, -(-total // CHUNK_BYTES))
    buckets = max(48, chunks // 16)
    bits = int(np.log2(common.power_of_two_at_least(max(64, total / SHARD_BYTES))))
    chunk_of, id_of = "__chunk", "__id"
    # The working columns come first, so that any other column may be called anything.
    dealt = docs.select(F.pmod(F.xxhash64(doc_id), F.lit(chunks)).alias(chunk_of), F.col(doc_id).cast("long").alias(id_of), F.col(text).alias("__text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text])

    def scan(key, table):
        common.release()
        _, raw, offsets, _, _ = _chunk_rows(table, id_of, "__text")
        _, _, value, twice = stretches(raw, offsets, length)
        order = np.argsort(value)
        value, twice = value[order], twice[order]
        at = common.runs(value)
        count = np.diff(np.append(at, len(value))).astype(np.uint32)
        if len(at):  # a stretch that may repeat inside itself counts twice
            count += np.add.reduceat(twice, at) > 0
        value = value[at]
        bucket = ((value >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
        some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        return pa.table(
            {
                "bucket": pa.array(some, pa.int64()),
                "chunk": pa.array([key[0].as_py()] * len(some), pa.int64()),
                "value": pa.array([value[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()),
                "count": pa.array([count[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()),
            }
        )

    def repeated(key, table):
        common.release()
        values = [np.frombuffer(v, np.uint64) for v in table.column("value").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("count").to_pylist()]).astype(np.int64)
        flat = np.concatenate(values)
        order = np.argsort(flat)
        at = common.runs(flat[order])
        total = np.empty(len(flat), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], at), np.diff(np.append(at, len(flat))))
        ends = np.append(0, np.cumsum([len(v) for v in values]))
        cut = lambda x, keep: pa.array([x[a:b][keep[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        return pa.table({"__chunk": table.column("chunk"), "value": cut(flat, (total > 1) & (total <= HOT_STRETCHES)), "hot": cut(flat, total > HOT_STRETCHES)})

    def send(key, left, right):
        common.release()
        chunk = key[0].as_py()
        rows = []
        if left.num_rows and right.num_rows:
            _, raw, offsets, ids, nth = _chunk_rows(left, id_of, "__text")
            start, count, value, _ = stretches(raw, offsets, length)
            wanted, hot = (np.frombuffer(b"".join(right.column(c).to_pylist()), np.uint64) for c in ("value", "hot"))
            known = np.sort(np.concatenate([wanted, hot]))
            hit = np.isin(value, known, assume_unique=False, kind="sort") if len(known) else np.zeros(len(value), bool)
            start, count, value = start[hit], count[hit], value[hit]
            hot = np.isin(value, hot)
            row = np.searchsorted(offsets, start, "right") - 1
            end = start + count + length - 1
            held = raw.tobytes()
            first: dict[bytes, int] = {}
            bodies = [held[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            fresh = np.array([first.setdefault(body, i) == i for i, body in enumerate(bodies)], bool)
            at_doc = start - offsets[row]
            shard = (value >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
            shard[~fresh] = (1 << bits) + chunk % (1 << bits)  # known here to be later copies: only passed on
            plain = np.flatnonzero(~fresh | ~hot)
            order = plain[np.argsort(shard[plain], kind="stable")]
            for a, b in common.run_spans(shard[order]):
                o = order[a:b]
                body = b"".join([bodies[i] for i in o]) if fresh[o[0]] else b""
                rows.append((int(shard[o[0]]), chunk, ids[row[o]].tobytes(), nth[row[o]].astype(np.int32).tobytes(), at_doc[o].tobytes(), (end - start)[o].tobytes(), body))
            o = np.flatnonzero(fresh & hot)
            if len(o):  # one row a window: its two hashes, and where it starts
                size = (end - start)[o]
                joined = np.frombuffer(b"".join([bodies[i] for i in o]), np.uint8)
                window = common.ragged_arange(np.cumsum(size) - size, count[o])
                first_hash, second_hash = rolling_hash(joined, length)[window], rolling_hash(joined, length, 1)[window]
                of = np.repeat(o, count[o])
                place = at_doc[of] + common.ragged_arange(np.zeros(len(o), np.int64), count[o])
                shard = (2 << bits) + (first_hash >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
                # Of a chunk's equal windows the earliest takes part (the stretches stand in order); the others are known to be later copies.
                order = np.lexsort((np.arange(len(of)), second_hash, first_hash))
                again = np.append(False, (first_hash[order][1:] == first_hash[order][:-1]) & (second_hash[order][1:] == second_hash[order][:-1]))
                copies = np.sort(order[again])
                if len(copies):  # adjoining ones as one span
                    first = np.flatnonzero(np.append(True, (of[copies][1:] != of[copies][:-1]) | (place[copies][1:] != place[copies][:-1] + 1)))
                    spans = np.diff(np.append(first, len(copies))) + length - 1
                    i = copies[first]
                    rows.append(((1 << bits) + chunk % (1 << bits), chunk, ids[row[of[i]]].tobytes(), nth[row[of[i]]].astype(np.int32).tobytes(), place[i].tobytes(), spans.tobytes(), b""))
                order = np.sort(order[~again])
                order = order[np.argsort(shard[order], kind="stable")]
                for a, b in common.run_spans(shard[order]):
                    i = order[a:b]
                    rows.append((int(shard[i[0]]), chunk, ids[row[of[i]]].tobytes(), nth[row[of[i]]].astype(np.int32).tobytes(), place[i].tobytes(), np.full(len(i), length).tobytes(), np.stack([first_hash[i], second_hash[i]], axis=1).tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.table({c: pa.array(v, pa.int64() if c in ("shard", "chunk") else pa.binary()) for c, v in zip(("shard", "chunk", "ids", "nth", "start", "size", "bytes"), columns, strict=True)})

    def sort_shard(key, table):
        common.release()
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        ids, nth, start, size = (np.concatenate([np.frombuffer(x, t) for x in columns[c]]) for c, t in (("ids", np.int64), ("nth", np.int32), ("start", np.int64), ("size", np.int64)))
        chunk = np.repeat(columns["chunk"], [len(x) // 8 for x in columns["ids"]])
        if key[0].as_py() >= 2 << bits:
            window = np.frombuffer(b"".join(columns["bytes"]), np.uint64).reshape(-1, 2)
            order = np.lexsort((start, nth, ids, window[:, 1], window[:, 0]))
            again = np.append(False, (window[order][1:] == window[order][:-1]).all(axis=1))
            which = order[again]  # all but the earliest of equal windows
            which = which[np.lexsort((start[which], nth[which], ids[which]))]
            found = which, start[which], start[which] + size[which]
        elif key[0].as_py() >= 1 << bits:
            found = np.arange(len(ids)), start, start + size
        else:
            flat = b"".join(columns["bytes"])
            ends = np.cumsum(size)
            order = np.lexsort((start, nth, ids))
            first: dict[bytes, int] = {}
            bodies, kept, copies = [], [], []
            for i in order.tolist():
                body = flat[ends[i] - size[i] : ends[i]]
                if first.setdefault(body, i) == i:
                    bodies.append(body)
                    kept.append(i)
                else:
                    copies.append(i)
            later = np.array(later_windows(bodies, length), np.int64).reshape(-1, 3)
            which = np.array(kept, np.int64)[later[:, 0]]
            copies = np.array(copies, np.int64)
            found = np.concatenate([which, copies]), np.concatenate([start[which] + later[:, 1], start[copies]]), np.concatenate([start[which] + later[:, 2], start[copies] + size[copies]])
        which, begin, end = found
        order = np.argsort(chunk[which], kind="stable")
        which, begin, end = which[order], begin[order], end[order]
        cuts = common.run_spans(chunk[which])
        blob = lambda x: pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary())
        return pa.table({"__chunk": pa.array([chunk[which[a]] for a, _ in cuts], pa.int64()), "ids": blob(ids[which]), "nth": blob(nth[which]), "begin": blob(begin), "end": blob(end)})

    names = [f"c{i}" for i, c in enumerate(docs.columns) if c != text]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(key, left, right):
        common.release()
        table, raw, offsets, ids, nth = _chunk_rows(left, id_of, "__text")
        change = np.zeros(len(raw) + 1, np.int32)
        if right.num_rows:
            i, j, begin, end = (np.concatenate([np.frombuffer(x, t) for x in right.column(c).to_pylist()]) for c, t in (("ids", np.int64), ("nth", np.int32), ("begin", np.int64), ("end", np.int64)))
            row = np.searchsorted(ids, i) + j
            np.add.at(change, offsets[row] + begin, 1)
            np.add.at(change, offsets[row] + end, -1)
        gone = np.cumsum(change[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[heads] = gone[heads]
        closes = gone.copy()
        closes[:-1] &= ~gone[1:]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        closes[tails] = gone[tails]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        row = np.searchsorted(offsets, first, "right") - 1
        counts = np.bincount(row, minlength=len(ids)) if len(ids) else np.zeros(0, int)
        spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays([pa.array(first - offsets[row]), pa.array(last - offsets[row])], ["start", "end"]))
        left_over = np.append(0, np.cumsum(~gone))[offsets]
        body = raw[~gone].tobytes()
        parts = [body[a:b] for a, b in zip(left_over[:-1].tolist(), left_over[1:].tolist(), strict=True)]
        kept = pa.array([p.decode(errors="ignore") for p in parts], pa.string()) if as_text else pa.array(parts, pa.binary())
        return pa.table({"__text": table.column("__text"), **{n: table.column(n) for n in names}, "removed_spans": spans.cast(spans_type), rest: kept})

    by_chunk = dealt.groupBy(chunk_of)
    grams = by_chunk.applyInArrow(scan, "bucket long, chunk long, value binary, count binary")
    wanted = grams.groupBy("bucket").applyInArrow(repeated, "__chunk long, value binary, hot binary")
    regions = by_chunk.cogroup(wanted.groupBy("__chunk")).applyInArrow(send, "shard long, chunk long, ids binary, nth binary, start binary, size binary, bytes binary")
    later = regions.groupBy("shard").applyInArrow(sort_shard, "__chunk long, ids binary, nth binary, begin binary, end binary")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*dealt.drop(chunk_of, id_of).schema.fields, T.StructField("removed_spans", T.ArrayType(span)), T.StructField(rest, T.StringType() if as_text else T.BinaryType())])
    done = by_chunk.cogroup(later.groupBy("__chunk")).applyInArrow(cut, schema)
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return done.select(*[F.col("__text" if c == text else named[c]).alias(c) for c in docs.columns], "removed_spans", rest)
