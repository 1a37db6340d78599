"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

For a merge-type vocabulary every prefix of a text has one last token. A scan with an
Aho-Corasick automaton lists the vocabulary pieces that end at each position; the one that is
compatible with the last token before it is stored, and the ids are recovered backwards from the
end. Two tokens are compatible when merging their joined characters gives the same two tokens.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

assert sys.byteorder == "little" and array("I").itemsize == 4
SPACE = "▁"
#: Words and token pairs a worker keeps, so that its memory is bounded.
CACHE_WORDS, CACHE_PAIRS = 600_000, 400_000


class PieceEncoder:
    """Encoder for a SentencePiece BPE model without user-defined pieces and with the identity normaliser."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.ids = {lib.id_to_piece(i): i for i in range(n) if not special[i]}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = lib.unk_id()
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        probe = " a  Åﬁ"
        if lib.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise NotImplementedError("models with another normaliser than identity with a leading space")
        self.byte_fallback = lib.is_byte(self.bytes[0])
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)  # no piece reaches over a space
        # Pieces of one score (runs of spaces) have no unique order: their texts are merged step by step.
        count: dict[float, int] = {}
        for s in self.scores.values():
            count[s] = count.get(s, 0) + 1
        self.tied = {p for p, s in self.scores.items() if len(p) > 1 and count[s] > 1}
        self.tied_text = re.compile("|".join(map(re.escape, sorted(self.tied, key=len)))) if self.tied else None
        self.names = {i: p for p, i in self.ids.items()}
        self.sizes = {i: len(p) for p, i in self.ids.items()}
        # A piece enters the automaton if merging its own characters gives it back.
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.letters = {p for p in self.ids if len(p) == 1}
        self.in_pieces = {c for p in self.ids for c in p}
        # Between two characters that no piece holds side by side, every text is cut.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.free = [m for m in ".,;:!?" if not any(p[-1] == m and p[:-1].isalpha() for p in self.inside)]
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.missed = 0

    def merged(self, text: str) -> list[str]:
        """Tokens of a short text by repeated best merges: highest score first, then leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        a, b = self.names[left], self.names[right]
        known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def prefix_table(self, unit: str) -> list[int | None]:
        """Last token of each prefix of a text whose characters are all pieces."""
        last: list[int | None] = [None] * (len(unit) + 1)
        pairs = self.pairs
        for stop, (piece, size) in self.automaton.iter(unit):
            stop += 1
            if last[stop] is None:
                if size == stop:
                    last[stop] = piece
                else:
                    before = last[stop - size]
                    if before is not None:
                        ok = pairs.get(before << 32 | piece)
                        if ok or ok is None and self.compatible(before, piece):
                            last[stop] = piece
        return last

    def unit_ids(self, unit: str) -> list[int]:
        """Ids of a text by the prefix table, recovered backwards. A character that no piece holds merges with nothing: the text is cut there."""
        if not self.in_pieces.issuperset(unit):
            out, start = [], 0
            for i, c in enumerate(unit):
                if c not in self.in_pieces:
                    out += (self.unit_ids(unit[start:i]) if i > start else []) + self._merged_ids(c)
                    start = i + 1
            return out + (self.unit_ids(unit[start:]) if start < len(unit) else [])
        if not self.letters.issuperset(unit) or self.tied_text is not None and self.tied_text.search(unit):
            return self._merged_ids(unit)
        last, sizes, out, stop = self.prefix_table(unit), self.sizes, [], len(unit)
        while stop:
            piece = last[stop]
            out.append(piece)
            stop -= sizes[piece]
        out.reverse()
        return out

    def _merged_ids(self, unit: str) -> list[int]:
        """Ids of a text that holds characters outside the vocabulary or pieces of one score."""
        out: list[int] = []
        for t in self._with_ties(unit):
            i = self.ids.get(t)
            if i is not None:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in t.encode())
            else:
                out.append(self.unknown)
        return out

    def _with_ties(self, unit: str) -> list[str]:
        """Tokens by merging step by step, with a queue over neighbouring parts."""
        import heapq

        parts: list[str | None] = list(unit)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                s = self.scores.get(parts[i] + parts[j])
                if s is not None:
                    heapq.heappush(queue, (-s, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, joined = heapq.heappop(queue)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != joined:
                continue
            j = after[i]
            parts[i], parts[j], after[i] = joined, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _unit_bytes(self, unit: str) -> bytes:
        if len(unit) > 2 and unit[-1] in self.free and unit[-2].isalpha():  # the mark never merges with a letter
            return self._word(unit[:-1]) + self._word(unit[-1])
        return array("I", self.unit_ids(unit)).tobytes()

    def _word(self, unit: str) -> bytes:
        known = self.words.get(unit)
        if known is None:
            known = self._unit_bytes(unit)
            if len(self.words) < CACHE_WORDS:
                self.words[unit] = known
            else:
                self.missed += 1
                if self.missed > 8 * CACHE_WORDS:  # the texts have changed
                    self.words.clear()
                    self.missed = 0
        return known

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, without begin and end; null counts as empty."""
        if not text:
            return b""
        if not self.apart:
            return np.array(self.unit_ids(SPACE + text.replace(" ", SPACE)), "<u4").tobytes()
        parts = text.split(" ")
        if "" in parts or SPACE in text:
            parts = self.units.findall(SPACE + text.replace(" ", SPACE))
        else:
            parts = [SPACE + p for p in parts]
        words = self.words
        try:
            return b"".join([words[p] for p in parts])
        except KeyError:
            return b"".join([self._word(p) for p in parts])

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", begin_end: bool = True) -> DataFrame:
    """Ids of every whole text: ``(doc_id, ids array<int>)``, with begin and end ids if asked.

    A null or empty text has only begin and end. Rows stay one for one; an empty table gives none.
    """
    kept = common.only(docs, doc_id=doc_id, text=text)

    def run(batches):
        coder = encoder(model)
        for batch in batches:
            ids = [_framed(coder, t, begin_end) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _framed(coder: PieceEncoder, text: str | None, begin_end: bool) -> np.ndarray:
    coded = np.frombuffer(coder.encode(text), "<u4")
    return np.concatenate([[coder.begin], coded, [coder.end]]).astype("<u4") if begin_end else coded


def decode_pieces(coded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of id lists: ``(doc_id, text)``; a null list gives a null text."""
    kept = common.only(coded, doc_id=doc_id, ids=ids)

    def run(batches):
        coder = encoder(model)
        for batch in batches:
            texts = [None if i is None else coder.library.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass and keep digests: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    Same cases as :func:`encode_pieces`; ids and texts stay inside the task, so nothing is shuffled.
    """
    kept = common.only(docs, doc_id=doc_id, text=text)

    def run(batches):
        coder = encoder(model)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                ids = _framed(coder, t, True)
                counts.append(len(ids))
                coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
