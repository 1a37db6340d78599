"""Conversation structure repair: cheapest edits to a legal order of roles, by Four-Russians block tables.

The costs of finishing from each state of the role automaton form a vector that differs from its least entry by a bounded amount, so there are few
such vectors. A table holds what each makes of every block of BLOCK symbols; rows are taken from the last to the first, a block a lookup.
Conversations are dealt by ranges of (conversation, turn, role, text digest): one that spans several ranges is cut into pieces, whose 4 x 4
cost matrices are joined, and each piece is then traced by itself.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Roles' initials, by state of the automaton: nothing yet, after s, after u, after a. The first and the last may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
AFTER = [{"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U}]
#: Where a row that is inserted or given another role leads, and that role.
FORCED = [(AFTER_U, "user"), (AFTER_U, "user"), (AFTER_A, "assistant"), (AFTER_U, "user")]
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows as symbols: to be deleted; or the initial of the role (o for any other), in capitals if the text is truncated.
SYMBOLS = "dsuaoSUAO"
BLOCK = 3
FAR = 1 << 40
_DIGITS = np.zeros(128, np.int64)
_DIGITS[[ord(c) for c in SYMBOLS]] = range(len(SYMBOLS))
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of text and rows' fields that a range of rows holds, about.
RANGE_BYTES = 8 << 20


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(2):
        costs = [min(c, INSERT + costs[FORCED[q][0]]) for q, c in enumerate(costs)]
    return costs


def _step(costs: tuple[int, ...], symbol: str) -> list[int]:
    """Costs of finishing before a row, from those after it."""
    out = []
    for q in range(4):
        best = DELETE + costs[q]
        if symbol != "d":
            extra = TRUNCATED if symbol.isupper() else 0
            best = min(best, REROLE + extra + costs[FORCED[q][0]])
            if symbol.lower() in AFTER[q]:
                best = min(best, extra + costs[AFTER[q][symbol.lower()]])
        out.append(best)
    return _with_inserts(out)


def _normal(costs) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least if c < FAR // 2 else FAR for c in costs), least


class Tables:
    """All normalised vectors that can come about, their steps by symbol and their steps by block of symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        ends = [_normal(_with_inserts([0, FAR, FAR, 0]))[0]] + [tuple(0 if p == q else FAR for p in range(4)) for q in range(4)]
        self.vectors, self.number = list(ends), {v: i for i, v in enumerate(ends)}
        steps: list[list[tuple[int, int]]] = []
        for v in self.vectors:  # grows while it is walked
            row = []
            for s in SYMBOLS:
                after, least = _normal(_step(v, s))
                if after not in self.number:
                    self.number[after] = len(self.vectors)
                    self.vectors.append(after)
                row.append((self.number[after], least))
            steps.append(row)
        self.step, self.add = (np.array([[x[k] for x in row] for row in steps], np.int64) for k in (0, 1))
        n, size = len(self.vectors), len(SYMBOLS)
        to, cost = np.arange(n)[:, None], np.zeros((n, 1), np.int64)
        for _ in range(block):  # one symbol more in front: its digit is the highest
            cost = np.concatenate([cost + self.add[to, s] for s in range(size)], axis=1)
            to = np.concatenate([self.step[to, s] for s in range(size)], axis=1)
        self.block_step, self.block_add = to.tolist(), cost.tolist()
        self._traced: dict[tuple[int, int, int], tuple[tuple[str, ...], int]] = {}

    def blocks(self, symbols: str) -> tuple[list[int], list[int]]:
        """Symbols that stand before the first whole block, and the numbers of the whole blocks."""
        values = _DIGITS[np.frombuffer(symbols.encode("ascii"), np.uint8)]
        rest = len(values) % self.block
        weights = len(SYMBOLS) ** np.arange(self.block - 1, -1, -1)
        return values[:rest].tolist(), (values[rest:].reshape(-1, self.block) @ weights).tolist()

    def before(self, symbols: str, end: int) -> tuple[list[int], int]:
        """Vector numbers at the ends of the head and of each block (the last is ``end``), the vector before all, first; and the cost added on the way."""
        head, blocks = self.blocks(symbols)
        at, total, seen = end, 0, [end]
        for code in reversed(blocks):
            total += self.block_add[at][code]
            at = self.block_step[at][code]
            seen.append(at)
        for s in reversed(head):
            total += int(self.add[at, s])
            at = int(self.step[at, s])
        return [at, *reversed(seen)], total

    def matrix(self, symbols: str) -> list[int]:
        """Least costs from each state to each state across the symbols, row by row."""
        columns = []
        for q in range(4):
            seen, total = self.before(symbols, 1 + q)
            columns.append([c + total if c < FAR else FAR for c in self.vectors[seen[0]]])
        return [columns[q][p] for p in range(4) for q in range(4)]

    def _walk(self, codes: list[int], state: int, end: int) -> tuple[tuple[str, ...], int]:
        """ASCII-least cheapest edits of each symbol (inserts stand before a row's own edit) and the state after them."""
        ends = [end]
        for s in reversed(codes):
            ends.append(int(self.step[ends[-1], s]))
        ends.reverse()
        edits = []
        for k, s in enumerate(codes):
            now, after, least = self.vectors[ends[k]], self.vectors[ends[k + 1]], int(self.add[ends[k + 1], s])
            symbol, done = SYMBOLS[s], ""
            extra = TRUNCATED if symbol.isupper() else 0
            kept = AFTER[state].get(symbol.lower())
            while DELETE + after[state] != now[state] + least and INSERT + now[FORCED[state][0]] == now[state]:
                state, done = FORCED[state][0], done + "I"
                kept = AFTER[state].get(symbol.lower())
            if DELETE + after[state] == now[state] + least:
                done += "D"
            elif kept is not None and symbol != "d" and extra + after[kept] == now[state] + least:
                done, state = done + "K", kept
            else:
                done, state = done + "R", FORCED[state][0]
            edits.append(done)
        return tuple(edits), state

    def trace(self, symbols: str, state: int, end: int) -> tuple[list[str], int]:
        """Edits of all symbols from ``state``, blocks expanded one by one, and the state after them."""
        seen, _ = self.before(symbols, end)
        head, blocks = self.blocks(symbols)
        edits, state = self._walk(head, state, seen[1])
        found = list(edits)
        for k, code in enumerate(blocks):
            key = (state, seen[k + 2], code)
            if key not in self._traced:
                digits = [code // len(SYMBOLS) ** i % len(SYMBOLS) for i in range(self.block - 1, -1, -1)]
                self._traced[key] = self._walk(digits, state, key[1])
            edits, state = self._traced[key]
            found += edits
        return found, state


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: rows with the faults that crc32 of ``conv_id:turn`` modulo 20 gives them; nulls are one space."""
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(full("conv_id"), F.lit(":"), full("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(full("text"), "[.!?]", "")).otherwise(full("text"))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(full("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number ``n`` and their ``symbols``, one a copy; only a row that may stay keeps its text.

    Of equal role and text in a conversation all but the first are duplicates; which is first, an aggregation tells, so that no window holds
    a conversation. Equal rows are counted before they are dealt. Ids and turns are wrapped, so that nulls are keys like others.
    """
    blank = F.btrim("text", F.lit(BLANKS)) == ""
    keyed = rows.select(F.struct("conv_id").alias("conv"), F.struct("turn").alias("at"), "role", "text", "n", blank.alias("blank"), F.unhex(F.sha2("text", 256)).alias("digest"))
    copies = keyed.groupBy("conv", "at", "role", "digest", "blank").agg(F.sum("n").alias("n"))
    firsts = keyed.where("not blank").groupBy("conv", "role", "digest").agg(F.min(F.struct("at", "text")).alias("first"))
    first = (F.col("first.at") == F.col("at")) & F.col("first").isNotNull()
    own = F.coalesce(F.nullif(F.regexp_extract("role", "^[sua]", 0), F.lit("")), F.lit("o"))
    cut = ~F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).isin(".", "!", "?")
    both = copies.join(firsts, ["conv", "role", "digest"], "left")
    stays = both.select("conv", "at", "role", "digest", "blank", "n", F.coalesce(first, F.lit(False)).alias("stays"), F.when(first, F.col("first.text")).alias("text"))
    symbols = F.when(F.col("stays"), F.concat(F.when(cut, F.upper(own)).otherwise(own), F.repeat(F.lit("d"), (F.col("n") - 1).cast("int")))).otherwise(F.repeat(F.lit("d"), F.col("n").cast("int")))
    return stays.select(F.col("conv.conv_id").alias("conv_id"), F.col("at.turn").alias("turn"), "role", "digest", "blank", "n", "stays", "text", symbols.alias("symbols"))


#: What a piece of a conversation holds: its rows in order and counts over them. ``edge``: it may go on in another range.
PIECE = "conv_id long, part long, edge boolean, symbols string, lengths array<int>, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long"
LEGAL = {"su", "ua", "au"}


def _piece(conv, part, rows) -> dict:
    before, illegal = None, 0
    for role, n in ((r["role"], r["n"]) for r in rows):
        mark = role[:1]
        illegal += (n - 1) * (mark + mark not in LEGAL) + (before is not None and before + mark not in LEGAL)
        before = mark
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "conv_id": conv, "part": part, "edge": False, "symbols": "".join(r["symbols"] for r in rows), "lengths": [r["n"] for r in rows], "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows],
        "blank": sum(r["n"] for r in rows if r["blank"]), "duplicate": sum(r["n"] - r["stays"] for r in rows if not r["blank"]), "truncated": sum(r["stays"] and r["symbols"][0].isupper() for r in rows),
        "illegal": illegal, "first": rows[0]["role"][:1], "last": before, "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
    }


def _pieces(batches):
    """Pieces of the conversations of one sorted range; its first and last one may have rows in other ranges."""
    part = TaskContext.get().partitionId()
    rows, conv, ready, size, first = [], None, [], 0, True
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("edge", pa.bool_()), ("symbols", pa.string()), ("lengths", pa.list_(pa.int32())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
                       + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")] + [("first", pa.string()), ("last", pa.string())] + [(c, pa.int64()) for c in ("turns", "low", "high")])
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["conv_id"] != conv:
                ready.append(_piece(conv, part, rows) | {"edge": first})
                rows, first = [], False
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready, size = [], 0
            conv = row["conv_id"]
            rows.append(row)
            size += len(row["text"] or "") + len(row["role"]) + len(row["symbols"]) + 100
    if rows:
        ready.append(_piece(conv, part, rows) | {"edge": True})
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


def pieces(rows: DataFrame) -> DataFrame:
    """Conversations in order of turn (nulls first), role and digest of the text, cut where ranges of rows end."""
    ordered = ["conv_id", "turn", "role", "digest"]
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 64)).first()[0] or 0
    dealt = marked(damage(rows)).repartitionByRange(max(1, -(-size // RANGE_BYTES)), *ordered).sortWithinPartitions(*ordered)
    return common.checkpoint(dealt.mapInArrow(_pieces, PIECE))


def _matrix(symbols: pd.Series) -> pd.Series:
    return symbols.map(tables().matrix)


def _exits(symbols: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([[tables().trace(s, q, e)[1] for q in range(4)] for s, e in zip(symbols, end, strict=True)])


def _ends(matrices: pd.Series) -> pd.Series:
    """The vector number after each piece of a conversation, from its pieces' matrices in order."""
    out = []
    for pieces_ in matrices:
        costs, found = tables().vectors[0], []
        for p in reversed(list(pieces_)):
            found.append({"part": p["part"], "end": tables().number[_normal(costs)[0]]})
            m = p["matrix"]
            costs = tuple(min(min(m[4 * a + b] + costs[b] for b in range(4)), FAR) for a in range(4))
        out.append(found)
    return pd.Series(out)


def _entries(exits: pd.Series) -> pd.Series:
    out = []
    for pieces_ in exits:
        state, found, ordered = START, [], list(pieces_)
        for p in ordered:
            found.append({"part": p["part"], "end": p["end"], "entry": state, "final": p is ordered[-1]})
            state = int(p["exits"][state])
        out.append(found)
    return pd.Series(out)


def _known(edges: DataFrame) -> DataFrame:
    """``(c, part, end, entry, final)`` of the pieces at ranges' edges: at most two a range."""
    matrix, exits = F.pandas_udf(_matrix, "array<long>"), F.pandas_udf(_exits, "array<int>")
    ends_of, entries_of = F.pandas_udf(_ends, "array<struct<part:long,end:int>>"), F.pandas_udf(_entries, "array<struct<part:long,end:int,entry:int,final:boolean>>")
    conv = F.struct("conv_id").alias("c")
    lists = edges.select(conv, "part", matrix("symbols").alias("matrix")).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "matrix"))).alias("all"))
    ends = lists.select("c", F.explode(ends_of("all")).alias("x")).select("c", "x.*")
    traced = edges.select(conv, "part", "symbols").join(ends, ["c", "part"]).select("c", "part", "end", exits("symbols", "end").alias("exits"))
    lists = traced.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "end", "exits"))).alias("all"))
    return lists.select("c", F.explode(entries_of("all")).alias("x")).select("c", "x.*")


TRACED = "conv_id long, part long, audit string, cost long, lines long, body string"


def _edited(batches):
    table = tables()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            edits, state = table.trace(r["symbols"], r["entry"], r["end"])
            q, at, body, cost = r["entry"], 0, [], 0
            for n, role, text in zip(r["lengths"], r["roles"], r["texts"], strict=True):
                symbol = r["symbols"][at]
                for e in "".join(edits[at : at + n]):
                    cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[e] + (TRUNCATED if e in "RK" and symbol.isupper() else 0)
                    if e == "I":
                        body.append(f"{FORCED[q][1]}:")
                    elif e == "R":
                        body.append(f"{FORCED[q][1]}:{text}")
                    elif e == "K":
                        body.append(f"{role}:{text}")
                    if e != "D":
                        q = AFTER[q][role[:1]] if e == "K" else FORCED[q][0]
                at += n
            while r["final"] and q in (AFTER_S, AFTER_U):
                edits, cost = [*edits, "I"], cost + INSERT
                body.append(f"{FORCED[q][1]}:")
                q = FORCED[q][0]
            out.append({"conv_id": r["conv_id"], "part": r["part"], "audit": "".join(edits), "cost": cost, "lines": len(body), "body": "\n".join(body)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("lines", pa.int64()), ("body", pa.string())]))


JOINED = "conv_id long, cost long, audit string, repaired_sha256 string"


def _hashed(batches):
    """Audits and digests of conversations whose pieces come one after the other; only digests' states and audits are held."""
    conv, open_, schema = None, None, pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    close = lambda: pa.RecordBatch.from_pylist([{"conv_id": conv, "cost": open_[0], "audit": "".join(open_[1]), "repaired_sha256": open_[2].hexdigest()}], schema)
    for batch in batches:
        for r in batch.to_pylist():
            if open_ is not None and r["conv_id"] != conv:
                yield close()
                open_ = None
            if open_ is None:
                conv, open_ = r["conv_id"], [0, [], hashlib.sha256(), False]
            open_[0] += r["cost"]
            open_[1].append(r["audit"])
            if r["lines"]:
                open_[2].update((("\n" if open_[3] else "") + r["body"]).encode())
                open_[3] = True
    if open_ is not None:
        yield close()


def _edited_pieces(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traced pieces: those that are a whole conversation, and those that may be a part of one."""
    columns = ["conv_id", "part", "symbols", "lengths", "roles", "texts", "end", "entry", "final"]
    inner = found.where("not edge").withColumns({"end": F.lit(0), "entry": F.lit(START), "final": F.lit(True)}).select(*columns)
    edges = found.where("edge").withColumn("c", F.struct("conv_id"))
    outer = edges.join(_known(found.where("edge")), ["c", "part"]).select(*columns)
    return inner.mapInArrow(_edited, TRACED), outer.mapInArrow(_edited, TRACED)


def repaired_texts(conversations: DataFrame) -> DataFrame:
    """``(conv_id, part, audit, cost, lines, body)``: each conversation's repaired ``role:text`` lines, in one piece or several in order of ``part``."""
    inner, outer = _edited_pieces(pieces(common.only(conversations, conv_id="conv_id", turn="turn", role="role", text="text")))
    return inner.union(outer)


def repair(conversations: DataFrame) -> DataFrame:
    """Damage, faults, cheapest repair and its digests of every conversation of ``(conv_id, turn, role, text)``.

    A row each ``conv_id`` of the table, null among them: ``gaps, blank, duplicate, truncated, illegal, cost`` (long), ``audit`` and
    ``repaired_sha256``. Rows of one turn are taken by role and by digest of the text, null turns first; repeated rows are duplicates; roles count by
    their first letter. Null roles and texts are one space. A conversation that lost all rows has zeros, an empty audit and the digest of an
    empty text; an empty table gives no rows. A conversation may have any number of rows: only its digest and its audit are made by one task.
    """
    rows = common.only(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    found = pieces(rows)
    inner, outer = _edited_pieces(found)
    whole = inner.select("conv_id", "cost", "audit", F.sha2("body", 256).alias("repaired_sha256"))
    parts = outer.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_hashed, JOINED)
    conv = F.struct("conv_id").alias("c")
    ends = F.sort_array(F.collect_list(F.struct("part", "first", "last", "low", "high")))
    sums = found.groupBy(conv).agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")], F.min("low").alias("low"), F.max("high").alias("high"), ends.alias("ends"))
    bad = lambda x, y: (~F.concat(x["last"], y["first"]).isin(*LEGAL)).cast("long")
    pairs = F.when(F.size("ends") > 1, F.zip_with(F.slice("ends", 1, F.size("ends") - 1), F.slice("ends", 2, F.size("ends") - 1), lambda x, y: F.struct(bad(x, y).alias("bad"), (x["high"].isNotNull() & (x["high"] == y["low"])).cast("long").alias("same"))))
    across = lambda k: F.coalesce(F.aggregate("pairs", F.lit(0).cast("long"), lambda a, x: a + x[k]), F.lit(0))
    faults = sums.withColumn("pairs", pairs).select("c", "blank", "duplicate", "truncated", (F.col("illegal") + across("bad")).alias("illegal"), F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - across("same")), F.lit(0)).alias("gaps"))
    done = whole.union(parts).select(conv, "cost", "audit", "repaired_sha256")
    out = rows.select(conv).distinct().join(faults, "c", "left").join(done, "c", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("c.conv_id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
