"""Site-relative line frequency: drop lines that a large share of a host's pages repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hosts' line lists are broadcast up to this many listed lines (8 bytes each), and joined by shuffle beyond.
BROADCAST_LINES = 500_000
#: Parts that each host's pages are dealt to in that join, so that no task has all pages with a common line.
SALTS = 16


def _lines(text):
    return F.split(text, "\n", -1)


def boilerplate_lines(docs: DataFrame, ratio: float = 0.05, min_copies: int = 2, host: str = "source", text: str = "text") -> DataFrame:
    """``(host, line_hash, pages, total)`` of lines that more than ``ratio`` of a host's pages contain, and ``min_copies`` pages at least.

    The rule is the same for hosts of any size. Blank lines are never listed, and a page counts a line once. Rows with a
    null host form a group of their own, as any host does.
    """
    pages = common.only(docs, host=host, text=text)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    once = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))
    counts = pages.select("host", F.explode(once).alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_copies)
    totals = totals.select(F.col("host").alias("h"), "total")
    return counts.join(totals, counts["host"].eqNullSafe(totals["h"])).where(F.col("pages") > F.col("total") * ratio).select("host", "line_hash", "pages", "total")


def _rebuilt(joined: DataFrame, columns: list[str], text: str, listed: str) -> DataFrame:
    """Texts of the renamed columns ``c0, c1, ...`` without the lines of the array column ``listed``."""
    at = F.col(f"c{columns.index(text)}")
    lines = _lines(at)
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(listed), F.xxhash64(x)))
    has = F.col(listed).isNotNull() & at.isNotNull()
    fewer = F.when(has, F.size(lines) - F.size(kept)).otherwise(F.lit(0)).cast("long")
    rebuilt = F.when(has, F.array_join(kept, "\n")).otherwise(at)
    return joined.select(*[rebuilt if c == text else F.col(f"c{i}") for i, c in enumerate(columns)], fewer).toDF(*columns, "lines_dropped")


def drop_boilerplate(docs: DataFrame, ratio: float = 0.05, min_copies: int = 2, host: str = "source", text: str = "text", broadcast_lines: int | None = None) -> DataFrame:
    """Every row of ``docs`` with its text rebuilt from the lines that its host doesn't repeat on too many pages.

    All columns stay as they are but ``text``, and ``lines_dropped`` is added (replaced if the table has one); other columns
    may have any name. Null texts stay null, empty texts empty; blank lines stay; repeated rows are pages each; a text that
    consists of listed lines becomes empty. An empty table gives no rows. A host lists at most (distinct lines of a page) / ratio lines, so its
    list is bounded; all lists are broadcast while they hold at most ``broadcast_lines`` (BROADCAST_LINES) lines together. Beyond that each row's own lines meet
    the lists by (host, hash) with the hosts' pages salted, and only what was met returns to the row.
    """
    listed = common.checkpoint(boilerplate_lines(docs, ratio, min_copies, host, text))
    columns = [c for c in docs.columns if c != "lines_dropped"]
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(columns)])
    own = f"c{columns.index(host)}"
    if listed.count() <= (BROADCAST_LINES if broadcast_lines is None else broadcast_lines):
        per_host = listed.groupBy(F.col("host").alias("h")).agg(F.collect_list("line_hash").alias("listed"))
        return _rebuilt(rows.join(F.broadcast(per_host), rows[own].eqNullSafe(per_host["h"]), "left"), columns, text, "listed")
    keyed = common.checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))  # written once, so that a repeated task finds the same numbers
    hashes = F.array_distinct(F.transform(_lines(F.col(f"c{columns.index(text)}")), lambda x: F.xxhash64(x)))
    asked = keyed.select("row", F.col(own).alias("host"), F.explode(hashes).alias("asked"), F.pmod("row", F.lit(SALTS)).alias("salt"))
    spread = listed.select(F.col("host").alias("h"), F.col("line_hash").alias("found"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    met = asked.join(spread, asked["host"].eqNullSafe(spread["h"]) & (asked["asked"] == spread["found"]) & (asked["salt"] == spread["s"]))
    per_row = met.groupBy(F.col("row").alias("r")).agg(F.collect_list("found").alias("listed"))
    return _rebuilt(keyed.join(per_row, keyed["row"] == per_row["r"], "left"), columns, text, "listed")
