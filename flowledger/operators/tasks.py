"""Raw records to tasks, deduplication, and the merge of a run's trace and report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units

STRINGS = ("task_id", "hash", "native_id", "name", "process", "status", "container", "queue")
OPTIONAL = ("exit", "attempt", "duration_ms", "realtime_ms", "pct_cpu_units", "peak_rss_kib", "peak_vmem_kib", "rchar_kib", "wchar_kib", "cpus_units", "memory_kib", "time_ms")

#: Fields of raw records that make up a task.
FIELDS = (
    "task_id", "hash", "native_id", "name", "process", "status", "container", "queue", "tag", "exit", "attempt", "duration", "realtime", "%cpu",
    "peak_rss", "peak_vmem", "rchar", "wchar", "cpus", "memory", "time",
)


def to_tasks(raw: DataFrame, source: str) -> DataFrame:
    """Typed tasks of raw records ``(run_id, path, pos, f)``, one projection without a shuffle.

    Missing strings are empty, other missing or unreadable values null. CPU requests and usage are in 1/100,000 CPU.
    """
    # Fields are taken from the record once; each is named several times below.
    texts = [F.coalesce(F.try_element_at("f", F.lit(k)), F.lit("")).alias(f"_{k}") for k in FIELDS]
    rows = raw.where("f is not null").select("run_id", "path", "pos", F.map_contains_key("f", "tag").alias("_tagged"), *texts)
    got = lambda k: F.col(f"_{k}")
    own_tag = F.nullif(F.nullif(units.strip(got("tag")), F.lit("")), F.lit("-"))
    kib = lambda k: units.whole(units.memory_bytes(got(k)), 1 / 1024)
    ms = lambda k: units.whole(units.duration_s(got(k)), 1000)
    return rows.select(
        "run_id",
        "path",
        F.lit(source).alias("source"),
        "pos",
        *[got(k).alias(k) for k in ("task_id", "hash", "native_id", "name", "status", "container", "queue")],
        F.coalesce(F.nullif(got("process"), F.lit("")), units.process_from_name(got("name"))).alias("process"),
        units.integer(got("exit")).alias("exit"),
        units.integer(got("attempt")).cast("int").alias("attempt"),
        ms("duration").alias("duration_ms"),
        ms("realtime").alias("realtime_ms"),
        units.whole(units.percent(got("%cpu")), 1000).alias("pct_cpu_units"),
        *[kib(k).alias(f"{k}_kib") for k in ("peak_rss", "peak_vmem", "rchar", "wchar", "memory")],
        units.whole(units.number(got("cpus")), 100_000).alias("cpus_units"),
        ms("time").alias("time_ms"),
        F.when(F.col("_tagged"), own_tag).otherwise(units.tag_from_name(got("name"))).alias("tag"),
    )


def _key(row: Column | None = None) -> Column:
    """What identifies a task in its run: its hash, else its id, else its row (its place, if ``row`` isn't given)."""
    row = F.col("pos") if row is None else row
    return F.when(F.col("hash") != "", F.concat(F.lit("h"), "hash")).when(F.col("task_id") != "", F.concat(F.lit("t"), "task_id")).otherwise(F.concat(F.lit("p"), row.cast("string")))


def dedup_tasks(tasks: DataFrame, parts: int | None = None, order: tuple[str, ...] | None = None) -> DataFrame:
    """Of rows of one task the last stays, at the place of the first. Rows with neither hash nor id all stay. ``parts``: into how many parts large tables are dealt.

    Tasks whose places aren't known or asked for give the columns that ``order`` a task's rows (nulls last); these columns go.
    """
    keyed = tasks.withColumn("_key", _key(F.monotonically_increasing_id() if order else None))
    if parts:
        keyed = keyed.repartition(parts, "run_id", "_key")
    task = Window.partitionBy("run_id", "_key")
    if order:
        last = F.row_number().over(task.orderBy(*[F.col(c).desc_nulls_first() for c in order]))
        return keyed.withColumn("_rank", last).where("_rank = 1").drop("_key", "_rank", *order)
    return keyed.withColumns({"_rank": F.row_number().over(task.orderBy(F.desc("pos"))), "_first": F.min("pos").over(task)}).where("_rank = 1").withColumn("pos", F.col("_first")).drop("_key", "_rank", "_first")


HELD = (*STRINGS, *OPTIONAL, "tag")


def _of_side(df: DataFrame, side: int) -> DataFrame:
    return df.select("run_id", "path", "pos", *HELD, F.lit(side).alias("side"))


def _put_over(rows: DataFrame, record: Column, together: Window, takes: Column) -> DataFrame:
    """Trace rows that ``takes`` names with the values of the one ``record`` row of their window over their own, in place, and ``_both`` true.

    Column by column, so that values nobody asks for don't travel, and no row carries a record beside its own values.
    """
    theirs = {c: F.max(F.when(record, F.col(c))).over(together) for c in HELD}
    best = {c: F.coalesce(F.nullif(theirs[c], F.lit("")), c) if c in STRINGS else F.coalesce(theirs[c], c) if c in OPTIONAL else theirs[c] for c in HELD}
    hit = takes & F.coalesce(F.max(record).over(together), F.lit(False))
    marked = rows.withColumns({"_hit": hit, **{f"_new_{c}": v for c, v in best.items()}})
    return marked.withColumns({**{c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in HELD}, "_both": F.col("_both") | F.col("_hit")}).drop("_hit", *[f"_new_{c}" for c in HELD])


def _merged(rows: DataFrame) -> DataFrame:
    source = F.when(F.col("_both"), "both").when(F.col("side") == 0, "trace").otherwise("report")
    return rows.select("run_id", "path", source.alias("source"), "pos", *HELD, "side")


def _merge_by_passes(trace: DataFrame, report: DataFrame, hashed: bool = True) -> DataFrame:
    """The merge where the trace rows of a name all have a hash or all have none: by hash first, then by name.

    Both sides are one table that is shuffled twice: by (run, hash), which deduplicates and matches, and by (run, name) for what is
    left; matched rows are dealt by their place there, so they crowd no name. Without ``hashed`` no trace row has a hash, and only rows of a
    task id, which may repeat, are shuffled before their names meet.
    """
    if not hashed:
        known = F.coalesce(F.col("task_id") != "", F.lit(False))
        once = _of_side(trace.where(~known), 0).unionByName(_of_side(dedup_tasks(trace.where(known)), 0))
        return _merge_by_name(once.unionByName(_of_side(report, 1)).withColumn("_both", F.lit(False)))
    return _merge_by_name(_merge_by_hash(_of_side(trace, 0).unionByName(_of_side(report, 1)).withColumn("_both", F.lit(False))))


def _merge_by_hash(rows: DataFrame) -> DataFrame:
    """Both sides' rows with the trace deduplicated, and records of its hashes put over its rows."""
    traced, reported = F.col("side") == 0, F.col("side") == 1

    # Of a report's rows without a hash each is a group of its own, as no trace row can match it here.
    report_key = F.when(F.col("hash") != "", F.concat(F.lit("h"), "hash")).otherwise(F.concat(F.lit("r"), F.col("pos").cast("string")))
    rows = rows.withColumn("_key", F.when(reported, report_key).otherwise(_key()))
    task = Window.partitionBy("run_id", "_key")
    own = Window.partitionBy("run_id", "_key", "side")
    # The wider group comes first: its shuffle serves the windows by side as well, which the other way round would need one of their own.
    rows = rows.withColumn("_least", F.min("side").over(task))
    rows = rows.withColumns({"_rank": F.row_number().over(own.orderBy(F.desc("pos"))), "_first": F.min("pos").over(own)})
    rows = rows.where(reported | (F.col("_rank") == 1))
    last = reported & (F.col("_rank") == 1)
    rows = rows.withColumn("_taken", last & (F.col("_least") == 0)).drop("_least")
    rows = _put_over(rows, last, task, traced)
    return rows.where("not _taken").withColumn("pos", F.when(traced, F.col("_first")).otherwise(F.col("pos"))).drop("_key", "_rank", "_first", "_taken")


def _merge_by_name(rows: DataFrame) -> DataFrame:
    """Both sides' rows with records put over the trace rows of their names that have none yet, in their order."""
    traced, reported = F.col("side") == 0, F.col("side") == 1
    # A trace has hashes or it hasn't: with them, only report records without one pair by name.
    is_open = ~F.col("_both")
    rows = rows.withColumn("_name", F.when(is_open, F.concat(F.lit("n"), "name")).otherwise(F.concat(F.lit("m"), F.col("pos").cast("string"))))
    hashed = F.max(F.when(traced, F.col("hash") != "")).over(Window.partitionBy("run_id", "_name"))
    rows = rows.withColumn("_able", is_open & (traced | (F.col("hash") == "") | ~F.coalesce(hashed, F.lit(True))))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("run_id", "_name", "_able", "side").orderBy("pos")))
    pair = Window.partitionBy("run_id", "_name", "_able", "_k")
    rows = rows.withColumn("_taken", reported & F.col("_able") & (F.min("side").over(pair) == 0))
    rows = _put_over(rows, reported & F.col("_able"), pair, traced & F.col("_able"))
    return _merged(rows.where("not _taken"))


def _greedy_pairs(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of places of one name's trace rows and report records; each row in file order takes the first record that is free for it.

    A row without a hash takes any record, one with a hash the last record of its hash, else one without a hash. Two pointers pass over the records, so the work is linear.
    """
    ordered = group.sort_values(["side", "pos"])
    rows, records = ordered[ordered["side"] == 0], ordered[ordered["side"] == 1]
    hashes, used = records["hash"].tolist(), [False] * len(records)
    of_hash = {h: i for i, h in enumerate(hashes) if h}
    anyone, bare, at, pairs = list(range(len(hashes))), [i for i, h in enumerate(hashes) if not h], {"": 0, "h": 0}, []
    for pos, own in zip(rows["pos"], rows["hash"], strict=True):
        found = of_hash.get(own) if own else None
        if found is None or used[found]:
            kind, line = ("h", bare) if own else ("", anyone)
            while at[kind] < len(line) and used[line[at[kind]]]:
                at[kind] += 1
            found = line[at[kind]] if at[kind] < len(line) else None
        if found is not None:
            used[found] = True
            pairs.append((pos, records["pos"].iloc[found]))
    return pd.DataFrame({"run_id": group["run_id"].iloc[0], "trace_pos": [p[0] for p in pairs], "report_pos": [p[1] for p in pairs]}).astype({"trace_pos": "int64", "report_pos": "int64"})


def _merge_in_turn(trace: DataFrame, report: DataFrame) -> DataFrame:
    """The merge of names whose trace rows have a hash in part: what a row may take depends on all rows before it.

    A name's places and hashes (no other columns) meet in one task, which pairs them; the records come by place. Such names are those of retries of one task.
    """
    rows = dedup_tasks(trace)
    narrow = rows.select("run_id", "name", "pos", "hash", F.lit(0).alias("side")).union(report.select("run_id", "name", "pos", "hash", F.lit(1).alias("side")))
    pairs = narrow.groupBy("run_id", "name").applyInPandas(_greedy_pairs, "run_id string, trace_pos long, report_pos long")
    pairs = pairs.select(F.col("run_id").alias("_run"), "trace_pos", "report_pos")
    # A report record goes to its trace row's place, and stays at its own without one.
    placed = _of_side(report, 1).join(pairs, (report["run_id"] == F.col("_run")) & (report["pos"] == F.col("report_pos")), "left")
    slot = F.when(F.col("trace_pos").isNull(), F.concat(F.lit("r"), F.col("pos").cast("string"))).otherwise(F.concat(F.lit("t"), F.col("trace_pos").cast("string")))
    placed = placed.select("run_id", "path", "pos", *HELD, "side", slot.alias("_slot"))
    both = _of_side(rows, 0).withColumn("_slot", F.concat(F.lit("t"), F.col("pos").cast("string"))).unionByName(placed).withColumn("_both", F.lit(False))
    place = Window.partitionBy("run_id", "_slot")
    both = both.withColumn("_taken", (F.col("side") == 1) & (F.min("side").over(place) == 0))
    return _merged(_put_over(both, F.col("side") == 1, place, F.col("side") == 0).where("not _taken"))


#: Lists of names or hashes up to so many rows go to every task.
BROADCAST_ROWS = 200_000
#: Lists of 64-bit hashes go up to so many.
BROADCAST_HASHES = 1_000_000


def _listed(df: DataFrame, most: int | None = None) -> DataFrame:
    """A list that is used several times: computed once, and sent to every task if it is short, so that wide rows needn't be shuffled to meet it."""
    kept = df.persist()
    return F.broadcast(kept) if kept.count() <= (BROADCAST_ROWS if most is None else most) else kept


def merge_tasks(trace: DataFrame, report: DataFrame, hashes: str = "any") -> DataFrame:
    """One task list of each run from its trace and its report.

    Trace rows are deduplicated. In file order each takes the last report record of its hash, or else, as a trace row without a hash does,
    the first free record of its name; of two hashes that differ none takes the other's. Non-empty report strings and known report
    values come first, and a matched task's tag is always the report's. Unmatched rows of both sides stay, trace rows first.
    A run without a report keeps its deduplicated trace; one without a trace keeps its report as it is. Places (``pos``) tell a run's rows of a side apart.

    Both sides are read several times where a trace has hashes in part: keep them if they are dear. Names whose trace rows have a hash all or not at all are matched in two passes over all of them. Only where a run's trace has hashes in part (one
    aggregation tells) its names of that kind are paired in turn; records whose hash belongs to a row of another name go to that row first.
    A caller who made the trace may know that ``all`` of its rows have ``hashes`` or ``none``: then nothing is read to find out.
    """
    if hashes not in ("any", "all", "none"):
        raise ValueError(f"hashes: {hashes}")
    if hashes != "any":
        return _merge_by_passes(trace, report, hashed=hashes == "all")
    hashed = F.col("hash") != ""
    by_name = trace.groupBy("run_id", "name").agg(F.max(hashed).alias("some"), F.min(hashed).alias("all")).persist()
    partly = by_name.groupBy("run_id").agg(F.max("some").alias("some"), F.min("all").alias("all")).where("some and not all").select(F.col("run_id").alias("_run"))
    partly = _listed(partly)
    if not partly.count():
        return _merge_by_passes(trace, report)
    # Names are listed by their hashes: one of another kind that shares a hash is paired in turn too, which is right for every name, only dearer.
    names = _listed(by_name.where("some and not all and run_id is not null and name is not null").select(F.xxhash64("run_id", "name").alias("_name")).distinct(), BROADCAST_HASHES)
    held = _of_side(trace, 0).unionByName(_of_side(report, 1)).where(hashed).select("run_id", "hash", "name", "side")
    held = held.join(partly, held["run_id"] == F.col("_run"), "left_semi")
    apart = held.groupBy("run_id", "hash").agg(F.min("side").alias("least"), F.max("side").alias("most"), (F.min("name") != F.max("name")).alias("unlike")).where("least = 0 and most = 1 and unlike")
    apart = _listed(apart.select(F.col("run_id").alias("_r"), F.col("hash").alias("_h")))

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        marked = df.join(names.withColumn("_in", F.lit(True)), F.xxhash64(df["run_id"], df["name"]) == F.col("_name"), "left")
        marked = marked.join(apart.withColumn("_apart", F.lit(True)), (df["run_id"] == F.col("_r")) & (df["hash"] == F.col("_h")), "left")
        turn = F.coalesce("_in", F.lit(False)) & F.col("_apart").isNull()
        drop = ("_name", "_in", "_r", "_h", "_apart")
        return marked.where(turn).drop(*drop), marked.where(~turn).drop(*drop)

    (trace_turn, trace_rest), (report_turn, report_rest) = split(trace), split(report)
    return _merge_by_passes(trace_rest, report_rest).unionByName(_merge_in_turn(trace_turn, report_turn))
