"""Questions over many runs: history, quantiles, audits and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pricing


def reconcile_cpu_hours(totals: DataFrame, headers: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Computed requested CPU-hours against the header's figure: its first word, with thousands set apart (``1'177.0 (4.2% failed)``)."""
    first = F.regexp_extract("cpu_hours", r"^\s*(\S+)", 1)
    stated = headers.select(F.col("run_id").alias("_r"), F.regexp_replace(first, "[',]", "").try_cast("double").alias("stated"))
    joined = totals.join(stated, totals["run_id"] == stated["_r"])
    return joined.select("run_id", "cpu_h_requested", "stated", (F.abs(F.col("cpu_h_requested") - F.col("stated")) <= tolerance).alias("agrees"))


#: Most ranges of values that a group is counted in at first, and so the most rows that one task orders.
RANGES = 65_536


def usage_quantiles(tasks: DataFrame, value: str, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9), by: tuple[str, ...] = ("process",), ranges: int = RANGES) -> DataFrame:
    """Exact quantiles with linear interpolation, mean and extremes of a measure in whole units for each group, however large it is.

    Equal values are counted first. A group's span is cut into ``ranges`` of equal width; their counts tell in which range each wanted rank lies, and only
    those few ranges' values are put in order. So no task holds a group: one orders ranges, or the distinct values of one range.
    """
    counts = tasks.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("long").alias("x")).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("tasks"), F.sum(F.col("x").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")).alias("sum"), F.min("x").alias("least"), F.max("x").alias("most"))
    key = F.struct(*by).alias("g")
    groups = sums.select(key, "tasks", "sum", "least", "most", F.greatest(F.ceil((F.col("most") - F.col("least") + 1) / ranges), F.lit(1)).alias("width"))
    placed = counts.select(key, "x", "n").join(groups.select("g", "least", "width"), "g").select("g", F.floor((F.col("x") - F.col("least")) / F.col("width")).alias("range"), "x", "n")
    upto = lambda *keys, order: F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    held = placed.groupBy("g", "range").agg(F.sum("n").alias("n")).withColumn("before", upto("g", order="range"))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), side(F.lit(q) * (F.col("tasks") - 1)).cast("long").alias("rank")) for i, q in enumerate(quantiles) for side in (F.floor, F.ceil)]))
    asked = groups.select("g", ranks.alias("r")).select("g", "r.rank").distinct()
    found = asked.join(held, "g").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select("g", "range", "rank", "before")
    wanted = found.groupBy("g", "range").agg(F.min("before").alias("before"), F.collect_set("rank").alias("ranks"))
    inside = placed.join(wanted, ["g", "range"]).withColumn("start", F.col("before") + upto("g", "range", order="x"))
    values = inside.select("g", "x", F.explode(F.filter("ranks", lambda k: (k >= F.col("start")) & (k < F.col("start") + F.col("n")))).alias("rank"))
    by_rank = values.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def quantile(q: float):
        place = F.lit(q) * (F.col("tasks") - 1)
        low, high = (F.element_at("at", side(place).cast("long")).cast("double") for side in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    done = groups.join(by_rank, "g")
    return done.select(*[F.col(f"g.{c}").alias(c) for c in by], "tasks", *[quantile(q).alias(f"q{round(q * 100):02d}") for q in quantiles], (F.col("sum").cast("double") / F.col("tasks")).alias("mean"), F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"))


def since_release(runs: DataFrame, key: Column, least: list[int]) -> DataFrame:
    """Runs whose release key isn't below ``least``."""
    return runs.where(key >= F.array(*[F.lit(x).cast("long") for x in least]))


def share_history(stats: DataFrame) -> DataFrame:
    """Band of each process's cost share and rank over the runs."""
    ranks = pricing.ranked(pricing.with_share(stats), "cost", "process")
    return ranks.groupBy("process").agg(F.count("*").alias("runs"), F.min("share").alias("least_share"), F.max("share").alias("most_share"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"))


def share_by_release(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Each process's cost share and rank in each run, with the run's ``position`` from ``runs(run_id, position)``."""
    order = runs.select(F.col("run_id").alias("_r"), "position")
    ranks = pricing.ranked(pricing.with_share(stats), "cost", "process")
    return ranks.join(order, ranks["run_id"] == order["_r"]).select("position", "run_id", "process", "share", "rank")


def share_band(history: DataFrame, first: int, last: int) -> DataFrame:
    """Range of each process's share over the runs between two positions, both included."""
    return history.where(F.col("position").between(first, last)).groupBy("process").agg(F.count("*").alias("runs"), F.min("share").alias("least_share"), F.max("share").alias("most_share"))


def release_delta(stats: DataFrame, names: DataFrame, before: str, after: str) -> DataFrame:
    """Cost, hours and largest requests of each name in two runs, and the change of cost; a name in one run only has null on the other side."""
    renamed = names.select(F.col("process").alias("_p"), "name")
    named = stats.where(F.col("run_id").isin(before, after)).join(renamed, stats["process"] == F.col("_p"))
    of = {"before": F.col("run_id") == before, "after": F.col("run_id") == after}
    figures = [f.alias(f"{n}_{x}") for x, own in of.items() for n, f in (("cost", pricing.fixed_sum(F.when(own, F.col("cost")))), ("hours", pricing.fixed_sum(F.when(own, F.col("realtime_h")))), ("cpus", F.max(F.when(own, F.col("max_cpus")))), ("mem_gib", F.max(F.when(own, F.col("max_mem_gib")))))]
    joined = named.groupBy("name").agg(*figures)
    return joined.withColumn("change", F.coalesce("cost_after", F.lit(0.0)) - F.coalesce("cost_before", F.lit(0.0)))


def biggest_mover(delta: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """The name whose cost changed most, either way, of those not named in ``without`` (ties: the first name)."""
    rest = delta.where(~F.col("name").isin(*without)) if without else delta
    return rest.select(F.abs("change").alias("moved"), "name", "change").orderBy(F.desc("moved"), "name").limit(1).select("name", "change")


def outside_band(totals: DataFrame, low: float, high: float) -> DataFrame:
    """Runs whose unused share of metered cost lies outside a band (unknown shares are left out)."""
    return totals.where((F.col("unused_share") < low) | (F.col("unused_share") > high)).select("run_id", "unused_share")


def select_runs(runs: DataFrame, failed_in: DataFrame, fallback_route: str = "rsem") -> DataFrame:
    """One run for each release and route: the last that succeeded, else, on the fallback route, the last in which the given process failed.

    ``runs``: release, route, run_id, start_date, ok. ``failed_in``: the run ids in which that process FAILED.
    """
    marked = runs.join(failed_in.select(F.col("run_id").alias("_f")).distinct(), F.col("run_id") == F.col("_f"), "left")
    order = F.struct("start_date", "run_id")
    good = F.max(F.when(F.col("ok"), order))
    other = F.max(F.when(F.col("_f").isNotNull() & (F.col("route") == fallback_route), order))
    return marked.groupBy("release", "route").agg(F.coalesce(good, other)["run_id"].alias("run_id")).where("run_id is not null")


def failure_tail(texts: DataFrame) -> DataFrame:
    """Of failure texts ``(run_id, text)``: the last line of the last command output, the entries it had parsed, and whether it timed out."""
    last = F.when(F.col("text").contains("Command output:"), F.substring_index("text", "Command output:", -1))
    body = F.split(F.regexp_replace(last, r"^\s*\n", ""), r"\n\s*\n|Fusion Info:")
    lines = F.filter(F.split(F.get(body, F.lit(0)), "\n"), lambda x: F.trim(x) != "")
    tail = F.trim(F.try_element_at(lines, F.lit(-1)))
    return texts.select("run_id", tail.alias("last_line"), F.nullif(F.regexp_extract(tail, r"Parsed (\d+) entries", 1), F.lit("")).try_cast("long").alias("parsed"), F.lower("text").contains("timeout").alias("timed_out"))


def read_amplification(tasks: DataFrame) -> DataFrame:
    """Bytes read over the input size that the task's script compares (``N -gt 1 ]``); tasks without that are left out."""
    size = F.nullif(F.regexp_extract("script", r"(\d+) -gt 1 \]", 1), F.lit("")).try_cast("long")
    return tasks.withColumn("input_bytes", size).where("input_bytes > 0").select("run_id", "hash", "input_bytes", (F.col("rchar_kib") * 1024 / F.col("input_bytes")).alias("amplification"))


def metering_audit(tasks: DataFrame) -> DataFrame:
    """For each run: completed tasks, those without any metric, and whether the whole run is unmetered."""
    bare = F.col("pct_cpu_units").isNull() & F.col("peak_rss_kib").isNull()
    done = F.col("status") == "COMPLETED"
    return tasks.groupBy("run_id").agg(F.count_if(done).alias("completed"), F.count_if(done & bare).alias("completed_unmetered"), F.bool_and(bare).alias("unmetered"))


def attempt_history(tasks: DataFrame) -> DataFrame:
    """Attempts of each (run, process, tag) in order, long form, with the number of attempts (null as 1); untagged tasks of a process are one series."""
    attempt = F.coalesce("attempt", F.lit(1))
    group = Window.partitionBy("run_id", "process", "tag")
    return tasks.select("run_id", "process", "tag", attempt.alias("attempt"), "status", "exit", "realtime_ms", F.row_number().over(group.orderBy(attempt, "pos")).alias("step"), F.max(attempt).over(group).alias("most_attempts"))


def launch_changes(runs: DataFrame, columns: tuple[str, ...] = ("profile", "nextflow_version"), by: str | None = None) -> DataFrame:
    """For each run in order, which launch facts differ from the run before (null-safe; the first run has no changes).

    ``runs`` needs ``position``; the window runs over one row a run, or one row a run of each group of the column ``by``.
    """
    group = [by] if by else []
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy("position")
    first = F.lag(F.lit(1)).over(order).isNull()
    return runs.select("run_id", *group, "position", *[(~first & ~F.lag(c).over(order).eqNullSafe(F.col(c))).alias(f"{c}_changed") for c in columns])


def launched_tasks(tasks: DataFrame) -> DataFrame:
    """``(run_id, process, script, image, registry)`` of the first task of each process in each run, its tag masked in the script.

    ``image`` is the container's last two path components, ``registry`` what stands before them.
    """
    first = tasks.groupBy("run_id", "process").agg(F.min_by(F.struct("script", "container", "tag"), "pos").alias("t"))
    script = F.when(F.col("t.tag").isNull() | (F.col("t.tag") == ""), F.col("t.script")).otherwise(F.replace("t.script", "t.tag", F.lit("<S>")))
    image = F.regexp_extract("t.container", r"((?:[^/]+/)?[^/]+)$", 1)
    return first.select("run_id", "process", script.alias("script"), image.alias("image"), F.substr("t.container", F.lit(1), F.length("t.container") - F.length(image)).alias("registry"))


def sample_range(tags: DataFrame, pattern: str) -> DataFrame:
    """For each run: tags that match a pattern and the range of their cost."""
    return tags.where(F.col("tag").rlike(pattern)).groupBy("run_id").agg(F.count("*").alias("samples"), F.min("cost").alias("least"), F.max("cost").alias("most"))


def cached_audit(tasks: DataFrame) -> DataFrame:
    """For each run: cached tasks and their part."""
    return tasks.groupBy("run_id").agg(F.count_if(F.col("status") == "CACHED").alias("cached"), F.count("*").alias("tasks")).withColumn("cached_share", F.col("cached") / F.col("tasks"))


def used_unused(totals: DataFrame, runs: DataFrame) -> DataFrame:
    """Used and unused cost of each run, in run order ``(run_id, position)``."""
    order = runs.select(F.col("run_id").alias("_r"), "position")
    joined = totals.join(order, totals["run_id"] == order["_r"])
    return joined.select("position", "run_id", (F.col("metered_cost") - F.col("total_waste")).alias("used_cost"), F.col("total_waste").alias("unused_cost"))


def cores_per_task(tasks: DataFrame) -> DataFrame:
    """Cores used by each completed task of a process, and their median over all of them."""
    done = tasks.where("status = 'COMPLETED' and pct_cpu_units is not null")
    return usage_quantiles(done, "pct_cpu_units", (0.5,)).select("process", "tasks", (F.col("q50") / pricing.CORE_UNITS).alias("median_cores"))


def scaling_table(points: DataFrame) -> DataFrame:
    """Speed-up against the smallest variant of each benchmark: ``points(benchmark, variant, wall_s, cpu_s)``."""
    group = Window.partitionBy("benchmark").orderBy("variant")
    base, cpu = F.first("wall_s").over(group), F.first("cpu_s").over(group)
    return points.select("benchmark", "variant", "wall_s", (base / F.col("wall_s")).alias("speed_up"), (F.col("variant") * F.col("wall_s")).alias("cpus_x_wall"), (F.col("cpu_s") / cpu).alias("relative_cpu"))


def output_identity(outputs: DataFrame) -> DataFrame:
    """Whether all variants of a benchmark wrote the same file: ``outputs(benchmark, file, sha256)``."""
    return outputs.groupBy("benchmark", "file").agg(F.count("*").alias("variants"), (F.count_distinct("sha256") == 1).alias("identical"))


def escalation_audit(recs: DataFrame) -> DataFrame:
    """For each process over the runs: how often each reason kept its requests, and how often only a kill did."""
    reasons = ("over_memory", "over_time", "retried_memory", "retried_cpus", "retried_time", "was_killed")
    others = F.lit(False)
    for r in reasons[:-1]:
        others = others | F.col(r)
    return recs.groupBy("process").agg(F.count("*").alias("runs"), *[F.count_if(r).alias(r) for r in reasons], F.count_if(F.col("was_killed") & ~others).alias("only_killed"))


def request_history(stats: DataFrame) -> DataFrame:
    """First-attempt requests of each process over the runs: range, whether constant, and the most cores ever used."""
    return stats.where("has_requests").groupBy("process").agg(
        F.count("*").alias("runs"),
        *[f(c).alias(f"{n}_{c}") for c in ("base_cpus", "base_mem_gib", "base_limit_h") for n, f in (("least", F.min), ("most", F.max))],
        ((F.count_distinct("base_cpus") == 1) & (F.count_distinct("base_mem_gib") == 1) & (F.count_distinct("base_limit_h") == 1)).alias("constant"),
        F.max("max_cores_used").alias("most_cores_used"),
    )
