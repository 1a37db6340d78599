"""Pricing of tasks, and statistics by process, tag and run.

Products of whole units are summed exactly and divided once, so results don't depend on the order of rows. A task's
product must fit 63 bits (a terabyte for over 200 days).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import units

#: CPU units and KiB times milliseconds in a CPU-hour and a GiB-hour.
CPU_HOUR, GIB_HOUR, HOUR_MS, GIB_KIB, CORE_UNITS = 100_000 * 3_600_000.0, 1_048_576 * 3_600_000.0, 3_600_000.0, 1_048_576.0, 100_000.0


@dataclass(frozen=True)
class Rates:
    """Prices of a CPU-hour and a GiB-hour."""

    name: str
    cpu_hour: float
    gib_hour: float


#: Published price presets.
PRESETS = {r.name: r for r in (Rates("seqera-compute", 0.10, 0.025), Rates("aws-m5-ondemand", 0.032, 0.004), Rates("aws-m5-spot", 0.0112, 0.0014))}


def rates(preset: str = "seqera-compute", cpu_hour: float | None = None, gib_hour: float | None = None) -> Rates:
    """A preset with either price overridden; prices must be finite and not negative."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}: one of {', '.join(PRESETS)}")
    for price in (cpu_hour, gib_hour):
        if price is not None and not (math.isfinite(price) and price >= 0):
            raise ValueError("prices must be finite and not negative")
    found = PRESETS[preset]
    if cpu_hour is not None or gib_hour is not None:
        found = replace(found, name="custom", cpu_hour=found.cpu_hour if cpu_hour is None else cpu_hour, gib_hour=found.gib_hour if gib_hour is None else gib_hour)
    return found


def rates_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.name, r.cpu_hour, r.gib_hour) for r in PRESETS.values()], "rate_name string, cpu_hour double, gib_hour double")


def is_killed() -> Column:
    """A FAILED task that a signal or memory limit ended, or that had no exit code within a tenth of its time limit."""
    signal = F.col("exit").between(130, 145) | (F.col("exit") == 104)
    timed_out = F.col("exit").isNull() & (F.col("time_ms") > 0) & (F.col("realtime_ms") * 10 >= F.col("time_ms") * 9)
    return F.coalesce((F.col("status") == "FAILED") & (F.coalesce(signal, F.lit(False)) | F.coalesce(timed_out, F.lit(False))), F.lit(False))


def price_tasks(tasks: DataFrame) -> DataFrame:
    """Priced amounts of each task: requests times run time, and what it used where there is no request.

    Adds ``ms``, the amounts ``cpu_priced`` and ``mem_priced`` (units times ms), ``cpu_used``, ``mem_used``, ``cpu_metered``,
    ``mem_metered`` (null unless a task has both request and metric), ``ok`` and ``killed``.
    """
    ms = F.coalesce("realtime_ms", F.lit(0))
    times = lambda c: F.col(c) * ms
    out = tasks.withColumns(
        {"ms": ms, "ok": units.succeeded(F.col("status")), "killed": is_killed(), "cpu_requested": times("cpus_units"), "mem_requested": times("memory_kib"), "cpu_at_use": times("pct_cpu_units"), "mem_at_use": times("peak_rss_kib")}
    )
    paired_cpu, paired_mem = F.col("cpu_requested").isNotNull() & F.col("cpu_at_use").isNotNull(), F.col("mem_requested").isNotNull() & F.col("mem_at_use").isNotNull()
    return out.withColumns(
        {
            "cpu_priced": F.coalesce("cpu_requested", "cpu_at_use"),
            "mem_priced": F.coalesce("mem_requested", "mem_at_use"),
            "cpu_used": F.when(paired_cpu, F.col("cpu_at_use")),
            "mem_used": F.when(paired_mem, F.col("mem_at_use")),
            "cpu_metered": F.when(paired_cpu, F.col("cpu_requested")),
            "mem_metered": F.when(paired_mem, F.col("mem_requested")),
        }
    )


def fixed_sum(x: Column, window=None, digits: int = 6) -> Column:
    """Sum of doubles rounded to ``digits`` places first, so that it doesn't depend on the order of rows."""
    scale = 10.0**digits
    total = F.sum(F.floor(x * scale + 0.5))
    return (total if window is None else total.over(window)).cast("double") / scale


def _exact(c: Column) -> Column:
    """Exact sum of long products: high and low bits are summed apart, so neither overflows, and joined once."""
    high, low = F.sum(F.shiftright(c, 30)), F.sum(c.bitwiseAND(F.lit((1 << 30) - 1)))
    return F.coalesce(high.cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + low.cast("decimal(20,0)"), F.lit(0).cast("decimal(31,0)")).cast("decimal(31,0)")


def _cost(cpu: str | Column, mem: str | Column, r: Rates) -> Column:
    of = lambda x: F.col(x) if isinstance(x, str) else x
    return of(cpu) * r.cpu_hour + of(mem) * r.gib_hour


def _amounts() -> dict[str, tuple[Column, float]]:
    """The hours of a group of priced tasks: what is summed exactly, and over what it is divided."""
    cpu, mem = F.col("cpu_priced"), F.col("mem_priced")
    failed, cached = ~F.col("ok"), F.col("status") == "CACHED"
    return {
        "realtime_h": (F.col("ms"), HOUR_MS),
        "cpu_h_used": (F.col("cpu_used"), CPU_HOUR),
        "gib_h_used": (F.col("mem_used"), GIB_HOUR),
        "cpu_h_req_metered": (F.col("cpu_metered"), CPU_HOUR),
        "gib_h_req_metered": (F.col("mem_metered"), GIB_HOUR),
        "priced_cpu_h": (cpu, CPU_HOUR),
        "priced_gib_h": (mem, GIB_HOUR),
        "failed_cpu_h": (F.when(failed, cpu), CPU_HOUR),
        "failed_gib_h": (F.when(failed, mem), GIB_HOUR),
        "cached_cpu_h": (F.when(cached, cpu), CPU_HOUR),
        "cached_gib_h": (F.when(cached, mem), GIB_HOUR),
        "cpu_h_requested": (F.col("cpu_requested"), CPU_HOUR),
        "gib_h_requested": (F.col("mem_requested"), GIB_HOUR),
    }


def _hours(names, exact: str = "exact") -> dict[str, Column]:
    """Hours from the exact sums in the struct column ``exact``."""
    per = {n: p for n, (_, p) in _amounts().items()}
    return {n: F.col(f"{exact}.{n}").cast("double") / per[n] for n in names}


def _counts() -> list[Column]:
    return [
        F.count("*").alias("tasks"),
        F.count_if(~F.col("ok")).alias("failed_tasks"),
        F.count_if(F.col("status") == "CACHED").alias("cached_tasks"),
        F.count_if(F.col("cpus_units").isNull() | F.col("memory_kib").isNull()).alias("tasks_without_requests"),
        F.count_if(F.col("pct_cpu_units").isNotNull() | F.col("peak_rss_kib").isNotNull()).alias("tasks_with_metrics"),
    ]


def with_waste(df: DataFrame, r: Rates) -> DataFrame:
    """``waste``: metered less used of each resource, not below 0, priced; null if nothing is metered."""
    over = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0.0))
    waste = over("cpu_h_req_metered", "cpu_h_used") * r.cpu_hour + over("gib_h_req_metered", "gib_h_used") * r.gib_hour
    return df.withColumn("waste", F.when((F.col("cpu_h_req_metered") > 0) | (F.col("gib_h_req_metered") > 0), waste))


COUNTS = ("tasks", "failed_tasks", "cached_tasks", "tasks_without_requests", "tasks_with_metrics")
_MORE_COUNTS = ("retried_tasks", "killed_tasks", "tasks_with_attempt", "tasks_with_cpu", "tasks_with_rss", "completed_with_metrics", "tasks_with_requests")
#: Greatest requests and peaks: what is compared, of which attempts (of tasks with both requests only), and the unit it is shown in.
_LARGEST = {
    **{f"{w}_{n}": (c, True, w, per) for w in ("max", "base", "retry") for n, c, per in (("cpus", "cpus_units", CORE_UNITS), ("mem_gib", "memory_kib", GIB_KIB))},
    **{f"{w}_limit_h": ("time_ms", False, w, HOUR_MS) for w in ("max", "base", "retry")},
    "max_cores_used": ("pct_cpu_units", False, "max", CORE_UNITS), "max_rss_gib": ("peak_rss_kib", False, "max", GIB_KIB), "max_realtime_h": ("ms", False, "max", HOUR_MS),
}


def usage(priced: DataFrame) -> DataFrame:
    """A row for each run, tag and process: counts, exact sums (``exact``) and greatest values (``largest``), all of which add up further.

    One pass over the tasks, from which process, tag and run statistics are rolled up; a hot process or tag is a few rows by then.
    """
    requested = F.col("cpus_units").isNotNull() & F.col("memory_kib").isNotNull()
    retry = F.coalesce("attempt", F.lit(1)) > 1
    attempts = {"max": F.lit(True), "base": F.coalesce("attempt", F.lit(1)) == 1, "retry": ~(F.coalesce("attempt", F.lit(1)) == 1)}
    greatest = lambda c, both, w: F.max(F.when((requested if both else F.lit(True)) & attempts[w], F.col(c)))
    return priced.groupBy("run_id", "tag", "process").agg(
        *_counts(),
        F.count_if(retry).alias("retried_tasks"),
        F.count_if("killed").alias("killed_tasks"),
        F.count("attempt").alias("tasks_with_attempt"),
        F.count("pct_cpu_units").alias("tasks_with_cpu"),
        F.count("peak_rss_kib").alias("tasks_with_rss"),
        F.count_if(F.col("ok") & F.col("pct_cpu_units").isNotNull() & F.col("peak_rss_kib").isNotNull()).alias("completed_with_metrics"),
        F.count_if(requested).alias("tasks_with_requests"),
        F.struct(*[_exact(c).alias(n) for n, (c, _) in _amounts().items()]).alias("exact"),
        F.struct(*[greatest(c, both, w).alias(n) for n, (c, both, w, _) in _LARGEST.items()]).alias("largest"),
    )


def _summed(names=COUNTS) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def _summed_amounts() -> Column:
    return F.struct(*[F.sum(f"exact.{n}").cast("decimal(38,0)").alias(n) for n in _amounts()]).alias("exact")


def process_stats_of(parts: DataFrame, r: Rates) -> DataFrame:
    """A row for each run and process from :func:`usage`: counts, hours, maxima of requests and peaks, cost, efficiency and waste.

    The struct ``exact`` holds the sums that the hours come from, so that totals of runs need no second pass over the tasks.
    """
    sums = parts.groupBy("run_id", "process").agg(*_summed(COUNTS + _MORE_COUNTS), _summed_amounts(), *[(F.coalesce(F.max(f"largest.{n}"), F.lit(0)) / per).alias(n) for n, (*_, per) in _LARGEST.items()])
    stats = sums.withColumns({"attempts_known": F.col("tasks_with_attempt") > 0, "has_requests": F.col("tasks_with_requests") > 0}).drop("tasks_with_attempt", "tasks_with_requests")
    stats = stats.withColumns(_hours(_amounts())).withColumns(
        {
            "cost": _cost("priced_cpu_h", "priced_gib_h", r),
            "failed_cost": _cost("failed_cpu_h", "failed_gib_h", r),
            "cpu_efficiency": F.when(F.col("cpu_h_req_metered") > 0, F.col("cpu_h_used") / F.col("cpu_h_req_metered")),
            "mem_efficiency": F.when(F.col("gib_h_req_metered") > 0, F.col("gib_h_used") / F.col("gib_h_req_metered")),
        }
    )
    return with_waste(stats, r)


def process_stats(priced: DataFrame, r: Rates) -> DataFrame:
    return process_stats_of(usage(priced), r)


def tag_stats_of(parts: DataFrame, r: Rates) -> DataFrame:
    """A row for each run and tag from :func:`usage`; tasks without a tag are a group of their own."""
    stats = parts.groupBy("run_id", "tag").agg(*_summed(), F.count("*").alias("processes"), _summed_amounts())
    stats = stats.withColumns(_hours(_amounts())).drop("exact")
    return with_waste(stats.withColumns({"cost": _cost("priced_cpu_h", "priced_gib_h", r), "failed_cost": _cost("failed_cpu_h", "failed_gib_h", r)}), r)


def tag_stats(priced: DataFrame, r: Rates) -> DataFrame:
    return tag_stats_of(usage(priced), r)


def run_totals(processes: DataFrame, r: Rates) -> DataFrame:
    """A row for each run from its :func:`process_stats`: exact sums of the processes' sums; waste is the sum of the processes' waste."""
    totals = processes.groupBy("run_id").agg(
        *_summed(),
        F.count("*").alias("processes"),
        _summed_amounts(),
        fixed_sum(F.coalesce("waste", F.lit(0.0))).alias("total_waste"),
    )
    totals = totals.withColumns(_hours(_amounts())).drop("exact").withColumn("tasks_without_metrics", F.col("tasks") - F.col("tasks_with_metrics"))
    totals = totals.withColumns({"total_cost": _cost("priced_cpu_h", "priced_gib_h", r), "failed_cost": _cost("failed_cpu_h", "failed_gib_h", r), "cached_cost": _cost("cached_cpu_h", "cached_gib_h", r)})
    metered = F.col("cpu_h_req_metered") * r.cpu_hour + F.col("gib_h_req_metered") * r.gib_hour
    return totals.withColumn("metered_cost", metered).withColumn("unused_share", F.when(F.col("metered_cost") > 0, F.col("total_waste") / F.col("metered_cost")))


#: Most rates that runs are priced at together.
MOST_RATES = 1000


def reprice(totals: DataFrame, table: DataFrame) -> DataFrame:
    """Each run's cost at each row of a rates table (a few presets, MOST_RATES at most), without going back to the tasks."""
    rows = table.select("rate_name", "cpu_hour", "gib_hour").limit(MOST_RATES + 1).collect()
    if len(rows) > MOST_RATES:
        raise ValueError(f"more than {MOST_RATES} rates")
    each = F.array(*[F.struct(F.lit(r["rate_name"]).alias("rate_name"), (F.col("priced_cpu_h") * F.lit(r["cpu_hour"]) + F.col("priced_gib_h") * F.lit(r["gib_hour"])).alias("cost")) for r in rows]).cast("array<struct<rate_name:string,cost:double>>")
    return totals.select("run_id", F.explode(each).alias("r")).select("run_id", "r.*")


def with_share(df: DataFrame, cost: str = "cost") -> DataFrame:
    """``share``: the row's part of its run's cost, 0 where a run costs nothing."""
    total = fixed_sum(F.col(cost), Window.partitionBy("run_id"))
    return df.withColumn("share", F.when(total > 0, F.col(cost) / total).otherwise(F.lit(0.0)))


def tagged_share(tags: DataFrame) -> DataFrame:
    """``(run_id, tagged_share)``: the part of each run's cost on tagged tasks (null if it costs nothing)."""
    sums = tags.groupBy("run_id").agg(F.coalesce(fixed_sum(F.when(F.col("tag").isNotNull(), F.col("cost"))), F.lit(0.0)).alias("tagged"), fixed_sum(F.col("cost")).alias("total"))
    return sums.select("run_id", F.when(F.col("total") > 0, F.col("tagged") / F.col("total")).alias("tagged_share"))


def run_notices(totals: DataFrame) -> DataFrame:
    """``basis`` (requested, used or mixed) of each run's prices, and the numbers of unpriced and unmetered tasks."""
    basis = F.when(F.col("tasks_without_requests") == 0, "requested").when(F.col("tasks_without_requests") == F.col("tasks"), "used").otherwise("mixed")
    coverage = F.when(F.col("tasks_without_metrics") == F.col("tasks"), "unmetered").when(F.col("tasks_without_metrics") > 0, "partly metered").otherwise("metered")
    return totals.select("run_id", "tasks", "tasks_without_requests", "tasks_without_metrics", basis.alias("basis"), coverage.alias("coverage"))


def ranked(df: DataFrame, value: str, *ties: str, by: str = "run_id") -> DataFrame:
    """``rank`` within a run: greatest value first, then the tie columns (nulls first)."""
    order = [F.desc(value), *[F.col(c).asc_nulls_first() for c in ties]]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def top_k(df: DataFrame, n: int, value: str, *ties: str, by: str = "run_id") -> DataFrame:
    return ranked(df, value, *ties, by=by).where(F.col("rank") <= n)
