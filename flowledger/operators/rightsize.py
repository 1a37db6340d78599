"""Smaller requests from observed peaks, and the config fragment that sets them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import units
from .pricing import Rates, fixed_sum


def _now(base: str, most: str):
    return F.when(F.col(base) > 0, F.col(base)).otherwise(F.col(most))


def recommend(stats: DataFrame, r: Rates, margin: float = 1.25) -> DataFrame:
    """New requests of each process that can be sized: peak times ``margin``, never above the present request.

    A process is sized if it has requests and at least half its tasks completed with both metrics. One whose
    tasks used more than the first attempt's request, were retried at a larger one or were killed keeps everything; the
    reasons are columns of their own. ``margin`` must be finite and at least 1.
    """
    if not (math.isfinite(margin) and margin >= 1):
        raise ValueError("the margin must be finite and at least 1")
    sized = stats.where("has_requests and tasks_with_metrics > 0 and completed_with_metrics * 2 >= tasks")
    sized = sized.withColumns({"cpus_now": _now("base_cpus", "max_cpus"), "mem_now_gib": _now("base_mem_gib", "max_mem_gib"), "time_now_h": _now("base_limit_h", "max_limit_h"), "time_wanted_h": F.col("max_realtime_h") * max(margin, 1.5)})
    limit = F.col("time_now_h") > 0
    sized = sized.withColumns(
        {
            "over_memory": (F.col("tasks_with_rss") > 0) & (F.col("max_rss_gib") > F.col("mem_now_gib")),
            "over_time": limit & (F.col("max_realtime_h") > F.col("time_now_h")),
            "retried_memory": F.col("retry_mem_gib") > F.col("mem_now_gib"),
            "retried_cpus": F.col("retry_cpus") > F.col("cpus_now"),
            "retried_time": limit & (F.col("retry_limit_h") > F.col("time_now_h")),
            "was_killed": F.col("killed_tasks") > 0,
        }
    )
    guard = F.col("over_memory") | F.col("over_time") | F.col("retried_memory") | F.col("retried_cpus") | F.col("retried_time") | F.col("was_killed")
    cpus = F.least(F.greatest(F.ceil(F.col("max_cores_used") * margin), F.lit(1)), F.ceil("cpus_now"))
    memory = F.least(F.greatest(units.round_mem_gib(F.col("max_rss_gib") * margin), F.lit(1.0)), F.col("mem_now_gib"))
    time = F.when(limit, F.least(units.round_time_h(F.col("time_wanted_h")), F.col("time_now_h"))).otherwise(0.0)
    sized = sized.withColumn("needs_escalation", guard).withColumns(
        {
            "cpus_new": F.when(F.col("needs_escalation"), F.ceil("cpus_now")).otherwise(cpus).cast("long"),
            "mem_new_gib": F.when(F.col("needs_escalation"), F.col("mem_now_gib")).otherwise(memory),
            "time_new_h": F.when(F.col("needs_escalation"), F.col("time_now_h")).otherwise(time),
            "time_tight": ~F.col("needs_escalation") & limit & (F.col("time_wanted_h") > F.col("time_now_h")),
        }
    )
    new_cost = F.col("cpus_new") * F.col("realtime_h") * r.cpu_hour + F.col("mem_new_gib") * F.col("realtime_h") * r.gib_hour
    return sized.withColumn("saving", F.when(F.col("needs_escalation"), 0.0).otherwise(F.greatest(F.col("cost") - new_cost, F.lit(0.0))))


def not_sized(stats: DataFrame) -> DataFrame:
    """Processes with requests of which fewer than half the tasks completed with both metrics."""
    return stats.where("has_requests and completed_with_metrics * 2 < tasks").select("run_id", "process", "tasks", "completed_with_metrics")


def total_saving(recs: DataFrame, totals: DataFrame) -> DataFrame:
    """``(run_id, saving, saving_share)`` of every run; the share is null if a run costs nothing."""
    sums = recs.groupBy(F.col("run_id").alias("_run")).agg(fixed_sum(F.col("saving")).alias("saving"))
    joined = totals.join(sums, totals["run_id"] == sums["_run"], "left")
    saving = F.coalesce("saving", F.lit(0.0))
    return joined.select("run_id", saving.alias("saving"), F.when(F.col("total_cost") > 0, saving / F.col("total_cost")).alias("saving_share"))


def config_blocks(recs: DataFrame) -> DataFrame:
    """A ``block`` of settings for each process with a value to lower or a tight limit to name."""
    line = lambda when, *text: F.when(when, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))
    lines = F.array_compact(
        F.array(
            line(F.col("cpus_new") < F.col("cpus_now"), "        cpus   = ", F.col("cpus_new").cast("string")),
            line(F.col("mem_new_gib") < F.col("mem_now_gib"), "        memory = '", units.memory_literal(F.col("mem_new_gib")), "'"),
            line((F.col("time_new_h") > 0) & (F.col("time_new_h") < F.col("time_now_h")), "        time   = '", units.duration_literal(F.col("time_new_h")), "'"),
            line(F.col("time_tight"), "        // near its limit: ", F.format_string("%.1f", F.col("max_realtime_h")), " h used of ", units.show_hours(F.col("time_now_h"))),
        )
    )
    blocks = recs.where("not needs_escalation").withColumn("lines", lines).where(F.size("lines") > 0)
    return blocks.withColumn("block", F.concat(F.lit("    withName: '"), "process", F.lit("' {\n"), F.array_join("lines", "\n"), F.lit("\n    }")))


#: Heading of a config fragment.
HEADING = "// Requests lowered to what the tasks of this run used, with a margin.\n// A process without an entry keeps its settings; an entry also ends growth on retry.\nprocess {\n"


def config_fragments(recs: DataFrame) -> DataFrame:
    """``(run_id, fragment)``: blocks by falling saving, then falling cost and name; a run's processes are few, so its text is one row."""
    blocks = config_blocks(recs).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("saving")).alias("s"), (-F.col("cost")).alias("c"), "process", "block"))).alias("all"))
    body = F.array_join(F.transform("all", lambda b: b["block"]), "\n")
    return blocks.select("run_id", F.concat(F.lit(HEADING), body, F.lit("\n}\n")).alias("fragment"))
