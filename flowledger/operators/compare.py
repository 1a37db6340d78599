"""Names, order and tables of many runs side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units
from . import pricing, rightsize
from .pricing import Rates


def _suffix(parts: Column, depth: Column) -> Column:
    """The last ``depth`` components of a name."""
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - depth + 1, F.lit(1)), F.size(parts)), ":")


def name_depths(processes: DataFrame) -> DataFrame:
    """``(run_id, process, depth)``: the fewest last components that no other process of the run shares."""
    names = processes.select("run_id", "process").distinct().withColumn("parts", F.split("process", ":"))
    each = names.select("run_id", "process", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts").withColumn("suffix", _suffix(F.col("parts"), F.col("depth")))
    alone = each.withColumn("same", F.count("*").over(Window.partitionBy("run_id", "depth", "suffix"))).where("same = 1")
    found = alone.groupBy("run_id", "process").agg(F.min("depth").alias("depth")).select(F.col("run_id").alias("_r"), F.col("process").alias("_p"), "depth")
    joined = names.join(found, (names["run_id"] == F.col("_r")) & (names["process"] == F.col("_p")), "left")
    return joined.select("run_id", "process", F.coalesce("depth", F.size("parts")).alias("depth"))


def display_names(processes: DataFrame) -> DataFrame:
    """``(run_id, process, name)``: the shortest name unique within the run, the full one if none is."""
    return name_depths(processes).select("run_id", "process", _suffix(F.split("process", ":"), F.col("depth")).alias("name"))


def matrix_names(processes: DataFrame) -> DataFrame:
    """``(process, name)`` stable over all runs: each last component has the depth that the neediest run asks for."""
    depths = name_depths(processes).withColumn("leaf", F.element_at(F.split("process", ":"), -1))
    need = depths.groupBy("leaf").agg(F.max("depth").alias("need"))
    return depths.select("process", "leaf").distinct().join(need, "leaf").select("process", _suffix(F.split("process", ":"), F.col("need")).alias("name"))


#: Routes by path folder, and by the ends of process names that show which one ran; the first that fits counts.
ROUTE_FOLDERS = {"star_salmon": "salmon", "star_rsem": "rsem", "hisat2": "hisat2"}
ROUTE_PROCESSES = {"rsem": ("RSEM_CALCULATEEXPRESSION",), "hisat2": ("HISAT2_ALIGN",), "salmon": ("STAR_ALIGN", "STAR_ALIGN_IGENOMES")}


def route_hint(runs: DataFrame, processes: DataFrame, folders: dict[str, str] | None = None, ends: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``(run_id, route)`` from the path's route folder, else from the processes that ran, else from the path's text."""
    folders, ends = folders or ROUTE_FOLDERS, ends or ROUTE_PROCESSES

    def any_end(names: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for n in names:
            hit = hit | F.col("process").endswith(n)
        return hit

    seen = processes.groupBy(F.col("run_id").alias("_run")).agg(*[F.bool_or(any_end(e)).alias(f"_{route}") for route, e in ends.items()])
    hint = F.lit(None).cast("string")
    for text, route in reversed(folders.items()):
        hint = F.when(F.col("path").contains(text), route).otherwise(hint)
    for route in reversed(ends):
        hint = F.when(F.col(f"_{route}"), route).otherwise(hint)
    for text, route in reversed(folders.items()):
        hint = F.when(F.col("path").contains(f"aligner_{text}"), route).otherwise(hint)
    return runs.join(seen, runs["run_id"] == F.col("_run"), "left").select("run_id", hint.alias("route"))


def run_label(revision: Column, commit: Column, route: Column, date: Column) -> Column:
    """Revision (a branch with seven characters of its commit), route and date; missing parts are left out."""
    rev = F.coalesce(revision, F.lit("?"))
    branch = F.concat(rev, F.lit("@"), F.substring(commit, 1, 7))
    return F.concat_ws(" ", F.when(units.release_key(rev).isNull() & commit.isNotNull(), branch).otherwise(rev), route, F.nullif(date, F.lit("")))


def order_runs(runs: DataFrame, by: str | None = None) -> DataFrame:
    """``position`` of runs ``(run_id, revision, start_date)``: releases by number then date, a branch behind the last
    leading release that started on or before it. ``by`` names a column (such as repository) whose groups are ordered apart.
    """
    group = [by] if by else []
    keyed = runs.withColumn("_key", units.release_key(F.col("revision"))).withColumn("_branch", F.col("_key").isNull().cast("int"))
    release = Window.partitionBy(*group, "_branch").orderBy("_key", "start_date", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    # A release can't come before the latest date up to it, which is what a branch's date is compared with.
    keyed = keyed.withColumn("_date", F.when(F.col("_branch") == 0, F.max("start_date").over(release)).otherwise(F.col("start_date")))
    position = F.row_number().over(Window.partitionBy(*group).orderBy("_date", "_branch", F.col("_key").asc_nulls_last(), "start_date", "run_id"))
    return keyed.withColumn("position", position).drop("_key", "_branch", "_date")


def compare_runs(totals: DataFrame, stats: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each run: counts, hours, cost, metered and unused parts, and the process that costs most with its share."""
    top = pricing.top_k(pricing.with_share(stats), 1, "cost", "process").select(F.col("run_id").alias("_run"), F.col("process").alias("_process"), F.col("share").alias("top_share"))
    labelled = top.join(names, top["_process"] == names["process"]).select("_run", F.col("name").alias("top_process"), "top_share")
    joined = totals.join(labelled, totals["run_id"] == labelled["_run"], "left")
    return joined.select("run_id", "tasks", "cached_tasks", "failed_tasks", "cpu_h_requested", "gib_h_requested", "total_cost", (F.col("tasks") - F.col("tasks_without_metrics")).alias("metered_tasks"), "unused_share", "top_process", "top_share")


def share_matrix(stats: DataFrame, names: DataFrame, top: int = 15) -> DataFrame:
    """``(name, run_id, share, total)`` of the ``top`` names that cost most over all runs; a missing cell has no row."""
    renamed = names.select(F.col("process").alias("_p"), "name")
    shares = pricing.with_share(stats).join(renamed, stats["process"] == F.col("_p")).groupBy("name", "run_id").agg(pricing.fixed_sum(F.col("share"), digits=12).alias("share"), pricing.fixed_sum(F.col("cost")).alias("cost"))
    totals = shares.groupBy("name").agg(pricing.fixed_sum(F.col("cost")).alias("total")).orderBy(F.desc("total"), "name").limit(top).select(F.col("name").alias("_n"), "total")
    return shares.join(F.broadcast(totals), shares["name"] == F.col("_n")).select("name", "run_id", "share", "total")


def pivot_matrix(long: DataFrame, runs: list[str]) -> DataFrame:
    """One row a name and one column a run, in the given order."""
    return long.groupBy("name").pivot("run_id", runs).agg(F.first("share"))


def report_tables(stats: DataFrame, tags: DataFrame, totals: DataFrame, recs: DataFrame, r: Rates, top: int = 25, top_sized: int = 15) -> dict[str, DataFrame]:
    """The tables of a run report: totals as metric and value, processes, tags, right-sizing, tight limits and guarded processes."""
    stats = stats.drop("exact")
    recs = recs.drop("exact")
    names = display_names(stats).select(F.col("run_id").alias("_r"), F.col("process").alias("_p"), "name")
    named = lambda df: df.join(names, (df["run_id"] == F.col("_r")) & (df["process"] == F.col("_p"))).drop("_r", "_p")
    metrics = ["tasks", "failed_tasks", "cached_tasks", "total_cost", "total_waste", "failed_cost", "cpu_h_requested", "cpu_h_used", "gib_h_requested", "gib_h_used"]
    values = totals.select("run_id", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot("run_id", metrics, "metric", "value")
    ranked = lambda df, n, value, *ties: pricing.top_k(df, n, value, *ties)
    return {
        "totals": values,
        "processes": named(ranked(pricing.with_share(stats), top, "cost", "process")),
        "tags": ranked(pricing.with_share(tags), top, "cost", "tag"),
        "right_sizing": named(ranked(recs.where("not needs_escalation"), top_sized, "saving", "process")),
        "tight": named(recs.where("time_tight")),
        "kept": named(recs.where("needs_escalation")),
        "not_sized": rightsize.not_sized(stats),
    }


def shown_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of :func:`report_tables` in the words of a report: dollars, per cents, hours and sizes as texts, ``n/a`` for what isn't known."""
    money, percent, hours = units.show_money, units.show_percent, units.show_hours
    change = lambda a, b: F.concat(a, F.lit(" \u2192 "), b)
    whole = lambda c: F.format_string("%.0f", F.bround(c, 0))
    time = change(hours(F.col("time_now_h")), F.concat(hours(F.col("time_new_h")), F.when(F.col("time_tight"), " (tight)").otherwise("")))
    retries = F.when(F.col("attempts_known"), F.col("retried_tasks").cast("string")).otherwise("n/a")
    return {
        "processes": tables["processes"].select("run_id", "rank", F.col("name").alias("process"), "tasks", hours(F.col("realtime_h")).alias("run_time"), money(F.col("cost")).alias("cost"), percent(F.col("share")).alias("share"), percent(F.col("cpu_efficiency")).alias("cpu_eff"), percent(F.col("mem_efficiency")).alias("mem_eff"), money(F.col("waste")).alias("waste"), retries.alias("retries"), "failed_tasks"),
        "tags": tables["tags"].select("run_id", "rank", F.coalesce("tag", F.lit("(untagged)")).alias("tag"), "tasks", "processes", hours(F.col("realtime_h")).alias("run_time"), money(F.col("cost")).alias("cost"), percent(F.col("share")).alias("share"), money(F.col("waste")).alias("waste")),
        "right_sizing": tables["right_sizing"].select("run_id", "rank", F.col("name").alias("process"), change(whole(F.col("cpus_now")), F.col("cpus_new").cast("string")).alias("cpus"), change(units.show_gib(F.col("mem_now_gib")), units.show_gib(F.col("mem_new_gib"))).alias("memory"), F.when(F.col("time_now_h") > 0, time).otherwise("n/a").alias("time"), money(F.col("saving")).alias("saving")),
        "tight": tables["tight"].select("run_id", F.concat("name", F.lit(" (longest task "), F.format_string("%.1f", "max_realtime_h"), F.lit(" h of "), hours(F.col("time_now_h")), F.lit(")")).alias("text")),
    }


def shown_totals(totals: DataFrame, r: Rates) -> DataFrame:
    """``(run_id, position, metric, value)``: a run's totals in the words of a report, the same run at the other presets among them.

    The basis of the prices is a row of its own; cached tasks have one only where there are some; requested hours are ``n/a`` where no task has a request.
    """
    money, percent = units.show_money, units.show_percent
    hours = lambda c: F.format_string("%.1f", c)
    unpriced, all_unpriced = F.col("tasks_without_requests"), F.col("tasks_without_requests") == F.col("tasks")
    metered = F.col("metered_cost") > 0

    def pair(requested: str, used: str, base: str):
        asked = F.when(all_unpriced, "n/a").otherwise(hours(requested))
        known = F.col(base) > 0
        return F.concat(asked, F.lit(" / "), F.when(known, hours(used)).otherwise("n/a"), F.lit(" ("), percent(F.when(known, F.col(used) / F.col(base))), F.lit(")"))

    others = [F.concat(money(F.col("priced_cpu_h") * p.cpu_hour + F.col("priced_gib_h") * p.gib_hour), F.lit(f" at {p.name}")) for p in pricing.PRESETS.values() if (p.name, p.cpu_hour, p.gib_hour) != (r.name, r.cpu_hour, r.gib_hour)]
    rows = {
        "cost": money(F.col("total_cost")),
        "basis": F.when(unpriced == 0, "requested x run time").when(all_unpriced, "used x run time").otherwise("requested x run time, used where no request is known"),
        "cached": F.when(F.col("cached_tasks") > 0, F.concat(money(F.col("cached_cost")), F.lit(" ("), F.col("cached_tasks").cast("string"), F.lit(" tasks)"))),
        "unused": F.when(metered, F.concat(money(F.col("total_waste")), F.lit(" ("), percent(F.col("unused_share")), F.lit(" of the "), money(F.col("metered_cost")), F.lit(" metered)"))).otherwise("n/a"),
        "failed attempts": money(F.col("failed_cost")),
        "other rates": F.concat_ws(", ", *others),
        "run time": F.concat(hours("realtime_h"), F.lit(" h")),
        "cpu-hours": pair("cpu_h_requested", "cpu_h_used", "cpu_h_req_metered"),
        "gib-hours": pair("gib_h_requested", "gib_h_used", "gib_h_req_metered"),
    }
    each = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name).alias("metric"), value.alias("value")) for i, (name, value) in enumerate(rows.items(), 1)])
    return totals.select("run_id", F.explode(each).alias("m")).select("run_id", "m.*").where("value is not null")
