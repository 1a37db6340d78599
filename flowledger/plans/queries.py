"""Registered queries of the fleet operators, over the task lens or text that Spark renders from it."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from ..operators import compare, fleet, leaks, pricing, redact, rightsize, sinks, tasks
from ..sources import files
from . import lens

RATES = pricing.rates()
SALT = "fixed-salt"
FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


KEPT: list[DataFrame] = []


def query(f):
    @functools.wraps(f)
    def run(spark, d):
        """As the query; what an earlier one has kept is let go (and would be computed again where it is still asked for)."""
        while KEPT:
            KEPT.pop().unpersist()
        return f(spark, d)

    FOUND[f.__name__] = run
    return f


def _tasks(spark, d, places=False):
    """Deduplicated tasks. Numbering the rows of a run takes another pass over the tables and a shuffle, so only queries that show or use places ask for them."""
    return tasks.dedup_tasks(lens.attempts(spark, d, places), lens.tasks_for(spark, d), None if places else lens.LINE_ORDER)


def _priced(spark, d, places=False):
    return pricing.price_tasks(_tasks(spark, d, places))


def _stats(spark, d):
    return pricing.process_stats(_priced(spark, d), RATES)


def _totals(spark, d):
    return pricing.run_totals(_stats(spark, d), RATES)


def _kept(df):
    """A small table (a row for each run and process) that a query uses several times, computed once."""
    KEPT.append(df.persist())
    return KEPT[-1]


def _written(spark, d, name):
    """A new folder for what a query writes and reads again: in the shared folder the cluster names, else a temporary one of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not (spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{shared or tempfile.mkdtemp(prefix='flowledger-')}/{name}-{uuid.uuid4().hex}"


def _recs(spark, d):
    return rightsize.recommend(_stats(spark, d), RATES)


def _runs(spark, d):
    """Runs of the lens with revision, commit, path and start date."""
    runs = lens.attempts(spark, d, places=False).groupBy("run_id").agg(F.min("revision").alias("revision"), F.min("order_date").alias("start_date"))
    number = F.substring("run_id", 4, 2).cast("int")
    return runs.select("run_id", "revision", "start_date", F.concat("run_id", F.lit("abcdef0123")).alias("commit"), F.concat(F.lit("data/"), F.when(number % 3 == 0, "aligner_star_rsem/").otherwise(""), "run_id", F.lit("/report.html")).alias("path"), F.concat(F.lit("24."), (number % 3).cast("string")).alias("nextflow_version"), F.when(number > 3, "aws").otherwise("local").alias("profile"))


@query
def process_cost(spark, d):
    shared = pricing.ranked(pricing.with_share(_stats(spark, d)), "cost", "process")
    return shared.select("run_id", "rank", "process", "tasks", "failed_tasks", "cost", "share", "cpu_efficiency", "mem_efficiency", "waste")


@query
def process_statistics(spark, d):
    return _stats(spark, d).select("run_id", "process", "tasks", "retried_tasks", "killed_tasks", "attempts_known", "tasks_with_metrics", "tasks_with_cpu", "tasks_with_rss", "completed_with_metrics", "has_requests", "realtime_h", "cpu_h_requested", "cpu_h_used", "gib_h_requested", "gib_h_used", "cpu_h_req_metered", "gib_h_req_metered", "max_cores_used", "max_rss_gib", "max_realtime_h", "failed_cost")


@query
def tag_cost(spark, d):
    ranked = pricing.ranked(pricing.tag_stats(_priced(spark, d), RATES), "cost", "tag")
    return ranked.select("run_id", "rank", "tag", "tasks", "processes", "realtime_h", "cost", "failed_cost", "waste")


@query
def tagged_share(spark, d):
    return pricing.tagged_share(pricing.tag_stats(_priced(spark, d), RATES))


@query
def run_totals(spark, d):
    return _totals(spark, d).select("run_id", "tasks", "processes", "failed_tasks", "cached_tasks", "tasks_without_requests", "tasks_without_metrics", "total_cost", "failed_cost", "cached_cost", "total_waste", "cpu_h_requested", "gib_h_requested", "priced_cpu_h", "priced_gib_h")


@query
def reprice_presets(spark, d):
    return pricing.reprice(_totals(spark, d), pricing.rates_table(spark))


@query
def unused_pct(spark, d):
    return _totals(spark, d).select("run_id", "metered_cost", "unused_share")


@query
def cost_basis(spark, d):
    return pricing.run_notices(_totals(spark, d))


@query
def killed_tasks(spark, d):
    return _priced(spark, d).where("killed").select("run_id", "hash", "process", "exit", "realtime_ms", "time_ms")


@query
def attempt_requests(spark, d):
    return _stats(spark, d).select("run_id", "process", "base_cpus", "retry_cpus", "max_cpus", "base_mem_gib", "retry_mem_gib", "max_mem_gib", "base_limit_h", "retry_limit_h", "max_limit_h")


@query
def dedup_tasks(spark, d):
    return _tasks(spark, d, places=True).select("run_id", "hash", "process", "status", "exit", "realtime_ms", "pos")


def _halves(spark, d, hashed=True, asked=None):
    """The lens as a trace that lacks requests and some rows, and a report that lacks others. With ``asked`` both are cut from one kept table of these columns, and the others are null."""
    t = _tasks(spark, d, places=True)
    if asked:
        others = {f.name: F.lit(None).cast(f.dataType) for f in t.schema.fields if f.name not in asked}
        t = _kept(t.select(*asked)).withColumns(others)
    t = t.withColumns({"path": F.col("run_id"), **{c: F.lit("") for c in ("native_id", "container", "queue")}, **{c: F.lit(None).cast("long") for c in ("duration_ms", "peak_vmem_kib", "rchar_kib", "wchar_kib")}})
    if not hashed:
        t = t.withColumn("hash", F.lit(""))
    # Requests are null in all rows (places are positive), by a condition, so that both halves ask for the same columns and share a shuffle.
    unknown = {c: F.when(F.col("pos") < 1, F.col(c)) for c in ("cpus_units", "memory_kib", "time_ms")}
    trace = t.where("pos % 10 <> 0").withColumns({**unknown, "tag": F.coalesce(F.when(F.col("pos") < 1, F.col("tag")), F.lit("trace"))})
    return trace, t.where("pos % 10 <> 1").withColumn("realtime_ms", F.when(F.col("pos") % 10 != 2, F.col("realtime_ms")))


@query
def merge_by_hash(spark, d):
    return tasks.merge_tasks(*_halves(spark, d), hashes="all").where("source = 'both'").select("run_id", "hash", "pos", "cpus_units", "memory_kib", "realtime_ms", "tag")


@query
def merge_by_name(spark, d):
    return tasks.merge_tasks(*_halves(spark, d, hashed=False), hashes="none").where("source = 'both'").select("run_id", "name", "pos", "cpus_units", "realtime_ms", "tag")


@query
def merge_mixed(spark, d):
    """A trace and a report that both lack some hashes."""
    trace, report = _halves(spark, d, asked=("run_id", "name", "hash", "task_id", "pos", "cpus_units", "realtime_ms", "tag"))
    bare = lambda df, n: df.withColumn("hash", F.when(F.col("pos") % n == 0, "").otherwise(F.col("hash")))
    return tasks.merge_tasks(bare(trace, 3), bare(report, 4)).select("run_id", "name", "source", "side", "pos", "hash", "cpus_units", "realtime_ms", "tag")


@query
def merge_leftovers(spark, d):
    return tasks.merge_tasks(*_halves(spark, d), hashes="all").where("source <> 'both'").select("run_id", "hash", "source", "side", "pos", "cpus_units", "realtime_ms", "tag")


def _text(ms):
    """Milliseconds as a trace would show them."""
    part = lambda n, u: F.concat(n.cast("long").cast("string"), F.lit(u))
    return F.concat_ws(" ", part(F.floor(ms / 3_600_000), "h"), part(F.floor(ms / 60_000) % 60, "m"), part(F.floor(ms / 1000) % 60, "s"), part(ms % 1000, "ms"))


@query
def parse_duration(spark, d):
    t = _tasks(spark, d).select("run_id", "hash", _text(F.col("realtime_ms")).alias("text"))
    return t.select("run_id", "hash", units.whole(units.duration_s(F.col("text")), 1000).alias("realtime_ms"))


@query
def parse_memory(spark, d):
    t = _tasks(spark, d).select("run_id", "hash", F.concat((F.col("memory_kib") / 1024).cast("long").cast("string"), F.lit(" MB")).alias("m"), F.concat(F.col("peak_rss_kib").cast("string"), F.lit("kb")).alias("r"))
    return t.select("run_id", "hash", units.whole(units.memory_bytes(F.col("m")), 1 / 1024).alias("memory_kib"), units.whole(units.memory_bytes(F.col("r")), 1 / 1024).alias("peak_rss_kib"))


@query
def parse_percent(spark, d):
    text = F.concat((F.col("pct_cpu_units") / 1000).cast("decimal(20,1)").cast("string"), F.lit("%"))
    return _tasks(spark, d).select("run_id", "hash", units.whole(units.percent(text), 1000).alias("pct_cpu_units"))


@query
def task_names(spark, d):
    names = lens.attempts(spark, d, places=False).groupBy("name").agg(F.count("*").alias("tasks"))
    return names.select("name", units.process_from_name(F.col("name")).alias("process"), units.tag_from_name(F.col("name")).alias("tag"), "tasks")


#: Tasks of one rendered file.
FILE_TASKS = 2000


def _file():
    return F.concat("run_id", F.lit("/part"), F.floor((F.col("pos") - 1) / FILE_TASKS).cast("string"))


def _cell(c):
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("-"))


TRACE_HEADER = "hash\tname\tstatus\texit\trealtime\t%cpu\tpeak_rss"


def _trace_lines(spark, d):
    """Lines of traces with their files' column names, as the reader of large traces finds them."""
    cells = [_cell("hash"), _cell("name"), _cell("status"), _cell("exit"), _cell(_text(F.col("realtime_ms"))), _cell(F.concat((F.col("pct_cpu_units") / 1000).cast("decimal(20,1)").cast("string"), F.lit("%"))), _cell(F.concat(F.col("peak_rss_kib").cast("string"), F.lit(" KB")))]
    return lens.attempts(spark, d).select("run_id", _file().alias("path"), "pos", F.concat_ws("\t", *cells).alias("line"), F.array(*[F.lit(c) for c in TRACE_HEADER.split("\t")]).alias("names"))


def _trace_files(spark, d):
    grouped = _trace_lines(spark, d).groupBy("run_id", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    return grouped.select("run_id", "path", F.concat(F.lit(f"{TRACE_HEADER}\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n\n")).alias("content"))


@query
def trace_lines_roundtrip(spark, d):
    parsed = tasks.to_tasks(files.parse_trace_lines(_trace_lines(spark, d)), "trace")
    return parsed.select("run_id", "hash", "process", "status", "exit", "realtime_ms", "pct_cpu_units", "peak_rss_kib")


@query
def trace_roundtrip(spark, d):
    parsed = tasks.to_tasks(files.parse_traces(_trace_files(spark, d)), "trace")
    return parsed.select("run_id", "hash", "process", "status", "exit", "realtime_ms", "pct_cpu_units", "peak_rss_kib")


def _report_files(spark, d):
    t = lens.attempts(spark, d)
    record = F.to_json(F.struct("hash", "process", F.coalesce("tag", F.lit("-")).alias("tag"), "name", "status", F.coalesce(F.col("exit").cast("string"), F.lit("-")).alias("exit"), F.col("attempt").cast("string").alias("attempt"), F.col("realtime_ms").alias("realtime"), (F.col("cpus_units") / 100_000).cast("long").alias("cpus"), (F.col("memory_kib") * 1024).cast("string").alias("memory"), F.col("time_ms").cast("string").alias("time"), F.lit("it's </done>").alias("script")))
    lines = t.select("run_id", "revision", _file().alias("path"), "pos", F.regexp_replace(record, "'", r"\\\\'").alias("line"))
    grouped = lines.groupBy("run_id", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    before = "<html><script>if (window.data == null) window.data_by = {};</script>\n<script>window.data = {\"trace\":["
    return grouped.select("run_id", "path", F.concat(F.lit(before), F.array_join(F.transform("rows", lambda r: r["line"]), ",\n"), F.lit('],"summary":null};\n</script></html>')).alias("content"))


@query
def report_roundtrip(spark, d):
    parsed = tasks.to_tasks(files.parse_reports(_report_files(spark, d)), "report")
    return parsed.select("run_id", "hash", "process", "tag", "status", "exit", "attempt", "realtime_ms", "cpus_units", "memory_kib", "time_ms")


@query
def report_errors(spark, d):
    good = _report_files(spark, d)
    number = F.substring(F.substring_index("path", "part", -1), 1, 4).cast("int") % 5
    broken = F.when(number == 0, "<html>no data here</html>").when(number == 1, 'window.data = {"trace": null}').when(number == 2, 'window.data = {"other": [1]};').when(number == 3, F.substring("content", 1, 300)).otherwise(F.col("content"))
    return files.parse_reports(good.withColumn("content", broken)).where("error is not null").select("path", "error")


def _header_files(spark, d):
    entry = lambda label, v: F.concat(F.lit(f"<dt>{label}</dt>\n<dd>"), v, F.lit("</dd>"))
    runs = _runs(spark, d)
    text = F.concat(
        F.lit('<html><span id="workflow_start">'), "start_date", F.lit('</span> duration: <strong> 5h 8m</strong>'),
        entry("Nextflow version", F.concat(F.lit("version "), "nextflow_version", F.lit(", build 5891"))),
        entry("Workflow profile", F.col("profile")),
        entry("Workflow repository", F.concat(F.lit("<a><code>https://github.com/pipes/rna</code></a>, revision <code>"), "revision", F.lit("</code> (commit hash <code>"), "commit", F.lit("</code>)"))),
        entry("Fusion enabled", F.lit("true, version 2.3")), entry("CPU-Hours", F.lit("1'177.0")),
        F.lit("<script>window.data = {\"trace\":[]};</script>"),
    )
    return runs.select("run_id", "path", text.alias("content"))


@query
def run_headers(spark, d):
    return files.run_summary(files.parse_headers(_header_files(spark, d))).select("run_id", "started", "duration", "nextflow_version", "profile", "repository", "revision", "commit", "fusion", "cpu_hours", "summary")


@query
def page_titles(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", files.title(F.col("html")).alias("title"))


@query
def recommendations(spark, d):
    return _recs(spark, d).select("run_id", "process", "cpus_now", "cpus_new", "mem_now_gib", "mem_new_gib", "time_now_h", "time_new_h", "saving", "needs_escalation", "time_tight")


@query
def not_sized(spark, d):
    return rightsize.not_sized(_stats(spark, d))


@query
def total_saving(spark, d):
    stats = _kept(_stats(spark, d))
    return rightsize.total_saving(rightsize.recommend(stats, RATES), pricing.run_totals(stats, RATES))


@query
def config_fragments(spark, d):
    return rightsize.config_fragments(_recs(spark, d))


@query
def config_literals(spark, d):
    t = _tasks(spark, d).select("memory_kib", "realtime_ms").distinct()
    return t.select("memory_kib", "realtime_ms", units.memory_literal(F.col("memory_kib") / 1_048_576.0).alias("memory"), units.duration_literal(F.col("realtime_ms") / 3_600_000.0).alias("time"))


def _processes(spark, d):
    """The processes of each run: names are compared several times, the tasks are read once."""
    return _kept(_tasks(spark, d).select("run_id", "process").distinct())


@query
def display_names(spark, d):
    return compare.display_names(_processes(spark, d))


@query
def matrix_names(spark, d):
    return compare.matrix_names(_processes(spark, d))


@query
def run_order(spark, d):
    return compare.order_runs(_runs(spark, d)).select("run_id", "revision", "start_date", "position")


@query
def run_labels(spark, d):
    runs = _runs(spark, d)
    routes = compare.route_hint(runs, _stats(spark, d), ends={"small": ("SMALL_ALIGN",), "salmon": ("STANDARD_ALIGN",)}).select(F.col("run_id").alias("_r"), "route")
    return runs.join(routes, runs["run_id"] == F.col("_r")).select("run_id", "route", compare.run_label(F.col("revision"), F.col("commit"), F.col("route"), F.col("start_date")).alias("label"))


@query
def start_dates(spark, d):
    parts = F.split("order_date", "-")
    months = F.array(*[F.lit(m.capitalize()) for m in units.MONTHS])
    text = F.concat(parts[2], F.lit("-"), F.element_at(months, parts[1].cast("int")), F.lit("-"), parts[0], F.lit(" 10:00:00"))
    return lens.attempts(spark, d, places=False).select("order_date").distinct().select("order_date", units.start_date(text).alias("start_date"))


@query
def compare_runs(spark, d):
    stats = _kept(_stats(spark, d))
    return compare.compare_runs(pricing.run_totals(stats, RATES), stats, compare.matrix_names(stats))


@query
def share_matrix_long(spark, d):
    stats = _kept(_stats(spark, d))
    return compare.share_matrix(stats, compare.matrix_names(stats))


@query
def share_matrix_pivot(spark, d):
    stats = _kept(_stats(spark, d))
    return compare.pivot_matrix(compare.share_matrix(stats, compare.matrix_names(stats)), [f"run{i}" for i in range(7)])


@query
def top_processes(spark, d):
    return pricing.top_k(_stats(spark, d), 25, "cost", "process").select("run_id", "rank", "process", "cost")


def _report(spark, d):
    usage = _kept(pricing.usage(_priced(spark, d)))
    stats = pricing.process_stats_of(usage, RATES)
    return compare.report_tables(stats, pricing.tag_stats_of(usage, RATES), pricing.run_totals(stats, RATES), rightsize.recommend(stats, RATES), RATES)


@query
def report_totals(spark, d):
    return _report(spark, d)["totals"]


@query
def report_processes(spark, d):
    return _report(spark, d)["processes"].select("run_id", "rank", "name", "tasks", "cost", "share", "cpu_efficiency", "mem_efficiency")


@query
def report_tags(spark, d):
    return _report(spark, d)["tags"].select("run_id", "rank", "tag", "tasks", "processes", "cost", "share")


@query
def report_right_sizing(spark, d):
    return _report(spark, d)["right_sizing"].select("run_id", "rank", "name", "cpus_now", "cpus_new", "mem_now_gib", "mem_new_gib", "saving")


@query
def report_tight_and_kept(spark, d):
    tables = _report(spark, d)
    return tables["tight"].select("run_id", "name", F.lit("tight").alias("list")).union(tables["kept"].select("run_id", "name", F.lit("kept").alias("list")))


@query
def shown_processes(spark, d):
    return compare.shown_tables(_report(spark, d))["processes"]


@query
def shown_tags(spark, d):
    return compare.shown_tables(_report(spark, d))["tags"]


@query
def shown_right_sizing(spark, d):
    return compare.shown_tables(_report(spark, d))["right_sizing"]


@query
def shown_totals(spark, d):
    return compare.shown_totals(_totals(spark, d), RATES)


@query
def recommendations_at_margin(spark, d):
    """Right-sizing with twice the observed peaks."""
    return rightsize.recommend(_stats(spark, d), RATES, margin=2.0).select("run_id", "process", "cpus_new", "mem_new_gib", "time_new_h", "saving")


@query
def fragment_lines(spark, d):
    """Config fragments written as text files, read again line by line."""
    folder = _written(spark, d, "fragments")
    sinks.write_fragments(rightsize.config_fragments(_recs(spark, d)), folder)
    lines = spark.read.text(folder)
    return lines.groupBy("run_id").agg(F.count_if(F.trim("value") != "").alias("lines"), F.count_if(F.col("value").contains("withName")).alias("processes"))


@query
def inspect_runs(spark, d):
    raw = files.parse_traces(_trace_files(spark, d))
    typed = tasks.to_tasks(raw, "trace")
    return files.inspect(raw, typed).select("path", "kind", "tasks", "with_requests", "with_metrics", F.array_join("columns", ",").alias("columns"), "notes")


@query
def manifest_check(spark, d):
    """All documents against a manifest of all of them in which some were renamed and some changed since."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), "n_chars")
    listed = docs.select(F.when(F.col("n_chars") % 7 == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"), F.when(F.col("n_chars") % 5 == 0, "changed").otherwise(F.col("sha256")).alias("sha256"))
    return files.verify_manifest(docs.select("path", "sha256"), listed)


def _raw(spark, d, places=False):
    """Lens rows as raw records, two fields of which aren't known."""
    t = _tasks(spark, d, places)
    keys = {"hash": "hash", "process": "process", "name": "name", "tag": F.coalesce("tag", F.lit("-")), "status": "status", "queue": F.concat(F.lit("queue-"), F.substring("process", 6, 3)), "workdir": F.concat(F.lit("/work/"), "hash")}
    return t.select("run_id", F.col("run_id").alias("path"), "pos", F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(v) if isinstance(v, str) else v for v in keys.values()])).alias("f"), F.lit(None).cast("string").alias("error"))


@query
def pseudonyms(spark, d):
    tags = lens.attempts(spark, d, places=False).select("tag").where("tag is not null").distinct()
    return tags.select("tag", units.pseudonym(F.col("tag"), "tag", SALT).alias("as_tag"), units.pseudonym(F.col("tag"), "value", SALT).alias("as_value"))


@query
def pseudonyms_by_salt(spark, d):
    """The same tags under three salts, and the length of a drawn one: how many pseudonyms stand for each tag."""
    tags = lens.attempts(spark, d, places=False).select("tag").where("tag is not null").distinct()
    salts = [SALT, "other-salt", SALT]
    each = tags.select("tag", F.array(*[units.pseudonym(F.col("tag"), "tag", s) for s in salts]).alias("p"))
    return each.select("tag", F.size(F.array_distinct("p")).alias("pseudonyms"), F.get("p", F.lit(1)).alias("by_other"), F.lit(len(redact.new_salt())).alias("salt_letters"))


@query
def redacted_tasks(spark, d):
    f = redact.redact_records(_raw(spark, d, places=True), SALT)
    return f.select("run_id", "pos", *[F.col("f")[k].alias(k) for k in ("hash", "process", "name", "tag", "queue", "workdir")])


@query
def redaction_map(spark, d):
    return redact.redaction_map(_raw(spark, d), SALT)


@query
def redaction_counts(spark, d):
    return redact.map_counts(redact.redaction_map(_raw(spark, d), SALT))


@query
def redaction_collisions(spark, d):
    """Collisions of pseudonyms cut to their last four characters."""
    return redact.collisions(redact.redaction_map(_raw(spark, d), SALT).withColumn("pseudonym", F.substring("pseudonym", -4, 4)))


@query
def redaction_invariance(spark, d):
    """Figures of the redacted records, read again as tasks: those of the tasks themselves."""
    shown = {"%cpu": F.concat((F.col("pct_cpu_units") / 1000).cast("decimal(20,1)").cast("string"), F.lit("%")), "peak_rss": F.concat(F.col("peak_rss_kib").cast("string"), F.lit(" KB")), "cpus": (F.col("cpus_units") / 100_000).cast("long").cast("string"), "memory": (F.col("memory_kib") * 1024).cast("string"), "time": F.col("time_ms").cast("string"), "realtime": F.col("realtime_ms").cast("string"), "exit": F.col("exit").cast("string"), "attempt": F.col("attempt").cast("string")}
    keys = {"hash": F.col("hash"), "process": F.col("process"), "name": F.col("name"), "tag": F.col("tag"), "status": F.col("status"), **shown}
    raw = _tasks(spark, d).select("run_id", F.col("run_id").alias("path"), "pos", F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[_cell(v) for v in keys.values()])).alias("f"))
    priced = pricing.price_tasks(tasks.to_tasks(redact.redact_records(raw, SALT), "report"))
    usage = _kept(pricing.usage(priced))
    stats = pricing.process_stats_of(usage, RATES)
    tags = pricing.tag_stats_of(usage, RATES).groupBy(F.col("run_id").alias("_t")).agg(F.count_if(F.col("tag").startswith("tag-")).alias("tags"), F.count("*").alias("tag_groups"))
    totals = rightsize.total_saving(rightsize.recommend(stats, RATES), pricing.run_totals(stats, RATES)).withColumnRenamed("run_id", "_s")
    runs = pricing.run_totals(stats, RATES)
    return runs.join(tags, F.col("run_id") == F.col("_t")).join(totals, F.col("run_id") == F.col("_s")).select("run_id", "tasks", "processes", "tags", "tag_groups", "total_cost", "total_waste", "unused_share", "saving")


@query
def redacted_traces(spark, d):
    """Trace files redacted as text, and read again."""
    again = files.parse_traces(redact.redact_trace_files(_trace_files(spark, d), SALT))
    return again.select("run_id", *[F.col("f")[k].alias(k) for k in ("hash", "name", "status", "realtime")])


@query
def redacted_reports(spark, d):
    """Reports' task objects redacted, and read again as reports."""
    json = redact.redact_reports(_report_files(spark, d), SALT)
    again = files.parse_reports(json.select("run_id", "path", F.concat(F.lit("<script>window.data = "), "json", F.lit(";</script>")).alias("content")))
    return again.select("run_id", *[F.col("f")[k].alias(k) for k in ("hash", "process", "tag", "name", "script", "cpus", "memory")])


def _failed_headers(spark, d):
    """Headers of failed runs with a run name, an error text and a field that isn't known."""
    extra = F.concat(F.lit("<title>[run-"), "run_id", F.lit('] report</title><div class="alert alert-danger"><p>x</p><pre>cannot read\n  /data/'), "run_id", F.lit("</pre></div><dt>Nextflow command</dt><dd><code>nextflow run &quot;x&amp;y&quot; --n &#39;"), "run_id", F.lit("&#x27;  &lt;in&gt;</code></dd><dt>Odd field</dt><dd>odd "), "run_id", F.lit("</dd><dt>Script name</dt><dd>main.nf</dd>"))
    return files.parse_headers(_header_files(spark, d).withColumn("content", F.concat(extra, "content")))


@query
def redacted_headers(spark, d):
    return redact.redact_headers(_failed_headers(spark, d), SALT).select("run_id", "command", "repository", "profile", "error_text", "run_name", "nextflow_version")


@query
def header_scan(spark, d):
    """What is scanned of redacted headers, and the originals that it is scanned for."""
    facts = _failed_headers(spark, d)
    scanned = redact.header_texts(redact.redact_headers(facts, SALT)).select(F.lit("scanned").alias("what"), "text")
    return scanned.union(redact.header_map(facts, SALT).select("pseudonym", "original"))


def _odd_reports(spark, d):
    """Reports with nested values in records, a summary's labels and other parts of the object."""
    rows = lens.attempts(spark, d).select("run_id", _file().alias("path"), "pos", F.to_json(F.struct("hash", "process", "name", F.coalesce("tag", F.lit("-")).alias("tag"), F.col("realtime_ms").alias("realtime"), F.struct(F.col("run_id").alias("RUN")).alias("env"), F.lit(7).alias("odd"), F.concat(F.lit("cd /work/"), "hash", F.lit("\n./run \"x\"")).alias("script"))).alias("line"))
    grouped = rows.groupBy("run_id", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    after = F.concat(F.lit('],"summary":[{"process":"P","cpu":{"minLabel":"A (only '), "path", F.lit(')","min":1.5,"text":"kept"}}],"cmd":"/secret/'), "path", F.lit('","deep":{"list":["one '), "run_id", F.lit('",3,null,true]}};\n</script>'))
    return grouped.select("run_id", "path", F.concat(F.lit('<script>window.data = {"trace":['), F.array_join(F.transform("rows", lambda r: r["line"]), ","), after).alias("content"))


@query
def report_redaction_map(spark, d):
    """All that the redaction of reports replaces, taken from the rows that make up the redacted reports."""
    return redact.replaced_values(redact.report_parts(_odd_reports(spark, d), SALT), SALT)


@query
def trace_redaction_map(spark, d):
    """All that the redaction of traces replaces; every tenth row has a cell past the header."""
    t = lens.attempts(spark, d).where("pos % 10 = 0 or pos % 10 = 1")
    line = F.concat_ws("\t", F.concat(F.lit(" "), "name"), "status", F.concat(F.lit("/scratch/"), F.col("attempt").cast("string")), F.when(F.col("pos") % 10 == 0, F.concat(F.lit("past "), "run_id")))
    grouped = t.select("run_id", _file().alias("path"), "pos", line.alias("line")).groupBy("run_id", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    found = grouped.select("run_id", "path", F.concat(F.lit("name\tstatus\tworkdir\r\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\r\n")).alias("content"))
    return redact.replaced_values(redact.trace_lines(found, SALT), SALT)


@query
def leak_scan_paths(spark, d):
    """Folders that differ in their last part only, looked for by key in texts that all hold their common parts: each text has the next document's."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    folder = lambda c: F.concat(F.lit("/work/runs/"), F.md5(c.cast("string")))
    texts = docs.select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" at "), folder(F.col("doc_id") + 1), F.when(F.col("doc_id") % 2 == 0, F.lit("/x y")).otherwise("")).alias("text"))
    return leaks.leak_scan(texts, docs.select(F.col("doc_id").alias("value"), folder(F.col("doc_id")).alias("needle")), most_chars=0)


@query
def leak_needles(spark, d):
    """Passages as a leak would show them: escaped for JSON and for HTML."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat(F.lit("<a href=\"/x\">it's & "), F.substring("text", 1, 40), F.lit("\\</a>")).alias("original"))
    return leaks.needles(items.union(items.select(F.substring("original", 1, 4))))


@query
def leak_scan(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    wanted = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("value"), F.col("text").alias("needle"))
    return leaks.leak_scan(docs, wanted)


@query
def leak_scan_tokens(spark, d):
    """The same scan by words instead of a broadcast: benchmark passages, their first words, and tags of the tasks."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("string").alias("value"), F.col("text").alias("needle"))
    first = items.select(F.concat(F.lit("word "), "value").alias("value"), F.regexp_extract("needle", "([A-Za-z]{5,})", 1).alias("needle")).where("needle <> ''")
    return leaks.leak_scan(docs, items.union(first), most_chars=0)


@query
def location_markers(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return leaks.location_markers(docs, ("@", "example.com")).select("id", F.array_join("markers", ",").alias("markers"))


@query
def usage_quantiles(spark, d):
    return fleet.usage_quantiles(_tasks(spark, d), "pct_cpu_units", (0.25, 0.5, 0.75))


@query
def quantiles_since_release(spark, d):
    t = _tasks(spark, d)
    recent = fleet.since_release(t, units.release_key(F.col("revision")), [3, 8])
    return fleet.usage_quantiles(recent, "realtime_ms", (0.25, 0.75), ("run_id",))


@query
def share_history(spark, d):
    return fleet.share_history(_stats(spark, d))


@query
def share_by_release(spark, d):
    return fleet.share_by_release(_stats(spark, d), compare.order_runs(_runs(spark, d)))


@query
def share_band(spark, d):
    return fleet.share_band(fleet.share_by_release(_stats(spark, d), compare.order_runs(_runs(spark, d))), 2, 4)


def _delta(spark, d):
    stats = _kept(_stats(spark, d))
    return fleet.release_delta(stats, compare.matrix_names(stats), "run1", "run2")


@query
def release_delta(spark, d):
    return _delta(spark, d)


@query
def biggest_mover(spark, d):
    return fleet.biggest_mover(_delta(spark, d), ("STANDARD_ALIGN",))


@query
def outside_band(spark, d):
    return fleet.outside_band(_totals(spark, d), 0.5, 0.62)


@query
def run_selection(spark, d):
    """The lens by month: release is the year's revision, a month fails as a run if over 8 per cent of its tasks failed."""
    t = _tasks(spark, d).withColumn("month", F.substring("order_date", 1, 7))
    runs = t.groupBy("revision", "month").agg((F.count_if(F.col("status") == "FAILED") * 100 <= 8 * F.count("*")).alias("ok"), F.min("order_date").alias("start_date"))
    runs = runs.select(F.col("revision").alias("release"), F.when(F.substring("month", 6, 2).cast("int") % 2 == 0, "rsem").otherwise("salmon").alias("route"), F.col("month").alias("run_id"), "start_date", "ok")
    failed = t.where("status = 'FAILED' and process like '%ALIGN'").select(F.col("month").alias("run_id"))
    return fleet.select_runs(runs, failed)


@query
def metering_audit(spark, d):
    return fleet.metering_audit(_tasks(spark, d))


@query
def attempt_history(spark, d):
    return fleet.attempt_history(_tasks(spark, d, places=True)).select("run_id", "process", "tag", "attempt", "status", "exit", "realtime_ms", "step", "most_attempts")


@query
def launch_changes(spark, d):
    return fleet.launch_changes(compare.order_runs(_runs(spark, d)))


@query
def script_changes(spark, d):
    """Scripts and containers of each process from run to run: the image moves to another registry, and one process's script changes."""
    order = compare.order_runs(_runs(spark, d)).select(F.col("run_id").alias("_r"), "position")
    number = F.substring("run_id", 4, 2).cast("int")
    t = _tasks(spark, d, places=True).withColumns({"script": F.concat(F.lit("align "), F.coalesce("tag", F.lit("all")), F.lit(" --x "), F.when(F.col("process").contains("SMALL"), number % 2).otherwise(0).cast("string")), "container": F.concat(F.when(number > 3, "wave.example/x/").otherwise("quay.example/"), F.lit("bio/"), F.lower(F.substring("process", 6, 3)))})
    t = t.withColumn("script", F.when(F.col("tag").isNull(), F.regexp_replace("script", "align all", "align <S>")).otherwise(F.col("script")))
    launched = fleet.launched_tasks(t)
    return fleet.launch_changes(launched.join(order, launched["run_id"] == order["_r"]), ("script", "image", "registry"), by="process")


@query
def request_history(spark, d):
    return fleet.request_history(_stats(spark, d))


@query
def sample_range(spark, d):
    return fleet.sample_range(pricing.tag_stats(_priced(spark, d), RATES), "^S[0-3]$")


@query
def used_unused_by_release(spark, d):
    return fleet.used_unused(_totals(spark, d), compare.order_runs(_runs(spark, d)))


@query
def cores_per_task(spark, d):
    return fleet.cores_per_task(_tasks(spark, d))


@query
def escalation_audit(spark, d):
    return fleet.escalation_audit(_recs(spark, d))


@query
def cached_audit(spark, d):
    return fleet.cached_audit(_tasks(spark, d))


@query
def cpu_hours_reconcile(spark, d):
    """The figure as the runs' headers state it: requested seconds summed straight from the tasks, with thousands and failures named; run 2's is an hour off."""
    tenths = F.floor(F.sum(F.expr("CAST(cpus_units AS DECIMAL(20,0)) * realtime_ms")) / F.lit(36_000_000_000).cast("decimal(20,0)")) + F.when(F.col("run_id") == "run2", 10).otherwise(0)
    stated = _tasks(spark, d).groupBy("run_id").agg(tenths.cast("long").alias("t"))
    whole = F.floor(F.col("t") / 10)
    text = F.concat(F.floor(whole / 1000).cast("string"), F.lit("'"), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit("."), (F.col("t") % 10).cast("string"), F.lit(" (4.2% failed)"))
    headers = stated.select("run_id", F.col("run_id").alias("path"), F.concat(F.lit("<dt>CPU-Hours</dt><dd>"), text, F.lit('</dd><script>window.data = {"trace":[]};</script>')).alias("content"))
    return fleet.reconcile_cpu_hours(_totals(spark, d), files.parse_headers(headers), 0.1).select("run_id", "stated", "agrees")


@query
def failure_tail(spark, d):
    failed = _priced(spark, d, places=True).where("status = 'FAILED'")
    text = F.concat(F.lit("Error\nCommand output:\n  first\nCommand output:\n  Parsed 100 entries\n  "), F.when(F.col("killed"), F.concat(F.lit("Parsed "), F.col("pos").cast("string"), F.lit(" entries"))).otherwise(F.lit("done")), F.lit("  \n\nFusion Info:\n  x"), F.when(F.col("exit").isNull(), " Timeout").otherwise(""))
    return fleet.failure_tail(failed.select(F.concat_ws("|", "run_id", "hash").alias("run_id"), text.alias("text")))


@query
def read_amplification(spark, d):
    t = _tasks(spark, d, places=True).withColumns({"rchar_kib": F.col("peak_rss_kib"), "script": F.when(F.col("pos") % 2 == 0, F.concat(F.lit("if [ "), (F.col("realtime_ms") + 1).cast("string"), F.lit(" -gt 1 ]; then"))).otherwise("true")})
    return fleet.read_amplification(t.where("rchar_kib is not null"))


@query
def scaling_table(spark, d):
    t = _tasks(spark, d).where("cpus_units is not null").groupBy(F.col("run_id").alias("benchmark"), (F.col("cpus_units") / 100_000).cast("long").alias("variant")).agg((F.max("realtime_ms") / 1000.0).alias("wall_s"), (F.sum("realtime_ms") / 1000.0).alias("cpu_s"))
    return fleet.scaling_table(t)


@query
def output_identity(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return fleet.output_identity(docs.select(F.col("source").alias("benchmark"), F.col("n_chars").cast("string").alias("file"), F.sha2("text", 256).alias("sha256")))


@query
def analysis_documents(spark, d):
    """Each run's JSON document, read again: a row for each process."""
    stats = _kept(_stats(spark, d))
    runs = _runs(spark, d).select("run_id", "revision", "profile")
    docs = sinks.analysis_json(pricing.run_totals(stats, RATES), stats.select("run_id", "process", "cost"), rightsize.recommend(stats, RATES).select("run_id", "process", "saving"), rightsize.not_sized(stats), runs, RATES)
    schema = "run_id string, tasks long, total_cost double, rates struct<name:string,cpu_hour:double>, meta struct<revision:string,profile:string>, processes array<struct<process:string,cost:double>>, recommendations array<struct<process:string,saving:double>>, not_sized array<struct<process:string,completed_with_metrics:long>>"
    doc = docs.select(F.from_json("json", schema).alias("d")).select("d.*")
    each = doc.select("run_id", "tasks", "total_cost", F.col("rates.name").alias("rates"), F.col("rates.cpu_hour").alias("cpu_hour"), F.col("meta.revision").alias("revision"), F.col("meta.profile").alias("profile"), F.explode("processes").alias("p"), "recommendations", "not_sized")
    own = lambda c: F.filter(F.coalesce(c, F.array().cast(each.schema[c].dataType)), lambda x: x["process"] == F.col("p.process"))
    return each.select("run_id", "tasks", "total_cost", "rates", "cpu_hour", "revision", "profile", "p.process", "p.cost", F.get(own("recommendations"), F.lit(0))["saving"].alias("saving"), F.get(own("not_sized"), F.lit(0))["completed_with_metrics"].alias("completed_with_metrics"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(FOUND)
