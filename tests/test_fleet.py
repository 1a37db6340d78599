"""Cases of the fleet operators that the given tables don't reach."""

import json
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from flowledger.functions import units
from flowledger.operators import compare, fleet, leaks, pricing, redact, rightsize, sinks, tasks
from flowledger.plans import lens, queries
from flowledger.sources import files

R = pricing.rates()
FIELDS = "run_id string, path string, pos long, hash string, task_id string, native_id string, name string, process string, status string, container string, queue string, exit long, attempt int, duration_ms long, realtime_ms long, pct_cpu_units long, peak_rss_kib long, peak_vmem_kib long, rchar_kib long, wchar_kib long, cpus_units long, memory_kib long, time_ms long, tag string"
HOUR, GIB, CORE = 3_600_000, 1_048_576, 100_000


def make(spark, *rows):
    base = dict(run_id="r", path="p", hash="", task_id="", native_id="", name="P (s)", process="P", status="COMPLETED", container="", queue="", exit=0, attempt=None, duration_ms=None, realtime_ms=HOUR, pct_cpu_units=None, peak_rss_kib=None, peak_vmem_kib=None, rchar_kib=None, wchar_kib=None, cpus_units=None, memory_kib=None, time_ms=None, tag="s")
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple({**base, "pos": i, **r}[n] for n in names) for i, r in enumerate(rows)], FIELDS)


def stats(spark, *rows):
    return pricing.process_stats(pricing.price_tasks(make(spark, *rows)), R)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


FULL = dict(pct_cpu_units=2 * CORE, peak_rss_kib=4 * GIB, cpus_units=8 * CORE, memory_kib=32 * GIB, time_ms=8 * HOUR)


@pytest.mark.parametrize("text,want", [("1h 2m 3s", 3723.0), ("350ms", 0.35), ("1d 2h", 93600.0), ("2.5s", 2.5), ("1500", 1.5), ("", None), ("-", None), ("5 parsecs", None), ("1h2m", 3720.0), ("12 3s", 15.0), ("5 m 3s", None), ("NaN", None), (" 1m\r", 60.0)])
def test_durations(spark, text, want):
    assert one(spark, units.duration_s, text) == pytest.approx(want) if want is not None else one(spark, units.duration_s, text) is None


@pytest.mark.parametrize("text,want", [("12.5 GB", 12.5 * 2**30), ("512 MB", 512 * 2.0**20), ("1 tb", 2.0**40), ("0", 0.0), ("204 B", 204.0), ("3k", 3072.0), ("-", None), ("", None), ("5 QB", None), ("1e3", 1000.0)])
def test_memory(spark, text, want):
    assert one(spark, units.memory_bytes, text) == want


def test_small_parsers(spark):
    assert [one(spark, units.percent, t) for t in ("95.3%", "95.3", "-", "")] == [95.3, 95.3, None, None]
    assert [one(spark, units.number, t) for t in ("12", "12f", "inf", "-3.5")] == [12.0, None, None, -3.5]
    assert [one(spark, units.tag_from_name, t) for t in ("A:B (x (y))", "A:B", "A (x) b", "A ()")] == ["x (y)", None, None, None]
    assert [one(spark, units.release_key, t) for t in ("3.15.1", "master", "3.x", "3")] == [[3, 15, 1], None, None, [3]]
    assert [one(spark, units.start_date, t) for t in ("16-Sep-2024 16:33:27", "5-jan-2024", "yesterday", None)] == ["2024-09-16", "2024-01-05", "yesterday", ""]
    assert [one(spark, units.memory_literal, g, "double") for g in (12.0, 3.5, 0.0001, None)] == ["12.GB", "3584.MB", "104.KB", None]
    assert [one(spark, units.duration_literal, h, "double") for h in (16.0, 1.5, 75 / 3600)] == ["16.h", "90.m", "75.s"]
    assert [one(spark, units.show_gib, g, "double") for g in (12.0, 3.5, 0.5, 0.0002)] == ["12 GB", "3.5 GB", "512 MB", "209.72 KB"]
    assert [one(spark, units.show_hours, h, "double") for h in (59.6 / 60, 8.0, 6.4)] == ["60m", "8h", "6.4h"]
    assert [one(spark, units.show_percent, x, "double") for x in (0.664, 1.2, None)] == ["66%", "120%", "n/a"]
    assert [one(spark, units.show_money, x, "double") for x in (79.234, 0.0, None)] == ["$79.23", "$0.00", "n/a"]
    assert [one(spark, units.round_mem_gib, g, "double") for g in (0.2, 1.2, 9.0, 65.0)] == [1.0, 2.0, 10.0, 72.0]
    assert [one(spark, units.round_time_h, h, "double") for h in (0.1, 0.6, 1.2)] == [0.25, 0.75, 2.0]


def text_files(spark, **content):
    return spark.createDataFrame([("r", p, c) for p, c in content.items()], "run_id string, path string, content string")


def test_traces(spark):
    raw = files.parse_traces(text_files(spark, a="hash\t name \tx\tx\r\nh1\tP (t)\t1\t2\textra\r\n\r\nh2\tshort\r\n", b="task_id\tstatus\n1\tOK\n"))
    rows = {(r.path, r.pos): (r.f, r.error) for r in raw.collect()}
    assert rows[("a", 0)] == ({"hash": "h1", "name": "P (t)", "x": "2"}, None)
    assert rows[("a", 2)] == (None, "short_row") and rows[("b", 0)] == (None, "no_name_column") and len(rows) == 3


def test_reports(spark):
    good = r"""<script>if (window.data == null) window.data.summary = {};</script> window.data_byprocess = {};
    window.data = {"trace": [{"name": "P (it\'s)", "exit": 0, "tag": null, "cpus": 2, "s": "a } b <\/x>"}, 7, {"name": "Q"}], "summary": {}}; more();</script>"""
    bad = {"none": "<html>", "many": 'window.data = {"trace": null}', "other": 'window.data = {"x": 1};', "text": 'window.data = {"trace": "no"};', "cut": 'window.data = {"trace": [{"name": "P'}
    raw = files.parse_reports(text_files(spark, good=good, **bad))
    got = {r.path: r.error for r in raw.where("error is not null").collect()}
    assert got == {"none": "no_window_data", "many": "max_tasks", "other": "no_trace", "text": "no_trace", "cut": "bad_json"}
    records = [r.f for r in raw.where("error is null").orderBy("pos").collect()]
    assert records == [{"name": "P (it's)", "exit": "0", "tag": "", "cpus": "2", "s": "a } b </x>"}, {"name": "Q"}]
    typed = tasks.to_tasks(raw, "report").orderBy("pos").collect()
    assert (typed[0].tag, typed[0].cpus_units, typed[0].exit, typed[0].process) == (None, 200_000, 0, "P") and typed[1].status == ""


def test_files_on_disk(spark, tmp_path):
    for run in ("run1", "run2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "trace.txt").write_text("name\tstatus\nP (a)\tCOMPLETED\n")
        (tmp_path / run / "report.html").write_text('<dt>x</dt><script>window.data = {"trace":[{"name":"P (a)"}]};</script>')
    assert {r.run_id.rsplit("/", 1)[1] for r in files.read_traces(spark, f"{tmp_path}/*/trace.txt").collect()} == {"run1", "run2"}
    assert files.read_reports(spark, f"{tmp_path}/*/report.html", strict=True).count() == 2
    (tmp_path / "run1" / "report.html").write_text("nothing")
    with pytest.raises(Exception, match="no_window_data"):
        files.read_reports(spark, f"{tmp_path}/*/report.html", strict=True).count()
    hashes = files.file_hashes(spark, f"{tmp_path}/*/trace.txt")
    assert {r.status for r in files.verify_manifest(hashes, hashes).collect()} == {"ok"}
    assert files.read_run_headers(spark, f"{tmp_path}/*/report.html").where("revision is null").count() == 2


def test_dedup_keeps_the_last_row_at_the_first_place(spark):
    df = make(spark, dict(hash="a", status="ABORTED"), dict(hash="b"), dict(hash="a", status="FAILED"), dict(task_id="1"), dict(task_id="1", status="X"), dict(), dict())
    got = [(r.pos, r.hash, r.status) for r in tasks.dedup_tasks(df).orderBy("pos").collect()]
    assert got == [(0, "a", "FAILED"), (1, "b", "COMPLETED"), (3, "", "X"), (5, "", "COMPLETED"), (6, "", "COMPLETED")]


def sequential_merge(trace, report):
    """The order-dependent rule, stated row by row: (trace pos, report pos) of each task."""
    by_hash = {r["hash"]: i for i, r in enumerate(report) if r["hash"]}
    hashed = any(t["hash"] for t in trace)
    pair, used = {}, set()
    for i, t in enumerate(trace):
        if t["hash"] and t["hash"] in by_hash:
            pair[i] = by_hash[t["hash"]]
            used.add(pair[i])
    for i, t in enumerate(trace):
        if i not in pair:
            for j, r in enumerate(report):
                if j not in used and r["name"] == t["name"] and not (hashed and r["hash"]):
                    pair[i] = j
                    used.add(j)
                    break
    return {(i, pair.get(i)) for i in range(len(trace))} | {(None, j) for j in range(len(report)) if j not in used}


def test_merge_equals_the_sequential_rule(spark):
    rng = random.Random(1)
    left, right, want = [], [], set()
    for case in range(60):
        hashed = rng.random() < 0.5
        t = [dict(hash=f"h{i}" if hashed else "", name=f"n{rng.randint(0, 2)}") for i in range(rng.randint(1, 6))]
        r = [dict(hash=rng.choice(["", f"h{i}"]), name=f"n{rng.randint(0, 2)}") for i in range(rng.randint(0, 6))]
        left += [dict(x, run_id=f"r{case}", pos=i, cpus_units=None, native_id=f"t{i}") for i, x in enumerate(t)]
        right += [dict(x, run_id=f"r{case}", pos=i, cpus_units=i + 1, tag=None) for i, x in enumerate(r)]
        want |= {(f"r{case}", *p) for p in sequential_merge(t, r)}
    merged = tasks.merge_tasks(make(spark, *left), make(spark, *right)).collect()
    got = {(m.run_id, int(m.native_id[1:]) if m.native_id else None, m.cpus_units - 1 if m.cpus_units else None) for m in merged}
    assert got == want and all(m.tag is None for m in merged if m.source == "both")


def merge_in_turn(trace, report):
    """(last trace row of the task, report record) by the rule for traces with hashes in part, row by row."""
    last = {}
    for i, t in enumerate(trace):
        last[t["hash"] or i] = i
    used, out, seen = set(), set(), set()
    for i, t in enumerate(trace):
        if (t["hash"] or i) in seen:
            continue
        seen.add(t["hash"] or i)
        own = [j for j, r in enumerate(report) if t["hash"] and r["hash"] == t["hash"]][-1:]
        free = own if own and own[0] not in used else [j for j, r in enumerate(report) if j not in used and r["name"] == t["name"] and not (t["hash"] and r["hash"])][:1]
        used.update(free)
        out.add((last[t["hash"] or i], free[0] if free else None))
    return out | {(None, j) for j in range(len(report)) if j not in used}


def test_merge_of_traces_with_hashes_in_part(spark):
    rng = random.Random(7)
    left, right, want = [], [], set()
    for case in range(120):
        t = [dict(hash=rng.choice(["", f"h{rng.randint(0, 5)}"]), name=f"n{rng.randint(0, 1)}") for i in range(rng.randint(1, 8))]
        name = {x["hash"]: x["name"] for x in t}
        t = [x | {"name": name[x["hash"]] if x["hash"] else x["name"]} for x in t]
        r = [dict(hash=h, name=name[h] if h in name and h else f"n{rng.randint(0, 1)}") for h in (rng.choice(["", f"h{rng.randint(0, 7)}"]) for i in range(rng.randint(0, 9)))]
        left += [dict(x, run_id=f"r{case}", pos=i, cpus_units=None, native_id=f"t{i}") for i, x in enumerate(t)]
        right += [dict(x, run_id=f"r{case}", pos=i, cpus_units=i + 1, tag=None) for i, x in enumerate(r)]
        want |= {(f"r{case}", *p) for p in merge_in_turn(t, r)}
    merged = tasks.merge_tasks(make(spark, *left), make(spark, *right)).collect()
    got = {(m.run_id, int(m.native_id[1:]) if m.native_id else None, m.cpus_units - 1 if m.cpus_units else None) for m in merged}
    assert got == want and len(merged) == len(got) and all(m.tag is None for m in merged if m.source == "both")


def test_merge_by_hash_across_names_comes_first(spark):
    left = [dict(hash="", name="a", pos=0, native_id="t0"), dict(hash="h1", name="a", pos=1, native_id="t1"), dict(hash="h2", name="b", pos=2, native_id="t2")]
    right = [dict(hash="h2", name="a", pos=0, cpus_units=1), dict(hash="h1", name="a", pos=1, cpus_units=2)]
    merged = tasks.merge_tasks(make(spark, *[dict(x, cpus_units=None) for x in left]), make(spark, *right)).collect()
    assert {(m.native_id, m.cpus_units) for m in merged} == {("t0", 2), ("t1", None), ("t2", 1)}


def test_merge_with_one_side_only(spark):
    both = [dict(hash="a"), dict(hash="a", status="FAILED")]
    assert tasks.merge_tasks(make(spark, *both), make(spark)).count() == 1
    assert tasks.merge_tasks(make(spark), make(spark, *both)).count() == 2


def test_unknown_is_not_zero(spark):
    row = stats(spark, dict(cpus_units=2 * CORE), dict(pct_cpu_units=CORE), FULL).first()
    assert (row.cpu_h_requested, row.cpu_h_used, row.cpu_h_req_metered, row.priced_cpu_h) == (10.0, 2.0, 8.0, 11.0)
    bare = stats(spark, dict(cpus_units=2 * CORE, realtime_ms=None)).first()
    assert bare.waste is None and bare.cpu_efficiency is None and bare.cost == 0 and not bare.has_requests


def test_rates():
    assert pricing.rates("aws-m5-spot", gib_hour=1.0) == pricing.Rates("custom", 0.0112, 1.0)
    for bad in (dict(preset="x"), dict(cpu_hour=-1.0), dict(gib_hour=float("nan"))):
        with pytest.raises(ValueError):
            pricing.rates(**bad)


def test_kills(spark):
    rows = [dict(status="FAILED", exit=137), dict(status="FAILED", exit=104), dict(status="FAILED", exit=1), dict(status="ABORTED", exit=137), dict(status="FAILED", exit=None, time_ms=HOUR), dict(status="FAILED", exit=None, time_ms=2 * HOUR), dict(status="FAILED", exit=None)]
    assert [r.killed for r in pricing.price_tasks(make(spark, *rows)).orderBy("pos").collect()] == [True, True, False, False, True, False, False]


@pytest.mark.parametrize(
    "extra,reason",
    [(dict(peak_rss_kib=40 * GIB), "over_memory"), (dict(realtime_ms=9 * HOUR), "over_time"), (dict(attempt=2, memory_kib=64 * GIB), "retried_memory"), (dict(attempt=2, cpus_units=16 * CORE), "retried_cpus"), (dict(attempt=2, time_ms=16 * HOUR), "retried_time"), (dict(status="FAILED", exit=137), "was_killed")],
)
def test_guarded_processes_keep_everything(spark, extra, reason):
    row = rightsize.recommend(stats(spark, FULL, FULL, {**FULL, **extra}), R).first()
    assert row[reason] and row.needs_escalation and (row.cpus_new, row.mem_new_gib, row.time_new_h, row.saving) == (8, 32.0, 8.0, 0.0)


def test_recommendation_and_fragment(spark):
    s = stats(spark, FULL, FULL)
    row = rightsize.recommend(s, R).first()
    assert (row.cpus_new, row.mem_new_gib, row.time_new_h, row.time_tight) == (3, 5.0, 2.0, False)
    assert row.saving == pytest.approx(2 * (8 * 0.1 + 32 * 0.025) - 2 * (3 * 0.1 + 5 * 0.025))
    text = rightsize.config_fragments(rightsize.recommend(s, R)).first().fragment
    assert "withName: 'P' {\n        cpus   = 3\n        memory = '5.GB'\n        time   = '2.h'\n    }" in text
    tight = rightsize.recommend(stats(spark, {**FULL, "realtime_ms": 6 * HOUR}), R)
    assert tight.first().time_tight and "near its limit: 6.0 h used of 8h" in rightsize.config_fragments(tight).first().fragment
    assert rightsize.recommend(stats(spark, FULL, dict(cpus_units=CORE, memory_kib=GIB), dict(cpus_units=CORE, memory_kib=GIB)), R).count() == 0
    for margin in (0.9, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            rightsize.recommend(s, R, margin)


def plain_names(names):
    out = {}
    for n in names:
        parts = n.split(":")
        out[n] = next((":".join(parts[-k:]) for k in range(1, len(parts) + 1) if sum(":".join(m.split(":")[-k:]) == ":".join(parts[-k:]) for m in names if len(m.split(":")) >= k) == 1), n)
    return out


def test_display_names_are_shortest_unique(spark):
    rng = random.Random(2)
    runs = {f"r{i}": {":".join(rng.choice("ABC") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 7))} for i in range(40)}
    df = spark.createDataFrame([(r, n) for r, names in runs.items() for n in names], "run_id string, process string")
    assert {(x.run_id, x.process): x["name"] for x in compare.display_names(df).collect()} == {(r, n): s for r, names in runs.items() for n, s in plain_names(names).items()}


def plain_order(runs):
    """Releases by number, date and id; a branch stands behind the longest row of leading releases that all started by its own date."""
    key = lambda r: ([int(x) for x in r[1].split(".")], r[2], r[0])
    releases = sorted((r for r in runs if r[1] != "dev"), key=key)
    place = {r[0]: (i, 1, "", "") for i, r in enumerate(releases)}
    for r in runs:
        if r[1] == "dev":
            leading = max(n for n in range(len(releases) + 1) if all(x[2] <= r[2] for x in releases[:n]))
            place[r[0]] = (leading, 0, r[2], r[0])
    return sorted(place, key=place.get)


def test_run_order_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(40):
        runs = [(f"r{i}", rng.choice(["dev", "1.0", "1.2", "1.10", "2"]), f"2024-0{rng.randint(1, 5)}-01", f"g{g}") for i in range(rng.randint(1, 7))]
        rows += runs
        want[f"g{g}"] = plain_order(runs)
    got = {}
    for r in compare.order_runs(spark.createDataFrame(rows, "run_id string, revision string, start_date string, repo string"), "repo").orderBy("position").collect():
        got.setdefault(r.repo, []).append(r.run_id)
    assert got == want


def test_redaction(spark):
    name = lambda n, p: spark.createDataFrame([(n, p)], "n string, p string").select(redact.redact_name(F.col("n"), F.col("p"), "s").alias("x")).first().x
    assert name("A (b) (c)", "A (b)").startswith("A (b) (tag-") and name("A (b (c))", None).startswith("A (tag-") and name("A ()", "A") == "A ()" and name("A (b", "A") == "A (b"
    raw = spark.createDataFrame([("r", "p", 0, {"name": "A (sample1)", "process": "A", "tag": "sample1", "cpus": "2", "odd": "secret value", "queue": "-"}, None)], "run_id string, path string, pos long, f map<string,string>, error string")
    f = redact.redact_records(raw, "s").first().f
    assert f["cpus"] == "2" and f["queue"] == "-" and f["odd"].startswith("redacted-") and f["name"] == f"A ({f['tag']})"
    mapping = redact.redaction_map(raw, "s")
    assert {(r.kind, r.original) for r in mapping.collect()} == {("tag", "sample1"), ("value", "secret value")}
    redact.assert_no_collisions(mapping)
    with pytest.raises(ValueError):
        redact.assert_no_collisions(spark.createDataFrame([("tag-1", "a"), ("tag-1", "b")], "pseudonym string, original string"))


@pytest.mark.parametrize("most", [4_000_000, 10])
def test_leak_scan(spark, monkeypatch, most):
    monkeypatch.setattr(leaks, "MATCHER_CHARS", most)
    mapping = spark.createDataFrame([("secret value here",), ('quo"te',), ("a<b>c",), ("tiny",), ("plain",)], "original string")
    texts = spark.createDataFrame([(1, "x secret value here y"), (2, 'quo\\"te'), (3, "a&lt;b&gt;c"), (4, "tiny"), (5, "nothing secret"), (6, "complainer")], "id long, text string")
    assert {(r.id, r.value) for r in leaks.leak_scan(texts, leaks.needles(mapping)).collect()} == {(1, "secret value here"), (2, 'quo"te'), (3, "a<b>c"), (6, "plain")}


def test_leak_scan_finds_a_script_inside_json(spark):
    mapping = spark.createDataFrame([("line one\n\tline two/x",)], "original string")
    texts = spark.createDataFrame([(1, '{"s":"line one\\n\\tline two/x"}'), (2, '{"s":"line one\\n\\tline two\\/x"}'), (3, "line one line two")], "id long, text string")
    for most in (None, 0):
        assert {r.id for r in leaks.leak_scan(texts, leaks.needles(mapping), most).collect()} == {1, 2}


def test_leak_scan_ways_agree(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abc-_ .") for _ in range(n))
    texts = spark.createDataFrame([(i, text(300)) for i in range(40)], "id long, text string")
    wanted = spark.createDataFrame([(f"v{i}", text(rng.randint(5, 7))) for i in range(150)], "value string, needle string")
    few, many = ({tuple(r) for r in leaks.leak_scan(texts, wanted, most).collect()} for most in (None, 0))
    assert few == many and few


def test_trace_files_redacted_as_text(spark):
    text = "name\tprocess\tx\tstatus\r\nA (s1)\tA\tsecret\tFAILED\textra\r\n\nA (s2)\tA\nlast (s3)\tlast\t-\tOK"
    out = {r.path: r for r in redact.redact_trace_files(text_files(spark, a=text, b="task_id\n1\n"), "s").collect()}
    lines = out["a"].content.split("\n")
    cells = [x.split("\t") for x in lines]
    assert lines[0] == text.split("\n")[0] and lines[2] == "" and lines[1].endswith("\r") and len(lines) == 5
    assert cells[1][0].startswith("A (tag-") and cells[1][2].startswith("redacted-") and cells[1][3] == "FAILED" and cells[1][4].startswith("redacted-") and len(cells[1]) == 5
    assert len(cells[3]) == 2 and cells[3][0].startswith("A (tag-") and cells[4][2:] == ["-", "OK"]
    assert (out["b"].content, out["b"].error) == (None, "no_name_column")


def test_report_objects_redacted(spark):
    import json

    data = {"trace": [{"name": "A (s1)", "process": "A", "tag": "s1", "exit": 0, "odd": 7, "flag": True, "none": None, "script": 'a "b"\n</x>', "nested": {"k": "v"}}, 5], "summary": [{"process": "A", "cpu": {"minLabel": "A (s1)", "min": 1.5, "text": "kept"}}], "title": "secret: one", "deep": {"a": ["x, y", 3, None], "b:": True}}
    text = json.dumps(data).replace("</", "<\\/")
    got = redact.redact_reports(text_files(spark, a=f"<script>window.data = {text};</script>", b="no data", c="window.data = {broken"), "s")
    rows = {r.path: (r.json, r.error) for r in got.collect()}
    assert rows["b"] == (None, "no_window_data") and rows["c"] == (None, "bad_json") and "</" not in rows["a"][0]
    new = json.loads(rows["a"][0])
    first, label = new["trace"][0], new["summary"][0]["cpu"]
    tag = units_pseudonym(spark, "s1")
    assert (first["name"], first["process"], first["tag"], first["exit"], first["flag"], first["none"]) == (f"A ({tag})", "A", tag, 0, True, None)
    assert all(first[k].startswith("redacted-") for k in ("odd", "script", "nested")) and new["trace"][1] == 5
    assert label == {"minLabel": f"A ({tag})", "min": 1.5, "text": "kept"} and new["summary"][0]["process"] == "A"
    assert new["title"].startswith("redacted-") and new["deep"]["a"][0].startswith("redacted-") and new["deep"]["a"][1:] == [3, None] and new["deep"]["b:"] is True


def units_pseudonym(spark, value):
    return one(spark, lambda c: units.pseudonym(c, "tag", "s"), value)


def test_header_fields_kept_on_purpose_are_not_scanned(spark):
    head = "<title>[happy_name] r</title><dt>Workflow profile</dt><dd>test_secret</dd><dt>Own label</dt><dd>s3://bucket</dd><dt>Container engine</dt><dd>/home/x</dd><dt>Work directory</dt><dd>/home/me</dd><script>window.data = {};</script>"
    facts = redact.redact_headers(files.parse_headers(text_files(spark, a=head)), "s")
    scanned = {r.text for r in redact.header_texts(facts).collect()}
    assert "s3://bucket" in scanned and "test_secret" not in scanned and "/home/x" not in scanned and "/home/me" not in scanned
    assert {r.original for r in redact.header_map(files.parse_headers(text_files(spark, a=head)), "s").collect()} == {"/home/me", "happy_name"}


def test_writing_is_gated(spark, tmp_path):
    mapping = spark.createDataFrame([("value", "redacted-1", "secret1"), ("value", "redacted-2", "two\nlines")], "kind string, pseudonym string, original string")
    good = spark.createDataFrame([(1, "fine", {"a": "b"})], "id long, text string, f map<string,string>")
    bad = [[(1, "has secret1", {})], [(2, "/home/me", {})], [(3, "x", {"k": "a two\nlines b"})]]
    for rows in bad:
        with pytest.raises(ValueError):
            redact.write_redacted({"t": spark.createDataFrame(rows, good.schema)}, f"{tmp_path}/out", mapping)
    with pytest.raises(ValueError, match="outside"):
        redact.write_redacted({"t": good}, f"{tmp_path}/out", mapping, f"{tmp_path}/out/map")
    assert not (tmp_path / "out").exists()
    redact.write_redacted({"t": good}, f"{tmp_path}/out", mapping, f"{tmp_path}/map")
    assert redact.read_redacted(spark, f"{tmp_path}/out", "t").collect() == good.collect() and spark.read.json(f"{tmp_path}/map").count() == 2
    with pytest.raises(ValueError, match="already exists"):
        redact.write_redacted({"t": good}, f"{tmp_path}/out", mapping)


def test_figures_must_agree(spark):
    a = spark.createDataFrame([(1,), (1,)], "x long")
    redact.assert_same_figures(a, a)
    with pytest.raises(ValueError):
        redact.assert_same_figures(a, a.distinct())


def test_sinks(spark, tmp_path):
    priced = pricing.price_tasks(make(spark, FULL, FULL))
    s = pricing.process_stats(priced, R)
    totals, recs = pricing.run_totals(s, R), rightsize.recommend(s, R)
    doc = sinks.analysis_json(totals, s.select("run_id", "process", "cost"), recs.select("run_id", "process", "saving"), rightsize.not_sized(s)).first().json
    assert '"processes":[{"process":"P"' in doc and '"tasks":2' in doc
    sinks.write_fragments(rightsize.config_fragments(recs), f"{tmp_path}/f")
    tables = compare.report_tables(s, pricing.tag_stats(priced, R), totals, recs, R)
    sinks.write_tables({k: v for k, v in tables.items() if k in ("totals", "tags")}, f"{tmp_path}/t")
    assert (tmp_path / "f" / "run_id=r").exists() and {k: v.count() for k, v in tables.items()} == {"totals": 10, "processes": 1, "tags": 1, "right_sizing": 1, "tight": 0, "kept": 0, "not_sized": 0}


def test_fleet_corner_cases(spark):
    tail = fleet.failure_tail(spark.createDataFrame([("a", "no output at all"), ("b", "Command output:\n\n")], "run_id string, text string")).orderBy("run_id").collect()
    assert [r.last_line for r in tail] == [None, None]
    scaling = fleet.scaling_table(spark.createDataFrame([("x", 1, 100.0, 90.0), ("x", 4, 50.0, 108.0)], "benchmark string, variant long, wall_s double, cpu_s double")).orderBy("variant").collect()
    assert [(r.speed_up, r.cpus_x_wall, r.relative_cpu) for r in scaling] == [(1.0, 100.0, 1.0), (2.0, 200.0, 1.2)]


@pytest.mark.parametrize("ranges", [fleet.RANGES, 1, 3, 50])
def test_quantiles_by_ranges_equal_sorted_values(spark, ranges):
    rng = random.Random(ranges)
    rows = [("big", rng.choice([rng.randint(-5, 5), rng.randint(0, 10**12), 7])) for _ in range(700)] + [("one", 4)] + [("same", -3)] * 9 + [(None, 1), (None, 2), ("none", None)]
    got = {r.g: r for r in fleet.usage_quantiles(spark.createDataFrame(rows, "g string, v long"), "v", (0.0, 0.1, 0.25, 0.5, 0.99, 1.0), ("g",), ranges).collect()}
    assert set(got) == {"big", "one", "same", None}
    for g, r in got.items():
        x = sorted(v for k, v in rows if k == g)
        for q in (0.0, 0.1, 0.25, 0.5, 0.99, 1.0):
            place = q * (len(x) - 1)
            low, high = x[math.floor(place)], x[math.ceil(place)]
            want = low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high
            assert math.isclose(r[f"q{round(q * 100):02d}"], want, rel_tol=1e-12)
        assert (r.tasks, r.least, r.most) == (len(x), x[0], x[-1]) and math.isclose(r.mean, sum(x) / len(x))


def test_one_pass_over_the_tasks(spark, capsys):
    priced = pricing.price_tasks(make(spark, FULL, FULL))
    parts = pricing.usage(priced)
    assert pricing.process_stats(priced, R).collect() == pricing.process_stats_of(parts, R).collect() and pricing.tag_stats_of(parts, R).collect() == pricing.tag_stats(priced, R).collect()
    kept = parts.persist()
    kept.count()
    s = pricing.process_stats_of(kept, R)
    s.join(pricing.tag_stats_of(kept, R), "run_id").explain()
    plan = capsys.readouterr().out
    assert plan.count("InMemoryTableScan") == 2 and plan.split("InMemoryTableScan")[0].count("LocalTableScan") + plan.split("InMemoryTableScan")[0].count("Scan ExistingRDD") == 0
    kept.unpersist()


def test_stated_cpu_hours(spark):
    totals = spark.createDataFrame([("a", 338.42), ("b", 1177.0), ("c", 5.0)], "run_id string, cpu_h_requested double")
    headers = spark.createDataFrame([("a", "338.4 (4.2% failed)"), ("b", "1'177.2"), ("c", None)], "run_id string, cpu_hours string")
    got = {r.run_id: (r.stated, r.agrees) for r in fleet.reconcile_cpu_hours(totals, headers).collect()}
    assert got == {"a": (338.4, True), "b": (1177.2, False), "c": (None, None)}


def test_launched_tasks_mask_the_tag(spark):
    rows = [("r1", "P", 0, "run s1 --o s1", "quay.example/bio/x:1", "s1"), ("r1", "P", 1, "other", "y", "s2"), ("r2", "P", 0, "run s9 --o s9", "wave.example/q/bio/x:1", "s9")]
    t = fleet.launched_tasks(spark.createDataFrame(rows, "run_id string, process string, pos long, script string, container string, tag string")).orderBy("run_id").collect()
    assert [(r.script, r.image, r.registry) for r in t] == [("run <S> --o <S>", "bio/x:1", "quay.example/"), ("run <S> --o <S>", "bio/x:1", "wave.example/q/")]


@pytest.mark.parametrize("parts", [None, 3])
def test_lens_places_number_each_run_in_the_order_of_its_sql(spark, monkeypatch, parts):
    """A run's places are 1 to its number of rows, by ship date, part and so on, however the rows are dealt."""
    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(lens, "tasks_for", lambda *_: parts)
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(f"SELECT 'run' || (year(o_orderdate) - 1995), l_orderkey || '/' || l_linenumber, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_orderkey, l_linenumber, l_quantity) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey").fetchall()
    assert sorted(tuple(r) for r in lens.attempts(spark, data).select("run_id", "hash", "pos").collect()) == sorted(want)


@pytest.mark.parametrize("sent", [0, 100_000])
@pytest.mark.parametrize("name", ["request_history", "display_names", "matrix_names", "cpu_hours_reconcile"])
def test_joins_of_large_tables_are_dealt_or_sent(spark, monkeypatch, name, sent):
    """Where tables are dealt, no join of task rows is left to Spark's own number of parts, whatever the size of ``part``; the rows stay the same."""
    data = "/root/testdata/sf0.001"
    want = sorted(map(repr, queries.queries()[name](spark, data).collect()))
    monkeypatch.setattr(lens, "tasks_for", lambda *_: 7)
    monkeypatch.setattr(lens, "SENT_ROWS", sent, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = queries.queries()[name](spark, data)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(repr, found.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"hashpartitioning\(([lo]_orderkey|[lp]_partkey)#\d+L?, (\d+)\), (\w+)", plan)
    assert {c for c, *_ in dealt} == ({"l_orderkey", "o_orderkey"} if sent else {"l_orderkey", "o_orderkey", "l_partkey", "p_partkey"})
    assert {(n, why) for _, n, why in dealt} == {("7", "REPARTITION_BY_NUM")}
    assert ("BroadcastHashJoin [l_partkey" in plan) == bool(sent) and rows == want


@pytest.mark.parametrize("rows_a_task,want", [(500, None), (100, 60), (10, 200), (5, 300)])
def test_number_of_parts_grows_with_the_rows(spark, monkeypatch, rows_a_task, want):
    """More than 200 parts, for which Spark sorts a task's share of a file in memory, only where a part would hold over four times its rows (of 6,000 here)."""
    monkeypatch.setattr(lens, "ROWS_A_TASK", rows_a_task)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert lens.tasks_for(spark, "/root/testdata/sf0.001") == want and rows == 6_000


@pytest.mark.parametrize("name", ["display_names", "matrix_names"])
def test_names_read_the_tasks_once(spark, name):
    """Names are compared several times, but tasks are joined and deduplicated once."""
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation [" in plan and not re.search(r"(?<!InMemory)Relation \[", plan)


def test_merge_carries_only_what_is_asked_for(spark):
    """Values that nobody asks for don't travel with the rows."""
    trace, report = (make(spark, dict(hash="a/1", pos=1), dict(hash="a/2", pos=2)) for _ in range(2))
    trace, report = (df.where(F.rand(1) >= 0) for df in (trace, report))
    merged = tasks.merge_tasks(trace, report).select("run_id", "pos", "cpus_units")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")  # plans shown whole
    lines = merged._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    carried = [line for line in lines if "Window" in line or "Project" in line]
    assert carried and not any("container" in line for line in carried)


def test_merge_shuffles_once_by_hash_and_once_by_name(spark):
    trace, report = (make(spark, dict(hash="a/1", pos=1), dict(hash="a/2", pos=2)).where(F.rand(1) >= 0) for _ in range(2))
    shuffles = lambda *a, **k: tasks.merge_tasks(*a, **k)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")
    assert shuffles(trace, report) == 2 and shuffles(trace, report, hashes="all") == 2
    assert shuffles(*[df.withColumns({"hash": F.lit(""), "task_id": F.lit("")}) for df in (trace, report)], hashes="none") == 1


@pytest.mark.parametrize("name", ["merge_by_hash", "merge_by_name", "merge_leftovers"])
def test_merges_of_made_traces_read_nothing_ahead(spark, name):
    """What the queries know of their traces' hashes isn't looked up, which would make all tasks a second time."""
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("merge ahead"))
    spark.sparkContext.setJobGroup("merge ahead", name)
    before = jobs()
    queries.queries()[name](spark, "/root/testdata/sf0.001")
    made = jobs() - before
    queries._halves(spark, "/root/testdata/sf0.001")
    assert made <= jobs() - before - made
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_merge_with_known_hashes_equals_the_one_that_looks(spark):
    rng = random.Random(3)
    for hashes in ("all", "none"):
        left = [dict(run_id=f"r{rng.randint(0, 2)}", hash=f"h{rng.randint(0, 60)}" if hashes == "all" else "", task_id=rng.choice(["", f"i{rng.randint(0, 9)}"]), name=f"n{rng.randint(0, 5)}", pos=i, cpus_units=None) for i in range(90)]
        right = [dict(run_id=f"r{rng.randint(0, 2)}", hash=rng.choice(["", f"h{rng.randint(0, 60)}"]), name=f"n{rng.randint(0, 5)}", pos=i, cpus_units=i + 1) for i in range(90)]
        trace, report = make(spark, *left), make(spark, *right)
        columns = ["run_id", "source", "side", "pos", "hash", "task_id", "name", "cpus_units", "tag"]
        known, found = (sorted(map(repr, tasks.merge_tasks(trace, report, hashes=h).select(*columns).collect())) for h in (hashes, "any"))
        assert known == found and any("both" in r for r in known)
    with pytest.raises(ValueError):
        tasks.merge_tasks(trace, report, hashes="some")


def test_merge_mixed_keeps_one_table_of_what_it_shows(spark):
    """Both halves were kept, with all columns, and the tasks were made for each of them."""
    queries.queries()["merge_mixed"](spark, "/root/testdata/sf0.001")
    assert [sorted(df.columns) for df in queries.KEPT] == [["cpus_units", "hash", "name", "pos", "realtime_ms", "run_id", "tag", "task_id"]]


def test_long_lists_of_names_give_the_same_merge(spark, monkeypatch):
    rng = random.Random(8)
    rows = lambda n: make(spark, *[dict(run_id=f"r{rng.randint(0, 2)}", hash=rng.choice(["", f"h{rng.randint(0, 40)}"]), name=rng.choice([None, "", "a", "b", "c", "d"]), pos=i, cpus_units=i) for i in range(n)])
    trace, report = rows(80), rows(70)
    merge = lambda: sorted(map(repr, tasks.merge_tasks(trace, report).select("run_id", "source", "side", "pos", "hash", "name", "cpus_units").collect()))
    sent = merge()
    monkeypatch.setattr(tasks, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tasks, "BROADCAST_HASHES", 0, raising=False)
    assert merge() == sent and any("both" in r for r in sent)


def test_records_of_a_report_are_parsed_once(spark):
    records = '[null,3,"x",[1,{"b":"c"}],{},{"process":"P","name":"P (t)","odd":{"b":1,"a":null},"n":1.50,"hash":"a/1","cpus":2}]'
    files_ = text_files(spark, a=f'<script>window.data = {{"trace":{records},"cmd":"/x"}};</script>', b="none").where(F.rand(1) >= 0)
    parts = redact.report_parts(files_, "s")
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(MapType(StringType,VariantType") == 1
    found = {r.path: r for r in redact.join_report_parts(parts).collect()}
    trace = json.loads(found["a"].json)["trace"]
    assert trace[:5] == [None, 3, "x", [1, {"b": "c"}], {}] and found["b"].error == "no_window_data" and found["b"].json is None
    assert set(trace[5]) == {"process", "name", "odd", "n", "hash", "cpus"} and (trace[5]["hash"], trace[5]["cpus"], trace[5]["process"]) == ("a/1", 2, "P")
    assert trace[5]["odd"].startswith("redacted-") and trace[5]["n"].startswith("redacted-") and trace[5]["name"].startswith("P (tag-")


def test_redacted_trace_lines_stay_with_their_file(spark):
    """Files are put together by (run, path); by path alone their lines would be shuffled once more."""
    plan = queries.queries()["redacted_traces"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "path" in line]
    assert len(grouped) == 1, grouped


def test_statistics_number_no_places(spark):
    """Only queries of places pay for numbering a run's rows: the others read each table once, and keep the same rows."""
    data = "/root/testdata/sf0.001"
    plan = queries.queries()["process_statistics"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and "l_year" not in plan
    columns = ["run_id", "hash", "process", "status", "realtime_ms", "cpus_units", "pct_cpu_units", "tag"]
    placed, plain = (sorted(map(repr, queries._tasks(spark, data, places).select(*columns).collect())) for places in (True, False))
    assert placed == plain


def test_dedup_by_order_keeps_the_last_row_and_all_rows_without_hash_and_id(spark):
    rows = [("r1", "a", "", 1, "old"), ("r1", "a", "", None, "nulls last"), ("r1", "b", "", 2, "late"), ("r1", "b", "", 1, "early"), ("r1", "", "", 1, "x"), ("r1", None, "", 1, "y"), ("r1", "", "7", 1, "i"), ("r1", "", "7", 2, "j")]
    df = spark.createDataFrame(rows, "run_id string, hash string, task_id string, line int, status string").withColumn("pos", F.lit(None).cast("long"))
    got = tasks.dedup_tasks(df, order=("line",))
    assert "line" not in got.columns
    assert sorted(r.status for r in got.collect()) == ["j", "late", "nulls last", "x", "y"]


def test_redacted_records_hold_each_redaction_once(spark):
    """What a name's tag is cut by is computed once for a record, not for each use: the plan grows with the rules, not with their nesting."""
    raw = spark.createDataFrame([("r1", {"process": "P (x)", "name": "P (x) (s1)", "tag": "s1", "odd": "o", "status": "OK"}), ("r1", {"name": "Q (s2)"}), ("r1", {"name": None, "process": "-"}), ("r1", None)], "run_id string, f map<string,string>")
    done = redact.redact_records(raw, "s")
    assert done._jdf.queryExecution().optimizedPlan().toString().count("locate(") <= 2
    hidden = lambda v, kind: spark.range(1).select(units.pseudonym(F.lit(v), kind, "s")).first()[0]
    s1, s2 = hidden("s1", "tag"), hidden("s2", "tag")
    assert [r.f for r in done.collect()] == [{"process": "P (x)", "name": f"P (x) ({s1})", "tag": s1, "odd": hidden("o", "value"), "status": "OK"}, {"name": f"Q ({s2})"}, {"name": None, "process": "-"}, None]
