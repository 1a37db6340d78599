"""DuckDB counterparts of the registered queries, written from the definitions, not from the Spark plans."""

from __future__ import annotations

from ..operators.pricing import PRESETS
from . import lens

_H = "CAST(coalesce(sum({}), 0) AS DOUBLE) / {}"
_CPU, _GIB, _HOUR = "360000000000.0", "3774873600000.0", "3600000.0"
_RC, _RM = PRESETS["seqera-compute"].cpu_hour, PRESETS["seqera-compute"].gib_hour


def _h(x: str, per: str) -> str:
    return _H.format(x, per)


_PAIR_C, _PAIR_M = "cpus_units IS NOT NULL AND pct_cpu_units IS NOT NULL", "memory_kib IS NOT NULL AND peak_rss_kib IS NOT NULL"
_WASTE = f"CASE WHEN cpu_h_req_metered > 0 OR gib_h_req_metered > 0 THEN greatest(cpu_h_req_metered - cpu_h_used, 0.0) * {_RC} + greatest(gib_h_req_metered - gib_h_used, 0.0) * {_RM} END"
_USAGE = f"""
  {_h("ms", _HOUR)} AS realtime_h, {_h(f"CASE WHEN {_PAIR_C} THEN use_c END", _CPU)} AS cpu_h_used, {_h(f"CASE WHEN {_PAIR_M} THEN use_m END", _GIB)} AS gib_h_used,
  {_h(f"CASE WHEN {_PAIR_C} THEN req_c END", _CPU)} AS cpu_h_req_metered, {_h(f"CASE WHEN {_PAIR_M} THEN req_m END", _GIB)} AS gib_h_req_metered,
  {_h("coalesce(req_c, use_c)", _CPU)} AS priced_cpu_h, {_h("coalesce(req_m, use_m)", _GIB)} AS priced_gib_h,
  {_h("CASE WHEN NOT ok THEN coalesce(req_c, use_c) END", _CPU)} AS failed_cpu_h, {_h("CASE WHEN NOT ok THEN coalesce(req_m, use_m) END", _GIB)} AS failed_gib_h,
  count(*) FILTER (pct_cpu_units IS NOT NULL OR peak_rss_kib IS NOT NULL) AS tasks_with_metrics"""
_BOTH = "cpus_units IS NOT NULL AND memory_kib IS NOT NULL"


def _max(x: str, where: str, per: str) -> str:
    return f"coalesce(max({x}) FILTER ({where}), 0) / {per}"


def _dec(x: str) -> str:
    """A sum of doubles rounded to millionths first."""
    return f"(CAST(sum(CAST(floor({x} * 1000000.0 + 0.5) AS BIGINT)) AS DOUBLE) / 1000000.0)"


_BASE = f"""
lens AS MATERIALIZED ({lens.sql()}),
t AS MATERIALIZED (SELECT * EXCLUDE (pos, rk, fp), fp AS pos FROM (SELECT *, row_number() OVER (PARTITION BY run_id, hash ORDER BY pos DESC) AS rk, min(pos) OVER (PARTITION BY run_id, hash) AS fp FROM lens) WHERE rk = 1),
p AS MATERIALIZED (SELECT *, coalesce(realtime_ms, 0) AS ms, status IN ('COMPLETED', 'CACHED') AS ok,
  status = 'FAILED' AND (coalesce(exit BETWEEN 130 AND 145 OR exit = 104, FALSE) OR (exit IS NULL AND time_ms > 0 AND realtime_ms * 10 >= time_ms * 9)) AS killed,
  CAST(cpus_units AS HUGEINT) * coalesce(realtime_ms, 0) AS req_c, CAST(memory_kib AS HUGEINT) * coalesce(realtime_ms, 0) AS req_m,
  CAST(pct_cpu_units AS HUGEINT) * coalesce(realtime_ms, 0) AS use_c, CAST(peak_rss_kib AS HUGEINT) * coalesce(realtime_ms, 0) AS use_m FROM t),
ps0 AS (SELECT run_id, process, count(*) AS tasks, count(*) FILTER (NOT ok) AS failed_tasks, count(*) FILTER (coalesce(attempt, 1) > 1) AS retried_tasks, count(*) FILTER (killed) AS killed_tasks,
  count(attempt) > 0 AS attempts_known, count(pct_cpu_units) AS tasks_with_cpu, count(peak_rss_kib) AS tasks_with_rss, count(*) FILTER (ok AND pct_cpu_units IS NOT NULL AND peak_rss_kib IS NOT NULL) AS completed_with_metrics,
  count(*) FILTER ({_BOTH}) > 0 AS has_requests, {_USAGE}, {_h("req_c", _CPU)} AS cpu_h_requested, {_h("req_m", _GIB)} AS gib_h_requested,
  {_max("cpus_units", _BOTH, "100000.0")} AS max_cpus, {_max("cpus_units", f"{_BOTH} AND attempt = 1", "100000.0")} AS base_cpus, {_max("cpus_units", f"{_BOTH} AND attempt > 1", "100000.0")} AS retry_cpus,
  {_max("memory_kib", _BOTH, "1048576.0")} AS max_mem_gib, {_max("memory_kib", f"{_BOTH} AND attempt = 1", "1048576.0")} AS base_mem_gib, {_max("memory_kib", f"{_BOTH} AND attempt > 1", "1048576.0")} AS retry_mem_gib,
  {_max("time_ms", "TRUE", _HOUR)} AS max_limit_h, {_max("time_ms", "attempt = 1", _HOUR)} AS base_limit_h, {_max("time_ms", "attempt > 1", _HOUR)} AS retry_limit_h,
  {_max("pct_cpu_units", "TRUE", "100000.0")} AS max_cores_used, {_max("peak_rss_kib", "TRUE", "1048576.0")} AS max_rss_gib, {_max("ms", "TRUE", _HOUR)} AS max_realtime_h
  FROM p GROUP BY run_id, process),
ps AS MATERIALIZED (SELECT *, priced_cpu_h * {_RC} + priced_gib_h * {_RM} AS cost, failed_cpu_h * {_RC} + failed_gib_h * {_RM} AS failed_cost,
  CASE WHEN cpu_h_req_metered > 0 THEN cpu_h_used / cpu_h_req_metered END AS cpu_efficiency, CASE WHEN gib_h_req_metered > 0 THEN gib_h_used / gib_h_req_metered END AS mem_efficiency, {_WASTE} AS waste FROM ps0),
sh AS MATERIALIZED (SELECT *, CASE WHEN tot > 0 THEN cost / tot ELSE 0.0 END AS share, row_number() OVER (PARTITION BY run_id ORDER BY cost DESC, process) AS rank
  FROM (SELECT *, CAST(sum(CAST(floor(cost * 1000000.0 + 0.5) AS BIGINT)) OVER (PARTITION BY run_id) AS DOUBLE) / 1000000.0 AS tot FROM ps)),
ts AS MATERIALIZED (SELECT *, priced_cpu_h * {_RC} + priced_gib_h * {_RM} AS cost, failed_cpu_h * {_RC} + failed_gib_h * {_RM} AS failed_cost, {_WASTE} AS waste
  FROM (SELECT run_id, tag, count(*) AS tasks, count(DISTINCT process) AS processes, {_USAGE} FROM p GROUP BY run_id, tag)),
rt0 AS (SELECT run_id, count(*) AS tasks, count(*) FILTER (NOT ok) AS failed_tasks, count(*) FILTER (status = 'CACHED') AS cached_tasks, count(*) FILTER (NOT ({_BOTH})) AS tasks_without_requests,
  count(*) FILTER (pct_cpu_units IS NULL AND peak_rss_kib IS NULL) AS tasks_without_metrics, {_USAGE}, {_h("req_c", _CPU)} AS cpu_h_requested, {_h("req_m", _GIB)} AS gib_h_requested,
  {_h("CASE WHEN status = 'CACHED' THEN coalesce(req_c, use_c) END", _CPU)} AS cached_cpu_h, {_h("CASE WHEN status = 'CACHED' THEN coalesce(req_m, use_m) END", _GIB)} AS cached_gib_h FROM p GROUP BY run_id),
rt AS MATERIALIZED (SELECT *, CASE WHEN metered_cost > 0 THEN total_waste / metered_cost END AS unused_share FROM (
  SELECT rt0.*, priced_cpu_h * {_RC} + priced_gib_h * {_RM} AS total_cost, failed_cpu_h * {_RC} + failed_gib_h * {_RM} AS failed_cost, cached_cpu_h * {_RC} + cached_gib_h * {_RM} AS cached_cost,
  cpu_h_req_metered * {_RC} + gib_h_req_metered * {_RM} AS metered_cost, w.total_waste, w.processes
  FROM rt0 JOIN (SELECT run_id, {_dec("coalesce(waste, 0.0)")} AS total_waste, count(*) AS processes FROM ps GROUP BY run_id) w ON rt0.run_id = w.run_id)),
rc0 AS (SELECT *, CASE WHEN base_cpus > 0 THEN base_cpus ELSE max_cpus END AS cpus_now, CASE WHEN base_mem_gib > 0 THEN base_mem_gib ELSE max_mem_gib END AS mem_now_gib,
  CASE WHEN base_limit_h > 0 THEN base_limit_h ELSE max_limit_h END AS time_now_h, max_realtime_h * 1.5 AS wanted, max_rss_gib * 1.25 AS m FROM ps WHERE has_requests AND tasks_with_metrics > 0 AND completed_with_metrics * 2 >= tasks),
rc1 AS (SELECT *, tasks_with_rss > 0 AND max_rss_gib > mem_now_gib AS over_memory, time_now_h > 0 AND max_realtime_h > time_now_h AS over_time, retry_mem_gib > mem_now_gib AS retried_memory,
  retry_cpus > cpus_now AS retried_cpus, time_now_h > 0 AND retry_limit_h > time_now_h AS retried_time, killed_tasks > 0 AS was_killed FROM rc0),
rc2 AS (SELECT *, over_memory OR over_time OR retried_memory OR retried_cpus OR retried_time OR was_killed AS needs_escalation FROM rc1),
rc3 AS (SELECT *, CAST(CASE WHEN needs_escalation THEN ceil(cpus_now) ELSE least(greatest(ceil(max_cores_used * 1.25), 1), ceil(cpus_now)) END AS BIGINT) AS cpus_new,
  CASE WHEN needs_escalation THEN mem_now_gib ELSE least(greatest(CASE WHEN m <= 1 THEN 1.0 WHEN m <= 8 THEN ceil(m) WHEN m <= 64 THEN ceil(m / 2) * 2 ELSE ceil(m / 8) * 8 END, 1.0), mem_now_gib) END AS mem_new_gib,
  CASE WHEN needs_escalation THEN time_now_h WHEN time_now_h > 0 THEN least(CASE WHEN wanted <= 0.25 THEN 0.25 WHEN wanted <= 1 THEN ceil(wanted * 4) / 4 ELSE ceil(wanted) END, time_now_h) ELSE 0.0 END AS time_new_h,
  NOT needs_escalation AND time_now_h > 0 AND wanted > time_now_h AS time_tight FROM rc2),
rc AS MATERIALIZED (SELECT *, CASE WHEN needs_escalation THEN 0.0 ELSE greatest(cost - (cpus_new * realtime_h * {_RC} + mem_new_gib * realtime_h * {_RM}), 0.0) END AS saving FROM rc3),
nm0 AS (SELECT DISTINCT run_id, process, string_split(process, ':') AS parts FROM t),
nm1 AS (SELECT run_id, process, len(parts) AS n, d, array_to_string(parts[len(parts) - d + 1:], ':') AS suffix FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS d FROM nm0)),
nm2 AS (SELECT a.run_id, a.process, any_value(a.n) AS n, min(a.d) FILTER (b.c = 1) AS d FROM nm1 a JOIN (SELECT run_id, d, suffix, count(*) AS c FROM nm1 GROUP BY ALL) b ON a.run_id = b.run_id AND a.d = b.d AND a.suffix = b.suffix GROUP BY a.run_id, a.process),
dn AS MATERIALIZED (SELECT run_id, process, coalesce(d, n) AS depth, array_to_string(string_split(process, ':')[n - coalesce(d, n) + 1:], ':') AS name FROM nm2),
mn AS MATERIALIZED (SELECT DISTINCT process, array_to_string(string_split(process, ':')[greatest(len(string_split(process, ':')) - need + 1, 1):], ':') AS name
  FROM dn JOIN (SELECT string_split(process, ':')[-1] AS leaf, max(depth) AS need FROM dn GROUP BY 1) l ON string_split(process, ':')[-1] = l.leaf),
rn AS MATERIALIZED (SELECT run_id, min(revision) AS revision, min(order_date) AS start_date, CAST(substr(run_id, 4, 2) AS INT) AS k FROM lens GROUP BY run_id),
ro AS MATERIALIZED (SELECT * EXCLUDE (eff), row_number() OVER (ORDER BY eff, key IS NULL, key, start_date, run_id) AS position FROM (SELECT *, CASE WHEN key IS NULL THEN start_date ELSE max(start_date) OVER (PARTITION BY key IS NULL ORDER BY key, start_date, run_id) END AS eff
  FROM (SELECT *, CASE WHEN revision ~ '^[0-9.]+$' THEN list_transform(string_split(revision, '.'), lambda x: CAST(x AS BIGINT)) END AS key FROM rn)))
"""
_TAGGED = "'tag-' || substr(sha256('fixed-salt' || chr(0) || {0}), 1, 10)"
_COMMAND = "('nextflow run \"x&y\" --n ''' || run_id || '''  <in>')"
_ERROR = "('cannot read' || chr(10) || '  /data/' || run_id)"
_VALUED = "'redacted-' || substr(sha256('fixed-salt' || chr(0) || {0}), 1, 10)"
_FILE = "run_id || '/part' || CAST((pos - 1) // 2000 AS VARCHAR)"

_SIDE = "SELECT name, {dec_cost} AS cost_{x}, {dec_hours} AS hours_{x}, max(max_cpus) AS cpus_{x}, max(max_mem_gib) AS mem_gib_{x} FROM ps JOIN mn USING (process) WHERE run_id = '{run}' GROUP BY name"
_DELTA = (
    "SELECT coalesce(a.name, b.name) AS name, " + ", ".join(f"{c}_{x}" for c in ("cost", "hours", "cpus", "mem_gib") for x in ("before", "after")) + ", coalesce(cost_after, 0.0) - coalesce(cost_before, 0.0) AS change FROM ("
    + _SIDE.format(dec_cost=_dec("cost"), dec_hours=_dec("realtime_h"), x="before", run="run1") + ") a FULL JOIN (" + _SIDE.format(dec_cost=_dec("cost"), dec_hours=_dec("realtime_h"), x="after", run="run2") + ") b ON a.name = b.name"
)

BODIES: dict[str, str] = {
    "process_cost": "SELECT run_id, CAST(rank AS INT) AS rank, process, tasks, failed_tasks, cost, share, cpu_efficiency, mem_efficiency, waste FROM sh",
    "process_statistics": "SELECT run_id, process, tasks, retried_tasks, killed_tasks, attempts_known, tasks_with_metrics, tasks_with_cpu, tasks_with_rss, completed_with_metrics, has_requests, realtime_h, cpu_h_requested, cpu_h_used, gib_h_requested, gib_h_used, cpu_h_req_metered, gib_h_req_metered, max_cores_used, max_rss_gib, max_realtime_h, failed_cost FROM ps",
    "tag_cost": "SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY cost DESC, tag NULLS FIRST) AS INT) AS rank, tag, tasks, processes, realtime_h, cost, failed_cost, waste FROM ts",
    "tagged_share": f"SELECT run_id, coalesce({_dec('CASE WHEN tag IS NOT NULL THEN cost END')}, 0.0) / {_dec('cost')} AS tagged_share FROM ts GROUP BY run_id",
    "run_totals": "SELECT run_id, tasks, processes, failed_tasks, cached_tasks, tasks_without_requests, tasks_without_metrics, total_cost, failed_cost, cached_cost, total_waste, cpu_h_requested, gib_h_requested, priced_cpu_h, priced_gib_h FROM rt",
    "reprice_presets": "SELECT run_id, rate_name, priced_cpu_h * c + priced_gib_h * m AS cost FROM rt, (VALUES " + ", ".join(f"('{r.name}', CAST({r.cpu_hour} AS DOUBLE), CAST({r.gib_hour} AS DOUBLE))" for r in PRESETS.values()) + ") v(rate_name, c, m)",
    "unused_pct": "SELECT run_id, metered_cost, unused_share FROM rt",
    "cost_basis": "SELECT run_id, tasks, tasks_without_requests, tasks_without_metrics, CASE WHEN tasks_without_requests = 0 THEN 'requested' WHEN tasks_without_requests = tasks THEN 'used' ELSE 'mixed' END AS basis, CASE WHEN tasks_without_metrics = tasks THEN 'unmetered' WHEN tasks_without_metrics > 0 THEN 'partly metered' ELSE 'metered' END AS coverage FROM rt",
    "killed_tasks": "SELECT run_id, hash, process, exit, realtime_ms, time_ms FROM p WHERE killed",
    "attempt_requests": "SELECT run_id, process, base_cpus, retry_cpus, max_cpus, base_mem_gib, retry_mem_gib, max_mem_gib, base_limit_h, retry_limit_h, max_limit_h FROM ps",
    "dedup_tasks": "SELECT run_id, hash, process, status, exit, realtime_ms, pos FROM t",
    "merge_by_hash": "SELECT run_id, hash, pos, cpus_units, memory_kib, realtime_ms, tag FROM t WHERE pos % 10 NOT IN (0, 1)",
    "merge_by_name": """SELECT a.run_id, a.name, a.pos, b.cpus_units, coalesce(CASE WHEN b.pos % 10 <> 2 THEN b.realtime_ms END, a.realtime_ms) AS realtime_ms, b.tag
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id, name ORDER BY pos) AS k FROM t WHERE pos % 10 <> 0) a
      JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, name ORDER BY pos) AS k FROM t WHERE pos % 10 <> 1) b ON a.run_id = b.run_id AND a.name = b.name AND a.k = b.k""",
    "merge_mixed": """SELECT a.run_id, a.name, CASE WHEN b.pos IS NULL THEN 'trace' ELSE 'both' END AS source, 0 AS side, a.pos, coalesce(nullif(b.h, ''), a.h) AS hash, b.cpus_units,
        coalesce(CASE WHEN b.pos % 10 <> 2 THEN b.realtime_ms END, a.realtime_ms) AS realtime_ms, CASE WHEN b.pos IS NULL THEN 'trace' ELSE b.tag END AS tag
      FROM ga a JOIN gr ON gr.run_id = a.run_id AND gr.name = a.name AND gr.i = a.i LEFT JOIN gb b ON b.run_id = a.run_id AND b.pos = gr.pick
      UNION ALL SELECT run_id, name, 'report', 1, pos, h, cpus_units, CASE WHEN pos % 10 <> 2 THEN realtime_ms END, tag FROM gb ANTI JOIN gr ON gr.run_id = gb.run_id AND gr.pick = gb.pos""",
    "merge_leftovers": """SELECT run_id, hash, CASE WHEN pos % 10 = 1 THEN 'trace' ELSE 'report' END AS source, CAST(CASE WHEN pos % 10 = 1 THEN 0 ELSE 1 END AS INT) AS side, pos,
      CASE WHEN pos % 10 = 0 THEN cpus_units END AS cpus_units, realtime_ms, CASE WHEN pos % 10 = 1 THEN 'trace' ELSE tag END AS tag FROM t WHERE pos % 10 IN (0, 1)""",
    "parse_duration": "SELECT run_id, hash, realtime_ms FROM t",
    "parse_memory": "SELECT run_id, hash, memory_kib, peak_rss_kib FROM t",
    "parse_percent": "SELECT run_id, hash, pct_cpu_units FROM t",
    "task_names": "SELECT name, process, regexp_extract(name, '\\((.*)\\)$', 1) AS tag, count(*) AS tasks FROM lens GROUP BY name, process",
    "trace_roundtrip": "SELECT run_id, hash, process, status, exit, realtime_ms, pct_cpu_units, peak_rss_kib FROM lens",
    "report_roundtrip": "SELECT run_id, hash, process, tag, status, exit, attempt, realtime_ms, cpus_units, memory_kib, time_ms FROM lens",
    "report_errors": f"""SELECT path, CASE CAST(substr(regexp_extract(path, 'part(.*)$', 1), 1, 4) AS INT) % 5 WHEN 0 THEN 'no_window_data' WHEN 1 THEN 'max_tasks' WHEN 2 THEN 'no_trace' ELSE 'bad_json' END AS error
      FROM (SELECT DISTINCT {_FILE} AS path FROM lens) WHERE CAST(substr(regexp_extract(path, 'part(.*)$', 1), 1, 4) AS INT) % 5 < 4""",
    "run_headers": """SELECT run_id, start_date AS started, '5h 8m' AS duration, '24.' || k % 3 AS nextflow_version, CASE WHEN k > 3 THEN 'aws' ELSE 'local' END AS profile, 'https://github.com/pipes/rna' AS repository, revision,
      run_id || 'abcdef0123' AS commit, 'true, version 2.3' AS fusion, '1''177.0' AS cpu_hours, 'pipes/rna ' || revision || ' · ' || CASE WHEN k > 3 THEN 'aws' ELSE 'local' END || ' · Nextflow 24.' || k % 3 || ' · Fusion 2.3 · wall 5h 8m' AS summary FROM rn""",
    "page_titles": "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g')) AS title FROM pages",
    "recommendations": "SELECT run_id, process, cpus_now, cpus_new, mem_now_gib, mem_new_gib, time_now_h, time_new_h, saving, needs_escalation, time_tight FROM rc",
    "not_sized": "SELECT run_id, process, tasks, completed_with_metrics FROM ps WHERE has_requests AND completed_with_metrics * 2 < tasks",
    "total_saving": f"SELECT rt.run_id, coalesce(s.saving, 0.0) AS saving, CASE WHEN total_cost > 0 THEN coalesce(s.saving, 0.0) / total_cost END AS saving_share FROM rt LEFT JOIN (SELECT run_id, {_dec('saving')} AS saving FROM rc GROUP BY run_id) s ON rt.run_id = s.run_id",
    "config_fragments": """SELECT run_id, '// Requests lowered to what the tasks of this run used, with a margin.' || chr(10) || '// A process without an entry keeps its settings; an entry also ends growth on retry.' || chr(10) || 'process {' || chr(10) || string_agg(b, chr(10) ORDER BY saving DESC, cost DESC, process) || chr(10) || '}' || chr(10) AS fragment
      FROM (SELECT *, '    withName: ''' || process || ''' {' || chr(10) || array_to_string(l, chr(10)) || chr(10) || '    }' AS b FROM (SELECT *, list_filter([
        CASE WHEN cpus_new < cpus_now THEN '        cpus   = ' || cpus_new END,
        CASE WHEN mem_new_gib < mem_now_gib THEN '        memory = ''' || CAST(mem_new_gib AS BIGINT) || '.GB''' END,
        CASE WHEN time_new_h > 0 AND time_new_h < time_now_h THEN '        time   = ''' || CASE WHEN time_new_h = floor(time_new_h) THEN CAST(time_new_h AS BIGINT) || '.h' ELSE CAST(round(time_new_h * 60) AS BIGINT) || '.m' END || '''' END,
        CASE WHEN time_tight THEN '        // near its limit: ' || printf('%.1f', max_realtime_h) || ' h used of ' || CAST(time_now_h AS BIGINT) || 'h' END], lambda x: x IS NOT NULL) AS l FROM rc WHERE NOT needs_escalation) WHERE len(l) > 0) GROUP BY run_id""",
    "config_literals": """SELECT DISTINCT memory_kib, realtime_ms, CASE WHEN memory_kib IS NULL THEN NULL WHEN memory_kib % 1048576 = 0 THEN memory_kib // 1048576 || '.GB' WHEN memory_kib >= 1024 THEN memory_kib // 1024 || '.MB' ELSE memory_kib || '.KB' END AS memory,
      CASE WHEN s % 3600 = 0 THEN s // 3600 || '.h' WHEN s % 60 = 0 THEN s // 60 || '.m' ELSE s || '.s' END AS time FROM (SELECT *, greatest(realtime_ms // 1000, 1) AS s FROM t)""",
    "display_names": "SELECT run_id, process, name FROM dn",
    "matrix_names": "SELECT process, name FROM mn",
    "run_order": "SELECT run_id, revision, start_date, CAST(position AS INT) AS position FROM ro",
    "run_labels": """SELECT run_id, route, CASE WHEN revision ~ '^[0-9.]+$' THEN revision ELSE revision || '@' || substr(run_id || 'abcdef0123', 1, 7) END || coalesce(' ' || route, '') || ' ' || start_date AS label
      FROM (SELECT rn.*, CASE WHEN k % 3 = 0 THEN 'rsem' WHEN small THEN 'small' WHEN std THEN 'salmon' END AS route FROM rn JOIN (SELECT run_id, bool_or(process LIKE '%SMALL\\_ALIGN' ESCAPE '\\') AS small, bool_or(process LIKE '%STANDARD\\_ALIGN' ESCAPE '\\') AS std FROM t GROUP BY run_id) x ON rn.run_id = x.run_id)""",
    "start_dates": "SELECT DISTINCT order_date, order_date AS start_date FROM lens",
    "compare_runs": "SELECT rt.run_id, rt.tasks, cached_tasks, rt.failed_tasks, rt.cpu_h_requested, rt.gib_h_requested, total_cost, rt.tasks - tasks_without_metrics AS metered_tasks, unused_share, mn.name AS top_process, sh.share AS top_share FROM rt JOIN sh ON sh.run_id = rt.run_id AND sh.rank = 1 JOIN mn ON mn.process = sh.process",
    "share_matrix_long": f"SELECT m.name, run_id, share, total FROM (SELECT name, run_id, CAST(sum(CAST(floor(share * 1000000000000.0 + 0.5) AS BIGINT)) AS DOUBLE) / 1000000000000.0 AS share, {_dec('cost')} AS cost FROM sh JOIN mn USING (process) GROUP BY name, run_id) m JOIN (SELECT name, {_dec('c')} AS total FROM (SELECT name, run_id, {_dec('cost')} AS c FROM sh JOIN mn USING (process) GROUP BY name, run_id) GROUP BY name ORDER BY total DESC, name LIMIT 15) n ON m.name = n.name",
    "share_matrix_pivot": f"SELECT m.name, {', '.join(f'max(share) FILTER (run_id = ' + chr(39) + f'run{i}' + chr(39) + f') AS run{i}' for i in range(7))} FROM (SELECT name, run_id, CAST(sum(CAST(floor(share * 1000000000000.0 + 0.5) AS BIGINT)) AS DOUBLE) / 1000000000000.0 AS share FROM sh JOIN mn USING (process) GROUP BY name, run_id) m JOIN (SELECT name, {_dec('c')} AS total FROM (SELECT name, run_id, {_dec('cost')} AS c FROM sh JOIN mn USING (process) GROUP BY name, run_id) GROUP BY name ORDER BY total DESC, name LIMIT 15) n ON m.name = n.name GROUP BY m.name",
    "top_processes": "SELECT run_id, CAST(rank AS INT) AS rank, process, cost FROM sh WHERE rank <= 25",
    "report_totals": "SELECT run_id, metric, value FROM (UNPIVOT (SELECT run_id, " + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in ("tasks", "failed_tasks", "cached_tasks", "total_cost", "total_waste", "failed_cost", "cpu_h_requested", "cpu_h_used", "gib_h_requested", "gib_h_used")) + " FROM rt) ON COLUMNS(* EXCLUDE run_id) INTO NAME metric VALUE value)",
    "report_processes": "SELECT sh.run_id, CAST(rank AS INT) AS rank, name, tasks, cost, share, cpu_efficiency, mem_efficiency FROM sh JOIN dn ON dn.run_id = sh.run_id AND dn.process = sh.process WHERE rank <= 25",
    "report_tags": f"SELECT run_id, CAST(rank AS INT) AS rank, tag, tasks, processes, cost, CASE WHEN tot > 0 THEN cost / tot ELSE 0.0 END AS share FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cost DESC, tag NULLS FIRST) AS rank, CAST(sum(CAST(floor(cost * 1000000.0 + 0.5) AS BIGINT)) OVER (PARTITION BY run_id) AS DOUBLE) / 1000000.0 AS tot FROM ts) WHERE rank <= 25",
    "report_right_sizing": "SELECT r.run_id, CAST(rank AS INT) AS rank, name, cpus_now, cpus_new, mem_now_gib, mem_new_gib, saving FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY saving DESC, process) AS rank FROM rc WHERE NOT needs_escalation) r JOIN dn ON dn.run_id = r.run_id AND dn.process = r.process WHERE rank <= 15",
    "report_tight_and_kept": "SELECT rc.run_id, name, l AS list FROM rc JOIN dn ON dn.run_id = rc.run_id AND dn.process = rc.process JOIN (VALUES ('tight'), ('kept')) v(l) ON CASE l WHEN 'tight' THEN time_tight ELSE needs_escalation END",
    "inspect_runs": f"SELECT {_FILE} AS path, 'trace' AS kind, count(*) AS tasks, CAST(0 AS BIGINT) AS with_requests, count(*) FILTER (pct_cpu_units IS NOT NULL OR peak_rss_kib IS NOT NULL) AS with_metrics, '%cpu,exit,hash,name,peak_rss,realtime,status' AS columns, concat_ws('; ', CASE WHEN count(*) FILTER (pct_cpu_units IS NOT NULL OR peak_rss_kib IS NOT NULL) = 0 THEN 'no usage metrics: priced but not right-sized' END, 'no cpus or memory columns') AS notes FROM lens GROUP BY 1",
    "manifest_check": """SELECT coalesce(h.path, w.path) AS path, CASE WHEN h.path IS NULL THEN 'missing' WHEN w.path IS NULL THEN 'unlisted' WHEN w.changed THEN 'changed' ELSE 'ok' END AS status
      FROM (SELECT CAST(doc_id AS VARCHAR) AS path FROM documents) h FULL JOIN (SELECT CAST(doc_id AS VARCHAR) || CASE WHEN n_chars % 7 = 0 THEN '.old' ELSE '' END AS path, n_chars % 5 = 0 AS changed FROM documents) w ON h.path = w.path""",
    "pseudonyms": f"SELECT DISTINCT tag, {_TAGGED.format('tag')} AS as_tag, {_VALUED.format('tag')} AS as_value FROM lens WHERE tag IS NOT NULL",
    "redacted_tasks": f"SELECT run_id, pos, hash, process, process || ' (' || {_TAGGED.format(chr(99) + 'oalesce(tag, ' + chr(39) + '1' + chr(39) + ')')} || ')' AS name, coalesce({_TAGGED.format('tag')}, '-') AS tag, {_VALUED.format('(' + chr(39) + 'queue-' + chr(39) + ' || substr(process, 6, 3))')} AS queue, {_VALUED.format('(' + chr(39) + '/work/' + chr(39) + ' || hash)')} AS workdir FROM t",
    "redaction_map": f"SELECT DISTINCT kind, CASE kind WHEN 'tag' THEN {_TAGGED.format('o')} ELSE {_VALUED.format('o')} END AS pseudonym, o AS original FROM (SELECT 'tag' AS kind, coalesce(tag, '1') AS o FROM t UNION SELECT 'value', 'queue-' || substr(process, 6, 3) FROM t UNION SELECT 'value', '/work/' || hash FROM t)",
    "redaction_collisions": f"SELECT right(pseudonym, 4) AS pseudonym, count(DISTINCT o) AS originals FROM (SELECT o, CASE kind WHEN 'tag' THEN {_TAGGED.format('o')} ELSE {_VALUED.format('o')} END AS pseudonym FROM (SELECT 'tag' AS kind, coalesce(tag, '1') AS o FROM t UNION SELECT 'value', 'queue-' || substr(process, 6, 3) FROM t UNION SELECT 'value', '/work/' || hash FROM t)) GROUP BY 1 HAVING count(DISTINCT o) > 1",
    "redaction_counts": "SELECT kind, count(*) AS originals FROM (SELECT 'tag' AS kind, coalesce(tag, '1') AS o FROM t UNION SELECT 'value', 'queue-' || substr(process, 6, 3) FROM t UNION SELECT 'value', '/work/' || hash FROM t) GROUP BY kind",
    "redaction_invariance": f"""SELECT rt.run_id, rt.tasks, processes, g.tags, g.tag_groups, total_cost, total_waste, unused_share, coalesce(s.saving, 0.0) AS saving FROM rt
      JOIN (SELECT run_id, count(tag) AS tags, count(*) AS tag_groups FROM ts GROUP BY run_id) g ON g.run_id = rt.run_id LEFT JOIN (SELECT run_id, {_dec('saving')} AS saving FROM rc GROUP BY run_id) s ON s.run_id = rt.run_id""",
    "redacted_traces": f"""SELECT run_id, hash, process || ' (' || {_TAGGED.format("coalesce(tag, '1')")} || ')' AS name, status,
      (realtime_ms // 3600000) || 'h ' || (realtime_ms // 60000 % 60) || 'm ' || (realtime_ms // 1000 % 60) || 's ' || (realtime_ms % 1000) || 'ms' AS realtime FROM lens""",
    "redacted_reports": f"""SELECT run_id, hash, process, coalesce({_TAGGED.format("tag")}, '-') AS tag, process || ' (' || {_TAGGED.format("coalesce(tag, '1')")} || ')' AS name, {_VALUED.format("('it' || chr(92) || '''s </done>')")} AS script,
      CAST(cpus_units // 100000 AS VARCHAR) AS cpus, CAST(memory_kib * 1024 AS VARCHAR) AS memory FROM lens""",
    "redacted_headers": f"""SELECT run_id, {_VALUED.format(_COMMAND)} AS command, {_VALUED.format("'https://github.com/pipes/rna'")} AS repository, CASE WHEN k > 3 THEN 'aws' ELSE 'local' END AS profile,
      {_VALUED.format("('cannot read' || chr(10) || '  /data/' || run_id)")} AS error_text, {_VALUED.format("('run-' || run_id)")} AS run_name, '24.' || k % 3 AS nextflow_version FROM rn""",
    "header_scan": f"""SELECT 'scanned' AS what, unnest(['odd ' || run_id, {_VALUED.format(_COMMAND)}, {_VALUED.format("'https://github.com/pipes/rna'")}, {_VALUED.format(_ERROR)}, {_VALUED.format("('run-' || run_id)")}]) AS text FROM rn
      UNION ALL SELECT DISTINCT {_VALUED.format('o')}, o FROM (SELECT unnest([{_COMMAND}, 'https://github.com/pipes/rna', {_ERROR}, 'cannot read', '/data/' || run_id, 'run-' || run_id]) AS o FROM rn)""",
    "report_redaction_map": f"""SELECT DISTINCT kind, CASE kind WHEN 'tag' THEN {_TAGGED.format('o')} ELSE {_VALUED.format('o')} END AS pseudonym, o AS original FROM (
      SELECT 'tag' AS kind, unnest([coalesce(tag, '1'), 'only ' || {_FILE}]) AS o FROM lens
      UNION SELECT 'value', unnest(['{{"RUN":"' || run_id || '"}}', '7', 'cd /work/' || hash || chr(10) || './run "x"', '/secret/' || {_FILE}, 'one ' || run_id]) FROM lens)""",
    "trace_redaction_map": f"""SELECT DISTINCT kind, CASE kind WHEN 'tag' THEN {_TAGGED.format('o')} ELSE {_VALUED.format('o')} END AS pseudonym, o AS original FROM (
      SELECT 'tag' AS kind, coalesce(tag, '1') AS o FROM lens WHERE pos % 10 IN (0, 1) UNION SELECT 'value', '/scratch/' || attempt FROM lens WHERE pos % 10 IN (0, 1) UNION SELECT 'value', 'past ' || run_id FROM lens WHERE pos % 10 = 0)""",
    "leak_scan_paths": """SELECT d.doc_id AS id, v.doc_id AS value FROM documents d JOIN documents v
      ON contains(d.text || ' at /work/runs/' || md5(CAST(d.doc_id + 1 AS VARCHAR)), '/work/runs/' || md5(CAST(v.doc_id AS VARCHAR)))""",
    "leak_needles": r"""SELECT DISTINCT o AS value, unnest(list_distinct([o, replace(replace(replace(o, '\', '\\'), '"', '\"'), chr(10), '\n'), replace(replace(replace(replace(o, '\', '\\'), '"', '\"'), chr(10), '\n'), '/', '\/'),
      replace(replace(replace(replace(replace(o, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')])) AS needle FROM (SELECT '<a href="/x">it''s & ' || left(text, 40) || '\</a>' AS o FROM benchmark)""",
    "leak_scan": "SELECT DISTINCT doc_id AS id, item_id AS value FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "leak_scan_tokens": """SELECT DISTINCT doc_id AS id, value FROM documents JOIN (SELECT CAST(item_id AS VARCHAR) AS value, text AS needle FROM benchmark
      UNION ALL SELECT 'word ' || item_id, regexp_extract(text, '([A-Za-z]{5,})', 1) FROM benchmark WHERE regexp_extract(text, '([A-Za-z]{5,})', 1) <> '') b ON contains(documents.text, needle)""",
    "location_markers": "SELECT doc_id AS id, concat_ws(',', CASE WHEN contains(text, '@') THEN '@' END, CASE WHEN contains(text, 'example.com') THEN 'example.com' END) AS markers FROM documents WHERE contains(text, '@') OR contains(text, 'example.com')",
    "usage_quantiles": "SELECT process, count(*) AS tasks, quantile_cont(CAST(pct_cpu_units AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(pct_cpu_units AS DOUBLE), 0.5) AS q50, quantile_cont(CAST(pct_cpu_units AS DOUBLE), 0.75) AS q75, CAST(sum(pct_cpu_units) AS DOUBLE) / count(*) AS mean, CAST(min(pct_cpu_units) AS DOUBLE) AS least, CAST(max(pct_cpu_units) AS DOUBLE) AS most FROM t WHERE pct_cpu_units IS NOT NULL GROUP BY process",
    "quantiles_since_release": "SELECT t.run_id, count(*) AS tasks, quantile_cont(CAST(realtime_ms AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(realtime_ms AS DOUBLE), 0.75) AS q75, CAST(sum(realtime_ms) AS DOUBLE) / count(*) AS mean, CAST(min(realtime_ms) AS DOUBLE) AS least, CAST(max(realtime_ms) AS DOUBLE) AS most FROM t JOIN ro USING (run_id) WHERE ro.key >= [3, 8] GROUP BY t.run_id",
    "share_history": "SELECT process, count(*) AS runs, min(share) AS least_share, max(share) AS most_share, CAST(min(rank) AS INT) AS best_rank, CAST(max(rank) AS INT) AS worst_rank FROM sh GROUP BY process",
    "share_by_release": "SELECT CAST(position AS INT) AS position, sh.run_id, process, share, CAST(rank AS INT) AS rank FROM sh JOIN ro ON ro.run_id = sh.run_id",
    "share_band": "SELECT process, count(*) AS runs, min(share) AS least_share, max(share) AS most_share FROM sh JOIN ro ON ro.run_id = sh.run_id WHERE position BETWEEN 2 AND 4 GROUP BY process",
    "release_delta": _DELTA,
    "biggest_mover": f"SELECT name, change FROM ({_DELTA}) WHERE name <> 'STANDARD_ALIGN' ORDER BY abs(change) DESC, name LIMIT 1",
    "outside_band": "SELECT run_id, unused_share FROM rt WHERE unused_share < 0.5 OR unused_share > 0.62",
    "run_selection": """SELECT release, route, coalesce(max_by(m, s || m) FILTER (ok), max_by(m, s || m) FILTER (bad AND route = 'rsem')) AS run_id FROM (
      SELECT revision AS release, substr(order_date, 1, 7) AS m, CASE WHEN CAST(substr(order_date, 6, 2) AS INT) % 2 = 0 THEN 'rsem' ELSE 'salmon' END AS route, min(order_date) AS s, count(*) FILTER (status = 'FAILED') * 100 <= 8 * count(*) AS ok,
      bool_or(status = 'FAILED' AND process LIKE '%ALIGN') AS bad FROM t GROUP BY 1, 2, 3) GROUP BY release, route HAVING coalesce(max_by(m, s || m) FILTER (ok), max_by(m, s || m) FILTER (bad AND route = 'rsem')) IS NOT NULL""",
    "metering_audit": "SELECT run_id, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'COMPLETED' AND pct_cpu_units IS NULL AND peak_rss_kib IS NULL) AS completed_unmetered, bool_and(pct_cpu_units IS NULL AND peak_rss_kib IS NULL) AS unmetered FROM t GROUP BY run_id",
    "attempt_history": "SELECT run_id, process, tag, attempt, status, exit, realtime_ms, CAST(row_number() OVER (PARTITION BY run_id, process, tag ORDER BY attempt, pos) AS INT) AS step, max(attempt) OVER (PARTITION BY run_id, process, tag) AS most_attempts FROM t",
    "launch_changes": "SELECT run_id, CAST(position AS INT) AS position, coalesce((k > 3) <> lag(k > 3) OVER (ORDER BY position), FALSE) AS profile_changed, coalesce(k % 3 <> lag(k % 3) OVER (ORDER BY position), FALSE) AS nextflow_version_changed FROM ro",
    "script_changes": """SELECT x.run_id, x.process, CAST(x.position AS INT) AS position, coalesce(x.s <> lag(x.s) OVER w, FALSE) AS script_changed, FALSE AS image_changed, coalesce(x.g <> lag(x.g) OVER w, FALSE) AS registry_changed
      FROM (SELECT ps.run_id, process, position, CASE WHEN process LIKE '%SMALL%' THEN k % 2 ELSE 0 END AS s, k > 3 AS g FROM ps JOIN ro ON ro.run_id = ps.run_id) x WINDOW w AS (PARTITION BY x.process ORDER BY x.position)""",
    "request_history": "SELECT process, count(*) AS runs, min(base_cpus) AS least_base_cpus, max(base_cpus) AS most_base_cpus, min(base_mem_gib) AS least_base_mem_gib, max(base_mem_gib) AS most_base_mem_gib, min(base_limit_h) AS least_base_limit_h, max(base_limit_h) AS most_base_limit_h, count(DISTINCT base_cpus) = 1 AND count(DISTINCT base_mem_gib) = 1 AND count(DISTINCT base_limit_h) = 1 AS constant, max(max_cores_used) AS most_cores_used FROM ps WHERE has_requests GROUP BY process",
    "sample_range": "SELECT run_id, count(*) AS samples, min(cost) AS least, max(cost) AS most FROM ts WHERE tag IN ('S0', 'S1', 'S2', 'S3') GROUP BY run_id",
    "used_unused_by_release": "SELECT CAST(position AS INT) AS position, rt.run_id, metered_cost - total_waste AS used_cost, total_waste AS unused_cost FROM rt JOIN ro ON ro.run_id = rt.run_id",
    "cores_per_task": "SELECT process, count(*) AS tasks, quantile_cont(CAST(pct_cpu_units AS DOUBLE), 0.5) / 100000.0 AS median_cores FROM t WHERE status = 'COMPLETED' AND pct_cpu_units IS NOT NULL GROUP BY process",
    "escalation_audit": "SELECT process, count(*) AS runs, " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in ("over_memory", "over_time", "retried_memory", "retried_cpus", "retried_time", "was_killed")) + ", count(*) FILTER (was_killed AND NOT (over_memory OR over_time OR retried_memory OR retried_cpus OR retried_time)) AS only_killed FROM rc GROUP BY process",
    "cached_audit": "SELECT run_id, count(*) FILTER (status = 'CACHED') AS cached, count(*) AS tasks, count(*) FILTER (status = 'CACHED') / count(*) AS cached_share FROM t GROUP BY run_id",
    "cpu_hours_reconcile": "SELECT run_id, t / 10 AS stated, run_id <> 'run2' AS agrees FROM (SELECT run_id, sum(CAST(cpus_units AS HUGEINT) * realtime_ms) // 36000000000 + CASE WHEN run_id = 'run2' THEN 10 ELSE 0 END AS t FROM t GROUP BY run_id)",
    "failure_tail": "SELECT run_id || '|' || hash AS run_id, CASE WHEN killed THEN 'Parsed ' || pos || ' entries' ELSE 'done' END AS last_line, CASE WHEN killed THEN pos END AS parsed, exit IS NULL AS timed_out FROM p WHERE status = 'FAILED'",
    "read_amplification": "SELECT run_id, hash, realtime_ms + 1 AS input_bytes, peak_rss_kib * 1024 / (realtime_ms + 1) AS amplification FROM t WHERE peak_rss_kib IS NOT NULL AND pos % 2 = 0",
    "scaling_table": """SELECT benchmark, variant, wall_s, first_value(wall_s) OVER w / wall_s AS speed_up, variant * wall_s AS cpus_x_wall, cpu_s / first_value(cpu_s) OVER w AS relative_cpu
      FROM (SELECT run_id AS benchmark, cpus_units // 100000 AS variant, max(realtime_ms) / 1000.0::DOUBLE AS wall_s, CAST(sum(realtime_ms) AS DOUBLE) / 1000.0::DOUBLE AS cpu_s FROM t WHERE cpus_units IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY benchmark ORDER BY variant)""",
    "output_identity": "SELECT source AS benchmark, CAST(n_chars AS VARCHAR) AS file, count(*) AS variants, count(DISTINCT sha256(text)) = 1 AS identical FROM documents GROUP BY 1, 2",
    "analysis_documents": f"""SELECT ps.run_id, rt.tasks, rt.total_cost, 'seqera-compute' AS rates, CAST({_RC} AS DOUBLE) AS cpu_hour, rn.revision, CASE WHEN k > 3 THEN 'aws' ELSE 'local' END AS profile, ps.process, ps.cost, rc.saving,
      CASE WHEN ps.has_requests AND ps.completed_with_metrics * 2 < ps.tasks THEN ps.completed_with_metrics END AS completed_with_metrics
      FROM ps JOIN rt ON rt.run_id = ps.run_id JOIN rn ON rn.run_id = ps.run_id LEFT JOIN rc ON rc.run_id = ps.run_id AND rc.process = ps.process""",
}


_MONEY = "CASE WHEN {0} IS NULL THEN 'n/a' ELSE '$' || printf('%.2f', {0}) END"
_PERCENT = "CASE WHEN {0} IS NULL THEN 'n/a' ELSE printf('%.0f', {0} * 100) || '%' END"
_HOURS = "CASE WHEN {0} < 1 THEN CAST(round({0} * 60) AS BIGINT) || 'm' WHEN abs({0} - round({0})) < 1e-9 THEN CAST(round({0}) AS BIGINT) || 'h' ELSE printf('%.1f', {0}) || 'h' END"
_TRIMMED = "regexp_replace(regexp_replace(printf('%.2f', {0}), '0+$', ''), '[.]$', '')"
_GB = f"CASE WHEN {{0}} >= 1 THEN {_TRIMMED} || ' GB' WHEN {{0}} * 1024 >= 1 THEN {_TRIMMED.replace('{0}', '{0} * 1024')} || ' MB' ELSE {_TRIMMED.replace('{0}', '{0} * 1048576')} || ' KB' END"


def _of(template: str, x: str) -> str:
    return template.replace("{0}", x)


def _both_hours(kind: str) -> str:
    asked, used, base = f"{kind}_h_requested", f"{kind}_h_used", f"{kind}_h_req_metered"
    return f"CASE WHEN tasks_without_requests = tasks THEN 'n/a' ELSE printf('%.1f', {asked}) END || ' / ' || CASE WHEN {base} > 0 THEN printf('%.1f', {used}) ELSE 'n/a' END || ' (' || {_of(_PERCENT, f'(CASE WHEN {base} > 0 THEN {used} / {base} END)')} || ')'"


_OTHERS = " || ', ' || ".join(_of(_MONEY, f"(priced_cpu_h * {p.cpu_hour} + priced_gib_h * {p.gib_hour})") + f" || ' at {p.name}'" for p in PRESETS.values() if p.name != "seqera-compute")
_TOTALS = {
    "cost": _of(_MONEY, "total_cost"), "basis": "CASE WHEN tasks_without_requests = 0 THEN 'requested x run time' WHEN tasks_without_requests = tasks THEN 'used x run time' ELSE 'requested x run time, used where no request is known' END",
    "cached": f"CASE WHEN cached_tasks > 0 THEN {_of(_MONEY, 'cached_cost')} || ' (' || cached_tasks || ' tasks)' END",
    "unused": f"CASE WHEN metered_cost > 0 THEN {_of(_MONEY, 'total_waste')} || ' (' || {_of(_PERCENT, 'unused_share')} || ' of the ' || {_of(_MONEY, 'metered_cost')} || ' metered)' ELSE 'n/a' END",
    "failed attempts": _of(_MONEY, "failed_cost"), "other rates": _OTHERS, "run time": "printf('%.1f', realtime_h) || ' h'", "cpu-hours": _both_hours("cpu"), "gib-hours": _both_hours("gib"),
}
BODIES |= {
    "trace_lines_roundtrip": BODIES["trace_roundtrip"],
    "shown_processes": f"""SELECT sh.run_id, CAST(rank AS INT) AS rank, name AS process, tasks, {_of(_HOURS, "realtime_h")} AS run_time, {_of(_MONEY, "cost")} AS cost, {_of(_PERCENT, "share")} AS share, {_of(_PERCENT, "cpu_efficiency")} AS cpu_eff,
      {_of(_PERCENT, "mem_efficiency")} AS mem_eff, {_of(_MONEY, "waste")} AS waste, CASE WHEN attempts_known THEN CAST(retried_tasks AS VARCHAR) ELSE 'n/a' END AS retries, failed_tasks FROM sh JOIN dn ON dn.run_id = sh.run_id AND dn.process = sh.process WHERE rank <= 25""",
    "shown_tags": f"""SELECT run_id, CAST(rank AS INT) AS rank, coalesce(tag, '(untagged)') AS tag, tasks, processes, {_of(_HOURS, "realtime_h")} AS run_time, {_of(_MONEY, "cost")} AS cost, {_of(_PERCENT, "(CASE WHEN tot > 0 THEN cost / tot ELSE 0.0 END)")} AS share, {_of(_MONEY, "waste")} AS waste
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cost DESC, tag NULLS FIRST) AS rank, CAST(sum(CAST(floor(cost * 1000000.0 + 0.5) AS BIGINT)) OVER (PARTITION BY run_id) AS DOUBLE) / 1000000.0 AS tot FROM ts) WHERE rank <= 25""",
    "shown_right_sizing": f"""SELECT r.run_id, CAST(rank AS INT) AS rank, name AS process, printf('%.0f', cpus_now) || ' \u2192 ' || cpus_new AS cpus, {_of(_GB, "mem_now_gib")} || ' \u2192 ' || {_of(_GB, "mem_new_gib")} AS memory,
      CASE WHEN time_now_h > 0 THEN {_of(_HOURS, "time_now_h")} || ' \u2192 ' || {_of(_HOURS, "time_new_h")} || CASE WHEN time_tight THEN ' (tight)' ELSE '' END ELSE 'n/a' END AS time, {_of(_MONEY, "saving")} AS saving
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY saving DESC, process) AS rank FROM rc WHERE NOT needs_escalation) r JOIN dn ON dn.run_id = r.run_id AND dn.process = r.process WHERE rank <= 15""",
    "shown_totals": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT run_id, {i} AS position, '{m}' AS metric, {v} AS value FROM rt" for i, (m, v) in enumerate(_TOTALS.items(), 1)) + ") WHERE value IS NOT NULL",
    "recommendations_at_margin": f"""SELECT run_id, process, cn AS cpus_new, mn AS mem_new_gib, tn AS time_new_h, CASE WHEN needs_escalation THEN 0.0 ELSE greatest(cost - (cn * realtime_h * {_RC} + mn * realtime_h * {_RM}), 0.0) END AS saving FROM (
      SELECT *, CAST(CASE WHEN needs_escalation THEN ceil(cpus_now) ELSE least(greatest(ceil(max_cores_used * 2.0), 1), ceil(cpus_now)) END AS BIGINT) AS cn,
        CASE WHEN needs_escalation THEN mem_now_gib ELSE least(greatest(CASE WHEN g <= 1 THEN 1.0 WHEN g <= 8 THEN ceil(g) WHEN g <= 64 THEN ceil(g / 2) * 2 ELSE ceil(g / 8) * 8 END, 1.0), mem_now_gib) END AS mn,
        CASE WHEN needs_escalation THEN time_now_h WHEN time_now_h > 0 THEN least(CASE WHEN h <= 0.25 THEN 0.25 WHEN h <= 1 THEN ceil(h * 4) / 4 ELSE ceil(h) END, time_now_h) ELSE 0.0 END AS tn
      FROM (SELECT *, max_rss_gib * 2.0 AS g, max_realtime_h * 2.0 AS h FROM rc))""",
    "fragment_lines": """SELECT run_id, CAST(4 + sum(2 + n) AS BIGINT) AS lines, count(*) AS processes FROM (SELECT run_id, CAST(cpus_new < cpus_now AS INT) + CAST(mem_new_gib < mem_now_gib AS INT)
      + CAST(time_new_h > 0 AND time_new_h < time_now_h AS INT) + CAST(time_tight AS INT) AS n FROM rc WHERE NOT needs_escalation) WHERE n > 0 GROUP BY run_id""",
    "pseudonyms_by_salt": f"SELECT DISTINCT tag, 2 AS pseudonyms, {_TAGGED.replace('fixed-salt', 'other-salt').format('tag')} AS by_other, 32 AS salt_letters FROM lens WHERE tag IS NOT NULL",
}

#: A trace and a report that lack some hashes, and each name's trace rows taking records one after the other.
_GREEDY = """,
ga AS MATERIALIZED (SELECT *, CASE WHEN pos % 3 = 0 THEN '' ELSE hash END AS h, row_number() OVER (PARTITION BY run_id, name ORDER BY pos) AS i FROM t WHERE pos % 10 <> 0),
gb AS MATERIALIZED (SELECT *, CASE WHEN pos % 4 = 0 THEN '' ELSE hash END AS h FROM t WHERE pos % 10 <> 1),
gl AS MATERIALIZED (SELECT run_id, name, list({'pos': pos, 'h': h} ORDER BY pos) AS records FROM gb GROUP BY ALL),
gr AS (SELECT DISTINCT run_id, name, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS pick, CAST([] AS BIGINT[]) AS used FROM ga
  UNION ALL SELECT run_id, name, i, pick, CASE WHEN pick IS NULL THEN used ELSE used || [pick] END FROM (
    SELECT gr.run_id, gr.name, ga.i, gr.used, CASE WHEN ga.h = '' THEN list_filter(coalesce(records, []), lambda x: NOT list_contains(gr.used, x.pos))[1].pos
      ELSE coalesce(list_filter(coalesce(records, []), lambda x: x.h = ga.h AND NOT list_contains(gr.used, x.pos))[-1].pos, list_filter(coalesce(records, []), lambda x: x.h = '' AND NOT list_contains(gr.used, x.pos))[1].pos) END AS pick
    FROM gr JOIN ga ON ga.run_id = gr.run_id AND ga.name = gr.name AND ga.i = gr.i + 1 LEFT JOIN gl ON gl.run_id = gr.run_id AND gl.name = gr.name))
"""


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {'RECURSIVE ' if name == 'merge_mixed' else ''}{_BASE}{_GREEDY if name == 'merge_mixed' else ''} {body}" for name, body in BODIES.items()}
