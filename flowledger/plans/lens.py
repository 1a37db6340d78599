"""The task lens: the given order tables seen as the tasks of seven workflow runs, in whole units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs unchanged on Spark and DuckDB; the braces are a task's place in its run and the joined tables.
LENS = """
SELECT 'run' || CAST(year(o_orderdate) - 1995 AS STRING) AS run_id,
  CASE WHEN year(o_orderdate) = 1998 THEN 'master' ELSE '3.' || CAST((year(o_orderdate) - 1995) * 4 AS STRING) || '.0' END AS revision,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_date,
  CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS hash,
  '' AS task_id,
  'PIPE:' || p_type || ':' || CASE WHEN p_size <= 10 THEN p_type || '_ALIGN' ELSE p_brand END AS process,
  'PIPE:' || p_type || ':' || CASE WHEN p_size <= 10 THEN p_type || '_ALIGN' ELSE p_brand END || ' (' || CASE WHEN l_returnflag = 'N' THEN '1' ELSE 'S' || CAST(l_suppkey % 8 AS STRING) END || ')' AS name,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'S' || CAST(l_suppkey % 8 AS STRING) END AS tag,
  CASE WHEN l_linestatus = 'F' AND l_discount > 0.085 THEN 'FAILED' WHEN o_orderstatus = 'P' AND l_tax > 0.075 THEN 'ABORTED'
       WHEN o_orderpriority = '5-LOW' AND l_linenumber = 1 THEN 'CACHED' ELSE 'COMPLETED' END AS status,
  CAST(CASE WHEN l_linestatus = 'F' AND l_discount > 0.085 THEN CASE WHEN p_brand LIKE 'Brand#1%' AND l_linenumber % 3 = 0 THEN 137 WHEN l_linenumber % 3 = 1 THEN NULL ELSE 1 END
            WHEN o_orderstatus = 'P' AND l_tax > 0.075 THEN NULL ELSE 0 END AS BIGINT) AS exit,
  CAST(CASE WHEN l_linenumber >= 6 THEN 2 ELSE 1 END AS INT) AS attempt,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS realtime_ms,
  CAST(CASE WHEN p_type LIKE '%PROMO%' OR p_type LIKE '%LARGE%' THEN 10800000 ELSE 28800000 END AS BIGINT) AS time_ms,
  CAST(CASE WHEN p_size % 7 = 0 THEN NULL ELSE 2 * (1 + p_size % 6) * CASE WHEN p_type LIKE '%SMALL%' AND l_linenumber >= 6 THEN 2 ELSE 1 END * 100000 END AS BIGINT) AS cpus_units,
  CAST(CASE WHEN p_size % 11 = 0 THEN NULL ELSE 1024 * (2 + p_size % 8) * CASE WHEN p_type LIKE '%SMALL%' AND l_linenumber >= 6 THEN 2 ELSE 1 END * 1024 END AS BIGINT) AS memory_kib,
  CAST(CASE WHEN l_quantity = 13 OR (p_type LIKE '%ECONOMY%' AND p_brand LIKE 'Brand#2%' AND l_linenumber <= 5) THEN NULL ELSE l_quantity * 2000 END AS BIGINT) AS pct_cpu_units,
  CAST(CASE WHEN l_quantity IN (13, 29) THEN NULL ELSE round(l_extendedprice * 20) END AS BIGINT) AS peak_rss_kib,
  CAST({place} AS BIGINT) AS pos
FROM {rows}
"""


PLACE = "row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_orderkey, l_linenumber, l_quantity)"
#: What of PLACE tells rows of one order and line apart: their order where no places are asked for.
LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
JOINED = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey"
#: Rows that a task sorts at once; tables of more than FEW_TASKS times as many are dealt to so many tasks.
ROWS_A_TASK, FEW_TASKS = 500_000, 16
#: Up to so many parts Spark deals rows as they come; into more it first sorts a task's whole share of a file in memory (``spark.shuffle.sort.bypassMergeThreshold``).
UNSORTED_PARTS = 200
#: Where tables are dealt, a ``part`` table of up to so many rows goes to every task; a larger one is dealt too.
SENT_ROWS = 100_000


def tasks_for(spark: SparkSession, sf_dir: str) -> int | None:
    """Into how many parts the lens's rows are dealt by windows; None leaves it to Spark (small tables). More than UNSORTED_PARTS only where a part would hold over 4 * ROWS_A_TASK."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    parts = max(min(rows // ROWS_A_TASK, UNSORTED_PARTS), rows // (4 * ROWS_A_TASK))
    return parts if parts > FEW_TASKS else None


def _joined(lineitem: DataFrame, orders: DataFrame, part: DataFrame, parts: int | None) -> DataFrame:
    """JOINED. Large tables are dealt to ``parts`` for each join, so that what a task sorts doesn't grow with them; only a ``part`` table of SENT_ROWS or fewer goes to every task."""
    if parts:
        lineitem, orders = lineitem.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if parts and part.count() <= SENT_ROWS:
        part = F.broadcast(part)
    elif parts:
        rows, part = rows.repartition(parts, "l_partkey"), part.repartition(parts, "p_partkey")
    return rows.join(part, F.col("l_partkey") == F.col("p_partkey"))


def _placed(rows: DataFrame, parts: int | None) -> DataFrame:
    """``rows`` with ``l_place``, the number that PLACE gives, without ordering a year in one task: rows are numbered inside a ship date, and the dates before it are counted."""
    year, date = F.year("o_orderdate"), F.col("l_shipdate").asc_nulls_last()
    days = rows.groupBy(year.alias("_year"), F.col("l_shipdate").alias("_date")).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_year").orderBy(F.col("_date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_year", "_date", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    keyed = rows.withColumn("l_year", year)
    if parts:
        keyed = keyed.repartition(parts, "l_year", "l_shipdate")
    rest = [F.col(c).asc_nulls_last() for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_quantity")]
    numbered = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("l_year", "l_shipdate").orderBy(*rest)))
    joined = numbered.join(F.broadcast(days), F.col("l_year").eqNullSafe(F.col("_year")) & F.col("l_shipdate").eqNullSafe(F.col("_date")))
    return joined.withColumn("l_place", F.col("_before") + F.col("_n"))


def attempts(spark: SparkSession, sf_dir: str, places: bool = True) -> DataFrame:
    """All task rows, repeats of a hash included; without ``places`` their ``pos`` is null, and LINE_ORDER's columns are there to order the repeats of a hash."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = tasks_for(spark, sf_dir)
    rows = _joined(read("lineitem"), read("orders"), read("part"), parts)
    if places:
        rows = _placed(rows, parts)
        return spark.sql(LENS.replace("{place}", "l_place"), rows=rows)
    return spark.sql(LENS.replace("CAST({place} AS BIGINT) AS pos", f"CAST(NULL AS BIGINT) AS pos, {', '.join(LINE_ORDER)}"), rows=rows)


def sql() -> str:
    return LENS.format(place=PLACE, rows=JOINED.format(lineitem="lineitem", orders="orders", part="part"))
