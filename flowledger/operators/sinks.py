"""Outputs of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pricing import Rates


def analysis_json(totals: DataFrame, stats: DataFrame, recs: DataFrame, unsized: DataFrame, runs: DataFrame | None = None, rates: Rates | None = None) -> DataFrame:
    """``(run_id, json)``: a document a run with its rates, header facts, totals, processes, recommendations and processes that weren't sized."""
    rows = lambda df, name, key: df.groupBy(F.col("run_id").alias("_r")).agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in df.columns if c not in ("run_id", key)]))).alias(name))
    out = totals.drop("processes")  # the list takes its place
    for df, name in ((stats, "processes"), (recs, "recommendations"), (unsized, "not_sized")):
        part = rows(df, name, "process")
        out = out.join(part, out["run_id"] == part["_r"], "left").drop("_r")
    if runs is not None:
        meta = runs.select(F.col("run_id").alias("_r"), F.struct(*[c for c in runs.columns if c != "run_id"]).alias("meta"))
        out = out.join(meta, out["run_id"] == meta["_r"], "left").drop("_r")
    if rates is not None:
        out = out.withColumn("rates", F.struct(F.lit(rates.name).alias("name"), F.lit(rates.cpu_hour).alias("cpu_hour"), F.lit(rates.gib_hour).alias("gib_hour")))
    return out.select("run_id", F.to_json(F.struct(*out.columns)).alias("json"))


def write_fragments(fragments: DataFrame, folder: str) -> None:
    """Config fragments as text, a folder a run."""
    fragments.select("run_id", F.col("fragment").alias("value")).write.partitionBy("run_id").mode("errorifexists").text(folder)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet; nothing is overwritten."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
