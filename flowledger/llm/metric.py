"""Exact near-duplicate vectors by a metric range join over pivot cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pivots of a label, labels that get pivots (the largest), different vectors for each pivot, and vectors on either side of a join cell.
MOST_PIVOTS, PIVOT_LABELS, PIVOT_ROWS, BLOCK = 32, 1000, 1024, 2048


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``(label, v, rep, copies, node)`` of the usable different vectors of each label; rep is the smallest id, node a 64-bit hash."""
    x = F.col("v")
    fit = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))
    return rows.where(fit & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("label", "v"))


def _unit(table, name="v") -> np.ndarray:
    """Rows of a list column as unit vectors in double precision (scaled first, so that squares stay finite)."""
    flat = np.array(table.column(name).combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def pivots(vectors: DataFrame) -> dict[tuple, np.ndarray]:
    """Unit pivot vectors of each large label: those of smallest id hash, at most MOST_PIVOTS each."""
    from pyspark.sql import Window

    sizes = vectors.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > 2 * PIVOT_ROWS)
    sizes = sizes.orderBy(F.desc("n"), "label", "dim").limit(PIVOT_LABELS).select(F.col("label").alias("l"), F.col("dim").alias("d"), F.least(F.ceil(F.col("n") / PIVOT_ROWS), F.lit(MOST_PIVOTS)).alias("pivots"))
    first = Window.partitionBy("label", "dim").orderBy("node")
    ranked = vectors.withColumn("r", F.row_number().over(first)).where(F.col("r") <= MOST_PIVOTS)
    chosen = ranked.join(F.broadcast(sizes), (ranked["label"] == sizes["l"]) & (ranked["dim"] == sizes["d"]) & (ranked["r"] <= sizes["pivots"])).select("label", "dim", "v", "r").collect()
    out: dict[tuple, list] = {}
    for row in sorted(chosen, key=lambda r: r["r"]):
        v = np.array(row["v"], np.float64)
        v = v / np.abs(v).max()
        out.setdefault((row["label"], row["dim"]), []).append(v / np.sqrt(v @ v))
    return {k: np.array(v) for k, v in out.items()}


def near_vectors(df: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row, one row each.

    Two rows link when their labels are equal and not null and the cosine of their vectors, in
    double precision, is at least ``threshold`` (in (0, 1]). ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, and ``kept`` marks the row that has it. Vectors that are null, empty or zero,
    hold null or non-finite components, or have a null id link with nothing; vectors of different lengths never link.
    Equal vectors of a label are compared once. An empty table gives no rows.

    Unit vectors at cosine c lie sqrt(2 - 2c) apart. Each goes to the cell of its nearest pivot and also to every cell
    that the triangle inequality can't rule out; a cell is joined on its own, in blocks of bounded size.
    """
    rows = common.only(df, vec_id=vec_id, v=vector, label=label)
    vectors = common.checkpoint(distinct_vectors(rows).withColumn("dim", F.size("v")))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-7
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in vectors.columns}
    held = df.sparkSession.sparkContext.broadcast(pivots(vectors))  # at most PIVOT_LABELS * MOST_PIVOTS vectors

    def distances(label, dim, unit):
        own = held.value.get((label, dim))
        if own is None:
            return None, np.zeros((len(unit), 1))
        return own, np.sqrt(np.maximum(0.0, 2 - 2 * unit @ own.T))

    def by_label(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(table.column("label").to_pylist(), table.column("dim").to_pylist(), strict=True))
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                groups.setdefault(k, []).append(i)
            for k, at in groups.items():
                part = table.take(at)
                yield k, part, _unit(part)

    def reach(batches):
        for (name, dim), part, unit in by_label(batches):
            _, d = distances(name, dim, unit)
            home = d.argmin(axis=1)
            for p in np.unique(home).tolist():
                yield pa.RecordBatch.from_arrays([part.column("label").combine_chunks()[:1], pa.array([dim], pa.int32()), pa.array([p], pa.int32()), pa.array([float(d[home == p, p].max())])], ["label", "dim", "pivot", "far"])

    far = vectors.mapInArrow(reach, f"label {kinds['label']}, dim int, pivot int, far double").groupBy("label", "dim", "pivot").agg(F.max("far").alias("far"))
    if held.value:
        covered = {(r["label"], r["dim"], r["pivot"]): r["far"] for r in far.where(F.col("pivot") >= 0).join(F.broadcast(df.sparkSession.createDataFrame([k for k in held.value], f"l {kinds['label']}, d int")), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))).collect()}  # a number for each pivot
    else:
        covered = {}

    def place(batches):
        for (name, dim), part, unit in by_label(batches):
            own, d = distances(name, dim, unit)
            home = d.argmin(axis=1)
            inside = np.zeros(d.shape, bool)
            if own is not None:
                near = d[np.arange(len(d)), home]
                limit = np.array([covered.get((name, dim, p), -np.inf) for p in range(len(own))])
                inside = (d <= near[:, None] + 2 * radius) & (d <= limit + radius)
                # Distance to the plane between two pivots, where the pivots differ.
                between = np.sqrt(np.maximum(0.0, 2 - 2 * own @ own.T))[home]
                with np.errstate(divide="ignore", invalid="ignore"):
                    inside &= ~((d * d - (near * near)[:, None]) / (2 * between) > radius)
            inside[np.arange(len(d)), home] = True
            at, pivot = np.nonzero(inside)
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(pa.array(at)).combine_chunks() for c in ("label", "dim", "node", "copies", "v")] + [pa.array(pivot.astype(np.int32)), pa.array(pivot == home[at])],
                ["label", "dim", "node", "copies", "v", "pivot", "home"],
            )

    placed = common.checkpoint(vectors.select("label", "dim", "node", "copies", "v").mapInArrow(place, f"label {kinds['label']}, dim int, node long, copies long, v {kinds['v']}, pivot int, home boolean"))
    cell = ["label", "dim", "pivot"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count_if("home") / BLOCK).alias("lefts"), F.ceil(F.count("*") / BLOCK).alias("rights"))
    sized = placed.join(sizes.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("pivot").alias("p"), "lefts", "rights"), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("pivot") == F.col("p")))
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    wanted = [*cell, "a", "b", "node", "copies", "v"]
    left = sized.where("home").withColumn("a", block(F.col("lefts"))).withColumn("b", each(F.col("rights"))).select(*wanted).toDF(*wanted)
    right = sized.where("lefts > 0").withColumn("b", block(F.col("rights"))).withColumn("a", each(F.col("lefts"))).select(*wanted).toDF(*[f"other_{c}" for c in wanted])

    def join(key, own, others):
        node, links, root = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if own.num_rows and others.num_rows:
            u, w = _unit(own), _unit(others, "other_v")
            i, j, copies = np.array(own.column("node")), np.array(others.column("other_node")), np.array(others.column("other_copies"))
            names, number = np.unique(np.concatenate([i, j]), return_inverse=True)
            low, high = number[: len(i)], number[len(i) :]
            best = np.arange(len(names))
            count = np.zeros(len(i), np.int64)
            pairs = []
            for a in range(0, len(i), 256):
                close = u[a : a + 256] @ w.T >= threshold
                close &= i[a : a + 256, None] != j[None, :]
                count[a : a + 256] = close @ copies
                x, y = np.nonzero(close)
                pairs.append(np.stack([low[a + x], high[y]]).astype(np.int32))
            x, y = np.concatenate(pairs, axis=1)
            while True:  # least number reachable, by passing it on and jumping
                least = np.minimum(best[x], best[y])
                new = best.copy()
                np.minimum.at(new, x, least)
                np.minimum.at(new, y, least)
                np.minimum.at(new, best[x], least)
                np.minimum.at(new, best[y], least)
                new = new[new]
                if (new == best).all():
                    break
                best = new
            met = np.zeros(len(names), bool)
            met[x], met[y] = True, True
            total = np.zeros(len(names), np.int64)
            total[low] = count
            at = np.flatnonzero(met)
            node, links, root = [names[at]], [total[at]], [names[best[at]]]
        return pa.table({"node": pa.array(np.concatenate(node)), "links": pa.array(np.concatenate(links)), "root": pa.array(np.concatenate(root))})

    keys = [*cell, "a", "b"]
    found = common.checkpoint(left.groupBy(*keys).cogroup(right.groupBy(*[f"other_{c}" for c in keys])).applyInArrow(join, "node long, links long, root long"))
    links = found.groupBy(F.col("node").alias("n")).agg(F.sum("links").alias("links"))
    roots = common.connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("m"), "component")
    classes = vectors.join(links, vectors["node"] == links["n"], "left").join(roots, vectors["node"] == roots["m"], "left")
    classes = common.checkpoint(classes.select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "rep", F.coalesce("component", "node").alias("component")))
    least = classes.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("least"))
    classes = classes.join(least, classes["component"] == least["c"]).select(F.col("label").alias("l"), F.col("v").alias("w"), "links", "least")
    joined = rows.join(classes, (rows["label"] == classes["l"]) & (rows["v"] == classes["w"]) & rows["vec_id"].isNotNull(), "left")
    component = F.coalesce("least", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
