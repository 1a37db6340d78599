"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

DataFrame functions only. Statistics are whole numbers, and the transformed vectors are whole hundredths, so that all sums are exact
and estimates don't depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Blanks of the word rule, and the characters that count as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Fixed-point steps of a transformed statistic to a unit.
STEPS = 200
#: Least spread (in units) of each transformed statistic: smaller differences are never held against a text.
#: They stand for ln of the mean word length, ln(1 + symbols a word), and the roots of repeated lines and of repeated words to a word.
#: A table with a bar after every second or third word stays within the second.
FLOORS = (0.06, 0.15, 0.1, 0.12)
P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Share of a group that the estimate is of, texts that a group needs for one of its own, and chance of a rejection under normality.
SHARE, LEAST_GROUP, ALPHA = 0.75, 50, 1e-6
#: Distances are counted in bins of a 16th of an octave.
BINS, LOW_BIN, HIGH_BIN = 16, -160, 480
MOST_STEPS, SETTLED = 20, 1e-3
#: Estimates are broadcast up to so many rows (some 300 bytes each), and joined by shuffle beyond.
BROADCAST_GROUPS = 20_000


def _words(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"[\x20\x09-\x0D]+", -1))


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``keep`` of every row and its statistics BASE (long); a null text counts as an empty one.

    Windows of three words are told apart by 64-bit hashes inside their text. A text's words are held in one row: some 200 bytes a word.
    """
    rows = docs.select(*[docs[c].alias(c) for c in keep], F.coalesce(docs[text], F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    split = rows.select(*keep, _words(F.btrim("t", F.lit(BLANKS))).alias("words"), (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"), lines.alias("lines"))
    counted = split.select(*keep, "n_symbols", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                           F.when(F.size("words") > 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("windows"))
    ordered = counted.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("windows")
    same = lambda x, y: x["h"].eqNullSafe(y["h"])
    starts = F.sort_array(F.transform(F.filter("ordered", lambda x, i: same(x, F.get("ordered", i - 1)) | same(x, F.get("ordered", i + 1))), lambda x: x["i"]))
    found = ordered.withColumn("starts", starts).drop("ordered")
    covered = F.aggregate(F.transform("starts", lambda s, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - s, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).select(*keep, *[F.col(c).cast("long").alias(c) for c in BASE])


def failed() -> Column:
    """The base rule: fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics ``x0, x1, ...`` in whole steps."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    units = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(x * STEPS).cast("long").alias(f"x{i}") for i, x in enumerate(units)]


def _below(x: float, k: int) -> float:
    """Chance that a chi-squared value of ``k`` degrees (even) is below ``x``."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def quantile(share: float, k: int = P) -> float:
    """The value below which a chi-squared value of ``k`` degrees (even) lies with chance ``share``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _below(middle, k) < share else (low, middle)
    return high


#: Makes the scatter of the closest SHARE of normal vectors that of all of them.
CONSISTENCY = SHARE / _below(quantile(SHARE), P + 2)


def _joined(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``few`` (a row a key), which is broadcast only below a checked size."""
    few = few.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in few.columns if c not in keys])
    on = [rows[k].eqNullSafe(few[f"_{k}"]) for k in keys]
    found = rows.join(F.broadcast(few) if few.count() <= BROADCAST_GROUPS else few, on, "left")
    return found.drop(*[f"_{k}" for k in keys])


def _inverted(df: DataFrame) -> DataFrame:
    """From scatters ``s{i}{j}`` (j <= i) the precisions ``p{i}{j}`` and ``logdet``, by Cholesky factors; FLOORS widen the diagonal."""
    wide = {(i, j): F.col(f"s{i}{j}") + (F.lit((FLOORS[i] * STEPS) ** 2) if i == j else F.lit(0.0)) for i, j in PAIRS}
    for j in range(P):
        for i in range(j, P):
            rest = wide[i, j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(P):
        for i in range(j, P):
            if i == j:
                df = df.withColumn(f"v{i}{j}", 1 / F.col(f"l{i}{i}"))
                continue
            total = F.lit(0.0)
            for k in range(j, i):
                total = total + F.col(f"l{i}{k}") * F.col(f"v{k}{j}")
            df = df.withColumn(f"v{i}{j}", -total / F.col(f"l{i}{i}"))
    out = [sum((F.col(f"v{k}{i}") * F.col(f"v{k}{j}") for k in range(i + 1, P)), F.col(f"v{i}{i}") * F.col(f"v{i}{j}")).alias(f"p{i}{j}") for i, j in PAIRS]
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, P)), 2 * F.log("l00"))
    kept = [c for c in df.columns if c[0] not in "lvs" or c in ("level", "lang", "source", "start")]
    return df.select(*kept, *out, logdet.alias("logdet"))


def distance() -> Column:
    """Squared Mahalanobis distance of ``x0, ...`` by the means ``m0, ...`` and precisions of the same row."""
    u = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    terms = [u[i] * u[j] * F.col(f"p{i}{j}") * (1 if i == j else 2) for i, j in PAIRS]
    return sum(terms[1:], terms[0])


KEY = ["level", "lang", "source"]


def _levels(cells: DataFrame) -> DataFrame:
    """Each cell once for its language and source, once for its language and once for all."""
    none = F.lit(None).cast("string")
    return cells.select(
        F.explode(F.array(F.struct(F.lit(0).alias("level"), "lang", "source"), F.struct(F.lit(1).alias("level"), "lang", none.alias("source")), F.struct(F.lit(2).alias("level"), none.alias("lang"), none.alias("source")))).alias("k"),
        "m", *[f"x{i}" for i in range(P)],
    ).select("k.*", "m", *[f"x{i}" for i in range(P)])


def _middles(cells: DataFrame, value: Column) -> DataFrame:
    """``(KEY, i, middle)``: the weighted lower median of each coordinate; a group has a bounded number of values."""
    long = cells.select(*KEY, "m", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value(i).alias("x")) for i in range(P)])).alias("c")).select(*KEY, "m", "c.*")
    counts = long.groupBy(*KEY, "i", "x").agg(F.sum("m").alias("n"))
    group = Window.partitionBy(*KEY, "i")
    upto = counts.withColumn("upto", F.sum("n").over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(group))
    found = upto.where(2 * F.col("upto") >= F.col("all")).groupBy(*KEY, "i").agg(F.min("x").alias("middle"))
    return found.groupBy(*KEY).agg(*[F.max(F.when(F.col("i") == i, F.col("middle"))).alias(f"middle{i}") for i in range(P)])


def _starts(cells: DataFrame) -> DataFrame:
    """Three robust first estimates a group: by medians and absolute deviations alone, by spatial signs and by bounded scores."""
    centre = common.checkpoint(_middles(cells, lambda i: F.col(f"x{i}")))
    moved = _joined(cells, centre, KEY)
    spread = _middles(moved.select(*KEY, "m", *[F.abs(F.col(f"x{i}") - F.col(f"middle{i}")).alias(f"x{i}") for i in range(P)]), lambda i: F.col(f"x{i}"))
    spread = spread.select(*KEY, *[F.greatest(1.4826 * F.col(f"middle{i}"), F.lit(FLOORS[i] * STEPS)).alias(f"d{i}") for i in range(P)])
    both = common.checkpoint(_joined(centre, spread, KEY))
    z = _joined(cells, both, KEY).select(*KEY, "m", *[((F.col(f"x{i}") - F.col(f"middle{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i in range(P)])
    norm = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0"))), F.lit(1e-9))
    scored = z.select(*KEY, "m", *[F.round(1000 * F.col(f"z{i}") / norm).cast("long").alias(f"a{i}") for i in range(P)], *[F.round(1000 * F.tanh(f"z{i}")).cast("long").alias(f"b{i}") for i in range(P)])
    sums = scored.groupBy(*KEY).agg(F.sum("m").alias("n"), *[F.sum(F.col("m") * F.col(f"{c}{i}") * F.col(f"{c}{j}")).alias(f"{c}{i}{j}") for c in "ab" for i, j in PAIRS])
    known = common.checkpoint(_joined(both, sums, KEY))
    scale = {"a": P, "b": 2.5}
    kinds = []
    for start, c in enumerate(["", "a", "b"]):
        of = {(i, j): (F.col(f"{c}{i}{j}") / F.col("n") * (scale[c] / 1e6) if c else F.lit(1.0 if i == j else 0.0)) * F.col(f"d{i}") * F.col(f"d{j}") for i, j in PAIRS}
        kinds.append(known.select(*KEY, F.lit(start).alias("start"), *[F.col(f"middle{i}").cast("double").alias(f"m{i}") for i in range(P)], *[of[i, j].alias(f"s{i}{j}") for i, j in PAIRS]))
    return common.checkpoint(_inverted(kinds[0].union(kinds[1]).union(kinds[2])))


def _concentrated(cells: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step: means and scatters of each group's closest SHARE under ``now``.

    Distances are counted by bin with the sums of their cells, so a group needs no sorting; of the last bin the share that is missing counts.
    """
    octave = F.floor(BINS * F.log2(F.greatest(distance(), F.lit(2.0**-11))))
    binned = _joined_starts(cells, now).withColumn("bin", F.least(F.greatest(octave, F.lit(LOW_BIN)), F.lit(HIGH_BIN)).cast("int"))
    x = [F.col(f"x{i}") for i in range(P)]
    sums = binned.groupBy(*KEY, "start", "bin").agg(F.sum("m").alias("n"), *[F.sum(F.col("m") * x[i]).alias(f"t{i}") for i in range(P)], *[F.sum(F.col("m") * x[i] * x[j]).alias(f"t{i}{j}") for i, j in PAIRS])
    group = Window.partitionBy(*KEY, "start")
    ranked = sums.withColumn("before", F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("h", F.ceil(F.sum("n").over(group) * SHARE))
    weight = F.greatest(F.least((F.col("h") - F.col("before")) / F.col("n"), F.lit(1.0)), F.lit(0.0))
    total = ranked.groupBy(*KEY, "start").agg(*[(F.sum(weight * F.col(f"t{i}")) / F.max("h")).alias(f"m{i}") for i in range(P)], *[(F.sum(weight * F.col(f"t{i}{j}")) / F.max("h")).alias(f"q{i}{j}") for i, j in PAIRS])
    scatter = total.select(*KEY, "start", *[f"m{i}" for i in range(P)], *[(CONSISTENCY * (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"s{i}{j}") for i, j in PAIRS])
    return common.checkpoint(_inverted(scatter))


def _joined_starts(cells: DataFrame, now: DataFrame) -> DataFrame:
    return _joined(cells.select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("start")), now, [*KEY, "start"])


def estimates(vectors: DataFrame) -> DataFrame:
    """Robust estimates of ``vectors(lang, source, x0, ...)`` by group: ``level`` 0 is a language and source, 1 a language, 2 all.

    Columns: the group, ``texts`` in it, means ``m0, ...``, precisions ``p00, ...`` and ``logdet``. From three robust starts concentration steps
    follow until no determinant changes; the least determinant of the three is taken. Null languages and sources are groups of their own.
    """
    cells = common.checkpoint(vectors.groupBy("lang", "source", *[f"x{i}" for i in range(P)]).agg(F.count("*").alias("m")))
    spread = _levels(cells)
    now = _starts(spread)
    for _ in range(MOST_STEPS):
        after = _concentrated(spread, now)
        pairs = _joined(after.select(*KEY, "start", F.col("logdet").alias("new")), now.select(*KEY, "start", "logdet"), [*KEY, "start"])
        moved = pairs.agg(F.max(F.abs(F.col("new") - F.col("logdet")))).first()[0]
        now = after
        if moved is None or moved < SETTLED:
            break
    best = now.groupBy(*KEY).agg(F.min_by(F.struct(*[c for c in now.columns if c not in (*KEY, "start")]), F.struct("logdet", "start")).alias("e")).select(*KEY, "e.*")
    return _joined(best, spread.groupBy(*KEY).agg(F.sum("m").alias("texts")), KEY)


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, BASE, ``base_failed``, ``kept``, ``distance`` and ``level`` of every row of ``docs(doc_id, text, lang, source)``.

    Texts that pass the base rule are judged by the estimate of their language and source, of their language where that group has fewer than
    LEAST_GROUP such texts, or of all where the language has fewer too; with fewer in all they are kept. Kept are those whose squared distance
    isn't over the chi-squared value of ALPHA. Null texts are empty; repeated rows count each; rows of an empty table give none.
    """
    stats = common.checkpoint(text_statistics(docs).withColumn("base_failed", failed()).select("*", *vector()))
    found = common.checkpoint(estimates(stats.where(~F.col("base_failed"))).where(F.col("texts") >= LEAST_GROUP))
    numbers = [c for c in found.columns if c not in (*KEY, "texts")]
    groups = stats.select("lang", "source").distinct()
    for level, keys in ((0, ["lang", "source"]), (1, ["lang"]), (2, [])):
        own = found.where(F.col("level") == level).select(*keys, F.struct("level", *numbers).alias(f"e{level}"))
        groups = _joined(groups, own, keys) if keys else groups.join(own, how="left")
    chosen = common.checkpoint(groups.select("lang", "source", F.coalesce("e0", "e1", "e2").alias("e")).select("lang", "source", "e.*"))
    judged = _joined(stats, chosen, ["lang", "source"]).withColumn("distance", F.when(~F.col("base_failed"), distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= quantile(1 - ALPHA), F.lit(True))
    return judged.select("doc_id", *BASE, "base_failed", kept.alias("kept"), "distance", "level")
