import duckdb
import numpy as np
import pytest

from flowledger.llm import metric, queries, topk


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, shard string")


def brute_top(rows, k):
    data = {i: np.floor(256 * np.array(v, np.float64)) for i, v, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, v in data.items():
        if q % 50 == 0:
            best = sorted(((-int(v @ w), i) for i, w in data.items() if i != q and len(w) == len(v)))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("shard", [64, 2048])
def test_top_k_is_exact_over_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 20] + (i % 3) * 0.01 * rng.normal(size=8)], i % 4, "n", "s") for i in range(400)]
    rows += [(400, None, 1, "n", "s"), (450, [1.0, None] + [1.0] * 6, 1, "n", "s"), (401, [float("nan")] * 8, 1, "n", "s"), (500, [0.0] * 8, 1, "n", "s")]
    df = table(spark, rows)
    got = {tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows, 5)


def test_top_k_of_few_rows_and_none(spark):
    df = table(spark, [(0, [1.0, 0.0], 0, "n", "s"), (1, [0.5, 0.0], 0, "n", "s")])
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def brute_near(rows, least):
    ok = [(i, np.array(v, np.float64), lab) for i, v, lab, *_ in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, *_ in rows}
    for a, (i, v, x) in enumerate(ok):
        for j, w, y in ok[a + 1 :]:
            if x == y and len(v) == len(w) and v @ w >= least * np.sqrt(v @ v) * np.sqrt(w @ w):
                links[i].add(j)
                links[j].add(i)
    out = set()
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.add((i, len(links[i]), min(seen), min(seen) == i))
    return out


@pytest.mark.parametrize("rows_a_pivot", [16, 1024])
def test_near_vectors_match_brute_force(spark, monkeypatch, rows_a_pivot):
    monkeypatch.setattr(metric, "PIVOT_ROWS", rows_a_pivot)
    monkeypatch.setattr(metric, "BLOCK", 32)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[rng.integers(25)] + rng.choice([0, 0.1, 0.25]) * rng.normal(size=16)], int(rng.integers(2)) if i % 3 else 0, "n", "s") for i in range(300)]
    rows += [(300 + i, rows[0][1], 0, "n", "s") for i in range(20)]
    rows += [(400, None, 0, "n", "s"), (401, [0.0] * 16, 0, "n", "s"), (402, rows[0][1], None, "n", "s"), (403, rows[0][1][:8], 0, "n", "s"), (404, [None] + rows[0][1][1:], 0, "n", "s"), (405, [], 0, "n", "s")]
    got = {tuple(r) for r in metric.near_vectors(table(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect()}
    assert got == brute_near(rows, 0.93)


def test_near_vectors_of_nothing(spark):
    assert metric.near_vectors(table(spark, [(0, [1.0], 0, "n", "s")]).limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [1e30, 1.0], 0, "n", "s"), (50, [1e13, -3e12], 0, "n", "s"), (1, [1e30, -1.0], 0, "n", "s"), (2, [3e12, 1e13], 0, "n", "s"), (3, [0.5, 0.25], 0, "n", "s"), (4, [-1e30, 0.0], 0, "n", "s")]
    rows = [(i, [float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]
    df = table(spark, rows)
    got = {tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    whole = {i: [int(np.floor(256 * np.float64(x))) for x in v] for i, v, *_ in rows}
    want = set()
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in whole.items() if i != q)[:5]
        want |= {(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best, 1)}
    assert {(q, i, s) for q, _, i, s in got} == {(q, i, s) for q, _, i, s in want}


def test_top_k_takes_repeated_rows_and_other_lengths_as_its_sql(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    rng = np.random.default_rng(5)
    vector = lambda n: [float(np.float32(x)) for x in rng.normal(size=n)]
    rows = [(i, vector(8 if i % 3 else 3 + i % 7), 0, "n", "s") for i in range(-100, 200)]
    rows += [(7, rows[107][1], 0, "n", "s")] * 3 + [(7, vector(8), 0, "n", "s"), (50, vector(8), 0, "n", "s"), rows[200], (300, [], 0, "n", "s"), (None, vector(8), 0, "n", "s"), (350, [float("inf")] * 8, 0, "n", "s")]
    df = table(spark, rows)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    got = topk.top_k(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.OP1_SQL).fetchall())
