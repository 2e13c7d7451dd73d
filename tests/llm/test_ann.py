import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import ann, queries, sql
from tests.conftest import SMALL


def brute(rows, k, every):
    """(query, rank, id, score) over clean (id, vector) rows."""
    out = []
    for q, x in rows:
        if q % every:
            continue
        scored = sorted((-ann.products(x[None, :], y[None, :])[0], i) for i, y in rows if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"vec_id long, embedding array<{kind}>")


def found(search, every, **options):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in search.nearest(F.col("vec_id") % every == 0, **options).collect())


def test_hilbert_curve_visits_all_cells_in_steps_of_one():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)), np.uint64)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)].astype(int)
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("block", [7, 100_000])
def test_complete_search_is_exact(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 12)).astype(np.float32) * rng.uniform(0.1, 3, (600, 1)).astype(np.float32)
    x[100:180] = x[100]  # equal vectors: ties go to smaller ids
    rows = [(i, v) for i, v in enumerate(x.astype(float))]
    search = ann.Search(table(spark, rows).repartition(3), k=20)
    assert found(search, 20, block=block) == brute(rows, 20, 20)


def test_windows_alone_find_near_neighbours(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 32))
    x = np.repeat(centers, 25, axis=0) + 0.05 * rng.normal(size=(1000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.astype(float))]
    got = found(ann.Search(table(spark, rows), k=20), 20, complete=False)
    want = {(q, i) for q, _, i, _ in brute(rows, 20, 20)}
    assert len(want & {(q, i) for q, _, i, _ in got}) >= 0.9 * len(want)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, None), (2, [0, 0]), (3, [nan, 1]), (4, [inf, 1]), (5, [1, None]), (6, []), (7, [1]), (20, [1, 1]), (20, [1, 1]), (21, [1, 0]), (22, [-1, 0]), (None, [1, 1]), (40, [0, 2])]
    given = table(spark, rows).withColumn("v", F.lit("clash")).withColumn("score", F.lit(1))
    clean = [(i, np.array(v, float)) for i, v in [(0, [1, 0]), (20, [1, 1]), (21, [1, 0]), (22, [-1, 0]), (40, [0, 2])]]
    assert found(ann.Search(given, k=3), 20) == brute(clean, 3, 20)  # 7 is alone in its dimension
    assert found(ann.Search(given, k=50), 20) == brute(clean, 50, 20)
    assert found(ann.Search(given.where("vec_id > 99"), k=3), 20) == [] and found(ann.Search(given.where("vec_id = 1"), k=3), 1) == []
    assert found(ann.Search(given.where("vec_id = 0"), k=3), 20) == []


def test_query(spark, same_as_sql):
    same_as_sql(queries.op3_neighbours(spark, SMALL), sql.OP3)


def test_each_dimension_is_searched(spark):
    rows = [(0, [1, 0]), (1, [1, 1]), (2, [3, 1]), (20, [1, 1, 1]), (21, [1, 0, 2]), (40, [1, 0, 0])]
    by_dim = [[(i, np.array(v, float)) for i, v in rows if len(v) == d] for d in (2, 3)]
    assert found(ann.Search(table(spark, rows), k=2), 20) == sorted(brute(by_dim[0], 2, 20) + brute(by_dim[1], 2, 20))


def test_tiny_and_huge_components(spark):
    rows = [(0, [1e-200, 0]), (1, [1e200, 1e200]), (2, [-1e200, 5e-324]), (20, [1e100, -1e-150]), (3, [1, 1]), (40, [5e-324, 1e-300])]
    clean = [(i, np.array(v)) for i, v in rows]
    assert found(ann.Search(table(spark, rows, "double"), k=4), 20) == brute(clean, 4, 20)


def test_an_id_with_several_vectors_is_one_candidate(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), x) for i, x in zip(rng.integers(0, 60, 200), rng.normal(size=(200, 5)), strict=True)]
    rows += [(100 + i, rows[0][1]) for i in range(50)]
    best = {}
    for q, x in rows:
        for i, y in rows:
            if q % 20 == 0 and q != i:
                best[q, i] = max(best.get((q, i), -np.inf), ann.products(x[None, :], y[None, :])[0])
    want = []
    for q in sorted({q for q, _ in best}):
        ranked = sorted((-s, i) for (p, i), s in best.items() if p == q)[:7]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    assert found(ann.Search(table(spark, rows, "double").repartition(4), k=7), 20, block=3) == want


def test_a_vector_that_most_rows_share(spark):
    rows = spark.range(100_000).selectExpr("id AS vec_id", "IF(id % 3 < 2, array(1.0D, 2.0D), array(CAST(id AS DOUBLE) / 1e5, 1.0D)) AS embedding")
    got = found(ann.Search(rows, k=3), 25_000)
    ids, x = np.arange(100_000), np.array([[1.0, 2.0] if i % 3 < 2 else [i / 1e5, 1.0] for i in range(100_000)])
    want = []
    for q in range(0, 100_000, 25_000):
        s = ann.products(np.repeat(x[q : q + 1], len(x), axis=0), x)
        order = [i for i in np.lexsort((ids, -s)).tolist() if i != q][:3]
        want += [(q, r, i, s[i]) for r, i in enumerate(order, 1)]
    assert got == want
    plan = ann.Search(rows, k=3).kinds[0].candidates._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "collect_" not in plan


def test_windows_go_over_the_borders_of_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    rows = table(spark, [(i, v) for i, v in enumerate(x)], "double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = found(ann.Search(rows, k=5, window=40), 20, complete=False)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert split == found(ann.Search(rows, k=5, window=40), 20, complete=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
