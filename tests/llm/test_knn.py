"""Operator 1 against brute force."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeaudit.llm.knn import _part, knn_join

KIND = "vec_id long, embedding array<double>"


def brute(rows, k):
    data = [(i, [max(-(1 << 62), min(1 << 62, math.floor(1024 * x) if abs(1024 * x) < 1e300 else int(math.copysign(1 << 62, x)))) for x in v])
            for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in data if i % 100 == 0}:
        v = min(u for i, u in data if i == q)
        s = sorted((-max(1 - (1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, x)))), i) for i, x in data if i != q)
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])]
    return sorted(out)


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    return sorted(tuple(r) for r in knn_join(df, F.col("vec_id") % 100 == 0, **kw).collect())


def clustered(n, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(5, 6)) * 4
    return [(int(i), (centre[i % 5] * r.choice([0.2, 1.0, 3.0]) + r.normal(size=6) * 0.05).tolist()) for i in r.permutation(n)]


@pytest.mark.parametrize("pack_rows", [64, 2048])
def test_clusters(spark, pack_rows):
    rows = clustered(1500, 1)
    assert result(spark, rows, pack_rows=pack_rows, query_rows=4) == brute(rows, 10)


def test_ties_repeats_and_bad_values(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(230)] + [(100, [5.0, 1.0]), (100, [0.0, 0.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0])]
    rows += [(None, [9.0, 9.0]), (300, None), (301, [None, 1.0]), (302, [float("nan"), 1.0]), (303, [float("inf"), 1.0]),
             (400, []), (401, [2.0]), (402, [1.0, 1.0, 1.0])]
    assert result(spark, rows, k=5) == brute(rows, 5)


def test_all_rows_are_copies(spark):
    rows = [(i, [0.5, -0.25]) for i in range(400)]
    assert result(spark, rows, pack_rows=50) == brute(rows, 10)


def test_few_rows_and_none(spark):
    assert result(spark, []) == []
    assert result(spark, [(100, [1.0])]) == []
    assert result(spark, [(100, [1.0]), (1, [-2.0]), (0, [0.1])]) == brute([(100, [1.0]), (1, [-2.0]), (0, [0.1])], 10)


def test_large_values_are_cut(spark):
    rows = [(0, [1e4, -3.0]), (1, [1e17, 1e17]), (2, [-1e300, 5.0]), (3, [123456.7, 1e5]), (100, [1e250, 1.0])]
    assert result(spark, rows) == brute(rows, 10)


def test_extra_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 2, 3), (1, [2.0], 4, 5, 6)], KIND + ", g int, v int, part int")
    assert [tuple(r) for r in knn_join(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]


def test_parts_are_even_whatever_the_ids():
    """Packs of many tasks fill nearly all parts, none of them much more than others."""
    for tasks, packs, parts in ((16, 4, 64), (64, 8, 512), (200, 1, 200), (1, 64, 64)):
        n = np.bincount([_part(t, s, parts) for t in range(tasks) for s in range(packs)], minlength=parts)
        assert n.max() <= 8 and (n > 0).mean() > 0.5
    assert sorted(_part(0, s, 7) for s in range(7)) == list(range(7))


def test_rows_meet_queries_by_parts_not_by_a_join(spark):
    """No row of a join holds a pack of rows and one of queries; each row is sent once, whatever the groups that need it."""
    r = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(900, 5)).tolist())]
    out = knn_join(spark.createDataFrame(rows, KIND).repartition(3), F.col("vec_id") % 100 == 0, pack_rows=32)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert sorted(tuple(x) for x in out.collect()) == brute(rows, 10)


@pytest.mark.parametrize("held, part", [(40, 200), (1 << 22, 64)])
def test_shares_and_parts(spark, monkeypatch, held, part):
    """Queries and data of many tasks, each of a share and a part."""
    from codeaudit.llm import knn
    monkeypatch.setattr(knn, "_HELD", held)
    monkeypatch.setattr(knn, "_PART", part)
    rows = clustered(700, 3)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = sorted(tuple(x) for x in knn_join(df, F.col("vec_id") % 100 == 0, pack_rows=16, query_rows=2).collect())
    assert got == brute(rows, 10)


@pytest.mark.parametrize("size, small", [(1, True), (900, True), (1 << 40, False)])
def test_the_best_of_a_stream(size, small):
    """Ties go to smaller ids, own rows are left out, whatever the packs."""
    from codeaudit.llm.knn import _Best
    r = np.random.default_rng(4)
    q, x = r.integers(-size, size, (30, 7), endpoint=True), r.integers(-size, size, (3000, 7), endpoint=True)
    own, ids = np.arange(30) * 7, r.integers(0, 2500, 3000)
    best = _Best(own, q, 5, small)
    for s in (slice(0, 3), slice(3, 700), slice(700, 3000)):
        best.put(ids[s], x[s])
    got = {}
    for a, i, n in zip(*(c.to_pylist() for c in best.rows().columns), strict=True):
        got.setdefault(a, []).append((-n, i))
    low = 1 - (1 << 63)
    for a, v in zip(own.tolist(), q.tolist(), strict=True):
        want = sorted((-max(low, min(-low, sum(m * n for m, n in zip(v, y)))), int(i)) for i, y in zip(ids, x.tolist()) if i != a)[:5]
        assert got[a] == want
