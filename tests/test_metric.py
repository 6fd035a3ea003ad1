"""Neighbours over whole vectors against brute force, in many dimensions, with copies, ties at the radius and odd vectors."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendlens.functions import metric, spatial
from spendlens.operators import creative
from tests.test_scale import brute_dbscan


def frame(spark, rows, repeat=5):
    return spark.createDataFrame([(i, None if r is None else [None if x is None else float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<double>").repartition(repeat)


@pytest.mark.parametrize("dims,eps,unit,pivots", [(64, 1.3, 4096, 512), (10, 0.7, 50, 40), (300, 6.0, 64, 512), (3, 1.0, 16, 9)])
def test_counts_equal_brute_force(spark, monkeypatch, dims, eps, unit, pivots):
    """The last case is a lattice, where the radius falls on distances exactly."""
    monkeypatch.setattr(metric, "UNIT", unit)
    monkeypatch.setattr(metric, "MOST_PIVOTS", pivots)
    rng = np.random.default_rng(dims)
    if dims == 3:
        pts = rng.integers(0, 6, (300, 3)).astype(float) * 1.0
    else:
        centres = rng.normal(0, 1, (6, dims))
        pts = np.concatenate([centres[i % 6] + rng.normal(0, 0.15, dims) for i in range(250)]).reshape(-1, dims)
        pts = np.concatenate([pts, rng.normal(0, 1, (80, dims)), np.repeat(centres[:1], 70, axis=0)])
    odd = [None, [None] + [0.0] * (dims - 1), [float("nan")] * dims, [float("inf")] * dims]
    got = {r["id"]: r["neighbours"] for r in metric.neighbour_counts(frame(spark, [*pts, *odd]), "id", "v", eps).collect()}
    want = [int((((pts - p) ** 2).sum(1) <= eps * eps).sum()) for p in pts]
    assert got == dict(enumerate(want))


def test_least_value_within_reach(spark):
    rng = np.random.default_rng(2)
    q, t = rng.uniform(0, 1, (60, 12)), rng.uniform(0, 1, (90, 12))
    got = metric.range_aggregate(frame(spark, q), frame(spark, t).withColumn("value", F.col("id") + 5), "v", 1.1, "value", "min").collect()
    want = {tuple(a): min(j + 5 for j, b in enumerate(t) if ((a - b) ** 2).sum() <= 1.21) for a in q if (((t - a) ** 2).sum(1) <= 1.21).any()}
    assert {tuple(r["v"]): r["value"] for r in got} == want
    assert metric.neighbour_counts(frame(spark, [[0.0]]).where("false"), "id", "v", 1.0).count() == 0


@pytest.mark.parametrize("dims,unit", [(10, 4096), (10, 32), (70, 64)])
def test_dbscan_in_many_dimensions(spark, monkeypatch, dims, unit):
    """More than any grid could hold; the units of one cell must come together again."""
    monkeypatch.setattr(metric, "UNIT", unit)
    rng = np.random.default_rng(dims)
    centres = rng.uniform(0, 1, (5, dims))
    pts = np.vstack([centres[i % 5] + rng.normal(0, 0.02, dims) for i in range(200)] + [rng.uniform(0, 1, (40, dims)), np.repeat(centres[:1], 50, axis=0)])
    eps = 0.04 * dims**0.5
    names = [f"d{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["label"] for r in spatial.dbscan(df, "id", names, eps, 4).collect()}
    assert [got[i] for i in range(len(pts))] == brute_dbscan([tuple(map(float, p)) for p in pts], eps, 4)


def test_a_large_ball(spark):
    """10^5 different points within reach of each other, ten dimensions: cell totals, no pairs; its rim against a shell is compared."""
    at = F.array(*[(F.rand(i) - 0.5) * 0.1 for i in range(10)])
    ball = spark.range(100_000).select("id", at.alias("v")).unionByName(spark.range(100_000, 100_050).select("id", F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: 5.0 + k * F.col("id")).alias("v")))
    counts = metric.neighbour_counts(ball, "id", "v", 1.0).groupBy("neighbours").count().collect()
    assert {r["neighbours"]: r["count"] for r in counts} == {100_000: 100_000, 1: 50}


def test_terms_tied_at_the_cut(spark):
    """Three terms share the count at the cut; the first in order is taken, and only its weight counts."""
    rows = [(1, "aa bb cc", "aa zz"), (2, "dd aa", "bb"), (3, None, None), (4, "cc dd", "")]
    df = spark.createDataFrame(rows, "creative_id long, headline string, body string")
    terms = [r["term"] for r in creative.vocabulary(creative.term_counts(df, "creative_id", creative.full_text()), 3).orderBy(F.desc("total"), "term").collect()]
    assert terms == ["aa", "bb", "cc"]
    got = {(r["creative_id"], r["term"]): (r["n"], round(r["weight"], 6)) for r in creative.tfidf(df, terms=3).collect()}
    idf = round(float(np.log(5 / 3)), 6)
    assert got == {(1, "aa"): (2, round(2 * float(np.log(5 / 3)), 6)), (2, "aa"): (1, idf), (1, "bb"): (1, idf), (2, "bb"): (1, idf), (1, "cc"): (1, idf), (4, "cc"): (1, idf)}


def test_queries_that_visit_all_cells_go_out_in_bounded_batches():
    """1,000 queries near each of 64 pivots: 64,000 rows, in batches of 4,096 at most."""
    sent = SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v))
    queries = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sent), select=lambda *_: SimpleNamespace(mapInArrow=lambda run, schema: run))
    points = np.random.default_rng(3).standard_normal((1000, 8))
    run = metric._visits(queries, points[:64], [{"cell": i, "low": 0.0, "high": 9.0} for i in range(64)], 9.0)
    rows = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(list(points), pa.list_(pa.float64()))], names=["id", "v"])
    out = list(run(iter([rows])))
    assert max(b.num_rows for b in out) <= 4096
    got = pa.Table.from_batches(out).to_pylist()
    assert sorted((r["id"], r["cell"]) for r in got) == [(i, k) for i in range(1000) for k in range(64)]
    assert all((r["packed"] is None) == r["inside"] and r["packed"] in (None, points[r["id"]].tobytes()) for r in got)


def test_rates_are_learned_from_the_inputs_alone(spark):
    """Rows without their texts give the scores that rows with them give."""
    rows = [(i, "word " * (1 + i % 7) + ("5!" if i % 3 else ""), "great body" if i % 2 else "text", "SHOP_NOW" if i % 5 else None, i % 7 / 100) for i in range(120)]
    df = spark.createDataFrame(rows, "creative_id long, headline string, body string, cta string, rate double")
    inputs = creative.train_inputs(df).select("creative_id", "rate", *creative.TRAIN_INPUTS)
    scores = [sorted(map(tuple, creative.rate_scores(d, F.col("rate"), trees=2, depth=2).select("creative_id", "label", "score").collect())) for d in (df, inputs)]
    assert len(scores[0]) == 120 and scores[0] == scores[1]


def test_term_counts_of_chosen_terms(spark):
    df = spark.createDataFrame([(1, "red red blue", "a sky"), (2, "blue", None), (1, "Blue green", "green")], "creative_id long, headline string, body string")
    some = creative.term_counts(df, "creative_id", creative.full_text(), ["blue", "green"])
    assert sorted(map(tuple, some.collect())) == [(1, "blue", 2), (1, "green", 2), (2, "blue", 1)]


def test_units_are_compared_in_small_blocks():
    rng = np.random.default_rng(11)
    a, b = rng.random((512, 8)), rng.random((4096, 8))
    b[:200] = a[:200] + np.eye(8)[0] * 0.5  # at the radius, but for rounding
    b[200:203] *= 1e9
    a[300], b[300] = 1e200, 1e200
    tracemalloc.start()
    try:
        near = metric._within(a, b, 0.5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.zeros((512, 4096))
        for k in range(8):
            total += (a[:, k, None] - b[None, :, k]) ** 2
    total[300, 300] = 1  # inf less inf settles nothing; such pairs never count
    assert (near == (total <= 0.25)).all() and near[:200, :200].any()
    assert peak < 24e6
    values = rng.integers(-2**55, 2**55, 4096)
    assert metric._sums(near, values).tolist() == [int(values[row].sum()) for row in near]
    assert metric._sums(near, values >> 20).tolist() == [int((values >> 20)[row].sum()) for row in near]
    u, v, label, want = [], [], np.arange(4096), []
    metric._forest(near, np.arange(512), np.arange(4096), label, u, v)
    root = np.arange(4096)
    for k in range(512):
        at = np.flatnonzero(near[k])
        names, first = np.unique(root[at], return_index=True)
        want += [(k, t) for t in at[first].tolist()]
        root[np.isin(root, names)] = names[0] if len(names) else 0
    assert list(zip(u, v)) == want and (label == root).all()


@pytest.mark.parametrize("copies,kind", [(0, "float"), (10**9, "double")])
def test_blocks_meet_without_copies_of_queries(spark, monkeypatch, copies, kind):
    """Cells wholly within reach, cells out of reach and scattered points, in small blocks; what is written grows with the points alone."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 4, (5, 12))
    pts = np.concatenate([np.repeat(centres, 40, axis=0) + rng.normal(0, 0.1, (200, 12)), rng.normal(0, 1, (60, 12)), np.zeros((10, 12))])
    pts = pts.astype(np.float32).astype(float)
    rows, staged = [], metric.staged
    monkeypatch.setattr(metric, "COPIES", copies)
    monkeypatch.setattr(metric, "UNIT", 64)
    monkeypatch.setattr(metric, "staged", lambda df, name, *more: (lambda out: rows.append((name, out.count())) or out)(staged(df, name, *more)))
    df = frame(spark, pts).withColumn("v", F.col("v").cast(f"array<{kind}>")).withColumn("value", F.col("id") % 50 - 20)
    near = ((pts[:, None] - pts[None]) ** 2).sum(2) <= 9.0
    assert {r["id"]: r["neighbours"] for r in metric.neighbour_counts(df, "id", "v", 3.0).collect()} == dict(enumerate(near.sum(1).tolist()))
    assert copies or sum(n for _, n in rows) < 2 * len(pts)
    value = np.arange(len(pts)) % 50 - 20
    for how, want in (("sum", near[::2] @ value), ("min", [value[x].min() for x in near[::2]])):
        got = metric.range_aggregate(df.where("id % 2 = 0"), df, "v", 3.0, "value", how).collect()
        assert {tuple(r["v"]): r["value"] for r in got} == {tuple(p): int(x) for p, x in zip(pts[::2], want)}


def test_scattered_vectors_are_not_copied(spark, monkeypatch):
    """Every cell may hold a neighbour of every vector: copies for each would be 24 rows a vector."""
    rows, staged = [], metric.staged
    monkeypatch.setattr(metric, "staged", lambda df, name, *more: (lambda out: rows.append(out.count()) or out)(staged(df, name, *more)))
    pts = np.random.default_rng(5).normal(0, 1, (600, 64))
    got = {r["id"]: r["neighbours"] for r in metric.neighbour_counts(frame(spark, pts), "id", "v", 10.0).collect()}
    assert got == dict(enumerate((((pts[:, None] - pts[None]) ** 2).sum(2) <= 100.0).sum(1).tolist()))
    assert sum(rows) < 2 * len(pts)
