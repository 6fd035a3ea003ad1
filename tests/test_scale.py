"""Skew-safe building blocks against plain formulations, with hot keys and copies."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spendlens.functions import skew, spatial
from spendlens.operators import alerts, attribution, audience, quality


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows on one key, repeated values and NULL keys."""
    rnd = random.Random(7)
    rows = [(i, 1 if i % 3 == 0 else rnd.choice([2, 3, 4, None]), rnd.randrange(500), float(rnd.randrange(20))) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k long, at long, v double").repartition(5)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ordered_scan_equals_window(hot):
    got = skew.ordered_scan(hot, ["k"], ["at", "id"], F.floor(F.col("at") / 10), lag={"p": F.col("v")}, lead={"n": F.col("id")},
                            before={"s": F.col("v")}, row_number="rn")
    w = Window.partitionBy("k").orderBy("at", "id")
    want = hot.withColumns({"p": F.lag("v").over(w), "n": F.lead("id").over(w),
                            "s": F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "rn": F.row_number().over(w).cast("long")})
    same(got, want)


def test_first_and_top_n_per_key(hot):
    w = Window.partitionBy("k").orderBy("at", "id")
    same(skew.first_per_key(hot, ["k"], ["at", "id"]), hot.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r"))
    same(skew.top_n_per_key(hot, ["k"], [F.col("at"), F.col("id")], 7, salt_on=["id"], salts=4), hot.withColumn("rank", F.row_number().over(w)).where("rank <= 7"))


def test_with_totals_keeps_null_keys(hot):
    got = skew.with_totals(hot, ["k"], t=F.sum("v"))
    same(got, hot.withColumn("t", F.sum("v").over(Window.partitionBy("k"))))


def test_bins_follow_the_values(spark):
    """10^5 distinct values within 1e-6, and nulls: no bin holds more than a few times its share, order is kept."""
    df = spark.range(100_000).select(F.when(F.col("id") % 1000 > 0, F.col("id") * 1e-11).alias("v"))
    bins = skew.value_bins(df, [], "v").groupBy("__bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("__bin").collect()
    assert max(b["n"] for b in bins) < 4 * 100_000 / 256
    assert all(a["high"] < b["low"] for a, b in zip(bins, bins[1:]))


def test_most_similar_settles_the_tie(spark):
    """Nine users in ten share one similarity; the cut falls among them."""
    df = spark.range(1000).select(F.col("id").alias("user_id"), F.when(F.col("id") % 10 == 0, 0.9).otherwise(0.5).alias("similarity"))
    got = sorted(r["user_id"] for r in audience._most_similar(df, F.lit(150)).collect())
    assert got == sorted([i for i in range(1000) if i % 10 == 0] + [i for i in range(1000) if i % 10][:50])


def test_exact_percentiles(hot):
    got = {r["k"]: (r["m"], r["t"]) for r in skew.exact_percentiles(hot, ["k"], "v", {"m": 0.5, "t": 0.9}).collect()}
    pdf = hot.toPandas()
    for k, g in pdf.groupby("k", dropna=False):
        key = None if math.isnan(k) else int(k)
        assert got[key] == pytest.approx((np.percentile(g["v"], 50), np.percentile(g["v"], 90)))


def brute_cooldown(rows, cool_us):
    fired, last = [], {}
    for key, us, eid in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or us - last[key] >= cool_us:
            last[key] = us
            fired.append((key, eid))
    return sorted(fired)


@pytest.mark.parametrize("bucket_us", [1_000_000, 60_000_000, 7_000_000_000])
def test_cooldown_equals_fold(spark, bucket_us):
    rnd = random.Random(bucket_us)
    rows = []
    for key, n, span in (("hot", 900, 40000), ("thin", 40, 900000), ("dense", 300, 3000)):
        rows += [(key, rnd.randrange(span) * 1_000_000, len(rows) + i) for i in range(n)]
    df = spark.createDataFrame(rows, "rule_id string, us long, event_id long").select(
        "rule_id", "event_id", F.timestamp_micros("us").alias("ts"), F.lit(10).alias("cooldown_minutes"))
    got = alerts.cooldown(df, ["rule_id"], tie="event_id", bucket_us=bucket_us, fold_rows=100)
    assert sorted((r["rule_id"], r["event_id"]) for r in got.collect()) == brute_cooldown(rows, 600_000_000)


def brute_dbscan(pts, eps, k):
    n = len(pts)
    near = [[j for j in range(n) if sum((a - b) ** 2 for a, b in zip(pts[i], pts[j])) <= eps * eps] for i in range(n)]
    labels, cluster, seen = [-1] * n, 0, [False] * n
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        if len(near[i]) < k:
            continue
        labels[i], queue = cluster, list(near[i])
        while queue:
            j = queue.pop()
            if not seen[j]:
                seen[j] = True
                if len(near[j]) >= k:
                    queue.extend(near[j])
            if labels[j] == -1:
                labels[j] = cluster
        cluster += 1
    return labels


@pytest.mark.parametrize("dims,eps,k,direct", [(2, 0.1, 5, 0), (2, 0.1, 5, 512), (4, 0.25, 4, 8)])
def test_dbscan_equals_brute_force(spark, monkeypatch, dims, eps, k, direct):
    monkeypatch.setattr(spatial, "DIRECT_PAIRS", direct)
    rng = np.random.default_rng(dims)
    centres = rng.uniform(0, 1, (4, dims))
    pts = np.vstack([centres[i % 4] + rng.normal(0, 0.05, dims) for i in range(120)] + [rng.uniform(0, 1, (40, dims))] + [np.repeat(centres[:1], 80, axis=0)])
    names = [f"d{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["label"] for r in spatial.dbscan(df, "id", names, eps, k).collect()}
    assert [got[i] for i in range(len(pts))] == brute_dbscan([tuple(map(float, p)) for p in pts], eps, k)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202)]
    got = {(r["v"], r["component"]) for r in spatial.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {(i, 0) for i in range(1, 61)} | {(x, 100) for x in range(101, 160)} | {(201, 200), (202, 200)}
    assert got == want


def test_rounds_of_components_are_few_files(spark, monkeypatch):
    files, plain = [], spatial.staged

    def counted(*args):
        out = plain(*args)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(spatial, "staged", counted)
    held = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
        assert spatial.connected_components(edges).where("component = 0").count() == 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 2 and set(files[1:]) == {1}


def test_journeys_of_a_hot_user(spark):
    rnd = random.Random(3)
    rows = [(0, 1 if i % 3 else 2 + i % 5, i, i * 400, rnd.choice("abc"), i % 17 == 0, 1.0) for i in range(2000)]
    ev = spark.createDataFrame(rows, "client_id long, user_id long, event_id long, s long, channel string, is_conversion boolean, value double").select(
        "client_id", "user_id", "event_id", F.timestamp_seconds("s").alias("ts"), "channel", F.lit(0).alias("campaign_id"), F.lit(0.0).alias("cost"), "is_conversion", "value")
    j = attribution.build_journeys(ev)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    plain = ev.withColumn("path_no", F.coalesce(F.sum(F.col("is_conversion").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same(j.select("event_id", "path_no"), plain.select("event_id", "path_no"))
    shares = attribution.shapley_value(attribution.path_channels(j)).agg(F.sum("shapley")).first()[0]
    assert shares == pytest.approx(1.0)


def test_changed_only_sees_earlier_rows_of_the_batch(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "z"), (5, "a", "x")]
    batch = spark.createDataFrame(rows, "seq long, id string, payload string")
    stored = spark.createDataFrame([("b", "z")], "id string, payload string").select("id", quality.checksum(["id", "payload"]).alias("checksum"))
    out = quality.changed_only(batch, stored, "id", "seq", ["id", "payload"], bucket_rows=2)
    assert sorted(r["seq"] for r in out.collect()) == [1, 3, 5]


@pytest.mark.parametrize("query", ["t13_attribution_report", "q04_dedupe_keep_first", "w19_sessionize", "u01_user_profiles"])
def test_plans_have_no_cross_join(spark, query):
    from spendlens.plans import catalog
    plan = catalog.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tied_sequences_are_settled_without_spelling_them(spark):
    """20,000 different sequences of five paths each, tied; the first ones share twelve touches, more than a round looks at."""
    n, top = 20_000, 20
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("copy"))
    digits = F.lpad(F.col("id").cast("string"), 5, "0")
    shared = F.array(*[F.lit("same")] * 12)
    channels = F.concat(shared, F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("c"), F.substring(digits, i, F.lit(1)))))
    path = F.concat_ws(":", "id", "copy")
    placed = rows.select(F.lit(0).alias("client_id"), path.alias("path_id"), F.posexplode(channels).alias("pos", "channel")).withColumn("is_last", F.col("pos") == 16)
    one = placed.where("path_id like '%:0'")
    got = attribution.first_in_order(one.select("path_id").distinct(), one, top).collect()
    assert sorted(int(r["path_id"].split(":")[0]) for r in got) == list(range(top))


def test_beta_draws_have_their_moments(spark):
    """Mean and variance of 4,000 draws each, small and large parameters; the same draws in other partitions."""
    from spendlens.operators import budget

    post = spark.createDataFrame([(a, b, k) for a, b in ((1.0, 1.0), (2.0, 5.0), (300.0, 40.0)) for k in range(4000)], "alpha double, beta double, k int")
    draws = post.withColumn("p", budget.beta_draw(F.col("alpha"), F.col("beta"), budget.draw_key(F.lit(3), F.col("alpha"), F.col("k"))))
    for r in draws.groupBy("alpha", "beta").agg(F.avg("p").alias("m"), F.var_samp("p").alias("v"), F.min("p").alias("low"), F.max("p").alias("high")).collect():
        a, b = r["alpha"], r["beta"]
        sd = math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        assert abs(r["m"] - a / (a + b)) < 5 * sd / math.sqrt(4000) and abs(r["v"] / sd**2 - 1) < 0.15 and 0 < r["low"] < r["high"] < 1
    same(draws.select("alpha", "k", "p"), draws.repartition(13).select("alpha", "k", "p"))


def test_silhouette_of_single_rows_and_clusters(spark):
    from pyspark.ml.functions import array_to_vector

    rows = [(1, 0, [0.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "user_id long, cluster int, f array<double>").select("user_id", "cluster", array_to_vector("f").alias("features"))
    got = {r["user_id"]: r["silhouette"] for r in audience.silhouette_by_moments(df).collect()}
    assert got == pytest.approx({1: 1 - 1 / 50, 2: 1 - 1 / 41, 3: 0.0})


def test_platforms_share_one_scan(spark):
    """Daily totals are written once; the three branches read those and not the line items."""
    from spendlens.plans import catalog
    plan = catalog.QUERIES["n08_derive_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("FileScan parquet") == 3 and "Exchange" not in plan
