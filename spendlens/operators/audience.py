"""User profiles, scores, segments, lookalikes and overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.expr import epoch_us, first_of, lookup
from spendlens.functions.skew import join_back, one_row, ordered_scan, value_bins
from spendlens.operators.timeseries import mark_sessions
from spendlens.session import staged

c = F.col

# Inputs, archetype names, strategies, targeting ids.
FEATURES = ["sessions_30d", "pageviews_30d", "time_on_site_avg", "purchases_30d", "total_revenue_30d",
            "engagement_score", "value_score", "recency_score", "email_opens_30d", "ad_clicks_30d"]
STRATEGIES = {
    "Champions": "VIP treatment, loyalty rewards, referral programs",
    "Loyal Customers": "Upselling, early access to new products",
    "Potential Loyals": "Membership offers, personalized recommendations",
    "New Customers": "Onboarding emails, first purchase incentives",
    "At Risk": "Win-back campaigns, feedback surveys",
    "Can't Lose": "Urgent reactivation, personal outreach",
    "Hibernating": "Reactivation offers, brand reminders",
}
DEFAULT_STRATEGY = "General nurturing, brand awareness"
META_INTERESTS = {"shopping_frequency": ("6003139266461", "Shopping (Hobby)"), "tech_affinity": ("6003384745172", "Technology"),
                  "fitness_score": ("6003107902433", "Fitness and wellness")}
GOOGLE_AFFINITIES = {"shopping_frequency": "Shoppers/Value Shoppers", "tech_affinity": "Technology/Technophiles"}


def user_profiles(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Behaviour row per user over the trailing days, from one bucketed session scan."""
    last = F.lit(as_of).cast("date")
    rows = events.where((c("ts") >= F.date_sub(last, days).cast("timestamp_ntz")) & (c("ts") < last.cast("timestamp_ntz")))
    m = mark_sessions(rows)
    kind = lambda k: F.count_if(c("event_type") == k)
    buys = c("event_type") == "purchase"
    g = m.groupBy("user_id").agg(
        F.count_if("opens").alias("sessions_30d"), kind("view").alias("pageviews_30d"), F.sum("idle_s").alias("time_s"),
        F.count_if(c("opens") & c("closes")).alias("bounces"), kind("purchase").alias("purchases_30d"),
        F.sum(F.when(buys, c("value")).otherwise(0.0)).alias("total_revenue_30d"), kind("signup").alias("email_opens_30d"),
        kind("click").alias("ad_clicks_30d"), F.max("ts").alias("last_ts"), F.max(F.when(buys, c("ts"))).alias("last_buy"))
    sessions = F.greatest(c("sessions_30d"), F.lit(1))
    since = lambda ts: F.datediff(last, ts.cast("date")).cast("bigint")
    return g.select(
        "user_id", "sessions_30d", "pageviews_30d", (c("time_s") / 60 / sessions).alias("time_on_site_avg"),
        (c("bounces") / sessions).alias("bounce_rate"), "purchases_30d", "total_revenue_30d",
        (c("total_revenue_30d") / F.greatest(c("purchases_30d"), F.lit(1))).alias("avg_order_value"), "email_opens_30d", "ad_clicks_30d",
        since(c("last_ts")).alias("days_since_last_visit"), F.coalesce(since(c("last_buy")), F.lit(90)).alias("days_since_last_purchase"))


def _cap(x: Column, top: float) -> Column:
    return F.least(F.lit(float(top)), x.cast("double"))


def _floor0(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x.cast("double"))


def engagement_score() -> Column:
    return _cap(_cap(c("sessions_30d") * 3, 30) + _cap(c("email_opens_30d") * 2, 20) + _cap(c("time_on_site_avg") * 5, 25)
                + _floor0(25 - c("bounce_rate") * 25), 100)


def value_score() -> Column:
    return _cap(F.when(c("total_revenue_30d") > 0, _cap(c("total_revenue_30d") / 10, 40)).otherwise(0.0) + _cap(c("purchases_30d") * 10, 30)
                + F.when(c("avg_order_value") > 0, _cap(c("avg_order_value") / 5, 30)).otherwise(0.0), 100)


def recency_score() -> Column:
    return _cap(_floor0(50 - c("days_since_last_visit") * 2) + _floor0(50 - c("days_since_last_purchase")), 100)


def score_users(profiles: DataFrame) -> DataFrame:
    return profiles.withColumns({"engagement_score": engagement_score(), "value_score": value_score(), "recency_score": recency_score()})


def feature_vector(scored: DataFrame) -> DataFrame:
    """The ten clustering inputs as an ML vector."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(scored)


def _fit(scored: DataFrame, k: int, scaler, **kmeans):
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    k = min(k, scored.limit(k).count())  # never more clusters than rows
    steps = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), scaler, KMeans(k=k, seed=42, featuresCol="features", predictionCol="cluster", **kmeans)]
    return Pipeline(stages=steps).fit(scored)


def kmeans_standardised(scored: DataFrame, k: int = 5):
    from pyspark.ml.feature import StandardScaler

    return _fit(scored, k, StandardScaler(inputCol="raw", outputCol="features", withMean=True), maxIter=300, tol=1e-6)


def kmeans_minmax(scored: DataFrame, k: int = 5):
    from pyspark.ml.feature import MinMaxScaler

    return _fit(scored, k, MinMaxScaler(inputCol="raw", outputCol="features"), initMode="random", maxIter=100)


def assign(scored: DataFrame, model) -> DataFrame:
    """Nearest centroid of a fitted model for each row."""
    return model.transform(scored)


def _distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _as_array(vector: str = "features") -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)


def assignment_facts(assigned: DataFrame, model, key: str = "user_id", tolerance: float = 0.01) -> DataFrame:
    """Per row whether its cluster is that of the nearest centre, whether that centre is the mean of its rows, and the rows of all clusters."""
    centres = [[float(x) for x in centre] for centre in model.stages[-1].clusterCenters()]
    dims = range(len(centres[0]))
    rows = staged(assigned.select(key, "cluster", _as_array().alias("f")), "assigned")
    means = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.array(*[F.avg(c("f")[i]) for i in dims]).alias("mean"))
    rows = rows.join(means, "cluster").withColumn("centres", F.lit(centres))
    away = F.transform("centres", lambda m: _distance2(c("f"), m))
    own = F.element_at("centres", c("cluster") + 1)
    total = F.lit(0).cast("long") + means.agg(F.sum("size")).scalar()
    return rows.select(key, (F.element_at(away, c("cluster") + 1) <= F.array_min(away) + 1e-9).alias("nearest"),
                       (F.sqrt(_distance2(own, c("mean"))) <= tolerance).alias("centre_is_mean"), total.alias("rows_in_clusters"))


def silhouette(clustered: DataFrame) -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(clustered)


def silhouette_by_moments(clustered: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, silhouette) by squared distances: one row of moments a cluster gives every mean distance, and no pair of rows meets.

    The mean squared distance of x to a cluster is |x|^2 - 2 x . mean + mean |y|^2; within its own cluster x itself does not count.
    A row alone in its cluster has 0.
    """
    rows = staged(clustered.select(key, "cluster", _as_array().alias("f")), "clustered")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    n_dims = len(rows.select("f").first()["f"])
    moments = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c("f")[i]) for i in range(n_dims)]).alias("mean"), F.avg(dot(c("f"), c("f"))).alias("square"))
    listed = moments.agg(F.collect_list(F.struct("cluster", "n", "mean", "square")))  # one entry per cluster
    rows = rows.withColumn("m", listed.scalar())
    to = F.transform("m", lambda m: F.struct(m["cluster"].alias("cluster"), m["n"].alias("n"), (dot(c("f"), c("f")) - dot(c("f"), m["mean"]) * 2 + m["square"]).alias("d")))
    rows = rows.withColumn("to", to)
    mine = F.element_at(F.filter("to", lambda t: t["cluster"] == c("cluster")), 1)
    inner = mine["d"] * mine["n"] / F.greatest(mine["n"] - 1, F.lit(1))
    outer = F.array_min(F.transform(F.filter("to", lambda t: t["cluster"] != c("cluster")), lambda t: t["d"]))
    value = F.when(mine["n"] == 1, 0.0).otherwise(F.coalesce(F.try_divide(outer - inner, F.greatest(outer, inner)), F.lit(0.0)))
    return rows.select(key, value.alias("silhouette"))


CORESET = 20_000  # rows the costs of all k are taken from, at most about twice as many


def coreset(scored: DataFrame, key: str = "user_id", size: int = CORESET) -> DataFrame:
    """Rows of scaled features with weights that stand for all: every row is kept with a chance of size * (1 / 2n + d^2 / 2 sum d^2) by a
    hash of its key, d its distance from the mean, and weighs the inverse.  Up to size / 2 rows all are kept."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    scaled = Pipeline(stages=steps).fit(scored).transform(scored)
    far = F.aggregate(F.transform(_as_array(), lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    rows = staged(scaled.select(key, "features", far.alias("far")), "scaled")
    both = one_row(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("far").alias("far")))
    chance = F.least(F.lit(1.0), size * (0.5 / both["n"] + F.coalesce(F.try_divide(c("far") * 0.5, both["far"]), F.lit(0.0))))
    unit = F.pmod(F.xxhash64(F.lit("coreset"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.withColumn("chance", chance).where(unit < c("chance")).select(key, "features", (1 / c("chance")).alias("weight"))


def cluster_costs(scored: DataFrame, ks: range) -> list[tuple[int, float]]:
    """(k, cost) for every k, all fitted on one weighted coreset: two passes over the rows, whatever the number of k."""
    from pyspark.ml.clustering import KMeans

    rows = staged(coreset(scored), "coreset")
    return [(k, KMeans(k=k, seed=42, featuresCol="features", predictionCol="cluster", weightCol="weight").fit(rows).summary.trainingCost) for k in ks]


def choose_k(scored: DataFrame, ks: range) -> int:
    """Elbow: the k whose cost lies farthest below the chord of first and last."""
    costs = cluster_costs(scored, ks)
    (k0, c0), (k1, c1) = costs[0], costs[-1]
    return max(costs, key=lambda p: (c0 + (c1 - c0) * (p[0] - k0) / max(k1 - k0, 1)) - p[1])[0]


def segment_profile(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, averages, RFM, name, traits of every segment, largest first by rank."""
    g = clustered.groupBy(c(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), F.avg("sessions_30d").alias("s"), F.avg("total_revenue_30d").alias("rev"),
        F.avg("engagement_score").alias("e"), F.avg("days_since_last_visit").alias("d"), F.avg("email_opens_30d").alias("opens"), F.avg("ad_clicks_30d").alias("clicks"))
    total = F.sum("size").over(Window.partitionBy())  # one row per cluster
    g = g.withColumns({"r": rfm_recency(c("d")), "f": rfm_frequency(c("s")), "m": rfm_monetary(c("rev")), "total": total})
    return g.select(
        "cluster", archetype(c("r"), c("f"), c("m")).alias("name"), "size", F.round(c("size") / c("total") * 100, 1).alias("percentage"),
        F.round(c("rev") * 12, 2).alias("avg_ltv"), F.round("s", 1).alias("avg_sessions"), F.round("rev", 2).alias("avg_revenue"),
        F.round("e", 1).alias("avg_engagement"), F.round("r", 2).alias("recency_score"), F.round("f", 2).alias("frequency_score"),
        F.round("m", 2).alias("monetary_score"), key_traits(c("r"), c("f"), c("m"), c("opens"), c("clicks")).alias("key_traits"),
        F.row_number().over(Window.orderBy(F.desc("size"), "cluster")).alias("rank"))


def rfm_recency(avg_days: Column) -> Column:
    return 5 - F.least(F.lit(4.0), avg_days / 7)


def rfm_frequency(avg_sessions: Column) -> Column:
    return F.least(F.lit(5.0), avg_sessions / 5 + 1)


def rfm_monetary(avg_revenue: Column) -> Column:
    return F.least(F.lit(5.0), avg_revenue / 100 + 1)


def archetype(r: Column, f: Column, m: Column) -> Column:
    """First matching name; the order makes three of the names unreachable, as defined."""
    rules = [
        ("Champions", (r >= 4) & (f >= 4) & (m >= 4)), ("Loyal Customers", (r >= 3) & (f >= 4)),
        ("Potential Loyals", (r >= 3) & (f >= 2) & (m >= 2)), ("New Customers", (r >= 4) & (f <= 2)),
        ("Promising", (r >= 3) & (f <= 2) & (m <= 2)), ("Need Attention", r.between(2, 3) & (f >= 2) & (m >= 2)),
        ("About to Sleep", (r <= 2) & (f >= 2)), ("At Risk", (r <= 2) & (f >= 3) & (m >= 3)),
        ("Can't Lose", (r <= 2) & (f >= 4) & (m >= 4)), ("Hibernating", (r <= 2) & (f <= 2)), ("Lost", (r <= 1) & (f <= 1))]
    return F.coalesce(*[F.when(cond, name) for name, cond in rules], F.lit("General Audience"))


def key_traits(r: Column, f: Column, m: Column, opens: Column, clicks: Column) -> Column:
    return F.slice(first_of(
        F.when(r >= 4, "Recently active").when(r <= 2, "Inactive/dormant"),
        F.when(f >= 4, "Frequent visitors").when(f <= 2, "Infrequent visitors"),
        F.when(m >= 4, "High spenders").when(m >= 2, "Medium spenders").otherwise("Low/no spend"),
        F.when(opens > 5, "Email engaged"), F.when(clicks > 3, "Ad responsive")), 1, 5)


def segment_value(segments: DataFrame) -> DataFrame:
    """Annual value, growth potential and uplift of a profiled segment."""
    high = (c("avg_engagement") > 50) & (c("monetary_score") < 3)
    wake = (c("recency_score") < 3) & (c("monetary_score") >= 3)
    rate = F.when(high, 0.5).when(wake, 0.3).otherwise(0.1)
    return segments.withColumns({
        "annual_value": F.round(c("avg_ltv") * c("size"), 2),
        "growth_potential": F.when(high, "High").when(wake, "Medium - Reactivation").otherwise("Low"),
        "potential_uplift": F.round(c("avg_revenue") * rate * c("size"), 2),
        "recommended_strategy": strategy(c("name"))})


def strategy(name: Column) -> Column:
    return lookup(STRATEGIES, name, DEFAULT_STRATEGY)


def api_projection(segments: DataFrame) -> DataFrame:
    """Published segment columns; sizes stay as counted."""
    e = c("avg_engagement")
    return segments.select(
        "cluster", "name", "size", (c("avg_sessions") / 10).alias("purchase_frequency"), (c("monetary_score") * 2 + 30).alias("avg_age"),
        F.when(e > 60, "high").when(e > 30, "medium").otherwise("low").alias("engagement_level"),
        (c("frequency_score") * 0.005 + 0.02).alias("avg_ctr"), (c("monetary_score") * 0.01 + 0.01).alias("avg_cvr"),
        (c("monetary_score") * 0.8 + 2.0).alias("avg_roas"))


def _seed_distance(seed: DataFrame, features: list[str], weight) -> tuple[Column, Column]:
    """Σ weight(deviation, spread); the seed's statistics are one row, read as a scalar."""
    stats = one_row(seed.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.var_pop(f).alias(f"v_{f}") for f in features]))
    return reduce(lambda a, b: a + b, [weight(c(f) - c("__s")[f"m_{f}"], c("__s")[f"v_{f}"]) for f in features]), stats


def _most_similar(scored: DataFrame, n: Column) -> DataFrame:
    """The n rows of greatest similarity, ties by user_id.

    Rows are counted per similarity and the counts scanned for the cut.  All rows above it stay; only the
    users who tie at the cut are ranked, in bins of their ids.
    """
    rows = staged(scored, "similarity")
    counts = rows.groupBy("similarity").agg(F.count(F.lit(1)).alias("__c")).withColumn("__far", -c("similarity"))
    ranked = ordered_scan(value_bins(counts, [], "__far"), [], ["__far"], c("__bin"), before={"__ahead": c("__c")})
    cut = ranked.withColumn("__room", n - c("__ahead")).where(c("__room") > 0).select("similarity", "__c", "__room")
    met = join_back(rows, cut, ["similarity"])
    tied = value_bins(met.where(c("__c") > c("__room")), [], "user_id")
    first = ordered_scan(tied, [], ["user_id"], c("__bin"), row_number="__rank").where(c("__rank") <= c("__room"))
    return met.where(c("__c") <= c("__room")).select(*rows.columns).unionByName(first.select(*rows.columns))


def lookalike_topn(seed: DataFrame, pool: DataFrame, expansion: float = 5.0, features: list[str] | None = None) -> DataFrame:
    """The ⌊seed size · expansion⌋ pool users nearest the seed in standard deviations."""
    d2, stats = _seed_distance(seed, features or FEATURES, lambda d, v: F.pow(d / (F.sqrt(v) + 0.001), F.lit(2.0)))
    wanted = F.floor(seed.agg(F.count(F.lit(1))).scalar() * expansion)
    scored = pool.withColumn("__s", stats).select("user_id", (1 / (1 + F.sqrt(d2))).alias("similarity"))
    return _most_similar(scored, wanted)


def lookalike_threshold(seed: DataFrame, pool: DataFrame, size: int = 1000, expansion: float = 1.0, features: list[str] | None = None) -> DataFrame:
    """At most ``size`` users with similarity of at least .8 / expansion."""
    d2, stats = _seed_distance(seed, features or FEATURES, lambda d, v: d * d / (v + 1e-10))
    scored = pool.withColumn("__s", stats).select("user_id", (1 / (1 + F.sqrt(d2))).alias("similarity"))
    return _most_similar(scored.where(c("similarity") >= 0.8 / expansion), F.lit(size))


def lookalike_report(seed: DataFrame, lookalikes: DataFrame) -> DataFrame:
    n = seed.agg(F.count(F.lit(1))).scalar()
    return lookalikes.agg(F.count(F.lit(1)).alias("lookalike_size"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("avg_similarity"),
                          F.coalesce(F.min("similarity"), F.lit(0.0)).alias("min_similarity")).withColumn("seed_size", n)


def centroids(clustered: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """Long centroid table (cluster, pos, feature, value)."""
    wide = clustered.groupBy(c(cluster).alias("cluster")).agg(*[F.avg(f).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), c(f).cast("double").alias("value")) for i, f in enumerate(features)])
    return wide.select("cluster", F.inline(pairs))


def distinguishing(centroid_rows: DataFrame) -> DataFrame:
    """First five features in order that stand out from the mean of the centroids."""
    mean = F.avg("value").over(Window.partitionBy("feature"))  # one row per cluster
    word = F.when(c("value") > c("mean") * 1.2, F.concat(F.lit("High "), c("feature"))).when(
        c("value") < c("mean") * 0.8, F.concat(F.lit("Low "), c("feature")))
    rows = centroid_rows.withColumn("mean", mean).withColumn("word", word)
    listed = F.array_sort(F.collect_list(F.when(c("word").isNotNull(), F.struct("pos", "word"))))  # one entry per feature
    g = rows.groupBy("cluster").agg(listed.alias("w"))
    return g.select("cluster", F.slice(F.transform("w", lambda x: x["word"]), 1, 5).alias("distinguishing"))


def segment_label(traits: Column) -> Column:
    parts = F.filter(F.transform(F.slice(traits, 1, 2), lambda t: F.when(F.contains(t, F.lit("High")), F.replace(t, F.lit("High "), F.lit("High-"))).when(
        F.contains(t, F.lit("Low")), F.replace(t, F.lit("Low "), F.lit("Low-")))), lambda t: t.isNotNull())
    return F.when(F.size(traits) == 0, "General Audience").when(F.size(parts) == 0, "Mixed Segment").otherwise(F.array_join(parts, " | "))


def segment_summary(labelled: DataFrame, value: str = "ltv") -> DataFrame:
    """Size and average value per label; noise (-1) is only counted."""
    noise = labelled.agg(F.count_if(c("label") == -1)).scalar()
    g = labelled.where("label <> -1").groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.avg(value).alias("avg_value"))
    return g.select(F.concat(F.lit("seg_"), c("label").cast("string")).alias("segment_id"), "size", "avg_value", noise.alias("noise_count"))


def targeting(segments: DataFrame, platform: str) -> DataFrame:
    """Targeting parameters of one platform as a struct column."""
    on = lambda f: F.coalesce(c(f), F.lit(0.0)) > 0.5
    if platform == "meta":
        age = lambda default, shift: (F.coalesce(c("avg_age"), F.lit(float(default))) + shift).cast("int")
        interests = first_of(*[F.when(on(f), F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"))) for f, (i, n) in META_INTERESTS.items()])
        t = F.struct(age(25, -5).alias("age_min"), age(35, 10).alias("age_max"), F.array(F.lit(1), F.lit(2)).alias("genders"),
                     F.array(F.lit("US")).alias("countries"), interests.alias("interests"))
    elif platform == "google":
        t = F.struct(F.lit("AGE_RANGE_25_34").alias("age_range"), F.array(F.lit("GENDER_UNKNOWN")).alias("genders"),
                     F.lit("PARENTAL_STATUS_UNDETERMINED").alias("parental_status"),
                     first_of(*[F.when(on(f), F.lit(n)) for f, n in GOOGLE_AFFINITIES.items()]).alias("affinity_audiences"))
    elif platform == "tiktok":
        t = F.struct(F.array(F.lit("AGE_25_34"), F.lit("AGE_35_44")).alias("age_groups"), F.array(F.lit("GENDER_UNLIMITED")).alias("genders"),
                     F.array(F.struct(F.lit("123").alias("interest_id"), F.lit("Fashion").alias("interest_name"))).alias("interests"))
    else:
        raise ValueError(f"unknown platform {platform}")
    return segments.withColumn("targeting", t)


def audience_overlap(members: DataFrame) -> DataFrame:
    """Users shared by each pair of segments, Jaccard and containment.

    Users are first counted by their set of segments, so pairs form on distinct sets only.
    """
    sets = members.groupBy("user_id").agg(F.array_sort(F.collect_set("segment")).alias("set"))  # bounded by the segments
    counted = sets.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    pairs = counted.select(F.explode("set").alias("a"), "set", "n").select("a", F.explode("set").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    sizes = pairs.where("a = b").select("a", c("shared").alias("size"))
    out = pairs.where("a < b").join(sizes.withColumnRenamed("size", "size_a"), "a")
    out = out.join(sizes.select(c("a").alias("b"), c("size").alias("size_b")), "b")
    return out.select("a", "b", "shared", (c("shared") / (c("size_a") + c("size_b") - c("shared"))).alias("jaccard"),
                      (c("shared") / F.least("size_a", "size_b")).alias("containment"))


def rule_segment(events: DataFrame, did: str, not_then: str, days: int) -> DataFrame:
    """Users with an event A that no event B follows within the days.

    B times are carried back along the user's timeline by a bucketed lead, so the range
    condition needs neither a range join nor all pairs of a user's events.
    """
    rows = events.where(c("event_type").isin(did, not_then)).withColumn("is_a", (c("event_type") == did).cast("int"))
    # next B per row: number the B events before each row; the (k+1)-th B is the next one.
    # A B at the very time of an A does not follow it and is counted before
    hour = F.date_trunc("hour", c("ts").cast("timestamp"))
    is_b = (c("event_type") == not_then).cast("bigint")
    numbered = ordered_scan(rows, ["user_id"], ["ts", "is_a", "event_id"], hour, before={"b_before": is_b})
    b = numbered.where(c("event_type") == not_then).select(c("user_id").alias("u"), c("b_before").alias("k"), c("ts").alias("b_ts"))
    a = numbered.where(c("event_type") == did)
    j = a.join(b, (a.user_id == b.u) & (a.b_before == b.k), "left")
    lost = c("b_ts").isNull() | (epoch_us("b_ts") - epoch_us("ts") > days * 86_400_000_000)
    return j.where(lost).select("user_id").distinct()
