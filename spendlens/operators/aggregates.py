"""Totals, rollups, benchmarks and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.expr import ratio
from spendlens.functions.skew import exact_percentiles, join_back
from spendlens.operators.normalize import kpis

SUMS = ["spend", "revenue", "clicks", "impressions", "conversions"]


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in SUMS]


def campaign_totals(metrics: DataFrame, key: str = "campaign_id") -> DataFrame:
    """Lifetime sums per entity with the ratios of the sums."""
    return kpis(metrics.groupBy(key).agg(*_sums()))


def campaign_metrics(metrics: DataFrame, campaign: int, start: str, end: str, granularity: str, at: str = "day") -> DataFrame:
    """Hourly, daily or weekly buckets plus one summary row (bucket NULL), in one pass."""
    unit = {"hourly": "hour", "daily": "day", "weekly": "week"}[granularity]
    rows = metrics.where((F.col("campaign_id") == campaign) & F.col(at).cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    rows = rows.withColumn("bucket", F.date_format(F.date_trunc(unit, F.col(at).cast("timestamp")), "yyyy-MM-dd HH:mm"))
    out = rows.rollup("bucket").agg(*_sums())
    return out.withColumn("roas", F.coalesce(F.try_divide("revenue", "spend"), F.lit(0.0)))


def dashboard_summary(state: DataFrame, campaigns: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: ROAS of sums, active campaigns, clients, clients at risk."""
    money = state.agg(F.sum("revenue").alias("r"), F.sum("spend_today").alias("s")).select(
        F.when(F.col("s") > 0, F.col("r") / F.col("s")).otherwise(0.0)).scalar()
    active = campaigns.agg(F.count_if(F.col("status") == "active")).scalar()
    return scored.agg(F.count(F.lit(1)).alias("total_clients"),
                      F.count_if(F.col("risk_level").isin("critical", "warning")).alias("at_risk_clients")).withColumns(
        {"total_roas": money, "active_campaigns": active})


def segment_performance(members: DataFrame, activity: DataFrame, key: str = "user_id") -> DataFrame:
    """Campaign-style totals of a segment's members."""
    per_member = activity.groupBy(key).agg(*_sums())
    return kpis(members.join(per_member, key).groupBy("segment").agg(*_sums()))


SKETCH_K = 800  # size of a quantile sketch: a rank is off by less than RANK_ERROR of the rows
RANK_ERROR = 0.01


def _recent(metrics: DataFrame, as_of: str, days: int) -> DataFrame:
    first = F.date_sub(F.lit(as_of).cast("date"), days)
    return kpis(metrics.where((F.col("day") > first) & (F.col("day") <= F.lit(as_of).cast("date"))))


def benchmarks(metrics: DataFrame, as_of: str, days: int = 90, exact: bool = True) -> DataFrame:
    """CTR average / median / top tenth, average CVR, CPM, CPC per industry and platform.

    exact=False takes the CTR quantiles from daily sketches instead: see ctr_sketches.
    """
    keys = ["industry", "platform"]
    rows = _recent(metrics, as_of, days)
    base = rows.groupBy(*keys).agg(
        F.avg("ctr").alias("avg_ctr"), F.avg("cvr").alias("avg_cvr"), F.avg("cpm").alias("avg_cpm"), F.avg("cpc").alias("avg_cpc"),
        F.count(F.lit(1)).alias("sample_size"))
    if not exact:
        return join_back(base, sketched_benchmarks(ctr_sketches(metrics), as_of, days), keys)
    cuts = exact_percentiles(rows, keys, "ctr", {"median_ctr": 0.5, "top10_ctr": 0.9})
    return join_back(base, cuts, keys)


def ctr_sketches(metrics: DataFrame) -> DataFrame:
    """(industry, platform, day, sketch): one mergeable quantile sketch of CTR a day, to be kept and merged over any window."""
    return kpis(metrics).groupBy("industry", "platform", "day").agg(F.kll_sketch_agg_double("ctr", SKETCH_K).alias("sketch"))


def sketched_benchmarks(daily: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Median and top tenth of CTR out of the daily sketches of the window; the rows themselves are not read."""
    last = F.lit(as_of).cast("date")
    window = daily.where((F.col("day") > F.date_sub(last, days)) & (F.col("day") <= last))
    merged = window.groupBy("industry", "platform").agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("s"))
    at = lambda q: F.kll_sketch_get_quantile_double("s", F.lit(q))
    return merged.select("industry", "platform", at(0.5).alias("median_ctr"), at(0.9).alias("top10_ctr"))


def sketch_check(metrics: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Per industry and platform the exact quantiles, and whether the sketched ones stand at their rank within RANK_ERROR of the rows."""
    keys = ["industry", "platform"]
    sketched = sketched_benchmarks(ctr_sketches(metrics), as_of, days)
    renamed = sketched.withColumnsRenamed({"median_ctr": "median_sketch", "top10_ctr": "top10_sketch"})
    rows = join_back(_recent(metrics, as_of, days).select(*keys, "ctr"), renamed, keys)
    below = lambda s: F.count_if(F.col("ctr") < F.col(s))
    upto = lambda s: F.count_if(F.col("ctr") <= F.col(s))
    slack = F.count(F.lit(1)) * RANK_ERROR + 1

    def near(s: str, q: float) -> Column:
        n = F.count(F.lit(1))
        return (below(s) <= n * q + slack) & (upto(s) >= n * q - slack)

    checked = rows.groupBy(*keys).agg(near("median_sketch", 0.5).alias("median_within"), near("top10_sketch", 0.9).alias("top10_within"))
    return join_back(benchmarks(metrics, as_of, days).select(*keys, "sample_size", "median_ctr", "top10_ctr"), checked, keys)


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Counts of active alerts by severity, by type and in total; empty groups do not appear."""
    active = alerts.where("resolved_at is null")
    out = active.groupingSets([["severity"], ["alert_type"], []], "severity", "alert_type").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("alerts"))
    kind = F.when(F.col("g") == 1, "severity").when(F.col("g") == 2, "type").otherwise("total")
    return out.select(kind.alias("group"), F.coalesce("severity", "alert_type", F.lit("all")).alias("value"), "alerts")


def entity_rollup(metrics: DataFrame) -> DataFrame:
    """account > campaign > ad set totals, one level per grouping id."""
    return metrics.rollup("account_id", "campaign_id", "ad_set_id").agg(F.grouping_id().alias("level"), *_sums())


def budget_fleet(recommendations: DataFrame) -> DataFrame:
    return recommendations.agg(F.sum("current_budget").alias("current_budget"), F.sum("recommended_budget").alias("recommended_budget"),
                               F.avg("roas").alias("avg_roas"))


def health_fleet(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg("overall_score").alias("avg_health"), F.count(F.lit(1)).alias("clients"))


def audience_fleet(segments: DataFrame) -> DataFrame:
    return segments.agg(F.sum("size").alias("total_audience"), F.avg("avg_ltv").alias("avg_ltv"))


def optimization_summary(recommendations: DataFrame) -> DataFrame:
    return recommendations.agg(
        F.count(F.lit(1)).alias("campaigns"), F.count_if(F.col("action") != "maintain").alias("adjusted"),
        F.round(F.sum("current_budget"), 2).alias("budget_before"), F.round(F.sum("recommended_budget"), 2).alias("budget_after"))


def audience_size(members: DataFrame, exact: bool = False, rsd: float = 0.02) -> DataFrame:
    """Distinct users per segment, by sketch unless exact."""
    n = F.count_distinct("user_id") if exact else F.approx_count_distinct("user_id", rsd)
    return members.groupBy("segment").agg(n.alias("users"))


def audience_sketches(members: DataFrame) -> DataFrame:
    """Mergeable sketches per segment, so sizes of unions need no second scan."""
    return members.groupBy("segment").agg(F.hll_sketch_agg("user_id").alias("sketch"))


def feature_adoption(usage: DataFrame, n_features: int) -> DataFrame:
    return usage.groupBy("client_id").agg((F.count_distinct("feature") / n_features * 100).alias("feature_adoption"))


def support_sentiment(interactions: DataFrame) -> DataFrame:
    return interactions.where("interaction_type = 'support_ticket'").groupBy("client_id").agg(F.avg("sentiment").alias("support_sentiment_avg"))


def interaction_stats(interactions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Counts and averages per client over the trailing days."""
    last = F.lit(as_of).cast("date")
    day = F.col("occurred_at").cast("date")
    rows = interactions.where((day > F.date_sub(last, days)) & (day <= last))
    n = lambda kind: F.count_if(F.col("interaction_type") == kind)
    return rows.groupBy("client_id").agg(
        n("support_ticket").alias("tickets_30d"), n("meeting").alias("meetings_30d"), n("dashboard_login").alias("logins_30d"),
        F.avg("response_hours").alias("avg_response_hours"), F.avg("sentiment").alias("avg_sentiment"))


def video_engagement(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quartile retention, hook, completion, engagement and share rates of the sums."""
    names = ["impressions", "views", "views_2s", "p25", "p50", "p75", "p100", "likes", "comments", "shares"]
    s = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    return s.select(*keys, *[ratio(p, "views").alias(f"retention_{p}") for p in ("p25", "p50", "p75", "p100")],
                    ratio("views_2s", "views").alias("hook_rate"), ratio("p100", "views").alias("completion_rate"),
                    ratio(F.col("likes") + F.col("comments") + F.col("shares"), "impressions").alias("engagement_rate"),
                    ratio("shares", "impressions").alias("share_rate"))


def breakdown(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """KPIs by each dimension at once; every output row names its dimension."""
    wide = rows.select(*SUMS, *[c.alias(n) for n, c in dimensions.items()])
    sets = [[n] for n in dimensions]
    out = wide.groupingSets(sets, *dimensions).agg(F.grouping_id().alias("g"), *_sums())
    k = len(dimensions)
    # grouping_id has a 0 bit for the column in the set; columns count from the high bit
    name = F.coalesce(*[F.when(F.expr(f"(g & {1 << (k - 1 - i)}) = 0"), F.lit(n)) for i, n in enumerate(dimensions)])
    value = F.coalesce(*[F.col(n).cast("string") for n in dimensions])
    return kpis(out.select(name.alias("dimension"), value.alias("value"), *SUMS))


def conversions_by_weekday(rows: DataFrame, at: str) -> DataFrame:
    """Share of conversions per weekday (Monday 0) with the weekend flag."""
    n = rows.groupBy(F.weekday(at).alias("weekday")).agg(F.count(F.lit(1)).alias("conversions"))
    total = F.sum("conversions").over(Window.partitionBy())  # seven rows
    return n.select("weekday", "conversions", (F.col("conversions") / total).alias("share"), (F.col("weekday") >= 5).alias("is_weekend"))


def creative_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("creative_id").agg(*_sums())
