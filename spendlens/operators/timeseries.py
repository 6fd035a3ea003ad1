"""Series features, trends, forecasts, recency and sessions.

Daily series hold one row per entity and day, so a window per entity is bounded by the
calendar; event-level scans go through the bucketed scan instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.expr import clamp, days_between, epoch_us, ratio
from spendlens.functions.skew import ordered_scan, rank_by_value, top_n_per_key, with_totals

# Fixed values of the short-term forecast and the drift check.
EMA_SHORT, EMA_LONG = 3, 7
IMPROVING, DECLINING = 1.05, 0.95
DRIFT_WINDOW, DRIFT_MIN, DRIFT_LIMIT = 1000, 100, 0.15


def _newest_first(entity: str, day: str = "day"):
    return Window.partitionBy(entity).orderBy(F.desc(day))


def rank_days(metrics: DataFrame, entity: str = "campaign_id", day: str = "day") -> DataFrame:
    return metrics.withColumn("rn", F.row_number().over(_newest_first(entity, day)))


def campaign_series_features(metrics: DataFrame, entity: str = "campaign_id") -> DataFrame:
    """Rolling averages, slopes and volatility of the daily ratios per entity, in one aggregate."""
    rows = rank_days(metrics, entity).withColumns({
        "roas": ratio("revenue", "spend"), "ctr": ratio("clicks", "impressions"), "cvr": ratio("conversions", "clicks")})
    last = lambda k, c: F.when(F.col("rn") <= k, F.col(c))
    g = rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"t_{c}") for c in ("spend", "revenue", "clicks", "impressions", "conversions")],
        F.avg(last(7, "roas")).alias("r7"), F.avg(last(30, "roas")).alias("r30"), F.avg(last(7, "ctr")).alias("c7"), F.avg(last(7, "cvr")).alias("v7"),
        F.regr_slope(last(7, "roas"), (-F.col("rn")).cast("double")).alias("slope"),
        F.regr_slope(last(7, "cvr"), (-F.col("rn")).cast("double")).alias("cvr_slope"),
        F.stddev_pop("spend").alias("sd_spend"), F.stddev_pop("roas").alias("sd_roas"))
    total = ratio("t_revenue", "t_spend")
    n = F.col("n")
    return g.select(
        entity, total.alias("roas_total"),
        F.when(n >= 7, F.col("r7")).otherwise(total).alias("roas_7d_avg"), F.when(n >= 30, F.col("r30")).otherwise(total).alias("roas_30d_avg"),
        F.when(n >= 7, F.col("slope")).otherwise(0.0).alias("roas_trend_7d"),
        F.when(n >= 7, F.col("c7")).otherwise(ratio("t_clicks", "t_impressions")).alias("ctr_7d_avg"),
        F.when(n >= 7, F.col("v7")).otherwise(ratio("t_conversions", "t_clicks")).alias("cvr_7d_avg"),
        F.when(n >= 7, F.col("cvr_slope")).otherwise(0.0).alias("cvr_trend_7d"),
        F.when(n > 1, F.col("sd_spend")).otherwise(0.0).alias("spend_volatility"),
        F.when(n > 1, F.col("sd_roas")).otherwise(0.0).alias("roas_volatility"))


def slope(df: DataFrame, keys: list[str], at: Column, value: str, name: str) -> DataFrame:
    """Least-squares slope per key."""
    return df.groupBy(*keys).agg(F.coalesce(F.regr_slope(F.col(value), at.cast("double")), F.lit(0.0)).alias(name))


def percentile_in_group(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """percent_rank within the group: rows below over rows minus one."""
    r = rank_by_value(df, [group], value)
    share = F.when(F.col("group_rows") > 1, F.col("less") / (F.col("group_rows") - 1)).otherwise(0.0)
    return r.withColumn(name, share).drop("less", "group_rows")


def ema_weight(age: Column, n: Column, span: int) -> Column:
    """Weight of the value ``age`` steps before the newest of n in the seeded EMA."""
    alpha = 2.0 / (span + 1)
    return F.when(age == n - 1, F.pow(F.lit(1 - alpha), age)).otherwise(F.lit(alpha) * F.pow(F.lit(1 - alpha), age))


def ema(series: DataFrame, entity: str, value: str, span: int, rn: str = "rn", name: str = "ema") -> DataFrame:
    """Exponential moving average in closed form: a weighted sum, partially aggregated."""
    sized = with_totals(series, [entity], n=F.count(F.lit(1)))
    w = ema_weight(F.col(rn) - 1, F.col("n"), span)
    return sized.groupBy(entity).agg(F.sum(w * F.col(value)).alias(name))


def series_stats(series: DataFrame, entity: str = "campaign_id", value: str = "roas") -> DataFrame:
    """EMA of the last 7 (short) and of all (long), mean and deviation of each series."""
    sized = with_totals(series, [entity], n=F.count(F.lit(1)))
    age, v = F.col("rn") - 1, F.col(value)
    in7 = F.least(F.col("n"), F.lit(7))
    short = F.when(F.col("rn") <= 7, ema_weight(age, in7, EMA_SHORT) * v)
    return sized.groupBy(entity).agg(
        F.first("n").alias("n"), F.sum(short).alias("ema_short"), F.sum(ema_weight(age, F.col("n"), EMA_LONG) * v).alias("ema_long"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def trend_of(short: Column, long: Column) -> Column:
    return F.when(short > long * IMPROVING, "improving").when(short < long * DECLINING, "declining").otherwise("stable")


def coef_variation(n: Column, mean: Column, sd: Column) -> Column:
    return F.when(n < 2, 0.5).when(mean == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(sd, mean)))


def forecast(stats: DataFrame, current: DataFrame, entity: str = "campaign_id", value: str = "roas") -> DataFrame:
    """1 h / 6 h / 24 h outlook; entities without history take the short-series branch."""
    j = current.join(stats, entity, "left")
    cur, few = F.col(value), F.coalesce(F.col("n"), F.lit(0)) < 3
    trend = F.when(few, "stable").otherwise(trend_of(F.col("ema_short"), F.col("ema_long")))
    mult = F.when(trend == "improving", 1.05).when(trend == "declining", 0.95).otherwise(1.0)
    cv = coef_variation(F.col("n"), F.col("mean"), F.col("sd"))
    r2 = lambda c: F.round(c, 2)
    return j.withColumns({
        "trend": trend,
        "roas_1h": F.when(few, cur * 0.98).otherwise(r2(cur * (1 + (mult - 1) * 0.1))),
        "roas_6h": F.when(few, cur * 0.95).otherwise(r2(cur * 0.8 + F.col("mean") * 0.2)),
        "roas_24h": F.when(few, cur * 0.90).otherwise(r2(F.col("mean") * 0.7 + F.col("ema_long") * 0.3)),
        "forecast_confidence": F.when(few, 0.3).otherwise(r2(clamp(1 - cv, 0.3, 0.95))),
    }).drop("n", "ema_short", "ema_long", "mean", "sd")


def month_over_month(df: DataFrame, entity: str, at: str, amount: str) -> DataFrame:
    """Relative change of the monthly sum against the entity's previous month with data."""
    m = df.groupBy(entity, F.date_trunc("month", F.col(at).cast("timestamp")).cast("date").alias("month")).agg(F.sum(amount).alias("revenue"))
    prev = F.lag("revenue").over(Window.partitionBy(entity).orderBy("month"))
    return m.withColumn("revenue_mom_change", F.try_divide(F.col("revenue") - prev, prev))


def roas_change(metrics: DataFrame, entity: str = "campaign_id") -> DataFrame:
    """Relative ROAS change from one day with data to the next."""
    r = metrics.select(entity, "day", ratio("revenue", "spend").alias("roas"))
    prev = F.lag("roas").over(Window.partitionBy(entity).orderBy("day"))
    return r.withColumn("roas_change", F.try_divide(F.col("roas") - prev, prev))


def health_trends(snapshots: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Snapshots in the window, slope per week and its direction."""
    last = F.lit(as_of).cast("date")
    rows = snapshots.where((F.col("snapshot_date") > F.date_sub(last, days)) & (F.col("snapshot_date") <= last))
    weekly = F.coalesce(F.regr_slope(F.col("health_score").cast("double"), F.datediff("snapshot_date", last).cast("double")) * 7, F.lit(0.0))
    g = rows.groupBy("client_id").agg(F.count(F.lit(1)).alias("snapshots"), weekly.alias("avg_weekly_change"))
    return g.withColumn("direction", F.when(F.col("avg_weekly_change") > 1e-9, "improving").when(F.col("avg_weekly_change") < -1e-9, "declining").otherwise("stable"))


def drift(predictions: DataFrame) -> DataFrame:
    """Mean of the newer half against the older half of the last 1000 predictions per model."""
    kept = top_n_per_key(predictions, ["model"], [F.desc("ts"), F.desc("id")], DRIFT_WINDOW, salt_on=["id"], rank="rn")
    sized = kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("model")))  # at most 1000 rows
    older = F.col("rn") > F.col("n") - F.floor(F.col("n") / 2)
    g = sized.groupBy("model").agg(F.max("n").alias("n"), F.avg(F.when(older, F.col("prediction"))).alias("historical_mean"),
                                   F.avg(F.when(~older, F.col("prediction"))).alias("recent_mean"))
    score = F.abs(F.col("recent_mean") - F.col("historical_mean")) / (F.col("historical_mean") + 1e-6)
    return g.where(F.col("n") >= DRIFT_MIN).withColumn("drift_score", score).withColumn("drift_detected", F.col("drift_score") > DRIFT_LIMIT)


def rolling_counts(events: DataFrame, entity: str, at: str, days: list[int]) -> DataFrame:
    """Events in the trailing days at every event day, per entity.

    Counted per day first, so the range window sees one row per entity and day.
    """
    daily = events.groupBy(entity, F.col(at).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    day_no = F.datediff("day", F.lit("1970-01-01").cast("date"))
    by_day = Window.partitionBy(entity).orderBy(day_no)
    return daily.withColumns({f"events_{d}d": F.sum("events").over(by_day.rangeBetween(-(d - 1), 0)) for d in days})


def days_since_last(events: DataFrame, entity: str, at: str, as_of: str) -> DataFrame:
    return events.groupBy(entity).agg(F.datediff(F.lit(as_of).cast("date"), F.max(F.col(at).cast("date"))).alias("days_since_last"))


def mark_sessions(events: DataFrame, user: str = "user_id", at: str = "ts", key: str = "event_id", gap_minutes: int = 30) -> DataFrame:
    """Rows with the gap before them, whether they open a session and whether they close one."""
    gap = gap_minutes * 60 * 1_000_000
    hour = F.date_trunc("hour", F.col(at).cast("timestamp"))
    rows = ordered_scan(events, [user], [at, key], hour, lag={"prev_at": F.col(at)}, lead={"next_at": F.col(at)})
    since = epoch_us(at) - epoch_us("prev_at")
    until = epoch_us("next_at") - epoch_us(at)
    return rows.withColumns({
        "opens": F.col("prev_at").isNull() | (since > gap), "closes": F.col("next_at").isNull() | (until > gap),
        "idle_s": F.when(since <= gap, since / 1e6).otherwise(0.0)}).drop("prev_at", "next_at")


def sessionize(events: DataFrame, user: str = "user_id", at: str = "ts", key: str = "event_id", gap_minutes: int = 30) -> DataFrame:
    """One row per session: number within the user, start, end, events and seconds."""
    marked = mark_sessions(events, user, at, key, gap_minutes)
    hour = F.date_trunc("hour", F.col(at).cast("timestamp"))
    rows = ordered_scan(marked, [user], [at, key], hour, before={"opened": F.col("opens").cast("bigint")})
    number = F.col("opened") + F.col("opens").cast("bigint")
    s = rows.groupBy(user, number.alias("session_no")).agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count(F.lit(1)).alias("events"))
    return s.withColumn("duration_s", days_between("ended_at", "started_at") * 86400)
