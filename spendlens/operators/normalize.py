"""Platform extracts to one campaign and one metric layout, KPIs and entity features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.expr import nz, ratio
from spendlens.functions.skew import join_back

CAMPAIGN_COLUMNS = ["external_id", "platform", "name", "status", "objective", "daily_budget", "lifetime_budget", "start_date", "end_date"]
METRIC_SUMS = ["impressions", "reach", "clicks", "spend", "conversions", "conversion_value"]
PASS_THROUGH = ("crm", "email", "analytics")


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def normalize_campaigns(df: DataFrame, source: str) -> DataFrame:
    """One layout for campaigns of every platform; other sources pass unchanged."""
    if source in PASS_THROUGH:
        return df
    status = F.lower("status")
    if source == "meta":  # budgets arrive in cents; 0 means no lifetime budget
        life = F.col("lifetime_budget")
        cols = [F.coalesce(F.nullif(F.col("campaign_id"), F.lit("")), F.col("id")), F.lit("meta"), F.col("name"), status, F.col("objective"),
                nz("daily_budget", 0.0) / 100, F.when(life != 0, life / 100), F.col("start_time"), F.col("stop_time")]
    elif source == "google":
        cols = [F.col("campaign_id"), F.lit("google"), F.col("name"), status, F.col("advertising_channel_type"),
                F.col("budget_amount"), _nothing("double"), F.col("start_date"), F.col("end_date")]
    elif source == "tiktok":
        mode = F.col("budget_mode")
        cols = [F.col("campaign_id"), F.lit("tiktok"), F.col("campaign_name"), status, F.col("objective_type"),
                F.when(mode == "BUDGET_MODE_DAY", F.col("budget")), F.when(mode == "BUDGET_MODE_TOTAL", F.col("budget")),
                _nothing("string"), _nothing("string")]
    else:
        raise ValueError(f"unknown source {source}")
    return df.select(*[c.alias(n) for c, n in zip(cols, CAMPAIGN_COLUMNS)])


def normalize_metrics(df: DataFrame, source: str, keep: list[str] | None = None) -> DataFrame:
    """One layout for daily metric rows; ``keep`` names key columns carried along."""
    if source in PASS_THROUGH:
        return df
    zero = F.lit(0).cast("bigint")
    first = lambda a, kind: F.coalesce(F.try_element_at(F.col(a), F.lit(1))["value"].cast(kind), F.lit(0).cast(kind))
    if source == "meta":  # only the first action counts
        cols = [nz("impressions"), nz("reach"), nz("clicks"), nz("spend", 0.0), first("actions", "int").cast("double"),
                first("action_values", "double"), nz("ctr", 0.0), nz("cpc", 0.0), nz("cpm", 0.0)]
    elif source == "google":  # money in micros
        cols = [nz("impressions"), zero, nz("clicks"), nz("cost_micros") / 1e6, nz("conversions", 0.0),
                nz("conversions_value", 0.0), nz("ctr", 0.0), nz("average_cpc") / 1e6, nz("average_cpm") / 1e6]
    elif source == "tiktok":  # no conversion value in the extract
        cols = [nz("impressions"), nz("reach"), nz("clicks"), nz("spend", 0.0), nz("conversions").cast("double"),
                F.lit(0.0), nz("ctr", 0.0), nz("cpc", 0.0), nz("cpm", 0.0)]
    else:
        raise ValueError(f"unknown source {source}")
    names = [*METRIC_SUMS, "ctr", "cpc", "cpm"]
    return df.select(*(keep or []), F.lit(source).alias("platform"), *[c.alias(n) for c, n in zip(cols, names)])


def derive_metrics(df: DataFrame) -> DataFrame:
    """roas, cvr in percent and cpa on normalised metric rows."""
    return df.withColumns({
        "roas": ratio("conversion_value", "spend", 0.01),
        "cvr_pct": ratio("conversions", "clicks", 1) * 100,
        "cpa": ratio("spend", "conversions", 1)})


def transform(df: DataFrame, source: str | None, kind: str, keep: list[str] | None = None) -> DataFrame:
    """Plan-time dispatch on source and declared table kind; no source leaves rows alone."""
    if not source or source in PASS_THROUGH:
        return df
    if kind == "metrics":
        return derive_metrics(normalize_metrics(df, source, keep))
    if kind == "campaigns":
        return normalize_campaigns(df, source)
    raise ValueError(f"unknown kind {kind}")


def unify_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def kpi_columns() -> dict[str, Column]:
    """Ratios of the summed spend, revenue, clicks, impressions and conversions."""
    return {
        "ctr": ratio("clicks", "impressions"), "cvr": ratio("conversions", "clicks"), "cpc": ratio("spend", "clicks"),
        "cpm": ratio("spend", "impressions") * 1000, "cpa": ratio("spend", "conversions"), "roas": ratio("revenue", "spend")}


def kpis(df: DataFrame) -> DataFrame:
    return df.withColumns(kpi_columns())


def temporal_features(df: DataFrame, ts: str) -> DataFrame:
    hour, dow, month = F.hour(ts), F.weekday(ts), F.month(ts)
    wave = lambda c, period: c * (2 * 3.141592653589793 / period)
    return df.withColumns({
        "hour": hour, "day_of_week": dow, "day_of_month": F.dayofmonth(ts), "month": month,
        "hour_sin": F.sin(wave(hour, 24)), "hour_cos": F.cos(wave(hour, 24)),
        "dow_sin": F.sin(wave(dow, 7)), "dow_cos": F.cos(wave(dow, 7)),
        "month_sin": F.sin(wave(month, 12)), "month_cos": F.cos(wave(month, 12)),
        "is_weekend": (dow >= 5).cast("int"), "is_month_start": (F.dayofmonth(ts) <= 7).cast("int"),
        "is_month_end": (F.dayofmonth(ts) >= 25).cast("int")})


def is_holiday(df: DataFrame, holidays: DataFrame, day: str, country: str) -> DataFrame:
    """Flag days listed for the row's country; the calendar is small, AQE decides on broadcast."""
    cal = holidays.select(F.col("country").alias(country), F.col("day").alias(day), F.lit(True).alias("is_holiday")).distinct()
    return join_back(df, cal, [country, day], "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))


def client_features(df: DataFrame) -> DataFrame:
    """Client feature row with the defaults for what is missing."""
    return df.select(
        "client_id",
        nz("monthly_spend", 0.0).alias("monthly_spend"), nz("revenue_mom_change", 0.0).alias("revenue_mom_change"),
        (nz("current_roas", 1.0) / F.greatest(nz("target_roas", 1.0), F.lit(0.1))).alias("roas_vs_target"),
        nz("logins_7d").alias("login_count_7d"), nz("logins_30d").alias("login_count_30d"), (nz("logins_30d") / 30).alias("login_frequency"),
        nz("response_hours", 24.0).alias("response_time_hours"), nz("last_contact_days").alias("days_since_contact"),
        nz("meeting_rate", 0.8).alias("meeting_attendance_rate"), nz("payment_delay_days", 0.0).alias("payment_delay_avg"),
        nz("invoices_outstanding").alias("invoices_outstanding"), nz("tenure_months").alias("tenure_months"),
        nz("contract_days_remaining", 365).alias("contract_days_remaining"),
        nz("is_month_to_month", False).cast("bigint").alias("is_month_to_month"))


def long_features(df: DataFrame, kind: str, key: str) -> DataFrame:
    """(entity_type, entity_id, feature, value) rows of a wide feature table."""
    names = [c for c in df.columns if c != key]
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))
    return df.select(F.lit(kind).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), F.explode(pairs).alias("feature", "value"))


def compute_features(campaigns: DataFrame, creatives: DataFrame, clients: DataFrame) -> DataFrame:
    """All entity features in one long table keyed by (entity_type, entity_id)."""
    return unify_sources(long_features(campaigns, "campaign", "campaign_id"), long_features(creatives, "creative", "creative_id"),
                         long_features(clients, "client", "client_id"))


def budget_utilization(df: DataFrame, spend: str = "spend", budget: str = "budget") -> DataFrame:
    used = F.try_divide(F.col(spend), F.col(budget))
    return df.withColumns({"budget_util": used, "budget_remaining_percent": (1 - used) * 100})
