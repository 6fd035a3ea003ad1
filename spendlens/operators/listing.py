"""Filters, listings, search, top-k and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.expr import once
from spendlens.functions.skew import last_per_key, ordered_scan


def where_all(df: DataFrame, **equals) -> DataFrame:
    """Equality filters; an argument that is None does not filter."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def contains_text(column: str, needle: str) -> Column:
    return F.contains(F.lower(column), F.lit(needle.lower()))


def page(df: DataFrame, key: str, page_no: int, size: int, bucket: Column) -> DataFrame:
    """One 1-based page along a unique key, with the total beside every row.

    The row number comes from a bucketed scan, so a deep page sorts no more than its buckets
    and no task sees the whole table.
    """
    low = (page_no - 1) * size
    numbered = ordered_scan(df, [], [key], bucket, row_number="row_no")
    total = df.agg(F.count(F.lit(1))).scalar()
    return numbered.where((F.col("row_no") > low) & (F.col("row_no") <= low + size)).withColumn("total", total)


def list_campaigns(df: DataFrame, client: int | None = None, platform: str | None = None, status: str | None = None,
                   page_no: int = 1, size: int = 50) -> DataFrame:
    rows = where_all(df, client_id=client, platform=platform, status=status)
    return page(rows, "campaign_id", page_no, size, F.floor(F.col("campaign_id") / 10000))


def list_clients(df: DataFrame, is_active: bool | None = None, industry: str | None = None, search: str | None = None,
                 page_no: int = 1, size: int = 50) -> DataFrame:
    rows = where_all(df, is_active=is_active, industry=industry)
    if search:
        rows = rows.where(contains_text("client_name", search))
    return page(rows, "client_id", page_no, size, F.floor(F.col("client_id") / 10000))


def _padded(text: str) -> str:
    return f"  {text.lower()} "


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the lower-cased text between two leading blanks and a trailing one."""
    join = lambda a, b: F.concat(a, b)
    letters = F.split(F.concat(F.lit("  "), F.lower(text), F.lit(" ")), "")
    grams = F.zip_with(F.zip_with(letters, F.slice(letters, F.lit(2), F.size(letters)), join), F.slice(letters, F.lit(3), F.size(letters)), join)
    return F.array_distinct(F.filter(grams, lambda g: g.isNotNull()))


def creative_search(creatives: DataFrame, text: str, min_similarity: float, column: str = "headline") -> DataFrame:
    """Creatives whose trigram sets overlap the query's; a projection, no join."""
    wanted = sorted({_padded(text)[i:i + 3] for i in range(len(_padded(text)) - 2)})
    grams = once(creatives, {"__g": trigrams(F.col(column))})
    grams = once(grams, {"__n": F.size(F.array_intersect("__g", F.array(*[F.lit(g) for g in wanted])))})
    share = F.col("__n") / (F.size("__g") + len(wanted) - F.col("__n"))
    return grams.withColumn("similarity", share).drop("__g", "__n").where(F.col("similarity") >= min_similarity)


def client_health(scored: DataFrame, risk: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    rows = where_all(scored, risk_level=risk)
    if low is not None:
        rows = rows.where(F.col("overall_score") >= low)
    return rows.where(F.col("overall_score") <= high) if high is not None else rows


def churn_alerts(alerts: DataFrame, status: str = "open", alert_type: str | None = None, limit: int = 50) -> DataFrame:
    rows = where_all(alerts, status=None if status == "all" else status, alert_type=alert_type)
    return rows.orderBy(F.desc("created_at"), "alert_id").limit(limit)


def at_risk(scored: DataFrame, as_of: str, threshold: float = 50, limit: int = 20) -> DataFrame:
    """Lowest scores first by churn probability; days_to_renewal counts from as_of."""
    days = F.datediff(F.col("contract_end"), F.lit(as_of).cast("date"))
    return scored.where(F.col("overall_score") < threshold).withColumn("days_to_renewal", days).orderBy(
        F.desc("churn_probability"), "client_id").limit(limit)


def journeys(paths: DataFrame, touches: DataFrame, client: int, start: str, end: str, channel: str | None = None,
             min_touchpoints: int = 1, limit: int = 100) -> DataFrame:
    """Converted journeys ending in the range; a channel restricts to journeys that hold it."""
    day = F.col("last_touch_at").cast("date")
    rows = paths.where(F.col("converted") & (F.col("client_id") == client) & (F.col("touchpoints") >= min_touchpoints)
                       & day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if channel:
        rows = rows.join(touches.where(F.col("channel") == channel).select("path_id"), "path_id", "left_semi")
    return rows.orderBy("path_id").limit(limit)


def newest(df: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(at), key).limit(limit)


def active_alerts(alerts: DataFrame, severity: str | None = None, alert_type: str | None = None, resolved: bool = False) -> DataFrame:
    """Unresolved alerts, newest first; asking for resolved ones ignores both filters."""
    if resolved:
        rows = alerts.where("resolved_at is not null")
    else:
        rows = where_all(alerts.where("resolved_at is null"), severity=severity, alert_type=alert_type)
    return rows.orderBy(F.desc("created_at"), "alert_id")


def top_campaigns(state: DataFrame, k: int = 4) -> DataFrame:
    return state.orderBy(F.desc("roas"), "campaign_id").limit(k).select(
        "campaign_id", "campaign_name", F.round("roas", 2).alias("roas"), F.round("spend_today", 2).alias("spend"))


def soft_delete(clients: DataFrame, ids: DataFrame, key: str = "client_id") -> DataFrame:
    """The client table after marking the given ids inactive; no row is removed."""
    gone = ids.select(key).distinct().withColumn("__gone", F.lit(True))
    return clients.join(gone, key, "left").withColumn("is_active", F.col("is_active") & F.col("__gone").isNull()).drop("__gone")


def latest_versions(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return last_per_key(df, keys, [version])


def campaign_creatives(campaign_id: int, ad_sets: DataFrame, creatives: DataFrame) -> DataFrame:
    return creatives.join(ad_sets.where(F.col("campaign_id") == campaign_id), "ad_set_id")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; a missing id gives no rows."""
    return df.where(F.col(key) == value)
