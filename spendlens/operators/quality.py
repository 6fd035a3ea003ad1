"""Validation, constraint checks, deduplication and change detection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.skew import first_per_key, join_back, ordered_scan


@dataclass(frozen=True)
class Rule:
    """A named check; any boolean Column, built-in or from a pandas UDF."""

    name: str
    check: Column


# Allowed codes of the enumerated columns.
PLATFORMS = ["meta", "google", "tiktok"]
ACCOUNT_PLATFORMS = ["meta", "google", "tiktok", "linkedin", "twitter"]
CREATIVE_TYPES = ["image", "video", "carousel", "collection", "dynamic"]
ENTITY_TYPES = ["account", "campaign", "adset", "ad"]
INTERACTION_TYPES = ["slack_message", "email", "call", "meeting", "dashboard_login", "support_ticket", "payment"]
ALERT_TYPES = ["critical", "warning", "monitor"]
SEGMENT_TYPES = ["cluster", "lookalike", "custom", "retargeting"]
ACTION_TYPES = ["budget_increase", "budget_decrease", "pause", "resume", "bid_adjustment", "targeting_change"]


def rules_for(table: str) -> list[Rule]:
    """Load-time rules (campaigns, metrics) and declared constraints (other tables)."""
    c = F.col
    between = lambda name, low, high: Rule(f"{name}_range", c(name).isNull() | c(name).between(low, high))
    one_of = lambda name, values: Rule(f"{name}_enum", c(name).isNull() | c(name).isin(values))
    table_rules = {
        "campaigns": lambda: [Rule("external_id_required", c("external_id").isNotNull()), Rule("name_required", c("name").isNotNull()),
                              Rule("platform_valid", F.coalesce(c("platform").isin(PLATFORMS), F.lit(False)))],
        "metrics": lambda: [Rule(f"{m}_non_negative", F.coalesce(c(m).cast("double"), F.lit(-1.0)) >= 0) for m in ("impressions", "clicks", "spend")],
        "clients": lambda: [between("health_score", 0, 100), between("churn_probability", 0, 1)],
        "client_health_snapshots": lambda: [between("overall_score", 0, 100)],
        "ad_accounts": lambda: [one_of("platform", ACCOUNT_PLATFORMS)],
        "ad_creatives": lambda: [one_of("creative_type", CREATIVE_TYPES)],
        "performance_metrics": lambda: [one_of("entity_type", ENTITY_TYPES)],
        "client_interactions": lambda: [one_of("interaction_type", INTERACTION_TYPES)],
        "churn_alerts": lambda: [one_of("alert_type", ALERT_TYPES)],
        "audience_segments": lambda: [one_of("segment_type", SEGMENT_TYPES)],
        "optimization_actions": lambda: [one_of("action_type", ACTION_TYPES)],
    }
    return table_rules[table]()


def failed_rules(rules: list[Rule]) -> Column:
    """Names of the rules a row fails; an undecided (NULL) check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(r.check, F.lit(False)), F.lit(r.name)) for r in rules]))


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.withColumn("failed", failed_rules(rules)).withColumn("is_valid", F.size("failed") == 0)


def validation_summary(df: DataFrame, rules: list[Rule]) -> DataFrame:
    v = validate(df, rules)
    return v.agg(F.count(F.lit(1)).alias("total_records"), F.count_if("is_valid").alias("valid_records"),
                 F.count_if(~F.col("is_valid")).alias("invalid_records")).withColumn("valid", F.col("invalid_records") == 0)


def validation_errors(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per record and failed rule."""
    return validate(df, rules).select(*df.columns, F.explode("failed").alias("rule"))


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    return validation_errors(df, rules_for(table))


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of every key along the ingest order; NULL is a key value."""
    return first_per_key(df, keys, order)


def dedupe_nested(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As dedupe, nested key parts compared by their JSON text."""
    texts = {f"__j{i}": F.to_json(F.struct(F.col(k))) for i, k in enumerate(keys)}
    return first_per_key(df.withColumns(texts), list(texts), order).drop(*texts)


def checksum(columns: list[str]) -> Column:
    """md5 of the record as JSON with sorted keys."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}))


def changed_only(df: DataFrame, previous: DataFrame, key: str, order: str, payload: list[str], bucket_rows: int = 100000) -> DataFrame:
    """Rows whose checksum differs from the last one seen for the id, in the batch or before it."""
    marked = df.withColumn("checksum", checksum(payload))
    scanned = ordered_scan(marked, [key], [order], F.floor(F.col(order) / bucket_rows), lag={"prev_checksum": F.col("checksum")})
    joined = join_back(scanned, previous.select(key, F.col("checksum").alias("stored_checksum")), [key], "left")
    last = F.coalesce("prev_checksum", "stored_checksum")
    return joined.where(~F.col("checksum").eqNullSafe(last)).drop("prev_checksum", "stored_checksum")


def since(df: DataFrame, watermarks: DataFrame, source: str, updated: str) -> DataFrame:
    """Rows newer than their source's high-water mark; sources never synced come whole."""
    joined = join_back(df, watermarks.select(source, "synced_at"), [source], "left")
    return joined.where(F.col("synced_at").isNull() | (F.col(updated) > F.col("synced_at"))).drop("synced_at")


def mark_synced(df: DataFrame, watermarks: DataFrame, source: str, updated: str) -> DataFrame:
    """High-water marks after a load."""
    seen = df.select(source, F.col(updated).alias("synced_at")).unionByName(watermarks.select(source, "synced_at"))
    return seen.groupBy(source).agg(F.max("synced_at").alias("synced_at"))


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows with a foreign key that has no parent (a NULL key is allowed)."""
    ids = parent.select(F.col(pk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(ids, fk, "left_anti")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def run_log(campaigns: DataFrame, metrics: DataFrame, failed_sources: list[str] | None = None) -> DataFrame:
    """Per source: campaign plus metric rows processed, invalid rows (still loaded) and status."""
    c = campaigns.select("platform", F.lit(1).alias("is_campaign"), (F.size(failed_rules(rules_for("campaigns"))) > 0).alias("bad"))
    m = metrics.select("platform", F.lit(0).alias("is_campaign"), (F.size(failed_rules(rules_for("metrics"))) > 0).alias("bad"))
    log = c.unionByName(m).groupBy(F.col("platform").alias("source")).agg(
        F.count(F.lit(1)).alias("records_processed"), F.sum("is_campaign").alias("campaigns"), F.count_if("bad").alias("invalid_rows"))
    log = log.withColumn("status", F.lit("completed"))
    if failed_sources:
        none = F.lit(0).cast("bigint")
        bad = log.sparkSession.createDataFrame([(s,) for s in failed_sources], "source string").select(
            "source", none.alias("records_processed"), none.alias("campaigns"), none.alias("invalid_rows"), F.lit("failed").alias("status"))
        log = log.unionByName(bad)
    return log


def load_total(campaigns: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Rows a run loads: campaigns after dedupe plus all metric rows."""
    distinct = campaigns.select(*keys).distinct().select(F.lit(1).alias("one"))
    return distinct.unionByName(metrics.select(F.lit(1).alias("one"))).agg(F.count("one").alias("total_loaded"))
