"""Readers of landed platform extracts, files with explicit schemas only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens import schemas


def _with_corrupt(schema: str) -> str:
    return f"{schema}, _corrupt_record string"


def read_json(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """Bad lines come along in _corrupt_record, so they reach the validation report."""
    return spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE").json(path)


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The same parse for JSON text already in a column (message bus, landed text tables)."""
    got = F.from_json(column, _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(got.alias("r")).select("r.*")


def read_campaigns(spark: SparkSession, source: str, path: str, status_filter: list[str] | None = None) -> DataFrame:
    return filter_status(read_json(spark, schemas.RAW_CAMPAIGNS[source], path), status_filter)


def filter_status(df: DataFrame, status_filter: list[str] | None) -> DataFrame:
    """Optional allow-list; it reaches the scan as a pushed filter."""
    return df.where(F.col("status").isin(status_filter)) if status_filter else df


def read_metrics(spark: SparkSession, source: str, path: str) -> DataFrame:
    return read_json(spark, schemas.RAW_METRICS[source], path)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, schemas.ACCOUNTS, path)


def read_adsets(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, schemas.AD_SETS, path)


def read_ads(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, schemas.ADS, path)


def read_creatives(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, schemas.CREATIVES, path)


def insights(metrics: DataFrame, as_of: str, start: str | None = None, end: str | None = None,
             entity: tuple[str, int] | None = None) -> DataFrame:
    """Daily rows in the closed range; by default the last seven days up to as_of, eight dates."""
    last = end or as_of
    first = start or (dt.date.fromisoformat(last) - dt.timedelta(days=7)).isoformat()
    out = metrics.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return out.where(F.col(entity[0]) == entity[1]) if entity else out


def read_customer_csv(spark: SparkSession, path: str) -> DataFrame:
    """Customer list upload; only CSV is taken and e-mails leave as hashes."""
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError("customer lists must be CSV files")
    return hash_customers(spark.read.option("header", True).schema(schemas.CUSTOMERS).csv(path))


def parse_customer_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return hash_customers(lines.select(F.from_csv(column, schemas.CUSTOMERS).alias("r")).select("r.*"))


def hash_customers(df: DataFrame) -> DataFrame:
    return df.select(hashed("email").alias("email_hash"), "purchase_value", "purchase_date")


def hashed(column: str):
    """SHA-256 of the trimmed lower-case text, the form platforms match on."""
    return F.sha2(F.lower(F.trim(F.col(column))), 256)


def sync_counts(accounts: DataFrame, campaigns: DataFrame, ad_sets: DataFrame, ads: DataFrame) -> DataFrame:
    """Entities per level below every account, counted bottom-up so that no level is multiplied."""
    n = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    ads_in = ads.groupBy("ad_set_id").agg(F.count(F.lit(1)).alias("ads"))
    sets_in = ad_sets.join(ads_in, "ad_set_id", "left").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("ad_sets"), n("ads"))
    camps_in = campaigns.join(sets_in, "campaign_id", "left").groupBy("account_id").agg(F.count(F.lit(1)).alias("campaigns"), n("ad_sets"), n("ads"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return accounts.join(camps_in, "account_id", "left").select("account_id", zero("campaigns"), zero("ad_sets"), zero("ads"))


def keyword_report(keywords: DataFrame, metrics: DataFrame, start: str, end: str) -> DataFrame:
    """Metrics per keyword and match type with the average quality score."""
    rows = metrics.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    sums = rows.groupBy("keyword_id").agg(*[F.sum(c).alias(c) for c in ("impressions", "clicks", "conversions", "spend")])
    return keywords.join(sums, "keyword_id").groupBy("keyword", "match_type").agg(
        *[F.sum(c).alias(c) for c in ("impressions", "clicks", "conversions", "spend")], F.avg("quality_score").alias("quality_score"))


def search_terms_report(terms: DataFrame, keywords: DataFrame) -> DataFrame:
    """Search terms with the keyword that matched them."""
    return terms.join(keywords.select("keyword_id", "keyword", "match_type"), "keyword_id").groupBy("search_term", "keyword", "match_type").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))


def read_event_bus(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Raw events from the message bus, from the earliest offset."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("startingOffsets", "earliest").load()
            .select(F.col("key").cast("string").alias("source"), F.col("value").cast("string").alias("payload"), F.col("timestamp").alias("ts")))


def read_event_files(spark: SparkSession, schema: str, path: str, max_files: int | None = None) -> DataFrame:
    """The same stream from landed JSON files."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).json(path)
