"""Writers: monthly partitions, upserts and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.skew import last_per_key
from spendlens.operators.quality import Rule, failed_rules, rules_for
from spendlens.session import shared_scratch
from spendlens.sources.landed import hashed


def write_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append metric rows into monthly partitions.

    Rows are dealt by month and a busy month is split by its size, so that as many tasks write
    it as it needs; they are sorted so that Parquet min/max skips on entity and day.
    """
    rows = df.withColumn("month", F.date_format("day", "yyyy-MM"))
    (rows.hint("rebalance", "month").sortWithinPartitions("month", "entity_type", "entity_id", "day")
        .write.partitionBy("month").mode(mode).parquet(path))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], as_of: Column, version: str = "updated_at") -> DataFrame:
    """Rows after replacing by key; replaced and new rows carry as_of as their version."""
    fresh = last_per_key(updates, keys, [version]).withColumn(version, as_of)
    both = target.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    return last_per_key(both, keys, ["__new", version]).drop("__new")


def upsert_partitions(path: str, updates: DataFrame, keys: list[str], as_of: Column, partition: str) -> None:
    """Upsert into a partitioned table, rewriting only the partitions the updates touch.

    The key must contain the partition column.  The new content is staged beside the table
    first, because a folder cannot be read and replaced in one job.
    """
    spark = updates.sparkSession
    touched = updates.select(partition).distinct()
    target = spark.read.parquet(path).join(touched, partition, "left_semi")
    stage = shared_scratch(spark, "upsert")
    upsert(target, updates, keys, as_of).write.parquet(stage)
    spark.read.parquet(stage).write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_features(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.partitionBy("entity_type").mode(mode).parquet(path)


def read_features(spark: SparkSession, path: str, entity_type: str, entity_id: str) -> DataFrame:
    """Point lookup; an unknown entity gives no rows."""
    return spark.read.parquet(path).where((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id))


def append_log(df: DataFrame, path: str, schema: str, stamp: str, as_of: Column) -> None:
    """Append typed log rows; a missing time stamp becomes as_of."""
    names = [f.strip().split(" ")[0] for f in _split_schema(schema)]
    kinds = [f.strip().split(" ", 1)[1] for f in _split_schema(schema)]
    rows = df.withColumn(stamp, F.coalesce(F.col(stamp), as_of) if stamp in df.columns else as_of)
    rows.select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds)]).write.mode("append").parquet(path)


def _split_schema(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return out


def log_interaction(df: DataFrame, path: str) -> None:
    """Append interactions; a row outside the allowed types stops the write."""
    rules: list[Rule] = rules_for("client_interactions")
    bad = F.size(failed_rules(rules)) > 0
    checked = df.withColumn("interaction_type", F.when(bad, F.raise_error(F.concat(F.lit("bad interaction type: "), "interaction_type")))
                            .otherwise(F.col("interaction_type")))
    checked.write.mode("append").parquet(path)


def audience_members(members: DataFrame, contacts: DataFrame, platform: str) -> DataFrame:
    """Members with the hashed contact one platform takes; is_invalid where there is none."""
    j = members.join(contacts, "user_id", "left")
    return j.select("segment", F.lit(platform).alias("platform"), "user_id", hashed("email").alias("email_hash"),
                    (~F.coalesce(F.contains(F.col("email"), F.lit("@")), F.lit(False))).alias("is_invalid"))


def export_counts(exported: DataFrame) -> DataFrame:
    return exported.groupBy("segment", "platform").agg(F.count(F.lit(1)).alias("num_received"), F.count_if("is_invalid").alias("num_invalid"))


def export_audience(members: DataFrame, contacts: DataFrame, platform: str, path: str) -> DataFrame:
    """Write the valid members by platform and return the received / invalid counts."""
    rows = audience_members(members, contacts, platform)
    rows.where("not is_invalid").drop("is_invalid").write.partitionBy("platform").mode("append").parquet(path)
    return export_counts(rows)
