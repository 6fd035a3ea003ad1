"""Join shapes of the entity model; Catalyst and AQE choose the physical join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.skew import join_back, last_per_key
from spendlens.functions.metric import neighbour_counts as vector_neighbour_counts  # noqa: F401  (the range self-join over whole vectors)
from spendlens.functions.spatial import neighbour_counts  # noqa: F401  (the range self-join)


def entity_chain(clients: DataFrame, accounts: DataFrame, campaigns: DataFrame, ad_sets: DataFrame, ads: DataFrame, how: str = "inner") -> DataFrame:
    """client → account → campaign → ad set → ad."""
    return (clients.join(accounts, "client_id", how).join(campaigns, "account_id", how)
            .join(ad_sets, "campaign_id", how).join(ads, "ad_set_id", how))


def polymorphic(facts: DataFrame, dimensions: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Facts keyed (entity_type, entity_id) with the name out of the matching dimension."""
    parts = []
    for kind, (dim, key, name) in dimensions.items():
        names = dim.select(F.col(key).alias("entity_id"), F.col(name).alias("entity_name"))
        parts.append(facts.where(F.col("entity_type") == kind).join(names, "entity_id"))
    return reduce(DataFrame.unionByName, parts)


def touch_campaign(touches: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Touchpoints keep their row when the campaign is missing."""
    return touches.join(campaigns.select("campaign_id", "campaign_name", "platform"), "campaign_id", "left")


def predictions_with_actuals(predictions: DataFrame, actuals: DataFrame, order: str = "seq") -> DataFrame:
    """Predictions with their last logged actual; the rest is dropped."""
    last = last_per_key(actuals, ["model", "id"], [order]).select("model", "id", "actual")
    return predictions.join(last, ["model", "id"])


def latest_snapshot(clients: DataFrame, snapshots: DataFrame, as_of: str) -> DataFrame:
    """Clients with the newest snapshot not after as_of."""
    seen = snapshots.where(F.col("snapshot_date") <= F.lit(as_of).cast("date"))
    return clients.join(last_per_key(seen, ["client_id"], ["snapshot_date"]), "client_id", "left")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Every left row with the newest right values at or before it.

    Both sides become one timeline per key; the last value is carried by a bucketed scan, so
    neither a hot key nor a long history meets in one task.
    """
    side = F.col("__side")
    carried = F.struct(*[F.col(v) for v in values], F.col(right_at).alias("__at"))
    r = right.groupBy(key, right_at).agg(*[F.max(v).alias(v) for v in values])
    r = r.select(F.col(key).alias("__key"), F.col(right_at).alias("__t"), F.lit(0).alias("__side"), carried.alias("__v"), F.lit(None).alias("__row"))
    rows = F.struct(*[F.col(c) for c in left.columns])
    v_type = r.schema["__v"].dataType
    lo = left.select(F.col(key).alias("__key"), F.col(left_at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(v_type).alias("__v"), rows.alias("__row"))
    line = r.withColumn("__row", F.lit(None).cast(lo.schema["__row"].dataType)).unionByName(lo)
    hour = F.date_trunc("hour", F.col("__t").cast("timestamp"))
    # within an hour: last value so far; across hours: the last value of any earlier hour
    inside = Window.partitionBy("__key", "__h").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("__h", hour)
    local = line.withColumn("__v", F.last("__v", ignorenulls=True).over(inside)).where(side == 1)
    ends = line.where(side == 0).groupBy("__key", "__h").agg(F.max_by("__v", "__t").alias("__end"))
    hours = line.select("__key", "__h").distinct().join(ends, ["__key", "__h"], "left")
    across = Window.partitionBy("__key").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("__key", "__h", F.last("__end", ignorenulls=True).over(across).alias("__before"))
    got = F.coalesce("__v", "__before")
    return join_back(local, hours, ["__key", "__h"]).select("__row.*", *[got[v].alias(v) for v in values], got["__at"].alias(f"{right_at}_used"))


def outcomes_with_variant(outcomes: DataFrame, assignments: DataFrame) -> DataFrame:
    return outcomes.join(assignments, ["test_id", "user_id"])


def with_benchmark(creatives: DataFrame, industries: dict[str, dict[str, float]], platforms: dict[str, dict[str, float]]) -> DataFrame:
    """Industry and platform constants with their fallbacks; the dictionaries are fixed and tiny."""
    spark = creatives.sparkSession
    ind = spark.createDataFrame([(k, v["ctr"], v["cvr"]) for k, v in industries.items()], "industry string, base_ctr double, base_cvr double")
    plat = spark.createDataFrame([(k, v["ctr"], v["cvr"]) for k, v in platforms.items()], "platform string, ctr_mult double, cvr_mult double")
    out = creatives.join(F.broadcast(ind), "industry", "left").join(F.broadcast(plat), "platform", "left")
    d, m = industries["default"], platforms["meta"]
    return out.withColumns({"base_ctr": F.coalesce("base_ctr", F.lit(d["ctr"])), "base_cvr": F.coalesce("base_cvr", F.lit(d["cvr"])),
                            "ctr_mult": F.coalesce("ctr_mult", F.lit(m["ctr"])), "cvr_mult": F.coalesce("cvr_mult", F.lit(m["cvr"]))})


def channel_full_outer(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the channels of two models; a missing share is 0."""
    j = a.join(b, keys, "full")
    return j.select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in j.columns if c not in keys])


def exclude_seed(pool: DataFrame, seed: DataFrame, key: str = "user_id") -> DataFrame:
    return pool.join(seed.select(key), key, "left_anti")


def member_profiles(members: DataFrame, profiles: DataFrame) -> DataFrame:
    return members.join(profiles, "user_id")
