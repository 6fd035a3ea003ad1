"""Set operations on audiences and channel sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_anti")


def coalition_members(path_channels: DataFrame, coalition: list[str]) -> DataFrame:
    """Per path its channels that belong to the coalition (bounded by the coalition)."""
    inside = F.when(F.col("channel").isin(coalition), F.col("channel"))
    return path_channels.groupBy("client_id", "path_id").agg(F.array_sort(F.collect_set(inside)).alias("members"))


def subset_counts(path_channels: DataFrame, coalition: list[str]) -> DataFrame:
    """Paths per client, and those whose channels all lie in the coalition; any number of channels."""
    inside = path_channels.groupBy("client_id", "path_id").agg(F.bool_and(F.col("channel").isin(coalition)).alias("inside"))
    return inside.groupBy("client_id").agg(F.count(F.lit(1)).alias("paths"), F.count_if("inside").alias("subset_paths"))
