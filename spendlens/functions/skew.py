"""Ordered and grouped computations that stay parallel when one key is hot.

A plain window puts all rows of a key into one task.  Here every key is cut into
order-preserving buckets (hours, value bins); windows run inside a bucket, a small
per-bucket summary is scanned across buckets, and the carry is joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def join_back(df: DataFrame, extra: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys, NULL being a key value, without duplicate key columns."""
    renamed = extra.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[F.col(c) for c in extra.columns if c not in keys])
    on = _null_safe(df, renamed, [(k, f"__r_{k}") for k in keys])
    return df.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def with_totals(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Group totals next to every row: partial aggregation and a join AQE can split,
    where sum() over (partition by key) would gather the whole key in one task."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return join_back(df, totals, keys)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan out evenly for work that is heavy per row; the partitions follow the data's size."""
    return df.hint("rebalance")


def one_row(df: DataFrame) -> Column:
    """A one-row DataFrame as a scalar subquery; fields by getField."""
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    *,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    row_number: str | None = None,
) -> DataFrame:
    """Previous / next row values, sums over all earlier rows and positions per key.

    ``bucket`` must not decrease along ``order``.  Rows of one key meet in one task only
    through one summary row per bucket.
    """
    lag, lead, before = lag or {}, lead or {}, before or {}
    src = df.withColumn("__b", bucket)
    for name, c in before.items():
        src = src.withColumn(f"__x_{name}", F.coalesce(c, F.lit(0)))
    if lag:
        src = src.withColumn("__lagv", F.struct(*[c.alias(n) for n, c in lag.items()]))
    if lead:
        src = src.withColumn("__leadv", F.struct(*[c.alias(n) for n, c in lead.items()]))

    at = F.struct(*[F.col(o) for o in order])
    parts = [F.count(F.lit(1)).alias("__n")]
    parts += [F.sum(f"__x_{n}").alias(f"__s_{n}") for n in before]
    if lag:
        parts.append(F.max_by("__lagv", at).alias("__last"))
    if lead:
        parts.append(F.min_by("__leadv", at).alias("__first"))
    across = Window.partitionBy(*keys).orderBy("__b")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = src.groupBy(*keys, "__b").agg(*parts)
    cols = [F.col(k) for k in keys] + [F.col("__b")]
    cols.append(F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__rows_before"))
    cols += [F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__p_{n}") for n in before]
    if lag:
        cols.append(F.lag("__last").over(across).alias("__prev"))
    if lead:
        cols.append(F.lead("__first").over(across).alias("__next"))
    summary = summary.select(*cols)

    within = Window.partitionBy(*keys, "__b").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    if lag:
        src = src.withColumn("__lagv", F.lag("__lagv").over(within))
    if lead:
        src = src.withColumn("__leadv", F.lead("__leadv").over(within))
    for name in before:
        src = src.withColumn(f"__l_{name}", F.coalesce(F.sum(f"__x_{name}").over(upto), F.lit(0)))
    if row_number:
        src = src.withColumn("__rn", F.row_number().over(within))

    out = join_back(src, summary, [*keys, "__b"])
    final = [F.col(c) for c in df.columns]
    if lag:
        got = F.coalesce(F.col("__lagv"), F.col("__prev"))
        final += [got.getField(n).alias(n) for n in lag]
    if lead:
        got = F.coalesce(F.col("__leadv"), F.col("__next"))
        final += [got.getField(n).alias(n) for n in lead]
    final += [(F.col(f"__p_{n}") + F.col(f"__l_{n}")).alias(n) for n in before]
    if row_number:
        final.append((F.col("__rows_before") + F.col("__rn")).alias(row_number))
    return out.select(*final)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key along ``order``; NULL is a key value.

    An aggregate with map-side combine: a key held by a third of the rows shrinks to one
    candidate per input task before the shuffle.
    """
    best = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(o) for o in order]))
    return df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(best.alias("__r")).select("__r.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    best = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(o) for o in order]))
    return df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(best.alias("__r")).select("__r.*")


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, salt_on: list[str],
                  salts: int = 64, rank: str = "rank") -> DataFrame:
    """The n best rows of every key, chosen in salted slices first, then among their winners."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in salt_on]), F.lit(salts)))
    inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
    cut = salted.withColumn("__rn", F.row_number().over(inner)).where(F.col("__rn") <= n).drop("__rn", "__salt")
    outer = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)


def value_bins(df: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """Adds __bin, which does not decrease along value (nulls first) and holds about equal shares of a key's rows.

    Edges are approximate percentiles, so a narrow span of crowded values is cut as finely as a wide
    one.  Only rows with equal values cannot be told apart: count those first.
    """
    at = F.percentile_approx(value, [k / bins for k in range(1, bins)], 10000)
    if keys:
        edged = join_back(df, df.groupBy(*keys).agg(at.alias("__edges")), keys)
    else:
        edged = df.withColumn("__edges", df.agg(at).scalar())
    # edges below the value, by halving: each step is taken if the edge it leads to is still below
    steps = [1 << b for b in range(bins.bit_length() - 1, -1, -1)]
    below = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.try_element_at("__edges", at + s) < F.col(value), at + s).otherwise(at))
    return edged.withColumn("__bin", F.coalesce(below, F.lit(0))).drop("__edges")


def rank_by_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with ``less`` (rows of the key with a smaller value) and ``group_rows``.

    Equal values are counted before ranking, so neither a hot key nor a hot value gathers.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = ordered_scan(value_bins(counts, keys, value), keys, [value], F.col("__bin"), before={"less": F.col("__c")}).drop("__bin")
    ranked = with_totals(ranked, keys, group_rows=F.sum("__c"))
    return join_back(df, ranked.drop("__c"), [*keys, value])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per key, exact, without holding a key in memory.

    Values are counted, ranked across value bins, and only the two order statistics around
    each requested point survive to the final aggregate.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = ordered_scan(value_bins(counts, keys, value), keys, [value], F.col("__bin"), before={"__less": F.col("__c")})
    ranked = with_totals(ranked, keys, __total=F.sum("__c"))

    def order_stat(position: Column) -> Column:
        inside = (position >= F.col("__less")) & (position < F.col("__less") + F.col("__c"))
        return F.max(F.when(inside, F.col(value)))

    aggs = []
    for name, p in points.items():
        pos = F.lit(p) * (F.col("__total") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        share = F.max(pos - low)
        aggs.append((order_stat(low) + (order_stat(high) - order_stat(low)) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
