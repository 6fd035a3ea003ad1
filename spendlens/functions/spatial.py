"""Range aggregates and density clustering without listing the pairs of a dense region.

Points are held in nested grid cells.  Two cells are compared by the boxes of their points:
if the boxes are wholly within reach, the cell totals are used and no pair is formed; if they
are out of reach, the pair is dropped; what straddles the radius is split further, unless the
two cells hold so few points that comparing them directly is cheaper.  Equal points are merged first, so copies cost
nothing, and the number of coarse cells depends on the radius, not on the rows.

Grids serve up to AXES dimensions; points of more go through the metric partition in ``metric``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions import metric
from spendlens.functions.skew import join_back, one_row, ordered_scan
from spendlens.session import staged

BRANCH, DEPTH = 4, 3
LAST = DEPTH - 1
AXES = 3  # dimensions of the first equi-join: 27 neighbour cells
MARGIN = 1e-9
DIRECT_PAIRS = 512  # point pairs two cells may form without being split further


def min_max_scaled(df: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """Columns scaled to 0..1; a constant column becomes 0."""
    stats = one_row(df.agg(*[F.min(d).cast("double").alias(f"lo_{d}") for d in dims], *[F.max(d).cast("double").alias(f"hi_{d}") for d in dims]))
    rows = df.withColumn("__s", stats)
    s = F.col("__s")
    return rows.select(key, *[((F.col(d) - s[f"lo_{d}"]) / F.greatest(s[f"hi_{d}"] - s[f"lo_{d}"], F.lit(1e-10))).alias(d) for d in dims])


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _with_cells(points: DataFrame, dims: list[str], eps: float) -> DataFrame:
    """k0 (side eps) … k2 (the finest); coarser keys by integer division of finer ones."""
    out = points.withColumn(f"k{LAST}", F.array(*[F.floor(F.col(d) / (eps / BRANCH**LAST)) for d in dims]))
    for level in range(LAST - 1, -1, -1):
        out = out.withColumn(f"k{level}", F.transform(f"k{level + 1}", lambda x: F.floor(x / BRANCH)))
    return out


def _cells(points: DataFrame, dims: list[str], level: int, side: str, value: Column) -> DataFrame:
    """One row per cell: its key, its parent's key, the box of its points and their value."""
    up = [F.col(f"k{level - 1}").alias(f"{side}up")] if level else []
    return points.groupBy(F.col(f"k{level}").alias(f"{side}k"), *up).agg(
        F.array(*[F.min(d) for d in dims]).alias(f"{side}lo"), F.array(*[F.max(d) for d in dims]).alias(f"{side}hi"), value.alias(f"{side}v"), F.count(F.lit(1)).alias(f"{side}n"))


def _box_distance(n: int) -> tuple[Column, Column]:
    """Squared least and greatest distance between the two boxes of a row."""
    c = F.col
    gap = [F.greatest(F.lit(0.0), c("blo")[i] - c("ahi")[i], c("alo")[i] - c("bhi")[i]) for i in range(n)]
    span = [F.greatest(c("ahi")[i] - c("blo")[i], c("bhi")[i] - c("alo")[i]) for i in range(n)]
    return _sum([g * g for g in gap]), _sum([s * s for s in span])


def _split(pairs: DataFrame, n: int, eps: float) -> tuple[DataFrame, DataFrame]:
    """(wholly within reach, straddling) box pairs."""
    near, far = _box_distance(n)
    inside = far <= eps * eps * (1 - MARGIN)
    marked = pairs.withColumn("__in", inside).where(near <= eps * eps * (1 + MARGIN))
    return marked.where("__in").drop("__in"), marked.where("not __in").drop("__in")


def _first_pairs(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    axes = range(min(n, AXES))
    left = a
    for i in axes:
        left = left.withColumn(f"__c{i}", F.explode(F.array(*[F.col("ak")[i] + s for s in (-1, 0, 1)])))
    right = b.withColumns({f"__c{i}": F.col("bk")[i] for i in axes})
    return left.join(right, [f"__c{i}" for i in axes]).drop(*[f"__c{i}" for i in axes])


def _levels(a_points: DataFrame, b_points: DataFrame, dims: list[str], eps: float, a_value: Column, b_value: Column):
    """Per level the box pairs within reach and those to compare directly; then the finest that straddle."""
    n, within, direct, pairs = len(dims), [], [], None
    for level in range(DEPTH):
        a, b = _cells(a_points, dims, level, "a", a_value), _cells(b_points, dims, level, "b", b_value)
        if level == 0:
            pairs = _first_pairs(a, b, n)
        else:
            up = pairs.select(F.col("ak").alias("aup"), F.col("bk").alias("bup"))
            pairs = up.join(a, "aup").join(b, "bup").drop("aup", "bup")
        pairs = staged(pairs, "pairs")
        inside, pairs = _split(pairs, n, eps)
        within.append(inside)
        few = F.col("an") * F.col("bn") <= DIRECT_PAIRS
        direct.append(pairs.where(few).select("ak", "bk"))
        pairs = pairs.where(~few)
    return within, direct, pairs


def range_aggregate(queries: DataFrame, targets: DataFrame, dims: list[str], eps: float, value: str,
                    how: Callable[[Column | str], Column]) -> DataFrame:
    """Distinct query points with ``how`` (sum or min) over the value of all targets within eps."""
    if len(dims) > AXES:
        packed = F.array(*dims).alias("v")
        found = metric.range_aggregate(queries.select(packed), targets.select(packed, F.col(value).alias("__v")), "v", eps, "__v", "sum" if how is F.sum else "min")
        return found.select(*[F.col("v")[i].alias(d) for i, d in enumerate(dims)], F.col("__v").alias(value))
    q = staged(_with_cells(queries.select(*dims).distinct(), dims, eps), "points")
    t = staged(_with_cells(targets.groupBy(*dims).agg(how(value).alias("__v")), dims, eps), "points")
    within, direct, rest = _levels(q, t, dims, eps, F.count(F.lit(1)), how("__v"))
    parts = []
    for level, inside in enumerate(within):
        per_cell = inside.groupBy("ak").agg(how("bv").alias("__v")).withColumnRenamed("ak", f"k{level}")
        parts.append(q.join(per_cell, f"k{level}").select(*dims, "__v"))
    t_dims = [F.col(d).alias(f"t_{d}") for d in dims]
    d2 = _sum([(F.col(d) - F.col(f"t_{d}")) * (F.col(d) - F.col(f"t_{d}")) for d in dims])
    for level, few in enumerate(direct):
        met = few.join(q.select(F.col(f"k{level}").alias("ak"), *dims), "ak").join(t.select(F.col(f"k{level}").alias("bk"), *t_dims, "__v"), "bk")
        parts.append(met.where(d2 <= eps * eps).select(*dims, "__v"))
    # a query point against the box of a finest target cell, then against its points
    lone = rest.select("ak", "bk", "blo", "bhi", "bv").join(q.select(F.col(f"k{LAST}").alias("ak"), *dims), "ak")
    boxed = lone.withColumns({"alo": F.array(*dims), "ahi": F.array(*dims)})
    inside, straddling = _split(boxed, len(dims), eps)
    parts.append(inside.select(*dims, F.col("bv").alias("__v")))
    other = t.select(F.col(f"k{LAST}").alias("bk"), *t_dims, "__v")
    parts.append(straddling.select("bk", *dims).join(other, "bk").where(d2 <= eps * eps).select(*dims, "__v"))
    return reduce(DataFrame.unionByName, parts).groupBy(*dims).agg(how("__v").alias(value))


def neighbour_counts(points: DataFrame, key: str, dims: list[str], eps: float) -> DataFrame:
    """How many rows lie within eps of each row, itself included."""
    one = points.withColumn("neighbours", F.lit(1).cast("bigint"))
    counts = range_aggregate(points, one, dims, eps, "neighbours", F.sum)
    return join_back(points, counts, dims).select(key, "neighbours")


def _cell_links(points: DataFrame, dims: list[str], eps: float) -> DataFrame:
    """Edges (u, v) between finest cells, named by their least point id, that hold points in reach.

    A finest cell is smaller than eps, so its points are mutually connected and one edge per
    pair of cells is enough; a coarse pair within reach is a star around its first cell.
    """
    p = _with_cells(points, dims, eps)
    first = p.groupBy(f"k{LAST}").agg(F.min("id").alias("cell"))
    p = staged(p.join(first, f"k{LAST}"), "points")
    within, direct, rest = _levels(p, p, dims, eps, F.min("cell"), F.min("cell"))
    edges = []
    for level, inside in enumerate(within):
        edges.append(inside.select(F.col("av").alias("u"), F.col("bv").alias("v")))
        star = inside.select(F.col("ak").alias(f"k{level}"), F.col("av").alias("u")).distinct()
        edges.append(star.join(p.select(f"k{level}", F.col("cell").alias("v")).distinct(), f"k{level}").select("u", "v"))
    a_dims, t_dims = [F.col(d).alias(f"a_{d}") for d in dims], [F.col(d).alias(f"t_{d}") for d in dims]
    d2 = _sum([(F.col(f"a_{d}") - F.col(f"t_{d}")) * (F.col(f"a_{d}") - F.col(f"t_{d}")) for d in dims])
    for level, few in enumerate(direct):
        one = p.select(F.col(f"k{level}").alias("ak"), F.col("cell").alias("u"), *a_dims)
        two = p.select(F.col(f"k{level}").alias("bk"), F.col("cell").alias("v"), *t_dims)
        edges.append(few.join(one, "ak").join(two, "bk").where((F.col("u") < F.col("v")) & (d2 <= eps * eps)).select("u", "v"))
    mine = p.select(F.col(f"k{LAST}").alias("ak"), *a_dims)
    lone = rest.select("ak", "bk", "blo", "bhi", "av", "bv").where("av < bv").join(mine, "ak")
    boxed = lone.withColumns({"alo": F.array(*[f"a_{d}" for d in dims]), "ahi": F.array(*[f"a_{d}" for d in dims])})
    inside, straddling = _split(boxed, len(dims), eps)
    edges.append(inside.select(F.col("av").alias("u"), F.col("bv").alias("v")))
    other = p.select(F.col(f"k{LAST}").alias("bk"), *t_dims)
    edges.append(straddling.join(other, "bk").where(d2 <= eps * eps).select(F.col("av").alias("u"), F.col("bv").alias("v")))
    return reduce(DataFrame.unionByName, edges).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, component) with the least vertex as the component's name.

    Alternating large-star and small-star rounds: logarithmic in practice, each a grouped
    minimum and a join; lineage is cut by a written table every round, in files as many as its rows need.
    """
    edges = staged(edges, "edges")

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        linked = both.join(least, "u")
        moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else linked.select(
            F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    before = state(edges)
    while True:
        edges = staged(star(star(edges, True), False), "edges", 16 * before[0])
        now = state(edges)
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("component"))
        before = now


def dbscan(points: DataFrame, key: str, dims: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Density clusters: ids in order of the first core row, -1 for noise.

    Core rows have min_samples rows within eps, themselves included; a border row joins the
    lowest cluster that reaches it.
    """
    points = staged(points, "points")
    counted = staged(join_back(points, neighbour_counts(points, key, dims, eps), [key]), "counted")
    core = counted.where(F.col("neighbours") >= min_samples)
    merged = core.groupBy(*dims).agg(F.min(key).alias("id"))
    if len(dims) > AXES:
        cell_of = merged = staged(merged.withColumn("cell", F.col("id")), "core")
        found = connected_components(metric.range_links(merged.select("id", F.array(*dims).alias("v")), eps))
    else:
        placed = _with_cells(merged, dims, eps)
        cell_of = placed.join(placed.groupBy(f"k{LAST}").agg(F.min("id").alias("cell")), f"k{LAST}")
        found = connected_components(_cell_links(merged, dims, eps))
    comp = cell_of.join(found, F.col("cell") == F.col("v"), "left").select(*dims, F.coalesce("component", "cell").alias("component"))
    comp = staged(comp, "components")
    names = ordered_scan(comp.select("component").distinct(), [], ["component"], F.floor(F.col("component") / 10000), row_number="n")
    comp = comp.join(names, "component").select(*dims, (F.col("n") - 1).alias("label"))
    border = range_aggregate(counted.where(F.col("neighbours") < min_samples), comp, dims, eps, "label", F.min)
    labels = comp.unionByName(border)
    return join_back(counted, labels, dims, "left").select(key, F.coalesce("label", F.lit(-1)).alias("label"), "neighbours")
