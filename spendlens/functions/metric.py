"""Neighbours within a distance in any number of dimensions, by a partition of the space around pivots.

Every target belongs to its nearest pivot; a pivot with its targets is a cell, known by the least and greatest distance of a
target and by what its targets add up to.  A query point is replicated to the cells that the triangle inequality leaves: the cell's ring must
come within eps of it, and no pivot may be nearer to it by more than twice eps.  A cell that lies within eps as a whole gives its total and
forms no pairs.  What is left is compared in units of bounded size, a block of queries against a block of targets by one matrix
product; pairs too close to the radius for that are added up again component by component.

Equal points are merged first, so copies cost nothing.  The pivots (at most MOST_PIVOTS points) and one row per cell are all that
reaches the driver.  Where distances are all alike, as in many dimensions, the triangle inequality excludes little and the
work is that of comparing all pairs once, evenly spread; no task holds more than one unit.  Copies of a query for every
cell would then fill the disks: totals and least values come from blocks of up to UNIT points that meet in a Cartesian product, of which
only the blocks themselves are written.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.session import staged

MOST_PIVOTS = 512
UNIT = 4096  # targets, and queries, that meet in one unit
BLOCK = 64  # queries of a unit that are compared at once
VISITS = 4096  # rows of one batch that sends queries to their cells
COPIES = 8  # of a query, on average, that are sent to cells; where more were needed, whole blocks meet
MEETING = 8 << 20  # bytes of blocks that one task holds against the others
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """False for a missing vector and for one with a missing or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _unpacked(column: pa.ChunkedArray, kind: str = "<f8") -> np.ndarray:
    return np.array([np.frombuffer(x, kind) for x in column.to_pylist()], np.float64)


def _kind(*points: DataFrame) -> str:
    """How a component is packed: in four bytes where all are such."""
    return "<f4" if all(p.schema["v"].dataType.elementType == T.FloatType() for p in points) else "<f8"


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; exact to a few units in the last places of the squared norms."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _blocks(a: np.ndarray, b: np.ndarray, eps: float):
    """(first row, which rows of b lie within eps of which rows of a) for some rows of a at a time, so that they stay in the processor's cache.

    Squared distances less eps * eps come from one matrix product; what it can't settle is summed in the order of the components.
    """
    limit = eps * eps
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    # a row times a column: |a|^2 - eps^2 + |b|^2 - 2ab
    left = np.concatenate((-2 * a, (aa - limit)[:, None], np.ones((len(a), 1))), 1)
    right = np.ascontiguousarray(np.concatenate((b, np.ones((len(b), 1)), bb[:, None]), 1).T)
    unsure = SLACK * (limit + aa + bb.max(initial=0))  # told for all columns at once, and again for the pairs it leaves
    for s in range(0, len(a), BLOCK):
        over = left[s:s + BLOCK] @ right
        out = over <= 0
        close = np.abs(over, out=over) <= unsure[s:s + BLOCK, None]
        if not close.any():  # far sooner told than where
            yield s, out
            continue
        i, j = np.nonzero(close)
        own = over[i, j] <= SLACK * (limit + aa[s + i] + bb[j])
        i, j = i[own], j[own]
        for t in range(0, len(i), 1 << 16):
            x, y = i[t:t + (1 << 16)], j[t:t + (1 << 16)]
            total = np.zeros(len(x))
            for k in range(a.shape[1]):
                step = a[s + x, k] - b[y, k]
                total += step * step
            out[x, y] = total <= limit
        yield s, out


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of b lie within eps of which rows of a."""
    return np.concatenate([np.zeros((0, len(b)), bool), *(near for _, near in _blocks(a, b, eps))])


def _sums(near: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    if np.abs(values.astype(np.float64)).sum() < 2**52:
        return (near.astype(np.float64) @ values.astype(np.float64)).astype(np.int64)
    return np.array([values[row].sum() for row in near], np.int64)


def _forest(near: np.ndarray, ids: np.ndarray, others: np.ndarray, label: np.ndarray, u: list[int], v: list[int]) -> None:
    """Links of rows with one target of every component (``label``, by target) they reach; what a row links is one component from then on."""
    for k in np.flatnonzero(near.any(1)).tolist():
        at = np.flatnonzero(near[k])
        names = label.take(at)
        if (names == names[0]).all():
            u.append(int(ids[k]))
            v.append(int(others[at[0]]))
            continue
        names, first = np.unique(names, return_index=True)
        u += [int(ids[k])] * len(first)
        v += others[at[first]].tolist()
        label[np.isin(label, names)] = names[0]


def _pivots(points: DataFrame, n: int) -> np.ndarray:
    """Some of the points, spread by a hash of theirs."""
    count = min(MOST_PIVOTS, max(1, math.isqrt(n)))
    return np.array([r["v"] for r in points.orderBy(F.xxhash64("v"), "id").limit(count).select("v").collect()], np.float64)


def _placed(targets: DataFrame, pivots: np.ndarray, kind: str = "<f8") -> DataFrame:
    """Targets (id, v, value) as (id, packed, value, cell, far) with their nearest pivot and its distance."""
    sent = targets.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1))
            d2 = np.concatenate([_squares(m[s:s + 4096], sent.value) for s in range(0, len(m), 4096)])
            cell = d2.argmin(1)
            far = np.sqrt(((m - sent.value[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in m.astype(kind)], pa.binary()), b.column(2), pa.array(cell, pa.int32()), pa.array(far)],
                names=["id", "packed", "value", "cell", "far"])

    return targets.select("id", "v", F.col("value").cast("long").alias("value")).mapInArrow(run, "id long, packed binary, value long, cell int, far double")


def _rings(n: int, cells: list) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of a target in each of n cells."""
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    for r in cells:
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    return low, high


def _reached(m: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """By query and cell: may it hold a target within eps, and does it hold nothing else?"""
    d = np.sqrt(_squares(m, pivots))
    # the product's error in a distance, at most the root of its error in the square
    slack = np.sqrt(SLACK * ((m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] + eps * eps))
    near = (d <= high + eps + slack) & (d >= low - eps - slack) & (d <= (d + slack).min(1)[:, None] + 2 * eps + slack)
    return near, near & (d + high + slack <= eps)


def _visits(queries: DataFrame, pivots: np.ndarray, cells: list, eps: float, kind: str = "<f8") -> DataFrame:
    """Queries (id, v) as (id, packed, cell, inside): the cells that may hold a target within eps, or hold nothing else."""
    sent = queries.sparkSession.sparkContext.broadcast((pivots, *_rings(len(pivots), cells)))

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                rows = b.slice(s, 2048)
                m = _matrix(rows.column(1))
                near, inside = _reached(m, *sent.value, eps)
                q, cell = np.nonzero(near)
                inside = inside[q, cell]
                packed = pa.array([r.tobytes() for r in m.astype(kind)], pa.binary())
                # a query may visit all cells: its copies go out in batches of bounded size
                for at in range(0, len(q), VISITS):
                    own, whole = q[at:at + VISITS], inside[at:at + VISITS]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(pa.array(own)), packed.take(pa.array(own, mask=whole)), pa.array(cell[at:at + VISITS], pa.int32()), pa.array(whole)],
                        names=["id", "packed", "cell", "inside"])

    return queries.select("id", "v").mapInArrow(run, "id long, packed binary, cell int, inside boolean")


def _crowded(queries: DataFrame, pivots: np.ndarray, cells: list, eps: float) -> bool:
    """Do queries visit more than COPIES cells each, on average?"""
    sent = queries.sparkSession.sparkContext.broadcast((pivots, *_rings(len(pivots), cells)))

    def run(batches):
        for b in batches:
            n = sum(int(_reached(_matrix(b.column(0).slice(s, 2048)), *sent.value, eps)[0].sum()) for s in range(0, b.num_rows, 2048))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([b.num_rows], pa.int64())], names=["visits", "n"])

    visits, n = queries.select("v").mapInArrow(run, "visits long, n long").agg(F.sum("visits"), F.sum("n")).first()
    return (visits or 0) > COPIES * (n or 0)


def _units(visits: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows (cell, qc, tc, asks, id, packed, value): every query that visits a cell meets every target of it in one unit."""
    chunks = lambda n: F.ceil(F.count(F.lit(1)) / F.lit(UNIT)).cast("int").alias(n)
    sizes = staged(visits.groupBy("cell").agg(chunks("qcs")).join(placed.groupBy("cell").agg(chunks("tcs")), "cell"), "cells")
    own = lambda n: F.pmod(F.xxhash64(F.lit(n), "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = visits.join(sizes, "cell").select("cell", own("qcs").alias("qc"), every("tcs").alias("tc"), F.lit(True).alias("asks"), "id", "packed", F.lit(0).cast("long").alias("value"))
    told = placed.join(sizes, "cell").select("cell", every("qcs").alias("qc"), own("tcs").alias("tc"), F.lit(False).alias("asks"), "id", "packed", "value")
    return asks.unionByName(told)


def _prepared(queries: DataFrame, targets: DataFrame, eps: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visits, placed targets, cells) of queries (id, v) and targets (id, v, value), all staged."""
    pivots = _pivots(targets, targets.count())
    placed = staged(_placed(targets, pivots), "placed")
    cells = staged(placed.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.min("id").alias("first"),
                                              F.sum("value").alias("sum"), F.min("value").alias("min")), "cells")
    return staged(_visits(queries, pivots, cells.collect(), eps), "visits"), placed, cells


def _vector(points: DataFrame, vector: str) -> Column:
    """The vector with 0.0 for -0.0, of floats where it is of floats and of doubles else."""
    kind = "float" if points.schema[vector].dataType.elementType == T.FloatType() else "double"
    return F.transform(F.col(vector), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))


def _numbered(points: DataFrame, vector: str, *aggs: Column) -> DataFrame:
    """Distinct vectors v with a number and the aggregates of their rows, staged; vectors that are not usable go."""
    usual = points.where(usable(F.col(vector))).withColumn("v", _vector(points, vector))
    merged = usual.groupBy("v").agg(*aggs) if aggs else usual.select("v").distinct()
    return staged(merged.withColumn("id", F.monotonically_increasing_id()), "points")


def _gathered(placed: DataFrame, sizes: dict[int, int], pivots: np.ndarray, cells: list, eps: float, how: str, kind: str) -> DataFrame:
    """Placed points as blocks (block, cells, asked, ids, data, own) of about UNIT points at most, whole cells or parts of one, staged.

    data: points and values by cell; own: which cells a point must be compared with, and what the cells within its reach
    give; asked: the cells that any point must be compared with.
    """
    first, parts, block, room = [0] * len(pivots), [1] * len(pivots), 0, UNIT
    for c, n in sorted(sizes.items()):
        if n > room:
            block, room = block + (room < UNIT), UNIT
        first[c], parts[c] = block, -(-n // UNIT)
        block, room = (block + parts[c], UNIT) if n > UNIT else (block, room - n)
    of = lambda x: F.element_at(F.array(*map(F.lit, x)), F.col("cell") + 1)
    total = np.zeros(len(pivots), np.int64)
    for r in cells:
        total[r["cell"]] = r[how]
    sent = placed.sparkSession.sparkContext.broadcast((pivots, *_rings(len(pivots), cells)))

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("id", "ascending")])
        m, cell = _unpacked(table["packed"], kind), np.asarray(table["cell"])
        names, starts = np.unique(cell, return_index=True)
        asks, given = np.zeros((len(m), len(pivots)), bool), _nothing(len(m), how)
        for s in range(0, len(m), 512):
            near, inside = _reached(m[s:s + 512], *sent.value, eps)
            asks[s:s + 512] = near & ~inside
            given[1, s:s + 512] = inside.any(1)
            given[0, s:s + 512] = np.where(inside, total, 0).sum(1) if how == "sum" else np.where(inside, total, given[0, 0]).min(1)
        some = [m.astype(kind), np.asarray(table["value"]), names, [*starts.tolist(), len(m)]]
        asked = np.flatnonzero(asks.any(0))
        filled = np.array([c for c in asked if c in sizes_of], np.int64)
        own = None if len(filled) == len(sizes_of) and asks[:, filled].all() else np.packbits(asks, axis=1)
        row = {"block": table["block"][:1], "cells": [names.tolist()], "asked": [asked.tolist()], "ids": [np.asarray(table["id"]).tobytes()],
               "data": [pickle.dumps(some)], "own": [pickle.dumps(own)], "given": [given.tobytes()]}
        return pa.table(row, schema=schema)

    sizes_of = {r["cell"] for r in cells}
    schema = pa.schema([("block", pa.int32()), ("cells", pa.list_(pa.int32())), ("asked", pa.list_(pa.int32())), ("ids", pa.binary()), ("data", pa.binary()), ("own", pa.binary()), ("given", pa.binary())])
    placed = placed.select("id", "packed", "value", "cell", (of(first) + F.pmod(F.xxhash64("id"), of(parts))).cast("int").alias("block"))
    return staged(placed.groupBy("block").applyInArrow(gather, "block int, cells array<int>, asked array<int>, ids binary, data binary, own binary, given binary"), "blocks")


def _nothing(n: int, how: str) -> np.ndarray:
    """For n queries, the value of no targets (row 0) and that there were none (row 1)."""
    out = np.zeros((2, n), np.int64)
    out[0] = 0 if how == "sum" else np.iinfo(np.int64).max
    return out


def _fold(to: np.ndarray, x: np.ndarray, how: str) -> None:
    to[0] = to[0] + x[0] if how == "sum" else np.minimum(to[0], x[0])
    to[1] |= x[1]


def _told(a: np.ndarray, b: np.ndarray, values: np.ndarray, eps: float, how: str) -> np.ndarray:
    """What the targets within eps of each query give, as in ``_nothing``."""
    out = _nothing(len(a), how)
    if how == "min":  # the first target within reach is the least
        order = np.argsort(values, kind="stable")
        b, values = b[order], values[order]
    for s, near in _blocks(a, b, eps):
        hit = near.any(1)
        out[1, s:s + BLOCK] = hit
        out[0, s:s + BLOCK] = _sums(near, values) if how == "sum" else np.where(hit, values.take(near.argmax(1)), out[0, s:s + BLOCK])
    return out


def _both(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The sums of values v of b by row of a, and of u of a by row of b, as in ``_nothing``: every pair is compared once."""
    x, y = _nothing(len(a), "sum"), _nothing(len(b), "sum")
    for s, near in _blocks(a, b, eps):
        x[0, s:s + BLOCK], x[1, s:s + BLOCK] = _sums(near, v), near.any(1)
        y[0] += _sums(near.T, u[s:s + BLOCK])
        y[1] |= near.any(0)
    return x, y


def _met(queries: DataFrame, targets: DataFrame, eps: float, how: str) -> DataFrame:
    """(id, value) of query blocks against target blocks; where both are one table every two blocks meet once."""
    same = queries is targets
    n = targets.agg(F.sum(F.length("data") + F.length("own"))).first()[0]
    left = queries.select("block", "asked", "cells", "data", "own")
    right = targets.select(*[F.col(c).alias(f"{c}_2") for c in left.columns]).repartition(max(1, -(-n // MEETING)))
    wanted = F.arrays_overlap("asked", "cells_2")
    if same:
        other = (F.col("block") + F.col("block_2")) % 2 == 1
        wanted = (wanted | F.arrays_overlap("asked_2", "cells")) & ((F.col("block") == F.col("block_2")) | ((F.col("block") > F.col("block_2")) == other))
    pairs = left.join(right.hint("shuffle_replicate_nl"), wanted)

    def meet(batches):
        last, found = None, {}

        def load(b, i, at):
            (points, *rest), own = (pickle.loads(b.column(c)[i].as_buffer()) for c in (at + 1, at + 2))
            return b.column(at)[i].as_py(), points.astype(np.float64), *rest, own

        def add(block, x):
            if block in found:
                _fold(found[block], x, how)
            else:
                found[block] = x

        def ask(one, two):
            (block, a, *_, asks), (_, b, values, names, starts, _) = one, two
            if asks is None:
                return add(block, _told(a, b, values, eps, how))
            out, asks = _nothing(len(a), how), np.unpackbits(asks, axis=1)
            for c, start, end in zip(names, starts, starts[1:]):
                rows = np.flatnonzero(asks[:, c])
                if len(rows):
                    part = out[:, rows]
                    _fold(part, _told(a[rows], b[start:end], values[start:end], eps, how), how)
                    out[:, rows] = part
            add(block, out)

        for b in batches:
            for i in range(b.num_rows):
                if last is None or last[0] != b.column(0)[i].as_py():
                    last = load(b, i, 0)
                other = load(b, i, 3)
                if same and how == "sum" and last[0] != other[0] and last[-1] is None and other[-1] is None:
                    for block, x in zip((last[0], other[0]), _both(last[1], other[1], last[2], other[2], eps)):
                        add(block, x)
                    continue
                ask(last, other)
                if same and last[0] != other[0]:
                    ask(other, last)
        for block, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([None], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "given"])

    def finish(table: pa.Table) -> pa.Table:
        ids = np.frombuffer(next(x for x in table["ids"].to_pylist() if x is not None), np.int64)
        out = _nothing(len(ids), how)
        for x in table["given"]:
            _fold(out, np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1), how)
        hit = out[1] > 0
        return pa.table({"id": pa.array(ids[hit], pa.int64()), "value": pa.array(out[0, hit], pa.int64())})

    parts = pairs.select("block", "data", "own", "block_2", "data_2", "own_2").mapInArrow(meet, "block int, ids binary, given binary")
    return queries.select("block", "ids", "given").unionByName(parts).groupBy("block").applyInArrow(finish, "id long, value long")


def _aggregated(q: DataFrame, t: DataFrame, eps: float, how: str) -> DataFrame:
    """(id, value) of queries (id, v) over targets (id, v, value), both numbered; queries without a target within eps are left out."""
    kind, fold = _kind(q, t), {"sum": F.sum, "min": F.min}[how]
    pivots = _pivots(t, t.count())
    placed = _placed(t, pivots, kind)
    ring = [F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min")]
    cells = staged(placed.groupBy("cell").agg(*ring), "cells")
    rings = cells.collect()
    if _crowded(q, pivots, rings, eps):
        blocks = _gathered(placed, {r["cell"]: r["n"] for r in rings}, pivots, rings, eps, how, kind)
        asking = blocks
        if q is not t:
            own = _placed(q.withColumn("value", F.lit(0)), pivots, kind)
            asking = _gathered(own, {r["cell"]: r["count"] for r in own.groupBy("cell").count().collect()}, pivots, rings, eps, how, kind)
        return _met(asking, blocks, eps, how)
    placed = staged(placed, "placed")
    visits = staged(_visits(q, pivots, rings, eps, kind), "visits")
    whole = visits.where("inside").join(cells, "cell").select("id", F.col(how).alias("value"))

    def meet(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"])
        ours, theirs = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        ids, out = np.asarray(ours["id"]), np.zeros((2, 0), np.int64)
        if len(ids) and theirs.num_rows:
            out = _told(_unpacked(ours["packed"], kind), _unpacked(theirs["packed"], kind), np.asarray(theirs["value"]), eps, how)
            hit = out[1] > 0
            ids, out = ids[hit], out[:, hit]
        else:
            ids = ids[:0]
        return pa.table({"id": pa.array(ids, pa.int64()), "value": pa.array(out[0], pa.int64())})

    pairs = _units(visits.where("not inside"), placed).groupBy("cell", "qc", "tc").applyInArrow(meet, "id long, value long")
    return whole.unionByName(pairs).groupBy("id").agg(fold("value").alias("value"))


def range_aggregate(queries: DataFrame, targets: DataFrame, vector: str, eps: float, value: str, how: str) -> DataFrame:
    """(v, value): distinct query vectors with the sum or least (``how``: sum, min) of the whole-number value of all targets within eps.

    Vectors that are null or hold null or non-finite components take no part; all others have the same length.  A
    query without a target within eps has no row.
    """
    fold = {"sum": F.sum, "min": F.min}[how]
    q, t = _numbered(queries, vector), _numbered(targets, vector, fold(value).alias("value"))
    found = q.select("id", F.lit(None).cast("long").alias("value")).where("false") if t.isEmpty() else _aggregated(q, t, eps, how)
    return q.join(found, "id").select(F.col("v").cast("array<double>").alias("v"), F.col("value").alias(value))


def neighbour_counts(points: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """How many rows lie within eps of each row, itself included; rows whose vector is not usable are left out.

    Rows find the count of their vector by two 64-bit prints of it.
    """
    prints = [F.xxhash64(F.lit(n), "v").alias(n) for n in ("print", "other_print")]
    rows = points.where(usable(F.col(vector))).select(key, _vector(points, vector).alias("v")).select(key, *prints)
    t = _numbered(points, vector, F.count(F.lit(1)).alias("value"))
    if t.isEmpty():
        return rows.select(key, F.lit(None).cast("long").alias("neighbours")).where("false")
    counts = t.select("id", *prints).join(_aggregated(t, t, eps, "sum").withColumnRenamed("value", "neighbours"), "id")
    return rows.join(counts.drop("id"), ["print", "other_print"]).select(key, "neighbours")


def range_links(points: DataFrame, eps: float) -> DataFrame:
    """Edges (u, v) between distinct points (id, v) that connect what steps of at most eps connect; of each unit a spanning forest."""
    points = staged(points, "points")
    if points.isEmpty():
        return points.select(F.col("id").alias("u"), F.col("id").alias("v"))
    visits, placed, cells = _prepared(points, points.withColumn("value", F.lit(0)), eps)
    whole = staged(visits.where("inside").join(cells, "cell").select("cell", "first", "id"), "whole")
    held = whole.select("cell", "first").distinct().join(placed.select("cell", "id"), "cell")

    def meet(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"])
        ours, theirs = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        u: list[int] = []
        v: list[int] = []
        if ours.num_rows and theirs.num_rows:
            ids, others = np.asarray(ours["id"]), np.asarray(theirs["id"])
            a, b = _unpacked(ours["packed"]), _unpacked(theirs["packed"])
            label = np.arange(len(others))
            for s, near in _blocks(a, b, eps):
                _forest(near, ids[s:s + BLOCK], others, label, u, v)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    pairs = _units(visits.where("not inside"), placed).groupBy("cell", "qc", "tc").applyInArrow(meet, "u long, v long")
    stars = [d.select(F.col("first").alias("u"), F.col("id").alias("v")) for d in (whole, held)]
    return pairs.unionByName(stars[0]).unionByName(stars[1]).where("u <> v").distinct()
