"""Exact search for the highest inner products: a KD-tree per shard, best first, with a propagated kth score."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import arrow_rows
from spendlens.session import staged

LEAF = 64
BUNDLE = 16  # blocks of queries that meet a tree together
MEETING = 16 << 20  # bytes of queries that one task has against its trees


def usable(vector: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def build_tree(points: np.ndarray, ids: np.ndarray) -> dict:
    """Median splits along the widest side; every node has the tight box of its points."""
    order, nodes, todo = np.arange(len(points)), [], [(0, len(points), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        own = points[order[start:end]]
        low, high = own.min(0), own.max(0)
        if parent >= 0:
            nodes[parent][4 + side] = len(nodes)
        nodes.append([start, end, low, high, -1, -1])
        if end - start > LEAF and (high > low).any():
            axis, half = int(np.argmax(high - low)), (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, axis], half)]
            todo += [(start, start + half, len(nodes) - 1, 0), (start + half, end, len(nodes) - 1, 1)]
    return {"points": points[order], "ids": ids[order], "span": [(n[0], n[1], n[4], n[5]) for n in nodes],
            "low": np.array([n[2] for n in nodes]), "high": np.array([n[3] for n in nodes])}


def packed(points: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them all."""
    for kind in (np.int16, np.int32):
        if points.size and points.min() >= np.iinfo(kind).min and points.max() <= np.iinfo(kind).max and (points == np.floor(points)).all():
            return points.astype(kind)
    return points


class Best:
    """The k best (score, id) of each of some queries so far, ties to the smaller id; scores below ``least`` are not looked for."""

    def __init__(self, least: np.ndarray, k: int):
        self.scores, self.ids = np.full((len(least), k), -np.inf), np.full((len(least), k), np.iinfo(np.int64).max)
        self.least, self.floor = least, least.copy()

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the queries ``at``."""
        rows, k = np.unique(at), self.scores.shape[1]
        at = np.concatenate((at, rows.repeat(k)))
        scores, ids = np.concatenate((scores, self.scores[rows].ravel())), np.concatenate((ids, self.ids[rows].ravel()))
        order = np.lexsort((ids, -scores, at))
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        order, place = order[place < k], place[place < k]
        self.scores[at[order], place], self.ids[at[order], place] = scores[order], ids[order]
        self.floor = np.maximum(self.least, self.scores[:, -1])

    def found(self) -> list[np.ndarray]:
        """Query, score and id of all that were found."""
        at, place = np.nonzero(self.scores > -np.inf)
        return [at, self.scores[at, place], self.ids[at, place]]


def search_tree(tree: dict, queries: np.ndarray, own: np.ndarray, asks: np.ndarray, best: Best) -> None:
    """Adds to ``best`` what the tree has for the queries that ask (True), but points of a query's own id.

    A box bounds its scores by its better corner.  Nodes are opened by the best bound of any query; a query whose kth score
    is above a node's bound leaves out everything under it, one that ties still opens it.  The queries
    that reach a leaf are scored by one matrix product.
    """
    bounds = np.maximum(queries, 0) @ tree["high"].T + np.minimum(queries, 0) @ tree["low"].T
    queue, waiting, count = [(0.0, 0)], [], 0
    while queue:
        _, node = heapq.heappop(queue)
        alive = np.flatnonzero(asks & (bounds[:, node] >= best.floor))
        if not len(alive):
            continue
        start, end, left, right = tree["span"][node]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(queue, (-bounds[alive, child].max(), child))
            continue
        scores = queries[alive] @ tree["points"][start:end].T.astype(float)
        i, j = np.nonzero(scores >= best.floor[alive, None])
        at, ids, scores = alive[i], tree["ids"][start + j], scores[i, j]
        # of those that tie with the kth, smaller ids only
        new = (ids != own[at]) & ((scores > best.scores[at, -1]) | (ids < best.ids[at, -1]))
        waiting.append((at[new], scores[new], ids[new]))
        count += len(waiting[-1][0])
        if count > 16 * len(queries):
            best.add(*map(np.concatenate, zip(*waiting)))
            waiting, count = [], 0
    if count:
        best.add(*map(np.concatenate, zip(*waiting)))


def top_products(vectors: DataFrame, wanted: Column | str, k: int = 10, shard_rows: int = 4096, query_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every wanted row with all others.

    vectors: vec_id, v (array of whole numbers).  Rows without an id take no part; rows with the
    query's own id are no candidates; only vectors of equal length meet.  Every row lies in one
    shard of about ``shard_rows`` rows, whose tree is built once and first searched for the shard's own queries; the kth score found
    there bounds the search of all the other shards.  Bundles of queries and trees meet pair by pair without a copy of either on disk, and
    a task holds one tree and the k best of the queries it is given, ``query_rows`` of which search at once.  Sums beyond 2^53 are not exact.
    """
    rows = staged(vectors.where("vec_id is not null and v is not null").select("vec_id", "v", F.size("v").alias("dim"), F.expr(wanted).alias("wanted") if isinstance(wanted, str) else wanted.alias("wanted")), "vectors")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("wanted").alias("q")).collect()
    shards = {r["dim"]: -(-r["n"] // shard_rows) for r in sizes}
    blocks = {r["dim"]: max(1, -(-r["q"] // (query_rows * BUNDLE))) for r in sizes}
    parts = -(-sum(r["q"] * (8 * r["dim"] + 24) for r in sizes) // MEETING)
    if not sizes:
        shards, blocks = {0: 1}, {0: 1}
    of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("dim")]
    spread = lambda name, d: F.pmod(F.xxhash64(F.lit(name), "vec_id", "v"), of(d)).cast("int")
    rows = rows.withColumn("shard", spread("shard", shards))
    found = "query_id long, vec_id long, score long"
    kept = "dim int, shard int, data binary, " + found
    emit, keep, bundled = arrow_rows(found), arrow_rows(kept), arrow_rows("dim int, block int, data binary")

    def matrix(t):
        return np.array(t.column("v").combine_chunks().flatten(), float).reshape(t.num_rows, -1)

    def listed(own, best):
        at, scores, ids = best.found()
        if (np.abs(scores) >= 2.0**63).any():
            raise OverflowError("a score does not fit 64 bits")
        return [own[at], ids, scores.astype(np.int64)]

    def plant(t):
        """A row with the tree, and a row for each seed of the shard's own queries."""
        points, ids = matrix(t), np.asarray(t.column("vec_id"))
        tree = build_tree(points, ids)
        ask = np.flatnonzero(t.column("wanted").fill_null(False).to_numpy())
        at = [t["dim"][0].as_py()], [t["shard"][0].as_py()]
        out = [keep([*at, [pickle.dumps(tree | {"points": packed(tree["points"])})], [None], [None], [None]])]
        for s in range(0, len(ask), query_rows):
            some = ask[s:s + query_rows]
            best = Best(np.full(len(some), -np.inf), k)
            search_tree(tree, points[some], ids[some], np.full(len(some), True), best)
            own = listed(ids[some], best)
            n = len(own[0])
            out.append(keep([*(x * n for x in at), [None] * n, *own]))
        return pa.Table.from_batches(out)

    planted = staged(rows.groupBy("dim", "shard").applyInArrow(plant, kept), "trees")
    seeds = planted.where("data is null").select("query_id", "vec_id", "score")
    kth = seeds.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))

    def bundle(t):
        data = pickle.dumps((np.asarray(t["vec_id"]), packed(matrix(t)), np.array(t["least"], float), np.asarray(t["shard"])))
        return pa.Table.from_batches([bundled([[t["dim"][0].as_py()], [t["block"][0].as_py()], [data]])])

    # then in all other shards, down to the kth score from home
    asked = rows.where("wanted").withColumn("block", spread("block", blocks))
    known = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").select(
        "vec_id", "v", "dim", "shard", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("least"), "block")
    blocked = known.groupBy("dim", "block").applyInArrow(bundle, "dim int, block int, data binary").repartition(max(1, parts))

    def look(batches):
        """All pairs of a task: a query's best go on from one tree to the next."""
        kept: dict[tuple, tuple] = {}
        for b in batches:
            for i in range(b.num_rows):
                dim, shard, tree, block, data = (b.column(c)[i] for c in range(5))
                own, queries, least, home = pickle.loads(data.as_buffer())
                tree, others = pickle.loads(tree.as_buffer()), home != shard.as_py()
                for s in range(0, len(own), query_rows):
                    name, some = (dim.as_py(), block.as_py(), s), slice(s, s + query_rows)
                    if name not in kept:
                        kept[name] = own[some], Best(least[some], k)
                    search_tree(tree, queries[some].astype(float), own[some], others[some], kept[name][1])
        for own, best in kept.values():
            yield emit(listed(own, best))

    trees = planted.where("data is not null").select("dim", "shard", F.col("data").alias("tree"))
    pairs = trees.join(blocked.withColumnRenamed("dim", "length").hint("shuffle_replicate_nl"), F.col("dim") == F.col("length"))
    rest = pairs.select("dim", "shard", "tree", "block", "data").mapInArrow(look, found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return seeds.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
