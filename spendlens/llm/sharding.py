"""Shards that keep linked documents together: label propagation under capacity quotas.

Only DataFrame operations.  Labels flow along links in rounds of joins; a shard takes in no more than its
quota has room for.  A last global ranking evens the shards out to the row, moving loose documents first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.skew import ordered_scan
from spendlens.session import staged

LAW = "rows"


def _unit(*keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def links(nodes: DataFrame, chunk: int) -> DataFrame:
    """(node, parent, depth, weight, near, group_weight) for the nodes (node, grp, weight) of groups of two or more.

    The links of a group form a tree: its first node, below it the first nodes of parts of about ``chunk`` nodes, below
    each the others of its part; so no node has many neighbours, however large the group.  ``near`` is the weight below a node.
    """
    sizes = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.ceil(F.col("n") / F.lit(chunk)).cast("long"))
    dealt = staged(nodes.join(sizes, "grp").withColumn("part", part), "dealt")
    hubs = dealt.groupBy("grp", "part").agg(F.min("node").alias("hub"), F.sum("weight").alias("part_weight"))
    tops = hubs.groupBy("grp").agg(F.min("hub").alias("top"), F.sum("part_weight").alias("group_weight"))
    at = dealt.join(hubs.join(tops, "grp"), ["grp", "part"])
    node, top = F.col("node") == F.col("hub"), F.col("node") == F.col("top")
    return at.select("node", "grp", F.when(node, F.col("top")).otherwise(F.col("hub")).alias("parent"), F.when(top, 0).when(node | (F.col("hub") == F.col("top")), 1).otherwise(2).alias("depth"),
                     "weight", F.when(node, F.col("part_weight")).otherwise(F.col("weight")).alias("near"), "group_weight")


def propagate(nodes: DataFrame, total: int, shards: int, rounds: int = 6, slack: float = 0.02) -> DataFrame:
    """(node, label, weight) for all linked nodes (as of ``links``), labels 0 to shards - 1; every node starts with a label of its own and moves by its own.

    Each round a node weighs its neighbours' labels: one below it counts for all that it stands for, the one above twice all that the node
    itself stands for; a node's own label counts one and a half times, or three quarters at the top.  Odd rounds move the nodes
    of even depth to the majority, even rounds the others, so that two neighbours never swap.  A shard takes in what its
    quota, an even share of ``total`` and ``slack``, has room for; rows without a group are not counted, as they go where room is
    left.  Of groups that fit a shard those who wish for one shard come first and are let in or kept out together; only larger ones are thinned node by node.
    """
    quota = total / shards * (1 + slack)
    start = F.pmod(F.xxhash64(F.lit("start"), "node"), F.lit(shards)).cast("int")
    state = staged(nodes.select("node", "grp", "depth", "weight", (F.col("group_weight") > quota).alias("large"), start.alias("label")), "labels")
    down = nodes.where("depth > 0").select(F.col("node").alias("a"), F.col("parent").alias("b"), (F.col("near") * 2.0).alias("w"))
    up = nodes.where("depth > 0").select(F.col("parent").alias("a"), F.col("node").alias("b"), (F.col("near") * 1.0).alias("w"))
    both = staged(down.unionByName(up), "links")
    quiet = 0
    for r in range(1, rounds + 1):
        heard = both.join(state.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", "w")
        own = state.select("node", "label", (F.col("weight") * F.when(F.col("depth") == 0, 0.75).otherwise(1.5)).alias("w"))
        votes = heard.unionByName(own).groupBy("node", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("node").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("best"))
        turn = (F.col("depth") % 2 == 0) == F.lit(r % 2 == 1)
        wish = staged(state.join(best, "node").withColumn("best", F.when(turn, F.col("best")).otherwise(F.col("label"))), "wishes")
        flow = wish.groupBy("label", "best", "large").agg(F.sum("weight").alias("n")).collect()
        open_to = []
        for s in range(shards):
            room = quota - sum(x["n"] for x in flow if x["label"] == s == x["best"])
            for large in (False, True):
                come = sum(x["n"] for x in flow if x["best"] == s != x["label"] and x["large"] == large)
                open_to.append(min(1.0, max(0.0, room / come)) if come else 0.0)
                room -= come
        share = F.array(*[F.lit(x) for x in open_to])[F.col("best") * 2 + F.col("large").cast("int")]
        moves = (F.col("best") != F.col("label")) & (_unit(F.lit(r), F.when(F.col("large"), F.col("node").cast("string")).otherwise(F.col("grp"))) < share)
        state = staged(wish.withColumn("label", F.when(moves, F.col("best")).otherwise(F.col("label"))).drop("best"), "labels")
        quiet = 0 if any(x["label"] != x["best"] for x in flow) else quiet + 1
        if quiet == 2:
            break
    return state.select("node", "label", "weight")


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 6, chunk: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of every row of docs.

    Equal texts are linked (null texts among themselves) and stay together as far as even shards
    allow; the law is ``rows``: row counts differ by one at most.  Links fan out to about ``chunk`` documents, at most an eighth
    of a shard; a group is parted only where a shard has no room for it.  A null text has no crc and size 1; repeated rows get a slot each; an empty
    table gives no rows.
    """
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("grp")).withColumn("node", F.xxhash64("doc_id", "grp"))
    rows = staged(rows, "rows")
    nodes = rows.groupBy("node", "grp").agg(F.count(F.lit(1)).alias("weight"))
    n_rows = rows.count()
    chunk = max(1, min(chunk, n_rows // (8 * shards)))
    state = propagate(staged(links(nodes, chunk), "members"), n_rows, shards, rounds)
    labels = state.select("node", "label")
    # rows without a group are dealt by the room that is left
    taken = {r["label"]: r["n"] for r in state.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    left = [max(0.0, n_rows / shards - taken.get(s, 0)) for s in range(shards)]
    start, upto, below = F.lit(shards - 1), sum(left), []
    for s in range(shards - 1, 0, -1):
        upto -= left[s]
        below.append((upto / max(1.0, sum(left)), s - 1))
    for edge, s in below:
        start = F.when(_unit(F.lit("start"), "node") < edge, s).otherwise(start)
    loose, h = F.col("label").isNull(), F.xxhash64(F.lit("place"), F.when(F.col("label").isNull(), F.col("node").cast("string")).otherwise(F.col("grp")))
    # loose rows stand at both ends of a label's range, where the cuts fall
    placed = rows.join(labels, "node", "left").withColumns({"h": h, "pos": F.when(~loose, 1).when(F.col("node") % 2 == 0, 0).otherwise(2),
                                                           "sub": F.when(loose, 0).otherwise(F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.lit(1 << 10)))})
    placed = staged(placed.withColumn("label", F.coalesce("label", start)).drop("grp"), "placed")
    counts = {(r["label"], r["pos"]): r["n"] for r in placed.groupBy("label", "pos").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    bits = max(1, total.bit_length() // 2)
    base, before = 0, []
    for key in sorted(counts):
        before += [F.lit(key[0] * 3 + key[1]), F.lit(base)]
        base += counts[key]
    first = F.create_map(*before) if before else F.create_map(F.lit(0), F.lit(0))
    placed = placed.withColumn("hb", F.shiftright("h", 64 - bits))
    # within a hashed bucket a crowded group is split further
    ranked = ordered_scan(placed, ["label", "pos"], ["hb", "sub", "h", "node"], F.struct("hb", "sub"), row_number="rn")
    rank = F.col("rn") - 1 + first[F.col("label") * 3 + F.col("pos")].cast("long")
    even, over = divmod(total, shards)
    edge = over * (even + 1)
    ranked = ranked.withColumn("rank", rank).withColumn("shard", (
        F.when(F.col("rank") < edge, F.floor(F.col("rank") / F.lit(even + 1)))
        .otherwise(over + F.floor((F.col("rank") - edge) / F.lit(max(1, even))))).cast("int"))
    slot = F.col("rank") - (F.col("shard") * even + F.least(F.col("shard"), F.lit(over)))
    return ranked.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
