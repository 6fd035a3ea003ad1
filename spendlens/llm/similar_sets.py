"""Sets of word shingles, and the groups of documents whose sets are linked.

What two sets must share to be looked at, and how a bounded unit of sets is searched for links, is up to the caller; here
is how sets are spread over units, so that neither a group of copies, nor one of near copies, nor a passage that many
share, meets in one task, and no pair that should be looked at is passed over.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.spatial import connected_components
from spendlens.llm.common import arrow_rows
from spendlens.session import staged

QUICK_BANDS = 4
CHUNK = 1 << 22
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(start: int, n: int) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


BYTES, PLACES, RUNS = seeds(1, 256), U(0x9E3779B97F4A7C15), seeds(1000, 8)
SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, A-Z lowered, split at ASCII white space; a chunk at a time."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    out, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + CHUNK)
        if end < len(raw):
            gaps = np.flatnonzero(SPACE[raw[start:end]])
            if len(gaps):
                end = start + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(SPACE[raw[end:]])
                end = end + int(more[0]) + 1 if len(more) else len(raw)
        part = raw[start:end]
        at = np.flatnonzero(~SPACE[part])
        start = end
        if not len(at):
            continue
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        powers = np.cumprod(np.full(int(place.max()) + 1, PLACES, U))
        out.append(mix(np.add.reduceat(BYTES[part[at]] * powers[place], first)))
    return np.concatenate(out) if out else np.zeros(0, U)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words; fewer words are one run; none without words."""
    words = word_hashes(text) if text else np.zeros(0, U)
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mix((words * RUNS[:n]).sum(dtype=U, keepdims=True) + U(n))
    total = words[:n - width + 1] * RUNS[0]
    for j in range(1, width):
        total = total + words[j:n - width + 1 + j] * RUNS[j]
    return np.unique(mix(total))


def print_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit prints of a set."""
    a, b = mix(tokens).sum(dtype=U), mix(tokens * U(0xD6E8FEB86659FD93)).sum(dtype=U)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        if x != y:
            self.of[self.of == max(x, y)] = min(x, y)


def _linked(units: DataFrame, keys: list[str], find: Callable) -> DataFrame:
    """Links (u, v) within each unit of rows (node, grp, odd, tokens, extra)."""
    schema = "u long, v long"
    types = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        nodes = np.asarray(t["node"])
        _, first = np.unique(nodes, return_index=True)
        odd = np.asarray(t["odd"])
        if len(first) < len(nodes):  # a set that came as an odd one and as one of all
            marked = set(nodes[odd].tolist())
            t, nodes = t.take(first), nodes[first]
            odd = np.array([n in marked for n in nodes.tolist()])
        sets = [np.frombuffer(x, U) for x in t["tokens"].to_pylist()]
        pairs = find(sets, t["extra"].to_pylist(), np.asarray(t["grp"]), odd)
        return pa.table({"u": nodes[[p for p, _ in pairs]] if pairs else [], "v": nodes[[q for _, q in pairs]] if pairs else []}, schema=types)

    return units.select(*keys, "node", "grp", "odd", "tokens", "extra").groupBy(*keys).applyInArrow(run, schema)


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with grp, the least node they are connected to."""
    found = connected_components(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return nodes.join(found.select(F.col("v").alias("node"), F.col("component").alias("grp")), "node", "left").withColumn(
        "grp", F.coalesce("grp", "node"))


def _with_main(nodes: DataFrame, key: str, unit_docs: int) -> DataFrame:
    """Per key that holds several groups: the largest one, all nodes, and the chunks the others make."""
    sizes = nodes.groupBy(key, "grp").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy(key).agg(F.max_by("grp", F.struct("k", "grp")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("top"))
    return main.where("top < all").withColumn("chunks", F.ceil((F.col("all") - F.col("top")) / F.lit(unit_docs)).cast("int"))


def _crossed(nodes: DataFrame, key: str) -> DataFrame:
    """Units (key, part, chunk): a chunk of the nodes outside the main group against a part of all nodes."""
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("chunks")).cast("int").alias("chunk")
    odd = nodes.where("grp <> main").select(key, "node", "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), chunk, F.lit(True).alias("odd"))
    every = nodes.select(key, "node", "grp", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("odd"))
    return odd.unionByName(every)


def linked_rows(docs: DataFrame, width: int, bands: Callable, find: Callable, extra: Callable | None = None, unit_docs: int = 512,
                unit_tokens: int = 1 << 21, few_chunks: int = 32) -> DataFrame:
    """(doc_id, text_key, n, root, component_id) of every row of docs (doc_id, text).

    n is the size of the row's set, root names its group of linked sets (null for an empty set), component_id is the least doc_id of the
    group; null if none of its rows has one, and the row's own id without a root.  text_key is xxhash64 of the text: with doc_id it
    tells a row from others, with or without an id, and also where one id stands on several texts.

    ``bands(tokens)`` gives keys, ``find(sets, extras, groups, odd)`` the pairs of positions that link sets of different groups, enough to
    connect all that are linked; only pairs with an odd member need be looked at.  ``extra(tokens)`` is what find wants to know besides.
    A set is known by two 64-bit prints and its size, and carries a number of its own from then on; of equal sets one is compared.

    Sets sharing a key are a block, blocks sharing a set a cluster.  A cluster up to ``unit_docs`` sets and ``unit_tokens`` shingles is
    one unit.  A larger one is worked through in parts of that size: first within the blocks of a few bands; then
    the sets outside its largest group meet all its parts, in chunks.  Where that takes more than ``few_chunks`` chunks, they meet the
    parts of each block they share instead.  No pair that shares a block is passed over, except pairs already known to be connected.
    """
    schema = "doc_id long, text_key long, n long, a long, check long, keys array<long>"
    make = arrow_rows(schema)

    def sign(batches):
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for text in b.column(2).to_pylist():
                tokens = shingles(text, width)
                one, two = print_of(tokens) if len(tokens) else (None, None)
                for col, v in zip(rows, (len(tokens), one, two, bands(tokens) if len(tokens) else None)):
                    col.append(v)
            yield make([b.column(0), b.column(1), *rows])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    base = staged(texts.mapInArrow(sign, schema), "signed")
    n_rows, n_keys = base.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("n") > 0, F.size("keys"))), F.lit(0))).first()
    # a row that stands for the class: the least id and a text of it, or any text where no row has an id
    classes = base.where("n > 0").groupBy("a", "check", "n").agg(
        F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("text_key"), F.first("keys").alias("keys"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes", 48 * n_rows + 8 * n_keys)
    keyed = classes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    blocks = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("far"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    parts = F.greatest(F.ceil(F.col("m") / F.lit(unit_docs)), F.ceil(F.col("t") / F.lit(unit_tokens))).cast("int")
    blocks = staged(blocks.where("hub <> far").select("key", "hub", parts.alias("parts")), "blocks", 10 * n_keys)
    part = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int").alias("part")
    shared = staged(keyed.join(blocks, "key").select("key", "band", "node", "hub", "parts", part), "shared", 36 * n_keys)
    clusters = _grouped(shared.select("node").distinct(), shared.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct())
    sized = staged(clusters.withColumnRenamed("grp", "cluster").join(classes.drop("keys"), "node"), "clusters", 56 * n_rows)
    large = sized.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t")).withColumn(
        "large", (F.col("c") > unit_docs) | (F.col("t") > unit_tokens))
    sized = sized.join(large.drop("c", "t"), "cluster")

    token_schema = "node long, cluster long, large boolean, tokens binary, extra binary"
    rows = arrow_rows(token_schema)

    def collect(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, one, two, node, cluster, is_large in zip(*(c.to_pylist() for c in b.columns)):
                tokens = shingles(text, width)
                if len(tokens) and print_of(tokens) == (one, two):  # not another text of the same hash
                    for col, v in zip(out, (node, cluster, is_large, tokens.tobytes(), extra(tokens) if extra else None)):
                        col.append(v)
            yield rows(out)

    wanted = sized.select(F.col("doc_id").alias("of"), F.col("text_key").alias("key"), "a", "check", "node", "cluster", "large")
    # both sides grow with the corpus: the same plan at every size
    met = texts.join(wanted.hint("merge"), (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("of")))
    tokens = met.select("text", "a", "check", "node", "cluster", "large").mapInArrow(collect, token_schema)
    tokens = staged(tokens.dropDuplicates(["node"]), "tokens")
    every = F.lit(True).alias("odd")
    small = _linked(tokens.where("not large").select("cluster", "node", F.col("node").alias("grp"), every, "tokens", "extra"), ["cluster"], find)
    links = staged(small, "links")
    if not large.where("large").isEmpty():
        big = tokens.where("large").select("node", "tokens", "extra")
        quick = shared.where(F.col("band") < QUICK_BANDS).join(big, "node").withColumns({"grp": F.col("node"), "odd": F.lit(True)})
        links = staged(links.unionByName(_linked(quick, ["key", "part"], find)), "links")
        of_cluster = sized.where("large").select("cluster", "node", "n")
        grouped = staged(_grouped(of_cluster, links), "groups")
        main = _with_main(grouped, "cluster", unit_docs)
        weight = grouped.groupBy("cluster").agg(F.sum("n").alias("t"))
        cut = F.greatest(F.ceil(F.col("all") / F.lit(unit_docs)), F.ceil(F.col("t") / F.lit(unit_tokens))).cast("int")
        main = staged(main.join(weight, "cluster").withColumn("parts", cut).withColumn("few", F.col("chunks") <= few_chunks), "clusters")
        place = F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int")
        whole = grouped.join(main.where("few").drop("few", "t"), "cluster").withColumn("part", place)
        links = links.unionByName(_linked(_crossed(whole, "cluster").join(big, "node"), ["cluster", "part", "chunk"], find))
        many = grouped.join(main.where("not few").select("cluster"), "cluster").select("node", "grp")
        here = staged(shared.join(many, "node"), "large-groups")
        blocked = here.join(_with_main(here, "key", unit_docs), "key")
        links = links.unionByName(_linked(_crossed(blocked, "key").join(big, "node"), ["key", "part", "chunk"], find))
        links = staged(links, "links")
    final = _grouped(sized.select("node"), links)
    root = classes.select("a", "check", "n", "node").join(final, "node", "left").select("a", "check", "n", F.coalesce("grp", "node").alias("root"))
    rooted = staged(base.drop("keys").join(root, ["a", "check", "n"], "left").select("doc_id", "text_key", "n", "root"), "roots", 32 * n_rows)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select(
        "doc_id", "text_key", "n", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and others) to keep: of each group of linked_rows() one row, that of the least doc_id; rows
    without words all stay.

    Of a row that occurs more than once, and of an id on several texts of one group, one stays; a group without any id keeps one of its texts.
    """
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    keep = linked.where("root is not null").groupBy("root").agg(F.min(at).alias("at")).select(
        F.col("at.doc_id").alias("__of"), F.col("at.text_key").alias("__key"))
    named = docs.withColumn("__text_key", F.xxhash64("text"))
    met = named.join(keep.hint("merge"), (F.col("__text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__of")), "left_semi")
    kept = met.dropDuplicates(["doc_id", "__text_key"]).drop("__text_key")
    blank = linked.where("root is null").select(F.col("doc_id").alias("__of"), F.col("text_key").alias("__key")).distinct()
    wordless = named.join(blank.hint("merge"), (F.col("__text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__of")), "left_semi")
    return kept.unionByName(wordless.drop("__text_key"))
