"""Secrets in texts: fixed patterns, and character Markov models for strings no pattern names.

Only DataFrame operations.  Two first-order models, of random strings and of ordinary words and identifiers, give every pair of
neighbouring characters a log-likelihood ratio; a long token whose ratios add up is a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.skew import one_row
from spendlens.llm.common import kept_share
from spendlens.session import staged

# Fixed patterns, the group that is measured, and its least length
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]

LEAST = 12  # characters of a token that is scored
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1
BACK = 0.05  # weight of the characters' own shares in both models


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _spans(text: Column, pattern: str, kind: int, maybe: Column, group: int = 0, least: int = 0) -> Column:
    """Spans (s, e, k) of all matches in code points; the pattern is only run where ``maybe`` holds."""
    p, none = F.lit(pattern), F.array().cast("array<struct<s:int,e:int,k:int>>")
    pieces = F.split(text, pattern, -1)
    hits = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("hit"),
                        F.transform(F.regexp_extract_all(text, p, F.lit(group)), F.length).alias("size"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.coalesce(x["hit"], F.lit(0))
        new = F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("k")))
        return F.struct(e.alias("at"), F.when(x["size"] >= least, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    return F.when(maybe & F.regexp_like(text, p), F.aggregate(hits, start, step, lambda acc: acc["out"])).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind."""
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    every = F.concat(_spans(text, ASSIGN, 0, named, 2, 8), _spans(text, ACCESS, 1, text.contains("AKIA"), 0, 16), _spans(text, HEX, 2, F.lit(True), 0, 32))
    return F.array_sort(every, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]))


def _place(c: Column) -> Column:
    """0 for a character outside the alphabet, else its place."""
    return F.instr(F.lit(ALPHABET), c)


def _characters(w: Column) -> Column:
    return F.filter(F.split(w, ""), lambda c: c != "")


def _pairs(tokens: DataFrame) -> DataFrame:
    """How often each pair of neighbouring characters occurs in column w."""
    chars = tokens.where(F.length("w") > 1).select(_characters(F.col("w")).alias("c"))
    left, right = F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1)
    pair = chars.select(F.explode(F.arrays_zip(left.alias("a"), right.alias("b"))).alias("p"))
    return pair.groupBy((_place(F.col("p.a")) * SIDE + _place(F.col("p.b"))).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def _drawn(docs: DataFrame, n: int) -> DataFrame:
    """n labelled random strings w of 16 to 40 characters, out of digests of counters: letters and digits, every fourth with + and /."""
    digest = lambda salt: F.base64(F.unhex(F.sha2(F.concat_ws(":", F.lit(salt), F.col("id")), 256)))
    both = F.concat(digest("a"), digest("b"))
    return docs.sparkSession.range(n).select(F.when(F.col("id") % 4 == 0, F.regexp_replace(both, "=", "")).otherwise(
        F.regexp_replace(both, "[+/=]", "")).alias("s"), "id").select(F.col("s").substr(F.lit(1), (F.lit(16) + F.col("id") % 25).cast("int")).alias("w"))


def _identifiers(words: Column) -> Column:
    """Labelled ordinary identifiers, one of every three words: names, paths, settings, numbers, dates, UUIDs, rules."""
    def written_as(a: Column, b: Column, d: Column, number: Column) -> Column:
        la, lb, ld, digest = F.lower(a), F.lower(b), F.lower(d), F.md5(F.concat(a, b, d))
        day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (number % 20000).cast("int")), "yyyy-MM-dd")
        forms = [
            F.concat(la, F.initcap(lb), F.initcap(ld)),
            F.concat_ws("_", la, lb, ld),
            F.concat(F.initcap(la), F.initcap(lb), F.initcap(ld)),
            F.concat_ws("/", F.lit(""), la, lb, ld),
            F.upper(F.concat_ws("_", a, b, d)),
            F.concat_ws("-", la, lb, ld),
            F.concat_ws("=", F.concat_ws("_", la, lb), (number % 100000).cast("string")),
            F.concat(la, F.initcap(lb), (number % 1000).cast("string")),
            F.concat_ws("-", *[F.substring(digest, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
            F.concat(number.cast("string"), F.crc32(b).cast("string")),
            F.concat(F.upper(F.substring(a, 1, 3)), F.initcap(lb), F.initcap(ld)),
            F.concat(la, F.initcap(lb), F.upper(F.substring(d, 1, 3))),
            F.concat_ws("_", F.concat(la, (number % 10).cast("string")), F.concat(lb, (number % 100).cast("string")), ld),
            F.concat_ws("-", la, day),
            F.concat_ws("/", F.lit(""), la, F.regexp_replace(day, "-", "/"), F.concat_ws("-", lb, ld)),
            F.repeat(F.substring(F.lit(ALPHABET), (number % len(ALPHABET)).cast("int") + 1, F.lit(1)), 16),
        ]
        which, told = F.pmod(number, F.lit(len(forms))), F.lit(None).cast("string")
        for i in reversed(range(len(forms))):  # only the branch that is taken is computed
            told = F.when(which == i, forms[i]).otherwise(told)
        return told

    def one(i: Column) -> Column:
        a, b, d = (F.element_at(words, (3 * i + k).cast("int")) for k in (1, 2, 3))
        return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), d.alias("d"), F.crc32(F.concat(a, b, d)).alias("n"))),
                           lambda x: written_as(x["a"], x["b"], x["d"], x["n"]))[0]

    triples = F.floor(F.size(words) / 3)
    return F.when(triples > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), triples - 1), one)).otherwise(F.array().cast("array<string>"))


def fit_markov(docs: DataFrame, random_rows: int = 400_000, ordinary_rows: int = 4_000, known: DataFrame | None = None, drawn: int = 4_000) -> DataFrame:
    """One row: ratio, the log-likelihood ratios of all character pairs, by first and second place.

    Labelled samples.  Random: values under the fixed patterns that name a secret, and ``drawn`` strings of hashed counters.
    Ordinary: the words around them, and identifiers that ``_identifiers`` makes of neighbouring words.
    They come from two hashed samples of whole documents, about ``random_rows`` and ``ordinary_rows`` at most;
    ``known`` (w, random) adds labelled strings of one's own.  Without ordinary samples the ratios come from smoothing
    alone: the drawn strings still tell how random ones look.
    """
    docs = docs.select("doc_id", _text().alias("text"))
    n = docs.count()
    sample = docs.where(kept_share(min(1.0, random_rows / max(1, n)), "doc_id")).where(
        F.lower("text").rlike("passw|secret|token|api") | F.col("text").contains("AKIA"))
    # the values themselves: what follows the name, and keys; purely hexadecimal ones teach nothing, as ordinary prints look alike
    values = F.concat(*[F.regexp_extract_all(F.col("text"), F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 2), (ACCESS, 0))])
    random = sample.select(F.explode(values).alias("w")).where((F.length("w") >= 16) & ~F.col("w").rlike("^[0-9a-f]+$")).unionByName(_drawn(docs, drawn))
    ordinary = docs.where(kept_share(min(1.0, ordinary_rows / max(1, n)), "doc_id", F.lit(1)))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = ordinary.select(clean.alias("clean"))
    words = ordinary.select(F.explode(F.regexp_extract_all("clean", F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("w"))
    letters = ordinary.select(F.regexp_extract_all("clean", F.lit(r"[A-Za-z]{2,}"), F.lit(0)).alias("a"))
    words = words.unionByName(letters.select(F.explode(_identifiers(F.col("a"))).alias("w")))
    if known is not None:
        random, words = random.unionByName(known.where("random").select("w")), words.unionByName(known.where("not random").select("w"))
    both = _pairs(random).withColumnRenamed("n", "r").join(_pairs(words).withColumnRenamed("n", "o"), "pair", "full")
    grid = docs.sparkSession.range(SIDE * SIDE).withColumnRenamed("id", "pair").join(both, "pair", "left").select(
        "pair", F.expr(f"pair div {SIDE}").alias("a"), (F.col("pair") % SIDE).alias("b"), (F.coalesce("r", F.lit(0)) + 0.5).alias("r"), (F.coalesce("o", F.lit(0)) + 0.5).alias("o"))
    # a pair's share after its first character, interpolated with its second one's share: pairs not seen stay possible (a grid of fixed size)
    of = lambda n, *by: F.sum(n).over(Window.partitionBy(*by))
    seen = lambda n: (1 - BACK) * F.col(n) / of(n, "a") + BACK * of(n, "b") / of(n, F.lit(0))
    ratio = F.log(seen("r") / seen("o"))
    every = grid.select(F.struct("pair", ratio.alias("x")).alias("p")).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return staged(every.select(F.transform("p", lambda p: p["x"]).alias("ratio")), "markov")


def scan(docs: DataFrame, model: DataFrame, least: float = 10.0, rate: float = 0.8) -> DataFrame:
    """docs with base and spans, arrays of (s, e, k): the fixed patterns' spans, and all spans.

    The models add tokens of ``LEAST`` characters or more whose ratios sum to ``least`` or more, and to ``rate`` a pair
    or more, and that touch no base span; their kind is random.  The rate keeps long runs of ordinary words that the
    corpus lacks: each odd pair adds a little, but most pairs are ordinary.  A null text counts as empty and has none.
    Columns of these names in docs are replaced.
    """
    docs = docs.drop("base", "spans", "__tokens", "__ratio")
    text = _text()
    found = docs.withColumns({"base": base_spans(text), "__tokens": _spans(text, TOKEN, 3, F.lit(True), 0, LEAST)})
    # not merged into what follows: each span list is computed once
    found = found.select(*docs.columns, F.inline(F.array(F.struct("base", "__tokens")))).withColumn("__ratio", F.when(F.size("__tokens") > 0, one_row(model)["ratio"]))

    def total(w: Column) -> Column:
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

        def step(acc: Column, c: Column) -> Column:
            ratio = F.when(acc["last"] >= 0, F.col("__ratio")[acc["last"] * SIDE + _place(c)]).otherwise(0.0)
            return F.struct(_place(c).alias("last"), (acc["sum"] + ratio).alias("sum"))

        return F.aggregate(_characters(w), start, step, lambda acc: acc["sum"])

    def odd(t: Column) -> Column:
        w = text.substr(t["s"] + 1, t["e"] - t["s"])
        free = ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))
        return free & (total(w) >= F.greatest(F.lit(least), rate * (t["e"] - t["s"] - 1)))

    spans = F.array_sort(F.concat("base", F.filter("__tokens", odd)), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]))
    return found.select(*docs.columns, "base", F.when(F.size("__tokens") > 0, spans).otherwise(F.col("base")).alias("spans"))


def written(spans: Column | str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, overlapping ones merged, replaced by mark; spans ascend by start."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        between = F.when(x["s"] >= acc["at"], F.concat(acc["out"], text.substr(acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), between.alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
