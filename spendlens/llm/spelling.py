"""Spelling variants: words one inserted, deleted or replaced letter apart, found through variable-length grams.

A gram dictionary is counted over the vocabulary and pruned by frequency: all pairs of letters, and longer grams as long as
they are frequent.  A word is cut into grams: at each place the longest one of the dictionary, unless another covers it.
For each word a bound says how many of its grams one edit can affect at most.  Two words within one edit then share one of their
rarest (bound + 1) grams, at the same place or one further: those lists are merged, the others skipped, and what meets
is verified.

Words meet in classes by the length of the shorter one.  Grams of a class have at most (length + 2) / 2 letters, so no
single edit affects both the first and the last gram: the bound is always below the number of grams, and no pair is missed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import arrow_rows
from spendlens.session import staged

LEAST_GRAM, MOST_GRAM = 2, 4
DICTIONARY = 50_000  # a longer gram of the dictionary holds at least one in so many gram places
CLASSES = 24  # list lengths of longer words are counted together
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"


def words_of(docs: DataFrame, least: int = 5, times: int = 3, hole: int = 97) -> DataFrame:
    """word and n, how often it occurs: letter runs of whole texts, A-Z lowered.

    Where ``hole`` divides the CRC-32 h of '<doc_id>:<run>', the run's code point h % length is left out; a row without an id has
    no h.  Words shorter than ``least`` code points or rarer than ``times`` are left out.
    """
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), run.alias("run")).where(F.length("run") >= least)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    holed = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("holed"), holed).otherwise(F.col("run")).alias("word")
    found = runs.withColumns({"holed": F.coalesce(h % hole == 0, F.lit(False)), "at": at}).select(word)
    return found.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


class Grams:
    """The gram dictionary, and what its grams begin and end with."""

    def __init__(self, longer: Iterable[str]):
        """longer: frequent grams of three letters and more; every beginning of one that is as long must be among them."""
        self.all = frozenset(longer)
        self.lists: dict[tuple[int, str], int] = {}
        self.starts = frozenset(g[:-1] for g in self.all)
        self.ends: dict[str, int] = {}
        for g in self.all:
            for k in range(1, len(g) - 1):
                self.ends[g[k:]] = min(len(g), self.ends.get(g[k:], len(g)))

    def cut(self, text: str, most: int) -> list[tuple[int, int]]:
        """Spans of the grams of a text, none within another."""
        out, reach = [], 0
        for p in range(len(text) - 1):
            end = p + 2
            while end < len(text) and end - p < most and text[p:end + 1] in self.all:
                end += 1
            if end > reach:
                out.append((p, end))
                reach = end
        return out

    def affected(self, text: str, spans: list[tuple[int, int]], most: int, inserted: bool) -> int:
        """How many of the grams one edit can take away at most: a letter inserted before a place, or the letter there changed or lost.

        A gram goes if the edit falls into it; if it ends before the edit but it or a gram shortly before it may now be longer;
        or if it begins after the edit but a new gram may cover it.
        """
        worst, first = 0, 0
        for i in range(1, len(text)):
            while first < len(spans) and spans[first][0] + most <= i:
                first += 1
            longer = next((q for q in range(max(0, i - most + 1), i - 1) if text[q:i] in self.starts), i)
            after, hits = i if inserted else i + 1, 0
            for p, end in spans[first:first + 2 * most]:
                if end <= i:
                    hits += p >= longer
                elif p < after:
                    hits += 1
                elif end - after >= most:
                    break
                else:
                    hits += self.ends.get(text[after:end], most + 1) <= most
            worst = max(worst, hits)
        return worst


def gram_counts(words: DataFrame) -> DataFrame:
    """gram and n, its places in the vocabulary, each word with a mark at either end."""
    marked = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    of_size = [F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - (q - 1), F.lit(1))), lambda p, q=q: F.substring(F.col("w"), p, q))
               for q in range(LEAST_GRAM + 1, MOST_GRAM + 1)]
    grams = marked.select(F.explode(F.flatten(F.array(*of_size))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _cuts(grams: Grams, word: str):
    """Per class of a word: its length there, whether it is the longer one, the marked text, the longest gram and the spans."""
    text = f"^{word}$"
    for longer in (False, True):
        shape = len(word) - longer
        most = min(MOST_GRAM, (shape + 2) // 2)
        yield shape, longer, text, most, grams.cut(text, most)


def gram_dictionary(words: DataFrame, share: int = DICTIONARY) -> Grams:
    """Grams that make up at least one in ``share`` of all places, so at most ``share`` of each length; and the lengths of the
    lists that hold as much, at most two in ``share``."""
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    often = F.col("n") >= max(4, places // share)
    grams = Grams(r["gram"] for r in gram_counts(words).where((F.length("gram") > LEAST_GRAM) & often).collect())
    schema = "shape int, gram string, n long"
    make = arrow_rows(schema)
    sent = words.sparkSession.sparkContext.broadcast(grams)

    def count(batches):
        for b in batches:
            seen: Counter = Counter()
            for word in b.column(0).to_pylist():
                for shape, _, text, _, spans in _cuts(sent.value, word):
                    seen.update((min(shape, CLASSES), text[p:e]) for p, e in spans)
            yield make([[k[0] for k in seen], [k[1] for k in seen], list(seen.values())])

    lists = words.select("word").mapInArrow(count, schema).groupBy("shape", "gram").agg(F.sum("n").alias("n")).where(often)
    grams.lists = {(r["shape"], r["gram"]): r["n"] for r in lists.collect()}
    return grams


def _letters(word: str) -> int:
    """A bit for each letter that occurs, some sharing one; an edit changes two at most."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) % 61)
    return bits


def prefixes(words: DataFrame, grams: Grams) -> DataFrame:
    """Lists to merge: (key, word, n, letters, long) - key a hash of class, gram and place, long if the word is the longer one there.

    The longer word's grams are listed at their place and at the one before it, where a letter less would put them.
    """
    schema = "key long, word string, n long, letters long, long boolean"
    make = arrow_rows(schema)
    sent = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches):
        grams = sent.value
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                letters = _letters(word)
                for shape, longer, text, most, spans in _cuts(grams, word):
                    bound = grams.affected(text, spans, most, False)
                    if not longer:
                        bound = max(bound, grams.affected(text, spans, most, True))
                    # short lists first; any order would do that is the same for all words of a class
                    order = sorted((grams.lists.get((min(shape, CLASSES), text[p:e]), 0), text[p:e], p) for p, e in spans)
                    for _, gram, p in order[:bound + 1]:
                        for place in (p - 1, p) if longer else (p,):
                            for col, v in zip(out, (xxhash.xxh3_64_intdigest(f"{shape} {place} {gram}"), word, n, letters, longer)):
                                col.append(v)
            yield make([np.array(out[0], np.uint64).view(np.int64), *out[1:]])

    return words.select("word", "n").mapInArrow(run, schema)


def near_words(words: DataFrame, share: int = DICTIONARY) -> DataFrame:
    """Pairs (a, na, b, nb) of words exactly one edit apart, each once."""
    lists = staged(prefixes(words, gram_dictionary(words, share)), "gram-lists")
    one = lists.where("not long").select("key", F.col("word").alias("a"), F.col("n").alias("na"), F.col("letters").alias("la"))
    two = lists.select("key", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("letters").alias("lb"), "long")
    close = F.bit_count(F.col("la").bitwiseXOR(F.col("lb"))) <= 2  # cheap, so asked first
    met = one.join(two, (one["key"] == two["key"]) & close & (F.col("long") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "na", "b", "nb").distinct()


def roots(pointers: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last one by pointer doubling.

    Counts at least double along forms, so a chain has at most some 60 links and takes 6 rounds.
    """
    found = staged(pointers.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = found.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = staged(moved, "roots")
        found = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return found


def variants(docs: DataFrame, least: int = 5, times: int = 3, factor: int = 2, hole: int = 97, share: int = DICTIONARY) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of docs (doc_id, text); see words_of.

    form is the near word of largest n, the smallest of ties in code-point order, if that n is at least ``factor`` times the
    word's own; root is where forms lead.  Words without a near one have n_near 0, words without a form are their own root.  Null and
    empty texts have no words; repeated rows count again; a table without words gives no rows; other columns are not read.
    A text is split in one row, whatever its length.
    """
    words = staged(words_of(docs, least, times, hole), "words")
    pairs = staged(near_words(words, share), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("down"), "other")).alias("best"))
    strong: Column = -F.col("best.down") >= factor * F.col("n")
    formed = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.down")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
