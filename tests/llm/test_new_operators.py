"""Spelling variants, target resampling and min-hash duplicates against brute force, on odd rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendlens.llm import jaccard_join, minhash, queries, resample, similar_sets, spelling
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    long = " ".join(f"w{i % 977} the of and" for i in range(60_000))
    odd = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "!!! 123 ???"), (1004, long), (1005, "İstanbul Σίσυφος 漢字 ÇŸ×÷ç a\x1cb"), (1006, "x" * 300_000),
           (None, "a text without an id, but of some words"), (None, None), rows[3], rows[3], (1007, rows[3][1]), (1008, "one two three"), (1009, "ONE two  three")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string")
    extra = {c: F.lit(7) for c in ("n", "word", "score", "rank", "weight", "node", "root", "key", "a", "check", "text_key", "buckets", "kept")}
    return df.withColumns(extra).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


# ---- spelling ------------------------------------------------------------------------------

def edits_apart(a, b):
    """True if one inserted, deleted or replaced letter turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_words(rows, hole=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % hole == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_variants(words):
    near = defaultdict(list)
    for w in words:
        for v in words:
            if abs(len(w) - len(v)) <= 1 and edits_apart(w, v):
                near[w].append(v)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v))
        if words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def test_variants(docs, none, rows):
    got = spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len({r["word"] for r in got})
    assert {r["word"]: tuple(r)[1:] for r in got} == brute_variants(brute_words(rows))
    assert spelling.variants(none).count() == 0


@pytest.mark.parametrize("share", [1, 40, 100_000])
def test_near_words_of_dense_vocabularies(spark, share):
    """Few letters, repeated letters, all short lengths and some long ones: no pair is missed, whatever the dictionary holds."""
    rng = random.Random(share)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.choice((5, 5, 6, 6, 7, 8, 9, 14)))) for _ in range(900)}
    words |= {"a" * k for k in range(5, 40)} | {"ab" * k for k in range(3, 12)} | {"abc" * 40, "abc" * 40 + "x", "abc" * 20 + "y" + "abc" * 20}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = [(r["a"], r["b"]) for r in spelling.near_words(df, share).collect()]
    want = {frozenset((a, b)) for a in words for b in words if edits_apart(a, b)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_bound_stays_below_the_number_of_grams():
    rng = random.Random(5)
    grams = spelling.Grams({"abc", "bca", "cab", "abca", "aaa", "aaaa", "^ab", "^abc", "bc$", "abc$", "bab", "aba"})
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 20)))
        for shape, longer, text, most, spans in spelling._cuts(grams, word):
            for kind in (False,) if longer else (False, True):
                assert shape < 5 or grams.affected(text, spans, most, kind) < len(spans)


def test_roots_of_a_long_chain(spark):
    got = spelling.roots(spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(60)], "word string, form string")).collect()
    assert {r["word"]: r["root"] for r in got} == {f"w{i}": "w60" for i in range(60)}


# ---- resampling ----------------------------------------------------------------------------

def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
    return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)


def brute_resample(rows, target, percent=25):
    of = [(i, *brute_features(t)) for i, t in rows]
    s, t = Counter(x for _, f, _ in of for x in f), Counter(x for text in target for x in brute_features(text)[0])
    all_s, all_t = s.total(), t.total()
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (all_s + 10000) / ((s[k] + 1) * (all_t + 10000)))) for k in s}
    out, fit = [], []
    for i, f, words in of:
        weight, score = sum(gain[x] for x in f) // len(f) if f else 0, None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        if score is not None and words >= 20:
            fit.append((-score, i, len(f), weight))
        else:
            out.append((i, len(f), weight, score, None))
    for k, (down, i, n, weight) in enumerate(sorted(fit)):
        out.append((i, n, weight, -down, k + 1 if k < percent * len(fit) // 100 else None))
    return Counter(out)


@pytest.mark.parametrize("head", [{}, {"head_words": 30, "head_pairs": 8}])
def test_resample(spark, docs, none, rows, head):
    """The head's size decides nothing but the cost."""
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resample.resample(docs, target, **head).collect()
    assert Counter(tuple(r) for r in got) == brute_resample(rows, [r["text"] for r in target.collect()])


def test_resample_empty(docs, none, rows):
    assert resample.resample(none, docs).count() == 0
    assert Counter(tuple(r) for r in resample.resample(docs, none).collect()) == brute_resample(rows, [])


def test_features_over_the_edges_of_pieces(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 16)
    head = resample.Head(np.zeros((0, 2), np.uint64), np.zeros((0, 4), np.uint64), 10000)
    texts = ["One two", None, "three", "", "a-b c" + "d" * 50 + " é ÀB " + "x" * 40, "two", "one TWO three four five six seven"]
    batch = pa.array(texts)[1:]
    got = [[] for _ in batch]
    last = None
    for w in resample.pieces(batch):
        follows = np.concatenate([[False], w.doc[1:] == w.doc[:-1]])
        single, double = resample._buckets(w, follows, head, 10000)
        if last is not None and last[0] == w.doc[0]:
            got[w.doc[0]] += ((w.run(resample._step(last[1], np.uint32(32)), np.zeros(1, np.int64)) ^ resample.START) % np.uint32(10000)).tolist()
        last = (w.doc[-1], w.run(np.array([resample.START]), np.array([len(w.start) - 1])))
        for d, v in zip(w.doc, single):
            got[d].append(int(v))
        for d, v in zip(w.doc[follows], double):
            got[d].append(int(v))
    assert [sorted(g) for g in got] == [sorted(brute_features(t)[0]) for t in texts[1:]]


# ---- min-hash ------------------------------------------------------------------------------

def brute_components(rows, width, percent=80):
    """Per row its set's size and the least id of its group; rows without an id link too."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                above[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("how", [{}, {"unit_docs": 2}, {"unit_docs": 2, "few_chunks": 0}])
def test_minhash(docs, none, rows, how):
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs, **how).collect())
    assert got == Counter((*r, r[0] == r[2]) for r in brute_components(rows, 4))
    assert minhash.near_duplicates(none).count() == 0


def chain(n=60, seed=1):
    """Copies that differ a little from step to step, under a line that every text shares, and texts with no more than that line in common."""
    rng = np.random.default_rng(seed)
    line = " ".join(f"line{i}" for i in range(12))
    base, texts = [f"b{i}" for i in range(80)], []
    for k in range(n):
        base[rng.integers(80)] = f"c{k}"
        texts.append((k, line + " " + " ".join(base)))
    return texts + [(1000 + k, line + " " + " ".join(f"u{k}x{i}" for i in range(3 + k % 40))) for k in range(2 * n)]


@pytest.mark.parametrize("how", [{"unit_docs": 5}, {"unit_tokens": 300, "few_chunks": 1}])
def test_minhash_chain(spark, how):
    texts = chain()
    got = Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), **how).collect())
    assert got == Counter((*r, r[0] == r[2]) for r in brute_components(texts, 4))


@pytest.mark.parametrize("seed", [2, 3])
def test_rows_without_an_id_are_bridges(spark, seed):
    """Every second row of a chain has no id, and two unrelated texts share one."""
    texts = [(None if k % 2 and k < 1000 else k, t) for k, t in chain(30, seed)] + [(0, "another text under an id that is taken, with words enough"), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert Counter(tuple(r) for r in minhash.near_duplicates(df).collect()) == Counter((*r, r[0] == r[2]) for r in brute_components(texts, 4))
    assert Counter(tuple(r) for r in jaccard_join.near_duplicates(df).collect()) == Counter(brute_components(texts, 5))


def test_one_of_each(spark):
    """Null-id copies, an id on two texts, repeated rows and rows without words: one row a group, all wordless ones."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, one, 1), (None, one, 2), (7, two, 3), (7, one + " end", 4), (7, two, 3), (9, two, 5), (11, None, 6), (None, "", 7), (None, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, of long")
    kept = similar_sets.one_of_each(df, similar_sets.linked_rows(df, 5, jaccard_join._bands, jaccard_join.tree_links)).collect()
    assert Counter(tuple(r) for r in kept) == Counter([(7, two, 3), (7, one + " end", 4), (11, None, 6), (None, "", 7), (None, "", 7)])
    alone = df.where("doc_id is null")
    kept = similar_sets.one_of_each(alone, similar_sets.linked_rows(alone, 5, jaccard_join._bands, jaccard_join.tree_links)).collect()
    assert sum(r["text"] == one for r in kept) == 1 and len(kept) == 3


def test_least_matches_is_the_tail_of_the_posterior():
    """Against draws: a pair at the threshold is dropped about as rarely as asked, one far below almost always."""
    least = minhash.least_matches(80, 0.01)
    rng = np.random.default_rng(0)
    for similarity, low, high in ((0.8, 0, 0.03), (0.4, 0.99, 1)):
        agree = (rng.random((20_000, minhash.HASHES)) < similarity).cumsum(1)
        dropped = np.any([agree[:, n - 1] < m for n, m in least.items()], axis=0).mean()
        assert low <= dropped <= high
    assert all(a <= b for a, b in zip(minhash.least_matches(80, 1e-9).values(), least.values()))


@pytest.mark.parametrize("name", ["op5_jaccard_join", "op11_spelling_variants", "op12_target_resample", "op13_minhash_dedup"])
def test_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE[name]) == ""
