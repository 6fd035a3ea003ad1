"""Language identification by error-correcting output codes.

Every language has a codeword of signs.  One binary classifier per position, on hashed letter
n-grams, predicts the sign; the codeword with the least weighted loss over all positions wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import arrow_rows, every_character, kept_share, once_per_process, summed, with_columns
from spendlens.session import staged

UNDETERMINED = "und"
ORDERS = 3
BINS = 1 << 14
CHUNK = 1 << 18


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x positions, signs
    weights: np.ndarray  # n-gram bins x positions, log-odds
    trust: np.ndarray  # languages x positions, how far a position can be relied on


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of signs, far apart: the exhaustive code up to seven languages, else the best of seeded draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    length, rng = 10 * int(np.ceil(np.log2(n))), np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice((-1.0, 1.0), (n, length))
        code[:, np.abs(code.sum(0)) == n] = rng.permutation(np.resize((1.0, -1.0), n))[:, None]
        agree = code @ code.T - 2 * length * np.eye(n)
        if length - agree.max() > apart:
            best, apart = code, length - agree.max()
    return best


def _letters() -> np.ndarray:
    return once_per_process("letters", lambda: np.char.isalpha(every_character()))


def _bins(text: str | None, letters: np.ndarray):
    """Bins of all letter n-grams of the whole text, a chunk at a time; nothing without a letter."""
    if not text:
        return
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(letters[codes], codes, 32)
    if not (codes != 32).any():
        return
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))].astype(np.uint64)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    for start in range(0, len(codes), CHUNK):
        part, rolled = codes[start:start + CHUNK + ORDERS - 1], None
        out = []
        for order in range(ORDERS):
            own = part[order:] * np.uint64(0x9E3779B97F4A7C15)
            rolled = own if rolled is None else rolled[:-1] * np.uint64(0xD6E8FEB86659FD93) + own
            used = rolled[:CHUNK]
            mixed = (used ^ (used >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(64 - 14)).astype(np.int64) + order * BINS)
        yield np.concatenate(out)


def _margins(text: str | None, weights: np.ndarray, letters: np.ndarray) -> np.ndarray | None:
    total, n = 0.0, 0
    for bins in _bins(text, letters):
        total = total + weights[bins].sum(0, dtype=np.float64)
        n += len(bins)
    return total / np.sqrt(n) if n else None


def fit_language(docs: DataFrame, fit_rows: int = 8000, partitions: int = 16) -> LanguageModel:
    """Learn from the rows of docs (text, lang, doc_id) that have both a text and a lang.

    ``fit_rows`` bounds the sample: about as many whole documents of each language at most, chosen
    by a hash of the id, so that a small table is used whole and a large one costs no more.
    No usable row gives a model without languages.
    """
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.count(F.lit(1))).alias("share"))
    shares = {r["lang"]: r["share"] for r in share.collect()}
    languages = sorted(shares)
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((ORDERS * BINS, 1), np.float32), np.ones((0, 1)))
    picked = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    sample = known.where(kept_share(picked[F.col("lang")], "doc_id"))
    sample = staged(sample.select("text", "lang").repartition(partitions), "language-sample")
    place = {name: k for k, name in enumerate(languages)}

    counted = "lang string, counts binary"
    make = arrow_rows(counted)

    def count(batches):
        letters, total = _letters(), {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = total.setdefault(lang, np.zeros(ORDERS * BINS))
                for bins in _bins(text, letters):
                    own += np.bincount(bins, minlength=len(own))
        if total:
            yield make([list(total), [v.astype("<f8").tobytes() for v in total.values()]])

    counts = np.zeros((len(languages), ORDERS, BINS))
    for r in summed(sample.mapInArrow(count, counted), "lang", "counts").collect():
        counts[place[r["lang"]]] = np.frombuffer(r["counts"], "<f8").reshape(ORDERS, BINS)
    counts += 0.5
    shares_of = counts / counts.sum(2, keepdims=True)
    codes = codewords(len(languages))
    weights = np.empty((ORDERS * BINS, codes.shape[1]), np.float32)
    for j in range(codes.shape[1]):
        on, off = codes[:, j] > 0, codes[:, j] < 0
        if off.any() and on.any():
            weights[:, j] = np.log(shares_of[on].mean(0) / shares_of[off].mean(0)).ravel()
        else:
            weights[:, j] = 1.0

    right = "lang string, hits binary"
    rows = arrow_rows(right)

    def judge(batches):
        letters, total = _letters(), {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = total.setdefault(lang, np.zeros(codes.shape[1] + 1))
                margins = _margins(text, weights, letters)
                if margins is not None:
                    own[:-1] += (margins * codes[place[lang]]) > 0
                    own[-1] += 1
        if total:
            yield rows([list(total), [v.astype("<f8").tobytes() for v in total.values()]])

    trust = np.ones(codes.shape)
    for r in summed(sample.mapInArrow(judge, right), "lang", "hits").collect():
        got = np.frombuffer(r["hits"], "<f8")
        trust[place[r["lang"]]] = (got[:-1] + 1) / (got[-1] + 2)
    return LanguageModel(languages, codes, weights, trust / trust.mean(1, keepdims=True))


def identify(docs: DataFrame, model: LanguageModel, gap: float = 0.05) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous.

    A null text or one without a letter is ``und`` with score 0; so is every text under a model
    without languages.  ``ambiguous`` marks texts whose two nearest codewords are almost equally
    near: their scores differ by less than ``gap``.  Of equally near ones the first in order wins.
    """
    languages, codes, weights, trust = model.languages, model.codes, model.weights, model.trust

    def predict(texts):
        letters = _letters()
        names, scores, unsure = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            margins = _margins(text, weights, letters) if languages else None
            if margins is None:
                names.append(UNDETERMINED)
                continue
            loss = (trust * np.logaddexp(0, -codes * margins)).sum(1)
            chance = np.exp(loss.min() - loss)
            chance /= chance.sum()
            best = int(np.argmin(loss))
            names.append(languages[best])
            scores[k] = chance[best]
            unsure[k] = len(chance) > 1 and chance[best] - np.delete(chance, best).max() < gap
        return [names, scores, unsure]

    return with_columns(docs, "lang_pred string, score double, ambiguous boolean", predict)
