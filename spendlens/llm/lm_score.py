"""Document scores by masked pseudo-likelihood: every word is predicted from the words on both its sides.

A word is one of 65,536 hashed ids.  A small network reads the two words before and the two after and predicts the
word's class; counts over the whole corpus give the word within its class.  A document's score is the sum of
the log-probabilities of all its words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import arrow_rows, summed
from spendlens.llm.similar_sets import word_hashes
from spendlens.session import staged

IDS, CLASSES, INPUTS, DIM, HIDDEN = 1 << 16, 128, 1 << 12, 16, 32
SIDES = (-2, -1, 1, 2)
BATCH = 512
SCORED = 1024  # words scored at once: their class scores stay in the processor's cache
SHAPES = [(INPUTS + 1, DIM), (len(SIDES) * DIM, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
BLOCKS, LOTS = 32, 256


@dataclass
class LanguageNet:
    weights: list[np.ndarray]
    within: np.ndarray  # log-probability of each id within its class

    @cached_property
    def sides(self) -> list[np.ndarray]:
        """What a word adds to the hidden layer, one table for each side it may stand on."""
        return [self.weights[0] @ self.weights[1][k * DIM:(k + 1) * DIM] for k in range(len(SIDES))]


def _ids(text: str | None) -> np.ndarray:
    return (word_hashes(text) >> np.uint64(48)).astype(np.int64) if text else np.zeros(0, np.int64)


def _windows(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inputs around the places at; beyond an end stands a mark of its own."""
    padded = np.full(len(ids) + 4, INPUTS, np.int64)
    padded[2:-2] = ids & (INPUTS - 1)
    return padded.take(at[:, None] + np.array(SIDES) + 2)


def _targets(ids: np.ndarray, stride: int, turn: int) -> np.ndarray:
    """The places of a text that are predicted in a round; ``stride`` rounds in a row take in every place."""
    return np.arange((int(ids[0]) + turn) % stride, len(ids), stride)


def _run_sums(part: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bit for bit np.add.reduceat over the runs of rows from starts on, sizes falling; many short runs are summed at once."""
    out = part.take(starts, 0)
    long, more = np.searchsorted(-sizes, (-8, -1))
    if more > long:
        rest = part.take(starts[long:more] + 1, 0)
        ends = long + np.searchsorted(-sizes[long:more], -np.arange(2, 8))
        for k, end in enumerate(ends.tolist(), 2):
            if end == long:
                break
            rest[:end - long] += part.take(starts[long:end] + k, 0)
        out[long:more] += rest
    if long:
        own = sizes[:long]
        begin = np.cumsum(own) - own
        at = np.repeat(starts[:long] - begin, own)
        at += np.arange(len(at))
        out[:long] = np.add.reduceat(part.take(at, 0), begin)
    return out


def _put(table: np.ndarray, rows: np.ndarray, new: np.ndarray) -> None:
    """table[rows] = new, a row of the input vectors copied as one piece."""
    whole = f"V{4 * DIM}"
    table.view(whole).ravel()[rows] = new.view(whole).ravel()


def _train(w: list[np.ndarray], x: np.ndarray, y: np.ndarray, memory: list[np.ndarray], rate: float) -> None:
    """One step of adaptive gradient descent, in place."""
    n = len(y)
    e = w[0].take(x.ravel(), 0).reshape(n, -1)
    h = e @ w[1]
    h += w[2]
    np.maximum(h, 0, out=h)
    g = h @ w[3]
    g += w[4]
    line, begin = g.reshape(-1), np.arange(n) * CLASSES
    g -= np.maximum.reduceat(line, begin)[:, None]
    np.exp(g, out=g)
    g /= g.sum(1, keepdims=True)
    begin += y
    line[begin] = line.take(begin) - 1
    if n & (n - 1):
        g /= n
    else:
        g *= np.float32(1 / n)  # exact, as n is a power of two
    gh = g @ w[3].T
    gh *= h > 0
    ge = (gh @ w[1].T).reshape(-1, DIM)
    flat = x.ravel().astype(np.uint16)  # short keys sort faster
    order = np.argsort(flat, kind="stable")
    ranked = flat.take(order)
    bounds = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
    sizes = bounds[1:] - bounds[:-1]
    falling = np.argsort((len(flat) - sizes).astype(np.uint16), kind="stable")
    starts = bounds.take(falling)
    rows, gw0 = ranked.take(starts).astype(np.int64), _run_sums(ge.take(order, 0), starts, sizes.take(falling))
    m = gw0 * gw0
    m += memory[0].take(rows, 0)
    _put(memory[0], rows, m)
    np.sqrt(m, out=m)
    m += np.float32(1e-4)
    gw0 *= np.float32(rate)
    gw0 /= m
    _put(w[0], rows, w[0].take(rows, 0) - gw0)
    for i, grad in ((1, e.T @ gh), (2, gh.sum(0)), (3, h.T @ g), (4, g.sum(0))):
        memory[i] += grad * grad
        w[i] -= rate * grad / (np.sqrt(memory[i]) + 1e-4)


def word_ids(docs: DataFrame) -> DataFrame:
    """doc_id and the packed word ids of every whole text (null: none), hashed once for the counts, the rounds and the scores."""
    schema = "doc_id long, ids binary"
    make = arrow_rows(schema)

    def run(batches):
        for b in batches:
            yield make([b.column(0), [_ids(t).astype("<u2").tobytes() for t in b.column(1).to_pylist()]])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _unpacked(batch) -> list[np.ndarray]:
    return [np.frombuffer(p, "<u2").astype(np.int64) for p in batch.column(1).to_pylist()]


def word_counts(words: DataFrame) -> DataFrame:
    """(id, n) over all words of all texts."""
    make = arrow_rows("id int, n long")

    def run(batches):
        total = np.zeros(IDS, np.int64)
        for b in batches:
            for ids in _unpacked(b):
                if len(ids) > IDS // 16:
                    total += np.bincount(ids, minlength=IDS)
                else:
                    np.add.at(total, ids, 1)
        some = np.flatnonzero(total)
        yield make([some, total[some]])

    return words.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def fit_net(docs: DataFrame, **how) -> LanguageNet:
    """``fit_ids`` on the texts of docs."""
    return fit_ids(staged(word_ids(docs), "word-ids"), **how)


def fit_ids(words: DataFrame, stride: int = 1, rounds: int = 2, rate: float = 0.05, seed: int = 5) -> LanguageNet:
    """Counts of all words, and a network trained in every round on every word of every document.

    A larger ``stride`` trains on every ``stride``-th word a round, from a start that moves on with the rounds.

    In each round every partition trains from the common weights on its own documents; the results are averaged, weighted
    by words seen, in two steps so that no task adds up more than a share of them.  The fit grows with the
    corpus; only the weights and one count per id come to the driver.
    """
    counts = np.zeros(IDS)
    for r in word_counts(words).collect():
        counts[r["id"]] = r["n"]
    of_class = counts.reshape(-1, CLASSES).sum(0)
    within = (np.log(counts + 1).reshape(-1, CLASSES) - np.log(of_class + IDS // CLASSES)).ravel()
    rng = np.random.default_rng(seed)
    weights = [(rng.normal(size=s) / np.sqrt(s[0] if i else DIM)).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for i, s in enumerate(SHAPES)]
    weights[4] = np.log((of_class + 1) / (of_class.sum() + CLASSES)).astype(np.float32)
    schema = "block int, lot int, sums binary"
    make = arrow_rows(schema)
    size = sum(w.size for w in weights) + 1

    def train(batches, weights, turn):
        w = [x.copy() for x in weights]
        memory = [np.full(x.shape, 1e-3, np.float32) for x in w]
        xs, ys, held, seen = [], [], 0, 0
        for b in batches:
            for ids in _unpacked(b):
                if not len(ids):
                    continue
                at = _targets(ids, stride, turn)
                xs.append(_windows(ids, at))
                ys.append(ids[at] % CLASSES)
                held += len(at)
                if held >= BATCH * 16:
                    seen += _steps(w, xs, ys, memory, rate)
                    xs, ys, held = [], [], 0
        if held:
            seen += _steps(w, xs, ys, memory, rate)
        if seen:
            flat = np.concatenate([x.ravel() for x in w] + [np.ones(1)]) * seen
            parts = np.array_split(flat, BLOCKS)
            lot = TaskContext.get().partitionId() % LOTS
            yield make([list(range(BLOCKS)), [lot] * BLOCKS, [p.astype("<f8").tobytes() for p in parts]])

    for turn in range(rounds):
        rows = words.mapInArrow(lambda batches, w=weights, turn=turn: train(batches, w, turn), schema)
        got = {r["block"]: np.frombuffer(r["sums"], "<f8") for r in summed(summed(rows, "block lot", "sums"), "block", "sums").collect()}
        if not got:
            break
        flat = np.concatenate([got[k] for k in range(BLOCKS)])
        flat = (flat / flat[size - 1]).astype(np.float32)
        cuts = np.cumsum([w.size for w in weights])
        weights = [p.reshape(s) for p, s in zip(np.split(flat[:size - 1], cuts[:-1]), SHAPES)]
    return LanguageNet(weights, within)


def _steps(w, xs, ys, memory, rate) -> int:
    x, y = np.concatenate(xs), np.concatenate(ys)
    mixed = np.random.default_rng(len(y)).permutation(len(y))
    for s in range(0, len(y), BATCH):
        some = mixed[s:s + BATCH]
        _train(w, x.take(some, 0), y.take(some), memory, rate)
    return len(y)


def log_likelihood(ids: np.ndarray, net: LanguageNet) -> float:
    """Sum of the log-probabilities of all words of a text, each given the words around it."""
    total, (_, _, b1, w2, b2) = 0.0, net.weights
    for s in range(0, len(ids), SCORED):
        at = np.arange(s, min(len(ids), s + SCORED))
        x = _windows(ids, at)
        h = b1 + net.sides[0].take(x[:, 0], 0)
        for k in range(1, len(SIDES)):
            h += net.sides[k].take(x[:, k], 0)
        z = np.maximum(h, 0, out=h) @ w2
        if max(z.max(), -z.min()) > 60:
            z -= z.max(1, keepdims=True)  # cancels below
        y = ids[at]
        total += float((z[np.arange(len(at)), y % CLASSES] + b2[y % CLASSES] + net.within[y]).sum(dtype=np.float64))
        total -= float(np.log(np.exp(z, out=z) @ np.exp(b2)).sum(dtype=np.float64))
    return total


def score_documents(docs: DataFrame, net: LanguageNet) -> DataFrame:
    """doc_id, n_words, log_likelihood and per_word of every row; a text without words has 0, 0 and null."""
    return score_ids(word_ids(docs), net)


def score_ids(words: DataFrame, net: LanguageNet) -> DataFrame:
    """``score_documents`` of the result of ``word_ids``."""
    schema = "doc_id long, n_words long, log_likelihood double, per_word double"
    make = arrow_rows(schema)

    def run(batches):
        for b in batches:
            texts = _unpacked(b)
            sums = [log_likelihood(ids, net) for ids in texts]
            yield make([b.column(0), [len(i) for i in texts], sums, [s / len(i) if len(i) else None for i, s in zip(texts, sums)]])

    return words.mapInArrow(run, schema)
