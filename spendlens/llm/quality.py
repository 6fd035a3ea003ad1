"""Quality scores: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import arrow_rows, every_character, kept_share, once_per_process, summed, with_columns
from spendlens.session import staged

STATISTICS = 22
STEPS = 2048  # score steps the calibration counts in


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated ones


def _kinds() -> np.ndarray:
    """Kind of every code point: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 ASCII symbol, 7 other letter."""
    c, at = every_character(), np.arange(0x110000)
    alpha = np.char.isalpha(c)
    marks = np.isin(at, [ord(x) for x in ".,;:!?'\"()-"])
    cases = [alpha & np.char.isupper(c), alpha & np.char.islower(c), alpha, np.char.isspace(c), np.char.isdigit(c), marks, at < 128]
    return np.select(cases, [2, 1, 7, 4, 3, 5, 6], 0).astype(np.uint8)


def _statistics(text: str | None, kinds: np.ndarray) -> np.ndarray:
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.bincount(kinds[codes], minlength=8) / max(1, len(codes))
    n, sizes = max(1, len(words)), np.fromiter(map(len, words), np.int64, len(words))
    times = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    heads = np.bincount(codes[codes < 256], minlength=256) / max(1, len(codes)) if len(codes) else np.zeros(256)
    heads = heads[heads > 0]
    marked = sum(c for w, c in times.items() if not w.isalnum())
    return np.array([
        np.log1p(len(codes)), np.log1p(len(words)), sizes.mean() if words else 0, sizes.std() if words else 0,
        len(times) / n, pairs / n, max(times.values(), default=0) / n,
        *kind, -(heads * np.log(heads)).sum(), np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        marked / n, sum(c for w, c in times.items() if w.isupper() and len(w) > 1) / n,
        text.count("!") / n, text.count("|") / n])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text; a null text counts as empty."""
    def run(texts):
        kinds = once_per_process("kinds", _kinds)
        return [[_statistics(t, kinds) for t in texts]]

    return with_columns(docs.select("doc_id", "text"), "stats array<double>", run).select("doc_id", "stats")


def _features(stats: np.ndarray, m: QualityModel) -> np.ndarray:
    x = np.clip((stats - m.mean) / m.scale, -8, 8)
    waves = np.cos(x @ m.directions + m.phases) * np.sqrt(2 / len(m.phases))
    return np.concatenate((np.ones((len(x), 1)), x, waves), 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, STATISTICS)


def _rising(scores: np.ndarray, weights: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns the middles of the pools and their levels."""
    pools: list[list[float]] = []
    for s, w, m in zip(scores, weights, means):
        pools.append([s * w, w, m * w])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    p = np.array(pools)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


def fit_quality(stats: DataFrame, labels: DataFrame, fit_rows: int = 200_000, waves: int = 384, penalty: float = 1.0,
                partitions: int = 24, seed: int = 11) -> QualityModel:
    """Learn label 1 against 0 from labels (doc_id, quality) and the statistics of those documents.

    ``fit_rows`` bounds the labelled rows used, chosen by a hash of the id.  Normal equations are summed per
    partition and fold, then over partitions; each fold is scored by the other one's fit, and the isotonic
    curve is drawn through those scores.  Without a labelled row every score is 0.5.
    """
    rng = np.random.default_rng(seed)
    model = QualityModel(np.zeros(STATISTICS), np.ones(STATISTICS), rng.normal(size=(STATISTICS, waves)) / np.sqrt(STATISTICS),
                         rng.uniform(0, 2 * np.pi, waves), np.zeros(0), np.array([0.0]), np.array([0.5]))
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    known = labels.count()
    picked = labels.where(kept_share(min(1.0, fit_rows / max(1, known)), "doc_id"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int")
    rows = stats.join(picked, "doc_id").select(fold.alias("fold"), "y", "stats").repartition(partitions)
    rows = staged(rows, "quality-sample")
    sums = rows.select(*[F.struct(F.avg(F.col("stats")[i]), F.stddev_pop(F.col("stats")[i])) for i in range(STATISTICS)]).first()
    if sums[0][0] is None:
        return model
    model.mean = np.array([s[0] for s in sums])
    model.scale = np.array([s[1] if s[1] and s[1] > 1e-9 else 1.0 for s in sums])
    width = 1 + STATISTICS + waves
    schema = "fold int, row int, sums binary"
    make = arrow_rows(schema)

    def normal(batches):
        total = np.zeros((2, width, width + 1))
        for b in batches:
            fold, y = np.asarray(b.column(0)), np.asarray(b.column(1), float)
            z = _features(_matrix(b.column(2)), model)
            for f in (0, 1):
                own = z[fold == f]
                total[f] += own.T @ np.concatenate((own, y[fold == f][:, None]), 1)
        for f in (0, 1):
            yield make([[f] * width, list(range(width)), [v.astype("<f8").tobytes() for v in total[f]]])

    eq = np.zeros((2, width, width + 1))
    for r in summed(rows.mapInArrow(normal, schema), "fold row", "sums").collect():
        eq[r["fold"], r["row"]] = np.frombuffer(r["sums"], "<f8")

    def solve(e: np.ndarray) -> np.ndarray:
        hold = np.full(width, penalty)
        hold[0] = 1e-6
        return np.linalg.solve(e[:, :-1] + np.diag(hold), e[:, -1])

    crossed = np.stack([solve(eq[1]), solve(eq[0])])
    model.ridge = solve(eq.sum(0))
    schema2 = "step int, y int"
    make2 = arrow_rows(schema2)

    def outside(batches):
        for b in batches:
            fold = np.asarray(b.column(0))
            raw = np.einsum("ij,ij->i", _features(_matrix(b.column(2)), model), crossed[fold])
            yield make2([np.rint(np.clip(raw, -1, 2) * STEPS).astype(np.int32), b.column(1)])

    steps = rows.mapInArrow(outside, schema2).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("step").collect()
    model.knots, model.levels = _rising(np.array([r["step"] / STEPS for r in steps]), np.array([float(r["n"]) for r in steps]),
                                        np.array([r["y"] for r in steps]))
    return model


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row of statistics()."""
    schema = "doc_id long, score double"
    make = arrow_rows(schema)

    def run(batches):
        for b in batches:
            if len(model.ridge):
                raw = _features(_matrix(b.column(1)), model) @ model.ridge
                score = np.clip(np.interp(raw, model.knots, model.levels), 0, 1)
            else:
                score = np.full(b.num_rows, 0.5)
            yield make([b.column(0), score])

    return stats.select("doc_id", "stats").mapInArrow(run, schema)
