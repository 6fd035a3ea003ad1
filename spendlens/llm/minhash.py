"""Near duplicates by min-hash signatures, verified sequentially by Bayes' rule and then exactly.

Texts whose signatures agree in some band are candidates.  Their signatures are compared a batch of hashes at a time: m agreements
out of n make the similarity a Beta(m + 1, n - m + 1) variable under a flat prior, and a pair is dropped as soon as it reaches the
threshold with less than the chosen probability of a miss.  Pairs that survive all batches are verified on their full sets.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.similar_sets import RUNS, Groups, linked_rows, mix, seeds

BANDS, BAND_ROWS = 40, 4  # a pair at 0.8 shares no band seven times in 10^10
HASHES = BANDS * BAND_ROWS
BATCH = 32
MISS = 1e-9
U = np.uint64
SALTS, FACTORS = (seeds(start, HASHES).astype(np.uint32) | np.uint32(1) for start in (5000, 6000))


def signature(tokens: np.ndarray) -> np.ndarray:
    """Per hash the least value over a set; two sets agree in one as often as they overlap."""
    low = (tokens >> U(17)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for start in range(0, len(low), 512):
        out = np.minimum(out, ((low[start:start + 512, None] ^ SALTS) * FACTORS).min(0))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key per band of each signature."""
    rows = signatures.reshape(-1, BANDS, BAND_ROWS).astype(U)
    return mix((mix(rows) * RUNS[:BAND_ROWS]).sum(2, dtype=U) + np.arange(BANDS, dtype=U))


def least_matches(percent: int, miss: float = MISS) -> dict[int, int]:
    """After n hashes the least agreements that still give the threshold a posterior probability of ``miss`` / batches or more.

    The tail of Beta(m + 1, n - m + 1) above t is the chance of at most m successes in n + 1 draws of t.
    """
    t, out = percent / 100, {}
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            log_choose = math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
            below += math.exp(log_choose + m * math.log(t) + (n + 1 - m) * math.log1p(-t)) if t < 1 else float(m == n + 1)
            if below >= miss * BATCH / HASHES:
                break
            m += 1
        out[n] = min(m, n)
    return out


def bayes_links(sets: list[np.ndarray], extras: list[bytes], group: np.ndarray, odd: np.ndarray, percent: int = 80,
                least: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that link sets of different groups, enough of them to connect all that are linked.

    Only pairs with an odd member that share a band are looked at.
    """
    least = least or least_matches(percent)
    signs = np.frombuffer(b"".join(extras), np.uint32).reshape(-1, HASHES)
    keys, sizes = band_keys(signs), np.array([len(s) for s in sets], np.int64)
    named = np.unique(group, return_inverse=True)[1]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    agreed: list[np.ndarray] = []
    for start in range(0, len(sets), 128):
        block = slice(start, start + 128)
        near = np.zeros((len(keys[block]), len(sets)), bool)
        for band in range(BANDS):
            near |= keys[block, band, None] == keys[None, :, band]
        a, b = np.nonzero(near)
        a += start
        ok = (a < b) & (named[a] != named[b]) & (odd[a] | odd[b])
        ok &= 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
        a, b = a[ok], b[ok]
        matches = np.zeros(len(a), np.int64)
        for n, enough in least.items():
            batch = slice(n - BATCH, n)
            for s in range(0, len(a), 1 << 15):
                p = slice(s, s + (1 << 15))
                matches[p] += (signs[a[p], batch] == signs[b[p], batch]).sum(1)
            ok = matches >= enough
            a, b, matches = a[ok], b[ok], matches[ok]
        left.append(a)
        right.append(b)
        agreed.append(matches)
    a, b = np.concatenate(left), np.concatenate(right)
    found, known = [], Groups(len(sets))
    known.of = named.copy()
    for i in np.argsort(-np.concatenate(agreed), kind="stable"):  # the surest first: most later pairs are connected by then
        p, q = int(a[i]), int(b[i])
        if known.of[p] == known.of[q]:
            continue
        both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
            known.join(p, q)
            found.append((p, q))
    return found


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 4, miss: float = MISS, **spread) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Texts link when 100 * overlap >= percent * union of their sets of ``width``-word shingles; a link is missed with a probability
    of about 10^-9 for its bands and of ``miss`` for its verification.  component_id is the least doc_id reachable, kept marks rows that have it.
    Texts without words, null ones too, have no shingle and no link and are kept.  Rows sharing an id are separate texts.  Rows without
    an id link like others and are not kept, unless no reachable row has an id: then component_id is null and they are.  See linked_rows for ``spread``.
    """
    find = partial(bayes_links, percent=percent, least=least_matches(percent, miss))
    rows = linked_rows(docs, width, lambda tokens: band_keys(signature(tokens))[0].view(np.int64), find, lambda tokens: signature(tokens).tobytes(), **spread)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
