"""Near duplicates by the Jaccard similarity of word shingles, joined through signature trees.

A tree's leaves are documents' token bitmaps; a node holds the OR of its children's bitmaps and the range of their
set sizes.  Two trees, or a tree and itself, are walked together: a pair of nodes is left out when no pair
of sets under it can overlap enough.  What is left is compared exactly.

Trees are built where similar documents can meet: sets share a block when some band of min-hashes is equal.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.similar_sets import RUNS, Groups, linked_rows, mix, seeds, shingles  # noqa: F401

BANDS, BAND_ROWS = 32, 3  # a pair at 0.8 shares no band once in 10^10
FANOUT = 8
U = np.uint64
SALTS = seeds(2000, BANDS * BAND_ROWS)


def _bands(tokens: np.ndarray) -> np.ndarray:
    """One key per band, of BAND_ROWS min-hashes each; they agree as often as the sets overlap."""
    least = np.full(len(SALTS), 2**64 - 1, U)
    for start in range(0, len(tokens), 2048):
        part = tokens[start:start + 2048]
        least = np.minimum(least, ((part[None, :] ^ (SALTS[:, None] >> U(7))) * SALTS[:, None]).min(1))
    rows = mix(least).reshape(BANDS, BAND_ROWS)
    return mix((rows * RUNS[:BAND_ROWS]).sum(1, dtype=U) + np.arange(BANDS, dtype=U)).view(np.int64)


def _levels(bits: np.ndarray, sizes: np.ndarray, odd: np.ndarray) -> list[tuple]:
    """From documents upwards: bitmaps, least and greatest size, most tokens that share a bit, any odd one."""
    extra = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
    out = [(bits, sizes, sizes, extra, odd)]
    while len(out[-1][0]) > FANOUT:
        b, low, high, more, any_odd = out[-1]
        cut = np.arange(0, len(b), FANOUT)
        out.append((np.bitwise_or.reduceat(b, cut, 0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut),
                    np.maximum.reduceat(more, cut), np.logical_or.reduceat(any_odd, cut)))
    return out


def tree_links(sets: list[np.ndarray], extras: list, group: np.ndarray, odd: np.ndarray, percent: int = 80) -> list[tuple[int, int]]:
    """Pairs of positions that link sets of different groups, enough of them to connect all that are linked.

    Only pairs with an odd member are looked at.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    step = np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.25))
    order = np.lexsort((np.array([s[0] for s in sets], U), step))
    width = 1 << int(np.clip(np.ceil(np.log2(8 * max(1, sizes.max()))), 8, 15))
    bits = np.zeros((len(sets), width // 64), U)
    for row, i in enumerate(order):
        at = (sets[i] & U(width - 1)).astype(np.int64)
        np.bitwise_or.at(bits[row], at >> 6, U(1) << (at & 63).astype(U))
    levels = _levels(bits, sizes[order], odd[order])
    top = len(levels[-1][0])
    a, b = np.triu_indices(top)
    for depth in range(len(levels) - 1, -1, -1):
        bit, low, high, more, any_odd = levels[depth]
        keep = []
        for s in range(0, len(a), 4096):
            x, y = a[s:s + 4096], b[s:s + 4096]
            need = percent * np.maximum(low[x], low[y])
            near = (100 * np.minimum(high[x], high[y]) >= need) & (any_odd[x] | any_odd[y])
            k = np.flatnonzero(near)
            common = np.bitwise_count(bit[x[k]] & bit[y[k]]).sum(1, dtype=np.int64) + np.minimum(more[x[k]], more[y[k]])
            keep.append(s + k[100 * common >= need[k]])
        keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        a, b = a[keep], b[keep]
        if depth:
            n = len(levels[depth - 1][0])
            i, j = np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij")
            same = a == b
            a, b = (a[:, None] * FANOUT + i.ravel()).ravel(), (b[:, None] * FANOUT + j.ravel()).ravel()
            ok = (a < n) & (b < n) & (~np.repeat(same, FANOUT * FANOUT) | (a <= b))
            a, b = a[ok], b[ok]
    a, b = a[a != b], b[a != b]
    found, known = [], Groups(len(sets))
    known.of = np.unique(group[order], return_inverse=True)[1]
    for s in range(0, len(a), 1024):
        x, y = a[s:s + 1024], b[s:s + 1024]
        for p, q in zip(x, y):
            if known.of[p] == known.of[q]:
                continue
            one, two = sets[order[p]], sets[order[q]]
            both = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * both >= percent * (len(one) + len(two) - both):
                known.join(p, q)
                found.append((int(order[p]), int(order[q])))
    return found


def linked_documents(docs: DataFrame, percent: int = 80, width: int = 5, **spread) -> DataFrame:
    """linked_rows() by signature trees."""
    return linked_rows(docs, width, _bands, partial(tree_links, percent=percent), **spread)


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, **spread) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Texts link when 100 * overlap >= percent * union of their shingle sets; component_id is the least doc_id
    reachable.  Texts without words, null ones too, have no shingle and no link.  Rows sharing an id are separate texts, rows
    without an id link like others; where no reachable row has an id, component_id is null.  See linked_rows for ``spread``.
    """
    return linked_documents(docs, percent, width, **spread).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
