"""Benchmark passages in documents, found through CGK embeddings and proved by edit distance.

A CGK embedding walks over a string and at every step writes the current symbol, then, by a random
bit of step and symbol, goes on or stays.  Strings at a small edit distance fall into step again, so their embeddings
differ in few places; agreement in a few sampled places makes a hash that near strings share.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import arrow_rows, every_character, once_per_process, with_columns
from spendlens.session import staged

STEPS = 40  # of a walk
SAMPLES = 18  # of its symbols; a hash takes the first of them, fewer for shorter items
DEPTHS = tuple(range(14, 2, -1))  # samples a hash may take
LENGTHS = (1, 5, 7, 10, 14, 20, 28, 40, 56, 80, 112, 160)  # items are told apart by length from one to the next
EVERY = 40  # items shorter than this are looked for at every character, longer ones at every word
TRIALS = 200  # copies from which the recall of a length is told
PAIRS = 1 << 16  # candidates proved at a time
CHECKS = (3, 5, 8, 11)  # sampled symbols after which windows without a partner are left out
FILTER_BITS = 22
TEXT_CHUNK = 1 << 18
BATCH_CHARS = 1 << 20
SPACE = 32


def _symbols() -> np.ndarray:
    """Every code point's symbol: its lower-case code for letters and digits, else white space."""
    c = every_character()
    low = np.char.lower(c).astype("<U2").view("<u4").reshape(-1, 2)
    alone = np.where(low[:, 1] == 0, low[:, 0], np.arange(0x110000))
    return np.where(np.char.isalnum(c), alone, SPACE).astype(np.int32)


def normal(text: str | None, symbols: np.ndarray) -> np.ndarray:
    """Lower-case letters and digits, one space for any run of other characters, none at the ends."""
    if not text:
        return np.zeros(0, np.int32)
    codes = symbols[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = codes != SPACE
    keep[1:] |= codes[:-1] != SPACE
    keep[0] = codes[0] != SPACE
    codes = codes[keep]
    return codes[:-1] if len(codes) and codes[-1] == SPACE else codes


def _starts(codes: np.ndarray) -> np.ndarray:
    """Places a window may begin at: words, and every character of a script without spaces."""
    lone = codes >= 0x2E80
    first = codes != SPACE
    first[1:] &= (codes[:-1] == SPACE) | lone[1:]
    return np.flatnonzero(first)


def walks(codes: np.ndarray, starts: np.ndarray, seed: int, depths, keep=None):
    """(samples, hashes, starts, last places read) of the windows at starts, after each number of samples in depths.

    Windows whose walk leaves codes are dropped.  keep(samples, hashes) may drop more on the way.
    """
    rng = np.random.default_rng(seed)
    sampled = np.zeros(STEPS, bool)
    sampled[rng.choice(STEPS, SAMPLES, replace=False)] = True
    go = rng.integers(0, 2, (STEPS, 256)).astype(np.int64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    at, starts = starts.astype(np.int64), starts
    value, seen, last = np.zeros(len(at), np.uint64), 0, max(depths, default=0)
    for t in range(STEPS):
        inside = at < len(codes)
        if not inside.all():
            at, value, starts = at[inside], value[inside], starts[inside]
        symbol = codes.take(at)
        if sampled[t]:
            value = (value ^ symbol.astype(np.uint64)) * mult
            seen += 1
            if keep is not None and seen in CHECKS:
                ok = keep(seen, value)
                at, value, starts, symbol = at[ok], value[ok], starts[ok], symbol[ok]
            if seen in depths:
                yield seen, value, starts, at
            if seen >= last:
                return
        at = at + go[t].take(symbol & 255)


def _slot(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _held(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which slots are marked in a filter; it stays packed, eight slots a byte."""
    return (bits.take(slot >> 3) >> (slot & 7).astype(np.uint8) & 1).view(bool)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in a row, a gap that no walk crosses after each, and the places where they begin."""
    gap = np.zeros(STEPS, np.int32)  # no text holds a 0
    codes = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
    return codes, np.cumsum([0] + [len(t) + STEPS for t in texts])[:len(texts)]


def _windows(codes: np.ndarray, every: bool) -> np.ndarray:
    starts = np.arange(len(codes)) if every else _starts(codes)
    return starts[codes[starts] != 0]


def _hashes(texts: list[np.ndarray], seed: int, depths, every: bool):
    """(samples, hashes, owners, offsets) of the windows that lie within their text."""
    codes, base = _joined(texts)
    ends = base + np.array([len(t) for t in texts], np.int64)
    for seen, value, starts, at in walks(codes, _windows(codes, every), seed, depths):
        owner = np.searchsorted(base, starts, "right") - 1
        own = at < ends[owner]
        yield seen, value[own], owner[own], (starts - base[owner])[own]


def _changed(text: list[int], edits: int, rng) -> list[int]:
    text = list(text)
    for kind, where, letter in zip(rng.integers(3, size=edits), rng.random(edits), rng.integers(97, 123, edits).tolist()):
        k = int(where * len(text))
        text[k:k + (kind != 1)] = [letter] if kind < 2 else []
    return text


@lru_cache(None)
def samples_for(length: int, allowed: float, recall: float, repeats: int) -> int:
    """How many samples the hash of an item of that length may take so that ``recall`` of its copies are found.

    Told by trial: made-up items with as many random edits as are allowed, embedded as documents are.  Longer hashes
    meet fewer strangers, so the longest that reaches the target is taken (the shortest if none does).
    """
    rng = np.random.default_rng(length)
    words = lambda n: [c for k in rng.integers(2, 10, n // 2 + 1) for c in [*rng.integers(97, 123, k).tolist(), SPACE]][:n]
    items = [[*words(length - 1), 97] for _ in range(TRIALS)]
    copies = [[*words(8), SPACE, *_changed(x, int(allowed * length), rng), SPACE, *words(STEPS)] for x in items]
    both = [[np.array(x, np.int32) for x in xs] for xs in (items, copies)]
    found = {d: np.zeros(TRIALS, bool) for d in DEPTHS}
    for r in range(repeats):
        tables = [{d: (v * np.uint64(TRIALS) + o.astype(np.uint64), o) for d, v, o, _ in _hashes(x, 100 + r, DEPTHS, length < EVERY)} for x in both]
        for d in DEPTHS:
            found[d][tables[1][d][1][np.isin(tables[1][d][0], tables[0][d][0])]] = True
    return next((d for d in DEPTHS if found[d].mean() >= recall), DEPTHS[-1])


class Index:
    """The windows of a block of items by their sampled hashes in every repetition, and the items' masks of symbols."""

    def __init__(self, items: list[tuple[int, np.ndarray]], allowed: float, recall: float, repeats: int, every: bool):
        self.items, self.allowed, self.repeats, self.every = items, allowed, repeats, every
        depth = np.array([samples_for(max(k for k in LENGTHS if k <= len(c)), allowed, recall, repeats) for _, c in items], np.int64)
        self.depths = sorted(set(depth.tolist()))
        self.tables, self.filters, keyed = [], [], np.zeros(len(items), bool)
        for r in range(repeats):
            filters, tables = np.zeros((len(CHECKS), 1 << FILTER_BITS), bool), {}
            for seen, value, owner, offset in _hashes([c for _, c in items], 100 + r, {*CHECKS, *self.depths}, every):
                if seen in CHECKS:
                    filters[CHECKS.index(seen), _slot(value[depth[owner] >= seen])] = True
                own = np.flatnonzero(depth[owner] == seen)
                own = own[np.argsort(value[own], kind="stable")]
                tables[seen] = value[own], owner[own], offset[own]
                keyed[owner[own]] = True
            self.tables.append(tables)
            self.filters.append(np.packbits(filters, axis=1, bitorder="little"))
        self.without = [x for x, k in zip(items, keyed) if not k]
        self.first = np.cumsum([0] + [-(-len(c) // 64) for _, c in items])
        self.sizes = np.array([len(c) for _, c in items], np.int64)
        self.masks = np.zeros((self.first[-1], 64), np.uint64)
        for k, (_, c) in enumerate(items):
            for p in range(self.first[k], self.first[k + 1]):
                part = self._part(c, k, p)
                np.bitwise_or.at(self.masks[p], part & 63, np.uint64(1) << np.arange(len(part), dtype=np.uint64))

    def _part(self, codes, k, p):
        n = self.first[k + 1] - self.first[k]
        return codes[len(codes) * (p - self.first[k]) // n:len(codes) * (p - self.first[k] + 1) // n]

    def candidates(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(item, likely start of its passage, window's start) of all windows that share a hash."""
        out = [np.zeros((0, 3), np.int64)]
        for r in range(self.repeats):
            keep = lambda seen, v, bits=self.filters[r]: _held(bits[CHECKS.index(seen)], _slot(v))
            for seen, value, at, _ in walks(codes, starts, 100 + r, self.depths, keep):
                keys, owner, offset = self.tables[r][seen]
                low, high = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
                n = high - low
                which = np.repeat(np.arange(len(n)), n)
                row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
                out.append(np.stack((owner[row], at[which] - offset[row], at[which]), 1))
        return np.unique(np.concatenate(out), axis=0)

    def possible(self, pairs: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Which pairs can hold their item: an item's parts of up to 64 symbols are matched apart, all pairs at once.

        A part of a passage begins at most as many places off as edits are allowed, the parts' least distances never
        add up to more than the item's own, and symbols that share a mask only lower them: nothing near enough is lost.
        """
        item = pairs[:, 0]
        room = (self.allowed * self.sizes[item]).astype(np.int64) + 1
        width = self.sizes[item] // (self.first[item + 1] - self.first[item]) + 1 + 3 * room
        ok, order = np.zeros(len(pairs), bool), np.argsort(width, kind="stable")
        for s in range(0, len(order), PAIRS):
            own = order[s:s + PAIRS]
            for cut in np.split(own, np.searchsorted(width[own], [64, 128, 256])):
                left, part = self.allowed * self.sizes[item[cut]], self.first[item[cut]]
                while len(cut):
                    parts, k, n = self.first[item[cut] + 1] - self.first[item[cut]], part - self.first[item[cut]], self.sizes[item[cut]]
                    low = pairs[cut, 1] + n * k // parts - room[cut] * 3 // 2
                    left = left - self._least(part, n * (k + 1) // parts - n * k // parts, low, int(width[cut].max()), codes)
                    part = part + 1
                    alive, done = left >= 0, part >= self.first[item[cut] + 1]
                    ok[cut[alive & done]] = True
                    go = alive & ~done
                    cut, left, part = cut[go], left[go], part[go]
        return ok

    def _least(self, part, size, low, width: int, codes) -> np.ndarray:
        """Least distance of each part to a passage of the width symbols from low, by bit-parallel columns."""
        top, one, masks, base = (size - 1).astype(np.uint64), np.uint64(1), self.masks.ravel(), part * 64
        plus, minus = np.full(len(part), ~np.uint64(0)), np.zeros(len(part), np.uint64)
        score, best = size.copy(), size.copy()
        for j in range(width):
            eq = masks.take(base + (codes.take(low + j, mode="clip") & 63))
            diag = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = minus | ~(diag | plus), plus & diag
            score += (up >> top & one).view(np.int64) - (down >> top & one).view(np.int64)
            np.minimum(best, score, out=best)
            up, down = up << one, down << one
            plus, minus = down | ~(diag | up), up & diag
        return best


def passage_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between item and any passage of text, and where that passage ends."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, n, 0
    for j, c in enumerate(text.tolist()):
        eq = masks.get(c, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diag | plus))
        down = plus & diag
        score += (up & top > 0) - (down & top > 0)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(diag | up)), up & diag
        if score < best:
            best, end = score, j + 1
    return best, end


def _nearest(codes: np.ndarray, pairs: list[tuple[int, int]], index: Index) -> dict[int, int]:
    """The least distance of each item with a passage near enough, from candidates (item, start) in order."""
    best: dict[int, int] = {}
    last, allowed = (-1, 0), index.allowed
    for k, start in pairs:
        item = index.items[k][1]
        room = int(allowed * len(item)) + 1
        if best.get(k, 1) == 0 or last[0] == k and start - last[1] <= room // 2:
            continue  # found verbatim, or the passage just looked at covers this start
        last = (k, start)
        low = max(0, start - 2 * room)
        d, _ = passage_distance(item, codes[low:max(low, start + len(item) + 2 * room)])
        if d <= allowed * len(item) and d < best.get(k, d + 1):
            best[k] = d
    return best


def hits(texts: list[np.ndarray], index: Index) -> list[dict[int, int]]:
    """For each normal text the items it holds, with their distances; texts are embedded together."""
    codes, base = _joined(texts)
    starts, found = _windows(codes, index.every), [np.zeros((0, 3), np.int64)]
    for s in range(0, len(starts), TEXT_CHUNK):
        found.append(index.candidates(codes, starts[s:s + TEXT_CHUNK]))
    pairs = np.concatenate(found)
    apart = (index.allowed * index.sizes[pairs[:, 0]]).astype(np.int64) // 2 + 1  # of passages looked at
    pairs = pairs[np.unique(np.stack((pairs[:, 0], pairs[:, 1] // apart, np.searchsorted(base, pairs[:, 2], "right"))), axis=1, return_index=True)[1]]
    pairs = pairs[index.possible(pairs, codes)]
    whose = np.searchsorted(base, pairs[:, 2], "right") - 1
    out: list[dict[int, int]] = [{} for _ in texts]
    for doc in np.unique(whose).tolist():
        own, first = pairs[whose == doc], int(base[doc])
        out[doc] = _nearest(texts[doc], sorted({(k, s - first) for k, s, _ in own.tolist()}), index)
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, repeats: int = 4, recall: float = 0.95,
                  block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, distance, item_chars: the nearest passage in each document of each item it holds.

    A passage counts when its edit distance to the item, both in lower case letters and digits with
    single spaces, is at most (1 - similarity) of the item's length.  Items are indexed at every word, those
    below 40 characters at every character, and hashed in ``repeats`` ways, by as many samples as their length allows
    for finding ``recall`` of the copies with the most edits allowed (``samples_for``).  A verbatim copy is always
    found.  Items too short for any edit or for a hash are looked up as they are, between spaces.  Null and empty
    texts and items give no row; repeated rows give their rows again.

    Items come in blocks of about ``block_chars`` characters, each searched in one pass over the documents:
    what a task is given is bounded however large the benchmark is.
    """
    schema = "doc_id long, item_id long, distance long, item_chars long"
    make = arrow_rows(schema)
    items, blocks = _items(benchmark, block_chars)
    texts, out = docs.select("doc_id", "text"), None
    for block in range(blocks):
        find = _finder(_block(items, blocks, block), round(1 - similarity, 9), repeats, recall)

        def run(batches, find=find):
            for b in batches:
                rows: list[list] = [[], [], [], []]
                for doc, held in zip(b.column(0).to_pylist(), find(b.column(1).to_pylist())):
                    for item, (d, chars) in held.items():
                        for c, v in zip(rows, (doc, item, d, chars)):
                            c.append(v)
                yield make(rows)

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def mark_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, **how) -> DataFrame:
    """docs with leaks, how many benchmark items each text holds; one pass per block of items, no join."""
    items, blocks = _items(benchmark, how.get("block_chars", 4_000_000))
    out = docs.drop("leaks").withColumn("leaks", F.lit(0).cast("bigint"))
    for block in range(blocks):
        find = _finder(_block(items, blocks, block), round(1 - similarity, 9), how.get("repeats", 4), how.get("recall", 0.95))
        counted = with_columns(out, "__more long", lambda texts, find=find: [[len(x) for x in find(texts)]])
        out = counted.withColumn("leaks", F.col("leaks") + F.col("__more")).drop("__more")
    return out


def _items(benchmark: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates()
    items = staged(items, "items")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, int(total // block_chars) + 1


def _block(items: DataFrame, blocks: int, block: int) -> list[tuple[int, str]]:
    own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
    return [(r["item_id"], r["text"]) for r in own.collect()]


def _finder(own: list[tuple[int, str]], allowed: float, repeats: int, recall: float):
    """A function from texts to their items, each with (distance, characters of the item)."""
    symbols = _symbols()
    items = [(i, c) for i, c in ((i, normal(t, symbols)) for i, t in own) if len(c)]
    plain = [x for x in items if int(allowed * len(x[1])) == 0]
    parts = [[x for x in items if int(allowed * len(x[1])) > 0 and (len(x[1]) < EVERY) == every] for every in (False, True)]
    indexes = [Index(x, allowed, recall, repeats, every) for x, every in zip(parts, (False, True)) if x]
    short = [(i, " " + "".join(map(chr, c)) + " ") for i, c in [*plain, *(x for index in indexes for x in index.without)]]

    def find(texts: list) -> list[dict[int, tuple[int, int]]]:
        table = once_per_process("symbols", _symbols)
        out: list[dict[int, tuple[int, int]]] = []
        held, size = [], 0

        def flush():
            best: list[dict[int, tuple[int, int]]] = [{} for _ in held]
            for index in indexes:
                for own, near in zip(best, hits(held, index)):
                    for k, d in near.items():
                        item, chars = index.items[k][0], len(index.items[k][1])
                        own[item] = min(own.get(item, (d, chars)), (d, chars))
            for own, codes in zip(best, held):
                whole = " " + "".join(map(chr, codes)) + " " if short else ""
                own |= {i: (0, len(w) - 2) for i, w in short if w in whole}
            out.extend(best)

        for text in texts:
            held.append(normal(text, table))
            size += len(held[-1])
            if size > BATCH_CHARS:
                flush()
                held, size = [], 0
        flush()
        return out

    return find
