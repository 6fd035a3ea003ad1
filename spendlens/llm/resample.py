"""Importance resampling of documents towards a target set, over hashed word and word-pair features.

Every feature's bucket is the CRC-32 of its bytes modulo the number of buckets.  CRC-32 is a running state: the state after a
word, carried on over a blank and the next word, is that of the pair.  A head vocabulary fitted on the corpus is sent to all
tasks: the exact states of frequent words and the buckets of frequent pairs.  Whatever it lacks, the tail, is run through the
CRC byte by byte.  Both give the same numbers, so the head decides the cost of a feature, never its bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens.functions.skew import ordered_scan
from spendlens.llm.common import arrow_rows
from spendlens.session import staged

HEAD_WORDS, HEAD_PAIRS = 1 << 14, 1 << 16
PIECE = 1 << 22  # bytes worked on at once
SHORT = 32  # longer words go through zlib, one by one
START = np.uint32(0xFFFFFFFF)
U = np.uint64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t.astype(np.uint32)


def _letters() -> np.ndarray:
    """Bytes as they count in a word, A-Z lowered; 0 where a word ends."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    inside = np.zeros(256, bool)
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        inside[low:high] = True
    return np.where(inside, t, 0).astype(np.uint8)


CRC, LETTERS = _crc_table(), _letters()
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], U)


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


@dataclass
class Words:
    """The words of a piece of text: lowered bytes, where they stand, and which document holds them."""

    raw: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray

    def run(self, state: np.ndarray, at: np.ndarray) -> np.ndarray:
        """CRC states carried on over the words at the given places."""
        state = state.copy()
        start, length = self.start[at], self.length[at]
        live = np.flatnonzero(length <= SHORT)
        j = 0
        while len(live):
            state[live] = _step(state[live], self.raw[start[live] + j])
            j += 1
            live = live[length[live] > j]
        for i in np.flatnonzero(length > SHORT):
            word = self.raw[start[i]:start[i] + length[i]].tobytes()
            state[i] = np.uint32(zlib.crc32(word, int(state[i] ^ START))) ^ START
        return state

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first and second eight bytes of each word, and whether that is all of it."""
        padded = np.concatenate([self.raw, np.zeros(16, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(U), (len(padded) - 7,), (1,))
        first = eight[self.start] & MASKS[np.minimum(self.length, 8)]
        second = eight[np.minimum(self.start + 8, len(padded) - 8)] & MASKS[np.clip(self.length - 8, 0, 8)]
        return first, second, self.length <= 16


def pieces(texts: pa.Array) -> Iterator[Words]:
    """The words of all texts, a bounded number of bytes at a time; a piece repeats the last word of the one before it."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, stop = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    while at < stop:
        end = min(stop, at + PIECE)
        low = LETTERS[data[at:end]]
        if end < stop and low[-1]:
            gaps = np.flatnonzero(low == 0)
            while not len(gaps) and end < stop:  # one word longer than a piece
                end = min(stop, end + PIECE)
                low = LETTERS[data[at:end]]
                gaps = np.flatnonzero(low == 0)
            if end < stop:
                end = at + int(gaps[-1]) + 1
                low = low[:end - at]
        cut = np.zeros(len(low) + 1, bool)
        inner = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, end, "right")] - at
        cut[inner] = True
        inside = np.concatenate([[False], low > 0, [False]])
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        if len(starts):
            yield Words(low, starts, ends - starts, np.searchsorted(offsets, starts + at, "right") - 1)
        at = end


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * U(0x9E3779B97F4A7C15)) ^ (b * U(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _carried(batches: Iterator[pa.Array]) -> Iterator[tuple[Words, np.ndarray]]:
    """Pieces with the mark of each word that directly follows the word before it in the same document."""
    for texts in batches:
        for w in pieces(texts):
            yield w, np.concatenate([[False], w.doc[1:] == w.doc[:-1]])


class Head:
    """Frequent words with their CRC states, frequent pairs with their buckets."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, buckets: int):
        """words: rows of two keys; pairs: rows of the first word's two keys and the second's."""
        order = np.argsort(_mixed(words[:, 0], words[:, 1]), kind="stable")
        self.first, self.second = words[order, 0], words[order, 1]
        self.mixed = _mixed(self.first, self.second)
        spelled = [(int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")).rstrip(b"\0") for a, b in zip(self.first, self.second)]
        self.states = np.array([zlib.crc32(s) for s in spelled], np.uint32) ^ START
        left, right = self.find(pairs[:, 0], pairs[:, 1]), self.find(pairs[:, 2], pairs[:, 3])
        known = np.flatnonzero((left >= 0) & (right >= 0))
        left, right = left[known], right[known]
        codes = left * (1 << 32) + right
        order = np.argsort(codes, kind="stable")
        self.pairs = codes[order]
        self.pair_buckets = np.array([zlib.crc32(spelled[a] + b" " + spelled[b]) % buckets for a, b in zip(left[order], right[order])], np.uint32)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of words in the head, -1 for those outside."""
        if not len(self.mixed):
            return np.full(len(first), -1, np.int64)
        at = np.minimum(np.searchsorted(self.mixed, _mixed(first, second)), len(self.mixed) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)

    def find_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(left), -1, np.int64)
        codes = left * (1 << 32) + right
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == codes), at, -1)


def frequent(texts: DataFrame, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS, buckets: int = 10000) -> Head:
    """The head of all texts: at most ``head_words`` words of up to 16 bytes and ``head_pairs`` pairs of them.

    A piece of text reports what makes up at least one in ``head_words`` (``head_pairs``) of its words; a feature with that share
    of the whole corpus has it in some piece.  Of the sums the largest are taken.  No text gives an empty head.
    """
    schema = "a0 long, a1 long, b0 long, b1 long, n long"
    make = arrow_rows(schema)

    def count(batches):
        for w, follows in _carried(b.column(0) for b in batches):
            first, second, whole = w.keys()
            which, at, n = np.unique(_mixed(first[whole], second[whole]), return_index=True, return_counts=True)
            often = n >= max(2, len(w.start) // head_words)
            at, n = np.flatnonzero(whole)[at[often]], n[often]
            none = np.zeros(len(at), np.int64)
            yield make([first[at].view(np.int64), second[at].view(np.int64), none, none, n])
            both = np.flatnonzero(follows & whole & np.concatenate([[False], whole[:-1]]))
            if len(both):
                left, right = _mixed(first[both - 1], second[both - 1]), _mixed(first[both], second[both])
                which, at, n = np.unique(_mixed(left, right), return_index=True, return_counts=True)
                often = n >= max(2, len(w.start) // head_pairs)
                at, n = both[at[often]], n[often]
                yield make([c.view(np.int64) for c in (first[at - 1], second[at - 1], first[at], second[at])] + [n])

    counted = staged(texts.select("text").mapInArrow(count, schema).groupBy("a0", "a1", "b0", "b1").agg(F.sum("n").alias("n")), "frequent")
    order = [F.desc("n"), "a0", "a1", "b0", "b1"]

    def top(rows: DataFrame, n: int) -> np.ndarray:
        got = rows.orderBy(*order).limit(n).select("a0", "a1", "b0", "b1").toPandas()
        return got.to_numpy(np.int64).reshape(-1, 4).view(U)

    return Head(top(counted.where("b0 = 0"), head_words)[:, :2], top(counted.where("b0 <> 0"), head_pairs), buckets)


def _buckets(w: Words, follows: np.ndarray, head: Head, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, and of the pairs that end at the words marked in ``follows``."""
    first, second, whole = w.keys()
    known = np.where(whole, head.find(first, second), -1)
    states = np.empty(len(known), np.uint32)
    states[known >= 0] = head.states[known[known >= 0]]
    rare = np.flatnonzero(known < 0)
    states[rare] = w.run(np.full(len(rare), START), rare)
    ends = np.flatnonzero(follows)
    pair = head.find_pairs(known[ends - 1], known[ends])
    out = np.empty(len(ends), np.uint32)
    out[pair >= 0] = head.pair_buckets[pair[pair >= 0]]
    rare = np.flatnonzero(pair < 0)
    out[rare] = (w.run(_step(states[ends[rare] - 1], np.uint32(32)), ends[rare]) ^ START) % np.uint32(buckets)
    return (states ^ START) % np.uint32(buckets), out


def bucketed(docs: DataFrame, head: Head, buckets: int = 10000) -> DataFrame:
    """doc_id, n_features and the buckets of all features (packed 32-bit numbers) of every row (doc_id, text)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_features", T.LongType()), T.StructField("buckets", T.BinaryType())])
    types = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 512):
                rows = b.slice(s, 512)
                parts: list[list[np.ndarray]] = [[] for _ in range(rows.num_rows)]
                last: tuple | None = None
                for w in pieces(rows.column(1)):
                    follows = np.concatenate([[False], w.doc[1:] == w.doc[:-1]])
                    single, double = _buckets(w, follows, sent.value, buckets)
                    if last is not None and last[0] == w.doc[0]:  # the pair over the edge of two pieces
                        state = w.run(_step(last[1], np.uint32(32)), np.zeros(1, np.int64)) ^ START
                        parts[w.doc[0]].append(state % np.uint32(buckets))
                    end = np.array([len(w.start) - 1])
                    last = (w.doc[-1], w.run(np.array([START]), end))
                    for of, values in ((w.doc, single), (w.doc[follows], double)):
                        cut = np.flatnonzero(np.diff(of, prepend=-1))
                        for d, v in zip(of[cut], np.split(values, cut[1:])):
                            parts[d].append(v)
                packed = [np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]
                columns = [rows.column(0), pa.array([len(p) for p in packed], pa.int64()), pa.array([p.astype("<u4").tobytes() for p in packed], types.field(2).type)]
                yield pa.RecordBatch.from_arrays(columns, names=types.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def totals(rows: DataFrame, buckets: int = 10000) -> DataFrame:
    """bucket and n, the features in it, over all rows of bucketed(): one sum a bucket and task before the shuffle."""
    schema = "bucket int, n long"
    make = arrow_rows(schema)

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                if (raw := x.as_buffer()) is not None:
                    n += np.bincount(np.frombuffer(raw, "<u4"), minlength=buckets)
        at = np.flatnonzero(n)
        yield make([at.astype(np.int32), n[at]])

    return rows.select("buckets").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10000) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the source's) of every bucket; one number a bucket reaches the driver."""
    spark = source.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(
        source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select(
        "bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    rows = sorted(both.collect())
    all_s, all_t = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    s, t = np.array([r["s"] for r in rows]), np.array([r["t"] for r in rows])
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features and weight, the floored mean of the gains of a row's features (0 without any)."""
    schema = T.StructType([rows.schema["doc_id"], rows.schema["n_features"], T.StructField("weight", T.LongType())])
    sent = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for b in batches:
            sums = []
            for n, x in zip(b.column(1).to_pylist(), b.column(2)):
                sums.append(int(sent.value[np.frombuffer(x.as_buffer(), "<u4")].sum()) // n if n else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.int64())], names=["doc_id", "n_features", "weight"])

    return rows.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel draw) from a hash of the id; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, min_words: int = 20, buckets: int = 10000,
             head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text), drawn towards target (text).

    Of the N rows with at least ``min_words`` words, floor(percent * N / 100) of the highest scores are drawn, ties to the smaller
    doc_id, and ranked from 1; the others' rank is null.  Null and empty texts have no feature and weight 0.  A row without an id has
    no score, counts in the totals, not in N, and is not drawn.  Rows sharing an id share its draw of noise; each is a row of its own.  Empty tables
    give no rows; an empty target still draws, towards what is rare in docs.  Other columns are not read.

    Scores are integers, ranked in slices of ten; no slice or task holds a fixed share of the rows unless their scores are equal.
    """
    head = frequent(docs, head_words, head_pairs, buckets)
    rows = staged(bucketed(docs, head, buckets), "features")
    aim = bucketed(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), head, buckets)
    gain = gains(totals(rows, buckets), totals(aim, buckets), buckets)
    scored = weighed(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = staged(scored.withColumn("fit", F.col("score").isNotNull() & (F.col("n_features") >= 2 * min_words - 1)), "scored")
    n = scored.where("fit").count()
    down = scored.where("fit").withColumn("down", -F.col("score"))
    ranked = ordered_scan(down, [], ["down", "doc_id"], F.floor(F.col("down") / 10), row_number="place")
    place = F.when(F.col("place") <= percent * n // 100, F.col("place")).cast("long")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, place.alias("rank")).unionByName(scored.where("not fit").select(*columns, F.lit(None).cast("long").alias("rank")))
