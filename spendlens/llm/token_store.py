"""Token ids in files: an adaptive context-mixing range coder over independent blocks.

A file row is a segment: whole documents in order, their ids cut into equal blocks.  Every block
starts from fresh models, has a checksum of its own and decodes alone; all blocks of a segment are
coded in step, one id of each at a time, so that the adaptive models run on numpy vectors.

An id is first guessed from what followed the same two, or else the same one id before.  Whether the
guess holds is a binary event: adaptive probabilities keyed on the order-2 and order-1 confidence and the
recent success (order 0) are mixed in the logistic domain with weights learned along the way.  Otherwise
four adaptive order-0 digits follow.  All arithmetic is on integers.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm.common import arrow_rows, once_per_process
from spendlens.llm.tokens import Encoder

BLOCK = 2048  # ids of a block at most
SEGMENT = 1 << 22  # ids of a segment; a longer document is a segment of its own
ROWS = 256  # texts that are held with their ids at once
SLOTS2, SLOTS1 = 1 << 11, 1 << 10
U = np.uint64


def _tables():
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.rint(np.log(p / (1 - p)) * 256).astype(np.int32)
    squash = np.clip(np.rint(65536 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, 65504).astype(np.int32)
    step = np.arange(16)
    target = np.where(step[None, :] > step[:, None], 32768 - 16 + step, step).astype(np.int16)
    return stretch, squash, target


class Coder:
    """The arithmetic coder of all lanes and its input or output words of 16 bits."""

    def __init__(self, lanes: int, words: np.ndarray | None = None, starts: np.ndarray | None = None, room: int = 64):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
        self.words, self.starts = words, starts
        if words is None:
            self.out, self.at = np.zeros((lanes, room), np.uint16), np.zeros(lanes, np.int64)
        else:
            self.at, self.code = starts.astype(np.int64), np.zeros(lanes, U)
            for _ in range(4):
                self.code = self.code << U(16) | self.words[self.at]
                self.at += 1

    def narrow(self, lanes, low, size, bits: int):
        """Go on in the part [low, low + size) of 2**bits."""
        rng = self.range.take(lanes) >> U(bits)
        at = self.low.take(lanes) + low.astype(U) * rng
        rng *= size.astype(U)
        small = np.flatnonzero(rng < U(1 << 32))
        if len(small):
            lo, r, ids = at[small], rng[small], lanes[small]
            keep = np.arange(len(small))
            while len(keep):
                cut = keep[(lo[keep] ^ (lo[keep] + r[keep])) >= U(1 << 48)]
                r[cut] = (~lo[cut] + U(1)) & U((1 << 32) - 1)
                self._shift(ids[keep], lo[keep])
                lo[keep] <<= U(16)
                r[keep] <<= U(16)
                keep = keep[r[keep] < U(1 << 32)]
            at[small], rng[small] = lo, r
        self.low[lanes], self.range[lanes] = at, rng

    def _shift(self, lanes, low):
        if self.words is None:
            if self.at.max() + 1 >= self.out.shape[1]:
                self.out = np.concatenate((self.out, np.zeros_like(self.out)), 1)
            self.out[lanes, self.at[lanes]] = (low >> U(48)).astype(np.uint16)
        else:
            self.code[lanes] = self.code[lanes] << U(16) | self.words[self.at[lanes]]
        self.at[lanes] += 1

    def value(self, lanes, bits: int) -> np.ndarray:
        past, part = self.code.take(lanes) - self.low.take(lanes), self.range.take(lanes) >> U(bits)
        return np.minimum(past // part, U((1 << bits) - 1)).astype(np.int32)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(4):
            self._shift(np.arange(len(self.low)), self.low)
            self.low <<= U(16)
        n = self.at
        return self.out[np.arange(self.out.shape[1]) < n[:, None]], n


class Guess:
    """Is the guess right?  Three adaptive probabilities, mixed with learned weights."""

    KEYS = 64

    def __init__(self, lanes: int, tables):
        self.stretch, self.squash, _ = tables
        self.p = [np.full(lanes * self.KEYS, 1 << 15, np.int32) for _ in range(3)]
        self.w = [np.full(lanes, 24000, np.int32) for _ in range(3)]
        self.past, self.base = np.zeros(lanes, np.int32), np.arange(lanes) * self.KEYS

    def code(self, coder: Coder, k: np.ndarray, right, conf2, conf1):
        """For the lanes k = 0, 1, ...: encode right, or decode it where that is None."""
        n = len(k)
        at = [self.base[:n] + key for key in (conf2, conf1, self.past[:n])]
        old = [p.take(a) for p, a in zip(self.p, at)]
        st = [self.stretch.take(o >> 4) for o in old]
        w = [x[:n] for x in self.w]
        mix = (w[0] * st[0] + w[1] * st[1] + w[2] * st[2]) >> 16
        p = self.squash.take(mix + 2047, mode="clip")
        if right is None:
            right = coder.value(k, 16) < p
        yes = right.astype(np.int32)
        coder.narrow(k, p - p * yes, p * yes + (65536 - p) * (1 - yes), 16)
        error = (yes * 65535 - p) >> 4
        for j in range(3):
            np.clip(w[j] + ((st[j] * error) >> 10), -(1 << 19), 1 << 19, out=w[j])
            self.p[j][at[j]] = old[j] + ((yes * 65505 + 15 - old[j]) >> 4)
        self.past[:n] = (self.past[:n] << 1 | yes) & 63
        return right


class Digits:
    """Adaptive distributions of base-16 digits, ``rows`` for each lane."""

    def __init__(self, lanes: int, rows: int, target: np.ndarray):
        self.cdf = np.tile(np.arange(16, dtype=np.int16) * np.int16(2048), (lanes * rows, 1))
        self.packed = self.cdf.view("V32").ravel()
        self.rows, self.target = rows, target

    def code(self, coder: Coder, lanes, row, digit):
        """Encode digit, or decode it where that is None."""
        at = lanes * self.rows + row
        own = self.packed.take(at).view(np.int16).reshape(-1, 16)
        if digit is None:
            below = own <= coder.value(lanes, 15).astype(np.int16)[:, None]
            digit = np.bitwise_count(below.view(np.uint64)).sum(1, dtype=np.int32) - 1
        flat, k = own.ravel(), np.arange(0, 16 * len(lanes), 16) + digit
        low = flat.take(k).astype(np.int32)
        high = flat.take(k + 1, mode="clip").astype(np.int32)
        high[digit == 15] = 32768
        coder.narrow(lanes, low, high - low, 15)
        self.packed[at] = (own + ((self.target.take(digit, 0) - own) >> 5)).view("V32").ravel()
        return digit


def _run(coder: Coder, ids: np.ndarray | None, lanes: int, length: int, last: int) -> np.ndarray:
    """Code ids (length x lanes) or decode them; the last lane ends after ``last``."""
    tables = _tables()
    decode = ids is None
    if decode:
        ids = np.zeros((length, lanes), np.uint16)
    digits, guess = Digits(lanes, 1 + 16 + 256 + 256, tables[2]), Guess(lanes, tables)
    two, one = np.zeros(lanes * SLOTS2, np.int32), np.zeros(lanes * SLOTS1, np.int32)
    k = np.arange(lanes)
    a, b = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for t in range(length if lanes > 1 else last):
        if t == last and lanes > 1:
            k, a, b = k[:-1], a[:-1], b[:-1]
        h2 = k * SLOTS2 + (((a * 40503) ^ (b * 30011)) >> 3 & (SLOTS2 - 1))
        h1 = k * SLOTS1 + ((a * 40503) >> 5 & (SLOTS1 - 1))
        e2, e1 = two.take(h2), one.take(h1)
        g2, c2, g1, c1 = e2 >> 4, e2 & 15, e1 >> 4, e1 & 15
        same, short = g2 == g1, (c2 == 0) & (c1 > 0)
        guessed = np.where(short, g1, g2)
        real = None if decode else ids[t, :len(k)].astype(np.int32)
        hit = guess.code(coder, k, None if decode else real == guessed, c2 + 16 * same + 32 * short, c1 + 16 * same)
        rest = np.flatnonzero(~hit)
        value = guessed
        if len(rest):
            v, lone = None if decode else real.take(rest), rest
            d3 = digits.code(coder, lone, 0, None if decode else v >> 12)
            d2 = digits.code(coder, lone, 1 + d3, None if decode else v >> 8 & 15)
            d1 = digits.code(coder, lone, 17 + d3 * 16 + d2, None if decode else v >> 4 & 15)
            d0 = digits.code(coder, lone, 273 + ((d2 * 16 + d1) ^ (d3 * 37 & 255)), None if decode else v & 15)
            value[rest] = d3 << 12 | d2 << 8 | d1 << 4 | d0
        if decode:
            ids[t, :len(k)] = value
        two[h2] = value << 4 | np.where(value == g2, np.minimum(c2 + 1, 15), 0)
        one[h1] = value << 4 | np.where(value == g1, np.minimum(c1 + 1, 15), 0)
        a, b = value, a
    return ids


def encode_segment(ids: np.ndarray) -> bytes:
    """Magic, number of ids, block length, then size and checksum of every block, then the blocks."""
    n = len(ids)
    if n == 0:
        return b"IDS1" + np.array([0, 0], "<u4").tobytes()
    if int(ids.max()) >> 16:
        raise ValueError("ids of more than 16 bits")
    length = min(BLOCK, max(128, n // 1024), n)
    lanes = -(-n // length)
    padded = np.zeros((lanes, length), np.uint16)
    padded.ravel()[:n] = ids
    coder = Coder(lanes, room=length)
    _run(coder, np.ascontiguousarray(padded.T), lanes, length, n - (lanes - 1) * length)
    del padded
    words, sizes = coder.finish()
    parts = np.split(words.astype("<u2"), np.cumsum(sizes)[:-1])
    sums = np.array([zlib.crc32(p.tobytes()) for p in parts], "<u4")
    return b"IDS1" + np.array([n, length], "<u4").tobytes() + sizes.astype("<u4").tobytes() + sums.tobytes() + words.astype("<u2").tobytes()


def decode_segment(data: bytes, only: int | None = None) -> np.ndarray:
    """All ids of a segment, or those of one block; a broken block is an error."""
    if data[:4] != b"IDS1":
        raise ValueError("not a segment of ids")
    n, length = (int(x) for x in np.frombuffer(data, "<u4", 2, 4))
    if n == 0:
        return np.zeros(0, "<u4")
    lanes = -(-n // length)
    sizes, sums = np.frombuffer(data, "<u4", 2 * lanes, 12).reshape(2, lanes)
    words = np.frombuffer(data, "<u2", offset=12 + 8 * lanes)
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    picked = range(lanes) if only is None else [only]
    for i in picked:
        if zlib.crc32(words[starts[i]:ends[i]].tobytes()) != sums[i]:
            raise ValueError(f"block {i} is damaged")
    last = n - (lanes - 1) * length
    words = np.append(words, np.zeros(8, np.uint16)).astype(U)
    if only is None:
        got = _run(Coder(lanes, words, starts), None, lanes, length, last)
        return got.T.ravel()[:n].astype("<u4")
    size = last if only == lanes - 1 else length
    return _run(Coder(1, words, starts[[only]]), None, 1, size, size).ravel().astype("<u4")


def _encoder(vocabulary: str, end_id: int):
    """A function from texts to their packed ids, end_id last."""
    description = Path(vocabulary).read_text()
    if Encoder(description).dtype.itemsize != 2:
        raise ValueError("the file format holds vocabularies of up to 65,536 ids")

    def ids(texts) -> list[bytes]:
        encode = once_per_process(f"encoder {vocabulary}", lambda: Encoder(description))
        end = np.array([end_id], encode.dtype).tobytes()
        return [encode(t) + end for t in texts]

    return ids


def _ordered(docs: DataFrame) -> DataFrame:
    """Texts in ascending order of doc_id and text over ascending partitions, nulls first."""
    return docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")


def encode_texts(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id and packed ids of every whole text, end_id last; null texts count as empty.

    Rows are in ascending order of doc_id and text over ascending partitions, nulls first.  Texts are moved
    before they are encoded: finding the ranges reads the rows once more, and that must not encode them.
    """
    schema = "doc_id long, ids binary"
    make, ids = arrow_rows(schema), _encoder(vocabulary, end_id)

    def run(batches):
        for b in batches:
            yield make([b.column(0), ids(b.column(1).to_pylist())])

    return _ordered(docs).mapInArrow(run, schema)


def _write(rows: DataFrame, path: str, packed) -> None:
    """Segments of rows (doc_id, x) with packed(x of some rows) as ids, part by part."""
    schema = "part int, segment int, doc_ids array<long>, counts array<long>, n_ids long, payload binary"
    make = arrow_rows(schema)

    def run(batches):
        part, segment = TaskContext.get().partitionId(), 0
        docs, sizes, held = [], [], bytearray()

        def row():
            return make([[part], [segment], [docs], [sizes], [len(held) // 2], [encode_segment(np.frombuffer(held, "<u2"))]])

        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                some = b.slice(s, ROWS)
                for doc, own in zip(some.column(0).to_pylist(), packed(some.column(1).to_pylist())):
                    docs.append(doc)
                    sizes.append(len(own) // 2)
                    held += own
                    if len(held) // 2 >= SEGMENT:
                        yield row()
                        docs, sizes, held, segment = [], [], bytearray(), segment + 1
        if docs:
            yield row()

    rows.mapInArrow(run, schema).write.parquet(path)


def write_ids(ids: DataFrame, path: str) -> None:
    """Write packed ids (doc_id, ids as 16-bit words) in the order of ``encode_texts``.

    File parts cover ascending id ranges; a part holds segments, a segment whole documents.  Rows
    without an id come first, repeated ids stand in the order of their texts.
    """
    _write(ids, path, list)


def write_texts(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """``encode_texts`` and ``write_ids`` in one pass: a task keeps one worker, and ids never leave it but coded."""
    _write(_ordered(docs), path, _encoder(vocabulary, end_id))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids, decoded from the files."""
    files = spark.read.parquet(path)
    sizes = files.select("part", "segment", "n_ids")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all")).select("part", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "segment", (F.col("own") + F.col("base")).alias("base"))
    schema = "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    make = arrow_rows(schema)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                part, segment, docs, counts, _, payload = (c[k].as_py() for c in b.columns)
                ids, ends = decode_segment(payload), np.cumsum(counts)
                at = ends - counts
                sums = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(at, ends)]
                yield make([[part] * len(docs), [segment] * len(docs), docs, at, counts, sums])

    found = files.mapInArrow(run, schema)
    return found.join(starts, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
