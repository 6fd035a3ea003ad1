"""Packing token sequences into windows of equal size by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.skew import ordered_scan
from spendlens.llm.common import arrow_rows, once_per_process
from spendlens.llm.tokens import Encoder
from spendlens.session import staged


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """The ids of every whole text and end_id, cut into full windows and one rest.

    Null texts count as empty: the end id alone.  ``with_ids`` adds the ids of the piece, packed.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    make, description = arrow_rows(schema), Path(vocabulary).read_text()

    def run(batches):
        encode = once_per_process(f"encoder {vocabulary}", lambda: Encoder(description))
        for b in batches:
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(np.frombuffer(encode(text), encode.dtype).astype("<u4"), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start:start + capacity].tobytes()
                    row = [doc, start, len(part) // 4, zlib.crc32(part), len(ids), part]
                    for c, v in zip(rows, row):
                        c.append(v)
            yield make(rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fill_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows as (length -> how many, repeated how often) until all counted rests are placed.

    Each window holds the longest rest left.  A bitset of reachable sums, one layer per length, picks
    the others: the full capacity if it can be reached, else a power of two (which needs no padding), else
    the largest sum.  Going back through the layers tells how many of each length.  A window is
    repeated as long as the counts allow, so each round uses up a length and the work depends on
    the capacity alone, never on the number of documents.
    """
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    everything = (1 << (capacity + 1)) - 1
    powers = [1 << k for k in range(capacity.bit_length() - 1, -1, -1)]
    while left:
        order = sorted(left, reverse=True)
        top, reach, layers = order[0], 1 << order[0], []
        for length in order:
            layers.append(reach)
            room = min(left[length] - (length == top), (capacity - top) // length)
            step = 1
            while room > 0:
                step = min(step, room)
                reach |= reach << (step * length) & everything
                room -= step
                step *= 2
            if reach >> capacity & 1:
                break
        total = next((p for p in powers if reach >> p & 1), reach.bit_length() - 1) if not reach >> capacity & 1 else capacity
        window = Counter({top: 1})
        for length, before in zip(reversed(order[:len(layers)]), reversed(layers)):
            while not before >> total & 1:
                total -= length
                window[length] += 1
        times = min(left[k] // n for k, n in window.items())
        out.append((dict(window), times))
        for k, n in window.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def placement(windows: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first window, pieces of that length a window, offset), sorted by length and rank."""
    rows, used, window_id = [], Counter(), 0
    for window, times in windows:
        offset = 0
        for length in sorted(window, reverse=True):
            rows.append((length, used[length], window_id, window[length], offset))
            used[length] += window[length] * times
            offset += length * window[length]
        window_id += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset there.

    Only the counts per length, ``capacity`` rows at most, come to the driver; pieces of one length
    are numbered in hashed buckets, so that a length many documents share is no single task's work.
    Repeated rows are packed as often as they occur.  An empty table gives no piece.
    """
    pieces = staged(cut_pieces(docs, vocabulary, end_id, capacity, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = placement(fill_windows(counts, capacity))
    bits = max(1, int(np.log2(max(counts.values(), default=1))) // 2)
    hashed = pieces.withColumn("__h", F.xxhash64("doc_id", "start"))
    ranked = ordered_scan(hashed, ["length"], ["__h", "doc_id", "start"], F.shiftright("__h", 64 - bits), row_number="rank")
    ranked = ranked.select(*pieces.columns, "rank")
    schema = f"{', '.join(f'{n} {t}' for n, t in pieces.dtypes)}, sequence_id long, offset long"
    at, make = ranked.columns.index("length"), arrow_rows(schema)
    keys = plan[:, 0] * (1 << 48) + plan[:, 1]

    def place(batches):
        for b in batches:
            length, rank = np.asarray(b.column(at)), np.asarray(b.column(b.num_columns - 1)) - 1
            row = plan[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            past, many = rank - row[:, 1], row[:, 3]
            yield make([*b.columns[:-1], row[:, 2] + past // many, row[:, 4] + past % many * length])

    return ranked.mapInArrow(place, schema)
