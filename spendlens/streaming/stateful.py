"""Keyed state: alert cooldown and change detection over streams.

Rows wait until the watermark has passed their slice of event time, so file order does not matter.  Those of a key with
less than a piece lie in the key's one value state; more lie in pieces of bounded size, each sorted, in a map state.  The value
state names the pieces and the one timer that the key has, at the end of its earliest slice.  When it goes off, the pieces that have begun are merged up to the watermark, one open where their
times do not overlap.  The state is so touched by the piece, not by the row, and memory holds a block of input or the
overlapping pieces of one key.  The value state also holds the last fired time or checksum, as each call to a state is a round trip.
The state lives in the state store that keyed timers need (``STORE``); ``windows.run_append`` asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import count, islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spendlens.functions.expr import epoch_us
from spendlens.operators.quality import checksum

c = F.col
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICE_MS = 1000
PIECE_ROWS = 1024
BLOCK_ROWS = 1 << 16


def _order(row: tuple) -> tuple:
    """By time and event id, a missing id last."""
    return row[0], row[1] is None, row[1]


class InOrder(StatefulProcessor):
    """Feeds a key's rows to ``decide(last, row) -> (last, wanted)`` in the order of (us, event_id).

    ``row`` names and types what decide sees, us and event_id first; ``out`` are its columns that wanted rows
    give, as one array each.  Rows of a slice are released once the watermark has passed its end; rows
    that come after the watermark are dropped by the stream itself.
    """

    def __init__(self, row: str, last: str, decide: Callable, keys: list[str], out: list[str], slice_ms: int = SLICE_MS,
                 piece_rows: int = PIECE_ROWS, block_rows: int = BLOCK_ROWS):
        self.row, self.last_type, self.decide, self.keys, self.out, self.slice_ms = row, last, decide, keys, out, slice_ms
        self.piece_rows, self.block_rows = piece_rows, block_rows
        self.names = [part.split(":")[0].strip() for part in row.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState(
            "kept", f"pieces array<struct<name: long, low: long, n: long>>, named long, timer long, few array<struct<{self.row}>>, last {self.last_type}")
        self.waiting = handle.getMapState("waiting", "name long", f"rows array<struct<{self.row}>>")

    def _until(self, us: int) -> int:
        """The end of a time's slice."""
        return (us // 1000 // self.slice_ms + 1) * self.slice_ms

    def _read(self, name: int) -> list[tuple]:
        return [tuple(r) for r in self.waiting.getValue((name,))[0]]

    def _held(self) -> tuple[list[tuple], int, int | None, list[tuple], object]:
        """The pieces (name, least us, rows), the next free name, the timer of the key, its rows outside of pieces in order, and what decide gave last."""
        held = self.kept.get()
        return ([], 0, None, [], None) if held is None else ([tuple(p) for p in held[0]], held[1], held[2], [tuple(r) for r in held[3]], held[4])

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        pieces, named, timer, few, last = self._held()
        rows = iter(rows)
        while block := [tuple(row[n] for n in self.names) for row in islice(rows, self.block_rows)]:
            block += few
            few = []
            if not pieces and len(block) < self.piece_rows:
                few = sorted(block, key=_order)
                continue
            # pieces less than half full are filled up
            for small in [p for p in pieces if 2 * p[2] < self.piece_rows]:
                block += self._read(small[0])
                self.waiting.removeKey((small[0],))
                pieces.remove(small)
            block.sort(key=_order)
            for s in range(0, len(block), self.piece_rows):
                part = block[s:s + self.piece_rows]
                self.waiting.updateValue((named,), (part,))
                pieces.append((named, part[0][0], len(part)))
                named += 1
        if pieces or few:
            first = self._until(min([p[1] for p in pieces] + [r[0] for r in few[:1]]))
            if timer is None or first < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
                timer = first
            self.kept.update((pieces, named, timer, few, last))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        pieces, named, _, few, last = self._held()
        # rows before this time are in slices that the watermark has passed
        passed = timerValues.getCurrentWatermarkInMs() // self.slice_ms * self.slice_ms * 1000
        stay = [p for p in pieces if p[1] >= passed]
        at = [self.names.index(n) for n in self.out]
        found, number = [], count()
        heap = [(*_order(row), next(number), row) for row in few if row[0] < passed]  # in order, so a heap
        few = few[len(heap):]
        for name, low, _ in [*sorted((p for p in pieces if p[1] < passed), key=lambda p: p[1]), (None, passed, 0)]:
            # all rows before the next piece's first are in the heap
            while heap and heap[0][0] < low:
                row = heappop(heap)[-1]
                last, wanted = self.decide(last, row)
                if wanted:
                    found.append(row)
            if len(found) >= self.piece_rows or name is None and found:
                yield Row(**dict(zip(self.keys, key)), **{n: [r[i] for r in found] for n, i in zip(self.out, at)})
                found = []
            if name is not None:
                rest = []
                for row in self._read(name):
                    if row[0] < passed:
                        heappush(heap, (*_order(row), next(number), row))
                    else:
                        rest.append(row)
                if rest:
                    self.waiting.updateValue((name,), (rest,))
                    stay.append((name, rest[0][0], len(rest)))
                else:
                    self.waiting.removeKey((name,))
        timer = None
        if stay or few:
            timer = self._until(min([p[1] for p in stay] + [r[0] for r in few[:1]]))
            self.handle.registerTimer(timer)
        self.kept.update((stay, named, timer, few, last))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: list[str], row: str, last: str, decide: Callable, out: list[str]) -> DataFrame:
    """The stream's rows (keys, us, event_id, ...; watermarked) through ``InOrder``, key by key; keys and ``out`` of those wanted."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} array<{kinds[n]}>" for n in out])
    found = rows.groupBy(*keys).transformWithState(InOrder(row, last, decide, keys, out), schema, "Append", "EventTime")
    return found.select(*keys, F.inline(F.arrays_zip(*out)))


def _fires(fired: int | None, row: tuple) -> tuple[int | None, bool]:
    us, _, cool = row
    return (us, True) if fired is None or us - fired >= cool * 60_000_000 else (fired, False)


def _changes(seen: str | None, row: tuple) -> tuple[str, bool]:
    return row[2], row[2] != seen


def alert_stream(triggers: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Cooldown over a stream of triggers (ts, event_id, cooldown_minutes and the keys).

    The default scope for scale is one cooldown per rule and entity: a rule alone would be one
    state key, and one task, for all of its triggers.
    """
    rows = triggers.where(c("ts").isNotNull()).withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select(*keys, "ts", epoch_us("ts").alias("us"), "event_id", c("cooldown_minutes").cast("long").alias("cool"))
    return in_order(rows, keys, f"us: long, event_id: {rows.schema['event_id'].dataType.simpleString()}, cool: long", "long", _fires, ["event_id"])


def changes_stream(records: DataFrame, key: str, payload: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose checksum differs from the last one seen for the id."""
    rows = records.where(c("ts").isNotNull()).withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select(key, "ts", epoch_us("ts").alias("us"), "event_id", checksum(payload).alias("checksum"))
    return in_order(rows, [key], f"us: long, event_id: {rows.schema['event_id'].dataType.simpleString()}, checksum: string", "string", _changes, ["event_id", "checksum"])
