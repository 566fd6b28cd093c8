"""Consensus and alerts on a stream, poll tick by poll tick.

Both operators keep what has arrived in state until the watermark has passed its tick, and
take ticks in order then, so the result does not depend on how the input is cut into
micro-batches; a timer at the next tick makes silence count as well. State is keyed by asset
and lives in RocksDB, so it is not bounded by a task's memory; input comes in Arrow batches.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pricelake.functions.decimals import WIDEST, middle, rescaled
from pricelake.operators.alerts import DEVIATION_TEXT, DISAGREEMENT_TEXT, SOURCE_DOWN_TEXT, STALE_TEXT
from pricelake.operators.breaker import DEVIATION_LIMIT_PCT, RECOVERY_SUCCESSES
from pricelake.schemas import POLL_SECONDS, STALENESS_SECONDS

LATENESS_SECONDS = 120
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME_ROWS = 10_000
BLOCK_TICKS = 64
PART_ROWS = 100_000  # input is dealt to blocks in stretches of about so many rows

CONSENSUS = ("asset string, tick bigint, tick_time timestamp, price string, decimals int, sources array<string>, "
             "timestamp bigint, confidence double, level string, stale boolean, lowest double, highest double, "
             "polled array<string>")
ALERTS = ("asset string, tick bigint, kind string, type string, message string, previous_price string, "
          "current_price string, deviation_percent double, affected_sources array<string>")


def with_state_store(df: DataFrame) -> DataFrame:
    """These operators need the RocksDB state store; a restarted query takes its checkpoint's."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


def level_of(used: int, total: int, stale: bool) -> str:
    ratio = used / max(total, 1)
    if stale or not used or ratio < 0.5:
        return "critical"
    return "degraded" if ratio < 1.0 else "healthy"


def _ticks_to(clock: int, watermark_ms: int, poll: int) -> range:
    """Ticks from `clock` on that the watermark has passed."""
    return range(clock, max(clock, watermark_ms // (poll * 1000) + 1))


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == FRAME_ROWS:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(),
          "array<string>": pa.list_(pa.string())}


def _stretches(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Frames put together to at least `rows` rows."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _values(column: pa.ChunkedArray) -> list:
    """As `to_pylist`, faster for plain values."""
    plain = not column.null_count and not pa.types.is_list(column.type)
    return column.to_numpy().tolist() if plain else column.to_pylist()


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


class _Ticked(StatefulProcessor):
    """What waits for its tick, by blocks of ticks, and the next tick to take.

    A block is a list of parts, each the Arrow bytes of the rows that one stretch of input had for it. Parts
    are only added until the block is taken, so the work grows with the rows, in whatever order they come.
    """

    fields: str  # of a waiting row, the tick first
    output: str
    poll: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = [part.split(None, 1) for part in self.fields.split(", ")]
        self.schema = pa.schema([(name, _ARROW[kind]) for name, kind in kinds])
        self.parts = handle.getMapState("parts", "block long", "n long")
        self.waiting = handle.getMapState("waiting", "block long, part long", "rows binary")
        self.clock = handle.getValueState("clock", "tick long")

    def _due_at(self, tick: int) -> int:
        # A timer is due when the watermark is beyond it.
        return tick * self.poll * 1000 - 1

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for frame in _stretches(rows, PART_ROWS):
            frame = frame[frame["tick"].notna()]
            if not len(frame):
                continue
            tick = frame["tick"].to_numpy().astype(np.int64)
            order = np.argsort(tick, kind="stable")
            block = tick[order] // BLOCK_TICKS
            table = pa.table({
                f.name: pa.array(frame[f.name].iloc[order], f.type, from_pandas=True) for f in self.schema}, self.schema)
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:]):
                self._add(int(block[a]), table.slice(a, b - a))
            low = int(tick.min())
            first = low if first is None else min(first, low)
        if first is not None:
            clock = self.clock.get()
            if clock is None or first < clock[0]:
                if clock is not None:
                    self.handle.deleteTimer(self._due_at(clock[0]))
                self.clock.update((first,))
                self.handle.registerTimer(self._due_at(first))
        return iter(())

    def _add(self, block: int, rows: pa.Table) -> None:
        n = (self.parts.getValue((block,)) or (0,))[0]
        self.waiting.updateValue((block, n), (_packed(rows),))
        self.parts.updateValue((block,), (n + 1,))

    def _leave(self, block: int) -> pa.Table | None:
        """The rows of a block by tick, out of the state."""
        held = self.parts.getValue((block,))
        if held is None:
            return None
        found = []
        for n in range(held[0]):
            found.append(pa.ipc.open_stream(bytes(self.waiting.getValue((block, n))[0])).read_all())
            self.waiting.removeKey((block, n))
        self.parts.removeKey((block,))
        table = pa.concat_tables(found)
        order = np.argsort(table.column("tick").to_numpy(), kind="stable")
        return table.take(pa.array(order)).combine_chunks()

    def _taken(self, ticks: range) -> Iterator[tuple[int, list[tuple]]]:
        """Every tick with its rows, which leave the state."""
        for block in range(ticks.start // BLOCK_TICKS, (ticks.stop - 1) // BLOCK_TICKS + 1 if ticks else 0):
            span = range(max(ticks.start, block * BLOCK_TICKS), min(ticks.stop, (block + 1) * BLOCK_TICKS))
            table = self._leave(block)
            at = [0] * (len(span) + 1)
            if table is not None:
                # What is left of an earlier tick is not taken again.
                at = np.searchsorted(table.column("tick").to_numpy(), [*span, span.stop]).tolist()
                if at[-1] < len(table):
                    self._add(block, table.slice(at[-1]))
            for tick, a, b in zip(span, at, at[1:]):
                part = table.slice(a, b - a) if a < b else None
                yield tick, list(zip(*map(_values, part.columns[1:]))) if part else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        clock = self.clock.get()[0]
        due = _ticks_to(clock, timerValues.getCurrentWatermarkInMs(), self.poll)
        yield from _frames(self.rows_of(key[0], due), _names(self.output))
        self.clock.update((due.stop,))
        self.handle.registerTimer(self._due_at(due.stop))

    def close(self) -> None:
        pass


class TickConsensus(_Ticked):
    """State per source: its newest reading, its last price in arrival order, and readings since it last strayed."""

    fields = "tick long, seq long, source string, price string, decimals int, timestamp long"
    output = CONSENSUS

    def __init__(self, staleness: int, poll: int, limit_pct: float | None, recovery: int, scale: int):
        self.staleness, self.poll, self.scale = staleness, poll, scale
        self.limit_pct, self.recovery = limit_pct, recovery

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getMapState(
            "known", "source string", "price string, decimals int, timestamp long, seq long, suspicious boolean, "
            "arrived string, good long")

    def rows_of(self, asset: str, ticks: range):
        known = {k[0]: list(v) for k, v in self.known.iterator()}
        for entry in known.values():
            entry[5] = None if entry[5] is None else int(entry[5])
        current = sorted(v[5] for v in known.values() if v[5] is not None)
        changed: set[str] = set()
        for tick, rows in self._taken(ticks):
            polled: dict[str, tuple] = {}
            for seq, source, price, decimals, timestamp in sorted(rows):
                suspicious, arrived, good = self._judge(known.get(source), current, int(price), decimals)
                at = (timestamp, seq)
                entry = known.get(source)
                if entry is None or at > (entry[2], entry[3]):
                    known[source] = [price, decimals, timestamp, seq, suspicious, arrived, good]
                else:
                    entry[5:] = [arrived, good]
                changed.add(source)
                if source not in polled or at > polled[source][:2]:
                    polled[source] = (*at, float(int(price)) / 10.0**decimals)
            yield self._decide(asset, tick, known, polled)
        for source in changed:
            entry = known[source]
            self.known.updateValue((source,), (*entry[:5], None if entry[5] is None else str(entry[5]), entry[6]))

    def _judge(self, entry, current: list[int], price: int, decimals: int):
        """(suspicious, last arrival, good readings since the last stray) after one more reading."""
        if self.limit_pct is None:
            return False, None, None
        value = rescaled(price, decimals, self.scale)
        if entry is not None and entry[5] is not None:
            # A price that fits no decimal leaves the one before it standing.
            if value is not None:
                del current[bisect_left(current, entry[5])]
        if value is not None:
            insort(current, value)
        good = None if entry is None else entry[6]
        strayed = False
        if value is not None and current:
            low, high = current[(len(current) - 1) // 2], current[len(current) // 2]
            # The double nearest to the exact median, none where `middle` has none.
            center = (low + high) / 2 if max(abs(low), abs(high)) < WIDEST // 10 else 0
            strayed = center != 0 and abs(float(value) - center) / center * 100 > self.limit_pct
        good = 0 if strayed else None if good is None else good + 1
        arrived = value if value is not None else None if entry is None else entry[5]
        return good is not None and good < self.recovery, arrived, good

    def _decide(self, asset: str, tick: int, known: dict, polled: dict) -> tuple:
        now = tick * self.poll
        active = {s: v for s, v in known.items() if now - v[2] < self.staleness}
        stale = not active
        active = active or known
        used = {s: v for s, v in active.items() if not v[4]} or active
        scale = max(v[1] for v in active.values())
        prices = [rescaled(int(v[0]), v[1], scale) for v in used.values()]
        price = None if None in prices else middle(sorted(prices))
        values = [v[2] for v in polled.values()]
        return (asset, tick, pd.Timestamp(now, unit="s"), price, scale, sorted(used), max(v[2] for v in used.values()),
                len(used) / max(len(known), 1), level_of(len(used), len(known), stale), stale,
                min(values, default=None), max(values, default=None), sorted(polled))


def stream_consensus(
    readings: DataFrame, *, staleness: int = STALENESS_SECONDS, poll: int = POLL_SECONDS,
    lateness_s: int = LATENESS_SECONDS, limit_pct: float | None = DEVIATION_LIMIT_PCT,
    recovery: int = RECOVERY_SUCCESSES, scale: int = 18,
) -> DataFrame:
    """Consensus per asset and poll tick, emitted when the watermark passes the tick.

    `readings` has seq, asset, source, price, decimals, timestamp. Every tick from an asset's first
    on gives a row; one without a fresh reading repeats the last known set and is stale. All sources
    that an asset has had count for the confidence; those the deviation breaker suspects are left
    out while others remain (`limit_pct` None: no breaker). `lowest`, `highest` and `polled` describe
    the readings of the tick itself. Late readings are dropped by the watermark.
    """
    ceil = F.ceil(F.col("timestamp") / F.lit(poll)).cast("bigint")
    rows = with_state_store(readings).select(
        "asset", F.timestamp_seconds("timestamp").alias("event_time"), "seq", "source",
        F.col("price").cast("string").alias("price"), F.col("decimals").cast("int").alias("decimals"), "timestamp",
        ceil.alias("tick"))
    rows = rows.filter(F.col("price").isNotNull()).withWatermark("event_time", f"{lateness_s} seconds")
    out = rows.groupBy("asset").transformWithStateInPandas(
        TickConsensus(staleness, poll, limit_pct, recovery, scale), CONSENSUS, "Append", "EventTime",
        eventTimeColumnName="tick_time")
    return out.withColumn("price", F.col("price").cast("decimal(38,1)"))


class TickAlerts(_Ticked):
    """State: the price before, ticks without a source in a row, and when each kind was last sent."""

    fields = ("tick long, price string, timestamp long, stale boolean, lowest double, highest double, polled array<string>, "
              "deviation_pct double, stale_s double, source_down double")
    output = ALERTS

    def __init__(self, poll: int, period_s: int, disagreement_pct: float):
        self.poll, self.period_s, self.disagreement_pct = poll, period_s, disagreement_pct

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "price string, failures long")
        self.sent = handle.getMapState("sent", "kind string", "at long")

    def rows_of(self, asset: str, ticks: range):
        previous, failures = self.last.get() or (None, 0)
        sent = {k[0]: v[0] for k, v in self.sent.iterator()}
        before = dict(sent)
        for tick, rows in self._taken(ticks):
            for row in rows:
                now = tick * self.poll
                for kind, alert in self._check(asset, now, previous, failures, row):
                    if kind not in sent or now - sent[kind] >= self.period_s:
                        sent[kind] = now
                        yield (asset, tick, kind, *alert)
                previous, failures = row[0], failures + 1 if row[2] else 0
        self.last.update((previous, failures))
        for kind, at in sent.items():
            if before.get(kind) != at:
                self.sent.updateValue((kind,), (at,))

    def _check(self, asset, now, previous, failures, row):
        price, timestamp, stale, lowest, highest, polled, limit, oldest, down = row
        if _set(limit) and previous is not None and price is not None:
            old, new = float(previous), float(price)
            # A move away from 0 has no finite size and always fires.
            moved = abs((new - old) / old) * 100 if old else (math.inf if new else 0.0)
            if moved > limit:
                yield "deviation", ("deviation", DEVIATION_TEXT.format(asset=asset, pct=_two_places(moved)),
                                    previous, price, moved, None)
        if _set(oldest) and now - timestamp > oldest:
            yield "stale", ("stale", STALE_TEXT.format(asset=asset, age=now - timestamp, limit=int(oldest)),
                            None, None, None, None)
        if _set(down) and stale and failures >= down:
            yield "source_down", ("source_down", SOURCE_DOWN_TEXT.format(asset=asset, streak=failures),
                                  None, None, None, None)
        if len(polled) > 1 and lowest > 0:
            spread = (highest - lowest) / lowest * 100
            if spread > self.disagreement_pct:
                yield "disagreement", (
                    "deviation", DISAGREEMENT_TEXT.format(asset=asset, pct=_two_places(spread)), None, None,
                    spread, list(polled))


def _two_places(value: float) -> str:
    """As the batch messages: half up on the shortest decimal form."""
    if not math.isfinite(value):
        return "Infinity"
    return str(Decimal(repr(value)).quantize(Decimal("0.01"), ROUND_HALF_UP, Context(prec=400)))


def _set(limit) -> bool:
    return limit is not None and limit > 0


def stream_alerts(
    consensus: DataFrame, thresholds: DataFrame, *, period_s: int, disagreement_pct: float, poll: int = POLL_SECONDS
) -> DataFrame:
    """Alerts from a stream of `stream_consensus`, held back for `period_s` per asset and kind.

    Kinds: deviation from the tick before, stale, source_down (ticks without a source in a row) by the
    asset's row of `thresholds` (asset, deviation_pct, stale_s, source_down; no row: not checked), and
    disagreement between the sources of one tick, which every asset is checked for.
    """
    limits = thresholds.select("asset", *[F.col(c).cast("double") for c in ("deviation_pct", "stale_s", "source_down")])
    rows = with_state_store(consensus).select(
        "asset", "tick", "tick_time", F.col("price").cast("string").alias("price"), "timestamp", "stale", "lowest",
        "highest", "polled").join(limits, "asset", "left")
    out = rows.groupBy("asset").transformWithStateInPandas(
        TickAlerts(poll, period_s, disagreement_pct), ALERTS, "Append", "EventTime")
    at: Column = F.col("tick") * poll
    return out.withColumn("timestamp", at.cast("bigint")).drop("tick")
