"""A keyed episode machine: turns arrive one at a time, in any order within a bound, and episodes end on their own.

A key's turns wait in state until the watermark has passed them, so they count in the order of their times however they
were delivered, and a restart in the middle changes nothing. An episode ends with its terminal turn, at the cap, or when
no turn followed in time. Timers end what has fallen silent, so a key without an open episode leaves no state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import Row

#: The state store that keeps keyed state on disk, not in the executors' heap. Fixed value.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FINISHED, CAPPED, TIMED_OUT = "finished", "capped", "timed_out"
EPISODES = "key long, began timestamp, ended timestamp, n_turns int, outcome string"


class Machine(StatefulProcessor):
    """Turns (key, at in ms, id, terminal) to episodes; clock is event, or processing for a service without event times."""

    def __init__(self, cap: int, idle_ms: int, clock: str = "event") -> None:
        self.cap, self.idle, self.clock = cap, idle_ms, clock

    def init(self, handle) -> None:
        self.handle = handle
        # by the processing clock state also has a time to live, beyond the timers, should one be lost
        live = {} if self.clock == "event" else {"ttlDurationMs": 4 * self.idle}
        self.open = handle.getValueState("open", "began long, last long, n int", **live)
        self.waiting = handle.getListState("waiting", "at long, id long, terminal boolean", **live)
        self.timer = handle.getValueState("timer", "at long", **live)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["at"], r["id"], r["terminal"]) for r in rows]
        if self.clock == "processing":
            now = timerValues.getCurrentProcessingTimeInMs()
            new = [(now, i, terminal) for _, i, terminal in sorted(new)]
            yield from self._advance(key, new, now, True)
        else:
            # a row that no turn has passed yet waits; those before it are dealt with by the watermark's timer
            yield from self._advance(key, [*self._held(), *new], timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs() if self.clock == "event" else timerValues.getCurrentProcessingTimeInMs()
        yield from self._advance(key, self._held(), now, False)

    def _held(self) -> list[tuple]:
        return list(self.waiting.get()) if self.waiting.exists() else []

    def _advance(self, key, turns: list[tuple], now: int, whole: bool) -> Iterator[Row]:
        """Take the turns before now (all, if whole) in order, end what has fallen silent by now, and set the next timer."""
        began, last, n = self.open.get() if self.open.exists() else (0, 0, 0)
        ready = sorted(t for t in turns if whole or t[0] < now)
        rest = [] if whole else [t for t in turns if t[0] >= now]
        for at, _, terminal in ready:
            if n and at > last + self.idle:
                yield self._episode(key, began, last + self.idle, n, TIMED_OUT)
                n = 0
            began, last, n = (began if n else at), at, n + 1
            if terminal or n >= self.cap:
                yield self._episode(key, began, at, n, FINISHED if terminal else CAPPED)
                n = 0
        if n and last + self.idle < now:
            yield self._episode(key, began, last + self.idle, n, TIMED_OUT)
            n = 0
        if n:
            self.open.update((began, last, n))
        elif self.open.exists():
            self.open.clear()
        if rest:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()
        self._ring(min([t[0] for t in rest] + ([last + self.idle] if n else []), default=None))

    def _ring(self, at: int | None) -> None:
        held = self.timer.get()[0] if self.timer.exists() else None
        if at is None:
            if held is not None:
                self.handle.deleteTimer(held)
                self.timer.clear()
            return
        at += 1  # rows strictly before now are taken
        if held != at:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _episode(self, key, began: int, ended: int, n: int, outcome: str) -> Row:
        from datetime import datetime, timezone

        when = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)
        return Row(key=key[0], began=when(began), ended=when(ended), n_turns=n, outcome=outcome)

    def close(self) -> None:
        pass


def use_disk_state(spark: SparkSession) -> None:
    """Keep keyed state in RocksDB, which transformWithState needs, for the streams this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def episodes(turns: DataFrame, key: str, at: str, id_: str, terminal, cap: int = 8, idle: str = "12 hours", late: str = "1 hour", clock: str = "event") -> DataFrame:
    """A stream of turns to a stream of ended episodes: key, began, ended, n_turns, outcome (finished, capped, timed_out).

    Turns of a key count in order of (at, id_), in milliseconds. terminal is the condition of a turn that ends its
    episode; so does the cap-th turn, and idle without a turn, which is also where a timed-out one is said to end. Turns
    later than late behind the newest one are dropped by the watermark; rows with a null key or time have no episode.
    State holds a key's turns of the last late, and one row for an open episode.
    """
    spark = turns.sparkSession
    use_disk_state(spark)
    idle_ms = int(spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {idle}"))).first()[0])
    rows = turns.withWatermark(at, late).filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("key"), F.unix_millis(at).alias("at"), F.col(id_).cast("long").alias("id"), F.coalesce(terminal, F.lit(False)).alias("terminal"), at)
    mode = {"event": "EventTime", "processing": "ProcessingTime"}[clock]
    return rows.groupBy("key").transformWithState(Machine(cap, idle_ms, clock), EPISODES, "Append", mode)
