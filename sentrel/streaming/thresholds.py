"""Threshold aggregations as a checkpointed stateful stream. The specification travels in each row, so rules may change under live state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from sentrel.operators.thresholds import AGGREGATIONS, OPS, advance, keyed, learn, registered

#: Spark's operator needs this state store.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_ROW = "event_uid string, rule_key string, agg_value long, payload string"
_NOW = "t0 long, a long, b long, due long, other string"  # other: of an aggregation that isn't built in, as JSON


class ThresholdProcessor(StatefulProcessor):
    """The state of one key: its first event's time and a number or two; the values that uniquecount has seen are entries of a map."""

    def __init__(self, reopen: bool, forget_seconds: int | None, event_time: bool):
        self.reopen, self.forget, self.event_time, self.more = reopen, forget_seconds, event_time, registered()

    def init(self, handle) -> None:
        learn(self.more)
        ttl = self.forget * 1000 if self.forget is not None and not self.event_time else None
        self.handle = handle
        self.now, self.seen = handle.getValueState("now", _NOW, ttl), handle.getMapState("seen", "value string", "n int", ttl)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ordered = sorted(rows, key=lambda r: (r.created_ms, r.event_uid))
        fn = ordered[0].agg_fn
        before = self.now.get() if self.now.exists() else None
        state = None if before is None else [before[0], self._read(fn, before)]
        own: set[str] = set()  # values of this batch that the map has
        for r in ordered:
            step = self._unique if fn == "uniquecount" and AGGREGATIONS[fn].init("") == {"": 1} else self._plain
            state, value = step(state, r, own)
            if value is not None:
                yield Row(event_uid=r.event_uid, rule_key=r.rule_key, agg_value=value, payload=r.payload)
        if state is None:
            if before is not None:
                self.now.clear()
            return
        last = ordered[-1]
        ends = state[0] + 1000 * last.timeframe_sec
        due = ends if self.reopen or self.forget is None else last.created_ms + 1000 * self.forget
        if self.event_time and (before is None or before[3] != due):
            self.handle.registerTimer(due)
        self.now.update((state[0], *self._written(fn, state[1], due)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """The watermark has passed what the state waited for: unless its next event is to find it expired, all of it goes."""
        before = self.now.get() if self.now.exists() else None
        if before is not None and expiredTimerInfo.getExpiryTimeInMs() >= before[3]:
            self.seen.clear()
            if self.reopen or self.forget is not None:
                self.now.clear()
        return iter(())

    def _plain(self, state: list | None, r: Row, own: set[str]) -> tuple[list | None, int | None]:
        return advance(state, r.created_ms, r.agg_raw, r.agg_fn, r.op, r.threshold, r.timeframe_sec, self.reopen)

    def _unique(self, state: list | None, r: Row, own: set[str]) -> tuple[list | None, int | None]:
        """`advance` with the values in the map and their number as the accumulator: an event costs one entry at most."""
        late = state is not None and int((r.created_ms - state[0]) / 1000) >= r.timeframe_sec
        if state is None or late:
            if late:
                self._forget(own)
            if (late and not self.reopen) or r.agg_raw is None:
                return None, None
            self._note(r.agg_raw, own)
            return [r.created_ms, 1], None
        n = state[1] + (r.agg_raw is not None and self._note(r.agg_raw, own))
        if OPS[r.op](n, r.threshold):
            self._forget(own)
            return None, n
        return [state[0], n], None

    def _note(self, value: str, own: set[str]) -> bool:
        """Whether the value is new."""
        if value in own:
            return False
        own.add(value)
        if self.seen.containsKey((value,)):
            return False
        self.seen.updateValue((value,), (1,))
        return True

    def _forget(self, own: set[str]) -> None:
        own.clear()
        self.seen.clear()

    @staticmethod
    def _read(fn: str, now: tuple) -> Any:
        _, a, b, _, other = now
        return json.loads(other) if other is not None else [a, b] if fn == "avg" else a

    @staticmethod
    def _written(fn: str, acc: Any, due: int) -> tuple:
        if fn == "avg" and isinstance(acc, list):
            return acc[0], acc[1], due, None
        return (acc, None, due, None) if isinstance(acc, int) else (None, None, due, json.dumps(acc))


def fired_stream(matches: DataFrame, reopen_on_expiry: bool = False, forget_after_seconds: int | None = None, event_time: bool = False, delay_seconds: int = 0) -> DataFrame:
    """Like operators.thresholds.fired, on a stream: rows of a micro-batch are taken in order of (created, event_uid) within a key.

    A text column `payload` goes along with the event that fires. State of an idle key stays until its next event, since that event must
    find it expired and is dropped with it. Keys by raw value may be without number, so the state can be bounded:

    * `forget_after_seconds`: a key that has had no event for so long is forgotten, and its next event opens a state instead. Anything from the
      longest timeframe on is safe for events that come on time. By the clock, as the store's time to live.
    * `event_time`: the same by the events' own time. The watermark is the latest created so far less delay_seconds; timers end a state once
      it has passed the end of its timeframe. With `reopen_on_expiry` nothing is left then and results are those of the batch; without it the first event's time
      stays, unless `forget_after_seconds` ends that too. Spark drops an event that is older than the watermark before it gets here.

    A key's rows of one micro-batch are in memory together: bound the micro-batch at the source.
    """
    source = matches.withWatermark("created", f"{delay_seconds} seconds") if event_time else matches
    narrow = keyed(source).selectExpr("created", "rule_key", "state_key", "created_ms", "cast(event_uid as string) event_uid", "agg_raw", "agg_fn", "op", "threshold", "timeframe_sec", "payload")
    mode = "eventTime" if event_time else "none" if forget_after_seconds is None else "processingTime"
    processor = ThresholdProcessor(reopen_on_expiry, forget_after_seconds, event_time)
    return narrow.groupBy("rule_key", "state_key").transformWithState(processor, _ROW, "append", mode)
