"""Stateful processors for live streams: value, list, map, reducing and aggregating state, expiry, timers.

Rows of one key in a micro-batch come in no order, so each processor sorts them by seq. A null vc gives no alert, is
counted as a value of its own in map state, and changes no sum and no list.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("seq")


def _values(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int | None]]:
    """(seq, vc) in order; a null vc is None."""
    frame = _ordered(rows)
    return ((seq, None if pd.isna(vc) else int(vc)) for seq, vc in zip(frame["seq"], frame["vc"], strict=True))


class JumpAlerts(StatefulProcessor):
    """Value state: the key's last value; an alert where the next differs by more than limit."""

    SCHEMA = "id string, seq long, vc int, prev_vc int"
    limit = 10

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "vc int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for seq, vc in _values(rows):
            if last is not None and vc is not None and abs(vc - last) > self.limit:
                out.append((key[0], seq, vc, last))
            last = vc
        self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["id", "seq", "vc", "prev_vc"]).astype({"vc": "Int32", "prev_vc": "Int32"})

    def close(self) -> None:
        pass


class TopList(StatefulProcessor):
    """List state: the key's three highest values, emitted after each record."""

    SCHEMA = "id string, seq long, top string"
    n = 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getListState("top", "vc int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        top = [v[0] for v in self.top.get()] if self.top.exists() else []
        out = []
        for seq, vc in _values(rows):
            if vc is not None:
                top = sorted([*top, vc], reverse=True)[: self.n]
            out.append((key[0], seq, ",".join(map(str, top))))
        if top:
            self.top.put([(v,) for v in top])
        yield pd.DataFrame(out, columns=["id", "seq", "top"])

    def close(self) -> None:
        pass


class ValueCounts(StatefulProcessor):
    """Map state: how often each value of the key occurred, emitted after each record."""

    SCHEMA = "id string, seq long, vc int, n long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "vc int", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        for seq, vc in _values(rows):
            at = (vc,)
            n = (self.counts.getValue(at)[0] if self.counts.containsKey(at) else 0) + 1
            self.counts.updateValue(at, (n,))
            out.append((key[0], seq, vc, n))
        yield pd.DataFrame(out, columns=["id", "seq", "vc", "n"]).astype({"vc": "Int32"})

    def close(self) -> None:
        pass


class SumAndAverage(StatefulProcessor):
    """Reducing and aggregating state: the running sum and average of a key."""

    SCHEMA = "id string, seq long, total long, average double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "total long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        total, n = self.sums.get() if self.sums.exists() else (None, 0)
        out = []
        for seq, vc in _values(rows):
            if vc is not None:
                total, n = (total or 0) + vc, n + 1
            out.append((key[0], seq, total, total / n if n else None))
        self.sums.update((total, n))
        yield pd.DataFrame(out, columns=["id", "seq", "total", "average"]).astype({"total": "Int64", "average": "Float64"})

    def close(self) -> None:
        pass


class Expiring(StatefulProcessor):
    """State with a time to live that reading refreshes too: what was read is written again."""

    SCHEMA = "id string, seq long, found int"
    ttl_ms = 5000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "vc int", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        for seq, vc in _values(rows):
            out.append((key[0], seq, self.last.get()[0] if self.last.exists() else None))
            self.last.update((vc,))
        yield pd.DataFrame(out, columns=["id", "seq", "found"]).astype({"found": "Int32"})

    def close(self) -> None:
        pass


class EventTimer(StatefulProcessor):
    """An event-time timer for each key, which fires once when the watermark passes it."""

    SCHEMA = "id string, fired_at long"
    at_ms = 5000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fired = handle.getValueState("fired", "yes boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if not self.fired.exists():
            self.handle.registerTimer(self.at_ms)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.fired.update((True,))
        yield pd.DataFrame({"id": [key[0]], "fired_at": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


class ProcessingTimer(StatefulProcessor):
    """A timer on the clock for each key, wait_ms after its record; a record with vc = cancel deletes the key's timers."""

    SCHEMA = "id string, fired_at long"
    wait_ms = 1000
    cancel = -1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if (_ordered(rows)["vc"] == self.cancel).any():
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"id": [key[0]], "fired_at": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


class WatermarkNow(StatefulProcessor):
    """The watermark that stands, in milliseconds, when each record is processed."""

    SCHEMA = "id string, seq long, watermark long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        yield pd.DataFrame([(key[0], seq, now) for seq in _ordered(rows)["seq"]], columns=["id", "seq", "watermark"])

    def close(self) -> None:
        pass


class GlobalWindow(StatefulProcessor):
    """One window without end for each key, with a trigger of its own: every n records, over the records since.

    List state takes a batch's new records at its end, and is read only when the window fires.
    """

    SCHEMA = "id string, fired_at long, total long"
    n = 4

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "vc int")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        out, new = [], []
        for _, vc in _values(rows):
            new.append((vc,))
            seen += 1
            if seen % self.n == 0:
                held = [*self.held.get(), *new] if self.held.exists() else new
                out.append((key[0], seen, sum(v[0] or 0 for v in held)))
                self.held.clear()
                new = []
        if new:
            self.held.appendList(new)
        self.seen.update((seen,))
        yield pd.DataFrame(out, columns=["id", "fired_at", "total"])

    def close(self) -> None:
        pass


class Changelog(StatefulProcessor):
    """sum(vc) of a key as +I, then -U and +U."""

    SCHEMA = "id string, seq long, op string, total long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "total long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        begun = self.total.exists()
        total = self.total.get()[0] if begun else None
        out = []
        for seq, vc in _values(rows):
            old, total = total, total if vc is None else (total or 0) + vc
            out += [(key[0], seq, "-U", old), (key[0], seq, "+U", total)] if begun else [(key[0], seq, "+I", total)]
            begun = True
        self.total.update((total,))
        yield pd.DataFrame(out, columns=["id", "seq", "op", "total"]).astype({"total": "Int64"})

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, processor: StatefulProcessor, key: str = "id", mode: str = "append",
             time: str = "none") -> DataFrame:
    """The processor over the stream's keys. time: none, processingTime or eventTime."""
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode=mode, timeMode=time
    )
