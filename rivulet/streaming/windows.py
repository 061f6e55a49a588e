"""Live windows that fire more than once, sessions, count windows and two-input functions, by keyed state.

The processors judge records by the watermark that stands when their batch begins. With one record a batch that is the
watermark of the replay, record by record; with larger batches a record is never judged later than in the replay.
Records come out with `kind`: "fire" for a window's first firing, "again" for each further one, and "late" for records
that come after the window is discarded; the engine drops none, so that late ones can go to a sink of their own.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rivulet.functions.accumulators import Accumulator

FIRE, AGAIN, LATE = "fire", "again", "late"


def _dumped(value: Any) -> tuple[bytes]:
    return (pickle.dumps(value),)


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: r["seq"])


def _named(columns: list[str]) -> Callable[[Row], tuple]:
    kind = namedtuple("Record", columns)
    return lambda row: kind(*(row[c] for c in columns))


class _Named(StatefulProcessor):
    """names: of the output's fields."""

    names: list[str]

    def row(self, *values: Any) -> Row:
        return Row(*self.names)(*values)

    def close(self) -> None:
        pass


class _Refiring(_Named):
    """A window by (key, start): fires at its end, again for each record within the allowed lateness, then goes."""

    def __init__(self, size_ms: int, allowed_ms: int) -> None:
        self.size_ms, self.allowed_ms = size_ms, allowed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fired = handle.getValueState("fired", "yes boolean")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self) -> None:
        """Reads the window's state, once for all records of a batch."""

    def save(self) -> None:
        """Writes what the records of a batch have made of it."""

    def held(self) -> bool:
        raise NotImplementedError

    def take(self, row: Row) -> None:
        """Adds a record to the window's state."""
        raise NotImplementedError

    def emit(self, key: tuple, kind: str, seq: int | None) -> Iterator[Row]:
        raise NotImplementedError

    def late(self, key: tuple, seq: int) -> Iterator[Row]:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now, end = timerValues.getCurrentWatermarkInMs(), key[-1] + self.size_ms
        self.load()
        if now >= end and self.held():
            yield from self._first(key)
        for row in _in_order(rows):
            if now >= end + self.allowed_ms:
                yield from self.late(key, row["seq"])
                continue
            self.take(row)
            if now >= end:
                self.fired.update((True,))
                yield from self.emit(key, AGAIN, row["seq"])
        self.save()
        if self.held():
            pending = set(self.handle.listTimers())
            for at in {end, end + self.allowed_ms} - pending:
                if at > now:
                    self.handle.registerTimer(at)

    def _first(self, key: tuple) -> Iterator[Row]:
        if not self.fired.exists():
            self.fired.update((True,))
            yield from self.emit(key, FIRE, None)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.load()
        if self.held():
            yield from self._first(key)
        if expiredTimerInfo.getExpiryTimeInMs() >= key[-1] + self.size_ms + self.allowed_ms:
            self.fired.clear()
            self.forget()


class RefiringAggregate(_Refiring):
    """The window's accumulator, written again for each batch of records."""

    def __init__(self, acc: Accumulator, width: int, columns: list[str], size_ms: int, allowed_ms: int) -> None:
        super().__init__(size_ms, allowed_ms)
        self.acc, self.width, self.columns = acc, width, columns

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state binary")
        self.record = _named(self.columns)

    def load(self) -> None:
        self.begun, self.changed = self.state.exists(), False
        self.current = pickle.loads(self.state.get()[0]) if self.begun else self.acc.create()

    def save(self) -> None:
        if self.changed:
            self.state.update(_dumped(self.current))

    def held(self) -> bool:
        return self.begun

    def take(self, row: Row) -> None:
        self.current = self.acc.add(self.current, self.record(row))
        self.begun = self.changed = True

    def emit(self, key: tuple, kind: str, seq: int | None) -> Iterator[Row]:
        yield self.row(*key, seq, kind, *self.acc.result(self.current))

    def late(self, key: tuple, seq: int) -> Iterator[Row]:
        yield self.row(*key, seq, LATE, *[None] * self.width)

    def forget(self) -> None:
        self.state.clear()


class RefiringCoGroup(_Refiring):
    """Both sides' records of a key and window in list state, which body sees whole at each firing."""

    def __init__(self, body: Callable[[list, list], Iterator[tuple]], width: int, columns: list[str], size_ms: int,
                 allowed_ms: int) -> None:
        super().__init__(size_ms, allowed_ms)
        self.body, self.width, self.columns = body, width, columns

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.lists = {side: handle.getListState(side, "record binary") for side in ("left", "right")}
        self.record = _named(self.columns)

    def load(self) -> None:
        self.waiting: dict[str, list[tuple[bytes]]] = {side: [] for side in self.lists}

    def save(self) -> None:
        for side, rows in self.waiting.items():
            if rows:
                self.lists[side].appendList(rows)
        self.load()

    def held(self) -> bool:
        return any(self.waiting.values()) or any(state.exists() for state in self.lists.values())

    def take(self, row: Row) -> None:
        self.waiting[row["side"]].append(_dumped(self.record(row)[:]))

    def emit(self, key: tuple, kind: str, seq: int | None) -> Iterator[Row]:
        self.save()
        record = namedtuple("Record", self.columns)
        sides = [
            [record(*pickle.loads(r[0])) for r in state.get()] if state.exists() else [] for state in self.lists.values()
        ]
        for out in self.body(*sides):
            yield self.row(*key, seq, kind, *out)

    def late(self, key: tuple, seq: int) -> Iterator[Row]:
        yield self.row(*key, seq, LATE, *[None] * self.width)

    def forget(self) -> None:
        for state in self.lists.values():
            state.clear()


def _placed(stream: DataFrame, key: str, columns: list[str | Column], size: int, delay: int, ts: str) -> DataFrame:
    """The stream with a watermark, and w_ms, the start of each record's window; the time itself stays behind."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{delay} seconds")
    ms = F.unix_millis(F.col(ts))
    return timed.select(key, "seq", *columns, (ms - F.pmod(ms, F.lit(size * 1000))).alias("w_ms"))


def _stateful(stream: DataFrame, keys: list[str], processor: _Named, schema: str, time: str = "eventTime") -> DataFrame:
    processor.names = stream.sparkSession.createDataFrame([], schema).columns
    return stream.groupBy(*keys).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=time
    )


def _width(stream: DataFrame, schema: str) -> int:
    """The number of fields that a schema names."""
    return len(stream.sparkSession.createDataFrame([], schema).columns)


def _with_start(found: DataFrame, key: str) -> DataFrame:
    rest = [c for c in found.columns if c not in (key, "w_ms", "seq", "kind")]
    return found.select(key, F.timestamp_millis("w_ms").alias("w_start"), "seq", "kind", *rest)


def refiring_windows(stream: DataFrame, key: str, acc: Accumulator, columns: list[str], size: int, delay: int = 0,
                     allowed: int = 0, ts: str = "ts") -> DataFrame:
    """key, w_start, seq, kind and the accumulator's result for every firing of tumbling windows of `size` seconds.

    The stream has seq, which orders the records of a batch. A first firing has no seq, the others their record's.
    """
    placed = _placed(stream, key, columns, size, delay, ts)
    processor = RefiringAggregate(acc, _width(stream, acc.schema), columns, size * 1000, allowed * 1000)
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, w_ms long, seq long, kind string, {acc.schema}"
    return _with_start(_stateful(placed, [key, "w_ms"], processor, schema), key)


def refiring_cogroup(stream: DataFrame, key: str, body: Callable[[list, list], Iterator[tuple]], schema: str,
                     columns: list[str], size: int, delay: int = 0, allowed: int = 0, ts: str = "ts"
                     ) -> DataFrame:
    """What body gives for both sides' records of each key and window at every firing, with w_start, seq and kind.

    The stream is the union of both inputs, with side ("left" or "right") and a common seq; body gets two lists of
    records with the named columns and gives tuples of `schema`.
    """
    placed = _placed(stream, key, ["side", *columns], size, delay, ts)
    processor = RefiringCoGroup(body, _width(stream, schema), columns, size * 1000, allowed * 1000)
    whole = f"{key} {stream.schema[key].dataType.simpleString()}, w_ms long, seq long, kind string, {schema}"
    return _with_start(_stateful(placed, [key, "w_ms"], processor, whole), key)


class Sessions(_Named):
    """A key's open sessions (start, end, fired, state). A record merges those that its own gap touches."""

    def __init__(self, acc: Accumulator, width: int, columns: list[str], allowed_ms: int) -> None:
        self.acc, self.width, self.columns, self.allowed_ms = acc, width, columns, allowed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open_sessions = handle.getValueState("sessions", "sessions binary")
        self.record = _named(self.columns)

    def _load(self) -> list[tuple]:
        return pickle.loads(self.open_sessions.get()[0]) if self.open_sessions.exists() else []

    def _store(self, sessions: list[tuple], now: int) -> None:
        """Timers: the end of what has not fired, and the discard of all."""
        wanted = {at for _, end, fired, _ in sessions for at in ([] if fired else [end]) + [end + self.allowed_ms]}
        pending = set(self.handle.listTimers())
        for at in pending - wanted:
            self.handle.deleteTimer(at)
        for at in wanted - pending:
            self.handle.registerTimer(max(at, now + 1))
        if sessions:
            self.open_sessions.update(_dumped(sessions))
        else:
            self.open_sessions.clear()

    def _row(self, key: tuple, session: tuple, seq: int | None, kind: str) -> Row:
        return self.row(*key, session[0], session[1], seq, kind, *self.acc.result(session[3]))

    def _due(self, key: tuple, sessions: list[tuple], now: int) -> tuple[list[Row], list[tuple]]:
        """What fires for the first time by now, and the sessions that stay."""
        out, left = [], []
        for start, end, fired, state in sessions:
            if end <= now and not fired:
                out.append(self._row(key, (start, end, True, state), None, FIRE))
            if end + self.allowed_ms > now:
                left.append((start, end, fired or end <= now, state))
        return out, left

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        out, sessions = self._due(key, self._load(), now)
        yield from out
        for row in _in_order(rows):
            start, end = row["from_ms"], row["to_ms"]
            touched = sorted((s for s in sessions if s[0] <= end and start <= s[1]), key=lambda s: s[0])
            start, end = min([start, *(s[0] for s in touched)]), max([end, *(s[1] for s in touched)])
            if end + self.allowed_ms <= now:
                yield self.row(*key, start, end, row["seq"], LATE, *[None] * self.width)
                continue
            state = touched[0][3] if touched else self.acc.create()
            for other in touched[1:]:
                state = self.acc.merge(state, other[3])
            merged = (start, end, end <= now, self.acc.add(state, self.record(row)))
            sessions = [s for s in sessions if s not in touched] + [merged]
            if end <= now:
                yield self._row(key, merged, row["seq"], AGAIN)
        self._store(sessions, now)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        out, left = self._due(key, self._load(), now)
        yield from out
        if left:
            self.open_sessions.update(_dumped(left))
        else:
            self.open_sessions.clear()


def sessions(stream: DataFrame, key: str, acc: Accumulator, columns: list[str], gap: Column | float, delay: int = 0,
             allowed: int = 0, ts: str = "ts") -> DataFrame:
    """key, w_start, w_end, seq, kind and the accumulator's result of sessions, fixed or with a gap for each record.

    gap: seconds, a number or a column; records whose gap is null or not positive take no part. A key's open sessions
    are one value of state: as many as the delay and the lateness allow.
    """
    seconds = gap if isinstance(gap, Column) else F.lit(gap)
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{delay} seconds")
    placed = timed.select(
        key,
        "seq",
        *columns,
        F.unix_millis(F.col(ts)).alias("from_ms"),
        (F.unix_millis(F.col(ts)) + (seconds * 1000).cast("long")).alias("to_ms"),
    ).where(F.col("to_ms") > F.col("from_ms"))
    kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, from_ms long, to_ms long, seq long, kind string, {acc.schema}"
    found = _stateful(placed, [key], Sessions(acc, _width(stream, acc.schema), columns, allowed * 1000), schema)
    rest = [c for c in found.columns if c not in (key, "from_ms", "to_ms", "seq", "kind")]
    bounds = [F.timestamp_millis("from_ms").alias("w_start"), F.timestamp_millis("to_ms").alias("w_end")]
    return found.select(key, *bounds, "seq", "kind", *rest)


class CountWindows(_Named):
    """A ring of a key's last `size` records in list state; fires at every slide-th record over what the ring holds."""

    def __init__(self, acc: Accumulator, columns: list[str], size: int, slide: int) -> None:
        self.acc, self.columns, self.size, self.slide = acc, columns, size, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "record binary")
        self.seen = handle.getValueState("seen", "n long")
        self.record = namedtuple("Record", self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        ring = [pickle.loads(r[0]) for r in self.ring.get()] if self.ring.exists() else []
        for row in _in_order(rows):
            ring = [*ring, tuple(row[c] for c in self.columns)][-self.size :]
            seen += 1
            if seen % self.slide == 0:
                state = self.acc.create()
                for held in ring:
                    state = self.acc.add(state, self.record(*held))
                yield self.row(*key, seen, *self.acc.result(state))
        self.seen.update((seen,))
        self.ring.put([_dumped(held) for held in ring])


def count_windows(stream: DataFrame, key: str, acc: Accumulator, columns: list[str], size: int, slide: int | None = None
                  ) -> DataFrame:
    """key, fired_at (the key's records so far) and the accumulator's result over its last `size` records at most.

    slide None: tumbling windows, which fire at every size-th record over exactly these. The stream has seq.
    """
    placed = stream.select(*dict.fromkeys([key, "seq", *columns]))
    processor = CountWindows(acc, columns, size, slide or size)
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, fired_at long, {acc.schema}"
    return _stateful(placed, [key], processor, schema, "none")


class TwoInput(_Named):
    """A function of two inputs with keyed state of its own: a hook for each side's records, in order of seq.

    A subclass names its output in `schema`, opens its state in `open`, and yields tuples of the schema.
    """

    schema: str

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def left(self, key: tuple, row: Row) -> Iterator[tuple]:
        raise NotImplementedError

    def right(self, key: tuple, row: Row) -> Iterator[tuple]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in _in_order(rows):
            given = self.left(key, row["of_left"]) if row["of_left"] is not None else self.right(key, row["of_right"])
            for out in given:
                yield self.row(*out)


def connected(left: DataFrame, right: DataFrame, key: str, function: TwoInput, seq: str = "seq") -> DataFrame:
    """Two streams with a common key through one two-input function. seq numbers both sides' records together."""

    def tagged(df: DataFrame, mine: str, other: str, others: DataFrame) -> DataFrame:
        missing = F.lit(None).cast(others.schema.simpleString())
        return df.select(key, F.col(seq).alias("seq"), F.struct(*df.columns).alias(mine), missing.alias(other))

    a, b = tagged(left, "of_left", "of_right", right), tagged(right, "of_right", "of_left", left)
    return _stateful(a.unionByName(b), [key], function, function.schema, "none")


class Pairs(TwoInput):
    """Every pair of a key's left and right records, once, whichever comes first: what came is kept for each side."""

    def __init__(self, schema: str, left_columns: list[str], right_columns: list[str]) -> None:
        self.schema, self.left_columns, self.right_columns = schema, left_columns, right_columns

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.lefts, self.rights = (handle.getListState(s, "record binary") for s in ("lefts", "rights"))

    @staticmethod
    def _all(state: Any) -> Iterator[tuple]:
        return (pickle.loads(r[0]) for r in state.get()) if state.exists() else iter(())

    def left(self, key: tuple, row: Row) -> Iterator[tuple]:
        mine = tuple(row[c] for c in self.left_columns)
        self.lefts.appendValue(_dumped(mine))
        for other in self._all(self.rights):
            yield (*key, *mine, *other)

    def right(self, key: tuple, row: Row) -> Iterator[tuple]:
        mine = tuple(row[c] for c in self.right_columns)
        self.rights.appendValue(_dumped(mine))
        for other in self._all(self.lefts):
            yield (*key, *other, *mine)
