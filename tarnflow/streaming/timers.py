"""State machines with typed state and timers: what waits ends at its time, without a further row.

State is in the state store under names and types of its own (values and lists), so it survives a
restart from the checkpoint and can be read by Spark's state reader.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnflow.operators.replay import Batcher, Step

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_REQUEST = "seq long, at_us long, key string"


def use_rocksdb(spark: SparkSession) -> None:
    """Typed state needs this state store; a session that has another refuses such queries."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class _Batches(StatefulProcessor):
    """A stream's server of batches: the rows that wait, in order, those put off, and when it is free."""

    def __init__(self, machine: Batcher, stream: str, arrival: bool) -> None:
        self.machine, self.stream, self.arrival = machine, stream, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.server = handle.getValueState("server", "free_us long, batch long")
        self.put_off = handle.getListState("put_off", _REQUEST)
        self.queue = handle.getListState("queue", _REQUEST)

    def _run(self, key: tuple, new: list[tuple], known_to: int) -> Iterator[Row]:
        state = self.machine.start()
        if self.server.exists():
            state["free"], state["batch"] = self.server.get()
        for name in ("put_off", "queue"):
            held = getattr(self, name)
            state[name] = deque(tuple(r) for r in held.get()) if held.exists() else deque()
        state["queue"].extend(new)
        made = self.machine.advance(state, known_to)
        self.server.update((state["free"], state["batch"]))
        for name in ("put_off", "queue"):
            rows = [tuple(r) for r in state[name]]
            getattr(self, name).put(rows) if rows else getattr(self, name).clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state["due"] is not None:
            self.handle.registerTimer(state["due"] // 1000 + 1)
        for seq, batch, place, closed in made:
            yield Row(**{self.stream: key[0], "seq": seq, "batch": batch, "place": place, "closed_us": closed})

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        if self.arrival:
            now = timerValues.getCurrentProcessingTimeInMs() * 1000
            new = [(seq, now, kind) for seq, _, kind in sorted((r.seq, r.at_us, r.key) for r in rows)]
            known = now
        else:
            found = sorted(((r.at_us, r.seq, r.key) for r in rows), key=lambda r: r[:2])
            new = [(seq, at, kind) for at, seq, kind in found]
            known = max(found[-1][0], timerValues.getCurrentWatermarkInMs() * 1000)
        yield from self._run(key, new, known)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802
        now = timerValues.getCurrentProcessingTimeInMs() if self.arrival else timerValues.getCurrentWatermarkInMs()
        yield from self._run(key, [], max(now, expiredTimerInfo.getExpiryTimeInMs()) * 1000)

    def close(self) -> None:
        pass


def batch_stream(
    requests: DataFrame, size: int, wait_us: int, service_us: int, *, at: str = "ts", key: str = "key", seq: str = "seq", stream: str = "stream_id", late: str = "0 seconds", arrival: bool = False
) -> DataFrame:
    """``tarnflow.operators.batching.collect_batches`` over a stream: (stream, seq, batch, place, closed_us).

    A batch that is not full closes once the watermark, which rows of any stream move, is past its
    deadline; with ``arrival`` times are those at which Spark sees the rows, and clocks end the wait.
    Rows of a stream are taken in the order of their times within a micro-batch; later ones come after.
    Only rows of batches that are not decided yet are kept.
    """
    use_rocksdb(requests.sparkSession)
    rows = requests.select(
        stream, F.col(at).alias("__ts"), F.col(seq).cast("long").alias("seq"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(key).cast("string").alias("key")
    )
    if not arrival:
        rows = rows.withWatermark("__ts", late)
    out = T.StructType([requests.schema[stream], *T.StructType.fromDDL("seq long, batch long, place long, closed_us long").fields])
    machine = _Batches(Batcher(size, wait_us, service_us), stream, arrival)
    return rows.groupBy(stream).transformWithState(machine, out, "Append", "ProcessingTime" if arrival else "EventTime")


class _Steps(StatefulProcessor):
    """A step with a state of a few typed fields, one value a stream."""

    def __init__(self, step: Step, start: Callable[[], Any], names: list[str], fields: str, stream: str, order: tuple[str, ...], ttl_ms: int | None) -> None:
        self.step, self.start, self.names, self.fields = step, start, names, fields
        self.stream, self.order, self.ttl_ms = stream, order, ttl_ms
        self.width = len(T.StructType.fromDDL(fields))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", "known boolean, " + self.fields, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        state = self.start()
        if self.value.exists():
            known, *held = self.value.get()
            state = None if not known else held[0] if self.width == 1 else tuple(held)
        made = []
        for row in sorted((r.asDict() for r in rows), key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order)):
            state, found = self.step(state, row)
            made += found
        held = (None,) * self.width if state is None else (state,) if self.width == 1 else state
        self.value.update((state is not None, *held))
        for values in made:
            yield Row(**dict(zip([self.stream, *self.names], (key[0], *values), strict=True)))

    def close(self) -> None:
        pass


def step_stream(
    df: DataFrame, step: Step, schema: str, state: str, *, start: Callable[[], Any] = lambda: None, stream: str = "stream_id", order: tuple[str, ...] = ("at_us",), ttl_ms: int | None = None
) -> DataFrame:
    """``tarnflow.operators.replay.replay`` over a stream, for steps whose state is null or a tuple of the fields of ``state``
    (a single one is not a tuple).  With ``ttl_ms`` a stream that has been silent so long begins anew."""
    use_rocksdb(df.sparkSession)
    given = T.StructType.fromDDL(schema)
    out = T.StructType([df.schema[stream], *given.fields])
    machine = _Steps(step, start, given.names, state, stream, order, ttl_ms)
    return df.groupBy(stream).transformWithState(machine, out, "Append", "None" if ttl_ms is None else "ProcessingTime")


class _Panes(StatefulProcessor):
    """Counts and sums by pane of time; a timer at each pane's end reports the pane and the window that ends with it."""

    def __init__(self, key: str, pane_us: int, window_us: int, idle: int) -> None:
        self.key, self.pane, self.panes, self.idle = key, pane_us, window_us // pane_us, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("panes", "pane long", "n long, total double")
        self.span = handle.getValueState("span", "due long, newest long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        added: dict[int, list] = {}
        for r in rows:
            # a pane has its end and not its start, as a window has
            own = added.setdefault(-(-r.at_us // self.pane), [0, 0.0])
            own[0] += 1
            own[1] += r.value or 0.0
        for pane, (n, total) in added.items():
            before = self.sums.getValue((pane,)) if self.sums.containsKey((pane,)) else (0, 0.0)
            self.sums.updateValue((pane,), (before[0] + n, before[1] + total))
        due, newest = self.span.get() if self.span.exists() else (min(added), max(added))
        self.span.update((due, max(newest, *added)))
        self._wait(due)
        yield from ()

    def _wait(self, pane: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(pane * self.pane // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802
        due, newest = self.span.get()
        upto = timerValues.getCurrentWatermarkInMs() * 1000 // self.pane
        sums = {pane[0]: tuple(v) for pane, v in self.sums.iterator()}
        while due <= min(upto, newest + self.idle):
            n, total = sums.get(due, (0, 0.0))
            window = [sums[p] for p in range(due - self.panes + 1, due + 1) if p in sums]
            many = sum(w[0] for w in window)
            yield Row(**{
                self.key: key[0], "end_us": due * self.pane, "frames": n, "fps": n / (self.pane / 1e6), "mean": total / n if n else 0.0,
                "recent": sum(w[1] for w in window) / many if many else None,
            })
            due += 1
        for pane in [p for p in sums if p <= due - self.panes]:
            self.sums.removeKey((pane,))
        if due > newest + self.idle:
            self.sums.clear()
            self.span.clear()
        else:
            self.span.update((due, newest))
            self._wait(due)

    def close(self) -> None:
        pass


def sliding_report(
    df: DataFrame, pane_us: int, window_us: int, *, value: str = "value", at: str = "ts", key: str = "stream_id", late: str = "0 seconds", idle: int = 0
) -> DataFrame:
    """Per key and pane, from its first, once the watermark has passed the pane's end: ``frames, fps, mean`` of the pane and
    ``recent``, the mean over the window that ends with it, ``(end - window, end]``.

    A pane without rows has 0 frames and 0.0; a window without, null.  Only counts and sums of the panes of one
    window are kept.  A key whose last row is ``idle`` panes back ends, and begins anew with its next row.
    """
    if window_us % pane_us or pane_us % 1000:
        raise ValueError("a window is a whole number of panes, and a pane of milliseconds")
    use_rocksdb(df.sparkSession)
    rows = df.select(key, F.col(at).alias("__ts"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(value).cast("double").alias("value"))
    out = T.StructType([df.schema[key], *T.StructType.fromDDL("end_us long, frames long, fps double, mean double, recent double").fields])
    machine = _Panes(key, pane_us, window_us, idle)
    return rows.withWatermark("__ts", late).groupBy(key).transformWithState(machine, out, "Append", "EventTime")


class _Trailing(StatefulProcessor):
    """The samples of a key that a later row can still see."""

    def __init__(self, key: str, window_us: int) -> None:
        self.key, self.window = key, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "at_us long, value double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        held = deque(tuple(r) for r in self.samples.get()) if self.samples.exists() else deque()
        new = sorted(((r.at_us, r.seq, r.value) for r in rows), key=lambda r: r[:2])
        at = 0
        while at < len(new):
            # rows of one time see one another
            end = at
            while end < len(new) and new[end][0] == new[at][0]:
                held.append((new[end][0], new[end][2]))
                end += 1
            while held[0][0] <= new[at][0] - self.window:
                held.popleft()
            known = [v for _, v in held if v is not None]
            mean = sum(known) / len(known) if known else None
            for i in range(at, end):
                yield Row(**{self.key: key[0], "seq": new[i][1], "at_us": new[i][0], "average": mean})
            at = end
        self.samples.put(list(held))

    def close(self) -> None:
        pass


def trailing_stream(df: DataFrame, window_us: int, *, value: str = "value", at: str = "ts", seq: str = "seq", key: str = "stream_id") -> DataFrame:
    """``tarnflow.operators.metrics.trailing_average`` over a stream whose micro-batches come in order: (key, seq, at_us, average).

    Rows of one time are in one micro-batch.  The samples of one window are kept.
    """
    use_rocksdb(df.sparkSession)
    rows = df.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("double").alias("value"))
    out = T.StructType([df.schema[key], *T.StructType.fromDDL("seq long, at_us long, average double").fields])
    return rows.groupBy(key).transformWithState(_Trailing(key, window_us), out, "Append", "None")
