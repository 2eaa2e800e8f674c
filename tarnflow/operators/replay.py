"""State machines over an ordered stream, written once as ``step(state, row) -> (state, values)``.

A batch deals rows by stream, sorts each part and runs through it: state is that of one stream at a
time, so a long stream needs no more memory than a short one.  A streaming query keeps the state of
each stream in the state store (``tarnflow.streaming.stateful``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnflow.operators.scan import count, scan, top

Row = dict[str, Any]
Step = Callable[[Any, Row], tuple[Any, list[tuple]]]
Finish = Callable[[Any], list[tuple]]


def replay(
    df: DataFrame, step: Step, schema: str, *, start: Callable[[], Any], stream: str = "stream_id", order: tuple[str, ...] = ("seq",), finish: Finish | None = None
) -> DataFrame:
    """The rows that ``step`` gives, with the stream's id before them.

    A stream's rows come in ``order`` (nulls first, equal ones in any order).  Rows of a null id are one
    stream.  An empty table gives no rows.
    """
    out = T.StructType([df.schema[stream], *T.StructType.fromDDL(schema).fields])
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, nothing = None, None, True

        def ended() -> list[tuple]:
            return [] if nothing or finish is None else [(now, *x) for x in finish(state)]

        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                if nothing or row[stream] != now:
                    rows += ended()
                    now, state, nothing = row[stream], start(), False
                state, made = step(state, row)
                rows += [(now, *x) for x in made]
            yield _batch(rows, kinds)
        yield _batch(ended(), kinds)

    return df.repartition(stream).sortWithinPartitions(stream, *order).mapInArrow(run, out)


def replay_runs(
    df: DataFrame, step: Step, schema: str, ends: Column, *, start: Callable[[], Any], stream: str = "stream_id", at: str = "at_us", order: tuple[str, ...] = ("seq",), slices: str | None = None
) -> DataFrame:
    """``replay`` for steps whose state is as at the start once all that earlier rows began has ended: the parts of one
    stream between such gaps are run through apart, so a stream is as many tasks as it has gaps.

    ``ends`` is when what a row may begin has ended at the latest; ``order`` must go with ``at``.  A row at or after the
    ends of all before it begins a part.
    """
    how = {"keys": (stream,), "order": order, "slices": slices}
    rows = scan(df, {"__busy": top(ends)}, **how, own=False)
    begins = F.col("__busy").isNull() | (F.col(at) >= F.col("__busy"))
    rows = scan(rows.withColumn("__begins", begins), {"__part": count(F.col("__begins"))}, **how)
    keyed = rows.withColumn("__run", F.struct(F.col(stream).alias("stream"), "__part")).drop("__busy", "__begins", "__part")
    found = replay(keyed, step, schema, start=start, stream="__run", order=order)
    return found.select(F.col("__run.stream").alias(stream), *[c for c in found.columns if c != "__run"])


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def busy_skip(free: int | None, row: Row) -> tuple[int | None, list[tuple]]:
    """A side worker takes a row only when idle; every row goes on."""
    taken = free is None or row["at_us"] >= free
    return (row["at_us"] + row["service_us"] if taken else free), [(row["seq"], taken)]


def deadline(limit_us: int) -> Step:
    """One slot with a deadline a row: outcome, and whether a row comes out.

    ``busy``       the slot is taken: the row passes as it is;
    ``completed``  done in time: its result comes out;
    ``error``      failed in time: the row passes as it is;
    ``dropped``    done in time, and the result is that nothing comes out;
    ``timeout``    not done in time: dropped, unless its input was released or it was done by the time
                   of the check, ``check_us`` after the deadline;
    ``partial``    of several ``stages_us``, those that would start at the deadline or later were left out;
    ``fatal``      the stream ends: once a fatal row is done no row comes out, and later ones are ``ended``.

    A row has ``at_us``, ``service_us`` or ``stages_us``, and may have ``failed``, ``dropped``,
    ``fatal``, ``check_us``, ``released_after_us`` (which counts for a single stage only) and
    ``frame_released_after_us``.
    """

    def step(state: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
        clock, free, dies = state or (row["at_us"], row["at_us"], None)
        clock = max(clock, row["at_us"])
        if dies is not None and clock >= dies:
            return (clock, free, dies), [(row["seq"], "ended", False)]
        if clock < free:
            return (clock, free, dies), [(row["seq"], "busy", True)]
        stages = row.get("stages_us") or [row["service_us"]]
        last = clock + limit_us
        done, ran = clock, 0
        for service in stages:
            if ran and done >= last:
                break
            done, ran = done + service, ran + 1
        whole = ran == len(stages)
        fatal = whole and row.get("fatal")
        if fatal:
            dies = done
        if done <= last:
            kind = "partial" if not whole else "fatal" if fatal else "error" if row.get("failed") else "dropped" if row.get("dropped") else "completed"
            return (done, done, dies), [(row["seq"], kind, kind not in ("fatal", "dropped"))]
        check = last + (row.get("check_us") or 0)
        if fatal and done <= check:
            return (check, done, dies), [(row["seq"], "fatal", False)]
        released = [row.get("frame_released_after_us"), row.get("released_after_us") if len(stages) == 1 else None]
        emitted = done <= check or any(x is not None and clock + x <= check for x in released)
        return (check, done, dies), [(row["seq"], "timeout" if whole else "partial", emitted)]

    return step


def back_off(wait_us: int) -> Step:
    """After a failure, rows within ``wait_us`` are skipped; outcome."""

    def step(state: tuple[int | None, bool], row: Row) -> tuple[tuple[int | None, bool], list[tuple]]:
        retry, open_ = state
        if not open_ and retry is not None and row["at_us"] < retry:
            return state, [(row["seq"], "skipped")]
        if row["failed"]:
            return (row["at_us"] + wait_us, False), [(row["seq"], "failed")]
        return (retry, True), [(row["seq"], "sent")]

    return step


def chained_dts(last: tuple[int, int, int] | None, row: Row) -> tuple[tuple[int, int, int] | None, list[tuple]]:
    """Missing decoding times go on from the last sent packet; rows not after it are dropped."""
    num, den = row["num"], row["den"]
    dts = row["dts"] if row["dts"] is not None else row["pts"]
    if dts is None:
        step = row["duration"] if row["duration"] and row["duration"] > 0 else 1
        dts = last[0] * last[1] * den // (last[2] * num) + step if last else 0
    if last and dts * num * last[2] <= last[0] * last[1] * den:
        return last, []
    return (dts, num, den), [(row["seq"], dts)]


class DropOldest:
    """A queue of ``size`` before one consumer; when full, the oldest waiting row is dropped.

    A row may be an event: ``discard`` drops all that wait; ``failed`` ends the queue: its consumer
    gets the error next, before any row that waits, and nothing after it.  Rows that come out carry
    how many were dropped before.
    """

    def __init__(self, size: int = 30) -> None:
        self.size = size

    def start(self) -> dict[str, Any]:
        return {"free": None, "waiting": deque(), "dropped": 0, "ended": False}

    def _take(self, state: dict[str, Any], until: int | None) -> list[tuple]:
        out = []
        while state["waiting"]:
            seq, at, service = state["waiting"][0]
            begin = at if state["free"] is None else max(state["free"], at)
            if until is not None and begin > until:
                break
            state["waiting"].popleft()
            state["free"] = begin + service
            out.append((seq, begin, state["dropped"]))
        return out

    def step(self, state: dict[str, Any], row: Row) -> tuple[dict[str, Any], list[tuple]]:
        if state["ended"]:
            return state, []
        out = self._take(state, row["at_us"])
        if row.get("failed"):
            state["ended"] = True
            state["waiting"].clear()
            return state, [*out, (row["seq"], max(row["at_us"], state["free"] or row["at_us"]), state["dropped"])]
        if row.get("discard"):
            state["dropped"] += len(state["waiting"])
            state["waiting"].clear()
            return state, out
        if len(state["waiting"]) == self.size:
            state["waiting"].popleft()
            state["dropped"] += 1
        state["waiting"].append((row["seq"], row["at_us"], row["service_us"]))
        return state, out

    def finish(self, state: dict[str, Any]) -> list[tuple]:
        return self._take(state, None)


class Batcher:
    """Batches of one key by size and wait: rows of another key are put off and seed later batches.

    Rows come in order of arrival.  A batch is decided once every row that it could pull is known,
    that is, when a row arrives after it, or at the end.
    """

    def __init__(self, size: int, wait_us: int, service_us: int) -> None:
        self.size, self.wait, self.service = size, wait_us, service_us

    def start(self) -> dict[str, Any]:
        return {"free": None, "put_off": deque(), "queue": deque(), "batch": 0, "due": None}

    def advance(self, state: dict[str, Any], known_to: int | None) -> list[tuple]:
        """The batches that are decided once every row before ``known_to`` is known; ``None``: every row.

        ``state["due"]`` is then the time after which the next one is, or null if nothing waits.
        """
        out: list[tuple] = []
        while (batch := self._form(state, known_to)) is not None:
            out += batch
        return out

    def _form(self, state: dict[str, Any], known_to: int | None) -> list[tuple] | None:
        put_off, queue = state["put_off"], state["queue"]
        state["due"] = None
        if not put_off and not queue:
            return None
        seed = put_off[0] if put_off else queue[0]
        now = seed[1] if state["free"] is None else max(state["free"], seed[1])
        last = seed[1] + self.wait
        members, passed, i = [seed], [], 0 if put_off else 1
        pulled = i
        while len(members) < self.size:
            if i == len(queue):
                if known_to is not None and known_to <= max(now, last):
                    state["due"] = max(now, last)
                    return None  # a row that is still to come may belong to it
                break
            row = queue[i]
            if row[1] > max(now, last):
                break
            now = max(now, row[1])
            (members if row[2] == seed[2] else passed).append(row)
            i += 1
            pulled = i
        if len(members) < self.size:
            now = max(now, last)
        if put_off:
            put_off.popleft()
        for _ in range(pulled):
            queue.popleft()
        put_off.extend(passed)
        state["free"] = now + self.service
        state["batch"] += 1
        return [(seq, state["batch"] - 1, place, now) for place, (seq, _, _) in enumerate(members)]

    def step(self, state: dict[str, Any], row: Row) -> tuple[dict[str, Any], list[tuple]]:
        state["queue"].append((row["seq"], row["at_us"], row["key"]))
        return state, self.advance(state, row["at_us"])

    def finish(self, state: dict[str, Any]) -> list[tuple]:
        return self.advance(state, None)
