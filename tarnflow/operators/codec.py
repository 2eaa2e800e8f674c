"""Decoders and encoders as state machines around a codec that plugs in.

A codec is an object with ``step(row) -> list`` and ``flush() -> list``, made by a factory once a
session.  Sessions, timestamps, recovery and metadata are kept here; the codec only turns rows into values.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from fractions import Fraction
from typing import Any, Protocol

from pyspark.sql import DataFrame

from tarnflow.operators.replay import Row, replay

#: Codecs that can be decoded, and the name each goes by.
CODECS = {"h264": "h264", "hevc": "hevc", "h265": "hevc"}


class Codec(Protocol):
    def step(self, row: Row) -> list: ...

    def flush(self) -> list: ...


class Decoder:
    """Packets of a stream to frames, 0 to n each; what the codec holds back comes at the stream's end.

    A row has ``key`` (a change begins a session), ``codec``, ``keyframe``, ``failed`` (the codec fails
    at it), ``pts``, ``num`` and ``den``.  A change and a failure make the codec anew: what it held back and
    the base are gone, and packets are passed over until a keyframe (not at the first session); a
    failing packet is consumed.  Frames carry times in the base of the first packet that a codec is shown,
    halves to even.  Packets without a base keep their times, and where the first has none all do.  Packets of
    other codecs, or with a base that is not positive, fail.
    """

    schema = "seq long, session long, frame string, pts long, num long, den long"

    def __init__(self, factory: Callable[[], Codec]) -> None:
        self.factory = factory

    def start(self) -> dict[str, Any]:
        return {"key": None, "session": -1, "codec": None, "base": None, "waits": False, "seq": None}

    def _rows(self, state: dict[str, Any], found: list) -> list[tuple]:
        base = state["base"]
        told = (None, None) if base is None else (base.numerator, base.denominator)
        return [(state["seq"], state["session"], frame, pts, *told) for frame, pts in found]

    def finish(self, state: dict[str, Any]) -> list[tuple]:
        return self._rows(state, state["codec"].flush()) if state["codec"] else []

    def step(self, state: dict[str, Any], row: Row) -> tuple[dict[str, Any], list[tuple]]:
        if (row["key"],) != state["key"]:
            state.update(waits=state["key"] is not None, key=(row["key"],), codec=None, base=None, session=state["session"] + 1)
        state["seq"] = row["seq"]
        if state["waits"] and not row["keyframe"]:
            return state, []
        timed = row["num"] is not None and row["den"] is not None
        usable = (row["codec"] or "").lower() in CODECS and (not timed or (row["num"] > 0 and row["den"] > 0))
        if row["failed"] or not usable:
            state.update(codec=None, base=None, waits=True)
            return state, []
        base = Fraction(row["num"], row["den"]) if timed else None
        if state["codec"] is None:
            state.update(codec=self.factory(), base=base)
        state["waits"] = False
        pts = row["pts"]
        if pts is not None and base is not None and state["base"] is not None:
            pts = round(pts * base / state["base"])
        return state, self._rows(state, state["codec"].step({**row, "pts": pts}))


class Encoder:
    """Frames of a stream to packets.

    A row has ``at_us``, ``key`` (of the picture's format), ``usable``, ``failed`` (the codec fails at
    it) and, with ``preserve``, ``pts``, ``num``, ``den`` and ``duration``.  A row that is not usable, or whose time
    cannot be preserved, is passed over.  Where the key changes, the codec is flushed under its own
    generation and a new one made.  After a failure what the codec held and all waiting times are gone,
    and rows are passed over for ``wait_us``.

    Packets get times that count them, in units of 1/``fps``, on and on; or, with ``preserve``, the times
    of the frames in order, and packets beyond them are dropped.  The first packet of a generation and
    each ``fps``-th after it is a keyframe.
    """

    schema = "seq long, generation long, packet string, pts long, num long, den long, duration long, keyframe boolean"

    def __init__(self, factory: Callable[[], Codec], fps: int = 30, wait_us: int = 1_000_000, preserve: bool = False) -> None:
        if isinstance(fps, bool) or not isinstance(fps, int) or fps < 1:
            raise ValueError("fps must be a positive integer")
        self.factory, self.fps, self.wait, self.preserve = factory, fps, wait_us, preserve

    def start(self) -> dict[str, Any]:
        return {"codec": None, "key": None, "generation": -1, "made": 0, "next": 0, "times": deque(), "retry": None, "seq": None}

    def _packets(self, state: dict[str, Any], found: list) -> list[tuple]:
        out = []
        for packet in found:
            if not packet or self.preserve and not state["times"]:
                continue
            pts, num, den, duration = state["times"].popleft() if self.preserve else (state["next"], 1, self.fps, 1)
            state["next"] += 1
            out.append((state["seq"], state["generation"], packet, pts, num, den, duration, state["made"] % self.fps == 0))
            state["made"] += 1
        return out

    def finish(self, state: dict[str, Any]) -> list[tuple]:
        return self._packets(state, state["codec"].flush()) if state["codec"] else []

    def _time(self, row: Row) -> tuple[int, int, int, int] | None:
        pts, num, den, duration = row["pts"], row["num"], row["den"], row["duration"] or 0
        known = pts is not None and -(2**63) < pts and (num or 0) > 0 and (den or 0) > 0 and duration >= 0
        return (pts, num, den, duration) if known else None

    def step(self, state: dict[str, Any], row: Row) -> tuple[dict[str, Any], list[tuple]]:
        time = self._time(row) if self.preserve else None
        if not row["usable"] or self.preserve and time is None:
            return state, []
        out: list[tuple] = []
        if state["codec"] and row["key"] != state["key"]:
            out = self.finish(state)
            state.update(codec=None, times=deque())
        state["seq"] = row["seq"]
        if state["codec"] is None:
            if state["retry"] is not None and row["at_us"] < state["retry"]:
                return state, out
            state.update(codec=self.factory(), key=row["key"], generation=state["generation"] + 1, made=0)
        if row["failed"]:
            state.update(codec=None, times=deque(), retry=row["at_us"] + self.wait)
            return state, out
        if self.preserve:
            state["times"].append(time)
        return state, out + self._packets(state, state["codec"].step(row))


def decode(packets: DataFrame, factory: Callable[[], Codec], *, stream: str = "stream_id") -> DataFrame:
    """(stream, seq, session, frame, pts, num, den); ``seq`` is of the packet at which a frame comes out.

    The codec gives pairs (frame, pts).
    """
    machine = Decoder(factory)
    return replay(packets, machine.step, machine.schema, start=machine.start, stream=stream, finish=machine.finish)


def encode(
    frames: DataFrame, factory: Callable[[], Codec], *, fps: int = 30, wait_us: int = 1_000_000, preserve: bool = False, stream: str = "stream_id"
) -> DataFrame:
    """(stream, seq, generation, packet, pts, num, den, duration, keyframe); see ``Encoder``."""
    machine = Encoder(factory, fps, wait_us, preserve)
    return replay(frames, machine.step, machine.schema, start=machine.start, stream=stream, finish=machine.finish)
