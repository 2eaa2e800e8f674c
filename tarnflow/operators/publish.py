"""A terminal output as a state machine over packets: what is sent, skipped or refused, and with which decoding time."""

from __future__ import annotations

from fractions import Fraction
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.replay import Row, replay

#: What makes an output a new one; fixed by the stream's settings.
KEY = ("connection_id", "stream_index", "codec", "width", "height", "extradata", "stream_base")


def valid_packet(discard: Column, trusted: Column, disposable: Column, num: Column, den: Column) -> Column:
    """Whether a packet can be copied to an output: none of the flags, and a positive time base; null flags are not set."""
    flagged = F.lit(False)
    for flag in (discard, trusted, disposable):
        flagged = flagged | F.coalesce(flag, F.lit(False))
    return ~flagged & F.coalesce((num > 0) & (den > 0), F.lit(False))


class Publisher:
    """The output of one stream.

    A row has ``at_us``, ``key`` (of the output), ``valid``, ``opens`` and ``writes`` (whether the
    output could be opened and written to), ``dts``, ``pts``, ``duration``, ``num`` and ``den``.  Its outcome:

    ``sent``     written, with its decoding time: its own, else its ``pts``, else that of the packet sent
                 last, in its own base and rounded down, and its duration (1 if it has none), else 0;
    ``late``     not after the packet sent last, in real time; the output stays;
    ``bad``      not valid: the output is closed, and what was sent last no longer counts;
    ``failed``   the output could not be opened or written to: it is closed, what was sent last still counts;
    ``skipped``  the output is closed and ``wait_us`` have not passed since it failed.

    Where the key changes, the output is opened anew and what was sent last no longer counts; a wait goes on.
    """

    schema = "seq long, outcome string, dts long"

    def __init__(self, wait_us: int = 3_000_000) -> None:
        self.wait = wait_us

    def start(self) -> dict[str, Any]:
        return {"open": False, "key": None, "last": None, "retry": None}

    def _fill(self, row: Row, base: Fraction, last: Fraction | None) -> int:
        if row["dts"] is not None:
            return row["dts"]
        if row["pts"] is not None:
            return row["pts"]
        if last is None:
            return 0
        return last // base + (row["duration"] if (row["duration"] or 0) > 0 else 1)

    def _one(self, state: dict[str, Any], row: Row) -> tuple[str, int | None]:
        key = (row["key"],)
        if key != state["key"]:
            state.update(open=False, key=key, last=None)
        if not state["open"]:
            if state["retry"] is not None and row["at_us"] < state["retry"]:
                return "skipped", None
            if not row["opens"]:
                state["retry"] = row["at_us"] + self.wait
                return "failed", None
            state["open"] = True
        if not row["valid"]:
            state.update(open=False, key=None, last=None, retry=row["at_us"] + self.wait)
            return "bad", None
        base = Fraction(row["num"], row["den"])
        dts = self._fill(row, base, state["last"])
        if state["last"] is not None and dts * base <= state["last"]:
            return "late", None
        if not row["writes"]:
            state.update(open=False, retry=row["at_us"] + self.wait)
            return "failed", None
        state["last"] = dts * base
        return "sent", dts

    def step(self, state: dict[str, Any], row: Row) -> tuple[dict[str, Any], list[tuple]]:
        outcome, dts = self._one(state, row)
        return state, [(row["seq"], outcome, dts)]


def publish_packets(packets: DataFrame, wait_us: int = 3_000_000, *, stream: str = "stream_id") -> DataFrame:
    """(stream, seq, outcome, dts) of every packet, in order of ``seq``; see ``Publisher``."""
    machine = Publisher(wait_us)
    return replay(packets, machine.step, machine.schema, start=machine.start, stream=stream)
