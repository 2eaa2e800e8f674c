"""Publishing, decoding, encoding: the cases, row by row."""

from tarnflow.operators import codec, publish, replay
from tarnflow.operators.codec import Decoder, Encoder


def run(machine, rows):
    state, out = machine.start(), []
    for row in rows:
        state, made = machine.step(state, row)
        out += made
    return out + (machine.finish(state) if hasattr(machine, "finish") else [])


def packet(seq, **given):
    row = {"seq": seq, "at_us": seq, "key": 0, "valid": True, "opens": True, "writes": True, "dts": None, "pts": None, "duration": None, "num": 1, "den": 90000}
    return {**row, **given}


def sent(rows, wait=10):
    return [(s, o, d) for s, o, d in run(publish.Publisher(wait), rows)]


def test_publish_gate_and_fill():
    rows = [packet(i, dts=d) for i, d in enumerate([9000, 9000, 6000, 8000, 12000])]
    assert [d for _, o, d in sent(rows) if o == "sent"] == [9000, 12000]
    rows = [packet(0, dts=9000), packet(1, dts=100, den=1000), packet(2, dts=99, den=1000), packet(3, dts=101, den=1000)]
    assert [(s, d) for s, o, d in sent(rows) if o == "sent"] == [(0, 9000), (3, 101)]
    assert [d for _, _, d in sent([packet(0, dts=0), packet(1, duration=3000)])] == [0, 3000]
    assert [d for _, _, d in sent([packet(0), packet(1), packet(2, pts=7)])] == [0, 1, 7]


def test_publish_resets():
    # a new key and bad input forget what was sent last, a failed write does not
    assert [o for _, o, _ in sent([packet(0, dts=50), packet(1, dts=10, key=1), packet(2, dts=5, key=1)])] == ["sent", "sent", "late"]
    rows = [packet(0, dts=50), packet(1, dts=60, valid=False), packet(2, dts=70), packet(11, dts=10)]
    assert [o for _, o, _ in sent(rows)] == ["sent", "bad", "skipped", "sent"]
    rows = [packet(0, dts=50), packet(1, dts=60, writes=False), packet(5, dts=70), packet(11, dts=40), packet(12, dts=60)]
    assert [o for _, o, _ in sent(rows)] == ["sent", "failed", "skipped", "late", "sent"]
    assert [o for _, o, _ in sent([packet(0, opens=False), packet(3), packet(10, dts=1)])] == ["failed", "skipped", "sent"]


class Held:
    """Gives a value some rows later."""

    def __init__(self, delay, make):
        self.delay, self.make, self.waiting = delay, make, []

    def step(self, row):
        self.waiting += self.make(row)
        out, self.waiting = self.waiting[: -self.delay or None], self.waiting[-self.delay :] if self.delay else []
        return out

    def flush(self):
        out, self.waiting = self.waiting, []
        return out


def frame(seq, **given):
    row = {"seq": seq, "at_us": seq * 1_000_000, "key": 0, "usable": True, "failed": False, "pts": seq * 100, "num": 1, "den": 90000, "duration": 0}
    return {**row, **given}


def test_generated_times_count_packets():
    machine = Encoder(lambda: Held(1, lambda r: [f"p{r['seq']}"]), fps=30)
    out = run(machine, [frame(0), frame(1), frame(2, key=1)])
    assert [(p, pts, num, den, dur) for _, _, p, pts, num, den, dur, _ in out] == [("p0", 0, 1, 30, 1), ("p1", 1, 1, 30, 1), ("p2", 2, 1, 30, 1)]
    # the held packet of the first generation comes at the change, under its own generation, and each begins with a keyframe
    assert [(seq, generation, key) for seq, generation, *_, key in out] == [(1, 0, True), (1, 0, False), (2, 1, True)]


def test_preserved_times():
    straight = lambda: Held(0, lambda r: [f"p{r['seq']}"])
    given = [frame(0, pts=-3000, duration=3000), frame(1, pts=0, duration=3000), frame(2, pts=9000, duration=3000)]
    assert [(p, d) for _, _, _, p, _, _, d, _ in run(Encoder(straight, preserve=True), given)] == [(-3000, 3000), (0, 3000), (9000, 3000)]
    bad = [frame(0, pts=None), frame(1, den=0), frame(2, duration=-1), frame(3, num=None), frame(4, pts=9000)]
    assert [x[3] for x in run(Encoder(straight, preserve=True), bad)] == [9000]
    two = Encoder(lambda: Held(0, lambda r: ["a", "b"]), preserve=True)
    assert [(x[2], x[3]) for x in run(two, [frame(0, pts=100)])] == [("a", 100)]


def test_recovery_clears_what_waits():
    machine = Encoder(lambda: Held(1, lambda r: [f"p{r['seq']}"]), preserve=True)
    out = run(machine, [frame(0, pts=100), frame(1, pts=200, failed=True, at_us=500_000), frame(2, pts=300, at_us=900_000), frame(3, pts=9000, at_us=1_500_000)])
    assert [(x[2], x[3]) for x in out] == [("p3", 9000)]


def test_decoder_sessions():
    machine = Decoder(lambda: Held(1, lambda r: [(f"f{r['seq']}", r["pts"])]))
    row = lambda seq, **x: {"seq": seq, "key": 0, "codec": "h264", "keyframe": False, "failed": False, "pts": seq * 10, "num": 1, "den": 40, **x}
    rows = [row(0), row(1, den=25), row(2, failed=True), row(3), row(4, keyframe=True), row(5, key=1, keyframe=True, codec="HEVC"), row(6, key=1), row(7, key=1, codec="vp9", keyframe=True)]
    out = run(machine, rows)
    # what is held goes with a failure and with a change of the stream
    assert [(s, session, f, pts) for s, session, f, pts, _, _ in out] == [(1, 0, "f0", 0), (6, 1, "f5", 50)]
    assert codec.CODECS["h265"] == "hevc"


def test_decoder_bases():
    straight = Decoder(lambda: Held(0, lambda r: [(f"f{r['seq']}", r["pts"])]))
    row = lambda seq, pts, den, **x: {"seq": seq, "key": 0, "codec": "h264", "keyframe": True, "failed": False, "pts": pts, "num": None if den is None else 1, "den": den, **x}
    # 10 at 1/25 is 16 at 1/40; a failure forgets the base, so 100 at 1/50 stays
    out = run(straight, [row(0, 0, 40), row(1, 10, 25), row(2, 1, 25, failed=True), row(3, 100, 50), row(4, 1, 25)])
    assert [(f, pts, den) for _, _, f, pts, _, den in out] == [("f0", 0, 40), ("f1", 16, 40), ("f3", 100, 50), ("f4", 2, 50)]
    # without a base times stay as they are; a base of 0 is a failure, after which the next packet's is the session's
    out = run(straight, [row(0, 7, None), row(1, 10, 25), row(2, 5, 0), row(3, 8, 10), row(4, 9, None), row(5, None, 10)])
    assert [(f, pts, den) for _, _, f, pts, _, den in out] == [("f0", 7, None), ("f1", 10, None), ("f3", 8, 10), ("f4", 9, 10), ("f5", None, 10)]


def outcomes(limit, rows):
    step, state, out = replay.deadline(limit), None, []
    for row in rows:
        state, made = step(state, row)
        out += made
    return [(o, e) for _, o, e in out]


def test_deadline_outcomes():
    row = lambda at, **x: {"seq": at, "at_us": at, **x}
    assert outcomes(10, [row(0, service_us=5, dropped=True), row(20, service_us=5)]) == [("dropped", False), ("completed", True)]
    # the second stage would start at the deadline: it is left out and the slot is free again then
    assert outcomes(10, [row(0, stages_us=[10, 50]), row(10, stages_us=[1, 1])]) == [("partial", True), ("completed", True)]
    assert outcomes(10, [row(0, stages_us=[12, 50]), row(11, stages_us=[1, 1]), row(13, stages_us=[1, 1])]) == [("partial", False), ("busy", True), ("completed", True)]
    # done late, but by the time of the check
    assert outcomes(10, [row(0, service_us=12, check_us=3)]) == [("timeout", True)]
    # an input's release counts for a single stage, a frame's always
    assert outcomes(10, [row(0, stages_us=[3, 50], released_after_us=1)]) == [("timeout", False)]
    assert outcomes(10, [row(0, stages_us=[3, 50], frame_released_after_us=1)]) == [("timeout", True)]
    assert outcomes(10, [row(0, service_us=50, released_after_us=1)]) == [("timeout", True)]
    # a fatal row ends the stream once it is done
    assert outcomes(10, [row(0, service_us=5, fatal=True), row(6, service_us=1)]) == [("fatal", False), ("ended", False)]
    assert outcomes(10, [row(0, service_us=30, fatal=True), row(12, service_us=1), row(31, service_us=1)]) == [("timeout", False), ("busy", True), ("ended", False)]


def test_queue_of_thirty_and_events():
    queue = replay.DropOldest()
    rows = [{"seq": i, "at_us": 0, "service_us": 10} for i in range(40)]
    out = run(queue, rows)
    assert [x[0] for x in out] == [0, *range(10, 40)] and out[-1][2] == 9
    rows = [{"seq": i, "at_us": i, "service_us": 100} for i in range(4)]
    assert [(s, d) for s, _, d in run(queue, [*rows, {"seq": 4, "at_us": 5, "discard": True}, {"seq": 5, "at_us": 6, "service_us": 1}])] == [(0, 0), (5, 3)]
    # an error comes before what waits, and nothing after it
    assert [s for s, _, _ in run(queue, [*rows, {"seq": 4, "at_us": 5, "failed": True}, {"seq": 5, "at_us": 6, "service_us": 1}])] == [0, 4]
