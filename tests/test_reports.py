"""Metrics, settings, logs, images."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import logs, metrics, tensors, vision
from tarnflow.operators.trees import tree_depths
from tarnflow.plans import config
from tarnflow.plans.pipeline import Apply, DropFrames, EveryNFrames, Pipeline, RunOnce


def test_trailing_window_is_half_open(spark):
    rows = [(0, 0, 10.0), (0, 2, 30.0), (0, 3, None), (0, 10, None), (0, 12, None)]
    df = spark.createDataFrame([(s, at * 1_000_000, v) for s, at, v in rows], "stream_id long, at_us long, v double")
    out = metrics.trailing_average(df, "a", F.col("v"), 10_000_000).orderBy("at_us").collect()
    assert [r.a for r in out] == [10.0, 20.0, 20.0, 30.0, None]


def test_connection_status_table(spark):
    rows = [(None, None, 0), (1, None, 2), (1, 3, 4), (1, None, 7), (3, 3, 4), (1, None, 6)]
    df = spark.createDataFrame([tuple(None if x is None else x * 1_000_000 for x in r) for r in rows], "ok long, bad long, now long")
    out = df.select(metrics.connection_status(F.col("ok"), F.col("bad"), F.col("now")).alias("s")).collect()
    assert [r.s for r in out] == ["wait", "ok", "failed", "stalled", "failed", "ok"]


def test_latest_pts_keeps_null(spark):
    rows = [(1, 0, True), (2, 99, False), (3, -7, True), (4, None, True)]
    df = spark.createDataFrame(rows, "at long, pts long, ok boolean")
    for upto, want in ((1, 0), (2, 0), (3, -7), (4, None)):
        assert df.where(F.col("at") <= upto).agg(metrics.latest(F.col("pts"), F.col("at"), F.col("ok")).alias("p")).first().p == want


def test_interval_without_frames_or_inferences(spark):
    df = spark.createDataFrame([(0, 0, 0.010), (0, 100_000, 0.020)], "stream_id long, at_us long, s double")
    row = metrics.interval_metrics(df, 1_000_000, F.col("s"), F.lit(None).cast("double")).first()
    assert (row.fps, row.avg_ms, row.inferences, row.inference_avg_ms) == (2.0, 15.0, 0, None)


def test_interval_between_frames_has_a_row(spark):
    df = spark.createDataFrame([(0, 0, 0.010), (0, 3_500_000, 0.020), (1, 9_000_000, 0.5)], "stream_id long, at_us long, s double")
    rows = metrics.interval_metrics(df, 1_000_000, F.col("s"), F.col("s")).orderBy("stream_id", "interval").collect()
    assert [(r.stream_id, r.interval, r.frames, r.fps, r.avg_ms, r.inference_avg_ms) for r in rows] == [
        (0, 0, 1, 1.0, 10.0, 10.0), (0, 1, 0, 0.0, 0.0, None), (0, 2, 0, 0.0, 0.0, None), (0, 3, 1, 1.0, 20.0, 20.0), (1, 9, 1, 1.0, 500.0, 500.0)
    ]


def test_geometry_clips(spark):
    df = spark.createDataFrame([(-3.0, -8.0, 21.0, 16.0)], "x1 double, y1 double, x2 double, y2 double")
    back = [vision.restore(F.col(c), 1 if c[0] == "x" else -2, 2.0 if c[0] == "x" else 3.0, 8.0 if c[0] == "x" else 4.0) for c in df.columns]
    assert list(df.select(*back).first()) == [0.0, 0.0, 8.0, 4.0]


def test_best_class_first_then_filter(spark):
    rows = [(0, [0.1, 0.9, 0.8]), (1, [0.1, 0.2, 0.25]), (2, [0.1, 0.2, 0.7])]
    df = spark.createDataFrame(rows, "cand_ix long, s array<double>")
    out = vision.select_candidates(df, F.col("s"), 0.25, [2]).collect()
    assert [(r.cand_ix, r.conf) for r in out] == [(2, 0.7)]
    assert vision.select_candidates(df, F.col("s"), 0.25, []).count() == 0


def test_nearest_score_ignores_blocks(spark):
    memory = spark.createDataFrame([([float(i), float(i % 7)],) for i in range(50)], "v array<double>")
    queries = spark.createDataFrame([(0, 0, [3.2, 1.0]), (0, 1, [60.0, 0.0]), (1, 0, [7.0, 0.0])], "image long, patch long, v array<double>")
    whole = {r.image: round(r.score, 9) for r in vision.nearest_score(queries, memory, image="image", patch="patch").collect()}
    parts = {r.image: round(r.score, 9) for r in vision.nearest_score(queries, memory, image="image", patch="patch", block=9).collect()}
    assert whole == parts and whole[1] == 0.0


def test_header_units(spark):
    df = spark.createDataFrame([("h264", "000001 67AA 000001 65 0000000168"), ("hevc", "0000000140 01 00000142 00000126")], "c string, h string")
    df = df.withColumn("b", F.unhex(F.replace("h", F.lit(" "), F.lit(""))))
    assert [r.u for r in df.select(tensors.header_units(F.col("c"), F.col("b")).alias("u")).collect()] == ["0000000167aa0000000168", "0000000140010000000142"]


def test_settings():
    assert config.resolve({"a": 1, "b": 2}, {"a": None}) == {"a": None, "b": 2}
    assert config.load("") == {} and config.load("A:\n  x: 1") == {"A": {"x": 1}}
    with pytest.raises(ValueError):
        config.load("A: 3")
    assert config.batch_settings(None, "torchscript") == (1, 0.0)
    assert config.batch_settings({"max_batch_wait_ms": 25}, "tensorrt") == (1, 0.025)
    with pytest.raises(ValueError):
        config.batch_settings({"profile_index": 1}, "tensorrt")
    for bad in ({"max_batch_wait_ms": 25}, {"max_batch_size": True, "max_batch_wait_ms": 1}, {"max_batch_size": 0, "max_batch_wait_ms": 1}, {"timeout": 1}):
        with pytest.raises(ValueError):
            config.batch_settings(bad, "torchscript")


def test_pipeline_sections_and_reload(spark):
    df = spark.createDataFrame([(0, i, i) for i in range(6)], "stream_id long, seq long, value long")
    once = RunOnce(Apply(lambda d: d.withColumn("value", F.col("value") - 1)))
    again = RunOnce(Apply(lambda d: d.withColumn("value", -F.col("value"))), fails="value < 2")
    assert sorted(r.value for r in again.apply(df).collect()) == [-2, 0, 1, 3, 4, 5]
    pipeline = Pipeline("p", {"DropFrames": {"keep_every": 2}}).step(DropFrames(1)).step(EveryNFrames({"value": "value * 10"}, interval_frames=2)).step(once)
    assert sorted(r.value for r in pipeline.run(df).collect()) == [-1, 2, 40]
    assert not pipeline.reload({"DropFrames": {"no_such": 1}}) and pipeline.steps[0].settings == {"keep_every": 2}
    assert pipeline.reload({}) and pipeline.steps[0].settings == {"keep_every": 1}
    with pytest.raises(ValueError):
        Pipeline("bad name")


def parts(text, chunk):
    """Line by line, bytes by bytes."""
    out = []
    lines = text.split("\n")
    for i, line in enumerate(lines[:-1] if lines[-1] == "" else lines):
        raw, at, part = line.encode(), 0, 0
        while True:
            end = min(len(raw), at + chunk)
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            out.append((i, part, raw[at:end].decode()))
            at, part = end, part + 1
            if at >= len(raw):
                break
    return out


def test_log_lines(spark):
    texts = ["ab\ncdefg\n", "", "a\n\n", "\n", "\n\nx", "é日本ab😀😀c\nß" * 3, "12345678"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for chunk in (4, 5, 7, 100):
        got = sorted((r.id, r.line, r.part, r.text) for r in logs.lines(df, "t", "id", chunk=chunk).collect())
        assert got == sorted((i, *x) for i, t in enumerate(texts) if t for x in parts(t, chunk))
        written = logs.written_lines(df.withColumn("thread", F.lit(1)), "t", thread="thread", order="id", chunk=chunk).collect()
        assert [(r.line, r.part, r.text) for r in written] == parts("".join(texts), chunk)


def test_names(spark):
    df = spark.createDataFrame([("abc\n",), ("a-b_C9",), ("",), ("x" * 65,), (None,)], "n string")
    assert [r.v for r in df.select(logs.valid_name(F.col("n")).alias("v")).collect()] == [False, True, False, False, False]
    backends = spark.createDataFrame([("a.b:C\n",), ("a.b:C",), ("patchcore",)], "n string")
    assert [r.v for r in backends.select(tensors.valid_backend(F.col("n")).alias("v")).collect()] == [False, True, True]


def test_payloads(spark):
    texts = ['{"a": {"b": {"c": {"d": {"e": 1}}}}}', "no { JSON", None, "[[[[[1]]]]]", '"x"', "", '{"b": 1, "a": null}']
    want = ['{"a": {"b": {"c": {"d": "{\'e\': 1}"}}}}', '"no { JSON"', None, '[[[["[1]"]]]]', '"x"', '""', '{"a": null, "b": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    assert [r.p for r in df.select("i", logs.safe_payload(F.col("t")).alias("p")).orderBy("i").collect()] == want


def test_equal_records_stay(spark):
    records = spark.createDataFrame([(1, "a", 30), (1, "a", 30), (2, "a.b", 5)], "id long, name string, level int")
    levels = spark.createDataFrame([("a", 10, False)], "name string, level int, disabled boolean")
    assert sorted((r.id, r.enabled) for r in logs.log_policy(records, levels, root=20).collect()) == [(1, True), (1, True), (2, False)]


def outline(box, height, width, thickness):
    if any(x is None or not math.isfinite(x) for x in box):
        return set()
    x1, y1, x2, y2 = (round(x) for x in box)
    if x2 < x1 or y2 < y1 or x2 < 0 or y2 < 0 or x1 >= width or y1 >= height:
        return set()
    x1, x2, y1, y2 = max(x1, 0), min(x2, width - 1), max(y1, 0), min(y2, height - 1)
    return {(y, x) for y in range(y1, y2 + 1) for x in range(x1, x2 + 1) if min(y - y1, y2 - y, x - x1, x2 - x) < thickness}


def test_outlines(spark):
    rng = random.Random(4)
    odd = [(float("inf"), 0.0, 5.0, 5.0), (float("nan"), 1.0, 2.0, 3.0), (None, 1.0, 2.0, 3.0), (-1e300, -1e300, 1e300, 1e300), (5.0, 5.0, 4.0, 6.0), (-3.0, -3.0, -1.0, -1.0), (0.5, 1.5, 2.5, 3.5)]
    boxes = odd + [tuple(rng.uniform(-6, 22) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "frame_id long, x1 double, y1 double, x2 double, y2 double")
    for thickness in (1, 3):
        got = sorted((r.frame_id, r.y, r.x) for r in vision.edge_mask(df, 12, 16, thickness).collect())
        assert got == sorted((i, *p) for i, b in enumerate(boxes) for p in outline(b, 12, 16, thickness))


def test_color_and_paint(spark):
    assert vision.yuv("#00ff00") == (145, 54, 34)
    pixels = spark.createDataFrame([(0, "y", 0, 0, 1), (0, "y", 1, 1, 2), (0, "u", 0, 0, 3), (0, "v", 0, 0, 4), (0, "v", 0, 1, 5)], "frame_id long, plane string, y long, x long, v int")
    mask = spark.createDataFrame([(0, 1, 1)], "frame_id long, y int, x int")
    got = {(r.plane, r.y, r.x): r.v for r in vision.paint(pixels, mask, "#00ff00").collect()}
    assert got == {("y", 0, 0): 1, ("y", 1, 1): 145, ("u", 0, 0): 54, ("v", 0, 0): 34, ("v", 0, 1): 5}


def test_model_outputs(spark):
    cases = ['"t"', '["a", {"x": "b"}]', '{"o": {"p": ["a", "b"]}, "q": 3}', "[]", '{"": "a"}', '{"a": null}', "{", None, '{"a/b": "x", "a": {"b": "y"}}']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, c string")
    got = [(r.o.outputs, r.o.error) for r in tensors.normalize_outputs(df, "o", F.col("c")).orderBy("i").collect()]
    assert got[:3] == [({"output0": "t"}, None), ({"output0": "a", "output1/x": "b"}, None), ({"o/p/output0": "a", "o/p/output1": "b", "q": "3"}, None)]
    assert all(outputs is None and error for outputs, error in got[3:])


def test_deep_json_ends_no_job(spark):
    deep = lambda n, core="5": "[" * n + core + "]" * n
    cases = [deep(3), deep(tensors.DEPTH), deep(tensors.DEPTH + 1), deep(900), deep(3000), deep(200_000), '{"x": ' * 500 + "1" + "}" * 500]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, c string")
    rows = tensors.encoded_bytes(tensors.normalize_outputs(df, "o", F.col("c")), "b", F.col("c"))
    got = rows.withColumn("p", logs.safe_payload(F.col("c"))).orderBy("i").collect()
    assert got[0].o.outputs == {"output0/output0/output0": "5"} and [len(r.o.outputs or {}) for r in got] == [1, 1, 0, 0, 0, 0, 0]
    assert [r.o.error.split(" at ")[0] for r in got[2:4]] == [f"more than {tensors.DEPTH} levels"] * 2 and got[4].o.error == "not JSON"
    assert [None if r.b is None else bytes(r.b) for r in got] == [b"\x05", b"\x05", b"\x05", None, None, None, None]
    assert all(r.p for r in got) and "MapInArrow" not in (plan := rows._jdf.queryExecution().toString()) and "ArrowEvalPython" not in plan


def test_bytes_of_answers(spark):
    cases = ['[1, 255]', "[1, 256]", "[1, true]", "[1.0]", "[]", '{"z": [1], "payload": [2], "data": "x", "packet": {"y": [3]}}', '[{"n": 1}, [[4], 5]]', '{"b": [6], "a": [7]}', '"[1]"', "7", None, "{"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, c string")
    got = [None if r.b is None else list(r.b) for r in tensors.encoded_bytes(df, "b", F.col("c")).orderBy("i").collect()]
    assert got == [[1, 255], None, None, None, [], [3], [4], [7], None, None, None, None]


def test_tree_depths(spark):
    nodes = [(0, None), (1, 0), (2, 1), (3, 2), (4, 3), (9, 8), (5, 6), (6, 7), (7, 5), (4, 3), (None, 1), (8, 77)]
    df = spark.createDataFrame(nodes, "id long, parent long")
    assert sorted(map(tuple, tree_depths(df).collect())) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]
    chain = spark.range(500).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert tree_depths(chain).where("id <> depth").count() == 0 and tree_depths(chain).count() == 500
    assert tree_depths(df.limit(0)).count() == 0
