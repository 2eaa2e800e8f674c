"""Options of the vision steps, and a frame from pixels to boxes."""

import numpy as np
import pytest

from tarnflow.operators import images, vision
from tarnflow.plans.pipeline import Pipeline
from tarnflow.plans.vision_steps import Inference, PostProcess, PreProcess


@pytest.mark.parametrize(
    "bad",
    [
        {"size": (0, 4)}, {"size": 4}, {"resize_mode": "other"}, {"auto": 1}, {"stride": True}, {"auto": True, "resize_mode": "stretch"},
        {"crop_size": (4, 4)}, {"crop_size": (900, 4), "resize_mode": "resize_center_crop"}, {"padding_value": 256}, {"std": 0},
        {"scale": float("nan")}, {"input_name": " "}, {"no_such": 1},
    ],
)
def test_preprocess_refuses(bad):
    with pytest.raises(ValueError):
        PreProcess(**bad)


@pytest.mark.parametrize("bad", [{"confidence": 1.5}, {"iou": True}, {"classes": [2]}, {"classes": (0,)}, {"max_det": 0}, {"output_name": ""}, {"end2end": 0}])
def test_postprocess_refuses(bad):
    with pytest.raises(ValueError):
        PostProcess(["car", "person"], **bad)


def test_refused_settings_leave_the_old_ones():
    step = PreProcess(size=(12, 16))
    with pytest.raises(ValueError):
        step.configure({"stride": 0})
    assert step.settings["stride"] == 32 and step.settings["size"] == (12, 16)


def test_frame_to_boxes(spark):
    rows = [(0, 0, 4, 8, 8.0, 6.0, 8.0, 4.0, [0.9, 0.1]), (0, 1, 4, 8, 8.2, 6.0, 8.0, 4.0, [0.8, 0.1]), (0, 2, 4, 8, 3.0, 5.0, 2.0, 2.0, [0.2, 0.7])]
    df = spark.createDataFrame(rows, "frame_id long, cand_ix long, height int, width int, cx double, cy double, w double, h double, scores array<double>")
    pipeline = Pipeline("p", {"PostProcess": {"confidence": 0.5}}).step(PreProcess(size=(12, 16))).step(PostProcess(["car", "person"]))
    out = sorted(tuple(r) for r in pipeline.run(df).collect())
    assert out == [(0, 0, 2.0, 1.0, 6.0, 3.0, 0.9, 0, "car"), (0, 2, 1.0, 1.0, 2.0, 2.0, 0.7, 1, "person")]


def test_pixels_become_input(spark):
    df = spark.createDataFrame([(1, 2, bytearray([255, 0, 51, 0, 255, 102]))], "height int, width int, pixels binary")
    step = PreProcess(size=(1, 2), input_name="images", mean=0.5, std=0.5, color_order="bgr")
    row = step.apply(df).first()
    assert row.input_shape == [1, 3, 1, 2] and row.transform.ratio_x == 1.0
    assert [round(x, 5) for x in row.model_input["images"]] == [-0.6, -0.2, -1.0, 1.0, 1.0, -1.0]
    each = PreProcess(size=(1, 2), mean=(0, 1, 0), std=(1, 2, 4), scale=1.0, layout="nhwc", dtype="float16").apply(df).first()
    assert each.input_shape == [1, 1, 2, 3] and each.model_input[""] == [255.0, -0.5, 12.75, 0.0, 127.0, 25.5]


def test_inference_passes_what_fails(spark):
    class Sum:
        """Sums values; some rows it cannot take, and after one it is of no use."""

        def __init__(self):
            self.broken = False

        def __call__(self, rows):
            if self.broken:
                raise AssertionError("a model that failed was called again")
            if rows["x"].isna().any():
                self.broken = True
                raise ValueError("no value")
            return rows["x"] * 2

    rows = [(0, 1.0, {"images": ("float32", [1, 3])}), (1, None, {"images": ("float32", [1, 3])}), (2, 3.0, {"images": ("float32", [2, 3])}), (3, 4.0, {" ": ("float32", [1])}), (4, 5.0, None)]
    df = spark.createDataFrame(rows, "i int, x double, inputs map<string,struct<dtype:string,shape:array<long>>>").coalesce(1)
    out = Inference("/models/a.engine", lambda path, gpu, profile: Sum(), batch=True).apply(df).orderBy("i").collect()
    assert [(r.model_id, r.model_output) for r in out] == [("a.engine", 2.0), *[("a.engine", None)] * 4]
    alone = Inference("m\\b.pt", lambda path, gpu, profile: Sum(), backend="torchscript", id="mine").apply(df.drop("inputs")).orderBy("i").collect()
    assert [(r.model_id, r.model_output) for r in alone] == [("mine", x) for x in (2.0, None, 6.0, 8.0, 10.0)]

    def lost(path, gpu, profile):
        def call(rows):
            raise RuntimeError("CUDA error: lost")

        return call

    with pytest.raises(Exception, match="CUDA error"):
        Inference("a", lost).apply(df).collect()
    for bad in ({"backend": "nothing"}, {"profile_index": 1, "backend": "torchscript"}, {"gpu_id": -1}, {"id": " "}, {"batch": 1}):
        with pytest.raises(ValueError):
            Inference("a", lost, **bad)


GEOMETRY = [
    ({}, (2.0, 2.0, 2, 0, 12, 16)),
    ({"center": False}, (2.0, 2.0, 0, 0, 12, 16)),
    ({"auto": True, "stride": 4}, (2.0, 2.0, 0, 0, 8, 16)),
    ({"resize_mode": "stretch"}, (3.0, 2.0, 0, 0, 12, 16)),
    ({"resize_mode": "resize_center_crop"}, (3.0, 3.0, 0, -4, 12, 16)),
    ({"resize_mode": "resize_center_crop", "crop_size": (10, 10)}, (3.0, 3.0, -1, -7, 10, 10)),
    ({"scaleup": False}, (1.0, 1.0, 4, 4, 12, 16)),
]


@pytest.mark.parametrize("options,want", GEOMETRY)
def test_geometry_of_pixels_and_columns(spark, options, want):
    """A frame of 4 x 8 brought to (12, 16), with and without its pixels."""
    df = spark.createDataFrame([(4, 8, bytearray(range(96)))], "height int, width int, pixels binary")
    step = PreProcess(size=(12, 16), **options)
    t = step.apply(df).first().transform
    assert (t.ratio_y, t.ratio_x, t.top, t.left, t.height, t.width) == want
    c = step.apply(df.drop("pixels")).first().transform
    assert (c.ratio_y, c.ratio_x, c.top, c.left) == want[:4]


def test_padding_and_cut():
    image = np.arange(96, dtype=float).reshape(3, 4, 8)
    out = images.place(image, {"new_h": 4, "new_w": 8, "top": 1, "left": 0}, (6, 8), (1, 2, 3))
    assert out.shape == (3, 6, 8) and np.array_equal(out[:, 1:5], image)
    assert np.array_equal(out[:, [0, 5]], np.broadcast_to(np.array([1.0, 2, 3])[:, None, None], (3, 2, 8)))
    cut = images.place(image, {"new_h": 4, "new_w": 8, "top": 0, "left": -2}, (4, 4))
    assert np.array_equal(cut, image[:, :, 2:6])


def test_prepared_pixels(spark):
    """The same by the step: padded above and below, and cut on both sides."""
    df = spark.createDataFrame([(4, 8, bytearray(range(96)))], "height int, width int, pixels binary")
    image = np.arange(96, dtype=float).reshape(4, 8, 3).transpose(2, 0, 1)
    plain = {"scale": 1.0}
    row = PreProcess(size=(6, 8), padding_value=7, **plain).apply(df).first()
    got = np.array(row.model_input[""]).reshape(row.input_shape)[0]
    assert np.array_equal(got[:, 1:5], image) and (got[:, [0, 5]] == 7).all()
    row = PreProcess(size=(4, 4), resize_mode="resize_center_crop", **plain).apply(df).first()
    assert np.array_equal(np.array(row.model_input[""]).reshape(row.input_shape)[0], image[:, :, 2:6])


def test_bilinear_by_points():
    image = np.random.default_rng(0).random((1, 5, 7))
    out = images.place(np.repeat(image, 3, axis=0), {"new_h": 8, "new_w": 3, "top": 0, "left": 0}, (8, 3))
    for y in range(8):
        for x in range(3):
            sy, sx = (min(max((i + 0.5) * n / m - 0.5, 0), n - 1) for i, n, m in ((y, 5, 8), (x, 7, 3)))
            (b, fy), (a, fx) = divmod(sy, 1), divmod(sx, 1)
            at = lambda i, j: image[0, min(int(i), 4), min(int(j), 6)]  # noqa: B023, E731
            want = (1 - fy) * ((1 - fx) * at(b, a) + fx * at(b, a + 1)) + fy * ((1 - fx) * at(b + 1, a) + fx * at(b + 1, a + 1))
            assert abs(out[0, y, x] - want) < 1e-12


def test_unusable_frames_are_dropped(spark):
    rows = [
        (0, 4, 4, bytearray(24), "NV12", None), (1, 4, 4, bytearray(23), "nv12", None), (2, 3, 4, bytearray(18), "nv12", None), (3, 4, 4, bytearray(36), "nv12", 6),
        (4, 4, 4, None, "rgb", None), (5, 4, 4, bytearray(48), "bgr", None), (6, 4, 4, bytearray(20), "nv12", 3),
    ]
    df = spark.createDataFrame(rows, "i int, height int, width int, pixels binary, pixel_format string, pitch int")
    assert sorted(r.i for r in PreProcess(size=(4, 4)).apply(df).collect()) == [0, 3, 5]
    for bad in ((4, 4, bytearray(47), "rgb"), (4, 4, bytearray(48), "gray")):
        with pytest.raises(Exception, match="rgb of|no format"):
            PreProcess(size=(4, 4)).apply(spark.createDataFrame([bad], "height int, width int, pixels binary, pixel_format string")).collect()


def test_nv12_by_columns_and_arrays(spark):
    raw = np.random.default_rng(1).integers(0, 256, 6 * 8).astype(np.uint8)
    image = images.nv12_to_rgb(images.planes(raw, "nv12", 4, 6, 8))
    df = spark.createDataFrame([(raw.tolist(), 4, 6, 8)], "b array<int>, height int, width int, pitch int")
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in vision.nv12_pixels(df, "b", pitch="pitch").collect()}
    assert len(got) == 24 and all(np.allclose(got[y, x], image[:, y, x]) for y, x in got)


def greedy(boxes, iou, most):
    """Kept boxes by a plain loop; a box is (tie, cls, conf, x1, y1, x2, y2)."""
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[2], b[0])):
        def over(o, b=b):
            w, h = (max(0.0, min(b[5 + i], o[5 + i]) - max(b[3 + i], o[3 + i])) for i in (0, 1))
            union = (b[5] - b[3]) * (b[6] - b[4]) + (o[5] - o[3]) * (o[6] - o[4]) - w * h
            return b[1] == o[1] and union > 0 and w * h / union > iou

        if len(kept) < most and not any(map(over, kept)):
            kept.append(b)
    return sorted(b[0] for b in kept)


BOX = "frame_id long, cand_ix long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"


def some_boxes(n, seed, classes=3, spread=60.0):
    r = np.random.default_rng(seed)
    at, size = r.uniform(0, spread, (n, 2)), r.uniform(1, 12, (n, 2))
    return [(i, int(r.integers(classes)), float(r.integers(50)) / 50, *map(float, at[i]), *map(float, at[i] + size[i])) for i in range(n)]


@pytest.mark.parametrize("most,block", [(300, 512), (7, 512), (300, 8)])
def test_suppression_equals_a_plain_loop(spark, monkeypatch, most, block):
    monkeypatch.setattr(vision, "BOXES", block)
    frames = {None: some_boxes(90, 0), **{f: some_boxes(60 + 30 * f, f + 1) for f in range(4)}, 9: [(0, 0, 0.5, 1.0, 1.0, 1.0, 1.0), (1, 0, 0.5, 1.0, 1.0, 1.0, 1.0)]}
    df = spark.createDataFrame([(f, *b) for f, own in frames.items() for b in own], BOX).repartition(3)
    got = {}
    for r in vision.suppress(df, 0.3, most).collect():
        got.setdefault(r.frame_id, []).append(r.cand_ix)
    assert {f: sorted(own) for f, own in got.items()} == {f: greedy(own, 0.3, most) for f, own in frames.items()}
    assert vision.suppress(df.limit(0), 0.3).count() == 0


def test_a_frame_of_thirty_thousand_boxes(spark):
    boxes = some_boxes(30_000, 5, classes=80, spread=600.0)
    df = spark.createDataFrame([(1, *b) for b in boxes], BOX)
    assert sorted(r.cand_ix for r in vision.suppress(df, 0.5, 300).collect()) == greedy(boxes, 0.5, 300)


@pytest.mark.parametrize("held", [1000, 30])
def test_nearest_of_a_large_memory(spark, held):
    r = np.random.default_rng(3)
    queries, bank = r.normal(size=(100, 5)), r.normal(size=(700, 5))
    df = spark.createDataFrame([(i % 7, v.tolist()) for i, v in enumerate(queries)], "i long, v array<double>").repartition(3)
    memory = spark.createDataFrame([(v.tolist(),) for v in bank], "v array<double>")
    want = sorted((i % 7, round(float(np.sqrt(((bank - q) ** 2).sum(1).min())), 8)) for i, q in enumerate(queries))
    for options in ({}, {"sent_bytes": 0, "held": held, "block": 64}):
        got = vision.nearest_distances(df, memory, **options).collect()
        assert sorted((x.i, round(x.distance, 8)) for x in got) == want
    assert vision.nearest_distances(df.limit(0), memory, sent_bytes=0).count() == 0
    assert [x.distance for x in vision.nearest_distances(df.limit(2), memory.limit(0), sent_bytes=0).collect()] == [None, None]
