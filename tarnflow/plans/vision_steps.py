"""Pre- and postprocessing as steps of a pipeline; options are checked by rules when settings arrive."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators import images, tensors, vision
from tarnflow.operators.inference import infer_batches
from tarnflow.plans.config import batch_settings
from tarnflow.plans.pipeline import Step

Rule = Callable[[Any], bool]


def _number(low: float = -math.inf, high: float = math.inf) -> Rule:
    return lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and low <= x <= high


def _integer(low: int) -> Rule:
    return lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= low


def _one_of(*names: str) -> Rule:
    return lambda x: x in names


def _several(rule: Rule, n: int) -> Rule:
    return lambda x: isinstance(x, (list, tuple)) and len(x) == n and all(rule(i) for i in x)


def _each(rule: Rule) -> Rule:
    """For all channels, or for each of three."""
    return lambda x: rule(x) or _several(rule, 3)(x)


def _or_none(rule: Rule) -> Rule:
    return lambda x: x is None or rule(x)


_flag: Rule = lambda x: isinstance(x, bool)
_named: Rule = lambda x: isinstance(x, str) and bool(x.strip())


class Checked(Step):
    """A step whose options have rules: one each, and some for several together."""

    rules: Mapping[str, Rule] = {}
    together: tuple[tuple[str, Callable[[Mapping[str, Any]], bool]], ...] = ()

    def configure(self, section: Mapping[str, Any] | None) -> None:
        before = self.settings
        super().configure(section)
        wrong = [k for k, rule in self.rules.items() if not rule(self.settings[k])]
        wrong = wrong or [what for what, rule in self.together if not rule(self.settings)]
        if wrong:
            self.settings = before
            raise ValueError(f"{type(self).__name__}: not allowed: {', '.join(wrong)}")


class PreProcess(Checked):
    """Frames (``height``, ``width``) brought to ``size`` and made model input.

    With a buffer ``pixels`` (and its ``pixel_format``) pixels are resized, padded or cut, put in order,
    normalised and laid out: ``images.prepare``.  Without one only the geometry is given, as ``transform``.
    """

    rules = {
        "size": _several(_integer(1), 2),
        "resize_mode": _one_of("letterbox", "stretch", "resize_center_crop"),
        "auto": _flag,
        "stride": _integer(1),
        "scaleup": _flag,
        "center": _flag,
        "padding_value": _each(_number(0, 255)),
        "crop_size": _or_none(_several(_integer(1), 2)),
        "color_order": _one_of("rgb", "bgr"),
        "scale": _number(),
        "mean": _each(_number()),
        "std": _each(lambda x: _number(0)(x) and x > 0),
        "dtype": _one_of("float32", "float16"),
        "layout": _one_of("nchw", "nhwc"),
        "input_name": _or_none(_named),
    }
    together = (
        ("auto without letterbox", lambda s: not s["auto"] or s["resize_mode"] == "letterbox"),
        ("crop_size without resize_center_crop", lambda s: s["crop_size"] is None or s["resize_mode"] == "resize_center_crop"),
        ("crop_size over size", lambda s: s["crop_size"] is None or all(c <= n for c, n in zip(s["crop_size"], s["size"], strict=True))),
    )

    def __init__(self, **options: Any) -> None:
        given = {
            "size": (640, 640), "resize_mode": "letterbox", "auto": False, "stride": 32, "scaleup": True, "center": True,
            "padding_value": 114, "crop_size": None, "color_order": "rgb", "scale": 1 / 255, "mean": 0.0, "std": 1.0,
            "dtype": "float32", "layout": "nchw", "input_name": None,
        }
        super().__init__(**given)
        self.configure(options)
        self.defaults = dict(self.settings)

    def apply(self, df: DataFrame) -> DataFrame:
        if "pixels" in df.columns:
            return images.prepare(df, self.settings)
        found = images.geometry(self.settings)
        return df.withColumn("transform", F.struct(*[found[n].alias(n) for n in ("ratio_y", "ratio_x", "new_h", "new_w", "top", "left")]))


class Inference(Checked):
    """A model's output for each frame: ``model_id`` and ``model_output``.

    ``factory`` makes the model, once a task, from the path, the GPU and the profile; the model takes rows and gives
    a value each.  Frames whose ``inputs`` (name to (dtype, shape)) cannot be used, and frames at which the model
    fails, pass without an output; with ``batch`` the first axis must be 1, as requests share calls.
    ``profile_index`` is for one backend only.

    With ``batch``, frames with ``stream_id``, ``seq``, ``at_us``, ``key`` and ``rows`` are requests: those that come together
    share a call of the worker's model, and its error.  How many and how long they wait is in ``shared``, the settings file of the model.
    """

    rules = {
        "model_path": _named,
        "batch": _flag,
        "gpu_id": _integer(0),
        "id": _or_none(_named),
        "backend": lambda x: isinstance(x, str) and (x in tensors.BACKENDS or re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*:[A-Za-z_]\w*", x) is not None),
        "profile_index": _integer(0),
    }
    together = (("profile_index with another backend than tensorrt", lambda s: s["profile_index"] == 0 or s["backend"] == "tensorrt"),)

    def __init__(self, model_path: str, factory: Callable[[str, int, int], Callable], shared: Mapping[str, Any] | None = None, **options: Any) -> None:
        super().__init__(model_path=model_path, batch=False, gpu_id=0, id=None, backend="tensorrt", profile_index=0)
        self.factory, self.shared = factory, shared
        self.configure(options)
        self.defaults = dict(self.settings)

    def apply(self, df: DataFrame) -> DataFrame:
        s, make = dict(self.settings), self.factory
        usable = tensors.valid_inputs(F.col("inputs"), shared=s["batch"]) if "inputs" in df.columns else None
        if s["batch"] and {"stream_id", "seq", "at_us", "key", "rows"} <= set(df.columns):
            size, wait_s = batch_settings(self.shared, s["backend"])
            token = f"{s['model_path']}|{s['gpu_id']}|{s['profile_index']}"
            load = lambda key: make(s["model_path"], s["gpu_id"], s["profile_index"])
            told = infer_batches(df, load, size=size, wait_us=round(wait_s * 1e6), token=token, usable=usable)
            told = told.select("stream_id", "seq", F.col("outputs").alias("model_output"), F.col("error").alias("model_error"))
            return df.join(told, ["stream_id", "seq"], "left").withColumn("model_id", self._name())
        found = tensors.infer(df, lambda: make(s["model_path"], s["gpu_id"], s["profile_index"]), usable=usable, guarded=True)
        return found.withColumn("model_id", self._name())

    def _name(self) -> Column:
        s = self.settings
        return F.lit(s["id"] or s["model_path"].replace("\\", "/").rstrip("/").rsplit("/", 1)[-1])


class PostProcess(Checked):
    """Detections from candidates (frame_id, cand_ix, cx, cy, w, h, scores), in the source image.

    With ``end2end`` candidates are decoded already: x1, y1, x2, y2, conf, cls.  Frames have
    ``transform``, ``height`` and ``width``.
    """

    rules = {
        "confidence": _number(0, 1),
        "iou": _number(0, 1),
        "classes": _or_none(lambda x: isinstance(x, list) and all(_integer(0)(i) for i in x)),
        "max_det": _integer(1),
        "output_name": _named,
        "names": lambda x: isinstance(x, list) and len(x) > 0 and all(_named(i) for i in x),
        "end2end": _flag,
    }
    together = (("classes without a name", lambda s: all(c < len(s["names"]) for c in s["classes"] or ())),)

    def __init__(self, names: list[str], **options: Any) -> None:
        super().__init__(confidence=0.25, iou=0.7, classes=None, max_det=300, output_name="output0", names=names, end2end=False)
        self.configure(options)
        self.defaults = dict(self.settings)

    def apply(self, df: DataFrame) -> DataFrame:
        s = self.settings
        frames = df.select("frame_id", "transform", "height", "width").distinct()
        if s["end2end"]:
            found = df.where(F.col("conf") > s["confidence"])
            found = found if s["classes"] is None else found.where(F.col("cls").isin(s["classes"]) if s["classes"] else F.lit(False))
            kept = vision.top_k(found, s["max_det"]).drop("rank", "transform", "height", "width")
        else:
            found = vision.select_candidates(df, F.col("scores"), s["confidence"], s["classes"])
            found = vision.top_k(found, 30_000).withColumns(vision.corners(*(F.col(c) for c in ("cx", "cy", "w", "h"))))
            best = vision.suppress(found, s["iou"], s["max_det"]).select("frame_id", "cand_ix")
            kept = found.join(best, ["frame_id", "cand_ix"]).select("frame_id", "cand_ix", "x1", "y1", "x2", "y2", "conf", "cls")
        rows = kept.join(frames, "frame_id")
        t = F.col("transform")
        back = {c: vision.restore(F.col(c), t["left"], t["ratio_x"], F.col("width").cast("double")) for c in ("x1", "x2")}
        back |= {c: vision.restore(F.col(c), t["top"], t["ratio_y"], F.col("height").cast("double")) for c in ("y1", "y2")}
        name = F.get(F.array(*[F.lit(n) for n in s["names"]]), F.col("cls"))
        return rows.withColumns(back).select("frame_id", "cand_ix", "x1", "y1", "x2", "y2", "conf", "cls", name.alias("name"))
