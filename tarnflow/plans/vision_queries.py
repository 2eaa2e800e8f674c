"""Queries for images, boxes and tensors, over the embeddings as model outputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import gating, recovery, tensors, vision
from tarnflow.plans.registry import query
from tarnflow.plans.vision_steps import PreProcess
from tarnflow.sources.tables import event_stream, table
from tarnflow.sources.tables import tensors as tensor_table

IS = lambda kind: F.col("event_type") == kind

#: A vector as a candidate: four numbers of a box, sixty scores; fifty candidates are a frame.
_CANDIDATES = """t AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
c AS (SELECT vec_id // 50 AS frame_id, vec_id % 50 AS cand_ix, v[1] * 400 + 320 AS cx, v[2] * 400 + 320 AS cy,
        abs(v[3]) * 600 + 20 AS w, abs(v[4]) * 600 + 20 AS h, v[5:64] AS s FROM t),
b AS (SELECT *, list_max(s) AS conf, list_position(s, list_max(s)) - 1 AS cls FROM c),
x AS (SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM b)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda i: F.get("v", F.lit(i))
    return tensor_table(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 50).alias("frame_id"), (F.col("vec_id") % 50).alias("cand_ix"),
        (v(0) * 400 + 320).alias("cx"), (v(1) * 400 + 320).alias("cy"),
        (F.abs(v(2)) * 600 + 20).alias("w"), (F.abs(v(3)) * 600 + 20).alias("h"), F.slice("v", 5, 60).alias("s"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vision.select_candidates(candidates(spark, sf_dir), F.col("s"), 0.2)
    return found.withColumns(vision.corners(*(F.col(c) for c in ("cx", "cy", "w", "h"))))


@query(
    "nv12_to_rgb",
    """WITH p AS (SELECT p_partkey, p_size * 5 AS y, p_partkey % 256 AS u, p_size * 3 % 256 AS v FROM part),
       q AS (SELECT p_partkey, greatest(y - 16, 0) / 219.0::DOUBLE AS c, (u - 128) / 224.0::DOUBLE AS d, (v - 128) / 224.0::DOUBLE AS e FROM p)
       SELECT p_partkey, round(greatest(0.0, least(1.0, c + 1.402::DOUBLE * e)), 9) AS r,
         round(greatest(0.0, least(1.0, c - 0.344136::DOUBLE * d - 0.714136::DOUBLE * e)), 9) AS g, round(greatest(0.0, least(1.0, c + 1.772::DOUBLE * d)), 9) AS b FROM q""",
)
def nv12_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = vision.nv12_to_rgb(F.col("p_size") * 5, F.col("p_partkey") % 256, F.col("p_size") * 3 % 256)
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 9).alias(n) for n, c in rgb.items()])


#: Vectors as buffers of bytes.
_BYTES = "f AS (SELECT vec_id, [CAST(floor(abs(x::DOUBLE) * 1000) AS INT) % 256 FOR x IN embedding] AS b FROM embeddings)"


def byte_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_table(spark, sf_dir).select("vec_id", F.transform("v", lambda x: (F.floor(F.abs(x) * 1000) % 256).cast("int")).alias("bytes"))


@query(
    "nv12_frames",
    "WITH " + _BYTES + """, p AS (SELECT vec_id, y, x, b[y * 6 + x + 1] AS l, b[(4 + y // 2) * 6 + x // 2 * 2 + 1] AS u, b[(4 + y // 2) * 6 + x // 2 * 2 + 2] AS v FROM f, range(4) yy(y), range(4) xx(x)),
       q AS (SELECT vec_id, y, x, greatest(l - 16, 0) / 219.0::DOUBLE AS c, (u - 128) / 224.0::DOUBLE AS d, (v - 128) / 224.0::DOUBLE AS e FROM p)
       SELECT vec_id, y, x, round(greatest(0.0, least(1.0, c + 1.402::DOUBLE * e)), 9) AS r,
         round(greatest(0.0, least(1.0, c - 0.344136::DOUBLE * d - 0.714136::DOUBLE * e)), 9) AS g, round(greatest(0.0, least(1.0, c + 1.772::DOUBLE * d)), 9) AS b FROM q""",
)
def nv12_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 4 x 4 in rows of six bytes."""
    frames = byte_frames(spark, sf_dir).withColumns({"height": F.lit(4), "width": F.lit(4), "pitch": F.lit(6)})
    found = vision.nv12_pixels(frames, "bytes", "vec_id", pitch="pitch")
    return found.select("vec_id", "y", "x", *[F.round(c, 9).alias(c) for c in "rgb"])


@query(
    "frame_validation",
    """WITH f AS (SELECT p_partkey, p_size AS h, p_size * 6 + p_partkey % 2 * 6 AS n, CASE WHEN p_partkey % 5 = 0 THEN 6 END AS pitch, p_size * 12 AS rgb FROM part)
       SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN h % 2 = 0 AND n % coalesce(pitch, 4) = 0 AND n / coalesce(pitch, 4) >= h * 1.5 THEN 'ok' ELSE 'dropped' END
       WHEN p_partkey % 3 = 1 THEN CASE WHEN n = h * 12 THEN 'ok' ELSE 'error' END ELSE 'error' END AS outcome FROM f""",
)
def frame_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, side = F.col("p_partkey"), F.col("p_size")
    fmt = F.get(F.array(F.lit("NV12"), F.lit("rgb"), F.lit("gray")), (key % 3).cast("int"))
    outcome = vision.frame_outcome(fmt, side, F.lit(4), side * 6 + key % 2 * 6, F.when(key % 5 == 0, 6))
    return table(spark, sf_dir, "part").select("p_partkey", outcome.alias("outcome"))


@query("channel_reorder", "SELECT vec_id, round(embedding[3]::DOUBLE, 6) AS r, round(embedding[2]::DOUBLE, 6) AS g, round(embedding[1]::DOUBLE, 6) AS b FROM embeddings")
def channel_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = tensor_table(spark, sf_dir).select("vec_id", F.reverse(F.slice("v", 1, 3)).alias("f"))
    return flipped.select("vec_id", *[F.round(F.get("f", F.lit(i)), 6).alias(c) for i, c in enumerate("rgb")])


_SIDES = "s AS (SELECT p_partkey, p_size * 11 + 7 AS h, p_partkey % 97 + 5 AS w FROM part)"
_FIT = """r AS (SELECT *, {ratio} AS ratio FROM s),
n AS (SELECT *, greatest(1, round_even(h * ratio, 0)::BIGINT) AS nh, greatest(1, round_even(w * ratio, 0)::BIGINT) AS nw FROM r)"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 11 + 7).alias("h"), (F.col("p_partkey") % 97 + 5).alias("w"))


def _geometry(df: DataFrame, **options) -> DataFrame:
    found = vision.letterbox(F.col("h"), F.col("w"), 640, 480, **options)
    return df.select("p_partkey", F.round(found["ratio_y"], 9).alias("ratio_y"), F.round(found["ratio_x"], 9).alias("ratio_x"), *[found[c].alias(c) for c in ("new_h", "new_w", "top", "left")])


@query(
    "letterbox",
    "WITH " + _SIDES + ", " + _FIT.format(ratio="least(640.0::DOUBLE / h, 480.0::DOUBLE / w)")
    + ' SELECT p_partkey, round(ratio, 9) AS ratio_y, round(ratio, 9) AS ratio_x, nh AS new_h, nw AS new_w, (640 - nh) // 2 AS top, (480 - nw) // 2 AS "left" FROM n',
)
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(_sides(spark, sf_dir))


@query(
    "letterbox_auto",
    "WITH " + _SIDES + ", " + _FIT.format(ratio="least(640.0::DOUBLE / h, 480.0::DOUBLE / w, 1.0)")
    + ' SELECT p_partkey, round(ratio, 9) AS ratio_y, round(ratio, 9) AS ratio_x, nh AS new_h, nw AS new_w, (640 - nh) % 32 // 2 AS top, (480 - nw) % 32 // 2 AS "left" FROM n',
)
def letterbox_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(_sides(spark, sf_dir), scaleup=False, auto=True)


@query(
    "stretch",
    "WITH " + _SIDES + ' SELECT p_partkey, round(640.0::DOUBLE / h, 9) AS ratio_y, round(480.0::DOUBLE / w, 9) AS ratio_x, 640 AS new_h, 480 AS new_w, 0 AS top, 0 AS "left" FROM s',
)
def stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(_sides(spark, sf_dir), mode="stretch")


@query(
    "center_crop",
    "WITH " + _SIDES + ", " + _FIT.format(ratio="greatest(640.0::DOUBLE / h, 480.0::DOUBLE / w)")
    + ' SELECT p_partkey, round(ratio, 9) AS ratio_y, round(ratio, 9) AS ratio_x, nh AS new_h, nw AS new_w, -((nh - 640) // 2) AS top, -((nw - 480) // 2) AS "left" FROM n',
)
def center_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(_sides(spark, sf_dir), mode="center_crop")


@query(
    "bilinear_resize",
    """WITH p AS (SELECT vec_id AS frame_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)),
       g AS (SELECT ty, tx, greatest(0.0, least(7.0, (ty + 0.5) * 8 / 5 - 0.5))::DOUBLE AS sy, greatest(0.0, least(7.0, (tx + 0.5) * 8 / 6 - 0.5))::DOUBLE AS sx
             FROM range(5) a(ty), range(6) b(tx)),
       c AS (SELECT ty, tx, least(floor(sy)::INT + dy, 7) AS y, least(floor(sx)::INT + dx, 7) AS x,
               (CASE WHEN dy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN dx = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS k
             FROM g, range(2) d(dy), range(2) e(dx))
       SELECT frame_id, ty, tx, round(sum(v * k), 6) AS v FROM p JOIN c USING (y, x) GROUP BY frame_id, ty, tx""",
)
def bilinear_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = tensor_table(spark, sf_dir).select(F.col("vec_id").alias("frame_id"), F.posexplode("v").alias("i", "v"))
    pixels = pixels.select("frame_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), "v")
    out = vision.bilinear(pixels, 8, 8, 5, 6)
    return out.select("frame_id", "ty", "tx", F.round("v", 6).alias("v"))


@query(
    "preprocess_frames",
    "WITH " + _BYTES + """, p AS (SELECT vec_id, y, x, c, b[(y * 4 + x) * 3 + (2 - c) + 1] AS v FROM f, range(4) yy(y), range(4) xx(x), range(3) cc(c)),
       g AS (SELECT ty, tx, greatest(0.0, least(3.0, (ty + 0.5) / 2 - 0.5))::DOUBLE AS sy, greatest(0.0, least(3.0, (tx + 0.5) / 2 - 0.5))::DOUBLE AS sx FROM range(8) a(ty), range(8) b(tx)),
       k AS (SELECT ty, tx, least(floor(sy)::INT + dy, 3) AS y, least(floor(sx)::INT + dx, 3) AS x,
               (CASE WHEN dy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN dx = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w
             FROM g, range(2) d(dy), range(2) e(dx)),
       r AS (SELECT vec_id, c, ty AS y, tx + 1 AS x, sum(v * w) AS v FROM p JOIN k USING (y, x) GROUP BY ALL
             UNION ALL SELECT vec_id, c, y, x, [100, 110, 120][c + 1] FROM f, range(8) yy(y), (VALUES (0), (9)) xx(x), range(3) cc(c))
       SELECT vec_id, ((y * 10 + x) * 3 + c)::INT AS i, (v - [16, 32, 64][c + 1]) / [2.0, 4.0, 8.0][c + 1]::DOUBLE AS v FROM r""",
)
def preprocess_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 4 x 4 in BGR brought to 8 x 10 in RGB, padded left and right, normalised by channel, laid out by pixel."""
    digits = F.transform(F.slice("bytes", 1, 48), lambda b: F.lpad(F.hex(b), 2, "0"))
    frames = byte_frames(spark, sf_dir).select("vec_id", F.unhex(F.array_join(digits, "")).alias("pixels"), F.lit("bgr").alias("pixel_format"), F.lit(4).alias("height"), F.lit(4).alias("width"))
    step = PreProcess(size=(8, 10), padding_value=(100, 110, 120), scale=1.0, mean=(16, 32, 64), std=(2, 4, 8), layout="nhwc", input_name="images")
    found = step.apply(frames).select("vec_id", F.posexplode(F.try_element_at("model_input", F.lit("images"))).alias("i", "v"))
    return found.select("vec_id", "i", F.col("v").cast("double").alias("v"))


@query("normalise", "SELECT vec_id, i, round((embedding[i + 1]::DOUBLE * 2.0::DOUBLE - 0.5::DOUBLE) / 0.25::DOUBLE, 6) AS v FROM embeddings, range(64) t(i)")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tensor_table(spark, sf_dir).select("vec_id", F.posexplode(vision.normalise(F.col("v"), 2.0, 0.5, 0.25)).alias("i", "v"))
    return rows.select("vec_id", "i", F.round("v", 6).alias("v"))


@query("class_select", "WITH " + _CANDIDATES + " SELECT frame_id, cand_ix, round(conf, 6) AS conf, cls FROM x WHERE conf > 0.2::DOUBLE AND cls < 30")
def class_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vision.select_candidates(candidates(spark, sf_dir), F.col("s"), 0.2, list(range(30)))
    return found.select("frame_id", "cand_ix", F.round("conf", 6).alias("conf"), "cls")


@query("box_corners", "WITH " + _CANDIDATES + " SELECT frame_id, cand_ix, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM x WHERE conf > 0.2::DOUBLE")
def box_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("frame_id", "cand_ix", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "topk_candidates",
    "WITH " + _CANDIDATES + ", k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY conf DESC, cand_ix) AS rank FROM x) SELECT frame_id, cand_ix, rank FROM k WHERE rank <= 10",
)
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, cls = vision.best_class(F.col("s"))
    return vision.top_k(candidates(spark, sf_dir).withColumns({"conf": top, "cls": cls}), 10).select("frame_id", "cand_ix", "rank")


@query(
    "nms",
    "WITH RECURSIVE " + _CANDIDATES + """,
    o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY conf DESC, cand_ix) AS n FROM x WHERE conf > 0.2::DOUBLE),
    p AS (SELECT a.frame_id, a.n AS n, b.n AS m,
            greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
            a.w * a.h + b.w * b.h AS sides FROM o a JOIN o b ON a.frame_id = b.frame_id AND b.n < a.n AND a.cls % 4 = b.cls % 4),
    l AS (SELECT frame_id, n, list(m) AS hits FROM p WHERE inter / (sides - inter) > 0.3::DOUBLE GROUP BY ALL),
    r AS (SELECT frame_id, 0::BIGINT AS n, []::BIGINT[] AS kept FROM (SELECT DISTINCT frame_id FROM o)
          UNION ALL
          SELECT r.frame_id, o.n, CASE WHEN list_has_any(coalesce(l.hits, []), r.kept) THEN r.kept ELSE list_append(r.kept, o.n) END
          FROM r JOIN o ON o.frame_id = r.frame_id AND o.n = r.n + 1 LEFT JOIN l ON l.frame_id = o.frame_id AND l.n = o.n),
    k AS (SELECT frame_id, unnest(kept) AS n FROM r WHERE n = (SELECT max(n) FROM o WHERE o.frame_id = r.frame_id))
    SELECT o.frame_id, o.cand_ix, (o.cls % 4)::INT AS cls, round(o.conf, 6) AS conf FROM k JOIN o USING (frame_id, n)""",
)
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = vision.suppress(boxes(spark, sf_dir).withColumn("cls", F.col("cls") % 4), 0.3)
    return kept.select("frame_id", "cand_ix", "cls", F.round("conf", 6).alias("conf"))


@query("end_to_end_outputs", "WITH " + _CANDIDATES + ", k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY conf DESC, cand_ix) AS rank FROM x WHERE conf > 0.25::DOUBLE) SELECT frame_id, cand_ix FROM k WHERE rank <= 5")
def end_to_end_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = boxes(spark, sf_dir).where("conf > 0.25")
    return vision.top_k(decoded, 5).select("frame_id", "cand_ix")


@query(
    "restore_boxes",
    "WITH " + _CANDIDATES + """ SELECT frame_id, cand_ix, round(greatest(0.0, least(1280.0, (x1 - 10) / 0.5::DOUBLE)), 4) AS x1, round(greatest(0.0, least(720.0, (y1 - 20) / 0.5::DOUBLE)), 4) AS y1,
      round(greatest(0.0, least(1280.0, (x2 - 10) / 0.5::DOUBLE)), 4) AS x2, round(greatest(0.0, least(720.0, (y2 - 20) / 0.5::DOUBLE)), 4) AS y2 FROM x WHERE conf > 0.2::DOUBLE""",
)
def restore_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = lambda c: F.round(vision.restore(F.col(c), 10 if c[0] == "x" else 20, 0.5, 1280.0 if c[0] == "x" else 720.0), 4).alias(c)
    return boxes(spark, sf_dir).select("frame_id", "cand_ix", *[back(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "merge_detections",
    "WITH {ev} SELECT stream_id, seq, CASE WHEN event_type = 'view' THEN -1.0 ELSE value END AS own, CASE WHEN event_type = 'click' THEN -1.0 ELSE k END::DOUBLE AS other FROM ev",
)
def merge_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.create_map(F.lit("own"), F.col("value"), F.lit("other"), F.col("k").cast("double"))
    model = F.when(IS("view"), "own").when(IS("click"), "other").otherwise("third")
    rows = event_stream(spark, sf_dir).withColumn("m", vision.merge_detections(before, model, F.lit(-1.0)))
    return rows.select("stream_id", "seq", F.try_element_at("m", F.lit("own")).alias("own"), F.try_element_at("m", F.lit("other")).alias("other"))


@query("context_cleanup", "WITH {ev} SELECT stream_id, seq, event_type, CASE WHEN event_type <> 'error' THEN k END AS model_output FROM ev")
def context_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).drop("slice").withColumns({"model_input": F.col("k"), "image_transform": F.col("value"), "inference_profile": F.lit(1), "model_output": F.col("k")})
    left = [c for c in rows.columns if c not in ("event_id", "at_us", "value", "k", "service_us")]
    return recovery.cleaned(rows.select(*left), IS("error"))


@query("class_names", "WITH " + _CANDIDATES + " SELECT frame_id, cand_ix, 'class-' || cls::VARCHAR AS name FROM x WHERE conf > 0.2::DOUBLE")
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(i, f"class-{i}") for i in range(60)], "cls int, name string")
    return boxes(spark, sf_dir).join(F.broadcast(names), "cls").select("frame_id", "cand_ix", "name")


@query(
    "carry_forward",
    """WITH {ev}, m AS (SELECT *, max(CASE WHEN event_type IN ('purchase', 'error') THEN seq END) OVER (PARTITION BY stream_id ORDER BY seq) AS at FROM ev)
       SELECT m.stream_id, m.seq, CASE WHEN e.event_type = 'purchase' THEN e.value END AS boxes FROM m LEFT JOIN ev e ON e.stream_id = m.stream_id AND e.seq = m.at""",
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gating.carry_forward(event_stream(spark, sf_dir), "boxes", F.col("value"), IS("purchase"), IS("error"), keys=("stream_id",), slices="slice")
    return rows.select("stream_id", "seq", "boxes")


_MASK = """m AS (SELECT frame_id, round_even(x1 / 20, 0)::BIGINT AS l, round_even(y1 / 20, 0)::BIGINT AS t, round_even(x2 / 20, 0)::BIGINT AS r, round_even(y2 / 20, 0)::BIGINT AS b
  FROM x WHERE conf > 0.2::DOUBLE),
h AS (SELECT frame_id, greatest(0, least(l, 32)) AS l, greatest(0, least(t, 24)) AS t, greatest(0, least(r, 31)) + 1 AS r, greatest(0, least(b, 23)) + 1 AS b
  FROM m WHERE r >= l AND b >= t AND r >= 0 AND b >= 0 AND l < 32 AND t < 24),
px AS (SELECT DISTINCT frame_id, y, x FROM h, range(24) yy(y), range(32) xx(x)
  WHERE x >= l AND x < r AND y >= t AND y < b AND (y < t + 2 OR y >= b - 2 OR x < l + 2 OR x >= r - 2))"""


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = boxes(spark, sf_dir).select("frame_id", *[(F.col(c) / 20).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return vision.edge_mask(small, 24, 32, 2)


@query("box_mask", "WITH " + _CANDIDATES + ", " + _MASK + " SELECT frame_id, y, x FROM px")
def box_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask(spark, sf_dir)


@query("chroma_mask", "WITH " + _CANDIDATES + ", " + _MASK + " SELECT DISTINCT frame_id, y // 2 AS y, x // 2 AS x FROM px")
def chroma_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.chroma_mask(_mask(spark, sf_dir))


@query(
    "overlay_paint",
    "WITH " + _CANDIDATES + ", " + _MASK + """, f AS (SELECT DISTINCT frame_id FROM x),
       a AS (SELECT frame_id, 'y' AS plane, y, x FROM f, range(24) yy(y), range(32) xx(x) UNION ALL SELECT frame_id, p, y, x FROM f, (VALUES ('u'), ('v')) pp(p), range(12) yy(y), range(16) xx(x)),
       painted AS (SELECT frame_id, 'y' AS plane, y, x, 145 AS color FROM px UNION ALL SELECT DISTINCT frame_id, p, y // 2, x // 2, c FROM px, (VALUES ('u', 54), ('v', 34)) pp(p, c))
       SELECT frame_id, plane, y, x, coalesce(color, y + x)::INT AS v FROM a LEFT JOIN painted USING (frame_id, plane, y, x)""",
)
def overlay_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = candidates(spark, sf_dir).select("frame_id").distinct()
    plane = lambda name, h, w: frames.select("frame_id", F.lit(name).alias("plane"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(h - 1).cast("long"))).alias("y")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w - 1).cast("long"))).alias("x")
    )
    pixels = plane("y", 24, 32).union(plane("u", 12, 16)).union(plane("v", 12, 16)).withColumn("v", (F.col("y") + F.col("x")).cast("int"))
    return vision.paint(pixels, _mask(spark, sf_dir), "#00ff00")


@query(
    "knn_anomaly",
    """WITH t AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
       d AS (SELECT q.vec_id // 25 AS image, q.vec_id AS patch, min(list_sum([(a - b) * (a - b) FOR a, i IN q.v, b IN [m.v[i]]])) AS d
             FROM t q, t m WHERE q.vec_id % 5 = 0 AND m.vec_id % 5 > 0 GROUP BY ALL)
       SELECT image, round(max(sqrt(d)), 5) AS score FROM d GROUP BY image""".replace(
        "min(list_sum([(a - b) * (a - b) FOR a, i IN q.v, b IN [m.v[i]]]))", "min(list_distance(q.v, m.v) ** 2)"
    ),
)
def knn_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tensor_table(spark, sf_dir)
    queries = rows.where("vec_id % 5 = 0").select(F.floor(F.col("vec_id") / 25).alias("image"), F.col("vec_id").alias("patch"), "v")
    found = vision.nearest_score(queries, rows.where("vec_id % 5 > 0"), image="image", patch="patch")
    return found.select("image", F.round("score", 5).alias("score"))


@query(
    "anomaly_map",
    """WITH t AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
       d AS (SELECT q.vec_id // 25 AS image, q.vec_id % 25 // 5 AS y, q.vec_id % 5 AS x, min(list_distance(q.v, m.v)) AS d FROM t q, embeddings m2, LATERAL (SELECT [x::DOUBLE FOR x IN m2.embedding] AS v) m
             WHERE m2.label = 0 GROUP BY ALL),
       g AS (SELECT ty, tx, greatest(0.0, least(4.0, (ty + 0.5) / 2 - 0.5))::DOUBLE AS sy, greatest(0.0, least(4.0, (tx + 0.5) / 2 - 0.5))::DOUBLE AS sx FROM range(10) a(ty), range(10) b(tx)),
       k AS (SELECT ty, tx, least(floor(sy)::INT + dy, 4) AS y, least(floor(sx)::INT + dx, 4) AS x,
               (CASE WHEN dy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN dx = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w
             FROM g, range(2) d(dy), range(2) e(dx))
       SELECT image, ty AS y, tx AS x, round(sum(d * w), 5) AS distance FROM d JOIN k USING (y, x) GROUP BY image, ty, tx""",
)
def anomaly_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 5 x 5 patches; the vectors of one label are the memory."""
    rows = tensor_table(spark, sf_dir)
    at = {"image": F.floor(F.col("vec_id") / 25), "y": F.floor(F.col("vec_id") % 25 / 5), "x": (F.col("vec_id") % 5).cast("long")}
    near = vision.nearest_distances(rows.withColumns(at).select("image", "y", "x", "v"), rows.where("label = 0"))
    found = vision.anomaly_map(near, 5, 5, 10, 10, image="image")
    return found.select("image", "y", "x", F.round("distance", 5).alias("distance"))


@query("flatten_outputs", "WITH {ev} SELECT stream_id, seq, value AS v0, value * 2 AS v1, k::DOUBLE AS v2 FROM ev")
def flatten_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.create_map(F.lit("boxes"), F.col("value"), F.lit("scores"), F.col("value") * 2)
    outputs = F.create_map(F.lit("output0"), head, F.lit("output1"), F.create_map(F.lit("mask"), F.col("k").cast("double")))
    rows = event_stream(spark, sf_dir).withColumn("m", tensors.flatten_outputs(outputs))
    names = ("output0/boxes", "output0/scores", "output1/mask")
    return rows.select("stream_id", "seq", *[F.try_element_at("m", F.lit(n)).alias(f"v{i}") for i, n in enumerate(names)])


@query(
    "normalize_outputs",
    """WITH {ev}, r AS (SELECT stream_id, seq, k % 6 AS c, k FROM ev)
       SELECT stream_id, seq, unnest(CASE c WHEN 0 THEN ['output0'] WHEN 1 THEN ['output0', 'output1/a', 'output1/b/output0'] WHEN 2 THEN ['boxes/xy', 'boxes/wh', 'mask'] ELSE [NULL] END) AS name,
              unnest(CASE c WHEN 0 THEN ['t' || k] WHEN 1 THEN ['t1', 't' || k, 't3'] WHEN 2 THEN ['t1', 't2', 't' || k] ELSE [NULL] END) AS tensor,
              CASE c WHEN 3 THEN 'two outputs named a/b' WHEN 4 THEN 'empty container at x' WHEN 5 THEN 'blank name under the top' END AS error FROM r""",
)
def normalize_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    t = F.concat(F.lit('"t'), k, F.lit('"'))
    cases = [
        t, F.concat(F.lit('["t1", {"a": '), t, F.lit(', "b": ["t3"]}]')), F.concat(F.lit('{"boxes": {"xy": "t1", "wh": "t2"}, "mask": '), t, F.lit("}")),
        F.lit('{"a": {"b": "t1"}, "a/b": "t2"}'), F.lit('{"x": {}, "y": "t1"}'), F.lit('{" ": "t1"}'),
    ]
    given = F.get(F.array(*cases), (k % 6).cast("int"))
    rows = tensors.normalize_outputs(event_stream(spark, sf_dir), "o", given)
    return rows.select("stream_id", "seq", F.explode_outer("o.outputs").alias("name", "tensor"), F.col("o.error").alias("error"))


@query(
    "engine_payload",
    """WITH {ev} SELECT stream_id, seq, CASE WHEN k % 4 < 2 THEN 'AA' || printf('%02X', k::INT) WHEN k % 4 = 2 THEN '02000000' || hex('[]') || 'AA' ELSE 'AA' END AS payload FROM ev""",
)
def engine_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 4
    tail = F.concat(F.lit("AA"), F.lpad(F.hex("k"), 2, "0"))
    meta = F.concat(F.lit("0A000000"), F.hex(F.lit('{"a": "b"}').cast("binary")), tail)
    file = F.when(k == 0, meta).when(k == 1, tail).when(k == 2, F.concat(F.lit("02000000"), F.hex(F.lit("[]").cast("binary")), F.lit("AA"))).otherwise("AA")
    return event_stream(spark, sf_dir).select("stream_id", "seq", F.hex(tensors.engine_payload(F.unhex(file))).alias("payload"))


@query("validate_inputs", "WITH {ev} SELECT stream_id, seq, coalesce(k % 5 > 0 AND k % 3 > 0, false) AS valid FROM ev")
def validate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tensor = F.struct(F.lit("float32").alias("dtype"), F.array(F.lit(1).cast("long"), F.col("k") % 5).alias("shape"))
    inputs = F.create_map(F.when(F.col("k") % 3 == 0, " ").otherwise("images"), tensor)
    return event_stream(spark, sf_dir).select("stream_id", "seq", tensors.valid_inputs(inputs, shared=True).alias("valid"))


@query(
    "engine_shapes",
    "WITH {ev} SELECT stream_id, seq, k % 7 BETWEEN 2 AND 4 AND k % 2 = 0 AS fits, k % 7 BETWEEN 2 AND 4 AND k % 2 = 0 AND k % 5 > 0 AND k % 3 > 0 AS bound FROM ev",
)
def engine_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.array(F.col("k") % 7, F.col("k") % 2 + 3)
    ints = lambda *x: F.array(*[F.lit(i).cast("long") for i in x])
    fits = tensors.fits_engine(shape, ints(2, 1), ints(4, 9), ints(-1, 3))
    binding = F.struct(F.lit("float32").alias("dtype"), ints(-1, 3).alias("fixed"), ints(2, 1).alias("low"), ints(4, 9).alias("high"))
    given = F.struct(F.when(F.col("k") % 5 > 0, "float32").otherwise("float16").alias("dtype"), shape.alias("shape"))
    inputs = F.create_map(F.when(F.col("k") % 3 > 0, "images").otherwise("other"), given)
    bound = tensors.fits_bindings(inputs, F.create_map(F.lit("images"), binding))
    return event_stream(spark, sf_dir).select("stream_id", "seq", fits.alias("fits"), bound.alias("bound"))


def linear_model():
    """A model of fixed weights, made once a task."""
    weights = 1.0 / (1.0 + np.arange(64))

    def infer(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(np.stack(rows["v"].to_list()) @ weights, index=rows.index)

    return infer


@query("model_inference", "SELECT vec_id, round(list_sum([x::DOUBLE / (1 + i) FOR x, i IN embedding]), 5) AS model_output FROM embeddings".replace("(1 + i)", "i"))
def model_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tensors.infer(tensor_table(spark, sf_dir).select("vec_id", "v"), linear_model)
    return found.select("vec_id", F.round("model_output", 5).alias("model_output"))
