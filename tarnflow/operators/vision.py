"""Image and box arithmetic on columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def clamp(x: Column, low: float, high: Column | float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(x, high if isinstance(high, Column) else F.lit(float(high))))


def nv12_to_rgb(y: Column, u: Column, v: Column) -> dict[str, Column]:
    """RGB in 0 to 1 of limited-range luma and chroma."""
    c, d, e = F.greatest(y - 16, F.lit(0)) / 219.0, (u - 128) / 224.0, (v - 128) / 224.0
    return {
        "r": clamp(c + 1.402 * e, 0, 1),
        "g": clamp(c - 0.344136 * d - 0.714136 * e, 0, 1),
        "b": clamp(c + 1.772 * d, 0, 1),
    }


def nv12_pixels(frames: DataFrame, buffer: str, *keep: str, height: str = "height", width: str = "width", pitch: str | None = None) -> DataFrame:
    """A row (keep, y, x, r, g, b) for each pixel of NV12 buffers, arrays of bytes: luma rows, then rows of
    chroma pairs, of which each holds for four pixels.  Rows are ``pitch`` long, if not ``width``."""
    row = F.col(pitch or width)
    rows = frames.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col(height) * F.col(width) - 1)))
    rows = rows.withColumns({"y": F.floor(F.col("__i") / F.col(width)), "x": F.col("__i") % F.col(width)})
    at = lambda i: F.get(buffer, i.cast("int"))
    cell = (F.col(height) + F.floor(F.col("y") / 2)) * row + F.floor(F.col("x") / 2) * 2
    rgb = nv12_to_rgb(at(F.col("y") * row + F.col("x")), at(cell), at(cell + 1))
    return rows.select(*keep, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[c.alias(n) for n, c in rgb.items()])


def frame_outcome(fmt: Column, height: Column, width: Column, size: Column | None = None, pitch: Column | None = None) -> Column:
    """ok; dropped for NV12 whose sides are not even and positive or whose buffer is too small; error for what
    cannot be read: another format, or RGB whose buffer is not of its size."""
    sides = (height > 0) & (width > 0)
    row = width if pitch is None else F.coalesce(pitch, width)
    enough = F.lit(True) if size is None else (row >= width) & (size % row == 0) & (size / row >= height * 3 / 2)
    whole = F.lit(True) if size is None else size == height * width * 3
    nv12 = F.coalesce(sides & (height % 2 == 0) & (width % 2 == 0) & enough, F.lit(False))
    rgb = F.coalesce(sides & whole, F.lit(False))
    known = F.lower(fmt)
    return F.when(known == "nv12", F.when(nv12, "ok").otherwise("dropped")).when(known.isin("rgb", "bgr") & rgb, "ok").otherwise("error")


def letterbox(h: Column, w: Column, th: int, tw: int, *, mode: str = "letterbox", crop: tuple[int, int] | None = None, scaleup: bool = True, center: bool = True, auto: bool = False, stride: int = 32) -> dict[str, Column]:
    """Ratios, resized sides and offsets of an image brought to (th, tw)."""
    rh, rw = F.lit(float(th)) / h, F.lit(float(tw)) / w
    if mode == "stretch":
        zero = F.lit(0).cast("long")
        return {"ratio_y": rh, "ratio_x": rw, "new_h": F.lit(th).cast("long"), "new_w": F.lit(tw).cast("long"), "top": zero, "left": zero}
    ratio = F.greatest(rh, rw) if mode == "center_crop" else F.least(rh, rw)
    ratio = ratio if scaleup or mode == "center_crop" else F.least(ratio, F.lit(1.0))
    side = lambda x: F.greatest(F.lit(1).cast("long"), F.bround(x * ratio, 0).cast("long"))
    nh, nw = side(h), side(w)
    if mode == "center_crop":
        ch, cw = crop or (th, tw)
        top, left = -F.floor((nh - ch) / 2), -F.floor((nw - cw) / 2)
    else:
        ph, pw = F.lit(th) - nh, F.lit(tw) - nw
        ph, pw = (F.pmod(ph, F.lit(stride)), F.pmod(pw, F.lit(stride))) if auto else (ph, pw)
        top, left = (F.floor(ph / 2), F.floor(pw / 2)) if center else (F.lit(0), F.lit(0))
    return {"ratio_y": ratio, "ratio_x": ratio, "new_h": nh, "new_w": nw, "top": top.cast("long"), "left": left.cast("long")}


def bilinear(pixels: DataFrame, h: int, w: int, th: int, tw: int, *, frame: str = "frame_id") -> DataFrame:
    """Pixels (frame, y, x, v) resized, sample points at pixel centres, edges held."""
    if (h, w) == (th, tw):
        return pixels
    spark = pixels.sparkSession
    where = lambda i, n, m: clamp((F.col(i) + 0.5) * n / m - 0.5, 0, n - 1)
    grid = spark.range(th * tw).select(F.floor(F.col("id") / tw).alias("ty"), (F.col("id") % tw).alias("tx"))
    grid = grid.withColumn("sy", where("ty", h, th)).withColumn("sx", where("tx", w, tw))
    corners = []
    for dy in (0, 1):
        for dx in (0, 1):
            y, x = F.floor("sy"), F.floor("sx")
            fy, fx = F.col("sy") - y, F.col("sx") - x
            weight = (fy if dy else 1 - fy) * (fx if dx else 1 - fx)
            at = lambda c, d, n: F.least(c + d, F.lit(n - 1).cast("long"))
            corners.append(F.struct(at(y, dy, h).alias("y"), at(x, dx, w).alias("x"), weight.alias("weight")))
    # the grid has th * tw * 4 rows whatever the number of frames
    grid = grid.select("ty", "tx", F.explode(F.array(*corners)).alias("c")).select("ty", "tx", "c.*")
    return pixels.join(F.broadcast(grid), ["y", "x"]).groupBy(frame, "ty", "tx").agg(F.sum(F.col("v") * F.col("weight")).alias("v"))


def normalise(values: Column, scale: float = 1.0, mean: float = 0.0, std: float = 1.0) -> Column:
    """Scaled, shifted, divided, each left out where it changes nothing."""
    def one(x: Column) -> Column:
        x = x * scale if scale != 1.0 else x
        x = x - mean if mean != 0.0 else x
        return x / std if std != 1.0 else x

    return F.transform(values, one)


def best_class(scores: Column) -> tuple[Column, Column]:
    """Score and index of the best class, the lowest index of equal ones."""
    top = F.array_max(scores)
    return top, (F.array_position(scores, top) - 1).cast("int")


def select_candidates(df: DataFrame, scores: Column, confidence: float, classes: list[int] | None = None) -> DataFrame:
    """Candidates whose best class is allowed and better than ``confidence``; no second choice."""
    top, cls = best_class(scores)
    rows = df.withColumn("conf", top).withColumn("cls", cls).where(F.col("conf") > confidence)
    return rows if classes is None else rows.where(F.col("cls").isin(classes) if classes else F.lit(False))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def top_k(df: DataFrame, k: int, *, frame: str = "frame_id", score: str = "conf", tie: str = "cand_ix") -> DataFrame:
    w = Window.partitionBy(frame).orderBy(F.col(score).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Boxes of a frame that are held against one another at once.
BOXES = 512


class _Frame:
    """The boxes of a frame that stay, best first, as they come in blocks."""

    def __init__(self, iou: float, most: int) -> None:
        self.iou, self.most = iou, most
        self.boxes, self.classes = np.zeros((0, 4)), np.zeros(0, np.int64)

    def _over(self, a: np.ndarray, a_class: np.ndarray, b: np.ndarray, b_class: np.ndarray) -> np.ndarray:
        """Bits: whether each of ``a`` and each of ``b`` are of a class and overlap by more than is allowed."""
        a, b = a[:, None, :], b[None, :, :]
        sides = np.maximum(0.0, np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]))
        both = sides[..., 0] * sides[..., 1]
        area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
        union = area(a) + area(b) - both
        with np.errstate(divide="ignore", invalid="ignore"):
            return (a_class[:, None] == b_class[None, :]) & (union > 0) & (both / union > self.iou)

    def take(self, boxes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Which of the next boxes stay; one step for each that does."""
        stay = []
        for at in range(0, len(boxes), BOXES):
            if len(self.boxes) >= self.most:
                break
            own, kinds = boxes[at : at + BOXES], classes[at : at + BOXES]
            open_ = ~self._over(own, kinds, self.boxes, self.classes).any(axis=1)
            pairs, found = self._over(own, kinds, own, kinds), []
            while len(self.boxes) + len(found) < self.most and open_.any():
                i = int(open_.argmax())
                found.append(i)
                open_ &= ~pairs[i]
                open_[: i + 1] = False
            self.boxes, self.classes = np.concatenate([self.boxes, own[found]]), np.concatenate([self.classes, kinds[found]])
            stay += [at + i for i in found]
        return np.array(stay, np.int64)


def suppress(df: DataFrame, iou: float, max_det: int = 300, *, frame: str = "frame_id", tie: str = "cand_ix") -> DataFrame:
    """Boxes kept by greedy suppression within a class: best first, none overlaps a kept one by more than ``iou``.

    A frame's boxes are run through in blocks, each against what is kept and, by a matrix of bits, against itself.
    """
    out = T.StructType([df.schema[frame], *T.StructType.fromDDL(f"`{tie}` long, cls int, conf double").fields])
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(frame)
            code = np.asarray(ids.dictionary_encode(null_encoding="encode").indices)
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
            boxes = np.column_stack([np.asarray(batch.column(c).cast(pa.float64()).fill_null(float("nan"))) for c in ("x1", "y1", "x2", "y2")])
            classes = np.asarray(batch.column("cls").cast(pa.int64()).fill_null(-1))
            stay = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                one = ids[a].as_py()
                if kept is None or one != now:
                    now, kept = one, _Frame(iou, max_det)
                stay.append(a + kept.take(boxes[a:b], classes[a:b]))
            rows = batch.take(pa.array(np.concatenate(stay)))
            yield pa.RecordBatch.from_arrays([rows.column(f.name).cast(f.type) for f in kinds], schema=kinds)

    corner = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    rows = df.select(frame, F.col(tie).cast("long").alias(tie), F.col("cls").cast("int").alias("cls"), F.col("conf").cast("double").alias("conf"), *corner)
    rows = rows.withColumn("__down", -F.col("conf")).repartition(frame).sortWithinPartitions(frame, "__down", tie)
    return rows.mapInArrow(run, out)


def restore(x: Column, offset: Column | float, ratio: Column | float, limit: Column | float) -> Column:
    """A coordinate in the source image, held within it."""
    return clamp((x - offset) / ratio, 0, limit)


def merge_detections(found: Column, model: Column, boxes: Column) -> Column:
    """The map with this model's boxes, the others as they were."""
    return F.map_concat(F.map_filter(found, lambda k, v: k != model), F.map_from_arrays(F.array(model), F.array(boxes)))


def edge_mask(boxes: DataFrame, height: int, width: int, thickness: int, *, frame: str = "frame_id") -> DataFrame:
    """Painted pixels (frame, y, x) of the outlines of boxes (x1, y1, x2, y2).

    Corners are rounded, halves to even, and belong to the box; what reaches over the image is cut at
    its border, where the outline then runs.  Boxes with a corner that is null or not finite, inverted
    ones and those outside the image have no pixels.  Only outlines are made, a row of a box at a time.
    """
    at = {c: F.bround(F.col(c), 0) for c in ("x1", "y1", "x2", "y2")}
    finite = F.lit(True)
    for c in at:
        finite = finite & (F.abs(F.col(c)) < float("inf"))
    shown = finite & (at["x1"] <= at["x2"]) & (at["y1"] <= at["y2"]) & (at["x2"] >= 0) & (at["y2"] >= 0) & (at["x1"] < width) & (at["y1"] < height)
    within = lambda c, most: clamp(at[c], 0, most).cast("int")
    cut = boxes.where(F.coalesce(shown, F.lit(False))).select(
        frame, within("x1", width - 1).alias("left"), within("x2", width - 1).alias("right"), within("y1", height - 1).alias("top"), within("y2", height - 1).alias("bottom")
    )
    rows = cut.select("*", F.explode(F.sequence("top", "bottom")).alias("y"))
    left, right, band = F.col("left"), F.col("right"), thickness - 1
    edge_row = (F.col("y") - F.col("top") <= band) | (F.col("bottom") - F.col("y") <= band)
    sides = F.concat(F.sequence(left, F.least(left + band, right)), F.sequence(F.greatest(right - band, left), right))
    return rows.select(frame, "y", F.explode(F.when(edge_row, F.sequence(left, right)).otherwise(sides)).alias("x")).distinct()


def yuv(color: str) -> tuple[int, int, int]:
    """A colour ``#rrggbb`` in limited-range luma and chroma, by the fixed weights of BT.601."""
    r, g, b = bytes.fromhex(color.removeprefix("#"))
    weights = {"y": (16, 65.481, 128.553, 24.966), "u": (128, -37.797, -74.203, 112.0), "v": (128, 112.0, -93.786, -18.214)}
    y, u, v = (round(base + (wr * r + wg * g + wb * b) / 255) for base, wr, wg, wb in weights.values())
    return y, u, v


def paint(pixels: DataFrame, mask: DataFrame, color: str, *, frame: str = "frame_id") -> DataFrame:
    """``pixels`` (frame, plane ``y``, ``u`` or ``v``, y, x, v) with the colour where ``mask`` (frame, y, x) has luma pixels.

    A chroma cell is painted if one of its four luma pixels is.
    """
    luma, u, v = yuv(color)
    cells = chroma_mask(mask, frame=frame)
    one = lambda df, plane, value: df.select(frame, F.lit(plane).alias("plane"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.lit(value).alias("__color"))
    colored = one(mask, "y", luma).union(one(cells, "u", u)).union(one(cells, "v", v)).distinct()
    found = pixels.join(colored, [frame, "plane", "y", "x"], "left")
    return found.withColumn("v", F.coalesce("__color", "v")).select(*pixels.columns)


def chroma_mask(mask: DataFrame, *, frame: str = "frame_id") -> DataFrame:
    """Chroma cells of which a luma pixel is painted."""
    return mask.select(frame, F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _nearer(near: np.ndarray, mine: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The least squares of distances so far, and to a block of vectors, by matrix products of 1024 rows."""
    out, sizes = near.copy(), (part * part).sum(1)
    for at in range(0, len(mine), 1024):
        own = mine[at : at + 1024]
        square = (own * own).sum(1)[:, None] + sizes - 2 * own @ part.T
        out[at : at + 1024] = np.minimum(out[at : at + 1024], square.min(1))
    return out


def nearest_distances(
    queries: DataFrame, memory: DataFrame, *, vector: str = "v", distance: str = "distance", block: int = 4096, sent_bytes: int = 64 << 20, held: int = 65_536
) -> DataFrame:
    """``queries`` with the distance of each vector to the nearest of ``memory``; null without memory.

    Blocks of the memory meet batches of queries in matrix products, so neither side is paired in rows.
    A memory of up to ``sent_bytes`` is sent to the tasks; a larger one is packed into blocks, and each
    task holds ``held`` queries and runs through all blocks.  Vectors are of one length.
    """
    n, dim = memory.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    out = T.StructType([*queries.schema.fields, T.StructField(distance, T.DoubleType())])
    if 8 * n * dim > sent_bytes:
        return _nearest_of_blocks(queries, memory, vector, out, block, held)
    kept = memory.select(F.col(vector).alias("m")).toArrow().column("m").combine_chunks()
    shared = queries.sparkSession.sparkContext.broadcast(_matrix(kept) if len(kept) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = shared.value
        for batch in batches:
            found = pa.nulls(batch.num_rows, pa.float64())
            if bank is not None and batch.num_rows:
                mine = _matrix(batch.column(vector))
                near = np.full(len(mine), np.inf)
                for at in range(0, len(bank), block):
                    near = _nearer(near, mine, bank[at : at + block])
                found = pa.array(np.sqrt(np.maximum(near, 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=out.names)

    return queries.mapInArrow(run, out)


def _nearest_of_blocks(queries: DataFrame, memory: DataFrame, vector: str, out: T.StructType, block: int, held: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = _matrix(batch.slice(at, block).column("m"))
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()), pa.array([len(part)])], ["__block", "__rows"])

    cells = max(1, -(-queries.count() // held))
    own = queries.withColumns({"__cell": F.pmod(F.monotonically_increasing_id(), F.lit(cells)), "__kind": F.lit(0)})
    blocks = memory.select(F.col(vector).alias("m")).mapInArrow(pack, "__block binary, __rows long").withColumn("__kind", F.lit(1))
    blocks = blocks.withColumn("__cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    both = own.unionByName(blocks, allowMissingColumns=True).repartition(cells, "__cell").sortWithinPartitions("__cell", "__kind")
    names = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, mine, near = None, [], None, None

        def done() -> Iterator[pa.RecordBatch]:
            at = 0
            for part in waiting:
                found = pa.array(np.sqrt(np.maximum(near[at : at + part.num_rows], 0)))
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=out.names)

        for batch in batches:
            key = np.asarray(batch.column("__cell")) * 2 + np.asarray(batch.column("__kind"))
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                cell, kind = divmod(int(key[a]), 2)
                if cell != now:
                    if waiting:
                        yield from done()
                    now, waiting, mine = cell, [], None
                part = batch.slice(a, b - a)
                if kind == 0:
                    waiting.append(part.select(names))
                elif waiting:
                    if mine is None:
                        mine = np.concatenate([_matrix(w.column(vector)) for w in waiting])
                        near = np.full(len(mine), np.inf)
                    for raw, rows in zip(part.column("__block").to_pylist(), part.column("__rows").to_pylist(), strict=True):
                        near = _nearer(near, mine, np.frombuffer(raw).reshape(rows, -1))
        if waiting:
            yield from done()

    return both.mapInArrow(run, out)


def nearest_score(queries: DataFrame, memory: DataFrame, *, image: str, patch: str, vector: str = "v", block: int = 4096) -> DataFrame:
    """Per image the largest, over its patches, of the distance to the nearest vector of ``memory``."""
    found = nearest_distances(queries.select(image, vector), memory, vector=vector, block=block)
    return found.groupBy(image).agg(F.max("distance").alias("score"))


def anomaly_map(patches: DataFrame, h: int, w: int, height: int, width: int, *, image: str) -> DataFrame:
    """Distances of patches (image, y, x, distance) on a grid of (h, w) as a map of the image's size, by bilinear resize."""
    grid = patches.select(F.col(image).alias("frame_id"), "y", "x", F.col("distance").alias("v"))
    resized = bilinear(grid, h, w, height, width)
    columns = ("y", "x") if (h, w) == (height, width) else ("ty", "tx")
    return resized.select(F.col("frame_id").alias(image), F.col(columns[0]).alias("y"), F.col(columns[1]).alias("x"), F.col("v").alias("distance"))
