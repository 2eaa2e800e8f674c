"""Rolling throughput and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.scan import count, scan, total, trailing


def counters(df: DataFrame, seconds: Column, *, keys: tuple[str, ...] = ("stream_id",), order: str = "seq", slices: str | None = None) -> DataFrame:
    """``df`` with ``frames``, its rows so far, and ``seconds``, theirs so far; negative times count as 0."""
    running = {"frames": count(), "seconds": total(F.greatest(seconds, F.lit(0.0)))}
    return scan(df, running, keys=keys, order=(order,), slices=slices)


def interval_metrics(df: DataFrame, interval_us: int, seconds: Column, inference: Column, *, keys: tuple[str, ...] = ("stream_id",), at: str = "at_us") -> DataFrame:
    """Per interval, from a key's first to its last: frames a second, mean milliseconds, mean inference.

    An interval without frames has a row too: 0 frames, 0.0 milliseconds and no mean inference.
    """
    n, m = F.count("*"), F.count(inference)
    found = df.groupBy(*keys, F.floor(F.col(at) / interval_us).cast("long").alias("interval")).agg(
        n.alias("frames"),
        F.avg(F.greatest(seconds, F.lit(0.0))).alias("__mean"),
        m.alias("inferences"),
        F.round(F.avg(inference) * 1000, 6).alias("inference_avg_ms"),
    )
    w = Window.partitionBy(*keys).orderBy("interval")
    gap = F.sequence(F.col("interval"), F.coalesce(F.lead("interval").over(w) - 1, F.col("interval")))
    rows = found.withColumn("__all", gap).withColumn("__at", F.explode("__all"))
    here = F.col("__at") == F.col("interval")
    return rows.select(
        *keys,
        F.col("__at").alias("interval"),
        F.when(here, F.col("frames")).otherwise(0).alias("frames"),
        F.when(here, F.col("frames") / (interval_us / 1e6)).otherwise(0.0).alias("fps"),
        F.when(here, F.round(F.coalesce(F.col("__mean"), F.lit(0.0)) * 1000, 6)).otherwise(0.0).alias("avg_ms"),
        F.when(here, F.col("inferences")).otherwise(0).alias("inferences"),
        F.when(here, F.col("inference_avg_ms")).alias("inference_avg_ms"),
    )


def trailing_average(df: DataFrame, name: str, value: Column, window_us: int, *, keys: tuple[str, ...] = ("stream_id",), at: str = "at_us", width_us: int | None = None) -> DataFrame:
    """``df`` with the mean over (now - window, now] as ``name``."""
    return trailing(df, {name: F.avg(value)}, window_us, keys=keys, at=at, width=width_us)


def connection_status(ok_at: Column, failed_at: Column, now: Column, stall_us: int = 5_000_000) -> Column:
    """wait before anything, failed if the last failure is not before the last success, stalled or ok by age."""
    return (
        F.when(failed_at.isNotNull() & (ok_at.isNull() | (failed_at >= ok_at)), "failed")
        .when(ok_at.isNull(), "wait")
        .when(now - ok_at > stall_us, "stalled")
        .otherwise("ok")
    )


def latest(value: Column, at: Column, success: Column) -> Column:
    """Value of the last success, null if that was null."""
    return F.max_by(F.struct(value.alias("v")), F.when(success, at))["v"]


def stage_report(parts: DataFrame, *keys: str) -> DataFrame:
    """Per key: mean milliseconds and number; the same of GPU times that are known."""
    return parts.groupBy(*keys).agg(
        F.round(F.avg("seconds") * 1000, 6).alias("avg_ms"),
        F.count("*").alias("n"),
        F.round(F.avg("gpu_ms"), 6).alias("avg_gpu_ms"),
        F.count("gpu_ms").alias("gpu_n"),
    )


def windowed_report(parts: DataFrame, since: DataFrame, window_us: int, *keys: str, kind: str = "kind", at: str = "at_us") -> DataFrame:
    """``stage_report`` over two periods: ``window``, after the kind's last report, and ``recent``, the last
    ``window_us``.  ``since`` has ``kind``, ``since_us`` and ``now_us``, one row a kind; later parts are not seen."""
    rows = parts.join(F.broadcast(since), kind).where(F.col(at) <= F.col("now_us"))
    names = F.array_compact(
        F.array(F.when(F.col(at) > F.col("since_us"), "window"), F.when(F.col(at) > F.col("now_us") - window_us, "recent"))
    )
    return stage_report(rows.withColumn("period", F.explode(names)), "period", *keys)


def bounded_history(df: DataFrame, keep: int, *, keys: tuple[str, ...], order: str, window_us: int | None = None) -> DataFrame:
    """The newest ``keep`` rows of each key, and none older than the window before the newest of all."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    rows = df
    if window_us is not None:
        # one row, joined so that no job runs while the plan is made
        newest = df.agg(F.max(order).alias("__now"))
        rows = df.join(F.broadcast(newest), F.col(order) > F.col("__now") - window_us).drop("__now")
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def finish_profile(parts: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Parts of a request, added up by name, with what its total has besides as ``other`` and the total."""
    summed = parts.groupBy(key, "part").agg(F.sum("seconds").alias("seconds"))
    used = summed.groupBy(key).agg(F.sum("seconds").alias("used"))
    rest = totals.join(used, key, "left").select(
        key,
        F.explode(
            F.array(
                F.struct(F.lit("other").alias("part"), F.greatest(F.lit(0.0), F.col("total") - F.coalesce("used", F.lit(0.0))).alias("seconds")),
                F.struct(F.lit("total").alias("part"), F.col("total").alias("seconds")),
            )
        ).alias("x"),
    )
    return summed.unionByName(rest.select(key, "x.part", "x.seconds"))


def first_kind(*fields: Column) -> Column:
    """The first profile that is bound."""
    return F.coalesce(*fields)


def backend_kind(backend: Column) -> Column:
    """Display name of a backend: known names in capitals but for one, others as they are."""
    known = backend.isin("torchscript", "ultralytics", "patchcore")
    return F.when(backend == "tensorrt", "TensorRT").when(known, F.upper(backend)).otherwise(backend)


def gaps(at: Column, limit_us: int, *, stream: str = "stream_id", order: str = "seq") -> Column:
    """Number of the session: a silence longer than ``limit_us`` ends one."""
    w = Window.partitionBy(stream).orderBy(order)
    new = F.when(at - F.lag(at).over(w) > limit_us, 1).otherwise(0)
    return new


def idle_periods(spans: DataFrame, wait_us: int, *, start: str = "start_us", end: str = "end_us", group: str = "stream_id") -> DataFrame:
    """Times at which a group has had no open span for ``wait_us``."""
    w = Window.partitionBy(group).orderBy(start, end)
    busy = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.lead(start).over(w)
    rows = spans.withColumn("busy_to", busy).withColumn("next_us", nxt)
    idle = F.col("next_us").isNull() | (F.col("next_us") - F.col("busy_to") > wait_us)
    return rows.where(idle).select(group, (F.col("busy_to") + wait_us).alias("stopped_us"))
