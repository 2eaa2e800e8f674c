"""Errors as data: what passes, what is dropped, what ends a stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An error whose message, or a cause's, has one of these in lower case ends the stream.
FATAL = (
    "cuda error:", "cuda out of memory", "device-side assert",
    "illegal memory access", "device lost", "driver shutting down",
    "gpu unavailable", "cuda scope failed", "context is destroyed",
    "cublas_status_alloc_failed", "cudnn_status_alloc_failed",
    "cuda driver", "cuda initialization", "no cuda-capable device",
    "nvidia driver", "cuda-capable devices are busy",
)


#: An error of such a type ends the stream, whatever its message.
FATAL_TYPES = ("MemoryError", "OutOfMemoryError", "ResourceSafetyError")


def is_fatal(*messages: Column, types: tuple[Column, ...] = (), fragments: tuple[str, ...] = FATAL) -> Column:
    """Whether one of the messages or types of an error and its causes is fatal; null messages and types say nothing."""
    whole = F.lower(F.concat_ws("\n", *messages))
    by_text = F.exists(F.array(*[F.lit(f) for f in fragments]), lambda f: F.contains(whole, f))
    return by_text | F.arrays_overlap(F.array_compact(F.array(F.lit(""), *types)), F.array(*[F.lit(t) for t in FATAL_TYPES]))


def origins(error: BaseException) -> list[BaseException]:
    """An error and all it came from, by cause or context, each once."""
    found = [error]
    for e in found:
        found += [x for x in {id(x): x for x in (e.__cause__, e.__context__)}.values() if x is not None and all(x is not y for y in found)]
    return found


def fatal(error: BaseException | None) -> bool:
    """Whether an error, or one it came from, ends the stream: by its type or by a fragment of its message."""

    def ends(e: BaseException) -> bool:
        names = {t.__name__ for t in type(e).__mro__}
        return bool(names.intersection(FATAL_TYPES)) or any(f in str(e).lower() for f in FATAL)

    return error is not None and any(map(ends, origins(error)))


def pass_through(df: DataFrame, failed: Column, changes: Mapping[str, Column], *, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """``changes`` where the step works; where it fails the row passes as it was, with ``keep`` set."""
    keep = keep or {}
    return df.withColumns({c: F.when(failed, keep.get(c, F.col(c) if c in df.columns else F.lit(None))).otherwise(v) for c, v in changes.items()})


def without_dropped(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """In a chain a dropped row keeps its place, marked; after it, it is gone."""
    return df.where(F.col(outcome) != "dropped").drop(outcome)


#: What a step leaves on a frame for the next one only.
TEMPORARY = ("model_input", "image_transform", "inference_profile")


def cleaned(df: DataFrame, failed: Column, *, output: str = "model_output", temporary: tuple[str, ...] = TEMPORARY) -> DataFrame:
    """Rows after a model's step, without what was there for it only, whether it worked or not; a failed one has no output."""
    return df.withColumn(output, F.when(~F.coalesce(failed, F.lit(False)), F.col(output))).drop(*temporary)
