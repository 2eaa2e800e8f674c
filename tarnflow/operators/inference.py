"""Requests that share model calls: collected into batches, concatenated, run by one call each, split, and failed together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnflow.operators.batching import collect_batches, concatenate, split
from tarnflow.operators.recovery import fatal

#: A model, loaded for a key: all rows of a batch to as many rows.
Model = Callable[[np.ndarray], Any]
#: Models of a worker, by the token of a query and the key of a batch.
_LOADED: dict[tuple[str, str], Model] = {}


def call_batches(batches: DataFrame, load: Callable[[str], Model], *, token: str, key: str = "key", inputs: str = "inputs") -> DataFrame:
    """``batches`` with ``made``, what one call of the key's model gives for all ``inputs`` of a row, and ``failure``.

    A worker keeps a model of each key from batch to batch; one that fails is dropped, so the next batch
    loads it anew.  A fatal error ends the job.  ``token`` tells the models of one query from those of another.
    """
    out = T.StructType([*batches.schema.fields, *T.StructType.fromDDL("made array<array<double>>, failure string").fields])
    kinds = to_arrow_schema(out)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made, failures = [], []
            for name, rows in zip(part.column(key).to_pylist(), part.column(inputs).to_pylist(), strict=True):
                session, outputs, failure = (token, str(name)), None, None
                try:
                    if session not in _LOADED:
                        _LOADED[session] = load(name)
                    outputs = np.asarray(_LOADED[session](np.array(rows, np.float64)), np.float64).tolist()
                except Exception as e:
                    _LOADED.pop(session, None)
                    if fatal(e):
                        raise
                    failure = f"{type(e).__name__}: {e}"
                made.append(outputs)
                failures.append(failure)
            columns = [pa.array(made, kinds.field("made").type), pa.array(failures, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema=kinds)

    return batches.mapInArrow(run, out)


def infer_batches(
    requests: DataFrame, load: Callable[[str], Model], *, size: int, wait_us: int, service_us: int = 0, token: str = "model", rows: str = "rows", usable: Column | None = None, stream: str = "stream_id"
) -> DataFrame:
    """(stream, seq, batch, place, closed_us, outputs, error) of requests with ``seq``, ``at_us``, ``key`` and ``rows``,
    an array along its first axis.

    Requests of a stream, that is, of one worker, that come within ``wait_us`` and have the same key share one
    call of up to ``size`` of them.  ``outputs`` has as many rows as the request gave; if the call fails or gives
    another number than all requests have rows, they all have its ``error`` and no outputs.  Requests that are
    not ``usable`` are in no batch and have neither; requests without rows, too.
    """
    good = F.coalesce(F.size(rows) > 0, F.lit(False)) & (F.lit(True) if usable is None else F.coalesce(usable, F.lit(False)))
    taken = requests.where(good)
    placed = collect_batches(taken.select(stream, "seq", "at_us", "key"), size, wait_us, service_us, stream=stream)
    shared = taken.select(stream, "seq", "key", F.col(rows).alias("__rows")).join(placed, [stream, "seq"])
    calls = call_batches(concatenate(shared, "__rows", stream, "batch", "key"), load, token=token)
    answers = split(calls, F.col("made"), stream, "batch", "failure")
    told = answers.select(stream, "batch", "seq", "outputs", F.coalesce("failure", "error").alias("error"))
    found = placed.join(told, [stream, "batch", "seq"])
    return requests.select(stream, "seq").join(found, [stream, "seq"], "left").select(stream, "seq", "batch", "place", "closed_us", "outputs", "error")
