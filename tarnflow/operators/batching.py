"""What surrounds a batch: its key, its split, its errors and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.replay import Batcher, replay


def batch_key(backend: Column, gpu: Column, profile: Column, inputs: Column) -> Column:
    """Requests of equal key may share a batch: model, device, profile, and names, types and shapes but for the first axis.

    ``inputs`` maps a name to (dtype, shape).  The key is JSON with nulls written out, so no two
    signatures share one.
    """
    signature = F.transform(
        F.array_sort(F.map_entries(inputs)),
        lambda e: F.struct(
            e["key"].alias("name"), e["value"]["dtype"].alias("dtype"),
            F.when(F.size(e["value"]["shape"]) > 0, F.slice(e["value"]["shape"], F.lit(2), F.size(e["value"]["shape"]))).alias("axes"),
        ),
    )
    whole = F.struct(backend.alias("backend"), gpu.alias("gpu"), profile.alias("profile"), signature.alias("inputs"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


def concatenate(requests: DataFrame, rows: str, *batch: str, place: str = "place", request: str = "seq") -> DataFrame:
    """A row for each batch: ``inputs``, the rows of its requests one after another, and ``parts``, the
    (request, size) of each in order.  ``rows`` is a request's array along its first axis."""
    one = F.struct(F.col(place).alias("place"), F.col(request).alias("request"), F.col(rows).alias("rows"))
    whole = requests.groupBy(*batch).agg(F.array_sort(F.collect_list(one)).alias("__all"))
    parts = F.transform("__all", lambda r: F.struct(r["request"].alias("request"), F.size(r["rows"]).alias("size")))
    return whole.select(*batch, F.flatten(F.transform("__all", lambda r: r["rows"])).alias("inputs"), parts.alias("parts"))


def split(batches: DataFrame, outputs: Column, *batch: str, request: str = "seq") -> DataFrame:
    """A row for each request: its ``outputs``, as many as it gave inputs, or an ``error`` for all requests of
    a batch whose outputs are missing or not as many as its inputs."""
    wanted = F.aggregate("parts", F.lit(0), lambda n, p: n + p["size"])
    whole = F.coalesce(F.size(outputs), F.lit(-1)) == wanted
    error = F.when(~whole, F.concat(F.lit("outputs for "), wanted.cast("string"), F.lit(" inputs are not as many")))
    rows = batches.select(*batch, outputs.alias("__out"), error.alias("error"), "parts", F.posexplode("parts").alias("__i", "__part"))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("__i")), F.lit(0), lambda n, p: n + p["size"])
    own = F.when(F.col("error").isNull(), F.slice("__out", before + 1, F.col("__part.size")))
    return rows.select(*batch, F.col("__part.request").alias(request), own.alias("outputs"), "error")


def collect_batches(requests: DataFrame, size: int, wait_us: int, service_us: int, *, stream: str = "stream_id") -> DataFrame:
    """(stream, seq, batch, place, closed_us) of rows with ``seq``, ``at_us`` and ``key``."""
    machine = Batcher(size, wait_us, service_us)
    schema = "seq long, batch long, place long, closed_us long"
    order = ("at_us", "seq")
    return replay(requests, machine.step, schema, start=machine.start, stream=stream, order=order, finish=machine.finish)


def share_in_batch(value: Column, *batch: str) -> Column:
    """A value of a batch on each of its rows: an error, an elapsed time."""
    return F.max(value).over(Window.partitionBy(*batch))


def model_file(path: Column, cwd: Column) -> Column:
    """A model's absolute path; a relative one stands under its folder, ``.`` and ``..`` are resolved."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", cwd, path))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda seen, p: F.when(p == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.array_append(seen, p)),
    )
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def registry(requests: DataFrame, backend: str, model: str, fails: Column, *, order: str = "seq") -> DataFrame:
    """One worker for each backend and model: ``n_requests``, ``n_failed`` creations and the request that made it.

    A creation that fails is not kept, so the next request tries again; after the first that works, none does.
    """
    first = requests.groupBy(backend, model).agg(F.min(F.when(~fails, F.col(order))).alias("made_at"), F.count("*").alias("n_requests"))
    tried = requests.join(first.select(backend, model, "made_at"), [backend, model]).where(fails & (F.col("made_at").isNull() | (F.col(order) < F.col("made_at"))))
    failed = tried.groupBy(backend, model).agg(F.count("*").alias("n_failed"))
    return first.join(failed, [backend, model], "left").na.fill(0, ["n_failed"])
