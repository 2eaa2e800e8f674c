"""Named tensors: shapes, nesting, model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.recovery import fatal

BACKENDS = ("tensorrt", "torchscript", "ultralytics", "patchcore")


def valid_inputs(inputs: Column, *, shared: bool = False) -> Column:
    """Whether a map of name to (dtype, shape) has names that are not blank and axes that are positive."""
    def right(k: Column, v: Column) -> Column:
        axes = (F.size(v["shape"]) > 0) & F.forall(v["shape"], lambda d: d > 0)
        one = F.get(v["shape"], F.lit(0)) == 1 if shared else F.lit(True)
        return (F.length(F.trim(k)) > 0) & axes & one

    entries = F.map_entries(inputs)
    return F.coalesce((F.size(entries) > 0) & F.forall(entries, lambda e: right(e["key"], e["value"])), F.lit(False))


def valid_backend(name: Column) -> Column:
    """One of the known backends, or ``module:Class``."""
    return name.isin(*BACKENDS) | name.rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*:[A-Za-z_]\w*\z")


def fits_engine(shape: Column, low: Column, high: Column, fixed: Column) -> Column:
    """Whether a shape has the engine's rank, its fixed sides (-1: free) and lies in its profile."""
    sides = F.forall(F.zip_with(shape, fixed, lambda s, f: (f == -1) | (s == f)), lambda x: x)
    least = F.forall(F.zip_with(shape, low, lambda s, x: x.isNull() | (s >= x)), lambda x: x)
    most = F.forall(F.zip_with(shape, high, lambda s, x: x.isNull() | (s <= x)), lambda x: x)
    return F.coalesce((F.size(shape) == F.size(fixed)) & sides & least & most, F.lit(False))


def flatten_outputs(outputs: Column) -> Column:
    """Nested outputs (name to a map of name to value) as one map, names joined by ``/``."""
    inner = F.transform(
        F.map_entries(outputs),
        lambda o: F.transform(F.map_entries(o["value"]), lambda i: F.struct(F.concat_ws("/", o["key"], i["key"]).alias("k"), i["value"].alias("v"))),
    )
    return F.map_from_entries(F.flatten(inner))


#: Levels of containers in JSON that are looked into.
DEPTH = 12


def _inside(v: Column) -> Column:
    """(``name``, ``v``) of what a JSON container holds: a list by place, a map by name; null for anything else."""
    items, fields = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
    listed = F.transform(items, lambda x, i: F.struct(F.concat(F.lit("output"), i.cast("string")).alias("name"), x.alias("v")))
    named = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("v")))
    return F.coalesce(listed, named)


def _place(path: Column) -> Column:
    return F.when(path == "", "the top").otherwise(path)


def _deeper(entry: Column) -> Column:
    """What takes the place of an entry (``path``, ``v``, ``fault``, ``open``) one level further down."""
    made = lambda path, v, fault, goes_on: F.struct(path.alias("path"), v.alias("v"), fault.cast("string").alias("fault"), goes_on.alias("open"))
    path, v, inside = entry["path"], entry["v"], _inside(entry["v"])

    def child(c: Column) -> Column:
        blank = F.trim(c["name"]) == ""
        full = F.when(path == "", c["name"]).otherwise(F.concat_ws("/", path, c["name"]))
        return made(full, c["v"], F.when(blank, F.concat(F.lit("blank name under "), _place(path))), ~blank)

    nothing = F.when(F.is_variant_null(v), F.concat(F.lit("no tensor at "), _place(path)))
    leaf = F.array(made(F.when(path == "", "output0").otherwise(path), v, nothing, F.lit(False)))
    empty = F.array(made(path, v, F.concat(F.lit("empty container at "), _place(path)), F.lit(False)))
    return F.when(inside.isNull(), leaf).when(F.size(inside) == 0, empty).otherwise(F.transform(inside, child))


def normalize_outputs(df: DataFrame, name: str, outputs: Column) -> DataFrame:
    """``df`` with ``outputs`` in JSON, in which what is no container stands for a tensor, as ``name``: (``outputs``: name to tensor, ``error``).

    A lone tensor is ``output0``, the i-th of a list ``output<i>``, and names of levels are joined by
    ``/``.  Empty containers, blank names, names that come twice, nulls, text that is not JSON (a key that comes
    twice in a map is not) and more than ``DEPTH`` levels are errors; of several, the first by place and name.
    """
    root, entries = F.col("__root"), F.col("__at")
    first = F.struct(F.lit("").alias("path"), root.alias("v"), F.lit(None).cast("string").alias("fault"), F.lit(True).alias("open"))
    rows = df.withColumn("__root", F.try_parse_json(F.coalesce(outputs, F.lit("null")))).withColumn("__at", F.array(first))
    for _ in range(DEPTH + 1):
        # a level is a projection of its own, and leaves rows without containers as they are
        down = F.flatten(F.transform(entries, lambda e: F.when(e["open"], _deeper(e)).otherwise(F.array(e))))
        rows = rows.withColumn("__at", F.when(F.exists(entries, lambda e: e["open"]), down).otherwise(entries))
    faults = F.transform(entries, lambda e: F.coalesce(e["fault"], F.when(e["open"], F.concat(F.lit(f"more than {DEPTH} levels at "), e["path"]))))
    names = F.transform(entries, lambda e: e["path"])
    twice = F.get(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1), F.lit(0))
    error = F.coalesce(F.get(F.array_compact(faults), F.lit(0)), F.when(twice.isNotNull(), F.concat(F.lit("two outputs named "), twice)))
    error = F.when(root.isNull(), "not JSON").otherwise(error)
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    found = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["path"].alias("k"), text(e["v"]).alias("t"))))
    return rows.withColumn(name, F.struct(F.when(error.isNull(), found).alias("outputs"), error.alias("error"))).drop("__root", "__at")


#: Keys under which an encoder's answer has its bytes, the first that has any.
BYTE_KEYS = ("bitstream", "data", "packet", "encoded_data", "payload")


def _as_bytes(v: Column) -> Column:
    """The numbers of a list of bytes, null for anything else."""
    items = F.try_variant_get(v, "$", "array<variant>")
    number = lambda x: F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))
    return F.when(F.forall(items, lambda x: F.coalesce(number(x).between(0, 255), F.lit(False))), F.transform(items, number))


def encoded_bytes(df: DataFrame, name: str, answer: Column) -> DataFrame:
    """``df`` with the bytes in an encoder's answer in JSON as ``name``: a list of bytes, or the first such list in it; null if there is none.

    Of a map the preferred keys come first, then all by name; ``DEPTH`` levels are looked into.
    """

    def inside(v: Column) -> Column:
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        preferred = F.filter(F.array(*[F.try_element_at(fields, F.lit(k)) for k in BYTE_KEYS]), lambda x: x.isNotNull())
        listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.concat(preferred, F.map_values(fields)))
        return F.coalesce(listed, F.array().cast("array<variant>"))

    found, rows = F.col("__at"), df.withColumn("__at", F.array(F.try_parse_json(answer)))
    for _ in range(DEPTH):
        # a level is a projection of its own
        rows = rows.withColumn("__at", F.flatten(F.transform(found, lambda v: F.when(_as_bytes(v).isNotNull(), F.array(v)).otherwise(inside(v)))))
    first = F.get(F.filter(F.transform(found, _as_bytes), lambda b: b.isNotNull()), F.lit(0))
    return rows.withColumn(name, F.unhex(F.array_join(F.transform(first, lambda b: F.lpad(F.hex(b), 2, "0")), ""))).drop("__at")



def engine_payload(file: Column, most: int = 1 << 20) -> Column:
    """An engine's file without the metadata before it: four bytes of length, lowest first, and a JSON object.

    What does not begin so is the engine as it is.
    """
    size = F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(F.substring(file, 1, 4)), F.lit("(..)"), F.lit(1))), ""), 16, 10).cast("long")
    fits = (F.octet_length(file) >= 4) & (size > 0) & (size <= F.least(F.lit(most), F.octet_length(file) - 4))
    text = F.try_validate_utf8(F.substring(file, F.lit(5), size.cast("int")).cast("string"))
    is_object = F.startswith(F.ltrim(text), F.lit("{")) & F.try_parse_json(text).isNotNull()
    rest = F.substring(file, size.cast("int") + 5, F.octet_length(file))
    return F.when(fits & F.coalesce(is_object, F.lit(False)), rest).otherwise(file)


def fits_bindings(inputs: Column, bindings: Column) -> Column:
    """Whether inputs (name to (dtype, shape)) have exactly the engine's names and, each, its type and a shape that
    fits: ``bindings`` maps a name to (dtype, fixed, low, high), where -1 in ``fixed`` is free within (low, high)."""
    names = F.array_sort(F.map_keys(inputs)) == F.array_sort(F.map_keys(bindings))

    def one(k: Column, v: Column) -> Column:
        b = F.try_element_at(bindings, k)
        return F.coalesce((v["dtype"] == b["dtype"]) & fits_engine(v["shape"], b["low"], b["high"], b["fixed"]), F.lit(False))

    return F.coalesce(names & F.forall(F.map_entries(inputs), lambda e: one(e["key"], e["value"])), F.lit(False))


def infer(
    df: DataFrame,
    factory: Callable[[], Callable[[pd.DataFrame], pd.Series]],
    output: str = "double",
    name: str = "model_output",
    *,
    usable: Column | None = None,
    guarded: bool = False,
) -> DataFrame:
    """``df`` with a model's output; a task makes its model once.  ``factory`` gives rows -> values.

    Rows that are not ``usable`` are not shown to the model and have no output.  If ``guarded``, a model that
    fails is made anew and the rows of the failed call are tried one by one; those that fail alone have no
    output.  A fatal error, and one of an unguarded model, ends the job.
    """
    mark = "__usable"
    rows = df.withColumn(mark, F.coalesce(usable, F.lit(False)) if usable is not None else F.lit(True))
    schema = f"{df._jdf.schema().toDDL()}, `{name}` {output}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list = []

        def call(part: pd.DataFrame) -> list:
            if not made:
                made.append(factory())
            return list(made[0](part))

        def values(part: pd.DataFrame) -> list:
            try:
                return call(part)
            except Exception as e:
                if not guarded or fatal(e):
                    raise
                made.clear()
                return [None] if len(part) == 1 else [v for i in range(len(part)) for v in values(part.iloc[i : i + 1])]

        for part in parts:
            shown = part[part[mark]].drop(columns=mark)
            out = pd.Series([None] * len(part), index=part.index, dtype=object)
            if len(shown):
                out[shown.index] = pd.Series(values(shown), index=shown.index, dtype=object)
            yield part.drop(columns=mark).assign(**{name: out})

    return rows.mapInPandas(run, schema)


def first_bytes(found: Column, preferred: tuple[str, ...] = ("bitstream", "data", "packet", "encoded_data", "payload")) -> Column:
    """The value of the first preferred key that there is, else of any key."""
    return F.coalesce(*[F.try_element_at(found, F.lit(k)) for k in preferred], F.get(F.map_values(found), F.lit(0)))


def header_units(codec: Column, bitstream: Column) -> Column:
    """Parameter sets of a byte stream in hex, each after a four-byte start code.

    Units begin after 000001; zeros before a start code belong to it.  H.264 keeps types 7 and 8 (low five bits), HEVC 32 to
    34 (six bits above the lowest).
    """
    spaced = F.regexp_replace(F.lower(F.hex(bitstream)), "(..)", "$1 ")
    split = F.split(spaced, "00 00 (?:00 )?01 ")
    units = F.slice(split, F.lit(2), F.size(split))
    first = lambda u: F.conv(F.substring(u, 1, 2), 16, 10).cast("int")
    h264 = F.lower(codec) == "h264"
    kind = lambda u: F.when(h264, first(u).bitwiseAND(31)).otherwise(F.shiftright(first(u), 1).bitwiseAND(63))
    wanted = lambda u: F.when(h264, kind(u).isin(7, 8)).otherwise(kind(u).isin(32, 33, 34))
    kept = F.filter(units, lambda u: (F.length(u) > 0) & wanted(u))
    return F.array_join(F.transform(kept, lambda u: F.concat(F.lit("00000001"), F.replace(u, F.lit(" "), F.lit("")))), "")
