"""Gates that need the order of a stream but no state machine: closed forms over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.scan import count, last, scan, top


def seconds(pts: Column, num: Column, den: Column) -> Column:
    """A time ``pts * num / den`` as (whole seconds, rest), which compares exactly across bases.

    Rests of denominators of up to ten digits differ by 10**-20 at least, so their floors in these units
    differ too.  Null for a base that is not positive, or of more digits.
    """
    units = pts.cast("decimal(19,0)") * num.try_cast("decimal(10,0)")
    below = den.try_cast("decimal(10,0)")
    rest = F.pmod(units, below)
    whole = ((units - rest) / below).cast("decimal(30,0)")
    parts = rest.cast("decimal(10,0)") * F.lit(str(10**20)).cast("decimal(21,0)")
    part = ((parts - F.pmod(parts, below)) / below).cast("decimal(21,0)")
    known = (num > 0) & (den > 0) & pts.isNotNull() & whole.isNotNull()
    return F.when(known, F.struct(whole.alias("whole"), part.alias("part")))


def monotonic_gate(
    df: DataFrame, at: Column, *, sent: Column | None = None, resets: Column | None = None, keys: tuple[str, ...] = ("stream_id",), order: str = "seq", slices: str | None = None
) -> DataFrame:
    """Rows whose time is after every earlier sent one's.

    Rejected rows never exceed the running maximum, so they need not be told apart.  With ``sent``,
    rows that could not be written do not count, yet are themselves tried.  A row with ``resets`` is
    bad input: it is dropped, and what was sent before it no longer counts.
    """
    how = {"keys": keys, "order": (order,), "slices": slices}
    rows, counted = df.withColumn("__at", at), F.lit(True) if sent is None else sent
    if resets is None:
        rows = scan(rows, {"__top": top(F.when(counted, F.col("__at")))}, **how, own=False)
        later = F.col("__top").isNull() | (F.col("__at") > F.col("__top"))
        return rows.where(F.col("__at").isNotNull() & later).drop("__at", "__top")
    # runs only rise, so the largest (run, time) is of the last run
    rows = scan(rows.withColumn("__bad", F.coalesce(resets, F.lit(False))), {"__run": count(F.col("__bad"))}, **how)
    counted = ~F.col("__bad") & counted & F.col("__at").isNotNull()
    rows = scan(rows, {"__top": top(F.when(counted, F.struct("__run", "__at")))}, **how, own=False)
    later = F.coalesce((F.col("__top.__run") < F.col("__run")) | (F.col("__at") > F.col("__top.__at")), F.lit(True))
    return rows.where(F.col("__at").isNotNull() & ~F.col("__bad") & later).drop("__at", "__top", "__bad", "__run")


def keyframe_gate(df: DataFrame, changed: Column, failed: Column, keyframe: Column, *, stream: str = "stream_id", order: str = "seq", slices: str | None = None) -> DataFrame:
    """Rows that are decoded: after a change (at its own row) or a failure (at the next one), none
    before a keyframe has come."""
    how, at = {"keys": (stream,), "order": (order,), "slices": slices}, F.col(order)
    rows = scan(df, {"__changed": top(F.when(changed, at)), "__key": top(F.when(keyframe, at))}, **how)
    rows = scan(rows.withColumn("__fails", failed), {"__failed": top(F.when(F.col("__fails"), at + 1))}, **how, own=False)
    reset = F.greatest("__changed", "__failed")
    return rows.where(reset.isNull() | F.coalesce(F.col("__key") >= reset, F.lit(False))).drop("__changed", "__key", "__fails", "__failed")


def carry_forward(df: DataFrame, name: str, value: Column, sets: Column, clears: Column, *, keys: tuple[str, ...], order: str = "seq", slices: str | None = None) -> DataFrame:
    """``df`` with the value that was set last, unless it was cleared since, as ``name``."""
    held = last(F.when(sets, value), F.coalesce(sets, F.lit(False)) | F.coalesce(clears, F.lit(False)))
    rows = scan(df, {"__held": held}, keys=keys, order=(order,), slices=slices)
    return rows.withColumn(name, F.col("__held.v")).drop("__held")


def epochs(change: Column, *, keys: tuple[str, ...] = ("stream_id",), order: str = "seq") -> Column:
    """Revision in force at a row: changes up to and with it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.count(F.when(change, 1)).over(w)


def epoch_tags(changes: list[Column], *, stream: str = "stream_id", order: str = "seq") -> list[Column]:
    """For each slot of a chain, what its outputs are tagged with: (slot, revision) of it and of all before it.

    A slot whose upstream tag changes is made anew, so ordered state of a slot goes by (stream, tag).
    """
    revisions = [epochs(c, keys=(stream,), order=order) for c in changes]
    pairs = [F.struct(F.lit(i).alias("slot"), r.alias("revision")) for i, r in enumerate(revisions)]
    return [F.array(*pairs[: i + 1]) for i in range(len(pairs))]


def as_of(rows: DataFrame, settings: DataFrame, at: str, value: str, *, keys: tuple[str, ...] = (), slice_us: int = 86_400_000_000) -> DataFrame:
    """``rows`` with the newest ``value`` set at or before their time; by a union, so nothing is paired.

    Time is cut into slices; a slice is told the last setting of those before it, by one row a slice
    and key.  So one key, or none, may hold all rows, as long as no slice does.  Of settings of one
    time the largest value counts, null being the least.  A row without time has no setting.
    """
    kind = settings.schema[value].dataType
    marked = rows.withColumns({"__set": F.lit(None).cast(kind), "__is": F.lit(1)})
    given = settings.where(F.col(at).isNotNull()).select(*keys, at, F.col(value).alias("__set"), F.lit(0).alias("__is"))
    both = marked.unionByName(given, allowMissingColumns=True).withColumn("__part", F.floor(F.col(at) / slice_us))
    newest = F.max(F.when(F.col("__is") == 0, F.struct(F.col(at), F.col("__set").alias("set"))))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    last = both.groupBy(*keys, "__part").agg(newest.alias("newest"))
    told = last.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__slice"), F.last("newest", ignorenulls=True).over(before).alias("__told"))
    same = F.col("__part").eqNullSafe(F.col("__slice"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = Window.partitionBy(*keys, "__part").orderBy(at, "__is", "__set").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("__is") == 0, F.struct(F.col("__set").alias("set"))), ignorenulls=True).over(within)
    found = both.withColumn("__held", held).where("__is = 1").join(told, same, "left")
    chosen = F.when(F.col(at).isNull(), None).when(F.col("__held").isNotNull(), F.col("__held.set")).otherwise(F.col("__told.set"))
    return found.select(*[c for c in rows.columns if c != value], chosen.alias(value))
