"""Mixing sources to target weights by systematic sampling, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.shared import WORD, fresh

#: Fraction bits of an expected number of copies; sums of 2**31 documents stay exact in a long.
SHIFT = 30


def source_targets(
    sizes: DataFrame, source: str, size: str, weights: tuple[float, ...], share: float, most: float
) -> DataFrame:
    """Per source: ``source_size`` and ``target``.

    Sources rank by code point, null last, and take ``weights`` in turn.  ``share`` of all sizes is
    split by weight; a target above ``most`` times its source's size stops there and what it leaves
    is split again, until none is above.  That fixed point is ``min(most * size, level * weight)``
    with one level: sources fill up in the order of their cap per weight, so the level follows from
    running sums.  The windows run over one row per source.
    """
    by_rank = Window.orderBy(F.col(source).isNull(), F.col(source))
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    turn = (F.row_number().over(by_rank) - 1) % len(weights) + 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col(source).isNull(), F.col(source))
    everywhere = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("all", F.sum("source_size").over(everywhere) * F.lit(float(share)))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("w_left"))
    )
    # the first source whose cap is not reached fixes the level of all that follow
    open_level = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level")))
    per = per.withColumn("open", open_level.over(everywhere)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("open") * F.col("w"), F.col("cap")))
    return per.select(source, "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    size: Column | None = None,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    Documents of a source stand in the order of their size, so that a systematic sample takes
    small and large ones alike.  Each expects ``target / source_size`` copies; the running sum of
    that, moved by one offset per source, gains a copy at every integer it passes.  Positions come
    from counts by (source, size, part), so no window holds more than a part.  Sums are integers,
    so a rerun gives the same copies; a document gets at most ``ceil(most)``.

    Nulls: a null text has size 0; a null source is a source of its own; a null key ranks first.
    Repeated rows count one by one.  A source without words has target 0 and no copies.  An empty
    table gives an empty table.  Columns of ``docs`` keep their names; of the added ones, a
    clashing name is prefixed with ``_``.
    """
    n, total, goal, copies, part, at, first, name, none = fresh(
        docs, "size", "source_size", "target", "copies", "part", "at", "first", "name", "none"
    )
    counted = size if size is not None else F.regexp_count(F.col(text), F.lit(WORD))
    # 128 bits of the key order the documents of one size; the first 8 deal them into parts
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    docs = docs.withColumn(n, F.coalesce(counted, F.lit(0)).cast("long")).withColumns(
        {
            name: F.coalesce(F.col(source).cast("string"), F.lit("")),
            none: F.col(source).isNull(),
            part: F.substring(drawn, 1, 2),
        }
    )
    # docs are dealt once, by these keys, for the window and for the join
    keys, of_source = [name, none, n, part], [name, none]
    groups = docs.groupBy(*keys).agg(F.count("*").alias("rows"))
    sized = groups.groupBy(name, none, n).agg(F.sum("rows").alias("rows"))
    words = sized.select(
        F.when(~F.col(none), F.col(name)).alias("source"), (F.col(n) * F.col("rows")).alias("words")
    )
    targets = source_targets(words, "source", "words", weights, share, most)
    targets = targets.select(
        F.coalesce("source", F.lit("")).alias(name), F.col("source").isNull().alias(none), "source_size", "target"
    )
    up_to = (Window.unboundedPreceding, -1)
    runs = Window.partitionBy(*of_source).orderBy(n).rowsBetween(*up_to)
    parts = Window.partitionBy(name, none, n).orderBy(part).rowsBetween(*up_to)
    nothing = F.lit(0).cast("long")
    sized = sized.select(name, none, n, F.coalesce(F.sum("rows").over(runs), nothing).alias("before"))
    groups = groups.select(*keys, F.coalesce(F.sum("rows").over(parts), nothing).alias("inside"))
    placed = (
        groups.join(sized, [name, none, n])
        .join(targets, of_source)
        .select(*keys, F.struct((F.col("before") + F.col("inside")).alias("rows"), "source_size", "target").alias(first))
    )
    inner = Window.partitionBy(*keys).orderBy(drawn, key)
    docs = docs.withColumn(at, F.row_number().over(inner).cast("long")).join(placed, keys)
    docs = docs.withColumns({total: F.col(f"{first}.source_size"), goal: F.col(f"{first}.target")})
    one = 1 << SHIFT
    rate = F.when(F.col(total) > 0, F.floor(F.col(goal) / F.col(total) * one)).otherwise(0).cast("long")
    draw = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(source).cast("string"), F.lit("")))), 1, 7)
    offset = F.pmod(F.conv(draw, 16, 10).cast("long"), F.lit(one))
    end = F.col(at) + F.col(f"{first}.rows")
    passed = F.shiftright(end * rate + offset, SHIFT) - F.shiftright((end - 1) * rate + offset, SHIFT)
    return docs.withColumn(copies, passed.cast("int")).drop(name, none, part, at, first)


def emit_copies(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """One row per copy: a row with ``copies`` of 0 goes, one with 2 stands twice; columns but ``copies`` stay.

    A null number of copies counts as 0.  Repeated rows count one by one.  An empty table gives an empty table.
    """
    (unit,) = fresh(mixed, "unit")
    return mixed.withColumn(unit, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).drop(unit, copies)
