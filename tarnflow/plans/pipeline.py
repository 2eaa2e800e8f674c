"""A pipeline is a named list of steps, each a DataFrame to a DataFrame; it composes to one plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.replay import busy_skip, replay
from tarnflow.operators.sampling import drop_frames
from tarnflow.operators.scan import numbered
from tarnflow.plans.config import resolve, walk


#: Marks of rows inside a nested chain: whether a step still sees the row, and whether it has been dropped.
ALIVE, GONE = "__alive", "__gone"


class Step:
    """A step keeps the settings it was made with; ``configure`` lays its section over them."""

    steps: tuple[Step, ...] = ()
    #: Whether each row that goes in comes out once, so that a chain need not look.
    one_to_one = False

    def __init__(self, **settings: Any) -> None:
        self.defaults, self.settings = dict(settings), dict(settings)

    def configure(self, section: Mapping[str, Any] | None) -> None:
        unknown = set(section or {}) - set(self.defaults)
        if unknown:
            raise ValueError(f"{type(self).__name__} has no settings {sorted(unknown)}")
        self.settings = resolve(self.defaults, section)

    def route(self, sections: Mapping[str, Mapping[str, Any]]) -> None:
        """Take the section of its class, and let what is inside take theirs."""
        self.configure(sections.get(type(self).__name__))
        for inner in self.steps:
            inner.route(sections)

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def within(self, df: DataFrame) -> DataFrame:
        """The step inside a chain: rows with ``ALIVE`` go through it, others pass.

        A row that does not come out exactly once has failed: it goes on as it was, past the rest of the chain.
        Rows are told by ``stream_id`` and ``seq``, so the step must leave these.
        """
        marks, identity = [ALIVE, GONE], ["stream_id", "seq"]
        shown = df.where(ALIVE).drop(*marks)
        out = self.apply(shown).withColumns({ALIVE: F.lit(True), GONE: F.lit(False)})
        if missing := [c for c in identity if c not in out.columns]:
            raise ValueError(f"{type(self).__name__} drops {missing} and cannot be in a chain")
        rest = df.where(f"not {ALIVE}")
        if not self.one_to_one:
            made = out.withColumn("__n", F.count("*").over(Window.partitionBy(*identity)))
            out = made.where("__n = 1").drop("__n")
            same = [shown[c].eqNullSafe(F.col(f"__{c}")) for c in identity]
            failed = shown.join(out.select(*[F.col(c).alias(f"__{c}") for c in identity]), same, "left_anti")
            rest = rest.unionByName(failed.withColumns({ALIVE: F.lit(False), GONE: F.lit(False)}), allowMissingColumns=True)
        return out.unionByName(rest, allowMissingColumns=True)


class Change(Step):
    """Columns set from SQL, row by row; ``fails`` tells at which rows the step fails, ``drops``, of its result, which go.

    Changes of one step are made together, each from the columns before.
    """

    one_to_one = True

    def __init__(self, changes: Mapping[str, str], fails: str | None = None, drops: str | None = None) -> None:
        super().__init__()
        self.changes, self.fails, self.drops = dict(changes), fails, drops

    @staticmethod
    def _told(sql: str | None) -> Column:
        return F.lit(False) if sql is None else F.coalesce(F.expr(sql), F.lit(False))

    def apply(self, df: DataFrame) -> DataFrame:
        """Outside a chain a failure ends the job."""
        marked = df.withColumn("__fails", F.when(self._told(self.fails), F.raise_error(F.lit("a step failed")).cast("boolean")).otherwise(F.lit(False)))
        out = marked.where("not __fails").drop("__fails").withColumns({c: F.expr(v) for c, v in self.changes.items()})
        return out.where(~self._told(self.drops))

    def within(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn(ALIVE, F.col(ALIVE) & ~F.when(F.col(ALIVE), self._told(self.fails)).otherwise(F.lit(True)))
        for c in self.changes:
            if c not in df.columns:
                kind = df.select(F.expr(self.changes[c]).alias("x")).schema["x"].dataType
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        rows = rows.withColumns({c: F.when(F.col(ALIVE), F.expr(v)).otherwise(F.col(c)) for c, v in self.changes.items()})
        gone = F.coalesce(F.when(F.col(ALIVE), self._told(self.drops)), F.lit(False))
        return rows.withColumn(GONE, F.col(GONE) | gone).withColumn(ALIVE, F.col(ALIVE) & ~F.col(GONE))


class Apply(Step):
    """Any function of a DataFrame; ``one_to_one`` if each row comes out once."""

    def __init__(self, f, one_to_one: bool = False) -> None:
        super().__init__()
        self.f, self.one_to_one = f, one_to_one

    def apply(self, df: DataFrame) -> DataFrame:
        return self.f(df)


class DropFrames(Step):
    """Every ``keep_every``-th row; ``index`` is a column that numbers a stream's rows where a table has only some of them."""

    def __init__(self, keep_every: int = 1, index: str | None = None) -> None:
        super().__init__(keep_every=keep_every)
        self.index = index

    def apply(self, df: DataFrame) -> DataFrame:
        if self.index is not None:
            return df.where(F.col(self.index) % self.settings["keep_every"] == 0)
        return drop_frames(df, self.settings["keep_every"], slices="slice" if "slice" in df.columns else None)


class EveryNFrames(Step):
    """A chain of steps on every n-th row; the others pass.

    Each row must come out of each inner step once.  One that does not, or at which a step fails, goes on as
    the steps before have left it; one that a step drops is gone, and later steps do not see it.  Columns
    given as a mapping to SQL are a step of their own.  ``index`` is a column that numbers a stream's rows, where a
    table has only some of them, as a micro-batch has: the place counts all rows, whatever the interval was before.
    """

    def __init__(self, *steps: Step | Mapping[str, str], interval_frames: int = 1, index: str | None = None) -> None:
        if not steps:
            raise TypeError("EveryNFrames wants a step")
        super().__init__(interval_frames=interval_frames)
        self.index = index
        self.steps = tuple(Change(x) if isinstance(x, Mapping) else x for x in steps)
        if any(not isinstance(x, Step) for x in self.steps):
            raise TypeError("EveryNFrames takes steps")

    def configure(self, section: Mapping[str, Any] | None) -> None:
        super().configure(section)
        n = self.settings["interval_frames"]
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise ValueError("interval_frames must be a positive integer")

    def apply(self, df: DataFrame) -> DataFrame:
        slices = "slice" if "slice" in df.columns else None
        placed = df.withColumn("__at", F.col(self.index)) if self.index else numbered(df, "__at", slices=slices)
        rows = placed.withColumns({ALIVE: F.col("__at") % self.settings["interval_frames"] == 0, GONE: F.lit(False)}).drop("__at")
        for step in self.steps:
            rows = step.within(rows)
        return rows.where(f"not {GONE}").drop(ALIVE, GONE)


class TapSkipIfBusy(Step):
    """A side chain that sees a row only when it is idle; every row goes on unchanged.

    What the step gives for the rows it takes is handed to ``sink``, or is in ``side`` once the plan is made.  The
    section of the tap is that of its step.  Rows have ``at_us`` and ``service_us``.
    """

    one_to_one = True

    def __init__(self, step: Step, sink: Callable[[DataFrame], None] | None = None) -> None:
        super().__init__()
        self.step, self.sink, self.side = step, sink, None

    def configure(self, section: Mapping[str, Any] | None) -> None:
        self.step.configure(section)

    def route(self, sections: Mapping[str, Mapping[str, Any]]) -> None:
        self.configure(sections.get(type(self).__name__))

    def apply(self, df: DataFrame) -> DataFrame:
        taken = replay(df.select("stream_id", "seq", "at_us", "service_us"), busy_skip, "seq long, taken boolean", start=lambda: None)
        self.side = self.step.apply(df.join(taken.where("taken").drop("taken"), ["stream_id", "seq"]))
        if self.sink is not None:
            self.sink(self.side)
        return df


class RunOnce(Step):
    """The inner step sees one row of each stream: the first, or the first at which it does not fail.

    ``fails`` is SQL that tells at which rows it fails; such rows pass as they are and it is tried again.
    """

    def __init__(self, step: Step, fails: str | None = None) -> None:
        super().__init__()
        self.step, self.steps, self.fails = step, (step,), fails

    def apply(self, df: DataFrame) -> DataFrame:
        works = F.lit(True) if self.fails is None else ~F.coalesce(F.expr(self.fails), F.lit(False))
        turn = F.row_number().over(Window.partitionBy("stream_id").orderBy(works.desc(), "seq"))
        marked = df.withColumn("__first", (turn == 1) & works)
        first = self.step.apply(marked.where("__first").drop("__first"))
        return first.unionByName(marked.where("not __first").drop("__first"), allowMissingColumns=True)


class Pipeline:
    """Steps by name; a section of the settings holds for all steps of its class, nested ones too."""

    def __init__(self, name: str, settings: Mapping[str, Mapping[str, Any]] | None = None, group: str = "default") -> None:
        for x in (name, group):
            if not re.fullmatch("[A-Za-z0-9_-]{1,64}", x):
                raise ValueError(f"not a name: {x!r}")
        self.name, self.group, self.settings, self.steps = name, group, dict(settings or {}), []

    def step(self, step: Step) -> Pipeline:
        self.steps.append(step)
        return self

    def reload(self, settings: Mapping[str, Mapping[str, Any]]) -> bool:
        """Take new settings; if a step refuses its section, all keep the old ones."""
        every = [x for s in self.steps for x in walk(s)]
        before = [dict(x.settings) for x in every]
        try:
            for top in self.steps:
                top.route(settings)
        except ValueError:
            for x, old in zip(every, before, strict=True):
                x.settings = old
            return False
        self.settings = dict(settings)
        return True

    def run(self, df: DataFrame) -> DataFrame:
        for top in self.steps:
            top.route(self.settings)
            df = top.apply(df)
        return df
