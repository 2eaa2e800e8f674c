"""Steps inside steps: chains on some rows, side chains, and where sections of settings go."""

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import replay
from tarnflow.plans.pipeline import Apply, Change, DropFrames, EveryNFrames, Pipeline, RunOnce, Step, TapSkipIfBusy
from tarnflow.plans.registry import QUERIES
from tarnflow.sources.tables import event_stream
from tarnflow import plans

SF = "/root/testdata/sf0.001"


class Scale(Step):
    one_to_one = True

    def __init__(self, by=1):
        super().__init__(by=by)

    def apply(self, df):
        return df.withColumn("v", F.col("v") * self.settings["by"])


def frame(spark, n=6):
    return spark.createDataFrame([(0, i, i, 10 * i, 15) for i in range(n)], "stream_id long, seq long, v long, at_us long, service_us long")


def values(df):
    return {r.seq: r.v for r in df.collect()}


def test_chains_give_the_rows_of_the_closed_forms(spark):
    plans.all_queries()
    rows = event_stream(spark, SF).withColumn("v", F.col("k"))
    chain = EveryNFrames(Change({"v": "v + 1"}, fails="k % 5 = 0"), Change({"v": "v * 10"}, fails="event_type = 'error'"), interval_frames=2)
    got = Pipeline("a").step(chain).run(rows).select("stream_id", "seq", "v")
    assert sorted(got.collect()) == sorted(QUERIES["every_n_failure"](spark, SF).collect())
    blows_up = "if(k % 4 = 0, raise_error('a dropped row went on'), floor(v * 100 / (k % 4)))"
    chain = EveryNFrames(Change({"v": "v + 1"}, drops="k % 4 = 0"), Change({"v": blows_up}, drops="k % 3 = 0"), Change({"v": "v"}))
    got = Pipeline("b").step(chain).run(rows).select("stream_id", "seq", "v")
    assert sorted(got.collect()) == sorted(QUERIES["drop_protocol"](spark, SF).collect())


@pytest.mark.parametrize("n", [0, 2])
def test_a_step_that_gives_rows_twice_or_not_at_all_has_failed(spark, n):
    twice = Apply(lambda d: d.withColumn("v", F.col("v") + 100).withColumn("x", F.explode(F.array_repeat(F.lit(1), F.when(F.col("seq") == 2, n).otherwise(1)))).drop("x"))
    chain = EveryNFrames(Change({"v": "v + 1"}), twice, Change({"v": "v * 2"}), interval_frames=2)
    # row 2 keeps what the first step made and does not see the third
    assert values(chain.apply(frame(spark))) == {0: 202, 1: 1, 2: 3, 3: 3, 4: 210, 5: 5}


def test_new_columns_are_null_where_the_chain_did_not_run(spark):
    out = EveryNFrames(Change({"w": "v + 1"}), interval_frames=3).apply(frame(spark))
    assert {r.seq: r.w for r in out.collect()} == {0: 1, 1: None, 2: None, 3: 4, 4: None, 5: None}


def test_chains_in_chains(spark):
    inner = EveryNFrames(Change({"v": "v + 100"}), interval_frames=2)
    out = EveryNFrames(inner, RunOnce(Change({"v": "-v"})), interval_frames=2).apply(frame(spark, 8))
    # of rows 0, 2, 4, 6 the inner chain takes 0 and 4; the first of them is negated
    assert values(out) == {0: -100, 1: 1, 2: 2, 3: 3, 4: 104, 5: 5, 6: 6, 7: 7}


def test_a_tap_sees_rows_when_idle_and_changes_none(spark):
    seen = []
    tap = TapSkipIfBusy(Scale(7), sink=seen.append)
    assert values(Pipeline("t").step(tap).step(Scale(2)).run(frame(spark))) == {i: 2 * i for i in range(6)}
    taken = replay.replay(frame(spark), replay.busy_skip, "seq long, taken boolean", start=lambda: None)
    assert sorted(values(seen[0])) == sorted(r.seq for r in taken.where("taken").collect()) == [0, 2, 4]
    assert seen[0] is tap.side


def test_sections_go_to_steps_by_class_and_through_a_tap(spark):
    inner, under, once = Scale(), Scale(), Scale()
    pipeline = Pipeline("p", {"Scale": {"by": 3}, "TapSkipIfBusy": {"by": 5}, "EveryNFrames": {"interval_frames": 2}})
    pipeline.step(EveryNFrames(EveryNFrames(inner))).step(TapSkipIfBusy(under)).step(RunOnce(once))
    out = values(pipeline.run(frame(spark)))
    assert (inner.settings["by"], under.settings["by"], once.settings["by"]) == (3, 5, 3)
    # rows 0 and 4 are every second of every second; the first row goes through the last step too
    assert out == {0: 0, 1: 1, 2: 2, 3: 3, 4: 12, 5: 5}
    assert not pipeline.reload({"TapSkipIfBusy": {"to": 1}}) and under.settings == {"by": 5}
    assert pipeline.reload({}) and under.settings == {"by": 1} and inner.settings == {"by": 1}


def test_wrong_nesting_is_refused(spark):
    for wrong in ((), (3,)):
        with pytest.raises(TypeError):
            EveryNFrames(*wrong)
    with pytest.raises(ValueError, match="interval_frames"):
        EveryNFrames(Scale()).configure({"interval_frames": 0})
    with pytest.raises(ValueError, match="cannot be in a chain"):
        EveryNFrames(Apply(lambda d: d.drop("seq"))).apply(frame(spark))
    with pytest.raises(ValueError):
        EveryNFrames(Scale()).configure({"by": 2})
    assert values(Pipeline("d").step(EveryNFrames(DropFrames(2))).run(frame(spark))) == {i: i for i in range(6)}
