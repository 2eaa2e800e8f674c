"""Batched inference: one call a batch, outputs split, errors shared, models kept and loaded anew."""

import os
import uuid

import pytest

from tarnflow.operators.inference import infer_batches
from tarnflow.plans.vision_steps import Inference

REQUESTS = "stream_id long, seq long, at_us long, key string, rows array<array<double>>, ok boolean"


def recorded(folder, fails=lambda rows: False):
    """A model that doubles, and writes a file for each load and call."""

    def note(kind, text):
        with open(os.path.join(folder, f"{kind}-{uuid.uuid4().hex}"), "w") as f:
            f.write(text)

    def load(key):
        note("load", key)

        def infer(rows):
            note("call", str(len(rows)))
            if fails(rows):
                raise RuntimeError("execution failed")
            return rows[:-1] if (rows < 0).any() else rows * 2

        return infer

    return load


def notes(folder, kind):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder) if f.startswith(kind))


def run(spark, rows, load, **options):
    df = spark.createDataFrame(rows, REQUESTS)
    return {(r.stream_id, r.seq): r for r in infer_batches(df, load, token=uuid.uuid4().hex, usable=df["ok"], **options).collect()}


def test_one_call_for_each_batch(spark, tmp_path):
    rows = [(1, i, i, "a" if i != 2 else "b", [[float(i)], [10.0 + i]] if i == 1 else [[float(i)]], True) for i in range(6)]
    rows += [(1, 6, 6, "a", [[1.0]], False), (1, 7, 7, "a", [], True), (1, 8, 8, "a", None, None)]
    got = run(spark, rows, recorded(str(tmp_path)), size=3, wait_us=100)
    # 0 with 1 and 3; then 2, put off, which puts off 4 and 5; what was put off only seeds
    assert [(got[1, i].batch, got[1, i].place) for i in range(6)] == [(0, 0), (0, 1), (1, 0), (0, 2), (2, 0), (3, 0)]
    assert notes(str(tmp_path), "call") == ["1", "1", "1", "4"]
    assert got[1, 1].outputs == [[2.0], [22.0]] and got[1, 3].outputs == [[6.0]] and got[1, 2].outputs == [[4.0]]
    assert all(got[1, i].error is None for i in range(6))
    assert all(got[1, i].batch is None and got[1, i].outputs is None and got[1, i].error is None for i in (6, 7, 8))


def test_a_failure_is_shared_and_the_model_loaded_anew(spark, tmp_path):
    rows = [(1, 0, 0, "a", [[5.0]], True), (1, 1, 1, "a", [[1.0]], True), (1, 2, 1000, "a", [[2.0]], True), (1, 3, 5000, "a", [[-3.0]], True)]
    got = run(spark, rows, recorded(str(tmp_path), lambda rows: (rows == 5).any()), size=2, wait_us=10)
    assert [got[1, i].error for i in range(2)] == ["RuntimeError: execution failed"] * 2
    assert got[1, 0].outputs is None and got[1, 2].outputs == [[4.0]] and got[1, 2].error is None
    assert "not as many" in got[1, 3].error and got[1, 3].outputs is None
    assert len(notes(str(tmp_path), "call")) == 3


def test_models_are_kept_from_batch_to_batch(spark, tmp_path):
    rows = [(1, i, i * 1000, "a", [[float(i)]], True) for i in range(20)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = run(spark, rows, recorded(str(tmp_path)), size=2, wait_us=10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 20 and len(notes(str(tmp_path), "call")) == 20
    assert len(notes(str(tmp_path), "load")) < 20


def test_fatal_failures_end_the_job(spark, tmp_path):
    def load(key):
        def infer(rows):
            raise RuntimeError("CUDA error: gone")

        return infer

    with pytest.raises(Exception, match="CUDA error"):
        run(spark, [(1, 0, 0, "a", [[5.0]], True)], load, size=2, wait_us=10)


def test_the_step_shares_calls(spark, tmp_path):
    calls = recorded(str(tmp_path))
    step = Inference("models/a.pt", lambda path, gpu, profile: calls(path), shared={"max_batch_size": 2, "max_batch_wait_ms": 1}, batch=True, backend="torchscript")
    df = spark.createDataFrame([(1, i, i, "a", [[float(i)]], True) for i in range(4)], REQUESTS)
    out = {r.seq: r for r in step.apply(df).collect()}
    assert [out[i].model_output for i in range(4)] == [[[0.0]], [[2.0]], [[4.0]], [[6.0]]] and out[0].model_id == "a.pt"
    assert notes(str(tmp_path), "call") == ["2", "2"]


def test_no_requests(spark, tmp_path):
    assert run(spark, [], recorded(str(tmp_path)), size=2, wait_us=10) == {}
