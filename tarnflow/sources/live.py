"""Long-running sources and sinks: retry, fatal errors, one output a generation."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from tarnflow.operators.publish import Publisher
from tarnflow.operators.recovery import fatal
from tarnflow.streaming.stateful import replay_stream


def keep_running(
    start: Callable[[], None], *, wait_s: float = 3.0, stopped: Callable[[], bool] = lambda: False, failed: Callable[[BaseException | None], None] = lambda e: None, sleep: Callable[[float], None] = time.sleep
) -> None:
    """Run a source again whenever it ends or fails, after a wait; only a fatal error or a stop ends this.

    ``start`` runs the source to its end, as ``lambda: query().awaitTermination()`` does.
    """
    while not stopped():
        try:
            start()
            failed(None)
        except Exception as e:
            if fatal(e):
                raise
            failed(e)
        if not stopped():
            sleep(wait_s)


def publish(df: DataFrame, path: str, checkpoint: str, *, generation: str = "generation"):
    """A terminal sink: each micro-batch is written under the generation of its rows; a batch that is
    tried again replaces what it wrote."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").partitionBy(generation).parquet(f"{path}/batch={batch}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def publish_packets(packets: DataFrame, path: str, checkpoint: str, *, wait_us: int = 3_000_000, stream: str = "stream_id"):
    """Packets of a stream through ``Publisher`` to a sink: only what it sends is written, by stream, with its decoding time."""
    machine = Publisher(wait_us)
    found = replay_stream(packets, machine.step, machine.schema, start=machine.start, stream=stream, order=("seq",))
    return publish(found.where("outcome = 'sent'").drop("outcome"), path, checkpoint, generation=stream)
