"""Settings that change while a stream runs: each micro-batch sees one revision of them, and sees it again if it is tried again."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tarnflow.plans.pipeline import Pipeline
from tarnflow.plans.watch import LiveSettings


class Revisions:
    """What settings each micro-batch ran with: a small file a batch in a folder that outlives the driver, beside the checkpoint."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 100) -> None:
        self.jvm, self.keep = spark.sparkContext._jvm, keep
        self.folder = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, batch: int) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, f"batch-{batch:020d}.json")

    def get(self, batch: int) -> tuple[int, dict[str, Any]] | None:
        """(revision, settings) of a batch, if it has begun before."""
        at = self._file(batch)
        if not self.fs.exists(at):
            return None
        source = self.fs.open(at)
        try:
            found = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()
        return found["revision"], found["settings"]

    def put(self, batch: int, revision: int, settings: Mapping[str, Any]) -> None:
        """Written under another name and then named, so that a file is whole or not there; old ones go."""
        draft = self.jvm.org.apache.hadoop.fs.Path(self.folder, f".draft-{batch}")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps({"revision": revision, "settings": dict(settings)}).encode()))
        finally:
            out.close()
        self.fs.rename(draft, self._file(batch))
        if batch >= self.keep:
            self.fs.delete(self._file(batch - self.keep), False)


def run_live(
    stream: DataFrame, pipeline: Pipeline, read: Callable[[], str], revisions: str, sink: Callable[[DataFrame, int], None], **watch: Any
) -> DataStreamWriter:
    """A writer that puts each micro-batch of ``stream`` through ``pipeline`` and hands the rows, with their ``revision``, to ``sink``.

    Before a batch the settings that ``read`` gives are looked at; if the steps refuse them the old ones stay in
    force.  The batch's settings are written down before it runs.  A batch that has begun before, in this run or
    another, takes those it had then, so a sink that replaces what a batch wrote ends up with the rows of one revision.
    Steps see one micro-batch: those that count rows of a stream take a column that numbers them (``index``).
    """
    log = Revisions(stream.sparkSession, revisions)
    live = LiveSettings(read, pipeline.reload, **watch)

    def each(rows: DataFrame, batch: int) -> None:
        known = log.get(batch)
        if known is None:
            before = log.get(batch - 1) if batch else None
            if before is not None and live.taken is None:
                # a new run goes on with what the last one had until the file says otherwise
                pipeline.reload(before[1])
            live.check()
            old, had = before or (-1, None)
            revision = old if had == pipeline.settings else old + 1
            log.put(batch, revision, pipeline.settings)
            sink(pipeline.run(rows).withColumn("revision", F.lit(revision)), batch)
            return
        now = pipeline.settings
        pipeline.reload(known[1])
        try:
            sink(pipeline.run(rows).withColumn("revision", F.lit(known[0])), batch)
        finally:
            pipeline.reload(now)

    return stream.writeStream.foreachBatch(each)
