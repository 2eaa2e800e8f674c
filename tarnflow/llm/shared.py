"""Places that driver and executors share, and the column conventions of the llm operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rank of a null id among ids: below every other.
NULL_ID = -(2**63)
#: The folder of a local session that names none.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a temporary one if that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tarnflow-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        at = _LOCAL[0]
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tarnflow/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send Python batches of ``rows`` rows: rows of whole texts may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Rows of a narrow table that are sent to the tasks at most, some 16 MB.
FEW = 200_000


def meet(rows: DataFrame, wanted: DataFrame, on: list[str], how: str = "inner", most: int = FEW) -> DataFrame:
    """``rows`` joined to a narrow table: it is sent to the tasks up to ``most`` rows, else both are shuffled."""
    return rows.join(wanted.hint("broadcast" if wanted.count() <= most else "merge"), on, how)


def meet_few(rows: DataFrame, wanted: DataFrame, bound: int, on: list[str]) -> DataFrame:
    """``rows`` joined to a narrow table of ``bound`` rows at most: few are sent to the tasks, more are left to Spark."""
    return rows.join(wanted.hint("broadcast") if bound <= FEW else wanted, on)


def release(spark: SparkSession) -> None:
    """Spark drops broadcasts and shuffle files of tables that are gone only when the driver collects its garbage: now."""
    spark.sparkContext._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Delete tables given by ``written`` whose readers are done; others are left alone."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
