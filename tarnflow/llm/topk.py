"""Exact top-k search by inner product: tiles of queries times shards, partial selection, merging in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import NULL_ID, written
from tarnflow.llm.vectors import as_type, exact_type, pack, unpack, whole

#: Rows of a block, the unit in which vectors travel; queries times rows of one matrix product.
BLOCK, TILE = 2048, 1024
#: Queries that a task holds at once, and rows that it runs through for them.
HELD, RUN = 65_536, 1 << 22
#: Lists that meet in one merge of the tree.
FAN_IN = 16
#: Score of a place that nothing has taken.
NONE = -(2**63) + 1
_BLOCKS = "dim int, block long, n int, n_asks int, ids binary, asks binary, x binary"


def _blocks(vectors: DataFrame) -> DataFrame:
    """Rows that take part, by length, in blocks in the order of their ids; ``block`` numbers their first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = TaskContext.get().partitionId() << 36, {}

        def cut(dim: int, most: int) -> list[tuple]:
            nonlocal at
            parts = [np.concatenate(p) for p in zip(*waiting.pop(dim), strict=True)]
            out = []
            for begin in range(0, len(parts[0]), most):
                ids, asks, x = (p[begin : begin + most] for p in parts)
                order = np.argsort(ids, kind="stable")
                out.append((dim, at, len(ids), int(asks.sum()), ids[order].tobytes(), asks[order].tobytes(), pack(x[order])))
                at += len(ids)
            return out

        for batch in batches:
            rows, sizes, x = whole(batch.column("vector"))
            ids = np.asarray(batch.column("id").cast(pa.int64()).fill_null(NULL_ID))[rows]
            asks = np.asarray(batch.column("asks").fill_null(False)).astype(bool)[rows]
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                waiting.setdefault(dim, []).append((ids[own], asks[own], x[starts[own, None] + np.arange(dim)]))
            full = [d for d, parts in waiting.items() if sum(len(p[0]) for p in parts) >= BLOCK]
            # many lengths at once would hold many open blocks
            for dim in full if len(waiting) <= 64 else list(waiting):
                yield _rows(cut(dim, BLOCK))
        for dim in list(waiting):
            yield _rows(cut(dim, BLOCK))

    return vectors.mapInArrow(run, _BLOCKS)


def _asking(blocks: DataFrame) -> DataFrame:
    """The queries of each block alone; ``asks`` has their numbers as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                asks = np.flatnonzero(np.frombuffer(r["asks"], bool))
                ids, x = np.frombuffer(r["ids"], np.int64)[asks], unpack(r["x"]).reshape(r["n"], r["dim"])[asks]
                yield _rows([(r["dim"], r["block"], len(asks), len(asks), ids.tobytes(), (r["block"] + asks).tobytes(), pack(x))])

    return blocks.where("n_asks > 0").mapInArrow(run, _BLOCKS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["dim", "block", "n", "n_asks", "ids", "asks", "x"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class _Tops:
    """The best ``k`` rows so far of some queries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.rows, self.x, self.k = ids, rows, x, k
        self.most = float(np.abs(x).max()) if x.size else 0.0
        self.typed: dict[type, np.ndarray] = {}
        self.scores = np.full((len(ids), k), NONE, np.int64)
        self.found = np.full((len(ids), k), NULL_ID, np.int64)

    def see(self, first: int, ids: np.ndarray, x: np.ndarray) -> None:
        """Run through a block of rows in the order of their ids, the first of them numbered ``first``."""
        kind = exact_type(self.most * (float(np.abs(x).max()) if x.size else 0.0) * max(x.shape[1], 1))
        if kind not in self.typed:
            self.typed[kind] = as_type(self.x, kind)
        shard = as_type(x, kind).T
        for begin in range(0, len(self.ids), TILE):
            part = slice(begin, begin + TILE)
            scores = self.typed[kind][part] @ shard
            if kind is not object:
                scores = scores.astype(np.int64)
            elif any(abs(s) >= 1 << 63 for s in scores.ravel().tolist()):
                raise OverflowError("a score does not fit a long")
            else:
                scores = scores.astype(np.int64)
            own = self.rows[part] - first
            mine = np.flatnonzero((own >= 0) & (own < len(ids)))
            scores[mine, own[mine]] = NONE
            # only queries for which the block has something as good as their last
            some = np.flatnonzero(scores.max(axis=1) >= self.scores[part, -1])
            if len(some):
                self._take(begin + some, scores[some], ids)

    def _take(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        n = scores.shape[1]
        few = min(self.k, n)
        if np.abs(scores[scores != NONE]).max(initial=0) < 1 << 50:
            # a score and, below it, the place from behind: all different, so the selection is exact
            rank = np.where(scores == NONE, NONE, scores * n + np.arange(n)[::-1])
            best = np.argpartition(rank, n - few, axis=1)[:, n - few :]
        else:
            best = np.argsort(-scores, axis=1, kind="stable")[:, :few]
        s = np.concatenate([self.scores[queries], np.take_along_axis(scores, best, 1)], axis=1)
        i = np.concatenate([self.found[queries], ids[best]], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[queries], self.found[queries] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def batch(self, group: int) -> pa.RecordBatch:
        taken = self.scores != NONE
        offsets = pa.array(np.concatenate([[0], np.cumsum(taken.sum(axis=1))]).astype(np.int32))
        tops = pa.StructArray.from_arrays([pa.array(-self.scores[taken]), pa.array(self.found[taken])], ["below", "id"])
        columns = [pa.array(self.rows), pa.array(self.ids), pa.array(np.full(len(self.ids), group, np.int64)), pa.ListArray.from_arrays(offsets, tops)]
        return pa.RecordBatch.from_arrays(columns, ["row", "query_id", "part", "top"])


def _search(cells: DataFrame, k: int, runs: int) -> DataFrame:
    """Each cell of the grid has query blocks, then row blocks: the first are held, the second run through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tops = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if at != (r["cell"], r["dim"]):
                    if tops is not None:
                        yield tops.batch(at[0] // runs)
                    at, held, tops = (r["cell"], r["dim"]), [], None
                ids, x = np.frombuffer(r["ids"], np.int64), unpack(r["x"]).reshape(r["n"], r["dim"])
                if r["kind"] == 0:
                    held.append((ids, np.frombuffer(r["asks"], np.int64), x))
                    continue
                if held:
                    tops, held = _Tops(*(np.concatenate(p) for p in zip(*held, strict=True)), k), []
                if tops is not None:
                    tops.see(r["block"], ids, x)
        if tops is not None:
            yield tops.batch(at[0] // runs)

    return cells.mapInArrow(run, "row long, query_id long, part long, top array<struct<below:long,id:long>>")


def top_k(
    vectors: DataFrame, queries: Column, *, k: int = 5, key: str = "vec_id", vector: str = "embedding", held: int = HELD, run: int = RUN
) -> DataFrame:
    """The ``k`` rows of largest inner product with each row that ``queries`` names: ``query_id, rank, vec_id, score``.

    Entries become ``floor(256 * x)``; scores are whole numbers and exact.  Every other row is a
    candidate, the query's own row is not (a repeated id is another row); ties go to the smaller id, a
    null id being the smallest (an id of -2**63 reads as null).  Vectors null or holding null or
    non-finite entries take no part; vectors of different length do not meet; a query without
    another row, and an empty table, give no rows.  A score beyond a long is an error.  Repeated ids that ask are queries each.

    Rows and queries are dealt in blocks over a grid: a cell holds up to ``held`` queries and runs
    through up to ``run`` rows a block at a time, so that memory follows ``held``, and what is
    shuffled is each row once for ``held`` queries and each query once for ``run`` rows.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(F.col(key).cast("long").alias("id"), queries.alias("asks"), F.col(vector).alias("vector"))
    blocks = written(_blocks(chosen), "vector-blocks")
    n_blocks, n, n_asks = blocks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_asks"), F.lit(0))).first()
    across = max(1, -(-n_asks // held))
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    down = max(1, min(n_blocks, max(-(-n // run), -(-wanted // across))))
    group = lambda seed, of: F.pmod(F.xxhash64("block", F.lit(seed)), F.lit(of))
    own = blocks.withColumn("kind", F.lit(1)).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("g", group(1, down))
    asked = _asking(blocks).withColumn("kind", F.lit(0)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("h", group(2, across))
    both = own.withColumn("asks", F.lit(None).cast("binary")).unionByName(asked)
    cells = both.withColumn("cell", F.col("g") * across + F.col("h")).repartition(down * across, "cell").sortWithinPartitions("cell", "dim", "kind", "block")
    tops = _search(cells.select("cell", "dim", "kind", "block", "n", "ids", "asks", "x"), k, across)
    while True:
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        tops = tops.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("row", "query_id", "part").agg(merged)
        if down <= FAN_IN:
            break
        down = -(-down // FAN_IN)
    listed = tops.select("query_id", F.posexplode("top").alias("at", "found"))
    known = lambda c: F.when(c != F.lit(NULL_ID), c)
    return listed.select(
        known(F.col("query_id")).alias("query_id"), (F.col("at") + 1).alias("rank"), known(F.col("found.id")).alias("vec_id"), (-F.col("found.below")).alias("score")
    )
