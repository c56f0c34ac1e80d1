"""Exact top-k by inner product with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize, scratch

CELLS = "block long, dims int, keys binary, ids binary, low binary, step binary, cells binary"
QUERIES = "block long, dims int, ids binary, exact binary"
FOUND = "query_id long, key long, upper double, lower double"

#: Components from here on raise an error, and so do scores that don't fit 64 bits.
LARGEST = 2**61


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in the batch."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def _packed(make, size: int, columns: list[str], names: list[str]):
    """A mapInArrow function that packs vectors ``e`` of one length, with the ``columns`` beside them, into blocks of ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[list[np.ndarray]]] = {}
        number = TaskContext.get().partitionId() << 32

        def flush(d: int) -> pa.RecordBatch:
            nonlocal number
            row = make(*[np.concatenate(parts) for parts in zip(*held.pop(d), strict=True)])
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([d], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in row]], names)

        for batch in batches:
            for k in range(0, batch.num_rows, size):
                piece = batch.slice(k, size)
                beside = [piece.column(c).to_numpy(zero_copy_only=False) for c in columns]
                for rows, m in _by_length(piece, "e"):
                    d = m.shape[1]
                    held.setdefault(d, []).append([*[c[rows] for c in beside], m])
                    if sum(len(p[-1]) for p in held[d]) >= size:
                        yield flush(d)
        for d in list(held):
            yield flush(d)

    return run


def _cells(keys: np.ndarray, ids: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """A block of the approximation file: 256 equal cells a dimension over the block's own range."""
    low = m.min(0)
    step = (m.max(0) - low) // 256 + 1
    return [keys, ids, low, step, ((m - low) // step).astype(np.uint8)]


class _Open:
    """The vectors that may still be among the ``k`` best of each query of a block, by their bounds."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q.astype(np.float64), k
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * len(q_ids)

    def scan(self, keys: np.ndarray, ids: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray) -> None:
        """Adds a block's vectors whose upper bound reaches the kth best lower bound so far.

        A score lies between q·corner + sum(min(q, 0)(step - 1)) and
        q·corner + sum(max(q, 0)(step - 1)), corner being the cell's low end;
        both are widened by what rounding may take from sums of such size.
        """
        base = (self.q * step) @ cells.astype(np.float64).T + (self.q @ low.astype(np.float64))[:, None]
        reach = np.maximum(np.abs(low.astype(np.float64)), np.abs(low + 256.0 * step))
        slack = np.abs(self.q) @ reach * (len(low) + 4) * 2.0**-50 if len(low) else np.zeros(len(self.q))
        up, down = np.maximum(self.q, 0) @ (step - 1.0) + slack, np.minimum(self.q, 0) @ (step - 1.0) - slack
        for i in range(len(self.q_ids)):
            others = np.flatnonzero(ids != self.q_ids[i])
            had = self.held[i]
            lower = np.concatenate([had[2], base[i, others] + down[i]])
            upper = np.concatenate([had[1], base[i, others] + up[i]])
            floor = np.partition(lower, len(lower) - self.k)[len(lower) - self.k] if len(lower) > self.k else -np.inf
            near = np.flatnonzero(upper >= floor)
            self.held[i] = (np.concatenate([had[0], keys[others]])[near], upper[near], lower[near])

    def rows(self) -> pa.RecordBatch:
        many = [len(h[0]) for h in self.held]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.q_ids, many)), *[pa.array(np.concatenate([h[c] for h in self.held])) for c in range(3)]], [f.split()[0] for f in FOUND.split(", ")])


def _scan(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, _Open] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            at = {n: batch.column(n)[row] for n in batch.schema.names}
            d, name = at["dims"].as_py(), at["q_block"].as_py()
            read = lambda c, t: np.frombuffer(at[c].as_buffer(), t)  # noqa: B023, E731
            if name not in held:
                if len(held) >= 64:
                    yield held.pop(next(iter(held))).rows()
                q_ids = read("q_ids", np.int64)
                held[name] = _Open(q_ids, read("q", np.int64).reshape(len(q_ids), d), k)
            ids = read("ids", np.int64)
            held[name].scan(read("keys", np.int64), ids, read("low", np.int64), read("step", np.int64), read("cells", np.uint8).reshape(len(ids), d))
    for open_ in held.values():
        yield open_.rows()


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact inner products of ``q`` and ``e``."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            piece = batch.slice(k, 1024)
            scores = np.zeros(piece.num_rows, np.int64)
            other = dict(zip(("q", "e"), (list(_by_length(piece, c)) for c in ("q", "e")), strict=True))
            for (rows, q), (_, e) in zip(other["q"], other["e"], strict=True):
                if (np.abs(q.astype(np.float64) * e).sum(1) >= 2.0**63).any():
                    raise ValueError("a score does not fit 64 bits")
                scores[rows] = (q * e).sum(1)
            yield pa.RecordBatch.from_arrays([piece.column("query_id"), piece.column("vec_id"), pa.array(scores)], ["query_id", "vec_id", "score"])


def _whole(embedding: Column, scale: float) -> Column:
    def one(x: Column) -> Column:
        y = F.floor(x * scale)
        return F.when(F.abs(x * scale) < float(LARGEST), y).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))

    return F.transform(embedding, one)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, block: int = 4096, query_block: int = 256, blocks_a_group: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` largest inner products, exactly.

    Components become ``floor(scale * x)``. Of equal vectors only the
    ``k + 1`` smallest ids can matter; they are written as the table of exact
    vectors. The approximation file holds 8-bit cells of them in blocks.

    1. Blocks of queries and blocks of cells are dealt to groups and meet by
       an equi-join on a grid of groups. A task hands on what may be among
       the k best by its bounds; the kth best lower bound over all groups is
       then each query's floor, and what doesn't reach it goes.
    2. Exact vectors are read in the order of their upper bounds: first each
       query's k best bounds; then, the kth exact score being known, only
       those whose bound still reaches it. The rest are never read.

    Vectors that are null, or hold a null, NaN or infinite component, take no
    part, nor do rows without vec_id. A query is not its own candidate (rows
    of its vec_id are left out). Only vectors of the query's length have a
    score. Rows that repeat a vec_id are candidates of their own; as a query
    the least of their vectors counts. Ties go to the smaller vec_id. Fewer
    than ``k`` candidates: all. Empty tables: empty result. A component of
    2**61 or more once scaled, or a score of 2**63 or more, raises an error.
    Other columns are not looked at.
    """
    spark = vectors.sparkSession
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fit)

    whole = usable(vectors).select("vec_id", _whole(F.col("embedding"), scale).alias("e"))
    whole = whole.withColumn("n", F.row_number().over(Window.partitionBy("e", "vec_id").orderBy("vec_id"))).where(F.col("n") <= k)
    whole = whole.withColumn("n", F.dense_rank().over(Window.partitionBy("e").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    with scratch():
        exact = materialize(whole.select(F.monotonically_increasing_id().alias("key"), "vec_id", "e"), "exact", kept=True)
        names = [f.split()[0] for f in CELLS.split(", ")]
        file = materialize(exact.mapInArrow(_packed(_cells, block, ["key", "vec_id"], names), CELLS), "approximation")
        asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select(F.col("vec_id").alias("query_id"), _whole(F.col("embedding"), scale).alias("e"))
        asked = materialize(asked, "queries", kept=True)
        names = [f.split()[0] for f in QUERIES.split(", ")]
        packed = materialize(asked.mapInArrow(_packed(lambda ids, m: [ids, m], query_block, ["query_id"], names), QUERIES), "query_blocks")

        parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n_file, n_asked = file.count(), packed.count()
        over, down = max(1, min(n_file, parallel), -(-n_file // blocks_a_group)), max(1, -(-n_asked // blocks_a_group))
        group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = packed.select(group(down).alias("q_group"), every(over).alias("group"), "dims", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("exact").alias("q"))
        right = file.withColumn("group", group(over)).select("group", every(down).alias("q_group"), "dims", "keys", "ids", "low", "step", "cells")
        pairs = left.join(right, ["q_group", "group", "dims"]).drop("q_group", "group")
        found = materialize(pairs.mapInArrow(lambda batches: _scan(batches, k), FOUND), "found")

        best = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower"), "key"))).where(F.col("n") <= k)
        floors = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lower")).alias("floor"))
        near = found.join(floors, "query_id").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
        near = materialize(near.select("query_id", "key", "upper"), "near", kept=True)
        # A limit inside a window goes ahead of the shuffle, so a query with many candidates is not gathered in one task.
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "key"))
        head = materialize(near.withColumn("place", place).where(F.col("place") <= k).select("query_id", "key"), "head", kept=True)

    def scored(some: DataFrame) -> DataFrame:
        both = some.select("query_id", "key").join(exact, "key").join(asked.withColumnRenamed("e", "q"), "query_id")
        return both.select("query_id", "vec_id", "q", "e").mapInArrow(_score, "query_id long, vec_id long, score long")

    first = materialize(scored(head), "first")
    certain = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = near.join(head, ["query_id", "key"], "left_anti").join(certain, "query_id").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = first.unionByName(scored(rest)).withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
