"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, new_path, written


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges, and of each the smallest end that it is connected with."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (far := root[root]).tobytes() != root.tobytes():
            root = far
    return ids, ids[root]


def stars(edges: DataFrame, a: str = "a", b: str = "b", held: int = 1 << 21) -> DataFrame:
    """``(a, b)``: edges with the components of ``edges``, at most one a node in each task, from a node to the smallest that the task connects it with.

    Where there are many more edges than nodes, this is little; twice, the second
    time in an eighth of the tasks. A task holds some ``held`` edges; with more nodes
    it passes on what it has. Ids are whole numbers; an edge with a null goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def joined() -> list[np.ndarray]:
            return list(_roots(*(np.concatenate([p[k] for p in parts]) for k in (0, 1))))

        for batch in batches:
            parts.append([batch.column(k).to_numpy() for k in (0, 1)])
            n += batch.num_rows
            if n >= held:
                parts = [joined()]
                n = len(parts[0][0])
                if 2 * n > held:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["a", "b"])
                    parts, n = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined()], ["a", "b"])

    rows = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    rows = materialize(rows.mapInArrow(run, "a long, b long"), "stars")
    tasks = rows.rdd.getNumPartitions()
    return materialize(rows.coalesce(-(-tasks // 8)).mapInArrow(run, "a long, b long"), "stars")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every end of an edge; component = smallest node.

    Each round lets a node take the smallest label among its neighbours and
    then the label of that label, which halves long chains. Labels are
    written to the shared folder each round; nothing but a yes/no comes to
    the driver. A hub with very many edges is safe: the join on its edges is
    a plain sort-merge join that adaptive execution splits, and the minimum
    is aggregated before the shuffle.

    Nulls at either end and self loops: a null end drops the edge; a self
    loop gives its node a component of its own. Repeated edges change
    nothing. No edges: an empty table. Columns besides the two are ignored.
    An error is raised if labels still change after ``max_rounds``; as they
    jump over their own paths, long chains need some dozens.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    root = new_path(spark, "components")
    both.write.parquet(f"{root}/edges")
    both = spark.read.schema(both.schema).parquet(f"{root}/edges")

    first = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
    first = first.select("node", F.least("node", "m").alias("component"), F.lit(True).alias("changed"))
    first.write.parquet(f"{root}/labels0")
    labels = spark.read.schema(first.schema).parquet(f"{root}/labels0")
    for i in range(1, max_rounds + 1):
        near = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("seen")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("seen").alias("seen"))
        step = labels.drop("changed").join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = step.join(jump, "mid", "left").select("node", F.coalesce("far", "mid").alias("component"), (F.coalesce("far", "mid") != F.col("old")).alias("changed"))
        step.write.parquet(f"{root}/labels{i}")
        discard(spark, f"{root}/labels{i - 1}")
        labels = spark.read.schema(first.schema).parquet(f"{root}/labels{i}")
        if labels.where("changed").isEmpty():
            discard(spark, f"{root}/edges")
            written(spark, root)
            return labels.select("node", "component")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
