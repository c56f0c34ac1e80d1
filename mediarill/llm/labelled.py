"""Bounded samples of labelled documents, and the split that holds documents out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, y)`` of the documents whose label may be learnt from; null labels are left out, of several labels of a document the largest counts."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, balanced: bool = False, most_bytes: int = 16 << 20) -> pd.DataFrame:
    """At most ``bound`` learnable rows ``(text, y)`` of at most ``most_bytes`` of text, the same ones on every run.

    Ids are taken in the order of a hash of them, from ``labels`` alone, so
    that documents are scanned once and joined with a few thousand ids, a
    number that does not grow. ``balanced``: half of the bound from each
    class, as far as it goes. Null labels are left out; of several labels of
    a document the largest counts. The texts found are written, and of those
    come to the driver, in the same order, as many as add up to no more than
    ``most_bytes`` (half of that from each class if ``balanced``); a text of
    more than a hundredth of it is left out.
    """
    spark = docs.sparkSession
    rows = learnable(labels, label)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if balanced:
        parts = [rows.where(F.col("y") == y).orderBy(*order).limit(bound // 2) for y in (0, 1)]
        picked = parts[0].unionByName(parts[1])
    else:
        picked = rows.orderBy(*order).limit(bound)
    ids = [(r["doc_id"], r["y"]) for r in picked.collect()]
    small = spark.createDataFrame(ids, "doc_id long, y int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(small), "doc_id")
    found = materialize(found.withColumn("size", F.octet_length("text")), "sample")
    held = Window.partitionBy("y" if balanced else F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    found = found.where(F.col("size") <= most_bytes // 100).withColumn("held", F.sum("size").over(held))
    fits = found.where(F.col("held") <= (most_bytes // 2 if balanced else most_bytes))
    return fits.select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "text"], ignore_index=True)
