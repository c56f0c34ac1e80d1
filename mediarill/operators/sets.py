"""Comparing a catalogue with a listing, and set operations on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def catalog_diff(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """U1. (path, action): new, modified (both dates known and over a second apart), unchanged or removed."""
    c = catalog.select(F.col("filepath").alias("path"), F.col("file_date").alias("known"), F.lit(True).alias("had"))
    w = listing.select("path", "mtime", F.lit(True).alias("has"))
    moved = (F.coalesce("known", F.lit(0.0)) != 0) & (F.coalesce("mtime", F.lit(0.0)) != 0) & (F.abs(F.col("known") - F.col("mtime")) > 1)
    action = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "removed").when(moved, "modified").otherwise("unchanged")
    return c.join(w, "path", "full").select("path", action.alias("action"))


def union_facets(ratings: DataFrame, names: DataFrame) -> DataFrame:
    """U2. Rating facets before name facets, with id 0 for names."""
    return ratings.select("id", "name", "image_count").unionByName(names.select(F.lit(0).alias("id"), "name", "image_count"))


def dedupe_keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """U3. The first row of each key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def folder_tree_edit(names: DataFrame, gone: DataFrame, made: DataFrame, moved: DataFrame) -> DataFrame:
    """U4. ``names(folder)`` after moves ``moved(old, new)`` (the deepest wins), deletions and additions, subtrees included."""
    up = names.select("folder", F.explode(S.path_ancestors(F.col("folder"))).alias("old"))
    best = up.join(moved, "old").groupBy("folder").agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("m"))
    placed = names.join(best, "folder", "left").select(F.coalesce(F.concat("m.new", F.substr("folder", F.length("m.old") + 1)), F.col("folder")).alias("folder"))
    lost = placed.select("folder", F.explode(S.path_ancestors(F.col("folder"))).alias("path")).join(gone.select(F.col("folder").alias("path")).distinct(), "path", "left_semi")
    return placed.join(lost.select("folder").distinct(), "folder", "left_anti").union(made.select("folder")).distinct()


def except_known(found: DataFrame, existing: DataFrame) -> DataFrame:
    """U5. Rows of ``found`` that ``existing`` lacks."""
    return found.exceptAll(existing)


def intersect_known(found: DataFrame, existing: DataFrame) -> DataFrame:
    """U5. Distinct rows of both."""
    return found.intersect(existing)
