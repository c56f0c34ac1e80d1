"""Filters over media rows. Tag filters are semi joins; the rest are plain comparisons that reach the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.search_index import plain, terms_of


def under(col: Column, folder: Column | str) -> Column:
    """``col`` is ``folder`` or lies below it, with either separator."""
    f = F.lit(folder) if isinstance(folder, str) else folder
    return (col == f) | col.startswith(F.concat(f, F.lit("\\"))) | col.startswith(F.concat(f, F.lit("/")))


def filter_folders(df: DataFrame, folders: list[str], subfolders: bool = True, col: str = "folder") -> DataFrame:
    """P1. Rows in any of ``folders``, with or without what lies below; no folders: all rows."""
    if not folders:
        return df
    tests = [under(F.col(col), f) if subfolders else F.col(col) == f for f in folders]
    return df.where(reduce(or_, tests))


def filter_ratings(df: DataFrame, ratings: list[int]) -> DataFrame:
    """P2. Rows with one of the ratings 1 to 9 asked for; none asked for: all rows."""
    ratings = [r for r in ratings if 1 <= r <= 9]
    return df.where(F.col("rating").isin(ratings)) if ratings else df


def filter_name_bases(df: DataFrame, bases: list[str]) -> DataFrame:
    """P3. Rows whose name base equals every one of ``bases``, in normal form."""
    tests = [S.norm_base(F.col("filename")) == S.norm_tag(F.lit(b)) for b in bases]
    return df.where(reduce(and_, tests)) if tests else df


def filter_tags_all(df: DataFrame, image_tags: DataFrame, names: list[str]) -> DataFrame:
    """P4. Rows that carry every tag of ``names`` (relational division)."""
    wanted = {" ".join(n.lower().replace("_", " ").split()) for n in names}
    if not wanted:
        return df
    norm = S.norm_tag(F.col("tag"))
    hits = image_tags.where(norm.isin(sorted(wanted))).groupBy("image_id").agg(F.countDistinct(norm).alias("n")).where(F.col("n") == len(wanted))
    return df.join(hits.select(F.col("image_id").alias("id")), "id", "left_semi")


def search(df: DataFrame, image_tags: DataFrame, query: str) -> DataFrame:
    """P5. Rows where each comma-separated term stands in the file name, the search text or a tag.

    A scan: every text is read, and all terms share one pass over the tags,
    with a row of flags for each image. ``SearchIndex.search`` gives the same
    rows from a written index.
    """
    terms = terms_of(query)
    if not terms:
        return df
    hit = [plain(F.col("tag")).contains(t) for t in terms]
    flags = image_tags.where(reduce(or_, hit)).groupBy(F.col("image_id").alias("id")).agg(*[F.max(h).alias(f"__t{k}") for k, h in enumerate(hit)])
    joined = df.join(flags, "id", "left")
    tests = [plain(F.col("filename")).contains(t) | plain(F.col("search_text")).contains(t) | F.coalesce(F.col(f"__t{k}"), F.lit(False)) for k, t in enumerate(terms)]
    return joined.where(reduce(and_, tests)).select(*[joined[c] for c in df.columns])


def ids_only(df: DataFrame) -> DataFrame:
    """P6. The distinct ids of a selection."""
    return df.select("id").distinct()


def _roots_of(df: DataFrame, roots: DataFrame, col: str) -> DataFrame:
    """``df`` with each row's ancestors, itself included, joined with ``roots(path)`` by equality."""
    own = df.select("*", F.explode(F.array_union(S.path_ancestors(F.col(col)), F.array(S.path_parent(F.col(col))))).alias("__up"))
    plain = roots.select(F.array_join(S.segments(F.col("path")), "/").alias("__up")).distinct()
    return own.join(plain, "__up", "left_semi")


def under_roots(df: DataFrame, roots: DataFrame, col: str = "filepath") -> DataFrame:
    """P7. Rows below any of ``roots(path)``: an equi-join on ancestors, not a comparison with each root."""
    hit = _roots_of(df.select(col), roots, col).select(col).distinct()
    return df.join(hit, col, "left_semi")


def not_under_any_root(df: DataFrame, roots: DataFrame, col: str = "filepath") -> DataFrame:
    """P7. Rows below none of ``roots``. No roots at all: no rows, never all of them."""
    hit = _roots_of(df.select(col), roots, col).select(col).distinct()
    some = roots.limit(1).select(F.lit(True).alias("__some"))
    return df.join(hit, col, "left_anti").crossJoin(F.broadcast(some)).drop("__some")


def keep_under_failed(df: DataFrame, failed: DataFrame, col: str = "filepath") -> DataFrame:
    """P8. Rows below a folder of ``failed(path)`` that could not be read; they must not be removed."""
    return under_roots(df, failed, col)


def drop_ignored_pairs(pairs: DataFrame, ignored: DataFrame, show_ignored: bool = False) -> DataFrame:
    """P9. Pairs (a, b) without the ignored ones, or only those."""
    return pairs.join(ignored.select("a", "b").distinct(), ["a", "b"], "left_semi" if show_ignored else "left_anti")


def restrict_pairs(pairs: DataFrame, eligible: DataFrame) -> DataFrame:
    """P10. Pairs with both ends in ``eligible(id)``."""
    ids = eligible.select("id").distinct()
    one = pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi")
    return one.join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select(*pairs.columns)


def restrict_ends(rows: DataFrame, eligible: DataFrame) -> DataFrame:
    """P10, before pairs are made: of ``rows(id, …)`` those in ``eligible(id)``; the pairs of these are the pairs with both ends there."""
    return rows.join(eligible.select("id").distinct(), "id", "left_semi").select(*rows.columns)


def pending_work(df: DataFrame, flag: str) -> DataFrame:
    """P11. Rows whose ``flag`` is not set yet; tagging leaves videos out."""
    rows = df.where(~F.coalesce(F.col(flag), F.lit(False)))
    return rows.where("media_type <> 'video'") if flag == "tagged" else rows


def missing_size_backlog(df: DataFrame) -> DataFrame:
    """P12. Finished rows without a file size."""
    return df.where(F.col("meta_done") & (F.coalesce("file_size", F.lit(0)) == 0))


def cleaning_candidates(df: DataFrame) -> DataFrame:
    """P13. Rows with ``reason``: null for still images, why they are passed over for others."""
    reason = F.when(F.col("media_type") == "gif", "animated").when(F.col("media_type") == "video", "video")
    return df.withColumn("reason", reason)


def drop_ignored_words(predictions: DataFrame, words: DataFrame) -> DataFrame:
    """P14. Predicted tags without the ignored ones, in normal form."""
    return predictions.withColumn("__n", S.norm_tag(F.col("tag"))).join(words.select(S.norm_tag(F.col("word")).alias("__n")).distinct(), "__n", "left_anti").drop("__n")


def stale_derived(media: DataFrame, cache: DataFrame) -> DataFrame:
    """P15. Cached results ``cache(id, src_mtime)`` whose source has moved by a second or more."""
    return cache.join(media.select("id", "file_date"), "id").where(F.abs(F.col("src_mtime") - F.col("file_date")) >= 1).select("id")


def prune_paths(df: DataFrame, skip: list[str], col: str = "path") -> DataFrame:
    """S3. Paths without a folder of one of the ``skip`` names, whatever the case."""
    folders = F.transform(S.segments(S.path_parent(F.col(col))), lambda s: F.lower(s))
    return df.where(~F.arrays_overlap(folders, F.array(*[F.lit(s.lower()) for s in skip]))) if skip else df
