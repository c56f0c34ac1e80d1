"""Counts, facets and summaries over media rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .filters import filter_folders


def folder_counts(media: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """A1. Rows in each folder; folders of ``folders(folder)`` without rows get 0."""
    counts = media.groupBy("folder").agg(F.count("*").alias("image_count"))
    if folders is None:
        return counts
    return counts.join(folders.select("folder").distinct(), "folder", "full").select("folder", F.coalesce("image_count", F.lit(0)).alias("image_count"))


def folder_rollup(counts: DataFrame) -> DataFrame:
    """A2. For every ancestor folder: what lies directly in it and in all below."""
    up = counts.select(F.array_join(S.segments(F.col("folder")), "/").alias("own"), "image_count", F.explode(S.path_ancestors(F.col("folder"))).alias("folder"))
    return up.groupBy("folder").agg(F.sum(F.when(F.col("own") == F.col("folder"), F.col("image_count")).otherwise(0)).alias("own_count"), F.sum("image_count").alias("total_count"))


def selection_total(counts: DataFrame, folders: list[str], subfolders: bool = True) -> DataFrame:
    """A3. Rows in a selection of folders."""
    return filter_folders(counts, folders, subfolders).agg(F.coalesce(F.sum("image_count"), F.lit(0)).alias("total"))


def tag_counts(image_tags: DataFrame, tags: DataFrame, media: DataFrame | None = None, once: bool = False) -> DataFrame:
    """A4. Images of each tag, and whether anyone set it by hand; ``media`` filters, and is not joined when absent.

    ``once``: ``image_tags`` has each image and tag once, so rows are counted where they are.
    """
    n, by_hand = (F.count if once else F.countDistinct)("image_id").alias("image_count"), F.max(F.col("source") == "manual").alias("manual")
    if media is None:
        counts = image_tags.groupBy("tag").agg(n, by_hand)
    else:
        rows = image_tags.join(media.select(F.col("id").alias("image_id")), "image_id", "left_semi")
        counts = rows.groupBy("tag").agg(n).join(image_tags.groupBy("tag").agg(by_hand), "tag")
    return counts.join(tags.withColumnRenamed("name", "tag"), "tag").select(S.display_tag(F.col("tag")).alias("name"), "category", "image_count", "manual")


def name_facet(media: DataFrame) -> DataFrame:
    """A5. Rows of each normal name base, under the spelling of the smallest id."""
    shown = F.trim(F.regexp_replace(F.translate(S.name_base(F.col("filename")), "_", " "), "\\s+", " "))
    rows = media.select("id", S.norm_base(F.col("filename")).alias("key"), shown.alias("shown")).where("key <> ''")
    return rows.groupBy("key").agg(F.min_by("shown", "id").alias("name"), F.count("*").alias("image_count")).select("name", "image_count")


def rating_facet(media: DataFrame) -> DataFrame:
    """A6. Rows of each rating above 0, as pseudo tags with ids below 0."""
    return media.where("rating > 0").groupBy("rating").agg(F.count("*").alias("image_count")).select((-F.col("rating")).alias("id"), F.col("rating").cast("string").alias("name"), "image_count")


def alphabet_facet(names: DataFrame, col: str = "name") -> DataFrame:
    """A7. Names by first letter: A to Z, ``#`` for the rest, ``unknown`` apart."""
    first = F.upper(F.substring(F.trim(col), 1, 1))
    letter = F.when(F.lower(F.trim(col)) == "unknown", "unknown").when(first.rlike("^[A-Z]$"), first).otherwise("#")
    return names.groupBy(letter.alias("letter")).agg(F.count("*").alias("n"))


def tag_overlap_report(image_tags: DataFrame, ids: DataFrame) -> DataFrame:
    """A8. For each tag in a selection ``ids(id)``: how many carry it, and whether all do."""
    chosen = ids.select(F.col("id").alias("image_id")).distinct()
    total = chosen.agg(F.count("*").alias("n"))
    rows = image_tags.join(chosen, "image_id", "left_semi")
    counts = rows.groupBy(S.norm_tag(F.col("tag")).alias("key")).agg(F.min("tag").alias("name"), F.countDistinct("image_id").alias("image_count"))
    return counts.join(F.broadcast(total)).select("name", "image_count", (F.col("image_count") == F.col("n")).alias("common"))


def page_totals(df: DataFrame, per_page: int = 60) -> DataFrame:
    """A9. Rows of a selection and its pages."""
    return df.agg(F.countDistinct("id").alias("total")).select("total", F.ceil(F.col("total") / per_page).cast("long").alias("pages"))


def catalog_stats(media: DataFrame) -> DataFrame:
    """A10. Rows of the catalogue."""
    return media.agg(F.count("*").alias("total_images"))


def progress_counts(media: DataFrame, signature: DataFrame) -> DataFrame:
    """A11. Done and pending for metadata, tags and signatures, in one pass."""
    rows = media.join(signature.select("id", F.lit(True).alias("signed")), "id", "left")
    n = lambda c: F.count_if(c)
    still = F.col("media_type") != "video"
    signed = F.coalesce("signed", F.lit(False))
    return rows.agg(
        F.count("*").alias("total"), n(F.col("meta_done")).alias("meta_done"), n(~F.col("meta_done")).alias("meta_pending"), n(still & F.col("tagged")).alias("tags_done"), n(still & ~F.col("tagged")).alias("tags_pending"), n(still & signed).alias("signed"), n(still & ~signed).alias("signed_pending")
    )


def payload_stats(df: DataFrame, col: str) -> DataFrame:
    """A12. Rows with a payload, and its bytes."""
    return df.agg(F.count(col).alias("n"), F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).alias("bytes"))


def change_fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """A13. Row count, and maximum and sum of each number column: changes when rows do."""
    return df.agg(F.count("*").alias("n"), *[F.max(c).alias(f"max_{c}") for c in cols], *[F.sum(c).alias(f"sum_{c}") for c in cols])


def coverage(image_tags: DataFrame) -> DataFrame:
    """A14. Images with any tag."""
    return image_tags.agg(F.countDistinct("image_id").alias("tagged_images"))


def document_frequency(image_tags: DataFrame, least: int = 2) -> DataFrame:
    """A15. Images of each tag, for tags of ``least`` images or more."""
    return image_tags.groupBy("tag").agg(F.countDistinct("image_id").alias("df")).where(F.col("df") >= least)


def _parts_key(c: Column) -> Column:
    """A name like ``A + B`` as the sorted list of its lower-cased parts, so that orders and spaces don't matter."""
    return F.array_join(F.array_sort(F.transform(F.split(F.lower(c), "\\+"), lambda p: F.trim(p))), "+")


def next_numbers(media: DataFrame) -> DataFrame:
    """A16. For each base name and kind of media: the highest ``(N)`` in use plus one; a bare name counts as 1.

    ``A + B`` and ``B+A`` are one base.
    """
    stem = F.regexp_replace("filename", "(?s)^(.*)\\.[^.]*$", "$1")
    base, number = F.regexp_replace(stem, "\\s*\\(\\d+\\)$", ""), F.regexp_extract(stem, "\\((\\d+)\\)$", 1).try_cast("long")
    return media.groupBy(_parts_key(base).alias("base"), "media_type").agg((F.max(F.coalesce(number, F.lit(1))) + 1).alias("next_number"))


def word_frequency(media: DataFrame, q: str) -> DataFrame:
    """A17. Words of the search text that contain ``q``, of two letters and occurrences or more."""
    words = media.select(F.explode(F.split("search_text", " ")).alias("word")).where(F.col("word").contains(q) & (F.length("word") >= 2))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def stage_timing(events: DataFrame, stage: str, seconds: str) -> DataFrame:
    """A18. Items, mean and total time of each stage."""
    return events.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.avg(seconds).alias("mean_s"), F.sum(seconds).alias("total_s"))


def import_summary(diff: DataFrame) -> DataFrame:
    """A19. Paths by action."""
    return diff.groupBy("action").agg(F.count("*").alias("n"))


def group_summary(groups: DataFrame, ignored: DataFrame) -> DataFrame:
    """A20. Groups, members and ignored pairs. ``groups(group_id, id, …)``."""
    n = ignored.agg(F.count("*").alias("ignored_pairs"))
    return groups.agg(F.countDistinct("group_id").alias("groups"), F.count("*").alias("members")).join(F.broadcast(n))


def rating_level(levels: DataFrame) -> DataFrame:
    """A21. ``(image_id, level, score)`` to the winner; questionable goes to its higher neighbour, keeping its score."""
    score = lambda n: F.coalesce(F.max(F.when(F.col("level") == n, F.col("score"))), F.lit(0.0))
    best = levels.groupBy("image_id").agg(F.max_by("level", F.struct("score", "level")).alias("won"), F.max("score").alias("score"), score("explicit").alias("e"), score("sensitive").alias("s"))
    level = F.when(F.col("won") == "questionable", F.when(F.col("e") >= F.col("s"), "explicit").otherwise("sensitive")).otherwise(F.col("won"))
    return best.select("image_id", level.alias("level"), "score")


def fastest_by(measurements: DataFrame, key: str, seconds: str, baseline: str) -> DataFrame:
    """A22. Mean time of each provider, its speed against the baseline's, and whether it is the fastest."""
    mean = measurements.groupBy(F.col(key).alias("provider")).agg(F.avg(seconds).alias("mean_s"))
    both = mean.agg(F.min("mean_s").alias("least"), F.max(F.when(F.col("provider") == baseline, F.col("mean_s"))).alias("base"))
    return mean.join(F.broadcast(both)).select("provider", "mean_s", (F.col("base") / F.col("mean_s")).alias("speedup"), (F.col("mean_s") == F.col("least")).alias("fastest"))
