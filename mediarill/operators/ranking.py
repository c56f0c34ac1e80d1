"""Sorted pages, top lists, numbering and best-of choices."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.shared import materialize

# The keys of each gallery order; the direction applies to the first.
ORDERS = {"newest": ["file_date", "folder", "filename"], "folder": ["folder", "filename", "file_date"], "name": ["filename", "folder", "file_date"]}
# Formats with a compression grid, formats without loss, and the tolerances of their comparison.
GRID_FORMATS, LOSSLESS, GRID_TIE, GRID_SLACK = ["jpg", "jpeg", "png"], ["png", "bmp", "tiff"], 0.02, 0.10


def gallery_order(sort: str = "newest", descending: bool = True) -> list:
    keys = [F.col(k) if k == "file_date" else S.natural_key(F.col(k)) for k in ORDERS[sort]]
    return [keys[0].desc() if descending else keys[0].asc(), *[k.asc() for k in keys[1:]], F.col("id").asc()]


def gallery_page(df: DataFrame, sort: str = "newest", descending: bool = True, page: int = 1, per_page: int = 60, early: int = 10_000) -> DataFrame:
    """W1. One page of a selection in natural order.

    Pages that end within the first ``early`` rows are a top-k. A later one is
    found by order statistics: the sort keys alone are dealt out by ranges and
    written by range, the counts of ranges (as many as Spark has shuffle
    partitions) tell which of them hold the page, and only those are
    read again and sorted. No task holds the rows before the page.
    """
    skip = (page - 1) * per_page
    if skip + per_page <= early:
        return df.orderBy(*gallery_order(sort, descending)).offset(skip).limit(per_page)
    own = [F.col(k) if k == "file_date" else S.natural_key(F.col(k)) for k in ORDERS[sort]]
    names = [f"__k{k}" for k in range(len(own))]
    order = [F.desc(names[0]) if descending else F.asc(names[0]), *names[1:], "id"]
    keys = df.select("id", *[c.alias(n) for c, n in zip(own, names, strict=True)])
    dealt = materialize(keys.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges", partition_by=["__range"])
    counts = sorted((r["__range"], r["n"]) for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect())
    ends = list(itertools.accumulate(n for _, n in counts))
    held = [(k, e - n) for (k, n), e in zip(counts, ends, strict=True) if e > skip and e - n < skip + per_page]
    first = held[0][1] if held else 0
    found = dealt.where(F.col("__range").isin([k for k, _ in held])).orderBy(*order).offset(skip - first).limit(per_page)
    return df.join(found, "id").orderBy(*order).select(*df.columns)


def keyset_page(df: DataFrame, after: int, n: int = 256, skip: DataFrame | None = None) -> DataFrame:
    """W2. The next ``n`` rows behind an id, without those of ``skip(id)``."""
    rows = df.where(F.col("id") > after)
    return (rows.join(skip.select("id"), "id", "left_anti") if skip is not None else rows).orderBy("id").limit(n)


def sort_groups(groups: DataFrame, mode: str = "size") -> DataFrame:
    """W3. Groups by size, or by similarity up or down; ties by group."""
    first = {"size": F.desc("size"), "similarity_desc": F.desc("similarity"), "similarity_asc": F.asc("similarity")}[mode]
    return groups.orderBy(first, "group_id")


def sort_matches(matches: DataFrame, mode: str = "similarity") -> DataFrame:
    """W4. Matches by similarity or file size, largest first."""
    return matches.orderBy(F.desc("file_size" if mode == "size" else "similarity"), "id")


def suggest_tags(image_tags: DataFrame, tags: DataFrame, q: str, image_id: int | None = None, each: int = 10, most: int = 14) -> DataFrame:
    """W5. Tags that contain ``q``: the ``each`` most frequent of both kinds, without those the image has; prefixes first."""
    norm = S.norm_tag(F.col("tag"))
    rows = image_tags.where(norm.contains(q)).join(tags.withColumnRenamed("name", "tag"), "tag")
    kind = F.when(F.col("category") == "character", "name").otherwise("auto")
    counts = rows.groupBy(norm.alias("key"), kind.alias("type")).agg(F.min("tag").alias("tag"), F.countDistinct("image_id").alias("image_count"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("image_count"), "key"))).where(F.col("k") <= each)
    if image_id is not None:
        top = top.join(image_tags.where(F.col("image_id") == image_id).select(norm.alias("key")), "key", "left_anti")
    name = F.when(F.col("type") == "name", S.display_name(F.col("tag"))).otherwise(S.display_tag(F.col("tag")))
    return top.orderBy(F.col("key").startswith(q).desc(), F.desc("image_count"), "key", "type").limit(most).select(name.alias("name"), "image_count", "type")


def suggest(media: DataFrame, image_tags: DataFrame, q: str, most: int = 12) -> DataFrame:
    """W6. Suggestions for a search box from names, tags, folders and words; the first kind that has a name keeps it."""
    plain = lambda c: F.translate(F.lower(F.col(c)), "_", " ")
    bases = media.select("id", S.norm_base(F.col("filename")).alias("key"), F.translate(S.name_base(F.col("filename")), "_", " ").alias("name")).where(F.col("key").contains(q))
    names = bases.groupBy("key").agg(F.min_by("name", "id").alias("name"), F.count("*").alias("image_count")).orderBy(F.desc("image_count"), "key").limit(8).select("name", "image_count", F.lit("tag").alias("type"), F.lit(0).alias("o"))
    tags = image_tags.where(plain("tag").contains(q)).groupBy(plain("tag").alias("key")).agg(F.min("tag").alias("name"), F.countDistinct("image_id").alias("image_count"))
    tags = tags.orderBy(F.desc("image_count"), "key").limit(8).select(S.display_tag(F.col("name")).alias("name"), "image_count", F.lit("mltag"), F.lit(1))
    folders = media.where(plain("folder").contains(q)).groupBy("folder").agg(F.count("*").alias("image_count")).orderBy(F.desc("image_count"), "folder").limit(5)
    folders = folders.select(S.suggestion_folder_label(F.col("folder"), q).alias("name"), "image_count", F.lit("folder"), F.lit(2))
    out = names.union(tags).union(folders)
    if " " not in q:
        words = media.select(F.explode(F.split("search_text", " ")).alias("w")).where(F.col("w").contains(q) & (F.length("w") >= 2)).groupBy("w").agg(F.count("*").alias("image_count"))
        out = out.union(words.orderBy(F.desc("image_count"), "w").limit(15).where("image_count >= 2").select(F.initcap("w"), "image_count", F.lit("meta"), F.lit(3)))
    key = F.when(F.col("type") == "folder", F.concat(F.lit("\\"), F.col("name"))).otherwise(F.lower("name"))
    first = out.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("o", F.desc("image_count"), "name"))).where("k = 1")
    return first.orderBy(S.norm_tag(F.col("name")).startswith(q).desc(), F.desc("image_count"), "o", "name").limit(most).select("name", "image_count", "type")


def _pixels() -> F.Column:
    return F.col("width").cast("long") * F.col("height")


def best_copy(members: DataFrame) -> DataFrame:
    """W7. The best member of each group: pixels, little compression, no loss, size, rating, age, id.

    ``members(group_id, id, width, height, blk, fmt, file_size, rating, file_date)``.
    """
    order = [_pixels().desc(), F.coalesce("blk", F.lit(9.0)), F.when(F.col("fmt").isin(LOSSLESS), 0).otherwise(1), F.desc("file_size"), F.desc(F.coalesce("rating", F.lit(0))), F.coalesce("file_date", F.lit(0.0)), "id"]
    return members.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy(*order))).where("k = 1").drop("k")


def _beaten(rows: DataFrame) -> DataFrame:
    """(group_id, id) of the members of ``rows`` that another one may stand in for, from aggregates; no pairs are made.

    Better ones have more pixels, or as many. For the first kind each size of
    picture needs only the best value above it, a running minimum over the
    sizes of a group; for the second the best value or the first in line
    among those of the size, within the tolerance by a range over the values.
    """
    above = Window.partitionBy("group_id").orderBy(F.desc("px")).rowsBetween(Window.unboundedPreceding, -1)
    grid = rows.where(F.col("fmt").isin(GRID_FORMATS) & F.col("blk").isNotNull())
    levels = grid.groupBy("group_id", "px").agg(F.min("blk").alias("here")).withColumn("above", F.min("here").over(above))
    values = grid.groupBy("group_id", "px", "blk").agg(F.min("tie").alias("line"))
    line = values.select("group_id", "px", "blk", F.expr(f"min(line) OVER (PARTITION BY group_id, px ORDER BY blk RANGE BETWEEN {GRID_TIE}D PRECEDING AND {GRID_TIE}D FOLLOWING)").alias("line"))
    grid = grid.join(levels, ["group_id", "px"]).join(line, ["group_id", "px", "blk"])
    by_grid = grid.where((F.col("above") <= F.col("blk") + GRID_SLACK) | (F.col("here") < F.col("blk") - GRID_TIE) | (F.col("line") < F.col("tie"))).select("group_id", "id")

    # By size, within a format: all of a format without grid; of one with a grid, where a value is missing on either side.
    above = Window.partitionBy("group_id", "fmt", "kind").orderBy(F.desc("px")).rowsBetween(Window.unboundedPreceding, -1)
    missing = F.col("fmt").isin(GRID_FORMATS) & F.col("blk").isNotNull()
    rows = rows.withColumn("full", F.coalesce(missing, F.lit(False)))
    # Rows with a value meet those without one only; the others meet all.
    offered = rows.withColumn("kind", F.explode(F.when(F.col("full"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    asked = rows.withColumn("kind", F.when(F.col("full"), 1).otherwise(0))
    level = ["group_id", "fmt", "kind", "px"]
    best = offered.groupBy(*level).agg(F.max("file_size").alias("here"))
    levels = asked.select(*level).distinct().join(best, level, "full").withColumn("above", F.max("here").over(above))
    line = offered.groupBy(*level, "file_size").agg(F.min("tie").alias("line"))
    by_size = asked.join(levels, level).join(line, [*level, "file_size"], "left")
    by_size = by_size.where((F.col("above") >= F.col("file_size")) | (F.col("here") > F.col("file_size")) | (F.col("line") < F.col("tie"))).select("group_id", "id")
    return by_grid.unionByName(by_size).distinct()


def skyline(members: DataFrame) -> DataFrame:
    """W8. ``members`` with ``keeper``: null for those that no other member may stand in for, else the one of those that does.

    One stands in for another if it has no fewer pixels and no more
    compression, and is better in one of the two or first in line. Formats
    with a compression grid compare by it, with a tolerance; others only with
    their own kind, by size. ``members`` as for best_copy. Who is beaten is
    found without making pairs (see _beaten); the beaten are then joined with
    those that are left, of which a group has few for each size of picture.
    """
    tie = F.struct(F.when(F.col("fmt").isin(LOSSLESS), 0).otherwise(1).alias("loss"), (-F.col("file_size")).alias("size"), (-F.coalesce("rating", F.lit(0))).alias("rating"), F.coalesce("file_date", F.lit(0.0)).alias("date"), "id")
    rows = materialize(members.select("group_id", "id", _pixels().alias("px"), "fmt", "file_size", F.col("blk").cast("double").alias("blk"), tie.alias("tie")), "members")
    beaten = materialize(_beaten(rows), "beaten")
    tops = rows.join(beaten, ["group_id", "id"], "left_anti")
    o = tops.select("group_id", *[F.col(c).alias(f"o_{c}") for c in rows.columns if c != "group_id"])
    p = rows.join(beaten, ["group_id", "id"], "left_semi").join(o, "group_id").where("o_px >= px")
    grid = F.col("fmt").isin(GRID_FORMATS) & F.col("o_fmt").isin(GRID_FORMATS) & F.col("blk").isNotNull() & F.col("o_blk").isNotNull()
    tol = F.when(F.col("px") == F.col("o_px"), F.lit(GRID_TIE)).otherwise(F.lit(GRID_SLACK))
    more, first = F.col("o_px") > F.col("px"), F.col("o_tie") < F.col("tie")
    by_grid = (F.col("o_blk") <= F.col("blk") + tol) & (more | (F.col("o_blk") < F.col("blk") - tol) | first)
    by_size = (F.col("fmt") == F.col("o_fmt")) & (F.col("o_file_size") >= F.col("file_size")) & (more | (F.col("o_file_size") > F.col("file_size")) | first)
    rank = F.struct((-F.col("o_px")).alias("px"), F.coalesce("o_blk", F.lit(9.0)).alias("blk"), F.col("o_tie").alias("tie"))
    keepers = p.where(F.when(grid, by_grid).otherwise(by_size)).groupBy("group_id", "id").agg(F.min_by("o_id", rank).alias("keeper"))
    top = tops.select("group_id", "id", F.lit(True).alias("top"))
    return members.join(keepers, ["group_id", "id"], "left").join(top, ["group_id", "id"], "left").withColumn("top", F.coalesce("top", F.lit(False)))


def numbered(df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "n") -> DataFrame:
    """``df`` with ``name long``: the row's number from 1 in ``order``, for each value of ``within`` if given.

    No task sees a whole group: rows are cut into ranges of the order and
    written with their range; the few counts of ranges give each one's start,
    and rows are numbered inside their range only. ``order`` must tell all
    rows apart, else equal ones get their numbers in any order.
    """
    within = within or []
    at, before = "__range", "__before"
    keys = [*within, *order]
    rows = materialize(df.repartitionByRange(*keys).withColumn(at, F.spark_partition_id()), "ranges")
    counts = rows.groupBy(at, *within).agg(F.count("*").alias("__rows"))
    ahead = Window.partitionBy(*(within or [F.lit(0)])).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(at, *within, F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias(before))
    starts = starts.select(F.col(at).alias("__at"), *[F.col(w).alias(f"__{w}") for w in within], before)
    same = rows[at] == starts["__at"]
    for w in within:
        same = same & rows[w].eqNullSafe(starts[f"__{w}"])
    place = F.row_number().over(Window.partitionBy(at, *within).orderBy(*order))
    return rows.join(starts, same).withColumn(name, (place + F.col(before)).cast("long")).select(*df.columns, name)


def sequence_names(media: DataFrame, base: str, start: int = 1) -> DataFrame:
    """W9. New names ``base (N).ext``, numbered for each kind of media in id order."""
    rows = numbered(media.select("id", "filename", "media_type"), ["id"], ["media_type"])
    n = (F.col("n") + (start - 1)).cast("string")
    return rows.select("id", "filename", F.concat(F.lit(base), F.lit(" ("), n, F.lit(")."), S.extension(F.col("filename"))).alias("new_name"))


def free_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """W10. For each ``wanted(id, folder, filename)`` a name that is free in its folder.

    The name itself, as number 1, if no row of ``existing(folder, filename)``
    has it, else ``base (N)`` with the lowest free N from 2 on; claims of one
    name take free numbers in id order. Numbers are not tried one by one. If
    ``n`` is the i-th number in use, ``n - i`` free ones lie below it; so the
    k-th claim has all those before it with ``n - i < k``, and its number is its
    place when both are sorted together. The sorts run in ranges (``numbered``), so no
    task holds all claims of one name.
    """
    stem, ext = F.regexp_replace("filename", "(?s)^(.+)\\.[^.]*$", "$1"), F.regexp_extract("filename", "(?s).(\\.[^.]*)$", 1)
    key = ["folder", "stem", "ext"]
    claims = wanted.select("id", "folder", "filename", stem.alias("stem"), ext.alias("ext"))
    asked = claims.select(*key).distinct()
    taken = existing.select("folder", stem.alias("stem"), ext.alias("ext"))
    plain = taken.select(*key, F.lit(1).cast("long").alias("n"))
    number = F.regexp_extract("stem", "(?s) \\(([1-9][0-9]{0,17})\\)$", 1)
    counted = taken.where(number != "").select("folder", F.regexp_replace("stem", " \\([0-9]+\\)$", "").alias("stem"), "ext", number.cast("long").alias("n")).where("n >= 2")
    used = numbered(plain.unionByName(counted).join(asked, key, "left_semi").distinct(), ["n"], key, "i")
    queue = numbered(claims, ["id"], key, "k")
    spots = queue.select("id", "filename", *key, (2 * F.col("k")).alias("at")).unionByName(used.select(*key, (2 * (F.col("n") - F.col("i")) + 1).alias("at")), allowMissingColumns=True)
    placed = numbered(spots, ["at", "id"], key, "n").where("filename is not null")
    name = F.when(F.col("n") == 1, F.col("filename")).otherwise(F.concat("stem", F.lit(" ("), F.col("n").cast("string"), F.lit(")"), "ext"))
    return placed.select("id", "folder", "filename", name.alias("free_name"))


def top_unique_tags(image_tags: DataFrame) -> DataFrame:
    """W11. Tags of each image by score, one a normal form, with their place."""
    norm = S.norm_tag(F.col("tag"))
    one = image_tags.withColumn("k", F.row_number().over(Window.partitionBy("image_id", norm).orderBy(F.desc("score"), "tag"))).where("k = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "tag"))).select("image_id", "tag", "score", "place")


def manual_first(counts: DataFrame) -> DataFrame:
    """W12. Tag counts with the tags set by hand before the others."""
    return counts.orderBy(F.when(F.col("manual"), 0).otherwise(1), F.desc("image_count"), "name")


def newest_missing(media: DataFrame, done: DataFrame, n: int = 500) -> DataFrame:
    """W13. Rows without a result, newest ids first."""
    return media.join(done.select("id"), "id", "left_anti").orderBy(F.desc("id")).limit(n)


def consecutive_failures(attempts: DataFrame, n: int = 3) -> DataFrame:
    """W14. Keys with ``n`` failures or more in a row, and their longest run; a success ends a run.

    ``attempts(key, at, seq, ok)``; rows of unreachable sources (ok null) don't count.
    """
    order = Window.partitionBy("key").orderBy("at", "seq")
    rows = attempts.where("ok is not null").withColumn("island", F.sum(F.col("ok").cast("int")).over(order))
    runs = rows.where("not ok").groupBy("key", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("key").agg(F.max("n").alias("longest")).where(F.col("longest") >= n)
