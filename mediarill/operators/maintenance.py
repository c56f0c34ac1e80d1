"""Changes to the catalogue: tables in, new tables out. Rows set by hand survive automatic ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .filters import keep_under_failed, under, under_roots
from .joins import agreement_check, orphan_tags
from .ranking import free_names, numbered, sequence_names, skyline

KEY = ["image_id", "tag"]


def apply_predictions(image_tags: DataFrame, predictions: DataFrame) -> DataFrame:
    """M1. ``predictions(image_id, tag, score)`` replace the automatic tags of their images; manual ones stay as they are, others that stay take a new score."""
    again = predictions.select("image_id").distinct()
    auto = F.col("source") == "auto"
    kept = image_tags.where(~auto).unionByName(image_tags.where(auto).join(again, "image_id", "left_anti"))
    new = predictions.groupBy(*KEY).agg(F.max("score").alias("__score"))
    scored = kept.join(new, KEY, "left").withColumn("score", F.when(F.col("source") == "manual", F.col("score")).otherwise(F.coalesce("__score", "score")))
    fresh = new.join(kept.select(*KEY), KEY, "left_anti").select(*KEY, F.col("__score").alias("score"), F.lit("auto").alias("source"))
    return scored.select(*KEY, "score", "source").unionByName(fresh)


def select_predictions(scores: DataFrame, vocab: DataFrame, general: float = 0.30, character: float = 0.70) -> DataFrame:
    """M2. ``scores(image_id, scores)`` against ``vocab(pos, name, category)``: tags over their category's limit, and the rating that won."""
    from .aggregates import rating_level

    each = scores.select("image_id", F.posexplode(S.score_to_probability(F.col("scores"))).alias("pos", "score")).join(vocab, "pos")
    limit = F.when(F.col("category") == "character", character).otherwise(general)
    tags = each.where((F.col("category") != "rating") & (F.col("score") >= limit)).select("image_id", "name", "category", "score")
    won = rating_level(each.where("category = 'rating'").select("image_id", F.col("name").alias("level"), "score"))
    return tags.unionByName(won.select("image_id", F.col("level").alias("name"), F.lit("rating").alias("category"), "score"))


def add_tags(image_tags: DataFrame, tags: DataFrame, media: DataFrame, ids: DataFrame, tag: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """M3. The tag by hand, with score 1, on every existing row of ``ids(id)``; an automatic one is replaced. Returns image tags and tags.

    The tag is looked up by its normal form among the tags of its kind:
    ``kind``, or else character if a character has that name, or else
    general. If there is none, it is added in normal form with underscores.
    A tag without a normal form is refused.
    """
    norm = " ".join(tag.lower().replace("_", " ").split())
    if not norm:
        raise ValueError("no tag")
    like = tags.where(S.norm_tag(F.col("name")) == norm)
    kind = kind or ("general" if like.where("category = 'character'").isEmpty() else "character")
    known = like.where(F.col("category") == kind).agg(F.min("name").alias("name")).first()["name"]
    name = known or norm.replace(" ", "_")
    rows = ids.select("id").distinct().join(media.select("id"), "id", "left_semi").select(F.col("id").alias("image_id"), F.lit(name).alias("tag"), F.lit(1.0).alias("score"), F.lit("manual").alias("source"))
    out = image_tags.select(*KEY, "score", "source").join(rows.select(*KEY), KEY, "left_anti").unionByName(rows)
    if known is None:
        tags = tags.select("name", "category").unionByName(tags.sparkSession.createDataFrame([(name, kind)], "name string, category string"))
    return out, tags


def remove_tags(image_tags: DataFrame, tags: DataFrame, ids: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """M4. Rows without the tag in any spelling on ``ids(id)``, and the tags that are then still in use."""
    norm = " ".join(tag.lower().replace("_", " ").split())
    hit = image_tags.where(S.norm_tag(F.col("tag")) == norm).join(ids.select(F.col("id").alias("image_id")).distinct(), "image_id", "left_semi")
    left = image_tags.join(hit.select(*KEY), KEY, "left_anti")
    return left, tags.join(orphan_tags(tags, left).select("name"), "name", "left_anti")


def import_keywords(image_tags: DataFrame, keywords: DataFrame, most: int = 200) -> DataFrame:
    """M5. The first ``most`` keywords of ``keywords(image_id, keywords)`` as embedded tags where the image lacks them."""
    words = keywords.select("image_id", F.explode(F.slice(S.split_keywords(F.col("keywords")), 1, most)).alias("word"))
    new = words.select("image_id", S.norm_tag(F.col("word")).alias("tag")).where("tag <> ''").distinct().join(image_tags.select(*KEY), KEY, "left_anti")
    return image_tags.unionByName(new.select(*KEY, F.lit(1.0).alias("score"), F.lit("embedded").alias("source")))


def set_rating(media: DataFrame, updates: DataFrame) -> DataFrame:
    """M6. Ratings from ``updates(id, rating)``; those outside 0 to 9 are passed over."""
    new = updates.where(F.col("rating").between(0, 9)).groupBy("id").agg(F.max("rating").alias("__r"))
    return media.join(new, "id", "left").withColumn("rating", F.coalesce(F.col("__r").cast("int"), "rating")).drop("__r").select(*media.columns)


def soft_delete(media: DataFrame, image_tags: DataFrame, ids: DataFrame, at: float) -> tuple[DataFrame, DataFrame]:
    """M7. The rows that stay, and the deleted ones with ``deleted_at`` and their character tags as JSON."""
    chosen = ids.select("id").distinct()
    names = image_tags.where(F.length("tag") >= 8).groupBy(F.col("image_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_set("tag"))).alias("characters_json"))
    trash = media.join(chosen, "id", "left_semi").join(names, "id", "left").withColumn("deleted_at", F.lit(at))
    return media.join(chosen, "id", "left_anti"), trash


def restore(trash: DataFrame, media: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M8. Rows to add to the catalogue, with free names and new ids behind its largest, and their character tags by hand."""
    back = trash.join(ids.select("id").distinct(), "id", "left_semi")
    names = free_names(back.select("id", "folder", "filename"), media.select("folder", "filename")).select("id", "free_name")
    top = media.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    fresh = numbered(back.join(names, "id"), ["id"], name="place").join(F.broadcast(top)).withColumn("new_id", F.col("top") + F.col("place"))
    tags = fresh.select(F.col("new_id").alias("image_id"), F.explode(F.from_json("characters_json", "array<string>")).alias("tag"), F.lit(1.0).alias("score"), F.lit("manual").alias("source"))
    rows = fresh.withColumns({"id": F.col("new_id"), "filename": F.col("free_name"), "filepath": F.concat("folder", F.lit("/"), "free_name")})
    return rows.select(*media.columns), tags


def purge_trash(trash: DataFrame, now: float, max_age: float = 600) -> DataFrame:
    """M9. Deleted rows that are still young enough to keep."""
    return trash.where(F.col("deleted_at") >= now - max_age)


def move_prefix(media: DataFrame, old: str, new: str) -> DataFrame:
    """M10. A folder and all below it under a new name; into itself is refused; a row whose target exists stays."""
    if new == old or new.startswith((old + "/", old + "\\")):
        raise ValueError("a folder cannot move into itself")
    hit = under(F.col("folder"), old)
    target = F.concat(F.lit(new), F.substr("folder", F.lit(len(old) + 1)))
    path = F.concat(target, F.lit("/"), "filename")
    taken = media.where(~hit).select(F.col("filepath").alias("__to"), F.lit(True).alias("__taken"))
    moved = media.where(hit).withColumn("__to", path).join(taken, "__to", "left")
    go = F.col("__taken").isNull()
    moved = moved.withColumns({"folder": F.when(go, target).otherwise(F.col("folder")), "filepath": F.when(go, F.col("__to")).otherwise(F.col("filepath"))})
    return media.where(~hit).unionByName(moved.select(*media.columns))


def relocate(media: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """M11. The chosen rows in another folder, under a free name where theirs is taken there; rows that are there already stay."""
    go = media.where(F.col("folder") != folder).join(ids.select("id").distinct(), "id", "left_semi").select("id", F.lit(folder).alias("folder"), "filename")
    free = free_names(go, media.where(F.col("folder") == folder).select("folder", "filename")).select("id", F.col("free_name").alias("__name"))
    rows, moves = media.join(free, "id", "left"), F.col("__name").isNotNull()
    moved = {"folder": F.when(moves, F.lit(folder)).otherwise(F.col("folder")), "filename": F.coalesce("__name", "filename"), "filepath": F.when(moves, F.concat(F.lit(folder + "/"), "__name")).otherwise(F.col("filepath"))}
    return rows.withColumns(moved).select(*media.columns)


def copy_rows(media: DataFrame, image_tags: DataFrame, ids: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """M11. New rows for the chosen ones in another folder, under free names, with their tags; ids are the old ones behind the largest in use."""
    top = media.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("__top"))
    rows = media.join(ids.select("id").distinct(), "id", "left_semi").join(F.broadcast(top)).withColumn("__new", F.col("id") + F.col("__top"))
    tags = image_tags.join(rows.select(F.col("id").alias("image_id"), "__new"), "image_id").select(F.col("__new").alias("image_id"), "tag", "score", "source")
    free = free_names(rows.select("id", F.lit(folder).alias("folder"), "filename"), media.where(F.col("folder") == folder).select("folder", "filename")).select("id", F.col("free_name").alias("__name"))
    rows = rows.join(free, "id").withColumns({"id": F.col("__new"), "folder": F.lit(folder), "filename": F.col("__name"), "filepath": F.concat(F.lit(folder + "/"), "__name")})
    return rows.select(*media.columns), tags


def apply_diff(media: DataFrame, diff: DataFrame, failed: DataFrame, max_share: float = 0.20, least: int = 1000) -> DataFrame:
    """M12. The catalogue after a comparison: new rows unfinished, modified ones to be done again, removed ones gone.

    Rows below folders that could not be read stay. If more than ``least``
    rows and ``max_share`` of the catalogue would go, none goes.
    """
    gone = diff.where("action = 'removed'").select(F.col("path").alias("filepath"))
    gone = gone.join(keep_under_failed(gone, failed).select("filepath"), "filepath", "left_anti")
    brake = media.agg(F.count("*").alias("__all")).join(gone.agg(F.count("*").alias("__gone")))
    stop = (F.col("__gone") > least) & (F.col("__gone") > max_share * F.col("__all"))
    marked = media.join(diff.select(F.col("path").alias("filepath"), "action"), "filepath", "left").join(gone.withColumn("__lost", F.lit(True)), "filepath", "left").join(F.broadcast(brake))
    kept = marked.where(F.col("__lost").isNull() | stop).withColumn("meta_done", F.when(F.col("action") == "modified", False).otherwise(F.col("meta_done")))
    new = diff.where("action = 'new'").select(F.col("path").alias("filepath"), S.path_leaf(F.col("path")).alias("filename"), S.path_parent(F.col("path")).alias("folder"), S.media_type(F.col("path")).alias("media_type"), F.lit(False).alias("meta_done"))
    return kept.select(*media.columns).unionByName(new, allowMissingColumns=True)


def migrate(df: DataFrame, defaults: dict[str, Column], stale: dict[str, int] | None = None, version: int = 0, retired: list[str] | None = None) -> DataFrame:
    """M13. Missing columns with their defaults, derived ones of an older version emptied, retired ones gone."""
    new = {c: v for c, v in defaults.items() if c not in df.columns}
    old = {c: F.lit(None).cast(df.schema[c].dataType) for c, v in (stale or {}).items() if c in df.columns and version < v}
    return df.withColumns(new | old).drop(*(retired or []))


def fix_orientation(media: DataFrame, orientation: DataFrame) -> DataFrame:
    """M14. Rows that still hold the raw size of ``orientation(id, raw_width, raw_height, orientation)`` turned; again is harmless."""
    rows = media.join(orientation, "id", "left")
    raw = (F.col("width") == F.col("raw_width")) & (F.col("height") == F.col("raw_height")) & F.col("orientation").between(5, 8)
    size = S.oriented_size(F.col("width"), F.col("height"), F.when(F.coalesce(raw, F.lit(False)), F.col("orientation")).otherwise(1))
    return rows.withColumn("__s", size).withColumns({"width": F.col("__s.width"), "height": F.col("__s.height")}).select(*media.columns)


def cascade_delete(children: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """M15. Every child table without the rows of the removed ids."""
    return {n: t.join(ids.select(F.col("id").alias(k)).distinct(), k, "left_anti") for n, (t, k) in children.items()}


def clean_plan(members: DataFrame, vectors: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """M17. What to do with each copy: ``keep``, ``remove`` (for ``keeper``) or ``skip`` with a reason, and the bytes it holds.

    Only still images are compared; a copy goes only if a better one shows
    the same. ``members`` as for ranking.skyline with ``media_type``;
    ``vectors`` and ``limits`` as for joins.agreement_check.
    """
    still = members.where("media_type = 'image'")
    ranked = skyline(still)
    pairs = ranked.where("keeper is not null and not top").select(F.col("id").alias("a"), F.col("keeper").alias("b"))
    checked = agreement_check(pairs.distinct(), vectors, **(limits or {})).select(F.col("a").alias("id"), F.col("b").alias("keeper"), "same", "reason")
    rows = ranked.join(checked, ["id", "keeper"], "left")
    action = F.when(F.col("top"), "keep").when(F.col("same"), "remove").otherwise("skip")
    why = F.when(F.col("top") | F.coalesce("same", F.lit(False)), None).when(F.col("keeper").isNull(), "not clearly worse than the copies that stay").otherwise(F.coalesce("reason", F.lit("could not be read")))
    done = rows.select("group_id", "id", action.alias("action"), F.when(action == "remove", F.col("keeper")).alias("keeper"), why.alias("reason"), "file_size")
    rest = members.where("media_type <> 'image'").select("group_id", "id", F.lit("skip").alias("action"), F.lit(None).cast("long").alias("keeper"), F.lit("animated").alias("reason"), "file_size")
    return done.unionByName(rest)


def apply_clean_plan(media: DataFrame, plan: DataFrame) -> DataFrame:
    """M18. The catalogue without the copies to remove; what any pair keeps never goes, and the keeper must exist."""
    gone = plan.where("action = 'remove'").join(media.select(F.col("id").alias("keeper")), "keeper", "left_semi")
    kept = plan.where("action = 'remove'").select(F.col("keeper").alias("id")).distinct()
    return media.join(gone.select("id").distinct().join(kept, "id", "left_anti"), "id", "left_anti")


def unlink_root(media: DataFrame, roots: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """M19. The catalogue and the roots without one root; rows that another root also covers stay."""
    left = roots.where(F.col("path") != root)
    covered = under_roots(media, left).select("id")
    lost = under_roots(media, roots.where(F.col("path") == root)).select("id").join(covered, "id", "left_anti")
    return media.join(lost, "id", "left_anti"), left


def bulk_rename(media: DataFrame, ids: DataFrame, base: str, start: int = 1) -> DataFrame:
    """M20. (id, old_name, new_name): numbered names for the chosen rows that are free in their folders."""
    chosen = media.join(ids.select("id").distinct(), "id", "left_semi")
    named = sequence_names(chosen, base, start).select("id", F.col("filename").alias("old_name"), F.col("new_name").alias("filename")).join(chosen.select("id", "folder"), "id")
    others = media.join(ids.select("id").distinct(), "id", "left_anti").select("folder", "filename")
    free = free_names(named.select("id", "folder", "filename"), others)
    return named.select("id", "old_name").join(free.select("id", F.col("free_name").alias("new_name")), "id")


def reset_flag(media: DataFrame, flag: str) -> DataFrame:
    """M21. Every row back in a backlog."""
    return media.withColumn(flag, F.lit(False))


def backfill_if_unset(media: DataFrame, values: DataFrame, col: str) -> DataFrame:
    """M22. ``values(id, <col>)`` where the column is null or 0."""
    new = values.select("id", F.col(col).alias("__v"))
    filled = F.when(F.coalesce(F.col(col), F.lit(0)) == 0, F.coalesce("__v", F.col(col))).otherwise(F.col(col))
    return media.join(new, "id", "left").withColumn(col, filled).select(*media.columns)
