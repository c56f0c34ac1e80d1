"""Joins: tags, look-ups, and exact similarity joins on signatures and tag sets."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..plans.shared import materialize

#: Smallest Jaccard similarity that still rounds to 50 %.
HALF = 0.495


def media_tags(media: DataFrame, image_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """J1. The tags of each image by score.

    Tags meet their names first and images last, where the places are given too. Only the short sides, names and
    ids, stand in hash tables, of one partition each; the images' tags are sorted once.
    """
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "name"))
    named = image_tags.withColumnRenamed("image_id", "id").join(tags.withColumnRenamed("name", "tag").hint("shuffle_hash"), "tag")
    rows = named.join(media.select("id").distinct().hint("shuffle_hash"), "id")  # a semi join would be put first, and its rows shuffled once more
    return rows.select("id", F.col("tag").alias("name"), "category", "score", "source").withColumn("place", place)


def tag_hits(media: DataFrame, image_tags: DataFrame, term: str) -> DataFrame:
    """J2. Rows with a tag that contains ``term``."""
    hits = image_tags.where(F.translate(F.lower("tag"), "_", " ").contains(term)).select(F.col("image_id").alias("id")).distinct()
    return media.join(hits, "id", "left_semi")


def orphan_tags(tags: DataFrame, image_tags: DataFrame) -> DataFrame:
    """J3. Tags that no image carries."""
    return tags.join(image_tags.select(F.col("tag").alias("name")).distinct(), "name", "left_anti")


def orphan_children(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """J4. Child rows whose parent is gone."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def _aspect_ok(earlier: Column, later: Column, tolerance: float) -> Column:
    return (earlier <= 0) | (later <= 0) | (F.abs(earlier / later - 1) <= tolerance)


def probe_plan(bits: int, max_dist: int, widest: int = 16) -> list[tuple[int, int, int]]:
    """Bands ``(first bit, width, radius)`` such that of any two signatures ``max_dist`` or fewer bits apart one band differs by its radius or less.

    With m bands and ``max_dist = m r + s``, either one of the first s + 1
    differs by r or less, or one of the others by r - 1 or less; else all
    together would differ by more. Bands of radius -1 are not needed.
    """
    m = -(-bits // widest)
    r, s = divmod(max_dist, m)
    cuts = [bits * k // m for k in range(m + 1)]
    return [(a, b - a, r if k <= s else r - 1) for k, (a, b) in enumerate(itertools.pairwise(cuts)) if k <= s or r > 0]


def probes(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with ``radius`` or fewer of them set."""
    return sorted(sum(1 << i for i in on) for k in range(radius + 1) for on in itertools.combinations(range(width), k))


def hamming_pairs(sig: DataFrame, max_dist: int, aspect_tol: float = 0.30, bits: int = 64, most_probes: int = 1000) -> DataFrame:
    """J5. All pairs ``a < b`` of ``sig(id, words, ar)`` within ``max_dist`` bits, exactly; the aspect gate divides by the later.

    ``words`` holds 32 bits each. Few bits apart: multi-index hashing. The
    signatures are cut into bands of up to 16 bits; one side looks up each
    band's value and all values a few bits from it (``probe_plan``), so an
    equi-join on 65,536 values a band finds every pair. Many bits apart, where that
    would take more than ``most_probes`` look-ups a signature, blocks of
    signatures meet each other in Arrow tasks instead, and only pairs that
    pass are emitted. Identical signatures are one entry of the index, with
    ``signature_classes`` to unfold them.
    """
    sig = sig.where("words is not null")
    plan = probe_plan(bits, max_dist)
    if sum(math.comb(w, k) for _, w, r in plan for k in range(r + 1)) <= most_probes:
        return _indexed_pairs(sig, max_dist, aspect_tol, plan)
    return _block_pairs(sig, max_dist, aspect_tol)


def signature_classes(sig: DataFrame) -> DataFrame:
    """(rep, id): every row of ``sig(id, words)`` under the smallest id with the same signature."""
    reps = sig.groupBy("words").agg(F.min("id").alias("rep"))
    return sig.select("id", "words").join(reps, "words").select("rep", "id")


def _band(words: Column, first: int, width: int) -> Column:
    """Bits ``first`` to ``first + width`` of 32-bit words, upper bits first."""
    low, high = first // 32, (first + width - 1) // 32
    whole = F.element_at(words, low + 1)
    if high > low:
        whole = F.shiftleft(whole, 32).bitwiseOR(F.element_at(words, high + 1))
    return F.shiftright(whole, 32 * (high + 1) - first - width).bitwiseAND(F.lit((1 << width) - 1))


def indexed_candidates(classes: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """Pairs ``(rep_a, words_a, rep_b, words_b)``, ``rep_a < rep_b``, of ``classes(rep, words)`` with a band within its radius of each other; each pair comes once, from its first such band."""
    own = F.array(*[F.struct(F.lit(k).alias("band"), _band(F.col("words"), at, w).alias("value")) for k, (at, w, _) in enumerate(plan)])
    near = F.flatten(F.array(*[F.transform(F.lit(probes(w, r)), lambda m: F.struct(F.lit(k).alias("band"), _band(F.col("words"), at, w).bitwiseXOR(m.cast("long")).alias("value"))) for k, (at, w, r) in enumerate(plan)]))  # noqa: B023
    a = classes.select(F.col("rep").alias("rep_a"), F.col("words").alias("words_a"), F.explode(near).alias("p")).select("rep_a", "words_a", "p.band", "p.value")
    b = classes.select(F.col("rep").alias("rep_b"), F.col("words").alias("words_b"), F.explode(own).alias("p")).select("rep_b", "words_b", "p.band", "p.value")
    apart = [F.bit_count(_band(F.col("words_a"), at, w).bitwiseXOR(_band(F.col("words_b"), at, w))) for at, w, _ in plan]
    earlier = F.lit(False)
    for k in range(1, len(plan)):
        before = [apart[j] <= plan[j][2] for j in range(k)]
        earlier = F.when(F.col("band") == k, functools.reduce(or_, before)).otherwise(earlier)
    return a.join(b, ["band", "value"]).where((F.col("rep_a") < F.col("rep_b")) & ~earlier).drop("band", "value")


def _indexed_pairs(sig: DataFrame, max_dist: int, aspect_tol: float, plan: list[tuple[int, int, int]]) -> DataFrame:
    sig = materialize(sig.select("id", "words", "ar"), "signatures")
    classes = materialize(sig.groupBy("words").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "signature_classes")
    met = indexed_candidates(classes.select("rep", "words"), plan).withColumn("dist", S.hamming(F.col("words_a"), F.col("words_b"))).where(F.col("dist") <= max_dist)
    near = met.select("words_a", "words_b", "dist").unionByName(classes.where("n > 1").select(F.col("words").alias("words_a"), F.col("words").alias("words_b"), F.lit(0).alias("dist")))
    near = materialize(near, "near_classes")
    # Members in lists of some CHUNK, so that a large class is no row of its own; then pairs of lists are dealt out by what they unfold to.
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK).cast("int")).alias("chunk")
    lists = sig.join(classes.select("words", "n"), "words").groupBy("words", chunk).agg(F.collect_list(F.struct("id", "ar")).alias("m"))
    lists = materialize(lists.select("words", "m"), "members")
    for x in "ab":
        near = near.join(lists.select(F.col("words").alias(f"words_{x}"), F.col("m").alias(f"m_{x}")), f"words_{x}")
    near = materialize(near.select("m_a", "m_b", "dist", (F.col("words_a") == F.col("words_b")).alias("same")), "met_lists")
    total = near.agg(F.coalesce(F.sum(F.size("m_a").cast("long") * F.size("m_b")), F.lit(0))).first()[0]
    near = near.repartition(1 + total // A_TASK).select("m_b", "dist", "same", F.explode("m_a").alias("x")).select("dist", "same", "x", F.explode("m_b").alias("y"))
    near = near.select("dist", "same", *[F.col(f"{v}.{c}").alias(f"{c}_{w}") for v, w in (("x", "a"), ("y", "b")) for c in ("id", "ar")])
    near = near.where(~F.col("same") | (F.col("id_a") < F.col("id_b")))
    first = F.col("id_a") < F.col("id_b")
    a, b = F.when(first, F.col("ar_a")).otherwise(F.col("ar_b")), F.when(first, F.col("ar_b")).otherwise(F.col("ar_a"))
    return near.where(_aspect_ok(a, b, aspect_tol)).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "dist")


#: Members of a class of equal signatures in one list, and pairs that a task unfolds.
CHUNK, A_TASK = 512, 1 << 20


def _blocks(sig: DataFrame) -> DataFrame:
    """Signatures packed into blocks, written once."""
    return materialize(_packed_blocks(sig), "blocks")


def pack_signatures(sig: DataFrame, order: float) -> DataFrame:
    """Blocks of ``sig(id, words)`` to be written and matched by ``first_match_packed``; those of a smaller ``order`` come first."""
    return _packed_blocks(sig.select("id", "words", F.lit(order).alias("ar")))


def _packed_blocks(sig: DataFrame, block: int = 1024) -> DataFrame:

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                piece = batch.slice(k, block)
                parts = [piece.column("id").to_numpy(), np.array(piece.column("words").to_pylist(), np.int64), piece.column("ar").to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["block", "ids", "words", "ar"])
                number += 1

    rows = sig.select(F.col("id").cast("long"), "words", F.col("ar").cast("double")).where("id is not null and words is not null")
    return rows.mapInArrow(pack, "block long, ids binary, words binary, ar binary")


def _in_64s(words: np.ndarray) -> list[np.ndarray]:
    """Rows of 32-bit words as columns of 64 bits each."""
    if words.shape[1] % 2:
        words = np.pad(words, ((0, 0), (0, 1)))
    return [np.ascontiguousarray(words[:, k] << np.uint64(32) | words[:, k + 1]) for k in range(0, words.shape[1], 2)]


def _cells(left: DataFrame, right: DataFrame, once: bool) -> DataFrame:
    """Rows of two block tables that meet, ``l_…`` and ``r_…``; ``once``: of one table, each two blocks in one order.

    Blocks are dealt to a grid of groups and joined on its cells by equality.
    """
    groups = max(1, int(left.count() ** 0.5))
    group, every = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], group.alias("lg"), every.alias("rg"))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], group.alias("rg"), every.alias("lg"))
    # A stated number of partitions, as Spark would put cells together by their few bytes, not by their work.
    a, b = (x.repartition(groups * groups, "lg", "rg") for x in (a, b))
    cells = a.join(b, ["lg", "rg"]).drop("lg", "rg")
    return cells.where("l_block <= r_block") if once else cells


def _close(batch: pa.RecordBatch, row: int, max_dist: int, once: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Places (in the left block, in the right one) of the close pairs of a row of ``_cells``, and their (l, r, dist, ar_l, ar_r)."""
    raw = lambda c, t: np.frombuffer(batch.column(c)[row].as_buffer(), t)
    li, ri, la, ra = raw("l_ids", np.int64), raw("r_ids", np.int64), raw("l_ar", np.float64), raw("r_ar", np.float64)
    lw, rw = _in_64s(raw("l_words", np.uint64).reshape(len(li), -1)), _in_64s(raw("r_words", np.uint64).reshape(len(ri), -1))
    same = once and batch.column("l_block")[row].as_py() == batch.column("r_block")[row].as_py()
    found = []
    for k in range(0, len(li), 128):
        d = np.bitwise_count(lw[0][k : k + 128, None] ^ rw[0])
        for v, w in zip(lw[1:], rw[1:], strict=True):  # word by word: a sum over so short an axis takes many times as long
            d = d.astype(np.uint16) + np.bitwise_count(v[k : k + 128, None] ^ w)
        at = np.flatnonzero((d <= max_dist).reshape(-1))
        x, y = np.divmod(at, len(ri))
        if same:
            later = x + k < y
            at, x, y = at[later], x[later], y[later]
        found.append((x + k, y, d.reshape(-1)[at].astype(np.int32)))
    x, y, d = map(np.concatenate, zip(*found, strict=True))
    return x, y, [li[x], ri[y], d, la[x], ra[y]]


def _met(left: DataFrame, right: DataFrame, max_dist: int, once: bool, first: bool = False) -> DataFrame:
    """``(l, r, dist, ar_l, ar_r)`` of the close pairs of two block tables; ``once``: of one table, each pair in one order;
    ``first``: of each left row in a cell only the hit that comes first, by ``ar_r`` and ``r``, of those before it.

    Only close pairs leave the Arrow tasks.
    """
    names = ["l", "r", "dist", "ar_l", "ar_r"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            for row in range(batch.num_rows):
                hits = _close(batch, row, max_dist, once)[2]
                if not first:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in hits], names)
                    continue
                kept = _firsts([np.concatenate(v) for v in zip(kept, _firsts(hits), strict=True)] if kept else _firsts(hits))
                if len(kept[0]) > FIRSTS:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in kept], names)
                    kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in kept], names)

    return _cells(left, right, once).mapInArrow(meet, "l long, r long, dist int, ar_l double, ar_r double")


def aspect_near(earlier: np.ndarray, later: np.ndarray, tolerance: float) -> np.ndarray:
    """The aspect gate on arrays; not a number passes no comparison, as in Spark."""
    with np.errstate(all="ignore"):
        return (earlier <= 0) | (later <= 0) | (np.abs(earlier / later - 1) <= tolerance)


def near_counts(blocks: DataFrame, max_dist: int) -> list[int]:
    """How many pairs of ``blocks`` are 0, 1, … ``max_dist`` bits apart, whatever their aspects; no pair leaves a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(max_dist + 1, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                n += np.bincount(_close(batch, row, max_dist, True)[2][2], minlength=max_dist + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(max_dist + 1, dtype=np.int32)), pa.array(n)], ["dist", "n"])

    counts = _cells(blocks, blocks, True).mapInArrow(count, "dist int, n long").groupBy("dist").agg(F.sum("n").alias("n"))
    found = {r["dist"]: r["n"] for r in counts.collect()}
    return [found.get(k, 0) for k in range(max_dist + 1)]


def first_partners(blocks: DataFrame, max_dist: int, aspect_tol: float, most: int) -> DataFrame:
    """``(a, dist, partners)``: of each id of ``blocks`` its first ``most`` partners of larger ids at each distance up to ``max_dist``, and one more if there are more.

    A task keeps as many of each two blocks, so of a large class of copies not all pairs come out. No id may stand twice.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                l, r, d, al, ar = _close(batch, row, max_dist, True)[2]
                first = l < r
                a, b = np.minimum(l, r), np.maximum(l, r)
                ok = np.flatnonzero(aspect_near(np.where(first, al, ar), np.where(first, ar, al), aspect_tol))
                ok = ok[np.lexsort((b[ok], d[ok], a[ok]))]
                a, b, d = a[ok], b[ok], d[ok]
                begins = np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1]))[: len(a)]
                place = np.arange(len(a)) - np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(a) else a
                few = place <= most
                yield pa.RecordBatch.from_arrays([pa.array(v[few]) for v in (a, d, b)], ["a", "dist", "b"])

    pairs = _cells(blocks, blocks, True).mapInArrow(meet, "a long, dist int, b long")
    return pairs.groupBy("a", "dist").agg(F.slice(F.array_sort(F.collect_list("b")), 1, most + 1).alias("partners"))


#: First hits that a task keeps before it hands them on.
FIRSTS = 1 << 16


def _firsts(hits: list[np.ndarray]) -> list[np.ndarray]:
    """Of hits (l, r, dist, ar_l, ar_r) those that come before, the first of each l."""
    l, r, _, al, ar = hits
    before = np.flatnonzero((l != r) & ((ar < al) | ((ar == al) & (r < l))))
    order = before[np.lexsort((r[before], ar[before], l[before]))]
    of = l[order]
    order = order[np.append(True, of[1:] != of[:-1])] if len(of) else order
    return [v[order] for v in hits]


def _block_pairs(sig: DataFrame, max_dist: int, aspect_tol: float) -> DataFrame:
    blocks = _blocks(sig)
    near = _met(blocks, blocks, max_dist, True).where("l <> r")
    first = F.col("l") < F.col("r")
    a, b = F.when(first, F.col("ar_l")).otherwise(F.col("ar_r")), F.when(first, F.col("ar_r")).otherwise(F.col("ar_l"))
    return near.where(_aspect_ok(a, b, aspect_tol)).select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "dist")


def hamming_neighbors(query: DataFrame, sig: DataFrame, max_dist: int) -> DataFrame:
    """J6. Rows of ``sig`` within ``max_dist`` of the one row of ``query(id, words)``, nearest first."""
    q = query.select(F.col("id").alias("q"), F.col("words").alias("qw")).limit(1)
    near = sig.crossJoin(F.broadcast(q)).where("id <> q").withColumn("dist", S.hamming(F.col("words"), F.col("qw"))).where(F.col("dist") <= max_dist)
    return near.select("q", "id", "dist", S.hamming_pct(F.col("dist"), 64).alias("similarity")).orderBy("dist", "id")


def hamming_lookup(queries: DataFrame, sig: DataFrame, max_dist: int, k: int = 300) -> DataFrame:
    """J7. For each of ``queries(id, words, ar)`` the ``k`` nearest rows within ``max_dist``, the number of all and the best.

    Blocks of queries meet blocks of the library; any number of queries will do.
    """
    near = _met(_blocks(queries), _blocks(sig), max_dist, False).where("l <> r").select(F.col("l").alias("q"), F.col("r").alias("id"), "dist")
    order, all_ = Window.partitionBy("q").orderBy("dist", "id"), Window.partitionBy("q")
    ranked = near.select("q", "id", "dist", F.row_number().over(order).alias("place"), F.count("*").over(all_).alias("total"), F.min("dist").over(all_).alias("best"))
    return ranked.where(F.col("place") <= k)


def tag_sets(image_tags: DataFrame, least: int = 1) -> DataFrame:
    """(id, tags): the sorted distinct tags of each image with ``least`` or more."""
    return image_tags.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags")).where(F.size("tags") >= least)


def collapse_identical(sets: DataFrame) -> DataFrame:
    """J10. (rep, id): every image under the smallest id with the same tag set."""
    keyed = materialize(sets.select("id", F.xxhash64("tags").alias("h1"), F.xxhash64(F.lit(1), "tags").alias("h2"), F.size("tags").alias("n")), "keyed")
    reps = keyed.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    return keyed.join(reps, ["h1", "h2", "n"]).select("rep", "id")


def similarity_pct(shared: Column, a: Column, b: Column) -> Column:
    """Jaccard similarity in per cent, halves to even."""
    return F.bround(shared * 100.0 / (a + b - shared)).cast("int")


def jaccard_pairs(sets: DataFrame, min_sim: int = 50, min_size: int = 3, among: DataFrame | None = None) -> DataFrame:
    """J8. Pairs ``a < b`` of ``sets(id, tags)`` with a similarity of ``min_sim`` per cent or more, exactly.

    Whole sets meet in the cells of a grid. There, pairs that sizes and parity
    bitmaps rule out go; two bitmaps differ in no more bits than the
    sets have tags apart, so this loses nothing. What is left is compared on all tags
    at once, so only pairs of the result leave a task. Sets move as codes, two bytes for one of the ``FREQUENT``
    most frequent tags and eight for another, no two tags with the same code.
    ``among(id)``: only these sets. Identical sets are for collapse_identical first.
    """
    coded = _in_codes(sets.where(F.size("tags") >= min_size))
    coded = coded if among is None else coded.join(among.select(F.col("id").cast("long").alias("id")), "id", "left_semi")
    return _coded_pairs(materialize(coded, "coded"), min_sim)


#: Tags whose codes are told to all tasks; a fixed number that two bytes can name.
FREQUENT = 50_000


def _in_codes(sets: DataFrame) -> DataFrame:
    """``_coded`` of ``sets(id, tags)`` by their own most frequent tags."""
    counts = materialize(sets.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("df")), "tag_counts")
    salt = _salt(counts)
    top = [r["h"] for r in counts.orderBy(F.desc("df"), "tag").limit(FREQUENT).select(_tag_hash(F.col("tag"), salt).alias("h")).collect()]
    return _coded(sets, np.array(top, np.int64), salt)


def _tag_hash(tag: Column, salt: int = 0) -> Column:
    return F.xxhash64(F.lit(salt), tag) if salt else F.xxhash64(tag)


def _salt(counts: DataFrame) -> int:
    """The first salt with which no two tags of ``counts(tag)`` have the same hash."""
    tags, salt = counts.count(), 0
    while counts.select(_tag_hash(F.col("tag"), salt).alias("h")).distinct().count() < tags:
        salt += 1
    return salt


def _coded(sets: DataFrame, frequent: np.ndarray, salt: int = 0) -> DataFrame:
    """``(id, n, rare, often)``: the tags of each set as bytes. ``often`` has their places among the hashes ``frequent`` in two bytes each, ``rare`` the hashes of all others in eight."""
    by = np.argsort(frequent)
    known = frequent[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            h = batch.column("h").flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            found = known[at] == h if len(known) else np.zeros(len(h), bool)
            columns = []
            for mine, keys in ((~found, h), (found, by[at].astype(np.uint16) if len(known) else h.astype(np.uint16))):
                keys, own = keys[mine], owner[mine]
                ends = np.append(0, np.cumsum(np.bincount(own, minlength=len(n)))) * keys.itemsize
                columns.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(keys.tobytes())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), *columns], ["id", "n", "rare", "often"])

    hashed = sets.select(F.col("id").cast("long").alias("id"), F.size("tags").alias("n"), F.transform("tags", lambda t: _tag_hash(t, salt)).alias("h"))
    return hashed.mapInArrow(run, "id long, n int, rare binary, often binary")


def _bytes_of(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of bytes, and how many each row has."""
    arrays = [x for x in column.chunks if len(x)]
    cuts = [np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset) for x in arrays]
    width = np.dtype(kind).itemsize
    parts = [np.frombuffer(x.buffers()[2], kind, int(e[-1] - e[0]) // width, int(e[0])) for x, e in zip(arrays, cuts, strict=True) if e[-1] > e[0]]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.concatenate([np.diff(e) // width for e in cuts])


def _parities(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of sets of codes, as columns of 64 bits: ``(word, set)``. Their halves together are the bitmaps of half the bits."""
    out = np.empty((bits // 64, len(size)), np.uint64)
    step = max(1, (1 << 23) // bits)
    for k in range(0, len(size), step):
        n = size[k : k + step]
        own = codes[np.arange(int(n.sum())) + np.repeat(begin[k : k + step] - (np.cumsum(n) - n), n)].astype(np.uint64)
        place = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40) & np.uint64(bits - 1)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(len(n)) * bits, n) + place, minlength=len(n) * bits) & 1
        out[:, k : k + step] = np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(len(n), -1).T
    return out


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps folded to as few words."""
    return maps if len(maps) == words else np.bitwise_xor.reduce(maps.reshape(-1, words, maps.shape[1]), 0)


#: Bits of a bitmap for each tag at least (twice that at most), and the largest bitmap.
PARITY_BITS, MOST_PARITY_BITS = 2.5, 1 << 20


def _alike(codes: np.ndarray, begin: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, c: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, one of ``left`` and one of ``right``, whose sizes and bitmaps allow a similarity of c; of one list each pair comes once. Rows stand in order of their sizes ``n``."""
    once = left is right
    bits = np.minimum(2 ** np.ceil(np.log2(np.maximum(64, PARITY_BITS * n))).astype(np.int64), MOST_PARITY_BITS)
    kinds = np.unique(bits)
    of = [{int(k): rows[bits[rows] == k] for k in kinds} for rows in (left, right)]
    maps = [{k: _parities(codes, begin[rows], n[rows], k) for k, rows in side.items()} for side in (of if not once else of[:1])] * (1 + once)
    allowed = (1 - c) / (1 + c)
    for k, xs in of[0].items():
        for m, ys in of[1].items():
            if not len(xs) or not len(ys) or n[ys[-1]] < c * n[xs[0]] - 1e-9 or n[ys[0]] > n[xs[-1]] / c + 1e-9:
                continue
            words = min(k, m) // 64
            mx, my = _folded(maps[0][k], words), _folded(maps[1][m], words)
            for i in range(0, len(xs), 32):
                x = xs[i : i + 32]
                lo, hi = np.searchsorted(n[ys], c * n[x[0]] - 1e-9), np.searchsorted(n[ys], n[x[-1]] / c + 1e-9, "right")
                hi = min(int(hi), int(np.searchsorted(ys, x[-1]))) if once else int(hi)
                for j in range(int(lo), hi, 2048):
                    y = ys[j : min(j + 2048, hi)]
                    apart, seen = np.zeros((len(x), len(y)), np.uint32 if words > 1000 else np.uint16), np.empty((len(x), len(y)), np.uint64)
                    for v, w in zip(mx[:, i : i + 32], my[:, j : min(j + 2048, hi)], strict=True):
                        np.bitwise_xor(v[:, None], w, out=seen)
                        apart += np.bitwise_count(seen)
                    at = np.flatnonzero((apart <= (n[x][:, None] + n[y]) * allowed + 1e-6).reshape(-1))
                    u, v = np.divmod(at, len(y))
                    u, v = x[u], y[v]
                    fit = (np.minimum(n[u], n[v]) >= c * np.maximum(n[u], n[v]) - 1e-9) & ((v < u) | (not once))
                    if fit.any():
                        yield u[fit], v[fit]


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows in parts of ``least`` or more."""
    held, many = [], 0
    for part in parts:
        held.append(part)
        many += len(part[0])
        if many >= least:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, many = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _even_keys(spark: SparkSession, n: int) -> list[int]:
    """n keys that Spark's hash deals to n partitions, one to each; few as n are, plain numbers would often meet in one."""
    dealt = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("to")).agg(F.min("id").alias("key")).collect()
    found = {r["to"]: r["key"] for r in dealt}
    return [found.get(k, -1 - k) for k in range(n)]


def _codes_of(cell: pa.Table) -> np.ndarray:
    """The codes of all sets of a cell, one run a set: frequent tags by their places and behind them all others."""
    rare, n_rare = _bytes_of(cell.column("rare"), np.int64)
    often, n_often = _bytes_of(cell.column("often"), np.uint16)
    rare = np.unique(rare, return_inverse=True)[1]
    codes = np.empty(len(rare) + len(often), np.int32)
    is_rare = np.repeat(np.tile([True, False], cell.num_rows), np.column_stack([n_rare, n_often]).reshape(-1))
    codes[is_rare] = rare + (1 << 16)
    codes[~is_rare] = often
    return codes


def _dealt(rows: DataFrame, groups: int) -> DataFrame:
    """``rows(id, …)`` dealt to groups ``g``, and a copy for each cell (``low``, ``high``) of two groups; one cell to a task."""
    low, high, cells = F.least("g", "other"), F.greatest("g", "other"), groups * (groups + 1) // 2
    keys = F.array(*[F.lit(k) for k in _even_keys(rows.sparkSession, cells)])
    number = (low * (2 * groups - low - 1) / 2 + high).cast("int")
    out = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return out.select(*rows.columns, "g", low.alias("low"), high.alias("high"), F.element_at(keys, number + 1).alias("cell")).repartition(cells, "cell")


def _coded_pairs(coded: DataFrame, min_sim: int, cell_bytes: int = 96 << 20) -> DataFrame:
    """Pairs ``(a, b, sim)``, ``a < b``, of ``coded`` sets with a similarity of ``min_sim`` per cent or more."""
    c = (min_sim - 0.5) / 100
    total = coded.agg(F.coalesce(F.sum(F.octet_length("rare").cast("long") + F.octet_length("often")), F.lit(0))).first()[0]
    # Some twenty cells at least where there is work for them; a set moves once a group.
    groups = max(1, -(-2 * total // cell_bytes), min(6, total >> 20))
    def meet(cell: pa.Table) -> pa.Table:
        low, high = (cell.column(x)[0].as_py() for x in ("low", "high"))
        cell = cell.select(["id", "n", "g", "rare", "often"]).sort_by([("n", "ascending"), ("id", "ascending")])
        ids, n, g = (cell.column(x).to_numpy() for x in ("id", "n", "g"))
        n = n.astype(np.int64)
        codes = _codes_of(cell)
        del cell
        begin = np.cumsum(n) - n
        left = np.flatnonzero(g == low)
        right = left if low == high else np.flatnonzero(g == high)
        out = []
        for x, y in _gathered(_alike(codes, begin, n, left, right, c), 1 << 18):
            shared = _shared(codes, begin, n, x, y)
            sim = np.rint(shared * 100.0 / (n[x] + n[y] - shared)).astype(np.int32)
            hit = np.flatnonzero(sim >= min_sim)
            out.append((ids[x[hit]], ids[y[hit]], sim[hit]))
        a, b, sim = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        return pa.table([np.minimum(a, b), np.maximum(a, b), sim], ["a", "b", "sim"])

    return _dealt(coded, groups).groupBy("cell").applyInArrow(meet, "a long, b long, sim int")


def _prefixes(sets: DataFrame, frequent: np.ndarray, c: float) -> DataFrame:
    """Whole sets for ``_prefix_pairs``; the name is that of an older form."""
    return _coded(sets, frequent)


def _prefix_pairs(coded: DataFrame, c: float, cell_bytes: int = 96 << 20) -> DataFrame:
    return _coded_pairs(coded, round(100 * c + 0.5), cell_bytes).select("a", "b")


def _checked(pairs: DataFrame, sets: DataFrame, min_sim: int) -> DataFrame:
    """Candidate pairs compared on the tags themselves, in cells; only sets of candidates move, and not once for each pair."""
    pairs = materialize(pairs, "candidates")
    met = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    sets = materialize(sets.join(met, "id", "left_semi").select(F.col("id").cast("long").alias("id"), "tags"), "met")

    def meet(pairs: pa.Table, facts: pa.Table) -> pa.Table:
        pairs, facts, x, y = _both_ends(pairs, facts)
        tags = facts.column("tags").combine_chunks()
        n = pc.list_value_length(tags).to_numpy().astype(np.int64)
        shared = _shared(pc.dictionary_encode(tags.flatten()).indices.to_numpy(), np.cumsum(n) - n, n, x, y)
        sim = np.rint(shared * 100.0 / (n[x] + n[y] - shared)).astype(np.int32)
        return pairs.append_column("sim", pa.array(sim)).filter(pa.array(sim >= min_sim))

    ends = [pairs.schema["a"], pairs.schema["b"], T.StructField("sim", T.IntegerType())]
    return met_in_cells(pairs, sets, 12 * F.size("tags"), meet, T.StructType(ends))


def _banded_sketches(sets: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """``(id, n, keys, w0, w1, ...)`` of ``sets(id, tags)``: MinHash band keys, and a parity bitmap of the tags' hashes in 64-bit words."""
    rng = np.random.default_rng(64)
    mult, mix = rng.integers(1, 2**63, (2, bands * rows), np.uint64) | np.uint64(1)
    salt = rng.integers(1, 2**63, bands, np.uint64)
    names = ["id", "n", "keys", *[f"w{k}" for k in range(words)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                size = batch.column("n").to_numpy()
                flat = batch.column("h").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                starts = np.cumsum(size) - size
                keys = np.empty((len(size), bands), np.uint64)
                for k in range(bands):
                    key = np.full(len(size), salt[k])
                    for j in range(k * rows, (k + 1) * rows):
                        x = flat * mult[j]
                        x ^= x >> np.uint64(32)
                        x *= mix[j]
                        low = np.minimum.reduceat(x, starts)
                        key = (key ^ low) * mult[j]
                        key ^= key >> np.uint64(29)
                    keys[:, k] = key
                bit = (flat >> np.uint64(20)) % np.uint64(64 * words)
                odd = np.bincount(np.repeat(np.arange(len(size)), size) * (64 * words) + bit.astype(np.int64), minlength=len(size) * 64 * words) & 1
                maps = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(size), words)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), lists, *[pa.array(np.ascontiguousarray(maps[:, k])) for k in range(words)]], names)

    hashed = sets.select(F.col("id").cast("long").alias("id"), F.size("tags").alias("n"), F.transform("tags", lambda t: F.xxhash64(t)).alias("h")).where("n > 0")
    return hashed.mapInArrow(run, "id long, n int, keys array<long>" + "".join(f", w{k} long" for k in range(words)))


def jaccard_pairs_minhash(sets: DataFrame, min_sim: int = 50, min_size: int = 3, rows: int = 2, miss: float = 1e-6, words: int = 16) -> DataFrame:
    """J9. As jaccard_pairs, candidates from MinHash bands: a pair at the limit is missed with a chance of ``miss``, others less often.

    There are as many bands of ``rows`` samples as the limit needs for that
    (50 of 2 for 50 %). Of the pairs that meet in a band, those go on whose
    sizes and parity bitmaps allow the limit: two bitmaps differ in no more
    bits than the sets have tags apart, so this loses nothing. What goes on
    is compared on the tags themselves.
    """
    c = (min_sim - 0.5) / 100
    bands = math.ceil(math.log(miss) / math.log1p(-(c**rows)))
    sets = sets.where(F.size("tags") >= min_size)
    sketches = materialize(_banded_sketches(sets, bands, rows, words), "sketches")
    maps = [f"w{k}" for k in range(words)]
    banded = sketches.select(F.explode("keys").alias("key"), "id", "n", *maps)
    a, b = (banded.select("key", F.col("id").alias(x), *[F.col(w).alias(f"{w}{x}") for w in ("n", *maps)]) for x in "ab")
    apart = sum((F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in maps), F.lit(0))
    near = (F.least("na", "nb") >= c * F.greatest("na", "nb")) & (apart * (1 + c) <= (F.col("na") + F.col("nb")) * (1 - c) + 1e-6)
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    return _checked(pairs, sets, min_sim)


def jaccard_lookup(image_tags: DataFrame, query: DataFrame, min_sim: int = 50, k: int = 300, min_size: int = 1, exclude: int | None = None) -> DataFrame:
    """J11, J12. Images by similarity with the tag set ``query(tag)``; tags no image has still count in the union."""
    q = query.select("tag").distinct()
    n_q = q.agg(F.count("*").alias("nq"))
    shared = image_tags.join(q, "tag", "left_semi").groupBy("image_id").agg(F.countDistinct("tag").alias("shared"))
    sizes = image_tags.groupBy("image_id").agg(F.countDistinct("tag").alias("n"))
    both = shared.join(sizes, "image_id").join(F.broadcast(n_q)).where((F.col("n") >= min_size) & (F.col("nq") >= min_size))
    out = both.select(F.col("image_id").alias("id"), similarity_pct(F.col("shared"), F.col("n"), F.col("nq")).alias("sim")).where(F.col("sim") >= min_sim)
    if exclude is not None:
        out = out.where(F.col("id") != exclude)
    return out.orderBy(F.desc("sim"), "id").limit(k)


def met_in_cells(pairs: DataFrame, facts: DataFrame, size: Column, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str | T.StructType, cell_bytes: int = 96 << 20, cell_pairs: int = 1 << 20) -> DataFrame:
    """``meet(pairs, facts)`` on the cells of a grid: pairs ``(a, b, …)``, and of ``facts(id, …)`` all rows of both ends.

    Ids are dealt to groups by hash, and a cell is two groups. So facts move once for
    each group, not once for each pair, and a pair moves once. ``size`` is a
    row's bytes; there are as many groups as keep a cell's facts near
    ``cell_bytes`` and its pairs near ``cell_pairs``. Both inputs should be written tables.
    """
    total = facts.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    groups = max(1, -(-2 * total // cell_bytes), math.isqrt(2 * pairs.count() // cell_pairs))
    group = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(groups)).cast("int")
    ga, gb, other = group("a"), group("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = pairs.withColumn("cell", F.least(ga, gb) * groups + F.greatest(ga, gb))
    right = facts.withColumn("g", group("id")).withColumn("h", other).withColumn("cell", F.least("g", "h") * groups + F.greatest("g", "h")).drop("g", "h")
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(lambda x, y: meet(x.drop_columns("cell"), y.drop_columns("cell")), schema)


def _places(ids: np.ndarray, wanted: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first of the sorted ``ids`` equal to each wanted one stands, and how many there are; a null is equal to none."""
    w = wanted.cast(pa.int64()).fill_null(0).to_numpy()
    at = np.searchsorted(ids, w)
    return at, np.where(wanted.is_valid().to_numpy(), np.searchsorted(ids, w, "right") - at, 0)


def _both_ends(pairs: pa.Table, facts: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """The inner join of pairs with the facts of both ends: pairs, facts by id, and for each pair the rows of a and of b."""
    facts = facts.sort_by("id").combine_chunks()
    ids = facts.column("id").to_numpy()
    rows, ends = np.arange(pairs.num_rows), []
    for x in "ab":
        at, n = _places(ids, pairs.column(x))
        at, n = at[rows], n[rows]
        rows, ends = np.repeat(rows, n), [np.repeat(e, n) for e in ends]
        ends.append(np.repeat(at, n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n))
    return pairs.take(rows), facts, *ends


def _shared(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many codes the sets x and y of each pair have in common; sets of one and more lie in ``codes`` from ``begin``."""
    out, marked = np.zeros(len(x), np.int64), np.zeros(int(codes.max(initial=0)) + 1, bool)
    by = np.argsort(x, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(x[by], prepend=-1)), len(by))
    for lo, hi in itertools.pairwise(cuts.tolist()):
        own = codes[begin[x[by[lo]]] :][: size[x[by[lo]]]]
        marked[own] = True
        for k in range(lo, hi, 1024):
            rows = by[k : min(hi, k + 1024)]
            n = size[y[rows]]
            first = np.cumsum(n) - n
            hits = marked[codes[np.arange(int(n.sum())) + np.repeat(begin[y[rows]] - first, n)]]
            out[rows] = np.add.reduceat(hits, first, dtype=np.int64)
        marked[own] = False
    return out


def verify_pairs_by_tags(pairs: DataFrame, image_tags: DataFrame) -> DataFrame:
    """J13. Pairs whose tags agree by 30 % or more, or where a side has fewer than three.

    Tag sets meet in cells, where common tags are counted; neither a set nor a tag is moved for each pair.
    """
    met = materialize(pairs.select(F.explode(F.array("a", "b")).alias("image_id")).distinct(), "ends")
    sets = materialize(tag_sets(image_tags.join(met, "image_id", "left_semi").where("tag is not null")).select(F.col("id").cast("long").alias("id"), "tags"), "met_sets")

    def meet(pairs: pa.Table, facts: pa.Table) -> pa.Table:
        facts = facts.sort_by("id").combine_chunks()
        tags = facts.column("tags").combine_chunks()
        sizes = np.append(pc.list_value_length(tags).to_numpy(zero_copy_only=False).astype(np.int64), 0)
        codes = pc.dictionary_encode(tags.flatten()).indices.to_numpy()
        (x, has_x), (y, has_y) = (_places(facts.column("id").to_numpy(), pairs.column(c)) for c in "ab")
        x, y = np.where(has_x > 0, x, len(sizes) - 1), np.where(has_y > 0, y, len(sizes) - 1)
        na, nb = sizes[x], sizes[y]
        few = (na < 3) | (nb < 3)
        may = np.flatnonzero(~few & (13 * np.minimum(na, nb) >= 3 * (na + nb)))
        few[may] = 13 * _shared(codes, np.cumsum(sizes) - sizes, sizes, x[may], y[may]) >= 3 * (na + nb)[may]
        return pairs.filter(pa.array(few))

    return met_in_cells(pairs, sets, 12 * F.size("tags"), meet, pairs.schema)


def near_pairs_by_tags(sig: DataFrame, sets: DataFrame, max_dist: int, aspect_tol: float = 0.30, cell_bytes: int = 96 << 20) -> DataFrame:
    """J13 on the pairs of J5: those of ``sig(id, words, ar)`` within ``max_dist`` bits whose ``sets(id, tags)`` agree by 30 % or more, or where a side has fewer than three tags.

    Signatures and coded tags meet in the cells of a grid, so a pair that is
    near is judged in the task that finds it, and only pairs of the result are written.
    """
    sig = materialize(sig.where("id is not null and words is not null").select(F.col("id").cast("long").alias("id"), "words", F.col("ar").cast("double").alias("ar")), "signatures")
    ids = sig.select("id").distinct()
    sets = materialize(sets.where("size(tags) > 0").select(F.col("id").cast("long").alias("id"), "tags").join(ids, "id", "left_semi"), "met_sets")
    empty = F.lit(b"")
    rows = sig.join(_in_codes(sets), "id", "left").select("id", "words", "ar", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rare", empty).alias("rare"), F.coalesce("often", empty).alias("often"))
    rows = materialize(rows, "signed_sets")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("rare").cast("long") + F.octet_length("often") + 24), F.lit(0))).first()[0]
    groups = max(1, -(-2 * total // cell_bytes), min(6, total >> 20))

    def meet(cell: pa.Table) -> pa.Table:
        low, high = (cell.column(x)[0].as_py() for x in ("low", "high"))
        ids, ar, n, g = (cell.column(x).to_numpy() for x in ("id", "ar", "n", "g"))
        n, codes = n.astype(np.int64), np.append(_codes_of(cell), np.int32(0))
        words = cell.column("words").combine_chunks()
        words = _in_64s(words.flatten().to_numpy().reshape(len(ids), -1).astype(np.uint64))
        del cell
        begin = np.cumsum(n) - n
        left = np.flatnonzero(g == low)
        right = left if low == high else np.flatnonzero(g == high)
        of_left, of_right = ([w[rows] for w in words] for rows in (left, right))
        # Two bitmaps differ in no more bits than the sets have tags apart.
        maps = np.ascontiguousarray(_parities(codes, begin, n, 2048).T)

        def close() -> Iterator[tuple[np.ndarray, ...]]:
            for i in range(0, len(left), 128):
                for j in range(0, i + 128 if low == high else len(right), 2048):
                    x, y = left[i : i + 128], right[j : j + 2048]
                    d = np.bitwise_count(of_left[0][i : i + 128, None] ^ of_right[0][j : j + 2048])
                    for v, w in zip(of_left[1:], of_right[1:], strict=True):
                        d = d.astype(np.uint16) + np.bitwise_count(v[i : i + 128, None] ^ w[j : j + 2048])
                    at = np.flatnonzero((d <= max_dist).reshape(-1))
                    u, v = np.divmod(at, len(y))
                    u, v = x[u], y[v]
                    ok = (ids[u] != ids[v]) & ((low != high) | (v < u))
                    u, v, d = u[ok], v[ok], d.reshape(-1)[at[ok]].astype(np.int32)
                    first = ids[u] < ids[v]
                    u, v = np.where(first, u, v), np.where(first, v, u)
                    both, least = n[u] + n[v], np.minimum(n[u], n[v])
                    ok = aspect_near(ar[u], ar[v], aspect_tol) & ((least < 3) | (13 * least >= 3 * both))
                    yield u[ok], v[ok], d[ok]

        out = []
        for u, v, d in _gathered(close(), 1 << 15):
            fits = np.minimum(n[u], n[v]) < 3
            may = np.flatnonzero(~fits & (13 * np.bitwise_count(maps[u] ^ maps[v]).sum(1, dtype=np.int64) <= 7 * (n[u] + n[v])))
            fits[may] = 13 * _shared(codes, begin, n, u[may], v[may]) >= 3 * (n[u] + n[v])[may]
            out.append((ids[u[fits]], ids[v[fits]], d[fits]))
        a, b, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        return pa.table([a, b, d], ["a", "b", "dist"])

    return _dealt(rows, groups).groupBy("cell").applyInArrow(meet, "a long, b long, dist int")


def adjacency(pairs: DataFrame) -> DataFrame:
    """J14. (id, neighbors): a map of each image's partners and their distance."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("o"), "dist"), F.struct(F.col("b").alias("id"), F.col("a").alias("o"), "dist"))).alias("p")).select("p.*")
    lists = both.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", "dist"))).alias("l"))
    # Of a partner named several times the first and nearest stays.
    return lists.select("id", F.map_from_entries(F.filter("l", lambda x, k: (k == 0) | (x["o"] != F.get("l", k - 1)["o"]))).alias("neighbors"))


def match_path_ci(paths: DataFrame, media: DataFrame) -> DataFrame:
    """J15. (path, id): the row with exactly that path, else the one that differs in case only."""
    rows = media.select("id", "filepath", F.lower("filepath").alias("low"))
    hit = paths.select("path", F.lower("path").alias("low")).distinct().join(rows, "low")
    best = F.struct(F.when(F.col("path") == F.col("filepath"), 0).otherwise(1), "id")
    return hit.groupBy("path").agg(F.min_by("id", best).alias("id"))


def vocabulary_lookup(names: DataFrame, tags: DataFrame) -> DataFrame:
    """J16. (name, tag, category) of the names that are tags, in normal form."""
    asked = names.select("name", S.norm_tag(F.col("name")).alias("key")).distinct()
    return asked.join(tags.select(F.col("name").alias("tag"), "category", S.norm_tag(F.col("name")).alias("key")), "key").select("name", "tag", "category")


def enrich_pairs(pairs: DataFrame, media: DataFrame) -> DataFrame:
    """J17. Pairs with size, rating and date of both members."""
    own = ["width", "height", "file_size", "rating", "file_date"]
    facts = materialize(media.select(F.col("id").cast("long").alias("id"), F.struct(*own).alias("row")), "facts")
    pairs = materialize(pairs, "pairs")

    def meet(pairs: pa.Table, facts: pa.Table) -> pa.Table:
        pairs, facts, *ends = _both_ends(pairs, facts)
        for x, at in zip("ab", ends, strict=True):
            pairs = pairs.append_column(f"{x}_row", facts.column("row").take(at))
        return pairs

    rows = [T.StructField(f"{x}_row", facts.schema["row"].dataType) for x in "ab"]
    return met_in_cells(pairs, facts, F.lit(48), meet, T.StructType([*pairs.schema.fields, *rows]))


def agreement_check(pairs: DataFrame, vectors: DataFrame, max_shift: float = 0.6, max_median: float = 1.0, max_colour: float = 3.2, max_block: float = 6.0, block_ratio: float = 2.5, least_block: float = 1.5, noise: float = 0.3) -> DataFrame:
    """J18. Whether two pictures show the same, by their block means ``vectors(id, v[, colour])``.

    Told apart in this order: the mean of the differences (``brightness``),
    their median size (``overall``), the largest difference of the colour
    blocks if there are any (``colour``), and one area that stands out
    (``detail``): a block above ``max_block``, or above ``least_block`` and
    ``block_ratio`` times the pair's own 99th percentile and ``noise``, so
    that compression spread over the picture is no change and a small edit
    of a clean one is. Returns (a, b, same, reason); reason is null when the
    same. Vectors of unlike lengths or with nulls: not the same (``unreadable``).
    """
    colour = F.col("colour") if "colour" in vectors.columns else F.array()
    facts = materialize(vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), colour.cast("array<double>").alias("colour")), "vectors")
    pairs = materialize(pairs.select("a", "b"), "pairs")

    def gaps(lists: pa.ListArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(place, pair): the differences of lists of one length."""
        values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        return values[x].T - values[y].T

    def judged(facts: pa.Table, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = gaps(facts.column("v").combine_chunks(), x, y)
        mean = np.abs(np.add.reduce(d, 0)) / len(d)
        s = np.sort(np.abs(d), 0)

        def quantile(q: float) -> np.ndarray:
            """Linear between the two values around it."""
            at = q * (len(s) - 1)
            low = s[int(at)]
            return low + (s[min(int(at) + 1, len(s) - 1)] - low) * (at - int(at))

        c = np.abs(gaps(facts.column("colour").combine_chunks(), x, y)).max(0, initial=0.0)
        local = (s[-1] > max_block) | ((s[-1] > least_block) & (s[-1] > block_ratio * (quantile(0.99) + noise)))
        # Not a number counts as above each limit, as in Spark.
        return np.select([~(mean <= max_shift), ~(quantile(0.5) <= max_median), ~(c <= max_colour), local], [1, 2, 3, 4], 0)

    def meet(pairs: pa.Table, facts: pa.Table) -> pa.Table:
        pairs, facts, x, y = _both_ends(pairs, facts)
        why = np.full(len(x), 5)
        # A picture's kind: the lengths of its lists, none where something is missing.
        kind = np.zeros((facts.num_rows, 2), np.int64)
        for k, name in enumerate(("v", "colour")):
            lists = facts.column(name).combine_chunks()
            kind[:, k] = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
            kind[np.unique(pc.list_parent_indices(lists).filter(lists.flatten().is_null()).to_numpy()), k] = -1
        whole = (kind[:, 0] > 0) & (kind[:, 1] >= 0)
        alike = whole[x] & (kind[x] == kind[y]).all(1)
        for lengths in np.unique(kind[whole], axis=0):
            of = np.flatnonzero((kind == lengths).all(1))
            rows, place = facts.take(of), np.cumsum((kind == lengths).all(1)) - 1
            mine = np.flatnonzero(alike & (kind[x] == lengths).all(1))
            for k in range(0, len(mine), 1 << 14):
                some = mine[k : k + (1 << 14)]
                why[some] = judged(rows, place[x[some]], place[y[some]])
        reasons = pa.array([None, "brightness", "overall", "colour", "detail", "unreadable"], pa.string()).take(pa.array(why))
        return pa.table([pairs.column("a"), pairs.column("b"), pa.array(why == 0), reasons], ["a", "b", "same", "reason"])

    ends = [pairs.schema["a"], pairs.schema["b"], T.StructField("same", T.BooleanType()), T.StructField("reason", T.StringType())]
    size = 8 * F.greatest(F.lit(1), F.size("v") + F.size("colour"))
    return met_in_cells(pairs, facts, size, meet, T.StructType(ends))


def rows_in_order(ids: list[int], media: DataFrame) -> DataFrame:
    """J19. The rows of an id list in the list's order."""
    asked = media.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos int, id long")
    return media.join(asked, "id").orderBy("pos")


def first_match(new: DataFrame, pool: DataFrame, max_dist: int = 13) -> DataFrame:
    """W15. The first hit of each arrival ``new(id, words)``: in the pool by id, then among the arrivals with smaller ids."""
    arrived = materialize(pack_signatures(new, 0.0), "arrived")
    return first_match_packed(arrived, arrived.unionByName(materialize(pack_signatures(pool, -1.0), "pool")), max_dist)


def first_match_packed(new: DataFrame, known: DataFrame, max_dist: int = 13) -> DataFrame:
    """W15, T7. The first hit of each signature in the blocks ``new``, by the order of its block and then by id, among the blocks ``known``.

    ``known`` holds the blocks of ``new`` too. Hits come before: of a smaller
    order, or of the same and with a smaller id. A task hands on one hit a
    signature, not all pairs.
    """
    near = _met(new, known, max_dist, False, first=True)
    best = near.groupBy(F.col("l").alias("id")).agg(F.min_by(F.struct(F.col("r").alias("hit"), "dist"), F.struct("ar_r", "r")).alias("m"))
    return best.select("id", "m.hit", "m.dist")
