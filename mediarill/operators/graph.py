"""Groups of similar images: components, greedy cliques, pruning."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize
from . import joins as J


def _greedy(pairs: pd.DataFrame, inside: np.ndarray | None = None, first: int | None = None) -> list[list[int]]:
    """The groups of ``pairs(a, b, k)``, smaller ``k`` first.

    A pair of free images opens a group. Only those near to both can join:
    free ones, by the worse of their two values and then by id, each if it
    is near to all that joined before.

    With ``inside``, the images of one region, pairs has all pairs with an
    end there, and only groups that are sure come out. A pair is decided if its
    ends and all free common neighbours lie inside and no earlier pair that was left open
    could use any of them; else it is left open itself, and so are from then on all
    images that it could use. An image with two neighbours outside is open from the
    start, as those may be a pair of their own that takes it.

    With ``first``, only so many pairs are tried; the others only tell who is near.

    Neighbours are kept in flat sorted arrays, some 40 bytes a pair.
    """
    n_pairs = len(pairs)
    ids, ends = np.unique(pairs[["a", "b"]].to_numpy(np.int64).T.reshape(-1), return_inverse=True)
    k, n = pairs["k"].to_numpy(np.float64), len(ids)
    a, b = ends[:n_pairs], ends[n_pairs:]
    order = np.lexsort((b, a, k))[:first]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.lexsort((dst, src))
    near, value, begin = dst[by].astype(np.int32), np.concatenate([k, k])[by], np.searchsorted(src[by], np.arange(n + 1))
    used, safe = np.zeros(n, bool), np.ones(n, bool)
    if inside is not None:
        safe = np.isin(ids, inside)
        safe &= np.bincount(src[~safe[dst]], minlength=n) < 2
    out = []
    gone, low, high = memoryview(used), a[order].tolist(), b[order].tolist()
    del src, dst, by, ends
    for x, y in zip(low, high, strict=True):
        if gone[x] or gone[y]:
            continue
        of_x, of_y = slice(begin[x], begin[x + 1]), slice(begin[y], begin[y + 1])
        common, i, j = np.intersect1d(near[of_x], near[of_y], True, True)
        free = ~used[common]
        common = common[free]
        if inside is not None and not (safe[x] and safe[y] and safe[common].all()):
            safe[[x, y]] = False
            safe[common] = False
            continue
        worse = np.maximum(value[of_x][i], value[of_y][j])[free]
        left, group = common[np.lexsort((common, worse))], [x, y]
        while len(left):
            group.append(int(left[0]))
            left = left[1:][np.isin(left[1:], near[begin[left[0]] : begin[left[0] + 1]])]
        used[group] = True
        out.append(ids[group].tolist())
    return out


_GROUPED = "group_id long, id long"


def _rows_of(groups: list[list[int]]) -> pd.DataFrame:
    return pd.DataFrame([(min(g), m) for g in groups for m in g], columns=["group_id", "id"], dtype="int64")


def _regions(rows: DataFrame, most: int, max_rounds: int = 40) -> DataFrame:
    """``(node, region)``: the nodes of ``rows(a, b)`` in regions of about ``most`` pairs each, cut along the pairs.

    Clusters begin as single nodes. In each round the clusters get new hashes,
    each is joined to the neighbour of the smallest hash, if that is smaller
    than its own, and to the one that this is joined to; links are
    then told between clusters, so that what a round works on shrinks by a
    factor each time. Clusters that would have more than ``most`` pairs
    together are not joined. Small components end as one cluster; chains are
    cut into pieces, whatever their ids. A node with more pairs than a region
    may have is in none. Regions are put together by hash into as many as
    have ``most`` pairs on average.
    """
    ends = 2 * most
    both = rows.select(F.col("a").alias("node"), F.col("b").alias("o")).unionByName(rows.select(F.col("b").alias("node"), F.col("a").alias("o")))
    sizes = materialize(both.groupBy("node").agg(F.count("*").alias("w")).where(F.col("w") <= ends), "ends")
    labels, clusters = sizes.select("node", F.col("node").alias("c")), sizes.select(F.col("node").alias("c"), "w")
    links, idle = both.select(F.col("node").alias("c"), F.col("o").alias("d")), 0
    total = sizes.agg(F.sum("w")).first()[0] or 0

    for k in range(max_rounds):
        links = links.join(clusters, "c").join(clusters.select(F.col("c").alias("d"), F.col("w").alias("v")), "d").where(F.col("w") + F.col("v") <= ends)
        links = materialize(links.select("c", "d"), "links")
        if links.isEmpty() or idle == 2:
            break
        key = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("c"))  # noqa: B023, E731
        first = links.groupBy("c").agg(F.min(key("d")).alias("m")).where(F.col("m") < key("c")).select("c", F.col("m.c").alias("to"))
        first = materialize(first, "first")
        far = first.join(first.select(F.col("c").alias("to"), F.col("to").alias("far")), "to", "left").select("c", F.coalesce("far", "to").alias("to"))
        placed = clusters.join(far, "c", "left").select("c", "w", F.coalesce("to", "c").alias("to"))
        heavy = placed.groupBy("to").agg(F.sum("w").alias("sum")).where(F.col("sum") > ends).select("to", F.lit(True).alias("heavy"))
        moved = placed.join(heavy, "to", "left").where("heavy is null and c <> to").select("c", "to")
        moved = materialize(moved, "moved")
        idle = idle + 1 if moved.isEmpty() else 0
        now = lambda df, c: df.join(moved.select(F.col("c").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        labels, clusters = materialize(now(labels, "c"), "labels"), materialize(now(clusters, "c").groupBy("c").agg(F.sum("w").alias("w")), "clusters")
        links = now(now(links, "c"), "d").where("c <> d").distinct()
    bins = max(1, -(-int(total) // ends))
    return materialize(labels.select("node", F.pmod(F.xxhash64("c"), F.lit(bins)).alias("region")), "regions")


def _decided(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Groups that tasks of one region each can decide; a pair between two regions goes to both."""
    side = lambda end: regions.select(F.col("node").alias(end), F.col("region").alias(f"{end}_region"))
    placed = rows.join(side("a"), "a", "left").join(side("b"), "b", "left")
    placed = placed.select("a", "b", "k", "a_region", "b_region", F.explode(F.array_distinct(F.array("a_region", "b_region"))).alias("region")).where("region is not null")
    inner = lambda end: F.coalesce(F.col(f"{end}_region") == F.col("region"), F.lit(False)).alias(f"{end}_in")
    placed = placed.select("region", "a", "b", "k", inner("a"), inner("b"))
    return placed.groupBy("region").applyInPandas(lambda pdf: _rows_of(_greedy(pdf, np.union1d(pdf.loc[pdf["a_in"], "a"], pdf.loc[pdf["b_in"], "b"]))), _GROUPED)


def _in_one_task(rows: DataFrame) -> DataFrame:
    return rows.withColumn("all", F.lit("all")).groupBy("all").applyInPandas(lambda pdf: _rows_of(_greedy(pdf)), _GROUPED)


#: Pairs that are opened in order at a time, the pairs around them that go to one task, and the pairs of common neighbours that are looked up for them.
FIRST, AROUND, LOOKED_UP = 20_000, 2_000_000, 20_000_000


def _first_pairs(rows: DataFrame) -> DataFrame:
    """Groups that the first of ``rows(a, b, k)`` open, taken in order by one task that has their surroundings.

    The surroundings of a pair are its common neighbours, their links to its ends, and
    the links among them: whatever its group may need. In a tangle common
    neighbours are few, and the links among those of one pair are looked up. In clusters many first
    pairs have the same surroundings; where there would be more than ``LOOKED_UP`` of such look-ups,
    all pairs among ends and common neighbours are taken instead. Of the
    first ``FIRST`` pairs so many are taken that their surroundings stay below
    ``AROUND`` pairs, and one in any case.
    """
    first = materialize(rows.orderBy("k", "a", "b").limit(FIRST), "first_pairs")
    both = rows.select(F.col("a").alias("x"), F.col("b").alias("c"), "k").unionByName(rows.select(F.col("b").alias("x"), F.col("a").alias("c"), "k"))
    many = FIRST
    while True:
        side = lambda end: both.withColumnsRenamed({"x": end, "k": f"k{end}"}).join(first.select(end).distinct(), end, "left_semi")  # noqa: B023, E731
        common = materialize(first.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "c"]).select("a", "b", "c", "ka", "kb"), "common")
        lookups = common.groupBy("a", "b").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) / 2")), F.lit(0))).first()[0]
        if lookups <= LOOKED_UP:
            to = lambda end: common.select(F.least(end, "c").alias("a"), F.greatest(end, "c").alias("b"), F.col(f"k{end}").alias("k"))  # noqa: B023, E731
            other = common.select("a", "b", F.col("c").alias("d"))
            among = common.join(other, ["a", "b"]).where("c < d").select(F.col("c").alias("a"), F.col("d").alias("b")).distinct()
            near = first.unionByName(to("a")).unionByName(to("b")).unionByName(rows.join(among, ["a", "b"], "left_semi").select("a", "b", "k")).distinct()
        else:
            nodes = first.select(F.explode(F.array("a", "b")).alias("x")).unionByName(common.select(F.col("c").alias("x"))).distinct()
            nodes = materialize(nodes, "around")
            near = rows.join(nodes.withColumnRenamed("x", "a"), "a", "left_semi").join(nodes.withColumnRenamed("x", "b"), "b", "left_semi").select("a", "b", "k")
        near = materialize(near, "around_pairs")
        size = near.count()
        if many == 1 or size <= AROUND:
            break
        many = max(1, min(many // 2, many * AROUND // size))
        first = materialize(first.orderBy("k", "a", "b").limit(many), "first_pairs")
    # The first pairs of all come first among their surroundings too.
    most = many
    return near.withColumn("all", F.lit("all")).groupBy("all").applyInPandas(lambda pdf: _rows_of(_greedy(pdf, first=most)), _GROUPED)


def _worst_pct(worst: Column, bits: int) -> Column:
    """A group's similarity in per cent, that of its worst pair."""
    return F.when(worst <= 0, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(99), F.floor((1 - worst / bits) * 100).cast("int")))).cast("int")


def clique_groups(pairs: DataFrame, order: str = "dist", bits: int = 256, most_pairs: int = 2_000_000, told: Callable[[int, int], None] | None = None) -> DataFrame:
    """G1, G2. Disjoint cliques of ``pairs(a, b, dist)`` or ``pairs(a, b, sim)`` as (group_id, id, size, similarity).

    Best pairs first, ties to smaller ids: greedy choice. Up to ``most_pairs``
    pairs are grouped in one task. Of more, the first pairs of all are opened in
    order with their surroundings at hand, for two turns and as long as that
    takes a tenth of the pairs away in a turn: in a dense tangle, where few images have many
    pairs, it soon does, and borders would be everywhere. What is left is cut
    into regions of about ``most_pairs``, components or parts of them; a task
    decides the pairs of its region in order, running ahead as far as nothing
    that is still open beyond its border can touch them. Used images go, which
    sets the next regions free. Where that hardly gets on, the first pairs are
    opened again, so each turn gets on; and if that is of little use for some
    turns, the rest is cut anew, with other borders. The groups are the plain
    rule's. ``told(round, pairs)`` hears how many pairs are left. ``dist``
    groups report their worst pair, ``sim`` groups the rounded mean. group_id
    is the smallest member.
    """
    distance = order == "dist"
    value = F.col("dist" if distance else "sim").cast("double")
    rows = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (value if distance else -value).alias("k")).where("a < b").groupBy("a", "b").agg(F.min("k").alias("k"))
    rows = all_rows = materialize(rows, "pairs")
    done, left, most_pairs = [], rows.count(), max(1, most_pairs)

    def without_used(rows: DataFrame, used: DataFrame) -> DataFrame:
        used = used.select("id")
        rest = rows.join(used.withColumnRenamed("id", "a"), "a", "left_anti").join(used.withColumnRenamed("id", "b"), "b", "left_anti")
        return materialize(rest.select("a", "b", "k"), "rest")

    rounds, regions, idle, patience, before = 0, None, 0, 2, 0
    while left > most_pairs and (rounds < 2 or before - left >= before // 10):
        before = left
        done.append(materialize(_first_pairs(rows), "opened"))
        rows = without_used(rows, done[-1])
        left, rounds = rows.count(), rounds + 1
        if told is not None:
            told(rounds, left)
    while left > most_pairs:
        if regions is None:
            regions, idle = _regions(rows, most_pairs), 0
        before = left
        for step in ("decided", "opened"):
            if step == "decided" or (left > most_pairs and before - left < before // 50):
                done.append(materialize(_decided(rows, regions) if step == "decided" else _first_pairs(rows), step))
                rows = without_used(rows, done[-1])
                left, rounds = rows.count(), rounds + 1
        idle = idle + 1 if before - left < before // 50 else 0
        if idle == patience:
            regions, patience = None, 2 * patience
        if told is not None:
            told(rounds, left)
    done.append(materialize(_in_one_task(rows), "small"))
    groups = done[0]
    for more in done[1:]:
        groups = groups.unionByName(more)
    groups = groups.withColumnRenamed("group_id", "g")
    inside = all_rows.join(groups.withColumnRenamed("id", "a"), "a").join(groups.select(F.col("id").alias("b"), F.col("g").alias("h")), "b").where("g = h")
    mean = F.round(F.expr("bround(avg(-k), 0)")).cast("int")
    score = _worst_pct(F.max("k"), bits) if distance else mean
    facts = inside.groupBy("g").agg(score.alias("similarity"))
    sizes = groups.groupBy("g").agg(F.count("*").cast("int").alias("size"))
    return groups.join(sizes, "g").join(facts, "g").select(F.col("g").alias("group_id"), "id", "size", "similarity")


#: Signatures that one task may hold, pairs that are opened in a turn, and partners of an image that are told at each distance.
HELD, A_TURN, TOLD_PARTNERS = 1 << 20, 2_000_000, 8


class _Signatures:
    """Free images by id with their signatures, and the plain rule on them."""

    def __init__(self, blocks: pa.Table, max_dist: int, aspect_tol: float):
        raw = lambda c, t: np.frombuffer(b"".join(blocks.column(c).to_pylist()), t)
        ids = raw("ids", np.int64)
        by = np.argsort(ids)
        self.ids, self.ar, self.max_dist, self.tol = ids[by], raw("ar", np.float64)[by], max_dist, aspect_tol
        self.words = J._in_64s(raw("words", np.uint64).reshape(len(ids), -1)[by]) if len(ids) else [np.zeros(0, np.uint64)]
        self.used, self.free, self.gone = np.zeros(len(ids), bool), np.arange(len(ids)), 0
        self.free_words = self.words

    def _apart(self, x: int, rows: np.ndarray | None = None) -> np.ndarray:
        of = self.free_words if rows is None else [w[rows] for w in self.words]
        d = np.bitwise_count(of[0] ^ self.words[0][x])
        for v, w in zip(of[1:], self.words[1:], strict=True):
            d = d.astype(np.uint16) + np.bitwise_count(v ^ w[x])
        return d

    def _near(self, x: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where the free images near to x stand among ``rows``, or else among ``free``, and their distances."""
        d = self._apart(x, rows)
        at = np.flatnonzero(d <= self.max_dist)
        y = self.free[at] if rows is None else rows[at]
        first = y < x
        ok = ~self.used[y] & (y != x) & J.aspect_near(np.where(first, self.ar[y], self.ar[x]), np.where(first, self.ar[x], self.ar[y]), self.tol)
        return at[ok], d[at[ok]].astype(np.int64)

    def next_partner(self, x: int, dist: int) -> int | None:
        """The first free image behind x that is near to it and just ``dist`` bits apart."""
        at, d = self._near(x)
        y = self.free[at[d == dist]]
        y = y[y > x]
        return int(y[0]) if len(y) else None

    def open(self, x: int, y: int, dist: int) -> tuple[list[int], int]:
        """The group that a pair opens, and the distance of its worst pair."""
        at, far = self._near(x)
        left = self.free[at]
        at, d = self._near(y, left)
        left, far = left[at], np.maximum(far[at], d)
        by = np.lexsort((left, far))
        left, far, group = left[by], far[by], [x, y]
        while len(left):
            c, dist = int(left[0]), max(dist, int(far[0]))
            group.append(c)
            left, far = left[1:], far[1:]
            at, d = self._near(c, left)
            left, far = left[at], np.maximum(far[at], d)
        self.used[group] = True
        self.gone += len(group)
        if 4 * self.gone > len(self.free):
            self.free, self.gone = np.flatnonzero(~self.used), 0
            self.free_words = [w[self.free] for w in self.words]
        return group, dist


def _opened(blocks: DataFrame, first: DataFrame, max_dist: int, aspect_tol: float) -> DataFrame:
    """Groups that the pairs of ``first(a, dist, partners)`` open, in order, by one task that has the signatures of all free images and no pairs among them."""

    def decide(blocks: pa.Table, first: pa.Table) -> pa.Table:
        known = _Signatures(blocks, max_dist, aspect_tol)
        a, dist = first.column("a").to_numpy(), first.column("dist").to_numpy()
        lists = first.column("partners").combine_chunks()
        begin, partners = lists.offsets.to_numpy(), np.searchsorted(known.ids, lists.flatten().to_numpy())
        rows, used = np.searchsorted(known.ids, a), memoryview(known.used)
        out: list[tuple[list[int], int]] = []
        for k in np.lexsort((a, dist)).tolist():
            x = int(rows[k])
            if used[x]:
                continue
            told = partners[begin[k] - begin[0] : begin[k + 1] - begin[0]].tolist()
            y = next((y for y in told[:TOLD_PARTNERS] if not used[y]), None)
            if y is None and len(told) > TOLD_PARTNERS:
                y = known.next_partner(x, int(dist[k]))
            if y is not None:
                out.append(known.open(x, y, int(dist[k])))
        size = np.array([len(g) for g, _ in out], np.int64)
        ids = known.ids[np.array([m for g, _ in out for m in g], np.int64)]
        group = np.array([min(g) for g, _ in out], np.int64)
        worst = np.array([w for _, w in out], np.int64)
        return pa.table([np.repeat(known.ids[group], size), ids, np.repeat(size, size).astype(np.int32), np.repeat(worst, size).astype(np.int32)], ["group_id", "id", "size", "worst"])

    one = lambda df: df.withColumn("all", F.lit("all")).groupBy("all")
    return one(blocks).cogroup(one(first)).applyInArrow(lambda x, y: decide(x, y), "group_id long, id long, size int, worst int")


def signature_groups(sig: DataFrame, max_dist: int, aspect_tol: float = 0.30, bits: int = 64, told: Callable[[int, int, int], None] | None = None) -> DataFrame:
    """G1. ``clique_groups`` of the pairs within ``max_dist`` bits of ``sig(id, words, ar)``, without those pairs.

    A group depends on which pairs come first and on who is near to whom, and
    the latter the signatures tell themselves. So pairs are looked for in
    turns, from near to far: as many distances at a time as have ``A_TURN``
    pairs, one at least, and only among images that are still free. Most
    images are used up by near pairs, so the many far ones are never made.
    Blocks of free signatures are compared by all tasks; a task then opens the turn's pairs in
    order, with the signatures of the free images at hand, some 24 bytes each.
    Of an image's partners at one distance it is told the first few, and looks
    for more itself if those are used and there are any. ``told(limit, pairs,
    free)`` hears of each turn. Where an id stands twice, or more than
    ``HELD`` images have signatures, the pairs are made and grouped.
    """
    rows = materialize(sig.where("id is not null and words is not null").select(F.col("id").cast("long").alias("id"), "words", F.col("ar").cast("double").alias("ar")), "signatures")
    if rows.count() > HELD or not rows.groupBy("id").count().where("count > 1").isEmpty():
        return clique_groups(J.hamming_pairs(rows, max_dist, aspect_tol, bits), bits=bits)
    done: list[DataFrame] = []
    limit = -1
    while True:
        blocks = J._blocks(rows)
        counts = J.near_counts(blocks, max_dist)
        among = np.cumsum(counts)
        if not among[-1] or limit == max_dist:
            break
        first = int(np.flatnonzero(among)[0])
        limit = max(first, limit + 1, int(np.searchsorted(among, A_TURN, "right")) - 1)
        if told is not None:
            told(limit, int(among[limit]), rows.count())
        partners = materialize(J.first_partners(blocks, limit, aspect_tol, TOLD_PARTNERS), "partners")
        done.append(materialize(_opened(blocks, partners, max_dist, aspect_tol), "opened"))
        if limit == max_dist:
            break
        rows = materialize(rows.join(done[-1].select("id"), "id", "left_anti"), "free")
    if not done:
        return rows.sparkSession.createDataFrame([], "group_id long, id long, size int, similarity int")
    groups = done[0]
    for more in done[1:]:
        groups = groups.unionByName(more)
    return groups.select("group_id", "id", "size", _worst_pct(F.col("worst").cast("double"), bits).alias("similarity"))


def prune_groups(groups: DataFrame, removed: DataFrame) -> DataFrame:
    """G4. Groups without removed members; groups of one go."""
    left = groups.join(removed.select("id").distinct(), "id", "left_anti")
    sizes = left.groupBy("group_id").agg(F.count("*").cast("int").alias("size")).where("size > 1")
    return left.drop("size").join(sizes, "group_id").select(*groups.columns)


def pairs_within(groups: DataFrame) -> DataFrame:
    """G5. All pairs ``a < b`` inside each group of ``groups(group_id, id)``; groups are cliques and so already their pairs' size."""
    a, b = (groups.select("group_id", F.col("id").alias(x)) for x in "ab")
    return a.join(b, "group_id").where("a < b").select("group_id", "a", "b")


#: Pairs of groups that are told to all tasks; of more, both sides are shuffled.
TOLD = 1 << 20


def mark_pairs(ignored: DataFrame, groups: DataFrame, add: bool = True, once: bool = False) -> DataFrame:
    """M16. Ignored pairs with the pairs of ``groups`` added, or without them; each pair once.

    ``once``: no pair stands twice in ``ignored``. Then ignored pairs, which may be
    very many, are looked up where they are and nothing of them is shuffled, as long
    as the groups have no more than ``TOLD`` pairs.
    """
    pairs = materialize(pairs_within(groups).select("a", "b").distinct(), "group_pairs")
    left = ignored.select("a", "b").join(F.broadcast(pairs) if pairs.count() <= TOLD else pairs, ["a", "b"], "left_anti")
    left = left if once else left.distinct()
    return left.union(pairs) if add else left
