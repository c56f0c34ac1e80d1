"""Operators that replace all-pairs or whole-table work, against the plain rule or the plain plan."""

import itertools

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from mediarill.operators import aggregates, filters, graph, joins, ranking
from mediarill.plans.catalog_queries import QUERIES
from mediarill.plans.shared import new_path
from mediarill.sources import io
from mediarill.sources import views as V
from mediarill.sources.search_index import SearchIndex, _grams, _packed, _unpacked, source_key, terms_of
from mediarill.streaming import changes
from mediarill.streaming.change_log import ChangeLog


# Cliques (G1, G2).
def groups_of(spark, pairs, **how):
    got = graph.clique_groups(spark.createDataFrame(pairs), **how).toPandas()
    return sorted(tuple(sorted(g)) for _, g in got.groupby("group_id")["id"])


def plain_groups(pairs):
    """The clique rule in plain steps."""
    near: dict = {}
    for a, b, k in pairs.itertuples(index=False):
        near.setdefault(a, {})[b] = k
        near.setdefault(b, {})[a] = k
    free, out = set(near), []
    for a, b in pairs.sort_values([pairs.columns[2], "a", "b"])[["a", "b"]].itertuples(index=False):
        if a in free and b in free:
            group = [a, b]
            for c in sorted(near[a].keys() & near[b].keys() & free, key=lambda c: (max(near[a][c], near[b][c]), c)):  # noqa: B023
                if all(m in near[c] for m in group[2:]):
                    group.append(c)
            free.difference_update(group)
            out.append(tuple(sorted(group)))
    return sorted(out)


@pytest.mark.parametrize("words, limit, told", [(2, 20, 8), (2, 24, 1), (4, 50, 2)])
def test_groups_of_signatures_are_those_of_their_pairs(spark, monkeypatch, words, limit, told):
    """turns by distance, few partners told, copies in masses, odd aspects; the pairs themselves are never made."""
    rng = np.random.default_rng(words * limit)
    heart = rng.integers(0, 2**32, (12, words))
    copies = [(heart[k % 12] ^ (1 << rng.integers(0, 32, words)) * rng.integers(0, 2, words) ^ (1 << rng.integers(0, 32, words)) * rng.integers(0, 2, words)).tolist() for k in range(160)]
    rows = [(w, 1 + k % 4 / 10) for k, w in enumerate(copies)] + [(heart[0].tolist(), 1.0)] * 70 + [(w, 1.5) for w in rng.integers(0, 2**32, (250, words)).tolist()]
    rows += [(heart[1].tolist(), x) for x in (0.0, -1.0, float("nan"), None, 3.0)] + [(None, 1.0)]
    ids = rng.permutation(5 * len(rows))[: len(rows)].tolist()
    sig = spark.createDataFrame([(i, w, x) for i, (w, x) in zip(ids, rows, strict=True)] + [(None, heart[0].tolist(), 1.0)], "id long, words array<long>, ar double").repartition(5)
    pairs = joins.hamming_pairs(sig.where("id is not null"), limit, bits=32 * words)
    want = graph.clique_groups(pairs, bits=32 * words).toPandas()
    monkeypatch.setattr(graph, "A_TURN", 300)
    monkeypatch.setattr(graph, "TOLD_PARTNERS", told)
    turns, made = [], joins.hamming_pairs
    monkeypatch.setattr(joins, "hamming_pairs", lambda *_: pytest.fail("all pairs"))
    got = graph.signature_groups(sig, limit, bits=32 * words, told=lambda *x: turns.append(x)).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    assert sorted(tuple(sorted(g)) for _, g in got.groupby("group_id")["id"]) == plain_groups(pairs.toPandas())
    assert len(turns) > 2 and turns[-1][2] < turns[0][2] and (got["size"] > 20).any()
    assert graph.signature_groups(sig.where("ar = 1.5").limit(1), limit).count() == 0

    monkeypatch.setattr(joins, "hamming_pairs", made)
    twice = sig.where("id is not null").union(sig.where("id % 3 = 0").withColumn("words", F.reverse("words")))
    want = graph.clique_groups(joins.hamming_pairs(twice, limit, bits=32 * words), bits=32 * words)
    assert sorted(map(tuple, graph.signature_groups(twice, limit, bits=32 * words).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["g1_clique_groups", "g4_prune_groups", "g5_pairs_within"])
def test_groups_make_no_pairs(spark, sf, monkeypatch, name):
    monkeypatch.setattr(joins, "hamming_pairs", lambda *_: pytest.fail("all pairs"))
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("seed", range(60))
def test_run_ahead_decides_only_what_is_sure(seed):
    """Whatever the region, its groups are among the plain rule's; a whole component is decided whole."""
    rng = random.Random(seed)
    n = rng.randint(4, 30)
    pairs = pd.DataFrame([(a, b, rng.randint(0, 3)) for a, b in itertools.combinations(range(n), 2) if rng.random() < rng.choice([0.1, 0.3, 0.6])] or [(0, 1, 1)], columns=["a", "b", "k"])
    every = set(plain_groups(pairs))
    assert {tuple(sorted(g)) for g in graph._greedy(pairs)} == every
    inside = {x for x in range(n) if rng.random() < 0.7}
    seen = pairs[pairs["a"].isin(inside) | pairs["b"].isin(inside)]
    sure = {tuple(sorted(g)) for g in graph._greedy(seen, np.array(sorted(inside)))} if len(seen) else set()
    assert sure <= every and all(inside.issuperset(g) for g in sure)
    assert {tuple(sorted(g)) for g in graph._greedy(pairs, np.arange(n))} == every


@pytest.mark.parametrize("seed", range(40))
def test_first_pairs_need_their_surroundings_only(seed):
    """Ends, common neighbours and the pairs among them give the groups that the first pairs open."""
    rng = random.Random(seed)
    n, p = rng.randint(4, 40), rng.choice([0.1, 0.3, 0.6])
    pairs = pd.DataFrame([(a, b, rng.randint(0, 3)) for a, b in itertools.combinations(range(n), 2) if rng.random() < p] or [(0, 1, 1)], columns=["a", "b", "k"])
    ordered = pairs.sort_values(["k", "a", "b"])
    first = ordered.head(rng.randint(1, len(pairs)))
    near = {x: set(pairs.loc[pairs["a"] == x, "b"]) | set(pairs.loc[pairs["b"] == x, "a"]) for x in range(n)}
    around = set(first["a"]) | set(first["b"]).union(*(near[a] & near[b] for a, b in zip(first["a"], first["b"], strict=True)))
    got = graph._greedy(pairs[pairs["a"].isin(around) & pairs["b"].isin(around)], first=len(first))
    opened = {(a, b) for a, b in zip(first["a"], first["b"], strict=True)}
    assert got == [g for g in graph._greedy(pairs) if (min(g[:2]), max(g[:2])) in opened]


def test_tangle_with_a_cluster(spark, monkeypatch):
    """Near copies of one picture, whose pairs come first, in a random graph; nothing is cut into regions."""
    rng = np.random.default_rng(8)
    copies = [(a, b, int(rng.integers(0, 2))) for a, b in itertools.combinations(range(30), 2)]
    ends = {tuple(sorted(e)) for e in rng.integers(0, 300, (3000, 2)).tolist() if e[0] != e[1]} - {(a, b) for a, b, _ in copies}
    pairs = pd.DataFrame(copies + [(a, b, int(rng.integers(2, 6))) for a, b in sorted(ends)], columns=["a", "b", "dist"])
    monkeypatch.setattr(graph, "FIRST", 60)
    monkeypatch.setattr(graph, "_regions", lambda *_: pytest.fail("regions"))
    assert groups_of(spark, pairs, most_pairs=1500) == plain_groups(pairs)


def test_tangle_needs_little_around_its_first_pairs(spark, monkeypatch):
    """All pairs among ends and common neighbours would be the whole tangle; what the first pairs need is a part of it, and few turns do."""
    rng = np.random.default_rng(21)
    ends = sorted({(min(e), max(e)) for e in rng.integers(0, 600, (20_000, 2)).tolist() if e[0] != e[1]})
    pairs = pd.DataFrame([(a, b, int(rng.integers(0, 9))) for a, b in ends], columns=["a", "b", "dist"])
    told = []
    monkeypatch.setattr(graph, "FIRST", 100)
    monkeypatch.setattr(graph, "AROUND", 5000)
    monkeypatch.setattr(graph, "_regions", lambda *_: pytest.fail("regions"))
    assert groups_of(spark, pairs, most_pairs=5000, told=lambda k, left: told.append(left)) == plain_groups(pairs)
    assert len(told) <= 6, told
    monkeypatch.setattr(graph, "LOOKED_UP", 0)
    monkeypatch.setattr(graph, "AROUND", 20_000)
    some = pairs.head(6000)
    assert groups_of(spark, some, most_pairs=4000) == plain_groups(some)


def test_long_chain_in_few_rounds(spark):
    """Equal distances and ids in order: the choice runs from one end to the other, through every region."""
    n, told = 300_000, []
    pairs = pd.DataFrame({"a": np.arange(n), "b": np.arange(n) + 1, "dist": 1})
    assert groups_of(spark, pairs, most_pairs=100_000, told=lambda k, left: told.append((k, left))) == plain_groups(pairs)
    assert told[-1][0] < 30 and [left for _, left in told] == sorted((left for _, left in told), reverse=True)


def test_regions_of_mixed_graphs(spark):
    """A chain with ids in any order, a band, a star with more pairs than a region may have, and many small components."""
    rng = np.random.default_rng(4)
    ids = rng.permutation(4000)
    chain = [(ids[k], ids[k + 1], 1) for k in range(1500)]
    band = [(5000 + k, 5000 + k + j, int(rng.integers(0, 3))) for k in range(400) for j in (1, 2)]
    star = [(9000, 9001 + k, 2) for k in range(900)] + [(9001 + k, 9002 + k, 3) for k in range(0, 800, 3)]
    small = [(20_000 + 10 * k + x, 20_000 + 10 * k + y, int(rng.integers(0, 4))) for k in range(200) for x, y in itertools.combinations(range(4), 2)]
    pairs = pd.DataFrame([(min(a, b), max(a, b), d) for a, b, d in chain + band + star + small], columns=["a", "b", "dist"])
    assert groups_of(spark, pairs, most_pairs=700) == plain_groups(pairs)


def test_dense_graph_by_its_first_pairs(spark, monkeypatch):
    """Borders everywhere and many ties: the first pairs are opened in order, some at a time."""
    rng = np.random.default_rng(11)
    pairs = pd.DataFrame([(a, b, int(rng.integers(0, 4))) for a, b in itertools.combinations(range(120), 2) if rng.random() < 0.3], columns=["a", "b", "dist"])
    told = []
    monkeypatch.setattr(graph, "FIRST", 12)
    monkeypatch.setattr(graph, "AROUND", 1500)
    assert groups_of(spark, pairs, most_pairs=1200, told=lambda k, left: told.append(left)) == plain_groups(pairs)
    assert told and told[-1] <= 1200


# Signatures.
@pytest.mark.parametrize(("bits", "limit"), [(64, 3), (64, 7), (64, 10), (128, 13), (256, 20)])
def test_index_of_signatures_loses_no_pair(spark, bits, limit):
    rng = np.random.default_rng(bits + limit)
    base = rng.integers(0, 2, (60, bits))
    rows = list(base) + [base[rng.integers(0, 60)] for _ in range(15)]
    for _ in range(250):
        x = base[rng.integers(0, 60)].copy()
        x[rng.choice(bits, rng.integers(0, limit + 4), replace=False)] ^= 1
        rows.append(x)
    words = [[int("".join(map(str, x[k : k + 32])), 2) for k in range(0, bits, 32)] for x in rows]
    sig = spark.createDataFrame([(k, w, 1.0 + k % 4 / 10) for k, w in enumerate(words)], "id long, words array<long>, ar double")
    plan = joins.probe_plan(bits, limit)
    got = [tuple(r) for r in joins._indexed_pairs(sig, limit, 0.3, plan).collect()]
    want = {(a, b, int((rows[a] != rows[b]).sum())) for a, b in itertools.combinations(range(len(rows)), 2) if (rows[a] != rows[b]).sum() <= limit and abs((1 + a % 4 / 10) / (1 + b % 4 / 10) - 1) <= 0.3}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    assert set(got) == {tuple(r) for r in joins._block_pairs(sig, limit, 0.3).collect()}
    classes = {tuple(r) for r in joins.signature_classes(sig).collect()}
    assert classes == {(min(j for j, w in enumerate(words) if w == words[k]), k) for k in range(len(rows))}


def test_probe_plans():
    assert joins.probe_plan(64, 7) == [(0, 16, 1), (16, 16, 1), (32, 16, 1), (48, 16, 1)]
    assert joins.probe_plan(64, 2) == [(0, 16, 0), (16, 16, 0), (32, 16, 0)]
    assert joins.probe_plan(64, 9) == [(0, 16, 2), (16, 16, 2), (32, 16, 1), (48, 16, 1)]
    assert len(joins.probes(16, 2)) == 137 and all(m.bit_count() <= 2 for m in joins.probes(16, 2))


def test_few_candidates_for_narrow_limits(spark):
    """Random signatures, 7 bits apart at most: about n²/2 * 68 / 65,536 candidates, where bands of eight bits alike had a thirtieth of all pairs."""
    rng, n = np.random.default_rng(8), 6000
    classes = spark.createDataFrame([(k, w) for k, w in enumerate(rng.integers(0, 1 << 32, (n, 2)).tolist())], "rep long, words array<long>")
    met = joins.indexed_candidates(classes, joins.probe_plan(64, 7)).count()
    assert 0.8 < met / (n * n / 2 * 68 / 65_536) < 1.2
    assert met < n * n / 2 * 8 / 256 / 25


# Search (P5).
ODD_ROWS = [(1, "Set_1 (1).jpg", "a cat on the mat", ["cat", "blue_eyes"]), (2, "x.png", None, None), (3, "", "", []), (4, "日本語の猫.gif", "ÉCOLE é\n猫", ["école"]), (5, "aaaa.jpg", "aa a aaa", ["a"]), (None, "lost.jpg", "lost", ["lost"]), (6, "Set_1.png", "the mat", ["cat"]), (6, "again.png", "the mat set 1", [])]


def catalogue(spark, rows):
    media = spark.createDataFrame([(i, f, t) for i, f, t, _ in rows], "id long, filename string, search_text string")
    tags = spark.createDataFrame([(i, t) for i, _, _, ts in rows for t in ts or []], "image_id long, tag string")
    own = media.join(tags.groupBy(F.col("image_id").alias("id")).agg(F.collect_set("tag").alias("t")), "id", "left")
    return media, tags, own.select("id", F.concat(F.array("filename", "search_text"), F.coalesce("t", F.array().cast("array<string>"))).alias("fields"))


@pytest.mark.parametrize("asked", ["cat", "Blue_EYES", "set 1, mat", "猫", "語の猫", "école", "aaa", "aaaa,a", "zzz", "cat,zzz", " , ", "t m", "the mat, set_1 ,e"])
def test_search_by_index_equals_scan(spark, asked):
    media, tags, fields = catalogue(spark, [r for r in ODD_ROWS if r[0] is not None])
    index = SearchIndex.build(fields.repartition(3, "id"), new_path(spark, "index"), buckets=2)
    ids = lambda df: sorted(r["id"] for r in df.select("id").distinct().collect())
    assert ids(index.search(media, asked)) == ids(filters.search(media, tags, asked))
    index.drop()


def test_index_of_given_tables(spark, sf, tmp_path):
    media, tags = V.media(spark, sf), V.image_tags(spark, sf)
    own = media.select("id", "filename", "search_text").join(tags.groupBy(F.col("image_id").alias("id")).agg(F.collect_set("tag").alias("t")), "id", "left")
    fields = own.select("id", F.concat(F.array("filename", "search_text"), "t").alias("fields"))
    made = []

    def rows():
        made.append(1)
        return fields

    key = source_key(spark.read.parquet(f"{sf}/documents.parquet"))
    index = SearchIndex.at(spark, f"{key}-test", rows)
    assert SearchIndex.at(spark, f"{key}-test", rows).path == index.path and len(made) == 1
    found = index.candidates("tion")
    assert found.count() == found.distinct().count() >= index.hits("tion").count() > 0
    for term in ("tion", "Set_12", "und der", "the,ing"):
        assert sorted(r[0] for r in index.hits(term).collect()) == sorted(r["id"] for r in filters.search(media, tags, term).select("id").collect())
    plan = index.postings.where("bucket IN (1) AND gram IN ('ion')")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert "PushedFilters" in plan and "gram" in plan
    assert source_key(spark.read.parquet(f"{sf}/labels.parquet")) != key
    empty = SearchIndex.build(fields.where("false"), new_path(spark, "index"))
    assert empty.hits("tion").count() == empty.hits("a").count() == 0 and empty.hits(" ,") is None
    index.drop()


def test_packed_lists():
    rng = random.Random(2)
    for top in (3, 300, 70_000, 1 << 33, 1 << 62):
        ids = np.array(sorted(rng.sample(range(-5, top), min(50, top))))
        raw = _packed(ids)
        assert _unpacked(raw).tolist() == ids.tolist() and len(raw) <= 9 + 8 * (len(ids) - 1)
    assert terms_of(" A_b ,,c  d") == ["a b", "c d"]


@pytest.mark.parametrize("wide", [False, True])
def test_grams_of_rows_in_any_order(wide):
    """As the plain rule, ids not sorted, and with more letters than gram and row fit into 63 bits with."""
    rng = random.Random(4)
    letters = [chr(k) for k in range(0x4E00, 0x4E00 + 9000)] + [chr(k) for k in range(0x20000, 0x30000)] if wide else "abc\u732b"
    texts = ["\n".join("".join(rng.choices(letters, k=rng.randint(0, 200))) for _ in range(3)) for _ in range(900)]
    texts[7] = "".join(letters) if wide else ""
    ids = rng.sample(range(-(1 << 40), 1 << 40), len(texts))
    batch = pa.record_batch([pa.array(ids), pa.array(texts), pa.array([5] * 600 + [6] * 300, pa.int32())], ["id", "text", "chunk"])
    got, want = {}, {}
    for b in _grams(iter([batch])):
        for r in b.to_pylist():
            got.setdefault((r["gram"], r["chunk"]), []).extend(_unpacked(r["deltas"]).tolist())
            assert r["n"] == len(_unpacked(r["deltas"]))
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        for g in {line[j : j + 3] for line in t.split("\n") for j in range(len(line) - 2)}:
            want.setdefault((g, 5 if k < 600 else 6), []).append(i)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_text_is_indexed_once_and_holds_all_tags(spark, tmp_path):
    """A tag is a piece of its row's cleaned text, so the index has no field for it."""
    odd = ["Don't stop-the_MUSIC 12abc34 5.6.7 x1yzw", "ABC.DEF^ghi=jkl 99", "\u0130stanbul \u00c9COLE na\u00efve stra\u00dfe \u212aelvin", "a\tbcd\n\nefg\u00a0hij 1.abc 2abc abc3", "", None]
    spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fields = {r["id"]: r["fields"] for r in V.search_fields(spark, f"file://{tmp_path}").collect()}
    assert all(len(f) == 2 for f in fields.values())
    tags = V.image_tags(spark, f"file://{tmp_path}").collect()
    assert len(tags) > 15 and all(r["tag"] in fields[r["image_id"]][1] for r in tags)


# Changes (T2, T7).
def test_change_log_writes_changes_only(spark):
    """Many small batches over a large base: rows as the plain rule gives them, bytes in proportion to the changes, repeats without effect."""
    rng, n = random.Random(6), 20_000
    base = {k: ("created", float(k)) for k in range(n)}
    schema = "path long, kind string, at double"
    rows = spark.range(n, numPartitions=2).select(F.col("id").alias("path"), F.lit("created").alias("kind"), F.col("id").cast("double").alias("at"))
    log, written, made = ChangeLog.create(rows, new_path(spark, "log"), fanout=3), [], []
    plain = log._replace
    log._replace = lambda segments, df: (plain(segments, df), made.append((segments[0][0], segments[-1][1])))
    size = log.bytes_of(-1, -1)
    for epoch in range(10):
        batch = {rng.randrange(n + 50): (rng.choice(["created", "modified", "removed"]), epoch + 0.5) for _ in range(20)}
        table = spark.createDataFrame([(k, *v) for k, v in batch.items()], schema).coalesce(1)
        log.apply(table, epoch)
        if epoch % 4 == 0:
            log.apply(table, epoch)  # a repeated batch
        base.update(batch)
        held = log.segments()
        written += [log.bytes_of(*s) for s in held if s[1] == epoch]
        assert held[0] == (-1, -1) and len(held) <= 6  # the base is not written anew
    assert sum(written) < size / 2 and all(first > -1 for first, _ in made) and len(made) == 4
    assert sorted(map(tuple, log.current().collect())) == sorted((k, *v) for k, v in base.items() if v[0] != "removed")
    log.apply(spark.createDataFrame([(1, "removed", 99.0)], schema), 2)  # an epoch that was merged long ago
    assert log.current().where("path = 1").count() == (base[1][0] != "removed")


def test_change_log_renews_its_base_and_survives_half_a_merge(spark):
    schema = "path long, kind string, at double"
    log = ChangeLog.create(spark.createDataFrame([(k, "created", 0.0) for k in range(8)], schema), new_path(spark, "log"), fanout=2, share=0.5)
    for epoch in range(5):
        log.apply(spark.createDataFrame([(epoch, "removed" if epoch % 2 else "modified", 1.0), (100 + epoch, "created", 1.0)], schema), epoch)
    assert log.segments()[0][1] > -1  # written anew, as the log had half its rows
    want = sorted([(0, "modified"), (2, "modified"), (4, "modified"), (5, "created"), (6, "created"), (7, "created"), *[(100 + k, "created") for k in range(5)]])
    assert sorted((r["path"], r["kind"]) for r in log.current().collect()) == want
    jvm, _, files = log._files()
    spark.createDataFrame([(5, "removed", 9.0)], schema).write.parquet(log._path(-1, 50))
    files.delete(jvm.org.apache.hadoop.fs.Path(f"{log._path(-1, 50)}/_SUCCESS"), False)  # never committed
    assert sorted((r["path"], r["kind"]) for r in log.current().collect()) == want
    again = ChangeLog(spark, log.folder, log.schema)
    assert sorted((r["path"], r["kind"]) for r in again.current().collect()) == want


def test_arrivals_are_packed_once(spark, tmp_path, monkeypatch):
    """Each micro-batch packs itself; the pool's blocks are written at the first start only, and a restart goes on from the checkpoint."""
    packed = []
    plain = joins.pack_signatures
    monkeypatch.setattr(joins, "pack_signatures", lambda sig, order: (packed.append(order), plain(sig, order))[1])
    pool = spark.createDataFrame([(1, [7, 7])], "id long, words array<long>")
    found = {}

    def run():
        stream = io.file_change_stream(spark, f"file://{tmp_path}/in", "id long, words array<long>")
        changes.match_arrivals(stream, pool, lambda b, e: found.update({r["id"]: r["hit"] for r in b.collect()}), f"file://{tmp_path}/state", f"file://{tmp_path}/met", 1).start().awaitTermination()

    add = lambda *rows: spark.createDataFrame(list(rows), "id long, words array<long>").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    add((10, [0, 0]), (11, [7, 6]))
    run()
    add((12, [0, 1]))
    add((13, [0, 1]))
    run()
    assert found == {11: 1, 12: 10, 13: 10}
    assert packed.count(-1.0) == 1 and [o for o in packed if o > 0] == [1.0, 2.0]


def test_late_pages_equal_a_full_sort(spark, sf):
    media = V.media(spark, sf)
    for sort, down in (("newest", True), ("name", False), ("folder", True)):
        whole = [r["id"] for r in media.orderBy(*ranking.gallery_order(sort, down)).select("id").collect()]
        for page, per_page in ((1, 7), (12, 16), (13, 16), (50, 60), (2, 150)):
            got = [r["id"] for r in ranking.gallery_page(media, sort, down, page, per_page, early=0).collect()]
            assert got == whole[(page - 1) * per_page : page * per_page]
    assert ranking.gallery_page(media.where("false"), page=400).count() == 0


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name in ("a b/x.JPG", "y.png", "z.txt", "noext"):
        (tmp_path / name).write_bytes(b"12345")
    files = io.scan_listing(spark, [f"file://{tmp_path}"])
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in files.collect()) == [("x.JPG", 5), ("y.png", 5)]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("ReadSchema") :].splitlines()[0]


# Free names.
@pytest.mark.parametrize("seed", [1, 2])
def test_free_names_by_trying(spark, seed):
    """Names in use in any order, claims that look like numbered names themselves, odd numbers, and many claims of one name."""
    rng = random.Random(seed)
    stems = ["a", "a (2)", "b.c", ".h", "Ü"]
    have = [("d", f"{rng.choice(stems)}{rng.choice(['', f' ({rng.randint(0, 9)})', ' (007)', ' (99999999999999999999)', ' (3) (2)'])}{rng.choice(['.jpg', ''])}") for _ in range(60)]
    want = [(k, rng.choice(["d", "e"]), f"{rng.choice(stems)}{rng.choice(['.jpg', '', ' (4).jpg'])}") for k in range(60)] + [(100 + k, "d", "a.jpg") for k in range(40)]
    got = {r["id"]: r["free_name"] for r in ranking.free_names(spark.createDataFrame(want, "id long, folder string, filename string"), spark.createDataFrame(have, "folder string, filename string")).collect()}
    by_name: dict = {}
    for k, folder, name in want:
        by_name.setdefault((folder, name), []).append(k)
    for (folder, name), ids in by_name.items():
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        free = (c for c in itertools.chain([name], (f"{stem} ({n}){ext}" for n in itertools.count(2))) if (folder, c) not in have)
        assert [got[k] for k in sorted(ids)] == list(itertools.islice(free, len(ids)))


def test_failures_in_a_row_over_batches():
    """Without a loop over rows: as the plain count, whatever the cuts between batches."""

    class State:
        hasTimedOut = False

        def __init__(self):
            self.value, self.wait = None, None

        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, value):
            self.value = value

        def setTimeoutTimestamp(self, ms):
            self.wait = ms

    rng = random.Random(3)
    for _ in range(50):
        oks, state, at = [rng.random() < 0.4 for _ in range(rng.randint(1, 40))], State(), 0
        while at < len(oks):
            end = rng.randint(at + 1, len(oks))
            batch = pd.DataFrame({"at": range(at, end), "seq": 0, "ok": oks[at:end]})
            (row,) = next(changes._retry(3, 5)((7,), iter([batch.iloc[::-1]]), state)).itertuples(index=False)
            at = end
        runs = [len(list(g)) for k, g in itertools.groupby(oks) if not k]
        assert tuple(row) == (7, 0 if oks[-1] else runs[-1], max(runs, default=0) >= 3) and state.wait == 1000 * (len(oks) - 1) + 5


def test_pairs_meet_facts_in_cells(spark, same_rows):
    """J13, J17, J18 on cells: repeated and unknown ids, nulls, lists of other lengths; what moves grows with the facts, not with the pairs."""
    import re

    rng = np.random.default_rng(5)
    tags = [(i, f"t{int(t)}") for i in range(300) for t in set(rng.integers(0, 40, rng.integers(0, 25)))]
    pairs = [(int(a), int(b), int(d)) for a, b, d in rng.integers(0, 310, (4000, 3)) if a < b] + [(1, None, 3), (2, 5, 9), (2, 5, 9)]
    p, t = spark.createDataFrame(pairs, "a long, b long, dist int"), spark.createDataFrame(tags, "image_id long, tag string")
    sets = {}
    for i, x in tags:
        sets.setdefault(i, set()).add(x)
    one = lambda i: sets.get(i, set())
    want = [r for r in pairs if min(len(one(r[0])), len(one(r[1]))) < 3 or 13 * len(one(r[0]) & one(r[1])) >= 3 * (len(one(r[0])) + len(one(r[1])))]
    got = joins.verify_pairs_by_tags(p, t)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) < len(pairs)
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)", got._jdf.queryExecution().executedPlan().toString())
    assert shuffles and not any("tag" in s.replace("tags", "") for s in shuffles)

    small = joins.met_in_cells(p, spark.range(300), F.lit(1 << 20), lambda x, y: x.filter(pc.is_in(x.column("a"), y.column("id"))), p.schema, cell_bytes=1 << 25, cell_pairs=100)
    assert sorted(map(tuple, small.collect()), key=str) == sorted((r for r in pairs if r[0] < 300), key=str)

    media = spark.createDataFrame([(i, 1, 2, None if i % 9 == 0 else i, 0, 0.5) for i in [*range(300), 7]], "id long, width int, height int, file_size long, rating int, file_date double")
    row = F.struct("width", "height", "file_size", "rating", "file_date")
    joined = p
    for x in "ab":
        joined = joined.join(media.select(F.col("id").alias(x), row.alias(f"{x}_row")), x)
    assert sorted(map(str, joins.enrich_pairs(p, media).select(joined.columns).collect())) == sorted(map(str, joined.collect()))

    vectors = [(0, [1.0, 2.0], [0.0]), (1, [1.0, 2.0], [9.0]), (2, [1.0, 2.0], None), (3, [1.0], [0.0]), (4, [1.0, None], [0.0]), (5, None, [0.0]), (6, [], [0.0]), (7, [float("nan"), 1.0], [0.0]), (8, [1.0, 2.0], [0.0]), (8, [5.0, 2.0], [0.0])]
    v = spark.createDataFrame(vectors, "id long, v array<double>, colour array<double>")
    firsts = spark.createDataFrame([(0, k) for k in range(10)], "a long, b long")
    got = sorted((r["b"], str(r["reason"])) for r in joins.agreement_check(firsts, v).collect())
    assert got == [(0, "None"), (1, "colour"), *[(k, "unreadable") for k in (2, 3, 4, 5, 6)], (7, "brightness"), (8, "None"), (8, "brightness")]


def test_block_pairs_deal_work_by_cells(spark):
    """J5 in blocks: one task a cell, whatever its bytes; signatures of odd and even numbers of words."""
    rng = np.random.default_rng(6)
    for words in (1, 2, 3, 4):
        rows = rng.integers(0, 2**32, (3000, words))
        sig = spark.createDataFrame([(i, [int(x) for x in w], 1.0) for i, w in enumerate(rows)], "id long, words array<long>, ar double").repartition(4)
        limit = 16 * words - 8
        got = joins._block_pairs(sig, limit, 0.3)
        d = sum(np.bitwise_count(rows[:, None, k] ^ rows[None, :, k]).astype(int) for k in range(words))
        x, y = np.nonzero(np.triu(d <= limit + 0, 1))
        assert sorted(map(tuple, got.collect())) == sorted(zip(x.tolist(), y.tolist(), d[x, y].tolist(), strict=True))
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_jaccard_candidates_leave_no_shuffle_of_pairs(spark, monkeypatch):
    """J8 against brute force, with several cells, frequent and rare tags, and no exchange between pairs."""
    rng = np.random.default_rng(8)
    base = [rng.choice(400, int(k), replace=False, p=(w := 1 / np.arange(1, 401)) / w.sum()) for k in rng.integers(3, 60, 80)]
    sets = [sorted({f"t{t}" for t in b[rng.random(len(b)) < 0.85]}) for b in base for _ in range(5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sets)], "id long, tags array<string>").repartition(3)
    want = set()
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = set(sets[a]), set(sets[b])
        if min(len(x), len(y)) >= 3 and 200 * len(x & y) >= 99 * len(x | y):
            want.add((a, b))
    for frequent in (0, 1, 50, 50_000):
        monkeypatch.setattr(joins, "FREQUENT", frequent)
        got = {(r["a"], r["b"]) for r in joins.jaccard_pairs(df).collect()}
        assert want ^ got <= {(a, b) for a, b in want ^ got if abs(len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) - 0.495) < 1e-9} and len(want) > 100
    prefixes = joins._prefixes(df.where("size(tags) > 2"), np.zeros(0, np.int64), 0.495)
    pairs = joins._prefix_pairs(prefixes, 0.495, cell_bytes=2000)
    assert want <= {tuple(r) for r in pairs.collect()} and pairs.count() == pairs.distinct().count()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(cell") > 0


def test_jaccard_pairs_move_codes_and_no_candidates(spark, monkeypatch):
    """sets of all sizes by brute force; codes of few and of many tags, hashes that clash, one task a cell, and nothing but the result leaves the cells."""
    rng = np.random.default_rng(4)
    base = [rng.choice(3000, int(k), replace=False) for k in np.append(rng.integers(3, 400, 60), (2500, 1500, 3, 3))]
    sets = [sorted({f"t{t}" for t in b[rng.random(len(b)) < q]}) for b in base for q in (1, 0.9, 0.7, 0.6)]
    want = {}
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = set(sets[a]), set(sets[b])
        if min(len(x), len(y)) >= 3 and (sim := int(np.rint(len(x & y) * 100.0 / len(x | y)))) >= 50:
            want[a, b] = sim
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sets)], "id long, tags array<string>").repartition(3)
    monkeypatch.setattr(joins, "_checked", lambda *_: pytest.fail("candidates"))
    hashed = joins._tag_hash
    clash = lambda tag, salt=0: F.when(tag.isin("t1", "t2", "t3"), F.lit(7).cast("long")).otherwise(hashed(tag)) if salt < 2 else hashed(tag, salt)
    for bits, frequent, h in ((2.5, 50_000, hashed), (0.1, 100, clash)):
        monkeypatch.setattr(joins, "PARITY_BITS", bits)
        monkeypatch.setattr(joins, "FREQUENT", frequent)
        monkeypatch.setattr(joins, "_tag_hash", h)
        assert {(a, b): s for a, b, s in joins.jaccard_pairs(df).collect()} == want
    some = joins.jaccard_pairs(df, among=spark.range(0, len(sets), 2)).collect()
    assert {(a, b): s for a, b, s in some} == {p: s for p, s in want.items() if p[0] % 2 == p[1] % 2 == 0} and len(want) > 200
    coded = joins._coded(df.where("size(tags) > 2"), np.zeros(0, np.int64)).cache()
    cells = joins._coded_pairs(coded, 50, cell_bytes=coded.selectExpr("sum(octet_length(rare))").first()[0] // 3)
    assert {(a, b): s for a, b, s in cells.collect()} == want and joins._even_keys(spark, 1) == [0]
    dealt = spark.createDataFrame([(k,) for k in joins._even_keys(spark, 36)], "k long").repartition(36, "k").select(F.spark_partition_id().alias("p"))
    assert dealt.distinct().count() == 36


def test_near_pairs_are_judged_where_they_are_found(spark, monkeypatch):
    """F8: J13 on signatures as on the pairs of J5, with several cells, repeated ids, images without tags, odd aspects; the pairs are not written."""
    rng = np.random.default_rng(13)
    for words, limit in ((2, 20), (4, 44)):
        heart = rng.integers(0, 2**32, (6, words))
        rows = [(int(i), [int(w) ^ (1 << int(rng.integers(32))) for w in heart[i % 6]], 1 + int(i) % 4 / 10) for i in rng.permutation(240)]
        rows += [(3, heart[0].tolist(), 1.0), (3, heart[1].tolist(), 1.1), (7, None, 1.0), (None, heart[0].tolist(), 1.0), (300, heart[0].tolist(), 0.0), (301, heart[0].tolist(), float("nan")), (302, heart[0].tolist(), None)]
        sig = spark.createDataFrame(rows, "id long, words array<long>, ar double").repartition(4)
        size = {i: int(rng.choice([0, 1, 2, 3, 9, 40, 700])) for i in range(0, 320, 1)}
        tags = [(i, f"t{int(t)}") for i, k in size.items() for t in rng.choice(3 * k + 1, k, replace=False)]
        t = spark.createDataFrame(tags, "image_id long, tag string")
        want = joins.verify_pairs_by_tags(joins.hamming_pairs(sig.where("id is not null"), limit, bits=32 * words), t)
        want = sorted(tuple(r) for r in want.select("a", "b", "dist").collect())
        all_pairs = joins.hamming_pairs(sig.where("id is not null"), limit, bits=32 * words).count()
        with monkeypatch.context() as m:
            m.setattr(joins, "hamming_pairs", lambda *_: pytest.fail("all pairs"))
            for cell_bytes in (96 << 20, 20_000):
                got = joins.near_pairs_by_tags(sig, joins.tag_sets(t), limit, cell_bytes=cell_bytes)
                assert sorted(tuple(r) for r in got.collect()) == want and 50 < len(want) < all_pairs


def test_tag_sets_of_repeated_ids(spark, tmp_path):
    rows = [(1, "aaa bbb"), (1, "bbb ccc"), (1, None), (2, "zzz aaa zzz"), (3, None), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: r["tags"] for r in V.tag_sets(spark, str(tmp_path)).where("size(tags) > 0").collect()}
    assert got == {1: ["aaa", "bbb", "ccc"], 2: ["aaa", "zzz"]}


# Pairs that are very many.
def test_marked_pairs_are_not_shuffled(spark, monkeypatch):
    """Ignored pairs are looked up where they are; with repeated ones each comes once all the same."""
    rows = [(a, b) for a, b in itertools.combinations(range(40), 2) if (a + b) % 3]
    ignored, groups = spark.createDataFrame(rows, "a long, b long"), spark.createDataFrame([(k // 4, k) for k in range(48)], "group_id long, id long")
    fours = {(a, b) for a, b in itertools.combinations(range(48), 2) if a // 4 == b // 4}
    for told in (graph.TOLD, 0):
        monkeypatch.setattr(graph, "TOLD", told)
        for add, want in ((True, set(rows) | fours), (False, set(rows) - fours)):
            for pairs, once in ((ignored, True), (ignored.union(ignored), False)):
                got = graph.mark_pairs(pairs, groups, add, once)
                assert sorted(tuple(r) for r in got.collect()) == sorted(want)
                if told and once:
                    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_copies_are_unfolded_by_many_tasks(spark, monkeypatch):
    """A class of many equal signatures is cut into lists, and their pairs are dealt out by what they unfold to."""
    monkeypatch.setattr(joins, "CHUNK", 16)
    monkeypatch.setattr(joins, "A_TASK", 2000)
    rows = [(k, [7, 7] if k < 150 else [7, 6 + k % 3], 1.0 if k % 9 else None) for k in range(200)]
    got = joins.hamming_pairs(spark.createDataFrame(rows, "id long, words array<long>, ar double"), 3)
    want = {(a, b, ((wa[1] ^ wb[1]).bit_count())) for (a, wa, x), (b, wb, y) in itertools.combinations(rows, 2) if x and y and (wa[1] ^ wb[1]).bit_count() <= 3}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    sizes = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().toPandas()["count"]
    assert len(sizes) > 5 and sizes.max() < len(want) / 3


def test_stars_keep_components_and_are_few(spark):
    from mediarill.plans.components import connected_components, stars

    rng = np.random.default_rng(2)
    edges = [(int(10 * g + x), int(10 * g + y)) for g in range(300) for x, y in rng.integers(0, 10, (40, 2))] + [(9000, 9000), (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    for held in (1 << 21, 50):
        few = stars(df, held=held)
        assert sorted(map(tuple, connected_components(few).collect())) == sorted(map(tuple, connected_components(df).collect()))
    assert stars(df).count() < len(edges) / 3
    long = spark.range(3000).selectExpr("id as a", "id + 1 as b")
    assert stars(long).select("a").distinct().count() == 3001 and connected_components(stars(long)).where("component <> 0").isEmpty()
    assert connected_components(stars(spark.createDataFrame([], "a long, b long"))).count() == 0


def test_word_counts_build_no_index(spark, sf, same_rows):
    """A17 reads the texts once; the search before gave the same words, for an index of all texts."""
    out = QUERIES["a17_word_frequency"](spark, sf)
    assert not any("mediarill-search" in f for f in out.inputFiles())
    media = V.media(spark, sf)
    found = filters.search(media, V.image_tags(spark, sf), "ing")
    same_rows(out, aggregates.word_frequency(found, "ing"))


# Tags of images.
def test_tags_of_images_come_once_and_are_shuffled_twice(spark):
    """J1. An image that stands twice in the catalogue has its tags once; two shuffles of the images' tags."""
    media = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    tags = spark.createDataFrame([("cat", "general"), ("dog", "general")], "name string, category string")
    rows = spark.createDataFrame([(1, "cat", 0.5, "auto"), (1, "dog", 0.9, "auto"), (2, "cat", 0.1, "auto"), (2, "gone", 1.0, "auto"), (3, "cat", 0.7, "auto")], "image_id long, tag string, score double, source string")
    out = joins.media_tags(media, rows, tags)
    assert sorted((r["id"], r["name"], r["place"]) for r in out.collect()) == [(1, "cat", 2), (1, "dog", 1), (2, "cat", 1)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 4


def repeated_documents(spark, path):
    texts = ["the cat The the dog", "cat and mat", "dog", None, "12 a b"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, "cat bird cat"), (10, "the end"), (10, "the"), (None, "cat lost")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return f"file://{path}"


def test_tags_are_counted_where_they_are(spark, tmp_path, same_rows):
    """A4, W12. As the distinct count, ids of several documents too; images' tags are not shuffled."""
    d = repeated_documents(spark, tmp_path)
    once = V.image_tags_once(V.tag_lists(spark, d))
    same_rows(once.where("image_id is not null"), V.image_tags(spark, d).distinct().where("image_id is not null"))
    same_rows(aggregates.tag_counts(once, V.tags(spark, d), once=True), aggregates.tag_counts(V.image_tags(spark, d), V.tags(spark, d)))
    plan = QUERIES["w12_manual_first"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan and "hashpartitioning(tag" in plan


def test_places_of_tags_take_one_shuffle_of_lists(spark, tmp_path, same_rows):
    """W11. Lists of an image are shuffled, not its rows, and not again for the places."""
    d = repeated_documents(spark, tmp_path)
    out = ranking.top_unique_tags(V.image_tags_by_image(spark, d))
    same_rows(out, ranking.top_unique_tags(V.image_tags(spark, d)))
    plan = QUERIES["w11_top_unique_tags"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


# First matches.
def test_one_hit_a_signature_leaves_a_task(spark):
    """As the plain rule, among many near ones of which a task hands on one each."""
    rng = random.Random(9)
    words = [[rng.getrandbits(2), rng.getrandbits(2)] for _ in range(2500)]
    sig = spark.createDataFrame(list(enumerate(words)), "id long, words array<long>").repartition(3)
    arrived, pool = sig.where("id % 3 <> 0"), sig.where("id % 3 = 0")
    bits = [a << 32 | b for a, b in words]
    want = {}
    for i in (k for k in range(2500) if k % 3):
        near = [(j % 3 != 0, j) for j in range(2500) if j != i and (j % 3 == 0 or j < i) and (bits[i] ^ bits[j]).bit_count() <= 1]
        if near:
            want[i] = (min(near)[1], (bits[i] ^ bits[min(near)[1]]).bit_count())
    assert {r["id"]: (r["hit"], r["dist"]) for r in joins.first_match(arrived, pool, 1).collect()} == want
    new = joins.pack_signatures(arrived, 0.0)
    known = new.unionByName(joins.pack_signatures(pool, -1.0))
    every, firsts = joins._met(new, known, 1, False).count(), joins._met(new, known, 1, False, first=True).count()
    assert len(want) <= firsts <= len(want) * known.count() < every / 20


# Deletions.
def test_deletions_expire_over_batches(spark, tmp_path):
    """By the watermark, ten minutes behind the latest; deleted again the time starts anew; late ones don't count; no Python a key."""
    batches = [[(1, 0), (2, 0), (2, 9), (3, 8), (None, 1)], [(1, 19), (4, 25)], [(5, 60), (6, 3)], [(7, 61)]]
    src, got = io_folder(tmp_path, spark, batches), {}
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")

    def sink(df, epoch):
        got[epoch] = sorted((r["id"] or 0, r["at"] // 60) for r in df.select("id", F.unix_seconds("ts").alias("at")).collect())

    changes.expire_after(stream, sink, f"{tmp_path}/state", f"file://{tmp_path}/waiting").start().awaitTermination()
    # Watermarks after the batches: -1, 15, 50, 51; the 6 of minute 3 is later than 15.
    assert got == {0: [], 1: [(0, 1)], 2: [(1, 19), (2, 9), (3, 8), (4, 25)], 3: []}


def io_folder(path, spark, batches):
    import os

    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, m * 60) for i, m in rows], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{path}/in/{k}")
        for f in (path / "in" / str(k)).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return f"file://{path}/in"
