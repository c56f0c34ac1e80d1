"""Rules of the operators on small tables, and properties against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mediarill.operators import aggregates, filters, graph, joins, maintenance, ranking, sets
from mediarill.plans.components import connected_components
from mediarill.sources import io
from mediarill.sources import views as V


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_folders(spark):
    df = table(spark, "folder string", ("a",), ("a/b",), ("a\\b",), ("ab",), ("A/b",))
    assert {r[0] for r in filters.filter_folders(df, ["a"]).collect()} == {"a", "a/b", "a\\b"}
    assert [r[0] for r in filters.filter_folders(df, ["a"], False).collect()] == ["a"]
    assert filters.not_under_any_root(df.withColumnRenamed("folder", "filepath"), table(spark, "path string")).count() == 0


def test_components_and_cliques(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(table(spark, "a long, b long", *edges)).collect()}
    want: dict = {}
    for a, b in edges:
        if a is not None:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            if a is not None:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert connected_components(table(spark, "a long, b long")).count() == 0

    pairs = table(spark, "a long, b long, dist int", (1, 2, 1), (1, 3, 2), (2, 3, 2), (3, 4, 1), (5, 6, 4))
    groups = graph.clique_groups(pairs)
    members = {}
    for r in groups.collect():
        members.setdefault(r["group_id"], set()).add(r["id"])
    assert members == {1: {1, 2, 3}, 5: {5, 6}}
    near = {(a, b) for a, b, _ in [(1, 2, 1), (1, 3, 2), (2, 3, 2), (3, 4, 1), (5, 6, 4)]}
    assert all(p in near for g in members.values() for p in itertools.combinations(sorted(g), 2))
    left = graph.prune_groups(groups, table(spark, "id long", (5,)))
    assert 6 not in {r["id"] for r in left.collect()}


def test_jaccard_limits(spark):
    tags = [(1, t) for t in "abcdefghij"] + [(2, t) for t in "abcdefghij"[:5]] + [(3, t) for t in "xyz"] + [(4, "x")]
    it = table(spark, "image_id long, tag string", *tags)
    assert [tuple(r) for r in joins.jaccard_pairs(joins.tag_sets(it)).collect()] == [(1, 2, 50)]
    pairs = table(spark, "a long, b long", (1, 2), (1, 3), (3, 4))
    assert {(r["a"], r["b"]) for r in joins.verify_pairs_by_tags(pairs, it).collect()} == {(1, 2), (3, 4)}


def test_minhash_loses_no_pair_at_the_limit(spark):
    """300 pairs of similarity 0.5: 10 tags of 20 shared."""
    random.seed(9)
    sets = []
    for k in range(300):
        own = [f"t{random.randrange(10**9)}" for _ in range(20)]
        sets += [(2 * k, own[:15]), (2 * k + 1, own[5:])]
    sets = table(spark, "id long, tags array<string>", *sets)
    got = {tuple(r) for r in joins.jaccard_pairs_minhash(sets).collect()}
    assert got == {(2 * k, 2 * k + 1, 50) for k in range(300)} == {tuple(r) for r in joins.jaccard_pairs(sets).collect()}


def test_minhash_equals_exact_pairs(spark, sf):
    sets = joins.tag_sets(V.image_tags(spark, sf), 3)
    got = {tuple(r) for r in joins.jaccard_pairs_minhash(sets).collect()}
    assert got == {tuple(r) for r in joins.jaccard_pairs(sets).collect()} and got


def test_diff_twice_is_nothing(spark, sf):
    m, listing = V.media(spark, sf), V.listing(spark, sf)
    diff = sets.catalog_diff(m, listing)
    after = maintenance.apply_diff(m, diff, table(spark, "path string"))
    dated = after.join(listing.select(F.col("path").alias("filepath"), "mtime"), "filepath", "left").withColumn("file_date", F.coalesce("mtime", "file_date"))
    assert {r["action"] for r in sets.catalog_diff(dated, listing).select("action").distinct().collect()} == {"unchanged"}


def test_brake(spark):
    m = table(spark, "filepath string, file_date double, meta_done boolean", *[(f"p{k}", 1.0, True) for k in range(20)])
    none = table(spark, "path string, mtime double")
    diff = sets.catalog_diff(m, none)
    assert maintenance.apply_diff(m, diff, table(spark, "path string"), 0.2, 5).count() == 20
    assert maintenance.apply_diff(m, diff, table(spark, "path string"), 0.2, 50).count() == 0


def test_delete_and_restore(spark, sf):
    m, t = V.media(spark, sf), V.image_tags(spark, sf)
    gone = m.where("rating = 5")
    left, trash = maintenance.soft_delete(m, t, gone, 1.0)
    rows, tags = maintenance.restore(trash, left, gone)
    assert left.count() + rows.count() == m.count()
    assert rows.select("filename").exceptAll(gone.select("filename")).count() == 0
    assert tags.count() == t.where("length(tag) >= 8").join(gone.select(F.col("id").alias("image_id")), "image_id").count()


def test_manual_tags_survive(spark):
    it = table(spark, "image_id long, tag string, score double, source string", (1, "a", 1.0, "manual"), (1, "b", 0.5, "auto"), (2, "c", 0.5, "auto"))
    out = maintenance.apply_predictions(it, table(spark, "image_id long, tag string, score double", (1, "a", 0.1), (1, "d", 0.9)))
    assert {tuple(r) for r in out.collect()} == {(1, "a", 1.0, "manual"), (1, "d", 0.9, "auto"), (2, "c", 0.5, "auto")}


def test_free_names(spark):
    have = table(spark, "folder string, filename string", ("f", "a.jpg"), ("f", "a (2).jpg"), ("f", "b"))
    want = table(spark, "id long, folder string, filename string", (1, "f", "a.jpg"), (2, "f", "a.jpg"), (3, "f", "b"), (4, "g", "a.jpg"))
    assert {r["id"]: r["free_name"] for r in ranking.free_names(want, have).collect()} == {1: "a (3).jpg", 2: "a (4).jpg", 3: "b (2)", 4: "a.jpg"}


def test_failures_and_levels(spark):
    rows = [(1, t, t, ok) for t, ok in enumerate([False, False, True, False, False, False])] + [(2, 0, 0, False), (2, 1, 1, None), (2, 2, 2, False)]
    got = ranking.consecutive_failures(table(spark, "key long, at long, seq long, ok boolean", *rows)).collect()
    assert [tuple(r) for r in got] == [(1, 3)]
    levels = table(spark, "image_id long, level string, score double", (1, "questionable", 0.9), (1, "sensitive", 0.3), (1, "explicit", 0.2))
    assert tuple(aggregates.rating_level(levels).first()) == (1, "sensitive", 0.9)


def test_next_numbers(spark):
    m = table(spark, "filename string, media_type string", ("A + B (3).jpg", "image"), ("b+a.jpg", "image"), ("x.jpg", "image"))
    assert {r["base"]: r["next_number"] for r in aggregates.next_numbers(m).collect()} == {"a+b": 4, "x": 2}


def test_moves(spark, sf):
    m = V.media(spark, sf)
    with pytest.raises(ValueError):
        maintenance.move_prefix(m, "en", "en/x")
    assert maintenance.move_prefix(m, "en", "gb").where("folder like 'en/%'").count() == 0


def test_listing_and_snapshot(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for n in ("a.JPG", "x/b.png", "x/c.txt"):
        (tmp_path / n).write_text("1")
    got = io.scan_listing(spark, [str(tmp_path)])
    assert sorted(r["ext"] for r in got.collect()) == ["jpg", "png"]
    df = table(spark, "id long, blob string", (1, "x"))
    for v in range(5):
        kept = io.snapshot({"media": df}, f"file://{tmp_path}/snap", v, ["blob"], 3)
    assert kept == [2, 3, 4] and spark.read.parquet(f"file://{tmp_path}/snap/v=4/media").columns == ["id"]


def test_cleaning(spark):
    schema = "group_id string, id long, width int, height int, blk double, fmt string, file_size long, rating int, file_date double, media_type string"
    rows = [("g", 1, 100, 100, 1.0, "jpg", 50, 0, 1.0, "image"), ("g", 2, 100, 100, 1.01, "jpg", 40, 0, 1.0, "image"), ("g", 3, 200, 100, 1.5, "jpg", 60, 0, 1.0, "image"), ("g", 4, 50, 50, None, "webp", 9, 0, 1.0, "image"), ("g", 5, 9, 9, None, "gif", 9, 0, 1.0, "gif")]
    v = table(spark, "id long, v array<double>", *[(k, [1.0, 2.0, 3.0]) for k in range(1, 6)])
    plan = {r["id"]: (r["action"], r["keeper"]) for r in maintenance.clean_plan(table(spark, schema, *rows), v, {"max_shift": 0.1, "max_median": 0.1, "max_block": 0.1}).collect()}
    assert plan == {1: ("keep", None), 2: ("remove", 1), 3: ("keep", None), 4: ("keep", None), 5: ("skip", None)}


def greedy(pairs):
    """The clique rule in plain steps: (a, b, value), smaller first."""
    near = {frozenset(p[:2]): p[2] for p in pairs}
    used, out = set(), []
    for _, a, b in sorted((v, *sorted(p)) for p, v in near.items()):
        if used & {a, b}:
            continue
        group = [a, b]
        others = {c for p in near for c in p} - used - {a, b}
        ranked = sorted((max(near[frozenset((a, c))], near[frozenset((b, c))]), c) for c in others if frozenset((a, c)) in near and frozenset((b, c)) in near)
        for _, c in ranked:
            if all(frozenset((c, m)) in near for m in group):
                group.append(c)
        used.update(group)
        out.append(sorted(group))
    return sorted(out)


@pytest.mark.parametrize("most_pairs", [0, 20, 100_000])
def test_cliques_by_brute_force(spark, most_pairs):
    """Rounds of joins, rounds down to small components, and whole components in a task: all as the plain rule."""
    random.seed(most_pairs)
    spots = {k: (random.random(), random.random()) for k in range(60)}
    pairs = [(a, b, int(100 * ((xa - xb) ** 2 + (ya - yb) ** 2) ** 0.5)) for (a, (xa, ya)), (b, (xb, yb)) in itertools.combinations(spots.items(), 2) if (xa - xb) ** 2 + (ya - yb) ** 2 < 0.02]
    groups = graph.clique_groups(table(spark, "a long, b long, dist int", *pairs), bits=200, most_pairs=most_pairs).collect()
    got = {}
    for r in groups:
        got.setdefault(r["group_id"], []).append(r["id"])
    assert sorted(sorted(g) for g in got.values()) == greedy(pairs)
    near = {frozenset(p[:2]): p[2] for p in pairs}
    for r in groups:
        worst = max(near[frozenset(p)] for p in itertools.combinations(got[r["group_id"]], 2))
        assert r["size"] == len(got[r["group_id"]]) and r["similarity"] == (100 if worst <= 0 else min(99, int((1 - worst / 200) * 100)))
    by_sim = graph.clique_groups(table(spark, "a long, b long, sim int", *[(a, b, 100 - v) for a, b, v in pairs]), "sim", most_pairs=most_pairs).collect()
    assert {(r["group_id"], r["id"]) for r in by_sim} == {(r["group_id"], r["id"]) for r in groups}
    assert graph.clique_groups(table(spark, "a long, b long, dist int")).count() == 0


def beats(o, c):
    """Whether row ``o`` may stand in for ``c``, both as in test_skyline_by_brute_force."""
    tie = lambda r: (0 if r["fmt"] in ranking.LOSSLESS else 1, -r["file_size"], -(r["rating"] or 0), r["file_date"] or 0.0, r["id"])
    px, opx = c["width"] * c["height"], o["width"] * o["height"]
    if o["id"] == c["id"] or o["group_id"] != c["group_id"] or opx < px:
        return False
    if o["fmt"] in ranking.GRID_FORMATS and c["fmt"] in ranking.GRID_FORMATS and o["blk"] is not None and c["blk"] is not None:
        tol = ranking.GRID_TIE if px == opx else ranking.GRID_SLACK
        return o["blk"] <= c["blk"] + tol and (opx > px or o["blk"] < c["blk"] - tol or tie(o) < tie(c))
    return o["fmt"] == c["fmt"] and o["file_size"] >= c["file_size"] and (opx > px or o["file_size"] > c["file_size"] or tie(o) < tie(c))


@pytest.mark.parametrize("seed", range(3))
def test_skyline_by_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [
        {"group_id": f"g{r.randrange(4)}", "id": k, "width": r.choice([10, 20, 30]), "height": r.choice([10, 20]), "blk": r.choice([None, *[1 + x / 50 for x in range(12)]]), "fmt": r.choice(["jpg", "png", "gif", "webp", "bmp"]), "file_size": r.randrange(5), "rating": r.choice([None, 1, 2]), "file_date": r.choice([None, 1.0, 2.0])}
        for k in range(120)
    ]
    df = spark.createDataFrame(rows, "group_id string, id long, width int, height int, blk double, fmt string, file_size long, rating int, file_date double")
    tops = {c["id"] for c in rows if not any(beats(o, c) for o in rows)}
    got = {x["id"]: x for x in ranking.skyline(df).collect()}
    assert len(got) == 120 and {i for i, x in got.items() if x["top"]} == tops
    for c in rows:
        able = {o["id"] for o in rows if o["id"] in tops and beats(o, c)}
        assert (got[c["id"]]["keeper"] in able) if able else got[c["id"]]["keeper"] is None


def test_numbering_in_ranges(spark):
    rows = [(k, random.Random(k).choice("abc"), f"n{k * 7919 % 1000:04}") for k in range(500)]
    df = table(spark, "id long, kind string, name string", *rows).repartition(7)
    assert [r["name"] for r in ranking.numbered(df, ["name"]).orderBy("n").collect()] == sorted(r[2] for r in rows)
    by_kind = ranking.numbered(df, ["name"], ["kind"]).collect()
    for kind in "abc":
        own = sorted((r["n"], r["name"]) for r in by_kind if r["kind"] == kind)
        assert own == list(enumerate(sorted(r[2] for r in rows if r[1] == kind), 1))
    assert ranking.numbered(df.where("false"), ["name"]).count() == 0


def test_jaccard_pairs_by_brute_force(spark):
    r = random.Random(5)
    base = [r.sample(range(60), r.randrange(3, 25)) for _ in range(30)]
    sets = {k: set(b) ^ set(r.sample(range(60), r.randrange(0, 6))) for k, b in enumerate(base * 3)}
    sets = {k: s for k, s in sets.items() if len(s) >= 3}
    df = spark.createDataFrame([(k, sorted(f"t{x}" for x in s)) for k, s in sets.items()], "id long, tags array<string>")
    for least in (20, 50, 51, 90, 100):
        want = {(a, b, round(100 * len(x & y) / len(x | y))) for (a, x), (b, y) in itertools.combinations(sets.items(), 2)}
        want = {w for w in want if w[2] >= least}
        assert {tuple(p) for p in joins.jaccard_pairs(df, least).collect()} == want
        if least >= 50:
            assert {tuple(p) for p in joins.jaccard_pairs_minhash(df, least).collect()} == want


def test_agreement_rules(spark):
    """Each rule in its order; one area against the pair's own noise; colour by itself."""
    flat, noisy = [10.0] * 200, [10.0 + (k % 2) * 0.8 for k in range(200)]
    changed = lambda v, k, by: [x + by * (i == k) for i, x in enumerate(v)]
    grey = [5.0] * 20
    rows = [
        (0, flat, grey), (1, [x + 0.7 for x in flat], grey), (2, [x + (1.5 if k % 2 else -1.5) for k, x in enumerate(flat)], grey), (3, flat, changed(grey, 3, 3.5)), (4, changed(flat, 7, 1.6), grey), (5, changed(flat, 7, 1.4), grey), (6, changed(flat, 7, 7.0), grey),
        (7, noisy, grey), (8, changed(noisy, 8, 1.6), grey), (9, flat[:-1], grey), (10, [None, *flat[1:]], grey),
    ]
    vectors = table(spark, "id long, v array<double>, colour array<double>", *rows)
    pairs = table(spark, "a long, b long", *[(0, k) for k in range(1, 11)], (0, 0))
    got = {r["b"]: r["reason"] for r in joins.agreement_check(pairs, vectors, max_median=1.0).collect()}
    assert got == {0: None, 1: "brightness", 2: "overall", 3: "colour", 4: "detail", 5: None, 6: "detail", 7: None, 8: None, 9: "unreadable", 10: "unreadable"}
    plain = {r["b"]: r["same"] for r in joins.agreement_check(pairs, vectors.drop("colour")).collect()}
    assert plain[3] and not plain[4]


def test_tag_rules(spark):
    tags = table(spark, "name string, category string", ("Blue_Eyes", "general"), ("saber", "character"), ("saber", "general"), ("SABER", "character"))
    media = table(spark, "id long", (1,), (2,))
    own = table(spark, "image_id long, tag string, score double, source string", (1, "saber", 0.4, "auto"), (1, "SABER", 0.4, "auto"), (2, "sky", 0.9, "embedded"), (2, "sea", 0.9, "manual"))
    ids = table(spark, "id long", (1,), (3,))
    add = lambda *a: tuple({tuple(r) for r in x.collect()} for x in maintenance.add_tags(own, tags, media, ids, *a))
    rows, left = add("blue  EYES")
    assert (1, "Blue_Eyes", 1.0, "manual") in rows and len(left) == 4
    rows, left = add(" Saber_")
    assert (1, "SABER", 1.0, "manual") in rows and (1, "saber", 0.4, "auto") in rows and len(left) == 4
    rows, left = add("saber", "general")
    assert (1, "saber", 1.0, "manual") in rows
    rows, left = add("New Tag")
    assert (1, "new_tag", 1.0, "manual") in rows and ("new_tag", "general") in left
    with pytest.raises(ValueError):
        add(" _ ")
    scored = maintenance.apply_predictions(own, table(spark, "image_id long, tag string, score double", (2, "sky", 0.1), (2, "sea", 0.1), (2, "new", 0.3), (1, "x", 0.2)))
    assert {tuple(r) for r in scored.collect()} == {(2, "sky", 0.1, "embedded"), (2, "sea", 0.9, "manual"), (2, "new", 0.3, "auto"), (1, "x", 0.2, "auto")}


def test_moves_take_free_names(spark):
    media = table(spark, "id long, folder string, filename string, filepath string", (1, "a", "x.jpg", "a/x.jpg"), (2, "b", "x.jpg", "b/x.jpg"), (3, "c", "x.jpg", "c/x.jpg"), (4, "to", "x.jpg", "to/x.jpg"), (5, "to", "x (3).jpg", "to/x (3).jpg"))
    got = {r["id"]: r["filepath"] for r in maintenance.relocate(media, table(spark, "id long", (1,), (2,), (4,)), "to").collect()}
    assert got == {1: "to/x (2).jpg", 2: "to/x (4).jpg", 3: "c/x.jpg", 4: "to/x.jpg", 5: "to/x (3).jpg"}
    tags = table(spark, "image_id long, tag string, score double, source string", (1, "t", 1.0, "auto"))
    rows, more = maintenance.copy_rows(media, tags, table(spark, "id long", (1,), (4,)), "to")
    assert {(r["id"], r["filepath"]) for r in rows.collect()} == {(7, "to/x (2).jpg"), (10, "to/x (4).jpg")} and [r["image_id"] for r in more.collect()] == [7]


def test_arrivals_meet_earlier_arrivals(spark, tmp_path):
    """Copies in two batches, a repeated batch, and a copy in the pool that comes before both."""
    from mediarill.streaming import changes

    zero, one = [0, 0], [1, 0]
    files = [[(10, zero), (11, [2**31, 2**31])], [(12, zero), (13, one)], [(14, [2**31, 2**31 + 1]), (9, zero)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "id long, words array<long>").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    pool = spark.createDataFrame([(1, [2**30 + 2**29 + 7, 1])], "id long, words array<long>")
    stream = io.file_change_stream(spark, f"file://{tmp_path}/in", "id long, words array<long>")
    found = {}

    def sink(df, epoch):
        for r in df.collect():
            found[r["id"]] = (r["hit"], r["dist"])

    changes.match_arrivals(stream, pool, sink, f"file://{tmp_path}/state", f"file://{tmp_path}/met", 1).start().awaitTermination()
    assert found == {12: (10, 0), 13: (10, 1), 14: (11, 1), 9: (10, 0)}


def test_uncut_texts(spark):
    from mediarill.functions import scalars as S

    df = table(spark, "t string", ("p" * 3000 + "\nNegative prompt: " + "n" * 1500 + "\nSteps: 5, Model: " + "m" * 400,))
    cut, whole = df.select(S.parse_infotext(F.col("t")).alias("c"), S.parse_infotext(F.col("t"), None, None, None).alias("w")).first()
    assert [len(cut[k]) for k in ("prompt", "negative_prompt", "model")] == [2000, 1000, 300] and [len(whole[k]) for k in ("prompt", "negative_prompt", "model")] == [3000, 1500, 400]
    words = table(spark, "k string", ("a," + "b" * 150,)).select(F.size(S.split_keywords(F.col("k"))).alias("c"), F.size(S.split_keywords(F.col("k"), None)).alias("w")).first()
    assert tuple(words) == (1, 2)


def test_scratch_scopes(spark):
    """Tables go at the end of the scope that made them, kept ones at the end of the one around."""
    from pathlib import Path

    from mediarill.plans.shared import materialize, scratch

    def there(df):
        return Path(df.inputFiles()[0].removeprefix("file://")).exists()

    df = table(spark, "a long", (1,), (2,))
    free = materialize(df, "free")
    with scratch():
        with scratch():
            gone, kept = materialize(df, "gone"), materialize(df, "kept", kept=True)
            assert there(gone) and there(kept)
            files = gone.inputFiles()
        assert not Path(files[0].removeprefix("file://")).exists() and kept.count() == 2
        files = kept.inputFiles()
    assert not Path(files[0].removeprefix("file://")).exists() and free.count() == 2
    with pytest.raises(ZeroDivisionError), scratch():
        files = materialize(df, "failed").inputFiles()
        1 / 0
    assert not Path(files[0].removeprefix("file://")).exists()
