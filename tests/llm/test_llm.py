"""The training-data operators: SQL twins, brute force, the libraries themselves, held-out accuracy, odd inputs."""

import hashlib
import html
import io
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediarill.llm import decontaminate, labelled, lines, main_text, near_dups, pieces, quality, registry, token_files, top_k, toxicity, url_filter

ODD_TEXTS = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a"), (5, "ß É 日本語   x y"), (6, "word " * 30_000), (7, "x" * 100_000), (8, "same words in this line here\n" * 3), (8, "same words in this line here\n" * 3), (9, "SAME words in this line here \nother"), (10, "same words in this line here"), (None, "no id at all in this one here")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, 2.0, "y", 3) for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_lines int, score double, decoded string, key int")


def digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, sf, same_rows, run_sql):
    same_rows(registry.QUERIES[name](spark, sf), run_sql(registry.ORACLES[name], sf))


# Line dedup.
def test_lines_odd(odd):
    got = {(r["doc_id"], r["n_lines"]): r for r in lines.dedup_lines(odd).collect()}
    assert got[(1, 1)]["text"] == "" and got[(2, 1)]["text"] == ""
    assert got[(8, 4)]["text"] == "" and got[(8, 4)]["n_dropped"] == 3
    assert got[(9, 2)]["text"] == "other" and got[(10, 1)]["n_dropped"] == 0
    assert got[(None, 1)]["n_dropped"] == 0
    assert lines.dedup_lines(odd.where("false")).count() == 0


def test_line_runs_levels(spark):
    store = lines.LineRuns(spark, fanout=2, buckets=3)
    for b in range(5):
        store.absorb(spark.createDataFrame([(100 - b, k, k) for k in range(b, b + 4)], "doc_id long, h1 long, h2 long"))
    assert len(store.levels[0]) <= 1 and len(store.levels) >= 3
    total = {r["h1"]: (r["keeper"], r["n_docs"]) for r in store.totals().collect()}
    assert total == {k: (100 - max(0, k - 3), min(k, 4) - max(0, k - 3) + 1) for k in range(8)}
    assert [r["h1"] for r in store.unseen(spark.createDataFrame([(3, 3), (99, 99)], "h1 long, h2 long")).collect()] == [99]
    lines_in_runs = [r["h1"] for n in store._names() for r in spark.table(n).collect()]
    assert sorted(lines_in_runs) == list(range(8))  # a line stands in one run only
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_lines_long_ids_and_many_losses(spark, run_sql):
    """Ids over the whole range of long, equal ids, clashing names; the way of documents that lose many lines gives the same."""
    line = lambda k: f"this is the common line number {k} of the text"
    rows = [(-(2**63), "\n".join(map(line, range(12)))), (2**63 - 1, "\n".join(map(line, range(8)))), (5, "\n".join([*map(line, range(10)), "own", line(1)])), (5, line(2).upper() + "\nmy own line that stays in this text"), (0, None), (7, "\n".join(map(line, range(9, 12))))]
    df = spark.createDataFrame([(i, t, "k", 1, ["x"], 3) for i, t in rows], "doc_id long, text string, key string, row int, drop array<string>, line int")
    con = __import__("duckdb").connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": [t for _, t in rows]}).drop_duplicates("doc_id"))
    want = {r[0]: r[1:] for r in con.sql("WITH" + lines._LINES_SQL.format(docs="documents") + " SELECT doc_id, text, n_lines, n_dropped FROM cut").fetchall()}
    plain = lines.dedup_lines(df).collect()
    for r in plain:
        assert (r["key"], r["row"], r["drop"], r["line"]) == ("k", 1, ["x"], 3)
        if not (r["text"] or "").endswith("stays in this text"):
            assert (r["text"], r["n_lines"], r["n_dropped"]) == want[r["doc_id"]]
    assert next(r for r in plain if r["text"].endswith("stays in this text"))["n_dropped"] == 1
    assert sorted(map(str, lines.dedup_lines(df, many=1).collect())) == sorted(map(str, plain))


# Main text.
def test_main_text_of_given_pages(spark, sf):
    got = {r["page_id"]: r for r in main_text.op2_main_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_blocks():
    page = "<p>a&amp;b <b>c<br>d</p><script>x='<p>no</p>'</script><!-- no <p> --><div class='menu'><a href=x>l</a></div>tail<p>one<p>two<"
    assert [(b.text, b.names[-1] if b.names else "") for b in main_text.blocks_of(page)] == [("a&b c d", "p"), ("l", "menu"), ("tail", ""), ("one", "p"), ("two<", "p")]
    assert main_text.blocks_of("") == [] and main_text.blocks_of("<" * 2000)


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    net = main_text.BiLstm(hidden=3)
    x = rng.normal(size=(5, 2, main_text.WIDTH)).astype(np.float32)
    on = np.array([[1, 1], [1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y, known = rng.integers(0, 2, on.shape).astype(np.float32), on.astype(np.float32)

    def loss():
        q = net.forward(x, on)[0].astype(np.float64)
        return -((y * np.log(q) + (1 - y) * np.log(1 - q)) * known).sum() / known.sum()

    g = net.gradients(x, on, y, known)
    for key, at in (("Uf", (1, 2)), ("Wb", (7, 4)), ("cf", (5,)), ("V", (2,)), ("Ub", (0, 7)), ("o", (0,))):
        net.p[key][at] += 0.02
        up = loss()
        net.p[key][at] -= 0.04
        down = loss()
        net.p[key][at] += 0.02
        assert g[key][at] == pytest.approx((up - down) / 0.04, rel=0.05, abs=2e-4)


def test_main_text_odd(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "plain words only", "t"), (None, "u", "<p>" * 3000 + "x", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    model = main_text.train_labeller(["<html><body><nav>m</nav><article><p>word here.</p></article></body></html>"])
    got = main_text.extract_main_text(df, model)
    assert got.columns == ["page_id", "url", "html", "text"] and {r["page_id"]: r["text"] for r in got.collect()}[1] == ""
    assert main_text.extract_main_text(df.where("false"), model).count() == 0


# SentencePiece.
def test_pieces_equal_library(spark, sf, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r["doc_id"]: r for r in pieces.op3_sentencepiece(spark, sf).collect()}
    for r in docs.collect():
        ids = sp.encode(r["text"])
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids)))


def test_pieces_odd(odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    out = pieces.encode_pieces(odd, pieces.default_model())
    assert out.columns == ["doc_id", "text", "n_lines", "score", "decoded", "key", "ids"]
    back = pieces.decode_pieces(out, pieces.default_model())
    for r in back.collect():
        want = sp.encode(r["text"] or "")
        assert r["ids"] == want and r["decoded"] == sp.decode(want)


def test_pieces_fuzz():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = np.random.default_rng(3)
    letters = list("aabbcc  \n\t▁é日本語ü😀\x00\xa0ﬁ'12-=_#the andofing")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)] + ["a" * 3000, " " * 500, "<s>", "</s> <unk>"]
    texts += ["".join(rng.choice(list(few), rng.integers(100, 400))) for few in ("e", "ab", "ethr", "=-", "ins ", "012") for _ in range(60)] + ["e" * 200_000, "ab" * 50_000, "-=" * 50_000]
    encoder = pieces.Encoder(pieces.PieceModel(pieces.default_model()), memory=500)
    for t, a, b in zip(texts, encoder.encode(texts), sp.encode(texts), strict=True):
        assert a.tolist() == b and encoder.model.decode(a) == sp.decode(b)


# Toxicity.
def test_chain_against_brute_force():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 1, 2, 63, 64, 65, 130])
    odds, moves = rng.normal(0, 2, lengths.sum()), rng.normal(0, 1, (2, 2))
    p, _, log_z = toxicity.chain_marginals(odds, lengths, moves)
    at, want, total = 0, [], 0.0
    for n in lengths:
        o, at = odds[at : at + n], at + n
        if not n:
            total += np.log(2)
            continue
        e = np.stack([np.zeros(n), o], 1)
        a, b = e.copy(), np.zeros((n, 2))
        for t in range(1, n):
            a[t] = e[t] + np.logaddexp(a[t - 1, 0] + moves[0], a[t - 1, 1] + moves[1])
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp(moves[:, 0] + e[t + 1, 0] + b[t + 1, 0], moves[:, 1] + e[t + 1, 1] + b[t + 1, 1])
        z = np.logaddexp(*a[-1])
        total += z
        want.append(np.exp(a[:, 1] + b[:, 1] - z))
    assert np.allclose(p, np.concatenate(want)) and log_z == pytest.approx(total)


LARGER = "/root/testdata/sf0.1"


def held_out_rate(spark, query, label):
    got = query(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all()
    return (got["predicted"] == got[label]).mean()


def test_toxicity_held_out(spark):
    assert held_out_rate(spark, toxicity.op4_toxicity, "toxic") >= 0.97


def test_quality_held_out(spark):
    assert held_out_rate(spark, quality.op10_quality, "quality") >= 0.99


def test_models_odd(odd, spark):
    words = [f"w{k} v{k} u{k} t{k}" for k in range(80)]  # copies would be left out of the training
    tagger = toxicity.train_tagger([f"{w} stupid thing" if k % 2 else f"{w} kind word" for k, w in enumerate(words)], np.array([0, 1] * 40), 0.5)
    out = toxicity.tag_documents(odd, tagger)
    assert out.count() == len(ODD_TEXTS) and out.where("score is null or score < 0 or score > 1").count() == 0
    toxic = toxicity.tag_documents(spark.createDataFrame([(1, "oh you stupid thing")], "doc_id long, text string"), tagger).first()
    assert [(s["start"], s["end"]) for s in toxic["spans"]] and "stupid" in "oh you stupid thing"[toxic["spans"][0]["start"] : toxic["spans"][0]["end"]]
    ranker = quality.train_ranker(["good words here"] * 5 + ["### ### !!"] * 5, np.array([1] * 5 + [0] * 5))
    assert quality.rank_documents(odd, ranker).where("score between 0 and 1").count() == len(ODD_TEXTS)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.tag_documents(odd, toxicity.fit_toxicity(odd, empty)).where("score >= 0.5").count() == 0
    assert quality.rank_documents(odd, quality.fit_quality(odd, empty)).count() == len(ODD_TEXTS)


def test_held_out_split(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("h", labelled.held_out(F.col("doc_id")))
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in df.collect())


# Token files.
def test_token_files_round_trip(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in token_files.op5_token_files(spark, sf).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_odd(odd, spark):
    import public_tokenizers
    from mediarill.plans.shared import new_path
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    back = token_files.read_token_files(token_files.write_token_files(odd, new_path(spark, "t"), path, shards=3)).collect()
    want = sorted([(i is not None, i or 0, *tokenizer.encode(t or "", add_special_tokens=False).ids, 1) for i, t in ODD_TEXTS])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *r["ids"]) for r in back) == want
    assert token_files.write_token_files(odd.where("false"), new_path(spark, "t"), path).count() == 0
    with pytest.raises(Exception, match="do not fit"):
        token_files.write_token_files(odd, new_path(spark, "t"), path, shards=2, id_type="<u1").count()
    token_files.RUN, kept = 3, token_files.RUN
    few = token_files.read_token_files(token_files.write_token_files(odd, new_path(spark, "t"), path, shards=1)).collect()
    token_files.RUN = kept
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *r["ids"]) for r in few) == want


def test_word_encoder_fuzz():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(5)
    letters = list("aAbB  \n\t\r'st\x1c\x85\xa0é́日ü123-_.,!²") + ["<|endoftext|>", "'re"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(2000)]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for a, b in zip(token_files.WordEncoder(path).encode(texts, 1), want, strict=True):
        assert a.tolist() == [*b.ids, 1]


@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (1, 10**12), (5, 3), (3000, 10), (3000, 10**15)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    ef = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(values).to_bytes())
    assert (ef.select_run(0, n) == values).all() and all(ef.select(i) == values[i] for i in range(n))
    for a, b in [(0, 0), (n // 3, n // 2), (n // 2, n), (max(0, n - 1), n), (min(511, n), min(513, n)), (min(512, n), min(1024, n))]:
        assert (ef.select_run(a, b) == values[a:b]).all()
    with pytest.raises(IndexError):
        ef.select_run(0, n + 1)
    if n == 3000:
        assert len(ef.low) + 8 * len(ef.high) < n * (2 + np.log2(max(2, top / n)) + 1) / 8 + 64


def test_shard_random_access():
    raw = io.BytesIO()
    raw.close, close = (lambda: None), raw.close
    w = token_files.ShardWriter(raw, "<u2")
    w.add([None, 4], np.array([2, 0]), np.array([7, 8]))
    w.add([9], np.array([3]), np.array([1, 2, 3]))
    w.close()
    r = token_files.ShardReader(raw, len(raw.getvalue()))
    assert r.doc_ids(0, 3) == [None, 4, 9] and r.doc_ids(0, 1) == [None] and r.doc_ids(2, 3) == [9] and [r.document(i).tolist() for i in range(3)] == [[7, 8], [], [1, 2, 3]]
    close()


# Near duplicates.
def test_near_dups_hard_group(spark, same_rows, run_sql, tmp_path):
    """Copies that differ in ever more words, exact copies, and texts that share a long passage."""
    rng = np.random.default_rng(2)
    word = lambda: "w" + str(rng.integers(10**6))
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    texts = [" ".join(base)] * 5
    for k in range(60):
        own = list(base)
        for _ in range(int(rng.integers(1, 9))):
            own[int(rng.integers(len(own)))] = word()
        texts.append(" ".join(own).upper() if k % 3 == 0 else "\n ".join(own))
    texts += [" ".join(passage + [word() for _ in range(int(rng.integers(8, 60)))]) for _ in range(60)]
    df = pd.DataFrame({"doc_id": rng.permutation(len(texts)), "text": texts, "lang": "en", "source": "s", "n_chars": 1})
    df.to_parquet(tmp_path / "documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    same_rows(near_dups.near_duplicates(spark.read.parquet(str(tmp_path / "documents.parquet"))), con.sql(near_dups.OP6_SQL).df())


def test_near_dups_one_id_two_texts(spark):
    one, two, other = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, one), (5, one), (5, two), (7, two), (9, other)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (9, 9, True)]


def test_near_dups_odd(odd):
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(odd).collect()}
    assert got[1]["n_shingles"] == 0 and got[1]["kept"] and got[2]["component_id"] == 2 and got[3]["component_id"] == 3
    assert got[4]["n_shingles"] == 1 and got[6]["n_shingles"] == 1
    assert got[9]["component_id"] == 9 and got[None]["kept"] and got[None]["component_id"] is None
    assert near_dups.near_duplicates(odd.where("false")).count() == 0


def test_folded_bounds():
    rng = np.random.default_rng(1)
    sizes, odd_bits = [], []
    for _ in range(300):
        n = int(rng.integers(40, 4000))
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        shared = int(np.ceil(0.75 * n * 2 / 1.75)) if n else 0
        a, b = pool[:n], np.concatenate([pool[n - shared : n], pool[n : 2 * n - shared]])
        if 100 * shared >= 75 * (2 * n - shared):
            f = near_dups.folded([np.unique(a), np.unique(b)])
            sizes.append(2 * n)
            odd_bits.append(int(np.bitwise_count(f[0] ^ f[1]).sum()))
    assert (np.array(odd_bits) <= near_dups.most_folded(np.array(sizes), 75)).all()


# Decontamination.
def test_decontaminate_odd(odd, spark):
    items = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "A", 0), (4, "same words in this line here", 0), (4, "same words in this line here", 0), (None, "a", 0), (5, "not in any text at all here", 0), (6, "same words in this line", 0), (6, "words in this line here", 0)], "item_id long, text string, h int")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contaminated(odd, items).collect()}
    assert got == {(4, 3): 1.0, (8, 4): 1.0, (9, 4): 1.0, (10, 4): 1.0, (8, 6): 1.0, (9, 6): 1.0, (10, 6): 1.0}
    assert decontaminate.contaminated(odd, items.where("false")).count() == 0 and decontaminate.contaminated(odd.where("false"), items).count() == 0


def test_sketch_never_misses(spark):
    rng = np.random.default_rng(8)
    items, docs_ = [], []
    for k in range(60):
        words = [f"w{rng.integers(10**6)}" for _ in range(int(rng.integers(5, 90)))]
        items.append((k, " ".join(words)))
        cut = len(words) - int((len(words) - 4) * 0.25 * rng.random())
        docs_.append((k, " ".join([*(f"x{rng.integers(10**6)}" for _ in range(300)), *words[-cut:]])))
    docs_df, items_df = spark.createDataFrame(docs_, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    want = {k for k, t in items if len(sets(t) & sets(docs_[k][1])) >= 0.75 * len(sets(t))}
    assert {r["doc_id"] for r in decontaminate.contaminated(docs_df, items_df).collect()} == want


def test_signatures_by_size_class(spark):
    """Each part has its own signature length, and a document must hold as many hashes as the item's size in it asks for."""
    sizes = {1: 1, 2: 2, 3: 4, 5: 17, 6: 24, 7: 32}
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{x}" for x in range(n + 4))) for k, n in sizes.items()], "item_id long, text string")
    index = decontaminate.containment_index(items).toPandas()
    lengths = {1: 1, 2: 1, 3: 2, 5: 9, 6: 9, 7: 9}  # a quarter of the class's largest size, and one
    needs = {1: 1, 2: 1, 3: 1, 5: 5, 6: 3, 7: 1}
    assert index.groupby("item_id").size().to_dict() == lengths and index.groupby("item_id")["need"].first().to_dict() == needs
    assert index.groupby("item_id")["part"].first().to_dict() == {1: 1, 2: 1, 3: 2, 5: 5, 6: 5, 7: 5}
    # Documents that hold one shingle each: enough for a candidate only where one hash of the signature is.
    one = [(100 * k + x, " ".join(f"i{k}w{y}" for y in range(x, x + 5))) for k, n in sizes.items() for x in range(n)]
    met = decontaminate.candidate_pairs(spark.createDataFrame(one, "doc_id long, text string"), decontaminate.containment_index(items)).toPandas()
    assert met.groupby("item_id").size().to_dict() == {1: 1, 2: 1, 3: 2, 7: 9}


# URLs.
def test_url_aliases(spark):
    canonical, refresh = '<link rel="canonical" href="%s">', "<meta http-equiv='refresh' content='0; url=%s'>"
    rows = [
        (1, "http://a.net/x", ""), (2, "http://b.example/one", canonical % "http://a.net/x#top"), (3, "http://b.example/two", refresh % "/one"), (4, "http://c.example/", "<LINK HREF='http://www.example.net/en/1' REL=canonical>"),
        (5, "http://c.example/", canonical % "http://z.net/"), (6, None, canonical % "http://a.net/"), (7, "no url", None), (8, "HTTP://B.example/one#f", None), (9, "http://free.example", "<p>"), (10, "https://x.org/fr/?q", None), (10, "https://x.org/fr/?q", None),
    ]
    df = spark.createDataFrame([(*r, "r") for r in rows], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, url_filter.rules_table(spark, url_filter.RULES)).collect()}
    assert got == {1: ("net/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "allow"), 10: ("org/fr/", "allow")}
    assert url_filter.judge_urls(df.where("false"), url_filter.rules_table(spark, url_filter.RULES)).count() == 0


# Top k.
def test_top_k_odd(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(0, rows[0][1]), (300, None), (400, [None] * 8), (500, [float("nan")] * 8), (None, rows[1][1]), (600, [1.0, 2.0]), (601, [1.0, 2.0]), (700, []), (5, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = top_k.top_k(df, df.where("vec_id % 100 = 0"), k=10, block=32, query_block=2, blocks_a_group=2).collect()
    ok = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        own = min(tuple(v) for i, v in rows if i == q and v is not None)
        x = np.floor(1024 * np.array(own)).astype(int)
        want[q] = sorted(((-int(x @ v), i) for i, v in ok if i != q and len(v) == len(x)))[:10]
    mine: dict = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert mine == {q: v for q, v in want.items() if v}
    assert top_k.top_k(df.where("false"), df).count() == 0


def test_top_k_large_components_and_ties(spark, same_rows):
    """Components up to 1e7 once scaled (and far above), a vector that a third of the rows share, many blocks and groups."""
    import duckdb

    rng = np.random.default_rng(4)
    m = np.concatenate([rng.integers(-(10**7), 10**7, (300, 16)) / 1024, rng.integers(-3, 3, (300, 16)).astype(float), np.repeat(rng.integers(-(10**7), 10**7, (1, 16)) / 1024, 300, 0)])
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(m)), m, strict=True)]
    con = duckdb.connect()
    con.register("embeddings", pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows]}))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k.top_k(df, df.where("vec_id % 100 = 0"), block=64, query_block=2, blocks_a_group=3)
    same_rows(got, con.sql(top_k.OP9_SQL).df())
    huge = spark.createDataFrame([(k, [2.0**30 * (1 + k)] * 4) for k in range(8)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        top_k.top_k(huge, huge).collect()
    with pytest.raises(Exception, match="too large"):
        top_k.top_k(df.union(spark.createDataFrame([(-1, [1e300] * 16)], df.schema)), df).collect()


def test_top_k_reads_few_exact_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 16)))], "vec_id long, embedding array<double>")
    kept = {}
    real = top_k.materialize
    monkeypatch.setattr(top_k, "materialize", lambda d, name, *a, **_: kept.setdefault(name, real(d, name, *a, kept=True)))
    top_k.top_k(df, df.where("vec_id % 300 = 0"), block=256).count()
    assert kept["exact"].count() == 3000 and "exact" not in kept["approximation"].columns
    assert 100 <= kept["near"].count() < 600  # ten queries, ten each


# Pipeline.
def test_pipeline_against_stages(spark, sf, docs, same_rows, tmp_path):
    import duckdb

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near-dedup", "decontamination", "sentencepiece"]
    con = duckdb.connect()
    current = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = current.toPandas()
        out = stage(spark, current, sf)
        out.write.mode("overwrite").parquet(str(tmp_path / str(k)))
        current = spark.read.parquet(str(tmp_path / str(k)))
        con.register("before", before)
        con.sql(f"CREATE OR REPLACE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
        got = current.toPandas()
        if k < 4:
            assert list(got.columns) == corpus_pipeline.COLUMNS
        if name == "line dedup":
            want = con.sql("WITH" + lines._LINES_SQL.format(docs="before") + " SELECT doc_id, text FROM cut").df()
            same_rows(got[["doc_id", "text"]], want)
            assert (got["n_chars"] == got["text"].str.len()).all()
        elif name == "near-dedup":
            kept = con.sql(near_dups.OP6_SQL.replace("FROM documents", "FROM before")).df()
            assert sorted(got["doc_id"]) == sorted(kept.loc[kept["kept"], "doc_id"])
        elif name == "decontamination":
            gone = con.sql(decontaminate.OP7_SQL.replace("FROM documents", "FROM before")).df()["doc_id"]
            assert sorted(got["doc_id"]) == sorted(set(before["doc_id"]) - set(gone))
        elif name == "sentencepiece":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
            assert all(list(i) == sp.encode(t or "") for i, t in zip(got["ids"], got["text"], strict=True))
        else:
            toxic = toxicity.tag_documents(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("score >= 0.5")
            assert sorted(got["doc_id"]) == sorted(set(before["doc_id"]) - {r["doc_id"] for r in toxic.collect()})
    assert corpus_pipeline.run(spark, sf).count() == current.count()


def test_pipeline_stages_odd(spark, sf):
    """Nulls, blank and long texts, repeated ids and rows, an id that is missing, columns whose names the operators use; and no rows at all."""
    words = " ".join(f"word{k}" for k in range(60))
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first()["text"]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, words), (4, words), (5, words + " end"), (6, "other " * 40_000), (7, leak), (None, words), (8, "a line that three documents hold\nown"), (9, "A line that three documents hold \nmine"), (10, "a line that three documents hold")]
    df = spark.createDataFrame([(i, t, None, "s", None, "x", 1, [2]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, score int, spans array<int>")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == corpus_pipeline.COLUMNS
        assert stage(spark, df.where("false"), sf).count() == 0
    got = {}
    for r in docs.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[1] == [""] and got[2] == [""] and got[4] == [words, words] and 5 not in got and 7 not in got and got[None] == [words]
    assert got[8] == ["own"] and got[9] == ["mine"] and got[10] == ["a line that three documents hold"]
    ids = corpus_pipeline.encode(spark, docs, sf)
    assert ids.columns == [*corpus_pipeline.COLUMNS, "ids"] and ids.count() == docs.count()
    assert corpus_pipeline.encode(spark, df.where("false"), sf).count() == 0
