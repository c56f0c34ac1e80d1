"""Licence scans, fill-in-middle texts and periodic runs: brute force, exact round trips, odd inputs."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediarill.llm import fill_middle, licences, periodic
from mediarill.llm.flat import flat_bytes, slices, text_array
from mediarill.llm.recompression import Grammar

ODD_TEXTS = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a"), (5, "ß É 日本語   x y <P"), (6, "word " * 30_000), (7, "x" * 100_000), (8, "a <S> mark"), (8, "a <S> mark"), (8, "one id, another text"), (9, "<<S<M<P"), (None, "no id at all in this one here")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, 2.0, "y", 3) for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n int, score double, runs string, h1 int")


def digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# Flat bytes.
def test_flat_bytes_and_slices():
    column = pa.array(["skip", None, "", "é", "日本 x"])[1:]
    raw, starts = flat_bytes(column)
    assert [raw[a:b].tobytes().decode() for a, b in zip(starts, starts[1:], strict=False)] == ["", "", "é", "日本 x"]
    assert text_array(["é".encode(), b"", b"x"]).to_pylist() == ["é", "", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * k for k in (3, 9, 1, 1, 20, 0, 4)])], ["t"])
    assert [[len(x) for x in s.column("t").to_pylist()] for s in slices(batch, "t", 10)] == [[3], [9, 1], [1], [20], [0, 4]]
    assert list(slices(batch.slice(0, 0), "t")) == []


# Fill in the middle.
def test_wavelet_ranks_and_cuts():
    rng = np.random.default_rng(5)
    for _ in range(200):
        codes = rng.integers(0, 8, rng.integers(0, 300)).astype(np.uint8)
        matrix, at = fill_middle.WaveletMatrix(codes, 3), rng.integers(0, len(codes) + 1, 20)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == [int((codes[:i] == c).sum()) for i in at]
        texts = ["".join(rng.choice(list("abZ <P>é日\n🙂0"), rng.integers(0, 20))) for _ in range(rng.integers(1, 9))]
        found, units = fill_middle.Boundaries(*flat_bytes(pa.array(texts))), [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
        assert found.counts().tolist() == [len(u) for u in units]
        k = np.array([rng.integers(0, len(u) + 1) for u in units])
        cut = found.cut(k)
        assert found.characters(found.starts[:-1], cut).tolist() == [len("".join(u[:n])) for u, n in zip(units, k, strict=True)]


def plain_middle(doc_id, text):
    text, h = text or "", digest(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fill_middle.MARKS) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    return (n, *(("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")), len(p), len(m))


def test_fill_in_middle_odd(odd, spark):
    got = fill_middle.fill_in_middle(odd).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, ((r["doc_id"], r["again"]) for r in got))) == sorted(map(str, ((i, t or "") for i, t in ODD_TEXTS)))
    assert sorted(map(str, ((r["doc_id"], *r[1:-1]) for r in got))) == sorted(map(str, ((i, *plain_middle(i, t)) for i, t in ODD_TEXTS)))
    assert fill_middle.fill_in_middle(odd.where("false")).count() == 0


def test_fill_in_middle_round_trip_near_marks(spark):
    rng = np.random.default_rng(9)
    rows = [(k, "".join(rng.choice(list("<<SPM>> ab\n"), rng.integers(1, 30)))) for k in range(400)]
    out = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in out.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()}
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}
    assert all(got[k]["again"] == t and got[k]["output"] == plain_middle(k, t)[2] for k, t in rows)


# Periodic runs.
def plain_runs(words, least=12):
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, 2 * p):
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_tails(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w.decode() for i, w in enumerate(words) if i not in gone)


def strange(rng, longest=70):
    """Words of few kinds, with repetitions set in."""
    n = int(rng.integers(0, longest))
    words = rng.integers(0, rng.integers(1, 5), n).tolist()
    for _ in range(rng.integers(0, 3) if n else 0):
        at, p, length = int(rng.integers(0, n)), int(rng.integers(1, 15)), int(rng.integers(2, 60))
        words = words[:at] + (rng.integers(0, 8, p).tolist() * length)[:length] + words[at:]
    return words


def test_grammar_extensions():
    rng = np.random.default_rng(3)
    for _ in range(150):
        texts = [strange(rng, 200) for _ in range(3)]
        flat, fence = [0], [True]
        for t in texts:
            flat, fence = [*flat, *t, 0], [*fence, *[False] * len(t), True]
        grammar = Grammar(np.array(flat), np.array(fence))
        assert grammar.levels[0].width.sum() == grammar.levels[-1].width.sum() == len(flat)
        base = 1
        for t in texts:
            if len(t) > 1:
                a, b = np.sort(rng.integers(0, len(t), (2, 40)), 0)
                a, b = a[a < b], b[a < b]
                want = [next((k for k in range(len(t)) if j + k >= len(t) or t[i + k] != t[j + k]), 0) for i, j in zip(a, b, strict=True)]
                assert grammar.extension(a + base, b + base).tolist() == want
                want = [next((k for k in range(len(t)) if k > i or t[i - k] != t[j - k]), 0) for i, j in zip(a, b, strict=True)]
                n = len(flat) - 1
                assert grammar.mirrored().extension(n - b - base, n - a - base).tolist() == want
            base += len(t) + 1


@pytest.mark.parametrize("most", [1 << 20, 50, 7])
def test_runs_by_brute_force(most):
    rng = np.random.default_rng(most)
    for _ in range(150):
        texts = [strange(rng) for _ in range(rng.integers(1, 7))]
        got = periodic.find_runs(np.array([c for t in texts for c in t], np.int64), np.array([len(t) for t in texts]), most=most)
        assert list(got.itertuples(index=False, name=None)) == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]


def test_long_runs_in_few_steps():
    codes = np.random.default_rng(0).integers(0, 1000, 200_000)
    codes[50_000:150_000] = np.tile(codes[:777], 129)[:100_000]
    codes[49_999], codes[150_000] = 2000, 2001
    got = periodic.find_runs(codes, np.array([len(codes)]))
    assert got.values.tolist() == [[0, 50_000, 100_000, 777]]
    assert periodic.find_runs(np.zeros(300_000, np.int64), np.array([300_000])).values.tolist() == [[0, 0, 300_000, 1]]


def test_periodic_runs_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in periodic.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = plain_tails(doc_id, text)
        runs, row = plain_runs(words), got[doc_id]
        assert row["n_runs"] == len(runs)
        assert row["runs_sha256"] == digest("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert row["collapsed_sha256"] == digest(collapsed(words, runs))
        s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == (s, n, p, n * 1000 // p if runs else None)
    assert any(r["n_runs"] for r in got.values())


def test_periodic_runs_odd(odd):
    got = {(r["doc_id"], r["collapsed"]): r for r in periodic.periodic_runs(odd).collect()}
    assert got[(1, "")]["n_words"] == got[(3, "")]["n_words"] == 0
    assert got[(6, "word")]["runs"] == [(0, 30_000, 1)]
    assert got[(5, "ß É 日本語 x y <P")]["runs"] == [] and got[(7, "x" * 100_000)]["n_words"] == 1
    assert (None, "no id at all in this one here") in got and len(got) == len(ODD_TEXTS) - 1  # one row stands twice
    assert periodic.periodic_runs(odd.where("false")).count() == 0
    tails = odd.select("doc_id", periodic.with_periodic_tails(F.col("doc_id"), F.col("text")).alias("t")).collect()
    assert all((r["t"] or "").split() == [w.decode() for w in plain_tails(i, t)] for r, (i, t) in zip(tails, ODD_TEXTS, strict=True) if i != 7)


# Licence scans.
def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(words, phrase):
    want = phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(want)] == want]


def plain_base(text):
    words = plain_words(text)
    hits = {label: places(words, phrase) for phrase, label in licences.BASE.items()}
    every = [i for at in hits.values() for i in at]
    return len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k, v in hits.items() if v))


def plain_passages(rows, rare=8, share=0.5, slack=4):
    """The verified passages of each row, by trying every place."""
    texts = [plain_words(t) for _, t in rows]
    df = {}
    for t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    weight = lambda w: np.log((len(rows) + 1) / (df.get(w, 0) + 1)) + 1e-9
    out = []
    for t in texts:
        found = []
        for p in licences.PASSAGES:
            words = plain_words(p.text)
            chosen = sorted(set(words), key=lambda w: (-weight(w), w.encode()))[:rare]
            own = [(i, w) for i, w in enumerate(words) if w in chosen]
            for begin in range(-len(words), len(t)):
                hit = [w for i, w in own if 0 <= begin + i < len(t) and t[begin + i] == w]
                near = lambda k: any(abs(i - begin - places(words, k)[0]) <= slack for i in places(t, k))  # noqa: B023, E731
                if len(hit) >= max(2, int(np.ceil(share * len(own)))) and all(near(k) for k in p.keys):
                    found.append((p.label, begin, len(words), round(sum(map(weight, hit)) / sum(weight(w) for _, w in own), 9)))
        out.append(sorted(found, key=lambda m: (m[1], m[0])))
    return out


NOTICES = [
    (1, "Some code\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including"),
    (2, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0"), (3, "This file: licensed under CC-BY-NC 4.0, see cc by nc sa 4.0"), (4, "licensed under CC BY 4.0. All rights reserved. All rights reserved"), (5, "the license of the bridge was reserved"),
    (6, "Apache"), (7, "License, Version 2.0"), (8, None), (9, "redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met"),
    (10, "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"), (11, "mit license mit license released under the mit license\x00released under the MIT\x0blicense"),
]


@pytest.mark.parametrize("batch", ["1000", "3"])
def test_licences_by_brute_force(spark, batch):
    rows = NOTICES + [(100 + k, f"plain text number {k} the of and to in any license é") for k in range(20)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert len(got) == len(rows)
    for (i, text), want in zip(rows, plain_passages(rows), strict=True):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(text)
        assert sorted([(m["label"], m["start"], m["words"], round(m["score"], 9)) for m in r["matches"]], key=lambda m: (m[1], m[0])) == want
        assert r["labels"] == ",".join(sorted({m[0] for m in want} | set(r["base_labels"].split(",")) - {""}))
        assert r["score"] == pytest.approx(1.0 if r["n_base"] else max((m[3] for m in want), default=0.0))
    labels = {i: got[i]["labels"] for i, _ in NOTICES}
    assert labels == {1: "mit", 2: "apache-2.0", 3: "cc-by,cc-by-nc-4.0,cc-by-nc-sa-4.0", 4: "cc-by,cc-by-4.0,reserved", 5: "", 6: "", 7: "", 8: "", 9: "", 10: "gpl,gpl-2.0", 11: "mit"}


def test_licences_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in licences.op11_licences(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(text)
        assert ("apache-2.0" in r["labels"]) == ("Licensed under the Apache License, Version 2.0" in (text or "")) and ("mit" in r["labels"].split(",")) == ("Released under the MIT License" in (text or ""))
        assert 0 <= r["score"] <= 1


def test_licences_odd(odd):
    got = licences.scan_licences(odd).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in ODD_TEXTS)
    assert all(r["labels"] == "" and r["matches"] == [] and r["first_word"] is None for r in got)
    assert licences.scan_licences(odd.where("false")).count() == 0
