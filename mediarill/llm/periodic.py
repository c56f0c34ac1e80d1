"""Periodic runs of words, and texts without their repetitions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import flat_bytes, slices, text_array
from .recompression import Grammar

#: Alike words side by side that a place of a long enough stretch has before or behind it, itself counted.
SEEN = 4


def _stride(period: np.ndarray, least: int) -> np.ndarray:
    """A run of this period has as many places in a row that equal the one a period later."""
    return np.maximum(least - period, period)


def _candidates(first: np.ndarray, size: np.ndarray, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(sequence, place, period)`` of the harmonic grid: each multiple of a period's stride, about ``most`` at a time."""
    periods = np.where(size >= least, size // 2, 0)
    ends = np.cumsum(periods)
    at = 0
    while at < ends[-1]:
        # Periods of a run of sequences, of so many that their grid has about ``most`` places.
        rows = np.arange(at, min(at + max(1, most // 4), int(ends[-1])))
        owner = np.searchsorted(ends, rows, "right")
        period = rows - (ends - periods)[owner] + 1
        stride = _stride(period, least)
        count = (size[owner] - period - 1) // stride + 1
        total = np.cumsum(count)
        taken = max(1, int(np.searchsorted(total, most, "right")))
        at += taken
        owner, period, stride, count, total = owner[:taken], period[:taken], stride[:taken], count[:taken], total[:taken]
        nth = np.arange(total[-1]) - np.repeat(total - count, count)
        yield np.repeat(owner, count), np.repeat(first[owner], count) + nth * np.repeat(stride, count), np.repeat(period, count)


def find_runs(codes: np.ndarray, size: np.ndarray, least: int = 12, most: int = 1 << 20) -> pd.DataFrame:
    """``(sequence, start, length, period)`` of all runs of sequences that lie end to end in ``codes``, in that order.

    A run is a stretch with smallest period q, of ``max(least, 2 q)`` places
    at least, that can't be extended keeping it. Where a run has period q, a
    stretch of ``max(least - q, q)`` places or more equals the one q later, so
    one of them is a multiple of that number. Those multiples are the
    candidates; those with ``SEEN`` alike places on neither side go, the others'
    stretch is extended both ways by the grammar. Stretches of a
    multiple of the period have the same ends, so the smallest period of
    each pair of ends is the run's.
    """
    n_seq = len(size)
    fence = np.ones(len(codes) + n_seq + 1, bool)
    first = np.cumsum(size) - size + np.arange(n_seq) + 1
    fence[np.arange(len(codes)) + np.repeat(np.arange(n_seq), size) + 1] = False
    spread = np.zeros(len(fence), np.int64)
    spread[~fence] = codes
    grammar: Grammar | None = None
    mirror: Grammar | None = None
    # Names of SEEN places in a row; a fence is like nothing, so none goes over one.
    base = spread + 1
    base[fence] = int(base.max(initial=0)) + 1 + np.arange(n_seq + 1)
    gram = base.astype(np.uint64)
    width = 1
    while width < SEEN:  # mixed, not exact: an accident costs one extension
        gram = gram * np.uint64(0x9E3779B97F4A7C15) ^ (gram >> np.uint64(31))
        gram = gram + np.append(gram[width:], np.zeros(width, np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        width *= 2
    n, found = len(fence), []
    if n_seq == 0 or int(size.max()) < least:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("sequence", "start", "length", "period")})
    behind = SEEN - 1
    for owner, place, period in _candidates(first, size, least, most):
        other = place + period
        like = (gram[place] == gram[other]) | ((place >= behind) & (gram[place - behind] == gram[other - behind]))
        owner, place, period = owner[like], place[like], period[like]
        if not len(place):
            continue
        if grammar is None:
            grammar = Grammar(spread, fence)
            mirror = grammar.mirrored()
        head = np.append(True, (owner[1:] != owner[:-1]) | (period[1:] != period[:-1]))
        # First one place of each sequence and period; what lies in its stretch needs no look.
        start, end = _stretch(grammar, mirror, n, place[head], period[head])
        which = np.cumsum(head) - 1
        left = (place >= end[which]) & ~head
        more = _stretch(grammar, mirror, n, place[left], period[left])
        for o, p, s, e in ((owner[head], period[head], start, end), (owner[left], period[left], *more)):
            length = e - s + p
            good = length >= np.maximum(least, 2 * p)
            found.append(np.stack([o[good], s[good] - first[o[good]], length[good], p[good]]))
    rows = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
    out = pd.DataFrame(dict(zip(("sequence", "start", "length", "period"), rows, strict=True)))
    out = out.groupby(["sequence", "start", "length"], as_index=False)["period"].min()
    return out.sort_values(["sequence", "start", "period"], ignore_index=True)


def _stretch(grammar: Grammar, mirror: Grammar, n: int, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last of the places around each that equal the one a period later."""
    ahead = grammar.extension(place, place + period)
    back = mirror.extension(n - place - period, n - place)  # the place before each, read from the right
    return place - back, place + ahead


def words_of(raw: np.ndarray, starts: np.ndarray) -> list[list[bytes]]:
    """The words of each text: what stands between white space of ASCII."""
    data = raw.tobytes()
    return [data[a:b].split() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row of ``docs``.

    ``runs array<struct<start, length, period>>``, in words from 0, by start
    and period: each stretch of words with smallest period q, of
    ``max(least, 2 q)`` words or more, that no neighbouring word extends
    keeping that period. ``collapsed`` is the text's words joined by one space,
    without those that any run holds behind its first q words. Words are what
    ASCII white space parts; null, empty and blank texts have none,
    no runs, and an empty ``collapsed``. Whole texts are searched, of any
    length; what a task holds grows with its longest text only. Rows that repeat a doc_id, or
    have none, stand for themselves. Other columns are left out, so their
    names can't clash. An empty table gives an empty table.
    """
    run_type = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type, False)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                words = words_of(*flat_bytes(piece.column("text")))
                size = np.fromiter(map(len, words), np.int64, len(words))
                every = [w for ws in words for w in ws]
                number: dict[bytes, int] = {}
                codes = np.fromiter((number.setdefault(w, len(number)) for w in every), np.int64, len(every))
                found = find_runs(codes, size, least)
                first = np.cumsum(size) - size
                owner, start, length, period = (found[c].to_numpy() for c in found.columns)
                depth = np.zeros(len(every) + 1, np.int64)
                np.add.at(depth, first[owner] + start + period, 1)
                np.add.at(depth, first[owner] + start + length, -1)
                kept = np.cumsum(depth[:-1]) == 0
                whole = np.bincount(owner, minlength=len(words)) == 0
                texts = [b" ".join(ws if w else compress(ws, kept[f : f + len(ws)].tolist())) for ws, f, w in zip(words, first.tolist(), whole.tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int32)
                fields = [pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]
                runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=fields))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size), runs, text_array(texts)], schema.names)

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)


def with_periodic_tails(doc_id: Column, text: Column) -> Column:
    """The text itself, but for each tenth document (by the crc of its id): there, its words with those from one on replaced by repetitions of a stretch."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(ws: Column) -> Column:
        n = F.size(ws)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.element_at(ws, (a + F.pmod(i - a, p) + 1).cast("int")))), " ")

    made = F.aggregate(F.array(words), F.lit(""), lambda _, ws: F.when(F.size(ws) > 0, tail(ws)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, made).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = periodic_runs(docs.select("doc_id", with_periodic_tails(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), F.floor(F.col("b.length") * 1000 / -F.col("b.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
