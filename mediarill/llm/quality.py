"""Document quality by Bradley-Terry ranking of labelled pairs, cut at a score quantile; learnt from all documents whose labels may be learnt from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import materialize
from .labelled import held_out, learnable
from .pieces import _slices

MEASURES = 15
#: Parts of the measures' range that get a weight each.
PARTS = 12


def measure(text: str) -> list[float]:
    """What is counted in a text: lengths, repetition, letter case, signs, lines."""
    words = text.split()
    n = max(1, len(words))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    upper, lower, digits = raw[65:91].sum(), raw[97:123].sum(), raw[48:58].sum()
    lines = text.split("\n")
    signs = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
    plain = raw[[44, 46]].sum()
    return [
        np.log1p(len(words)),
        len(text) / n,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        upper / max(1, upper + lower),
        digits / size,
        (signs - plain) / size,
        plain / n,
        raw[[33, 63]].sum() / n,
        raw[[35, 36, 37, 38, 42, 64, 94, 95, 124, 126]].sum() / n,
        raw[[60, 61, 62, 91, 92, 93, 123, 125]].sum() / n,
        raw[128:].sum() / size,
        len(lines) / n,
        len(set(lines)) / len(lines),
        1.0 if words else 0.0,
    ]


@dataclass
class Ranker:
    """Cut points of the measures, a weight for each part, the cut of the score and its scale."""

    cuts: np.ndarray
    weights: np.ndarray
    limit: float
    scale: float
    accept: float

    def features(self, m: np.ndarray) -> np.ndarray:
        """Each measure as the parts of its range that lie below it (a sum of weights is then any step function)."""
        return (m[:, :, None] > self.cuts[None]).reshape(len(m), -1).astype(np.float64)

    def raw(self, m: np.ndarray) -> np.ndarray:
        return self.features(m) @ self.weights

    def scores(self, m: np.ndarray) -> np.ndarray:
        z = self.scale * (self.raw(m) - self.limit) + np.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_ranker(texts: list[str], y: np.ndarray, pairs: int = 60_000, accept: float = 0.3, l2: float = 1.0, seed: int = 11) -> Ranker:
    """Weights that put good documents before bad ones, and the score quantile that parts them.

    Preference pairs (good, bad) are drawn from the sample; the chance that
    the good one wins is the logistic function of the difference of scores,
    and the likelihood of all pairs is raised by Newton steps. The cut is the
    quantile of the sample's scores at the share of bad documents, moved to
    the middle of the gap there; it is mapped to a score of ``accept``.
    """
    m = np.array([measure(t) for t in texts], float).reshape(-1, MEASURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        share = float(len(good) > 0)
        return Ranker(np.zeros((MEASURES, PARTS)), np.zeros(MEASURES * PARTS), -1.0 if share else 1.0, 1.0, accept)
    # Cut points at quantiles of both classes alike, so that the rarer one is resolved too.
    half = [np.quantile(m[rows], np.linspace(0.02, 0.98, PARTS // 2), axis=0).T for rows in (good, bad)]
    ranker = Ranker(np.sort(np.concatenate(half, 1), 1), np.zeros(MEASURES * PARTS), 0.0, 1.0, accept)
    x = ranker.features(m)
    rng = np.random.default_rng(seed)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = ranker.weights
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        h = (d * (p * (1 - p))[:, None]).T @ d + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, d.T @ (1 - p) - l2 * w)
    ranker.weights = w
    s = np.sort(x @ w)
    at = min(len(s) - 1, max(1, int(round(len(bad) / len(y) * len(s)))))
    ranker.limit = float((s[at - 1] + s[at]) / 2)
    ranker.scale = 4.0 / max(1e-9, float(s.std()))
    return ranker


def rank_documents(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """``docs`` with ``score double``, 0 to 1, ``ranker.accept`` at the cut.

    Whole texts are measured. Null and empty texts are scored as the empty
    text. A column already called score is replaced; others pass through. Rows
    that repeat a doc_id, or have none, are scored each by their own text. An
    empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(ranker)
    others = [f for f in docs.schema.fields if f.name != "score"]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                m = np.array([measure(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, MEASURES)
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(model.value.scores(m))], [*names, "score"])

    return docs.mapInArrow(run, T.StructType([*others, T.StructField("score", T.DoubleType())]))


def _measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, m)``: the measures of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                m = np.array([measure(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, MEASURES)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, MEASURES, dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "m"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, m array<double>")


#: Bits of a single-precision number that are left out where measures are counted: 256 steps to each power of two stay.
COARSE = 15


def _cut_points(rows: DataFrame) -> np.ndarray:
    """Cut points of each measure at quantiles of both classes of ``rows(y, m)`` alike, so that the rarer one is resolved too.

    All rows are counted, by values of nine significant bits; so no more than some
    thousands of counts of a measure come to the driver, however many rows there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("m").flatten().to_numpy().reshape(-1, MEASURES)
            code = m.astype(np.float32).view(np.int32).astype(np.int64) >> COARSE
            key = (batch.column("y").to_numpy()[:, None].astype(np.int64) * MEASURES + np.arange(MEASURES)) << 32 | code
            met, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n)], ["key", "n"])

    counts = rows.select("y", "m").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toPandas()
    key, n = counts["key"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    values = ((key & (2**32 - 1)).astype(np.int32) << COARSE).view(np.float32).astype(np.float64)
    cuts = []
    for j in range(MEASURES):
        both = []
        for y in (1, 0):
            of = key >> 32 == y * MEASURES + j
            ends = np.cumsum(n[of])  # measures are never negative, so codes stand in their order
            both.append(values[of][np.searchsorted(ends, np.linspace(0.02, 0.98, PARTS // 2) * (ends[-1] - 1), "right")])
        cuts.append(np.sort(np.concatenate(both)))
    return np.array(cuts)


def _pair_cells(rows: DataFrame, good: int, bad: int, side: int = 500) -> DataFrame:
    """``(good, bad)``: measures of some ``side`` documents of each class, as bytes; every document of ``rows(doc_id, y, m)`` is in one cell at least, those of the rarer class in several."""
    groups = [-(-bad // side), -(-good // side)]
    cells = max(groups)
    of = F.when(F.col("y") == 1, groups[1]).otherwise(groups[0])
    dealt = rows.select("y", "m", "doc_id", of.alias("of")).withColumn("g", F.pmod(F.xxhash64("doc_id"), F.col("of")).cast("int"))
    dealt = dealt.select("y", "m", F.explode(F.sequence("g", F.lit(cells - 1), F.col("of"))).alias("cell"))

    def pack(cell: pa.Table) -> pa.Table:
        y = cell.column("y").to_numpy()
        m = cell.column("m").combine_chunks().flatten().to_numpy().reshape(-1, MEASURES)
        m, y = m[order := np.lexsort([*m.T, y])], y[order]
        return pa.table([pa.array([m[y == k].tobytes()], pa.binary()) for k in (1, 0)], ["good", "bad"])

    return materialize(dealt.groupBy("cell").applyInArrow(pack, "good binary, bad binary"), "pair_cells")


def _slope(cells: DataFrame, ranker: Ranker) -> tuple[np.ndarray, np.ndarray, float]:
    """Slope and curvature of the likelihood of all pairs (good, bad) of all cells, and how many pairs there are; each task adds up its own."""
    model = cells.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value.weights
        g, h, n = np.zeros(len(w)), np.zeros((len(w), len(w))), 0.0
        for batch in batches:
            for raw in zip(batch.column("good").to_pylist(), batch.column("bad").to_pylist(), strict=True):
                x, z = (model.value.features(np.frombuffer(r, np.float64).reshape(-1, MEASURES)) for r in raw)
                p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - (z @ w)[None], -40, 40)))
                v = p * (1 - p)
                g += x.T @ (1 - p).sum(1) - z.T @ (1 - p).sum(0)
                across = x.T @ v @ z
                h += (x * v.sum(1)[:, None]).T @ x + (z * v.sum(0)[:, None]).T @ z - across - across.T
                n += p.size
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g, h.ravel(), [n]]).tobytes()], pa.binary())], ["sums"])

    sums = sum(np.frombuffer(r["sums"], np.float64) for r in cells.mapInArrow(run, "sums binary").collect())
    model.destroy()
    k = MEASURES * PARTS
    return sums[:k], sums[k:-1].reshape(k, k), float(sums[-1])


def _at_rank(scored: DataFrame, rank: int, most: int = 10_000, bins: int = 2048) -> float:
    """The score of a rank from 0 on, exactly: ranges are counted and the one that holds it is cut again, until ``most`` rows are left."""
    low, high, before = -np.inf, np.inf, 0
    while True:
        inside = scored.where(F.col("s").between(float(low), float(high)))
        f = inside.agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).first()
        if f["low"] == f["high"]:
            return f["low"]
        if f["n"] <= most:
            return sorted(r["s"] for r in inside.collect())[rank - before]
        edge = np.linspace(f["low"], f["high"], bins + 1)
        bin_ = F.width_bucket("s", F.lit(float(edge[0])), F.lit(float(edge[-1])), F.lit(bins))
        for r in inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("low").collect():
            if before + r["n"] > rank:
                low, high = r["low"], r["high"]
                break
            before += r["n"]


def fit_quality(docs: DataFrame, labels: DataFrame, pairs: int = 60_000, accept: float = 0.3, l2: float = 1.0) -> Ranker:
    """A ranker from all documents whose labels may be learnt from, as ``train_ranker`` makes of texts in memory.

    Tasks measure the texts; cut points are quantiles of all learnable documents.
    These are dealt to cells of some 500 of each class, and each cell's pairs of a good
    and a bad one count, with the weight of ``pairs`` in all; tasks add up slopes and
    curvatures, and the driver gets the sums for its Newton steps. The score's cut is
    the one that ``train_ranker`` describes, over all learnable documents.
    """
    rows = materialize(_measured(docs).join(learnable(labels, "quality").where("y in (0, 1)"), "doc_id"), "measured")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return Ranker(np.zeros((MEASURES, PARTS)), np.zeros(MEASURES * PARTS), -1.0 if good else 1.0, 1.0, accept)
    ranker = Ranker(_cut_points(rows), np.zeros(MEASURES * PARTS), 0.0, 1.0, accept)
    cells = _pair_cells(rows, good, bad)
    for _ in range(12):
        g, h, n = _slope(cells, ranker)
        step = np.linalg.solve(h * (pairs / n) + l2 * np.eye(len(g)), g * (pairs / n) - l2 * ranker.weights)
        ranker.weights = ranker.weights + step
        if np.abs(step).max() < 1e-6:
            break
    model = docs.sparkSession.sparkContext.broadcast(ranker)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.value.raw(batch.column("m").flatten().to_numpy().reshape(-1, MEASURES)))], ["s"])

    scored = materialize(rows.select("m").mapInArrow(score, "s double"), "scored")
    at = min(good + bad - 1, max(1, bad))
    ranker.limit = (_at_rank(scored, at - 1) + _at_rank(scored, at)) / 2
    ranker.scale = 4.0 / max(1e-9, scored.agg(F.stddev_pop("s")).first()[0])
    return ranker


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranker = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = rank_documents(docs, ranker)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
