"""Toxic spans by a linear-chain conditional random field; document scores from its marginals."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, labelled_sample
from .pieces import _slices
from .remembered import Remembered

#: Hashed feature weights, and tokens in a stretch of the two-level chain recursion.
SIZE, STRETCH = 1 << 17, 64
#: Slots in which the features of the sample's documents are counted.
MARKS = 1 << 22


def word_features(word: str) -> list[str]:
    """A token's features: its bare form, and the starts and ends of that."""
    w = word.lower().strip("\"'.,;:!?()[]{}<>|#$%&*+-=_~^/\\`@“”„«»…–—")
    return ["=" + w, *[f"<{w[:n]}" for n in range(3, 7) if len(w) >= n], *[f">{w[-n:]}" for n in range(3, 6) if len(w) >= n]]


def _slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % SIZE for f in word_features(word)]


def chain_marginals(odds: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once.

    ``odds``: log score of state 1 over state 0 of each token, all chains end
    to end; ``moves``: 2 x 2 log transition scores. Returns the tokens'
    marginals of state 1, the expected transitions (2 x 2), and the sum of
    the log partition functions.

    Each chain is cut into stretches of STRETCH tokens. Products of the step
    matrices run inside all stretches side by side; the stretches of a chain
    are then linked one after the other, all chains side by side. That costs
    a constant number of array operations a token, however long a chain is.
    """
    n_chains = len(lengths)
    stretches = np.maximum(1, -(-lengths // STRETCH))
    first = np.cumsum(stretches) - stretches
    total = int(stretches.sum())
    grid = np.zeros((STRETCH, total))
    real = np.zeros((STRETCH, total), bool)
    chain = np.repeat(np.arange(n_chains), lengths)
    offset = np.arange(len(odds)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    col, row = first[chain] + offset // STRETCH, offset % STRETCH
    top = np.maximum(odds, 0.0)
    grid[row, col], real[row, col] = odds, True
    e0, e1 = np.exp(np.minimum(-grid, 0.0)), np.exp(np.minimum(grid, 0.0))  # scaled by exp(max(odds, 0))
    m = np.exp(moves)
    # Step t maps a row vector before token t to one behind it: M diag(e). A chain's first token has no transition.
    start = np.zeros(total, bool)
    start[first] = True

    def steps(t: int):
        on = real[t]
        a = [np.where(on, m[i, j] * (e1[t] if j else e0[t]), float(i == j)) for i in (0, 1) for j in (0, 1)]
        if t == 0:
            a = [np.where(start & on, (e1[0] if j else e0[0]) * float(i == j), x) for x, (i, j) in zip(a, ((0, 0), (0, 1), (1, 0), (1, 1)), strict=True)]
        return a

    # Products inside each stretch, scaled.
    p = [np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)]
    log_p = np.zeros(total)
    for t in range(STRETCH):
        a = steps(t)
        p = [p[0] * a[0] + p[1] * a[2], p[0] * a[1] + p[1] * a[3], p[2] * a[0] + p[3] * a[2], p[2] * a[1] + p[3] * a[3]]
        s = p[0] + p[1] + p[2] + p[3]
        p = [x / s for x in p]
        log_p += np.log(s)
    # Link stretches: forward entry vectors and backward exit vectors.
    f0, f1, b0, b1 = np.ones(total), np.ones(total), np.ones(total), np.ones(total)
    log_z = np.zeros(n_chains)
    live, k = np.arange(n_chains), 0
    v0, v1 = np.ones(n_chains), np.ones(n_chains)
    while len(live):
        at = first[live] + k
        f0[at], f1[at] = v0, v1
        w0, w1 = v0 * p[0][at] + v1 * p[2][at], v0 * p[1][at] + v1 * p[3][at]
        s = w0 + w1
        log_z[live] += np.log(s) + log_p[at]
        k += 1
        more = stretches[live] > k
        live, v0, v1 = live[more], (w0 / s)[more], (w1 / s)[more]
    live, k = np.arange(n_chains), 1
    v0, v1 = np.ones(n_chains), np.ones(n_chains)
    while len(live):
        at = first[live] + stretches[live] - k
        b0[at], b1[at] = v0, v1
        w0, w1 = p[0][at] * v0 + p[1][at] * v1, p[2][at] * v0 + p[3][at] * v1
        s = w0 + w1
        more = stretches[live] > k
        live, v0, v1 = live[more], (w0 / s)[more], (w1 / s)[more]
        k += 1
    # Inside again: forward vectors kept, then backward with marginals.
    alpha = np.empty((STRETCH + 1, 2, total))
    alpha[0, 0], alpha[0, 1] = f0, f1
    for t in range(STRETCH):
        a = steps(t)
        x, y = alpha[t, 0] * a[0] + alpha[t, 1] * a[2], alpha[t, 0] * a[1] + alpha[t, 1] * a[3]
        s = x + y
        alpha[t + 1, 0], alpha[t + 1, 1] = x / s, y / s
    grid_p = np.zeros((STRETCH, total))
    expected = np.zeros((2, 2))
    for t in range(STRETCH - 1, -1, -1):
        a = steps(t)
        z = alpha[t + 1, 0] * b0 + alpha[t + 1, 1] * b1
        grid_p[t] = alpha[t + 1, 1] * b1 / z
        pair = [alpha[t, i] * a[2 * i + j] * (b1 if j else b0) for i in (0, 1) for j in (0, 1)]
        s = pair[0] + pair[1] + pair[2] + pair[3]
        on = real[t] & ~(start & (t == 0))
        expected += np.array([(x / s)[on].sum() for x in pair]).reshape(2, 2)
        n0, n1 = a[0] * b0 + a[1] * b1, a[2] * b0 + a[3] * b1
        s = n0 + n1
        b0, b1 = n0 / s, n1 / s
    # A chain's entry vector is (1, 1), the first step diagonal: its sum is the start's partition.
    return grid_p[row, col], expected, float(log_z.sum() + top.sum())


@dataclass
class Tagger:
    """Weights of a trained field, and the map from a document's marginals to its score."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    score: np.ndarray

    def odds(self, word: str) -> float:
        return self.odds_of([word])[0]

    def odds_of(self, words: list[str]) -> list[float]:
        """Log odds of each word: the weights of its features, summed for all words at once."""
        slots = [_slots(w) for w in words]
        starts = np.cumsum([0, *[len(s) for s in slots[:-1]]])
        return (np.add.reduceat(self.weights[[s for own in slots for s in own]], starts) + self.bias).tolist()

    def document_features(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each document: expected toxic tokens, their chance to be any, the largest marginal."""
        some = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[some]
        out = np.zeros((len(lengths), 4))
        out[:, 0] = 1.0
        if len(some):
            out[some, 1] = np.log1p(np.add.reduceat(p, starts))
            out[some, 2] = 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), starts))
            out[some, 3] = np.maximum.reduceat(p, starts)
        return out

    def scores(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.document_features(p, lengths) @ self.score)))


def without_copies(texts: list[np.ndarray]) -> list[int]:
    """Places of texts, given as their words' hashes, that aren't near copies of earlier ones: of eight minima over runs of three words, four met before."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, w in enumerate(texts):
        w = np.concatenate([w, np.zeros(max(0, 3 - len(w)), np.uint64)])
        h = (w[:-2] * np.uint64(31) + w[1:-1]) * np.uint64(31) + w[2:]
        h ^= h >> np.uint64(17)
        minima = [(k, int((h * np.uint64(2654435761 + 2 * k) % np.uint64(4294967291)).min())) for k in range(8)]
        if sum(m in seen for m in minima) < 4:
            out.append(i)
            seen.update(minima)
    return out


def weak_lexicon(documents: list[np.ndarray], y: np.ndarray, features: list[np.ndarray], least: float = 16.0) -> np.ndarray:
    """Which of MARKS hashed features mark toxic documents: in ten times the share of toxic ones at least, with a G-test of ``least``.

    ``documents``: the numbers of each one's distinct words; ``features``: each word's slots.
    """
    n = [int((y == 0).sum()), int((y == 1).sum())]
    count = np.zeros((2, MARKS), np.int32)
    for words, label in zip(documents, y, strict=True):
        if len(words):
            count[int(label), np.unique(np.concatenate([features[w] for w in words.tolist()]))] += 1
    met = np.flatnonzero(count[1] >= 3)
    a, b = (count[k, met].astype(float) for k in (1, 0))
    share = n[1] / max(1, n[0] + n[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (a * np.log(a / ((a + b) * share)) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0))
        marks = np.zeros(MARKS, bool)
        marks[met] = (g >= least) & (a / n[1] >= 10 * (b + 0.25) / n[0])
    return marks


def train_tagger(texts: list[str], y: np.ndarray, prior: float, rounds: int = 60, l2: float = 1e-3) -> Tagger:
    """Fit the field on tokens labelled from document labels, then the score on its marginals.

    A token is labelled toxic if it stands in a toxic document and has a
    feature that marks such documents. The field's likelihood is raised by
    Adam over all tokens of the sample; the map to a score is a logistic
    regression, its intercept moved to the share ``prior`` of toxic labels.
    """
    vocabulary: dict[str, int] = {}
    words = [[vocabulary.setdefault(w, len(vocabulary)) for w in t.split()] for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((w for ws in words for w in ws), np.int32, int(lengths.sum()))
    del words
    hashed = [np.array([zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in word_features(w)], np.uint32) for w in vocabulary]
    n_words = len(hashed)
    crc = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in vocabulary], np.uint64)
    del vocabulary
    slot_word = np.repeat(np.arange(n_words, dtype=np.int32), [len(s) for s in hashed])
    slot_flat = np.concatenate([*hashed, np.zeros(0, np.uint32)])
    ends = np.cumsum(lengths)
    single = without_copies([crc[flat[e - n : e]] for e, n in zip(ends, lengths, strict=True)])
    marks = weak_lexicon([np.unique(flat[ends[i] - lengths[i] : ends[i]]) for i in single], y[single], [h % MARKS for h in hashed])
    del hashed
    marked = np.bincount(slot_word, marks[slot_flat % MARKS], n_words) > 0
    slot_flat = (slot_flat % SIZE).astype(np.int32)
    gold = (marked[flat] & np.repeat(y == 1, lengths)).astype(float) if len(flat) else np.zeros(0)
    # Observed transitions.
    inner = np.ones(len(flat), bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[at - 1].astype(int), gold[at].astype(int)), 1)
    w, bias, moves = np.zeros(SIZE), -4.0, np.zeros((2, 2))
    m1, m2 = np.zeros(SIZE + 5), np.zeros(SIZE + 5)
    n = max(1, len(flat))
    for k in range(1, rounds + 1):
        score = np.bincount(slot_word, w[slot_flat], n_words) + bias
        p, expected, _ = chain_marginals(score[flat], lengths, moves)
        gap = (gold - p) * n**-0.5
        by_word = np.bincount(flat, gap, n_words)
        g = np.concatenate([np.bincount(slot_flat, by_word[slot_word], SIZE) - l2 * w, [gap.sum()], ((seen - expected) * n**-0.5 - l2 * moves).reshape(-1)])
        m1 = 0.8 * m1 + 0.2 * g
        m2 = 0.98 * m2 + 0.02 * g * g
        step = 0.3 * (m1 / (1 - 0.8**k)) / (np.sqrt(m2 / (1 - 0.98**k)) + 1e-6)
        w, bias, moves = w + step[:SIZE], bias + step[SIZE], np.clip(moves + step[SIZE + 1 :].reshape(2, 2), -6, 6)
    tagger = Tagger(w, float(bias), moves, np.zeros(4))
    score = np.bincount(slot_word, w[slot_flat], n_words) + bias
    p, _, _ = chain_marginals(score[flat], lengths, moves)
    x = tagger.document_features(p, lengths)
    c = np.zeros(4)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ c))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-6, 0.05, 0.05, 0.05])
        c = c + np.linalg.solve(h, x.T @ (y - q) - np.array([0, 0.05, 0.05, 0.05]) * c)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    c[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    tagger.score = c
    return tagger


TOKEN = re.compile(r"\S+")


def tag_documents(docs: DataFrame, tagger: Tagger, spans: bool = True, least: float = 0.5) -> DataFrame:
    """``docs`` with ``score double`` (0 to 1) and ``spans array<struct<start, end, p>>``.

    Spans are the tokens whose marginal is ``least`` or more, as code point
    offsets into the text; neighbours are joined, p being the largest. Null
    and empty texts have no span and the score of a text without toxic
    tokens. Texts of any length are tagged whole. Columns already so called
    are replaced; all others pass through. Rows that repeat a doc_id, or have
    none, are tagged each by their own text. An empty table gives an empty
    table.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(tagger)
    added = ["score", *["spans"] * spans]
    kinds = {"score": T.DoubleType(), "spans": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))}
    others = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in others]
    schema = T.StructType([*others, *[T.StructField(n, kinds[n]) for n in added]])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def found(text: str, p: np.ndarray) -> list[dict]:
        out: list[dict] = []
        hot = set(np.flatnonzero(p >= least).tolist())
        if hot:
            last = -2
            for i, m in enumerate(TOKEN.finditer(text)):
                if i in hot:
                    if i == last + 1:
                        out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[i]))}
                    else:
                        out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
                    last = i
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        known = Remembered(24 << 20)
        for whole in batches:
            for batch in _slices(whole, "text", 1 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                words = [TOKEN.findall(t) for t in texts]
                known.make_room()
                new = list(set().union(*words).difference(known))
                for w, o in zip(new, field.odds_of(new) if new else (), strict=True):
                    known.add(w, o)
                lengths = np.array([len(w) for w in words], np.int64)
                odds = np.fromiter((o for ws in words for o in map(known.__getitem__, ws)), np.float64, int(lengths.sum()))
                p, _, _ = chain_marginals(odds, lengths, field.moves)
                columns = [batch.column(n) for n in names] + [pa.array(field.scores(p, lengths))]
                if spans:
                    ends = np.cumsum(lengths)
                    columns.append(pa.array([found(t, p[e - n : e]) for t, e, n in zip(texts, ends, lengths, strict=True)], span_type))
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return docs.mapInArrow(run, schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 2400, most_bytes: int = 12 << 20) -> Tagger:
    """A tagger from at most ``bound`` labelled documents of ``most_bytes`` of text, half of them toxic. No labels at all: scores near 0."""
    share = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).agg(F.avg("toxic").alias("p")).first()["p"]
    sample = labelled_sample(docs, labels, "toxic", bound, balanced=True, most_bytes=most_bytes)
    if not len(sample):
        return Tagger(np.zeros(SIZE), -8.0, np.zeros((2, 2)), np.array([-6.0, 0, 0, 0]))
    return train_tagger(sample["text"].tolist(), sample["y"].to_numpy(), float(share or 0.0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tagger = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = tag_documents(docs, tagger)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
