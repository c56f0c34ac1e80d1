"""Near-duplicate documents: MinHash bands, odd sketches, exact Jaccard, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.shared import materialize, scratch
from .pieces import _slices
from .remembered import Remembered


class _WordHashes(Remembered):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        self.make_room()
        h = xxhash.xxh3_64_intdigest(word)
        self.add(word, h)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], words: _WordHashes, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: A-Z lower-cased, words parted by ASCII white space.

    Fewer words than ``width``: all of them as one shingle. None: an empty set.
    """
    split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((words[w] for ws in split for w in ws), np.uint64, int(sizes.sum()))
    n = len(flat)
    step = np.uint64(0x9E3779B97F4A7C15)
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width if len(whole) else 0):
        whole = (whole + flat[k : n - width + 1 + k]) * step
        whole ^= whole >> np.uint64(29)
    out, at = [], 0
    for size in sizes.tolist():
        if size >= width:
            out.append(np.unique(whole[at : at + size - width + 1]))
        elif size:
            h = np.uint64(size)
            for w in flat[at : at + size]:
                h = _mix(np.array([h ^ w]))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


class Sketcher:
    """MinHash samples of shingle sets, their band keys, and odd sketches of the samples.

    With ``rows`` samples a band and ``bands`` bands, two sets of similarity s
    share no band with probability ``(1 - s**rows) ** bands``: 5e-6 at 0.75
    with 4 and 32.
    """

    def __init__(self, bands: int = 32, rows: int = 4, bits: int = 512, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.k = bands * rows
        self.mul = rng.integers(0, 2**32, self.k, np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 2**32, self.k, np.uint32)
        self.salt = rng.integers(0, 2**63, self.k, np.uint64)

    def samples(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of ``k`` minima for each set; all sets must hold something."""
        if not sets:
            return np.zeros((0, self.k), np.uint32)
        flat = _mix(np.concatenate(sets))
        low = (flat >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
        out = np.empty((len(sets), self.k), np.uint32)
        for i in range(self.k):
            x = low * self.mul[i]
            x += self.add[i]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[:, i] = np.minimum.reduceat(x, starts)
        return out

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        keys = np.empty((len(samples), self.bands), np.uint64)
        for b in range(self.bands):
            h = np.full(len(samples), b + 1, np.uint64)
            for r in range(self.rows):
                h = _mix(h ^ samples[:, b * self.rows + r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            keys[:, b] = h
        return keys.view(np.int64)

    def odd_sketches(self, samples: np.ndarray) -> np.ndarray:
        """Each (place, sample) flips one bit of the bitmap: samples that two sets share cancel out under XOR."""
        where = _mix(samples.astype(np.uint64) ^ self.salt[None, :]) % np.uint64(self.bits)
        bitmap = np.zeros((len(samples), self.bits), np.uint8)
        row = np.repeat(np.arange(len(samples)), self.k)
        np.bitwise_xor.at(bitmap, (row, where.reshape(-1).astype(np.int64)), 1)
        return np.packbits(bitmap, axis=1)

    def most_odd(self, similarity: float, sigmas: float = 5.0) -> int:
        """The XOR population count that a pair of ``similarity`` or more stays under, but for ``sigmas`` deviations.

        Unlike samples are binomial, k(1 - s) on average; each flips two bits
        of the XOR; m flips over n bits leave n(1 - exp(-2m / n)) / 2 set. At
        5 deviations one pair in three million at the very limit is missed.
        """
        n, k = self.bits, self.k
        m = 2 * k * (1 - similarity)
        fade = np.exp(-2 * m / n)
        spread = (fade**2 * 4 * k * similarity * (1 - similarity) + n * (1 - fade**2) / 4) ** 0.5
        return int(n * (1 - fade) / 2 + sigmas * spread) + 1


def sketch_documents(docs: DataFrame, sketcher: Sketcher, width: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, d1, d2, bands, odd)``; d1 and d2 are the same for equal sets only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for whole in batches:
            for batch in _slices(whole, "text"):
                sets = shingle_sets(batch.column("text").to_pylist(), words, width)
                full = [s for s in sets if len(s)]
                samples = sketcher.samples(full)
                at = iter(range(len(full)))
                place = [next(at) if len(s) else None for s in sets]
                keys, odd = sketcher.band_keys(samples), sketcher.odd_sketches(samples)
                d1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                d2 = [int(_mix(s ^ np.uint64(0x5EED)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())]
                columns.append(pa.array([None if p is None else keys[p] for p in place], pa.list_(pa.int64())))
                columns.append(pa.array([None if p is None else odd[p].tobytes() for p in place], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "bands", "odd"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, odd binary")


#: Bits of the parity bitmap of a whole set.
FOLD = 4096


def folded(sets: list[np.ndarray]) -> np.ndarray:
    """The parity bitmap of each whole set: an odd sketch whose samples are all shingles."""
    bitmap = np.zeros((len(sets), FOLD), np.uint8)
    for i, s in enumerate(sets):
        bitmap[i] = np.bincount((_mix(s) % np.uint64(FOLD)).astype(np.int64), minlength=FOLD) & 1
    return np.packbits(bitmap, axis=1)


def most_folded(sizes: np.ndarray, percent: int, sigmas: float = 5.0) -> np.ndarray:
    """For pairs with so many shingles in both sets together: the XOR count that similar pairs stay under.

    A similarity of s leaves sizes * (1 - s) / (1 + s) shingles unlike at
    most; mean and variance are those of the parities of as many balls in
    FOLD bins. Far more balls than bins tell nothing: then every pair passes.
    """
    n, s = float(FOLD), percent / 100
    balls = np.asarray(sizes, float) * (1 - s) / (1 + s)
    p2, p4 = (1 - 2 / n) ** balls, (1 - 4 / n) ** balls
    spread = np.sqrt(np.maximum(0.0, n + n * (n - 1) * p4 - n * n * p2 * p2)) / 2
    return n * (1 - p2) / 2 + sigmas * spread + 1


def shingle_table(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, shingles array<long>, n_shingles, fold)``: the full sets and their parity bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for whole in batches:
            for batch in _slices(whole, "text"):
                sets = shingle_sets(batch.column("text").to_pylist(), words, width)
                ends = np.cumsum([0, *map(len, sets)])
                flat = pa.array(np.concatenate(sets).view(np.int64)) if sets else pa.array([], pa.int64())
                fold = pa.array([f.tobytes() for f in folded(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat), pa.array(np.diff(ends)), fold], ["doc_id", "shingles", "n_shingles", "fold"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>, n_shingles long, fold binary")


def odd_filter(pairs: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sketches differ in at most ``most`` bits, with that count as ``odd``.

    The count is made in Arrow batches: 64 bytes a side, XOR and population count.
    """
    one = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("odd").alias("oa")), "a")
    both = one.join(sketches.select(F.col("doc_id").alias("b"), F.col("odd").alias("ob")), "b").select("a", "b", "oa", "ob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("oa", "ob"))
            odd = np.bitwise_count(left ^ right).sum(1).astype(np.int32)
            near = np.flatnonzero(odd <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(near), batch.column("b").take(near), pa.array(odd[near])], ["a", "b", "odd"])

    return both.mapInArrow(run, "a long, b long, odd int")


def close_across(placed: DataFrame, sets: DataFrame, percent: int, best: int | None, block: int = 1024) -> DataFrame:
    """Pairs ``(a, b, odd)`` that share a bucket, lie in different parts and may be similar by size and parity bitmap.

    ``placed``: ``(key, doc_id, part)``. Buckets of one part cost nothing
    more. The bitmaps of a bucket meet in Arrow tasks, ``block`` rows against
    ``block`` rows, larger buckets in several such meetings; what doesn't
    pass is never emitted. ``best``: only so many closest partners of a row
    and meeting; None: all.
    """
    mixed = materialize(placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"), "mixed")
    rows = materialize(placed.join(mixed, "key"), "across")
    rows = rows.join(sets.select("doc_id", "n_shingles", "fold"), "doc_id")
    many = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), many).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    rows = rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "doc_id", "part", "n_shingles", "fold")

    def meet(table: pa.Table) -> pa.Table:
        ids, part, size, own = (table.column(c).to_numpy() for c in ("doc_id", "part", "n_shingles", "own"))
        sketch = np.frombuffer(b"".join(table.column("fold").to_pylist()), np.uint64).reshape(len(ids), -1)
        alone = (own == own[0]).all() and table.column("p")[0] != table.column("q")[0]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not alone and (part != part[0]).any():
            inside = table.column("p")[0] == table.column("q")[0]
            for k in range(0, len(ids), 64):
                at = slice(k, k + 64)
                fits = (part[at, None] != part[None, :]) & (100 * np.minimum(size[at, None], size[None, :]) >= percent * np.maximum(size[at, None], size[None, :]))
                if not inside:
                    fits &= own[at, None] != own[None, :]
                if best is None:
                    fits &= ids[at, None] < ids[None, :]
                x, y = np.nonzero(fits)
                odd = np.concatenate([np.bitwise_count(sketch[x[c : c + 65536] + k] ^ sketch[y[c : c + 65536]]).sum(1, dtype=np.int32) for c in range(0, len(x), 65536)] or [np.zeros(0, np.int32)])
                near = np.flatnonzero(odd <= most_folded(size[x + k] + size[y], percent))
                x, y, odd = x[near], y[near], odd[near]
                if best is not None:
                    order = np.lexsort((y, odd, x))
                    x, y, odd = x[order], y[order], odd[order]
                    rank = np.arange(len(x)) - np.searchsorted(x, x)
                    x, y, odd = x[rank < best], y[rank < best], odd[rank < best]
                out.append((ids[x + k], ids[y], odd))
        a, b, odd = (np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in range(3))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "odd": odd.astype(np.int32)})

    found = rows.groupBy("key", "p", "q").applyInArrow(meet, "a long, b long, odd int")
    return found.groupBy("a", "b").agg(F.first("odd").alias("odd"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs whose full sets have ``100 * |intersection| >= percent * |union|``."""
    one = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = one.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    both = both.where((F.size("sa") * 100 >= F.size("sb") * percent) & (F.size("sb") * 100 >= F.size("sa") * percent))
    return both.withColumn("n", shared).where(F.col("n") * 100 >= (F.size("sa") + F.size("sb") - F.col("n")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, sketcher: Sketcher | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    1. Every text gets its shingle set's digest, MinHash band keys and odd
       sketch. Equal sets become one class, named by its smallest doc_id.
    2. Classes that share a band key form a bucket. Each class is first
       compared with the bucket heads (smallest ids) it meets, best odd
       sketch only, on full sets. That gives components without all pairs.
       The classes of an id that has several texts are linked through it.
    3. In buckets that still hold several components, parity bitmaps of the
       full sets are compared across components, and the closest few partners
       of each class on full sets; then, across the components that still
       stand apart, all pairs that the bitmaps let through. Pairs inside a component need no look:
       they can't change it. So no link between candidates is lost, and a
       group of thousands of copies costs its size.

    Null, empty and blank texts have the empty set and are linked with
    nothing. A row without doc_id has no component and is kept. Rows that
    repeat a doc_id are one document, linked through any of their texts. Ties
    cannot occur: components are named by the smallest id. Empty table: empty
    result. Further columns are not looked at.
    """
    sk = sketcher or Sketcher()
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    with scratch():
        sigs = materialize(sketch_documents(docs, sk, width), "sketches", kept=True)
        some = sigs.where("n_shingles > 0 and doc_id is not null")
        classes = some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
        classes = materialize(classes, "classes")

        rows = classes.select(F.explode("bands").alias("key"), "doc_id")
        heads = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("key", "head"), "heads")
        members = materialize(rows.join(heads, "key"), "members")

        most = sk.most_odd(percent / 100)
        stars = members.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
        best = odd_filter(stars, classes, most).groupBy("b").agg(F.min_by("a", F.struct("odd", "a")).alias("a")).select("a", "b")  # a < b
        best = materialize(best, "best")
        needed = members.select("doc_id").distinct()
        sets = materialize(shingle_table(docs.join(needed, "doc_id", "left_semi"), width), "sets")
        digest = F.struct("d1", "d2", "n_shingles")
        several = some.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("doc_id")
        own = some.join(materialize(several, "several"), "doc_id").select("doc_id", "d1", "d2", "n_shingles")
        own = own.join(classes.select("d1", "d2", "n_shingles", F.col("doc_id").alias("a")), ["d1", "d2", "n_shingles"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
        links = materialize(verified(best, sets, percent).unionByName(own).distinct(), "links")
        tried = best
        parts = connected_components(links)

        for nearest in (4, None):
            placed = members.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("part"))
            rest = close_across(materialize(placed, "placed"), sets, percent, nearest)
            rest = materialize(rest.join(tried, ["a", "b"], "left_anti").select("a", "b"), "rest")
            links = materialize(links.unionByName(verified(rest, sets, percent)).distinct(), "links")
            parts = connected_components(links)
            tried = materialize(tried.unionByName(rest), "tried")

        named = classes.select("d1", "d2", "n_shingles", "doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        named = materialize(named, "named", kept=True)
    out = sigs.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS_SQL = """
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM {docs}
),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)
)"""

_NEAR_SQL = """
sizes AS (SELECT d.doc_id, count(s.s) AS n FROM {docs} d LEFT JOIN shingles s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * common.n >= 75 * (p.n + q.n - common.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""

OP6_SQL = "WITH RECURSIVE" + (_WORDS_SQL + "," + _NEAR_SQL).format(docs="documents") + " SELECT s.doc_id, s.n AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sizes s JOIN parts p ON s.doc_id = p.doc_id"
