"""A written index for searches inside texts: posting lists of trigrams, and the texts in chunks beside them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import discard, materialize, shared_dir

#: Length of what is indexed. Shorter terms are looked for in all texts.
GRAM = 3


def plain(c: Column) -> Column:
    """A text as terms are compared with it."""
    return F.replace(F.lower(c), F.lit("_"), F.lit(" "))


def terms_of(query: str) -> list[str]:
    """The terms of a search: between commas, lower case, one space between words."""
    return [t for t in (" ".join(p.lower().replace("_", " ").split()) for p in query.split(",")) if t]


def source_key(df: DataFrame) -> str:
    """A fingerprint of the files that a table is read from: another one when any of them is new, gone, or written again."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    k = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*files.columns)), F.lit(0)).alias("x"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("s")).first()
    return f"{k['n']}-{k['s']}-{k['x'] & (2**64 - 1):016x}"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(gram, chunk, n, deltas)``: the rows of each batch that hold a gram, as ascending ids in differences."""
    for whole in batches:
        at = 0
        sizes = np.cumsum(pc.binary_length(whole.column("text")).to_numpy().astype(np.int64))
        while at < whole.num_rows:  # about two megabytes at a time, of one chunk
            chunk = whole.column("chunk")[at].as_py()
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 21), "right")))
            same = whole.column("chunk").slice(at, end - at).to_numpy() == chunk
            end = at + (int(np.argmin(same)) if not same.all() else len(same))
            batch, at = whole.slice(at, end - at), end
            batch = batch.take(np.argsort(batch.column("id").to_numpy(), kind="stable"))
            texts = batch.column("text").to_pylist()
            codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
            if len(codes) < GRAM:
                continue
            lengths = np.array([len(t) + 1 for t in texts])
            letters, met, row = _met(codes, np.repeat(np.arange(len(texts)), lengths)[: len(codes) - GRAM + 1], len(texts))
            if not len(met):
                continue
            starts = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
            sizes_of = np.diff(np.append(starts, len(met)))
            grams = letters(met[starts]).astype(np.uint32).tobytes().decode("utf-32-le")
            columns = [pa.array([grams[k : k + GRAM] for k in range(0, len(grams), GRAM)]), pa.array(np.full(len(starts), chunk, np.int32)), pa.array(sizes_of.astype(np.int32)), _lists(batch.column("id").to_numpy()[row], starts)]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "chunk", "n", "deltas"])


def _met(codes: np.ndarray, owner: np.ndarray, rows: int):
    """Each gram of a row once, ``(letters, gram, row)`` by gram and row; grams are numbers that ``letters`` takes back to code points.

    Letters are numbered as they occur, so that gram and row mostly fit one
    number of 63 bits: one sort finds all. Of texts with too many different letters
    the grams are numbered first.
    """
    used = np.zeros(0x110000, bool)
    used[codes] = True
    alphabet = np.flatnonzero(used)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    one, wide = number[codes], max(1, int(len(alphabet) - 1).bit_length())
    gram = (one[:-2] << wide | one[1:-1]) << wide | one[2:]
    line = codes == 10  # between rows and between a row's fields
    inside = ~(line[:-2] | line[1:-1] | line[2:])
    gram, owner, every, places = gram[inside], owner[inside], None, max(1, int(rows - 1).bit_length())
    if GRAM * wide + places > 63:
        every, gram = np.unique(gram, return_inverse=True)
    both = np.sort(gram << places | owner)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both

    def letters(grams: np.ndarray) -> np.ndarray:
        grams = grams if every is None else every[grams]
        return alphabet[np.stack([grams >> 2 * wide, grams >> wide & (1 << wide) - 1, grams & (1 << wide) - 1], 1)]

    return letters, both >> places, both & (1 << places) - 1


def _lists(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of ascending ids, each from one of ``starts`` to the next: the first id, the width of a difference in bytes, and the differences."""
    ends = np.append(starts[1:], len(ids))
    step = np.append(0, np.diff(ids))
    step[starts] = 0
    largest = np.maximum.reduceat(step, starts)
    width = np.select([largest < 1 << 8, largest < 1 << 16, largest < 1 << 32], [1, 2, 4], 8)
    at = np.append(0, np.cumsum(9 + width * (ends - starts - 1)))
    out = np.zeros(at[-1], np.uint8)
    out[at[:-1, None] + np.arange(8)] = ids[starts].astype("<i8").view(np.uint8).reshape(-1, 8)
    out[at[:-1] + 8] = width
    of = np.repeat(np.arange(len(starts)), ends - starts)
    place = np.arange(len(ids)) - starts[of] - 1
    for w in (1, 2, 4, 8):
        here = np.flatnonzero((width[of] == w) & (place >= 0))
        if len(here):
            out[(at[of[here]] + 9 + w * place[here])[:, None] + np.arange(w)] = step[here].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])


def _packed(ids: np.ndarray) -> bytes:
    return _lists(ids, np.zeros(1, np.int64))[0].as_py()


def _unpacked(raw: bytes) -> np.ndarray:
    first, width = int.from_bytes(raw[:8], "little", signed=True), raw[8]
    return np.cumsum(np.append(np.int64(first), np.frombuffer(raw, f"<u{width}", offset=9).astype(np.int64)))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")


class SearchIndex:
    """Three tables in a folder.

    ``texts(id, text, chunk)`` holds what is searched, a row's fields on lines of
    their own, in chunks as the rows came. ``postings(gram, chunk, n, deltas,
    bucket)`` holds for each trigram the ids that have it, in pieces of some
    hundred rows each, so that no list of a frequent trigram is one row; it is
    bucketed and sorted by trigram, so that a look-up reads a few row groups
    of one bucket. ``counts(gram, n)`` says how many rows have each.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.texts = spark.read.schema("id long, text string, chunk int").parquet(f"{path}/texts")
        self.postings = spark.read.schema("gram string, chunk int, n int, deltas binary, bucket int").parquet(f"{path}/postings")
        self.counts = spark.read.schema("gram string, n long").parquet(f"{path}/counts")
        self.buckets = int(spark.read.schema("buckets int").parquet(f"{path}/made").first()["buckets"])

    @classmethod
    def build(cls, rows: DataFrame, path: str, buckets: int | None = None) -> SearchIndex:
        """Index ``rows(id, fields array<string>)``; null fields and rows without id are left out.

        The rows' own partitions are the chunks, so texts are not shuffled; as many
        buckets as Spark has shuffle partitions, if nothing else is said.
        """
        spark = rows.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        lines = F.coalesce(F.array_join(F.transform("fields", plain), "\n"), F.lit(""))
        texts = rows.where("id is not null").select(F.col("id").cast("long"), lines.alias("text")).withColumn("chunk", F.spark_partition_id())
        texts.write.mode("overwrite").option("compression", "zstd").partitionBy("chunk").parquet(f"{path}/texts")
        texts = spark.read.schema("id long, text string, chunk int").parquet(f"{path}/texts")
        lists = texts.mapInArrow(_grams, "gram string, chunk int, n int, deltas binary").withColumn("bucket", _bucket(buckets))
        lists = lists.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram", "chunk")
        lists.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        lists = spark.read.schema("gram string, chunk int, n int, deltas binary, bucket int").parquet(f"{path}/postings")
        lists.groupBy("gram").agg(F.sum("n").alias("n")).sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")
        spark.range(1, numPartitions=1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/made")  # last: the index is whole
        return cls(spark, path)

    @classmethod
    def at(cls, spark: SparkSession, key: str, rows) -> SearchIndex:
        """The index in the shared folder whose sources have fingerprint ``key``; built from ``rows()`` where there is none yet."""
        path = f"{shared_dir(spark)}/mediarill-search-{key}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/made/_SUCCESS")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return cls(spark, path)
        return cls.build(rows(), path)

    def drop(self) -> None:
        discard(self.texts.sparkSession, self.path)

    def candidates(self, term: str, rarest: int = 4) -> DataFrame:
        """``(id, chunk)`` of the rows that have the ``rarest`` trigrams of ``term``; all that hold the term are among them."""
        grams = sorted({term[k : k + GRAM] for k in range(len(term) - GRAM + 1)})
        counts = self.counts.where(F.col("gram").isin(grams)).select("gram", "n", _bucket(self.buckets).alias("b"))
        found = {r["gram"]: (r["n"], r["b"]) for r in counts.collect()}  # as many as the term has
        picked = sorted(grams, key=lambda g: (found.get(g, (0, 0))[0], g))[:rarest]
        buckets = sorted({found[g][1] for g in picked if g in found})
        lists = self.postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(picked))

        def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [_unpacked(x) for x in batch.column("deltas").to_pylist()]
                size = [len(x) for x in ids]
                if size:
                    bit = np.array([1 << picked.index(g) for g in batch.column("gram").to_pylist()], np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.repeat(batch.column("chunk").to_numpy(), size)), pa.array(np.repeat(bit, size))], ["id", "chunk", "bit"])

        met = lists.select("gram", "chunk", "deltas").mapInArrow(unfold, "id long, chunk int, bit int").groupBy("id", "chunk").agg(F.bit_or("bit").alias("met"))
        return met.where(F.col("met") == (1 << len(picked)) - 1).select("id", "chunk")

    def hits(self, query: str) -> DataFrame | None:
        """``(id)`` of the rows with each comma-separated term in one of their fields; None if nothing is asked.

        Terms of three characters and more narrow the rows down by the postings, the
        texts of those rows alone are compared with all terms, and only chunks
        that hold such a row are read: their numbers come to the driver,
        as many as the index has folders. If all terms are shorter, all
        texts are compared.
        """
        terms = terms_of(query)
        if not terms:
            return None
        texts, found = self.texts, None
        for term in sorted({t for t in terms if len(t) >= GRAM}):
            more = self.candidates(term)
            found = more if found is None else found.join(more, ["id", "chunk"], "left_semi")
        if found is not None:
            found = materialize(found, "found")
            chunks = [r["chunk"] for r in found.select("chunk").distinct().collect()]
            texts = texts.where(F.col("chunk").isin(chunks)).join(found, ["id", "chunk"], "left_semi")
        return texts.where(reduce(and_, [F.col("text").contains(t) for t in terms])).select("id")

    def search(self, df: DataFrame, query: str) -> DataFrame:
        """P5 by the index: the rows of ``df`` that ``hits`` names; all, if nothing is asked."""
        hits = self.hits(query)
        return df if hits is None else df.join(hits, "id", "left_semi")
