"""Token ids in binary shard files with Elias-Fano coded document boundaries."""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize, new_path
from .pieces import _slices
from .remembered import Remembered

MAGIC = b"MRTOK001"


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about ``2 + log2(u / n)`` bits each.

    Low bits are packed; high bits are a bitmap with one set bit for each
    value, at (high part + index). Every ``STEP``-th set bit's place is kept,
    so that ``select`` scans a few words only.
    """

    STEP = 512

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, run: int = 1 << 16) -> EliasFano:
        """Encoded ``run`` values at a time, so that beside the values only their code is held."""
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        top = int(values[-1])
        width = max(0, (top // n).bit_length() - 1) if top >= n else 0
        words = np.zeros(((top >> width) + n - 1) // 64 + 1, np.uint64)
        low, samples = [], []
        for a in range(0, n, run):  # a run's low bits end with a byte
            v = np.asarray(values[a : a + run], np.uint64)
            at = (v >> np.uint64(width)) + np.arange(a, a + len(v), dtype=np.uint64)
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low.append(np.packbits(bits.reshape(-1), bitorder="little"))
            samples.append(at[:: cls.STEP].copy())
        return cls(n, width, np.concatenate(low), words, np.concatenate(samples))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i[:, None].astype(np.int64) * self.width + np.arange(self.width)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value ``i``, by the nearest kept place and a scan of the words behind it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // self.STEP])
        left, word = i % self.STEP, at >> 6
        bits = int(self.high[word]) >> (at & 63) << (at & 63)
        while (c := bits.bit_count()) <= left:
            left -= c
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        at = word * 64 + (bits & -bits).bit_length() - 1
        return (at - i) << self.width | int(self._low(np.array([i]))[0])

    def select_run(self, a: int, b: int) -> np.ndarray:
        """Values ``a`` up to ``b``, from the words between the kept places around them."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, np.int64)
        word = int(self.samples[a // self.STEP]) >> 6
        behind = (b - 1) // self.STEP + 1
        last = int(self.samples[behind]) >> 6 if behind < len(self.samples) else len(self.high) - 1
        at = np.flatnonzero(np.unpackbits(self.high[word : last + 1].view(np.uint8), bitorder="little")) + 64 * word
        at = at[at >= int(self.samples[a // self.STEP])][a % self.STEP :][: b - a]
        i = np.arange(a, b)
        return (at - i) << self.width | self._low(i).astype(np.int64)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.width, len(self.low), len(self.high), len(self.samples)], "<u8").tobytes()
        return head + self.high.astype("<u8").tobytes() + self.samples.astype("<u8").tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, width, n_low, n_high, n_samples = (int(x) for x in np.frombuffer(raw, "<u8", 5))
        high = np.frombuffer(raw, "<u8", n_high, 40)
        samples = np.frombuffer(raw, "<u8", n_samples, 40 + 8 * n_high)
        return cls(n, width, np.frombuffer(raw, np.uint8, n_low, 40 + 8 * (n_high + n_samples)), high, samples)


class ShardWriter:
    """One shard: magic, ids, coded boundaries, coded doc ids, a JSON footer, its length, magic.

    Ids stream to the file as they come; only one number a document is held.
    Documents come in ascending doc_id; those without one come first.
    """

    def __init__(self, stream, id_type: str):
        self.stream, self.id_type, self.ends, self.doc_ids, self.n_null, self.n_ids = stream, id_type, [], [], 0, 0
        stream.write(MAGIC)

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.stream.write(ids.astype(self.id_type).tobytes())
        self.ends.append(self.n_ids + np.cumsum(lengths))
        self.n_ids += len(ids)
        self.n_null += sum(d is None for d in doc_ids)
        self.doc_ids.append(np.array([d for d in doc_ids if d is not None], np.int64))

    def close(self) -> None:
        ends = np.concatenate([np.zeros(1, np.int64), *self.ends])
        self.ends.clear()
        starts = EliasFano.encode(ends).to_bytes()
        del ends
        docs = np.concatenate([*self.doc_ids, np.zeros(0, np.int64)])
        self.doc_ids.clear()
        first = int(docs[0]) if len(docs) else 0
        docs -= first  # differences of 64-bit ids, read without sign
        names = EliasFano.encode(docs.view(np.uint64)).to_bytes()
        del docs
        foot = json.dumps({"ids": self.id_type, "n_ids": self.n_ids, "starts": len(starts), "names": len(names), "first": first, "n_null": self.n_null}).encode()
        self.stream.write(starts + names + foot + np.array([len(foot)], "<u4").tobytes() + MAGIC)
        self.stream.close()


class ShardReader:
    """Random access to a shard through a seekable file."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 12)
        n_foot, magic = int(np.frombuffer(file.read(4), "<u4")[0]), file.read(8)
        file.seek(0)
        if magic != MAGIC or file.read(8) != MAGIC:
            raise ValueError("not a token shard")
        file.seek(size - 12 - n_foot)
        foot = json.loads(file.read(n_foot))
        self.id_type, self.n_ids, self.n_null = np.dtype(foot["ids"]), foot["n_ids"], foot["n_null"]
        file.seek(size - 12 - n_foot - foot["names"] - foot["starts"])
        self.starts = EliasFano.from_bytes(file.read(foot["starts"]))
        self._names, self._first = EliasFano.from_bytes(file.read(foot["names"])), foot["first"]
        self.n_docs = self.starts.n - 1

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        """Ids of documents ``a`` up to ``b``; those without one come first."""
        null = max(0, min(b, self.n_null) - a)
        return [None] * null + (self._names.select_run(max(a, self.n_null) - self.n_null, max(b, self.n_null) - self.n_null) + self._first).tolist()

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from place ``a`` up to ``b``."""
        self.file.seek(8 + a * self.id_type.itemsize)
        return np.frombuffer(self.file.read((b - a) * self.id_type.itemsize), self.id_type)

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.starts.select(i), self.starts.select(i + 1))


#: Only these surely part words for the tokenizer; what lies between is encoded by the library.
BETWEEN = re.compile("[^ \t\n\r]+")
#: The tokenizer's own split for lower-case texts of Latin-1 characters (white space has gone between the matches).
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^ \t\n\ra-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: Odd white space, control characters and possible special tokens: such texts take the general way.
ODD = re.compile("[^\t\n\r -~¡-ÿ]|<\\|")


class WordEncoder:
    """The library's ids, word by word, with a memory that is emptied when full.

    Texts of plain Latin-1 characters are lower-cased and split as the
    tokenizer does, so that case and punctuation don't multiply the words;
    new words go to the library many at a time, parted by spaces, and are
    told apart by the tokens that end a word. Other texts go to it in pieces
    between spaces.
    """

    def __init__(self, path: str, memory: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Remembered(memory)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        known = self.known
        known.make_room()
        plain = [not t or not ODD.search(t) for t in texts]
        words = [[] if not t else LATIN.findall(t.lower()) if p else BETWEEN.findall(t) for t, p in zip(texts, plain, strict=True)]
        new = list(set().union(*[w for w, p in zip(words, plain, strict=True) if p]).difference(known))
        if new:
            found = self.tokenizer.encode_batch_fast([" ".join(new[k : k + 256]) for k in range(0, len(new), 256)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            raw = ids.tobytes()
            for w, a, b in zip(new, [0, *(cuts[:-1] * 4).tolist()], (cuts * 4).tolist(), strict=True):
                known.add(w, raw[a:b], b - a)
        rest = list(set().union(*[w for w, p in zip(words, plain, strict=True) if not p]).difference(known))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [], strict=True):
            known.add(w, np.array(e.ids, np.uint32).tobytes(), 4 * len(e.ids))
        tail = np.array([end], np.uint32).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)) + tail, np.uint32) for ws in words]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _open(path: str):
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system, inside


#: Bytes of input, as Spark puts them from the files, for each shard.
SHARD_BYTES = 64 << 20


def _shards(docs: DataFrame) -> int:
    """As many shards as the table's size asks for, and as Spark has shuffle partitions at least; so what a task holds doesn't grow with the table."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:  # no figure at all
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


#: Documents whose boundaries are looked up at a time.
RUN = 4096
MANIFEST = "part int, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, shards: int | None = None, id_type: str = "<u2") -> DataFrame:
    """Write ``docs`` as token shards in ascending doc_id; returns the manifest ``(part, path, n_docs, n_ids)``.

    Rows are dealt out by ranges of doc_id and sorted, then encoded and
    streamed to one file a task. A task that is run again writes a file of
    another name; the manifest, committed by Spark, names the ones that count.
    Null and empty texts hold only the end id. Rows without doc_id come first;
    rows that repeat a doc_id stay, ordered by text. No rows: an empty
    manifest. If ``id_type`` cannot hold the tokenizer's largest id, nothing
    is written and an error raised. ``folder`` must be reachable from every
    machine.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows = rows.repartitionByRange(shards or _shards(rows), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, path, n_docs = _encoder(tokenizer_path), None, "", 0
        largest = max(end_id, len(encoder.ends) - 1)
        if largest > np.iinfo(np.dtype(id_type)).max:
            raise ValueError(f"ids up to {largest} do not fit {id_type}")
        part = TaskContext.get().partitionId()
        for whole in batches:
            for batch in _slices(whole, "text", 4 << 20):
                if writer is None:
                    path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.tok"
                    system, inside = _open(path)
                    system.create_dir(os.path.dirname(inside), recursive=True)
                    writer = ShardWriter(system.open_output_stream(inside), id_type)
                ids = encoder.encode(batch.column("text").to_pylist(), end_id)
                writer.add(batch.column("doc_id").to_pylist(), np.array([len(x) for x in ids], np.int64), np.concatenate(ids))
                n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` from the shards of a manifest.

    ``start`` counts all ids of the documents before, over all shards: a
    running sum over the manifest, which has one row a shard. ``ids_crc32`` is
    the crc of the ids as little-endian 32-bit integers, signless. Boundaries
    and doc_ids are selected ``RUN`` documents at a time; no table of them is
    made.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "base")
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, inside = _open(path)
                with system.open_input_file(inside) as file:
                    shard = ShardReader(file, file.size())
                    for first in range(0, shard.n_docs, RUN):
                        last = min(first + RUN, shard.n_docs)
                        starts, docs = shard.starts.select_run(first, last + 1), shard.doc_ids(first, last)
                        group = starts[:-1] // (1 << 20)
                        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), last - first]
                        for a, b in zip(cuts, cuts[1:], strict=False):
                            ids = shard.ids(int(starts[a]), int(starts[b])).astype("<u4")
                            own = starts[a : b + 1] - starts[a]
                            crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(own, own[1:], strict=False)]
                            columns = [pa.array(docs[a:b], pa.int64()), pa.array(starts[a:b] + base), pa.array(np.diff(own)), pa.array(crc, pa.int64())]
                            if with_ids:
                                columns.append(pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(ids.view(np.int32))))
                            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return placed.mapInArrow(run, schema)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_token_files(docs, new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest, with_ids=False)
