"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .remembered import Remembered

SPACE = "▁"


class PieceModel:
    """The tables that merging needs, read from a sentencepiece BPE model with byte fallback.

    A merge joins two neighbouring symbols whose joined text is a piece, best
    score first, leftmost first among equals. Two characters that stand side
    by side in no piece can never be merged over, so a text falls apart there
    into words that do not influence each other.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        for i, is_byte in enumerate(byte):
            if is_byte:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        normal = {self.pieces[i]: i for i in range(n) if not byte[i] and not special[i]}
        self.single = {p: i for p, i in normal.items() if len(p) == 1}
        # Equal scores are equal ranks, so that position decides between them.
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank_of = np.unique(-scores, return_inverse=True)[1]
        # Symbols: an id for every piece and every proper part a merge can meet; pairs of symbols to (rank, joined).
        pairs: dict[tuple[int, int], int] = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = normal.get(p[:cut]), normal.get(p[cut:])
                if a is None and cut == 1:
                    a = self._odd(p[:cut], n)
                if b is None and cut == len(p) - 1:
                    b = self._odd(p[cut:], n)
                if a is not None and b is not None:
                    pairs[(a, b)] = i
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_piece = np.array(list(pairs.values()), np.int64)[order]
        self.pair_rank = rank_of[self.pair_piece]
        beside = {ord(p[k]) << 32 | ord(p[k + 1]) for p in normal for k in range(len(p) - 1)}
        self.beside = np.array(sorted(beside), np.int64)
        self.symbols = np.arange(n, n + 0x110000, dtype=np.int32)
        for c, i in self.single.items():
            self.symbols[ord(c)] = i
        # Decoding: the bytes of each id.
        self.raw = [bytes([int(p[3:5], 16)]) if byte[i] else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.silent = {i for i in range(n) if sp.is_control(i)}
        for i in range(n):
            if sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
        self.no_pair = np.iinfo(np.int64).max

    def _odd(self, char: str, n: int) -> int:
        """Symbol of a character that is no piece itself."""
        return n + ord(char)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of each pair; pairs that make no piece get the largest rank."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], self.no_pair), np.where(hit, self.pair_piece[at], 0)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and each word's number of ids; all words are merged side by side.

        Flat arrays hold the symbols of all parts that still have a pair,
        a part being what lies between two characters that no piece has side
        by side. A round finds each part's smallest rank, merges its pairs of
        that rank from the left in all parts at once, and drops parts without
        pairs. Pairs that overlap one before them, or stand behind a merge whose
        piece makes a pair just as good or better, wait for a later round; so a
        run of one letter halves in each round, and the order is the library's.
        """
        n = len(self.pieces)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        flat = self.symbols[codes].astype(np.int64)
        tie = codes[:-1] << 32 | codes[1:]
        at = np.minimum(np.searchsorted(self.beside, tie), len(self.beside) - 1)
        cut = (self.beside[at] != tie) | (owner[1:] != owner[:-1])
        part = np.concatenate([[0], np.cumsum(cut)]) if len(flat) else owner
        place = np.arange(len(flat))
        size = np.bincount(part) if len(flat) else np.zeros(0, np.int64)
        rank, joined = np.full(len(flat), self.no_pair), np.zeros(len(flat), np.int64)
        inner = np.flatnonzero(~cut) if len(flat) else place
        rank[inner], joined[inner] = self.look_up(flat[inner], flat[inner + 1])
        done_place, done_flat = [], []
        while len(flat):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, starts)
            done = best == self.no_pair
            if done.any():
                out = np.repeat(done, size)
                done_place.append(place[out])
                done_flat.append(flat[out])
                keep = ~out
                flat, rank, joined, place = flat[keep], rank[keep], joined[keep], place[keep]
                size, best = size[~done], best[~done]
                if not len(flat):
                    break
                starts = np.cumsum(size) - size
            # Of overlapping hits every second one is merged, from the left.
            hits = np.flatnonzero(rank == np.repeat(best, size))
            run = np.concatenate([[True], hits[1:] != hits[:-1] + 1])
            first = hits[(hits - np.maximum.accumulate(np.where(run, hits, 0))) % 2 == 0]
            at = np.searchsorted(starts, first, "right") - 1
            has_left, has_right = first > starts[at], first + 2 < (starts + size)[at]
            made = joined[first]
            left = flat[np.maximum(first - 1, 0)]
            beside = np.flatnonzero(has_left[1:] & (first[1:] == first[:-1] + 2)) + 1
            left[beside] = made[beside - 1]
            rank_l, joined_l, rank_r, joined_r = np.full(len(first), self.no_pair), np.zeros(len(first), np.int64), np.full(len(first), self.no_pair), np.zeros(len(first), np.int64)
            rank_l[has_left], joined_l[has_left] = self.look_up(left[has_left], made[has_left])
            rank_r[has_right], joined_r[has_right] = self.look_up(made[has_right], flat[first[has_right] + 2])
            # Where a merge makes a pair of no worse rank, the part's later hits wait: that pair may come before them.
            ahead = np.cumsum(stop := np.minimum(rank_l, rank_r) <= best[at]) - stop
            go = ahead == ahead[np.searchsorted(at, at)]
            first, at, made, has_left = first[go], at[go], made[go], has_left[go]
            flat[first] = made
            keep = np.ones(len(flat), bool)
            keep[first + 1] = False
            moved = first - np.arange(len(first))  # the merged symbol's place once the holes are closed
            flat, rank, joined, place = flat[keep], rank[keep], joined[keep], place[keep]
            size = size - np.bincount(at, minlength=len(size))
            rank[moved], joined[moved] = rank_r[go], joined_r[go]
            again = moved[has_left] - 1
            rank[again], joined[again] = rank_l[go][has_left], joined_l[go][has_left]
        if not done_place:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        place, flat = np.concatenate(done_place), np.concatenate(done_flat)
        order = np.argsort(place, kind="stable")
        flat, owner = flat[order], owner[place[order]]
        odd = np.flatnonzero(flat >= n)
        if len(odd):  # characters that are no piece become the pieces of their UTF-8 bytes
            as_bytes = [self.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in (flat[odd] - n).tolist()]
            many = np.ones(len(flat), np.int64)
            many[odd] = [len(x) for x in as_bytes]
            owner, flat = np.repeat(owner, many), np.repeat(flat, many)
            flat[flat >= n] = np.concatenate(as_bytes)
        return flat.astype(np.int32), np.bincount(owner, minlength=len(words))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: spaces for the space mark, byte runs as UTF-8, the leading space dropped."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        if raw[:1] == b" ":
            first = next((i for i in ids.tolist() if i not in self.silent), None)
            if first is not None and self.pieces[first].startswith(SPACE):
                raw = raw[1:]
        return raw.decode("utf-8", "replace")


#: A word is a run of spaces and what follows up to the next space; no piece has a space behind another character.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Encoder:
    """Texts to ids with a memory of words, emptied when it is full; the memory changes speed only."""

    def __init__(self, model: PieceModel, memory: int = 16 << 20):
        self.model, self.known = model, Remembered(memory)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        known = self.known
        known.make_room()
        words = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list(set().union(*words).difference(known))
        if new:
            flat, size = self.model.merge(new)
            raw, ends = flat.tobytes(), np.cumsum(size) * 4
            for w, a, b in zip(new, (ends - size * 4).tolist(), ends.tolist(), strict=True):
                known.add(w, raw[a:b], 2 * len(w) + b - a)
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)), np.int32) for ws in words]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(PieceModel(path))


def _slices(batch: pa.RecordBatch, text: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _appended(schema: T.StructType, *names: str) -> list[T.StructField]:
    return [f for f in schema.fields if f.name not in names]


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids array<int>``: exactly the library's ids, no begin or end id, no sampling.

    With ``decoded``, also ``decoded string``, the ids' text again, in the
    same pass. Null and empty texts give an empty array and an empty text.
    Texts of any length are encoded whole, about 512 kB at a time. Columns
    already so called are replaced; all others pass through, so rows that repeat
    stay. An empty table gives an empty table. ``model_path`` must exist on
    every machine.
    """
    added = ["ids", *["decoded"] * decoded]
    others = _appended(docs.schema, *added)
    kinds = {"ids": T.ArrayType(T.IntegerType(), False), "decoded": T.StringType()}
    schema = T.StructType([*others, *[T.StructField(n, kinds[n]) for n in added]])
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        for whole in batches:
            for batch in _slices(whole, text):
                ids = encoder.encode(batch.column(text).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                columns = [batch.column(n) for n in names]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())))
                if decoded:
                    columns.append(pa.array(map(encoder.model.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return docs.mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded string``, as the library's ``decode(ids)`` gives it. Null ids give null."""
    others = _appended(encoded.schema, "decoded")
    schema = T.StructType([*others, T.StructField("decoded", T.StringType())])
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(model_path).model
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = [None if not v.is_valid else model.decode(v.values.to_numpy(zero_copy_only=False)) for v in batch.column(ids)]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_model()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = encode_pieces(docs, path, decoded=True)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
