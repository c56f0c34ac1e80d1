"""Fill-in-the-middle documents; the cuts are found by ranks over a wavelet matrix of character classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import flat_bytes, slices, text_array

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

#: Classes of the bytes of a text: a byte inside a character, a letter inside a run of letters, any other character, the first letter of a run. The upper bit says that a unit begins here.
INSIDE, LETTER, OTHER, FIRST = range(4)

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Bits:
    """A bit vector with the number of ones before each word, so that a rank is two look-ups."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.before = np.cumsum(ones, dtype=np.int64) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """A sequence of small codes by levels of bits, upper bit first; each level is parted by the one before, zeros first."""

    def __init__(self, codes: np.ndarray, width: int):
        self.size, self.width = len(codes), width
        self.levels: list[tuple[Bits, int]] = []
        for shift in range(width - 1, -1, -1):
            bit = (codes >> shift) & 1 == 1
            self.levels.append((Bits(bit), len(codes) - int(np.count_nonzero(bit))))
            if shift:
                codes = np.concatenate([codes[~bit], codes[bit]])

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often ``code`` stands before each position."""
        first, last = np.zeros(1, np.int64), at.astype(np.int64)
        for level, (bits, zeros) in enumerate(self.levels):
            f, l = bits.rank(first), bits.rank(last)  # noqa: E741
            first, last = (zeros + f, zeros + l) if code >> (self.width - 1 - level) & 1 else (first - f, last - l)
        return last - first


def classes_of(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of the texts that begin at ``starts``; a run of letters ends with its text."""
    letter = _IS_LETTER[raw]
    goes_on = np.zeros(len(raw), bool)
    goes_on[1:] = letter[:-1]
    begins = starts[starts < len(raw)]
    goes_on[begins] = False
    codes = np.where((raw & 0xC0) == 0x80, np.uint8(INSIDE), np.uint8(OTHER))
    codes[letter] = FIRST
    codes[letter & goes_on] = LETTER
    return codes


class Boundaries:
    """Units ``[A-Za-z]+|[^A-Za-z]`` of texts that lie end to end, counted and found by ranks."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray):
        self.matrix, self.starts = WaveletMatrix(classes_of(raw, starts[:-1]), 2), starts
        self.before = self.units_before(starts)

    def units_before(self, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(FIRST, at) + self.matrix.rank(OTHER, at)

    def counts(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.before)

    def characters(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Code points between two places."""
        return last - first - (self.matrix.rank(INSIDE, last) - self.matrix.rank(INSIDE, first))

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The byte behind the first ``units`` units of each text, by bisection on ranks, all texts side by side."""
        low, high = self.starts[:-1].copy(), self.starts[1:].copy()
        wanted = self.before[:-1] + units
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            enough = self.units_before(middle + 1) > wanted[open_]
            high[open_[enough]] = middle[enough]
            low[open_[~enough]] = middle[~enough] + 1
        return low


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits, from the hash of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, text: str = "text", plain_pct: int = 10, spm_pct: int = 20) -> DataFrame:
    """``(doc_id, n, form, output, prefix_chars, middle_chars)`` of every row of ``docs``, its text rearranged to fill the middle.

    A text is cut at two units drawn from the hash of seed and doc_id. ``psm``
    gives prefix, suffix, middle, ``spm`` suffix, prefix, middle, each behind
    its mark; ``plain`` leaves the text as it is: ``plain_pct`` of all, empty
    and null texts, and texts that hold a mark already. So ``restored`` gives
    every text back. Texts of any length are cut whole. Rows that repeat a
    doc_id are cut alike, each its own text; a row without doc_id draws from
    the empty id. Other columns are left out, so their names can't clash. An
    empty table gives an empty table.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.contains(whole, F.lit(MARKS[0])) | F.contains(whole, F.lit(MARKS[1])) | F.contains(whole, F.lit(MARKS[2]))
    form = F.when((whole == "") | marked | (h3 % 100 >= 100 - plain_pct), "plain").when(h4 % 100 < spm_pct, "spm").otherwise("psm")
    rows = docs.select("doc_id", whole.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    kinds = [("n", T.LongType()), ("form", T.StringType()), ("output", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, k) for n, k in kinds]])
    p, s, m = (x.encode() for x in MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                raw, starts = flat_bytes(piece.column("text"))
                found = Boundaries(raw, starts)
                n = found.counts()
                a, b = (piece.column(h).to_numpy() % (n + 1) for h in ("h1", "h2"))
                one, two = found.cut(np.minimum(a, b)), found.cut(np.maximum(a, b))
                forms, view, out = piece.column("form").to_pylist(), memoryview(raw), []
                for form, t0, t1, t2, t3 in zip(forms, starts[:-1].tolist(), one.tolist(), two.tolist(), starts[1:].tolist(), strict=True):
                    prefix, middle, suffix = view[t0:t1], view[t1:t2], view[t2:t3]
                    out.append(bytes(view[t0:t3]) if form == "plain" else b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)))
                cut = np.array([f == "plain" for f in forms], bool)
                chars = [pa.array(found.characters(*ends), mask=cut) for ends in ((starts[:-1], one), (one, two))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), piece.column("form"), text_array(out), *chars], schema.names)

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again. No mark can begin inside another, so the first of each kind is the one that was set."""
    p, s, m = MARKS
    psm = F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = fill_in_middle(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM texts),
cuts AS (
  SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS c, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS d,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, c), '') AS p, array_to_string(list_slice(u, c + 1, d), '') AS m, array_to_string(list_slice(u, d + 1, n), '') AS s
  FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
