"""Signatures of larger pictures, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dct_signatures(pictures: DataFrame, size: int = 64, keep: int = 16) -> DataFrame:
    """F29. ``(id, words)`` of ``pictures(id, px)``: median bits of the low ``keep`` x ``keep`` block of the 2-D DCT-II.

    ``px`` is a row-major luma array of ``size`` x ``size``; a null, an array
    of another length or with nulls inside gives null words. The bits are
    packed into 32-bit words, row by row, the first bit highest.
    """
    k, i = np.arange(keep)[:, None], np.arange(size)[None, :]
    basis = 2.0 * np.cos(np.pi * k * (2 * i + 1) / (2 * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                px = batch.column("px").to_pylist()
                fit = [j for j, p in enumerate(px) if p is not None and len(p) == size * size and None not in p]
                words: list[list[int] | None] = [None] * len(px)
                if fit:
                    low = basis @ np.array([px[j] for j in fit], np.float64).reshape(-1, size, size) @ basis.T
                    low = low.reshape(len(fit), keep * keep)
                    bits = (low > np.median(low, axis=1, keepdims=True)).reshape(len(fit), -1, 32)
                    packed = (bits * (1 << np.arange(31, -1, -1, dtype=np.int64))).sum(2)
                    for j, w in zip(fit, packed.tolist(), strict=True):
                        words[j] = w
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.list_(pa.int64()))], ["id", "words"])

    return pictures.select(F.col("id").cast("long"), F.col("px").cast("array<double>")).mapInArrow(run, "id long, words array<long>")
