"""A catalogue as a base table and a log of changes, merged on read and compacted now and then."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.shared import discard

#: Epoch of the rows that were there before the first batch.
BEFORE = -1


class ChangeLog:
    """Rows by ``path``, with their last ``kind`` (``removed`` or another) and columns of their own.

    The folder holds segments ``seg-<first>-<last>``: what the batches of those
    epochs changed, the last change of each path only. The one from epoch -1
    on is the base, without removed rows. A batch writes its own segment and
    nothing else. ``fanout`` segments of one size class are merged into one, so each
    change is rewritten once a class; the base is written anew only when the
    log has ``share`` of its rows, so that costs a constant number of rows a
    change too. A segment counts once Spark has committed it; a wider one
    replaces those it covers. So a batch that is repeated, or a merge that was cut
    off, leaves the same rows. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, fanout: int = 4, share: float = 0.5):
        self.spark, self.folder, self.schema, self.fanout, self.share = spark, folder, schema, fanout, share
        self._rows: dict[tuple[int, int], int] = {}

    @classmethod
    def create(cls, rows: DataFrame, folder: str, **how) -> ChangeLog:
        """A log over the rows ``(path, kind, ...)`` that are there already."""
        log = cls(rows.sparkSession, folder, rows.schema, **how)
        rows.write.mode("overwrite").parquet(log._path(BEFORE, BEFORE))
        return log

    def _path(self, first: int, last: int) -> str:
        return f"{self.folder}/seg-{first + 1:09d}-{last + 1:09d}"

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[tuple[int, int]]:
        """``(first, last)`` of the committed segments that no wider one covers, in order."""
        jvm, root, files = self._files()
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        found = [(int(m[1]) - 1, int(m[2]) - 1) for n in names if (m := re.fullmatch(r"seg-(\d+)-(\d+)", n)) and files.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
        return sorted(s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found))

    def bytes_of(self, first: int, last: int) -> int:
        jvm, _, files = self._files()
        return files.getContentSummary(jvm.org.apache.hadoop.fs.Path(self._path(first, last))).getLength()

    def read(self, segments: list[tuple[int, int]]) -> DataFrame:
        """The rows of some segments, with ``epoch``, the last one of their segment."""
        parts = [self.spark.read.schema(self.schema).parquet(self._path(*s)).withColumn("epoch", F.lit(s[1])) for s in segments]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def _merged(self, segments: list[tuple[int, int]]) -> DataFrame:
        row = F.struct(*self.schema.names)
        return self.read(segments).groupBy(F.col("path").alias("p")).agg(F.max_by(row, "epoch").alias("r")).select("r.*")

    def apply(self, changes: DataFrame, epoch: int) -> None:
        """Write the last changes of some paths, one row each, as the segment of ``epoch``; an epoch that is covered already changes nothing."""
        held = self.segments()
        if not any(first <= epoch <= last and last > first for first, last in held):
            changes.select(*self.schema.names).write.mode("overwrite").parquet(self._path(epoch, epoch))
            self._rows.pop((epoch, epoch), None)
        self.compact()

    def compact(self) -> None:
        """Merge segments of one size class, then the whole log into the base if it has become large."""
        while True:
            held = self.segments()
            logs = [s for s in held if s[0] != BEFORE]
            rank = {s: (s[1] - s[0] + 1).bit_length() for s in logs}
            run = next((logs[k : k + self.fanout] for k in range(len(logs) - self.fanout + 1) if len({rank[s] for s in logs[k : k + self.fanout]}) == 1), None)
            if run is None:
                break
            self._replace(run, self._merged(run))
        base = [s for s in held if s[0] == BEFORE]
        if base and logs and sum(map(self._count, logs)) >= max(1, self.share * self._count(base[0])):
            self._replace(held, self.current())

    def _count(self, segment: tuple[int, int]) -> int:
        """Rows of a segment, from the footers of its files, looked up once."""
        if segment not in self._rows:
            self._rows[segment] = self.read([segment]).count()
        return self._rows[segment]

    def _replace(self, segments: list[tuple[int, int]], rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._path(segments[0][0], segments[-1][1]))
        for s in segments:
            discard(self.spark, self._path(*s))

    def current(self) -> DataFrame:
        """The catalogue now: base rows whose path the log doesn't name, and what the log says last, but for removed ones."""
        held = self.segments()
        base, logs = [s for s in held if s[0] == BEFORE], [s for s in held if s[0] != BEFORE]
        rows = self.read(base).drop("epoch")
        if not logs:
            return rows
        last = self._merged(logs)
        return rows.join(last.select("path"), "path", "left_anti").select(*self.schema.names).unionByName(last.where("kind <> 'removed'"))
