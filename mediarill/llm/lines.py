"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import discard, materialize, new_path, scratch

# The characters stripped from a line's ends, and the letters that are lower-cased.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all else untouched; texts of one byte a character take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(STRIPPED)))


def _hashed(line: Column) -> Column:
    """Two 64-bit hashes of a line's key under different seeds."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(0x5EED), line).alias("h2"))


class LineRuns:
    """A levelled store of line hashes.

    A run is a table ``(h1, h2, keeper, n_docs)``, dealt out by hash into
    buckets and sorted inside each, so that the next batch merges with it
    bucket by bucket without moving the run. ``absorb`` adds one batch of
    ``(doc_id, h1, h2)``: the batch is merge-anti-joined with each run. What
    survives is new and becomes a run, its keeper being the largest doc_id
    that holds the line in the batch. So a line stands in one run only, and
    its first batch names its keeper. What was met before only leaves its
    number of documents, as a delta ``(h1, h2, n_docs)``. Once ``fanout``
    runs lie on a level they are merged into one of the next, and the deltas
    that have come since are added up.

    Batches must arrive in descending order of doc_id for ``keeper`` to be
    the largest holder.
    """

    RUN, DELTA = "h1 long, h2 long, keeper long, n_docs long", "h1 long, h2 long, n_docs long"

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = new_path(spark, "runs")
        self.levels: list[list[str]] = [[]]
        self.deltas: list[str] = []
        self._made = 0

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _name(self, kind: str) -> str:
        self._made += 1
        return f"{kind}_{self.root.rsplit('-', 1)[1].split('/')[0]}_{self._made}"

    def _write(self, df: DataFrame) -> str:
        name = self._name("run")
        df = df.select("h1", "h2", F.col("keeper").cast("long"), "n_docs").repartition(self.buckets, "h1", "h2")
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{name}").format("parquet").saveAsTable(name)
        return name

    def _read(self, names: list[str], schema: str) -> DataFrame:
        """Runs are read as plain files here: a union of bucketed scans is planned as if its parts lay together."""
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names])

    def _names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose line is in no run."""
        for name in self._names():
            batch = batch.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def absorb(self, batch: DataFrame) -> None:
        own = batch.groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.count("*").alias("n_docs"))
        if not self._names():
            self.levels[0].append(self._write(own))
            return
        own = materialize(own, "batch")
        fresh = self._write(self.unseen(own))
        met = own.join(self.spark.table(fresh).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.deltas.append(self._name("delta"))
        met.select("h1", "h2", "n_docs").write.parquet(f"{self.root}/{self.deltas[-1]}")
        self.levels[0].append(fresh)
        self.compact()

    def compact(self) -> None:
        at = 0
        while at < len(self.levels):
            level = self.levels[at]
            if len(level) >= self.fanout:
                merged = self._write(self._read(level, self.RUN))
                for n in level:
                    self._drop(n)
                self.levels[at] = []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(merged)
                if len(self.deltas) > 1:
                    name = self._name("delta")
                    self._added().write.parquet(f"{self.root}/{name}")
                    for n in self.deltas:
                        discard(self.spark, f"{self.root}/{n}")
                    self.deltas = [name]
            at += 1

    def _added(self) -> DataFrame:
        return self._read(self.deltas, self.DELTA).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def totals(self) -> DataFrame:
        """``(h1, h2, keeper, n_docs)``: each line once, with the documents of all batches."""
        more = self._added().withColumnRenamed("n_docs", "more")
        lines = self._read(self._names(), self.RUN).join(more, ["h1", "h2"], "left")
        return lines.select("h1", "h2", "keeper", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"))

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        for n in self._names():
            self._drop(n)
        for n in self.deltas:
            discard(self.spark, f"{self.root}/{n}")
        self.levels, self.deltas = [[]], []


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, h1, h2)``: the distinct long line keys of each document; rows without doc_id give none."""
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_key)
    long = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    hashes = F.array_distinct(F.transform(long, _hashed))
    return docs.where("doc_id is not null").select("doc_id", F.explode(hashes).alias("h")).select("doc_id", "h.h1", "h.h2").distinct()


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``(doc_id, h1, h2)``: the lines that each document loses.

    The hashes of all lines are written once, cut into ``batches`` of about
    as many rows of ``docs`` at quantiles of doc_id; they enter the runs from
    the largest ids down. Rows of one doc_id are always in one batch.
    """
    spark = docs.sparkSession
    shares = [F.lit(k / batches) for k in range(1, batches)] or [F.lit(1.0)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*shares), 1000).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))[: batches - 1]
    batch = sum(((F.col("doc_id") <= c).cast("int") for c in cuts), F.lit(0))
    hashes = materialize(line_hashes(docs, min_chars).withColumn("batch", batch), "hashes", ["batch"])
    with LineRuns(spark, fanout) as store:
        for i in range(len(cuts) + 1):
            store.absorb(hashes.where(F.col("batch") == i).drop("batch"))
        often = materialize(store.totals().where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "often")
    return hashes.drop("batch").join(often, ["h1", "h2"]).where("doc_id <> keeper").select("doc_id", "h1", "h2")


def _free_name(taken: list[str], name: str) -> str:
    """``name`` with as many underscores as it takes to be none of ``taken``."""
    while name.lower() in (t.lower() for t in taken):
        name += "_"
    return name


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, many: int = 2000) -> DataFrame:
    """``docs`` with ``text`` cut down to the lines that stay, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII white space with A-Z in lower
    case. A key of at least ``min_chars`` code points held by ``min_docs``
    documents or more stays only in the largest doc_id that holds it (all its
    lines there stay). Null or empty text is one empty line. A row without
    doc_id keeps all its lines and counts nowhere. Rows that repeat a doc_id
    count as one holder and are each cut by the same rule. An empty table
    gives an empty table. Other columns pass through, whatever their names;
    columns named n_lines or n_dropped are replaced.

    A document that loses up to ``many`` different lines has them beside it
    as an array. One that loses more, where looking each line up in an array
    would cost lines times losses, hands its lines out as rows instead and
    is put together again from those that stay.
    """
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    key, drop, kept, row, at, line = (_free_name(docs.columns, n) for n in ("key", "drop", "kept", "row", "at", "line"))
    with scratch():
        lost = materialize(repeated_lines(docs, min_chars, min_docs, batches, fanout), "drops", kept=True)
    sizes = materialize(lost.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > many).select(F.col("doc_id").alias(key)), "many")
    rows, lines = docs.select(*others), F.split(F.coalesce("text", F.lit("")), "\n")

    def finished(df: DataFrame) -> DataFrame:
        n = F.size(lines).cast("long")
        cut = {"text": F.array_join(kept, "\n"), "n_lines": n, "n_dropped": n - F.size(kept)}
        return df.select(*[cut[c].alias(c) if c == "text" else F.col(c) for c in others], cut["n_lines"].alias("n_lines"), cut["n_dropped"].alias("n_dropped"))

    def stays(x: Column) -> Column:
        k = line_key(x)
        return (F.char_length(k) < min_chars) | ~F.array_contains(drop, _hashed(k))

    lost = lost.withColumnRenamed("doc_id", key)
    few = lost.join(sizes, key, "left_anti").groupBy(key).agg(F.collect_list(F.struct("h1", "h2")).alias(drop))
    if sizes.isEmpty():
        joined = rows.join(few, rows["doc_id"] == few[key], "left")
        return finished(joined.withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, stays))))
    short = rows.join(sizes, rows["doc_id"] == sizes[key], "left_anti")
    short = short.join(few, short["doc_id"] == few[key], "left").withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, stays)))
    long = materialize(rows.join(sizes, rows["doc_id"] == sizes[key], "left_semi").withColumn(row, F.monotonically_increasing_id()), "long")
    each = long.select(row, F.col("doc_id").alias(key), F.posexplode(lines).alias(at, line))
    hashed = each.withColumn("k", line_key(F.col(line))).select(row, key, at, line, F.when(F.char_length("k") >= min_chars, _hashed(F.col("k"))).alias("h"))
    left = hashed.select(row, key, at, line, "h.h1", "h.h2").join(lost.join(sizes, key, "left_semi"), [key, "h1", "h2"], "left_anti")
    left = left.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(at, line))).alias(kept))
    long = long.join(left, row, "left").withColumn(kept, F.coalesce(F.col(kept)[line], F.array().cast("array<string>")))
    return finished(short).unionByName(finished(long))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_LINES_SQL = """
lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {docs})
),
often AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
),
judged AS (
  SELECT l.doc_id, l.pos, l.line, (o.k IS NOT NULL AND l.doc_id <> o.keeper) AS gone FROM lines l LEFT JOIN often o ON l.k = o.k
),
cut AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM judged GROUP BY doc_id
)"""

OP1_SQL = "WITH" + _LINES_SQL.format(docs="documents") + " SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM cut"
