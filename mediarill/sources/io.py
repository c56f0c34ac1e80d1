"""Reading and writing what surrounds the catalogue: listings, lists, vocabularies, snapshots, logs, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..plans.shared import discard

# The file endings that are media, and the codes of tag categories in vocabulary files.
MEDIA_ENDINGS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "mp4", "webm", "mkv", "mov", "avi", "m4v"]
CATEGORIES = {"0": "general", "4": "character", "9": "rating"}

MEDIA_SCHEMA = "id long, filename string, folder string, filepath string, width int, height int, file_date double, file_size long, media_type string, rating int, search_text string, meta_done boolean, tagged boolean"


def load_catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """S1. The tables of a snapshot, media in its fixed types; empty signatures are null."""
    media = spark.read.parquet(f"{folder}/media")
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(MEDIA_SCHEMA).fields}
    typed = media.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in media.columns])
    return {"media": typed, "tags": spark.read.parquet(f"{folder}/tags"), "image_tags": spark.read.parquet(f"{folder}/image_tags")}


def scan_listing(spark: SparkSession, roots: list[str], endings: list[str] = MEDIA_ENDINGS) -> DataFrame:
    """S2. (path, length, mtime, ext) of the files below ``roots`` with one of the ``endings``, media files if none are named; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    rows = files.select("path", "length", F.col("modificationTime").cast("double").alias("mtime"), S.extension(F.col("path")).alias("ext"))
    return rows.where(F.col("ext").isin(endings))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """S4. The distinct words of a text list, one a line, trimmed and in lower case."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def write_word_list(words: DataFrame, path: str) -> None:
    """S4. A sorted text list; a hand-kept list, so one file."""
    words.select(F.lower(F.trim("word")).alias("value")).where("value <> ''").distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def read_tag_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """S5. (pos, name, category) of a vocabulary CSV with columns pos, name, category code."""
    names = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    rows = spark.read.csv(path, header=True, schema="pos int, name string, category string")
    return rows.select("pos", "name", F.coalesce(F.element_at(names, F.col("category")), F.lit("general")).alias("category"))


def parse_json_column(df: DataFrame, col: str, schema: str) -> DataFrame:
    """S6. A JSON text column as a typed one; what is no JSON becomes null."""
    return df.withColumn(col, F.from_json(col, schema))


def snapshot(tables: dict[str, DataFrame], dest: str, version: int, drop: list[str] | None = None, keep: int = 3) -> list[int]:
    """S7. All tables, without payload columns, as ``dest/v=<version>``; the last ``keep`` versions stay. Returns those."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.drop(*(drop or [])).write.parquet(f"{dest}/v={version}/{name}")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(dest)
    found = sorted(int(s.getPath().getName()[2:]) for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root) if s.getPath().getName().startswith("v="))
    for v in found[:-keep]:
        discard(spark, f"{dest}/v={v}")
    return found[-keep:]


def tail_since(df: DataFrame, after: int, col: str, limit: int = 1200) -> DataFrame:
    """S8. The newest rows of a log behind a sequence number, in order."""
    return df.where(F.col(col) > after).orderBy(F.desc(col)).limit(limit).orderBy(col)


def file_change_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """S9. A folder of change files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def json_value(col: Column, path: str) -> Column:
    """S6. One value of a JSON text."""
    return F.get_json_object(col, path)
