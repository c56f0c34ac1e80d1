"""A corpus pipeline: toxic documents out, repeated lines out, near copies out, benchmark leaks out, then token ids.

Part of the training-data operators; every stage calls one of them.

Stages take any table with the columns of documents, and return those and no
others, so columns of other names can't clash; the last adds ``ids``. An empty
table gives an empty table. A null text counts as an empty one, and is an
empty one behind the line dedup. A row without doc_id has no copies and no
leaks: only its own toxicity can make it go. Rows that repeat a doc_id are
scored each by their own text; as lines, copies and leaks they are one
document, so all of them go or stay in those stages. Ties: of near copies the
smallest doc_id stays, of a repeated line the largest keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediarill.llm.decontaminate import contaminated
from mediarill.llm.lines import dedup_lines
from mediarill.llm.near_dups import near_duplicates
from mediarill.llm.pieces import default_model, encode_pieces
from mediarill.llm.toxicity import fit_toxicity, tag_documents
from mediarill.plans.shared import discard, materialize, new_path, scratch
from mediarill.plans.shipping import ship, shipped

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5. The tagger learns from labelled documents of this stage's input."""
    tagger = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return tag_documents(docs, tagger, spans=False).where(F.col("score") < 0.5).select(*COLUMNS)


@shipped
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that three documents or more hold; ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies."""
    with scratch():
        gone = materialize(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "near_copies", kept=True)
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


@shipped
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to three quarters or more."""
    with scratch():
        found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        gone = materialize(found.select("doc_id").distinct(), "leaks", kept=True)
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


@shipped
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, with their piece ids; none left: an empty table with that column."""
    return encode_pieces(docs.select(*COLUMNS), default_model())


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near-dedup", drop_near_copies), ("decontamination", drop_contaminated), ("sentencepiece", encode)]

#: The tagger and the piece model cannot be said in SQL; the other stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again before the next.

    What a stage wrote for itself goes with its end, and its predecessor's table
    once its own is written; the result reads the last but one stage's table.
    """
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage_{k}")
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            discard(spark, before)
        before = path
