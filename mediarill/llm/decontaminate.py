"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize, scratch
from .lines import ascii_lower

# Fixed value: a word is a run of anything but ASCII white space.
SPACES = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


#: Words in a shingle.
WIDTH = 5


def _hash_at(words: Column, i: Column) -> Column:
    """A shingle's hash from its words' hashes (``words`` holds hashes here)."""
    return F.xxhash64(*[F.element_at(words, i + k) for k in range(WIDTH)])


def _text_at(words: Column, i: Column) -> Column:
    return F.array_join(F.slice(words, i, WIDTH), " ")


def shingle_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's shingles of five words (fewer words: all as one)."""

    def of(words: Column) -> Column:
        few = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " "))))
        full = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WIDTH - 1)), lambda i: _hash_at(h, i)))
        return F.when(F.size(words) >= WIDTH, full).otherwise(few)

    return F.array_distinct(_let(_words(text), of))


def shingle_texts(text: Column) -> Column:
    """Distinct shingles themselves."""

    def of(words: Column) -> Column:
        few = F.when(F.size(words) > 0, F.array(F.array_join(words, " ")))
        full = F.transform(F.sequence(F.lit(1), F.size(words) - (WIDTH - 1)), lambda i: _text_at(words, i))
        return F.when(F.size(words) >= WIDTH, full).otherwise(few)

    return F.array_distinct(_let(_words(text), of))


def size_class(n: Column) -> Column:
    """The exponent of the power of two that ``n`` goes up to: 2 → 1, 3 and 4 → 2, 5 to 8 → 3."""
    return F.length(F.bin(n.cast("long") - 1))


def containment_index(items: DataFrame, percent: int = 75) -> DataFrame:
    """``(part, item_id, n, need, h)``: the MinHash signatures of the benchmark items, a row for each hash.

    Items are parted by size, sizes up to a power of two together. A part
    has one signature length: as many hashes as its largest size may lack,
    and one more. An item's signature are its smallest hashes of that number
    (a bottom-k MinHash sketch), or all if it has fewer. A document that
    holds ``percent`` of an item lacks at most ``n * (100 - percent) / 100``
    of its shingles, so it holds ``need`` of the signature at least, which
    is one for the largest items of a part and more for the smaller ones.
    That holds however long the document is, and misses nothing.
    """
    shingles = items.where("item_id is not null").select("item_id", F.explode(shingle_hashes(F.col("text"))).alias("h")).distinct()
    sets = shingles.groupBy("item_id").agg(F.array_sort(F.collect_list("h")).alias("set")).withColumn("n", F.size("set"))
    sets = sets.withColumn("part", size_class(F.col("n")))
    most = F.floor(F.pow(F.lit(2.0), F.col("part")) * (100 - percent) / 100).cast("int") + 1
    lacking = F.floor(F.col("n") * (100 - percent) / 100).cast("int")
    signature = F.slice("set", F.lit(1), most)
    return sets.select("part", "item_id", "n", (F.size(signature) - lacking).alias("need"), F.explode(signature).alias("h"))


def candidate_pairs(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``: documents that hold ``need`` hashes of an item's signature in ``index``.

    The index is a written table: Spark broadcasts it only if its size is
    under the session's limit, and joins by shuffle otherwise. Hashes above
    its largest never match and go before the join.
    """
    top = index.agg(F.max("h").alias("top")).first()["top"]
    probes = docs.select("doc_id", F.explode(shingle_hashes(F.col("text"))).alias("h")).where(F.col("h") <= F.lit(top if top is not None else 0))
    met = probes.join(index.select("item_id", "need", "h"), "h").groupBy("doc_id", "item_id").agg(F.size(F.collect_set("h")).alias("hits"), F.first("need").alias("need"))
    return met.where("hits >= need").select("doc_id", "item_id")


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)``: items of which a document holds ``percent`` or more.

    Candidates come from the size-partitioned signatures (containment_index),
    and are then compared shingle by shingle, as texts.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set holds
    runs of five words, or all words as one if they are fewer. Null, empty
    and blank texts on either side match nothing; rows without doc_id or
    item_id are left out; rows that repeat an id count as one text set. No
    items or no documents: an empty table. Other columns are not looked at.
    """
    docs, items = docs.select("doc_id", "text").where("doc_id is not null"), items.select("item_id", "text").where("item_id is not null")
    with scratch():
        index = materialize(containment_index(items, percent), "index")
        candidates = materialize(candidate_pairs(docs, index), "candidates", kept=True)

    item_sets = items.select("item_id", F.explode(shingle_texts(F.col("text"))).alias("s")).distinct()
    sizes = item_sets.groupBy("item_id").agg(F.count("*").alias("n_item"))
    wanted = candidates.join(items.groupBy("item_id").agg(F.collect_list("text").alias("__item")), "item_id")
    wanted = wanted.select("doc_id", "item_id", F.array_distinct(F.flatten(F.transform("__item", shingle_texts))).alias("__set"))
    texts = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", shingle_texts(F.col("text")).alias("__doc"))
    met = texts.join(wanted, "doc_id").select("doc_id", "item_id", F.explode(F.array_intersect("__doc", "__set")).alias("s")).distinct()
    met = met.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    out = met.join(sizes, "item_id").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return out.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FOUND_SQL = """
item_words AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
item_shingles AS (
  SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM item_words)
),
found AS (
  SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM shingles JOIN item_shingles USING (s) JOIN (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id) USING (item_id) GROUP BY ALL HAVING count(*) * 100 >= n_item * 75
)"""


def _op7_sql() -> str:
    from .near_dups import _WORDS_SQL

    return "WITH" + _WORDS_SQL.format(docs="documents") + "," + _FOUND_SQL + " SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM found"


OP7_SQL = _op7_sql()
