"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next
stage. All but the last return the columns of documents, with n_chars brought up to date where the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed, ensure_checkpoint_dir, sized, small_batches, table
from tallyforge.llm.jaccard_join import jaccard_groups
from tallyforge.llm.line_dedup import dedup_lines
from tallyforge.llm.packing import pack
from tallyforge.llm.pii_crf import redact
from tallyforge.llm.quality_llr import filter_quality, trusted_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go.

    Null or empty text fails the base rules; a null id is never a trusted one; rows that repeat are judged one by one; an
    empty table gives an empty result; other columns are left out. Without labels only the base rules decide.
    """
    return filter_quality(docs, trusted_ids(table(spark, sf_dir, "labels"))).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so do documents of which no word is left.

    Null text has no word; null ids come first in the order of documents; rows that repeat an id are one document for that
    order; an empty table gives an empty result; other columns are left out.
    """
    return _sized_text(dedup_lines(docs, short=True).where("text rlike '[^ \\t-\\r]'"))


def told_apart(docs: DataFrame, hashed=F.xxhash64) -> DataFrame:
    """docs with _row, a number that rows have in common only if all their contents are equal.

    It is a hash; where contents that share one have different 256-bit digests, those rows are hashed anew with a further
    value, until no such hash is left.
    """
    whole = F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})
    rows = docs.withColumn("_row", hashed(*docs.columns))
    again = 0
    while True:
        digests = rows.select("_row", F.unhex(F.sha2(whole, 256)).alias("d"))
        shared = checkpointed(digests.groupBy("_row").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select(F.col("_row").alias("_shared")))
        if not shared.limit(1).count():
            return rows
        again += 1
        met = rows.join(sized(shared), F.col("_row") == F.col("_shared"), "left")
        rows = met.withColumn("_row", F.when(F.col("_shared").isNull(), F.col("_row")).otherwise(hashed(F.lit(again), *docs.columns))).drop("_shared")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document stays, that of the smallest id; documents without words all stay.

    Rows are told apart by their whole contents, not by their id: rows that share an id but are not linked all stay, and
    of equal rows one does. Rows without an id come last in the choice. An empty table gives an empty result; null text
    has no words; columns other than those of documents are left out, whatever their names.
    """
    small_batches(spark)
    whole = told_apart(docs.select(*COLUMNS))
    found = checkpointed(jaccard_groups(whole, "_row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stay = checkpointed(found.where("label is not null").groupBy("label").agg(first.alias("f")).select(F.col("f.row").alias("_stay")))
    empty = found.where("label is null").select(F.col("row").alias("_stay")).distinct()
    kept = whole.join(sized(stay), F.col("_row") == F.col("_stay"), "left_semi")
    if found.where("label is not null").groupBy("row").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_row"])
    return kept.union(whole.join(sized(empty), F.col("_row") == F.col("_stay"), "left_semi")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. No row goes: null text stays null, repeated rows are read one by one.

    An empty table gives an empty result; other columns are left out.
    """
    small_batches(spark)
    return _sized_text(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 2048 tokens.

    Null or empty text is its closing id alone; rows that repeat an id, or have none, are packed one by one; an empty table
    gives an empty result.
    """
    import public_tokenizers

    small_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again in the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
