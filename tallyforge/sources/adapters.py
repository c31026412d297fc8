"""The driver's tables in the shapes of an annotation log, a gold set and raw model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.parse import FIELDS, field_label, first_label
from tallyforge.session import ship_package


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1)
    code = F.pmod(k.cast("int"), F.lit(5))
    return load(spark, sf_dir, "events").select(
        (F.col("event_id") % 997).alias("id"),
        F.concat(F.lit("Annotator_"), (F.col("user_id") % 3 + 1).cast("string")).alias("annotator"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("time"),
        F.concat(F.lit("item "), (F.col("event_id") % 997).cast("string")).alias("text"),
        F.col("event_type").isin("error", "purchase").cast("int").alias("label_hateful"),
        F.when(code == 2, "1").when(code == 3, "1,2").when(code == 4, "3").otherwise("0").alias("label_incivility"),
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(k, F.lit("([0-9])"), 1))), ",").alias("label_intolerance"),
    )


def image(key: Column, digits: Column | int = 5) -> Column:
    """Name of an item's image, by the number of `digits` digits: of a longer number the first ones."""
    return F.concat(F.lit("img/"), F.lpad(key.cast("string"), digits, "0"), F.lit(".png"))


def whole_image(key: Column) -> Column:
    """The image's name by the whole number, so that items of six digits and more have images of their own."""
    return image(key, F.greatest(F.lit(5), F.length(key.cast("string"))))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    m = F.pmod("doc_id", F.lit(5))
    intolerant = (F.col("n_chars") % 3 == 0) | ((F.col("toxic") == 1) & (F.col("n_chars") % 2 == 0))
    return rows.select(
        F.col("doc_id").alias("id"),
        "text",
        image(F.col("doc_id")).alias("img"),
        F.when(m == 0, "dev_seen").when(m == 1, "dev_unseen").when(m == 2, "test_seen").when(m == 3, "test_unseen").otherwise("train").alias("split"),
        F.col("toxic").alias("label_hateful"),
        (1 - F.col("quality")).alias("label_incivility"),
        intolerant.cast("int").alias("label_intolerance"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    coarse = F.when(p == "1-URGENT", "  Hateful ").when(p == "2-HIGH", "Neutral.").when(p == "3-MEDIUM", "This is NOT hateful").when(p.startswith("4"), "neutral").otherwise("cannot say")
    m4, m5, m3 = F.col("o_orderkey") % 4, F.col("o_custkey") % 5, F.col("o_orderkey") % 3
    civil = F.when(m4 == 0, "Incivility: Civil").when(m4 == 1, "Incivility:Uncivil").when(m4 == 2, "incivility: uncivil").otherwise("n/a")
    tolerant = F.when(m5 == 0, "Intolerance: Intolerant").when(m5 == 1, "intolerance:intolerant").when(m5 == 2, "none").otherwise("Intolerance: Tolerant")
    hateful = F.when(m3 == 0, "Hatefulness: Hateful").when(m3 == 1, "hatefulness:neutral").otherwise("Hatefulness:  Hateful")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("int").alias("label_hateful"),
        (F.col("o_totalprice") > 100000).cast("int").alias("label_incivility"),
        (F.col("o_custkey") % 3 == 0).cast("int").alias("label_intolerance"),
        coarse.alias("output_coarse"),
        F.concat_ws(", ", civil, tolerant, hateful).alias("output_joint"),
    )


def parsed(rows: DataFrame, task: str) -> DataFrame:
    """Predictions of a task read out of the raw output."""
    labels = ["label_hateful", "label_incivility", "label_intolerance"]
    if task == "coarse":
        return rows.select("id", "o_orderpriority", "label_hateful", first_label(F.col("output_coarse")).alias("pred_hateful"))
    fields = list(FIELDS) if task == "joint" else ["incivility", "intolerance"]
    return rows.select("id", "o_orderpriority", *labels, *[field_label(F.col("output_joint"), f).alias(f"pred_{f}") for f in fields])
