"""Readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id bigint, img string, label int, text string"
ANNOTATION = "id bigint, annotator string, label_incivility string, label_intolerance string, label_hateful int, text string, time string, img string"
PREDICTION = "id bigint, label_hateful int, label_incivility int, label_intolerance int, output string, pred_hateful int, pred_incivility int, pred_intolerance int"
API_PREDICTION = "id bigint, label int, output string, reasoning string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(jpath)] if system.exists(jpath) else []


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines; tolerant drops lines that cannot be read, otherwise they are an error."""
    return spark.read.schema(schema).json(path if isinstance(path, str) else list(path), mode="DROPMALFORMED" if tolerant else "FAILFAST")


class BadLines(ValueError):
    """More lines of a log cannot be read than the caller allows."""


@dataclass
class Log:
    """rows: what can be read, with `place`; bad: file, block, row and text of the lines that cannot; counts: of each file."""

    rows: DataFrame
    bad: DataFrame
    counts: DataFrame


def place() -> Column:
    """A line's place in its files: name, beginning of the block, and row in it, however files are dealt to tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def placed_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """_line and place of the lines of text files."""
    return spark.read.text(path if isinstance(path, str) else list(path)).select(F.col("value").alias("_line"), place().alias("place"))


def streamed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """As placed_lines, of a stream of files, in which rows have no numbers: a file, one append of its writer, is read whole."""
    files = spark.readStream.option("wholetext", "true").text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("row", "_line"))
    return lines.select("_line", F.struct("file", F.lit(0).cast("long").alias("block"), F.col("row").cast("long").alias("row")).alias("place"))


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """_row (of schema), _bad, _line and place of lines that hold something; _bad: the line cannot be read whole."""
    read = F.from_json("_line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where("_line rlike '[^ \\\\t-\\\\r]'").select("_line", "place", read.alias("_row"))
    return rows.withColumn("_bad", F.col("_row").isNull() | F.col("_row._corrupt").isNotNull())


def good_rows(parsed: DataFrame, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    return parsed.where("not _bad").select(*[F.col(f"_row.{n}").alias(n) for n in names], "place")


def bad_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where("_bad").select("place.*", F.col("_line").alias("line"))


def annotation_log(spark: SparkSession, path: str | Sequence[str], schema: str = ANNOTATION) -> Log:
    """A log that may hold bad lines: cut-off ones, or values of another type. None is lost: bad ones are a table with
    their place, to be mended or written beside, and every file has its counts. Empty lines are no lines.
    """
    parsed = parsed_lines(placed_lines(spark, path), schema)
    counts = parsed.groupBy(F.col("place.file").alias("file")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("_bad").alias("n_bad"))
    return Log(good_rows(parsed, schema), bad_lines(parsed), counts)


def check_bad_lines(log: Log, most: float = 0.01) -> None:
    """BadLines if more than a share of all lines is bad, with the file that has most of them."""
    found = log.counts.agg(F.sum("n_lines").alias("n"), F.sum("n_bad").alias("bad"), F.max_by("file", "n_bad").alias("file")).first()
    if found.n and found.bad > most * found.n:
        raise BadLines(f"{found.bad} of {found.n} lines cannot be read, most of them in {found.file}")


def split_items(spark: SparkSession, paths: Mapping[str, str], schema: str = ITEM) -> DataFrame:
    """Items of several split files with split and priority (0 first), which keep-first relies on.

    seq is the place in the files.
    """
    out = None
    for k, (name, path) in enumerate(paths.items()):
        one = json_lines(spark, path, schema).select("*", F.lit(name).alias("split"), F.lit(k).alias("priority"), place().alias("seq"))
        out = one if out is None else out.union(one)
    return out


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One integer a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("id")).where("id is not null")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name) of files; their bytes are not read."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return paths.withColumn("name", F.element_at(F.split("path", "/"), -1))


def images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A dataset partitioned by split; one split reads its own folder only."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


def predictions(spark: SparkSession, path: str, schema: str = PREDICTION) -> DataFrame | None:
    """Row-level results, or None where the file is not there."""
    return json_lines(spark, path, schema) if exists(spark, path) else None


def annotated_by(spark: SparkSession, path: str, annotator: str) -> DataFrame:
    """An annotator's part of a log that may hold bad lines."""
    return annotation_log(spark, path).rows.where(F.col("annotator") == annotator).drop("place")
