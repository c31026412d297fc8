"""The append-only annotation log as a stream: the latest row of each key, kept as Parquet in buckets of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.labels import keep_last
from tallyforge.sources.readers import ANNOTATION, bad_lines, exists, good_rows, parsed_lines, streamed_lines
from tallyforge.sources.sinks import append_batch, read_batches

#: Type of a line's place in its files.
PLACE = "struct<file: string, block: bigint, row: bigint>"


def read_log(spark: SparkSession, folder: str, schema: str = ANNOTATION) -> DataFrame:
    """The lines that can be read, with their `place` in the files; read_bad has the others."""
    return good_rows(parsed_lines(streamed_lines(spark, folder), schema), schema)


def read_bad(spark: SparkSession, folder: str, schema: str = ANNOTATION) -> DataFrame:
    """The lines that cannot be read, with their place, as a stream of its own."""
    return bad_lines(parsed_lines(streamed_lines(spark, folder), schema))


def _order(log: DataFrame, order: Sequence[str] | None) -> list[str]:
    """The order given, or time and, of equal times, the place in the files."""
    return list(order) if order is not None else [c for c in ("time", "place") if c in log.columns]


def _folders(spark: SparkSession, folder: str, prefix: str) -> dict[int, str]:
    """Numbered folders prefix=N in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
    return {int(n[len(prefix) + 1 :]): f"{folder}/{n}" for n in names if n.startswith(f"{prefix}=")}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _buckets(spark: SparkSession, target: str) -> dict[int, dict[int, str]]:
    """For each bucket its finished versions and their folders."""
    out: dict[int, dict[int, str]] = {}
    for v, folder in _folders(spark, target, "v").items():
        if exists(spark, f"{folder}/_SUCCESS"):
            for b, path in _folders(spark, folder, "_bucket").items():
                out.setdefault(b, {})[v] = path
    return out


def keep_latest(
    log: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("annotator", "id"), order: Sequence[str] | None = None, buckets: int = 32
) -> StreamingQuery:
    """The latest row of each key so far, in buckets by a hash of the key: target/v=N/_bucket=K is K as batch N left it.

    A batch reads and writes only the buckets that it has keys of; choose their number once for a table, so that one
    bucket fits a task. A batch that is run again writes the same version from the same predecessors, the newest before
    it, so a restart changes nothing. Two versions of a bucket are kept; older ones go.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    order = _order(log, order)

    def upsert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        touched = [r._bucket for r in batch.select(bucket.alias("_bucket")).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        known = _buckets(spark, target)
        before = {b: max((v for v in known.get(b, ()) if v < n), default=None) for b in touched}
        old = [known[b][v] for b, v in before.items() if v is not None]
        rows = spark.read.schema(batch.schema).parquet(*old).unionByName(batch) if old else batch
        last = keep_last(rows, list(keys), order).withColumn("_bucket", bucket)
        last.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/v={n}")
        for b, v in before.items():
            for gone in [x for x in known.get(b, ()) if v is not None and x < v]:
                _delete(spark, known[b][gone])
        for v, folder in _folders(spark, target, "v").items():
            if v < n and not _folders(spark, folder, "_bucket"):
                _delete(spark, folder)

    return log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, schema: str = f"{ANNOTATION}, place {PLACE}") -> DataFrame:
    """The newest version of every bucket; no rows of schema before the first one is finished."""
    folders = [versions[max(versions)] for versions in _buckets(spark, target).values()]
    return spark.read.parquet(*folders) if folders else spark.createDataFrame([], schema)


def track_latest(log: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("annotator", "id"), order: Sequence[str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """As keep_latest, with the latest row of each key in the engine's state store instead of files that are rewritten.

    A batch reads no older rows: it hands on the keys whose latest row changed, as the batch N of a table of changes
    (sinks.append_batch), which latest_changes puts together. The order is of event time, then of place, so rows that come
    late change nothing that is newer, however late they are, and the state holds one row of each key. A batch that is run
    again after a crash finds its changes written, or writes them anew, from the state of its predecessor.
    """
    order = _order(log, order)
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")

    def write(batch: DataFrame, n: int) -> None:
        # A batch must be read to its end for the state to be kept, even if its changes are written already.
        if not append_batch(batch, target, f"{n:09d}"):
            batch.write.format("noop").mode("overwrite").save()

    return best.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_changes(spark: SparkSession, target: str, schema: str = f"{ANNOTATION}, place {PLACE}", keys: Sequence[str] = ("annotator", "id")) -> DataFrame:
    """The latest row of each key of a table of changes: that of its last finished batch."""
    return keep_last(read_batches(spark, target, schema), list(keys), ["batch"]).drop("batch")
