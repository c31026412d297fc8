"""Validation and aggregation of annotators' labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.text import csv_codes, has_label, sanitize


def coverage(log: DataFrame, expected: int, annotator: str = "annotator", item: str = "id") -> DataFrame:
    """Distinct items of each annotator, and whether they are as many as expected."""
    return log.groupBy(annotator).agg(F.countDistinct(item).alias("n_items")).withColumn("complete", F.col("n_items") == expected)


def exclusivity_violations(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of each code column in which code 0 stands beside another; repeats are not removed first."""
    def count(c: str) -> Column:
        codes = F.split(c, ",")
        return F.count_if(F.array_contains(codes, "0") & (F.size(codes) > 1)).alias(c)

    wide = log.agg(*[count(c) for c in columns])
    return wide.unpivot([], list(columns), "label", "n_violations")


def _best(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None) -> DataFrame:
    """The first row of each key in an order. Each task ranks its rows before the shuffle and hands on one of a key.

    Columns that nothing reads later are not read at all. Texts that are only keys are dealt by 256-bit digests.
    """
    kept = list(rows.columns if columns is None else columns)
    types = dict(rows.dtypes)
    by = [F.unhex(F.sha2(F.col(k), 256)) if types[k] == "string" and k not in kept else F.col(k) for k in keys]
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").select(*kept)


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The last row of each key by a total order (all columns, or some). No row is arbitrary, as with dropDuplicates."""
    return _best(rows, keys, [F.desc(c) for c in order], columns)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    return _best(rows, keys, [F.asc(c) for c in order], columns)


def duplicate_count(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("n_duplicates"))


def binarize(rows: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    return rows.withColumns({f"{c}_bin": has_label(F.col(c), strict) for c in columns})


def majority_mean(rows: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """1 where at least half the annotators say 1 (a tie is 1). columns: source -> result. Null keys are left out."""
    known = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return known.groupBy(*keys).agg(*[(F.avg(c) >= 0.5).cast("int").alias(out) for c, out in columns.items()])


def majority_mode(rows: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """The most frequent value; the smallest of those tied."""
    return rows.groupBy(*keys).agg(*[F.mode(c, True).alias(out) for c, out in columns.items()])


def _column(prefix: str, name: str) -> str:
    return f"{prefix}_{name.replace(' ', '_').replace('/', '_')}"


def majority_multilabel(rows: DataFrame, key: str, codes: str, names: Mapping[int, str], prefix: str, least: int = 2) -> DataFrame:
    """One 0/1 column for each category: 1 if at least `least` of its codes were given. A code twice counts twice."""
    flat = rows.select(key, F.explode_outer(csv_codes(F.col(codes))).alias("code"))
    return flat.groupBy(key).agg(*[(F.count_if(F.col("code") == k) >= least).cast("int").alias(_column(prefix, n)) for k, n in names.items()])


def votes(rows: DataFrame, key: str, binary: Mapping[str, str], dimensions: Mapping[str, Mapping[int, str]], least: int = 2) -> DataFrame:
    """key, modal binary labels, and a 0/1 column for each category of each dimension (its codes in label_<name>).

    One aggregation for all: codes are counted within rows, so that nothing is exploded or joined.
    """
    listed = rows.select(key, *binary, *[csv_codes(F.col(f"label_{d}")).alias(f"_{d}") for d in dimensions])

    # As SQL: an expression of many lambdas is dear to put together piece by piece.
    count = lambda d, k: F.expr(f"coalesce(sum(cast(size(filter(`_{d}`, x -> x = {k})) as long)) >= {least}, false)")
    modes = [F.mode(c, True).alias(out) for c, out in binary.items()]
    each = [count(d, k).cast("int").alias(_column(d, n)) for d, names in dimensions.items() for k, n in names.items()]
    return listed.groupBy(key).agg(*modes, *each)


def soft_labels(rows: DataFrame, key: str, codes: str, names: Mapping[int, str], prefix: str) -> DataFrame:
    """Each annotator's weight 1 divided among its codes, summed and scaled to 1 in all; zeros if there is none."""
    listed = csv_codes(F.col(codes))
    flat = rows.select(key, F.explode_outer(listed).alias("code"), F.size(listed).alias("n"))
    weight = F.when(F.col("n") > 0, 1.0 / F.col("n"))
    known = F.col("code").isin(list(names))
    part = [F.sum(F.when(F.col("code") == k, weight)).alias(f"_{k}") for k in names]
    wide = flat.groupBy(key).agg(*part, F.sum(F.when(known, weight)).alias("_all"))
    return wide.select(key, *[F.coalesce(F.try_divide(f"_{k}", "_all"), F.lit(0.0)).alias(_column(prefix, n)) for k, n in names.items()])


def soft_table(rows: DataFrame, key: str, binary: Mapping[str, str], dimensions: Mapping[str, Mapping[int, str]]) -> DataFrame:
    """key, binary labels by mean (a tie is 1), and the soft labels of every dimension (codes in label_<name>).

    One aggregation for all: a code's share of its annotator's weight is summed within rows, so nothing is exploded or
    joined. Rows without a key are left out.
    """
    known = rows.where(F.col(key).isNotNull())
    listed = known.select(key, *binary, *[csv_codes(F.col(f"label_{d}")).alias(f"_{d}") for d in dimensions])

    def weight(d: str, wanted: Sequence[int]) -> Column:
        return F.expr(f"sum(coalesce(try_divide(cast(size(filter(`_{d}`, x -> x in ({', '.join(map(str, wanted))}))) as double), cast(size(`_{d}`) as double)), 0D))")

    sums, out = [], []
    for d, names in dimensions.items():
        whole = f"_{d}_all"
        sums.append(weight(d, list(names)).alias(whole))
        for k, n in names.items():
            sums.append(weight(d, [k]).alias(f"_{d}_{k}"))
            out.append(F.coalesce(F.try_divide(f"_{d}_{k}", whole), F.lit(0.0)).alias(_column(d, n)))
    modes = [(F.avg(c) >= 0.5).cast("int").alias(o) for c, o in binary.items()]
    return listed.groupBy(key).agg(*modes, *sums).select(key, *binary.values(), *out)


def label_frequency(rows: DataFrame, codes: str, book: DataFrame) -> DataFrame:
    """Count and share of every category of book (code, name), also those never given."""
    flat = rows.select(F.explode(csv_codes(F.col(codes))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    every = F.broadcast(book).join(flat, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = every.agg(F.sum("n").alias("_total"))
    out = every.join(F.broadcast(total)).select("code", sanitize(F.col("name")).alias("name"), "n", F.try_divide("n", "_total").alias("share"))
    return out


def disagreement(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose annotators differ in any of the columns."""
    return with_disagreement(rows, key, columns).where("_disagree").select(key)


def with_disagreement(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, _disagree: whether annotators differ in any of the columns."""
    spans = rows.groupBy(key).agg(*[(F.min(c) < F.max(c)).alias(f"_{k}") for k, c in enumerate(columns)])
    return spans.select(key, F.coalesce(F.greatest(*[F.coalesce(f"_{k}", F.lit(False)) for k in range(len(columns))], F.lit(False)), F.lit(False)).alias("_disagree"))


def split_by_disagreement(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """rows with _disagree of their key: one shuffle by key, in place of a join of rows with themselves."""
    own = Window.partitionBy(key)
    differ = F.lit(False)
    for c in columns:
        differ = differ | F.coalesce(F.min(c).over(own) < F.max(c).over(own), F.lit(False))
    return rows.withColumn("_disagree", differ)
