"""Evaluation of 0/1 predictions, -1 where the output could not be read."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prediction_pairs(columns: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Category -> (label column, prediction column) for every pred_x that has a label_x or, alone, a label."""
    out = {}
    for c in columns:
        if m := re.fullmatch(r"pred_(\w+)", c):
            label = f"label_{m[1]}" if f"label_{m[1]}" in columns else "label" if "label" in columns else None
            if label:
                out[m[1]] = (label, c)
    return out


def long_predictions(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each pair of label y and prediction p, with its category."""
    pairs = prediction_pairs(rows.columns)
    each = [F.struct(F.lit(k).alias("category"), F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p")) for k, (y, p) in pairs.items()]
    return rows.select(*by, F.inline(F.array(*each)))


def _counts() -> list[Column]:
    y, p = F.col("y"), F.col("p")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(p == -1).alias("n_invalid"),
        F.count_if(y == 1).alias("n1"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    ]


def binary_metrics(rows: DataFrame, by: Sequence[str] = ("category",), invalid_policy: str = "count_as_error") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 of (y, p) in each group; 0/0 is 0, no rows is null.

    invalid_policy: "count_as_error" scores all rows, "exclude" those with a readable output; either way invalid_rate
    is of all rows. Weighted recall equals accuracy.
    """
    if invalid_policy not in ("count_as_error", "exclude"):
        raise ValueError(invalid_policy)
    c = rows.groupBy(*by).agg(*_counts())
    col, ratio = F.col, lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    if invalid_policy == "exclude":
        total, s1 = col("n") - col("n_invalid"), col("tp") + col("fn")
    else:
        total, s1 = col("n"), col("n1")
    s0 = total - s1
    p1, r1 = ratio(col("tp"), col("tp") + col("fp")), ratio(col("tp"), s1)
    p0, r0 = ratio(col("tn"), col("tn") + col("fn")), ratio(col("tn"), s0)
    f = lambda p, r: ratio(2 * p * r, p + r)
    mean = lambda a, b: ratio(a * s0 + b * s1, total)
    return c.select(
        *by,
        "n",
        (col("n") - col("n_invalid")).alias("valid_samples"),
        ratio(col("tp") + col("tn"), total).alias("accuracy"),
        mean(p0, p1).alias("precision"),
        mean(r0, r1).alias("recall"),
        mean(f(p0, r0), f(p1, r1)).alias("f1"),
        F.try_divide(col("n_invalid"), col("n")).alias("invalid_rate"),
    )


def macro_average(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "invalid_rate")])


def confusion_matrix(rows: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """Long form: y, p, n and the rate within y, for pairs that occur."""
    counts = rows.groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "y"))
    return counts.select(*by, "y", "p", "n", (F.col("n") / total).alias("rate"))


def confusion_array(rows: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """Row-normalised matrix as nested arrays: 2 by 2, or 3 by 3 in the order -1, 0, 1 where outputs are invalid.

    An empty row is zeros; the matrix is null if no output is valid.
    """
    c = rows.groupBy(*by).agg(*_counts(), F.count_if((F.col("y") == 1) & (F.col("p") == -1)).alias("i1"))
    col, ratio = F.col, lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s1, s0, i0 = col("n1"), col("n") - col("n1"), col("n_invalid") - col("i1")
    two = F.array(F.array(ratio(col("tn"), s0), ratio(col("fp"), s0)), F.array(ratio(col("fn"), s1), ratio(col("tp"), s1)))
    three = F.array(
        F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)),
        F.array(ratio(i0, s0), ratio(col("tn"), s0), ratio(col("fp"), s0)),
        F.array(ratio(col("i1"), s1), ratio(col("fn"), s1), ratio(col("tp"), s1)),
    )
    matrix = F.when(col("n_invalid") < col("n"), F.when(col("n_invalid") > 0, three).otherwise(two))
    return c.select(*by, matrix.alias("confusion_matrix"))


def bias_table(rows: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """Cells, accuracies overall and by class, FPR, FNR and FNR - FPR. Invalid outputs are in no cell but are errors."""
    c = rows.groupBy(*by).agg(*_counts())
    col, ratio = F.col, lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    fpr, fnr = ratio(col("fp"), col("fp") + col("tn")), ratio(col("fn"), col("fn") + col("tp"))
    return c.select(
        *by, "n", "tp", "tn", "fp", "fn",
        ratio(col("tp") + col("tn"), col("n")).alias("accuracy"),
        ratio(col("tp"), col("n1")).alias("accuracy_pos"),
        ratio(col("tn"), col("n") - col("n1")).alias("accuracy_neg"),
        fpr.alias("fpr"), fnr.alias("fnr"), (fnr - fpr).alias("error_difference"),
    )
