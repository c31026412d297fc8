"""Writers and report formats."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.readers import exists, listed


def json_document(rows: DataFrame, path: str) -> None:
    """Rows as JSON documents, nulls written."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str, append: bool = False, token: str | None = None) -> None:
    """Rows as JSON lines; with a token as one batch of a table of batches, see append_batch."""
    if token is not None:
        append_batch(rows, path, token, "json")
        return
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def append_batch(rows: DataFrame, path: str, token: str, kind: str = "parquet") -> bool:
    """Rows as the batch `token` of a table: path/batch=token. A batch that is finished is left as it is (False), and an
    unfinished one is written anew, so an append may be tried as often as need be without doubling a row."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", token):
        raise ValueError(f"a batch's token is letters, digits, dots, dashes and underscores, not {token!r}")
    folder = f"{path}/batch={token}"
    if exists(rows.sparkSession, f"{folder}/_SUCCESS"):
        return False
    rows.write.mode("overwrite").option("ignoreNullFields", "false").format(kind).save(folder)
    return True


def finished_batches(spark: SparkSession, path: str) -> list[str]:
    """Tokens of the finished batches of a table, in order."""
    found = [name.removeprefix("batch=") for name in listed(spark, path) if name.startswith("batch=")]
    return sorted(t for t in found if exists(spark, f"{path}/batch={t}/_SUCCESS"))


def read_batches(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The rows of a table's finished batches with their token as `batch`; those of unfinished ones are passed over."""
    folders = [f"{path}/batch={t}" for t in finished_batches(spark, path)]
    if not folders:
        return spark.createDataFrame([], f"{schema}, batch string")
    return spark.read.schema(f"{schema}, batch string").option("basePath", path).format(kind).load(folders)


def id_list(ids: DataFrame, path: str, column: str = "id") -> None:
    ids.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def publish(rows: DataFrame, path: str, by: str = "split") -> None:
    """A dataset partitioned by split, for pruning."""
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def append_metrics(metrics: DataFrame, path: str, token: str | None = None, **tags: str) -> None:
    """Metrics of a run appended to a table of all runs; with a token once, however often it is tried."""
    rows = metrics.withColumns({k: F.lit(v) for k, v in tags.items()} | {"logged_at": F.current_timestamp()})
    append_batch(rows, path, token or uuid.uuid4().hex)


def latex_table(rows: DataFrame, columns: Sequence[str], digits: int = 2, limit: int = 200) -> str:
    """A LaTeX table of a small result (at most `limit` rows reach the driver; more is an error)."""
    found = rows.select(*columns).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows")
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = [" & ".join(show(x) for x in r) + r" \\" for r in found]
    head = " & ".join(show(c) for c in columns) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])


def text_report(sections: dict[str, DataFrame], limit: int = 200) -> str:
    """Titled sections of small results, a row a line; more than `limit` rows in one are an error."""
    out = []
    for title, rows in sections.items():
        out += [title, "=" * len(title)]
        found = rows.limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"{title}: more than {limit} rows")
        out += ["  ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in found]
        out.append("")
    return "\n".join(out)
