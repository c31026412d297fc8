"""Queries against their SQL on items whose numbers have more digits than the names of their images keep."""

from collections import Counter

import duckdb
import pytest

from tallyforge.plans.queries import ORACLES, QUERIES

IDS = [*range(60), *range(9_998, 10_004), *range(99_980, 100_040), *range(1_000_000, 1_000_020)]
#: Queries that tell items apart by their images.
BY_IMAGE = ["annotation_sample", "found_items", "queue_by_task", "split_items_keep_first", "workflow_descriptive", "workflow_evaluate_api", "workflow_evaluate_api_fine"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    made = {
        "documents": ([(k, f"text {k}", "en", "web", 7 * k % 11) for k in IDS], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(k, k % 3 % 2, k % 5 % 2) for k in IDS], "doc_id long, quality int, toxic int"),
        "events": ([(k, k % 3, "click error view purchase".split()[k % 4], f'{{"k": {k * k % 10}}}') for k in range(5000)], "event_id long, user_id long, event_type string, props string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).selectExpr("*", *["timestamp'2024-01-01' as ts"] * (name == "events")).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", BY_IMAGE)
def test_long_ids(spark, tables, name):
    found = QUERIES[name](spark, tables)
    with duckdb.connect() as con:
        for table in ("documents", "labels", "events"):
            con.execute(f"create view {table} as select * from '{tables}/{table}.parquet/*.parquet'")
        truth = con.execute(f"select {', '.join(found.columns)} from ({ORACLES[name]})").fetchall()
    assert truth and Counter(map(tuple, found.collect())) == Counter(truth)
