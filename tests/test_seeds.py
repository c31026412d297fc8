"""Seeds that each order all rows anew, against sorting on one machine."""

import hashlib

from tallyforge.operators import curate
from tallyforge.plans.queries import LABELS, QUERIES
from tests.test_long_ids import tables  # noqa: F401


def parts_of(rows, seed):
    """rows: (id, split, labels ...); id -> part."""
    parts = {}
    for split in {r[1] for r in rows}:
        ids = sorted((r[0] for r in rows if r[1] == split), key=lambda k: (k is None, hashlib.md5(f"{k}-{seed}".encode()).hexdigest(), k))
        held = -(-3 * len(ids) // 10)
        test = -(-2 * held // 3)
        parts |= {k: "test" if n < test else "validation" if n < held else "train" for n, k in enumerate(ids)}
    return parts


def drift_of(rows, seed):
    parts, drifts = parts_of(rows, seed), []
    for c in range(2, len(rows[0])):
        own = {p: [r[c] for r in rows if parts[r[0]] == p and r[c] is not None] for p in ("train", "validation", "test")}
        mean = {p: sum(v) / len(v) for p, v in own.items()}
        drifts.append((abs(mean["validation"] - mean["train"]) + abs(mean["test"] - mean["train"])) / 2)
    return round(sum(drifts) / len(drifts), 9)


def best_of(rows, seeds):
    return min((drift_of(rows, s), s) for s in range(seeds))


def test_seeds_order_all_rows_anew(spark):
    for n in (150, 12_000):
        rows = [(k if k else None, "ab"[k % 2] if k % 7 else None, int(k % 3 == 0), int(k % 5 == 0) if k % 11 else None) for k in range(n)]
        df = spark.createDataFrame(rows, "id long, split string, a int, b int").repartition(3)
        best = curate.best_seed(df, ["split"], "id", ["a", "b"], 9, apart=True).first()
        assert (best.drift, best.seed) == best_of(rows, 9)
        assert {r.id: r.part for r in curate.stratified_split(df, ["split"], "id", 7, apart=True).collect()} == parts_of(rows, 7)
    assert curate.best_seed(df.limit(0), ["split"], "id", ["a"], 3, apart=True).first().seed is None


def test_query_best_seed(spark, tables):  # noqa: F811
    from tallyforge.sources.adapters import gold

    rows = [tuple(r) for r in gold(spark, tables).select("id", "split", *LABELS).collect()]
    best = QUERIES["best_seed"](spark, tables).first()
    assert (best.drift, best.seed) == best_of(rows, 50)


def gold_rows(spark, tables):  # noqa: F811
    return [tuple(r) for r in QUERIES["workflow_gold"](spark, tables).select("id", "split", *LABELS, "part").collect()]


def test_query_workflow_gold(spark, tables):  # noqa: F811
    found = gold_rows(spark, tables)
    rows = [r[:-1] for r in found]
    assert {r[0]: r[-1] for r in found} == parts_of(rows, best_of(rows, 20)[1])


def test_query_workflow_gold_balance(spark, tables):  # noqa: F811
    rows = [r[:-1] for r in gold_rows(spark, tables)]
    found = QUERIES["workflow_gold_balance"](spark, tables).collect()
    assert len(found) == len(LABELS) and abs(sum(r.drift for r in found) / len(found) - best_of(rows, 20)[0]) < 1e-8
