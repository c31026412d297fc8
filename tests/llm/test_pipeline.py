import random
from collections import defaultdict

import corpus_pipeline
from tallyforge.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(13)
    good = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(60):
        lines = [" ".join(rng.choice(good) for _ in range(12)) for _ in range(rng.randrange(1, 9))]
        rows.append((k, "\n".join(lines)))
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    near = " ".join(rng.choice(good) for _ in range(200)).split()
    rows.append((200, " ".join(near)))
    near[50] = "other"
    rows.append((201, " ".join(near)))
    rows += [(300 + k, " ".join(f"#junk{rng.randrange(30)}$" for _ in range(50))) for k in range(10)]
    rows += [(400, "mail a.b@example.org and " + rows[0][1].split("\n")[0][:30] + " " + " ".join(good[:20])), (401, None), (402, ""), (None, " ".join(good[30:60]))]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    folder = tmp_path / "sf"
    docs = spark.createDataFrame([(i, t, "en", None, len(t) if t else None) for i, t in rows], SCHEMA)
    docs.write.parquet(str(folder / "documents.parquet"))
    labels = spark.createDataFrame([(i, int("junk" not in (t or "")), 0) for i, t in rows if i is not None], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(folder / "labels.parquet"))
    seen = {}
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    kept = seen["quality rules"]
    assert set(kept) == {i for i, t in rows if t and "junk" not in t}
    lines = seen["line dedup"]
    assert not set(lines) & {100 + k for k in range(5)} and {k: lines[k] for k in range(60)} == {k: kept[k] for k in range(60)}
    groups = seen["n-gram Jaccard join"]
    assert set(lines) - set(groups) == {201} and None in groups
    assert seen["personal data"][400].startswith("mail [EMAIL] and")
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(groups)
    filled = defaultdict(int)
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
    assert corpus_pipeline.run(spark, str(folder)).count() == len(pieces)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []


def test_near_duplicates_with_repeated_ids_and_clashing_columns(spark):
    words = lambda a, n=40: " ".join(f"{a}{k}" for k in range(n))
    rows = [
        (1, words("a")), (1, words("b")), (2, words("c")), (3, words("a") + " end"), (None, words("b") + " end"),
        (4, words("d")), (4, words("d")), (5, None), (5, "  "), (5, "  "), (None, words("e")), (None, words("e")), (0, words("f")), (1, words("f") + " x"),
    ]
    df = spark.createDataFrame([(i, t, "en", None, 0, "x", 7, "y") for i, t in rows], SCHEMA + ", _id string, row long, _row string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == corpus_pipeline.COLUMNS
    out = sorted(((r.doc_id or 0), r.text or "") for r in got.collect())
    assert out == sorted([(1, words("a")), (1, words("b")), (2, words("c")), (4, words("d")), (5, ""), (5, "  "), (5, "  "), (0, words("e")), (0, words("f"))])


def test_rows_with_one_hash_are_told_apart(spark):
    from pyspark.sql import functions as F

    rows = [(k % 7, f"text {k % 40}", "en", None, k % 3) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    few = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(5000))
    got = corpus_pipeline.told_apart(df, few).collect()
    assert len(got) == 300
    of_row = {}
    for r in got:
        of_row.setdefault(r["_row"], set()).add(tuple(r)[:5])
    assert all(len(x) == 1 for x in of_row.values()) and len(of_row) == len(set(rows))


def test_stages_with_odd_rows(spark, tmp_path):
    """Null in any column, repeated rows, a very long text and columns of clashing names pass every stage."""
    spark.createDataFrame([(1, 1, 0), (None, 1, None), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"word{k}" for k in range(30000))
    text = " ".join(f"some{k}" for k in range(30))
    rows = [(1, text, None, None, None), (1, text, "en", "s", 5), (None, long, "en", None, 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, long + " end", "x", "y", 1)]
    extra = ", _doc string, _row long, _id long, kept string, n_lines long, spans string"
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, spark.createDataFrame([(*r, "a", 1, 2, "b", 3, "c") for r in rows], SCHEMA + extra), str(tmp_path))
        if k < 4:
            assert got.columns == corpus_pipeline.COLUMNS
        assert got.count() >= 2


def test_registry():
    assert sum(n.startswith("op") for n in QUERIES) == 13 and "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)
