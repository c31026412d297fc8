import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyforge.llm import quality_llr
from tallyforge.llm.quality_llr import ALPHA, BUCKETS, PRIOR, THRESHOLD, UNIT, filter_quality, score_quality, trusted_ids

SCHEMA = "doc_id long, text string, kept string, _h int, n_words string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    text, w = text or "", words(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(5)}
    lines = [s for s in text.split("\n") if words(s)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def corpus():
    rng = random.Random(12)
    good = [f"good{k}" for k in range(40)]
    bad = [f"junk{k}#" for k in range(40)]
    rows = []
    for k in range(160):
        pool = bad if k % 4 == 0 else good
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 90)))
        if k % 7 == 0:
            text = text.replace(" ", "\n", 3) + "\n" + text[:40] + "\n" + text[:40]
        if k % 9 == 0:
            text += " a b c d e f g é🙂 a b c d e f g é🙂"
        rows.append((k, text))
    return [*rows, (500, None), (501, ""), (502, " \n\t \x0b"), (3, rows[3][1]), (None, rows[5][1])]


def frames(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in corpus()], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(0, 160, 2)] + [(1, 1, 1), (2, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_base_figures(spark):
    docs, labels = frames(spark)
    got = score_quality(docs, trusted_ids(labels)).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    mine = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key)
    assert mine == sorted(((i, *base(t)) for i, t in corpus()), key=key)
    assert all(not (r.base_failed and r.kept) for r in got)


def test_ratio_against_brute_force(spark):
    docs, labels = frames(spark)
    grams = {i: [(w,) for w in words(t)] + list(zip(words(t), words(t)[1:], strict=False)) for i, t in corpus() if i is not None}
    every = sorted({g for x in grams.values() for g in x})
    rows = spark.createDataFrame([(k, *g, *[None] * (2 - len(g)), len(g)) for k, g in enumerate(every)], "k int, a string, b string, n int")
    hashed = F.when(F.col("n") == 1, F.xxhash64("a")).otherwise(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")))
    bucket = {every[r.k]: r.h % BUCKETS for r in rows.select("k", hashed.alias("h")).collect()}
    trusted = {r[0] for r in trusted_ids(labels).collect()} - {None}
    raw, target = Counter(), Counter()
    for i, t in corpus():
        own = [(w,) for w in words(t)] + list(zip(words(t), words(t)[1:], strict=False))
        raw.update(bucket[g] for g in own)
        if i in trusted:
            target.update(bucket[g] for g in own)
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: round(UNIT * math.log((target[b] + ALPHA * share) / ((raw[b] + ALPHA) * share))) for b in raw}
    for x in score_quality(docs, trusted_ids(labels)).where("doc_id is not null").collect():
        own = grams[x.doc_id]
        total = sum(ratio[bucket[g]] for g in own)
        assert abs(x.llr - total / (max(1, len(own)) * UNIT)) < 1e-12
        assert x.kept == (not x.base_failed and total >= round(THRESHOLD * UNIT) * max(1, len(own)))


def test_separates_and_filters(spark):
    docs, labels = frames(spark)
    kept = filter_quality(docs, trusted_ids(labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    good = {i for i, t in corpus() if i is not None and not base(t)[-1] and "good" in t}
    assert good <= ids and not any("junk" in t for i, t in corpus() if i in ids)
    assert filter_quality(docs.limit(0), trusted_ids(labels)).collect() == []
    untaught = filter_quality(docs, trusted_ids(labels.limit(0)))
    assert untaught.count() == sum(not base(t)[-1] for _, t in corpus())


def test_threshold_follows_trusted_scores(spark, monkeypatch):
    monkeypatch.setattr(quality_llr, "TRUSTED_PER_MISS", 20)
    docs, labels = frames(spark)
    trusted = trusted_ids(labels)
    fixed = score_quality(docs, trusted).where("n_words >= 10 and doc_id is not null").collect()
    ids = {r[0] for r in trusted.collect()}
    scores = sorted(math.floor(r.llr * UNIT + 1e-9) for r in fixed if r.doc_id in ids)
    n, rank = len(scores), len(scores) / 20
    quantile = scores[int(rank)] + (rank - int(rank)) * (scores[int(rank) + 1] - scores[int(rank)])
    least = round((n * quantile + PRIOR * THRESHOLD * UNIT) / (n + PRIOR)) / UNIT
    assert least > THRESHOLD
    for r in score_quality(docs, trusted, threshold=None).where("doc_id is not null").collect():
        assert r.kept == (not r.base_failed and r.llr >= least - 1e-9)
    assert score_quality(docs, trusted_ids(labels.limit(0)), threshold=None).where("kept = base_failed").count() == 0


def test_threshold_moves_little_with_one_more_document():
    rng = random.Random(3)
    # Equal scores: a document more draws the threshold a little from the fixed one to theirs, at any number of them.
    last = quality_llr.blended([])
    assert last == THRESHOLD
    for n in range(1, 1201):
        now = quality_llr.blended([(300, n)])
        assert 0 < now - last <= (0.3 - THRESHOLD) / (n + PRIOR - 1)
        last = now
    # Any scores: the rank moves by a two hundredth, so the threshold moves with the two neighbours of that rank only.
    scores = [round(rng.gauss(300, 120)) for _ in range(1200)]
    for n in range(1, 1200):
        old, new = sorted(scores[:n]), sorted(scores[: n + 1])
        k = n // 200
        gap = (max(new[k : k + 3]) - min(new[max(0, k - 1) : k + 3])) / UNIT
        assert abs(quality_llr.blended(sorted(Counter(new).items())) - quality_llr.blended(sorted(Counter(old).items()))) <= gap + 1.0 / (n + PRIOR)
    ordered = sorted(scores)
    assert abs(quality_llr.blended(sorted(Counter(scores).items())) - (1200 * ordered[6] / UNIT + PRIOR * THRESHOLD) / (1200 + PRIOR)) < 1e-9


def test_ties_stay_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(k, f"a{k} b c d e f g h i j k l") for k in range(20)] + [(50, long), (51, "x" * 500_000), (None, long), (52, ("word" + " " * 50_000) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    everything = docs.select("doc_id")
    got = {r.doc_id: r for r in score_quality(docs.where("doc_id is not null"), everything, threshold=0.0).collect()}
    # All documents are trusted: every ratio is 0, which is the threshold itself.
    assert all(got[k].llr == 0 and got[k].kept for k in [*range(20), 50]) and got[50].n_words == 120_000
    assert (got[51].n_words, got[51].kept, got[52].n_words, got[52].word_chars) == (1, False, 12, 48)
    assert score_quality(docs, everything).where("doc_id is null").first().n_words == 120_000


def test_base_figures_by_sql(spark, tmp_path):
    """The DuckDB form of the base figures, on rows of this test."""
    import duckdb

    from tallyforge.llm.queries import ORACLES

    rows = [(i, t) for i, t in corpus() if i is not None][:-1]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    table = con.sql(ORACLES["quality_base_figures"])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(table.select(*names).fetchall()) == sorted((i, *base(t)) for i, t in rows)
