import math

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import parse, text
from tallyforge.operators import chat, curate, evaluate, labels, stats
from tallyforge.plans import config, pipelines
from tallyforge.plans.codebook import INCIVILITY, INTOLERANCE


def test_binary_evaluation(spark):
    rows = [(0, "Neutral")] * 204 + [(0, "Hateful")] * 57 + [(1, "Neutral")] * 25 + [(1, "Hateful")] * 121
    df = spark.createDataFrame(rows, "label_hateful int, output string").withColumn("pred_hateful", parse.first_label(F.col("output")))
    long = evaluate.long_predictions(df)
    m = evaluate.binary_metrics(long).first()
    assert m.accuracy == m.recall == pytest.approx(0.7985257985257985, abs=1e-15)
    assert (m.precision, m.f1, m.invalid_rate) == (pytest.approx(0.815119757320827, abs=1e-14), pytest.approx(0.8018963923725828, abs=1e-14), 0)
    matrix = evaluate.confusion_array(long).first().confusion_matrix
    assert [round(x, 10) for r in matrix for x in r] == [0.7816091954, 0.2183908046, 0.1712328767, 0.8287671233]


@pytest.mark.parametrize("cells, chi2, r", [((623, 129, 96, 1182), 1171.323, 0.761), ((600, 290, 119, 1021), 706.861, 0.591)])
def test_yates(spark, cells, chi2, r):
    df = spark.createDataFrame([cells], "n11 long, n10 long, n01 long, n00 long")
    columns = [F.col(c) for c in df.columns]
    got = df.select(stats.yates_chi2(*columns).alias("chi2"), stats.phi(*columns).alias("r")).first()
    assert (round(got.chi2, 3), round(got.r, 3)) == (chi2, r)


def test_p_value(spark):
    df = spark.createDataFrame([(0.0,), (3.841458820694124,), (None,)], "chi2 double")
    got = [r.p for r in df.select(stats.chi2_p_value("chi2").alias("p")).collect()]
    assert got[0] == 1 and got[1] == pytest.approx(0.05, abs=1e-9) and (got[2] is None or math.isnan(got[2]))


def test_drift(spark):
    parts = {"train": (1420, (502, 627, 526)), "validation": (203, (71, 88, 75)), "test": (407, (146, 175, 151))}
    rows = [(p, *[int(k < n) for n in ones]) for p, (size, ones) in parts.items() for k in range(size)]
    df = spark.createDataFrame(rows, "part string, label_hateful int, label_incivility int, label_intolerance int")
    got = {r.label: round(r.drift, 7) for r in curate.label_balance(df, pipelines.LABELS).collect()}
    assert got == {"label_hateful": 0.0044843, "label_incivility": 0.0098128, "label_intolerance": 0.0007746}


def test_bias_row(spark):
    rows = [(1, 1)] * 81 + [(0, 0)] * 262 + [(0, 1)] * 7 + [(1, 0)] * 70
    df = spark.createDataFrame(rows, "label_hateful int, pred_hateful int")
    b = evaluate.bias_table(evaluate.long_predictions(df)).first()
    assert [round(x, 2) for x in (b.accuracy, b.accuracy_pos, b.accuracy_neg, b.fpr, b.fnr, b.error_difference)] == [0.82, 0.54, 0.97, 0.03, 0.46, 0.44]


def test_invalid_policies(spark):
    rows = [(k % 2, k % 2 if k < 285 else 1 - k % 2) for k in range(401)] + [(1, -1)] * 6
    long = spark.createDataFrame(rows, "y int, p int").withColumn("category", F.lit("c"))
    only = evaluate.binary_metrics(long, invalid_policy="exclude").first()
    every = evaluate.binary_metrics(long).first()
    assert only.accuracy == pytest.approx(0.7107231920199502, abs=1e-15) and only.invalid_rate == pytest.approx(0.014742014742014743, abs=1e-17)
    assert every.accuracy == pytest.approx(285 / 407) and every.valid_samples == 401
    assert len(evaluate.confusion_array(long).first().confusion_matrix) == 3
    none = spark.createDataFrame([("c", 1, -1), ("c", 0, -1)], "category string, y int, p int")
    assert evaluate.confusion_array(none).first().confusion_matrix is None
    m = evaluate.binary_metrics(none).first()
    assert (m.accuracy, m.f1, m.invalid_rate) == (0, 0, 1)
    assert evaluate.binary_metrics(long.limit(0)).collect() == []


def test_classifiers(spark):
    cases = {"not hateful": 1, "neutral or hateful": 1, "  NEUTRAL .": 0, "": -1, None: -1, "what": -1}
    df = spark.createDataFrame([(k,) for k in cases], "o string")
    assert [r.p for r in df.select(parse.first_label(F.col("o")).alias("p")).collect()] == list(cases.values())
    two = first = spark.createDataFrame([("a \n b",)], "o string").select(text.collapse_spaces(F.col("o")).alias("p")).first().p
    assert first == two == "a b"
    fields = {"Incivility: civil": 0, "incivility:UNCIVIL": 1, "Incivility:  civil": -1, None: -1}
    df = spark.createDataFrame([(k,) for k in fields], "o string")
    assert [r.p for r in df.select(parse.field_label(F.col("o"), "incivility").alias("p")).collect()] == list(fields.values())


def test_scalars(spark):
    df = spark.createDataFrame([("",), ("0,3",), (" 1, ,2",), (None,)], "c string")
    got = df.select(text.has_label(F.col("c")).alias("a"), text.has_label(F.col("c"), True).alias("b"), text.csv_codes(F.col("c")).alias("d")).collect()
    assert [r.a for r in got] == [1, 0, 1, None] and [r.b for r in got] == [None, 0, 1, None]
    assert [r.d for r in got] == [[], [0, 3], [1, 2], None]
    one = spark.createDataFrame([("img/gim12.png", "a{}b %s $1", b"x" * 100)], "p string, t string, b binary")
    r = one.select(
        text.strip_charset(F.col("p")).alias("set"), text.strip_prefix(F.col("p")).alias("prefix"), text.fill_template("<{}|{}>", F.col("t")).alias("fill"),
        text.data_url(F.col("b")).alias("url"), text.parent_name(F.lit("a/b/c")).alias("parent"), text.first_of(F.lit(""), F.lit("y")).alias("first"),
        text.display_name(F.lit("incivility_Vulgar_Profane"), "incivility_").alias("name"), text.codes_csv(F.array(F.lit(1), F.lit(2))).alias("csv"),
    ).first()
    assert (r.set, r.prefix, r.fill) == ("12.png", "gim12.png", "<a{}b %s $1|a{}b %s $1>")
    assert "\n" not in r.url and (r.parent, r.first, r["name"], r.csv) == ("b", "y", "Vulgar Profane", "1,2")


def log(spark, rows):
    return spark.createDataFrame(rows, "id long, annotator string, label_incivility string, label_intolerance string, label_hateful int, text string, time string")


def test_label_edges(spark):
    rows = log(spark, [(1, "a", "1,1", "2,3", 0, "t", "1"), (1, "b", "0", "3", 1, "t", "2"), (2, "a", None, None, 1, "u", "3"), (1, "b", "0,2", "3", 1, "t", "4")])
    last = labels.keep_last(rows, ["annotator", "id"], ["time"])
    assert last.count() == 3 and last.where("annotator = 'b'").first().label_incivility == "0,2"
    assert {r.label: r.n_violations for r in labels.exclusivity_violations(rows, pipelines.CODES).collect()} == {"label_incivility": 1, "label_intolerance": 0}
    multi = {r.id: r for r in labels.majority_multilabel(rows, "id", "label_incivility", INCIVILITY, "i").collect()}
    assert (multi[1]["i_Vulgar_Profane"], multi[1]["i_Attacks"], multi[2]["i_Attacks"]) == (1, 0, 0)
    soft = {r.id: r for r in labels.soft_labels(rows.where("time < '4'"), "id", "label_intolerance", INTOLERANCE, "s").collect()}
    assert (soft[1]["s_Political_Intolerance"], soft[1]["s_Racism"]) == (0.25, 0.75) and sum(soft[2][c] for c in soft[2].asDict() if c != "id") == 0
    binary = rows.select("id", F.col("label_hateful").alias("h"))
    assert labels.majority_mean(binary.where("id = 1").limit(2), ["id"], {"h": "h"}).first().h == 1
    assert labels.majority_mode(binary.where("id = 1").limit(2), ["id"], {"h": "h"}).first().h == 0


def test_agreement_edges(spark):
    rows = [(k, a, int(k % 3 == 0), 1) for k in range(9) for a in "xy"] + [(99, "z", 1, 1)]
    df = spark.createDataFrame(rows, "id long, annotator string, p int, q int")
    got = {r.label: r for r in stats.pairwise_agreement(df, ["p", "q"]).collect()}
    assert len(got) == 2 and (got["p"].agreement, got["p"].kappa) == (1, 1) and got["q"].kappa is None
    flipped = stats.pairwise_agreement(df.withColumn("annotator", F.when(F.col("annotator") == "x", "y").when(F.col("annotator") == "y", "x").otherwise("z")), ["p"]).first()
    assert flipped.kappa == got["p"].kappa
    const = spark.createDataFrame([(1, 1), (1, 0)], "x int, y int")
    table = const.agg(*stats.two_by_two(F.col("x"), F.col("y")))
    cells = [F.col(c) for c in table.columns]
    r = table.select(stats.phi(*cells).alias("r"), stats.yates_chi2(*cells).alias("c")).first()
    assert r.r is None and r.c == 0


def test_split_cover(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("int").alias("a"), (F.col("id") % 5 == 0).cast("int").alias("b"))
    parts = curate.stratified_split(df, ["a", "b"], "id", 42)
    counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sum(counts.values()) == 1000 and abs(counts["train"] - 700) < 8 and abs(counts["test"] - 200) < 8
    assert parts.repartition(7).select("id", "part").exceptAll(curate.stratified_split(df.repartition(5), ["a", "b"], "id", 42).select("id", "part")).count() == 0
    assert curate.sample_n(df.limit(2), ["a"], "id", 5, 1).count() == 2
    assert curate.sample_fraction(df, ["a"], "id", 1.0, 1).count() == 1000


def test_logit(spark):
    import random

    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        x = rng.randrange(2)
        rows.append((int(rng.random() < 1 / (1 + math.exp(1 - 2 * x))), float(x), 0.0))
    got = {r.term: r for r in stats.logit_odds_ratios(spark.createDataFrame(rows, "y int, x double, empty double"), "y", ["x", "empty"]).collect()}
    assert set(got) == {"x", "intercept"} and got["x"].low < math.exp(2) < got["x"].high and got["x"].p < 1e-6


def test_chat(spark):
    items = spark.createDataFrame([(1, "a {} b", "img/1.png", 1, 0, 1), (2, None, None, 0, 1, 0)], "id long, text string, img string, label_hateful int, label_incivility int, label_intolerance int")
    flat = chat.flat_messages(chat.training_messages(items, "joint")).where("id = 1").orderBy("turn", "part").collect()
    assert [(r.role, r.type) for r in flat] == [("system", "text"), ("user", "image"), ("user", "text"), ("assistant", "text")]
    assert "Caption: a {} b\n" in flat[2].text and flat[3].text == "Incivility: Civil, Intolerance: Intolerant, Hatefulness: Hateful"
    api = chat.flat_messages(chat.api_messages(items.withColumn("url", F.lit("data:x")), "coarse")).where("id = 2").orderBy("turn", "part").collect()
    assert [r.type for r in api] == ["input_text", "input_text", "input_image"]
    reply = "array<struct<type: string, text: string, summary: array<string>>>"
    df = spark.createDataFrame([(1, [("reasoning", None, ["r1", "r2"]), ("output_text", "first", None), ("output_text", "last", None)]), (2, [])], f"id int, reply {reply}")
    got = pipelines.read_reply(df).orderBy("id").collect()
    assert (got[0].output, got[0].reasoning, got[1].output, got[1].reasoning) == ("last", "r1\nr2", None, None)
    g = chat.fit_geometry(spark.createDataFrame([(2048, 1000), (10, 11)], "w int, h int"), 1024, 768).collect()
    assert [(r.new_w, r.new_h, r.pad_left, r.pad_right, r.pad_top, r.pad_bottom) for r in g] == [(1024, 500, 0, 0, 134, 134), (10, 11, 507, 507, 378, 379)]


def test_config(spark):
    merged = config.merge({"a": {"b": 1, "c": [1, 2]}, "d": "${a.b}"}, {"a": {"c": [3]}, "e": "x-${d}"})
    assert config.resolve(merged) == {"a": {"b": 1, "c": [3]}, "d": 1, "e": "x-1"}
    with pytest.raises(ValueError):
        config.resolve({"a": "${b}", "b": "${a}"})
    assert config.run_grid(spark, [{"r": 8, "m": "x"}, {"r": 16, "q": 0.5}]).count() == 2


def test_category_names():
    """Names that published tables of such logs give to the codes, in order of code."""
    assert list(INCIVILITY.values()) == ["Civil", "Vulgar/Profane", "Attacks", "Aspersions"]
    assert [INTOLERANCE[k] for k in (0, 1, 2, 3)] == ["Tolerant", "Threats to Rights", "Political Intolerance", "Racism"]
    assert [INTOLERANCE[k] for k in (4, 5, 6)] == ["Social Intolerance", "Gender/Sexual Intolerance", "Religious Intolerance"]
    assert [INTOLERANCE[k] for k in (7, 8, 9)] == ["Offensive Stereotypes", "Violent Threats", "Ableism"]


def test_category_rates_by_name(spark):
    """Rates and phi by category, those of code 0 among them."""
    rows = []
    for k in range(200):
        inc, tol, hate = ("2", "3", 1) if k < 60 else ("0", "0", int(k % 10 == 0))
        rows += [(k, who, inc, tol, hate, "t", who) for who in "abc"]
    found = {r.category: r for r in pipelines.fine_grained(labels.binarize(log(spark, rows), pipelines.CODES)).categories.collect()}
    assert set(found) == {"incivility_Attacks", "incivility_Civil", "intolerance_Racism", "intolerance_Tolerant"}
    assert (found["intolerance_Racism"].n, found["intolerance_Racism"].rate, found["incivility_Civil"].n, found["incivility_Civil"].rate) == (60, 1.0, 140, 0.1)
    assert found["incivility_Civil"].phi == pytest.approx(-found["incivility_Attacks"].phi)


def seed_order(key, seed):
    """Buckets of the key's digest, as mixed by the seed; then the digest and the key."""
    import hashlib

    digest = hashlib.md5(str(key).encode()).hexdigest()
    b = int(digest[:3], 16)
    v = (b + 1) * ((seed * 1_000_003 + 40_503) % (2**31 - 1)) % (2**31 - 1)
    return (v * v % (2**31 - 1) * 48_271 + b) % (2**31 - 1), b, digest, key


def naive_drift(rows, seed):
    parts = {"train": [], "validation": [], "test": []}
    for split in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == split), key=lambda r: seed_order(r[0], seed))
        held = -(-3 * len(own) // 10)
        test = -(-2 * held // 3)
        parts["test"] += own[:test]
        parts["validation"] += own[test:held]
        parts["train"] += own[held:]
    mean = lambda p, c: sum(r[c] for r in parts[p]) / len(parts[p])
    drift = [(abs(mean("validation", c) - mean("train", c)) + abs(mean("test", c) - mean("train", c))) / 2 for c in (2, 3)]
    return round(sum(drift) / 2, 9)


def test_best_seed_tells_seeds_apart(spark):
    rows = [(k, "ab"[k % 2] if k % 7 else None, int(k % 3 == 0), int(k % 5 == 0)) for k in range(150)]
    drifts = [naive_drift(rows, s) for s in range(12)]
    assert len(set(drifts)) > 6
    df = spark.createDataFrame(rows, "id long, split string, a int, b int").repartition(3)
    best = curate.best_seed(df, ["split"], "id", ["a", "b"], 12).first()
    assert (best.drift, best.seed) == min((d, s) for s, d in enumerate(drifts))
    whole = [(k, None, a, b) for k, _, a, b in rows]
    best = curate.best_seed(df, [], "id", ["a", "b"], 12).first()
    assert (best.drift, best.seed) == min((naive_drift(whole, s), s) for s in range(12))


def test_best_seed_cuts_through_buckets(spark):
    """Many rows of a bucket: the cut's part of one is its first rows in the order that seeds share."""
    rows = [(k, "ab"[k % 2], int(k % 3 == 0), int(k % 5 == 0)) for k in range(40_000)]
    df = spark.createDataFrame(rows, "id long, split string, a int, b int")
    best = curate.best_seed(df, ["split"], "id", ["a", "b"], 3).first()
    assert (best.drift, best.seed) == min((naive_drift(rows, s), s) for s in range(3))


def test_ranks_of_split_and_sample(spark):
    import hashlib

    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, "x").alias("s"))
    parts, taken = {}, set()
    for own in ([k for k in range(500) if k % 3], [k for k in range(500) if k % 3 == 0]):
        by = sorted(own, key=lambda k: seed_order(k, 7))
        held = -(-3 * len(own) // 10)
        test = -(-2 * held // 3)
        parts |= {k: "test" if r < test else "validation" if r < held else "train" for r, k in enumerate(by)}
        by = sorted(own, key=lambda k: (hashlib.md5(f"{k}-7".encode()).hexdigest(), k))
        taken |= set(by[: math.floor(len(own) * 0.25 + 0.5)])
    for n in (1, 7):
        some = df.repartition(n)
        assert {r.id: r.part for r in curate.stratified_split(some, ["s"], "id", 7).collect()} == parts
        assert {r.id for r in curate.sample_fraction(some, ["s"], "id", 0.25, 7).collect()} == taken
    batch = curate.batches(df, "id", 16, ["s"]).orderBy("s", "id").collect()
    place = {}
    for r in batch:
        n = place.get(r.s, 0)
        assert (r.batch, r.place) == (n // 16, n % 16)
        place[r.s] = n + 1
    assert curate.batches(df.limit(0), "id", 16, ["s"]).count() == 0


def test_batches_of_any_numbers(spark):
    import random

    rng = random.Random(6)
    values = [None, 0.0, -0.5, 1.0, 2.0, 4.0, 1e300, -1e300, 5e-324, 2.0**53, 1023.999, 1024.0] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-5, 12) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    by = sorted(values, key=lambda v: (v is not None, v or 0))
    assert {(r.x, r.batch, r.place) for r in curate.batches(df, "x", 10).collect()} == {(v, k // 10, k % 10) for k, v in enumerate(by)}


def test_no_job_before_an_action(spark):
    """Plans are made without running anything, and a hot stratum is not one task's."""
    df = spark.range(3000).select("id", F.lit("hot").alias("s"), (F.col("id") % 2).alias("a"))
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        made = [curate.stratified_split(df, ["s"], "id", 1), curate.sample_fraction(df, ["s"], "id", 0.5, 1), curate.batches(df, "id", 7, ["s"]), curate.best_seed(df, ["s"], "id", ["a"], 9)]
        for one in made:
            one.explain()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r.n for r in made[0].groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) > 1 and max(sizes) < 1500
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_keep_last_reads_only_what_is_wanted(spark, tmp_path):
    spark.range(50).select("id", F.lit("a").alias("annotator"), F.col("id").alias("seq"), F.lit("text").alias("text")).write.parquet(str(tmp_path / "log"))
    last = labels.keep_last(spark.read.parquet(str(tmp_path / "log")), ["annotator", "id"], ["seq"]).select("id")
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "text" not in plan and "WindowGroupLimit" in plan


def test_kappa_of_many_values_and_overlap(spark):
    rows = [(k, a, v) for k, (x, z) in enumerate([("0", "0"), ("1", "1"), ("2", "1"), ("1,2", "1,2"), ("0", "2"), ("2", "2")]) for a, v in (("x", x), ("y", z))] + [(9, "x", "0")]
    df = spark.createDataFrame(rows, "id long, annotator string, c string")
    r = stats.pairwise_kappa(df, ["c"]).first()
    chance = (2 * 1 + 1 * 2 + 2 * 2 + 1 * 1) / 36
    assert (r.n, r.agreement) == (6, pytest.approx(4 / 6)) and r.kappa == pytest.approx((4 / 6 - chance) / (1 - chance))
    o = stats.overlap(df).first()
    assert (o.n_common, o.n_a, o.n_b, o.complete) == (6, 7, 6, False)


def test_presentation(spark):
    df = spark.createDataFrame([(2.675,), (0.125,), (-1.5,), (None,)], "x double")
    got = [r.y for r in df.select(text.rounded(F.col("x"), 2).alias("y")).collect()]
    assert got[:3] == [2.67, 0.12, -1.5] and (got[3] is None or math.isnan(got[3]))
    ids = spark.createDataFrame([("hub/some/model",), ("runs/joint/26-1/checkpoint-9",)], "m string").withColumn("at", F.timestamp_seconds(F.lit(0)))
    rows = ids.select(text.run_id("joint", F.col("m"), ["hub/"]).alias("id"), text.run_name("eval", F.col("at")).alias("n")).collect()
    assert [r.id for r in rows] == ["eval_joint_hub_some_model", "eval_joint_26-1"] and rows[0].n == "eval_700101-000000"


def test_images(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad")), (3, None)], "id int, content binary")

    def fit(raw, w, h):
        if raw == b"bad":
            raise ValueError("no image")
        return raw + bytes([w, h])

    got = {r.id: r.content for r in chat.fit_images(df, fit, 4, 5).collect()}
    assert got == {1: bytearray(b"ok\x04\x05"), 2: None, 3: None}
    g = chat.fit_geometry(spark.createDataFrame([(3000, 1), (1, 3000), (1025, 768), (1024, 768)], "w int, h int"), 1024, 768).collect()
    assert [(r.new_w, r.new_h) for r in g] == [(1024, 1), (1, 768), (1024, 767), (1024, 768)]
