"""Regression, logs with bad lines, appends, state of streams, and scorers that resume."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import labels, scoring, stats
from tallyforge.plans import pipelines
from tallyforge.sources import readers, sinks
from tallyforge.streaming import log as stream


def naive_logit(x, y, rounds=60):
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ b))
    cov = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    return b, np.sqrt(np.diag(cov)), float(np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)))


def test_logit_against_newton_on_one_machine(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        a, b = rng.choice([0.0, 0.25, 1.0]), rng.choice([0.0, 0.5, 1 / 3])
        rows.append((int(rng.random() < 1 / (1 + math.exp(0.7 - 1.5 * a + 2 * b))), a, b, 0.0))
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 0.0), (1, None, 0.0, 0.0)], "y int, a double, b double, empty double").repartition(3)
    fit = stats.logit(df, "y", ["a", "b", "empty"])
    coefficients, errors, likelihood = naive_logit(np.array([r[1:3] for r in rows]), np.array([r[0] for r in rows]))
    got = {r.term: r for r in fit.terms.collect()}
    for name, b, se in zip(("a", "b", "intercept"), coefficients, errors, strict=True):
        r = got[name]
        assert r.coefficient == pytest.approx(b, abs=1e-8) and r.se == pytest.approx(se, abs=1e-8) and r.z == pytest.approx(b / se, abs=1e-6)
        assert r.p == pytest.approx(math.erfc(abs(b / se) / math.sqrt(2)), abs=1e-9) and r.odds_ratio == pytest.approx(math.exp(b))
    s = fit.summary.first()
    assert (s.n, s.converged, s.separated, s.singular) == (3000, True, False, False)
    assert s.log_likelihood == pytest.approx(likelihood, abs=1e-7) and s.aic == pytest.approx(6 - 2 * likelihood) and 0 < s.pseudo_r2 < 1


def test_logit_of_separated_dependent_and_no_rows(spark):
    apart = spark.createDataFrame([(int(k > 5), float(k)) for k in range(12)], "y int, x double")
    assert stats.logit(apart, "y", ["x"]).summary.first().separated
    quasi = spark.createDataFrame([(1, 1.0)] * 5 + [(0, 0.0)] * 5 + [(1, 0.0)] * 5, "y int, x double")
    assert stats.logit(quasi, "y", ["x"]).summary.first().separated
    rng = random.Random(1)
    twice = spark.createDataFrame([(rng.randrange(2), float(k % 3), 2.0 * (k % 3)) for k in range(90)], "y int, x double, z double")
    s = stats.logit(twice, "y", ["x", "z"]).summary.first()
    assert s.singular and not s.separated and s.converged
    none = stats.logit(twice.limit(0), "y", ["x"]).summary.first()
    assert none.n == 0 and not none.converged


def test_soft_table_is_the_joined_soft_labels(spark):
    rng = random.Random(3)
    codes = lambda: rng.choice(["0", "1", "1,2", "3,3", "", None, "9", "0,1,2"])
    rows = [(k % 20 if k else None, codes(), codes(), rng.randrange(2)) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, label_incivility string, label_intolerance string, label_hateful int")
    from tallyforge.plans.codebook import DIMENSIONS

    whole = {r.id: r.asDict() for r in labels.soft_table(df, "id", {"label_hateful": "hateful"}, DIMENSIONS).collect()}
    for d, book in DIMENSIONS.items():
        for r in labels.soft_labels(df.where("id is not null"), "id", f"label_{d}", book, d).collect():
            for c, v in r.asDict().items():
                assert whole[r.id][c] == pytest.approx(v)


def test_erfc_and_rounding_are_native(spark):
    values = [0.0, 1e-9, 0.3, 1.0, 2.5, 2.999999, 3.0, 3.1, 5.0, 9.0, 20.0, 40.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", stats.erfc(F.col("x")).alias("y")).collect()
    for r in got:
        assert r.y == pytest.approx(math.erfc(r.x), rel=1e-9, abs=1e-300)
    rng = random.Random(9)
    numbers = [2.675, 0.125, 0.375, -2.675, 1.005, 1e15 + 0.3, 4503599627370497.5, 1e300, -0.0, 0.5, 1.5, 2.5, float("inf"), 5e-324, 0.285, 1.115]
    numbers += [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 14) for _ in range(500)] + [k / 1000 for k in range(0, 3000, 5)] + [k / 16 for k in range(200)]
    df = spark.createDataFrame([(v,) for v in numbers], "x double")
    for digits in (0, 1, 2, 6):
        out = df.select("x", text.rounded(F.col("x"), digits).alias("y"))
        for r in out.collect():
            assert r.y == (r.x if math.isinf(r.x) else round(r.x, digits))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
    assert spark.createDataFrame([(None,)], "x double").select(text.rounded(F.col("x"), 2)).first()[0] is None


def line(k, annotator="A", time="1", hateful=0):
    return {"id": k, "annotator": annotator, "label_incivility": "0", "label_intolerance": "0", "label_hateful": hateful, "text": "t", "time": time, "img": None}


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_bad_lines_are_kept_and_counted(spark, tmp_path):
    write(tmp_path / "a.jsonl", [line(1), '{"id": 2, "annot', "", line(3), "not json", '{"id": "three", "annotator": "A"}'])
    write(tmp_path / "b.jsonl", [line(4)])
    log = readers.annotation_log(spark, str(tmp_path / "*.jsonl"))
    assert sorted(r.id for r in log.rows.collect()) == [1, 3, 4]
    assert sorted(r.line for r in log.bad.collect()) == sorted(['{"id": 2, "annot', "not json", '{"id": "three", "annotator": "A"}'])
    assert {(os.path.basename(r.file), r.n_lines, r.n_bad) for r in log.counts.collect()} == {("a.jsonl", 5, 3), ("b.jsonl", 1, 0)}
    with pytest.raises(readers.BadLines, match="3 of 6 lines.*a.jsonl"):
        readers.check_bad_lines(log)
    readers.check_bad_lines(log, most=0.5)


def test_of_equal_times_the_later_line_counts(spark, tmp_path):
    for k in (1, 2):
        write(tmp_path / f"{k}.jsonl", [line(1, hateful=0, time="5"), *[line(9, time=str(i)) for i in range(50)], line(1, hateful=k, time="5")])
    log = readers.annotation_log(spark, str(tmp_path))
    for n in (1, 5):
        rows = pipelines.validate(log.rows.repartition(n)).rows
        assert [r.label_hateful for r in rows.where("id = 1").collect()] == [2]


def test_appends_are_not_doubled(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.append_batch(spark.range(3), path, "a") and not sinks.append_batch(spark.range(3), path, "a")
    spark.range(5).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=b")
    assert sorted((r.id, r.batch) for r in sinks.read_batches(spark, path, "id long").collect()) == [(0, "a"), (1, "a"), (2, "a")]
    assert sinks.append_batch(spark.range(1), path, "b") and sinks.finished_batches(spark, path) == ["a", "b"]
    assert sinks.read_batches(spark, path, "id long").count() == 4
    assert sinks.read_batches(spark, str(tmp_path / "none"), "id long").count() == 0
    with pytest.raises(ValueError, match="token"):
        sinks.append_batch(spark.range(1), path, "a/b")


def batch_answer(spark, folder):
    rows = readers.annotation_log(spark, str(folder)).rows
    return {(r.annotator, r.id): r.label_hateful for r in labels.keep_last(rows, ["annotator", "id"], ["time", "place"]).collect()}


def test_state_survives_a_crash_and_late_rows(spark, tmp_path, monkeypatch):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()
    rng = random.Random(2)
    real, crashes = stream.append_batch, {1: 1, 3: 2}

    def failing(batch, path, token):
        """Some batches fail: half written, or wholly written but not yet known to be."""
        n = int(token)
        if crashes.get(n):
            crashes[n] -= 1
            if crashes[n]:
                batch.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch={token}")
            else:
                real(batch, path, token)
            raise RuntimeError("killed")
        return real(batch, path, token)

    monkeypatch.setattr(stream, "append_batch", failing)
    for k in range(5):
        # Later files hold earlier times as well: rows that come late.
        write(source / f"{k}.json", [line(rng.randrange(12), "AB"[rng.randrange(2)], f"{rng.randrange(40):03d}", rng.randrange(100)) for _ in range(30)] + ["{broken"])
        for _ in range(4):
            query = stream.track_latest(stream.read_log(spark, str(source)), target, state)
            try:
                query.awaitTermination()
                break
            except StreamingQueryException as e:
                assert "killed" in str(e) or "awaitResult" in str(e)
        got = {(r.annotator, r.id): r.label_hateful for r in stream.latest_changes(spark, target).collect()}
        assert got == batch_answer(spark, source)
    assert not any(crashes.values())


def test_no_finished_version_and_bad_lines_of_a_stream(spark, tmp_path):
    assert stream.latest(spark, str(tmp_path / "none")).count() == 0 and stream.latest_changes(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "0.json", [line(1), "{bad", "worse"])
    stream.read_bad(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "bad")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["worse", "{bad"]


def test_scoring_goes_on_where_it_was_killed(spark, tmp_path):
    sent, log = tmp_path / "sent", str(tmp_path / "answers")
    sent.mkdir()
    rows = spark.range(200).select("id", F.concat(F.lit("p"), F.col("id") % 150).alias("prompt"))

    def model(prompts):
        import uuid

        (sent / uuid.uuid4().hex).write_text("\n".join(prompts))
        return [p.upper() for p in prompts]

    waves = {"n": 0}

    def killed(some):
        waves["n"] += 1
        if waves["n"] > 4:
            raise KeyboardInterrupt
        return scoring.score(some, model, size=5, errors=True)

    with pytest.raises(KeyboardInterrupt):
        scoring.answered(rows, log, "m", killed, waves=8)
    half = sum(len(f.read_text().split()) for f in sent.iterdir())
    assert 30 < half < 120
    out = scoring.answered(rows, log, "m", lambda some: scoring.score(some, model, size=5, errors=True), waves=8)
    assert {(r.id, r.output) for r in out.collect()} == {(k, f"P{k % 150}") for k in range(200)}
    every = [p for f in sent.iterdir() for p in f.read_text().split()]
    assert len(every) == len(set(every)) == 150
    other = scoring.answered(rows.limit(3), log, "another", lambda some: scoring.score(some, lambda p: ["x"] * len(p), errors=True), waves=1)
    assert {r.output for r in other.collect()} == {"x"}


def test_failures_are_counted_over_the_job(spark, tmp_path):
    rows = spark.range(100).select("id", F.col("id").cast("string").alias("prompt"))

    def picky(prompts):
        if "7" in prompts:
            raise TimeoutError("no answer")
        return ["ok"] * len(prompts)

    # One bad row of a small task is no reason to end a job of a hundred.
    kept = scoring.score(rows.repartition(20, "id"), picky, size=1, errors=True).persist()
    scoring.check_failures(kept, 0.01)
    with pytest.raises(scoring.TooManyFailures, match="1 of 100 rows failed.*no answer"):
        scoring.check_failures(kept, 0.005)
    kept.unpersist()
    asks = lambda some: scoring.score(some, picky, size=1, errors=True)
    with pytest.raises(scoring.TooManyFailures):
        scoring.answered(rows, str(tmp_path / "a"), "m", asks, waves=2, max_failed=0.001)
    first = {r.id: r for r in scoring.answered(rows, str(tmp_path / "b"), "m", asks, waves=2).collect()}
    assert first[7].output is None and "no answer" in first[7].error and first[8].output == "ok"
    again = {r.id: r for r in scoring.answered(rows, str(tmp_path / "b"), "m", lambda some: scoring.score(some, lambda p: ["late"] * len(p), errors=True), waves=2).collect()}
    assert (again[7].output, again[7].error, again[8].output) == ("late", None, "ok")


def test_failed_requests_are_tried_again():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("busy")
        return "fine"

    assert scoring.tried(flaky, 3, 0.001) == "fine" and len(calls) == 3
    with pytest.raises(ConnectionError):
        scoring.tried(lambda: (_ for _ in ()).throw(ConnectionError("down")), 2, 0.001)


def test_fine_task_of_a_remote_model_resumes(spark, tmp_path):
    items = spark.range(30).select("id", F.lit("x").alias("text"), F.lit("i").alias("img"), F.concat(F.lit("img/"), F.col("id")).alias("url"), *[(F.col("id") % 2).cast("int").alias(c) for c in ("label_hateful", "label_incivility", "label_intolerance")])

    def client():
        return lambda prompt: [{"type": "reasoning", "summary": ["why"]}, {"type": "output_text", "text": "Incivility: Uncivil, Intolerance: Tolerant"}]

    def broken():
        raise RuntimeError("must not be asked again")

    first = pipelines.evaluate_api(items, "fine", client, log=str(tmp_path / "log"))
    again = pipelines.evaluate_api(items, "fine", lambda: (lambda prompt: broken()), log=str(tmp_path / "log"))
    for done in (first, again):
        m = {r.category: r for r in done.metrics.collect()}
        assert set(m) == {"incivility", "intolerance"} and m["incivility"].recall == pytest.approx(0.5) and m["incivility"].valid_samples == 30
        assert {r.reasoning for r in done.rows.collect()} == {"why"}


def test_agreement_by_patterns(spark):
    """Pairs made of counted lists against every pair of raw rows."""
    rng = random.Random(5)
    rows = [(i, f"a{k:02d}", rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(60) for k in rng.sample(range(6), rng.randrange(1, 6))]
    rows += [(100, f"a{k:02d}", k % 2, 1) for k in range(40)] + [(None, "a00", 1, 1), (3, None, 1, 1)]
    df = spark.createDataFrame(rows, "id long, annotator string, p int, q int").repartition(3)
    truth = {}
    for i, a, *x in rows:
        for j, b, *y in rows:
            if i is not None and i == j and a and b and a < b:
                for c, u, v in zip("pq", x, y, strict=True):
                    if u is not None and v is not None:
                        truth.setdefault((c, a, b), []).append((u, v))
    for found in (stats.pairwise_agreement(df, ["p", "q"]).collect(), stats.pairwise_kappa(df, ["p", "q"]).collect()):
        assert {(r.label, r.annotator_a, r.annotator_b) for r in found} == set(truth)
        for r in found:
            own = truth[r.label, r.annotator_a, r.annotator_b]
            n = len(own)
            seen, pa, pb = sum(u == v for u, v in own) / n, sum(u for u, _ in own) / n, sum(v for _, v in own) / n
            chance = pa * pb + (1 - pa) * (1 - pb)
            assert r.n == n and r.agreement == pytest.approx(seen)
            assert r.kappa is None if chance == 1 else r.kappa == pytest.approx((seen - chance) / (1 - chance))
    plan = stats.pairwise_agreement(df, ["p"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_image_sizes(spark):
    from tallyforge.operators import chat

    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    gif = b"GIF89a" + (300).to_bytes(2, "little") + (7).to_bytes(2, "little")
    bmp = b"BM" + bytes(16) + (12).to_bytes(4, "little") + (34).to_bytes(4, "little")
    segment = lambda mark, n: bytes([0xFF, mark]) + (n + 2).to_bytes(2, "big") + b"\xff\xc0" * (n // 2)
    jpeg = b"\xff\xd8" + segment(0xE0, 14) + segment(0xE1, 4000) + b"\xff" + segment(0xDB, 64) + segment(0xC4, 30) + b"\xff\xc2\x00\x11\x08" + (768).to_bytes(2, "big") + (1024).to_bytes(2, "big") + b"\x03"
    content = [png, gif, bmp, jpeg, png[:18], jpeg[:30], b"\xff\xd8", b"", b"text", None, b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xe0\x00\x00" * 50]
    df = spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in enumerate(content)], "k int, content binary")
    out = df.select("k", chat.image_size(F.col("content")).alias("s"))
    got = {r.k: (r.s.w, r.s.h) if r.s else None for r in out.collect()}
    assert got == {0: (640, 480), 1: (300, 7), 2: (12, 34), 3: (1024, 768)} | {k: None for k in range(4, 12)}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
