import json
import logging
import threading
import time

import pytest
from pyspark.sql import functions as F

from tallyforge import session
from tallyforge.plans import pipelines
from tallyforge.sources import readers, sinks
from tallyforge.streaming import log as stream


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def annotation(i, who, inc, tol, hate, time):
    return {"id": i, "annotator": who, "label_incivility": inc, "label_intolerance": tol, "label_hateful": hate, "text": f"t{i}", "time": time, "img": f"img/{i}.png"}


def make_log(n=40):
    rows = []
    for i in range(n):
        for a, who in enumerate("ABC"):
            bad = i % 5 == 0 and a == 0
            rows.append(annotation(i, who, "1,2" if (i % 2 == 0) != bad else "0", "3" if i % 3 == 0 else "0", int(i % 4 == 0), f"2024-01-01T00:{i:02d}:0{a}"))
    return rows


def test_labels_to_gold(spark, tmp_path):
    path = write(tmp_path / "log.jsonl", make_log())
    (tmp_path / "ids.txt").write_text("".join(f"{i}\n" for i in range(40)) + "\n")
    items = [{"id": i, "img": f"img/{i}.png", "label": i % 2, "text": f"t{i}"} for i in range(40)]
    catalogue = readers.split_items(spark, {"train": write(tmp_path / "a.jsonl", items), "dev": write(tmp_path / "b.jsonl", items[:5])})
    ids = readers.id_list(spark, str(tmp_path / "ids.txt"))
    done = pipelines.validate(readers.json_lines(spark, path, readers.ANNOTATION), ids)
    assert done.coverage.where("complete").count() == 3 and done.summary.count() == 3
    gold = pipelines.build_gold(done.rows, catalogue, seeds=10)
    assert gold.rows.count() == 40 and gold.rows.where("split = 'train'").count() == 40 and 0 <= gold.seed < 10
    again = pipelines.reannotation(done.rows)
    assert again["again"].count() == 8 and again["agreed"].select("id").distinct().count() == 32
    assert pipelines.calibration_review(done.rows).where("incivility like '%Attacks%'").count() > 0
    fine = pipelines.fine_grained(done.rows)
    assert fine.frequency["incivility"].count() == 4 and fine.categories.count() == 5
    assert pipelines.coarse_fine_relation(gold.rows).where("p_value between 0 and 1").count() == 4
    report = pipelines.descriptive(catalogue, None, gold.rows)
    assert report["rows"].first().n == 40 and report["duplicates"].first().n_duplicates == 5
    assert "crosstab" in sinks.text_report(report) and r"\toprule" in sinks.latex_table(fine.categories, ["category", "n", "rate"])
    sinks.publish(gold.rows, str(tmp_path / "gold"), "part")
    assert readers.dataset(spark, str(tmp_path / "gold")).where("part = 'test'").count() == gold.rows.where("part = 'test'").count()
    assert pipelines.training_data(gold.rows, "coarse").count() == gold.rows.where("part = 'train'").count()


def test_queue_and_samples(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    write(path, make_log(10))
    with path.open("a") as f:
        f.write('{"id": 3, "annot\n')
    items = spark.range(12).select("id")
    own = readers.annotated_by(spark, str(path), "A")
    assert [r.id for r in pipelines.work_queue(items, own, "A").collect()] == [10, 11]
    catalogue = spark.range(100).select("id", F.concat(F.lit("img/"), F.col("id")).alias("img"), F.lit("s").alias("split"), F.lit(0).alias("priority"), F.col("id").alias("seq"))
    assert pipelines.annotation_sample(catalogue).count() == 21


def test_evaluation(spark, tmp_path):
    items = spark.range(50).select("id", F.lit("x").alias("text"), F.lit("i").alias("img"), *[(F.col("id") % k == 0).cast("int").alias(c) for k, c in ((2, "label_hateful"), (3, "label_incivility"), (5, "label_intolerance"))])

    def scorer(prompts):
        return ["Incivility: Civil, Intolerance: Tolerant, Hatefulness: Hateful" for _ in prompts]

    rows, metrics = pipelines.evaluate_task(items, "joint", scorer)
    assert {r.category: r.accuracy for r in metrics.collect()}["hateful"] == 0.5

    def broken(prompts):
        raise RuntimeError("no model")

    assert pipelines.evaluate_task(items, "coarse", broken, max_failed=1.0)[1].first().invalid_rate == 1
    with pytest.raises(Exception, match="rows failed"):
        pipelines.evaluate_task(items, "coarse", broken)[1].collect()
    sinks.json_lines(rows, str(tmp_path / "run"))
    table, warnings = pipelines.bias_analysis(spark, {"joint": {"one": str(tmp_path / "run"), "two": str(tmp_path / "none")}})
    assert table.count() == 3 and len(warnings) == 1


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for k, rows in enumerate(([annotation(1, "A", "0", "0", 0, "1"), annotation(2, "A", "0", "0", 0, "1")], [annotation(1, "A", "1", "0", 1, "2")])):
        write(source / f"{k}.json", rows)
        stream.keep_latest(stream.read_log(spark, str(source)), target, checkpoint).awaitTermination()
    got = {r.id: r.label_incivility for r in stream.latest(spark, target).collect()}
    assert got == {1: "1", 2: "0"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, reasoning string")
    sinks.json_document(df, str(tmp_path / "doc"))
    assert '"reasoning":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "doc")).collect())
    sinks.id_list(df, str(tmp_path / "ids"))
    assert readers.id_list(spark, str(tmp_path / "ids")).count() == 2
    sinks.append_metrics(df, str(tmp_path / "m"), run="r1")
    sinks.append_metrics(df, str(tmp_path / "m"), run="r2")
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    assert readers.files(spark, str(tmp_path / "doc"), "*.txt").count() >= 1


def test_intermediate_tables_need_a_shared_folder():
    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext, self.conf = type("Context", (), {"master": master}), {"spark.checkpoint.dir": folder}

    assert session.shared_folder(Session("yarn", "/shared"), "x").startswith("/shared/")
    assert session.shared_folder(Session("local[4]"), "x")
    with pytest.raises(ValueError, match="share"):
        session.shared_folder(Session("yarn"), "x")


def test_report_is_never_cut(spark):
    with pytest.raises(ValueError, match="more than 5 rows"):
        sinks.text_report({"many": spark.range(6)}, limit=5)


def test_stream_keeps_two_versions_and_skips_gaps(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    target, checkpoint = tmp_path / "out", str(tmp_path / "cp")
    for k in range(4):
        write(source / f"{k}.json", [annotation(1, "A", str(k), "0", 0, str(k))])
        stream.keep_latest(stream.read_log(spark, str(source)), str(target), checkpoint).awaitTermination()
    assert sorted(p.name for p in target.iterdir() if p.name.startswith("v=")) == ["v=2", "v=3"]
    assert stream.latest(spark, str(target)).first().label_incivility == "3"


def test_stream_writes_only_touched_buckets(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k, ids in enumerate((range(200), [7], [7])):
        write(source / f"{k}.json", [annotation(i, "A", str(k), "0", 0, str(k)) for i in ids])
        stream.keep_latest(stream.read_log(spark, str(source)), str(target), str(tmp_path / "cp"), buckets=8).awaitTermination()
    written = {v: len(list((target / f"v={v}").glob("_bucket=*"))) for v in range(3)}
    assert written == {0: 7, 1: 1, 2: 1}
    got = {r.id: r.label_incivility for r in stream.latest(spark, str(target)).collect()}
    assert got == {i: "2" if i == 7 else "0" for i in range(200)}


def test_remote_model(spark):
    items = spark.range(60).select("id", F.lit("x").alias("text"), F.lit("i").alias("img"), F.concat(F.lit("img/"), F.col("id")).alias("url"), *[(F.col("id") % 2).cast("int").alias(c) for c in ("label_hateful", "label_incivility", "label_intolerance")])

    def client():
        lock, state = threading.Lock(), {"now": 0, "most": 0}

        def send(prompt):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.002)
            with lock:
                state["now"] -= 1
            n = int(prompt.split("img/")[1].split('"')[0])
            if n == 7:
                raise TimeoutError("no answer")
            return [{"type": "reasoning", "summary": [f"at most {state['most']}"]}, {"type": "output_text", "text": "Hateful" if n % 2 else "Neutral"}]

        return send

    done = pipelines.evaluate_api(items.repartition(3), "coarse", client, in_flight=6, workers=2)
    rows = done.rows.collect()
    assert len(rows) == 60 and {r.id: r.output for r in rows}[4] == "Neutral" and {r.id: r.pred_hateful for r in rows}[7] == -1
    assert all(int(r.reasoning.split()[-1]) <= 3 for r in rows if r.reasoning)
    m = done.metrics.first()
    assert m.accuracy == pytest.approx(59 / 60) and m.valid_samples == 59
    with pytest.raises(Exception, match="rows failed"):
        pipelines.evaluate_api(items, "coarse", client, max_failed=0.001).rows.collect()


def test_models_and_runs(spark, tmp_path, caplog):
    items = spark.range(40).select("id", F.lit("x").alias("text"), F.lit("i").alias("img"), F.lit("train").alias("part"), *[(F.col("id") % 2).cast("int").alias(c) for c in ("label_hateful", "label_incivility", "label_intolerance")])

    def broken(prompts):
        raise RuntimeError("no model")

    tasks = {"zero-shot": {"hub/a": lambda p: ["Incivility: Civil, Intolerance: Tolerant, Hatefulness: Neutral"] * len(p), "hub/b": broken}, "base": {"runs/joint/26-1/last": lambda p: ["?"] * len(p)}}
    logger = logging.getLogger("test-models")
    with caplog.at_level(logging.INFO, logger="test-models"):
        done = pipelines.evaluate_models(items, tasks, "joint", hubs=["hub/"], log=logger)
    assert [e.run_id for e in done] == ["eval_zero-shot_hub_a", "eval_base_26-1"] and "eval_zero-shot_hub_b failed" in caplog.text
    assert done[0].mean.first().accuracy == 0.5 and done[1].mean.first().invalid_rate == 1
    for e in done:
        pipelines.save_evaluation(e, str(tmp_path), task="joint")
    assert {r.run_id for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {"eval_zero-shot_hub_a", "eval_base_26-1"}
    assert "confusion_matrix" in spark.read.text(str(tmp_path / "eval_zero-shot_hub_a_metrics")).first().value
    rows, settings, runs = pipelines.training_runs(items, {"training": {"rate": 0.1, "share": 0.5}, "runs": [{"r": 8}, {"rate": 0.2}]}, "fine")
    assert rows.count() == 20 and settings == [{"rate": 0.1, "share": 0.5, "r": 8}, {"rate": 0.2, "share": 0.5}] and runs.count() == 2


def test_logs(tmp_path):
    from tallyforge import logs

    log = logs.get("tallyforge.some.job", str(tmp_path))
    assert logs.get("tallyforge.some.job", str(tmp_path)) is log and len(log.handlers) == 2
    log.info("done")
    files = list(tmp_path.iterdir())
    assert len(files) == 1 and files[0].name.startswith("job_") and "INFO tallyforge.some.job: done" in files[0].read_text()
