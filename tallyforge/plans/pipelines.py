"""Whole workflows as compositions of the operators. They return DataFrames; only the callers write or format."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from logging import Logger

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import logs
from tallyforge.functions.parse import FIELDS, field_label, first_label
from tallyforge.functions.text import codes_to_names, strip_charset
from tallyforge.operators import chat, curate, evaluate, labels, scoring, stats
from tallyforge.plans.codebook import DIMENSIONS, INCIVILITY, INTOLERANCE, dimension
from tallyforge.plans.config import merge, run_grid, select
from tallyforge.session import checkpointed
from tallyforge.sources import readers, sinks

CODES = ["label_incivility", "label_intolerance"]
BIN = {"label_hateful": "label_hateful", "label_incivility_bin": "label_incivility", "label_intolerance_bin": "label_intolerance"}
LABELS = list(BIN.values())


@dataclass
class Validated:
    coverage: DataFrame
    violations: DataFrame
    rows: DataFrame
    agreement: DataFrame
    summary: DataFrame


def validate(log: DataFrame, ids: DataFrame | None = None, expected: int | None = None, order: Sequence[str] | None = None) -> Validated:
    """Coverage and exclusivity before repeats are removed, then the latest rows, binary labels and agreement.

    order: by default `time`, and of equal times `place`, the place in the files, which readers.annotation_log adds.
    """
    rows = log if ids is None else curate.semi(log, ids.select("id").distinct(), "id")
    if expected is None:
        expected = (ids if ids is not None else log).agg(F.countDistinct("id")).scalar()
    if order is None:
        order = [c for c in ("time", "place") if c in log.columns]
    clean = labels.binarize(labels.keep_last(rows, ["annotator", "id"], order), CODES)
    pairs = stats.pairwise_agreement(clean, list(BIN))
    return Validated(labels.coverage(rows, expected), labels.exclusivity_violations(rows, CODES), clean, pairs, stats.agreement_summary(pairs))


@dataclass
class Gold:
    rows: DataFrame
    balance: DataFrame
    seed: int


def build_gold(clean: DataFrame, catalogue: DataFrame, seeds: int = 1000, strata: Sequence[str] = ("split",)) -> Gold:
    """Majority labels with image and split, cut into parts within each split by the seed of least drift of the labels.

    Each seed orders all items anew.
    """
    strata = list(strata)
    votes = labels.majority_mean(clean, ["id", "text"], BIN)
    known = curate.attach(votes, catalogue.select("id", "img", "split", "priority", "seq"), "id", ["priority", "seq"]).drop("priority", "seq")
    best = curate.best_seed(known, strata, "id", LABELS, seeds, apart=True).first()
    seed = 0 if best is None or best.seed is None else int(best.seed)
    parts = curate.stratified_split(known, strata, "id", seed, apart=True)
    return Gold(parts, curate.label_balance(parts, LABELS), seed)


@dataclass
class FineGrained:
    frequency: dict[str, DataFrame]
    votes: DataFrame
    categories: DataFrame
    soft: DataFrame


def fine_grained(clean: DataFrame) -> FineGrained:
    """Code frequencies, majority categories with rates, phi and Wilson bounds, and soft labels for a regression."""
    spark = clean.sparkSession
    frequency = {k: labels.label_frequency(clean, f"label_{k}", dimension(spark, k).select("code", "name")) for k in DIMENSIONS}
    votes = labels.votes(clean, "id", {"label_hateful": "hateful", "label_incivility_bin": "incivility_bin", "label_intolerance_bin": "intolerance_bin"}, DIMENSIONS)
    soft = labels.soft_table(clean, "id", {"label_hateful": "hateful", "label_incivility_bin": "incivility_bin", "label_intolerance_bin": "intolerance_bin"}, DIMENSIONS)
    table = stats.category_table(votes, "hateful", votes.columns[4:])
    low, high = stats.wilson(F.col("k"), F.col("n"))
    table = table.withColumn("low", low).withColumn("high", high).withColumn("dimension", F.split("category", "_", 2)[0])
    return FineGrained(frequency, votes, table.orderBy("dimension", F.desc("rate"), "category"), soft)


def regression(soft: DataFrame) -> stats.Logit:
    """The hateful label by the soft weights of categories, those of code 0 as baseline: odds ratios, and the fit."""
    baseline = tuple(f"{d}_{book[0]}" for d, book in DIMENSIONS.items())
    columns = [c for c in soft.columns if c.startswith(tuple(f"{d}_" for d in DIMENSIONS)) and not c.endswith("_bin") and c not in baseline]
    return stats.logit(soft, "hateful", columns)


def odds_ratios(soft: DataFrame) -> DataFrame:
    return regression(soft).terms


def coarse_fine_relation(gold: DataFrame) -> DataFrame:
    """How well four rules over the fine labels reproduce the coarse one, with p-values."""
    a, b = F.col("label_incivility") == 1, F.col("label_intolerance") == 1
    rules = {"intolerance": b, "incivility": a, "incivility_or_intolerance": a | b, "incivility_and_intolerance": a & b}
    out = stats.hypotheses(gold, "label_hateful", {k: c.cast("int") for k, c in rules.items()})
    return out.withColumn("p_value", stats.chi2_p_value("chi2"))


def found_items(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items whose image is among the files (name)."""
    names = files.select(F.col("name").alias("_name")).distinct()
    return items.withColumn("_name", strip_charset(F.col("img"))).join(names, "_name", "left_semi").drop("_name")


def descriptive(items: DataFrame, files: DataFrame | None, gold: DataFrame) -> dict[str, DataFrame]:
    """Counts of the raw corpus (files missing, repeats removed) and of the gold labels."""
    found = items if files is None else found_items(items, files)
    clean = labels.keep_first(found, ["img"], ["priority", "seq"])
    return {
        "rows": clean.agg(F.count(F.lit(1)).alias("n")),
        "duplicates": labels.duplicate_count(found, "img"),
        "labels": curate.value_counts(clean, "label"),
        "splits": curate.value_counts(clean, "split"),
        **{c: curate.value_counts(gold, c) for c in LABELS},
        "crosstab": curate.crosstab(gold, *CODES),
        "gold_without_item": gold.select("id").subtract(clean.select("id")),
    }


def bias_analysis(spark: SparkSession, tasks: Mapping[str, Mapping[str, str]]) -> tuple[DataFrame | None, list[str]]:
    """Bias table of all runs of all tasks (task -> run -> file), and warnings for files that are not there."""
    rows, warnings = None, []
    for task, runs in tasks.items():
        for run, path in runs.items():
            found = readers.predictions(spark, path)
            if found is None:
                warnings.append(f"{task}/{run}: no results at {path}")
                continue
            one = evaluate.long_predictions(found).where("p is not null").select(F.lit(task).alias("task"), F.lit(run).alias("run_id"), "category", "y", "p")
            rows = one if rows is None else rows.union(one)
    return (None if rows is None else evaluate.bias_table(rows, ["task", "run_id", "category"])), warnings


def annotation_sample(items: DataFrame, share: float = 0.21, seed: int = 42) -> DataFrame:
    """Items without repeated images, the same share of every split."""
    return curate.sample_fraction(labels.keep_first(items, ["img"], ["priority", "seq"]), ["split"], "id", share, seed)


def work_queue(items: DataFrame, log: DataFrame, annotator: str, needed: Sequence[str] = ("label_incivility", "label_intolerance", "label_hateful")) -> DataFrame:
    """Items that an annotator has not filled in, in order of id."""
    return curate.remaining(items, log.where(F.col("annotator") == annotator), "id", needed).orderBy("id")


def task_queue(items: DataFrame, ids: DataFrame, log: DataFrame, annotator: str, folder: str, files: DataFrame | None = None, needed: Sequence[str] = ("label_incivility", "label_intolerance", "label_hateful")) -> DataFrame:
    """What an annotator has still to do of a task, such as annotating again or calibration: the items of the task's ids,
    repeated images left out, whose row in the task's own log is not filled in; with the path of their image, by id."""
    known = items if files is None else found_items(items, files)
    own = curate.semi(labels.keep_first(known, ["img"], ["priority", "seq"]), ids.select("id").distinct(), "id")
    return work_queue(own.withColumn("img_path", F.concat_ws("/", F.lit(folder.rstrip("/")), F.col("img"))), log, annotator, needed)


def reannotation(clean: DataFrame, calibrated: DataFrame | None = None, per_group: int = 3, seed: int = 42) -> dict[str, DataFrame]:
    """Items to annotate again, those that agree, and a calibration sample of pairs of fine labels."""
    columns = ["label_incivility_bin", "label_intolerance_bin"]
    marked = labels.split_by_disagreement(clean, "id", columns)
    again = labels.disagreement(clean, "id", columns)
    agreed = marked.where("not _disagree").drop("_disagree")
    pool = marked.where("_disagree").drop("_disagree")
    if calibrated is not None:
        pool = curate.anti(pool, calibrated.select("id").distinct(), "id")
    return {"again": again, "agreed": agreed, "calibration": curate.sample_n(pool, columns, "id", per_group, seed).select("id").distinct()}


def calibration_review(clean: DataFrame) -> DataFrame:
    """The annotations of items in dispute, with their categories by name."""
    rows = labels.split_by_disagreement(clean, "id", list(BIN)).where("_disagree").drop("_disagree")
    named = rows.withColumn("incivility", codes_to_names(F.col("label_incivility"), INCIVILITY))
    return named.withColumn("intolerance", codes_to_names(F.col("label_intolerance"), INTOLERANCE)).orderBy("id", "annotator")


def evaluate_task(items: DataFrame, task: str, scorer: Callable[[list[str]], list[str | None]], invalid_policy: str = "count_as_error", size: int = 32, max_failed: float = 0.1, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Row-level predictions of a task by a scorer, and their metrics: messages, output, labels read back, scores.

    log: a folder of the model's own, where answers are logged, so that a job that is killed goes on from there.
    """
    asked = chat.inference_messages(items, task)
    prompt = F.to_json("messages")
    prompts = asked.select("id", prompt.alias("prompt"), *[c for c in asked.columns if c.startswith("label")])
    if log is None:
        # Kept, as a model is dear to ask.
        scored = checkpointed(scoring.score(prompts, scorer, size, errors=True))
        scoring.check_failures(scored, max_failed)
    else:
        scored = scoring.answered(prompts, log, task, lambda some: scoring.score(some, scorer, size, errors=True, attempts=3), max_failed=max_failed)
    rows = _read(scored.drop("prompt", "error"), task)
    return rows, evaluate.binary_metrics(evaluate.long_predictions(rows), invalid_policy=invalid_policy)


def _read(rows: DataFrame, task: str) -> DataFrame:
    """rows with the labels of a task read out of `output`."""
    fields = {"coarse": ["hateful"], "fine": ["incivility", "intolerance"], "joint": list(FIELDS)}[task]
    return rows.withColumns({f"pred_{f}": first_label(F.col("output")) if task == "coarse" else field_label(F.col("output"), f) for f in fields})


@dataclass
class Evaluation:
    run_id: str
    rows: DataFrame
    metrics: DataFrame
    mean: DataFrame
    matrices: DataFrame


def evaluation(run_id: str, rows: DataFrame, invalid_policy: str = "count_as_error") -> Evaluation:
    """Scores of row-level predictions: by category, their mean, and confusion matrices."""
    long = evaluate.long_predictions(rows)
    metrics = evaluate.binary_metrics(long, invalid_policy=invalid_policy)
    return Evaluation(run_id, rows, metrics, evaluate.macro_average(metrics), evaluate.confusion_array(long))


def evaluate_models(items: DataFrame, tasks: Mapping[str, Mapping[str, Callable[[list[str]], list[str | None]]]], kind: str, hubs: Sequence[str] = (), invalid_policy: str = "count_as_error", log: Logger | None = None) -> list[Evaluation]:
    """Every model of every evaluation task (name -> model id -> scorer) on the items, as one of the kinds of PROMPTS.

    A task's model that fails is logged and left out; the others go on.
    """
    out = []
    log = log or logs.get("tallyforge.evaluate")
    for name, models in tasks.items():
        for model, scorer in models.items():
            published = any(model.startswith(h) for h in hubs)
            run = f"eval_{name}_{model.replace('/', '_') if published else model.rstrip('/').split('/')[-2 if '/' in model else -1]}"
            try:
                rows, _ = evaluate_task(items, kind, scorer, invalid_policy)
                out.append(evaluation(run, rows, invalid_policy))
                mean = out[-1].mean.first()
                log.info("%s: accuracy %s, F1 %s, invalid %s", run, mean.accuracy, mean.f1, mean.invalid_rate)
            except Exception as e:  # noqa: BLE001 - one model's failure does not stop the others
                if out and out[-1].run_id == run:
                    out.pop()
                log.error("%s failed: %s", run, str(e).splitlines()[0] if str(e) else type(e).__name__)
    return out


def save_evaluation(done: Evaluation, folder: str, **tags: str) -> None:
    """Rows as JSON lines, metrics with matrices as JSON documents, and the means appended to a table of all runs."""
    sinks.json_lines(done.rows, f"{folder}/{done.run_id}_results")
    sinks.json_document(done.metrics.join(done.matrices, "category"), f"{folder}/{done.run_id}_metrics")
    sinks.append_metrics(done.mean, f"{folder}/runs", token=done.run_id, run_id=done.run_id, **tags)


def evaluate_api(
    items: DataFrame, task: str, client: Callable[[], Callable[[str], list[dict]]], in_flight: int = 8, workers: int = 4, invalid_policy: str = "count_as_error",
    max_failed: float = 0.1, log: str | None = None, attempts: int = 1, wait: float = 0.5, waves: int = 16,
) -> Evaluation:
    """A remote model on the items (with `url`, the image): messages, replies with reasoning, labels read, scores.

    log: a folder of the model's own, where answers are logged in waves, so that a job that is killed goes on from there.
    """
    asked = chat.api_messages(items, task)
    named = [c for c in asked.columns if c.startswith("label")]
    prompts = asked.select("id", F.to_json("messages").alias("prompt"), *named)
    sent = lambda some: scoring.ask(some, client, in_flight, workers, errors=True, attempts=attempts, wait=wait)
    if log is None:
        replies = checkpointed(sent(prompts))
        scoring.check_failures(replies, max_failed)
        replies = read_reply(replies)
    else:
        # A log holds texts: what is read of a reply, as JSON.
        whole = scoring.answered(prompts, log, task, lambda some: sent(some).withColumn("output", F.to_json("reply")), waves, max_failed=max_failed)
        replies = read_reply(whole.withColumn("reply", F.from_json("output", scoring.REPLY)))
    return evaluation(f"eval_{task}_api", _read(replies.drop("prompt", "reply", "error"), task), invalid_policy)


def chart_frames(found: FineGrained) -> dict[str, DataFrame]:
    """What charts of the analysis draw: shares by category, and rates with the lengths of their error bars, in order."""
    title = lambda c: F.initcap(F.translate(F.regexp_replace(c, "^(incivility|intolerance)_", ""), "_", " "))
    shares = [rows.select(F.lit(k).alias("group"), "code", title(F.col("name")).alias("label"), "n", "share") for k, rows in found.frequency.items()]
    bars = shares[0]
    for one in shares[1:]:
        bars = bars.union(one)
    rates = found.categories.select(
        F.col("dimension").alias("group"), title(F.col("category")).alias("label"), "n", "rate",
        (F.col("rate") - F.col("low")).alias("below"), (F.col("high") - F.col("rate")).alias("above"),
    )
    return {"shares": bars.orderBy("group", "code"), "rates": rates.orderBy("group", F.desc("rate"), "label")}


def read_reply(rows: DataFrame, column: str = "reply") -> DataFrame:
    """output and reasoning of an API reply: array of (type, text, summary); the last output text wins."""
    texts = F.filter(column, lambda m: m["type"] == "output_text")
    summaries = F.flatten(F.transform(F.filter(column, lambda m: m["type"] == "reasoning"), lambda m: F.coalesce(m["summary"], F.array().cast("array<string>"))))
    reasoning = F.when(F.size(summaries) > 0, F.array_join(summaries, "\n"))
    return rows.withColumn("output", F.try_element_at(texts, F.lit(-1))["text"]).withColumn("reasoning", reasoning)


def training_data(gold: DataFrame, task: str, share: float | None = None, seed: int = 3407) -> DataFrame:
    """Training conversations of the train part, or of a label-balanced share of it."""
    rows = gold.where("part = 'train'")
    return chat.training_messages(rows if share is None else curate.sample_fraction(rows, ["label_hateful"], "id", share, seed), task)


def training_runs(gold: DataFrame, config: dict, task: str) -> tuple[DataFrame, list[dict], DataFrame]:
    """What a task's training needs: its conversations, each run's whole settings, and the runs as a table.

    config: training (settings of all runs, with an optional label-balanced share) and runs (what each changes).
    """
    common = select(config, "training", {})
    settings = [merge(common, run) for run in select(config, "runs", [{}])]
    return training_data(gold, task, share=common.get("share")), settings, run_grid(gold.sparkSession, settings)
