"""Quality rules: heuristics and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Each document's word unigrams and bigrams are hashed into a fixed number of buckets. Two smoothed multinomials over
the buckets, one of the trusted target documents and one of the raw corpus, give an integer log ratio per bucket.
A document's score is the mean ratio over its n-grams; it is kept if that reaches a threshold: a given one, or the one
that the trusted documents' own scores set. All sums are over integers, so the verdict does not depend on partitioning.

Defined results: null or empty text has no words and fails the base rules; an empty table gives an empty result;
without trusted documents every ratio is 0 and only the base rules decide; repeated rows are scored one by one;
other columns, whatever their names, pass through filter_quality untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import sized, words_column

#: Buckets of the hashed n-grams; a power of two. It bounds what the driver holds of the model.
BUCKETS = 8192
#: Fixed-point unit of the log ratios.
UNIT = 1000
#: Mean log ratio (nats per n-gram) from which a document is kept, if no trusted document says otherwise, and the number
#: of trusted documents that count as much as it does.
THRESHOLD, PRIOR = -0.12, 20
#: Trusted documents that a threshold set by their scores may reject, one of so many.
TRUSTED_PER_MISS = 200
#: Pseudo-count of each bucket, shared between target and raw as all n-grams are: a bucket seen a few times has a
#: ratio near 1, so small corpora give mild verdicts.
ALPHA = 20.0


def _buckets(hashes: Column) -> tuple[Column, Column]:
    mask = F.lit(BUCKETS - 1).cast("long")
    single = F.transform(hashes, lambda h: h.bitwiseAND(mask).cast("int"))
    double = F.transform(
        F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda h, i: F.xxhash64(hashes[i], h).bitwiseAND(mask).cast("int"),
    )
    return single, double


def bucket_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Fixed-point log ratio of target to raw for each bucket; at most BUCKETS rows reach the driver.

    trusted: one column of ids. Null ids are never trusted.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).where("_id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("_id"), F.transform(words_column(F.col(text_col)), lambda w: F.xxhash64(w)).alias("_h"))
    rows = rows.join(sized(ids.withColumn("_t", F.lit(1))), "_id", "left")
    grams = rows.select("_t", F.explode(F.concat(*_buckets(F.col("_h")))).alias("_b"))
    counts = grams.groupBy("_b").agg(F.count(F.lit(1)).alias("raw"), F.count("_t").alias("target")).collect()
    raw, target = sum(r.raw for r in counts), sum(r.target for r in counts)
    ratios = [0] * BUCKETS
    if target:
        share = target / raw
        for r in counts:
            ratios[r["_b"]] = round(UNIT * math.log((r.target + ALPHA * share) / ((r.raw + ALPHA) * share)))
    return ratios


def trusted_threshold(docs: DataFrame, trusted: DataFrame, ratios: list[int], id_col: str = "doc_id", text_col: str = "text") -> float:
    """The score below which one of TRUSTED_PER_MISS trusted documents lies, drawn towards THRESHOLD by PRIOR documents.

    One rule for any number of them: the quantile lies between two neighbouring scores by its rank, and is weighed with
    THRESHOLD as n to PRIOR, so a further document moves it a little, and without any it is THRESHOLD. Documents of fewer
    than 10 words fail the base rules and do not count.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).where("_id is not null").distinct()
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(sized(ids), "_id", "left_semi")
    own = own.select(F.transform(words_column(F.col("_t")), lambda w: F.xxhash64(w)).alias("_h")).where(F.size("_h") >= 10)
    own = own.select((2 * F.size("_h") - 1).alias("n"), _total(F.col("_h"), ratios).alias("_sum"))
    score = F.floor(F.col("_sum") / F.col("n")).cast("long")
    counts = own.groupBy(score.alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy("s").collect()  # a row a score in steps of 1 / UNIT
    return blended(counts)


def blended(counts: list[tuple[int, int]]) -> float:
    """The threshold of scores (in units of 1 / UNIT, ascending) and how many documents have each."""
    total = sum(n for _, n in counts)
    if not total:
        return THRESHOLD
    rank, upto, places = total / TRUSTED_PER_MISS, 0, []
    whole = int(rank)
    for s, n in counts:
        places += [s] * max(0, min(upto + n, whole + 2) - max(upto, whole))
        upto += n
        if upto >= whole + 2:
            break
    low, high = places[0], places[-1]
    quantile = (low + (rank - whole) * (high - low)) / UNIT
    return (total * quantile + PRIOR * THRESHOLD) / (total + PRIOR)


def _total(hashes: Column, ratios: list[int]) -> Column:
    """Sum of the ratios of all n-grams."""
    model = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    zero = F.lit(0).cast("long")
    add = lambda a, b: a + F.get(model, b)
    single, double = _buckets(hashes)
    return F.aggregate(single, zero, add) + F.aggregate(double, zero, add)


def _repeated(hashes: Column) -> Column:
    """Words in 5-word windows that occur at least twice, from the array of word hashes."""
    windows = F.transform(
        F.slice(hashes, 5, F.greatest(F.size(hashes) - 4, F.lit(0))),
        lambda h, i: F.struct(
            F.xxhash64(hashes[i], hashes[i + 1], hashes[i + 2], hashes[i + 3], h).alias("w"), i.alias("p")
        ),
    )
    return windows


def _places(ordered: Column) -> Column:
    """Positions of the windows that have an equal neighbour; `ordered` is a column of windows sorted by hash."""
    same = lambda x, j: F.coalesce(x["w"] == F.get(ordered, j)["w"], F.lit(False))
    twice = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
    return F.sort_array(F.transform(twice, lambda x: x["p"]))


def _covered(places: Column) -> Column:
    """Number of words in the windows of 5 that start at the sorted places."""
    return F.aggregate(
        places,
        F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).cast("long").alias("n")),
        lambda a: a["n"],
    )


def score_quality(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    threshold: float | None = THRESHOLD,
) -> DataFrame:
    """Columns `keep` (default: the id) of every row, with the base figures, llr (mean ratio) and kept.

    threshold: None sets it by the scores of the trusted documents.
    """
    ratios = bucket_ratios(docs, trusted, id_col, text_col)
    if threshold is None:
        threshold = trusted_threshold(docs, trusted, ratios, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = F.char_length(text)
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^ \\t-\\r]"))
    kept = [id_col] if keep is None else keep
    rows = docs.select(
        F.struct(*kept).alias("_row"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (chars - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.transform(lines, lambda w: F.xxhash64(w)).alias("_l"),
        F.transform(words_column(text), lambda w: F.xxhash64(w)).alias("_h"),
    )
    # One step at a time: what a lambda refers to must be a column, or it is computed for every element.
    rows = rows.withColumn("_w", _repeated(F.col("_h")))
    again = F.size(F.array_distinct(F.col("_w")["w"])) < F.size("_w")
    rows = rows.withColumn("_o", F.when(again, F.sort_array("_w")))
    zero = F.lit(0).cast("long")
    rows = rows.select(
        "_row",
        F.size("_h").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(_places(F.col("_o"))), zero).alias("n_repeat_words"),
        _total(F.col("_h"), ratios).alias("_sum"),
        # Stops a filter on the result from being pushed below, into expressions that lambdas would then repeat.
        F.monotonically_increasing_id().alias("_barrier"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    good = F.col("_sum") >= F.lit(round(threshold * UNIT)) * grams
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in kept],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & good & (F.col("_barrier") >= 0)).alias("kept"),
        (F.col("_sum") / (grams * UNIT)).alias("llr"),
    )


def filter_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    flat = whole.select("_doc", F.col("_doc")[id_col].alias("_key"), F.col("_doc")[text_col].alias("_text"))
    scored = score_quality(flat, trusted, "_key", "_text", keep=["_doc"], threshold=None)
    return scored.where("kept").select("_doc.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
