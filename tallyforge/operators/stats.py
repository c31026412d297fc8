"""Agreement and association statistics in closed form, from counts of one aggregation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import checkpointed

#: Standard normal quantile of 0.975.
Z95 = 1.959963984540054


def _pairs(rows: DataFrame, labels: Sequence[str], item: str, annotator: str) -> DataFrame:
    """annotator_a, annotator_b, <label>_a and <label>_b of each pair (a < b) on an item, and _n, the items that have it.

    Items are one row each, the sorted list of who said what, and equal lists are counted: few annotators and labels make
    few lists however many items there are. Pairs are made of the lists, first those of one member and then one by one, so
    that no task holds the pairs of an item of thousands of annotators, and raw rows meet no others.
    """
    known = rows.where(F.col(item).isNotNull() & F.col(annotator).isNotNull())
    member = F.struct(F.col(annotator).alias("who"), *[F.col(c).alias(f"l{k}") for k, c in enumerate(labels)])
    lists = known.groupBy(item).agg(F.sort_array(F.collect_list(member)).alias("_m")).where("size(_m) > 1")
    counted = lists.groupBy("_m").agg(F.count(F.lit(1)).alias("_n"))
    firsts = counted.select("_n", "_m", F.posexplode("_m").alias("_i", "_x")).where(F.col("_i") + 1 < F.size("_m"))
    pairs = firsts.select("_n", "_x", F.explode(F.slice("_m", F.col("_i") + 2, F.size("_m"))).alias("_y")).where("_x.who < _y.who")
    sides = [F.col(f"_{v}.l{k}").alias(f"{c}_{s}") for k, c in enumerate(labels) for v, s in (("x", "a"), ("y", "b"))]
    return pairs.select(F.col("_x.who").alias("annotator_a"), F.col("_y.who").alias("annotator_b"), *sides, "_n")


def pairwise_agreement(rows: DataFrame, labels: Sequence[str], item: str = "id", annotator: str = "annotator") -> DataFrame:
    """label, annotator_a, annotator_b, n, agreement, kappa for each pair with common items; binary labels.

    kappa is null where chance agreement is 1.
    """
    met = _pairs(rows, labels, item, annotator)
    counts = []
    for c in labels:
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        known = a.isNotNull() & b.isNotNull()
        tally = lambda which: F.sum(F.when(which, F.col("_n")).otherwise(0))
        counts.append(F.struct(F.lit(c).alias("label"), tally(known).alias("n"), tally(known & (a == b)).alias("same"), tally(known & (a == 1)).alias("a1"), tally(known & (b == 1)).alias("b1")).alias(c))
    wide = met.groupBy("annotator_a", "annotator_b").agg(*counts)
    long = wide.select("annotator_a", "annotator_b", F.explode(F.array(*labels)).alias("x")).select("annotator_a", "annotator_b", "x.*")
    n, pa, pb = F.col("n"), F.col("a1") / F.col("n"), F.col("b1") / F.col("n")
    chance = pa * pb + (1 - pa) * (1 - pb)
    seen = F.col("same") / n
    kappa = F.when(chance < 1, F.try_divide(seen - chance, 1 - chance))
    return long.where("n > 0").select("label", "annotator_a", "annotator_b", "n", seen.alias("agreement"), kappa.alias("kappa"))


def pairwise_kappa(rows: DataFrame, labels: Sequence[str], item: str = "id", annotator: str = "annotator") -> DataFrame:
    """As pairwise_agreement for labels of any number of values: chance agreement sums over all of them."""
    met = _pairs(rows.withColumns({c: F.col(c).cast("string") for c in labels}), labels, item, annotator)
    each = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"{c}_a").alias("x"), F.col(f"{c}_b").alias("z")) for c in labels])
    pair = ["label", "annotator_a", "annotator_b"]
    counts = met.select("annotator_a", "annotator_b", "_n", F.inline(each)).where("x is not null and z is not null").groupBy(*pair, "x", "z").agg(F.sum("_n").alias("n"))
    sides = counts.select(*pair, F.explode(F.array(F.struct(F.col("x").alias("v"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.col("z").alias("v"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))).alias("s")).select(*pair, "s.*")
    margins = sides.groupBy(*pair, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    chance = margins.groupBy(*pair).agg(F.sum("a").alias("n"), F.sum(F.col("a").cast("double") * F.col("b")).alias("_e"))
    seen = counts.groupBy(*pair).agg(F.sum(F.when(F.col("x") == F.col("z"), F.col("n")).otherwise(0)).alias("_s"))
    both = chance.join(seen, pair)
    e, o = F.col("_e") / (F.col("n").cast("double") * F.col("n")), F.col("_s") / F.col("n")
    return both.select(*pair, "n", o.alias("agreement"), F.when(e < 1, F.try_divide(o - e, 1 - e)).alias("kappa"))


def overlap(rows: DataFrame, item: str = "id", annotator: str = "annotator") -> DataFrame:
    """Common items of each pair of annotators with any, the items of each, and whether both have the same: agreement is of
    common items only, so a partial overlap is worth a warning."""
    own = rows.select(F.col(item).alias("_i"), F.col(annotator).alias("annotator")).where("_i is not null").distinct()
    sizes = own.groupBy("annotator").agg(F.count(F.lit(1)).alias("n"))
    a, b = own.withColumnRenamed("annotator", "annotator_a"), own.withColumnRenamed("annotator", "annotator_b")
    common = a.join(b, "_i").where("annotator_a < annotator_b").groupBy("annotator_a", "annotator_b").agg(F.count(F.lit(1)).alias("n_common"))
    first, second = sizes.toDF("annotator_a", "n_a"), sizes.toDF("annotator_b", "n_b")
    out = common.join(first, "annotator_a").join(second, "annotator_b")
    return out.select("annotator_a", "annotator_b", "n_common", "n_a", "n_b", ((F.col("n_common") == F.col("n_a")) & (F.col("n_common") == F.col("n_b"))).alias("complete"))


def agreement_summary(pairs: DataFrame) -> DataFrame:
    """Means and population deviations over pairs."""
    stats = [f(c).alias(f"{c}_{k}") for c in ("agreement", "kappa") for k, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n_pairs"), *stats)


def two_by_two(x: Column, y: Column) -> list[Column]:
    """n11, n10, n01, n00 as counts; rows with a null are in none."""
    return [F.count_if((x == i) & (y == j)).alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)]


def phi(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Pearson's r of two binaries; null if one is constant."""
    r1, r0, c1, c0 = ((a + b).cast("double") for a, b in ((n11, n10), (n01, n00), (n11, n01), (n10, n00)))
    return F.try_divide(n11.cast("double") * n00 - n10.cast("double") * n01, F.sqrt(r1 * r0) * F.sqrt(c1 * c0))


def yates_chi2(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Chi-square of independence with Yates' correction; 0 if a margin is empty."""
    n = (n11 + n10 + n01 + n00).cast("double")
    gap = F.greatest(F.abs(n11.cast("double") * n00 - n10.cast("double") * n01) - n / 2, F.lit(0.0))
    margins = (n11 + n10).cast("double") * (n01 + n00) * (n11 + n01) * (n10 + n00)
    return F.coalesce(F.try_divide(n * gap * gap, margins), F.lit(0.0))


#: Terms of the series of erfc, and levels of its continued fraction, by which both are exact to about 1e-14.
SERIES, LEVELS = 90, 80


def erfc(x: Column) -> Column:
    """1 - erf(x) for x of 0 or more, in expressions: a power series up to 3, a continued fraction from there on."""
    square = 2 * x * x
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, k: Column) -> Column:
        term = a["term"] * square / (2 * k + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES)), start, add, lambda a: a["sum"])
    fraction = F.aggregate(F.sequence(F.lit(LEVELS), F.lit(1), F.lit(-1)), x, lambda f, k: x + k / 2 / f)
    scale = F.exp(-x * x) / F.lit(math.sqrt(math.pi))
    return F.when(x < 3, 1 - 2 * x * scale * series).otherwise(scale / fraction)


def chi2_p_value(chi2: Column | str) -> Column:
    """Upper tail for one degree of freedom."""
    value = F.col(chi2) if isinstance(chi2, str) else chi2
    return F.when(value.isNotNull(), erfc(F.sqrt(F.greatest(value, F.lit(0.0)) / 2)))


def hypotheses(rows: DataFrame, label: str, columns: Mapping[str, Column]) -> DataFrame:
    """Each hypothesis (name -> 0/1 column) against the label: n, match_rate, correlation, chi2. One pass for all."""
    own = F.col(label)
    tables = F.array(*[F.struct(*two_by_two(c, own), F.lit(k).alias("hypothesis")).alias(k) for k, c in columns.items()])
    wide = rows.agg(tables.alias("t"))
    long = wide.select(F.explode("t").alias("x")).select("x.*")
    cells = [F.col(c) for c in ("n11", "n10", "n01", "n00")]
    n = cells[0] + cells[1] + cells[2] + cells[3]
    return long.select("hypothesis", n.alias("n"), F.try_divide(cells[0] + cells[3], n).alias("match_rate"), phi(*cells).alias("correlation"), yates_chi2(*cells).alias("chi2"))


def category_table(wide: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """For each 0/1 category column: n of its items, rate of the label among them, phi. One pass for all categories."""
    cells = lambda c: ", ".join(f"'n{i}{j}', count_if(`{c}` = {i} and `{label}` = {j})" for i in (1, 0) for j in (1, 0))
    tables = F.array(*[F.expr(f"named_struct({cells(c)}, 'category', '{c}')") for c in columns])
    long = wide.agg(tables.alias("t")).select(F.explode("t").alias("x")).select("x.*")
    cells = [F.col(c) for c in ("n11", "n10", "n01", "n00")]
    n = cells[0] + cells[1]
    return long.where(n > 0).select("category", n.alias("n"), cells[0].alias("k"), (cells[0] / n).alias("rate"), phi(*cells).alias("phi"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k out of n; null for n = 0."""
    p, z2 = F.try_divide(k, n), z * z
    centre = (p + F.try_divide(F.lit(z2), 2 * n)) / (1 + F.try_divide(F.lit(z2), n))
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)) / (1 + F.try_divide(F.lit(z2), n))
    return centre - half, centre + half


@dataclass
class Logit:
    """A logistic regression: a row for each term, and one row about the fit."""

    terms: DataFrame
    summary: DataFrame


#: |log odds| from which a fitted probability is as good as 0 or 1, which is where separated data lead.
CERTAIN = 25.0


def logit(rows: DataFrame, label: str, columns: Sequence[str], rounds: int = 40, tolerance: float = 1e-9) -> Logit:
    """Maximum likelihood by Newton's steps, with an intercept.

    Rows with equal values are counted once and for all, and kept; a step is one aggregation of those counts into the
    gradient and the matrix X'WX, so only its few sums reach the driver. Columns that are 0 throughout are dropped; rows
    with a null are left out. A step that does not raise the likelihood is halved.

    summary: n, rounds, converged, separated (a term, or several together, tell the label for certain: the coefficients
    have no finite values, and theirs here mean nothing), singular (columns that depend on each other; the shortest
    solution is given), log_likelihood, null_log_likelihood, pseudo_r2 (McFadden's), aic.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)])
    counts = checkpointed(own.dropna().groupBy(*own.columns).agg(F.count(F.lit(1)).alias("_w")))
    spans = counts.agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("y"), *[F.max(F.abs(F.col(f"_x{k}"))).alias(f"_x{k}") for k in range(len(columns))]).first()
    used = [k for k in range(len(columns)) if spans[f"_x{k}"]]
    names = [*(columns[k] for k in used), "intercept"]
    x = [*(F.col(f"_x{k}") for k in used), F.lit(1.0)]
    q, n = len(x), spans.n or 0

    def sums(b: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Log likelihood, largest |log odds|, gradient and X'WX at b."""
        eta = sum((F.lit(float(v)) * c for v, c in zip(b, x, strict=True)), F.lit(0.0))
        with_eta = counts.withColumn("_e", eta).withColumn("_p", 1 / (1 + F.exp(-F.col("_e"))))
        with_eta = with_eta.withColumn("_d", F.col("_w") * (F.col("_y") - F.col("_p"))).withColumn("_v", F.col("_w") * F.col("_p") * (1 - F.col("_p")))
        e = F.col("_e")
        fit = F.sum(F.col("_w") * (F.col("_y") * e - F.greatest(e, F.lit(0.0)) - F.log1p(F.exp(-F.abs(e)))))
        pairs = [(i, j) for i in range(q) for j in range(i, q)]
        found = with_eta.agg(fit, F.max(F.abs(e)), *[F.sum(F.col("_d") * c) for c in x], *[F.sum(F.col("_v") * x[i] * x[j]) for i, j in pairs]).first()
        h = np.zeros((q, q))
        for (i, j), v in zip(pairs, found[2 + q :], strict=True):
            h[i, j] = h[j, i] = v
        return found[0], found[1], np.array(found[2 : 2 + q]), h

    b, done, steps, separated = np.zeros(q), False, 0, False
    best, edge, gradient, h = sums(b) if n else (0.0, 0.0, np.zeros(q), np.eye(q))
    while n and steps < rounds and not done and not separated:
        steps += 1
        step = np.linalg.lstsq(h, gradient, rcond=1e-12)[0]
        for _ in range(30):
            found = sums(b + step)
            if found[0] >= best - 1e-12 * abs(best):
                break
            step = step / 2
        b, (best, edge, gradient, h) = b + step, found
        done, separated = bool(np.max(np.abs(step)) < tolerance), edge > CERTAIN
    share = spans.y / n if n else 0.0
    null = sum(n * p * math.log(p) for p in (share, 1 - share) if p > 0)
    singular = bool(n) and int(np.linalg.matrix_rank(h, tol=1e-9 * max(1.0, float(np.abs(h).max())))) < q
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(h, rcond=1e-12)), 0.0))
    bound = lambda v: math.exp(min(v, 700.0))
    out = []
    for name, v, se in zip(names, b.tolist(), errors.tolist(), strict=True):
        z = v / se if se else 0.0
        out.append((name, v, se, z, math.erfc(abs(z) / math.sqrt(2)), bound(v), bound(v - Z95 * se), bound(v + Z95 * se)))
    fit = (n, steps, done, separated, singular, best, null, 1 - best / null if null else None, 2 * q - 2 * best)
    return Logit(
        spark.createDataFrame(out, "term string, coefficient double, se double, z double, p double, odds_ratio double, low double, high double"),
        spark.createDataFrame([fit], "n long, rounds int, converged boolean, separated boolean, singular boolean, log_likelihood double, null_log_likelihood double, pseudo_r2 double, aic double"),
    )


def logit_odds_ratios(rows: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Odds ratios of a logistic regression: term, coefficient, se, z, p, odds_ratio and its 95 % bounds."""
    return logit(rows, label, columns).terms
