"""Selection of items: queues, samples, splits, set algebra and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.session import ship_package

#: Buckets of a seeded order; the order of seeds permutes them.
BUCKETS = 4096
#: Hexadecimal digits of a seed's own order that cut it into cells: for one seed, and where many are tried at once.
DIGITS, SEED_DIGITS = 3, 2
#: Cells into which values between two powers of two are dealt when they are ranked.
CELLS = 512
#: Modulus and factors by which seeds mix buckets.
PRIME, SEED_STEP, SEED_START, SPREAD = 2**31 - 1, 1_000_003, 40_503, 48_271


def seeded(key: str, seed: Column | int) -> Column:
    """An order by key and seed that does not depend on partitioning."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), seed if isinstance(seed, Column) else F.lit(str(seed))))


def _apart(key: str, seed: Column | int) -> Column:
    """The digest by which a seed of its own orders rows; null keys are last."""
    own = seed if isinstance(seed, Column) else F.lit(seed)
    return F.coalesce(F.md5(F.concat(F.col(key).cast("string"), F.lit("-"), own.cast("string"))), F.lit("~"))


def digest(key: str) -> Column:
    """The one digest of a row that the splits of all seeds share."""
    return F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))


def bucket(of: Column) -> Column:
    return F.conv(F.substring(of, 1, 3), 16, 10).cast("long")


def mixed(number: Column, seed: Column) -> Column:
    """Where a seed puts a bucket: buckets are in order of this, then of their number."""
    v = ((number + 1) * ((seed * SEED_STEP + SEED_START) % PRIME)) % PRIME
    return ((v * v) % PRIME * SPREAD + number) % PRIME


def _stratum(strata: Sequence[str]) -> Column:
    """The values of a row's stratum as one text, nulls told apart; joins and windows deal rows by it alike."""
    return F.to_json(F.struct(*strata), {"ignoreNullFields": "false"}) if strata else F.lit("")


def _ranked(rows: DataFrame, strata: Sequence[str], cell: Column, order: Sequence[str | Column], turn=lambda c: [c]) -> DataFrame:
    """rows with _rank, from 1, in their stratum, and _n, its rows. Nothing runs before an action.

    cell: a number or text of each row that cuts the order into pieces: rows are in order of turn(cell), then of `order`.
    Rows are shuffled by stratum and cell, so a stratum of any size is spread over tasks, and ranked within their cell; the
    counts of cells, one small aggregation, say how many rows come before. The join with them needs no other shuffle of
    rows, and adaptive execution broadcasts them where they are few.
    """
    marked = rows.withColumn("_s", _stratum(strata)).withColumn("_b", cell)
    counts = marked.groupBy(F.col("_s").alias("_s2"), F.col("_b").alias("_b2")).agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy("_s2")
    upto = own.orderBy(*turn(F.col("_b2")), "_b2").rowsBetween(Window.unboundedPreceding, 0)
    cells = counts.select("_s2", "_b2", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), F.sum("_c").over(own).alias("_n"))
    inside = marked.withColumn("_k", F.row_number().over(Window.partitionBy("_s", "_b").orderBy(*order)))
    met = inside.join(cells, (F.col("_s") == F.col("_s2")) & (F.col("_b") == F.col("_b2")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_k")).alias("_rank"), "_n")


def _by_seed(rows: DataFrame, strata: Sequence[str], key: str, seed: Column | int) -> DataFrame:
    """Ranks in the order of a split's seed: of the bucket as mixed by the seed, the digest and the key."""
    number = seed if isinstance(seed, Column) else F.lit(seed).cast("long")
    ranked = _ranked(rows.withColumn("_m", digest(key)), strata, bucket(F.col("_m")), ["_m", key], lambda b: [mixed(b, number)])
    return ranked.drop("_m")


def semi(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def anti(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ids; null keys stay, as with a negated isin."""
    return rows.join(ids.select(key), key, "left_anti")


def remaining(items: DataFrame, log: DataFrame, key: str, needed: Sequence[str]) -> DataFrame:
    """Items for which some needed column was never filled in the log."""
    done = log.groupBy(key).agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in needed]).where(" and ".join(needed))
    return anti(items, done, key)


def sample_fraction(rows: DataFrame, strata: Sequence[str], key: str, share: float, seed: int) -> DataFrame:
    """round(share * n) rows of each stratum, by seeded order. A share of 1 or more, or none, returns all rows."""
    if share is None or share >= 1:
        return rows
    ranked = _ranked(rows.withColumn("_m", seeded(key, seed)), strata, F.substring("_m", 1, 3), ["_m", key])
    return ranked.where(F.col("_rank") <= F.expr(f"round(_n * {share!r}D)")).select(*rows.columns)


def sample_n(rows: DataFrame, strata: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each stratum."""
    w = Window.partitionBy(*strata).orderBy(seeded(key, seed), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def cuts(n: Column) -> tuple[Column, Column]:
    """Ranks within a stratum of n rows up to which a row is in the test part, and in the test or validation part: 3n/10
    rounded up are held back, and two thirds of those, rounded up, are the test part."""
    whole = lambda x, k: F.floor(x / k)
    held = whole(3 * n + 9, 10)
    return whole(2 * held + 2, 3), held


def stratified_split(rows: DataFrame, strata: Sequence[str], key: str, seed: Column | int, apart: bool = False) -> DataFrame:
    """Column part: 70 % train, 10 % validation, 20 % test of each stratum, see cuts.

    apart: rows are in order of a digest of key and seed, so that each seed orders all rows anew; otherwise in the order
    of one digest that seeds share, of which a seed permutes the buckets.
    """
    test, held = cuts(F.col("_n"))
    if apart:
        ranked = _ranked(rows.withColumn("_m", _apart(key, seed)), strata, F.substring("_m", 1, DIGITS), ["_m", key])
    else:
        ranked = _by_seed(rows, strata, key, seed)
    part = F.when(F.col("_rank") <= test, "test").when(F.col("_rank") <= held, "validation").otherwise("train")
    return ranked.select(*rows.columns, part.alias("part"))


def _drifts(wide: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """label, train, validation, test, drift from columns label__part: (|val - train| + |test - train|) / 2."""
    parts = ("train", "validation", "test")
    rows_of = F.array(*[F.struct(F.lit(c).alias("label"), *[F.col(f"{c}__{p}").alias(p) for p in parts]) for c in labels])
    long = wide.select(*by, F.explode(rows_of).alias("x")).select(*by, "x.*")
    drift = (F.abs(F.col("validation") - F.col("train")) + F.abs(F.col("test") - F.col("train"))) / 2
    return long.withColumn("drift", drift)


def label_balance(rows: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of 1 in each part and the drift of each label. One aggregation."""
    rate = lambda c, p: F.avg(F.when(F.col("part") == p, F.col(c)))
    wide = rows.groupBy(*by).agg(*[rate(c, p).alias(f"{c}__{p}") for c in labels for p in ("train", "validation", "test")])
    return _drifts(wide, labels, by)


def _sums(labels: Sequence[str]) -> tuple[list[str], list[Column]]:
    """Names and columns of what is summed of each label: whether it is known, and its value."""
    flags = [F.expr(e) for k, c in enumerate(labels) for e in (f"cast(`{c}` is not null as long) as _n{k}", f"coalesce(cast(`{c}` as long), 0) as _v{k}")]
    return [f"_{x}{k}" for k in range(len(labels)) for x in "nv"], flags


def _least_drift(until: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The seed of least mean drift, from sums of each seed: up to the first cut (_0), the second (_1), and in all (_2)."""
    part = {"test": "{0}_0", "validation": "{0}_1 - {0}_0", "train": "{0}_2 - {0}_1"}
    rates = [F.expr(f"try_divide({e.format(f'_v{k}')}, {e.format(f'_n{k}')})").alias(f"{c}__{name}") for k, c in enumerate(labels) for name, e in part.items()]
    drifts = _drifts(until.select("seed", *rates), labels, ["seed"])
    mean = drifts.groupBy("seed").agg(F.round(F.avg("drift"), 9).alias("drift"))
    return mean.agg(F.min(F.struct("drift", "seed")).alias("m")).select(F.col("m.seed").cast("int").alias("seed"), F.col("m.drift").alias("drift"))


def _best_apart(rows: DataFrame, strata: Sequence[str], key: str, labels: Sequence[str], seeds: int) -> DataFrame:
    """best_seed where each seed orders all rows anew.

    Every row has a digest for every seed and is summed by seed, stratum and cell of that order before any shuffle. Cells
    that a cut goes through, at most two of a stratum and seed, are broadcast, and their rows alone are ranked.
    """
    sums, flags = _sums(labels)
    every = F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)).cast("array<long>"))
    tried = rows.select(_stratum(strata).alias("_s"), F.col(key).alias("_key"), *flags).withColumn("seed", every)
    tried = tried.withColumn("_m", _apart("_key", F.col("seed"))).withColumn("_b", F.substring("_m", 1, SEED_DIGITS))
    cells = tried.groupBy("_s", "seed", "_b").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(c) for c in sums])
    own = Window.partitionBy("_s", "seed")
    upto = own.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_after", F.sum("_c").over(upto)).withColumn("_all", F.sum("_c").over(own))
    test, held = cuts(F.col("_all"))
    cells = cells.withColumn("_cut0", test).withColumn("_cut1", held)
    whole = [F.expr(f"sum(if(_after <= _cut{k}, {c}, 0)) as {c}_{k}") for k in (0, 1) for c in sums]
    of_seed = cells.groupBy("seed").agg(*whole, *[F.sum(c).alias(f"{c}_2") for c in sums])
    # Ranks in a cell up to which its rows are before a cut that goes through it.
    through = [F.expr(f"if(_after - _c < _cut{k} and _cut{k} < _after, _cut{k} - _after + _c, 0) as _r{k}") for k in (0, 1)]
    edges = cells.select("_s", "seed", "_b", *through).where("_r0 > 0 or _r1 > 0")
    inside = tried.join(F.broadcast(edges), ["_s", "seed", "_b"])
    inside = inside.withColumn("_k", F.row_number().over(Window.partitionBy("_s", "seed", "_b").orderBy("_m", "_key")))
    at = inside.groupBy("seed").agg(*[F.expr(f"sum(if(_k <= _r{k}, {c}, 0)) as {c}_e{k}") for k in (0, 1) for c in sums])
    added = [F.expr(f"{c}_{k} + coalesce({c}_e{k}, 0) as {c}_{k}") for k in (0, 1) for c in sums]
    return _least_drift(of_seed.join(at, "seed", "left").select("seed", *added, *[f"{c}_2" for c in sums]), labels)


def best_seed(rows: DataFrame, strata: Sequence[str], key: str, labels: Sequence[str], seeds: int, apart: bool = False) -> DataFrame:
    """The seed of 0 .. seeds - 1 whose stratified_split has the least mean drift of the labels, the smallest of those tied.

    apart: as of stratified_split, each seed orders all rows anew. Otherwise all seeds share one digest of a row: rows are summed by stratum and bucket once, and each seed only puts the at most
    BUCKETS sums of a stratum in another order. Whole buckets before a cut are summed; a cut that goes through a bucket
    adds the bucket's first rows, which are running sums in an order that all seeds share. So rows are read twice however
    many seeds there are, and what is made for each seed does not grow with them.
    """
    if apart:
        return _best_apart(rows, strata, key, labels, seeds)
    sums, flags = _sums(labels)
    marked = rows.select(_stratum(strata).alias("_s"), digest(key).alias("_m"), F.col(key).alias("_key"), *flags).withColumn("_b", bucket(F.col("_m")))
    cells = marked.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(c) for c in sums])

    tried = cells.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)).cast("array<long>")))
    own = Window.partitionBy("_s", "seed")
    upto = own.orderBy(mixed(F.col("_b"), F.col("seed")), "_b").rowsBetween(Window.unboundedPreceding, 0)
    tried = tried.withColumn("_after", F.sum("_c").over(upto)).withColumn("_all", F.sum("_c").over(own))
    test, held = cuts(F.col("_all"))
    tried = tried.withColumn("_cut0", test).withColumn("_cut1", held)
    whole = [F.expr(f"array({', '.join(f'sum(if(_after <= _cut{k}, {c}, 0))' for c in sums)})").alias(f"_whole{k}") for k in (0, 1)]
    # At most two a stratum.
    edges = [F.expr(f"collect_list(if(_after - _c < _cut{k} and _cut{k} < _after, struct({k} as cut, _s, _b, cast(_cut{k} - _after + _c as long) as _r), null))").alias(f"_edge{k}") for k in (0, 1)]
    of_seed = tried.groupBy("seed").agg(*whole, *edges)
    none = "cast(null as string) as _s, cast(null as long) as _b, cast(null as long) as _r"
    parts = F.expr(
        f"concat(array(struct(0 as cut, {none}, _whole0 as sums), struct(1 as cut, {none}, _whole1 as sums)), "
        "transform(concat(_edge0, _edge1), e -> struct(e.cut as cut, e._s as _s, e._b as _b, e._r as _r, cast(null as array<long>) as sums)))"
    )
    first = Window.partitionBy("_s", "_b").orderBy("_m", "_key")
    running = F.array(*[F.sum(c).over(first.rowsBetween(Window.unboundedPreceding, 0)) for c in sums])
    inside = marked.select("_s", "_b", F.row_number().over(first).cast("long").alias("_r"), running.alias("_in"))
    at = of_seed.select("seed", F.inline(parts)).join(inside, ["_s", "_b", "_r"], "left").withColumn("sums", F.coalesce("sums", "_in"))
    until = at.groupBy("seed").agg(*[F.expr(f"sum(if(cut = {k}, sums[{i}], 0)) as {c}_{k}") for k in (0, 1) for i, c in enumerate(sums)])
    total = cells.agg(*[F.sum(c).alias(f"{c}_2") for c in sums])
    return _least_drift(until.join(F.broadcast(total)), labels)  # the total is one row


def _magnitude(value: Column) -> Column:
    """A number that ascends with a value: CELLS of them between two powers of two, so that values of any spread are dealt
    to many; null below all."""
    size = F.abs(value.cast("double"))
    power = F.floor(F.log2(size))
    cell = (power + 1100) * CELLS + F.floor((size / F.pow(F.lit(2.0), power) - 1) * CELLS)
    return F.when(value.isNull(), F.lit(-(2**40))).when(size == 0, F.lit(0)).when(value < 0, -cell).otherwise(cell).cast("long")


def batches(rows: DataFrame, order: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """Batch number and place in it by a numeric order, within each of `by`.

    Rows are ranked within cells of the order's magnitude, whose sizes add up, so that a hot value of `by` is not one
    task's.
    """
    n = F.col("_rank") - 1
    ranked = _ranked(rows, by, _magnitude(F.col(order)), [order])
    return ranked.select(*rows.columns, F.floor(n / size).cast("long").alias("batch"), F.pmod(n, F.lit(size)).cast("int").alias("place"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_t")))).select(column, "n", (F.col("n") / F.col("_t")).alias("share"))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of value pairs, and shares of all rows."""
    counts = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_t")))).select(a, b, "n", (F.col("n") / F.col("_t")).alias("share"))


def attach(rows: DataFrame, catalogue: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Left join with the first catalogue row of each key, so that no row is repeated."""
    others = [c for c in catalogue.columns if c != key]
    first = catalogue.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_x")).select(key, "_x.*")
    return rows.join(first, key, "left")


def missing(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether both have the same set of keys, and how many each has alone."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, key, "full")
    only = both.agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"))
    return only.withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def union_tagged(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """All parts with their name, missing columns as null, and their order as priority."""
    out = None
    for k, (name, df) in enumerate(parts.items()):
        one = df.withColumn(tag, F.lit(name)).withColumn("priority", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
