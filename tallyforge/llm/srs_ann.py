"""Approximate nearest neighbours: low-dimensional stable projections indexed by a kd-tree.

Vectors are completed by one coordinate to equal length, so that the largest inner product is the smallest distance,
and projected to PROJECTED dimensions by Gaussian coefficients: the squared projected distance over the squared true
one then follows a chi-square law. A query meets its projected neighbours in order of distance, verifies them on the
whole vectors, and stops when the chi-square test says that a vector nearer than its k-th best so far would have been
met before with probability CONFIDENCE.

The index has two levels. The upper one cuts the projected space into cells of about SHARD vectors; each cell is a
kd-tree of its own. A query first searches the NEAR cells nearest to it, which gives it a k-th best, and then only those
whose bounding box passes the test for that. A vector is in one cell, and goes to tasks as often as blocks of queries ask
for its cell. The cuts between cells are fitted on at most about SAMPLE vectors chosen by hash; the boxes, and all
else, come from all vectors. All vectors are indexed, equal ones once with their k + 1 smallest ids; equal queries are
searched once.

Defined results: vectors null, empty, zero or with null or non-finite components take no part, nor rows without an id;
rows that repeat an id and a vector count once; vectors are compared with those of their own length; ties go to the
smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import checkpointed, sized

PROJECTED, LEAF, CONFIDENCE, SEED = 24, 64, 0.9, 3
#: Vectors in a cell and queries in a block, on average; cells beyond CELLS grow instead, as all tasks are told their boxes.
SHARD, BLOCK, CELLS = 4096, 4096, 1 << 14
#: Cells that a query searches first, and vectors that the cuts between cells are fitted on: a documented bound.
NEAR, SAMPLE = 2, 1 << 16


def chi_square_cdf(x: np.ndarray, freedom: int) -> np.ndarray:
    """Closed form for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for j in range(1, freedom // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 100.0 + 10 * freedom
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(np.array(middle), freedom) < share else (low, middle)
    return high


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from each query to each box."""
    out = np.zeros((len(queries), len(low)))
    for d in range(queries.shape[1]):
        q = queries[:, d, None]
        gap = np.maximum(np.maximum(low[:, d] - q, q - high[:, d]), 0)
        out += gap * gap
    return out


class KdTree:
    """Median splits along the widest side until no part has more than `leaf` points; parts and their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves: list[np.ndarray] = []
        self.nodes: list[list] = []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            own, above, turn = todo.pop()
            if len(own) <= leaf or (points[own].max(0) == points[own].min(0)).all():
                place = -1 - len(self.leaves)
                self.leaves.append(own)
            else:
                part = points[own]
                side = int((part.max(0) - part.min(0)).argmax())
                cut = float(np.median(part[:, side]))
                if cut == part[:, side].max():
                    cut = float(np.nextafter(cut, -np.inf))
                right = part[:, side] > cut
                place = len(self.nodes)
                self.nodes.append([side, cut, 0, 0])
                todo += [(own[~right], place, 2), (own[right], place, 3)]
            if above >= 0:
                self.nodes[above][turn] = place
        self.low = np.array([points[x].min(0) for x in self.leaves if len(x)]).reshape(-1, points.shape[1])
        self.high = np.array([points[x].max(0) for x in self.leaves if len(x)]).reshape(-1, points.shape[1])

    def part(self, points: np.ndarray) -> np.ndarray:
        """The part into which each point falls, by the cuts alone."""
        at = np.zeros(len(points), np.int64) if self.nodes else np.full(len(points), -1)
        if self.nodes:
            side, cut, below, over = (np.array(x) for x in zip(*self.nodes, strict=True))
            while (go := np.flatnonzero(at >= 0)).size:
                k = at[go]
                at[go] = np.where(points[go, side[k].astype(int)] > cut[k], over[k], below[k])
        return -1 - at


def completed(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the coordinate that brings all to the same length."""
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(1), 0))
    return np.concatenate((vectors, rest[:, None]), 1)


def aimed(queries: np.ndarray, norm: float) -> np.ndarray:
    """Queries at the common length; their own further coordinate is 0."""
    length = np.sqrt((queries * queries).sum(1, keepdims=True))
    return np.concatenate((queries * (norm / length), np.zeros((len(queries), 1))), 1)


def coefficients(n: int) -> np.ndarray:
    """Gaussian (2-stable) coefficients for completed vectors of n coordinates, the same everywhere."""
    return np.random.default_rng(SEED).normal(size=(n, PROJECTED))


def search(vectors: np.ndarray, queries: np.ndarray, k: int, norm: float, bound: np.ndarray | None = None, at_once: int = 512) -> tuple[list[np.ndarray], int]:
    """Places of the k (or fewer) vectors of least distance found for each query, and how many pairs were verified.

    bound: squared distance that a vector must be within to be wanted at all (default: none).
    """
    whole, goal = completed(vectors, norm), aimed(queries, norm)
    turn = coefficients(whole.shape[1])
    points, aims = whole @ turn, goal @ turn
    tree, k = KdTree(points), min(k, len(vectors))
    factor = chi_square_quantile(CONFIDENCE, PROJECTED)
    squares = (points * points).sum(1)
    found: list[np.ndarray] = []
    verified = 0
    for first in range(0, len(queries), at_once):
        q, p = goal[first : first + at_once], aims[first : first + at_once]
        limit = np.full(len(q), np.inf) if bound is None else bound[first : first + at_once].astype(float)
        gaps = box_distances(p, tree.low, tree.high)
        order = np.argsort(gaps, axis=1)
        best = np.full((len(q), k), np.inf)
        place = np.full((len(q), k), -1, np.int64)
        active = np.arange(len(q))
        for r in range(len(tree.leaves)):
            reach = np.minimum(best[active].max(1), limit[active])
            nearest = order[active, r]
            stay = gaps[active, nearest] <= factor * reach
            active, nearest, reach = active[stay], nearest[stay], reach[stay]
            if not len(active):
                break
            by_leaf = np.argsort(nearest, kind="stable")
            cuts = np.flatnonzero(np.diff(nearest[by_leaf], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(by_leaf)], strict=True):
                rows, own = active[by_leaf[a:b]], tree.leaves[nearest[by_leaf[a]]]
                projected = (p[rows] ** 2).sum(1)[:, None] + squares[own] - 2 * p[rows] @ points[own].T
                i, j = np.nonzero(projected <= factor * reach[by_leaf[a:b], None])
                if not len(i):
                    continue
                verified += len(i)
                gap = np.full(projected.shape, np.inf)
                gap[i, j] = np.maximum(2 * (norm * norm - np.einsum("ij,ij->i", q[rows[i]], whole[own[j]])), 0)
                gap[gap > limit[rows, None]] = np.inf
                both = np.concatenate((best[rows], gap), 1)
                names = np.concatenate((place[rows], np.broadcast_to(own, gap.shape)), 1)
                keep = np.argpartition(both, k - 1, axis=1)[:, :k]
                best[rows], place[rows] = np.take_along_axis(both, keep, 1), np.take_along_axis(names, keep, 1)
        found += [x[np.isfinite(g)] for x, g in zip(place, best, strict=True)]
    return found, verified


def _usable(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths d in a batch, and the rows of each."""
    d = batch.column(batch.schema.get_field_index("d")).to_numpy(zero_copy_only=False)
    for n in np.unique(d).tolist():
        yield n, np.flatnonzero(d == n)


class Index:
    """The upper level: cuts of the projected space by vector length, and the boxes of cells; queries are routed by it."""

    def __init__(self, unique: DataFrame):
        """unique: d, h, v, ids of distinct vectors, materialised."""
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        self.sc = unique.sparkSession.sparkContext
        sizes = {r.d: (r.n, math.sqrt(r.m) * (1 + 1e-12)) for r in unique.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m")).collect()}
        self.norms = {d: norm for d, (_, norm) in sizes.items()}
        norms = self.norms
        every = F.create_map(*[F.lit(x) for d, (n, _) in (sizes or {0: (1, 1)}).items() for x in (d, -(-n // SAMPLE))])[F.col("d")]

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, rows in _by_length(batch):
                    points = completed(_matrix(batch.column(1).take(pa.array(rows))), norms[d]) @ coefficients(d + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d, np.int32)), pa.array(list(points), pa.list_(pa.float64()))], names=["d", "p"])

        sample = unique.where(F.pmod(F.xxhash64("h"), every.cast("long")) == 0).select("d", "v").mapInArrow(project, "d int, p array<double>")
        found: dict[int, list] = {}
        for r in sample.collect():
            found.setdefault(r.d, []).append(r.p)
        self.trees = {}
        for d, (n, _) in sizes.items():
            points = np.array(sorted(found.get(d, [])), float).reshape(-1, PROJECTED)
            wanted = min(CELLS, -(-n // SHARD))
            self.trees[d] = KdTree(points, max(1, -(-len(points) // wanted)))
        shared = self.sc.broadcast((self.trees, norms))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, norms = shared.value
            for batch in batches:
                cell = np.zeros(batch.num_rows, np.int32)
                for d, rows in _by_length(batch):
                    cell[rows] = trees[d].part(completed(_matrix(batch.column(1).take(pa.array(rows))), norms[d]) @ coefficients(d + 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["d", "v", "ids", "cell"])

        self.cells = checkpointed(unique.select("d", "v", "ids").mapInArrow(assign, "d int, v array<double>, ids array<long>, cell int"))

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, rows in _by_length(batch):
                    points = completed(_matrix(batch.column(1).take(pa.array(rows))), norms[d]) @ coefficients(d + 1)
                    cell = batch.column(2).to_numpy(zero_copy_only=False)[rows]
                    own = np.unique(cell)
                    low, high = (np.array([f(points[cell == c], 0) for c in own]) for f in (np.min, np.max))
                    n = len(own) * PROJECTED
                    columns = [np.full(n, d, np.int32), np.repeat(own, PROJECTED), np.tile(np.arange(PROJECTED, dtype=np.int32), len(own)), low.ravel(), high.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "cell", "i", "low", "high"])

        sides = self.cells.select("d", "v", "cell").mapInArrow(bounds, "d int, cell int, i int, low double, high double")
        self.boxes: dict[int, tuple] = {}
        table = sides.groupBy("d", "cell", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values(["d", "cell", "i"])
        for d, part in table.groupby("d"):
            self.boxes[d] = (part["cell"].to_numpy()[::PROJECTED], part["low"].to_numpy().reshape(-1, PROJECTED), part["high"].to_numpy().reshape(-1, PROJECTED))

    def routed(self, queries: DataFrame) -> DataFrame:
        """(d, cell, qid, v, bound): a row for each cell that a query (d, v, qid, bound) goes to.

        Without a bound these are the NEAR nearest cells; with one, all others whose box passes the test.
        """
        factor = chi_square_quantile(CONFIDENCE, PROJECTED)
        shared = self.sc.broadcast((self.boxes, self.norms))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            boxes, norms = shared.value
            for batch in batches:
                bound = batch.column(3).fill_null(np.nan).to_numpy(zero_copy_only=False)
                for d, rows in _by_length(batch):
                    cells, low, high = boxes[d]
                    aims = aimed(_matrix(batch.column(1).take(pa.array(rows))), norms[d]) @ coefficients(d + 1)
                    for first in range(0, len(rows), 256):
                        gaps = box_distances(aims[first : first + 256], low, high)
                        own = bound[rows[first : first + 256]]
                        rank = np.argsort(np.argsort(gaps, axis=1, kind="stable"), axis=1, kind="stable")
                        go = np.where(np.isnan(own)[:, None], rank < NEAR, (rank >= NEAR) & (gaps <= factor * own[:, None]))
                        i, j = np.nonzero(go)
                        at = pa.array(rows[first + i])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(at), pa.array(cells[j].astype(np.int32)), batch.column(2).take(at), batch.column(1).take(at), batch.column(3).take(at)],
                            names=["d", "cell", "qid", "v", "bound"],
                        )

        return queries.select("d", "v", "qid", "bound").mapInArrow(run, "d int, cell int, qid long, v array<double>, bound double")

    def met(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, vec_id, score) of the k nearest ids of each query in each cell it goes to."""
        asked = checkpointed(self.routed(queries))
        blocks = asked.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        blocks = sized(checkpointed(blocks))
        left = self.cells.join(blocks, ["d", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = asked.join(blocks, ["d", "cell"]).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).drop("blocks")
        norms = self.norms
        schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

        def join(key: tuple, stored: pa.Table, wanted: pa.Table) -> pa.Table:
            if not stored.num_rows or not wanted.num_rows:
                return schema.empty_table()
            vectors, queries = _matrix(stored["v"]), _matrix(wanted["v"])
            lists, names = stored["ids"].to_pylist(), wanted["qid"].to_pylist()
            bound = wanted["bound"].to_numpy()
            found, _ = search(vectors, queries, k, norms[key[0].as_py()], np.where(np.isnan(bound), np.inf, bound))
            out: tuple[list, list, list] = ([], [], [])
            for q, name, places in zip(queries, names, found, strict=True):
                scores = (vectors[places] * q).sum(1)
                every = sorted((-s, i) for s, p in zip(scores.tolist(), places.tolist(), strict=True) for i in lists[p])[:k]
                out[0].extend([name] * len(every))
                out[1].extend(i for _, i in every)
                out[2].extend(-s for s, _ in every)
            return pa.table([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

        keys = ("d", "cell", "block")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(join, "qid long, vec_id long, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row for which is_query holds."""
    usable = rows.where(_usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    # Adding zero turns -0.0 into 0.0, so that equal vectors are equal arrays.
    same = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    source = usable.select(F.col(id_col).cast("long").alias("id"), same.alias("v"), is_query.alias("q")).distinct()
    source = checkpointed(source.withColumn("d", F.size("v")).withColumn("h", F.xxhash64("v")))
    few = source.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    index = Index(checkpointed(few.groupBy("d", "h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))))

    asked = source.where("q")
    queries = checkpointed(asked.select("d", "h", "v").distinct().withColumn("qid", F.monotonically_increasing_id()))
    none = F.lit(None).cast("double")
    first = checkpointed(index.met(queries.withColumn("bound", none), k + 1))
    # The k-th best besides the query itself, as a squared distance between vectors of the common length.
    kth = first.groupBy("qid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") > k)
    norm = F.create_map(*[F.lit(x) for item in (index.norms or {0: 1.0}).items() for x in item])[F.col("d")]
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    bound = 2 * (norm * norm - norm * F.col("s")[k] / length)
    bound = F.coalesce(F.greatest(bound, F.lit(0.0)) * (1 + 1e-9) + norm * norm * 1e-12, F.lit(float("inf")))
    second = index.met(queries.join(kth, "qid", "left").withColumn("bound", bound), k + 1)

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    best = first.union(second).distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("l"))
    names = asked.join(queries.select("h", "v", "qid"), ["h", "v"]).select(F.col("id").alias("query_id"), "qid")
    own = names.join(lists, "qid").select("query_id", F.slice(F.filter("l", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("l"))
    ranked = own.select("query_id", F.posexplode("l").alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
