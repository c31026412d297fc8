"""Ranked lexical search with inverted treaps: every item of a benchmark against all documents, the best k of each.

A term's postings in a shard of documents form a treap: documents in search order, impacts in heap order, so the root of
a subtree has the greatest impact of its documents. For an item the treaps of its terms are traversed together. A state
is a range of documents with one node of each term, the highest whose document is in the range; the sum of their impacts
bounds every score in the range, and a state that cannot reach the item's k best is dropped. Otherwise the document of
its greatest impact is scored by searching each treap's documents, and the range is cut there in two. Ranges of at most
LEAF documents are scored whole. States of all items of a group are kept in numpy arrays, best bounds first.

Documents are dealt to shards as they lie in partitions, each at most SHARD documents, and a task carries the k best so
far from shard to shard, so later shards are pruned by earlier ones. Each task gives at most k rows an item, which one
window merges. Terms of items, not the vocabulary, are told to all tasks, in blocks of items of about TERMS terms; a
block reads the documents once, and what its terms count in them is kept. Hashes only find terms: their bytes are
compared.

Scores: a term's weight w is floor(1000 ln((2N+2) / (2df+1))); its impact in a document is w * (10^9 tf div (1000 tf +
20 m)), m = 50 + (50 n N div L), with N documents that have a term, L their terms, n the document's; all in 64-bit
integers.

Defined results: null or empty text has no terms, and such documents are not counted; items without terms, or without a
document that scores above 0, have no row; rows that repeat an item's id are ranked one by one, each with ranks of its
own; documents that repeat an id are ranked one by one; of equal scores the smaller id comes first, no id last; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import HashIndex, batch_runs, checkpointed, word_hashes
from tallyforge.llm.decontaminate import folded, words

#: Terms of items that are told to all tasks at once (some 40 bytes each), documents of a shard, items traversed together.
TERMS, SHARD, GROUP = 1 << 20, 1 << 14, 256
#: Documents of a range that is scored whole, and states of an item that are opened at once.
LEAF, OPEN = 64, 16
LAST = np.iinfo(np.int64).max

_WORD = set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
_SPACED = bytes(b if b in _WORD else 32 for b in range(256))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def spaced(column: pa.Array) -> pa.Array:
    """Texts in which spaces stand for all characters that are in no term."""
    column = column.fill_null("")
    _, places, data = column.buffers()
    data = data.to_pybytes().translate(_SPACED) if data is not None else b""
    return pa.Array.from_buffers(column.type, len(column), [None, places, pa.py_buffer(data)], offset=column.offset)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


class Terms:
    """Terms told to tasks: places of words in them."""

    def __init__(self, terms: list[str]):
        each = [t.encode() for t in terms]
        self.data = np.frombuffer(b" ".join(each), np.uint8)
        self.sizes = np.array([len(t) for t in each], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        hashes, _, _ = word_hashes(self.data.tobytes())
        self.known = HashIndex(hashes)

    def __len__(self) -> int:
        return len(self.sizes)

    def find(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms, and which ones, by their bytes."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.known(hashes).astype(np.int64)
        word = np.flatnonzero(at >= 0)
        term, size = at[word], stops[word] - starts[word]
        same = size == self.sizes[term]
        for n in np.unique(size[same]):
            own = np.flatnonzero(same & (size == n))
            step = max(1, (1 << 20) // int(n))
            for k in range(0, len(own), step):
                part, place = own[k : k + step], np.arange(n)
                same[part] = (_FOLD[raw[starts[word[part]][:, None] + place]] == self.data[self.starts[term[part]][:, None] + place]).all(1)
        return word[same], term[same]


def count_terms(docs: DataFrame, terms) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with a term of any kind; terms, tfs: places in the broadcast `terms`, ascending."""
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in batches:
            ids, at = batch.column(0), 0
            for raw, starts, stops, hashes, places in batch_runs(spaced(batch.column(1))):
                n = np.diff(places)
                word, term = known.find(raw, starts, stops, hashes)
                key, tf = np.unique((np.searchsorted(places, word, "right") - 1) * max(1, len(known)) + term, return_counts=True)
                doc, term = np.divmod(key, max(1, len(known)))
                cuts = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))).cast(ints) for x in (term, tf)]
                out = pa.RecordBatch.from_arrays([ids.slice(at, len(n)), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])
                at += len(n)
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def treaps(term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right, top of the treaps of postings sorted by term and document; of equal impacts the left one is above.

    A node's parent is the lower of the nearest greater postings on its two sides, which are found by pointer jumping.
    """
    n = len(term)
    at = np.arange(n)
    edge = np.flatnonzero(term[1:] != term[:-1]) if n else at

    def nearest(step: int, above) -> np.ndarray:
        up = at + step
        up[edge + (step < 0)] = -1
        if n:
            up[0 if step < 0 else -1] = -1
        todo = at
        while len(todo):
            todo = todo[up[todo] >= 0]
            todo = todo[~above(impact[up[todo]], impact[todo])]
            up[todo] = up[up[todo]]
        return up

    before, after = nearest(-1, np.greater_equal), nearest(1, np.greater)
    under_left = (before >= 0) & ((after < 0) | (impact[before] < impact[after]))
    under_right = (after >= 0) & ~under_left
    left, right = np.full(n, -1), np.full(n, -1)
    right[before[under_left]] = at[under_left]
    left[after[under_right]] = at[under_right]
    return left, right, at[~under_left & ~under_right]


class Best:
    """The k best (score, document) of each item so far, best first; score 0: none yet."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.order = np.full((items, k), LAST)
        self.missing = np.zeros((items, k), bool)

    def add(self, item: np.ndarray, score: np.ndarray, order: np.ndarray, missing: np.ndarray) -> None:
        good = self.can(item, score, order)
        item, score, order, missing = item[good], score[good], order[good], missing[good]
        own = np.unique(item)
        if not len(own):
            return
        items = np.concatenate((np.repeat(own, self.k), item))
        scores, orders, gone = (np.concatenate((a[own].ravel(), b)) for a, b in ((self.score, score), (self.order, order), (self.missing, missing)))
        by = np.lexsort((gone, orders, -scores, items))
        begin = np.searchsorted(items[by], own)
        by = by[(begin[:, None] + np.arange(self.k))]
        self.score[own], self.order[own], self.missing[own] = scores[by], orders[by], gone[by]

    def can(self, item: np.ndarray, bound: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Which scores up to `bound`, of documents from `order` on, could enter."""
        least = self.score[item, -1]
        return (bound > least) | ((bound == least) & (bound > 0) & (order < self.order[item, -1]))


class Shard:
    """Documents in order of their ids, with the treap of each term."""

    def __init__(self, order: np.ndarray, missing: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        by = np.lexsort((missing, order))
        self.order, self.missing, self.n = order[by], missing[by], len(by)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        doc = place[doc]
        by = np.lexsort((doc, term))
        self.doc, self.term, self.impact = doc[by], term[by], impact[by]
        self.key = self.term * self.n + self.doc
        self.left, self.right, tops = treaps(self.term, self.impact)
        self.top = np.full(terms, -1)
        self.top[self.term[tops]] = tops

    def settle(self, node: np.ndarray, state: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes moved down to the highest whose document is in their state's range; terms without one go."""
        moved = np.arange(len(node))
        while len(moved):
            doc, at = self.doc[node[moved]], state[moved]
            low, high = doc < lo[at], doc >= hi[at]
            node[moved] = np.where(low, self.right[node[moved]], np.where(high, self.left[node[moved]], node[moved]))
            moved = moved[(low | high) & (node[moved] >= 0)]
        here = node >= 0
        return node[here], state[here]

    def search(self, best: Best, items: np.ndarray, begin: np.ndarray, terms: np.ndarray) -> None:
        """Put the documents of this shard into the k best of items; item k's terms are those from begin[k] to begin[k + 1]."""
        counts = begin[items + 1] - begin[items]
        state = np.repeat(np.arange(len(items)), counts)
        node = self.top[terms[ranges(begin[items], counts)]]
        item, lo, hi = items, np.zeros(len(items), np.int64), np.full(len(items), self.n)
        node, state = node[node >= 0], state[node >= 0]
        bound = np.bincount(state, self.impact[node], len(items)).astype(np.int64)
        while len(item):
            # Choose each item's states of the greatest bounds; what cannot enter any more goes.
            alive = best.can(item, bound, self.order[np.minimum(lo, self.n - 1)]) & (lo < hi)
            by = np.lexsort((-bound, item, ~alive))[: int(alive.sum())]
            turn = np.arange(len(by)) - np.searchsorted(item[by], item[by])
            chosen, rest = by[turn < OPEN], by[turn >= OPEN]
            start = np.searchsorted(state, np.arange(len(item)))
            size = np.searchsorted(state, np.arange(len(item)), "right") - start
            take = lambda some: (node[ranges(start[some], size[some])], np.repeat(np.arange(len(some)), size[some]))  # noqa: E731, B023
            open_node, open_state = take(chosen)
            rest_node, rest_state = take(rest)
            new = self._open(best, item[chosen], lo[chosen], hi[chosen], open_node, open_state)
            node, state = np.concatenate((rest_node, new[4])), np.concatenate((rest_state, new[5] + len(rest)))
            item, lo, hi, bound = (np.concatenate((a[rest], b)) for a, b in zip((item, lo, hi, bound), new[:4], strict=True))

    def _open(self, best: Best, item, lo, hi, node, state) -> tuple:
        """Score what the states give at once, and return the states that remain of them."""
        small = hi - lo <= LEAF
        at = np.flatnonzero(small[state])
        if len(at):
            base = self.term[node[at]] * self.n
            first, last = (np.searchsorted(self.key, base + x[state[at]]) for x in (lo, hi))
            all_of = ranges(first, last - first)
            own = np.repeat(state[at], last - first)
            score = np.bincount(own * LEAF + self.doc[all_of] - lo[own], self.impact[all_of], len(item) * LEAF).astype(np.int64)
            found = np.flatnonzero(score)
            doc = lo[found // LEAF] + found % LEAF
            best.add(item[found // LEAF], score[found], self.order[doc], self.missing[doc])
        large = np.flatnonzero(~small)
        keep = ~small[state]
        node, state = node[keep], np.searchsorted(large, state[keep])
        item, lo, hi = item[large], lo[large], hi[large]
        # The document of the greatest impact of each state.
        by = np.lexsort((-self.impact[node], state))
        first = by[np.searchsorted(state[by], np.arange(len(item)))]
        pivot = self.doc[node[first]]
        want = self.term[node] * self.n + pivot[state]
        place = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        score = np.bincount(state, np.where(self.key[place] == want, self.impact[place], 0), len(item)).astype(np.int64)
        best.add(item, score, self.order[pivot], self.missing[pivot])
        item, lo, hi = np.tile(item, 2), np.concatenate((lo, pivot + 1)), np.concatenate((pivot, hi))
        node, state = self.settle(np.tile(node, 2), np.concatenate((state, state + len(large))), lo, hi)
        return item, lo, hi, np.bincount(state, self.impact[node], len(item)).astype(np.int64), node, state


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    m = 50 + (50 * size * n) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def search_block(docs: DataFrame, items: list, k: int, shard: int = SHARD) -> DataFrame | None:
    """(q, item_id, doc_id, score) of the k best documents in each task; items: rows of q, item_id, terms. None: no document
    has a term."""
    spark = docs.sparkSession
    terms = sorted({t for r in items for t in r.terms})
    of = {t: i for i, t in enumerate(terms)}
    told = spark.sparkContext.broadcast(Terms(terms))
    counted = checkpointed(count_terms(docs, told))
    whole = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total")).first()
    if not whole.n:
        return None
    n, total = whole.n, whole.total
    seen = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).toPandas()  # a row a term told
    df = np.zeros(len(terms), np.int64)
    df[seen["t"].to_numpy(np.int64)] = seen["c"].to_numpy(np.int64)
    begin = np.cumsum([0, *(len(r.terms) for r in items)])
    flat = np.array([of[t] for r in items for t in r.terms], np.int64)
    plan = spark.sparkContext.broadcast((weights(n, df), begin, flat, np.array([r.q for r in items], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, begin, flat, numbers = plan.value
        best, parts, held = Best(len(numbers), k), [], 0

        def work() -> None:
            batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            ids, sizes = batch.column(0), batch.column(1).to_numpy()
            missing = np.asarray(ids.is_null())
            order = np.where(missing, LAST, np.asarray(ids.fill_null(0)))
            count = np.diff(batch.column(2).offsets.to_numpy())
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            doc = np.repeat(np.arange(len(sizes)), count)
            impact = impacts(weight[term], tf, sizes[doc], n, total)
            some = impact > 0
            if some.any():
                one = Shard(order, missing, doc[some], term[some], impact[some], len(weight))
                for g in range(0, len(numbers), GROUP):
                    one.search(best, np.arange(g, min(g + GROUP, len(numbers))), begin, flat)

        for batch in batches:
            for s in range(0, batch.num_rows, shard):
                parts.append(batch.slice(s, shard))
                held += parts[-1].num_rows
                if held >= shard:
                    work()
                    parts, held = [], 0
        if held:
            work()
        item, place = np.nonzero(best.score)
        doc = pa.array(best.order[item, place], mask=best.missing[item, place])
        yield pa.RecordBatch.from_arrays([pa.array(numbers[item]), doc, pa.array(best.score[item, place])], names=["q", "doc_id", "score"])

    found = counted.mapInArrow(run, "q long, doc_id long, score long")
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", told: int = TERMS, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item."""
    spark = docs.sparkSession
    text = folded(words(F.col(item_text_col)))
    rows = items.select(F.col(item_col).alias("item_id"), F.array_distinct(F.split(text, " ")).alias("terms"), text.alias("_t")).where("_t <> ''")
    # Kept, so that an item's number is settled.
    rows = checkpointed(rows.drop("_t").withColumn("q", F.monotonically_increasing_id()))
    blocks = max(1, -(-(rows.agg(F.sum(F.size("terms"))).first()[0] or 0) // told))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], "q long, doc_id long, score long")
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()  # about `told` terms
        part = search_block(own, block, k, shard) if block else None
        found = found if part is None else found.union(part)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(rows.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
