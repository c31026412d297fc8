"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Two sets link when scale * |A & B| >= least * |A | B|. Under any global order of shingles, linked sets share at least
k shingles among their first |A| - ceil(least/scale * |A|) + k. The order here puts shingles found frequent last, so
those prefixes hold rare ones. Small (light) sets enumerate every 2-subset of their prefix and meet on equal subsets.
Large (heavy) sets scan the inverted lists of their prefix shingles, against small and large sets alike, and a pair is
a candidate from k common entries. The boundary between small and large is where enumerating costs more than scanning.
Candidates are verified on the whole sets.

Long lists come from groups of near copies. Their members are first verified against one pivot of the list; then only
sets still in different components are paired, with at least one of them outside the list's main component. No link is
lost by that, as the result is components.

Defined results: null, empty or blank text has the empty set, which links with nothing; fewer words than a shingle make
one shingle; equal sets link whatever their number (they are one set from the start); rows that repeat an id are
documents of that id, linked where their sets are; rows without an id are linked like others, and a component's id is
the smallest one there is, null if there is none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import batch_word_hashes, checkpointed, mix64, shingle_hashes, sized
from tallyforge.llm.components import components

#: Entries a pair must share in the lists that large sets scan.
COMMON = 3
#: List length from which a shingle counts as frequent, and from which a list's members meet a pivot first.
FREQUENT, LONG = 16, 8
#: Most frequent shingles that are told to all tasks (16 bytes each); FREQUENT doubles until they fit. Fewer known
#: frequent shingles make longer lists, never another result.
KNOWN = 1 << 20
#: Pairs of one set that are verified in a task.
SIDE = 256


def hash_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    s = np.sort(shingle_hashes(words, size))
    if len(s) < 2:
        return s
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def set_id(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set, signed."""
    if len(s) == 0:
        return 0
    other = mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    total = (int(s.sum(dtype=np.uint64)) + int(other) * 0x9E3779B97F4A7C15 + len(s)) % 2**64
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def _least_overlap(n: int, least: int, scale: int) -> int:
    return -(-least * n // scale)


def _emit(docs: DataFrame, schema: str, types: list, size: int, make: Callable) -> DataFrame:
    """Rows that make(set, its id) gives as columns, for the first document of a set in a task and no empty set."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts: list[list] = [[] for _ in types]
            for words in batch_word_hashes(batch.column(1)):
                if not len(words):
                    continue
                s = hash_set(words, size)
                sid = set_id(s)
                if sid in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sid)
                for p, x in zip(parts, make(s, sid), strict=True):
                    p.append(x)
            arrays = [pa.array(np.concatenate(p) if p else [], t) for p, t in zip(parts, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, schema)


def _ordered_prefix(s: np.ndarray, n: int, known: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The first n shingles of a sorted set, frequent ones last by their count."""
    if known is None or len(known[0]) == 0:
        return s[:n]
    at = np.minimum(np.searchsorted(known[0], s), len(known[0]) - 1)
    weight = np.where(known[0][at] == s, known[1][at], 0)
    if not weight.any():
        return s[:n]
    return s[np.lexsort((s, weight))][:n]


class JaccardJoin:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, least: int, scale: int, row: Column | None = None):
        """row: a 64-bit key that tells rows of different texts apart; by default a hash of id and text."""
        row = F.xxhash64(id_col, text_col) if row is None else row
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row.alias("row"))
        self.size, self.least, self.scale = size, least, scale
        self.sc = docs.sparkSession.sparkContext

    def sets(self) -> DataFrame:
        """(doc_id, row, n, sid, prefix) of every document; prefix: the first shingles by hash, once for a set in a task."""
        size, least, scale = self.size, self.least, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                n, sids, prefixes = [], [], []
                for words in batch_word_hashes(batch.column(1)):
                    s = hash_set(words, size)
                    sid = set_id(s)
                    n.append(len(s))
                    sids.append(sid)
                    fresh = len(s) > 0 and sid not in seen
                    prefixes.append(s[: len(s) - _least_overlap(len(s), least, scale) + COMMON].view(np.int64) if fresh else None)
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(sid)
                arrays = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sids, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "n", "sid", "prefix"])

        return self.docs.mapInArrow(run, "doc_id long, row long, n long, sid long, prefix array<long>")

    def _second_rows(self, known) -> DataFrame:
        """(key): shingles to count again: the prefix once frequent ones are put last, or the whole of a set whose
        first prefix is mostly frequent (a near copy of many), as its next ones would be frequent too."""
        least, scale = self.least, self.scale

        def make(s, sid):
            n = len(s) - _least_overlap(len(s), least, scale) + COMMON
            first = s[:n]
            at = np.minimum(np.searchsorted(known.value[0], first), len(known.value[0]) - 1)
            hot = known.value[0][at] == first
            if 2 * hot.sum() >= len(first):
                return (s.view(np.int64),)
            return (_ordered_prefix(s, n, known.value).view(np.int64) if hot.any() else s[:0].view(np.int64),)

        return _emit(self.docs, "key long", [pa.int64()], self.size, make)

    def _prefix_rows(self, known, boundary: int) -> DataFrame:
        """(key, sid, n, pos, light): list entries of all sets, then (light) the 2-subsets of small ones."""
        least, scale = self.least, self.scale

        def make(s, sid):
            n = len(s)
            slack = n - _least_overlap(n, least, scale)
            first = _ordered_prefix(s, slack + COMMON, known.value if known is not None else None)
            keys, pos = first, np.arange(len(first))
            if n <= boundary:
                two = first[: slack + 2]
                i, j = np.triu_indices(len(two), 1) if n > 1 else (np.zeros(1, int), np.zeros(1, int))
                keys = np.concatenate((first, mix64(two[i] * np.uint64(0x9E3779B97F4A7C15) + mix64(two[j]))))
                pos = np.concatenate((pos, i + j))
            light = np.arange(len(keys)) >= len(first)
            return keys.view(np.int64), np.full(len(keys), sid), np.full(len(keys), n, np.int32), pos.astype(np.int32), light

        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        return _emit(self.docs, "key long, sid long, n int, pos int, light boolean", types, self.size, make)

    def frequent(self, sets: DataFrame):
        """Shingles frequent among prefixes, as a broadcast of sorted shingles and counts; and a list's mean length."""
        known, mean = None, 1.0
        for again in (False, True):
            rows = self._second_rows(known) if again else sets.select(F.explode("prefix").alias("key"))
            counts = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
            bits = counts.groupBy(F.floor(F.log2("c")).alias("b")).agg(
                F.count(F.lit(1)).alias("n"), F.sum(F.col("c") * F.col("c")).alias("s2"), F.sum("c").alias("s")
            ).collect()
            least, total = FREQUENT, 0 if known is None else len(known.value[0])
            while sum(r.n for r in bits if 2**r.b >= least) + total > KNOWN:
                least *= 2
            if not again:
                light = [r for r in bits if 2**r.b < least]
                mean = 1 + sum(r.s2 for r in light) / max(1, sum(r.s for r in light))
            found = counts.where(F.col("c") >= least).toPandas()
            if not len(found):
                break
            keys, c = found["key"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
            if known is not None:
                keys, c = np.concatenate((known.value[0], keys)), np.concatenate((known.value[1], c))
            order = np.lexsort((-c, keys))
            keys, c = keys[order], c[order]
            first = np.concatenate(([True], keys[1:] != keys[:-1]))
            known = self.sc.broadcast((keys[first], c[first]))
        return known, mean

    def boundary(self, mean: float) -> int:
        """The largest size at which enumerating 2-subsets costs no more than scanning lists of the mean length."""
        n = 1
        while n < 10_000:
            slack = n + 1 - _least_overlap(n + 1, self.least, self.scale)
            p = min(slack + 2, n + 1)
            if p * (p - 1) / 2 > mean * min(slack + COMMON, n + 1):
                break
            n += 1
        return n

    def verified(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of sets that link."""
        least, scale, size = self.least, self.scale, self.size
        pairs = checkpointed(pairs)

        def binary(batches):
            for batch in batches:
                sets = [hash_set(words, size) for words in batch_word_hashes(batch.column(2))]
                own = pa.array([set_id(s) == i for s, i in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_())
                out = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([x.filter(own) for x in (batch.column(0), batch.column(1), out)], names=["sid", "salt", "s"])

        def test(batches):
            for batch in batches:
                keep = []
                for a, b in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                    both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                    keep.append(scale * both >= least * (len(x) + len(y) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

        whole = pairs
        for side in ("a", "b"):
            # A pivot meets many sets: it is read several times over, so that no task gets more than about SIDE pairs of one.
            asked = checkpointed(pairs.groupBy(F.col(side).alias("sid")).agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("parts")))
            ids = reps.join(asked, "sid").select(F.col("row").alias("_rep"), "sid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
            texts = self.docs.join(sized(checkpointed(ids)), F.col("row") == F.col("_rep")).select("sid", "salt", "text")
            # Should two rows share a key, only the one of the set wanted is emitted; any copy of it will do.
            sets = texts.mapInArrow(binary, "sid long, salt int, s binary").dropDuplicates(["sid", "salt"])
            sets = sets.select(F.col("sid").alias(side), "salt", F.col("s").alias(f"s{side}"))
            many = sized(asked.where("parts > 1").select(F.col("sid").alias(side), "parts"))
            salt = F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")
            whole = whole.join(many, side, "left").withColumn("salt", salt).drop("parts").join(sets, [side, "salt"]).drop("salt")
        return checkpointed(whole.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long"))

    def _near(self, n: str, m: str):
        """Sizes between which a link is possible."""
        return (F.col(n) * self.scale >= F.col(m) * self.least) & (F.col(m) * self.scale >= F.col(n) * self.least)

    def links(self, sets: DataFrame, reps: DataFrame) -> DataFrame:
        """Verified pairs (a, b) of different sets, enough of them for the components of all links."""
        known, mean = self.frequent(sets)
        bound = self.boundary(mean)
        rows = self._prefix_rows(known, bound).repartition("key", "light").dropDuplicates(["key", "light", "sid"])
        of = Window.partitionBy("key", "light")
        rows = rows.withColumn("c", F.count(F.lit(1)).over(of)).where("c > 1")
        lists = checkpointed(rows)

        # A pivot has the fewest rarer shingles: the original rather than one of its copies.
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(self.scale / self.least)))
        pivots = lists.where(F.col("c") >= LONG).withColumn("band", band)
        head = pivots.groupBy("key", "light", "band").agg(F.min(F.struct("pos", "sid")).alias("p"))
        pivots = pivots.join(head, ["key", "light", "band"]).select(F.col("sid").alias("a"), F.col("p.sid").alias("b")).where("a <> b")
        best = pivots.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
        best = best.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b")))
        first = self.verified(best.where("r <= 2").select("a", "b"), reps)
        of_set = components(first)

        rows = lists.join(of_set.withColumnRenamed("node", "sid"), "sid", "left")
        rows = rows.withColumn("label", F.coalesce("label", "sid"))
        sizes = rows.groupBy("key", "light", "label").agg(F.count(F.lit(1)).alias("m"))
        main = sizes.groupBy("key", "light").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        rows = checkpointed(rows.join(main.select("key", "light", "main"), ["key", "light"]))
        x = rows.where("label <> main").select("key", "light", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"))
        y = rows.select("key", "light", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"), "main")
        # Small sets meet on their subsets only. The r-th common shingle of two sets leaves room for r plus what follows
        # it in either; linked sets need enough of it at each of their first COMMON ones.
        room = COMMON + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
        enough = room.cast("long") * (self.scale + self.least) >= self.least * (F.col("na") + F.col("nb")).cast("long")
        met = x.join(y, ["key", "light"]).where(
            (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b")))
            & self._near("na", "nb") & (F.col("light") | (((F.col("na") > bound) | (F.col("nb") > bound)) & enough))
        )
        pair = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "light")
        # Sets of fewer shingles than COMMON are never large: the boundary is beyond them.
        pair = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"), F.max("light").alias("light"))
        rest = self.verified(pair.where(F.col("light") | (F.col("w") >= COMMON)).select("a", "b"), reps)
        return first.union(rest)

    def run(self) -> DataFrame:
        """doc_id, row, n_shingles, label (of the component; null for empty sets), component_id of every row."""
        sets = checkpointed(self.sets())
        reps = checkpointed(sets.where("n > 0").groupBy("sid").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
        parts = components(self.links(sets, reps))
        named = reps.join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = named.join(smallest, "label").select("sid", "label", "component_id")
        out = sets.join(named, "sid", "left")
        return out.select("doc_id", "row", F.col("n").alias("n_shingles"), "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: int = 80, scale: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) for every row of docs."""
    return JaccardJoin(docs, id_col, text_col, size, least, scale).run().select("doc_id", "n_shingles", "component_id")


def jaccard_groups(docs: DataFrame, row: str, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: int = 80, scale: int = 100) -> DataFrame:
    """doc_id, row, n_shingles, label for every row of docs; row: a column that tells rows of different texts apart.

    Rows are of one component if and only if their labels are equal, whatever ids they share; no label: no words.
    """
    return JaccardJoin(docs, id_col, text_col, size, least, scale, F.col(row)).run().drop("component_id")
