"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, in DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item (all of a shorter one). A window occurs in a document only if
all shingles of the window do, so one shingle of it, its prefix, is necessary: the rarest in the corpus, as every
benchmark shingle is counted over all documents first. Windows with a shingle that no document has are out at once. The
prefixes meet the documents' shingles; the shingle's place in window and document says where the window would begin,
which length and place rule out or allow, and the words there are compared with the window's.

Words are compared by hashes of their Unicode lower case until then, which merges no fewer words than the rule of
lower-casing A-Z only; the last comparison is of the words themselves under that rule.

Prefixes are broadcast if there are at most `told` of them, and a document's words are then at hand; beyond that the
shingles are shuffled and the documents read again for what they met. Results of equal sets of windows are put together
once, however many documents have the set.

Defined results: null or empty text has no words; an item without words has no window; windows shared by items count for
each of them; items that repeat an id are one item, and items without one hit words but are no item; documents that
repeat an id, or have none, are judged one by one; an empty table gives an empty result, an empty benchmark no hits;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import BROADCAST_ROWS, checkpointed, sized

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 5
#: What stands between words, as a Java pattern on text that is not lower-cased yet.
BETWEEN = "[\\x00-/:-@\\[-`{-\\x7F]+"
MET = "struct<window: bigint, text: string, size: int, _start: int>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of the words of a text, in its own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def folded(some: Column) -> Column:
    """Words as one text, A-Z lower-cased."""
    return F.translate(F.array_join(some, " "), UPPER, LOWER)


def _hashes(some: Column) -> Column:
    return F.transform(some, lambda w: F.xxhash64(F.lower(w)))


def _shingle(size: int, hashes: str, at: Column) -> Column:
    """Hash of the `size` word hashes from a place on; null beyond the end."""
    h = F.col(hashes)
    return F.when(at + size <= F.size(h), F.xxhash64(F.lit(size), *[F.get(h, at + k) for k in range(size)]))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, text) of each window of each item, its words folded and joined by spaces."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("_w")).where("size(_w) > 0")
    size = F.least(F.size("_w"), F.lit(window))
    rows = rows.select("item_id", "_w", size.alias("_n"), F.explode(F.sequence(F.lit(1), F.size("_w") - size + 1)).alias("_k"))
    return rows.select("item_id", folded(F.slice("_w", F.col("_k"), F.col("_n"))).alias("text")).distinct()


class Decontamination:
    def __init__(self, docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, told: int):
        self.told = told
        text = F.coalesce(F.col(text_col), F.lit(""))
        # Rows of one id and text have one result: a digest of the text tells the others apart. A text that begins or ends
        # between words has an empty one there, which costs less to allow for than to remove.
        rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("_key"), F.split(text, BETWEEN).alias("_w"))
        lead = (F.get("_w", F.lit(0)) == "").cast("int")
        n = F.size("_w") - lead - ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")
        # The null stands for the document itself.
        self.rows = rows.select("doc_id", "_key", "_w", lead.alias("_lead"), n.alias("_n"), F.concat(F.array(F.lit(None).cast("long")), _hashes(F.col("_w"))).alias("_h"))
        owned = windows(items, item_col, item_text_col)
        # Kept, so that a window's number is settled.
        self.windows = checkpointed(owned.select("text").distinct().withColumn("window", F.monotonically_increasing_id()))
        self.owners = owned.where("item_id is not null").join(self.windows, "text").select("window", "item_id")

    def _tokens(self, sizes: list[int]) -> DataFrame:
        """Rows with the shingles `_g` of each place `_i` (from 1) and size; those of _i = 0 have none, and one is _own.

        The arrays are made into rows first, and hashed then, which is compiled as a lambda is not; an outer explode, as
        Spark puts a filter that makes the arrays once more before others.
        """
        rows = self.rows.select("*", F.posexplode_outer("_h").alias("_i", "_x"))
        each = [F.when(F.col("_i") > 0, _shingle(s, "_h", F.col("_i"))) for s in sizes]
        if len(each) < 2:
            return rows.withColumn("_g", each[0] if each else F.lit(None).cast("long")).withColumn("_own", F.col("_i") == 0)
        return rows.select("*", F.posexplode_outer(F.array(*each)).alias("_j", "_g")).withColumn("_own", (F.col("_i") == 0) & (F.col("_j") == 0))

    def prefixes(self) -> tuple[DataFrame, list[int]]:
        """(g, window, text, size, place) for windows that may occur: the rarest shingle and where in the window it is; and
        the sizes of shingles there are, at most SHINGLE of them."""
        rows = self.windows.select("window", "text", F.split("text", " ").alias("_w"))
        rows = rows.select("window", "text", F.size("_w").alias("size"), _hashes(F.col("_w")).alias("_h"))
        sizes = sorted(r.s for r in rows.select(F.least("size", F.lit(SHINGLE)).alias("s")).distinct().collect())
        own = rows.select("window", "size", "_h", F.posexplode("_h").alias("place", "_x"))
        shingle = F.coalesce(F.lit(None).cast("long"), *[F.when(F.least("size", F.lit(SHINGLE)) == s, _shingle(s, "_h", F.col("place"))) for s in sizes])
        own = checkpointed(own.select("window", "place", shingle.alias("g")).where("g is not null"))
        known = sized(own.select("g").distinct(), self.told)
        seen = self._tokens(sizes).select(F.col("_g").alias("g")).join(known, "g").groupBy("g").agg(F.count(F.lit(1)).alias("c"))
        rarest = own.join(sized(checkpointed(seen), self.told), "g", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "place", "g")).alias("p"))
        rarest = rarest.where("p.c > 0").select("window", "p.place", "p.g")
        return checkpointed(rarest.join(rows.drop("_h"), "window").select("g", "window", "text", "size", "place")), sizes

    def hits(self) -> DataFrame:
        """(doc_id, _key, _lead, _n, _own, hit): a row with _own for each document, and rows for windows that occur, as
        (start, end, window)."""
        prefixes, sizes = self.prefixes()
        tokens, same = self._tokens(sizes), F.col("_g") == F.col("g")
        start = (F.col("_i") - 1 - F.col("place")).alias("_start")
        # The place and the length of a window rule out what would begin before a document or end behind it.
        fits = (F.col("_start") >= 0) & (F.col("_start") + F.col("size") <= F.col("_lead") + F.col("_n"))
        if prefixes.limit(self.told + 1).count() <= self.told:
            met = tokens.join(F.broadcast(prefixes), same, "left").where("_own or window is not null")
            met = met.select("doc_id", "_key", "_lead", "_n", "_w", "text", "size", "window", "_own", start)
        else:
            lean = tokens.join(prefixes, same).select("doc_id", "_key", "_lead", "_n", "window", "text", "size", start).where(fits)
            found = lean.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).agg(F.collect_set(F.struct("window", "text", "size", "_start")).alias("_met"))
            both = self.rows.drop("_h").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left")
            every = F.concat(F.array(F.lit(None).cast(MET)), F.coalesce("_met", F.array().cast(f"array<{MET}>")))
            met = both.select("doc_id", "_key", "_lead", "_n", "_w", F.posexplode(every).alias("_i", "_m"))
            met = met.select("doc_id", "_key", "_lead", "_n", "_w", "_m.*", (F.col("_i") == 0).alias("_own"))
        there = F.when(fits, folded(F.slice("_w", F.greatest("_start", F.lit(0)) + 1, F.col("size"))) == F.col("text"))
        first = F.col("_start") - F.col("_lead")
        hit = F.when(there, F.struct(first.alias("start"), (first + F.col("size")).alias("end"), "window"))
        return met.select("doc_id", "_key", "_n", "_own", hit.alias("hit")).where("_own or hit is not null")

    def run(self) -> DataFrame:
        """doc_id, n_words, n_hit, spans (merged, of words), windows (ascending numbers) of every document."""
        of = self.hits().groupBy("doc_id", "_key", "_n").agg(F.count_if("_own").alias("_copies"), F.collect_set("hit").alias("_hits"))
        # One step at a time: what a lambda refers to must be a column, or it is computed for every element.
        places = F.flatten(F.transform("_hits", lambda x: F.sequence(x["start"], x["end"] - 1)))
        of = of.withColumn("_at", F.sort_array(F.array_distinct(places)))
        edge = lambda step: F.filter("_at", lambda x, i: F.coalesce(F.get(F.col("_at"), i + step) != x + step, F.lit(True)))
        of = of.withColumn("_from", edge(-1)).withColumn("_to", edge(1))
        rows = of.select(
            "doc_id", F.col("_n").cast("long").alias("n_words"), F.size("_at").cast("long").alias("n_hit"),
            F.zip_with("_from", "_to", lambda x, y: F.struct(x.alias("start"), (y + 1).alias("end"))).alias("spans"),
            F.sort_array(F.array_distinct(F.transform("_hits", lambda x: x["window"]))).alias("windows"), "_copies",
        )
        return rows.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copies")


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", told: int = BROADCAST_ROWS
) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start and end of hit words), items (ids as sorted strings) of every document."""
    work = Decontamination(docs, items, id_col, text_col, item_col, item_text_col, told)
    rows = checkpointed(work.run().withColumn("_set", F.when(F.size("windows") > 0, F.sha2(F.array_join(F.col("windows").cast("array<string>"), ","), 256))))
    sets = rows.where("_set is not null").groupBy("_set").agg(F.min("windows").alias("windows"))
    own = sets.select("_set", F.explode("windows").alias("window")).join(sized(checkpointed(work.owners), told), "window")
    named = checkpointed(own.groupBy("_set").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    out = rows.join(sized(named, min(told, 10_000)), "_set", "left")
    return out.select("doc_id", "n_words", "n_hit", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
