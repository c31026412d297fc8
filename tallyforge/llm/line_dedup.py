"""Line dedup: a segment-partition edit join over lines, in DataFrame functions only.

A line stays only where it occurs first, in order of (document id, place), and only if no other line within
`max_edits` edits occurs first before it. Lines of fewer than MIN_CHARS characters have no edits: with `short` an equal
one before them takes them away, without it they stay. Lines without a non-space character always stay.

A line of length l is cut into max_edits + 1 segments. Of two lines within that many edits, the longer holds one of
the shorter's segments unchanged near its place. So every line gives its own segments as index keys, with its length,
and as probes the substrings that could be a segment of a line up to max_edits shorter. Lines that share a key are
candidates unless the parities of their letter counts differ in more letters than the edits can explain; candidates
are verified by a banded bit-parallel edit distance: one word of 2 * max_edits + 1 bits moves down the diagonal.

Lines of one template share segments without being alike. A key of more than CROWD lines is therefore made finer: what its
lines hold beside the segment, without the beginning and end common to all of them, is cut into segments in its turn,
and so on until keys are small or next to nothing is left. Every pair within the edits still shares a key.

Defined results: null text stays null; an empty table gives an empty result; rows that repeat an id are one document
for the order and keep the same places; null ids come first; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import checkpointed, sized

MAX_EDITS = 2
MIN_CHARS = 20
#: Occurrences from which a line gives its keys once, at its first place, so that no key is hot by repetition.
HOT = 1000
#: Rows of a key from which its lines are told apart by one more segment, rather than each compared with all.
CROWD = 100


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _kinds(edits: int) -> list[tuple[int, int, int]]:
    """(segment, how much shorter its line is, shift of its place) of all segments that a line may hold of others."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(i, less, shift) for shift in range(low, high + 1)]
    return out


def _placed(rows: DataFrame, edits: int) -> DataFrame:
    """rows (len, i, less, shift, ..) with size of the shorter line, place and length of its segment i, where they fit."""
    parts = edits + 1
    size = F.col("len") - F.col("less")
    over = F.pmod(size, F.lit(parts))
    base = ((size - over) / parts).cast("int")
    start = base * F.col("i") + F.greatest(F.col("i") - parts + over, F.lit(0)) + F.col("shift")
    n = base + (F.col("i") >= parts - over).cast("int")
    rows = rows.select("*", size.alias("size"), start.alias("at"), n.alias("n"))
    return rows.where((F.col("at") >= 0) & (F.col("at") + F.col("n") <= F.col("len")))


def _kind_array(edits: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(shift).alias("shift")) for i, less, shift in _kinds(edits)])


_OWN = "less = 0 and shift = 0"


def _beside(text: str) -> Column:
    """What is left of a text without its segment."""
    return F.concat(F.substr(text, F.lit(1), F.col("at")), F.substr(text, F.col("at") + F.col("n") + 1))


def key_rows(lines: DataFrame, edits: int = MAX_EDITS, rest: bool = False) -> DataFrame:
    """(h, key, own) for each line of lines (h, line, len): own segments, and probes of segments of other lines.

    One row for each (segment, length less, shift) is made first and its key afterwards, so that the key is one small
    expression rather than one of a score in a method too large to be compiled. rest: also less, and the line beside
    the segment.
    """
    rows = lines.select("h", "line", "len", F.explode(_kind_array(edits)).alias("w")).select("h", "line", "len", "w.*")
    rows = _placed(rows, edits).where(F.col("size") >= MIN_CHARS)
    key = F.xxhash64("i", "size", F.substr("line", F.col("at") + 1, F.col("n")))
    more = [F.col("less"), _beside("line").alias("rest")] if rest else []
    return rows.select("h", key.alias("key"), F.expr(_OWN).alias("own"), *more)


def _common(a: str, b: str) -> Column:
    """Number of characters at the beginning of both texts that are the same."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.char_length(a), F.char_length(b)).cast("long")).cast("int")


def finer_rows(rows: DataFrame, edits: int = MAX_EDITS) -> tuple[DataFrame, DataFrame]:
    """Rows (h, key, own, less, rest) of crowded keys, dealt to finer keys; and (key, h, own) of those too short for that.

    Lines that share a segment are within the edits only if what they hold beside it is. Beginnings and ends that all
    lines of a key have in common say nothing and are cut off; of the rest one segment again is unchanged.
    """
    turned = F.reverse("rest")
    groups = rows.groupBy("key").agg(
        F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.min(turned).alias("rlo"), F.max(turned).alias("rhi"), F.min(F.char_length("rest")).alias("short")
    )
    groups = groups.select("key", "short", F.least(_common("lo", "hi"), F.col("short")).alias("front"), _common("rlo", "rhi").alias("back"))
    groups = checkpointed(groups.select("key", "front", F.least(F.col("back"), F.col("short") - F.col("front")).alias("back")))
    rows = rows.join(sized(groups), "key").withColumn("len", F.char_length("rest") - F.col("front") - F.col("back"))
    rows = rows.select("h", "key", "own", "less", "len", F.substr("rest", F.col("front") + 1, F.col("len")).alias("rest"))
    short = F.col("len") - F.col("less") <= edits
    own = rows.where(~short).withColumn("w", F.explode(F.filter(_kind_array(edits), lambda w: w["less"] == F.col("less"))))
    own = _placed(own.select("h", "key", "own", "len", "rest", "w.*"), edits)
    key = F.xxhash64("key", "i", "size", F.substr("rest", F.col("at") + 1, F.col("n")))
    own = own.select("h", key.alias("key"), (F.col("own") & F.expr(_OWN)).alias("own"), "less", _beside("rest").alias("rest"))
    return own, rows.where(short).select("key", "h", "own")


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of keys that several lines have, one at least as its own."""
    group = Window.partitionBy("key")
    shared = keys.withColumn("lo", F.min("h").over(group)).withColumn("hi", F.max("h").over(group))
    return shared.withColumn("any", F.max("own").over(group)).where("lo < hi and any").drop("lo", "hi", "any")


def candidate_rows(lines: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """(key, h, own): lines that share a key are candidates. Keys of more than CROWD rows are made finer, level by level."""
    level = checkpointed(_shared(key_rows(lines, edits)).select("key", "h", "own").distinct())
    found, rest = None, None
    while True:
        crowd = checkpointed(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key"))
        none = crowd.limit(1).count() == 0
        calm = level if none else level.join(sized(crowd), "key", "left_anti")
        calm = calm.select("key", "h", "own").distinct()
        found = calm if found is None else found.union(calm)
        if none:
            return found
        if rest is None:
            wanted = sized(checkpointed(level.join(sized(crowd), "key", "left_semi").select("h").distinct()))
            texts = lines.join(wanted, "h", "left_semi").groupBy("h", "len").agg(F.first("line").alias("line"))
            rest = key_rows(texts, edits, rest=True).join(sized(crowd), "key", "left_semi")
        else:
            rest = level.join(sized(crowd), "key", "left_semi")
        finer, short = finer_rows(checkpointed(rest.distinct()), edits)
        found = found.union(short.distinct())
        level = checkpointed(_shared(finer))


def banded_distance(a: Column, b: Column, edits: int = MAX_EDITS) -> Column:
    """Edit distance of two columns of character arrays if it is at most `edits`; else some larger number.

    Their lengths must differ by no more than `edits` and a must be longer than that. Bit d of a word stands for row
    j - edits + d of column j. The score follows the lowest row of the band until that is the last row, then the
    last row itself.
    """
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1).cast("long")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = F.size(a)
    flip = lambda x: full.bitwiseXOR(x.bitwiseAND(full))
    bit = lambda x, at: F.call_function("getbit", x, at).cast("long")

    def equal(c: Column, j: Column) -> Column:
        out = zero
        for d in range(width):
            same = F.coalesce(F.get(a, j - edits + d - 1) == c, F.lit(False))
            out = out + F.when(same, F.lit(1 << d).cast("long")).otherwise(zero)
        return out

    def step(s: Column, c: Column) -> Column:
        j = s["j"] + 1

        def with_equal(x: Column) -> Column:
            carry = ((x.bitwiseAND(s["vp"])) + s["vp"]).bitwiseXOR(s["vp"])
            return _let(carry.bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(full), with_diagonal)

        def with_diagonal(d0: Column) -> Column:
            hp = s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"])))
            hn = d0.bitwiseAND(s["vp"])
            return _let(F.struct(d0.alias("d"), hp.alias("p"), hn.alias("n")), with_horizontal)

        def with_horizontal(h: Column) -> Column:
            half = F.shiftright(h["d"], 1)
            over = j + edits - rows
            side = F.lit(2 * edits) - over
            score = F.when(over <= 0, one - bit(h["d"], F.lit(2 * edits))).otherwise(
                bit(h["p"], F.greatest(side, F.lit(0))) - bit(h["n"], F.greatest(side, F.lit(0)))
            )
            return F.struct(
                j.alias("j"),
                h["n"].bitwiseOR(flip(half.bitwiseOR(h["p"]))).alias("vp"),
                half.bitwiseAND(h["p"]).alias("vn"),
                (s["score"] + score).cast("long").alias("score"),
            )

        return _let(equal(c, j), with_equal)

    start = F.struct(
        F.lit(0).alias("j"),
        F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("vp"),
        zero.alias("vn"),
        F.lit(edits).cast("long").alias("score"),
    )
    return F.aggregate(b, start, step, lambda s: s["score"])


def _parity(chars: Column) -> Column:
    """64 bits: bit k is the parity of the number of characters whose code is k modulo 64."""
    zero = F.lit(0).cast("long")
    return F.aggregate(chars, zero, lambda x, c: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))))


def linked_lines(lines: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """Pairs (a, b) of ids of different lines within `edits` edits. lines: h (id), line, len."""
    shared = checkpointed(candidate_rows(lines, edits))

    wanted = sized(shared.select("h").distinct())
    texts = lines.select("h", "line").join(wanted, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    texts = texts.select("h", F.split("line", "").alias("chars"))
    texts = checkpointed(texts.select("h", "chars", F.size("chars").alias("len"), _parity(F.col("chars")).alias("sig")))
    rows = shared.join(texts.select("h", "sig", "len"), "h")
    x = rows.where("own").select("key", F.col("h").alias("a"), F.col("sig").alias("sa"), F.col("len").alias("la"))
    y = rows.select("key", F.col("h").alias("b"), F.col("sig").alias("sb"), F.col("len").alias("lb"), "own")
    near = (F.col("a") < F.col("b")) | (~F.col("own") & (F.col("a") != F.col("b")))
    fits = (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 2 * edits) & (F.abs(F.col("la") - F.col("lb")) <= edits)
    pairs = x.join(y, "key").where(near & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = texts.select(F.col("h").alias("a"), F.col("chars").alias("ca")), texts.select(F.col("h").alias("b"), F.col("chars").alias("cb"))
    whole = pairs.join(left, "a").join(right, "b")
    # Common beginnings and ends do not change a distance. Each step is a row of its own (inline): what a lambda refers to
    # must be a column, or it is computed for every element.
    for _ in ("beginnings", "ends"):
        same = F.zip_with("ca", "cb", lambda x, y: F.coalesce(x == y, F.lit(False)))
        most = F.least(F.size("ca"), F.size("cb")) - edits - 1
        first = F.array_position(same, False).cast("int")
        cut = F.struct("ca", "cb", (1 + F.when(first > 0, F.least(first - 1, most)).otherwise(most)).alias("at"))
        whole = whole.select("a", "b", F.inline(F.array(cut)))
        left = F.struct(*[F.reverse(F.slice(c, F.col("at"), F.size(c))).alias(c) for c in ("ca", "cb")])
        whole = whole.select("a", "b", F.inline(F.array(left)))
    return whole.where(banded_distance(F.col("ca"), F.col("cb"), edits) <= edits).select("a", "b")


def _compared(line: Column, short: bool) -> Column:
    return (F.char_length(line) >= (1 if short else MIN_CHARS)) & line.rlike("[^ \\t-\\r]")


def kept_places(docs: DataFrame, id_col: str, text_col: str, edits: int = MAX_EDITS, short: bool = False) -> DataFrame:
    """(id, kept: sorted places of the compared lines that stay) for ids with any."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    lines = lines.where(_compared(F.col("line"), short)).select("id", "pos", "line", F.xxhash64("line").alias("h"), F.char_length("line").alias("len"))
    first = lines.groupBy("h", "len").agg(F.min(F.struct("id", "pos")).alias("at"), F.count(F.lit(1)).alias("n"))
    first = checkpointed(first)
    hot = sized(first.where((F.col("n") >= HOT) & (F.col("len") >= MIN_CHARS)).select(F.col("h").alias("_h"), F.col("at").alias("_at")))
    once = lines.where(F.col("len") >= MIN_CHARS).join(hot, F.col("h") == F.col("_h"), "left")
    once = once.where(F.col("_at").isNull() | (F.col("id").eqNullSafe(F.col("_at.id")) & (F.col("pos") == F.col("_at.pos"))))
    links = checkpointed(linked_lines(once.select("h", "line", "len"), edits))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = first.select(F.col("h").alias("b"), F.col("at").alias("other"))
    before = both.join(seen, "b").groupBy("a").agg(F.min("other").alias("other"))
    stay = first.drop("n").join(before, first.h == before.a, "left").where("other is null or at <= other")
    return stay.groupBy(F.col("at.id").alias("id")).agg(F.sort_array(F.collect_list("at.pos")).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MAX_EDITS, short: bool = False) -> DataFrame:
    """docs with the lines that stay in `text_col`, and n_lines, n_kept in place of any such columns."""
    kept = kept_places(docs, id_col, text_col, edits, short)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    # Places are few beside texts: hashing them spares sorting the texts.
    joined = whole.join(kept.hint("shuffle_hash"), F.col("_doc")[id_col].eqNullSafe(F.col("id")), "left")
    joined = joined.select("_doc", "kept", F.split(F.col("_doc")[text_col], "\n").alias("_lines"))
    free = F.filter(F.transform(F.col("_lines"), lambda s, i: F.when(~_compared(s, short), i)), lambda i: i.isNotNull())
    joined = joined.withColumn("_stay", F.sort_array(F.concat(free, F.coalesce("kept", F.array().cast("array<int>")))))
    text = F.array_join(F.transform("_stay", lambda i: F.get(F.col("_lines"), i)), "\n")
    columns = [text.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_kept")]
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return joined.select(*columns, F.greatest(count("_lines"), F.lit(0)).alias("n_lines"), F.greatest(count("_stay"), F.lit(0)).alias("n_kept"))
