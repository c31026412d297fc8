import random

from pyspark.sql import functions as F

from tallyforge.llm import line_dedup
from tallyforge.llm.line_dedup import MIN_CHARS, banded_distance, dedup_lines, linked_lines

SCHEMA = "doc_id long, text string, h long, id string, kept int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(rng, line, edits):
    s = list(line)
    for _ in range(edits):
        k = rng.randrange(len(s))
        what = rng.randrange(3)
        if what == 0:
            s[k] = rng.choice("abcé🙂 ")
        elif what == 1:
            s.insert(k, rng.choice("abcé🙂 "))
        else:
            del s[k]
    return "".join(s)


def some_lines(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgé🙂 ") for _ in range(rng.choice([21, 25, 40, 90]))) for _ in range(n)]
    return base + [near(rng, rng.choice(base), rng.choice([1, 1, 2, 2, 3, 4])) for _ in range(2 * n)], rng


def test_distance(spark):
    lines, rng = some_lines(1, 40)
    pairs = [(a, near(rng, a, e)) for a in lines for e in (0, 1, 2, 3, 5)]
    for edits in (1, 2, 3):
        fit = [(a, b) for a, b in pairs if abs(len(a) - len(b)) <= edits]
        df = spark.createDataFrame(fit, "a string, b string")
        got = df.select("a", "b", banded_distance(F.split("a", ""), F.split("b", ""), edits).alias("d")).collect()
        for r in got:
            d = distance(r.a, r.b)
            assert r.d == d if d <= edits else r.d > edits, (r.a, r.b, r.d, d)


def test_links_against_brute_force(spark):
    for edits in (1, 2, 3):
        lines = sorted({x for x in some_lines(10 + edits, 40)[0] if len(x) >= MIN_CHARS})
        df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "h long, line string")
        got = {(r.a, r.b) for r in linked_lines(df.withColumn("len", F.char_length("line")), edits).collect()}
        assert got == {(i, j) for j in range(len(lines)) for i in range(j) if distance(lines[i], lines[j]) <= edits}


def brute(rows, edits=2):
    firsts, out = {}, []
    order = [(i, p, s) for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0)) for p, s in enumerate(t.split("\n"))]
    compared = lambda s: len(s) >= MIN_CHARS and s.strip(" \t\n\x0b\x0c\r")
    for i, p, s in order:
        if compared(s):
            firsts.setdefault(s, (i is not None, i or 0, p))
    gone = {s for s in firsts for o in firsts if firsts[o] < firsts[s] and abs(len(o) - len(s)) <= edits and distance(o, s) <= edits}
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        stay = [s for p, s in enumerate(t.split("\n")) if not compared(s) or (s not in gone and firsts[s] == (i is not None, i or 0, p))]
        out.append((i, "\n".join(stay)))
    return out


def test_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    test_documents(spark)


def test_documents(spark):
    lines, rng = some_lines(5, 25)
    rows = [(k, "\n".join(rng.choice([*lines, "short", "", " " * 30]) for _ in range(rng.randrange(0, 9)))) for k in range(40)]
    rows += [(7, rows[7][1]), (100, None), (101, ""), (None, lines[0] + "\nshort\nshort"), (102, lines[0])]
    df = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = dedup_lines(df)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    assert got.columns == [*df.columns, "n_lines", "n_kept"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(brute(rows), key=key)
    assert dedup_lines(df.limit(0)).collect() == []


def test_short_copies_go(spark):
    rows = [(2, "short\n\nshorts\nshort"), (1, "a line that is long enough\nshort\n  \n"), (3, None), (4, "short"), (5, "é\né")]
    df = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: r.text for r in dedup_lines(df, short=True).collect()}
    assert got == {1: rows[1][1], 2: "\nshorts", 3: None, 4: "", 5: "é"}


def template_lines(rng, n, digits=20):
    """Log lines, counters and footers: one template each, with numbers in it; some are within two edits of others."""
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = [f"2024-05-01 user {number(digits)} logged in from the server room" for _ in range(n)]
    out += [f"page {k} of the annual report of the company" for k in range(n // 4)]
    out += [f"id={number(8)} action=login through the usual gateway ip={number(8)}" for _ in range(n)]
    out += [near(rng, rng.choice(out), e) for e in (1, 2, 2, 3) for _ in range(n // 4)]
    return sorted({x for x in out if len(x) >= MIN_CHARS})


def test_template_lines_against_brute_force(spark, monkeypatch):
    lines = template_lines(random.Random(21), 120)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "h long, line string").withColumn("len", F.char_length("line"))
    truth = {(i, j) for j in range(len(lines)) for i in range(j) if abs(len(lines[i]) - len(lines[j])) <= 2 and distance(lines[i], lines[j]) <= 2}
    assert len(truth) > 100
    for crowd in (100, 8, 2):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        assert {(r.a, r.b) for r in linked_lines(df).collect()} == truth


def test_template_lines_do_not_meet_all_others(spark):
    lines = [x for x in template_lines(random.Random(22), 1500) if x.startswith("2024")]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "h long, line string").withColumn("len", F.char_length("line"))
    rows = line_dedup.candidate_rows(df).groupBy("key").count()
    assert rows.agg(F.sum(F.col("count") * F.col("count"))).first()[0] < 0.05 * len(lines) ** 2


def test_long_and_odd_lines(spark):
    long = "x" * 150_000
    rows = [(1, long + "\n" + "y" * 30), (2, "a" + long), (3, " " * 100_000 + "\n" + "y" * 29 + "z"), (4, None), (None, "y" * 30)]
    df = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], SCHEMA).repartition(2)
    got = {r.doc_id: r.text for r in dedup_lines(df, short=True).collect()}
    assert got == {1: long, 2: "", 3: " " * 100_000, 4: None, None: "y" * 30}
