import random
import re
from collections import defaultdict

from tallyforge.llm.jaccard_join import jaccard_components

SCHEMA = "doc_id long, text string, n long, key string, label string"


def brute(rows, size, least, scale):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
        sets.append((i, grams))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and scale * len(x & y) >= least * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 6, 9, 14, 20, 40, 120]))]
        if rng.random() < 0.3:
            words += passage
        texts.append(words)
    for _ in range(90):
        words = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(words)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One"), (1004, "one"), (1005, "one two"), (1006, "a  b\nc d"), (1007, "A b c D")]
    return rows


def check(spark, rows, size, least):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in jaccard_components(df, size=size, least=least).collect())
    assert got == brute(rows, size, least, 100)


def test_against_brute_force(spark):
    check(spark, corpus(1), 4, 85)
    check(spark, corpus(2), 5, 80)


def test_dense_group_and_empty(spark):
    rng = random.Random(3)
    base = [f"v{rng.randrange(200)}" for _ in range(300)]
    rows = []
    for k in range(80):
        words = list(base)
        for _ in range(rng.choice([0, 2, 4, 8])):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    check(spark, rows, 4, 85)
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_same_id_twice(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    assert {r.component_id for r in jaccard_components(df).collect()} == {1}


def test_many_pairs_of_one_set(spark, monkeypatch):
    from tallyforge.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "SIDE", 5)
    rng = random.Random(5)
    base = [f"v{rng.randrange(200)}" for _ in range(200)]
    rows = [(k, " ".join([*base[:150], *[f"x{rng.randrange(10**6)}" for _ in range(3)], *base[150:]])) for k in range(60)]
    check(spark, rows, 4, 85)


def test_null_ids_and_a_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(60000))
    rows = [(None, "a b c d e f"), (7, "A b c d e f"), (None, "p q r s t"), (None, "p q r s t"), (3, long), (4, long + " end"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(2)
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard_components(df, size=4, least=85).collect())
    assert got == [(0, 0, None), (0, 2, None), (0, 2, None), (0, 3, 7), (3, 59997, 3), (4, 59998, 3), (7, 3, 7)]
