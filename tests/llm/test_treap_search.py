import math
import random
import re
from collections import Counter

import numpy as np

from tallyforge.llm.treap_search import Best, Shard, Terms, search, spaced, treaps

DOCS = "doc_id long, text string, item_id long, score long, q long, n long"
ITEMS = "item_id long, text string, doc_id long, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({k: k + 32 for k in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(docs, items, k=50):
    """Every document scored for every item."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(n=400):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "été", "the", "The", "ß", "x-1", "日本"]
    weights = [1 / (1 + k) for k in range(len(vocabulary))]
    text = lambda size: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=size))
    docs = [(k, text(rng.choice([0, 1, 5, 30, 200]))) for k in range(n)]
    docs += [(None, "w1 w2 w3"), (5, "w9 w9 w50"), (5, docs[5][1]), (n + 1, None), (n + 2, " .. "), (n + 3, "w3 " * 30000)]
    docs += [(n + 10 + k, "the same copy w59 w58") for k in range(120)]
    items = [(k, text(rng.choice([1, 3, 12, 40]))) for k in range(25)]
    items += [(90, None), (91, "..."), (92, "nowhere"), (3, "w59"), (None, "w58 été"), (93, "the the same Same copy"), (94, " ".join(vocabulary) * 2)]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in docs], DOCS).repartition(3),
        spark.createDataFrame([(i, t, 3, 4) for i, t in items], ITEMS).repartition(2),
    )


def rows(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


def test_against_brute_force(spark):
    docs, items = corpus()
    truth = brute(docs, items)
    d, i = frames(spark, docs, items)
    assert rows(search(d, i)) == truth
    assert rows(search(d, i, told=40, shard=70)) == truth
    assert rows(search(d, i, k=3)) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(20)
    d, i = frames(spark, docs, items)
    assert search(d.limit(0), i).collect() == search(d, i.limit(0)).collect() == search(d.where("text is null"), i).collect() == []


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(3)
    term = np.sort(rng.integers(0, 40, 3000))
    impact = rng.integers(1, 30, 3000)
    impact[term == 7] = 5
    impact[term == 8] = np.arange((term == 8).sum())
    left, right, tops = treaps(term, impact)
    assert len(tops) == len(np.unique(term))
    seen = []
    for top in tops:
        todo, order = [(top, False)], []
        while todo:
            node, done = todo.pop()
            if node < 0:
                continue
            if done:
                order.append(node)
                continue
            for child in (left[node], right[node]):
                assert child < 0 or (impact[child] <= impact[node] and term[child] == term[node])
            todo += [(right[node], False), (node, True), (left[node], False)]
        assert order == sorted(order)
        seen += order
    assert sorted(seen) == list(range(3000))


def test_pruning_skips_documents():
    """Of 20,000 documents with one rare good match the traversal scores few, and finds what scoring all does."""
    rng = np.random.default_rng(1)
    n, k = 20_000, 5
    doc = np.concatenate([np.sort(rng.choice(n, 6000, False)) for _ in range(3)])
    term = np.repeat(np.arange(3), 6000)
    impact = (rng.pareto(1.5, len(doc)) * 1000).astype(np.int64) + 1
    shard, best = Shard(np.arange(n), np.zeros(n, bool), doc, term, impact, 3), Best(1, k)
    scored = []
    add = best.add
    best.add = lambda item, score, order, missing: (scored.append(len(item)), add(item, score, order, missing))
    shard.search(best, np.array([0]), np.array([0, 3]), np.arange(3))
    whole = np.bincount(doc, impact, n).astype(np.int64)
    by = np.lexsort((np.arange(n), -whole))[:k]
    assert best.order[0].tolist() == by.tolist() and best.score[0].tolist() == whole[by].tolist()
    assert sum(scored) < n / 20


def test_terms_are_compared_by_bytes():
    import pyarrow as pa

    from tallyforge.llm.common import batch_runs

    known = Terms(["ab", "abc", "été"])
    known.known = lambda hashes: np.zeros(len(hashes), np.int64)  # as if every word's hash were that of "ab"
    (raw, starts, stops, hashes, _), = batch_runs(spaced(pa.array(["AB abc-ab aB\x00xy", None])))
    word, term = known.find(raw, starts, stops, hashes)
    assert word.tolist() == [0, 2, 3] and set(term.tolist()) == {0}
