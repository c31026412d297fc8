import hashlib
import random
import re

from tallyforge.llm.decontaminate import find_contamination

DOCS = "doc_id long, text string, item_id long, g long, window string, _w string"
ITEMS = "item_id string, text string, doc_id long, size int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def brute(docs, items):
    """Every window of every item at every place of every document."""
    out = []
    for doc, text in docs:
        words = WORD.findall(fold(text))
        hit, found = set(), set()
        for item, own in items:
            mine = WORD.findall(fold(own))
            size = min(10, len(mine))
            for k in range(len(mine) - size + 1 if mine else 0):
                for at in range(len(words) - size + 1):
                    if words[at : at + size] == mine[k : k + size]:
                        hit |= set(range(at, at + size))
                        found |= {item} - {None}
        out.append((doc, len(words), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Été", "été", "a", "ΑΣ", "q1", "zz9", "x", "İs"]
    text = lambda n, sep: "".join(w + rng.choice(sep) for w in rng.choices(vocabulary, [30, 20, 2, 2, 30, 1, 1, 1, 9, 1], k=n))
    items = [(str(k), text(rng.choice([12, 25, 14, 10]), [" ", "-", "\n"])) for k in range(30)]
    items += [("one", "Alone!"), ("three", "three short words"), ("nine", "n1 n2 n3 n4 n5 n6 n7 n8 n9"), ("none", " .,"), (None, "no id has these ten words in a row at all"), ("null", None)]
    items += [items[3], ("3b", items[3][1]), ("30", "the of the of the of the of the of"), ("2", "the of the of the of the of the of a")]
    docs = []
    for k in range(60):
        parts = [text(rng.randrange(0, 60), [" ", "  ", ", ", "\t"]) for _ in range(3)]
        chosen = rng.choice(items)[1] or ""
        parts.insert(rng.randrange(4), chosen.upper() if k % 7 == 0 and chosen.isascii() else re.sub(" ", rng.choice([" ", "\n", " * "]), chosen))
        docs.append((k, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "...."), (103, "alone"), (104, "Three short, words"), (7, docs[7][1]), (7, "other text"), (None, items[3][1]), (None, None), (105, "the of " * 3000), (106, items[0][1] + " " + "filler " * 20000 + items[1][1])]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, 1, 2, "w", "x") for d, t in docs], DOCS).repartition(3),
        spark.createDataFrame([(i, t, 3, 4) for i, t in items], ITEMS).repartition(2),
    )


def rows(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()), key=str)


def test_against_brute_force(spark):
    docs, items = corpus()
    truth = brute(docs, items)
    assert sum(r[2] > 0 for r in truth) > 40 and sum(r[2] == 0 for r in truth) > 5
    for told in (10**6, 3):
        assert rows(find_contamination(*frames(spark, docs, items), told=told)) == truth


def test_spans(spark):
    items = [("a", "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12"), ("b", "b1 b2")]
    docs = [(1, "x A1 a2 a3 a4 a5, a6 a7 a8 a9 a10 a11 y b1 b2 b1 b2 z b1 q b2")]
    found = find_contamination(*frames(spark, docs, items)).first()
    assert [(s.start, s.end) for s in found.spans] == [(1, 12), (13, 17)] and found.n_hit == 15 and found["items"] == ["a", "b"]


def test_passage_repeated_many_times_in_one_document(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    docs = [(1, " x ".join([passage] * 4000)), (2, " ".join([passage] * 4000))]
    found = {r.doc_id: r for r in find_contamination(*frames(spark, docs, [("a", passage)])).collect()}
    assert (found[1].n_hit, len(found[1].spans)) == (48_000, 4000) and (found[2].n_hit, [tuple(s) for s in found[2].spans]) == (48_000, [(0, 48_000)])


def test_empty_tables(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    assert find_contamination(d.limit(0), i).collect() == []
    assert rows(find_contamination(d, i.limit(0))) == brute(docs, [])


def test_passage_shared_by_many_items_and_documents(spark):
    passage = " ".join(f"p{k}" for k in range(10))
    items = [(str(k), f"{passage} own{k} word{k}") for k in range(300)]
    docs = [(k, f"before {passage} after {k}") for k in range(400)]
    truth = hashlib.sha256(",".join(sorted(str(k) for k in range(300))).encode()).hexdigest()
    found = find_contamination(*frames(spark, docs, items)).collect()
    assert len(found) == 400 and {r.n_hit for r in found} == {10}
    assert {hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in found} == {truth}
