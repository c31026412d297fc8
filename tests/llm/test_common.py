import random
import re

import pyarrow as pa
import pytest

from tallyforge.llm import common
from tallyforge.llm.common import batch_runs, batch_word_hashes, shingle_hashes, sized, word_hashes
from tallyforge.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def texts():
    rng = random.Random(21)
    parts = ["The", "the", "É", "é", "a", "b", " ", "\n", "\t\x0b", "漢", "🙂", "x" * 30, "\x85", "\xa0"]
    return [None, "", " ", *["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]]


def test_words_and_hashes_agree():
    name = {}
    for text in texts():
        hashes, starts, ends = word_hashes((text or "").encode())
        own = words(text)
        assert [(text or "").encode()[a:b].decode().translate({k: k + 32 for k in range(65, 91)}) for a, b in zip(starts, ends, strict=True)] == own
        for w, h in zip(own, hashes.tolist(), strict=True):
            assert name.setdefault(w, h) == h
    assert len(set(name.values())) == len(name)


@pytest.mark.parametrize("at_once", [7, 64, 1 << 20])
def test_batches_give_the_same_hashes(at_once):
    column = pa.array(texts())
    alone = [word_hashes((t or "").encode())[0].tolist() for t in texts()]
    got = []
    for _, _, _, hashes, places in batch_runs(column, at_once=at_once):
        got += [hashes[a:b].tolist() for a, b in zip(places[:-1], places[1:], strict=True)]
    assert got == alone
    assert [h.tolist() for h in batch_word_hashes(column.slice(5, 20))] == alone[5:25]


def test_chunks(monkeypatch):
    whole = [word_hashes((t or "").encode())[0].tolist() for t in texts()]
    monkeypatch.setattr(common, "_CHUNK", 5)
    assert [word_hashes((t or "").encode())[0].tolist() for t in texts()] == whole


def test_shingles():
    h = word_hashes(b"a b c d e")[0]
    assert len(shingle_hashes(h, 4)) == 2 and len(shingle_hashes(h[:2], 4)) == 1 and len(shingle_hashes(h[:0], 4)) == 0
    assert shingle_hashes(h[:4], 4)[0] == shingle_hashes(h, 4)[0] != shingle_hashes(h[:3], 4)[0]


def test_components(spark):
    rng = random.Random(22)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sized(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "hint" in plan(sized(spark.range(5), 5)).lower() and "hint" not in plan(sized(spark.range(6), 5)).lower()
