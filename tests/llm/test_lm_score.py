import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import lm_score
from tallyforge.llm.common import HashIndex
from tallyforge.llm.lm_score import CLASSES, HIDDEN, START, WORDS, WORDS_IN_CLASS, Gru, Lanes, score_documents

SCHEMA = "doc_id long, text string, score double, id string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(n=300):
    rng = random.Random(8)
    rows = []
    for k in range(n):
        # Word i is followed by word 3i or 3i + 1: what comes before tells what follows.
        w, words = rng.randrange(50), []
        for _ in range(rng.choice([0, 3, 60, 200])):
            words.append(f"w{w}" if rng.random() < 0.9 else f"Rare{rng.randrange(10**5)},")
            w = (3 * w + rng.randrange(2)) % 50
        rows.append((k, " ".join(words)))
    return [*rows, (n, None), (n + 1, "   "), (5, rows[5][1])]


def test_base_figures(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], SCHEMA).repartition(4)
    got = sorted(score_documents(df).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for t in train for w in tokens(t))
    count["<end>"] = len(train)
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r, (i, text) in zip(got, sorted(rows, key=lambda x: (x[0], len(tokens(x[1])))), strict=True):
        own = [*tokens(text), "<end>"]
        assert (r.doc_id, r.held_out) == (i, zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert score_documents(df.limit(0)).collect() == []


def test_told_words_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 0.5, "x") for i, t in corpus(60)], SCHEMA).coalesce(1)
    key = lambda r: (r.doc_id, r.n_tokens)
    whole = sorted(score_documents(df).collect(), key=key)
    monkeypatch.setattr(lm_score, "TOLD", 10)
    few = sorted(score_documents(df).collect(), key=key)
    assert [r.n_known for r in whole] == [r.n_known for r in few]
    assert [r.base_score for r in whole] == pytest.approx([r.base_score for r in few], rel=1e-9)


def test_learns_and_carries_state():
    rng = np.random.default_rng(1)

    def docs(n):
        out = []
        for _ in range(n):
            w, d = int(rng.integers(40)), []
            for _ in range(int(rng.integers(5, 90))):
                d.append(w)
                w = (7 * w + int(rng.integers(2))) % 40
            out.append(np.array(d, np.int16))
        return out

    train, held = docs(3000), docs(100)
    count = np.bincount(np.concatenate(train), minlength=lm_score.WORDS)
    model = Gru()
    model.start_from(count, np.zeros(lm_score.RARE))
    before = model.score(held).sum()
    unigram = sum(np.log(count[d] / (count.sum() + 0.8)).sum() for d in held)
    assert abs(before - unigram) < 0.05 * abs(unigram)
    for k in range(3):
        model.fit(train, 0.06 / (1 + k))
    after = model.score(held)
    assert after.sum() > 0.7 * before
    alone = np.array([model.score([d], lanes=1)[0] for d in held[:20]])
    assert np.allclose(alone, after[:20], rtol=1e-4, atol=1e-3)


def test_distribution_sums_to_one():
    model = Gru()
    model.start_from(np.arange(1, 200), np.ones(lm_score.RARE))
    state = np.random.default_rng(2).normal(size=(1, HIDDEN)).astype(np.float32)
    every = np.arange(lm_score.START)
    logs, _ = model.log_probabilities(np.repeat(state, len(every), 0), every)
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradient():
    model = Gru()
    model.start_from(np.full(lm_score.WORDS, 5), np.ones(lm_score.RARE))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, lm_score.START, n) for n in (9, 4, 6)]
    deal = Lanes(np.array([9, 4, 6]), 2)
    target, before, _ = deal.flat(docs)
    places, within = next(deal.windows(12, 1))

    def loss():
        out = model.states(np.where(within, before[np.minimum(places, len(before) - 1)], 0), np.zeros((places.shape[1], HIDDEN)))
        return -model.log_probabilities(out[within].astype(np.float64), target[places[within]])[0].sum()

    _, grad = model.window_gradient(places, within, target, before, np.zeros((places.shape[1], HIDDEN)))
    for name in model.p:
        i = np.unravel_index(int(np.abs(grad[name]).argmax()), grad[name].shape)
        old = model.p[name][i]
        model.p[name][i] = old + 1e-2
        up = loss()
        model.p[name][i] = old - 1e-2
        down = loss()
        model.p[name][i] = old
        assert (up - down) / 2e-2 == pytest.approx(grad[name][i], rel=0.02, abs=1e-3), name


def test_hash_index():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    index = HashIndex(keys)
    assert (index(keys) == np.arange(len(keys))).all() and (index(keys + np.uint64(1)) == -1).mean() > 0.99
    assert (HashIndex(keys[:0])(keys) == -1).all()


def test_every_training_document_is_learnt_from(spark):
    df = spark.createDataFrame([(i, t) for i, t in corpus(200)], "id long, text string").repartition(1)
    source = df.select("id", "text", lm_score.training("id").alias("training"))
    counts = lm_score.checkpointed(lm_score.token_counts(source))
    told = spark.sparkContext.broadcast(lm_score.vocabulary(source, counts))
    whole = lm_score.train(source, told).flat()
    for k in (4, 13, 31):
        without = source.where(F.pmod(F.xxhash64("id"), F.lit(32)) != k)
        assert without.where("training").count() < source.where("training").count()
        assert not np.array_equal(lm_score.train(without, told).flat(), whole)


def plain_score(p, symbols):
    """The network symbol by symbol, in plain loops: gates, state, class and word."""
    tanh, n = math.tanh, HIDDEN
    h, before, total = [0.0] * n, START, 0.0
    for symbol in symbols:
        own = {k: v.astype(float) for k, v in p.items() if k in ("cb", "wb")}
        fed = p["x"][before].astype(float)
        turned = [sum(h[i] * float(p["u"][i, j]) for i in range(n)) for j in range(3 * n)]
        gate = [1 / (1 + math.exp(-2 * (fed[j] + turned[j]))) for j in range(2 * n)]
        new = [tanh(fed[2 * n + j] + gate[n + j] * turned[2 * n + j]) for j in range(n)]
        h = [gate[j] * h[j] + (1 - gate[j]) * new[j] for j in range(n)]
        rare = WORDS // WORDS_IN_CLASS
        k = symbol // WORDS_IN_CLASS if symbol < WORDS else symbol - WORDS + rare
        scores = [own["cb"][c] + sum(h[i] * float(p["c"][i, c]) for i in range(n)) for c in range(CLASSES)]
        total += scores[k] - math.log(sum(map(math.exp, scores)))
        if symbol < WORDS:
            span = range(k * WORDS_IN_CLASS, (k + 1) * WORDS_IN_CLASS)
            inner = [own["wb"][w] + sum(h[i] * float(p["w"][w, i]) for i in range(n)) for w in span]
            total += inner[symbol % WORDS_IN_CLASS] - math.log(sum(map(math.exp, inner)))
        before = symbol
    return total


def test_score_is_the_plain_networks():
    rng = np.random.default_rng(6)
    model = Gru()
    model.start_from(rng.integers(1, 500, 900), np.full(lm_score.RARE, 7.0))
    docs = [rng.choice([3, 17, 400, 899, WORDS + 2, WORDS + 50], n).astype(np.int16) for n in (1, 5, 40, 150, 9)]
    model.fit(docs * 40, 0.05)
    got = model.score(docs, lanes=2)
    assert got == pytest.approx([plain_score(model.p, d.tolist()) for d in docs], rel=1e-4)


def test_training_carries_the_state_through_a_long_document():
    rng = np.random.default_rng(7)
    model = Gru()
    model.start_from(np.full(WORDS, 5), np.ones(lm_score.RARE))
    long = rng.integers(0, START, 3000).astype(np.int16)
    before = np.concatenate(([START], long[:-1])).astype(np.int16)[:, None]
    whole = model.states(before, np.zeros((1, HIDDEN), np.float32))[:, 0]
    seen, at = [], 0
    own = model.window_gradient

    def spy(places, within, target, before, h):
        nonlocal at
        seen.append((at, h[0].copy()))
        at += len(places)
        return own(places, within, target, before, h)

    model.window_gradient = spy
    model.fit([long, long[:20]], 0.0)
    assert len(seen) > 4
    for t, h in seen[1:]:
        assert np.allclose(h, whole[t - 1], atol=1e-5)


def test_very_long_text_and_missing_id(spark):
    long = " ".join(f"w{k % 700}" for k in range(60_000))
    rows = [(None, "no id here"), (1, long), (2, long + " end"), (3, "w1 " * 10), (4, "\n" * 100_000)]
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {None: 4, 1: 60_001, 2: 60_002, 3: 11, 4: 1}
    assert not got[None].held_out and all(math.isfinite(r.score) and r.score < 0 for r in got.values())


def test_rows_are_scored_in_blocks():
    """More rows than a block, with scores near and far: as without blocks, in less memory than all scores of classes."""
    import tracemalloc

    rng, n = np.random.default_rng(3), 20 * lm_score.BLOCK + 7
    model = lm_score.Gru()
    model.p["cb"][5], model.p["wb"][70] = 200, -200
    states = rng.uniform(-1, 1, (n, lm_score.HIDDEN)).astype(np.float32)
    target = rng.integers(0, lm_score.START, n)
    tracemalloc.start()
    found, _ = model.log_probabilities(states, target, grad := {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    logs = lambda x: x - np.log(np.exp(x).sum(1, keepdims=True))
    word, each = target < lm_score.WORDS, np.arange(n)
    of = np.where(word, target // lm_score.WORDS_IN_CLASS, target - lm_score.WORDS + lm_score.WORDS // lm_score.WORDS_IN_CLASS)
    classes = logs(np.clip(states @ p["c"] + p["cb"], -lm_score.LOGIT, lm_score.LOGIT))
    inner = np.einsum("nh,nwh->nw", states, p["w"].reshape(-1, lm_score.WORDS_IN_CLASS, lm_score.HIDDEN)[np.where(word, of, 0)])
    inner = logs(np.clip(inner + p["wb"].reshape(-1, lm_score.WORDS_IN_CLASS)[np.where(word, of, 0)], -lm_score.LOGIT, lm_score.LOGIT))
    truth = classes[each, of] + np.where(word, inner[each, np.where(word, target % lm_score.WORDS_IN_CLASS, 0)], 0)
    assert np.allclose(found, truth, rtol=1e-4, atol=1e-3)
    flow = np.exp(classes)
    flow[each, of] -= 1
    assert np.allclose(grad["cb"], flow.sum(0), rtol=1e-3, atol=0.1)
    assert peak < n * lm_score.CLASSES * 4
