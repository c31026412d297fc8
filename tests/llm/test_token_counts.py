import random

import public_tokenizers
from tokenizers import Tokenizer

from tallyforge.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(text, spans, rule):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    e = tokenizer.encode(text, add_special_tokens=False)
    n, outside = [0.0] * len(spans), 0
    for s, t in e.offsets:
        shares = [max(0, min(b, t) - max(a, s)) for a, b in spans]
        hit = [k for k, x in enumerate(shares) if x]
        if not hit:
            outside += 1
        elif rule == "proportional":
            for k in hit:
                n[k] += shares[k] / sum(shares)
        else:
            n[hit[0] if rule == "first" else hit[-1]] += 1
    return len(e.ids), outside, n


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        text = "".join(rng.choice(["the ", "hour", "é", "\n", "漢", " x", "12", "🙂", "ing"]) for _ in range(rng.choice([0, 3, 40])))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 6)))
        rows.append((k, text, [{"start": a, "end": b} for a, b in zip(cuts[::2], cuts[1::2])], "s"))
    rows += [(100, None, [], "s"), (101, "abc", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start: long, end: long>>, sections string")
    for rule in ("first", "last", "proportional"):
        for r in token_counts(df, PATH, sections_col="spans", rule=rule).collect():
            _, text, spans, _ = next(x for x in rows if x[0] == r.doc_id)
            n, outside, each = brute(text or "", [(x["start"], x["end"]) for x in spans or []], rule)
            assert (r.n_tokens, r.n_outside) == (n, outside)
            assert [round(x.n_tokens, 9) for x in r.sections] == [round(x, 9) for x in each]


def test_lines(spark):
    df = spark.createDataFrame([(1, "ab cd\n\n  \nef"), (1, "ab cd\n\n  \nef"), (2, "")], "doc_id long, text string")
    got = sorted(token_counts(df, PATH).collect())
    assert [(x.start, x.end) for x in got[0].sections] == [(0, 5), (10, 12)] and got[0] == got[1]
    assert sum(x.n_tokens for x in got[0].sections) + got[0].n_outside == got[0].n_tokens
    assert got[2].n_tokens == 0 and token_counts(df.limit(0), PATH).collect() == []


def test_long_blank_lines_take_linear_time(spark):
    import time

    from tallyforge.llm.token_counts import line_spans

    began = time.perf_counter()
    assert line_spans(" " * 3_000_000 + "\n\t\x0c\n" + " x ") == [(3_000_004, 3_000_007)]
    assert time.perf_counter() - began < 2
    rows = [(None, " " * 200_000 + "\nab"), (1, "word " * 40_000)]
    got = sorted(token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect(), key=lambda r: r.doc_id or 0)
    assert [len(r.sections) for r in got] == [1, 1] and got[0].doc_id is None
    assert got[1].sections[0].n_tokens + got[1].n_outside == got[1].n_tokens
