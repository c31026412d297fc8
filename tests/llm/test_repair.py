import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np

from tallyforge.llm import repair
from tallyforge.llm.repair import damage, plan, repaired, repaired_digest, solve_all

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place long, code int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def broken(rows):
    """The damaged rows of each conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text, own = space(role), space(text), out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(rows, key=key) for c, rows in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_edits(rows, found):
    """Least (cost, letters) over all edits, by recursion over what has been written so far."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def go(k, last, put_in):
        options = []
        if k == len(rows):
            if last in ("", "a"):
                options.append((0, ""))
        else:
            role, fault = rows[k][1], found[k]
            cost, letters = go(k + 1, last, 0)
            options.append((cost + 2, "D" + letters))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] and role[0] in legal[last]:
                    cost, letters = go(k + 1, role[0], 0)
                    options.append((cost + more, "K" + letters))
                for r in "ua":
                    if r in legal[last]:
                        cost, letters = go(k + 1, r, 0)
                        options.append((cost + more + 1, "R" + letters))
        if put_in < 3:
            for r in "ua":
                if r in legal[last]:
                    cost, letters = go(k, r, put_in + 1)
                    options.append((cost + 5, "I" + letters))
        return min(options, default=(10**9, ""))

    return go(0, "", 0)


def mended(rows, audit):
    out, k = [], 0
    for x in audit:
        role = "assistant" if out and out[-1][0][0] == "u" else "user"
        if x == "I":
            out.append((role, ""))
            continue
        _, own, text = rows[k]
        k += 1
        if x != "D":
            out.append((own if x == "K" else role, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return out


def brute(rows):
    out = []
    for conv, own in broken(rows).items():
        found = faults(own)
        cost, audit = best_edits(own, tuple(found))
        turns = {t for t, _, _ in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        text = "\n".join(f"{r}:{t}" for r, t in mended(own, audit))
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    rows = []
    for conv in range(250):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 20])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else "user" if turn % 2 == 0 else "assistant"
            role = rng.choice(["system", role, role]) if turn == 0 else rng.choice([role] * 12 + ["system", "tool", None, "", "User"])
            text = rng.choice(["Fine.", "Yes!", "no end", "What? ", "cut,\n", "Été.", " \t\x0b", " ", None, f"Turn {turn}."])
            rows.append((conv, rng.choice([turn] * 15 + [None, turn + 3, 0]), role, text))
    rows += [rows[5], rows[5], (None, 0, "user", "Hi."), (None, None, "assistant", "Ho."), (None, None, None, None), (-7, None, "user", None)]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"Line {t}." if t % 5 else "again.") for t in range(1500)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def digest(spark, rows):
    hurt = damage(frame(spark, rows))
    return hurt, repaired_digest(hurt, plan(hurt))


def test_against_brute_force(spark):
    import sys

    sys.setrecursionlimit(20_000)
    rows = corpus()
    truth = brute(rows)
    hurt, found = digest(spark, rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == truth
    # With these costs a turn is never put in, as deleting one costs less; the search allows for it all the same.
    assert any(r[-2] == "" for r in truth) and {x for r in truth for x in r[-2]} == set("DKR")


def test_repaired_turns(spark):
    rows = corpus()
    hurt = damage(frame(spark, rows))
    own = {r[0]: r[-2] for r in map(tuple, repaired_digest(hurt, plan(hurt)).collect())}
    got = {}
    for r in repaired(hurt, plan(hurt)).collect():
        got.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    for conv, turns in broken(rows).items():
        assert [x[1:] for x in sorted(got.get(conv, []))] == mended(turns, own[conv])


def test_turns_put_in(monkeypatch):
    """With dear deletions turns are put in, in the middle and at the end."""
    monkeypatch.setattr(repair, "DELETE", 50)
    monkeypatch.setattr(repair, "REROLE", 20)
    codes = np.array([0, 1, 1, 2, 1, 2, 2])  # s u u a u, then a a
    cost, audit = solve_all(codes, np.array([5, 7]))
    assert cost.tolist() == [10, 10] and audit == [b"KKIKKKI", b"IKIK"]


def test_undamaged_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], "conv_id long, turn long, role string, text string")
    assert [(r.cost, r.audit) for r in plan(df).collect()] == [(0, "KK")]
    assert plan(df.limit(0)).collect() == [] and repaired(df.limit(0), plan(df.limit(0))).collect() == []


def test_buckets_and_pieces(monkeypatch):
    """Conversations solved together, in pieces of tensors, as one at a time."""
    rng = np.random.default_rng(4)
    sizes = rng.choice([0, 1, 2, 3, 9, 40], 300)
    ends = np.cumsum(sizes)
    codes = rng.integers(0, 16, ends[-1])
    cost, audit = solve_all(codes, ends)
    monkeypatch.setattr(repair, "CELLS", 64)
    again = solve_all(codes, ends)
    assert again[0].tolist() == cost.tolist() and again[1] == audit
    for k in range(300):
        own = codes[ends[k] - sizes[k] : ends[k]]
        rows = tuple((0, "suax"[c % 4], "") for c in own.tolist())
        found = tuple(["", "blank", "duplicate", "truncated"][c // 4] for c in own.tolist())
        assert best_edits(rows, found) == (cost[k], audit[k].decode())
