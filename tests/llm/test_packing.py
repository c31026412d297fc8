import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from tallyforge.llm.packing import END_ID, first_fit_decreasing, pack

SCHEMA = "doc_id long, text string, start long, length string"


def naive_ffd(lengths, capacity):
    fill, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for k, used in enumerate(fill):
            if used + lengths[i] <= capacity:
                break
        else:
            k = len(fill)
            fill.append(0)
        out[i] = (k, fill[k])
        fill[k] += lengths[i]
    return out


def test_tree_matches_scan():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 300):
        lengths = rng.integers(1, 2048, n)
        bins, offsets = first_fit_decreasing(lengths)
        assert list(zip(bins, offsets, strict=True)) == naive_ffd(lengths.tolist(), 2048)


def test_pieces_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(2)
    texts = [None, "", "Hello  world's 12 <|endoftext|> ünï²  x\n\n", "a" * 5000]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 900, rng.integers(1, 3000))) for _ in range(40)]
    rows = [(k, t, 5, "z") for k, t in enumerate(texts)] + [(4, texts[4], 5, "z")]
    got = pack(spark.createDataFrame(rows, SCHEMA), path).toPandas()
    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    filled = defaultdict(list)
    for k, text in enumerate(texts):
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")
        mine = got[got.doc_id == k].sort_values("start").drop_duplicates("start")
        assert (mine.doc_tokens == len(ids)).all()
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids)
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length, strict=True)]
    for r in got.itertuples():
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert (got.doc_id == 4).sum() % 2 == 0
    assert pack(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_repeated_and_missing_ids_are_dealt_out(spark, monkeypatch):
    from tallyforge.llm import packing

    monkeypatch.setattr(packing, "GROUP", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None if k % 2 else 9007199254740993, "x y z " * (k % 7)) for k in range(600)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect()
    assert len(got) == 600 and {r.doc_id for r in got} == {None, 9007199254740993}
    groups = defaultdict(int)
    for r in got:
        groups[r.sequence_id >> 32] += 1
    assert len(groups) > 8 and max(groups.values()) < 150


def test_long_text_and_exact_piece(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "the " * 2047), (2, "the " * 60000), (3, " " * 100000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), path).toPandas()
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()
    full = got[got.length == 2048]
    assert (full.offset == 0).all() and full.sequence_id.is_unique and not set(full.sequence_id) & set(got[got.length < 2048].sequence_id)
