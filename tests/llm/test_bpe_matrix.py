import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyforge.llm import bpe_matrix
from tallyforge.llm.pretokens import Splitter, segments

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    letters = "abcdeghinorst éèñüß01²½_$%'-.\n\t\r  ΩжЖ漢字٣🙂\x1c\x85"
    out = ["", "Hello  world's  ", "a" * 3000, "aab" * 700, " " * 900, "<|endoftext|>", "x" + "\n" * 40, "it's we'LL I'd  \n "]
    out += ["".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 40, 400]))) for _ in range(300)]
    out += [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 12))) for _ in range(200)) for _ in range(20)]
    return out


def test_same_ids_as_library(reference):
    model, pieces = bpe_matrix.load(PATH)
    for text in texts():
        ids = pieces.ids(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert model.decode(ids.astype(np.int64)) == text.encode()


def test_segments_keep_pieces(monkeypatch):
    from tallyforge.llm import pretokens

    monkeypatch.setattr(pretokens, "SEGMENT", 7)
    split = Splitter()
    for text in texts():
        assert [p for s in segments(text) for p in split(s)] == split(text)


def test_documents(spark, reference):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(9000, None, "x"), (9001, "same", "x"), (9001, "same", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe_matrix.encode_documents(df, PATH).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    for r in got:
        assert r.ids == reference.encode_ordinary(text[r.doc_id]) and bytes(r.decoded) == text[r.doc_id].encode()
    assert bpe_matrix.encode_documents(df.limit(0), PATH).count() == 0


def test_pieces_at_the_widest_matrix(reference):
    """Pieces of up to WIDEST bytes are merged in matrices, longer ones by a heap: the same ids on both sides of it."""
    model, pieces = bpe_matrix.load(PATH)
    rng = random.Random(9)
    for n in range(bpe_matrix.WIDEST - 2, bpe_matrix.WIDEST + 4):
        for text in ("a" * n, "".join(rng.choice("etaoin") for _ in range(n)), "é" * (n // 2) + "x" * (n % 2)):
            assert len(text.encode()) == n
            ids = pieces.ids(text)
            assert ids.tolist() == reference.encode_ordinary(text) and model.decode(ids.astype(np.int64)) == text.encode()
