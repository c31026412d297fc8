import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyforge.llm.pretokens import JsonEncoder


def test_same_as_tokenizers():
    encoder = JsonEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.fast is not None
    rng = random.Random(9)
    letters = list("abcdeghinorst  éèñüß01²½_$%'-.\n\t\r\x1c\x85 ΩжЖ漢字٣🙂") + ["'s", "'LL", "  ", "<|endoftext|>", "\n\n", "the "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 400]))) for _ in range(600)]
    texts += ["".join(rng.choice("abc déñ  .,'\n19") for _ in range(300)) for _ in range(100)] + [" " * 500, "a" * 4000]
    for text, ids in zip(texts, encoder.ids_many(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_other_kinds_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = JsonEncoder(path)
    assert encoder.fast is None
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    assert encoder.ids("Hello wide World").tolist() == plain.encode("Hello wide World", add_special_tokens=False).ids
    assert encoder.ids("").tolist() == np.zeros(0).tolist()
