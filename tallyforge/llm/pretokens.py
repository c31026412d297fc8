"""Splitting of text by the public tokenizers' pattern, and cached encoding of the pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Texts of these characters only are split by `re`, whose classes then agree with \\p{L} and \\p{N}.
_PLAIN = re.compile(r"[\t-\r -~¡-©«¬®-±´¶-¸»¿-ɏ‐-‧]*")
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters in a segment, and pieces in a cache before it starts anew.
SEGMENT, CACHE = 1 << 18, 400_000


def segments(text: str) -> Iterator[str]:
    """The text in bounded parts, cut only where a piece begins whatever follows: before a lone space."""
    at = 0
    while len(text) - at > SEGMENT and (m := _CUT.search(text, at + SEGMENT)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Splitter:
    """findall by the tokenizers' pattern."""

    def __init__(self, pattern: str | None = None):
        import public_tokenizers
        import regex

        self._slow = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self._own = pattern is not None and pattern != public_tokenizers.PATTERN

    def __call__(self, text: str) -> list[str]:
        return self._slow(text) if self._own or not _PLAIN.fullmatch(text) else _FAST.findall(text)


class _Index(dict):
    """Numbers keys as they come and notes the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class PieceTable:
    """Ids of pieces in flat arrays. Bounded: it starts anew when full.

    encode: list of pieces -> (ids in a row, number of ids of each piece, order of the pieces or None if as given).
    """

    def __init__(self, encode: Callable[[list[str]], tuple], split: Splitter | None = None):
        self.encode, self.split = encode, split or Splitter()
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.flat, self.first, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self) -> None:
        pieces, self.index.new = self.index.new, []
        ids, n, order = self.encode(pieces)
        k = len(self.index)
        if k > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * k), np.resize(self.count, 2 * k)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        at = slice(k - len(n), k) if order is None else k - len(n) + order
        self.first[at], self.count[at] = self.used + np.cumsum(n) - n, n
        self.used += len(ids)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return next(self.ids_many([text]))

    def ids_many(self, texts: Iterable[str | None], at_once: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of each text, null as empty. New pieces of about `at_once` characters are encoded together."""
        sizes, places, chars = [], [], 0
        for text in texts:
            if text and len(text) > at_once:
                yield from self._cut(sizes, places)
                sizes, places, chars = [], [], 0
                done = []
                for part in segments(text):
                    pieces = self.split(part)
                    done += self._cut([len(pieces)], [np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))])
                yield np.concatenate(done)
                continue
            pieces = [p for part in segments(text) for p in self.split(part)] if text else []
            places.append(np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces)))
            sizes.append(len(pieces))
            chars += len(text or "")
            if chars > at_once:
                yield from self._cut(sizes, places)
                sizes, places, chars = [], [], 0
        yield from self._cut(sizes, places)

    def _cut(self, sizes: list[int], places: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of texts given by their pieces' places, all at once; afterwards a full table starts anew."""
        if not sizes:
            return []
        if self.index.new:
            self._add()
        where = np.concatenate(places)
        n = self.count[where]
        ends = np.cumsum(n)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[where] - (ends - n), n)]
        cuts = np.concatenate(([0], ends))[np.cumsum(sizes)]
        if len(self.index) > CACHE:
            self._reset()
        return np.split(flat, cuts[:-1])


def flat_lists(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists in a row, and their lengths."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.concatenate(lists) if len(lists) else np.zeros(0, np.uint32), n


class JsonEncoder:
    """ids and ids_many of a tokenizers file of byte-level BPE.

    Texts of plain characters go through a faster library with the file's own vocabulary as merge ranks: for a
    byte-level BPE whose ids are in the order of its merges both give the same ids. Any other text, and any file of
    another kind, goes through tokenizers itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fast = self._ranked()

    def _ranked(self):
        import json

        import public_tokenizers
        import tiktoken

        spec = json.loads(self.tokenizer.to_str())
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or spec["normalizer"] or model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return None
        byte = byte_alphabet()
        try:
            ranks = {bytes(byte[c] for c in name): i for name, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
            merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            made = [ranks[bytes(byte[c] for c in a + b)] for a, b in merges]
        except KeyError:
            return None
        ordered = all(x < y for x, y in zip(made, made[1:], strict=False)) and sum(len(t) == 1 for t in ranks) == 256
        if not ordered:
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and _PLAIN.fullmatch(text):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        parts = segments(text) if self.fast is not None else [text]
        return np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(list(parts), add_special_tokens=False)])

    def ids_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        return (self.ids(t or "") for t in texts)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies name bytes: printable ones themselves, the others from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(spare)], spare = b, spare + 1
    return out


_ENCODERS: dict[str, JsonEncoder] = {}


def json_encoder(path: str) -> JsonEncoder:
    """One encoder per worker process for a tokenizers file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = JsonEncoder(path)
    return _ENCODERS[path]
