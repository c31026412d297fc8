"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import checkpointed, ensure_checkpoint_dir, ship_package

__all__ = ["batch_runs", "batch_word_hashes", "checkpointed", "ensure_checkpoint_dir", "sized", "small_batches", "table", "words_column"]

#: Rows of a key table that may be broadcast (16 bytes each at most); beyond it joins shuffle.
BROADCAST_ROWS = 2_000_000


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Texts are long: fewer rows in an Arrow batch keep a worker's memory small. Workers are told of the package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow key table for broadcast if it has at most `limit` rows; otherwise leave the join to shuffle."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def words_column(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; null text: empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


# --- numpy text hashing -------------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CHUNK = 1 << 22


def word_hashes(data: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start and end byte offsets of the words of UTF-8 text; fold lower-cases A-Z. Works in bounded pieces."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    codes = _FOLDED if fold else _BYTES
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(codes[raw[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _BASE)
        i = j
    return out, starts, ends


def batch_runs(column, fold: bool = True, at_once: int = 1 << 20):
    """Words of an Arrow string array (null as empty), several texts at a time.

    Yields (bytes, word starts, word ends, word hashes, places): texts follow each other in the bytes, and the words
    of text k of the run are those from places[k] to places[k + 1].
    """
    if not len(column):
        return
    column = column.fill_null("")
    wide = np.int64 if str(column.type).startswith("large") else np.int32
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    codes = _FOLDED if fold else _BYTES
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(ends, ends[i] + at_once, "right")) - 1))
        raw, cuts = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j
        if len(raw) > 2 * at_once:
            hashes, starts, stops = word_hashes(raw.tobytes(), fold)
            yield raw, starts, stops, hashes, np.array([0, len(hashes)])
            continue
        word = ~_SPACE[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = cuts[(cuts > 0) & (cuts < len(raw))]
        before[inner], after[inner - 1] = False, False
        starts, stops = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        up, down = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(codes[raw] * up[: len(raw)], out=total[1:])
        hashes = mix64((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64) * _BASE)
        yield raw, starts, stops, hashes, np.searchsorted(starts, cuts)


def batch_word_hashes(column, fold: bool = True):
    """Word hashes of each text of an Arrow string array, null as empty."""
    for _, _, _, hashes, places in batch_runs(column, fold):
        for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            yield hashes[a:b]


class HashIndex:
    """Places of distinct uint64 keys in an array, by open addressing with linear probing; -1 if absent."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        slot, rest, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(rest):
            self.probes += 1
            free = rest[self.at[slot[rest]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.at[slot[put]] = keys[put], put
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _BASE >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        at = self.at[slot]
        wrong = np.flatnonzero((at >= 0) & (self.keys[slot] != keys))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & self.mask
            found = self.at[slot]
            at[wrong] = found
            more = (found >= 0) & (self.keys[slot] != keys[wrong])
            wrong, slot = wrong[more], slot[more]
        return at


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` word hashes; a shorter non-empty sequence is one run."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = out * _BASE + words[k : k + n]
    return mix64(out + np.uint64(min(size, len(words))))
