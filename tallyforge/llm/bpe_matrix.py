"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pieces are bucketed by byte length into matrices of token ids, padded on the right. In every round each row merges its
leftmost pair of least rank; ranks of pairs come from a hash table with open addressing. A row that merges loses one
cell, so the matrix narrows by one column a round, and rows without a pair left are taken out. Pieces longer than
WIDEST bytes, for which a round a merge would be quadratic, go through a heap with the same order of merges.

Defined results: null or empty text has no ids; rows are encoded one by one, repeated or not; an empty table gives an
empty result; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.pretokens import PieceTable, flat_lists

#: Widest matrix in bytes, and most cells in one.
WIDEST, CELLS = 512, 1 << 20
_NONE = np.int32(np.iinfo(np.int32).max)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank of the token that two adjacent tokens make, by hash with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        key, value = np.array(keys, np.uint64), np.array(values, np.int32)
        bits = max(4, (4 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, _NONE)
        slot, self.probes = self._slot(key), 0
        rest = np.arange(len(key))
        while len(rest):
            self.probes += 1
            free = rest[self.values[slot[rest]] == _NONE]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            done = np.zeros(len(key), bool)
            done[put] = True
            rest = rest[~done[rest]]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * _MULTIPLIER >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; negative ids are padding and pair with nothing."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], _NONE)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.values[slot] != _NONE))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            at, want = slot[open_], key[open_]
            hit = self.keys[at] == want
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] != _NONE)]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class MatrixBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.array([len(r) for r in raw])
        out: list = [None] * len(raw)
        widths = np.where(sizes <= 16, (sizes + 3) // 4 * 4, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int))
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            if width > WIDEST:
                for r in rows.tolist():
                    out[r] = self._long(raw[r])
                continue
            step = max(1, CELLS // max(1, width))
            for s in range(0, len(rows), step):
                part = rows[s : s + step]
                flat = np.frombuffer(b"".join(raw[r].ljust(width, b"\0") for r in part.tolist()), np.uint8)
                matrix = self.single[flat.reshape(len(part), width)]
                matrix[np.arange(width) >= sizes[part][:, None]] = -1
                self._merge(matrix, part, out)
        return out

    def _merge(self, m: np.ndarray, rows: np.ndarray, out: list) -> None:
        if m.shape[1] < 2:
            rank = np.full((len(m), 0), _NONE)
        else:
            rank = self.pairs(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
        while len(m):
            best = rank.min(axis=1) if rank.shape[1] else np.full(len(m), _NONE)
            more = best != _NONE
            if not more.all():
                for r, ids in zip(rows[~more].tolist(), m[~more], strict=True):
                    out[r] = ids[ids >= 0]
                m, rank, rows, best = m[more], rank[more], rows[more], best[more]
                if not len(m):
                    break
            at = rank.argmin(axis=1)
            each = np.arange(len(m))
            keep = np.ones(m.shape, bool)
            keep[each, at + 1] = False
            m[each, at] = best
            m = m[keep].reshape(len(m), -1)
            rank = rank[keep[:, 1:]].reshape(len(m), -1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < rank.shape[1])
            rank[left, at[left] - 1] = self.pairs(m[left, at[left] - 1], m[left, at[left]])
            rank[right, at[right]] = self.pairs(m[right, at[right]], m[right, at[right] + 1])

    def _long(self, raw: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        lookup, tokens = self.ranks.get, self._token
        first = self.pairs(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        alive = [True] * n

        def rank(i: int, j: int):
            return lookup(tokens(ids[i]) + tokens(ids[j]))

        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or rank(i, j) != r:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := rank(i, after[i])) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank(before[i], i)) is not None:
                heapq.heappush(heap, (x, before[i]))
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int32)

    def _token(self, i: int) -> bytes:
        return self.bytes[self.begin[i] : self.begin[i] + self.length[i]].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        n = self.length[ids]
        if not len(n):
            return b""
        ends = np.cumsum(n)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.begin[ids] - (ends - n), n)].tobytes()


_MODELS: dict[str, tuple[MatrixBpe, PieceTable]] = {}


def load(path: str) -> tuple[MatrixBpe, PieceTable]:
    """One model per worker process for a rank file."""
    if path not in _MODELS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
        model = MatrixBpe(ranks)
        _MODELS[path] = (model, PieceTable(lambda pieces: (*flat_lists(model.encode(pieces)), None)))
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded binary (the bytes of the ids) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = load(path)
        for batch in batches:
            ids = [x.astype(np.int32) for x in pieces.ids_many(t.as_py() for t in batch.column(1))]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            decoded = pa.array([model.decode(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], names=["doc_id", "ids", "decoded"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
