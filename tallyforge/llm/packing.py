"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

A document's ids (its text's, then one closing id) are cut into pieces of at most `capacity`; every full piece is a
sequence of its own, without a shuffle, and the remainders, one of a document at most, are packed by first-fit
decreasing. They are dealt to groups by a hash of id and row, so a group holds about GROUP documents whatever the corpus
and however often an id repeats, and each group is packed by one task on its own. Only lengths and checksums are
shuffled, never texts or ids.

Defined results: null or empty text is the closing id alone; a null id stays null; repeated rows are packed one by one;
ties are broken by id, then place; an empty table gives an empty result; other columns are ignored. The numbers of
sequences depend on how rows lie in partitions; what they hold is always whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed
from tallyforge.llm.pretokens import json_encoder

CAPACITY = 2048
#: Documents in a group, on average.
GROUP = 4096
END_ID = 1
#: Sequences of one full piece are numbered from here, beyond those of any group.
FULL = 1 << 62
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class TournamentTree:
    """Bin capacities under a max tree; first(n) is the leftmost bin with room for n."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.size)

    def first(self, n: int) -> int:
        best, k = self.best, 1
        while k < self.size:
            k *= 2
            if best[k] < n:
                k += 1
        return k - self.size

    def take(self, place: int, n: int) -> None:
        best, k = self.best, place + self.size
        best[k] -= n
        while k > 1:
            k //= 2
            left, right = best[2 * k], best[2 * k + 1]
            top = left if left > right else right
            if best[k] == top:
                break
            best[k] = top


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken in the order given for equal lengths."""
    order = np.argsort(-lengths, kind="stable")
    tree, fill = TournamentTree(max(1, len(lengths)), capacity), [0] * max(1, len(lengths))
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        k = tree.first(n)
        tree.take(k, n)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += n
    return bins, offsets


def tokenized_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """One row per piece of each document: its place, length and checksum."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = json_encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            every = table.ids_many(t.as_py() for t in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), every, strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for s in range(0, len(ids), capacity):
                    part = ids[s : s + capacity]
                    rows.append((doc, s, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(cut, _PIECES)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = checkpointed(tokenized_pieces(docs, tokenizer, id_col, text_col, capacity).withColumn("_row", F.monotonically_increasing_id()))
    full = F.col("length") >= capacity
    groups = max(1, round(pieces.where(~full).count() / GROUP))
    # The row's number is fixed by the checkpoint: documents that share an id, or have none, go to groups of their own.
    dealt = pieces.where(~full).withColumn("_g", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(groups)))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32", "_row")])
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows = rows.drop_columns(["_g", "_row"]).append_column("sequence_id", pa.array((int(key[0].as_py()) << 32) + bins))
        return rows.append_column("offset", pa.array(offsets))

    packed = dealt.groupBy("_g").applyInArrow(place, f"{_PIECES}, sequence_id long, offset long")
    alone = pieces.where(full).withColumn("sequence_id", F.col("_row") + F.lit(FULL)).withColumn("offset", F.lit(0).cast("long"))
    return packed.union(alone.select(*packed.columns))
