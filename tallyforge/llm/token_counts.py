"""Token counts by section: each document is encoded once and its tokens are joined to sections by character spans.

A token spans the characters that its bytes touch. Sections are disjoint character spans of a document, given in a
column or else its lines that hold a non-space character. A token that touches no section counts as outside. One that
touches several is allocated by `rule`: "first" gives it whole to the first section touched, "last" to the last,
"proportional" divides it by the characters touched (what lies between sections goes to none, the rest sums to 1).

Defined results: null or empty text has no tokens and no lines; a line of white space alone is no section, whatever its
length; null or empty sections leave all tokens outside; null ends are read as an empty span; null ids stay null; overlapping sections are an error of the caller: spans are sorted and cut to begin
where the one before ends; repeated rows are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.pretokens import json_encoder

RULES = ("first", "last", "proportional")


def line_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the lines that hold a character other than white space; one pass over the text."""
    out, at = [], 0
    for line in text.split("\n"):
        if line and not line.isspace():
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def token_spans(ids: np.ndarray, lengths: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last; lengths: bytes of each token id."""
    ends = np.cumsum(lengths[ids])
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return char[ends - lengths[ids]], char[ends - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each section (rows of start, end, in order) and tokens outside, by interval join on sorted spans."""
    out = np.zeros(len(sections))
    if not len(sections) or not len(start):
        return out, float(len(start))
    first = np.searchsorted(sections[:, 1], start, "right")
    last = np.searchsorted(sections[:, 0], end, "left") - 1
    touched = first <= last
    if rule == "proportional":
        one = touched & (first == last)
        np.add.at(out, first[one], 1.0)
        for t in np.flatnonzero(touched & (first < last)).tolist():
            k = np.arange(first[t], last[t] + 1)
            share = np.minimum(sections[k, 1], end[t]) - np.maximum(sections[k, 0], start[t])
            out[k] += share / share.sum()
    else:
        np.add.at(out, (first if rule == "first" else last)[touched], 1.0)
    return out, float((~touched).sum())


def _clean(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    out, at = [], 0
    for s, e in sorted(spans):
        s, e = max(s, at), min(e, n)
        if s < e:
            at = e
        out.append((s, max(s, e)))
    return np.array(out, np.int64).reshape(-1, 2)


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first"
) -> DataFrame:
    """doc_id, n_tokens, n_outside, sections (array of start, end, n_tokens) of every row.

    sections_col: an array<struct<start, end>> of character offsets, end exclusive.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    inner = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths = json_encoder(tokenizer), token_lengths(tokenizer)
        for batch in batches:
            rows = []
            every = table.ids_many(t.as_py() for t in batch.column(1))
            for k, ids in enumerate(every):
                text = batch.column(1)[k].as_py() or ""
                raw = text.encode("utf-8", "surrogatepass")
                if sections_col is None:
                    spans = line_spans(text)
                else:
                    spans = [(x["start"] or 0, x["end"] or 0) for x in batch.column(2)[k].as_py() or [] if x]
                spans = _clean(spans, len(text))
                start, end = token_spans(ids, lengths, raw)
                n, outside = attribute(start, end, spans, rule)
                rows.append((len(ids), outside, [{"start": a, "end": b, "n_tokens": c} for (a, b), c in zip(spans.tolist(), n.tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(inner))],
                names=["doc_id", "n_tokens", "n_outside", "sections"],
            )

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col is not None:
        columns.append(F.col(sections_col).alias("sections"))
    return docs.select(*columns).mapInArrow(run, "doc_id long, n_tokens long, n_outside double, sections array<struct<start: long, end: long, n_tokens: double>>")


_LENGTHS: dict[str, np.ndarray] = {}


def token_lengths(path: str) -> np.ndarray:
    """Bytes of each id: in a byte-level vocabulary every character of a token's name stands for one byte."""
    if path not in _LENGTHS:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        out = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, i in vocabulary.items():
            out[i] = len(name)
        _LENGTHS[path] = out
    return _LENGTHS[path]
