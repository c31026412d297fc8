"""Labels out of free-text model output: 1, 0, or -1 where it cannot be told."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import collapse_spaces

#: Fields of the structured answers: field, word for 0, word for 1.
FIELDS = {
    "incivility": ("incivility", "civil", "uncivil"),
    "intolerance": ("intolerance", "tolerant", "intolerant"),
    "hateful": ("hatefulness", "neutral", "hateful"),
}


def first_label(c: Column, labels: Sequence[tuple[str, int]] = (("hateful", 1), ("neutral", 0))) -> Column:
    """The first label, in the order given, whose word the output contains; so "not hateful" counts as hateful."""
    text = collapse_spaces(c)
    out = F.when(text.contains(labels[0][0].lower()), labels[0][1])
    for word, value in labels[1:]:
        out = out.when(text.contains(word.lower()), value)
    return out.otherwise(-1)


def field_label(c: Column, field: str) -> Column:
    """Value of "field: word" or "field:word"; the form of 0 is tried first. More spaces than one do not match."""
    key, zero, one = FIELDS[field]
    text = F.lower(c)
    either = lambda word: text.contains(f"{key}: {word}") | text.contains(f"{key}:{word}")
    return F.when(either(zero), 0).when(either(one), 1).otherwise(-1)


def parse_fine(c: Column) -> Column:
    return F.struct(*[field_label(c, f).alias(f"pred_{f}") for f in ("incivility", "intolerance")])


def parse_joint(c: Column) -> Column:
    return F.struct(*[field_label(c, f).alias(f"pred_{f}") for f in FIELDS])
