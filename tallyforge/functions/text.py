"""Scalar expressions over label codes, names and texts. All are built-in column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def csv_codes(c: Column) -> Column:
    """"1, 2," -> [1, 2]: blanks and what is no integer are dropped; null stays null."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def csv_codes_strict(c: Column) -> Column:
    """As csv_codes, but a blank or bad code is an error (ANSI cast)."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x).cast("int"))


def codes_csv(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def has_label(c: Column, strict: bool = False) -> Column:
    """1 if the code text holds no "0", else 0; "" is 1, or null if strict. Null stays null."""
    flag = (~c.contains("0")).cast("int")
    return F.when(F.trim(c) != "", flag) if strict else flag


def code_map(names: Mapping[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in names.items() for x in item])


def codes_to_names(c: Column, names: Mapping[int, str]) -> Column:
    """"1,2" -> "First, Second"; unknown codes are left out."""
    lookup = code_map(names)
    return F.array_join(F.transform(csv_codes(c), lambda x: lookup[x]), ", ")


def sanitize(c: Column) -> Column:
    """Spaces and slashes become underscores."""
    return F.translate(c, " /", "__")


def display_name(c: Column, prefix: str = "") -> Column:
    """A sanitized name as a title, without its prefix."""
    return F.initcap(F.translate(F.regexp_replace(c, f"^{prefix}", ""), "_", " "))


def strip_charset(c: Column, chars: str = "img/") -> Column:
    """Drops leading characters that are in the set, as str.lstrip does."""
    return F.ltrim(c, F.lit(chars))


def strip_prefix(c: Column, prefix: str = "img/") -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def collapse_spaces(c: Column) -> Column:
    """Runs of any Unicode white space become one space; trimmed and lower-cased."""
    return F.trim(F.regexp_replace(F.lower(c), "(?U)\\s+", " "))


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def fill_template(template: str, value: Column) -> Column:
    """The template with each {} replaced literally."""
    return F.replace(F.lit(template), F.lit("{}"), value)


def data_url(image: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.replace(F.base64(image), F.lit("\r\n"), F.lit("")))


def first_of(a: Column, b: Column) -> Column:
    """a, or b where a is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def parent_name(path: Column) -> Column:
    """Name of the folder that holds a path's last part."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def joined_lines(lines: Column) -> Column:
    """Lines joined, or null if there are none."""
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def _low_part(a: Column, b: float, product: Column) -> Column:
    """What is missing in the rounded product of two doubles, exactly, by splitting both in halves of their digits."""
    half = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    high, b_high = half(a), b * 134217729.0 - (b * 134217729.0 - b)
    low, b_low = a - high, b - b_high
    return ((high * b_high - product) + high * b_low + low * b_high) + low * b_low


def rounded(c: Column, digits: int) -> Column:
    """Rounding of the exact binary value, halves to even, as Python has it: 2.675 -> 2.67, 0.125 -> 0.12.

    Spark's round works on the shortest decimal form. Here the scaled value is kept as a rounded product and its exact
    remainder, which tell on which side of a half it is. digits: 0 to 15.
    """
    value = c.cast("double")
    size, scale = F.abs(value), float(10**digits)
    product = size * scale
    rest = _low_part(size, scale, product)
    whole = F.floor(product).cast("double")
    whole = F.when((whole == product) & (rest < 0), whole - 1).otherwise(whole)
    beyond = (product - whole - 0.5) + rest
    up = (beyond > 0) | ((beyond == 0) & (whole % 2 == 1))
    near = F.when(up, whole + 1).otherwise(whole) / scale
    # Beyond 2^52 there is nothing left to round.
    return F.when(value.isNull() | F.isnan(value) | (product >= 2.0**52), value).when(F.signum(value) < 0, -near).otherwise(near)


def run_name(prefix: str, at: Column) -> Column:
    """prefix and a time as yyMMdd-HHmmss."""
    return F.concat_ws("_", F.lit(prefix), F.date_format(at, "yyMMdd-HHmmss"))


def is_published(model: Column, hubs: Sequence[str]) -> Column:
    """Whether a model id names a published model, by the prefixes of its hubs, rather than a checkpoint's path."""
    out = F.lit(False)
    for hub in hubs:
        out = out | model.startswith(hub)
    return out


def run_id(task: str, model: Column, hubs: Sequence[str]) -> Column:
    """Id of an evaluation: the task, and a published model's whole id or the folder that holds a checkpoint."""
    return F.concat(F.lit(f"eval_{task}_"), F.when(is_published(model, hubs), F.translate(model, "/", "_")).otherwise(parent_name(model)))
