"""Items as nested chat messages, replies read back, and image geometry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import fill_template
from tallyforge.plans.codebook import PROMPTS

#: Label -> words for 0 and 1 in a written answer.
ANSWERS = {
    "incivility": ("Incivility", "Civil", "Uncivil"),
    "intolerance": ("Intolerance", "Tolerant", "Intolerant"),
    "hateful": ("Hatefulness", "Neutral", "Hateful"),
}
TASK_LABELS = {"coarse": ("hateful",), "fine": ("incivility", "intolerance"), "joint": ("incivility", "intolerance", "hateful")}


def _part(kind: str, text: Column | None = None, image: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), (none if text is None else text).alias("text"), (none if image is None else image).alias("image"))


def _message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def answer(task: str) -> Column:
    """The written answer of a task's labels, in the order of its fields; a single label is its word alone."""
    word = lambda k: F.when(F.col(f"label_{k}") == 1, ANSWERS[k][2]).otherwise(ANSWERS[k][1])
    labels = TASK_LABELS[task]
    if len(labels) == 1:
        return word(labels[0])
    return F.concat_ws(", ", *[F.concat(F.lit(f"{ANSWERS[k][0]}: "), word(k)) for k in labels])


def _opening(task: str) -> list[Column]:
    """System and user message; a null text asks about an empty caption."""
    system, user = PROMPTS[task]
    prompt = fill_template(user, F.coalesce("text", F.lit("")))
    return [_message("system", _part("text", F.lit(system))), _message("user", _part("image", image=F.col("img")), _part("text", prompt))]


def training_messages(items: DataFrame, task: str) -> DataFrame:
    """id, messages: system, user with image and prompt, assistant with the answer."""
    turns = [*_opening(task), _message("assistant", _part("text", answer(task)))]
    return items.select("id", F.array(*turns).alias("messages"))


def inference_messages(items: DataFrame, task: str) -> DataFrame:
    """id, messages without the answer, and the label columns as they are."""
    labels = [c for c in items.columns if c.startswith("label")]
    return items.select("id", F.array(*_opening(task)).alias("messages"), *labels)


def api_messages(items: DataFrame, task: str) -> DataFrame:
    """As inference_messages for an API that takes text first, then the image as a data URL column `url`."""
    system, user = PROMPTS[task]
    prompt = fill_template(user, F.coalesce("text", F.lit("")))
    turns = [_message("system", _part("input_text", F.lit(system))), _message("user", _part("input_text", prompt), _part("input_image", image=F.col("url")))]
    labels = [c for c in items.columns if c.startswith("label")]
    return items.select("id", F.array(*turns).alias("messages"), *labels)


def flat_messages(rows: DataFrame) -> DataFrame:
    """One row for each part: id, turn, role, part, type, text, image."""
    turns = rows.select("id", F.posexplode("messages").alias("turn", "m"))
    return turns.select("id", "turn", F.col("m.role").alias("role"), F.posexplode("m.content").alias("part", "c")).select("id", "turn", "role", "part", "c.*")


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, n_turns and messages (role, text) in order of turn, then role and text."""
    one = F.struct(F.col(turn).alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    rows = turns.groupBy(conv).agg(F.sort_array(F.collect_list(one)).alias("m"))
    return rows.select(conv, F.size("m").alias("n_turns"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))


def last_reply(rows: DataFrame, role: str = "assistant") -> DataFrame:
    """Text of the last message of a role in `messages`; null if there is none."""
    own = F.filter("messages", lambda m: m["role"] == role)
    return rows.withColumn("reply", F.try_element_at(own, F.lit(-1))["text"])


def _number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """An unsigned number in binary content, from a place counted from 0; null beyond the end."""
    digits = F.hex(F.substring(content, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(size)))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("int"))


def image_size(content: Column, segments: int = 256) -> Column:
    """Width and height (w, h) that the header of a PNG, GIF, BMP or JPEG says; null for anything else.

    In expressions, so that bytes stay where they are read. A JPEG's segments are passed over, at most `segments` of them,
    up to the frame that holds its size.
    """
    sized = lambda w, h: F.struct(w.alias("w"), h.alias("h"))
    start = F.hex(F.substring(content, 1, 8))
    empty = F.lit(None).cast("int")

    def pass_over(a: Column, _: Column) -> Column:
        at = a["at"]
        mark = _number(content, at + 1, 1)
        frame = (mark >= 0xC0) & (mark <= 0xCF) & ~mark.isin(0xC4, 0xC8, 0xCC)
        ended = a["w"].isNotNull() | (at < 0) | mark.isNull() | (_number(content, at, 1) != 0xFF) | mark.isin(0xD9, 0xDA)
        bare = mark.between(0xD0, 0xD7) | mark.isin(0x01, 0xFF)
        onward = at + F.when(mark == 0xFF, 1).when(bare, 2).otherwise(2 + _number(content, at + 2, 2))
        found = ~ended & frame
        return F.struct(
            F.when(ended, at).otherwise(F.coalesce(onward, F.lit(-1))).cast("int").alias("at"),
            F.when(found, _number(content, at + 7, 2)).otherwise(a["w"]).alias("w"), F.when(found, _number(content, at + 5, 2)).otherwise(a["h"]).alias("h"),
        )

    zero = F.struct(F.lit(2).alias("at"), empty.alias("w"), empty.alias("h"))
    jpeg = F.aggregate(F.sequence(F.lit(1), F.lit(segments)), zero, pass_over, lambda a: F.when(a["w"].isNotNull() & a["h"].isNotNull(), sized(a["w"], a["h"])))
    png = sized(_number(content, 16, 4), _number(content, 20, 4))
    gif = sized(_number(content, 6, 2, True), _number(content, 8, 2, True))
    bmp = sized(_number(content, 18, 4, True), F.abs(_number(content, 22, 4, True)))
    found = F.when(start == "89504E470D0A1A0A", png).when(start.startswith("47494638"), gif).when(start.startswith("424D"), bmp).when(start.startswith("FFD8"), jpeg)
    return F.when(found["w"].isNotNull() & found["h"].isNotNull(), found)


def fit_geometry(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Size of an image (w, h) shrunk to fit, never enlarged, and its padding; odd pixels go right and below. Null if unknown.

    The side that does not fill its room is rounded down or up, whichever keeps the proportions better; down if equal.
    """
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    proportion = w / h

    def nearer(exact: Column, gap) -> Column:
        low, high = F.floor(exact), F.ceil(exact)
        return F.greatest(F.when((low == 0) | (gap(high) < gap(low)), high).otherwise(low), F.lit(1)).cast("int")

    fits, tall = (w <= width) & (h <= height), F.lit(width / height) >= proportion
    narrow = nearer(F.lit(float(height)) * proportion, lambda n: F.abs(proportion - n / F.lit(float(height))))
    flat = nearer(F.lit(float(width)) / proportion, lambda n: F.abs(proportion - F.try_divide(F.lit(float(width)), n)))
    known = w.isNotNull() & h.isNotNull()
    sized = rows.withColumn("new_w", F.when(known, F.when(fits, F.col("w")).when(tall, narrow).otherwise(width)).cast("int"))
    sized = sized.withColumn("new_h", F.when(known, F.when(fits, F.col("h")).when(tall, F.lit(height)).otherwise(flat)).cast("int"))
    left, top = F.expr(f"({width} - new_w) div 2").cast("int"), F.expr(f"({height} - new_h) div 2").cast("int")
    return sized.withColumn("pad_left", left).withColumn("pad_top", top).withColumn("pad_right", F.lit(width) - F.col("new_w") - left).withColumn("pad_bottom", F.lit(height) - F.col("new_h") - top)


def fit_images(images: DataFrame, fit: Callable[[bytes, int, int], bytes], width: int, height: int, column: str = "content") -> DataFrame:
    """images with their bytes decoded, shrunk, padded and encoded by `fit`; null where it cannot read them.

    fit comes from whatever imaging library the workers have; the geometry it should follow is fit_geometry's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, out = batch.schema.get_field_index(column), []
            for raw in batch.column(place).to_pylist():
                try:
                    out.append(None if raw is None else fit(raw, width, height))
                except (ValueError, OSError):
                    out.append(None)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return images.mapInArrow(run, images.schema)
