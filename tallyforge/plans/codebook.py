"""Category dimensions, and prompts in wording of our own."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Names of the category codes in the annotation logs. Code 0 is the absence of the others.
INCIVILITY = {
    0: "Civil",
    1: "Vulgar/Profane",
    2: "Attacks",
    3: "Aspersions",
}
INTOLERANCE = {
    0: "Tolerant",
    1: "Threats to Rights",
    2: "Political Intolerance",
    3: "Racism",
    4: "Social Intolerance",
    5: "Gender/Sexual Intolerance",
    6: "Religious Intolerance",
    7: "Offensive Stereotypes",
    8: "Violent Threats",
    9: "Ableism",
}
DIMENSIONS = {"incivility": INCIVILITY, "intolerance": INTOLERANCE}
VERSION = 2

#: Task -> system and user prompt; {} takes the item's text. The form of the answer is what functions.parse reads.
PROMPTS = {
    "coarse": (
        "You review posts made of a picture and a caption.",
        "Say whether this post is hateful or neutral. Caption: {}\nAnswer with one word: Hateful or Neutral.",
    ),
    "fine": (
        "You review posts made of a picture and a caption.",
        "State incivility and intolerance of this post. Caption: {}\nAnswer in this form: Incivility: Civil or Uncivil, Intolerance: Tolerant or Intolerant",
    ),
    "joint": (
        "You review posts made of a picture and a caption.",
        "State incivility, intolerance and hatefulness of this post. Caption: {}\nAnswer in this form: Incivility: Civil or Uncivil, Intolerance: Tolerant or Intolerant, Hatefulness: Neutral or Hateful",
    ),
}


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """(code, name, dimension, version) of a dimension: a handful of rows, safe to broadcast."""
    book = DIMENSIONS[name]
    n = len(book)
    columns = [pa.array(list(book), pa.int32()), pa.array(list(book.values())), pa.array([name] * n), pa.array([VERSION] * n, pa.int32())]
    # An Arrow table becomes a local relation: no Python worker is started for it.
    return spark.createDataFrame(pa.table(columns, names=["code", "name", "dimension", "version"]))


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s, u) for k, (s, u) in PROMPTS.items()], "task string, system string, user string")
