"""Batch scoring by any callable, and remote models: the nodes of the plan that are not built in.

A model that fails gives rows without an answer and with the error, never a failed task; how many may fail is asked of the
whole job once its answers are kept (check_failures). Answers can be logged under a key of model and prompt, in waves
(answered): a job that is killed goes on where its last finished wave ended, and no prompt of a finished wave is sent again.
"""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import checkpointed, ship_package
from tallyforge.sources import sinks


class TooManyFailures(RuntimeError):
    """More of a job's rows failed than the caller allows."""


def check_failures(rows: DataFrame, share: float, error: str = "error") -> None:
    """TooManyFailures if more than a share of all rows has an error. rows: kept, or a model is asked once more."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count(error).alias("failed"), F.max(error).alias("one")).first()
    if found.failed > share * found.n:
        raise TooManyFailures(f"{found.failed} of {found.n} rows failed, one of them: {found.one}")


def tried(call: Callable, attempts: int, wait: float):
    """call(), again after an error: at most `attempts` times, with waits that double and vary by half."""
    for k in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001 - a model's failure is data here
            if k + 1 == attempts:
                raise
            time.sleep(wait * 2**k * random.uniform(0.5, 1.5))
    raise ValueError("at least one attempt")


def score(rows: DataFrame, scorer: Callable[[list[str]], list[str | None]], size: int = 32, prompt: str = "prompt", errors: bool = False, attempts: int = 1, wait: float = 0.5) -> DataFrame:
    """rows with `output`, and `error` if asked for. scorer takes a list of prompts and returns as many outputs, in order.

    A batch that fails `attempts` times gives null outputs, which parsers read as -1, and the error.
    """
    ship_package(rows.sparkSession)
    columns = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask_one(part: list[str]) -> list:
            found = list(scorer(part))
            if len(found) != len(part):
                raise ValueError("scorer changed the number of rows")
            return found

        for frame in frames:
            outputs: list = []
            failures: list = []
            texts = frame[prompt].tolist()
            for s in range(0, len(texts), size):
                part = texts[s : s + size]
                try:
                    outputs += tried(lambda part=part: ask_one(part), attempts, wait)
                    failures += [None] * len(part)
                except Exception as e:  # noqa: BLE001
                    outputs += [None] * len(part)
                    failures += [repr(e)] * len(part)
            frame["output"] = pd.Series(outputs, index=frame.index, dtype="object")
            frame["error"] = pd.Series(failures, index=frame.index, dtype="object")
            yield frame[[*columns, "output", *(["error"] if errors else [])]]

    text = F.lit(None).cast("string")
    return rows.mapInPandas(run, rows.select("*", text.alias("output"), *([text.alias("error")] if errors else [])).schema)


#: A reply of a remote model: its parts by type, with text or summaries.
REPLY = "array<struct<type: string, text: string, summary: array<string>>>"


def ask(rows: DataFrame, client: Callable[[], Callable[[str], list[dict]]], in_flight: int = 8, workers: int = 4, prompt: str = "prompt", errors: bool = False, attempts: int = 1, wait: float = 0.5) -> DataFrame:
    """rows with `reply` (REPLY) of a remote model, asked one prompt at a time, and `error` if asked for.

    client() is called once a task and gives the function that sends a prompt. At most `workers` tasks run, each with
    in_flight // workers requests under way, so that no more than in_flight wait at once in the whole cluster; what is
    before this, such as the making of prompts, has its own tasks. A request that fails `attempts` times has a null reply.
    """
    ship_package(rows.sparkSession)
    lanes = max(1, in_flight // workers)
    inner = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("summary", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = client()
        with ThreadPoolExecutor(lanes) as pool:
            for batch in batches:
                waiting, replies, failures = deque(), [], []

                def take() -> None:
                    try:
                        replies.append([{k: p.get(k) for k in ("type", "text", "summary")} for p in waiting.popleft().result()])
                        failures.append(None)
                    except Exception as e:  # noqa: BLE001 - a failed request is data here
                        replies.append(None)
                        failures.append(repr(e))

                for text in batch.column(batch.schema.get_field_index(prompt)).to_pylist():
                    if len(waiting) >= lanes:
                        take()
                    waiting.append(pool.submit(tried, lambda text=text: send(text), attempts, wait))
                while waiting:
                    take()
                more = [pa.array(replies, inner), *([pa.array(failures, pa.string())] if errors else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "reply", *(["error"] if errors else [])])

    schema = rows.select("*", F.lit(None).cast(REPLY).alias("reply"), *([F.lit(None).cast("string").alias("error")] if errors else [])).schema
    return rows.repartition(workers).mapInArrow(run, schema)


#: What a log of answers holds: the key of model and prompt, and what came of it.
ANSWER = "key string, output string, error string"


def answered(rows: DataFrame, folder: str, model: str, asks: Callable[[DataFrame], DataFrame], waves: int = 16, prompt: str = "prompt", max_failed: float = 0.1) -> DataFrame:
    """rows with `output` and `error`, by answers that are logged in folder as they come.

    asks(prompts) -> the same with output and error, such as score(..., errors=True). Equal prompts are asked once. Prompts
    are dealt to waves by a hash of their key, and a wave's answers are one batch of the log, finished or not at all. A call
    asks what no finished wave has an answer to, so after a crash at most the wave that was under way is asked again, and
    prompts that failed are tried anew. The job ends (TooManyFailures) as soon as more than a share of its prompts has failed.
    """
    spark = rows.sparkSession
    key = F.sha2(F.concat_ws("\x1f", F.lit(model), F.coalesce(prompt, F.lit(""))), 256)
    keyed = rows.withColumn("_key", key)
    prompts = checkpointed(keyed.select(F.col("_key").alias("key"), prompt).dropDuplicates(["key"]))  # each wave reads them
    known = sinks.finished_batches(spark, folder)
    call = 1 + max((int(t.split("-")[0]) for t in known), default=-1)
    before = sinks.read_batches(spark, folder, ANSWER).where("error is null").select("key")
    todo = prompts.join(before, "key", "left_anti")
    total = prompts.count()
    for wave in range(waves):
        part = todo.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave)
        sinks.append_batch(asks(part).select("key", "output", "error"), folder, f"{call:06d}-{wave:04d}")
        own = sinks.read_batches(spark, folder, ANSWER).where(F.col("batch").startswith(f"{call:06d}-"))
        found = own.agg(F.count("error").alias("failed"), F.max("error").alias("one")).first()
        if found.failed > max_failed * total:
            raise TooManyFailures(f"{found.failed} of {total} rows failed, one of them: {found.one}")
    answers = sinks.read_batches(spark, folder, ANSWER)
    # Of a prompt that failed and was asked again, the answer; of one that failed only, the last failure.
    last = answers.groupBy("key").agg(F.max_by(F.struct("output", "error"), F.struct(F.col("error").isNull(), "batch")).alias("_a"))
    return keyed.join(last, keyed._key == last.key, "left").select(*rows.columns, "_a.output", "_a.error")
