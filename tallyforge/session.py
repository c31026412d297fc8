"""Spark session with the settings the engine is planned for."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC. Cluster settings given outside stay as they are."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.jsonGenerator.ignoreNullFields": "false",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local(cpus: int | None = None, memory: str = "12g") -> SparkSession:
    n = cpus or os.cpu_count() or 4
    return build(master=f"local[{n}]", **{"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(n)})


def ship_package(spark: SparkSession) -> None:
    """Let Python workers started from now on find this package where the driver found it.

    On a cluster without a shared folder the package is installed or sent with --py-files as usual; then this path
    does not exist there and changes nothing.
    """
    root, own = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in own.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        own["PYTHONPATH"] = os.pathsep.join([root, *paths])


def _shared(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a temporary one will do in local mode; on a cluster, whose machines share none, it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own_folder()
    return shared


@cache
def _own_folder() -> str:
    """A temporary folder of this process, which goes with it."""
    folder = tempfile.mkdtemp(prefix="tallyforge-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, shared by all machines."""
    return f"{_shared(spark)}/tallyforge-{name}-{uuid.uuid4()}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark, "checkpoint"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
