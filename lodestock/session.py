"""Tables that cut lineage: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; below a folder of our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="lodestock-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = "file://" + _OWN[0]
    return f"{root.rstrip('/')}/lodestock/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: what was computed survives the executors that did it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df on the right side of a join whose tables grow with the input: never broadcast. Files of sorted or repeated keys are small, and their rows many times larger in the driver's memory."""
    return df.hint("merge")
