"""Cutting lineage through storage that outlives an executor."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and all runs in one process (tests, notebooks) a local one is made. On a
    cluster, whose executors don't share a disk, it is an error.
    """
    spark = df.sparkSession
    _checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder in the checkpoint folder, for what is written and read again."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def shared_folder(configured: str | None, master: str) -> str:
    """The configured checkpoint folder, or a new local one if there is none and the master is this process."""
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is not set, and a local folder won't do on {master}")
    return tempfile.mkdtemp(prefix="kithgraph-checkpoint-")


def _checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None), context.master))


def tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Number of tasks so that each gets about ``per_task`` rows, and no fewer than the session's shuffle partitions when there is enough to share out."""
    return max(1, min(-(-rows // max(1, per_task)), 100_000))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application; needed where they don't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    whole = Path(tempfile.mkdtemp(prefix="kithgraph-")) / "kithgraph.zip"
    with zipfile.ZipFile(whole, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(whole))
    _shipped.add(context.applicationId)
