"""A queue of start requests that survives a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators.ordering import numbered


class StartQueue:
    """Requests in the order they were put in, as Parquet under ``folder`` (shared by all executors): what was put in once, and what was done since.

    Each entry has ``position``; a request is done by its position, so equal requests are told apart.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _has(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def fill(self, requests: DataFrame, *order: str) -> bool:
        """Put ``requests`` in, first in ``order`` first out. A queue that was filled before is left as it is, and the requests aren't made again: False."""
        if self._has("queued"):
            return False
        numbered(requests, *order, name="position").write.mode("overwrite").parquet(f"{self.folder}/queued")
        return True

    def waiting(self) -> DataFrame:
        """What isn't done yet, with its position."""
        queued = self.spark.read.parquet(f"{self.folder}/queued")
        return queued.join(self.spark.read.parquet(f"{self.folder}/done"), "position", "left_anti") if self._has("done") else queued

    def next(self, n: int) -> DataFrame:
        """The first ``n`` that wait."""
        return self.waiting().orderBy("position").limit(n)

    def done(self, requests: DataFrame) -> None:
        """Note by their position that requests are done; each may be noted again."""
        requests.select(F.col("position").cast("bigint").alias("position")).write.mode("append").parquet(f"{self.folder}/done")
