"""Incremental ingest as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, folder: str, schema: StructType, kind: str = "json", files: int = 100) -> DataFrame:
    """A stream of the files that arrive in a folder, at most ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(folder)


def first_seen(items: DataFrame, keys: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """Items of a stream once for each key. With ``time`` and ``delay`` a key is forgotten when the watermark has passed it, which bounds the state; without, state grows with the number of keys."""
    if time and delay:
        return items.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return items.dropDuplicates(keys)


def request_states(responses: DataFrame) -> DataFrame:
    """``endpoint``, ``state`` and ``pages`` of each endpoint after each batch that speaks of it (update mode): 'pending' while pages follow, 'visited' for good after a last page.

    ``responses`` has endpoint, order, status and has_next; only status 200 counts, '' and '/' are ignored. The state of an endpoint is two numbers.
    """
    good = responses.where((F.col("status") == 200) & ~F.col("endpoint").isin("", "/"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages, ended = state.get if state.exists else (0, False)
        for b in batches:
            pages += len(b)
            ended = ended or not b["has_next"].all()
        state.update((int(pages), bool(ended)))
        yield pd.DataFrame({"endpoint": [key[0]], "state": ["visited" if ended else "pending"], "pages": [pages]})

    return good.groupBy("endpoint").applyInPandasWithState(step, "endpoint string, state string, pages bigint", "pages bigint, ended boolean", "update", GroupStateTimeout.NoTimeout)


def counts_by_window(events: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    """Events of each key in tumbling windows, final once the watermark has passed; later rows are dropped."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def append(stream: DataFrame, folder: str, checkpoint: str, partition: str | None = None, kind: str = "json") -> StreamingQuery:
    """Write all that is there to files once and stop; a restart goes on where the checkpoint says, each row exactly once."""
    writer = stream.writeStream.format(kind).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(partition) if partition else writer).start()
