"""JSON-lines items: reading with arrival order, merging, appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.sources.schemas import ITEMS


def read_items(spark: SparkSession, folder: str, item: str, where: Column | None = None) -> DataFrame:
    """The items of ``folder/<item>.jsonl`` (a file or a folder) under the item's schema, with ``line_no`` in arrival order.

    Lines that are no JSON come as rows of nulls. line_no grows with the place in the file; across files and splits it follows the scan's order.
    """
    rows = spark.read.schema(ITEMS[item]).json(f"{folder}/{item}.jsonl").withColumn("line_no", F.monotonically_increasing_id())
    return rows if where is None else rows.where(where)


def append_items(items: DataFrame, folder: str, item: str) -> None:
    """Append items to ``folder/<item>.jsonl``, only their declared fields, in UTF-8, one JSON document a line."""
    items.select(*[f for f in ITEMS[item].fieldNames() if f in items.columns]).write.mode("append").json(f"{folder}/{item}.jsonl")


def merge_entities(rows: DataFrame, key: str, rank: Column) -> DataFrame:
    """One row for each ``key``: of each other column the last value that isn't null, in the order of ``rank``. Null keys are dropped.

    A null that was written down and a field that was absent can't be told apart under a fixed schema; both leave the older value.
    """
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest])


#: Kinds of items that an entity is merged from.
MODES = ("both", "full", "summary")


def entity_rows(rows: DataFrame, summary: str, mode: str = "both", item: str = "item", order: str = "line_no") -> DataFrame:
    """Rows of full and ``summary`` items to those of one ``mode``, with ``rank``: summaries come after full items, each in their order."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    kept = rows if mode == "both" else rows.where((F.col(item) == summary) == (mode == "summary"))
    return kept.withColumn("rank", F.struct(F.col(item) == summary, F.col(order)))


def merge_documents(lines: DataFrame, text: str, rank: Column, key: str = "id") -> DataFrame:
    """JSON documents to one for each ``key``, field by field, the last in the order of ``rank`` that has the field, an explicit null too: ``key`` (bigint) and ``fields`` (map from name to text).

    Lines that are null or no JSON object, and those whose key is null or no whole number, are dropped. A document has few fields, so they are put together by key.
    """
    each = lines.select(F.from_json(F.col(text), "map<string,string>").alias("__d"), rank.alias("__r"))
    each = each.select(F.try_element_at("__d", F.lit(key)).try_cast("bigint").alias(key), F.explode("__d").alias("__k", "__v"), "__r").where(F.col(key).isNotNull())
    last = each.groupBy(key, "__k").agg(F.max_by(F.struct("__v"), "__r").alias("__v"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__k", F.col("__v.__v")))).alias("fields"))


def last_rows(rows: DataFrame, key: Column, rank: Column, **values: Column) -> DataFrame:
    """``key`` and the given values of its last row in the order of ``rank``, nulls included."""
    return rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.max_by(F.struct(*[v.alias(n) for n, v in values.items()]), rank).alias("__v")).select("key", "__v.*")
