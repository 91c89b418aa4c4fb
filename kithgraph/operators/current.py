"""The value of each field that holds for an id whose rows disagree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.text import has_text


def current_values(df: DataFrame, key: Column, fields: Mapping[str, Column], updated: Column, full: Column, line: Column, values: bool = True) -> DataFrame:
    """For each id, the current value of each field and the line that gives it.

    Of the rows of an id (null ids are left out) in which a field isn't missing, the one with the latest ``updated`` (null is
    oldest) gives the field; then one where ``full`` is true; then the greatest ``line``. A field is missing if it is null or a
    string of white space only. Result: ``id``, ``n_rows``, and for each field ``<field>`` (if ``values``) and
    ``<field>__line``, null where every row lacks it. Repeated rows count in n_rows but can't change a value; rows that tie
    in everything are decided by the greater value. It is one aggregate by id that combines on the map side, so an id with
    very many rows is no group in one task.
    """
    types = dict(df.select(*[c.alias(f) for f, c in fields.items()]).dtypes)
    best = []
    for name, value in fields.items():
        there = has_text(value) if types[name] == "string" else value.isNotNull()
        rank = [updated.alias("updated"), F.coalesce(full, F.lit(False)).alias("full"), line.alias("line"), *([value.alias("value")] if values else [])]
        best.append(F.max(F.when(there, F.struct(*rank))).alias(f"__{name}"))
    one = df.where(key.isNotNull()).groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n_rows"), *best)
    out = ["id", "n_rows"]
    for name in fields:
        out += [F.col(f"__{name}.value").alias(name)] if values else []
        out.append(F.col(f"__{name}.line").alias(f"{name}__line"))
    return one.select(*out)
