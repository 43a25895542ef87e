"""Indexes, manuals and raw pages as files. Spark's committer renames what is complete."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def yearly_index(sets: DataFrame, target: str) -> DataFrame:
    """A folder of JSON lines for each year, sets in the order of their names; gives the main index: year, count, size."""
    dated = sets.filter(F.coalesce("year", F.lit(0)) != 0)
    sorted_ = dated.repartition("year").sortWithinPartitions("year", "set")
    sorted_.write.mode("overwrite").partitionBy("year").option("ignoreNullFields", True).json(target)
    size = F.length(F.to_json(F.struct(*(c for c in dated.columns if c != "year"))))
    return dated.groupBy("year").agg(F.count(F.lit(1)).alias("count"), F.sum(size + 1).alias("filesize"), F.concat(F.lit("year="), F.col("year").cast("string")).alias("filename"))


def documents(rows: DataFrame, target: str, compression: str = "none") -> None:
    """Each row as one line of JSON without null fields (manuals, candidates, raw documents)."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").option("compression", compression).text(target)


def pages(rows: DataFrame, target: str, compression: str = "none") -> None:
    """Raw pages in a folder for each page number."""
    rows.write.mode("overwrite").partitionBy("page_number").option("compression", compression).json(target)


def table(rows: DataFrame, target: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(target)


def nowhere(rows: DataFrame) -> None:
    """Runs the plan and keeps nothing."""
    rows.write.format("noop").mode("overwrite").save()


def json_schema(rows: DataFrame) -> str:
    """The schema of the rows as JSON, with keys in order."""
    return json.dumps(json.loads(rows.schema.json()), indent=2, sort_keys=True)


def not_found(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is still to be fetched: keys without a marker of an earlier failure."""
    return asked.join(known.select(key), key, "left_anti")
