"""Windows over numbered rows: gaps, islands, jumps, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds ``before``: the value of the previous row of the key."""
    return df.withColumn("before", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def gaps(df: DataFrame, key: str, number: str) -> DataFrame:
    """The numbers between a key's least and greatest that it lacks."""
    have = df.select(key, number).distinct()
    ends = have.groupBy(key).agg(F.min(number).alias("a"), F.max(number).alias("z"))
    return ends.select(key, F.explode(F.sequence("a", "z")).alias(number)).join(have, [key, number], "left_anti")


def islands(df: DataFrame, key: str, number: str) -> DataFrame:
    """A key's numbers as text, runs joined: ``1-3, 5``; beyond 100 characters the first 97 and ``...``."""
    have = df.select(key, number).distinct()
    run = F.col(number) - F.row_number().over(Window.partitionBy(key).orderBy(number))
    parts = have.withColumn("run", run).groupBy(key, "run").agg(F.min(number).alias("a"), F.max(number).alias("z"))
    shown = F.when(F.col("a") == F.col("z"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "z"))
    lists = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("a", shown.alias("t")))).alias("l"))
    whole = F.array_join(F.transform("l", lambda x: x["t"]), ", ")
    return lists.select(key, F.when(F.length(whole) > 100, F.concat(F.substring(whole, 1, 97), F.lit("..."))).otherwise(whole).alias("ranges"))


def largest_gap(df: DataFrame, key: str, number: str, least: int, max_start: int | None = None) -> DataFrame:
    """The rows above a key's largest gap (first on ties) if that exceeds ``least``, else all; repeats are kept.

    With ``max_start`` only keys whose least number is at most that lose rows.
    """
    by, over = Window.partitionBy(key).orderBy(number), Window.partitionBy(key)
    stepped = df.withColumn("gap", F.col(number) - F.lag(number).over(by))
    cut = F.max(F.when(F.col("gap") > least, F.struct(F.col("gap"), (-F.col(number)).alias("n")))).over(over)
    stepped = stepped.withColumn("cut", -cut["n"])
    stays = F.col("cut").isNull() | (F.col(number) >= F.col("cut"))
    if max_start is not None:
        stepped = stepped.withColumn("start", F.min(number).over(over))
        stays |= F.col("start") > max_start
    return stepped.filter(stays).select(*df.columns)


def runs_from_one(df: DataFrame, key: str, number: str) -> DataFrame:
    """Rows whose number continues 1, 2, 3, ... within the key; repeats are kept."""
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(number))
    return df.withColumn("rank", rank).filter(F.col("rank") == F.col(number)).drop("rank")
