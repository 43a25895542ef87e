"""Candidates of labels: the best of a group, conflicts over blocks, what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scored(candidates: DataFrame, least: float, keys: list[str], order: str) -> DataFrame:
    """Candidates that have not failed and reach a score, ranked within the keys: best first, then by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), order))
    return candidates.filter(~F.coalesce(F.col("failed"), F.lit(False)) & (F.col("score") >= least)).withColumn("place", place)


def best(candidates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The best scored candidate of each group, the first on ties."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), order))
    return candidates.withColumn("__place", place).filter("__place = 1").drop("__place")


def rank_of(label: Column, labels: list[str]) -> Column:
    """The place of a label in the order in which labels are built."""
    return F.array_position(F.array(*map(F.lit, labels)), label)


def settle_single(candidates: DataFrame, block: list[str], labels: list[str]) -> DataFrame:
    """Candidates of one block each, with ``failed``: a block goes to the label that is built first."""
    first = F.min(rank_of(F.col("label"), labels)).over(Window.partitionBy(*block))
    return candidates.withColumn("failed", rank_of(F.col("label"), labels) > first)


def conflicts(bridge: DataFrame, built: DataFrame, key: str, block: list[str]) -> DataFrame:
    """The candidates (``key``) that share a block with a built one and are not built themselves."""
    taken = bridge.join(built.select(key), key, "left_semi").select(*block).distinct()
    return bridge.join(taken, block, "left_semi").join(built.select(key), key, "left_anti").select(key).distinct()


def unconsumed(blocks: DataFrame, built: DataFrame, block: list[str]) -> DataFrame:
    return blocks.join(built.select(*block), block, "left_anti")


def repeated(blocks: DataFrame, block: list[str]) -> DataFrame:
    """Block ids that a page has more than once."""
    return blocks.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def strangers(bridge: DataFrame, blocks: DataFrame, block: list[str]) -> DataFrame:
    """Blocks of candidates that their page does not have."""
    return bridge.join(blocks.select(*block), block, "left_anti")


def report(candidates: DataFrame, least: float) -> DataFrame:
    """Per label how many candidates there are, reach a score and are built, the best score, and on how many pages."""
    return candidates.groupBy("label").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("score") >= least).alias("scored"), F.count_if(~F.col("failed")).alias("built"),
        F.max("score").alias("best"), F.count_distinct("page").alias("pages"),
    )


def categories(info: Column, instruction: Column, catalog: Column) -> Column:
    """The sorted categories of a page from what it holds; a page that holds nothing is of the kind ``info``."""
    found = F.array_compact(F.array(F.when(catalog, "catalog"), F.when(info, "info"), F.when(instruction, "instruction")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("info")))
