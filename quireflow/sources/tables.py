"""Table scans, and page boxes derived from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_boxes(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """A page for each order and a box for each of its lines.

    ``dealt``: numbered before they are named, so that Spark knows the boxes to be
    dealt by page and does not shuffle them again for what works on pages.
    """
    lines = read(spark, sf_dir, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    if dealt:
        lines, number = lines.withColumn("id", number), F.col("id")
    x0, y0 = F.col("l_quantity"), F.col("l_discount") * 100
    return lines.select(
        F.col("l_orderkey").alias("page"),
        number.alias("id"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 5 + F.col("l_linenumber")).alias("x1"),
        (y0 + 3 + F.col("l_tax") * 100).alias("y1"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("price"),
    )


#: The same boxes for the oracle, as a CTE named ``boxes``.
BOXES_SQL = """boxes AS (SELECT l_orderkey AS page,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS id,
 l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 5 + l_linenumber AS x1, l_discount * 100 + 3 + l_tax * 100 AS y1,
 l_returnflag AS flag, l_linestatus AS status, l_extendedprice AS price FROM lineitem)"""


#: Blocks of pages of 600 by 800 points derived from order lines, in expressions that both engines read.
_BLOCK_FIELDS = [
    ("page", "l_orderkey"),
    ("page_no", "CAST(l_orderkey % 50 AS INT)"),
    ("kind", "CAST(l_partkey % 8 AS INT)"),
    ("text_kind", "CAST((l_partkey - l_partkey % 8) / 8 AS BIGINT) % 7"),
    ("q", "CAST(l_quantity AS INT)"),
    ("line", "l_linenumber"),
    ("x0", "l_quantity * 11"),
    ("y0", "CAST((l_partkey * 7 + l_suppkey * 13 + l_orderkey) % 80 AS DOUBLE) * 10"),
    ("font_size", "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_suppkey % 5 AS DOUBLE) * 9 + l_linenumber * 4 END"),
    ("s0", "CASE WHEN l_linestatus = 'O' THEN l_discount * 4 + 0.5 END"),
    ("f0", "CASE WHEN l_tax > 0.02 THEN l_tax * 5 + 0.5 END"),
    ("id", "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT)"),
]
_BLOCK_MORE = [
    ("tag", "CASE WHEN kind <= 3 THEN 'Text' WHEN kind <= 5 THEN 'Drawing' ELSE 'Image' END"),
    ("x1", "x0 + CASE kind WHEN 4 THEN 4 WHEN 5 THEN 500 WHEN 6 THEN 10 + line WHEN 7 THEN 60 ELSE 14 + line END"),
    ("y1", "y0 + CASE kind WHEN 4 THEN 400 WHEN 5 THEN 4 + line * 4 WHEN 6 THEN 10 WHEN 7 THEN 50 ELSE 12 END"),
    (
        "text",
        "CASE text_kind WHEN 0 THEN CAST(q AS STRING) || 'x' WHEN 1 THEN CAST(page_no AS STRING) WHEN 2 THEN CAST(1000000 + q AS STRING)"
        " WHEN 3 THEN CAST(q % 12 AS STRING) WHEN 4 THEN '1:1' WHEN 5 THEN 'Page ' || CAST(page_no AS STRING) ELSE '00' || CAST(page_no AS STRING) END",
    ),
]
_BLOCK_NAMES = "page, page_no, id, tag, x0, y0, x1, y1, text, font_size, s0, f0, line"
BLOCKS_SQL = (
    f"raw_blocks AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _BLOCK_FIELDS)} FROM lineitem),\n"
    f"blocks AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _BLOCK_MORE)} FROM raw_blocks)"
)


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, drawings and images of pages of 600 by 800 points; colours are arrays of three channels."""
    raw = read(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in _BLOCK_FIELDS))
    blocks = raw.selectExpr("*", *(f"{e} AS {n}" for n, e in _BLOCK_MORE))
    color = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c), F.lit(0.95), F.lit(1.0)))
    return blocks.select(*_BLOCK_NAMES.split(", "), color("s0").alias("stroke"), color("f0").alias("fill"), F.col("line").alias("n_curves"))
