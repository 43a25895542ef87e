"""Scans of metadata, raw pages, stored files and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed formats of the files.
PDFS = "array<struct<url:string,sequence_number:int,sequence_total:int,filename:string,preview_url:string,filesize:bigint,filehash:string,is_additional_info_booklet:boolean>>"
METADATA = f"set string, locale string, name string, theme string, age string, pieces int, year int, set_image_url string, pdfs {PDFS}"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK = (
    f"struct<__tag__:string,bbox:{BOX},id:int,draw_order:int,text:string,font_name:string,font_size:double,font_flags:int,color:int,ascender:double,descender:double,origin:array<double>,"
    "image_id:string,width:int,height:int,ext:string,colorspace:int,xres:int,yres:int,bpc:int,size:int,transform:array<double>,xref:int,smask:int,digest:string,"
    f"fill_color:array<double>,stroke_color:array<double>,line_width:double,fill_opacity:double,stroke_opacity:double,path_type:string,dashes:string,even_odd:boolean,items:string,original_bbox:{BOX}>"
)
PAGES = f"pages array<struct<page_number:int,bbox:{BOX},blocks:array<{BLOCK}>>>"


def metadata(spark: SparkSession, path: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Metadata files: those that parse, and the paths of those that do not (a set is required)."""
    reader = spark.read.schema(f"{METADATA}, broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "broken")
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json")
    found = reader.json(path).withColumn("path", F.col("_metadata.file_path"))
    bad = F.col("broken").isNotNull() | F.col("set").isNull()
    return found.filter(~bad).drop("broken"), found.filter(bad).select("path", "broken")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of raw page files, plain or compressed (.gz, .bz2 by suffix): path, page number, box, blocks."""
    found = spark.read.schema(PAGES).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    return found.select("path", F.explode("pages").alias("p")).select("path", "p.page_number", "p.bbox", "p.blocks")


def blocks_of(pages: DataFrame) -> DataFrame:
    """One row for each block of raw pages; texts without a place in the drawing order come last."""
    wide = pages.select("path", "page_number", F.col("bbox").alias("page_bbox"), F.explode("blocks").alias("b")).select("path", "page_number", "page_bbox", "b.*")
    order = F.coalesce("draw_order", F.when(F.col("tag") == "Text", 1_000_000))
    fields = wide.withColumnsRenamed({"__tag__": "tag", "fill_color": "fill", "stroke_color": "stroke"}).withColumn("draw_order", order)
    inner = fields.select("*", *(F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))
    box = F.coalesce("original_bbox", "bbox")
    return inner.withColumns({"unclipped": box, "clipped": ~F.coalesce("original_bbox", "bbox").eqNullSafe(F.col("bbox")), "digest": F.unhex("digest"), "xref": F.nullif("xref", F.lit(0))})


def files(spark: SparkSession, path: str, pattern: str, content: bool = False) -> DataFrame:
    """Stored files below a folder: path, folder, name, size and time, with the SHA-256 if asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    shown = [F.col("path"), F.substring_index("path", "/", -2).alias("place"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("changed")]
    return found.select(*shown, *([F.sha2("content", 256).alias("hash")] if content else []))


def set_numbers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines of a list: those of digits alone, and the others that are not empty."""
    lines = spark.read.text(path).select(F.trim("value").alias("number")).filter("number <> ''")
    good = F.col("number").rlike("^[0-9]+$")
    return lines.filter(good), lines.filter(~good)


def csv_list(spark: SparkSession, path: str) -> DataFrame:
    """The first three columns of a CSV list with a header; carriage returns go."""
    found = spark.read.option("header", True).csv(path)
    return found.select(*(F.regexp_replace(F.col(f"`{c}`"), "\r", "").alias(c.strip()) for c in found.columns[:3]))


def sets_with_files(sets: DataFrame, stored: DataFrame) -> DataFrame:
    """Sets that have a year, a theme and a first file that is stored beside their metadata."""
    first = F.get("pdfs", F.lit(0))["filename"]
    some = sets.filter(F.col("year").isNotNull() & F.col("theme").isNotNull()).select("year", "theme", "set", first.alias("filename"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"))
    met = some.join(stored.select("folder", F.col("name").alias("filename"), F.col("path").alias("file")), ["folder", "filename"])
    return met.select("year", "theme", "set", "filename", F.col("file").alias("path"))


def verify(good: DataFrame, bad: DataFrame, stored: DataFrame) -> DataFrame:
    """Errors of stored files against their metadata: kind, folder, file.

    ``stored`` has size and hash.  Kinds: invalid_metadata, missing_filename, missing_file,
    filesize_mismatch, hash_mismatch, orphaned_file; size and hash may both be wrong.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    claimed = good.select(folder.alias("folder"), F.explode("pdfs").alias("p")).select("folder", F.nullif(F.col("p.filename"), F.lit("")).alias("name"), "p.filesize", "p.filehash")
    named = claimed.filter("name IS NOT NULL")
    known = good.select(folder.alias("folder")).distinct()
    both = named.withColumn("claimed", F.lit(True)).join(stored.join(known, "folder", "left_semi").select("folder", "name", "size", "hash"), ["folder", "name"], "full_outer")
    issue = lambda when, kind: F.when(when, F.lit(kind))
    there, claim = F.col("size").isNotNull(), F.col("claimed").isNotNull()
    kinds = F.array_compact(
        F.array(issue(claim & ~there, "missing_file"), issue(there & ~claim, "orphaned_file"), issue(claim & there & (F.col("filesize") != F.col("size")), "filesize_mismatch"), issue(claim & there & (F.col("filehash") != F.col("hash")), "hash_mismatch"))
    )
    found = both.select(F.explode(kinds).alias("kind"), "folder", "name")
    unnamed = claimed.filter("name IS NULL").select(F.lit("missing_filename").alias("kind"), "folder", "name")
    return found.union(unnamed).union(bad.select(F.lit("invalid_metadata").alias("kind"), folder.alias("folder"), F.lit(None).cast("string").alias("name")))


def fresh(changed: Column, now: Column, most: Column) -> Column:
    """Whether a stored copy is young enough to be kept."""
    return now - changed <= most
