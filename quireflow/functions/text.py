"""Numbers and marks in short texts, URLs, page ranges, links and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _SPACES, "")


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(strip(text), pattern, group), F.lit("")).cast("int")


def page_number(text: Column) -> Column:
    plain = _number(text, r"^0*(\d{1,3})$")
    return F.coalesce(plain, _number(text, r"^(?i:page|p\.?)\s*0*(\d{1,3})$"))


def step_number(text: Column) -> Column:
    return _number(text, r"^([1-9]\d{0,3})$")


def part_count(text: Column) -> Column:
    return _number(text, r"^(\d{1,3})\s*[xX×]$")


def bag_number(text: Column) -> Column:
    return _number(text, r"^([1-9]\d?)$")


def element_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(strip(text), r"^([1-9]\d{3,7})$", 1), F.lit(""))


def is_scale(text: Column) -> Column:
    return strip(text).rlike(r"^1\s*:\s*1$")


def is_set_id(text: Column) -> Column:
    return text.rlike(r"^[0-9]+$")


def url_file_name(url: Column) -> Column:
    """The decoded last part of the path, null for none."""
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    return F.nullif(F.try_url_decode(F.regexp_extract(path, r"([^/]*)$", 1)), F.lit(""))


def hash_encoded(url: Column) -> Column:
    return F.replace(url, F.lit("#"), F.lit("%23"))


def links(html: Column, pattern: str = r'href="([^"]+)"') -> Column:
    """Distinct matches in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))


def expand_ranges(ranges: Column, last: int) -> Column:
    """Page numbers of [start, end] pairs (null: open), clamped to 1..last, each once, in order."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(1)), F.lit(last))
    pages = F.transform(ranges, lambda r: F.sequence(clamp(F.coalesce(r["start"], F.lit(1))), clamp(F.coalesce(r["end"], F.lit(last)))))
    return F.array_distinct(F.flatten(pages))


def next_data(html: Column) -> Column:
    """The JSON text of a page's state script, null for none."""
    return F.nullif(F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))


def page_range(text: Column) -> Column:
    """A range such as ``5``, ``5-10``, ``10-`` or ``-5`` as (start, end, error); an open end is null, and so is a wrong range."""
    plain = strip(text)
    span = plain.contains("-")
    a = F.when(span, strip(F.substring_index(plain, "-", 1))).otherwise(plain)
    z = F.when(span, strip(F.regexp_replace(plain, r"(?s)^[^-]*-", ""))).otherwise(plain)
    number = lambda c: F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("int"))
    start, end = number(a), number(z)
    wrong = lambda c, n: (c != "") & (n.isNull() | (n < 1))
    error = (
        F.when(plain == "", "empty").when((a == "") & (z == ""), "no page number").when(wrong(a, start), "invalid start").when(wrong(z, end), "invalid end").when(start > end, "start beyond end")
    )
    kept = lambda c: F.when(error.isNull(), c)
    return F.struct(kept(start).alias("start"), kept(end).alias("end"), error.alias("error"))


def page_list(text: Column) -> Column:
    """The ranges of a list such as ``1-3, 7, 10-`` (``all``: everything), for :func:`expand_ranges`; an error if one is wrong."""
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
    found = F.transform(parts, page_range)
    every = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    bad = F.exists(found, lambda r: r["error"].isNotNull()) | (F.size(parts) == 0)
    ranges = F.transform(found, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid page ranges: "), text)).cast("array<struct<start:int,end:int>>")).otherwise(ranges)
    return F.when(strip(text) == "all", every).otherwise(checked)
