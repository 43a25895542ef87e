"""Set metadata and file lists from the state that a page embeds as JSON.

The state is a map from keys to JSON texts; values refer to others by
``{"type": "id", "id": key}``.  References are followed a bounded number of times,
which also ends cycles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow.functions import text as tx

HOPS = 4


def _get(json: Column, *path: str) -> Column:
    return F.get_json_object(json, "$." + ".".join(path))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def state(html: Column) -> Column:
    """The embedded state as a map of JSON texts, null for none."""
    return F.from_json(_get(tx.next_data(html), "props", "pageProps", "__APOLLO_STATE__"), "map<string,string>")


def resolve(held: Column, value: Column) -> Column:
    """Follows references from a JSON value; one that leads nowhere stays as it is."""

    def follow(v: Column) -> Column:
        return F.coalesce(F.when(F.coalesce(_get(v, "type"), F.lit("id")) == "id", F.try_element_at(held, F.coalesce(_get(v, "id"), F.lit("")))), v)

    for _ in range(HOPS):
        value = _bind(value, follow)
    return value


def instruction_data(held: Column) -> Column:
    """The first value of the kind that describes a set, as JSON."""
    return F.get(F.filter(F.map_values(held), lambda v: F.coalesce(_get(v, "__typename") == "CS_BuildingInstructionData", F.lit(False))), F.lit(0))


def absolute(url: Column, base: Column) -> Column:
    """A relative address completed by the base's scheme and host; ``#`` is encoded."""
    root, scheme = F.regexp_extract(base, r"^([^:]+://[^/?#]+)", 1), F.regexp_extract(base, r"^([^:]+:)", 1)

    def complete(safe: Column) -> Column:
        beside = F.concat(F.regexp_replace(base, r"[^/]*$", ""), safe)
        return F.when(safe.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), safe).when(safe.startswith("//"), F.concat(scheme, safe)).when(safe.startswith("/"), F.concat(root, safe)).otherwise(beside)

    return _bind(tx.hash_encoded(url), lambda safe: F.when(safe.isNotNull(), complete(safe)))


def set_metadata(held: Column, base: Column) -> Column:
    """Name, theme, age, pieces, year and picture of the set; null without a name."""

    def described(data: Column) -> Column:
        at = lambda *path: F.try_element_at(held, F.coalesce(_get(data, *path), F.lit("")))
        found = F.struct(
            _get(data, "name").alias("name"), _get(at("theme", "id"), "themeName").alias("theme"), _get(data, "ageRating").alias("age"), _get(data, "setPieceCount").try_cast("int").alias("pieces"),
            _get(data, "year").try_cast("int").alias("year"), absolute(_get(at("setImage", "id"), "src"), base).alias("set_image_url"),
        )
        return F.when(F.coalesce(_get(data, "name"), F.lit("")) != "", found)

    return _bind(instruction_data(held), described)


def file_list(held: Column, base: Column) -> Column:
    """The set's files in order; entries without a file or address are left out."""
    items = F.from_json(_get(instruction_data(held), "buildingInstructions"), "array<string>")

    def filed(item: Column, place: Column, pdf: Column) -> Column:
        cover = resolve(held, _get(pdf, "coverImage"))
        return F.struct(
            absolute(_get(pdf, "pdfUrl"), base).alias("url"), _get(place, "element").try_cast("int").alias("sequence_number"), _get(place, "total").try_cast("int").alias("sequence_total"),
            absolute(_get(cover, "src"), base).alias("preview_url"), _get(item, "isAdditionalInfoBooklet").try_cast("boolean").alias("is_additional_info_booklet"),
        )

    def entry(ref: Column) -> Column:
        return _bind(resolve(held, ref), lambda item: _bind(resolve(held, _get(item, "sequence")), lambda place: _bind(resolve(held, _get(item, "pdf")), lambda pdf: filed(item, place, pdf))))

    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), entry), lambda e: e["url"].isNotNull())


def files_or_links(held: Column, html: Column, base: Column, pattern: str) -> Column:
    """The listed addresses, or where there are none those that the page's text holds, each once in order."""
    listed = F.transform(file_list(held, base), lambda e: e["url"])
    return F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, listed).otherwise(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))))
