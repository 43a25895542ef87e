"""Scans, checks, sinks and embedded state on small files."""

import bz2
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quireflow.functions import state as st
from quireflow.functions import text as tx
from quireflow.operators import candidates as c
from quireflow.sources import files, sinks
from quireflow.streaming import landing


@pytest.fixture
def sets(tmp_path):
    def put(name, text, **pdfs):
        folder = tmp_path / "sets" / name
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text(text)
        for k, v in pdfs.items():
            (folder / f"{k}.pdf").write_bytes(v)

    def described(name, year, pdfs):
        return json.dumps({"set": name, "year": year, "theme": "City", "pdfs": pdfs}, indent=1)

    right = hashlib.sha256(b"abc").hexdigest()
    put("1", described("1", 2020, [{"url": "u", "filename": "a.pdf", "filesize": 3, "filehash": right}]), a=b"abc")
    put("2", described("2", 2020, [{"url": "u", "filename": "a.pdf", "filesize": 4, "filehash": "0"}, {"url": "v"}, {"url": "w", "filename": "b.pdf"}]), a=b"abc", c=b"more")
    put("3", "{not json")
    put("4", described("4", None, []))
    return str(tmp_path / "sets")


def test_metadata_files_are_verified(spark, sets):
    good, bad = files.metadata(spark, f"{sets}/*/metadata.json")
    assert sorted(x["set"] for x in good.collect()) == ["1", "2", "4"] and bad.count() == 1
    assert files.metadata(spark, sets, recursive=True)[0].count() == 3
    stored = files.files(spark, sets, "*.pdf", content=True)
    found = sorted((x.kind, x.folder[-1], x.name) for x in files.verify(good, bad, stored).collect())
    assert found == sorted([("invalid_metadata", "3", None), ("missing_filename", "2", None), ("missing_file", "2", "b.pdf"), ("filesize_mismatch", "2", "a.pdf"), ("hash_mismatch", "2", "a.pdf"), ("orphaned_file", "2", "c.pdf")], key=str) or set(found) == {
        ("invalid_metadata", "3", None), ("missing_filename", "2", None), ("missing_file", "2", "b.pdf"), ("filesize_mismatch", "2", "a.pdf"), ("hash_mismatch", "2", "a.pdf"), ("orphaned_file", "2", "c.pdf"),
    }
    assert sorted((x.year, x.set, x.filename) for x in files.sets_with_files(good, files.files(spark, sets, "*.pdf")).collect()) == [(2020, "1", "a.pdf"), (2020, "2", "a.pdf")]


def test_indexes_and_lists(spark, sets, tmp_path):
    good, _ = files.metadata(spark, f"{sets}/*/metadata.json")
    main = sinks.yearly_index(good.drop("path"), f"{tmp_path}/index").collect()
    assert [(x.year, x["count"], x.filename) for x in main] == [(2020, 2, "year=2020")]
    assert [x["set"] for x in spark.read.json(f"{tmp_path}/index/year=2020").collect()] == ["1", "2"]
    sinks.documents(good.select("set", "year"), f"{tmp_path}/docs", "bzip2")
    assert sorted(x.value for x in spark.read.text(f"{tmp_path}/docs").collect()) == ['{"set":"1","year":2020}', '{"set":"2","year":2020}', '{"set":"4"}']
    sinks.table(good.select("set", "theme", "year"), f"{tmp_path}/csv")
    assert files.csv_list(spark, f"{tmp_path}/csv").count() == 3
    sinks.nowhere(good)
    assert json.loads(sinks.json_schema(good.select("set")))["fields"][0]["name"] == "set"
    (tmp_path / "numbers.txt").write_text("123\n\n x1\n77 \n")
    numbers, wrong = files.set_numbers(spark, f"{tmp_path}/numbers.txt")
    assert sorted(x.number for x in numbers.collect()) == ["123", "77"] and wrong.count() == 1
    assert [x.number for x in sinks.not_found(numbers, numbers.filter("number = '77'"), "number").collect()] == ["123"]


def test_raw_pages_plain_and_compressed(spark, tmp_path):
    box = {"x0": 0.0, "y0": 0.0, "x1": 10.0, "y1": 5.0}
    text = {"__tag__": "Text", "bbox": box, "id": 0, "text": "2x", "font_size": 8.0}
    image = {"__tag__": "Image", "bbox": box, "id": 1, "draw_order": 4, "xref": 0, "digest": "0aff", "original_bbox": {**box, "x1": 20.0}}
    drawing = {"__tag__": "Drawing", "bbox": box, "id": 2, "draw_order": 1, "stroke_color": [1.0, 1.0, 1.0], "items": [["l", [0, 0], [1, 1]]]}
    raw = json.dumps({"pages": [{"page_number": n, "bbox": box, "blocks": [text, image, drawing]} for n in (5, 6)]})
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.json").write_text(raw)
    (tmp_path / "raw" / "two.json.bz2").write_bytes(bz2.compress(raw.encode()))
    pages = files.raw_pages(spark, f"{tmp_path}/raw")
    blocks = files.blocks_of(pages)
    assert pages.count() == 4 and blocks.count() == 12
    got = {x.tag: x for x in blocks.filter("page_number = 5 AND path LIKE '%one.json'").collect()}
    assert got["Text"].draw_order == 1_000_000 and got["Image"].xref is None and bytes(got["Image"].digest) == b"\x0a\xff"
    assert got["Image"].clipped and got["Image"].unclipped.x1 == 20 and not got["Text"].clipped and got["Drawing"].stroke == [1, 1, 1]
    sinks.pages(pages, f"{tmp_path}/pages", "bzip2")
    assert spark.read.json(f"{tmp_path}/pages").select("page_number").distinct().count() == 2


def test_embedded_state(spark):
    held = {
        "ROOT": {"x": 1},
        "B": {"__typename": "CS_BuildingInstructionData", "name": "Boat", "theme": {"type": "id", "id": "T"}, "setPieceCount": "120", "year": "20x0", "ageRating": "8+", "setImage": {"id": "I"},
              "buildingInstructions": [{"type": "id", "id": "P1"}, {"type": "id", "id": "lost"}, {"type": "id", "id": "P2"}]},
        "T": {"themeName": "City"}, "I": {"src": "/img/a#1.png"},
        "P1": {"sequence": {"type": "id", "id": "S"}, "pdf": {"type": "id", "id": "F"}, "isAdditionalInfoBooklet": False},
        "S": {"element": "1", "total": 2}, "F": {"pdfUrl": "https://x.org/f.pdf", "coverImage": {"type": "id", "id": "I"}},
        "P2": {"pdf": {"type": "id", "id": "loop"}}, "loop": {"type": "id", "id": "loop"},
    }
    page = '<html><script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"__APOLLO_STATE__": held}}}) + "</script></html>"
    rows = spark.createDataFrame([(1, page), (2, "<p>https://y.org/b.pdf https://y.org/a.pdf https://y.org/b.pdf</p>")], "n int, html string").withColumn("held", st.state(F.col("html")))
    base = F.lit("https://www.example.org/en/")
    got = {x.n: x for x in rows.select("n", st.set_metadata(F.col("held"), base).alias("m"), st.file_list(F.col("held"), base).alias("f"), st.files_or_links(F.col("held"), F.col("html"), base, r"https://y\.org/\w+\.pdf").alias("u")).collect()}
    assert tuple(got[1].m) == ("Boat", "City", "8+", 120, None, "https://www.example.org/img/a%231.png")
    assert [tuple(x) for x in got[1].f] == [("https://x.org/f.pdf", 1, 2, "https://www.example.org/img/a%231.png", False)]
    assert got[1].u == ["https://x.org/f.pdf"] and got[2].m is None and got[2].u == ["https://y.org/b.pdf", "https://y.org/a.pdf"]


def test_page_lists(spark):
    rows = spark.createDataFrame([(1, "1-3, 7, 2, 30-"), (2, " all ")], "n int, t string")
    got = {x.n: x.p for x in rows.select("n", tx.expand_ranges(tx.page_list(F.col("t")), 9).alias("p")).collect()}
    assert got == {1: [1, 2, 3, 7, 9], 2: list(range(1, 10))}
    for wrong in ("", "3-1", "a", "0", "-", "1,,x"):
        with pytest.raises(Exception, match="invalid page ranges"):
            spark.createDataFrame([(wrong,)], "t string").select(tx.page_list(F.col("t"))).collect()


def test_conflicts_over_shared_blocks(spark):
    bridge = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3), ("d", 9)], "cand string, id int")
    blocks = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id int")
    built = bridge.filter("cand = 'a'").select("cand", "id")
    assert [x.cand for x in c.conflicts(bridge, built.select("cand").distinct(), "cand", ["id"]).collect()] == ["b"]
    assert [x.id for x in c.unconsumed(blocks, built, ["id"]).collect()] == [3, 3]
    assert [tuple(x) for x in c.repeated(blocks, ["id"]).collect()] == [(3, 2)]
    assert [x.cand for x in c.strangers(bridge, blocks, ["id"]).collect()] == ["d"]
    some = spark.createDataFrame([(1, "x", 0.9, False), (2, "x", 0.9, True), (3, "x", 0.4, None), (4, "y", 0.2, None)], "id int, label string, score double, failed boolean")
    assert [(x.id, x.place) for x in c.scored(some, 0.4, ["label"], "id").orderBy("id").collect()] == [(1, 1), (3, 2)]
    assert sorted(x.id for x in c.best(some, ["label"], "id").collect()) == [1, 4]
    kinds = spark.createDataFrame([(True, True, False), (False, False, False)], "i boolean, s boolean, k boolean")
    assert [x[0] for x in kinds.select(c.categories(F.col("i"), F.col("s"), F.col("k"))).collect()] == [["info", "instruction"], ["info"]]


def test_landing_files_once(spark, sets, tmp_path):
    for _ in range(2):
        landing.drain(landing.landed(spark, f"{sets}/*/metadata.json"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert sorted(x["set"] for x in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "2", "4"]
