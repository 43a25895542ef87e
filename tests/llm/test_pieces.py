"""The distinct-chunk table against the library on whole tables, long texts and empty ones."""

import hashlib

import pyarrow as pa
import pytest
import sentencepiece

from quireflow.llm import pieces
from quireflow.llm.common import sliced

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))


def test_whole_table_equals_the_library(spark, library):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = pieces.query(spark, SF).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == expected(library, texts[x.doc_id])


def test_long_texts_and_odd_rows(spark, library):
    rows = [(1, "wort für wort, " * 200_000), (2, "z" * 100_000), (3, "a \n" * 300_000), (None, "no id"), (4, None), (5, ""), (5, ""), (6, "▁\n▁ \n\n "), (7, "🙂\x00 \x85 x" * 50)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in pieces.digests(frame).collect()), key=str)
    assert got == sorted(((i, *expected(library, t)) for i, t in rows), key=str)
    assert pieces.digests(frame.limit(0)).count() == 0 and pieces.encode(frame.limit(0)).count() == 0


def test_ids_and_texts(spark, library):
    rows = [(1, "Zwei Wörter\nund mehr"), (2, None), (3, "a  b ▁c"), (4, "\n")]
    for x in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        ids = library.encode(dict(rows)[x.doc_id] or "", add_eos=True)
        assert (x.ids, x.decoded) == (ids, library.decode(ids))


def test_a_distinct_chunk_is_segmented_once(monkeypatch):
    held = pieces.ChunkTable(pieces.default_model())
    given, encode = [], held.library.encode
    monkeypatch.setattr(held, "library", type("L", (), {"encode": lambda self, text, **k: (given.append(text), encode(text, **k))[1], "decode": held.library.decode})())
    held.written(pa.array(["the cat and the dog", "and the cat\nand the dog"]))
    assert sorted("".join(given).split("\n")) == ["", " and", " cat", " dog", " the", "and"]


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 30, 2, 2)] + [None])], ["text"])
    parts = list(sliced([batch, batch.slice(0, 0)], "text", 8))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist() and len(parts) == 2
