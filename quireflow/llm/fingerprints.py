"""Substring dedup with a log-structured fingerprint index (operator 10).

Every window of 50 consecutive words has a fingerprint, the least hash of its
10-word runs; equal windows have equal fingerprints, and neighbouring windows
mostly share theirs: a stretch of windows with one fingerprint begins about every
twenty words.  A stretch is known by its fingerprint and the MD5 of its windows'
hashes.  The index keeps, in immutable runs stored as tables bucketed and sorted by
fingerprint, one row for each distinct stretch: the least document that holds it and
its place there.  Rows of a frequent fingerprint are salted over several buckets.

A new batch of documents is turned into stretches, which are merge-joined with every
run and with each other.  A stretch that a smaller document holds is removed as a
whole.  Where a fingerprint has several stretches, which may agree in some windows
only, the windows of one holder of each are compared by a second hash, independent
of the fingerprint (128 bits with it), and a window goes if the least document that
holds it is smaller.  Then the batch's distinct stretches become a run, and too many
runs are compacted into one.  Texts of earlier batches are read again only where a
stretch of theirs shares a fingerprint, but not all windows, with another one.

Batches must come in rising doc_id.  A passage that a third of all documents share
is one row for its middle, and a row for each document where it runs into private
text; nothing gathers a passage's documents in one place.

Defined results: null or empty texts have no words; a null doc_id takes no part
and keeps all words; rows that repeat a doc_id never remove each other's words;
an empty table gives an empty result; extra columns, whatever their names, are
ignored, or passed through by :func:`filter_documents`.  A text may be of any
length; one is held in memory as a whole, with some 50 bytes for each of its words.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.common import cut, cut_lean, drop_path, finish, lean, mark, release, shared_dir, shuffle_width, sliced, small, table, unused
from quireflow.llm.hashing import chunks, mix, runs, sliding_min, word_hashes

WINDOW = 50
RUN = 10
#: More batches than runs, so that runs are compacted and the last batch meets a compacted one.
BATCHES = 4
MAX_RUNS = 2
#: Rows of one fingerprint that go to one bucket of a run.
HOT_ROWS = 2000
#: Bytes of the texts whose words are arrays at once; changes no result.
CHUNK_BYTES = 1 << 18
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A stretch: its fingerprint and digest, a document that holds it, its first window there and how many it has.
KEY = ["fp", "d0", "d1"]
PLACE = ["doc_id", "th", "pos", "n"]
_KINDS = "fp long, d0 long, d1 long, doc_id long, th long, pos int, n int, again boolean"


def windows_of(raws: list[bytes], window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per window of each text: text number, number of its first word, fingerprint, and an independent hash."""
    words = word_hashes(raws, 2)
    n = len(words.doc) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    least = sliding_min(mix(runs(words.hashes[0], run)), window - run + 1)
    at = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    doc = words.doc[at]
    return doc, at - words.bounds[doc], least[at].view(np.int64), mix(runs(words.hashes[1], window, 1))[at].view(np.int64)


def stretches(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """KEY and PLACE of the stretches of the documents (doc_id, text, th) with an id; again: its text has had it before."""

    @lean
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", CHUNK_BYTES):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for part in chunks(((i, h, (t or "").encode()) for i, h, t in rows), lambda r: len(r[2]), CHUNK_BYTES):
                doc, pos, fp, hashes = windows_of([r[2] for r in part], window, run)
                new = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])])) if len(fp) else np.zeros(0, np.int64)
                end = np.append(new[1:], len(fp))
                raw = memoryview(np.ascontiguousarray(hashes)).cast("B")
                digest = b"".join([hashlib.md5(raw[8 * a : 8 * b]).digest() for a, b in zip(new.tolist(), end.tolist(), strict=False)]) if len(new) else b""
                d = np.frombuffer(digest, np.int64).reshape(-1, 2)
                ids, th = (np.array([r[k] for r in part], np.int64)[doc[new]] for k in (0, 1))
                order = np.lexsort((np.arange(len(new)), d[:, 1], d[:, 0], doc[new]))
                same = [x[order][1:] == x[order][:-1] for x in (doc[new], d[:, 0], d[:, 1])]
                again = np.zeros(len(new), bool)
                again[order[1:]] = same[0] & same[1] & same[2]
                columns = [fp[new], d[:, 0].copy(), d[:, 1].copy(), ids, th, pos[new].astype(np.int32), (end[: len(new)] - new).astype(np.int32), again]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*KEY, *PLACE, "again"])

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "th", "text").mapInArrow(of, _KINDS)


def _least(rows: DataFrame, *more: Column) -> DataFrame:
    """One row for each distinct stretch, that of the least place."""
    held = rows.groupBy(*KEY).agg(F.min(F.struct(*PLACE)).alias("least"), *more)
    return held.select(*KEY, *(F.col(f"least.{c}").alias(c) for c in PLACE), *(c for c in held.columns if c not in [*KEY, "least"]))


class FingerprintIndex:
    """Immutable sorted runs of distinct stretches in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, max_runs: int = MAX_RUNS) -> None:
        self.spark, self.max_runs = spark, max_runs
        self.path = path or f"{shared_dir(spark)}/quireflow/index-{uuid.uuid4().hex}"
        self.buckets = shuffle_width(spark)
        self.runs: list[tuple[str, str]] = []  # table name, folder
        self.hot: dict[str, DataFrame] = {}  # by table name: its frequent fingerprints and how many salts each has

    def append(self, rows: DataFrame) -> None:
        """Stores distinct stretches (a stored table) as a run; compacts if there are too many runs."""
        name = f"quireflow_run_{uuid.uuid4().hex}"
        folder = f"{self.path}/{name}"
        many = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT_ROWS)
        # a row that matches nothing keeps the plan the same where no fingerprint is frequent
        none = self.spark.range(1).select(F.lit(None).cast("long").alias("fp"), F.lit(1).alias("salts"))
        self.hot[name] = cut(many.select("fp", F.ceil(F.col("c") / HOT_ROWS).cast("int").alias("salts")).union(none), "lsm-hot")
        salted = rows.select(*KEY, *PLACE).join(small(self.hot[name]), "fp", "left").withColumn("salt", F.coalesce(F.pmod("d0", "salts"), F.lit(0)).cast("int")).drop("salts")
        dealt = salted.repartition(self.buckets, "fp", "salt").sortWithinPartitions("fp", "salt")
        dealt.write.format("parquet").bucketBy(self.buckets, "fp", "salt").sortBy("fp", "salt").option("path", folder).saveAsTable(name)
        self.runs.append((name, folder))
        if len(self.runs) > self.max_runs:
            self.compact()

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name).select(*KEY, *PLACE) for name, _ in self.runs]

    def compact(self) -> None:
        """Merges all runs into one; the old ones go after the new one is written."""
        old = self.runs
        if len(old) < 2:
            return
        merged, self.runs = cut(_least(reduce(DataFrame.union, self.tables())), "lsm-merged"), []
        self.append(merged)
        self._forget(old)

    def met(self, prints: DataFrame) -> list[DataFrame]:
        """Of every run, the rows whose fingerprint is among ``prints`` (fp, each once)."""
        found = []
        for name, _ in self.runs:
            asked = prints.join(small(self.hot[name]), "fp", "left")
            asked = asked.select("fp", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
            found.append(self.spark.table(name).join(asked.hint("merge"), ["fp", "salt"], "left_semi").select(*KEY, *PLACE))
        return found

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, folder in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, folder)
            self.hot.pop(name, None)

    def drop(self) -> None:
        self._forget(self.runs)
        self.runs = []


def _windows(docs: DataFrame, places: DataFrame, window: int, run: int) -> DataFrame:
    """fp, hash (wh), doc_id, th and number (pos) of each window of the stretches at ``places`` (PLACE)."""
    per_doc = cut(places.groupBy("doc_id", "th").agg(F.collect_list("pos").alias("at"), F.collect_list("n").alias("n")), "lsm-places")
    asked = docs.join(small(per_doc), ["doc_id", "th"]).select("doc_id", "th", "text", "at", "n")

    @lean
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", CHUNK_BYTES):
            columns = [batch.column(c) for c in ("doc_id", "th", "text", "at", "n")]
            for i, h, text, at, n in zip(*columns, strict=True):
                _, _, fp, hashes = windows_of([text.as_py().encode()], window, run)
                at, n = at.values.to_numpy(), n.values.to_numpy()
                pos = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                same = np.full(len(pos), i.as_py(), np.int64), np.full(len(pos), h.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (fp[pos], hashes[pos], *same, pos.astype(np.int32))], ["fp", "wh", "doc_id", "th", "pos"])

    return asked.mapInArrow(of, "fp long, wh long, doc_id long, th long, pos int")


def _spans(hits: DataFrame, window: int) -> DataFrame:
    """doc_id, th and the covered word ranges [start, end, start, end, ...]."""
    lists = hits.groupBy("doc_id", "th").agg(F.collect_list("pos").alias("pos"), F.collect_list("n").alias("n"))

    @lean
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pos, n in zip(batch.column("pos"), batch.column("n"), strict=True):
                start = pos.values.to_numpy().astype(np.int64)
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate((start + n.values.to_numpy() - 1 + window)[order])
                new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                last = np.append(new[1:], len(start)) - 1
                out.append(np.stack([start[new], end[last]], axis=1).reshape(-1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "th", "spans"])

    return lists.mapInArrow(of, "doc_id long, th long, spans array<int>")


def add_batch(index: FingerprintIndex, batch: DataFrame, known: DataFrame, since: int | None = None, apart: DataFrame | None = None, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, th and spans to remove from the batch's documents; the batch becomes a run.

    ``known`` holds the documents indexed so far and the batch itself.  Both have
    doc_id, text and ``th`` (a hash of the text); the batch's doc_ids are above
    ``since``, those of the index are not.  ``apart`` names the documents that have
    several texts, if any has.
    """
    begun = mark()
    found = cut_lean(stretches(batch, window, run), "lsm-stretches")
    own = cut(_least(found, F.max("doc_id").alias("last")), "lsm-own")
    prints = own.select("fp").distinct()
    met = reduce(DataFrame.unionByName, (m.withColumn("last", F.col("doc_id")) for m in index.met(prints)), own)
    met = cut(met, "lsm-met")
    # fingerprints of several documents; several: their stretches differ
    shared = met.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("last").alias("z"), F.min("d0").alias("b"), F.max("d0").alias("y"))
    shared = cut(shared.filter("a < z").select("fp", (F.col("b") != F.col("y")).alias("several")), "lsm-shared")
    every = cut(_least(met.join(small(shared), "fp"), F.max("last").alias("last"), F.first("several").alias("several")), "lsm-every")
    first = cut(every.filter("doc_id < last").select(*KEY, F.col("doc_id").alias("first")), "lsm-first")
    whole = found.join(small(first), KEY).filter("doc_id > first").select("doc_id", "th", "pos", "n")
    # windows of stretches that may agree in part, at every place of a document that holds one several times
    twice = found.filter("again")
    if apart is not None:
        twice = twice.union(found.join(small(apart), "doc_id", "left_semi"))
    twice = cut(twice.select(*KEY, *PLACE).distinct(), "lsm-twice")
    differ = every.filter("several")
    places = differ.select(*PLACE).union(differ.select(*KEY, "doc_id").join(small(twice), [*KEY, "doc_id"]).select(*PLACE)).distinct()
    windows = cut_lean(_windows(known, places, window, run), "lsm-windows")
    least = windows.groupBy("fp", "wh").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    least = cut((least if since is None else least.filter(F.col("last") > since)).select("fp", "wh", "first"), "lsm-least")
    fresh = windows if since is None else windows.filter(F.col("doc_id") > since)
    partly = fresh.join(small(least), ["fp", "wh"]).filter("doc_id > first").select("doc_id", "th", "pos", F.lit(1).alias("n"))
    index.append(own)
    spans = cut_lean(_spans(whole.union(partly), window), "lsm-spans")
    release(begun, keep=[spans, *index.hot.values()])
    return spans


def all_spans(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, run: int = RUN, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, th and spans of every document that loses words, batch by batch.

    An ``index`` that is given is empty at first and is kept, for :func:`add_batch` with later documents.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    edges = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    held, found, low = index or FingerprintIndex(spark), [], None
    ids = slim.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("th").alias("a"), F.max("th").alias("z"))
    apart = cut(ids.filter("a < z").select("doc_id"), "lsm-apart")
    for high in [*sorted({int(e) for e in edges or []}), None]:
        upto = slim if high is None else slim.filter(F.col("doc_id") <= high)
        batch = upto if low is None else upto.filter(F.col("doc_id") > low)
        found.append(add_batch(held, batch, upto, low, apart, window, run))
        low = high
    if index is None:
        held.drop()
    return reduce(DataFrame.union, found)


def _with_spans(docs: DataFrame, batches: int) -> tuple[DataFrame, str]:
    """The documents with their spans, and the name of that column."""
    begun = mark()
    spans = finish(all_spans(docs, batches), "lsm-all", begun)
    i, h, out = (unused(docs, name) for name in ("s__id", "s__th", "s__spans"))
    spans = small(spans).withColumnsRenamed({"doc_id": i, "th": h, "spans": out})
    return docs.join(spans, (docs["doc_id"] == spans[i]) & (F.xxhash64(docs["text"]) == spans[h]), "left").drop(i, h), out


def _keep(words: list[str], spans: list[int] | None) -> tuple[list[str], int]:
    if not spans:
        return words, 0
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return kept, len(words) - len(kept)


def digests(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""

    @lean
    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(rows, "text", 4 * CHUNK_BYTES):
            n_words, n_removed, sha = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(held).to_pylist(), strict=True):
                words = _WORD.findall(text or "")
                kept, lost = _keep(words, spans)
                n_words.append(len(words))
                n_removed.append(lost)
                sha.append(hashlib.sha256(" ".join(kept).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    wide, held = _with_spans(docs.select("doc_id", "text"), batches)
    return wide.select("doc_id", "text", held).mapInArrow(of, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def filter_documents(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents without repeated words, with all columns.

    A text that loses words becomes its kept words joined by single spaces; one
    that loses all of them goes; every other text stays as it is.
    """
    names = docs.columns
    schema = docs.schema
    wide, held = _with_spans(docs, batches)
    place = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    @lean
    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(rows, "text", 4 * CHUNK_BYTES):
            spans = batch.column(len(names)).to_pylist()
            columns = [batch.column(i) for i in range(len(names))]
            hit = [i for i, s in enumerate(spans) if s]
            if hit:
                texts = columns[place].to_pylist()
                n_chars = columns[chars].to_pylist() if chars is not None else None
                keep = [True] * len(texts)
                for i in hit:
                    kept, _ = _keep(_WORD.findall(texts[i]), spans[i])
                    texts[i], keep[i] = " ".join(kept), bool(kept)
                    if n_chars is not None:
                        n_chars[i] = len(texts[i])
                columns[place] = pa.array(texts, columns[place].type)
                if n_chars is not None:
                    columns[chars] = pa.array(n_chars, columns[chars].type)
                columns = [c.filter(pa.array(keep)) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names)

    return wide.select(*(F.col(f"`{c}`") for c in names), held).mapInArrow(of, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def oracle() -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT rid, doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS u(i) WHERE doc_id IS NOT NULL),
m AS (SELECT rid, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS f FROM v) WHERE f < doc_id),
c AS (SELECT rid, list(DISTINCT i + j) AS gone FROM m, unnest(range(0, {WINDOW})) AS u(j) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
sha256(coalesce(array_to_string(list_filter(w, lambda x, k: NOT coalesce(list_contains(gone, k), false)), ' '), '')) AS kept_sha256 FROM d LEFT JOIN c USING (rid)"""
