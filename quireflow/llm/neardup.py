"""Near-duplicate classes by BagMinHash (operator 4).

A text is the multiset of its five-word shingles (a shorter one that has words
is a single shingle).  The weight axis is discretised at the whole numbers and
cut into (0, 1], (1, 2], (2, 4], (4, 8], ...; each shingle runs a hierarchy of
Poisson processes over every interval that begins below its count.  A process
over more than one whole number is split in halves at its first point: the half
that holds the point, by a fair coin, inherits it, the other one goes on from
there by its own generator, and halves beyond the shingle's count are dropped.
Points of single whole numbers carry a register; the least point of each register
is the signature, and two texts agree on a register with the probability of their
weighted Jaccard similarity.  Processes emit points in rising order and stop
beyond the largest register, so few points are made per shingle.

Bands of the signature propose candidates, exact multiset overlap decides
(5 * sum of minima >= 4 * sum of maxima for 0.8), and classes are the components
of the graph of all similar pairs.  No bucket emits all its pairs: every member
is compared with its bucket's first member, then with the member that shares most
buckets, and only members that are in several classes after that are compared
further: small buckets pair by pair, large ones through their rare shingles.  Two
similar texts share one of the fifth of their shingles that fewest of the texts
in question hold, so a large bucket falls into the buckets of those shingles;
such a bucket that is large again is compared exactly in blocks.

Texts are moved for a comparison, not their shingles: a text, compressed, is
smaller than eight bytes for each of its words.

Result: one row per document with its class (the smallest doc_id of the class).
Defined cases: equal texts are one class; a text without words is linked only to
equal texts that have words, i.e. stays alone; a null doc_id takes no part and
has a null class; rows that repeat a doc_id are one document, linked if any of
its texts is; ties of heads go to the smaller id; an empty table gives an empty
result; extra columns, whatever their names, are ignored, or passed through by
:func:`filter_documents`.  Texts may be of any length: one is held in memory as a
whole, with eight bytes for each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireflow.llm.common import cut, cut_lean, finish, lean, mark, sliced, small, table, unused
from quireflow.llm.hashing import U, chunks, gold, mix, runs, word_hashes

SHINGLE = 5
THRESHOLD = (4, 5)  # as a fraction
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
STAR_ROUNDS = 2
#: Members up to which a bucket's pairs are compared singly; changes no result.
SMALL_BUCKET = 48
#: Members, and bytes of shingles, of a block of a large bucket; change no result.
BLOCK, BLOCK_BYTES = 512, 2 << 20
#: Bytes of the texts whose words are arrays at once; changes no result.
CHUNK_BYTES = 1 << 19
_GOLD = gold(1)


def shingles(raws: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multisets of all texts: text number, shingle hash, count; sorted by text."""
    words = word_hashes(raws)
    h, bounds = words.hashes[0], words.bounds
    docs, found = [], []
    if len(h) >= size:
        inside = words.doc[: len(h) - size + 1] == words.doc[size - 1 :]
        docs.append(words.doc[: len(h) - size + 1][inside])
        found.append(mix(runs(h, size))[inside])
    count = np.diff(bounds)
    for n in range(1, size):
        some = np.flatnonzero(count == n)
        if len(some):
            at = bounds[some]
            value = np.full(len(some), U(n))
            for j in range(n):
                value = mix(value * _GOLD + h[at + j])
            docs.append(some)
            found.append(value)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    doc, value = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]))
    return doc[new], value[new], np.diff(np.concatenate([new, [len(doc)]]))


#: Told to the two halves of a split process.
_HALVES = np.array([0xA5A5F1E2D3C4B597, 0x5A5A0E1D2C3B4A69], np.uint64)


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The least point of every register (n_docs x registers); infinite without shingles."""
    least = np.full((n_docs, registers), np.inf)
    flat = least.reshape(-1)
    # a process for each interval (0, 1], (1, 2], (2, 4], ... that begins below the weight
    parts, low, step = [], 0, 0
    while len(some := np.flatnonzero(weight > low)):
        span = max(low, 1)
        parts.append((doc[some], mix(value[some] + gold(step)), np.full(len(some), low), np.full(len(some), span), weight[some]))
        low, step = low + span, step + 1
    if not parts:
        return least
    d, seed, low, span, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(d, kind="stable")
    d, seed, low, span, w = d[order], seed[order], low[order], span[order], w[order]
    x, given = np.zeros(len(d)), None  # given: processes that hold a point already
    worst = np.full(n_docs, np.inf)
    while len(d):
        drawn = mix(seed + _GOLD)
        ahead = x - np.log(((drawn >> U(11)).astype(np.float64) + 0.5) / 2**53) / span
        seed, x = (drawn, ahead) if given is None else (np.where(given, seed, drawn), np.where(given, x, ahead))
        alive = x < worst[d]
        d, seed, low, span, w, x = d[alive], seed[alive], low[alive], span[alive], w[alive], x[alive]
        coin, one = mix(seed ^ _GOLD), span == 1
        register = ((coin & U(0xFFFFFFFF)) * U(registers) >> U(32)).astype(np.int64)
        given = None
        if one.all():
            np.minimum.at(flat, d * registers + register, x)
        else:
            np.minimum.at(flat, d[one] * registers + register[one], x[one])
            # the rest are split: the half with the point keeps it, the other half goes on from there
            half, side = span[~one] // 2, (coin[~one] >> U(63)).astype(np.int64)
            rest = [(d[one], seed[one], low[one], span[one], w[one], x[one], np.zeros(int(one.sum()), bool))]
            for way, holds in ((side, True), (1 - side, False)):
                begin = low[~one] + way * half
                some = begin < w[~one]
                rest.append(tuple(c[some] for c in (d[~one], mix(seed[~one] ^ _HALVES[way]), begin, half, w[~one], x[~one], np.full(len(half), holds))))
            d, seed, low, span, w, x, given = (np.concatenate(c) for c in zip(*rest, strict=True))
        active = np.flatnonzero(np.bincount(d, minlength=n_docs))
        worst[active] = least[active].max(axis=1)
    return least


def band_hashes(least: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = least.view(U).reshape(len(least), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=U) * _GOLD, (len(least), 1))
    for r in range(rows):
        out = mix(out ^ parts[:, :, r])
    return out.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, band hashes (none without words).

    A text without words is alone, so its digest is that of its doc_id (no text has the byte 0xFF).
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", CHUNK_BYTES):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for part in chunks(((i, (t or "").encode()) for i, t in rows), lambda r: len(r[1]), CHUNK_BYTES):
                raws = [r[1] for r in part]
                doc, value, weight = shingles(raws)
                least = signatures(doc, value, weight, len(raws))
                hashes, some = band_hashes(least), np.isfinite(least[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.int64()),
                        pa.array([hashlib.md5(x if some[i] else b"\xff%d" % r[0]).digest() for i, (r, x) in enumerate(zip(part, raws, strict=True))], pa.binary()),
                        pa.array([hashes[i] if some[i] else [] for i in range(len(raws))], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "key", "bands"],
                )

    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key binary, bands array<long>")


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two multisets (sorted values, counts) reach the threshold."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return THRESHOLD[1] * both >= THRESHOLD[0] * (total - both)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the documents in question."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(ids), "id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar; ``pairs`` is a stored table."""
    texts = cut(_texts(docs, cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-ids")), "near-texts")
    # a is the text that many are compared with: it comes last and is not moved with its pairs
    both = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a")

    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        _, value, weight = shingles([(text or "").encode()])
        return value, weight

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = None, None
        for batch in sliced(batches, "ta tb", 4 * CHUNK_BYTES):
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            kept = []
            for i, (x, left, right) in enumerate(zip(a, ta, tb, strict=True)):
                if (x, left) != last_id:
                    last_id, last = (x, left), bag(left)
                other = bag(right)
                if len(last[0]) and len(other[0]) and similar(last, other):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and label (the least id of its component) of every id in ``edges`` (a, b).

    Least labels travel along the links and are then followed to their own
    labels, so the rounds grow with the logarithm of a chain's length.
    """
    links = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "cc-links")
    labels = cut(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "cc-labels")
    while True:
        seen = links.join(labels, links["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(seen, labels["id"] == seen["a"]).select("id", "label", F.least("label", "m").alias("next"))
        step = near.select("id", "label", "next")
        up = labels.select(F.col("id").alias("u"), F.col("label").alias("ul"))
        moved = cut(step.join(up, step["next"] == up["u"], "left").select("id", F.col("label").alias("was"), F.least("next", "ul").alias("label")), "cc-labels")
        labels = moved.select("id", "label")
        if moved.filter("was <> label").isEmpty():
            return labels


def _still_apart(slots: DataFrame, labels: DataFrame) -> DataFrame:
    """slot, id, key, label and size of the buckets whose members have several labels."""
    known = slots.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = known.groupBy("slot").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("n")).filter("l0 <> l1").select("slot", "n")
    return known.join(mixed, "slot")


def _small_pairs(apart: DataFrame) -> DataFrame:
    """All pairs of one small bucket with different labels."""
    few = apart.filter(F.col("n") <= SMALL_BUCKET).select("slot", "id", "label").distinct()
    other = few.withColumnsRenamed({"id": "b", "label": "lb"})
    # at most SMALL_BUCKET rows a slot
    met = few.join(other, "slot").filter((F.col("id") < F.col("b")) & (F.col("label") != F.col("lb")))
    return met.select(F.col("id").alias("a"), "b").distinct()


def _bags(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """key of each of the texts (id, key) and its shingles as a set of (shingle, copy) hashes."""
    keyed = _texts(docs, texts.select("id").distinct()).withColumn("key", F.unhex(F.md5("text"))).join(small(texts), ["id", "key"], "left_semi")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", CHUNK_BYTES):
            bags = []
            for text in batch.column("text").to_pylist():
                _, value, weight = shingles([(text or "").encode()])
                copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                bags.append(mix(np.repeat(value, weight) + copy.astype(U) * _GOLD).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(bags, pa.list_(pa.int64()))], ["key", "bag"])

    # equal rows of a table give a text's bag more than once
    return keyed.select("key", "text").mapInArrow(run, "key binary, bag array<long>").dropDuplicates(["key"])


def _rare_slots(many: DataFrame, bags: DataFrame) -> DataFrame:
    """Slots (slot, id, key) in one of which any two similar ones of the texts (id, key) meet.

    A slot is a shingle.  Of a text's n shingles, ordered by how many of the texts
    hold them, the first n - ceil(4 n / 5) + 1 are its slots; those that no other
    text holds are left out.
    """
    at_least, of = THRESHOLD
    every = bags.select("key", F.explode("bag").alias("slot"))
    # counted where they meet: a shingle has a row for each of its texts and is dealt once
    held = every.withColumn("holders", F.count(F.lit(1)).over(Window.partitionBy("slot"))).filter("holders > 1")
    shared = held.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("holders", "slot"))).alias("shared"))
    n = F.size("bag")
    prefix = n - F.ceil(n * at_least / of).cast("int") + 1 - (n - F.size("shared"))
    some = bags.join(shared, "key").withColumn("prefix", prefix).filter("prefix > 0")
    return some.select("key", F.explode(F.transform(F.slice("shared", F.lit(1), F.col("prefix")), lambda s: s["slot"])).alias("slot")).join(many, "key").select("slot", "id", "key")


def overlap_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, by products of incidence matrices."""
    out = np.zeros((len(left), len(right)), np.float64)
    row_l, row_r = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))
    all_l, all_r = np.concatenate([np.zeros(0, U), *left]), np.concatenate([np.zeros(0, U), *right])
    both = np.intersect1d(all_l, all_r)
    in_l, in_r = np.isin(all_l, both), np.isin(all_r, both)
    col_l, col_r = np.searchsorted(both, all_l[in_l]), np.searchsorted(both, all_r[in_r])
    row_l, row_r = row_l[in_l], row_r[in_r]
    for at in range(0, len(both), columns):
        a, b = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
        some = (col_l >= at) & (col_l < at + columns)
        a[row_l[some], col_l[some] - at] = 1
        some = (col_r >= at) & (col_r < at + columns)
        b[row_r[some], col_r[some] - at] = 1
        out += a @ b.T
    return out


def _block_links(apart: DataFrame, docs: DataFrame, bags: DataFrame | None = None) -> DataFrame:
    """Similar pairs that join the labels of each large bucket, compared block by block.

    All pairs of two blocks are compared exactly; of the similar ones only those
    are returned that join what is not yet joined, at most a row for each member.
    Members are texts, so several texts of one id are compared each.
    """
    many = apart.filter(F.col("n") > SMALL_BUCKET).select("slot", "id", "key", "label", "n")
    if bags is None:
        bags = cut_lean(_bags(docs, cut(many.select("id", "key").distinct(), "near-ids")), "near-bags")
    held = many.join(bags.select("key", F.size("bag").alias("size")), "key")
    wide = held.groupBy("slot").agg(F.greatest(F.ceil(F.max("n") / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    many = many.join(wide, "slot").withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("slot", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "id", "key", "label").join(bags, "key")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "key"])
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        sides = [pdf[pdf["own"] == i], pdf[pdf["own"] == j]]
        if sides[0]["label"].nunique() == 1 and sides[1]["label"].nunique() == 1 and sides[0]["label"].iloc[0] == sides[1]["label"].iloc[0]:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        left, right = ([np.asarray(x, np.int64).view(U) for x in side["bag"]] for side in sides)
        both = overlap_counts(left, right) if left and right else np.zeros((len(left), len(right)))
        total = np.array(list(map(len, left)))[:, None] + np.array(list(map(len, right)))[None, :]
        l_id, r_id = sides[0]["id"].to_numpy(), sides[1]["id"].to_numpy()
        l_label, r_label = sides[0]["label"].to_numpy(), sides[1]["label"].to_numpy()
        hit = (both > 0) & (THRESHOLD[1] * both >= THRESHOLD[0] * (total - both)) & (l_label[:, None] != r_label[None, :])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x, y in np.argwhere(hit).tolist():
            p, q = find(int(l_label[x])), find(int(r_label[y]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((min(l_id[x], r_id[y]), max(l_id[x], r_id[y])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return many.groupBy("slot", "i", "j").applyInPandas(within, "a long, b long").distinct()


def _star_pairs(members: DataFrame) -> DataFrame:
    """Every member of a bucket with one head, unless they share a label.

    ``members`` has slot, id, label and n (the bucket's size).  The head is the
    member that shares most places in buckets with others: among altered copies
    that is the text they were made from.
    """
    shared = members.groupBy("id").agg(F.sum("n").alias("shared"))
    members = members.join(shared, "id")
    # one row for each bucket
    heads = members.groupBy("slot").agg(F.max_by(F.struct("id", "label"), F.struct("shared", -F.col("id"))).alias("h"))
    heads = heads.select("slot", F.col("h.id").alias("a"), F.col("h.label").alias("la"))
    met = members.join(heads, "slot").filter(F.col("label") != F.col("la"))
    return met.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def _shared_ids(named: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of all texts of one document."""
    several = cut(named.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("doc_id", "a"), "near-several")
    return named.join(small(several), "doc_id").filter("a < id").select("a", F.col("id").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every document."""
    begun = mark()
    sketched = cut_lean(sketch(docs), "near-sketch")
    texts = cut(sketched.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "near-texts")
    named = cut(sketched.select("doc_id", "key").join(texts.select("key", "id"), "key").select("doc_id", "id"), "near-named")
    # only buckets of several texts matter: the rest is left behind at once
    slots = texts.select("id", "key", F.explode("bands").alias("slot"))
    met = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head")).filter("n > 1")
    slots = cut(slots.join(met.select("slot", "head"), "slot"), "near-slots")
    # rows of one doc_id with several texts are one document
    edges = cut(_shared_ids(named), "near-edges")
    tried = cut(slots.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "near-pairs")
    slots = slots.select("slot", "id", "key")
    edges = edges.union(cut_lean(verified(tried, docs), "near-edges"))
    labels = components(edges)
    for _ in range(STAR_ROUNDS - 1):
        apart = cut(_still_apart(slots, labels), "near-apart")
        pairs = cut(_star_pairs(apart).join(tried, ["a", "b"], "left_anti"), "near-pairs")
        tried = tried.union(pairs)
        edges = edges.union(cut_lean(verified(pairs, docs), "near-edges"))
        labels = components(edges)
    apart = cut(_still_apart(slots, labels), "near-apart")
    many = cut(apart.filter(F.col("n") > SMALL_BUCKET).select("id", "key").distinct(), "near-many")
    bags = cut_lean(_bags(docs, many), "near-bags")
    rare = cut(_still_apart(_rare_slots(many, bags), labels), "near-rare")
    pairs = cut(_small_pairs(apart).union(_small_pairs(rare)).distinct().join(tried, ["a", "b"], "left_anti"), "near-cross")
    rest = cut_lean(_block_links(rare, docs, bags).union(verified(pairs, docs)), "near-edges")
    if not rest.isEmpty():
        labels = components(edges.union(rest))
    # all texts of a doc_id have one label
    known = named.join(labels, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "id")).alias("class_id"))
    known = finish(known, "near-classes", begun)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(known, "doc_id", "left")


def filter_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, with all columns; null doc_ids stay."""
    begun, name = mark(), unused(docs, "near__id")
    lost = finish(classes(docs).filter("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct(), "near-lost", begun)
    return docs.join(small(lost), docs["doc_id"] == lost[name], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
