"""The training-data operators against brute force, with nulls, empties, ties and repeats."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quireflow.llm import chat, fingerprints, licenses, mixing, mtree, neardup, pieces, quality, registry, suffixes, url_filter
from quireflow.llm.hashing import runs, sliding_min
from quireflow.llm.rindex import RunLengthIndex

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7)))
    long = [word() for _ in range(70)]
    base = [word() for _ in range(160)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one")]
    for i in range(5, 40):
        words = [word() for _ in range(r.randint(40, 150))]
        if i % 4 == 0:
            words[20:20] = long
        if i % 5 == 0:
            words = list(base)
            words[r.randrange(160)] = word()
        out.append((i, r.choice([" ", "\n", "  "]).join(words)))
    out += [(40, " ".join(base)), (41, " ".join(base)), (42, "x y " * 3000), (43, "x y " * 2000), (43, "x y " * 2000), (None, " ".join(base))]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", None]), 0 if t is None else len(t), "clash") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def against(df, sql, **views):
    con = duckdb.connect()
    for name, frame in views.items():
        con.register(name, frame.toPandas().astype({"doc_id": "Int64"}) if "doc_id" in frame.columns else frame.toPandas())
    got, want = df.toPandas(), con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda d: sorted(str(tuple(r)) for r in d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None))
    norm = lambda rows: [re.sub(r"\.0\b", "", x) for x in rows]
    assert norm(plain(got)) == norm(plain(want))


def test_top_k(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(700, 6))
    v[100:400] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [1.0, None]), (702, [float("nan")] * 6), (None, [1.0] * 6), (500, v[500].tolist())]
    held = mtree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in mtree.top_k(held, held.filter("vec_id % 100 = 0"), 10, 64).collect()}
    q = [(i, np.floor(1024 * x).astype(int)) for i, x in enumerate(v)] + [(500, np.floor(1024 * v[500]).astype(int))]
    for i in range(0, 700, 100):
        best = sorted(((-int(q[i][1] @ c), j) for j, c in q if j != i))[:10]
        assert [got[i, n + 1] for n in range(10)] == [(j, -s) for s, j in best]
    empty = held.limit(0)
    assert mtree.top_k(empty, empty).count() == 0


def test_tree_skips_comparisons():
    r = np.random.default_rng(1)
    v = (r.normal(size=(50, 1, 4)) * 100 + r.normal(size=(50, 40, 4))).reshape(-1, 4).astype(np.int64)
    counts: dict = {}
    pages = mtree.build_pages(np.arange(len(v)), v)
    assert mtree.search(pages, 0, v[0], 5, counts=counts) == [(s, i) for s, i in sorted(((int(v[0] @ x), j) for j, x in enumerate(v) if j), key=lambda x: (-x[0], x[1]))[:5]]
    assert counts["compared"] < len(v) / 2


@pytest.mark.parametrize("name", ["op2_mix_sources", "op3_license_digests", "op5_host_quality", "op8_suffix_dedup", "op10_fingerprint_dedup"])
def test_documents_against_sql(spark, docs, name, monkeypatch, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    against(registry.QUERIES[name](spark, str(tmp_path)), registry.oracle_sql()[name], documents=docs)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert registry.QUERIES[name](spark, f"{tmp_path}/none").count() == 0


def test_hot_anchors_go_singly(spark, docs):
    one = suffixes.deduplicate(docs, hot_blocks=2, block_bytes=4000).drop("kept").toPandas()
    two = suffixes.deduplicate(docs).drop("kept").toPandas()
    key = lambda d: sorted(map(str, d.itertuples(index=False, name=None)))
    assert key(one) == key(two)


def test_run_length_index():
    texts = [b"abracadabra", b"cadabrac", b"zzzzz", b"abraca"]
    index = RunLengthIndex(texts, np.array([3, 1, 2, 5]), 5)
    got, at = index.stream(texts), 0
    for t in texts:
        for i in range(len(t) - 4):
            assert got[at] == min(d for d, x in zip([3, 1, 2, 5], texts, strict=True) if t[i : i + 5] in x)
            at += 1
    assert index.runs <= index.n


def test_hash_helpers():
    x = np.arange(60, dtype=np.uint64) % 7
    assert len(set(runs(x, 7).tolist())) == 7 and runs(x, 7)[0] == runs(x, 7)[7]
    assert sliding_min(x, 5).tolist() == [min(x[i : i + 5]) for i in range(56)]


def _similar(a, b):
    bag = lambda t: Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if (w := _WORD.findall(t or "")) else Counter()
    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    return both > 0 and 5 * both >= 4 * sum((x | y).values())


@pytest.mark.parametrize("bucket", [48, 2])
def test_near_duplicates(spark, docs, bucket, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", bucket)
    rows = [(i, t) for i, t, *_ in corpus() if i is not None]
    label = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for i, t in rows:
            for j, u in rows:
                if t == u and _WORD.findall(t or "") or _similar(t, u):
                    label[i] = label[j] = min(label[i], label[j])
    got = {x.doc_id: x.class_id for x in neardup.classes(docs).collect()}
    assert got.pop(None) is None
    assert got == label


def test_signature_estimates_weighted_jaccard():
    r = np.random.default_rng(2)
    value = r.integers(0, 2**63, 300).astype(np.uint64)
    a, b = r.integers(1, 9, 300), r.integers(1, 9, 300)
    doc = np.repeat([0, 1], 300)
    least = neardup.signatures(doc, np.tile(value, 2), np.concatenate([a, b]), 2, 2000)
    assert abs((least[0] == least[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    odd = ["", None, " ", "  a  b", "a\n\n b\tc\r\nd ", "▁x ▁▁ y", "日本語 🙂 é", "</s> <unk> <0x0A>", "\x00z", "a" * 5000, "x y " * 500] + [t for _, t, *_ in corpus()]
    frame = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {x.doc_id: x for x in pieces.digests(frame).collect()}
    for i, t in enumerate(odd):
        ids = library.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_batches_and_compaction_change_nothing(spark, docs, monkeypatch):
    want = sorted(map(str, fingerprints.digests(docs, 1).collect()))
    monkeypatch.setattr(fingerprints, "MAX_RUNS", 1)
    monkeypatch.setattr(fingerprints.FingerprintIndex.__init__, "__defaults__", (None, 1))
    assert sorted(map(str, fingerprints.digests(docs, 4).collect())) == want


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, None, "who"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (1, 1, "ann", "hi <|im_end|>")]
    turns = spark.createDataFrame([(*x, 9) for x in rows], "conv_id long, turn long, role string, text string, speaker int")
    against(chat.rotate(turns), chat.ORACLE, conversations=turns.drop("speaker"))
    whole = {(x.conv_id, x.perspective): x for x in chat.assemble(chat.rotate(turns)).collect()}
    said = whole[1, "bob"]
    assert [said.text[a:b] for a, b in said.spans] == [chat.END]
    assert chat.rotate(turns.limit(0)).count() == 0


def test_licences(spark):
    text = dict(licenses.KNOWN)["MIT"]
    odd = "Copyright (c) 2020 Somebody\n\n" + text.upper().replace(",", " ,").replace("SUBLICENSE", "sub-licence")
    frame = spark.createDataFrame([(1, odd), (2, text + " more"), (3, None), (4, "released under the mit licence")], "doc_id long, text string")
    assert {x.doc_id: x.license for x in licenses.scan(frame, licenses.known_digests(spark)).collect()} == {1: "MIT", 2: None, 3: None, 4: "MIT-notice"}


def test_urls(spark):
    urls = ["https://a.example.com/en/71?x#y", "http://COM/en/", None, "no url", "http://net/de/8", "http://x.example.net/de/8a", "http://org/es/", "http://free-pills.example.com/free-pills/en/1", ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    against(url_filter.query.__globals__["judge"](pages, url_filter._plain_weights()), url_filter.oracle(), pages=pages)
    trained, plain = url_filter.train(url_filter.labelled_frame(spark)), url_filter._plain_weights()
    assert np.allclose(trained, plain, atol=1e-9)


def test_bad_hosts_lose_all(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "bad") for i in range(40)] + [(100 + i, good, "bad") for i in range(5)] + [(200 + h * 50 + i, good if i else "short", f"h{h}") for h in range(5) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {x.doc_id for x in quality.judge(frame).filter("kept").collect()}
    assert kept == {200 + h * 50 + i for h in range(5) for i in range(1, 40)}
    assert {x.doc_id for x in quality.filter_documents(frame).collect()} == kept


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)], "m__domain string, m__lang string, m__source string, tokens long")
    got = {x.m__source: x.alloc for x in mixing.plan(leaves, mixing.Weights({}, {}, {}), 1, 50).collect()}
    assert got == {"a": 10, "b": 492, "c": 502}


def _pipeline_by_brute_force(rows):
    """doc_id, n_tokens and both digests of what the five stages leave of ``rows``."""
    import sentencepiece

    words = lambda t: _WORD.findall(t or "")

    def fails(t):
        w = words(t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(tri)
        repeated = {i + d for i, x in enumerate(tri) if seen[x] > 1 for d in range(3)}
        return len(w) < 50 or 100 * len(repeated) > 50 * len(w)

    hosts = {}
    for _, t, _, source, *_ in rows:
        n, f = hosts.get(source, (0, 0))
        hosts[source] = n + 1, f + fails(t)
    mean = sum(f for _, f in hosts.values()) / len(rows)
    spread = sum((f / n - mean) ** 2 for n, f in hosts.values()) / len(hosts)
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0) if spread else 1000.0
    rows = [r for r in rows if not fails(r[1]) and (hosts[r[3]][1] + mean * weight) / (hosts[r[3]][0] + weight) <= 0.5]

    ids = sorted((r[0], r[1]) for r in rows if r[0] is not None)
    label = {i: i for i, _ in ids}
    for _ in ids:
        for i, t in ids:
            for j, u in ids:
                if _similar(t, u):
                    label[i] = label[j] = min(label[i], label[j])
    rows = [r for r in rows if r[0] is None or label[r[0]] == r[0]]

    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for at in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[at : at + 50])
            first[key] = min(first.get(key, i), i)
    cut = []
    for i, t, lang, source, *_ in rows:
        w = words(t)
        gone = {at + d for at in range(len(w) - 49) if i is not None and first[tuple(w[at : at + 50])] < i for d in range(50)}
        kept = " ".join(x for at, x in enumerate(w) if at not in gone)
        if kept:
            cut.append((i, kept if gone else t, lang, source))
    lost = sum(len(words(b[1])) for b in rows) - sum(len(words(a[1])) for a in cut)

    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(cut, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    texts = {i: t for i, t, *_ in cut}
    assert len(texts) == len(cut)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for doc_id, take, n in con.execute(f"SELECT doc_id, take, n_tokens FROM ({mixing.ORACLE})").fetchall():
        t = texts[doc_id]
        got = library.encode(" ".join(words(t)[:take]) if take < n else t, add_eos=True)
        out.append((doc_id, len(got), sha(" ".join(map(str, got))), sha(library.decode(got))))
    return sorted(out, key=str), lost


def test_pipeline_against_brute_force(spark, docs, tmp_path, monkeypatch):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = []

    def watched(stage):
        def run(spark, df, sf_dir):
            columns.append(df.columns)
            return stage(spark, df, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    got = sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    want, lost = _pipeline_by_brute_force([tuple(r) for r in docs.collect()])
    assert columns == [docs.columns] * 5
    assert got == want and len(got) > 5 and lost > 0
