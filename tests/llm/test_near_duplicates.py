"""Classes of documents with several texts, against brute force."""

import random

import pytest
from test_operators import _WORD, _similar

from quireflow.llm import neardup


def brute_force(rows):
    """The least doc_id of each document's class; a document is linked if any of its texts is."""
    label = {i: i for i, _ in rows}
    for _ in label:
        for i, t in rows:
            for j, u in rows:
                if _WORD.findall(t or "") and t == u or _similar(t, u):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def several_texts(seed):
    """Families of altered copies, dealt so that some doc_ids hold texts of two families."""
    r = random.Random(seed)
    rows, at = [], 0
    for _ in range(6):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(8):
            words = list(base)
            words[r.randrange(120)] = "changed"
            rows.append((at, " ".join(words)))
            at += 1
    texts = dict(rows)
    rows += [(3, texts[20]), (40, texts[30]), (47, "alone in the world it is"), (9, texts[10].replace("changed", "other"))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket", [48, 1])
def test_documents_with_several_texts_join_their_classes(spark, bucket, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", bucket)
    # 0 and 5 are linked only through 7, which holds a copy of either
    rows = [(0, "a b c d e f g h"), (5, "k l m n o p q r"), (7, "k l m n o p q r"), (7, "a b c d e f g h"), *((i + 100, t) for i, t in several_texts(1))]
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == got[5] == got[7] == 0
    assert got == brute_force(rows)


def test_block_compares_every_text_of_a_document(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 1)
    base = [[f"{x}{i}" for i in range(60)] for x in "pq"]
    near = [" ".join([*words[:-1], "changed"]) for words in base]
    docs = spark.createDataFrame([(1, near[0]), (2, near[1]), (3, " ".join(base[0])), (3, " ".join(base[1]))], "doc_id long, text string")
    found = neardup.sketch(docs).withColumnRenamed("doc_id", "id").selectExpr("id", "key", "1L AS slot", "id AS label", "4L AS n")
    assert {(x.a, x.b) for x in neardup._block_links(found, docs).collect()} == {(1, 3), (2, 3)}


def test_texts_without_words_stay_alone(spark):
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one"), (8, ""), (8, "one"), (9, ""), (9, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in neardup.classes(docs).collect()}
    assert got == brute_force(rows) == {**{i: i for i in range(10)}, 7: 6, 8: 6}
    assert sorted(x.doc_id for x in neardup.filter_documents(docs).collect()) == [0, 1, 2, 3, 4, 5, 6, 9, 9]


def test_small_buckets_lose_no_pair_before_the_exact_check(spark):
    # two similar texts in one bucket: they are compared whatever their signatures say
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "changed"])), (3, "quite another text it is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    apart = spark.createDataFrame([(1, i, i, 3, bytes([i]) * neardup.REGISTERS) for i, _ in rows], "slot long, id long, label long, n long, sig binary")
    pairs = neardup._small_pairs(apart)
    assert {(x.a, x.b) for x in pairs.collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(x.a, x.b) for x in neardup.verified(pairs, docs).collect()} == {(1, 2)}


def altered(r, words, share):
    return [f"x{r.randrange(10**9)}" if r.random() < share else w for w in words]


def test_recall_of_similar_pairs(spark):
    """All pairs at 0.8 or more, found by comparing every two texts, stand in one class."""
    r = random.Random(11)
    rows = []
    for _ in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randint(60, 400))]
        rows += [(len(rows) + k, " ".join(altered(r, base, s))) for k, s in enumerate((0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05))]
        rows += [(len(rows), " ".join(base + base[: len(base) // 8]))]
    pairs = [(i, j) for i, t in rows for j, u in rows if i < j and _similar(t, u)]
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 80 and found >= 0.99 * len(pairs)
    label = {i: i for i, _ in rows}
    for _ in range(8):  # families have eight members
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    assert all(label[got[i]] == label[i] for i in got)


def test_rare_shingles_let_every_similar_pair_meet(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(altered(r, base, s)) for s in (0, 0.01, 0.02, 0.02, 0.03, 0.1, 0.3, 0.5) for _ in range(3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    many = rows.selectExpr("doc_id AS id", "unhex(md5(text)) AS key")
    slots = neardup._rare_slots(many, neardup._bags(rows, many)).collect()
    met = {(a.id, b.id) for a in slots for b in slots if a.slot == b.slot and a.id < b.id}
    similar = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] != texts[j] and _similar(texts[i], texts[j])}
    assert len(similar) > 10 and similar <= met and len(met) < len(texts) * (len(texts) - 1) // 2


def test_shingles_are_counted_without_a_join(spark):
    """A common shingle's rows were joined with its count, a row for each text that holds it."""
    shared = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(i, f"{shared} own{i} end{i}" if i else "quite another text it is") for i in range(60)], "doc_id long, text string")
    many = rows.selectExpr("doc_id AS id", "unhex(md5(text)) AS key")
    found = neardup._rare_slots(many, neardup._bags(rows, many))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "slot#" in line]
    # 38 shingles, of which two are each text's own and not slots: of the first 38 - ceil(4 * 38 / 5) + 1 = 8, six are left
    slots = found.collect()
    assert len(slots) == 59 * 6 and len({r.slot for r in slots}) == 6 and 0 not in {r.id for r in slots}


def test_split_processes_agree_across_weights():
    """The points below the smaller weight are those of the larger one."""
    import numpy as np

    value = np.arange(50, dtype=np.uint64)
    for small, large in ((3, 4), (5, 8), (700, 1000)):
        weight = np.concatenate([np.full(50, small), np.full(50, large)])
        least = neardup.signatures(np.repeat([0, 1], 50), np.tile(value, 2), weight, 2, 500)
        assert (least[1] <= least[0]).all()
        assert abs((least[0] == least[1]).mean() - small / large) < 0.08


def test_whole_classes_on_an_empty_table_with_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 1, 2), (None, "x", 1, 2)], "doc_id long, text string, near__id int, id int")
    assert sorted(map(str, neardup.filter_documents(frame).collect())) == sorted(map(str, frame.filter("doc_id = 1 OR doc_id IS NULL").collect()))
    assert neardup.classes(frame.limit(0)).count() == 0 and neardup.filter_documents(frame.limit(0)).columns == frame.columns
