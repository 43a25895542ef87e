from quireflow.llm import mixing, quality

CLASHING = ["q__w", "q__host", "q__row", "m__domain", "m__take", "e__h", "x0", "q__r__h", "base_failed_q"]


def _rows(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i else "short", "en" if i % 2 else None, f"s{i % 3}", 1, *(f"{c}-{i}" for c in CLASHING)) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))


def test_filters_leave_clashing_columns_as_they_are(spark):
    frame = _rows(spark)
    given = {x.doc_id: x for x in frame.collect()}
    passed = quality.filter_documents(frame)
    assert passed.columns == frame.columns
    assert {x.doc_id: x for x in passed.collect()} == {i: x for i, x in given.items() if i}
    mixed = mixing.filter_documents(frame)
    assert mixed.columns == frame.columns
    found = mixed.collect()
    assert found
    assert all(x[c] == given[x.doc_id][c] for x in found for c in ["source", "lang", *CLASHING])


def _flags(spark, hosts):
    rows = [(h, i < f) for h, (n, f) in hosts.items() for i in range(n)]
    return spark.createDataFrame(rows, "host string, base_failed boolean")


def test_prior_leaves_out_what_drawing_explains(spark):
    # ten hosts of two documents, rates 0, 0.5 and 1 as drawing at 0.5 gives them: no host stands out
    drawn = {f"h{i}": (2, f) for i, f in enumerate([0, 0, 1, 1, 1, 1, 1, 2, 2, 1])}
    assert {x.q__host for x in quality.rejected_hosts(_flags(spark, drawn), "host", 0.6).collect()} == set()
    # hosts of 40 documents with rates that drawing cannot explain keep their own rates
    apart = {f"h{i}": (40, f) for i, f in enumerate([40, 0, 40, 0])}
    assert {x.q__host for x in quality.rejected_hosts(_flags(spark, apart), "host", 0.6).collect()} == {"h0", "h2"}
