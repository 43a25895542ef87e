"""What the registered queries' own parameters reach."""

import numpy as np
import pandas as pd
from test_operators import corpus, docs  # noqa: F401

from quireflow.llm import fingerprints, suffixes


def test_defaults_compact_before_the_last_batch(spark, docs, monkeypatch):  # noqa: F811
    steps, append, compact = [], fingerprints.FingerprintIndex.append, fingerprints.FingerprintIndex.compact
    monkeypatch.setattr(fingerprints.FingerprintIndex, "append", lambda self, prints: (steps.append("append"), append(self, prints))[1])
    monkeypatch.setattr(fingerprints.FingerprintIndex, "compact", lambda self: (steps.append("compact"), compact(self))[1])
    got = sorted(map(str, fingerprints.digests(docs).collect()))
    assert "compact" in steps and steps[-1] == "append" and steps.index("compact") < len(steps) - 2
    assert got == sorted(map(str, fingerprints.digests(docs, 1).collect()))


def test_an_anchor_with_many_distinct_surroundings_is_hot_by_default():
    r = np.random.default_rng(1)
    shared = bytes(r.integers(65, 91, 200).astype(np.uint8))
    texts = [bytes(r.integers(97, 123, 60).astype(np.uint8)) + shared + bytes(r.integers(97, 123, 60).astype(np.uint8)) for _ in range(20_000)]
    anchor, held = suffixes.block_anchors(pd.DataFrame({"doc_id": range(len(texts)), "text": [t.decode() for t in texts]}), 50, 16)
    hot = suffixes.hot_anchors(held, np.arange(len(held)), np.ones(len(held), np.int64), suffixes.HOT_BLOCKS, suffixes.HOT_BYTES)
    middle = set(suffixes.anchors([shared[60:140]]).anchor.tolist())
    # the two ends of the passage run into private text, its middle is one stretch
    assert 1 <= hot.sum() <= 8 and not middle & set(anchor[hot].tolist())
    assert (held[np.isin(anchor, list(middle))] & 1).all()


def test_hot_by_bytes_changes_nothing(spark, docs):  # noqa: F811
    key = lambda d: sorted(map(str, d.drop("kept").toPandas().itertuples(index=False, name=None)))
    assert key(suffixes.deduplicate(docs, hot_bytes=200)) == key(suffixes.deduplicate(docs, hot_bytes=1 << 60))
