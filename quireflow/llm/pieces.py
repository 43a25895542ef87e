"""SentencePiece encoding and decoding by a distinct-chunk table (operator 9).

No piece of the model holds a white-space marker after another character, and a
line feed is part of no piece (byte-fallback models spell it as one byte piece),
so a text falls into chunks that are segmented independently: each maximal run
of spaces with the characters up to the next space or line feed.  Texts are
taken in blocks of about ``BLOCK_BYTES``.  The chunks of a block are looked up in
a table of its distinct chunks, each distinct chunk is segmented once, and ids
are joined back by position.  Models whose pieces do cross markers, or whose
normaliser changes the text, are encoded whole by the library.

The table is a block's own, not the corpus's: a table of the whole corpus would
be joined back through a shuffle of a row for every word, several times the
input, to save segmenting the rare chunks of a block again in another one.

Defined results: a null text counts as empty; an empty text has the end id alone
and decodes to ''; repeated rows are encoded each; a null doc_id stays null; an
empty table gives an empty result; extra columns are ignored.  A text longer than
a block is a block of its own, and a chunk may be as long as a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quireflow.llm.common import lean, sliced, table

MODEL = "piece_bpe_32k.model"
BLOCK_BYTES = 2 << 20
#: Distinct chunks that the library is given in one text.
TOGETHER = 2000
MARK = "▁"


class Encoded(NamedTuple):
    """A block's distinct chunks, where they stand, and what each becomes."""

    chunk: np.ndarray  # distinct number of each chunk
    bounds: np.ndarray  # the chunks of text i are bounds[i]:bounds[i + 1]
    distinct: pa.StringArray
    ids: pa.ListArray  # by distinct chunk
    surfaces: dict[int, str]  # of distinct chunks that do not decode to themselves


class ChunkTable:
    """Segments distinct chunks once and joins them back by position."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.end = self.library.eos_id()
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        byte = re.compile(r"<0x[0-9A-F]{2}>\Z")
        inside = {c for p in pieces if not byte.match(p) for c in p}
        feed = self.library.encode("\n")
        probe = "a\n b  c\n\n é"
        self.chunked = (
            "\n" not in inside
            and not any(MARK in p.lstrip(MARK) for p in pieces)
            and len(feed) == 2
            and self.library.id_to_piece(feed[0]) == MARK
            and self.library.decode(self.library.encode(probe)) == probe
        )
        self.feed = feed[-1]
        self.numbers = pa.array([str(i) for i in range(n)])
        # pieces that stand for the characters they are written with
        special = [byte.match(p) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) for i, p in enumerate(pieces)]
        self.literal = ~np.array(special, bool)

    def _segment(self, distinct: pa.StringArray) -> pa.ListArray:
        """The ids of distinct chunks, each segmented once, behind a line feed as in the middle of a text."""
        is_feed = pc.equal(distinct, "\n").to_numpy(zero_copy_only=False)
        words = distinct.filter(pa.array(~is_feed))
        parts, lengths = [np.zeros(0, np.int32)], np.ones(len(distinct), np.int64)
        counts = [np.zeros(0, np.int64)]
        for at in range(0, len(words), TOGETHER):
            part = words.slice(at, TOGETHER)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), "\n")[0].as_py()
            ids = np.asarray(self.library.encode("\n" + text, return_type="numpy", num_threads=1), np.int32)
            # a marker, then a line feed and the chunk's ids for each chunk
            feeds = ids == self.feed
            counts.append(np.diff(np.append(np.flatnonzero(feeds), len(ids))) - 1)
            parts.append(ids[1:][~feeds[1:]])
        lengths[~is_feed] = np.concatenate(counts)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate(parts)
        for i in np.flatnonzero(is_feed).tolist():
            flat = np.insert(flat, offsets[i], self.feed)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))

    def block(self, texts: pa.Array) -> Encoded:
        """The chunks of texts that are neither null nor empty, each text with a space before it."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        space, feed = data == 0x20, data == 0x0A
        start = feed | space
        start[1:] &= feed[1:] | ~space[:-1]
        start[1:] |= feed[:-1]
        start[offsets[:-1]] = True
        at = np.flatnonzero(start)
        edges = np.append(at, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), raw) if len(at) else pa.array([], pa.string())
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary
        ids = self._segment(distinct)
        odd = np.concatenate([[0], np.cumsum(~self.literal[ids.values.to_numpy()])])[ids.offsets.to_numpy()]
        surfaces = {}
        for i in np.flatnonzero(np.diff(odd)).tolist():  # a line feed before the chunk keeps its leading space
            shown = self.library.decode([self.feed, *ids[i].as_py()])[1:]
            if shown != distinct[i].as_py():
                surfaces[i] = shown
        return Encoded(coded.indices.to_numpy(), np.searchsorted(at, offsets), distinct, ids, surfaces)

    def _ready(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the texts that hold something, and those with a space before each."""
        texts = pc.fill_null(texts, "")
        some = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        held = pc.replace_substring(texts.take(pa.array(some)), MARK, " ")
        return some, pc.binary_join_element_wise(pa.scalar(" ", held.type), held, pa.scalar("", held.type)).cast(pa.string())

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, end id last."""
        if not self.chunked:
            return [np.array(x, np.int32) for x in self.library.encode([t or "" for t in texts.to_pylist()], add_eos=True, num_threads=1)]
        some, held = self._ready(texts)
        out = [np.array([self.end], np.int32)] * len(texts)
        if len(some):
            e = self.block(held)
            at, n = e.ids.offsets.to_numpy()[e.chunk], np.diff(e.ids.offsets.to_numpy())[e.chunk]
            total = np.concatenate([[0], np.cumsum(n)])
            flat = e.ids.values.to_numpy()[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
            for i, a, b in zip(some.tolist(), total[e.bounds[:-1]].tolist(), total[e.bounds[1:]].tolist(), strict=True):
                out[i] = np.append(flat[a:b], np.int32(self.end))
        return out

    def written(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Of each text: the number of ids, the ids in decimal joined by a space, the decoded text in UTF-8."""
        if not self.chunked:
            ids = [x.tolist() for x in self.encode(texts)]
            return np.array(list(map(len, ids)), np.int64), [" ".join(map(str, x)).encode() for x in ids], [self.library.decode(x).encode() for x in ids]
        some, held = self._ready(texts)
        end = b"%d" % self.end
        count, ids, shown = np.ones(len(texts), np.int64), [end] * len(texts), [b""] * len(texts)
        if len(some):
            e = self.block(held)
            bounds = pa.array(e.bounds.astype(np.int32))
            spelled = pc.binary_join(pa.ListArray.from_arrays(e.ids.offsets, self.numbers.take(e.ids.values)), " ")
            joined = pc.binary_join(pa.ListArray.from_arrays(bounds, spelled.take(pa.array(e.chunk))), " ").cast(pa.binary())
            n = np.concatenate([[0], np.cumsum(np.diff(e.ids.offsets.to_numpy())[e.chunk])])
            count[some] = np.diff(n[e.bounds]) + 1
            changed = np.zeros(len(e.distinct), bool)
            changed[list(e.surfaces)] = True
            odd = np.concatenate([[0], np.cumsum(changed[e.chunk])])[e.bounds]
            raw = held.cast(pa.binary())
            for i, a, b in zip(some.tolist(), joined, raw, strict=True):
                ids[i], shown[i] = a.as_py() + b" " + end, b.as_py()[1:]
            for j in np.flatnonzero(np.diff(odd)).tolist():
                chunks = e.chunk[e.bounds[j] : e.bounds[j + 1]]
                words = [e.surfaces.get(c, w) for c, w in zip(chunks.tolist(), e.distinct.take(pa.array(chunks)).to_pylist(), strict=True)]
                shown[some[j]] = "".join(words).encode()[1:]
        return count, ids, shown


_tables: dict[str, ChunkTable] = {}


def _table_for(path: str) -> ChunkTable:
    if path not in _tables:
        _tables[path] = ChunkTable(path)
    return _tables[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, the ids as an array, and the text they decode to."""
    path = model_path or default_model()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _table_for(path)
        for part in sliced(batches, "text", BLOCK_BYTES):
            _, _, shown = held.written(part.column("text"))
            ids = pa.array([x.tolist() for x in held.encode(part.column("text"))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), ids, pa.array([x.decode() for x in shown], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    path = model_path or default_model()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _table_for(path)
        for part in sliced(batches, "text", BLOCK_BYTES):
            count, ids, shown = held.written(part.column("text"))
            sha = [pa.array([hashlib.sha256(x).hexdigest() for x in column], pa.string()) for column in (ids, shown)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(count), *sha], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
