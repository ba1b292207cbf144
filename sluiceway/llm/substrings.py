"""Exact removal of repeated word windows, behind a count-min prefilter.

Pass 1 counts in a count-min sketch (see ``sketch``): a window is counted under
its anchor, the least hash among its 8-word grams, so that neighbouring windows
share an entry. Pass 2 takes only windows whose anchor is estimated repeated
and groups them by 128 bits: two rolling hashes over the two halves of 128-bit word
hashes. A task sends the first of its windows for each sequence; its other
occurrences are known to be later and only mark the document. Windows are dealt by their own hash, so a
group holds one entry per task at most for a sequence, however frequent it or its anchor is. What has to
go comes back as word ranges per document.

Edge cases: null, empty and blank texts have no words and keep the empty text;
documents shorter than a window keep everything. An occurrence goes only if another starts strictly earlier by (doc_id,
start); rows that repeat a doc_id are one document, so what starts at the same word in both
stays in both. Rows without a doc_id are in no order: they keep everything and remove nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import map_arrow
from sluiceway.llm.sketch import (
    Anchors, anchored, buffers, by_document, grams, keyed, marks, packed, read_blob, read_marks, read_packed, repeated_anchors, spans_by_document, table_blob, union_spans,
    with_marks, with_spans,
)

WINDOW = 20
GRAM = 8
#: Bytes of text per group of the exact pass.
GROUP_BYTES = 8 << 20
#: Windows a task holds before it sends them.
FLUSH = 1 << 20
#: Bytes of text per anchor, as a rule; the sketch is laid out for so many.
PER_ANCHOR = 45


def word_bytes(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.split() splits at exactly the white space of the contract."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class _Buffer:
    """Hashes of the words of several documents, end to end."""

    def __init__(self, docs: list[tuple], window: int):
        self.ids, self.tags = np.array([x[0] for x in docs], np.int64), np.array([x[2] for x in docs], np.int64)
        sizes = np.array([x[1] for x in docs], np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        n = int(self.start[-1])
        digest = xxhash.xxh3_128_digest
        halves = np.frombuffer(b"".join(digest(w) for x in docs for w in x[3]), ">u8").astype(np.uint64).reshape(n, 2)
        self.words, self.others = halves[:, 0].copy(), halves[:, 1].copy()
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        self.gram = marks(self.words, GRAM)
        at = np.arange(max(0, n - window + 1))
        self.valid = self.start[self.doc[at] + 1] >= at + window
        self.least, self.anchor = anchored(self.gram, self.valid, window - GRAM + 1)
        self.marks = [x[4] for x in docs]

    def anchors(self) -> Anchors:
        at = np.flatnonzero(self.anchor)
        return self.ids, self.tags, np.bincount(self.doc[at], minlength=len(self.ids)), self.gram[at]

    def repeated(self) -> np.ndarray:
        """Windows whose anchor is estimated to repeat."""
        _, _, sizes, h = self.anchors()
        seen = np.concatenate([read_marks(m, n) for m, n in zip(self.marks, sizes, strict=True)]) > 0
        known = np.unique(h[seen])
        at = np.flatnonzero(self.valid)
        i = np.minimum(np.searchsorted(known, self.least[at]), max(0, len(known) - 1))
        return at[known[i] == self.least[at]] if len(known) else at[:0]


def _buffered(batches: Iterator[pa.RecordBatch], window: int, marked: bool) -> Iterator[_Buffer]:
    def docs() -> Iterator[tuple]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("doc_id", "tag", "text")]
            for d, tag, t, m in zip(*columns, b.column("marks").to_pylist() if marked else columns[0], strict=True):
                if d is not None and m is not None and len(w := word_bytes(t)) >= window:
                    yield d, len(w), tag, w, m

    for part in buffers(docs(), 200_000):
        yield _Buffer(part, window)


def later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by hash, document and start; does a sequence start earlier elsewhere; is it a copy of the entry before)."""
    order = np.lexsort((tag, at, doc, h2, h1))
    a, b, d, t, s = h1[order], h2[order], doc[order], tag[order], at[order]
    if not len(a):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    after = (d > d[first]) | (s > s[first])
    return order, after, ~new & ~after & np.concatenate(([False], t[1:] == t[:-1]))


def repeated_ranges(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of ``keyed`` rows: doc_id, tag, spans (packed int32 pairs), the word ranges to remove; only documents that lose words."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(1, int(total // GROUP_BYTES))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[Anchors]:
        for b in _buffered(batches, window, False):
            yield b.anchors()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            h1, h2, doc, tag, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order, after, copy = later(h1, h2, doc, tag, at)
            gone = order[after]
            marked = packed(*by_document(doc[gone], tag[gone], at[gone, None] + (0, window)), n_groups)
            keep = order[~after & ~copy]
            g = (h1[keep] % np.uint64(n_groups)).astype(np.int64)
            by = np.argsort(g, kind="stable")
            keep, g = keep[by], g[by]
            edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True]))) if len(g) else np.zeros(1, np.int64)
            cut = [keep[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            groups = [*marked["b"], *g[edge[:-1]].tolist()]
            blobs = [*marked["data"], *(table_blob(h1[k], h2[k], doc[k], tag[k], at[k]) for k in cut)]
            local = [True] * len(marked) + [False] * len(cut)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(local, pa.bool_()), pa.array(blobs, pa.binary())], names=["g", "local", "data"])

        held, n = [], 0
        for b in _buffered(batches, window, True):
            at = b.repeated()
            if len(at):
                h1 = grams(b.words, window, 0xA24BAED4963EE407)[at]
                h2 = grams(b.others, window, 0x9FB21C651E98DF25)[at]
                d = b.doc[at]
                held.append((h1, h2, b.ids[d], b.tags[d], (at - b.start[d]).astype(np.int32)))
                n += len(at)
            if n >= FLUSH:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        local = rows["local"].to_numpy(bool)
        parts = [read_blob(x, np.uint64, np.uint64, np.int64, np.int64, np.int32) for x in rows["data"][~local]]
        out = pd.DataFrame({"b": rows["g"][local], "data": rows["data"][local]})
        if parts:
            h1, h2, doc, tag, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, after, _ = later(h1, h2, doc, tag, at)
            gone = order[after]
            out = pd.concat([out, packed(*by_document(doc[gone], tag[gone], at[gone, None] + (0, window)), n_groups)])
        return out

    found = with_marks(rows, repeated_anchors(rows, anchors, total / PER_ANCHOR))
    sent = map_arrow(found, send, "g long, local boolean, data binary")
    return spans_by_document(sent.groupBy("g").applyInPandas(group, "b long, data binary"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = word_bytes(t)
                kept, at, gone = [], 0, 0
                for lo, hi in union_spans(s):
                    kept += words[at:lo]
                    gone += hi - lo
                    at = hi
                out.append((len(words), int(gone), b" ".join(kept + words[at:])))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    rows = keyed(docs)
    found = map_arrow(with_spans(rows, repeated_ranges(rows, window)), run, "doc_id long, n_words long, n_removed long, kept binary")
    return found.withColumn("kept", F.col("kept").cast("string"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract on a dictionary of word sequences, for tests."""
    rows = [(d, word_bytes(t)) for d, t in docs]
    least: dict[tuple, tuple] = {}
    for doc, w in rows:
        for i in range(len(w) - window + 1 if doc is not None else 0):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, (doc, i)), (doc, i))
    out = []
    for doc, w in rows:
        gone = set()
        for i in range(len(w) - window + 1 if doc is not None else 0):
            if least[tuple(w[i : i + window])] < (doc, i):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, rank() OVER (PARTITION BY p ORDER BY doc_id, i) AS n FROM win) WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.j) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.j = x.j WHERE g.j IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
