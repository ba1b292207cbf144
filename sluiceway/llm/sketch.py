"""A count-min sketch over anchors, dealt over the cluster, as a prefilter for repeats.

An anchor is a position whose gram hash is the least in some window around it.
A window that occurs twice has equal anchors in both places, so a window with an
anchor that is estimated to occur once occurs once. The estimate never falls
short: nothing repeated is lost.

The sketch is never in one place. A hash's high bits name a segment, a pair of
counter rows of ``2 ** CELL_BITS`` cells each; the number of segments follows the input, so that a
row's load stays at a sixth whatever the size. A task sends, for each chunk of its anchors
and each segment, the other bits of the hashes, their counts and their places in the chunk.
A segment adds up what all tasks sent, estimates each hash by the least of its two cells, and replies
with the places that it estimates repeated. Replies come together by chunk and
leave as one row of bits per document, which is joined to its text. Nothing is
broadcast and nothing reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import counted_side, map_arrow

#: log2 of a segment's cells a row, rows, and the anchors that a segment is made for (a load of one sixth).
CELL_BITS = 22
DEPTH = 2
PER_SEGMENT = 700_000
#: Bits of a hash that are sent; the segment has the others.
SENT_BITS = 28
#: Estimated occurrences from which an anchor is called hot: a group of so many entries is about 0.2 GB in a task.
HOT = 500_000
#: Anchors of a chunk.
FLUSH = 1 << 21
#: Bytes of text that are handled as one buffer.
BUFFER = 1 << 20


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays end to end, compressed; what reads them knows their kinds and lengths."""
    return _zstd()[0].compress(b"".join(a if isinstance(a, bytes) else a.tobytes() for a in arrays))


def unsqueeze(blob: bytes) -> bytes:
    return _zstd()[1].decompress(blob)


def table_blob(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, with their length, compressed."""
    return squeeze(np.uint32(len(arrays[0])).tobytes(), *arrays)


def read_blob(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = unsqueeze(blob)
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tag, text: the tag tells the texts of a repeated doc_id apart, and is 0 for all others."""
    twice = counted_side(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_d")).count().where("count > 1").select("_d"))
    rows = docs.select("doc_id", "text")
    if twice.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("tag"), "text")
    tag = F.when(F.col("_d").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))
    return rows.join(twice, F.col("doc_id") == F.col("_d"), "left").select("doc_id", tag.alias("tag"), "text")


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def marks(symbols: np.ndarray, k: int) -> np.ndarray:
    """Mixed gram hashes, never zero: zero stands for a window that isn't in one document."""
    return mixed(grams(symbols, k, 0x9E3779B97F4A7C15)) | np.uint64(1)


def sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + width], for each i with a full window, by doubling."""
    done, y = 1, x
    while done < width:
        step = min(done, width - done)
        y = f(y[: len(y) - step], y[step:])
        done += step
    return y


def grams(symbols: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rolling hash of symbols[i : i + k], modulo 2 ** 64."""
    out = np.zeros(max(0, len(symbols) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        done, span, power = 0, symbols.astype(np.uint64), np.uint64(base)
        # binary composition: hashes of 1, 2, 4, ... symbols, put together from the left
        length, k_left = 1, k
        at = 0
        while k_left:
            if k_left & 1:
                out = out * power + span[at : at + len(out)]
                at += length
                done += length
            k_left >>= 1
            if k_left:
                span = span[: len(span) - length] * power + span[length:]
                power = power * power
                length *= 2
    return out


def anchored(gram: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(least gram hash of each window, is position an anchor).

    ``gram`` has ``marks``; a window is ``width`` grams; ``last[i]`` says that
    the window starting at i lies in one document.
    """
    if len(gram) < width:
        return np.zeros(0, np.uint64), np.zeros(len(gram), bool)
    least = sliding(gram, width, np.minimum)
    valid = np.where(last[: len(least)], least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate((pad, valid, pad)), width, np.maximum)
    return least, (most == gram) & (most > 0)


def buffers(docs: Iterator[tuple[object, int, object]], limit: int = BUFFER) -> Iterator[list]:
    """Group (id, size, value) into lists of about ``limit`` in size."""
    held, size = [], 0
    for x in docs:
        held.append(x)
        size += x[1]
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def sort_cells(sent: np.ndarray, row: int) -> np.ndarray:
    """A row's cell of the sent bits of hashes."""
    if row == 0:
        return (sent & np.uint32((1 << CELL_BITS) - 1)).astype(np.int64)
    return (mixed(sent.astype(np.uint64) + np.uint64(row)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def estimates(sent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count-min estimate of each entry of a segment: the least of its cells' sums."""
    out = None
    for row in range(DEPTH):
        c = sort_cells(sent, row)
        total = np.bincount(c, counts, 1 << CELL_BITS)[c]
        out = total if out is None else np.minimum(out, total)
    return out


def places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, bits that are sent) of hashes; mixed once more, as anchors are the least of their windows and so lie near zero."""
    h = mixed(h ^ np.uint64(0x5851F42D4C957F2D))
    high = (h >> np.uint64(32)).astype(np.uint64)
    low = ((h >> np.uint64(1)) & np.uint64((1 << SENT_BITS) - 1)).astype(np.uint32)
    return ((high * np.uint64(segments)) >> np.uint64(32)).astype(np.int64), low


Anchors = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _messages(held: list[Anchors], segments: int, once: bool) -> Iterator[tuple[int, int, bool, bytes]]:
    """(segment, chunk, is it the chunk's list of documents, data) for a chunk of anchors."""
    ids, tags, sizes, h = (np.concatenate(x) for x in zip(*held, strict=True))
    if not len(h):
        return
    name = hashlib.blake2b(ids.tobytes() + tags.tobytes(), digest_size=8).digest()
    chunk = int.from_bytes(name, "big", signed=True)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    first = np.flatnonzero(new)
    if once:
        doc = np.repeat(np.arange(len(sizes)), sizes)[order]
        n = np.add.reduceat(new | np.concatenate(([True], doc[1:] != doc[:-1])), first, dtype=np.int64)
    else:
        n = np.diff(np.concatenate((first, [len(s)])))
    lead = order[first].astype(np.int32)
    more, of = order[~new].astype(np.int32), lead[np.cumsum(new) - 1][~new]
    listed = squeeze(np.array([len(ids), len(more)], np.uint32), ids, tags, sizes.astype(np.int32), more, of)
    yield chunk % segments, chunk, True, listed
    seg, sent = places(s[first], segments)
    by = np.lexsort((sent, seg))
    seg, sent, n, lead = seg[by], sent[by], np.minimum(n[by], 65535).astype(np.uint16), lead[by]
    edge = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1], [True])))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        gaps = np.diff(sent[a:b], prepend=np.uint32(0)).astype(np.uint32)
        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T) for x in (gaps, lead[a:b])]
        yield int(seg[a]), chunk, False, squeeze(np.uint32(b - a).tobytes(), *planes, n[a:b])


def _entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits sent, counts, places in the chunk) of a message."""
    raw = unsqueeze(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    planes = np.frombuffer(raw, np.uint8, 8 * n, 4).reshape(2, 4, n)
    gaps, lead = (np.ascontiguousarray(x.T).view(np.uint32).ravel() for x in planes)
    return np.cumsum(gaps, dtype=np.uint32), np.frombuffer(raw, np.uint16, n, 4 + 8 * n), lead.astype(np.int64)


def repeated_anchors(docs: DataFrame, anchors: Callable[[Iterator[pa.RecordBatch]], Iterator[Anchors]], expected: float, once: bool = False) -> DataFrame:
    """doc_id, tag, marks of documents that have an anchor estimated to occur twice.

    ``anchors`` turns a task's batches (of doc_id, tag, text) into ids, tags, numbers of anchors
    and the anchors' hashes, documents end to end. ``marks`` has two bits per anchor, see ``read_marks``. With ``once`` a
    hash counts once for a document.
    """
    segments = max(1, int(np.ceil(expected / PER_SEGMENT)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[Anchors]) -> Iterator[pa.RecordBatch]:
            rows = list(_messages(held, segments, once))
            for i in range(0, len(rows), 256):
                seg, chunk, listed, data = zip(*rows[i : i + 256], strict=True)
                kinds = [pa.array(seg, pa.int64()), pa.array(chunk, pa.int64()), pa.array(listed, pa.bool_()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(kinds, names=["seg", "chunk", "listed", "data"])

        held, n = [], 0
        for x in anchors(batches):
            held.append(x)
            n += len(x[3])
            if n >= FLUSH:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        listed = rows["listed"].to_numpy(bool)
        out = [(c, True, d) for c, d in zip(rows["chunk"][listed], rows["data"][listed], strict=True)]
        chunks, parts = rows["chunk"][~listed].tolist(), [_entries(x) for x in rows["data"][~listed]]
        if parts:
            sent, counts, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
            n = estimates(sent, counts)
            edge = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
            for c, a, b in zip(chunks, edge[:-1], edge[1:], strict=True):
                twice = np.sort(lead[a:b][n[a:b] >= 2]).astype(np.int32)
                if len(twice):
                    hot = np.sort(lead[a:b][n[a:b] >= HOT]).astype(np.int32)
                    out.append((c, False, squeeze(np.uint32(len(twice)).tobytes(), np.diff(twice, prepend=np.int32(0)), hot)))
        return pd.DataFrame(out, columns=["chunk", "listed", "data"]).astype({"chunk": "int64", "listed": "bool"})

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        raw = unsqueeze(rows["data"][rows["listed"]].iloc[0])
        n, m = np.frombuffer(raw, np.uint32, 2).tolist()
        ids, tags = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
        sizes = np.frombuffer(raw, np.int32, n, 8 + 16 * n)
        more, of = np.frombuffer(raw, np.int32, 2 * m, 8 + 20 * n).reshape(2, m)
        marks = np.zeros(int(sizes.sum()), np.uint8)
        for blob in rows["data"][~rows["listed"]]:
            raw = unsqueeze(blob)
            k = int(np.frombuffer(raw, np.uint32, 1)[0])
            marks[np.cumsum(np.frombuffer(raw, np.int32, k, 4))] = 1
            marks[np.frombuffer(raw, np.int32, -1, 4 + 4 * k)] = 2
        marks[more] = marks[of]
        edge = np.concatenate(([0], np.cumsum(sizes)))
        own = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(marks > 0)))[edge]))
        blobs = [np.packbits(marks[edge[i] : edge[i + 1], None] >= (1, 2)).tobytes() for i in own]
        return pd.DataFrame({"doc_id": ids[own], "tag": tags[own], "marks": blobs}).astype({"doc_id": "int64", "tag": "int64"})

    sent = map_arrow(docs, send, "seg long, chunk long, listed boolean, data binary")
    replied = sent.groupBy("seg").applyInPandas(add, "chunk long, listed boolean, data binary")
    found = replied.groupBy("chunk").applyInPandas(gather, "doc_id long, tag long, marks binary")
    # a row that repeats may be in several chunks; its marks are the same in all
    return found.groupBy("doc_id", "tag").agg(F.max("marks").alias("marks"))


def read_marks(blob: bytes, n: int) -> np.ndarray:
    """0, 1 (estimated to repeat) or 2 (hot) for each of a document's n anchors."""
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=2 * n).reshape(n, 2).sum(1, dtype=np.uint8)


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Documents with their marks (null: none). The same exchange of the texts serves ``with_spans``."""
    return docs.join(marks, ["doc_id", "tag"], "left")


def spans_of(starts: np.ndarray, length: int) -> np.ndarray:
    """Union of [s, s + length) over sorted starts, as rows (from, to)."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.concatenate(([True], starts[1:] > starts[:-1] + length))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return np.stack((starts[first], starts[last] + length), axis=1)


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of (from, to) rows; touching ones become one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    first = np.flatnonzero(new)
    return np.stack((spans[first, 0], np.concatenate((reach[first[1:] - 1], reach[-1:]))), axis=1)


# -- spans per document, on their way back from groups


def by_document(doc: np.ndarray, tag: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ids, tags, packed union of spans) per document from spans (rows of from, to)."""
    order = np.lexsort((tag, doc))
    doc, tag, spans = doc[order], tag[order], spans[order].astype(np.int64)
    if not len(doc):
        return doc, tag, []
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]), [True])))
    return doc[edge[:-1]], tag[edge[:-1]], [merged(spans[a:b]).astype(np.int32).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def packed(doc: np.ndarray, tag: np.ndarray, blobs: list[bytes], n_buckets: int) -> pd.DataFrame:
    """(b, data): spans of documents, one row per bucket of documents instead of one per document."""
    with np.errstate(over="ignore"):
        bucket = (mixed(doc.view(np.uint64) + mixed(tag.view(np.uint64))) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(doc) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own = order[a:b]
        sizes = np.array([len(blobs[i]) for i in own], np.int32)
        rows.append((int(bucket[own[0]]), squeeze(np.uint32(len(own)).tobytes(), doc[own], tag[own], sizes, b"".join(blobs[i] for i in own))))
    return pd.DataFrame(rows, columns=["b", "data"]).astype({"b": "int64"})


def read_packed(blob: bytes) -> Iterator[tuple[tuple[int, int], bytes]]:
    raw = unsqueeze(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    at = 4 + 20 * n
    ids, sizes = np.frombuffer(raw, np.int64, 2 * n, 4).reshape(2, n).T.tolist(), np.frombuffer(raw, np.int32, n, 4 + 16 * n).tolist()
    for key, size in zip(map(tuple, ids), sizes, strict=True):
        yield key, raw[at : at + size]
        at += size


def spans_by_document(rows: DataFrame) -> DataFrame:
    """(b, data) to doc_id, tag and spans: all packed int32 pairs of a document, merged."""

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[tuple[int, int], list[bytes]] = {}
        for blob in rows["data"]:
            for key, spans in read_packed(blob):
                held.setdefault(key, []).append(spans)
        spans = [merged(np.frombuffer(b"".join(x), np.int32).reshape(-1, 2).astype(np.int64)).astype(np.int32).tobytes() for x in held.values()]
        return pd.DataFrame({"doc_id": [d for d, _ in held], "tag": [t for _, t in held], "spans": spans}).astype({"doc_id": "int64", "tag": "int64"})

    return rows.groupBy("b").applyInPandas(gather, "doc_id long, tag long, spans binary")


def union_spans(blob: bytes | None) -> np.ndarray:
    return merged(np.frombuffer(blob or b"", np.int32).reshape(-1, 2).astype(np.int64))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with their spans (null: none)."""
    return docs.join(spans, ["doc_id", "tag"], "left")
