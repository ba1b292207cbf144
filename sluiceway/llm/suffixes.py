"""Byte-level removal of repeated 50-byte strings by merging sorted suffix runs.

The suffix array is sparse: it has the suffixes that start at anchors (a byte
position whose 20-byte gram has the least hash in some 50-byte string around
it), and of these only the ones whose gram is estimated to occur in several
documents. A suffix is cut at 50 bytes and carries the 30 bytes before it, so it
decides every 50-byte string around its anchor.

A task sorts its suffixes into runs, one per group of grams, and sends them
front-coded (the length of the prefix shared with the suffix before, and the
rest). A group's runs are combined by a loser tree that keeps, for every entry,
how long a prefix it shares with the last winner: of two entries the one that
shares more is the smaller, and only on a tie are bytes compared, from there on.
The merged order and its common prefixes give the classes of equal strings for
each offset of the anchor, and each class its smallest document. All comparisons are of the bytes themselves.

Suffixes of one task that are equal with their context are sent once, with the
task's smallest document; in the task's other documents the strings around them
are known to be repeats. A very frequent passage is thus one entry per task. A gram that is
hot (in ``HOT`` documents or more by the sketch's estimate, the same everywhere) may stand in as many different
surroundings; its entries are sent as the up to 31 strings of 50 bytes around the anchor instead, each a suffix
of its own that is dealt by all its bytes, so that no group has more than a task's one entry for a string.

Edge cases: null and empty texts have no bytes; texts shorter than 50 bytes lose
nothing; matches never cross documents; rows that repeat a doc_id are one
document and don't remove from each other; rows without a doc_id are in no order, they keep
everything and remove nothing; NUL bytes are ordinary bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import map_arrow
from sluiceway.llm.sketch import (
    Anchors, anchored, buffers, by_document, keyed, marks, packed, read_marks, repeated_anchors, spans_by_document, squeeze, union_spans, unsqueeze, with_marks, with_spans,
)

LENGTH = 50
GRAM = 20
SIDE = LENGTH - GRAM
#: A key: 50 bytes from the anchor on and their number, 30 bytes before it (reversed) and their number.
RIGHT, KEY = LENGTH + 1, LENGTH + 1 + SIDE + 1
GROUP_BYTES = 8 << 20
#: Suffixes a task holds before it sends its runs.
FLUSH = 400_000
#: Bytes of text per anchor, as a rule; the sketch is laid out for so many.
PER_ANCHOR = 16


class _Buffer:
    """The bytes of several documents, end to end."""

    def __init__(self, docs: list[tuple]):
        self.ids, self.tags = np.array([x[0] for x in docs], np.int64), np.array([x[2] for x in docs], np.int64)
        sizes = np.array([x[1] for x in docs], np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.bytes = np.frombuffer(b"".join(x[3] for x in docs), np.uint8)
        n = len(self.bytes)
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        self.gram = marks(self.bytes, GRAM)
        at = np.arange(max(0, n - LENGTH + 1))
        valid = self.start[self.doc[at] + 1] >= at + LENGTH
        _, anchor = anchored(self.gram, valid, LENGTH - GRAM + 1)
        self.at = np.flatnonzero(anchor)
        self.marks = [x[4] for x in docs]

    def anchors(self) -> Anchors:
        return self.ids, self.tags, np.bincount(self.doc[self.at], minlength=len(self.ids)), self.gram[self.at]

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchors estimated to repeat, are they hot)."""
        sizes = self.anchors()[2]
        seen = np.concatenate([read_marks(m, n) for m, n in zip(self.marks, sizes, strict=True)])
        return self.at[seen > 0], seen[seen > 0] > 1

    def keys(self, at: np.ndarray) -> np.ndarray:
        """Fixed-width keys of the suffixes at these positions (rows of KEY bytes)."""
        d = self.doc[at]
        right = np.minimum(self.start[d + 1] - at, LENGTH)
        left = np.minimum(at - self.start[d], SIDE)
        out = np.zeros((len(at), KEY), np.uint8)
        padded = np.concatenate((np.zeros(SIDE, np.uint8), self.bytes, np.zeros(LENGTH, np.uint8)))
        for i in range(LENGTH):
            out[:, i] = np.where(i < right, padded[at + SIDE + i], 0)
        for i in range(SIDE):
            out[:, RIGHT + i] = np.where(i < left, padded[at + SIDE - 1 - i], 0)
        out[:, LENGTH], out[:, KEY - 1] = right, left
        return out


def _buffered(batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[_Buffer]:
    def docs() -> Iterator[tuple]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("doc_id", "tag", "text")]
            for d, tag, t, m in zip(*columns, b.column("marks").to_pylist() if marked else columns[0], strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                if d is not None and m is not None and len(raw) >= LENGTH:
                    yield d, len(raw), tag, raw, m

    for part in buffers(docs()):
        yield _Buffer(part)


def front_code(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefix lengths of sorted keys, and what follows them, without zeros at the end."""
    same = keys[1:] == keys[:-1]
    shared = np.where(same.all(1), KEY, same.argmin(1)) if len(keys) > 1 else np.zeros(0, np.int64)
    shared = np.concatenate(([0], shared)).astype(np.uint8)
    return shared, keys[np.arange(KEY)[None, :] >= shared[:, None]].tobytes()


def decode(shared: np.ndarray, rest: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for n in shared.tolist():
        last = last[:n] + rest[at : at + KEY - n]
        at += KEY - n
        out.append(last)
    return out


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the prefix that a and b share, of which ``known`` bytes are known."""
    if a == b:
        return KEY
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return known + ((KEY - known) * 8 - x.bit_length()) // 8


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs (keys, prefix shared with the key before): (run, index, prefix shared with the last).

    The tree's inner nodes keep losers; ``share[r]`` is how much the head of run r
    shares with the winner that passed its node last.
    """
    k = 1
    while k < len(runs):
        k *= 2
    done = len(runs)
    head = [0] * k
    share = [0] * k
    key: list[bytes | None] = [runs[r][0][0] if r < done and runs[r][0] else None for r in range(k)]
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's share with the winner."""
        x, y = key[a], key[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        n = common(x, y, share[a])
        if n == KEY or x[n] < y[n]:
            share[b] = n
            return a, b
        share[a] = n
        return b, a

    winners = list(range(k))
    level = k
    while level > 1:
        up = []
        for i in range(0, level, 2):
            w, lost = play(winners[i], winners[i + 1])
            tree[(level + i) // 2] = lost
            up.append(w)
        winners, level = up, level // 2
    w = winners[0]
    while key[w] is not None:
        yield w, head[w], share[w]
        keys, lcps = runs[w]
        head[w] += 1
        if head[w] < len(keys):
            key[w], share[w] = keys[head[w]], lcps[head[w]]
        else:
            key[w] = None
        node = (w + k) // 2
        while node:
            w, tree[node] = play(w, tree[node])
            node //= 2


def _pack(shared: np.ndarray, rest: bytes, doc: np.ndarray, n_at: np.ndarray, tag: np.ndarray, at: np.ndarray) -> bytes:
    head = np.array([len(shared), len(rest), len(at)], np.uint32)
    return squeeze(head, doc.astype(np.int64), tag.astype(np.int64), n_at.astype(np.uint32), at.astype(np.int32), shared, rest)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """(shared, doc, n_at, tag, at, rest) as packed."""
    raw = unsqueeze(blob)
    n, m, k = np.frombuffer(raw, np.uint32, 3).tolist()
    out, to = [], 12
    for kind, size in ((np.int64, n), (np.int64, k), (np.uint32, n), (np.int32, k), (np.uint8, n)):
        out.append(np.frombuffer(raw, kind, size, to))
        to += out[-1].nbytes
    doc, tag, n_at, at, shared = out
    return shared, doc, n_at, tag, at, raw[to : to + m]


def _left_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of keys by the bytes before their anchors, prefix of these shared with the key before)."""
    left = np.ascontiguousarray(keys[:, RIGHT : KEY - 1])
    order = np.argsort(left.view(f"S{SIDE}").ravel(), kind="stable")
    same = left[order[1:]] == left[order[:-1]]
    return order, np.concatenate(([0], np.where(same.all(1), SIDE, same.argmin(1)))).astype(np.int64)


def decide(keys: np.ndarray, shared: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry has a repeat, bytes before the anchor, bytes after it) from merged keys and their shared prefixes.

    For an anchor at offset o of a 50-byte string, strings are equal if their
    suffixes share 50 - o bytes and their contexts o bytes.
    """
    n = len(keys)
    lo, hi = np.full(n, LENGTH), np.full(n, -1)
    right_n, left_n = keys[:, LENGTH], keys[:, KEY - 1]
    by_left, same_left = _left_order(keys)
    left = np.zeros(n, np.int64)
    for o in range(SIDE + 1):
        ok = np.flatnonzero((right_n >= LENGTH - o) & (left_n >= o))
        if len(ok) < 2:
            continue
        left[by_left] = np.cumsum(same_left < o)
        name = np.cumsum(shared < LENGTH - o)[ok] * (n + 1) + left[ok]
        order = np.lexsort((doc[ok], name))
        name, own = name[order], doc[ok][order]
        new = np.concatenate(([True], name[1:] != name[:-1]))
        least = own[np.flatnonzero(new)[np.cumsum(new) - 1]]
        hit = ok[order[own > least]]
        lo[hit] = np.minimum(lo[hit], o)
        hi[hit] = o
    return hi >= 0, hi, LENGTH - lo


def strings_around(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, offset, keys of the 50-byte strings) around the anchors of keys."""
    k, o = np.nonzero((keys[:, LENGTH, None] >= LENGTH - np.arange(SIDE + 1)) & (keys[:, KEY - 1, None] >= np.arange(SIDE + 1)))
    around = np.concatenate((keys[:, RIGHT : KEY - 1][:, ::-1], keys[:, :LENGTH]), axis=1)
    out = np.zeros((len(k), KEY), np.uint8)
    for i in range(LENGTH):
        out[:, i] = around[k, SIDE - o + i]
    out[:, LENGTH] = LENGTH
    return k, o, out


def _sorted(keys: np.ndarray, g: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{KEY}").ravel(), kind="stable")
    return order[np.lexsort((at[order], doc[order], _rank(keys[order]), g[order]))]


def runs_of(gram: np.ndarray, hot: np.ndarray, keys: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray, n_groups: int) -> Iterator[tuple[int, bool, bytes]]:
    """(group, False, run) of a task's suffixes, and (bucket, True, spans) of what is known to repeat already."""
    g = (gram % np.uint64(n_groups)).astype(np.int64)
    order = _sorted(keys, g, doc, at)
    g, hot, keys, doc, tag, at = (x[order] for x in (g, hot, keys, doc, tag, at))
    # equal keys: the smallest document's entry is sent, the others are repeats of it
    first = np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))
    late = doc != doc[np.flatnonzero(first)[np.cumsum(first) - 1]]
    before, after = keys[late, KEY - 1].astype(np.int64), keys[late, LENGTH].astype(np.int64)
    whole = before + after >= LENGTH
    where = at[late].astype(np.int64)
    known = packed(*by_document(doc[late][whole], tag[late][whole], np.stack((where - before, where + after), axis=1)[whole]), n_groups)
    for b, data in zip(known["b"], known["data"], strict=True):
        yield b, True, data
    if (own := hot & ~late).any():
        k, o, around = strings_around(keys[own])
        flat = around[:, :LENGTH].astype(np.uint64)
        name = np.zeros(len(k), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(LENGTH):
                name = name * np.uint64(0x9E3779B97F4A7C15) + flat[:, i] + np.uint64(1)
        yield from runs_of(name >> np.uint64(20), np.zeros(len(k), bool), around, doc[own][k], tag[own][k], (at[own][k] - o).astype(np.int32), n_groups)
    own = ~late & ~hot
    heads = np.flatnonzero(first & ~hot)
    n_at = np.bincount(np.cumsum(first)[own] - 1, minlength=int(first.sum()))[(np.cumsum(first) - 1)[heads]]
    tag, at = tag[own], at[own]
    offset = np.concatenate(([0], np.cumsum(n_at)))
    gh = g[heads]
    edge = np.flatnonzero(np.concatenate(([True], gh[1:] != gh[:-1], [True]))) if len(gh) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own = slice(offset[a], offset[b])
        shared, rest = front_code(keys[heads[a:b]])
        yield int(gh[a]), False, _pack(shared, rest, doc[heads[a:b]], n_at[a:b], tag[own], at[own])


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Of ``keyed`` rows: doc_id, tag, spans (packed int32 pairs), the byte ranges to remove; only documents that lose bytes."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(1, int(total // GROUP_BYTES))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[Anchors]:
        for b in _buffered(batches, False):
            yield b.anchors()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            g, local, data = zip(*runs_of(*(np.concatenate(x) for x in zip(*held, strict=True)), n_groups), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(local, pa.bool_()), pa.array(data, pa.binary())], names=["g", "local", "data"])

        held, n = [], 0
        for b in _buffered(batches, True):
            at, hot = b.repeated()
            if len(at):
                d = b.doc[at]
                held.append((b.gram[at], hot, b.keys(at), b.ids[d], b.tags[d], (at - b.start[d]).astype(np.int32)))
                n += len(at)
            if n >= FLUSH:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        local = rows["local"].to_numpy(bool)
        out = pd.DataFrame({"b": rows["g"][local], "data": rows["data"][local]})
        parts = [_unpack(x) for x in rows["data"][~local]]
        if parts:
            runs = [(decode(p[0], p[5]), p[0].tolist()) for p in parts]
            base = np.concatenate(([0], np.cumsum([len(p[1]) for p in parts])))
            n = int(base[-1])
            entry, shared = np.zeros(n, np.int64), np.zeros(n, np.uint8)
            keys = bytearray()
            for i, (r, at, share) in enumerate(merge_runs(runs)):
                entry[i], shared[i] = base[r] + at, share
                keys += runs[r][0][at]
            del runs
            _, doc, n_at, tag, at = (np.concatenate(x) for x in zip(*(p[:5] for p in parts), strict=True))
            hit, before, after = decide(np.frombuffer(bytes(keys), np.uint8).reshape(n, KEY), shared, doc[entry])
            span = np.zeros((n, 3), np.int64)
            span[entry] = np.stack((hit, before, after), axis=1)
            n_at = n_at.astype(np.int64)
            per = np.repeat(span, n_at, axis=0)
            on = per[:, 0] == 1
            at = at.astype(np.int64)
            spans = np.stack((at - per[:, 1], at + per[:, 2]), axis=1)[on]
            out = pd.concat([out, packed(*by_document(np.repeat(doc, n_at)[on], tag[on], spans), n_groups)])
        return out

    found = with_marks(rows, repeated_anchors(rows, anchors, total / PER_ANCHOR, once=True))
    sent = map_arrow(found, send, "g long, local boolean, data binary")
    return spans_by_document(sent.groupBy("g").applyInPandas(group, "b long, data binary"))


def _rank(keys: np.ndarray) -> np.ndarray:
    """Ranks of sorted keys; equal keys have one rank."""
    return np.cumsum(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                kept, at, gone = [], 0, 0
                spans = union_spans(s)
                for lo, hi in spans:
                    kept.append(raw[at:lo])
                    gone += hi - lo
                    at = hi
                out.append((len(raw), int(gone), len(spans), b"".join(kept) + raw[at:]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([x[3] for x in out], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    rows = keyed(docs)
    return map_arrow(with_spans(rows, repeated_spans(rows)), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """The contract on a dictionary of strings, for tests."""
    raws = [(d, (t or "").encode()) for d, t in docs]
    least: dict[bytes, int] = {}
    for d, raw in raws:
        for i in range(len(raw) - LENGTH + 1 if d is not None else 0):
            s = raw[i : i + LENGTH]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - LENGTH + 1 if d is not None else 0):
            if least[raw[i : i + LENGTH]] < d:
                gone[i : i + LENGTH] = True
        starts = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((d, len(raw), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out
