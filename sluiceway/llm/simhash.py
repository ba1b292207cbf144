"""SimHash near-duplicates through vantage-point trees.

A text's fingerprint takes one majority vote per bit over the XXH64 hashes of
its word shingles (repeats included). Equal fingerprints form one class, kept
under its smallest doc_id. Classes within ``RADIUS`` = 2 bits are linked.

Two fingerprints that differ in at most two bits differ in at most one bit in
their upper or in their lower half. So there is one vantage-point tree for each
half, over the Hamming distance of 32 bits with radius 1: half the radius lets
the triangle bounds prune far better than one tree over 64 bits, and no pair is
lost. A tree is built on the driver from a bounded sample of fingerprints: a node has a
vantage point and the median distance to it. Every class lives in one leaf
(shard), and queries each leaf it may have a partner in: where the distance is
within the radius of the boundary, both branches are taken. Within a leaf the same rule goes on
until few enough are left, and these are compared exactly over all 64 bits.
A leaf emits a spanning forest of its links, never all pairs.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like
any other; fewer words than a shingle count as one shingle; rows that repeat or
share a doc_id fall into one class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import forget, map_arrow, one_of_each, text_tag, uniform, written
from sluiceway.llm.components import components, join_labels

RADIUS = 2
#: Fingerprints sampled to build the trees (8 bytes each on the driver), and their largest share of all.
SAMPLE = 200_000
SHARE = 1 / 8
#: Classes wanted in a leaf, and pairs that are compared at once. Fewer leaves have fewer borders, where classes go to both
#: sides; within a leaf the search goes on by further vantage points.
LEAF = 4000
PAIRS = 1 << 21


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 with A-Z in lower case; bytes.lower() and bytes.split() do exactly that much."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, k: int) -> list[bytes]:
    words = words_of(text)
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def fingerprint(text: str | None, k: int = 3) -> int:
    """Unsigned 64-bit SimHash; zero without words."""
    s = shingles(text, k)
    if not s:
        return 0
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(s), 8192):
        h = np.fromiter((digest(x, 42) for x in s[at : at + 8192]), np.uint64)
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(s)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, tag (of the text) and fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array(fp, pa.int64())], names=["doc_id", "tag", "fp"])

    return map_arrow(docs.select("doc_id", text_tag().alias("tag"), "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, tag long, fp long")


# -- vantage-point trees over halves of 32 bits


def half(fp: np.ndarray, upper: bool) -> np.ndarray:
    return ((fp.view(np.uint64) >> np.uint64(32 if upper else 0)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def cut(distance: np.ndarray) -> int:
    """The inner branch's largest distance: near the median, where both branches have points."""
    counts = np.bincount(distance, minlength=33)
    inner = np.cumsum(counts)
    return int(np.argmin(np.abs(inner[:-1] - len(distance) / 2)))


def build(points: np.ndarray, leaf: int, rng: np.random.Generator) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, cut, inner child, outer child); a child below zero is leaf -child - 1."""
    nodes: list[list[int]] = []
    leaves = 0
    todo: list[tuple[np.ndarray, int, int]] = [(points, -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        me = None
        if len(own) > leaf:
            v = int(own[rng.integers(len(own))])
            d = np.bitwise_count(own ^ np.uint32(v))
            c = cut(d)
            inner = d <= c
            if inner.any() and not inner.all():
                me = len(nodes)
                nodes.append([v, c, 0, 0])
                todo += [(own[inner], me, 2), (own[~inner], me, 3)]
        if me is None:
            leaves += 1
            me = -leaves
        if parent >= 0:
            nodes[parent][side] = me
    return [tuple(n) for n in nodes]


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of point, leaf, is it the point's own leaf) for all leaves that the triangle bound leaves."""
    at, leaf, home = [], [], []
    start = 0 if nodes else -1
    todo = [(start, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, idx, own = todo.pop()
        if not len(idx):
            continue
        if node < 0:
            at.append(idx)
            leaf.append(np.full(len(idx), -node - 1, np.int32))
            home.append(own)
            continue
        v, c, inner, outer = nodes[node]
        d = np.bitwise_count(points[idx] ^ np.uint32(v)).astype(np.int16)
        a, b = d <= c + 1, d > c - 1
        todo += [(inner, idx[a], own[a] & (d[a] <= c)), (outer, idx[b], own[b] & (d[b] > c))]
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return np.concatenate(at), np.concatenate(leaf), np.concatenate(home)


def link_leaf(fp: np.ndarray, home: np.ndarray, upper: bool, labels: np.ndarray, rng: np.random.Generator) -> None:
    """Link all pairs within RADIUS of which one is at home here, by further vantage points."""
    h = half(fp, upper)
    bits = fp.view(np.uint64)
    todo = [(np.flatnonzero(home), np.arange(len(fp)), 0)]
    while todo:
        own, seen, stuck = todo.pop()
        if not len(own):
            continue
        if len(own) * len(seen) > PAIRS and stuck < 3:
            d_own = np.bitwise_count(h[own] ^ (v := h[own[rng.integers(len(own))]])).astype(np.int16)
            d = np.bitwise_count(h[seen] ^ v).astype(np.int16)
            c = cut(d_own)
            parts = ((own[d_own <= c], seen[d <= c + 1]), (own[d_own > c], seen[d > c - 1]))
            size = sum(len(x) * len(y) for x, y in parts)
            worse = stuck + 1 if size > 0.8 * len(own) * len(seen) else 0
            if parts[0][0].size and parts[1][0].size:
                todo += [(x, y, worse) for x, y in parts]
                continue
        step = max(1, PAIRS // len(seen))
        for i in range(0, len(own), step):
            mine = own[i : i + step]
            near = np.bitwise_count(bits[mine][:, None] ^ bits[seen][None, :]) <= RADIUS
            near &= labels[mine][:, None] != labels[seen][None, :]
            a, b = np.nonzero(near)
            join_labels(labels, mine[a], seen[b])


def links(classes: DataFrame) -> DataFrame:
    """classes (rep, fp) to edges (u, v) between reps: a spanning forest per leaf."""
    n = classes.count()
    rate = min(SAMPLE, n * SHARE) / max(n, 1)
    sample = classes.select("fp").where(uniform("fp") < rate).orderBy(F.xxhash64("fp"), "fp").limit(2 * SAMPLE)
    points = np.array([r[0] for r in sample.collect()], np.int64)
    rng = np.random.default_rng(5)
    leaf = max(LEAF * len(points) // max(n, 1), 8)
    trees = [build(half(points, upper), leaf, rng) if len(points) else [] for upper in (True, False)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, fp = b.column("rep"), b.column("fp").to_numpy(zero_copy_only=False)
            for t, nodes in enumerate(trees):
                at, where, home = route(half(fp, t == 0), nodes)
                for i in range(0, len(at), 50_000):
                    s = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [rep.take(pa.array(at[s])), pa.array(fp[at[s]]), pa.array(where[s] * 2 + t, pa.int32()), pa.array(home[s])],
                        names=["rep", "fp", "leaf", "home"],
                    )

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        fp, rep = rows["fp"].to_numpy(np.int64), rows["rep"].to_numpy()
        labels = np.arange(len(fp))
        link_leaf(fp, rows["home"].to_numpy(bool), rows["leaf"].iloc[0] % 2 == 0, labels, np.random.default_rng(7))
        moved = np.flatnonzero(labels != np.arange(len(fp)))
        return pd.DataFrame({"u": rep[moved], "v": rep[labels[moved]]})

    kind = dict(classes.dtypes)["rep"]
    dealt = classes.select("rep", "fp").mapInArrow(deal, f"rep {kind}, fp long, leaf int, home boolean")
    return dealt.groupBy("leaf").applyInPandas(within, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, tag, fp (signed long), component_id (smallest doc_id reachable over links)."""
    marked = written(fingerprints(docs, k))
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = written(links(classes))
    found = components(edges).withColumnRenamed("component", "c")
    forget(edges)
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("c", "rep").alias("component_id"))
    return marked.join(named, "fp")


def brute_force(docs: list[tuple[int, str | None]], k: int = 3) -> dict[int, tuple[str, int]]:
    """Fingerprints bit by bit and components over all pairs, for tests."""
    fps = {}
    for doc, text in docs:
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)]
        fps[doc] = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    group = {d: d for d in fps}

    def top(d: int) -> int:
        while group[d] != d:
            d = group[d]
        return d

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= RADIUS:
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {d: (f"{fps[d]:016x}", top(d)) for d in order}


def drop_near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """Rows of ``docs`` but for near copies: per component the smallest doc_id stays; see ``one_of_each``."""
    return one_of_each(docs, near_duplicates(docs, k).select("doc_id", "tag", "component_id"))
