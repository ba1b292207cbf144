"""Near copies by the Jaccard similarity of their word shingles, for the pipeline.

Texts whose sets of five-word shingles have a similarity of ``LEAST`` = 0.8 or more
are linked, and of each connected group the smallest doc_id stays. Candidates
come from bands of least hashes (MinHash): ``BANDS`` bands of ``ROWS`` rows, so that a
pair at 0.8 meets in some band with probability 0.9998, and more similar pairs
are surer still. Every link is then checked exactly on the two sets.

Equal sets form one class. Each class is first compared with the
least class it shares a bucket with, which joins most groups at a cost linear in their size. Only
candidate groups that are still apart are compared in full, between the parts that aren't joined
yet; large ones are cut into parts that meet pairwise in tasks of their own.

Edge cases: texts without words form one class; fewer words than a shingle count
as one shingle; of rows that repeat a doc_id and a text one stays; rows without a doc_id stay.
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

from sluiceway.llm.common import counted_side, forget, map_arrow, one_of_each, text_tag, written
from sluiceway.llm.components import components, join_labels
from sluiceway.llm.simhash import words_of
from sluiceway.llm.sketch import marks, mixed

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 48, 8
#: Classes of a candidate group that are compared in one task; larger groups are cut.
PART = 1000
_rng = np.random.default_rng(10)
ODD = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    digest = xxhash.xxh3_64_intdigest
    x = np.array(list(map(digest, words_of(text))), np.uint64)
    return np.unique(marks(x, min(k, max(1, len(x)))))


def bands(s: np.ndarray) -> np.ndarray:
    """One key per band; none for the empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 256):
            np.minimum(least, (s[i : i + 256, None] * ODD + ADD).min(0), out=least)
        key = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def alike(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, least: float) -> np.ndarray | bool:
    return common >= least * (a + b - common) - 1e-9


def key_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, tag (of the text), key (of the shingle set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tag"), pa.array(list(map(key_of, sets)), pa.binary()), pa.array(list(map(bands, sets)), pa.list_(pa.int64()))],
                names=["doc_id", "tag", "key", "bands"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", text_tag().alias("tag"), "text"), run, f"doc_id {kind}, tag long, key binary, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """rep and set (packed hashes) of the classes in ``nodes`` (rep, key), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
            ok = pa.array([key_of(s) == x for s, x in zip(sets, b.column("key").to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([b.column("rep"), b.column("key"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "key", "set"])
            yield out.filter(ok)

    kind = dict(nodes.dtypes)["rep"]
    met = docs.select("doc_id", "text").join(nodes, F.col("doc_id") == F.col("rep")).select("rep", "key", "text")
    return map_arrow(met, run, f"rep {kind}, key binary, set binary").dropDuplicates(["rep", "key"]).select("rep", "set")


def link_apart(sets: list[np.ndarray], joined: np.ndarray, part: np.ndarray, across: bool, least: float) -> np.ndarray:
    """Labels after all links between sets that aren't joined yet (in different parts, if ``across``)."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = {}
    labels = np.array([first.setdefault(j, i) for i, j in enumerate(joined.tolist())])
    for i, s in enumerate(sets):
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        width = hi - lo
        at = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
        common = np.bincount(owner[at], minlength=n)
        near = alike(common, size, size[i], least) & (labels != labels[i])
        if across:
            near &= part != part[i]
        j = np.flatnonzero(near)
        join_labels(labels, np.full(len(j), i), j)
    return labels


def links(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Candidates (u, v) and sets (rep, set) to edges (u, v) whose components are those of all links."""
    kind = dict(sets.dtypes)["rep"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = sorted((len(x), len(y)))
                ok.append(small >= least * large - 1e-9 and bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least)))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    first = pairs.groupBy("u").agg(F.min("v").alias("v"))
    both = first.join(sets.select(F.col("rep").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("rep").alias("v"), F.col("set").alias("b")), "v")
    sure = written(map_arrow(both.select("u", "v", "a", "b"), check, f"u {kind}, v {kind}"))
    wide = components(pairs).withColumnRenamed("component", "c")
    tight = components(sure).select(F.col("node").alias("n"), F.col("component").alias("p"))
    placed = written(wide.join(tight, F.col("node") == F.col("n"), "left").select("node", "c", F.coalesce("p", "node").alias("p")))
    # candidate groups that are still in pieces
    open_ = counted_side(placed.groupBy("c").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("size")).where("lo != hi").select(F.col("c").alias("oc"), "size"))
    cut = (
        placed.join(open_, F.col("c") == F.col("oc")).join(sets, F.col("node") == F.col("rep"))
        .withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("c", F.least("part", "other").alias("pa"), F.greatest("part", "other").alias("pb"), "part", "rep", "p", "set")
    )

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rep = rows["rep"].to_numpy()
        across = rows["pa"].iloc[0] != rows["pb"].iloc[0]
        labels = link_apart([np.frombuffer(x, np.uint64) for x in rows["set"]], rows["p"].to_numpy(), rows["part"].to_numpy(), across, least)
        moved = np.flatnonzero(labels != np.arange(len(rep)))
        return pd.DataFrame({"u": rep[moved], "v": rep[labels[moved]]})

    more = cut.groupBy("c", "pa", "pb").applyInPandas(within, f"u {kind}, v {kind}")
    return sure.union(more)


def near_copies(docs: DataFrame, k: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """doc_id, tag and component_id (smallest doc_id reachable over links)."""
    rows = written(signed(docs, k))
    classes = written(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    dealt = classes.select("rep", F.explode("bands").alias("value"))
    least_of = dealt.groupBy("value").agg(F.min("rep").alias("v"), F.max("rep").alias("top")).where("v != top").drop("top")
    pairs = written(dealt.join(least_of, "value").where(F.col("rep") != F.col("v")).select(F.col("rep").alias("u"), "v").distinct())
    nodes = pairs.select(F.col("u").alias("rep")).union(pairs.select(F.col("v").alias("rep"))).distinct()
    nodes = counted_side(classes.select("rep", "key").join(nodes, "rep"))
    sets = written(sets_of(docs, nodes, k))
    edges = written(links(sets, pairs, least))
    found = components(edges).select(F.col("node"), F.col("component").alias("c"))
    forget(edges)
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("c", "rep").alias("component_id"))
    return rows.select("doc_id", "tag", "key").join(named, "key").select("doc_id", "tag", "component_id")


def drop_near_copies(docs: DataFrame, k: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Rows of ``docs`` but for near copies: per component, the smallest doc_id stays; see ``one_of_each``."""
    return one_of_each(docs, near_copies(docs, k, least))


def brute_force(docs: list[tuple[int, str | None]], k: int = SHINGLE, least: float = LEAST) -> dict[int, int]:
    """doc_id to component over all pairs, for tests."""
    sets = {}
    for d, t in docs:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
    group = {d: d for d in sets}

    def top(d: int) -> int:
        while group[d] != d:
            d = group[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            n = len(sets[a] & sets[b])
            if alike(n, len(sets[a]), len(sets[b]), least):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {d: top(d) for d in order}
