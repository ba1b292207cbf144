"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Vectors are made unit length and projected on many random directions. Two
vectors collide in a projection if each lies in the window of ``width`` around
the other. For a pair at the wanted cosine the number of collisions is binomial,
so the count that nearly all such pairs reach is known; pairs that reach it are
verified by their cosine in double precision.

Windows of a fixed width hold a fixed share of all vectors, so counting within
all of them would be quadratic. Therefore vectors are first dealt, in several
rounds, into cells by the sides they take of a few random cuts through the origin,
and collisions are counted within cells. A pair's chance to be on one side of such a cut depends on its angle
alone, so it holds for off-centre and clustered vectors too; their cells are uneven. As
vectors of a cluster lie alike to each cut, rounds are added until the sampled vectors that
the drawn cuts serve worst reach the recall as well. Rounds are added until a pair at the wanted cosine
meets in some cell with probability ``RECALL``. A pair that meets more than
once is counted in its first round only. Very large cells are cut into parts that
meet pairwise in tasks of their own, so no task grows with a cell.

Equal vectors form one class and are compared once. Cells emit a spanning forest
of their links and each vector's number of links, never the pairs.

Edge cases: a vector that is null, empty, zero or holds null or non-finite
components links with nothing; vectors of different lengths don't link; repeated
rows are different vectors that are equal; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import counted_side, map_arrow, written
from sluiceway.llm.components import components, join_labels

RECALL = 0.995
PROJECTIONS = 24
#: Vectors wanted in a cell; cells above PART are cut.
CELL, PART = 500, 6000
#: Vectors sampled to choose the number of cuts (documented bound); links don't depend on it.
SAMPLE = 20_000
BLOCK = 256
#: Sampled vectors for which the recall of the drawn cuts is calculated.
CALIBRATED = 1000


def doubles(column: pa.Array) -> list[np.ndarray | None]:
    """Finite non-zero vectors as doubles; None for those that link with nothing."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # a null component becomes NaN
    offsets, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for a, b, ok in zip(offsets[:-1], offsets[1:], there, strict=True):
        x = values[a:b]
        out.append(x if ok and len(x) and np.isfinite(x).all() and x.any() else None)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, exactly, so that their norms neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, key (of the exact vector, null if it links with nothing), v (the vector as it is)."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = doubles(b.column("v"))
            keys = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in xs]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), b.column("v")], names=["vec_id", "key", "v"])

    return map_arrow(vectors.select("vec_id", F.col("embedding").cast(kind).alias("v")), run, f"vec_id long, key binary, v {kind}")


def layout(n: int, sample: np.ndarray, same: float) -> tuple[int, int]:
    """(sides, rounds) with the fewest comparisons, as estimated from the angles of sampled vectors."""
    half = len(sample) // 2
    angles = np.arccos(np.clip(np.einsum("ij,ij->i", sample[:half], sample[half : 2 * half]), -1, 1)) if half else np.array([math.pi / 2])
    best, out = math.inf, (0, 1)
    for sides in range(max(0, math.ceil(math.log2(max(n, 1) / CELL))) + 1):
        meet = same**sides
        rounds = 1 if meet >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - meet))
        cost = rounds * max(CELL, n * float(np.mean((1 - angles / math.pi) ** sides)))
        if cost < best:
            best, out = cost, (sides, rounds)
    return out


def missed(x: np.ndarray, cuts: np.ndarray, sides: int, cosine: float) -> np.ndarray:
    """How likely a partner at the cosine, in any direction, meets each unit vector in no round of these cuts."""
    g = cuts / np.linalg.norm(cuts, axis=0)
    t = np.abs(x @ g)
    z = cosine * t / np.sqrt(np.maximum((1 - cosine**2) * (1 - t**2) / max(1, len(g) - 1), 1e-12))
    same = 0.5 + 0.5 * np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2))
    return np.prod(1 - np.prod(same.reshape(len(x), -1, sides), axis=2), axis=1)


def worst(miss: np.ndarray) -> float:
    """Mean of the worst tenth: vectors of a dense cluster lie alike to the cuts and miss together."""
    return float(np.mean(np.sort(miss)[-max(1, len(miss) // 10) :]))


class Plan:
    """Directions, cuts, rounds and the collision count for vectors of one length."""

    def __init__(self, dim: int, n: int, sample: np.ndarray, cosine: float):
        rng = np.random.default_rng(dim)
        same = 1 - math.acos(cosine) / math.pi  # that such a pair is on one side of a cut, wherever the vectors lie
        self.sides, self.rounds = layout(n, sample, same)
        self.cuts = rng.normal(size=(dim, max(1, self.rounds * self.sides)))
        while self.sides and len(sample) and worst(missed(sample[:CALIBRATED], self.cuts, self.sides, cosine)) > 1 - RECALL:
            self.cuts = np.hstack((self.cuts, rng.normal(size=(dim, self.sides))))
            self.rounds += 1
        self.directions = rng.normal(size=(dim, PROJECTIONS))
        near = math.sqrt(2 - 2 * cosine)
        self.width = 2.3 * near
        p = math.erf(2.3 / math.sqrt(2))
        tail, self.count = 0.0, 0
        for k in range(PROJECTIONS + 1):  # the largest count that such a pair misses with 0.1 % at most
            tail += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
            if tail > 0.001:
                self.count = k
                break

    def cells(self, x: np.ndarray, rounds: int | None = None) -> np.ndarray:
        """Cell of each unit vector in each of the first rounds (default: all)."""
        rounds = self.rounds if rounds is None else rounds
        if not self.sides:
            return np.zeros((len(x), rounds), np.int64)
        bits = (x @ self.cuts[:, : rounds * self.sides] > 0).reshape(len(x), rounds, self.sides)
        return bits @ (1 << np.arange(self.sides, dtype=np.int64))


def near_in_cell(x: np.ndarray, weight: np.ndarray, part: np.ndarray, parts: tuple[int, int], round_: int, plan: Plan, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each vector that are first met here, labels of linked vectors).

    Collisions are counted for every pair of the cell (or of its two parts): a
    pair that reaches the count is in the window of any PROJECTIONS - count + 1
    projections at least once, and the windows of so many hold nearly all pairs.
    """
    n = len(x)
    x = scaled(x)
    norm = np.linalg.norm(x, axis=1)
    p = ((x / norm[:, None]) @ plan.directions).astype(np.float32)
    degree, labels = np.zeros(n, np.int64), np.arange(n)
    across = parts[0] != parts[1]
    left = np.flatnonzero(part == parts[0]) if across else np.arange(n)
    right = np.flatnonzero(part == parts[1]) if across else left
    pl, pr = p[left].T.copy(), p[right].T.copy()
    for a in range(0, len(left), BLOCK):
        lo = 0 if across else a  # each pair once
        b = min(a + BLOCK, len(left))
        count = np.zeros((b - a, len(right) - lo), np.uint8)
        for k in range(PROJECTIONS):
            count += np.abs(pl[k, a:b, None] - pr[k, None, lo:]) <= plan.width
        i, j = np.nonzero(count >= plan.count)
        i, j = i + a, j + lo
        if not across:
            i, j = i[i < j], j[i < j]
        i, j = left[i], right[j]
        for s in range(0, len(i), 200_000):
            u, v = i[s : s + 200_000], j[s : s + 200_000]
            good = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= cosine
            u, v = u[good], v[good]
            join_labels(labels, u, v)
            if round_ and len(u):  # cells of earlier rounds, of linked vectors only
                own, at = np.unique(np.concatenate((u, v)), return_inverse=True)
                cells = plan.cells(x[own] / norm[own, None], round_)
                new = ~(cells[at[: len(u)]] == cells[at[len(u) :]]).any(1)
                u, v = u[new], v[new]
            degree += (np.bincount(u, weight[v], n) + np.bincount(v, weight[u], n)).astype(np.int64)
    return degree, labels


def find_links(classes: DataFrame, cosine: float) -> DataFrame:
    """classes (rep, n, v) to rows (u, v, links): edges (v set) and numbers of linked vectors (v null)."""
    spark = classes.sparkSession
    dims = {r[0]: r[1] for r in classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count")).collect()}
    share = min(1.0, SAMPLE / max(1, sum(dims.values())))
    drawn = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20)))
    picked = drawn.orderBy(F.xxhash64("rep"), "rep").select("v").limit(2 * SAMPLE).collect()
    plans = {}
    for d, n in dims.items():
        s = [r[0] for r in picked if len(r[0]) == d]
        plans[d] = Plan(d, n, unit(np.array(s, np.float64)) if s else np.zeros((0, d)), cosine)
    shared = spark.sparkContext.broadcast(plans)
    kind = dict(classes.dtypes)["v"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            values, offsets = v.values.to_numpy(zero_copy_only=False).astype(np.float64), v.offsets.to_numpy()
            size = np.diff(offsets)
            cells: list[list[int]] = [[]] * len(size)
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                x = values[offsets[own][:, None] + np.arange(d)]
                for i, c in zip(own.tolist(), shared.value[d].cells(unit(x)).tolist(), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "n", "v")), pa.array(cells, pa.list_(pa.int64()))], names=["rep", "n", "v", "cells"])

    dealt = classes.mapInArrow(deal, f"rep long, n long, v {kind}, cells array<long>")
    dealt = dealt.select("rep", "n", "v", F.size("v").alias("dim"), F.posexplode("cells").alias("round", "cell"))
    big = counted_side(dealt.groupBy("dim", "round", "cell").count().where(F.col("count") > PART))
    cut = (
        dealt.join(big, ["dim", "round", "cell"], "left")
        .withColumn("parts", F.coalesce(F.ceil(F.col("count") / PART), F.lit(1)).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("pa", F.least("part", "other")).withColumn("pb", F.greatest("part", "other"))
        .select("dim", "round", "cell", "pa", "pb", "part", "rep", "n", "v")
    )

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        x, rep = np.stack(rows["v"].to_numpy()).astype(np.float64), rows["rep"].to_numpy(np.int64)
        plan = shared.value[x.shape[1]]
        parts = (int(first["pa"]), int(first["pb"]))
        degree, labels = near_in_cell(x, rows["n"].to_numpy(np.int64), rows["part"].to_numpy(), parts, int(first["round"]), plan, cosine)
        moved, linked = np.flatnonzero(labels != np.arange(len(x))), np.flatnonzero(degree)
        return pd.DataFrame({
            "u": np.concatenate((rep[moved], rep[linked])),
            "v": pd.array([*rep[labels[moved]].tolist(), *[None] * len(linked)], dtype="Int64"),
            "links": np.concatenate((np.zeros(len(moved), np.int64), degree[linked])),
        })

    return cut.groupBy("dim", "round", "cell", "pa", "pb").applyInPandas(within, "u long, v long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = written(keyed(vectors))
    classes = written(rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    found = written(find_links(classes.select("rep", "n", "v"), cosine))
    joined = components(found.where(F.col("v").isNotNull()).select("u", "v"))
    links = found.where(F.col("v").isNull()).groupBy(F.col("u").alias("lu")).agg(F.sum("links").alias("links"))
    facts = (
        classes.select("key", "rep", "n")
        .join(links, F.col("rep") == F.col("lu"), "left").join(joined, F.col("rep") == F.col("node"), "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    )
    out = rows.select("vec_id", "key").join(facts, "key", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def brute_force(rows: list[tuple[int, list | None]], cosine: float = 0.9) -> dict[int, tuple[int, int]]:
    """vec_id to (links, component) over all pairs, for tests."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    group = {i: i for i, _ in rows}
    degree = dict.fromkeys(group, 0)

    def top(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                degree[i] += 1
                degree[j] += 1
                lo, hi = sorted((top(i), top(j)))
                group[hi] = lo
    return {i: (degree[i], top(i)) for i in group}
