"""Connected components of a large edge table.

Tasks first replace their edges by a spanning forest of them, without a shuffle. Up to ``ONE_TASK`` edges are then
joined by one task (16 bytes an edge). More than that go on in rounds of large-star and small-star,
spread over all tasks; each round writes its edges into the shared folder, so that lineage stays short
and a lost executor costs one round. Nothing but counts and sums reaches the driver.

Callers whose edges come out of Python write them first: two Python steps in one stage hold two workers for each core, and
an executor keeps as many workers as ever ran at once.

Rounds are for what one task can't hold: each has some ten jobs of as many tasks as there are shuffle partitions, and a driver
pays for every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import forget, written

MAX_ROUNDS = 60
#: Edges that one task joins, and edges that a task holds at once while it makes a forest.
ONE_TASK = 2_000_000
AT_ONCE = 1_000_000


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the labels of a and b in place; labels point to the least index of a group."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def star(batches: list[pa.RecordBatch], names: list[str], least_too: bool) -> pa.RecordBatch:
    """Edges (u, v) to rows of a node and the least node it reaches by them; of the least ones too, if wanted."""
    u, v = (pa.concat_arrays([b.column(n) for b in batches]) for n in ("u", "v"))
    nodes = pc.unique(pa.concat_arrays([u, v]))
    nodes = nodes.take(pc.array_sort_indices(nodes))
    a, b = (pc.index_in(x, nodes).to_numpy(zero_copy_only=False) for x in (u, v))
    labels = np.arange(len(nodes))
    join_labels(labels, a, b)
    rows = np.arange(len(nodes)) if least_too else np.flatnonzero(labels != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(rows)), nodes.take(pa.array(labels[rows]))], names=names)


def _forest(edges: DataFrame) -> DataFrame:
    """Edges with the same components: at most one per node and chunk of a task, towards smaller nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > AT_ONCE:
                yield star(held, ["u", "v"], False)
                held, n = [], 0
        if n:
            yield star(held, ["u", "v"], False)

    return edges.mapInArrow(run, edges.schema)


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = dict(edges.dtypes)["u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if any(b.num_rows for b in held):
            yield star(held, ["node", "component"], True)

    return edges.repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


def _with_least(directed: DataFrame) -> DataFrame:
    """(u, v) plus m, the least of u and its v; sums before the shuffle, joins that can split a hub."""
    least = directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return directed.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    x = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return x.where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    x = _with_least(down)
    star = x.select(F.col("v").alias("u"), F.col("m").alias("v")).union(x.select("u", F.col("m").alias("v")))
    return star.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) to (node, component): the least node reachable; only nodes that have edges."""
    now = written(_forest(edges.select("u", "v").where(F.col("u") != F.col("v"))))
    if now.count() <= ONE_TASK:
        done = written(_in_one_task(now))
        forget(now)
        return done
    mark = None
    for _ in range(MAX_ROUNDS):
        last, now = now, written(_small_star(_large_star(now)))
        forget(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    # now every edge goes from a node to the least node of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
