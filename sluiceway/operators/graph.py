"""Graph views over a session's lineage: depth, descendants, pruning.

Sessions are independent, so each is solved whole in one pass over its nodes and edges: one shuffle and one
sort bring them together, and a task streams through its sessions. Work is linear in a session's edges (for
descendants, in its edges times a bit per node); no path is enumerated, however many there are. Memory is bounded by the
largest session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway import at_hand

Rows = list[tuple]


def _solved(nodes: DataFrame, marked: str, edges: DataFrame, solve: Callable[[dict[int, bool], dict[int, list[int]]], Rows], schema: str) -> DataFrame:
    """``solve`` gets a session's nodes (seq to mark) and children (seq to seqs), and gives rows after session_id."""
    at_hand(nodes.sparkSession)
    none = F.lit(None)
    both = nodes.select("session_id", F.lit(0).alias("kind"), F.col("seq").cast("long").alias("a"), none.cast("long").alias("b"), F.expr(marked).alias("mark")).unionByName(
        edges.select("session_id", F.lit(1).alias("kind"), F.col("parent").cast("long").alias("a"), F.col("child").cast("long").alias("b"), none.cast("boolean").alias("mark"))
    )
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = None
        seen: dict[int, bool] = {}
        children: dict[int, list[int]] = {}
        out: Rows = []

        def close() -> None:
            if seen:
                out.extend((now, *r) for r in solve(seen, children))

        for rows in batches:
            for session, kind, a, b, mark in zip(rows["session_id"].tolist(), rows["kind"].tolist(), rows["a"].tolist(), rows["b"].tolist(), rows["mark"].tolist(), strict=True):
                if session != now:
                    close()
                    now, seen, children = session, {}, {}
                if not kind:
                    seen[a] = bool(mark)
                elif a in seen and int(b) in seen:
                    children.setdefault(a, []).append(int(b))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        close()
        yield pd.DataFrame(out, columns=columns)

    return both.repartition("session_id").sortWithinPartitions("session_id", "kind", "a", "b").mapInPandas(run, schema)


def in_order(nodes: dict[int, bool], children: dict[int, list[int]]) -> list[int]:
    """Nodes after their parents; nodes on or behind a cycle are left out."""
    waiting = dict.fromkeys(nodes, 0)
    for ends in children.values():
        for c in ends:
            waiting[c] += 1
    order = [n for n, k in waiting.items() if not k]
    for n in order:
        for c in children.get(n, ()):
            waiting[c] -= 1
            if not waiting[c]:
                order.append(c)
    return order


def longest_paths(nodes: dict[int, bool], children: dict[int, list[int]]) -> dict[int, int]:
    """Edges on the longest path from a root; edges between nodes on or behind a cycle count nothing."""
    depth = dict.fromkeys(nodes, 0)
    for n in in_order(nodes, children):
        for c in children.get(n, ()):
            depth[c] = max(depth[c], depth[n] + 1)
    return depth


def reached(nodes: dict[int, bool], children: dict[int, list[int]]) -> dict[int, int]:
    """For each marked node, a set of the nodes below it as the bits of a number; a node isn't below itself."""
    place = {n: i for i, n in enumerate(nodes)}
    below = dict.fromkeys(nodes, 0)
    todo = list(reversed(in_order(nodes, children)))
    rest = [n for n in nodes if n not in set(todo)] if len(todo) < len(nodes) else []
    moved = bool(rest)
    while moved:  # nodes on or behind a cycle, until nothing changes
        moved = False
        for n in rest:
            new = below[n]
            for c in children.get(n, ()):
                new |= below[c] | (1 << place[c])
            moved, below[n] = moved or new != below[n], new
    for n in todo:
        for c in children.get(n, ()):
            below[n] |= below[c] | (1 << place[c])
    return {n: below[n] & ~(1 << place[n]) for n, mark in nodes.items() if mark}


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest path from a root for each node."""
    kind = dict(nodes.dtypes)["session_id"]
    return _solved(nodes, "false", edges, lambda n, c: list(longest_paths(n, c).items()), f"session_id {kind}, seq long, depth int")


def descendants(starts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, start, node): all that a tag given late to a start would reach."""

    def pairs(n: dict[int, bool], c: dict[int, list[int]]) -> Rows:
        names = list(n)
        return [(start, names[i]) for start, bits in reached(n, c).items() for i in range(len(names)) if bits >> i & 1]

    kind = dict(nodes.dtypes)["session_id"]
    return _solved(_started(starts, nodes), "start", edges, pairs, f"session_id {kind}, start long, node long")


def descendant_counts(starts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, start, reached): how many nodes are below a start; starts without any are left out. No pair is emitted."""
    kind = dict(nodes.dtypes)["session_id"]
    count = lambda n, c: [(start, bits.bit_count()) for start, bits in reached(n, c).items() if bits]
    return _solved(_started(starts, nodes), "start", edges, count, f"session_id {kind}, start long, reached long")


def _started(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    on = starts.select("session_id", "seq").distinct().withColumn("start", F.lit(True))
    return nodes.select("session_id", "seq").join(on, ["session_id", "seq"], "left").withColumn("start", F.coalesce("start", F.lit(False)))


def prunable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without tags and without live children (one round of pruning)."""
    parents = edges.select("session_id", F.col("parent").alias("seq")).distinct()
    return nodes.where(F.size("tags") == 0).join(parents, ["session_id", "seq"], "left_anti").select("session_id", "seq")


def prune(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The fixpoint: nodes that have no tags and whose descendants have none."""

    def dead(n: dict[int, bool], children: dict[int, list[int]]) -> Rows:
        parents: dict[int, list[int]] = {}
        for p, ends in children.items():
            for c in ends:
                parents.setdefault(c, []).append(p)
        todo = [x for x, tagged in n.items() if tagged]
        alive = set(todo)
        while todo:
            for p in parents.get(todo.pop(), ()):
                if p not in alive:
                    alive.add(p)
                    todo.append(p)
        return [(x,) for x in n if x not in alive]

    kind = dict(nodes.dtypes)["session_id"]
    return _solved(nodes, "size(tags) > 0", edges, dead, f"session_id {kind}, seq long")
