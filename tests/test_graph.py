"""Graph views on sessions that paths can't be enumerated for, and against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from sluiceway.catalog import QUERIES
from sluiceway.operators import graph
from sluiceway.sources.calls import calls


def frames(spark, sessions):
    """sessions: id to (tags by node, edges)."""
    nodes = [(s, n, tags) for s, (own, _) in sessions.items() for n, tags in own.items()]
    edges = [(s, p, c) for s, (_, e) in sessions.items() for p, c in e]
    return spark.createDataFrame(nodes, "session_id long, seq long, tags array<string>"), spark.createDataFrame(edges, "session_id long, parent long, child long")


def test_long_chain_dense_graph_and_cycle(spark):
    chain = ({i: [] for i in range(10_000)} | {9_999: ["S"]}, [(i, i + 1) for i in range(9_999)])
    dense = ({i: ["U"] if i == 0 else [] for i in range(64)}, [(p, c) for p in range(64) for c in range(p + 1, 64)])
    cycle = ({1: [], 2: [], 3: [], 4: ["S"]}, [(1, 2), (2, 3), (3, 2), (3, 4)])
    nodes, edges = frames(spark, {1: chain, 2: dense, 3: cycle})
    depth = {(r.session_id, r.seq): r.depth for r in graph.depths(nodes, edges).collect()}
    assert all(depth[1, i] == i for i in range(10_000)) and all(depth[2, i] == i for i in range(64))
    assert [depth[3, i] for i in (1, 2, 3, 4)] == [0, 1, 0, 0]  # edges on and behind the cycle count nothing
    starts = nodes.where("(session_id = 1 AND seq % 1000 = 0) OR session_id > 1").select("session_id", "seq")
    reach = {(r.session_id, r.start): r.reached for r in graph.descendant_counts(starts, nodes, edges).collect()}
    assert reach[1, 0] == 9_999 and reach[1, 9_000] == 999 and reach[2, 0] == 63 and reach[2, 62] == 1 and (2, 63) not in reach
    assert reach[3, 1] == 3 and reach[3, 2] == 2 and reach[3, 3] == 2
    dead = {(r.session_id, r.seq) for r in graph.prune(nodes, edges).collect()}
    assert dead == {(2, i) for i in range(1, 64)}


def test_against_brute_force(spark):
    rng = random.Random(1)
    sessions = {}
    for s in range(40):
        n = rng.randrange(1, 9)
        sessions[s] = ({i: rng.choice(([], ["S"], ["U"])) for i in range(n)}, [e for e in itertools.combinations(range(n), 2) if rng.random() < 0.4])
    nodes, edges = frames(spark, sessions)
    depth = {(r.session_id, r.seq): r.depth for r in graph.depths(nodes, edges).collect()}
    pairs = {(r.session_id, r.start, r.node) for r in graph.descendants(nodes, nodes, edges).collect()}
    dead = {(r.session_id, r.seq) for r in graph.prune(nodes, edges).collect()}
    for s, (own, e) in sessions.items():
        def longest(n, e=e):
            return max((1 + longest(p) for p, c in e if c == n), default=0)

        def below(n, e=e):
            return {c for p, c in e if p == n}.union(*(below(c) for p, c in e if p == n))

        for n in own:
            assert depth[s, n] == longest(n)
            assert {x for a, b, x in pairs if (a, b) == (s, n)} == below(n)
            assert ((s, n) in dead) == (not own[n] and not any(own[x] for x in below(n)))


def test_sessions_of_two_users_never_meet(spark, tmp_path):
    """A user with 9,000 events has sessions of his or her own, whatever the next user's number."""
    rows = spark.range(9_020).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.when(F.col("id") < 9_000, 7).otherwise(8).cast("long").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    c = calls(spark, str(tmp_path))
    users = c.groupBy("session_id").agg(F.countDistinct("user_id").alias("n"), F.count("*").alias("calls"), F.countDistinct("seq").alias("seqs"))
    assert users.where("n > 1 OR calls <> seqs OR calls > 8").count() == 0 and users.count() == 1125 + 3


def test_reports_are_whole_or_raise(spark):
    import pytest

    from sluiceway import catalog
    from sluiceway.operators.reports import to_markdown

    with pytest.raises(ValueError):
        to_markdown(spark.range(20), 10)
    text = catalog.limits_report(spark, "/root/testdata/sf0.001")
    assert text.startswith("# Limits") and "축 1" in text and text.count("##") == 6
    assert "## 4. Leak forms" in catalog.extension_report(spark, "/root/testdata/sf0.001")
    assert QUERIES["axis_table"](spark, "/root/testdata/sf0.001").columns[0] == "bucket"
