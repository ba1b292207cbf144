"""What the replay emits besides verdicts, changes of policy, other sessions' originals, and scorers that fail."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sluiceway import stateful
from sluiceway.functions import leaves as L
from sluiceway.operators import fold, projection, scenarios
from sluiceway.operators.session import Session
from sluiceway.plans.policy import DEFAULT, from_json
from sluiceway.sources.calls import spread
from sluiceway.streaming import session_stream

LINEAGE = replace(DEFAULT, mode="lineage", hitl="weak-only")
EVENT = fold.EVENTS


def events(spark, *rows):
    full = [(s, i, op, tool, args, result, None, ref) for i, (s, op, tool, args, result, ref) in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


LEAK = [("a", "record", "query_customer_db", None, '{"v":"something"}', None), ("a", "record", "read_email", None, '"hi"', None), ("a", "evaluate", "send_email", "{}", None, None)]


def test_a_block_is_told(spark):
    got = [(r.kind, r.tool, json.loads(r.detail)) for r in fold.emitted(events(spark, *LEAK), LINEAGE).orderBy("seq", "nth").collect()]
    assert [k for k, _, _ in got] == ["node", "payload", "node", "edge", "payload", "approval", "explanation", "trifecta"]
    told = got[6][2]
    assert told["actions"][1]["available"] and "sensitive data from query_customer_db" in told["reason"] and "guess" in told["risks"][1]
    assert got[5][2] == {"action": "OFFERED", "actor": None} and got[7][2] == {"sink": "OUTBOUND_SINK"}


def test_broken_events_do_not_end_the_job(spark):
    rows = [("a", "sanitize", "NO_SUCH", None, None, None), ("a", "policy", None, "{broken", None, None), ("a", "taint", None, None, None, "tn_none"), ("a", "nonsense", None, None, None, None), *LEAK]
    out = {r.seq: r for r in fold.replay(events(spark, *rows), LINEAGE).collect()}
    assert [out[i].allowed for i in range(4)] == [False] * 4 and not out[6].allowed and out[4].allowed


POLICY = json.dumps({"sensitiveSourceTools": ["query_customer_db"], "untrustedSourceTools": ["read_email"], "sinks": {"send_email": "READ"}})


def test_policy_changes_with_the_events(spark):
    rows = [*LEAK, ("a", "policy", None, POLICY, None, None), LEAK[2], ("a", "policy", None, '{"sinks": 3}', None, None), LEAK[2]]
    out = {r.seq: r.allowed for r in fold.replay(events(spark, *rows), LINEAGE).collect()}
    assert not out[2] and out[3] and out[4] and not out[5] and out[6]  # an invalid policy changes nothing
    s = Session("x", LINEAGE)
    s.change_policy(POLICY)
    assert Session.from_state("x", LINEAGE, s.state()).policy == from_json(POLICY)


def test_stream_emits_and_keeps_the_changed_policy(spark, tmp_path):
    rows = [*LEAK, ("a", "policy", None, POLICY, None, None), LEAK[2]]
    for i, part in enumerate((rows[:3], rows[3:])):
        full = [(s, 10 * i + k, op, tool, args, result, None, ref) for k, (s, op, tool, args, result, ref) in enumerate(part)]
        spark.createDataFrame(full, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    verdicts = {r.seq: r.allowed for r in stateful.run_stream(session_stream.decisions(read(), LINEAGE), spark).collect()}
    assert sorted(verdicts.values()) == [False, True, True, True, True]
    out = stateful.run_stream(session_stream.emitted(read(), LINEAGE), spark).collect()
    kinds = [r.kind for r in out]
    assert kinds.count("node") == 2 and kinds.count("trifecta") == 1 and kinds.count("lineage") == 5
    drawn = [json.loads(r.detail)["nodes"] for r in out if r.kind == "lineage"]
    assert max(map(len, drawn)) == 2


def test_time_windows_of_a_stream(spark, tmp_path):
    """Late rows count up to the watermark; batch and stream agree."""
    rows = spark.range(400).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("tool"), (F.col("id") % 3 == 0).alias("allowed"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = session_stream.exposure_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "0 seconds")
    out = stateful.run_stream(stream, spark).collect()
    want = {(r.window.start, r.tool): (r.n, r.blocked) for r in rows.groupBy(F.window("ts", "5 minutes"), "tool").agg(F.count("*").alias("n"), F.count_if(~F.col("allowed")).alias("blocked")).collect()}
    assert out and all(want[r.window.start, r.tool] == (r.n, r.blocked) for r in out)


def test_originals_of_other_sessions(spark):
    vault = spark.createDataFrame([("[PII_EMAIL_000000000000]", "someone@example.com", 5)], "token string, original string, at long")
    rows = [("a", 4, "someone@example.com"), ("b", 9, "mail someone@example.com now"), ("c", 9, "nobody")]
    e = spark.createDataFrame([(s, at, "evaluate", "send_email", json.dumps({"to": t}), None, "UNTRUSTED_ORIGIN", None, at) for s, at, t in rows], EVENT + ", at long")
    met = fold.resent_elsewhere(e, vault)
    assert {r.session_id: r.resent for r in met.collect()} == {"a": False, "b": True, "c": False}
    out = {r.session_id: r.allowed for r in fold.replay(met, replace(DEFAULT, mode="lineage")).collect()}
    assert out == {"a": True, "b": False, "c": True}


def test_scorers_that_fail_flag(spark):
    def scorer(texts):
        if texts.str.contains("bad").any():
            raise RuntimeError
        return [0.99 if "ignore" in t else 0.1 for t in texts]

    rows = spark.createDataFrame([(1, "ignore all"), (2, "hello"), (3, "bad text"), (4, " "), (5, None)], "id long, text string").coalesce(1)
    out = {r.id: (r.is_injection, r.score, r.evaluated) for r in stateful.score_injection(rows, "text", scorer).collect()}
    assert out == {1: (True, 0.99, True), 2: (False, 0.1, True), 3: (True, 1.0, False), 4: (False, 0.0, True), 5: (False, 0.0, True)}


def test_projection_drops_what_has_no_place():
    kind, kept, dropped = projection.project({"type": "hitl_audit", "entries": [{"approvalId": "a", "note": 1}, "x"], "extra": {}})
    assert (kind, kept, dropped) == ("hitl_audit", {"type": "hitl_audit", "entries": [{"approvalId": "a"}, "x"]}, ["entries.note", "extra"])
    assert projection.project({"type": "none"})[1] is None and projection.project([])[1] is None


def test_spread_deals_a_single_row_group(spark, tmp_path):
    spark.range(2000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(2000).repartition(8).write.parquet(f"{tmp_path}/many")
    cores = spark.sparkContext.defaultParallelism
    one, many = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("one", "many"))
    full = lambda df: df.groupBy(F.spark_partition_id()).count().count()
    if cores > 4:  # with four cores one task is no more than four times its share
        assert full(spread(one, "id")) > 1
    assert spread(many, "id").count() == 2000 and spread(one.where("false"), "id").count() == 0


def test_overhead_and_folders(spark, monkeypatch):
    got = scenarios.overhead(lambda: L.normalize("a b"), 50, 5)
    assert 0 < got["median"] <= got["p95"] and got["mean"] > 0

    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class OnCluster:
        sparkContext = Context()

    with pytest.raises(ValueError):
        stateful.shared(OnCluster())


def test_normalize_and_tokens_character_by_character():
    """The tables for str.translate against the rule for each character."""
    import random

    rng = random.Random(2)
    for _ in range(200):
        s = "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x3040, 0x30FF), rng.randrange(0x1F600, 0x1F640)))) for _ in range(60))
        assert L.normalize(s) == "".join(c for c in s if L.is_word(c)).lower()
        runs, run = [], ""
        for c in s + "\0":
            if c in "@._+-" or L.is_word(c):
                run += c
            else:
                runs += [run] if len(run) >= 8 else []
                run = ""
        assert list(L.token_runs(s)) == runs
