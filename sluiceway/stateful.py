"""Queries that replay sessions, decode and tokenize: few have a SQL form; tests check the others against fixtures and each other."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import replace
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway import at_hand
from sluiceway.functions import leaves as L
from sluiceway.operators import audit, fold, scenarios
from sluiceway.operators.classify import flagged, verdicts
from sluiceway.plans.policy import DEFAULT
from sluiceway.replays import VERDICT_SQL
from sluiceway.sources import audit_log
from sluiceway.sources.calls import calls, table
from sluiceway.streaming import session_stream

LINEAGE = replace(DEFAULT, mode="lineage", hitl="weak-only", destructive_policy="hitl", pruning="declassified")


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call log as replay events: each call is judged with a document as its argument, then its result is recorded.

    Every sixth event is followed by an approval, every ninth by a tokenization.
    """
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    text = docs.select(F.col("doc_id").alias("k"), F.to_json(F.struct("text")).alias("json"))
    c = calls(spark, sf_dir).select("session_id", "seq", "event_id", "tool")
    c = c.join(text.select(F.col("k"), F.col("json").alias("args")), (F.col("event_id") * 31 + 7) % n == F.col("k")).drop("k")
    c = c.join(text.select(F.col("k"), F.col("json").alias("result")), F.col("event_id") % n == F.col("k")).drop("k")
    none = F.lit(None).cast("string")
    row = lambda at, op, tool, args, result: F.struct(
        F.lit(at).cast("long").alias("at"), F.lit(op).alias("op"), tool.alias("tool"), args.alias("args"), result.alias("result")
    )
    steps = F.array_compact(F.array(
        row(0, "evaluate", F.col("tool"), F.col("args"), none),
        F.when(F.col("event_id") % 6 == 0, row(1, "approve", none, none, none)),
        F.when(F.col("event_id") % 6 == 0, row(2, "evaluate", F.col("tool"), F.col("args"), none)),
        row(3, "record", F.col("tool"), F.col("args"), F.col("result")),
        F.when(F.col("event_id") % 9 == 0, row(4, "sanitize", F.lit("TOKENIZATION"), none, none)),
    ))
    e = c.select(F.col("session_id").cast("string").alias("session_id"), "seq", F.explode(steps).alias("s"))
    return e.select("session_id", (F.col("seq") * 8 + F.col("s.at")).alias("seq"), "s.op", "s.tool", "s.args", "s.result", none.alias("arg_tags"), none.alias("ref"))


def lineage_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold.replay(session_events(spark, sf_dir), LINEAGE)
    return out.where(F.col("op") == "evaluate").select("session_id", "seq", "tool", "allowed", "matched_tags", "link_method", "evidence", "weak_only", "can_override", "scan_kind", "scan_transform")


def hitl_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold.replay(session_events(spark, sf_dir), LINEAGE)
    return out.where(F.col("op").isin("approve", "evaluate")).select("session_id", "seq", "op", "allowed", "reason", "can_override", "approval_id")


def sanitize_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold.replay(session_events(spark, sf_dir), LINEAGE)
    return out.where(F.col("op") == "sanitize").select("session_id", "seq", "allowed", "reason", "tags", "exposed")


def tokenize_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for rows in batches:
            found = [L.tokenize(t, DEFAULT) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "ok": [f[0] for f in found], "n_tokens": [len(f[2]) for f in found], "text": [f[1] for f in found]})

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, ok boolean, n_tokens long, text string")


def mask_pii_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"conv_id": rows["conv_id"], "turn": rows["turn"], "text": [L.redact_deep(t) for t in rows["text"]]})

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").mapInPandas(run, "conv_id long, turn long, text string")


def output_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, in one of six disguises, scanned for a benchmark passage that it may hold."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n = items.count()
    plain = F.col("text")
    binary = plain.cast("binary")
    forms = [plain, F.regexp_replace(F.base64(binary), r"\s", ""), F.lower(F.hex(binary)), F.url_encode(plain), F.reverse(plain), F.regexp_replace(plain, "(.)", "$1 ")]
    form = F.col("doc_id") % len(forms)
    secret = items.select(F.col("item_id").alias("k"), F.to_json(F.struct("text")).alias("payload"), F.array(*forms).alias("disguised"))
    pairs = docs.join(secret, F.col("doc_id") % n == F.col("k")).select(
        "doc_id", F.lit("query_customer_db").alias("tool"), F.when(F.col("doc_id") % 2 == 0, "source").otherwise("content").alias("origin"),
        F.to_json(F.struct(F.col("text").alias("body"), F.element_at("disguised", (form + 1).cast("int")).alias("note"))).alias("args"), "payload",
    )
    return fold.scan_calls(pairs, DEFAULT)


def vault_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.vault_entries(table(spark, sf_dir, "documents").select(F.col("text").alias("result"), F.col("doc_id").alias("at")), DEFAULT)


def injection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer hook with no model at hand: flagged, not evaluated; empty text scores 0."""
    return score_injection(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")


def score_injection(rows: DataFrame, text: str, scorer=None, threshold: float = 0.95) -> DataFrame:
    """Adds is_injection, score, evaluated. ``scorer`` maps texts (cut to 2,000 characters) to scores in Arrow batches."""
    if scorer is None:
        empty = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
        return rows.select("*", (~empty).alias("is_injection"), F.when(empty, 0.0).otherwise(1.0).alias("score"), empty.alias("evaluated"))

    def scored(texts: pd.Series) -> pd.Series:
        """Scores of a batch; where the scorer fails on it, each text alone; null where it fails on that. Blank texts score 0."""
        full = texts[texts.str.strip() != ""].str.slice(0, 2000)
        out = pd.Series(0.0, index=texts.index)
        try:
            out[full.index] = list(scorer(full))
        except Exception:  # noqa: BLE001
            for i, t in full.items():
                try:
                    out[i] = float(next(iter(scorer(pd.Series([t])))))
                except Exception:  # noqa: BLE001
                    out[i] = None
        return out

    found = rows.withColumn("_score", F.pandas_udf(scored, "double")(F.coalesce(text, F.lit(""))))
    failed = F.col("_score").isNull() | F.isnan("_score")  # what can't be judged is flagged
    return found.select("*", (failed | (F.col("_score") > threshold)).alias("is_injection"), F.when(failed, 1.0).otherwise(F.col("_score")).alias("score"), (~failed).alias("evaluated")).drop("_score")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where spark.checkpoint.dir is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sluiceway-")
        sc.setCheckpointDir(path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path.rstrip("/")


def kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table written into the shared checkpoint folder, and read again."""
    path = f"{shared(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_stream(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet under the shared checkpoint folder, and read that."""
    path = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def stream_session_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by keyed state over the events table read as a stream."""
    events = table(spark, sf_dir, "events")
    whole = any(f.endswith("/events.parquet") for f in events.inputFiles())  # one file, or a folder of part files
    where, only = (sf_dir, "events.parquet") if whole else (f"{sf_dir}/events.parquet", "*.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", only).parquet(where)
    tool = F.element_at(F.create_map(*(F.lit(x) for kv in TOOLS.items() for x in kv)), F.col("event_type"))
    none = F.lit(None).cast("string")
    event = lambda at, op: F.struct(F.lit(at).alias("at"), F.lit(op).alias("op"))
    e = stream.select("user_id", "event_id", tool.alias("tool"), F.explode(F.array(event(0, "evaluate"), event(1, "record"))).alias("s"))
    e = e.select(F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") * 2 + F.col("s.at")).cast("long").alias("seq"), "s.op", "tool", none.alias("args"), none.alias("result"), none.alias("arg_tags"), none.alias("ref"))
    out = run_stream(session_stream.decisions(e, DEFAULT), spark)
    return out.where(F.col("op") == "evaluate").select("session_id", "seq", "tool", "allowed", "exposed")


TOOLS = {"signup": "query_customer_db", "view": "fetch_web_page", "click": "read_email", "purchase": "send_email", "error": "mystery_tool"}


def fold_session_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-mode verdicts by the fold; equal to the windows of session_verdict."""
    none = F.lit(None).cast("string")
    event = lambda at, op: F.struct(F.lit(at).alias("at"), F.lit(op).alias("op"))
    c = calls(spark, sf_dir).select("session_id", "seq", "tool", F.explode(F.array(event(0, "evaluate"), event(1, "record"))).alias("s"))
    e = c.select(F.col("session_id").cast("string").alias("session_id"), (F.col("seq") * 2 + F.col("s.at")).alias("seq"), "s.op", "tool", none.alias("args"), none.alias("result"), none.alias("arg_tags"), none.alias("ref"))
    out = fold.replay(e, DEFAULT).where(F.col("op") == "evaluate")
    return out.select(F.col("session_id").cast("long").alias("session_id"), ((F.col("seq")) / 2).cast("long").alias("seq"), "tool", "allowed")


def channel_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as external content: each is requested, recorded, and then sent on by another channel."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.to_json(F.struct("html")).alias("json"))
    none = F.lit(None).cast("string")
    row = lambda at, op, args, result: F.struct(
        F.lit(at).alias("at"), F.lit(op).alias("op"), args.alias("args"), result.alias("result")
    )
    steps = F.array(row(0, "resource", none, none), row(1, "content", none, F.col("json")), row(2, "outbound", F.col("json"), none))
    e = p.select((F.col("page_id") % 50).cast("string").alias("session_id"), "page_id", "url", F.explode(steps).alias("s"))
    tool = F.when(F.col("s.op") == "outbound", "sampling/createMessage").otherwise("resources/read")
    e = e.select("session_id", (F.col("page_id") * 3 + F.col("s.at")).alias("seq"), "s.op", tool.alias("tool"), "s.args", "s.result", none.alias("arg_tags"), F.col("url").alias("ref"))
    return fold.replay(e, LINEAGE).select("session_id", "seq", "op", "allowed", "link_method", "tags", "exposed", "scan_kind")


def scenario_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios made from the call log, replayed in both modes: an evaluation record per labelled decision."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    text = docs.select(F.col("doc_id").cast("long").alias("key"), F.to_json(F.struct("text")).alias("json"))
    label = F.when(F.col("value") > 40, "block").otherwise("pass").alias("label")
    traces = calls(spark, sf_dir).select("session_id", "seq", "tool", (F.col("event_id") % n).alias("key"), label)
    return scenarios.replay_keyed(traces, text, DEFAULT, lambda df: kept(spark, df)).drop("why")


def audit_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts' audit log written as JSON lines, read again and verified as a chain."""
    from pyspark.sql import Window

    v = verdicts(flagged(calls(spark, sf_dir))).withColumn("decision", F.when(F.col("allowed"), "ALLOWED").otherwise("BLOCKED"))
    sign = lambda: audit.signature(*(F.col(c) for c in ("session_id", "seq", "tool", "decision")))
    v = v.withColumn("signature", sign())
    v = v.withColumn("prev_hash", F.lag("signature").over(Window.partitionBy("user_id", "session_id").orderBy("seq")))
    path = f"{shared(spark)}/audit-{uuid.uuid4().hex}"
    audit_log.write(v, path)
    back = audit_log.read(spark, path)
    return audit.verify_chain(back, ["session_id"], "seq", sign(), F.col("bad")).select("session_id", "seq", "tool", "decision", "problem")


def shadow_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-mode verdicts beside what the lineage rule would have said, and how they differ."""
    out = fold.replay(session_events(spark, sf_dir), replace(LINEAGE, mode="shadow")).where((F.col("op") == "evaluate") & F.col("shadow_allowed").isNotNull())
    # the destructive gate may block what the compared rule allows
    ruled = F.col("allowed") | (F.col("matched_tags") == "UNTRUSTED_ORIGIN")
    differs = F.when(ruled & ~F.col("shadow_allowed"), "ALLOW_BLOCK").when(~ruled & F.col("shadow_allowed"), "BLOCK_ALLOW")
    return out.select("session_id", "seq", "tool", ruled.alias("session_allowed"), "shadow_allowed", differs.alias("divergence"))


def step_meta_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn, the longest text it shares with the turn before."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    pairs = c.select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))

    def run(batches):
        for rows in batches:
            rows["shared"] = [L.longest_common(a or "", b or "") for a, b in zip(rows["text"], rows["before"], strict=True)]
            yield rows[["conv_id", "turn", "shared"]]

    return pairs.mapInPandas(run, "conv_id long, turn long, shared long")


def _ready(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at_hand(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _ready(f)
    for f in (
        lineage_replay, hitl_replay, sanitize_replay, tokenize_pii, mask_pii_deep, output_scan, vault_tokens, injection_scores,
        stream_session_verdict, fold_session_verdict, channel_replay, scenario_replay, audit_jsonl,
        shadow_compare, step_meta_lcs,
    )
}

#: Where neither decoding nor a document as argument decides, SQL tells the same.
ORACLES = {
    "fold_session_verdict": "WITH " + VERDICT_SQL + " SELECT session_id, seq, tool, allowed FROM verdict",
    "stream_session_verdict": """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'query_customer_db' WHEN 'view' THEN 'fetch_web_page' WHEN 'click' THEN 'read_email' WHEN 'purchase' THEN 'send_email' WHEN 'error' THEN 'mystery_tool' END AS tool FROM events),
f AS (SELECT *, coalesce(bool_or(tool = 'query_customer_db') OVER w, false) AS s, coalesce(bool_or(tool IN ('fetch_web_page', 'read_email', 'mystery_tool')) OVER w, false) AS u FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id::VARCHAR AS session_id, event_id * 2 AS seq, tool, NOT (tool IN ('send_email', 'fetch_web_page', 'mystery_tool') AND s AND u) AS allowed, u AS exposed FROM f""",
    "audit_jsonl": "WITH " + VERDICT_SQL + " SELECT session_id, seq, tool, CASE WHEN allowed THEN 'ALLOWED' ELSE 'BLOCKED' END AS decision, NULL::VARCHAR AS problem FROM verdict",
    "injection_scores": "SELECT conv_id, turn, text, length(trim(coalesce(text, ''))) > 0 AS is_injection, CASE WHEN length(trim(coalesce(text, ''))) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score, length(trim(coalesce(text, ''))) = 0 AS evaluated FROM conversations",
}
