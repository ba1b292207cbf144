"""Replays whose outcome SQL can tell as well: the call log folded by the state machine, beside a recursion over each session."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.operators import fold, links, projection
from sluiceway.plans.policy import DEFAULT
from sluiceway.sources.calls import CALLS_SQL, calls
from sluiceway.streaming import session_stream

LINEAGE = replace(DEFAULT, mode="lineage")

FLAGS_SQL = (
    CALLS_SQL
    + """, tools(tool, sensitive, untrusted, destr, snk) AS (VALUES ('query_customer_db', true, false, false, 'READ'),
  ('fetch_web_page', false, true, false, 'OUTBOUND_SINK'), ('read_email', false, true, false, 'READ'),
  ('send_email', false, false, false, 'OUTBOUND_SINK'), ('delete_customer_record', false, false, true, NULL)),
flags AS (
  SELECT c.*, t.tool IS NOT NULL AS classified, coalesce(snk, 'OUTBOUND_SINK') AS sink, coalesce(sensitive, false) AS s,
    coalesce(untrusted, false) OR t.tool IS NULL AS u, coalesce(destr, false) AS destructive
  FROM calls c LEFT JOIN tools t ON c.tool = t.tool
)"""
)
VERDICT_SQL = (
    FLAGS_SQL
    + """, verdict AS (
  SELECT *, NOT (sink = 'OUTBOUND_SINK' AND s_before AND exposed) AS allowed FROM (
    SELECT *, coalesce(bool_or(s) OVER w, false) AS s_before, coalesce(bool_or(u) OVER w, false) AS exposed FROM flags
    WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
)"""
)
#: The call that a call's arguments refer to: the one before, the one at half its place, or none (linked by time).
PARENT_SQL = "CASE WHEN seq >= 2 THEN CASE event_id % 3 WHEN 0 THEN seq - 1 WHEN 1 THEN seq // 2 END END"


def lineage_sql(by_value: bool) -> str:
    """Session by session, tags along links: ``lin`` has what each call's links bring and its verdicts.

    A named parent counts alone. A parent found by value that holds no tag is joined by all that hold one, as is a call without a parent.
    """
    alone = "par IS NOT NULL AND (ss[par] OR us[par])" if by_value else "par IS NOT NULL"
    link = lambda x: f"CASE WHEN {alone} THEN {x}[par] ELSE coalesce(list_contains({x}, true), false) END"
    return (
        VERDICT_SQL
        + f""", r AS (SELECT *, {PARENT_SQL} AS par FROM verdict),
walk(session_id, seq, ss, us) AS (
  SELECT session_id, seq, [s], [u] FROM r WHERE seq = 1
  UNION ALL SELECT w.session_id, r.seq, list_append(ss, r.s OR {link('ss')}), list_append(us, r.u OR {link('us')})
  FROM walk w JOIN r ON r.session_id = w.session_id AND r.seq = w.seq + 1),
linked AS (
  SELECT r.*, coalesce({link('ss')}, false) AS link_s, coalesce({link('us')}, false) AS link_u, coalesce({alone}, false) AS alone
  FROM r LEFT JOIN walk w ON w.session_id = r.session_id AND w.seq = r.seq - 1),
root AS (SELECT *, (s AND NOT link_s) OR (u AND NOT link_u) AS is_root FROM linked),
lin AS (
  SELECT *, NOT (sink = 'OUTBOUND_SINK' AND link_s AND (link_u OR exposed)) AS ok,
    coalesce(sum(is_root::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS roots FROM root)"""
    )


def _parent() -> Column:
    at = F.when(F.col("event_id") % 3 == 0, F.col("seq") - 1).when(F.col("event_id") % 3 == 1, F.floor(F.col("seq") / 2))
    return F.when(F.col("seq") >= 2, at)


def value_of(session: Column, seq: Column) -> Column:
    """A value that only this call's result has: long enough to be strong evidence, too short to be taken for a key."""
    return F.concat(F.lit("v"), F.substring(F.sha2(F.concat_ws("|", session.cast("string"), seq.cast("string"), F.lit("value")).cast("binary"), 256), 1, 17))


def events_of(spark: SparkSession, sf_dir: str, args: Column | None = None, result: Column | None = None, before: tuple[str, ...] = ("evaluate",), after: tuple[tuple[str, Column, str | None], ...] = ()) -> DataFrame:
    """The call log as replay events: what is asked before each call, its record, and (op, condition, tool) after it."""
    none = F.lit(None).cast("string")
    step = lambda at, op, tool: F.struct(F.lit(at).cast("long").alias("at"), F.lit(op).alias("op"), tool.alias("tool"))
    n = len(before)
    steps = [step(i, op, F.col("tool")) for i, op in enumerate(before)] + [step(n, "record", F.col("tool"))]
    steps += [F.when(cond, step(n + 1 + i, op, F.lit(tool))) for i, (op, cond, tool) in enumerate(after)]
    c = calls(spark, sf_dir).withColumn("args", none if args is None else args).withColumn("result", none if result is None else result)
    e = c.select("session_id", "seq", "event_id", "args", "result", F.explode(F.array_compact(F.array(*steps))).alias("s"))
    return e.select(
        F.col("session_id").cast("string").alias("session_id"), (F.col("seq") * 8 + F.col("s.at")).alias("seq"), "s.op", "s.tool", "args",
        F.when(F.col("s.op") == "record", F.col("result")).alias("result"), none.alias("arg_tags"), none.alias("ref"),
    )


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose arguments name an earlier call's node, or nothing."""
    node = links.node_id(F.col("session_id").cast("string"), _parent().cast("string"))
    return events_of(spark, sf_dir, F.when(_parent().isNotNull(), F.to_json(F.struct(F.array(node).alias("_taintRef")))))


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose arguments repeat a value of an earlier call's result, or nothing."""
    ref = F.when(_parent().isNotNull(), F.to_json(F.struct(value_of(F.col("session_id"), _parent()).alias("x"))))
    return events_of(spark, sf_dir, ref, F.to_json(F.struct(value_of(F.col("session_id"), F.col("seq")).alias("x"))))


def decided(rows: DataFrame, *columns: str) -> DataFrame:
    """Verdicts with the log's own session_id and seq."""
    at = rows.where(F.col("op") == "evaluate").select(F.col("session_id").cast("long").alias("session_id"), F.floor(F.col("seq") / 8).alias("seq"), (F.col("seq") % 8).cast("long").alias("nth"), *columns)
    return at


_EVIDENCE = """ SELECT session_id, seq, tool, ok AS allowed, {method} AS link_method, CASE WHEN sink = 'OUTBOUND_SINK' THEN {evidence} ELSE 0 END::INT AS evidence, exposed FROM lin"""
_METHOD = "CASE WHEN sink <> 'OUTBOUND_SINK' THEN 'NONE' WHEN alone THEN '{}' WHEN roots > 0 THEN 'TEMPORAL_FALLBACK' WHEN par IS NOT NULL THEN '{}' ELSE 'NONE' END"


def lineage_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold.replay(named(spark, sf_dir), LINEAGE)
    return decided(out, "tool", "allowed", "link_method", "evidence", "exposed").drop("nth")


def lineage_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold.replay(valued(spark, sf_dir), LINEAGE)
    return decided(out, "tool", "allowed", "link_method", "evidence", "exposed").drop("nth")


def lineage_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the relaxation, links by time alone don't block when the scan is clean."""
    policies = {p: replace(LINEAGE, relaxation=p) for p in ("off", "scan-clean")}
    return decided(fold.replays(named(spark, sf_dir), policies), F.col("label").alias("condition"), "tool", "allowed").drop("nth")


_NODE = "'tn_' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
_TAGS = "concat_ws(',', CASE WHEN {s} THEN 'SENSITIVE' END, CASE WHEN {u} THEN 'UNTRUSTED_ORIGIN' END)"


def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that the replay emits, with the tags they bring and those they inherit."""
    out = fold.emitted(named(spark, sf_dir), LINEAGE).where(F.col("kind") == "node")
    own = F.array_join(F.from_json(F.get_json_object("detail", "$.own"), "array<string>"), ",")
    return out.select(F.col("session_id").cast("long").alias("session_id"), F.col("name").alias("node_id"), "tool", own.alias("own"), "tags")


def lineage_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that the replay emits, with how they were found."""
    out = fold.emitted(named(spark, sf_dir), LINEAGE).where(F.col("kind") == "edge")
    field = lambda n: F.get_json_object("detail", f"$.{n}")
    return out.select(F.col("session_id").cast("long").alias("session_id"), F.col("name").alias("child"), field("parent").alias("parent"), field("method").alias("method"), field("weak").cast("boolean").alias("weak"))


def tag_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each session and tag, how many nodes hold it, and the tools of those that brought it."""
    nodes = lineage_nodes(spark, sf_dir)
    t = nodes.select("session_id", "tool", "own", F.explode(F.split(F.when(F.col("tags") != "", F.col("tags")), ",")).alias("tag"))
    brought = F.array_join(F.array_sort(F.collect_set(F.when(F.contains("own", F.col("tag")), F.col("tool")))), ",")
    return t.groupBy("session_id", "tag").agg(F.count("*").alias("holders"), brought.alias("brought_by"))


def payload_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of tagged results."""
    out = fold.emitted(events_of(spark, sf_dir), LINEAGE).where(F.col("kind") == "payload")
    return out.select(F.col("session_id").cast("long").alias("session_id"), F.floor(F.col("seq") / 8).alias("seq"), "tool", "tags", F.get_json_object("detail", "$.origin").alias("origin"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir, before=("evaluate", "approve", "evaluate"))


ASK = replace(LINEAGE, hitl="weak-only")


def hitl_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call is judged, approved if it waits, and judged again: an approval opens it once."""
    return decided(fold.replay(_asked(spark, sf_dir), ASK), "tool", "allowed", "can_override")


def hitl_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows of approvals: offered, requested, approved, used."""
    out = fold.emitted(_asked(spark, sf_dir), ASK).where(F.col("kind") == "approval")
    return out.select(F.col("session_id").cast("long").alias("session_id"), F.floor(F.col("seq") / 8).alias("seq"), "tool", F.get_json_object("detail", "$.action").alias("action"), F.get_json_object("detail", "$.actor").alias("actor"))


def destructive_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The destructive gate in both modes: blocked for good, or opened once by an approval."""
    block = {m: replace(DEFAULT, mode=m, destructive_policy="block") for m in ("session", "lineage")}
    ask = {f"{m} asks": replace(DEFAULT, mode=m, destructive_policy="hitl") for m in ("session", "lineage")}
    return decided(fold.replays(_asked(spark, sf_dir), block | ask), "label", "tool", "allowed")


def sanitize_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-mode verdicts with tokenizations that clear the sensitive tag of a session whose payloads all pass."""
    mail = F.to_json(F.struct(F.concat(F.lit("user"), F.col("event_id").cast("string"), F.lit("@example.com")).alias("mail")))
    out = fold.replay(events_of(spark, sf_dir, result=mail, after=(("sanitize", F.col("event_id") % 5 == 0, "TOKENIZATION"),)), DEFAULT)
    at = out.where(F.col("op").isin("evaluate", "sanitize"))
    masked = F.get_json_object(F.when(F.col("op") == "sanitize", F.col("reason")), "$.masked").cast("long")
    return at.select(F.col("session_id").cast("long").alias("session_id"), F.floor(F.col("seq") / 8).alias("seq"), "op", "allowed", masked.alias("masked"))


def shadow_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-mode verdicts beside the lineage rule's, and where they part."""
    out = decided(fold.replay(named(spark, sf_dir), replace(DEFAULT, mode="shadow")), "tool", F.col("allowed").alias("session_allowed"), "shadow_allowed").drop("nth")
    return out.withColumn("divergence", F.when(F.col("session_allowed") & ~F.col("shadow_allowed"), "ALLOW_BLOCK").when(~F.col("session_allowed") & F.col("shadow_allowed"), "BLOCK_ALLOW"))


TRUSTED = "https://tionsh.example.net/a"


def channel_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other channels: a resource is requested and its content recorded, and mail leaves as content."""
    none = F.lit(None).cast("string")
    uri = F.when(F.col("event_id") % 4 == 0, TRUSTED).otherwise("https://other.example.org/b")
    op = F.when(F.col("tool") == "fetch_web_page", F.array(F.lit("resource"), F.lit("content"))).when(F.col("tool") == "send_email", F.array(F.lit("outbound"))).otherwise(F.array(F.lit("record")))
    c = calls(spark, sf_dir).select("session_id", "seq", "tool", uri.alias("ref"), F.posexplode(op).alias("at", "op"))
    e = c.select(F.col("session_id").cast("string").alias("session_id"), (F.col("seq") * 8 + F.col("at")).alias("seq"), "op", "tool", none.alias("args"), none.alias("result"), none.alias("arg_tags"), "ref")
    out = fold.replay(e, LINEAGE).where(F.col("op").isin("resource", "outbound"))
    return out.select(F.col("session_id").cast("long").alias("session_id"), F.floor(F.col("seq") / 8).alias("seq"), "op", "allowed")


def block_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of each block where both tags meet, and its explanation's actions."""
    out = fold.emitted(events_of(spark, sf_dir), LINEAGE).where(F.col("kind").isin("trifecta", "explanation"))
    actions = F.array_join(F.transform(F.from_json(F.get_json_object("detail", "$.actions"), "array<struct<kind:string,available:boolean>>"), lambda a: F.concat_ws(":", a["kind"], a["available"].cast("string"))), ",")
    told = F.when(F.col("kind") == "trifecta", F.get_json_object("detail", "$.sink")).otherwise(actions)
    return out.select(F.col("session_id").cast("long").alias("session_id"), F.floor(F.col("seq") / 8).alias("seq"), "kind", "tool", "tags", told.alias("told"))


def lineage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records of real replays: each call judged in both modes, with the relaxation off and on."""
    policies = {f"{m}|{r}": replace(DEFAULT, mode=m, relaxation=r) for m in ("session", "lineage") for r in ("off", "scan-clean")}
    out = fold.replays(named(spark, sf_dir), policies).where(F.col("op") == "evaluate")
    return out.select(
        F.col("session_id").cast("long").alias("session_id"), F.floor(F.col("seq") / 8).alias("seq"), F.split("label", r"\|")[0].alias("mode"), F.split("label", r"\|")[1].alias("condition"), F.col("allowed").alias("ok")
    )


def lineage_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's lineage as views get it, after its last call: nodes with their parents and how these were found."""
    none = F.lit(None).cast("string")
    e = named(spark, sf_dir)
    last = e.groupBy("session_id").agg((F.max("seq") + 1).alias("seq"))
    asked = last.select("session_id", "seq", F.lit("snapshot").alias("op"), *(none.alias(c) for c in ("tool", "args", "result", "arg_tags", "ref")))
    out = projection.frames(projection.of_lineage(fold.emitted(e.unionByName(asked), LINEAGE)), "session_id", "text")
    nodes = F.from_json(F.get_json_object("frame", "$.nodes"), "array<struct<id:string,tags:array<string>,parents:array<struct<nodeId:string,method:string,weak:boolean>>>>")
    n = out.select(F.col("session_id").cast("long").alias("session_id"), F.explode(nodes).alias("n"))
    return n.select("session_id", F.col("n.id").alias("node_id"), F.array_join("n.tags", ",").alias("tags"), F.size("n.parents").cast("long").alias("parents"), F.count_if(F.lit(True)).over(Window.partitionBy("session_id")).alias("nodes"))


def control_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of views as events: those with the token and a known type."""
    e = calls(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("approve", "reject", "sanitize", "shutdown"))), (F.col("event_id") % 4 + 1).cast("int"))
    token = F.when(F.col("event_id") % 3 == 0, "wrong").otherwise("right")
    text = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct(kind.alias("type"), token.alias("token"), F.concat(F.lit("ap_"), F.col("event_id").cast("string")).alias("approvalId"))))
    out = session_stream.commands(e.select(F.col("session_id").cast("string").alias("session_id"), "seq", text.alias("text")), "text", "right")
    return out.select("session_id", "seq", "op", "ref")


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each call from its links, with tombstones: a tagged one shows as pruned, a clean one is left out."""
    nodes = lineage_nodes(spark, sf_dir).withColumn("pruned", F.substring("node_id", 4, 1) < "8")
    found = lineage_links(spark, sf_dir).join(nodes.select("session_id", F.col("node_id").alias("parent"), "tool", "tags", "pruned"), ["session_id", "parent"])
    kept = found.where(~F.col("pruned") | (F.col("tags") != ""))
    return kept.groupBy("session_id", "child").agg(F.count("*").alias("nodes"), F.count_if("pruned").alias("tombstones"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("pruned"), "(pruned)").otherwise(F.col("tool")))), ",").alias("tools"))


_ASKED = "VERDICT, x AS (SELECT *, unnest([0, 2])::BIGINT AS nth FROM verdict)"
SQL = {
    lineage_named: "WITH RECURSIVE " + lineage_sql(False) + _EVIDENCE.format(method=_METHOD.format("MCP_REF", "MCP_REF"), evidence="CASE WHEN alone THEN 1 ELSE roots END"),
    lineage_valued: "WITH RECURSIVE " + lineage_sql(True) + _EVIDENCE.format(method=_METHOD.format("VALUE_MATCH", "VALUE_MATCH"), evidence="CASE WHEN alone THEN 1 ELSE roots + (par IS NOT NULL)::INT END"),
    lineage_relaxed: "WITH RECURSIVE " + lineage_sql(False) + " SELECT session_id, seq, 'off' AS condition, tool, ok AS allowed FROM lin UNION ALL SELECT session_id, seq, 'scan-clean', tool, ok OR NOT alone FROM lin",
    lineage_nodes: "WITH RECURSIVE " + lineage_sql(False) + f""", k AS (SELECT *, sha256(session_id || '|' || seq) AS h FROM lin)
SELECT session_id, {_NODE} AS node_id, tool, {_TAGS.format(s='s', u='u')} AS own, {_TAGS.format(s='s OR link_s', u='u OR link_u')} AS tags FROM k""",
    lineage_links: "WITH RECURSIVE " + lineage_sql(False) + f""", k AS (SELECT session_id, seq, is_root, {_NODE} AS id FROM (SELECT *, sha256(session_id || '|' || seq) AS h FROM lin))
SELECT c.session_id, c.id AS child, p.id AS parent, 'MCP_REF' AS method, false AS weak FROM lin l JOIN k c USING (session_id, seq) JOIN k p ON p.session_id = l.session_id AND p.seq = l.par
UNION ALL SELECT c.session_id, c.id, p.id, 'TEMPORAL_FALLBACK', true FROM lin l JOIN k c USING (session_id, seq) JOIN k p ON p.session_id = l.session_id AND p.seq < l.seq AND p.is_root WHERE l.par IS NULL""",
    tag_holders: "WITH RECURSIVE " + lineage_sql(False) + """, t AS (SELECT session_id, tool, 'SENSITIVE' AS tag, s AS own FROM lin WHERE s OR link_s UNION ALL SELECT session_id, tool, 'UNTRUSTED_ORIGIN', u FROM lin WHERE u OR link_u)
SELECT session_id, tag, count(*)::BIGINT AS holders, string_agg(DISTINCT tool, ',' ORDER BY tool) FILTER (own) AS brought_by FROM t GROUP BY 1, 2""",
    lineage_frames: "WITH RECURSIVE " + lineage_sql(False) + f""", k AS (SELECT *, {_NODE} AS id FROM (SELECT *, sha256(session_id || '|' || seq) AS h FROM lin))
SELECT session_id, id AS node_id, {_TAGS.format(s='s OR link_s', u='u OR link_u')} AS tags, (CASE WHEN alone THEN 1 ELSE roots END)::BIGINT AS parents, count(*) OVER (PARTITION BY session_id)::BIGINT AS nodes FROM k""",
    evidence_rows: "WITH RECURSIVE " + lineage_sql(False) + f""", k AS (SELECT *, {_NODE} AS id, s OR link_s OR u OR link_u AS tagged FROM (SELECT *, sha256(session_id || '|' || seq) AS h FROM root)),
e AS (SELECT c.session_id, c.id AS child, p.tool, p.tagged, substr(p.id, 4, 1) < '8' AS pruned FROM k c JOIN k p ON p.session_id = c.session_id AND (p.seq = c.par OR (c.par IS NULL AND p.seq < c.seq AND p.is_root)))
SELECT session_id, child, count(*)::BIGINT AS nodes, count(*) FILTER (pruned)::BIGINT AS tombstones, string_agg(CASE WHEN pruned THEN '(pruned)' ELSE tool END, ',' ORDER BY CASE WHEN pruned THEN '(pruned)' ELSE tool END) AS tools FROM e WHERE NOT pruned OR tagged GROUP BY 1, 2""",
    control_messages: "WITH " + CALLS_SQL + """ SELECT session_id::VARCHAR AS session_id, seq, ['approve', 'reject', 'sanitize'][(event_id % 4 + 1)::INT] AS op, 'ap_' || event_id AS ref FROM calls WHERE event_id % 4 < 3 AND event_id % 3 <> 0 AND event_id % 7 <> 0""",
    payload_store: "WITH " + FLAGS_SQL + f" SELECT session_id, seq, tool, {_TAGS.format(s='s', u='u')} AS tags, CASE WHEN s THEN 'source' END AS origin FROM flags WHERE s OR u",
    hitl_once: "WITH " + _ASKED.replace("VERDICT", VERDICT_SQL) + " SELECT session_id, seq, nth, tool, allowed OR nth = 2 AS allowed, CASE WHEN NOT allowed AND nth = 0 THEN true END AS can_override FROM x",
    hitl_steps: "WITH " + VERDICT_SQL + """, a AS (SELECT *, unnest(['OFFERED', 'REQUESTED', 'APPROVED', 'OVERRIDE_USED']) AS action FROM verdict WHERE NOT allowed)
SELECT session_id, seq, tool, action, CASE WHEN action IN ('APPROVED', 'OVERRIDE_USED') THEN 'dashboard' END AS actor FROM a""",
    destructive_fold: "WITH " + _ASKED.replace("VERDICT", VERDICT_SQL) + """, m AS (SELECT *, unnest(['session', 'lineage', 'session asks', 'lineage asks']) AS label FROM x)
SELECT session_id, seq, nth, label, tool, allowed AND (NOT (destructive AND exposed) OR (nth = 2 AND label LIKE '% asks')) AS allowed FROM m""",
    sanitize_fold: "WITH " + FLAGS_SQL + """, e AS (SELECT *, coalesce(sum((event_id % 5 = 0)::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era FROM flags),
b AS (SELECT *, coalesce(sum(s::INT) OVER (PARTITION BY session_id, era ORDER BY seq), 0) AS held, coalesce(bool_or(u) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS exposed FROM e)
SELECT session_id, seq, 'evaluate' AS op, NOT (sink = 'OUTBOUND_SINK' AND held - s::INT > 0 AND exposed) AS allowed, NULL::BIGINT AS masked FROM b
UNION ALL SELECT session_id, seq, 'sanitize', held > 0, CASE WHEN held > 0 THEN held END FROM b WHERE event_id % 5 = 0""",
    shadow_fold: "WITH RECURSIVE " + lineage_sql(False) + """ SELECT session_id, seq, tool, allowed AS session_allowed, ok AS shadow_allowed,
CASE WHEN allowed AND NOT ok THEN 'ALLOW_BLOCK' WHEN NOT allowed AND ok THEN 'BLOCK_ALLOW' END AS divergence FROM lin""",
    channel_fold: "WITH " + FLAGS_SQL + """, t AS (SELECT *, CASE WHEN tool = 'fetch_web_page' THEN event_id % 4 <> 0 WHEN tool = 'send_email' THEN false ELSE u END AS dirty FROM flags),
b AS (SELECT *, coalesce(bool_or(s) OVER w, false) AND coalesce(bool_or(dirty) OVER w, false) AS both_tags FROM t WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, seq, CASE tool WHEN 'send_email' THEN 'outbound' ELSE 'resource' END AS op, NOT both_tags OR (tool = 'fetch_web_page' AND event_id % 4 = 0) AS allowed FROM b WHERE tool IN ('send_email', 'fetch_web_page')""",
    block_events: "WITH " + VERDICT_SQL + """ SELECT session_id, seq, unnest(['trifecta', 'explanation']) AS kind, tool, 'SENSITIVE,UNTRUSTED_ORIGIN' AS tags,
unnest([sink, 'SANITIZE:true,REQUEST_APPROVAL:false,INSPECT_SOURCE:true']) AS told FROM verdict WHERE NOT allowed""",
    lineage_records: "WITH RECURSIVE " + lineage_sql(False) + """, m AS (SELECT *, unnest(['off', 'scan-clean']) AS condition FROM lin)
SELECT session_id, seq, 'session' AS mode, condition, allowed AS ok FROM m UNION ALL SELECT session_id, seq, 'lineage', condition, ok OR (condition = 'scan-clean' AND NOT alone) FROM m""",
}
QUERIES = {f.__name__: f for f in SQL}
ORACLES = {f.__name__: sql for f, sql in SQL.items()}
