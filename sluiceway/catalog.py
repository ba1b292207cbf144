"""All queries of the engine, each beside the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway import replays
from sluiceway.functions import text as T
from sluiceway.operators import audit, classify, graph, links, projection, reports, scenarios, views
from sluiceway.plans.policy import DEFAULT, PII
from sluiceway.replays import FLAGS_SQL, VERDICT_SQL, lineage_sql
from sluiceway.sources.calls import CALLS_SQL, calls, in_session, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EDGES_SQL = (
    FLAGS_SQL
    + """, edges AS (
  SELECT session_id, seq AS child, lag(seq) OVER (PARTITION BY session_id, event_id % 3 ORDER BY seq) AS parent FROM calls
  UNION ALL SELECT session_id, seq, seq // 2 FROM calls WHERE seq >= 2 AND event_id % 5 = 0
), edge AS (SELECT DISTINCT session_id, child, parent FROM edges WHERE parent IS NOT NULL AND parent < child),
node AS (SELECT session_id, seq, tool, list_filter([CASE WHEN s THEN 'S' END, CASE WHEN u THEN 'U' END], lambda x: x IS NOT NULL) AS tags FROM flags)"""
)
TOKENS_SQL = r"""doc_token AS (
  SELECT DISTINCT doc_id, token FROM (
    SELECT doc_id, unnest(list_concat([regexp_replace(text, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')], regexp_extract_all(text, '[\p{L}\p{N}@._+-]{8,}'))) AS token FROM documents)
  WHERE length(token) >= 8 AND lower(token) NOT IN ('password', 'username', 'response', 'timestamp', 'description', 'undefined', 'function', 'javascript', 'sessionid', 'localhost')
)"""
#: Titles of labelled points, in the forms that reports tell apart.
TITLES = (
    "은행: 원문 전송", "메일: base64 인코딩 3자 전송", "파일: HEX 4자 hex 전송", "은행: URL 인코딩 우회", "메일: 공백 삽입 5자리", "파일: 두 호출로 분할", "은행: 다른 필드로 위장", "메일: 요약문 속에 감춤",
    "파일: 정화 선언 후 재전송", "은행: 역순 전송", "메일: 다중 전송 중 하나만 유출", "파일 정리", "은행: [축3/전각] 변형 5자", "정상: 주간 보고", "",
)
RECORDS_SQL = (
    lineage_sql(False)
    + """, evals AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS eval_index,
    CASE WHEN value > 40 THEN 'block' ELSE 'pass' END AS expect, CASE WHEN session_id % 3 = 0 THEN 'attack' ELSE 'normal' END AS category,
    ['easy', 'boundary', 'obvious', 'subtle'][(event_id % 4 + 1)::INT] AS tier, {titles}[(event_id % {n} + 1)::INT] AS title, 'L' || lpad((event_id % 150 + 1)::VARCHAR, 3, '0') AS point
  FROM lin WHERE sink = 'OUTBOUND_SINK'
), every AS (
  SELECT *, CASE WHEN expect = 'block' AND NOT judged THEN 'TP' WHEN expect = 'block' THEN 'FN' WHEN NOT judged THEN 'FP' ELSE 'TN' END AS outcome FROM (
    SELECT *, unnest(['session', 'lineage', 'session', 'lineage']) AS mode, unnest(['off', 'off', 'scan-clean', 'scan-clean']) AS condition, unnest([allowed, ok, allowed, ok OR NOT alone]) AS judged FROM evals)
), rec AS (SELECT * EXCLUDE (ok), judged AS ok FROM every WHERE condition = 'off')""".replace("{titles}", str(list(TITLES))).replace("{n}", str(len(TITLES)))
)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- tables that several queries share


def _flags(spark, d):
    return classify.flagged(calls(spark, d))


def _verdicts(spark, d):
    return classify.verdicts(_flags(spark, d))


def _docs(spark, d):
    return table(spark, d, "documents")


def _edges(spark, d):
    c = calls(spark, d)
    w = Window.partitionBy("user_id", "session_id", F.col("event_id") % 3).orderBy("seq")
    a = c.select("session_id", F.col("seq").alias("child"), F.lag("seq").over(w).alias("parent"))
    b = c.where((F.col("seq") >= 2) & (F.col("event_id") % 5 == 0)).select("session_id", F.col("seq").alias("child"), F.floor(F.col("seq") / 2).alias("parent"))
    return a.union(b).where(F.col("parent") < F.col("child")).distinct()


def _nodes(spark, d):
    tags = F.array_compact(F.array(F.when(F.col("s"), "S"), F.when(F.col("u"), "U")))
    return _flags(spark, d).select("session_id", "seq", "tool", tags.alias("tags"))


def _all_records(spark, d):
    """Labelled points of the call log, judged by replays in both modes, with the relaxation off and on."""
    v = _verdicts(spark, d).where(F.col("sink") == classify.OUTBOUND)
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    points = v.select(
        "session_id", "seq", "event_id", "tool", "s_before", "exposed", "classified", "value",
        (F.row_number().over(in_session()) - 1).cast("long").alias("eval_index"),
        F.when(F.col("value") > 40, "block").otherwise("pass").alias("expect"),
        F.when(F.col("session_id") % 3 == 0, "attack").otherwise("normal").alias("category"), pick(("easy", "boundary", "obvious", "subtle"), 4).alias("tier"),
        pick(TITLES, len(TITLES)).alias("title"), F.concat(F.lit("L"), F.lpad((F.col("event_id") % 150 + 1).cast("string"), 3, "0")).alias("point"),
    )
    judged = points.join(replays.lineage_records(spark, d), ["session_id", "seq"])
    return judged.withColumn("outcome", reports.outcome(F.col("expect"), F.col("ok")))


def _records(spark, d):
    return _all_records(spark, d).where(F.col("condition") == "off")


# -- classification


@query("WITH " + FLAGS_SQL + " SELECT tool, sink, classified, count(*)::BIGINT AS n FROM flags GROUP BY ALL")
def tool_sink_class(spark, d):
    return _flags(spark, d).groupBy("tool", "sink", "classified").agg(F.count("*").alias("n"))


@query("WITH " + FLAGS_SQL + " SELECT event_id, tool, concat_ws(',', CASE WHEN s THEN 'SENSITIVE' END, CASE WHEN u THEN 'UNTRUSTED_ORIGIN' END) AS tags FROM flags")
def tool_source_tags(spark, d):
    return _flags(spark, d).select("event_id", "tool", classify.tag_list(F.col("s"), F.col("u")).alias("tags"))


@query("WITH " + FLAGS_SQL + " SELECT session_id, count(*) FILTER (classified)::BIGINT AS known, count(*) FILTER (NOT classified)::BIGINT AS unknown FROM flags GROUP BY 1")
def tool_classified(spark, d):
    return _flags(spark, d).groupBy("session_id").agg(F.count_if("classified").alias("known"), F.count_if(~F.col("classified")).alias("unknown"))


@query("WITH " + FLAGS_SQL + ", w AS (SELECT *, CASE WHEN classified AND tool <> 'delete_customer_record' THEN sink ELSE 'READ' END AS warn_sink FROM flags) SELECT tool, warn_sink, u, count(*)::BIGINT AS n FROM w GROUP BY ALL")
def unknown_tool_warn(spark, d):
    from dataclasses import replace

    f = classify.flagged(calls(spark, d), replace(DEFAULT, unknown_tools="warn"))
    return f.groupBy("tool", F.col("sink").alias("warn_sink"), "u").agg(F.count("*").alias("n"))


@query("""SELECT event_type || '.' || props AS name, event_type AS server, props AS tool, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def agent_tool_split(spark, d):
    e = table(spark, d, "events").select(F.concat_ws(".", "event_type", "props").alias("name"))
    server, tool = T.tool_parts(F.col("name"))
    return e.groupBy("name", server.alias("server"), tool.alias("tool")).agg(F.count("*").alias("n"))


METHODS = ("tools/list", "ping", "sampling/createMessage", "notifications/progress", "tasks/run")


@query("""SELECT m AS method, CASE WHEN m = 'sampling/createMessage' THEN 'SINK' WHEN m IN ('ping', 'tools/list') OR m LIKE 'notifications/%' THEN 'HARMLESS' ELSE 'UNCLASSIFIED' END AS risk, 'FORWARDED' AS decision, count(*)::BIGINT AS n
FROM (SELECT ['tools/list', 'ping', 'sampling/createMessage', 'notifications/progress', 'tasks/run'][(event_id % 5 + 1)::INT] AS m FROM events) GROUP BY ALL""")
def method_risk(spark, d):
    m = F.element_at(F.array(*map(F.lit, METHODS)), (F.col("event_id") % 5 + 1).cast("int")).alias("method")
    rows = audit.forwarded(table(spark, d, "events").select(m), F.col("method"))
    return rows.groupBy("method", "risk", "decision").agg(F.count("*").alias("n"))


@query("SELECT page_id, url, starts_with(url, 'https://tionsh.example.net/') OR starts_with(url, 'https://ads-track.example.org/') AS trusted FROM pages")
def uri_trust_prefix(spark, d):
    return table(spark, d, "pages").select("page_id", "url", classify.trusted_uri(F.col("url")).alias("trusted"))


HIGH = r"list_filter(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{20,}'), lambda r: -list_sum(list_transform(list_distinct(string_split(r, '')), lambda c: (len(list_filter(string_split(r, ''), lambda x: x = c)) / len(r)) * log2(len(list_filter(string_split(r, ''), lambda x: x = c)) / len(r)))) >= 3.8)"
SECRETS_SQL = r"(regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') OR regexp_matches(text, '\bgh[pousr]_[A-Za-z0-9]{36,255}\b') OR len(" + HIGH + ") > 0)"


def has_secret(text):
    keys = F.lit(False)
    for _, p in DEFAULT.secrets.by_regex:
        keys = keys | text.rlike(T.ascii_bounded(p))
    runs = F.regexp_extract_all(text, F.lit(T.SECRET_RUN), F.lit(0))
    return keys | F.exists(runs, lambda r: T.entropy(r) >= DEFAULT.secrets.by_entropy.threshold)


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'source' WHEN {SECRETS_SQL} THEN 'content' END AS origin FROM documents")
def sensitive_origin(spark, d):
    origin = F.when(F.col("doc_id") % 3 == 0, "source").when(has_secret(F.col("text")), "content")
    return _docs(spark, d).select("doc_id", origin.alias("origin"))


@query("SELECT page_id, concat_ws(',', CASE WHEN " + SECRETS_SQL.replace("text", "html") + " THEN 'SENSITIVE' END, CASE WHEN NOT (starts_with(url, 'https://tionsh.example.net/') OR starts_with(url, 'https://ads-track.example.org/')) THEN 'UNTRUSTED_ORIGIN' END) AS tags FROM pages")
def external_content_tags(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", classify.tag_list(has_secret(F.col("html")), ~classify.trusted_uri(F.col("url"))).alias("tags"))


# -- session verdicts


@query("WITH " + FLAGS_SQL + " SELECT event_id, bool_or(u) OVER (PARTITION BY session_id ORDER BY seq) AS exposed FROM flags")
def session_exposure(spark, d):
    w = in_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _flags(spark, d).select("event_id", F.max("u").over(w).alias("exposed"))


@query("WITH " + FLAGS_SQL + """, e AS (SELECT *, sum((event_id % 11 = 0)::INT) OVER (PARTITION BY session_id ORDER BY seq) AS era FROM flags)
SELECT event_id, bool_or(s) OVER (PARTITION BY session_id, era ORDER BY seq) AS s_now, bool_or(u) OVER (PARTITION BY session_id ORDER BY seq) AS u_ever FROM e""")
def session_tags(spark, d):
    return classify.session_state(_flags(spark, d), F.col("event_id") % 11 == 0).select("event_id", "s_now", "u_ever")


@query("WITH " + VERDICT_SQL + " SELECT event_id, session_id, seq, tool, s_before, exposed, allowed FROM verdict")
def session_verdict(spark, d):
    return _verdicts(spark, d).select("event_id", "session_id", "seq", "tool", "s_before", "exposed", "allowed")


@query("WITH " + VERDICT_SQL + " SELECT tool, CASE WHEN allowed THEN 'ALLOWED' ELSE 'BLOCKED' END AS decision, count(*)::BIGINT AS n FROM verdict GROUP BY ALL")
def verdict_counts(spark, d):
    decision = F.when(F.col("allowed"), "ALLOWED").otherwise("BLOCKED")
    return _verdicts(spark, d).groupBy("tool", decision.alias("decision")).agg(F.count("*").alias("n"))


@query("WITH " + VERDICT_SQL + " SELECT event_id, tool, allowed, destructive AND exposed AS gated, allowed AND NOT (destructive AND exposed) AS passes FROM verdict")
def destructive_gate(spark, d):
    return classify.destructive_gate(_verdicts(spark, d)).select("event_id", "tool", "allowed", "gated", "passes")


@query("WITH " + VERDICT_SQL + """ SELECT event_id, CASE WHEN allowed THEN '' ELSE 'sensitive data and untrusted input meet at ' || tool || CASE WHEN classified THEN '' ELSE ' (unclassified)' END END AS reason,
CASE WHEN allowed THEN '' ELSE 'SENSITIVE,UNTRUSTED_ORIGIN' END AS matched_tags FROM verdict""")
def explanations(spark, d):
    why = F.concat(F.lit("sensitive data and untrusted input meet at "), F.col("tool"), F.when(F.col("classified"), "").otherwise(" (unclassified)"))
    none = lambda c: F.when(F.col("allowed"), "").otherwise(c)
    return _verdicts(spark, d).select("event_id", none(why).alias("reason"), none(F.lit("SENSITIVE,UNTRUSTED_ORIGIN")).alias("matched_tags"))


# -- text


@query("WITH " + TOKENS_SQL + " SELECT doc_id, count(*)::BIGINT AS n_tokens, max(length(token))::INT AS longest, sha256(string_agg(token, ' ' ORDER BY token)) AS digest FROM doc_token GROUP BY 1")
def match_tokens(spark, d):
    t = _docs(spark, d).select("doc_id", T.match_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_max(F.transform("t", F.length)).alias("longest"),
        F.sha2(F.array_join(F.array_sort("t"), " ").cast("binary"), 256).alias("digest"),
    )


@query("WITH " + TOKENS_SQL.replace("documents", "benchmark").replace("doc_id", "item_id") + " SELECT item_id, substr(sha256(token), 1, 32) AS token_hash, length(token)::INT AS token_length FROM doc_token")
def token_hash(spark, d):
    return links.tokens(table(spark, d, "benchmark"), "text", ["item_id"])


@query(r"SELECT doc_id, length(n)::INT AS n_chars, sha256(n) AS digest FROM (SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS n FROM documents)")
def normalize_text(spark, d):
    n = _docs(spark, d).select("doc_id", T.normalized(F.col("text")).alias("n"))
    return n.select("doc_id", F.length("n").alias("n_chars"), F.sha2(F.col("n").cast("binary"), 256).alias("digest"))


@query(r"""SELECT doc_id, run, round(-list_sum(list_transform(list_distinct(string_split(run, '')), lambda c: (len(list_filter(string_split(run, ''), lambda x: x = c)) / len(run)) * log2(len(list_filter(string_split(run, ''), lambda x: x = c)) / len(run)))), 6) AS entropy
FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{20,}'))) AS run FROM documents)""")
def shannon_entropy(spark, d):
    r = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(T.SECRET_RUN), F.lit(0)))).alias("run"))
    return r.select("doc_id", "run", F.round(T.entropy(F.col("run")), 6).alias("entropy"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {n.lower()}" for n, p in PII) + " FROM documents")
def pii_hits(spark, d):
    return _docs(spark, d).select("doc_id", *(T.count_matches(F.col("text"), p).alias(n.lower()) for n, p in PII))


def _masked_sql() -> str:
    s = "text"
    for n, p in PII:
        s = f"regexp_replace({s}, '{p}', '[{n}]', 'g')"
    return s


@query(f"SELECT doc_id, length(m)::INT AS n_chars, sha256(m) AS digest FROM (SELECT doc_id, {_masked_sql()} AS m FROM documents)")
def mask_pii_simple(spark, d):
    m = _docs(spark, d).select("doc_id", T.masked(F.col("text"), PII).alias("m"))
    return m.select("doc_id", F.length("m").alias("n_chars"), F.sha2(F.col("m").cast("binary"), 256).alias("digest"))


@query(r"""SELECT DISTINCT doc_id, n AS digits, list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN (len(n) - i) % 2 = 0 THEN n[i]::INT WHEN n[i]::INT * 2 > 9 THEN n[i]::INT * 2 - 9 ELSE n[i]::INT * 2 END)) % 10 = 0 AS valid
FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b')), '[^0-9]', '', 'g') AS n FROM documents)""")
def luhn_valid(spark, d):
    found = F.explode(F.regexp_extract_all("text", F.lit(T.ascii_bounded(PII[1][1])), F.lit(0)))
    n = _docs(spark, d).select("doc_id", found.alias("x")).select("doc_id", F.regexp_replace("x", "[^0-9]", "").alias("digits"))
    return n.distinct().select("doc_id", "digits", T.luhn(F.col("digits")).alias("valid"))


@query(r"""SELECT DISTINCT doc_id, ip, len(list_filter(string_split(ip, '.'), lambda p: length(p) > 3 OR p::INT > 255)) = 0 AS valid
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{1,3}(?:\.\d{1,3}){3}\b')) AS ip FROM documents)""")
def ipv4_valid(spark, d):
    found = F.explode(F.regexp_extract_all("text", F.lit(T.ascii_bounded(r"\b\d{1,3}(?:\.\d{1,3}){3}\b")), F.lit(0)))
    return _docs(spark, d).select("doc_id", found.alias("ip")).distinct().select("doc_id", "ip", T.ipv4(F.col("ip")).alias("valid"))


@query("SELECT doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || '…' ELSE text END AS args FROM documents")
def truncate_args(spark, d):
    return _docs(spark, d).select("doc_id", T.cut_to(F.col("text"), 1200).alias("args"))


TOKENED_SQL = r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[PII_EMAIL_' || substr(sha256(text), 1, 12) || ']', 'g') AS t FROM documents"


def _tokened(spark, d):
    token = F.concat(F.lit("[PII_EMAIL_"), T.short_hash(F.col("text"), 12), F.lit("]"))
    return _docs(spark, d).select("doc_id", F.regexp_replace("text", F.lit(PII[3][1]), token).alias("t"))


@query(rf"SELECT doc_id, len(regexp_extract_all(t, '{T.VAULT_TOKEN}'))::BIGINT AS n_tokens FROM ({TOKENED_SQL})")
def vault_token_count(spark, d):
    return _tokened(spark, d).select("doc_id", F.regexp_count("t", F.lit(T.VAULT_TOKEN)).cast("long").alias("n_tokens"))


@query(rf"SELECT doc_id, regexp_matches(regexp_replace(t, '{T.VAULT_TOKEN}', '', 'g'), '[\p{{L}}\p{{N}}]') AS has_content FROM ({TOKENED_SQL})")
def residual_content(spark, d):
    return _tokened(spark, d).select("doc_id", T.has_content(F.col("t")).alias("has_content"))


@query(r"""WITH p AS (SELECT event_id, event_type AS kind, 'user ' || user_id || CASE WHEN event_id % 9 = 0 THEN ': x' WHEN event_id % 10 = 0 THEN repeat('n', 20) ELSE '' END AS name FROM events)
SELECT event_id, kind IN ('click', 'purchase', 'view') AND length(name) BETWEEN 1 AND 20 AND regexp_full_match(name, '[\p{L}\p{N} ._-]+') AS ok,
 CASE WHEN kind IN ('click', 'purchase', 'view') AND length(name) BETWEEN 1 AND 20 AND regexp_full_match(name, '[\p{L}\p{N} ._-]+') THEN '{"type":"' || kind || '","name":"' || name || '"}' END AS value FROM p""")
def structured_extract(spark, d):
    from sluiceway.operators.sanitize import extract_structured
    from sluiceway.plans.policy import FieldRule

    schema = {"type": FieldRule("enum", ("click", "purchase", "view")), "name": FieldRule("string", (), 20, "safe-text")}
    tail = F.when(F.col("event_id") % 9 == 0, ": x").when(F.col("event_id") % 10 == 0, F.repeat(F.lit("n"), 20)).otherwise("")
    name = F.concat(F.lit("user "), F.col("user_id").cast("string"), tail)
    payload = F.to_json(F.struct(F.col("event_type").alias("type"), name.alias("name"), F.lit(1).alias("extra")))
    out = extract_structured(table(spark, d, "events").withColumn("payload", payload), "payload", schema)
    return out.select("event_id", "ok", "value")


# -- links and containment


@query("WITH " + CALLS_SQL + ", n AS (SELECT count(*) AS n FROM documents), " + TOKENS_SQL + """, h AS (SELECT doc_id, substr(sha256(token), 1, 32) AS h, length(token) AS l FROM doc_token),
a AS (SELECT session_id, seq, h, l FROM calls, n JOIN h ON doc_id = (event_id * 31 + 7) % n.n WHERE tool = 'send_email'),
r AS (SELECT session_id, seq, h FROM calls, n JOIN h ON doc_id = event_id % n.n)
SELECT a.session_id, a.seq AS child, r.seq AS parent, count(*)::BIGINT AS matches, max(l)::INT AS best_length, arg_min(h, (-l, h)) AS best_hash, count(*) < 2 AND max(l) < 16 AS weak
FROM a JOIN r USING (session_id, h) WHERE r.seq < a.seq GROUP BY ALL""")
def value_match_links(spark, d):
    docs, c = _docs(spark, d), calls(spark, d)
    n = docs.count()
    sent = c.where(F.col("tool") == "send_email").select("session_id", "seq", F.lit(True).alias("asks"), ((F.col("event_id") * 31 + 7) % n).alias("doc_id"))
    # results only of sessions that send something, before they do
    last = sent.groupBy("session_id").agg(F.max("seq").alias("last"))
    held = c.join(last, "session_id").where(F.col("seq") < F.col("last")).select("session_id", "seq", F.lit(False).alias("asks"), (F.col("event_id") % n).alias("doc_id"))
    return links.value_matches_of(sent.unionByName(held), docs, "doc_id", "text")


NODE_SQL = "'tn_' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@query("WITH " + CALLS_SQL + f""", node AS (SELECT session_id, seq, event_id, {NODE_SQL} AS node_id FROM (SELECT *, sha256(session_id || '|' || seq) AS h FROM calls)),
leaf AS (SELECT session_id, seq, CASE WHEN event_id % 3 = 1 THEN 'see ' || prev ELSE prev END AS leaf FROM (SELECT *, lag(node_id) OVER (PARTITION BY session_id ORDER BY seq) AS prev FROM node) WHERE prev IS NOT NULL AND event_id % 3 < 2)
SELECT l.session_id, l.seq AS child, n.seq AS parent FROM leaf l JOIN node n ON n.session_id = l.session_id AND n.node_id = l.leaf AND n.seq < l.seq""")
def explicit_ref_links(spark, d):
    nodes = calls(spark, d).withColumn("node_id", links.node_id(F.col("session_id").cast("string"), F.col("seq").cast("string")))
    prev = F.lag("node_id").over(in_session())
    leaf = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("see "), F.col("prev"))).otherwise(F.col("prev"))
    args = nodes.withColumn("prev", prev).where(F.col("prev").isNotNull() & (F.col("event_id") % 3 < 2)).select("session_id", "seq", leaf.alias("leaf"))
    return links.explicit_links(args, nodes)


@query("WITH " + EDGES_SQL + """, t AS (SELECT session_id, seq, unnest(tags) AS tag FROM node)
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM edge e JOIN t p ON p.session_id = e.session_id AND p.seq = e.parent WHERE e.session_id = t.session_id AND e.child = t.seq AND p.tag = t.tag)""")
def frontier_nodes(spark, d):
    return links.frontier(_nodes(spark, d), _edges(spark, d))


@query("WITH " + EDGES_SQL + """ SELECT e.session_id, e.child, count(*)::BIGINT AS parents, bool_or(list_contains(tags, 'S')) AS s, bool_or(list_contains(tags, 'U')) AS u, string_agg(tool, ',' ORDER BY seq) AS tools
FROM edge e JOIN node n ON n.session_id = e.session_id AND n.seq = e.parent GROUP BY 1, 2""")
def lineage_evidence(spark, d):
    n = _nodes(spark, d).withColumnRenamed("seq", "parent")
    j = _edges(spark, d).join(n, ["session_id", "parent"])
    tools = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("parent", "tool"))), lambda x: x["tool"]), ",")
    return j.groupBy("session_id", "child").agg(
        F.count("*").alias("parents"), F.max(F.array_contains("tags", "S")).alias("s"), F.max(F.array_contains("tags", "U")).alias("u"), tools.alias("tools")
    )


SENT_SQL = """sent AS (SELECT d.doc_id, d.text || ' ' || CASE d.doc_id % 3 WHEN 0 THEN lower(hex(encode(b.text))) WHEN 1 THEN reverse(b.text) ELSE '' END AS text
  FROM documents d JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark) b ON d.doc_id % b.n = b.k)"""


def _sent(spark, d):
    """Documents with a known text behind them: in hexadecimal, reversed, or none."""
    items = table(spark, d, "benchmark")
    n = items.count()
    known = items.select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("k"), F.col("text").alias("item"))  # a stated, small set
    form = F.when(F.col("doc_id") % 3 == 0, F.lower(F.hex(F.col("item").cast("binary")))).when(F.col("doc_id") % 3 == 1, F.reverse("item")).otherwise("")
    return _docs(spark, d).join(known, F.col("doc_id") % n == F.col("k")).select("doc_id", F.concat_ws(" ", "text", form).alias("text"))


def _containment(how: str, text: str, needle: str):
    rows = "sent" if how in ("hex", "reverse") else "documents"

    @query(f"WITH {SENT_SQL} SELECT doc_id, item_id FROM (SELECT doc_id, {text} AS hay FROM {rows}) JOIN (SELECT item_id, {needle} AS n FROM benchmark) ON contains(hay, n) WHERE length(n) >= 12")
    def run(spark, d):
        return links.containment(_sent(spark, d) if rows == "sent" else _docs(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id", how)

    name = f"containment_{how}"
    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_norm = r"lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))"
_containment("exact", "text", "text")
_containment("normalized", _norm, _norm)
_containment("hex", _norm, "lower(hex(encode(text)))")
_containment("reverse", "text", "reverse(text)")


@query("""WITH g AS (SELECT DISTINCT item_id, substr(text, i, 12) AS gram FROM (SELECT item_id, text, unnest(range(1, length(text) - 10)) AS i FROM benchmark WHERE length(text) > 12 AND length(text) <= 256)),
h AS (SELECT DISTINCT doc_id, substr(text, i, 12) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 10)) AS i FROM documents WHERE length(text) >= 12))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (gram)""")
def fragment_12gram(spark, d):
    return links.fragments(_docs(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id")


@query("""WITH v AS (SELECT item_id, text AS original FROM benchmark WHERE length(text) >= 8), c AS (SELECT doc_id, doc_id % 50 AS pos, text FROM documents)
SELECT doc_id, pos, count(*)::BIGINT AS originals FROM c JOIN v ON contains(c.text, v.original) AND v.item_id % 50 < c.pos GROUP BY ALL""")
def vault_resend(spark, d):
    hit = links.containment(_docs(spark, d), table(spark, d, "benchmark").where(F.length("text") >= 8), "doc_id", "item_id", "exact")
    at = hit.withColumn("pos", F.col("doc_id") % 50).where(F.col("item_id") % 50 < F.col("pos"))
    return at.groupBy("doc_id", "pos").agg(F.count("*").alias("originals"))


@query("WITH " + VERDICT_SQL + """, snap AS (SELECT session_id, seq AS snap, ts + INTERVAL 1 MINUTE + INTERVAL 250 MILLISECONDS AS until FROM calls WHERE event_id % 3 = 0)
SELECT session_id, snap, log_seq FROM (SELECT s.session_id, snap, arg_max(seq, (ts, seq)) AS log_seq, arg_max(allowed, (ts, seq)) AS allowed FROM snap s JOIN verdict v ON v.session_id = s.session_id AND v.ts <= s.until GROUP BY 1, 2) WHERE NOT allowed""")
def asof_blocked(spark, d):
    v = _verdicts(spark, d)
    snaps = calls(spark, d).where(F.col("event_id") % 3 == 0).select("session_id", F.col("seq").alias("snap"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts"))
    return links.as_of(v, snaps).where(~F.col("allowed")).select("session_id", "snap", "log_seq")


# -- graph


@query("WITH RECURSIVE " + EDGES_SQL + """, walk AS (SELECT session_id, seq, 0 AS depth FROM node UNION ALL SELECT e.session_id, e.child, w.depth + 1 FROM walk w JOIN edge e ON e.session_id = w.session_id AND e.parent = w.seq)
SELECT session_id, seq, max(depth)::INT AS depth FROM walk GROUP BY 1, 2""")
def node_depth(spark, d):
    return graph.depths(_nodes(spark, d), _edges(spark, d))


@query("WITH RECURSIVE " + EDGES_SQL + """, walk AS (SELECT session_id, seq AS start, seq AS node FROM flags WHERE s UNION SELECT w.session_id, w.start, e.child FROM walk w JOIN edge e ON e.session_id = w.session_id AND e.parent = w.node)
SELECT session_id, start, count(*)::BIGINT AS reached FROM walk WHERE node <> start GROUP BY 1, 2""")
def cascade_descendants(spark, d):
    return graph.descendant_counts(_flags(spark, d).where(F.col("s")), _nodes(spark, d), _edges(spark, d))


@query("WITH " + EDGES_SQL + " SELECT session_id, seq FROM node n WHERE len(tags) = 0 AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.session_id = n.session_id AND e.parent = n.seq)")
def prune_candidates(spark, d):
    return graph.prunable(_nodes(spark, d), _edges(spark, d))


@query("WITH RECURSIVE " + EDGES_SQL + """, up AS (SELECT session_id, seq FROM node WHERE len(tags) > 0 UNION SELECT e.session_id, e.parent FROM up u JOIN edge e ON e.session_id = u.session_id AND e.child = u.seq)
SELECT session_id, seq FROM node n WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.session_id = n.session_id AND up.seq = n.seq)""")
def prune_fixpoint(spark, d):
    return graph.prune(_nodes(spark, d), _edges(spark, d))


_DEPTH = "WITH RECURSIVE " + EDGES_SQL + """, walk AS (SELECT session_id, seq, 0 AS depth FROM node UNION ALL SELECT e.session_id, e.child, w.depth + 1 FROM walk w JOIN edge e ON e.session_id = w.session_id AND e.parent = w.seq),
dep AS (SELECT session_id, seq, max(depth)::INT AS depth FROM walk GROUP BY 1, 2)"""


BLOCKS_SQL = """, verdict AS (SELECT *, NOT (sink = 'OUTBOUND_SINK' AND s_before AND exposed) AS allowed FROM (
    SELECT *, coalesce(bool_or(s) OVER w, false) AS s_before, coalesce(bool_or(u) OVER w, false) AS exposed FROM flags
    WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
hit AS (SELECT session_id, max(seq) AS blocked_seq, arg_max(tool, seq) AS blocked_tool FROM verdict WHERE NOT allowed GROUP BY 1),
deep AS (SELECT d.session_id, n.tool, arg_max(d.seq, (depth, -d.seq)) AS seq, max(depth) AS depth FROM dep d JOIN node n ON n.session_id = d.session_id AND n.seq = d.seq
  WHERE len(tags) > 0 AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.session_id = d.session_id AND hit.blocked_tool = n.tool) GROUP BY 1, 2)"""


def _deepest(spark, d):
    n = _nodes(spark, d)
    depth = graph.depths(n, _edges(spark, d)).join(n.where(F.size("tags") > 0), ["session_id", "seq"])
    return views.deepest(depth, views.last_blocks(_verdicts(spark, d)))


@query(_DEPTH + BLOCKS_SQL + " SELECT session_id, tool, seq, depth FROM deep")
def deepest_by_tool(spark, d):
    return _deepest(spark, d)


@query(_DEPTH + " SELECT session_id, seq, depth, row_number() OVER (PARTITION BY session_id, depth ORDER BY seq) - 1 AS slot FROM dep")
def depth_slots(spark, d):
    return views.slots(graph.depths(_nodes(spark, d), _edges(spark, d)))


# -- approvals and audit

ACTIONS = ("OFFERED", "REQUESTED", "APPROVED", "REJECTED", "SUPERSEDED")


@query("""WITH h AS (SELECT event_id // 3 AS approval_id, ts, event_id, ['OFFERED', 'REQUESTED', 'APPROVED', 'REJECTED', 'SUPERSEDED'][(event_id % 5 + 1)::INT] AS action FROM events)
SELECT approval_id, arg_max(action, (ts, event_id)) AS action, CASE WHEN arg_max(action, (ts, event_id)) IN ('OFFERED', 'REQUESTED') THEN 'PENDING' ELSE arg_max(action, (ts, event_id)) END AS status FROM h GROUP BY 1""")
def approval_latest_state(spark, d):
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("event_id") % 5 + 1).cast("int"))
    h = table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("approval_id"), "ts", "event_id", action.alias("action"))
    last = audit.latest_by(h, "approval_id", "ts", "event_id")
    return last.select("approval_id", "action", F.when(F.col("action").isin("OFFERED", "REQUESTED"), "PENDING").otherwise(F.col("action")).alias("status"))


@query("WITH " + EDGES_SQL + """ SELECT e.session_id, e.child, bool_and(e.child % 2 = 0 OR len(tags) = 0) AND e.child % 5 <> 0 AS can_override
FROM edge e JOIN node n ON n.session_id = e.session_id AND n.seq = e.parent GROUP BY e.session_id, e.child""")
def approval_overridable(spark, d):
    n = _nodes(spark, d).withColumnRenamed("seq", "parent")
    nodes = F.collect_list(F.struct((F.col("child") % 2 == 0).alias("weak"), "tags"))
    e = _edges(spark, d).join(n, ["session_id", "parent"]).groupBy("session_id", "child").agg(nodes.alias("nodes"))
    arg_tags = F.when(F.col("child") % 5 == 0, F.array(F.lit("SENSITIVE"))).otherwise(F.array().cast("array<string>"))
    return e.select("session_id", "child", audit.overridable(F.col("nodes"), arg_tags).alias("can_override"))


@query("WITH " + CALLS_SQL + """, signed AS (SELECT *, sha256(session_id || '|' || seq || '|' || tool) AS signature FROM calls),
log AS (SELECT session_id, seq, CASE WHEN event_id % 97 = 0 THEN 'forged' ELSE tool END AS tool, signature, CASE WHEN event_id % 89 = 0 THEN 'x' ELSE lag(signature) OVER (PARTITION BY session_id ORDER BY seq) END AS prev_hash, event_id % 101 = 0 AS bad FROM signed)
SELECT session_id, seq, CASE WHEN bad THEN 'PARSE_ERROR' WHEN signature <> sha256(session_id || '|' || seq || '|' || tool) THEN 'SIGNATURE_MISMATCH' WHEN prev_hash IS DISTINCT FROM expected THEN 'CHAIN_BREAK' END AS problem
FROM (SELECT *, lag(CASE WHEN NOT bad THEN signature END) OVER (PARTITION BY session_id ORDER BY seq) AS expected FROM log)""")
def audit_chain_verify(spark, d):
    sign = lambda: audit.signature(F.col("session_id"), F.col("seq"), F.col("tool"))
    c = calls(spark, d).withColumn("signature", sign())
    prev = F.when(F.col("event_id") % 89 == 0, "x").otherwise(F.lag("signature").over(in_session()))
    log = c.withColumn("prev_hash", prev).withColumn("tool", F.when(F.col("event_id") % 97 == 0, "forged").otherwise(F.col("tool")))
    out = audit.verify_chain(log, ["user_id", "session_id"], "seq", sign(), F.col("event_id") % 101 == 0)
    return out.select("session_id", "seq", "problem")


@query("WITH " + VERDICT_SQL + """, line AS (SELECT ts, event_id, 'decision' AS kind, CASE WHEN allowed THEN 'ALLOWED' ELSE 'BLOCKED' END AS what FROM verdict
UNION ALL SELECT ts, event_id, 'hitl', 'OFFERED' FROM verdict WHERE NOT allowed) SELECT ts, event_id, kind, what FROM line""")
def audit_timeline(spark, d):
    v = _verdicts(spark, d)
    a = v.select("ts", "event_id", F.lit("decision").alias("kind"), F.when(F.col("allowed"), "ALLOWED").otherwise("BLOCKED").alias("what"))
    b = v.where(~F.col("allowed")).select("ts", "event_id", F.lit("hitl").alias("kind"), F.lit("OFFERED").alias("what"))
    return audit.timeline(a, b).orderBy(F.desc("ts"), "kind")


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN '{"kind":"purchase","k":"' || (props->>'k') || '"}' ELSE '{"kind":"' || event_type || '"}' END AS kept,
CASE WHEN event_type = 'purchase' THEN 'user' ELSE 'k,user' END AS dropped FROM events""")
def whitelist_projection(spark, d):
    """Fields of an event that its type allows, and the names of those that are dropped."""
    f = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string"))
    allowed = F.when(F.col("event_type") == "purchase", F.array(F.lit("kind"), F.lit("k"))).otherwise(F.array(F.lit("kind")))
    e = table(spark, d, "events").select("event_id", f.alias("f"), allowed.alias("ok"))
    kept = F.to_json(F.map_filter("f", lambda k, _: F.array_contains("ok", k)))
    return e.select("event_id", kept.alias("kept"), F.array_join(F.array_sort(F.array_except(F.map_keys("f"), "ok")), ",").alias("dropped"))


@query("WITH " + VERDICT_SQL + """ SELECT event_id, CASE WHEN allowed THEN NULL ELSE tool END AS args, CASE WHEN allowed THEN 'ALLOWED' ELSE 'BLOCKED' END AS decision,
concat_ws(',', CASE WHEN s_before THEN 'SENSITIVE' END, CASE WHEN exposed THEN 'UNTRUSTED_ORIGIN' END) AS tags FROM verdict""")
def decision_events(spark, d):
    """Decisions as views show them; arguments only of what was blocked."""
    v = _verdicts(spark, d)
    return v.select(
        "event_id", F.when(~F.col("allowed"), F.col("tool")).alias("args"), F.when(F.col("allowed"), "ALLOWED").otherwise("BLOCKED").alias("decision"),
        classify.tag_list(F.col("s_before"), F.col("exposed")).alias("tags"),
    )


@query(_DEPTH + BLOCKS_SQL + """ SELECT session_id, 'node' AS kind, seq AS a, NULL::BIGINT AS b FROM node UNION ALL SELECT session_id, 'edge', parent, child FROM edge
UNION ALL SELECT session_id, 'sink', blocked_seq, NULL FROM hit UNION ALL SELECT session_id, 'dashed', deep.seq, blocked_seq FROM deep JOIN hit USING (session_id)""")
def graph_model(spark, d):
    """Rows to draw a session's graph from: nodes, edges and, where its last block is, a sink with dashed edges from the deepest tainted nodes."""
    n, e = _nodes(spark, d), _edges(spark, d)
    hit = views.last_blocks(_verdicts(spark, d))
    none = F.lit(None).cast("long")
    row = lambda kind, a, b: ("session_id", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    return (
        n.select(*row("node", F.col("seq"), none)).unionByName(e.select(*row("edge", F.col("parent"), F.col("child"))))
        .unionByName(hit.select(*row("sink", F.col("blocked_seq"), none))).unionByName(_deepest(spark, d).join(hit, "session_id").select(*row("dashed", F.col("seq"), F.col("blocked_seq"))))
    )


@query("SELECT conv_id, count(*)::BIGINT AS turns, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def extract_text(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(parts, "\n").alias("text"))


@query("""WITH h AS (SELECT event_id // 3 AS approval_id, ts, event_id, ['OFFERED', 'REQUESTED', 'APPROVED', 'REJECTED', 'SUPERSEDED'][(event_id % 5 + 1)::INT] AS action FROM events)
SELECT approval_id, event_id, next_ts IS NULL OR next_ts > ts + INTERVAL 5 SECONDS AS timed_out FROM (SELECT *, lead(ts) OVER (PARTITION BY approval_id ORDER BY ts, event_id) AS next_ts FROM h) WHERE action = 'REQUESTED'""")
def approval_timeouts(spark, d):
    """Requests without an answer within five seconds."""
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("event_id") % 5 + 1).cast("int"))
    h = table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("approval_id"), "ts", "event_id", action.alias("action"))
    h = h.withColumn("next_ts", F.lead("ts").over(Window.partitionBy("approval_id").orderBy("ts", "event_id"))).where(F.col("action") == "REQUESTED")
    return h.select("approval_id", "event_id", (F.col("next_ts").isNull() | (F.col("next_ts") > F.col("ts") + F.expr("INTERVAL 5 SECONDS"))).alias("timed_out"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'source' ELSE 'content' END AS origin FROM documents WHERE doc_id % 3 = 0 OR {SECRETS_SQL}")
def sensitive_payloads(spark, d):
    """Payloads that hold the sensitive tag, with where it came from."""
    p = _docs(spark, d).where((F.col("doc_id") % 3 == 0) | has_secret(F.col("text")))
    return p.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "source").otherwise("content").alias("origin"))


# -- views


@query("WITH " + VERDICT_SQL + " SELECT session_id, count(*)::BIGINT AS total, count(*) FILTER (NOT allowed)::BIGINT AS blocked, count(*) FILTER (allowed)::BIGINT AS passed, count(*) FILTER (sink = 'OUTBOUND_SINK')::BIGINT AS outbound FROM verdict GROUP BY 1")
def metric_cards(spark, d):
    return views.metric_cards(_verdicts(spark, d))


@query("WITH " + VERDICT_SQL + """, b AS (SELECT session_id, arg_max(tool, seq) AS last_tool, arg_max(classified, seq) AS known FROM verdict WHERE NOT allowed GROUP BY 1),
c AS (SELECT session_id, arg_max(value > 60, seq) AS inj FROM verdict WHERE u GROUP BY 1), f AS (SELECT b.*, 1 + coalesce(inj, false)::INT + (NOT known)::INT AS signals FROM b LEFT JOIN c USING (session_id))
SELECT session_id, last_tool, signals, CASE WHEN signals >= 3 THEN 'high' ELSE 'caution' END AS level FROM f""")
def threat_fusion(spark, d):
    v = _verdicts(spark, d)
    return views.threat_fusion(v, v.where(F.col("u")).select("session_id", "seq", (F.col("value") > 60).alias("is_injection")))


@query("WITH " + FLAGS_SQL + " SELECT session_id, tool, bool_or(s) AS s, bool_or(u) AS u, count(*)::BIGINT AS n FROM flags WHERE (s OR u) AND tool <> 'send_email' GROUP BY 1, 2")
def flow_sources(spark, d):
    return views.flow_sources(_flags(spark, d))


@query("WITH " + VERDICT_SQL + """, hit AS (SELECT DISTINCT session_id, tool FROM verdict WHERE NOT allowed), t AS (SELECT DISTINCT session_id, tool, s, u FROM flags)
SELECT h.session_id, h.tool, coalesce((SELECT string_agg(DISTINCT t.tool, ',' ORDER BY t.tool) FROM t WHERE t.session_id = h.session_id AND s AND t.tool <> h.tool), '') AS sensitive_from,
 coalesce((SELECT string_agg(DISTINCT t.tool, ',' ORDER BY t.tool) FROM t WHERE t.session_id = h.session_id AND u AND t.tool <> h.tool), '') AS untrusted_from FROM hit h""")
def block_reason(spark, d):
    return views.block_reason(_verdicts(spark, d), _flags(spark, d))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 1000")
def shadow_ring_1000(spark, d):
    return views.ring(table(spark, d, "events").select("event_type", "event_id", "ts"), "event_type", ["ts", "event_id"], 1000).select("event_type", "event_id")


# -- accuracy reports


@query("WITH RECURSIVE " + RECORDS_SQL + " SELECT mode, " + ", ".join(f"count(*) FILTER (outcome = '{x}')::BIGINT AS {x.lower()}" for x in ("TP", "FP", "TN", "FN")) + " FROM rec GROUP BY 1")
def confusion_matrix(spark, d):
    return reports.confusion(_records(spark, d), "mode")


@query("WITH RECURSIVE " + RECORDS_SQL + """ SELECT mode, round(coalesce(count(*) FILTER (outcome = 'FP' AND category = 'normal') / nullif(count(*) FILTER (category = 'normal'), 0), 0), 6) AS fp_rate,
round(coalesce(count(*) FILTER (outcome = 'FN' AND category = 'attack') / nullif(count(*) FILTER (category = 'attack'), 0), 0), 6) AS fn_rate FROM rec GROUP BY 1""")
def fp_fn_rates(spark, d):
    return reports.error_rates(_records(spark, d), "mode")


@query("WITH RECURSIVE " + RECORDS_SQL + """ SELECT mode, count(*) FILTER (outcome = 'FP')::BIGINT AS fp, count(*) FILTER (outcome = 'FN')::BIGINT AS fn, count(*) FILTER (expect = 'pass')::BIGINT AS by_label_pass,
count(*) FILTER (expect = 'block')::BIGINT AS by_label_block, count(*) FILTER (category = 'normal')::BIGINT AS by_category_normal, count(*) FILTER (category = 'attack')::BIGINT AS by_category_attack FROM rec GROUP BY 1""")
def dual_denominator(spark, d):
    return reports.denominators(_records(spark, d), "mode")


def _pivot_sql(bucket: str) -> str:
    cols = ", ".join(f"count(*) FILTER (mode = '{m}')::BIGINT AS {m}_total, count(*) FILTER (mode = '{m}' AND outcome IN ('FP', 'FN'))::BIGINT AS {m}_miss" for m in ("session", "lineage"))
    return "WITH RECURSIVE " + RECORDS_SQL + f" SELECT {bucket}, {cols} FROM rec GROUP BY 1"


@query("WITH RECURSIVE " + RECORDS_SQL + " SELECT tier, " + ", ".join(f"count(*) FILTER (mode = '{m}')::BIGINT AS {m}_total, count(*) FILTER (mode = '{m}' AND outcome = CASE WHEN tier IN ('easy', 'boundary') THEN 'FP' ELSE 'FN' END)::BIGINT AS {m}_miss" for m in ("session", "lineage")) + " FROM rec GROUP BY 1")
def tier_breakdown(spark, d):
    return reports.tier_rates(_records(spark, d))


@query(_pivot_sql("tool"))
def tool_pivot(spark, d):
    return reports.pivot_rates(_records(spark, d), "tool")


FORMS_SQL = "CASE WHEN coalesce(title, '') = '' THEN '미분류' " + " ".join(f"WHEN contains(title, '{x}') THEN '{y}'" for x, y in reports.LEAK_FORMS) + " ELSE '미분류' END"
NORMAL_SQL = "CASE WHEN coalesce(title, '') = '' THEN '미분류' WHEN contains(title, ': ') THEN substr(title, position(': ' IN title) + 2) ELSE title END"
LENGTH_SQL = "CASE WHEN regexp_matches(title, '[0-9]자') THEN regexp_extract(title, '([0-9])자', 1) || '자' ELSE '?' END"
FORM_SQL = "CASE WHEN contains(lower(title), 'base64') THEN 'base64' WHEN contains(lower(title), 'hex') THEN 'hex' ELSE '원문' END"
VARIANT_SQL = r"CASE WHEN regexp_matches(title, '\[축3/[^\]]+\]') THEN regexp_extract(title, '\[축3/([^\]]+)\]', 1) ELSE '?' END"
AXIS_SQL = "CASE WHEN substr(point, 2)::INT <= 30 THEN 1 WHEN substr(point, 2)::INT <= 58 THEN 2 WHEN substr(point, 2)::INT <= 92 THEN 3 ELSE 4 END"
BRANCH_SQL = "CASE WHEN substr(point, 2)::INT <= 92 THEN '' WHEN substr(point, 2)::INT <= 110 THEN '4a' WHEN substr(point, 2)::INT <= 124 THEN '4b' ELSE '4c' END"
COLUMNS = [(c, m) for c in ("off", "scan-clean") for m in ("session", "lineage")]


@query("WITH RECURSIVE " + RECORDS_SQL + f" SELECT event_id, {FORMS_SQL} AS leak_form, {NORMAL_SQL} AS normal_form, {LENGTH_SQL} AS secret_length, {FORM_SQL} AS secret_form, {VARIANT_SQL} AS variant, {AXIS_SQL} AS axis, {BRANCH_SQL} AS branch FROM evals")
def title_classes(spark, d):
    """What reports read from a point's title and number."""
    r = _records(spark, d).where(F.col("mode") == "session")
    t, p = F.col("title"), F.col("point")
    return r.select(
        "event_id", reports.leak_form(t).alias("leak_form"), reports.normal_form(t).alias("normal_form"), reports.secret_length(t).alias("secret_length"), reports.secret_form(t).alias("secret_form"),
        reports.variant(t).alias("variant"), reports.axis(p).alias("axis"), reports.branch(p).alias("branch"),
    )


def _share_sql(miss: str, of: str) -> str:
    return f"CASE WHEN count(*) FILTER ({of}) > 0 THEN (count(*) FILTER ({of} AND {miss}))::VARCHAR || '/' || (count(*) FILTER ({of}))::VARCHAR || ' (' || printf('%.1f', round((count(*) FILTER ({of} AND {miss}))::DOUBLE / count(*) FILTER ({of}) * 100, 1)) || '%)' ELSE '-' END"


def _cells_sql(miss: str) -> str:
    return ", ".join(_share_sql(miss, f"condition = '{c}' AND mode = '{m}'") + f" AS {c}_{m}".replace("-", "_") for c, m in COLUMNS)


def _bucket_sql(bucket: str, kind: str, order: tuple[str, ...] = ()) -> str:
    first = "CASE bucket " + " ".join(f"WHEN '{b}' THEN '{i:04d}'" for i, b in enumerate(order)) + f" ELSE '{len(order):04d}' END" if order else "'0000'"
    cells = _cells_sql(f"outcome = '{kind}'")
    natural = "array_to_string(list_transform(regexp_extract_all(bucket, '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(t, 20, '0') ELSE t END), '')"
    return (
        "WITH RECURSIVE " + RECORDS_SQL + f", b AS (SELECT *, {bucket} AS bucket FROM every WHERE expect = '{'block' if kind == 'FN' else 'pass'}') "
        f"SELECT bucket, count(*) FILTER (condition = 'off' AND mode = 'session')::BIGINT AS points, {cells}, {first} || {natural} AS rank FROM b WHERE bucket IS NOT NULL GROUP BY bucket"
    )


@query(_bucket_sql(FORMS_SQL, "FN", tuple(y for _, y in reports.LEAK_FORMS)))
def leak_form_pivot(spark, d):
    return reports.bucket_table(_all_records(spark, d), reports.leak_form(F.col("title")), "FN", COLUMNS, tuple(y for _, y in reports.LEAK_FORMS))


@query(_bucket_sql(f"'축 ' || {AXIS_SQL}", "FN", ("축 1", "축 2", "축 3", "축 4")))
def axis_table(spark, d):
    name = F.concat(F.lit("축 "), reports.axis(F.col("point")).cast("string"))
    return reports.bucket_table(_all_records(spark, d), name, "FN", COLUMNS, ("축 1", "축 2", "축 3", "축 4"))


@query(_bucket_sql(f"CASE WHEN {AXIS_SQL} = 1 THEN {LENGTH_SQL} || '·' || {FORM_SQL} END", "FN"))
def length_form_table(spark, d):
    t = F.col("title")
    both = F.concat_ws("·", reports.secret_length(t), reports.secret_form(t))
    return reports.bucket_table(_all_records(spark, d), F.when(reports.axis(F.col("point")) == 1, both), "FN", COLUMNS)


@query(_bucket_sql(f"CASE WHEN {AXIS_SQL} = 2 THEN (event_id % 23)::VARCHAR || '자' END", "FN"))
def fragment_table(spark, d):
    """By the length of the fragment that a point carries, in the order of the numbers."""
    length = F.concat((F.col("event_id") % 23).cast("string"), F.lit("자"))
    return reports.bucket_table(_all_records(spark, d), F.when(reports.axis(F.col("point")) == 2, length), "FN", COLUMNS)


@query(_bucket_sql(f"CASE WHEN {AXIS_SQL} = 3 THEN {VARIANT_SQL} END", "FN"))
def variant_table(spark, d):
    return reports.bucket_table(_all_records(spark, d), F.when(reports.axis(F.col("point")) == 3, reports.variant(F.col("title"))), "FN", COLUMNS)


@query(_bucket_sql(f"CASE WHEN {AXIS_SQL} = 4 THEN {BRANCH_SQL} END", "FP", ("4a",)))
def branch_table(spark, d):
    return reports.bucket_table(_all_records(spark, d), F.when(reports.axis(F.col("point")) == 4, reports.branch(F.col("point"))), "FP", COLUMNS, ("4a",))


# each slice: the points it has, their bucket, the kind of miss; SQL and columns side by side
SLICES = {
    "sink normals": ("expect = 'pass'", "CASE WHEN classified THEN 'sink' ELSE 'neutral' END", "FP"),
    "sink normals by category": ("expect = 'pass' AND classified", "category", "FP"),
    "logical form": ("expect = 'pass' AND classified", NORMAL_SQL, "FP"),
    "leak form": ("expect = 'block'", FORMS_SQL, "FN"),
    "tag basis": ("expect = 'block'", "CASE WHEN s_before THEN 'by source' ELSE 'none' END", "FN"),
    "registration": ("expect = 'pass'", "CASE WHEN classified THEN 'registered' ELSE 'unregistered' END", "FP"),
    "nature of unregistered": ("expect = 'pass' AND NOT classified", "tool", "FP"),
    "share of false positives": ("outcome = 'FP'", "CASE WHEN classified THEN 'registered' ELSE 'unregistered' END", "FP"),
    "origin of exposure": ("outcome = 'FP'", "CASE WHEN exposed THEN 'untrusted source' ELSE 'default deny' END", "FP"),
}


@query("WITH RECURSIVE " + RECORDS_SQL + ", x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS slice, {b} AS bucket, mode, outcome = '{k}' AS miss FROM rec WHERE {t}" for n, (t, b, k) in SLICES.items()) + """)
SELECT slice, bucket, """ + ", ".join(f"count(*) FILTER (mode = '{m}')::BIGINT AS {m}_total, count(*) FILTER (mode = '{m}' AND miss)::BIGINT AS {m}_miss" for m in ("session", "lineage")) + " FROM x GROUP BY 1, 2")
def report_slices(spark, d):
    """All cuts of the accuracy report in one pass."""
    forms = {"leak form": reports.leak_form(F.col("title")), "logical form": reports.normal_form(F.col("title"))}
    return reports.slices(_records(spark, d), {n: (F.expr(t), forms.get(n, F.expr(b) if n not in forms else None), k) for n, (t, b, k) in SLICES.items()})


METRICS = {
    "FP of pass": ("expect = 'pass'", "FP"), "FN of block": ("expect = 'block'", "FN"), "FP of normal": ("category = 'normal'", "FP"), "FN of attack": ("category = 'attack'", "FN"),
    "FN of easy tiers": ("tier IN ('easy', 'boundary')", "FN"), "FP of unregistered": ("NOT classified AND expect = 'pass'", "FP"),
}


@query("WITH RECURSIVE " + RECORDS_SQL + ", x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, condition, mode, outcome = '{k}' AS miss FROM every WHERE {t}" for n, (t, k) in METRICS.items()) + f") SELECT metric, {_cells_sql('miss')} FROM x GROUP BY 1")
def condition_comparison(spark, d):
    return reports.comparison(_all_records(spark, d), {n: (F.expr(t), k) for n, (t, k) in METRICS.items()}, COLUMNS)


def extension_report(spark, d) -> str:
    """The accuracy report as one document."""
    r = _records(spark, d).cache()
    try:
        forms = tuple(y for _, y in reports.LEAK_FORMS)
        sections = [
            ("Outcomes", reports.confusion(r, "mode")), ("Denominators", reports.denominators(r, "mode")), ("Tiers", reports.tier_rates(r)),
            ("Leak forms", reports.bucket_table(r, reports.leak_form(F.col("title")), "FN", COLUMNS[:2], forms).orderBy("rank").drop("rank")), ("Doubts", reports.honesty(r, "mode")),
        ]
        return reports.document("Accuracy", sections)
    finally:
        r.unpersist()


def limits_report(spark, d) -> str:
    """The report on the limits of detection, by axis, as one document."""
    axes = [("Axes", axis_table), ("Length and form", length_form_table), ("Fragments", fragment_table), ("Variants", variant_table), ("Branches", branch_table)]
    return reports.document("Limits", [(n, f(spark, d).orderBy("rank").drop("rank")) for n, f in axes] + [("Comparison", condition_comparison(spark, d).orderBy("metric"))])


@query("WITH RECURSIVE " + RECORDS_SQL + " SELECT coalesce(tool, 'all') AS tool, coalesce(tier, 'all') AS tier, grouping(tool)::INT AS g_tool, grouping(tier)::INT AS g_tier, count(*)::BIGINT AS n, count(*) FILTER (outcome IN ('FP', 'FN'))::BIGINT AS miss FROM rec GROUP BY CUBE (tool, tier)")
def limits_axis_cube(spark, d):
    c = _records(spark, d).cube("tool", "tier").agg(
        F.grouping("tool").cast("int").alias("g_tool"), F.grouping("tier").cast("int").alias("g_tier"), F.count("*").alias("n"), F.count_if(F.col("outcome").isin("FP", "FN")).alias("miss")
    )
    return c.withColumn("tool", F.coalesce("tool", F.lit("all"))).withColumn("tier", F.coalesce("tier", F.lit("all")))


@query("WITH RECURSIVE " + RECORDS_SQL + """ SELECT mode, round(avg(value), 6) AS mean, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS median, list_sort(list(value))[floor(count(*) * 0.95)::INT + 1] AS p95, min(value) AS least, max(value) AS most FROM rec GROUP BY 1""")
def latency_stats(spark, d):
    return reports.latency(_records(spark, d), "value", "mode")


@query("WITH RECURSIVE " + RECORDS_SQL + """ SELECT tool, mode, concat_ws(',', CASE WHEN count(*) FILTER (outcome = 'FP') = 0 THEN 'no_fp' END, CASE WHEN count(*) FILTER (outcome = 'FN') = 0 THEN 'no_fn' END,
CASE WHEN count(*) FILTER (tier = 'boundary') = 0 THEN 'no_boundary' END, CASE WHEN count(*) FILTER (tier = 'subtle') = 0 THEN 'no_subtle' END) AS flags FROM rec GROUP BY 1, 2""")
def honesty_flags(spark, d):
    return reports.honesty(_records(spark, d), "tool", "mode")


@query("WITH RECURSIVE " + RECORDS_SQL + """ SELECT session_id || CASE WHEN eval_index > 0 THEN '#' || eval_index ELSE '' END AS rec_id, mode, outcome, tier FROM rec WHERE outcome IN ('FP', 'FN')""")
def fp_fn_id_list(spark, d):
    rec = F.concat(F.col("session_id").cast("string"), F.when(F.col("eval_index") > 0, F.concat(F.lit("#"), F.col("eval_index").cast("string"))).otherwise(""))
    return _records(spark, d).where(F.col("outcome").isin("FP", "FN")).select(rec.alias("rec_id"), "mode", "outcome", "tier")


@query("WITH RECURSIVE " + RECORDS_SQL + """ SELECT a.session_id, a.eval_index, a.ok AS session_ok, b.ok AS lineage_ok FROM rec a JOIN rec b ON a.session_id = b.session_id AND a.eval_index = b.eval_index AND a.mode = 'session' AND b.mode = 'lineage' WHERE a.ok <> b.ok""")
def mode_diff(spark, d):
    r = _records(spark, d)
    one = lambda m: r.where(F.col("mode") == m).select("session_id", "eval_index", F.col("ok").alias(f"{m}_ok"))
    return one("session").join(one("lineage"), ["session_id", "eval_index"]).where(F.col("session_ok") != F.col("lineage_ok"))


@query("WITH RECURSIVE " + RECORDS_SQL + """ SELECT session_id, mode, arg_max(expect, eval_index) AS expect, arg_max(ok, eval_index) AS ok FROM rec GROUP BY 1, 2""")
def last_expect(spark, d):
    return _records(spark, d).groupBy("session_id", "mode").agg(F.max_by("expect", "eval_index").alias("expect"), F.max_by("ok", "eval_index").alias("ok"))


@query("WITH " + FLAGS_SQL + " SELECT session_id, bool_or(s) AS reads_sensitive, bool_or(u) AS reads_untrusted, bool_or(sink = 'OUTBOUND_SINK') AS has_sink, bool_or(NOT classified) AS has_unknown FROM flags GROUP BY 1")
def scenario_facts(spark, d):
    return _flags(spark, d).groupBy("session_id").agg(
        F.max("s").alias("reads_sensitive"), F.max("u").alias("reads_untrusted"), F.max(F.col("sink") == classify.OUTBOUND).alias("has_sink"), F.max(~F.col("classified")).alias("has_unknown")
    )


@query("WITH " + FLAGS_SQL + """, f AS (SELECT session_id, bool_or(s) AS s FROM flags GROUP BY 1 HAVING bool_or(u)), i(goal, reads) AS (VALUES ('send_money', false), ('mail_inbox', true), ('post_secret', true))
SELECT session_id, goal FROM f, i WHERE s OR reads""")
def exposed_x_injection(spark, d):
    f = _flags(spark, d).groupBy("session_id").agg(F.max("s").alias("s"), F.max("u").alias("u")).where(F.col("u"))
    return scenarios.with_injections(f, [("send_money", False), ("mail_inbox", True), ("post_secret", True)])


@query("WITH " + CALLS_SQL + """, n AS (SELECT count(*) AS n FROM documents), marker AS (SELECT text FROM benchmark WHERE item_id % 2 = 0),
held AS (SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM marker m WHERE contains(d.text, m.text)))
SELECT DISTINCT session_id FROM calls, n WHERE tool IN ('fetch_web_page', 'read_email') AND event_id % n.n IN (SELECT doc_id FROM held)""")
def exposed_sessions(spark, d):
    """Sessions that have read a result with any of the injected markers."""
    docs = _docs(spark, d)
    n = docs.count()
    markers = table(spark, d, "benchmark").where(F.col("item_id") % 2 == 0).select(F.col("item_id").alias("marker"), "text")
    hits = links.containment(docs, markers, "doc_id", "marker", "plain").select("doc_id").distinct()
    read = calls(spark, d).where(F.col("tool").isin("fetch_web_page", "read_email")).select("session_id", (F.col("event_id") % n).alias("doc_id"))
    return read.join(hits, "doc_id", "left_semi").select("session_id").distinct()


@query("WITH " + FLAGS_SQL + """ SELECT (session_id % 5)::INT AS suite, count(DISTINCT session_id)::BIGINT AS sessions, string_agg(DISTINCT CASE WHEN s THEN tool END, ',' ORDER BY CASE WHEN s THEN tool END) AS sensitive_tools,
string_agg(DISTINCT CASE WHEN u THEN tool END, ',' ORDER BY CASE WHEN u THEN tool END) AS untrusted_tools FROM flags GROUP BY 1""")
def config_tool_union(spark, d):
    join = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c), F.col("tool")))), ",")
    return _flags(spark, d).groupBy((F.col("session_id") % 5).cast("int").alias("suite")).agg(
        F.countDistinct("session_id").alias("sessions"), join("s").alias("sensitive_tools"), join("u").alias("untrusted_tools")
    )


@query("WITH " + CALLS_SQL + " SELECT 's' || (user_id % 3) || '.' || tool AS name, count(*)::BIGINT AS n FROM calls GROUP BY 1")
def federated_catalog(spark, d):
    """Tools of several servers in one catalogue, each under its server's name."""
    return calls(spark, d).groupBy(T.agent_tool(F.concat(F.lit("s"), F.col("user_id") % 3), F.col("tool")).alias("name")).agg(F.count("*").alias("n"))


@query("WITH " + VERDICT_SQL + """, snap AS (SELECT session_id, seq AS snap, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 250 MILLISECONDS END AS until FROM calls WHERE event_id % 5 = 0)
SELECT s.session_id, snap, arg_max(v.seq, (ts, seq)) AS log_seq FROM snap s JOIN verdict v ON v.session_id = s.session_id AND (until IS NULL OR v.ts <= until) GROUP BY 1, 2""")
def asof_without_time(spark, d):
    """Snapshots without a time take the last row of their log."""
    snaps = calls(spark, d).where(F.col("event_id") % 5 == 0).select("session_id", F.col("seq").alias("snap"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("ts"))
    return links.as_of(_verdicts(spark, d), snaps).select("session_id", "snap", "log_seq")


@query("WITH " + VERDICT_SQL + """, f AS (SELECT session_id, count(*)::BIGINT AS forwarded FROM calls WHERE event_id % 3 = 1 GROUP BY 1), p AS (SELECT session_id, count(*)::BIGINT AS pending FROM calls WHERE event_id % 4 = 1 GROUP BY 1),
m AS (SELECT session_id, count(*)::BIGINT AS total, count(*) FILTER (NOT allowed)::BIGINT AS blocked, count(*) FILTER (allowed)::BIGINT AS passed, count(*) FILTER (sink = 'OUTBOUND_SINK')::BIGINT AS outbound FROM verdict GROUP BY 1)
SELECT m.*, coalesce(forwarded, 0) AS forwarded, coalesce(pending, 0) AS pending FROM m LEFT JOIN f USING (session_id) LEFT JOIN p USING (session_id)""")
def metric_cards_full(spark, d):
    """The cards with what was forwarded and what waits for an approval."""
    c = calls(spark, d)
    waits = c.select("session_id", F.when(F.col("event_id") % 4 == 1, "PENDING").otherwise("APPROVED").alias("status"))
    return views.metric_cards(_verdicts(spark, d), c.where(F.col("event_id") % 3 == 1), waits)


FRAME_SQL = """CASE event_id % 4 WHEN 0 THEN '{"type":"decision","sessionId":"' || user_id || '","toolName":"' || event_type || '","secret":"x","explanation":{"summary":"s","node":"tn_1","actions":[{"kind":"k","raw":"r"}]}}'
 WHEN 1 THEN '{"type":"lineage","nodes":[{"id":"n","toolName":"t","payload":"p","parents":[{"nodeId":"m","token":"q"}]}],"sessionId":"' || user_id || '"}' WHEN 2 THEN '{"type":"debug","all":"' || event_id || '"}' ELSE '{broken' END"""


def _frames(spark, d):
    user, event = F.col("user_id").cast("string"), F.col("event_id")
    decision = F.concat(F.lit('{"type":"decision","sessionId":"'), user, F.lit('","toolName":"'), F.col("event_type"), F.lit('","secret":"x","explanation":{"summary":"s","node":"tn_1","actions":[{"kind":"k","raw":"r"}]}}'))
    lineage = F.concat(F.lit('{"type":"lineage","nodes":[{"id":"n","toolName":"t","payload":"p","parents":[{"nodeId":"m","token":"q"}]}],"sessionId":"'), user, F.lit('"}'))
    text = F.when(event % 4 == 0, decision).when(event % 4 == 1, lineage).when(event % 4 == 2, F.concat(F.lit('{"type":"debug","all":"'), event.cast("string"), F.lit('"}'))).otherwise("{broken")
    return table(spark, d, "events").select("event_id", text.alias("text"))


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, {FRAME_SQL} AS text FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'lineage' WHEN 2 THEN 'debug' END AS type,
CASE event_id % 4 WHEN 0 THEN '{{"type":"decision","sessionId":"' || user_id || '","toolName":"' || event_type || '","explanation":{{"summary":"s","actions":[{{"kind":"k"}}]}}}}'
 WHEN 1 THEN '{{"type":"lineage","nodes":[{{"id":"n","toolName":"t","parents":[{{"nodeId":"m"}}]}}],"sessionId":"' || user_id || '"}}' END AS frame,
CASE event_id % 4 WHEN 0 THEN 'actions.raw,explanation.node,secret' WHEN 1 THEN 'nodes.payload,parents.token' ELSE '' END AS dropped FROM e""")
def nested_projection(spark, d):
    """What may leave of an event, with its nested fields, and the paths of what is dropped."""
    return projection.frames(_frames(spark, d), "event_id", "text")


@query(f"WITH e AS (SELECT event_id, user_id, event_type FROM events) SELECT event_id, event_id % 4 = 3 AS error, CASE event_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'lineage' WHEN 2 THEN 'debug' END AS type, CASE WHEN event_id % 4 < 2 THEN user_id::VARCHAR END AS session, CASE WHEN event_id % 4 = 0 THEN event_type END AS tool, CASE WHEN event_id % 4 = 0 THEN 'BLOCKED' END AS decision FROM e")
def dashboard_events(spark, d):
    """Frames as a view's source reads them: by type, broken ones counted."""
    return projection.received(_frames(spark, d), "text", "event_id").drop("timestamp")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE text || chr(10) || 'turn ' || turn END AS text FROM conversations""")
def content_text(spark, d):
    """The text parts of results: other parts, parts without a text and results without a list of parts give nothing."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.col("text")), part("image", F.lit("data")), part("text", F.lit(None).cast("string")), part("text", F.concat(F.lit("turn "), F.col("turn").cast("string"))))
    result = F.when(F.col("turn") % 3 == 0, F.lit('{"content":"none"}')).otherwise(F.to_json(F.struct(parts.alias("content"))))
    c = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), result.alias("result"))
    return projection.text_parts(c, "key", "result").select("key.*", "text")


@query(rf"WITH d AS (SELECT doc_id, t, sha256(t) AS h FROM ({TOKENED_SQL})), v AS (SELECT DISTINCT '[PII_EMAIL_' || substr(sha256(text), 1, 12) || ']' AS token, doc_id AS original FROM documents WHERE doc_id % 2 = 0), f AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '{T.VAULT_TOKEN}'))) AS token FROM d) SELECT f.doc_id, f.token, v.original::VARCHAR AS original FROM f LEFT JOIN v USING (token)")
def token_lookup(spark, d):
    """Originals of the tokens in a text, by a join with the vault; unknown tokens have none."""
    from sluiceway.operators import fold

    vault = _docs(spark, d).where(F.col("doc_id") % 2 == 0).select(F.concat(F.lit("[PII_EMAIL_"), T.short_hash(F.col("text"), 12), F.lit("]")).alias("token"), F.col("doc_id").cast("string").alias("original"))
    return fold.resolved(_tokened(spark, d), vault, "t").select("doc_id", "token", "original")


from sluiceway import stateful  # noqa: E402

QUERIES |= stateful.QUERIES | replays.QUERIES
ORACLES |= stateful.ORACLES | replays.ORACLES
