"""Replay of sessions over a call log, distributed by session.

Events have session_id, seq, op, tool, args, result (JSON texts), arg_tags and
ref (an approval id, a uri or a node). Each session is read in order
of seq and folded by ``Session``; sessions are independent but for the vault, for
which ``resent_elsewhere`` marks the events whose arguments hold an original that was tokenized before, in whatever session.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sluiceway import at_hand
from sluiceway.functions import leaves as L
from sluiceway.functions import text as T
from sluiceway.operators import links
from sluiceway.operators.session import Decision, Session, tag_names
from sluiceway.plans.policy import Policy

EVENTS = "session_id string, seq long, op string, tool string, args string, result string, arg_tags string, ref string"
#: What a session makes besides verdicts, in the order in which it comes about.
EMITTED = "session_id string, seq long, nth int, kind string, name string, tool string, tags string, detail string"
DECISIONS = (
    "session_id string, seq long, op string, tool string, allowed boolean, reason string, matched_tags string, link_method string, "
    "evidence int, weak_only boolean, can_override boolean, approval_id string, scan_kind string, scan_transform string, tags string, exposed boolean, ref string, shadow_allowed boolean"
)


#: Arguments come twice, with the verdict and with the record: the same text is the same value, which nothing changes.
parsed = lru_cache(4)(L.parse)


def step(s: Session, op: str, tool: str | None, args: str | None, result: str | None, arg_tags: str | None, ref: str | None) -> tuple:
    """Apply one event; a row of DECISIONS without session_id and seq. Whatever fails is a row that isn't allowed."""
    s.shadowed = None
    try:
        d, node = _apply(s, op, tool, args, result, arg_tags, ref)
    except Exception as e:  # noqa: BLE001  one broken event doesn't end the job, and passes nothing
        d, node = Decision(False, f"{op} failed: {type(e).__name__}"), None
    e = d.evidence
    return (
        op, tool, d.allowed, d.reason, ",".join(d.tags), e.method, len(e.nodes), e.weak_or_clean, d.can_override, d.approval,
        d.scan.kind if d.scan else None, d.scan.transform if d.scan else None, ",".join(tag_names(s.tags)), s.exposed, node, s.shadowed,
    )


def _apply(s: Session, op: str, tool: str | None, args: str | None, result: str | None, arg_tags: str | None, ref: str | None) -> tuple[Decision, str | None]:
    d, node = Decision(True), None
    if op == "record":
        node, d.evidence.method, _ = s.record(tool or "", parsed(args), L.parse(result))
    elif op == "content":
        node, d.evidence.method, _ = s.record_content(tool or "resources/read", ref or "", L.parse(result))
    elif op == "evaluate":
        d = s.evaluate(tool or "", parsed(args), args or "", {t[0] for t in (arg_tags or "").split(",") if t})
    elif op == "outbound":
        d = s.outbound(tool or "sampling/createMessage", parsed(args))
    elif op == "resource":
        d = s.resource(tool or "resources/read", ref or "", parsed(args))
    elif op == "sanitize":
        out = s.sanitize(tool or "")
        s.emit("sanitized", None, tool or "", **out)
        d = Decision(out["done"], json.dumps({k: out[k] for k in ("masked", "residual")}))
    elif op in ("approve", "reject"):
        try:
            wanted = ref or next((o.id for o in reversed(s.offers.values()) if o.status in ("OFFERED", "PENDING")), "")
            s.request(wanted)
            s.resolve(wanted, op == "approve", "dashboard")
            d = Decision(True, approval=wanted)
        except (KeyError, ValueError) as e:
            d = Decision(False, str(e))
    elif op == "taint":
        try:
            s.add_tags(ref or "", {t[0] for t in (arg_tags or "").split(",") if t})
        except KeyError as e:
            d = Decision(False, f"no node {e}")
    elif op == "prune":
        d = Decision(True, str(s.prune()))
    elif op == "policy":
        s.change_policy(args or "")
    elif op == "snapshot":
        s.emit("lineage", None, "", nodes=s.snapshot())
    else:
        d = Decision(False, f"unknown event {op}")
    return d, node


def taken(s: Session, seq: int) -> list[tuple]:
    """Rows of EMITTED for what the session has made since it was asked last."""
    out = [(s.name, seq, i, kind, name, tool, ",".join(tags), json.dumps(detail, ensure_ascii=False)) for i, (kind, name, tool, tags, detail) in enumerate(s.emitted)]
    s.emitted.clear()
    return out


def _folded(events: DataFrame, policies: dict[str, Policy], row, schema: str, telling: bool) -> DataFrame:
    """One pass over all sessions; ``row(session, event)`` gives the rows of each event, for each policy.

    One shuffle and one sort bring sessions together in order; a task then streams through its sessions, one state
    machine at a time, so there is no cost per group and memory is bounded by the largest session's state.
    """
    at_hand(events.sparkSession)
    known = [c.split()[0] for c in EVENTS.split(", ")] + [c for c in ("resent",) if c in events.columns]
    out_schema = StructType.fromDDL(f"label string, {schema}")
    names, kinds = out_schema.names, [to_arrow_type(f.dataType) for f in out_schema]
    event = namedtuple("event", known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: str | None = None
        sessions: dict[str, Session] = {}
        for b in batches:
            out: list[tuple] = []
            for r in map(event._make, zip(*(b.column(c).to_pylist() for c in known), strict=True)):
                if not sessions or now != r.session_id:
                    now = r.session_id
                    sessions = {label: Session(now, p) for label, p in policies.items()}
                    for s in sessions.values():
                        s.telling = telling
                for label, s in sessions.items():
                    s.resent_elsewhere = bool(getattr(r, "resent", False))
                    out += [(label, *x) for x in row(s, r)]
                    s.emitted.clear()
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return events.select(*known).repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(run, out_schema)


def replays(events: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """A row of DECISIONS per event and policy, with the policy's label: the log is read once for all of them."""
    return _folded(events, policies, lambda s, r: [(r.session_id, r.seq, *step(s, r.op, r.tool, r.args, r.result, r.arg_tags, r.ref))], DECISIONS, False)


def replay(events: DataFrame, policy: Policy) -> DataFrame:
    """A row of DECISIONS per event."""
    return replays(events, {"": policy}).drop("label")


def emitted(events: DataFrame, policy: Policy) -> DataFrame:
    """Rows of EMITTED: nodes, edges, payloads, steps of approvals, shadow verdicts, explanations and events."""

    def row(s: Session, r) -> list[tuple]:
        step(s, r.op, r.tool, r.args, r.result, r.arg_tags, r.ref)
        return taken(s, r.seq)

    return _folded(events, {"": policy}, row, EMITTED, True).drop("label")


def of_session(rows: DataFrame, session: str | None = None) -> DataFrame:
    """Rows of one session, or of all."""
    return rows if session is None else rows.where(F.col("session_id") == session)


def resolved(rows: DataFrame, vault: DataFrame, text: str) -> DataFrame:
    """Adds originals: the vault's (token, original) of the tokens in a text, one row per token; tokens that it doesn't know have null."""
    found = rows.withColumn("token", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(T.VAULT_TOKEN), F.lit(0)))))
    return found.join(vault.select("token", "original"), "token", "left")


def resent_elsewhere(events: DataFrame, vault: DataFrame) -> DataFrame:
    """Events with resent: the arguments hold an original of the vault (token, original, at) that was tokenized before ``at`` (a column of both)."""
    known = vault.where(F.length("original") >= L.VAULT_MIN).select(F.monotonically_increasing_id().alias("v"), F.col("original").alias("text"), F.col("at").alias("since"))
    hits = links.containment(events.select(F.struct("session_id", "seq").alias("e"), F.col("args").alias("text")).where("text IS NOT NULL"), known, "e", "v", "plain")
    late = hits.join(known.select("v", "since"), "v").groupBy("e").agg(F.min("since").alias("since"))
    met = events.join(late.select("e.*", "since"), ["session_id", "seq"], "left")
    return met.withColumn("resent", F.coalesce(F.col("since") < F.col("at"), F.lit(False))).drop("since")


def vault_entries(events: DataFrame, policy: Policy) -> DataFrame:
    """Pass 1 of a shared vault: (token, original, at) of every tokenization, with its order in the whole log."""

    def run(batches):
        for rows in batches:
            out = [(t, o, int(at)) for v, at in zip(rows["result"], rows["at"], strict=True) for t, o in L.tokenize(L.parse(v), policy)[2].items()]
            yield pd.DataFrame(out, columns=["token", "original", "at"]).astype({"at": "int64"})

    found = events.mapInPandas(run, "token string, original string, at long")
    return found.groupBy("token").agg(F.min("original").alias("original"), F.min("at").alias("at"))


def scan_calls(pairs: DataFrame, policy: Policy) -> DataFrame:
    """Output scan of (args, payload, tool, origin) rows in Arrow batches: adds kind, normalized, transform, length, value_hash."""

    def run(batches):
        for rows in batches:
            found = [L.scan([(t, L.parse(p), o)], L.parse(a), policy.secrets) for a, p, t, o in zip(rows["args"], rows["payload"], rows["tool"], rows["origin"], strict=True)]
            yield rows.drop(columns=["args", "payload"]).assign(
                kind=[f and f.kind for f in found], normalized=[f.normalized if f else None for f in found], transform=[f and f.transform for f in found],
                length=pd.array([f.length if f else None for f in found], dtype="Int64"), value_hash=[f and f.value_hash for f in found],
            )

    keys = [f"{n} {t}" for n, t in pairs.dtypes if n not in ("args", "payload")]
    return pairs.mapInPandas(run, ", ".join([*keys, "kind string, normalized boolean, transform string, length long, value_hash string"]))
