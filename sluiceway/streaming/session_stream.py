"""Sessions as keyed state in Structured Streaming, by the same state machine as in batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluiceway.operators.fold import DECISIONS, EMITTED, EVENTS, step, taken
from sluiceway.operators.session import Session
from sluiceway.plans.policy import Policy


def _keyed(events: DataFrame, policy: Policy, idle: str | None, row: Callable, schema: str) -> DataFrame:
    """Rows of ``row(session, event)``; arrival order between batches is the truth, within one seq is.

    State per session is its serialised state machine, with the policy that came last with its events
    (op ``policy``), so that a change holds without a restart. With ``idle`` (milliseconds) a session that has
    been quiet for so long is forgotten; by default state is kept.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        s = Session.from_state(key[0], policy, state.get[0]) if state.exists else Session(key[0], policy)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        rows = rows.astype(object).where(rows.notna(), None)
        out = []
        for r in rows.itertuples(index=False):
            out += row(s, r)
            s.emitted.clear()
        state.update((s.state(),))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    picked = events.select(*(c.split()[0] for c in EVENTS.split(", ")))
    return picked.groupBy("session_id").applyInPandasWithState(fold, schema, "state string", "append", timeout)


def decisions(events: DataFrame, policy: Policy, idle: str | None = None) -> DataFrame:
    """A streaming row of DECISIONS per event."""
    return _keyed(events, policy, idle, lambda s, r: [(s.name, r.seq, *step(s, r.op, r.tool, r.args, r.result, r.arg_tags, r.ref))], DECISIONS)


def emitted(events: DataFrame, policy: Policy, idle: str | None = None) -> DataFrame:
    """Streaming rows of EMITTED: nodes, edges, approvals, shadow verdicts, explanations, and a session's lineage after each event."""

    def row(s: Session, r) -> list[tuple]:
        step(s, r.op, r.tool, r.args, r.result, r.arg_tags, r.ref)
        s.emit("lineage", None, r.tool or "", nodes=s.snapshot())
        return taken(s, r.seq)

    return _keyed(events, policy, idle, row, EMITTED)


def exposure_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Blocked and passed decisions per time window; late rows up to the watermark still count."""
    w = events.withWatermark("ts", watermark)
    return w.groupBy(F.window("ts", window), "tool").agg(F.count("*").alias("n"), F.count_if(~F.col("allowed")).alias("blocked"))


# Commands that a view may send, and the events they become.
COMMANDS = {"approve": "approve", "reject": "reject", "sanitize": "sanitize"}


def commands(messages: DataFrame, text: str, token: str) -> DataFrame:
    """Events from control messages (session_id, seq and a JSON text), to be unioned with a session's other events, in batch or as a second stream.

    A message that doesn't carry the token, can't be read or has no known type becomes no event.
    """
    m = messages.select("session_id", "seq", F.from_json(text, "type string, token string, approvalId string, method string").alias("m"))
    same = F.sha2(F.col("m.token"), 256) == F.lit(hashlib.sha256(token.encode()).hexdigest())
    op = F.element_at(F.create_map(*(F.lit(x) for kv in COMMANDS.items() for x in kv)), F.col("m.type"))
    none = F.lit(None).cast("string")
    out = m.where(same).select("session_id", F.col("seq").cast("long").alias("seq"), op.alias("op"), F.col("m.method").alias("tool"), none.alias("args"), none.alias("result"), none.alias("arg_tags"), F.col("m.approvalId").alias("ref"))
    return out.where("op IS NOT NULL")
