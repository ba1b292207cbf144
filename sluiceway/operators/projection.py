"""What leaves for views: a white list of fields per type of event, nested ones too; and events read back from such frames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway import at_hand

# Fields that may leave, by type of event and by name of a nested field.
FIELDS = {
    "decision": ("type", "sessionId", "toolName", "allowed", "decision", "reason", "matchedTags", "explanation", "canOverride", "approvalId", "outputScan", "blockedArgs", "timestamp"),
    "lineage": ("type", "sessionId", "nodes", "timestamp"),
    "hitl_audit": ("type", "sessionId", "entries", "timestamp"),
    "audit_integrity": ("type", "ok", "total", "problems", "timestamp"),
    "approval_resolved": ("type", "sessionId", "approvalId", "approved", "resolvedBy", "timestamp"),
    "sanitized": ("type", "sessionId", "method", "originalTags", "resultTags", "ok", "maskedCount", "residualSensitiveData", "timestamp"),
    "injection_check": ("type", "sessionId", "toolName", "isInjection", "score", "evaluated", "timestamp"),
}
NESTED = {
    "explanation": ("summary", "reason", "risks", "actions"),
    "actions": ("kind", "label", "description", "available", "detail"),
    "outputScan": ("id", "sessionId", "toolName", "sinkClass", "timestamp", "kind", "sourceTool", "matchLen", "valueHash"),
    "nodes": ("id", "toolName", "tags", "parents"),
    "parents": ("nodeId", "method", "weak"),
    "entries": ("approvalId", "sessionId", "toolName", "action", "actor", "timestamp"),
    "problems": ("line", "kind", "detail"),
}
FRAME = "type string, frame string, dropped string"


def project(event: object) -> tuple[str | None, dict | None, list[str]]:
    """(type, what may leave, paths of what is dropped); an event of no known type doesn't leave at all."""
    kind = event.get("type") if isinstance(event, dict) else None
    if not isinstance(kind, str) or kind not in FIELDS:
        return kind if isinstance(kind, str) else None, None, []
    dropped: list[str] = []
    out: dict = {}
    todo: list[tuple[dict, dict, tuple[str, ...], str]] = [(event, out, FIELDS[kind], "")]
    while todo:
        source, into, allowed, prefix = todo.pop()
        for k, v in source.items():
            if k not in allowed:
                dropped.append(prefix + k)
                continue
            into[k] = v
            if k not in NESTED:
                continue
            if isinstance(v, dict):
                into[k] = {}
                todo.append((v, into[k], NESTED[k], f"{k}."))
            elif isinstance(v, list):
                into[k] = [{} if isinstance(x, dict) else x for x in v]
                todo += [(x, into[k][i], NESTED[k], f"{k}.") for i, x in enumerate(v) if isinstance(x, dict)]
    return kind, out, sorted(set(dropped))


def frames(events: DataFrame, key: str, text: str) -> DataFrame:
    """key, type, frame (JSON of what may leave; null if nothing) and dropped (paths) of events as JSON texts."""
    at_hand(events.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, t in zip(rows[key], rows[text], strict=True):
                try:
                    kind, kept, dropped = project(json.loads(t))
                except (TypeError, ValueError, RecursionError):
                    kind, kept, dropped = None, None, []
                out.append((k, kind, None if kept is None else json.dumps(kept, ensure_ascii=False, separators=(",", ":")), ",".join(dropped)))
            yield pd.DataFrame(out, columns=[key, "type", "frame", "dropped"])

    return events.select(key, text).mapInPandas(run, f"{key} {dict(events.dtypes)[key]}, {FRAME}")


def write(rows: DataFrame, path: str) -> None:
    """Frames as lines, for whoever tails them; what may not leave isn't among them."""
    rows.where("frame IS NOT NULL").select(F.col("frame").alias("value")).write.mode("append").text(path)


def of_lineage(emitted: DataFrame) -> DataFrame:
    """Events of type lineage from the replay's snapshots: session_id, seq, text."""
    text = F.concat(F.lit('{"type":"lineage","sessionId":'), F.concat(F.lit('"'), "session_id", F.lit('"')), F.lit(',"nodes":'), F.get_json_object("detail", "$.nodes"), F.lit("}"))
    return emitted.where("kind = 'lineage'").select("session_id", "seq", text.alias("text"))


def received(lines: DataFrame, text: str, *keys: str) -> DataFrame:
    """Frames as a view's source reads them, from a table or a stream: dispatched by type, broken lines counted by ``error``.

    A decision frame gives a decision (its own word, or that of ``allowed``); other types keep their frame.
    """
    r = lines.select(*keys, text, F.from_json(text, "type string, sessionId string, toolName string, allowed boolean, decision string, timestamp string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    word = F.coalesce(F.col("r.decision"), F.when(F.col("r.allowed"), "ALLOWED").otherwise("BLOCKED"))
    return r.select(
        *keys, bad.alias("error"), F.when(~bad, F.col("r.type")).alias("type"), F.col("r.sessionId").alias("session"), F.col("r.toolName").alias("tool"),
        F.when(~bad & (F.col("r.type") == "decision"), word).alias("decision"), F.col("r.timestamp").alias("timestamp"),
    )


def text_parts(rows: DataFrame, key: str, result: str) -> DataFrame:
    """key and text: the text parts of a result's content, joined by newlines; other parts, and results of another form, give none."""
    parts = F.from_json(F.get_json_object(result, "$.content"), "array<struct<type:string,text:string>>")
    said = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    return rows.select(key, F.coalesce(F.array_join(said, "\n"), F.lit("")).alias("text"))
