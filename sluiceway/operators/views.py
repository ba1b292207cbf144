"""Operational views over verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.operators.classify import OUTBOUND


def metric_cards(verdict: DataFrame, forwarded: DataFrame | None = None, approvals: DataFrame | None = None) -> DataFrame:
    """Counts per session: decisions, and what was forwarded (rows with session_id) or waits (approvals with session_id and status)."""
    out = verdict.groupBy("session_id").agg(
        F.count("*").alias("total"), F.count_if(~F.col("allowed")).alias("blocked"), F.count_if("allowed").alias("passed"),
        F.count_if(F.col("sink") == OUTBOUND).alias("outbound"),
    )
    for rows, name in ((forwarded, "forwarded"), (approvals and approvals.where(F.col("status") == "PENDING"), "pending")):
        if rows is not None:
            out = out.join(rows.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "left").fillna(0, [name])
    return out


def threat_fusion(verdict: DataFrame, scores: DataFrame) -> DataFrame:
    """Per session: signals of the last blocked row and of the last injection check, and a level."""
    blocked = verdict.where(~F.col("allowed")).groupBy("session_id").agg(
        F.max_by("tool", "seq").alias("last_tool"), F.max_by("classified", "seq").alias("known")
    )
    checks = scores.groupBy("session_id").agg(F.max_by("is_injection", "seq").alias("injection"))
    out = blocked.join(checks, "session_id", "left")
    n = F.lit(1) + F.when(F.coalesce("injection", F.lit(False)), 1).otherwise(0) + F.when(~F.col("known"), 1).otherwise(0)
    return out.select("session_id", "last_tool", n.alias("signals"), F.when(n >= 3, "high").when(n >= 1, "caution").otherwise("low").alias("level"))


def flow_sources(flags: DataFrame) -> DataFrame:
    """Tainted tools of a session with the union of their tags; pure sinks bring no tag and are left out."""
    return (
        flags.where(F.col("s") | F.col("u"))
        .groupBy("session_id", "tool").agg(F.max("s").alias("s"), F.max("u").alias("u"), F.count("*").alias("n"))
    )


def block_reason(verdict: DataFrame, flags: DataFrame) -> DataFrame:
    """For each blocked tool of a session: the other tools that brought either tag."""
    axis = flags.groupBy("session_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("s"), F.col("tool")))).alias("s_tools"),
        F.array_sort(F.collect_set(F.when(F.col("u"), F.col("tool")))).alias("u_tools"),
    )
    cut = lambda c: F.array_join(F.filter(c, lambda t: t != F.col("tool")), ",")
    hit = verdict.where(~F.col("allowed")).select("session_id", "tool").distinct()
    return hit.join(axis, "session_id").select("session_id", "tool", cut("s_tools").alias("sensitive_from"), cut("u_tools").alias("untrusted_from"))


def ring(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def last_blocks(verdict: DataFrame) -> DataFrame:
    """(session_id, blocked_seq, blocked_tool): the last blocked call of each session that has one."""
    hit = verdict.where(~F.col("allowed")).groupBy("session_id").agg(F.max_by(F.struct("seq", "tool"), "seq").alias("b"))
    return hit.select("session_id", F.col("b.seq").alias("blocked_seq"), F.col("b.tool").alias("blocked_tool"))


def deepest(depth: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """The deepest node of each tool in a session; the first wins a tie. The tool that ``blocks`` shows as the sink is left out."""
    if blocks is not None:
        depth = depth.join(blocks.select("session_id", F.col("blocked_tool").alias("tool")), ["session_id", "tool"], "left_anti")
    best = F.max_by(F.struct("seq", "depth"), F.struct(F.col("depth"), -F.col("seq")))
    return depth.groupBy("session_id", "tool").agg(best.alias("b")).select("session_id", "tool", F.col("b.seq").alias("seq"), F.col("b.depth").alias("depth"))


def slots(depth: DataFrame) -> DataFrame:
    """Place of a node among those of its depth."""
    w = Window.partitionBy("session_id", "depth").orderBy("seq")
    return depth.withColumn("slot", F.row_number().over(w) - 1)
