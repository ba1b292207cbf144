"""Classification of calls and session-mode verdicts: joins to a small policy table and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.plans.policy import DEFAULT, MAX_TOOLS, Policy
from sluiceway.sources.calls import in_session

OUTBOUND = "OUTBOUND_SINK"


def flagged(calls: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """calls with classified, sink, s, u, destructive; the tools of a policy are few by construction."""
    tools = policy.tools(calls.sparkSession).drop("label")
    names = len(policy.sensitive) + len(policy.untrusted) + len(policy.sinks) + len(policy.destructive)
    tools = F.broadcast(tools) if names <= MAX_TOOLS else tools
    by_source = policy.secrets is None or policy.secrets.by_source
    default = "READ" if policy.unknown_tools == "warn" else OUTBOUND
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    joined = calls.join(tools.withColumn("classified", F.lit(True)), "tool", "left")
    return joined.select(
        *(c for c in calls.columns),
        no("classified").alias("classified"), F.coalesce("sink", F.lit(default)).alias("sink"),
        (no("sensitive") & F.lit(by_source)).alias("s"), (no("untrusted") | ~no("classified")).alias("u"), no("destructive").alias("destructive"),
    )


def tag_list(s: Column, u: Column) -> Column:
    both = F.array(F.when(s, "SENSITIVE"), F.when(u, "UNTRUSTED_ORIGIN"))
    return F.array_join(both, ",")


def verdicts(flags: DataFrame) -> DataFrame:
    """Session-mode verdicts: a call sees the tags of the calls before it; exposure only grows.

    One window per session over the partitioning that the log already has.
    """
    before = in_session().rowsBetween(Window.unboundedPreceding, -1)
    had = lambda c: F.coalesce(F.max(c).over(before), F.lit(False))
    out = flags.withColumn("s_before", had("s")).withColumn("exposed", had("u"))
    blocked = (F.col("sink") == OUTBOUND) & F.col("s_before") & F.col("exposed")
    return out.withColumn("allowed", ~blocked)


def destructive_gate(verdict: DataFrame, policy: str = "block") -> DataFrame:
    """Adds gated: a destructive tool in a session exposed to untrusted input."""
    on = F.lit(policy != "off")
    return verdict.withColumn("gated", on & F.col("destructive") & F.col("exposed")).withColumn("passes", F.col("allowed") & ~F.col("gated"))


def trusted_uri(uri: Column, policy: Policy = DEFAULT) -> Column:
    """Case-sensitive prefix match; nothing is parsed."""
    return F.coalesce(F.exists(F.array(*map(F.lit, policy.trusted_uris)), lambda p: F.startswith(uri, p)), F.lit(False)) if policy.trusted_uris else F.lit(False)


def session_state(flags: DataFrame, clears: Column | None = None) -> DataFrame:
    """Session tags after each call: s since the last call where ``clears`` holds; exposure is never cleared."""
    upto = in_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reset = F.coalesce(clears, F.lit(False)).cast("int") if clears is not None else F.lit(0)
    out = flags.withColumn("era", F.sum(reset).over(upto))
    era = Window.partitionBy("user_id", "session_id", "era").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("s_now", F.max("s").over(era)).withColumn("u_ever", F.max("u").over(upto))
