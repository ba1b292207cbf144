"""Audit log: forwarding, hash chain, approvals, timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions import text as T


def forwarded(rows: DataFrame, method: Column) -> DataFrame:
    """Messages other than tool calls: classified and passed on with a FORWARDED row."""
    return rows.withColumn("risk", T.method_risk(method)).withColumn("decision", F.lit("FORWARDED"))


def signature(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256)


def verify_chain(log: DataFrame, key: list[str], order: str, recomputed: Column, broken: Column | None = None) -> DataFrame:
    """Adds problem: PARSE_ERROR, SIGNATURE_MISMATCH, CHAIN_BREAK or null.

    Each row's prev_hash must be the stored signature of the row before (null for
    the first row, and after a row that can't be parsed). One window per chain.
    """
    bad = F.coalesce(broken, F.lit(False)) if broken is not None else F.lit(False)
    w = Window.partitionBy(*key).orderBy(order)
    expected = F.lag(F.when(~bad, F.col("signature"))).over(w)
    problem = (
        F.when(bad, "PARSE_ERROR")
        .when(~F.col("signature").eqNullSafe(recomputed), "SIGNATURE_MISMATCH")
        .when(~F.col("prev_hash").eqNullSafe(expected), "CHAIN_BREAK")
    )
    return log.withColumn("problem", problem)


def latest_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: aggregated before the shuffle, not ranked after it."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def overridable(nodes: Column, arg_tags: Column) -> Column:
    """All evidence is weak or clean, and the arguments carry no tag."""
    return (F.size(arg_tags) == 0) & F.forall(nodes, lambda n: n["weak"] | (F.size(n["tags"]) == 0))


def timeline(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
