"""Mix sources to target weights by Pareto order sampling (DataFrame functions only).

Each source gets a target number of words. A document's expected number of
copies is its source's target over its source's size (times an optional weight
of its own). The whole part of that number is allocated for certain. What is
left of the target is filled by an order sample: documents are ranked by
``odds(u) / odds(inclusion)`` with ``u`` a uniform number hashed from the
document's id, and the lowest ranks are taken until the words that are left are
reached; the document on the boundary is taken if that comes nearer.

No source is ever ranked in one task. Ranks are first counted in cells of the
rank's own scale (a small table per source), the cell in which the words run
out is found from these sums, and only that cell's rows are ranked exactly.
The outcome is one cut per source, so the last pass is map-only.

Edge cases: null text has size 0 and is never repeated beyond its copies of 0
words; a null source is a source of its own (last in order); repeated rows with
one id share one rank and are taken together; an empty table gives an empty
result; other columns are kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import WORD, written

#: Sources up to this many rows are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 50_000
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in (0, 1) from 52 bits of md5; the same arithmetic runs in any SQL engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, pull) to targets: weights by order, capped, the excess reshared.

    The water level after capping the first sources in order of cap / weight is
    a closed form over running sums, so nothing iterates.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sizes.select(
        "*", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1)).alias("w")
    ).withColumn("limit", F.col("source_size") * cap)
    level = Window.orderBy((F.col("limit") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranked = ranked.select(
        "*",
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(level), F.lit(0))).cast("double")
            / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(level), F.lit(0))).cast("double")
        ).alias("lam"),
    ).withColumn("full", F.col("lam") > F.col("limit") / F.col("w"))
    # the first source that isn't full has the final level; levels rise while sources are capped
    final = F.max(F.when(~F.col("full"), F.col("lam"))).over(everything)
    return ranked.select(
        "source", "source_size", "pull",
        F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("w") * final).alias("target"),
    )


def _with_sources(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Join per-source facts; broadcast only below a checked count."""
    s = sources.withColumnRenamed("source", "_s")
    s = F.broadcast(s) if n_sources <= BROADCAST_SOURCES else s
    return rows.join(s, rows["source"].eqNullSafe(s["_s"]), "left").drop("_s")


def _ranked(rows: DataFrame, cap: int, seed: int) -> DataFrame:
    """Add whole copies and, for the rest of the expectation, the Pareto rank and its cell."""
    expected = F.least(
        F.lit(float(cap)),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        * F.when(F.col("pull") > 0, F.col("weight") * F.col("source_size") / F.col("pull")).otherwise(0.0),
    )
    u, part = F.col("u"), F.col("part")
    return (
        rows.withColumn("expected", expected)
        .withColumn("whole", F.floor("expected").cast("long"))
        .withColumn("part", F.col("expected") - F.floor("expected"))
        .withColumn("u", draw(F.col("doc_id"), seed))
        .withColumn("rank", F.when(part > 0, (u / (1 - u)) / (part / (1 - part))))
        .withColumn("cell", F.when(part > 0, F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS), F.lit(CELLS - 1))))
    )


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: int = 11,
    weight: Column | None = None,
) -> tuple[DataFrame, DataFrame, int]:
    """Plan a mix. Returns (slim rows, cuts per source, number of sources).

    ``weight`` is a document's relative pull on its source's target (default: all
    alike; null or negative counts as 0).
    """
    pull = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), pull.alias("weight")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("pull"))
    targets = written(source_targets(sizes, weights, cap))
    n = targets.count()
    ranked = _ranked(_with_sources(rows, targets, n), cap, seed)
    cells = written(
        ranked.groupBy("source", "cell").agg(
            F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain")
        )
    )
    per_source = Window.partitionBy("source")
    upto = per_source.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per source and cell, at most CELLS + 1 for a source whatever its size
    edges = (
        cells.withColumn("certain", F.sum("certain").over(per_source))
        .where(F.col("cell").isNotNull())
        .withColumn("upto", F.sum("words").over(upto))
        .join(targets.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("rest", F.col("target") - F.col("certain"))
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        .groupBy(F.col("source").alias("es"))
        .agg(
            F.min("cell").alias("cut_cell"), F.min_by("rest", "cell").alias("rest"),
            F.min_by(F.col("upto") - F.col("words"), "cell").alias("before"),
            F.min_by("target", "cell").alias("t"),
        )
    )
    edges = F.broadcast(edges) if n <= BROADCAST_SOURCES else edges
    inside = (
        ranked.join(edges, F.col("source").eqNullSafe(F.col("es")) & (F.col("cell") == F.col("cut_cell")))
        .groupBy("source", "rank")
        .agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("before").alias("before"), F.first("cut_cell").alias("cut_cell"))
    )
    by_rank = per_source.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        inside.withColumn("upto", F.col("before") + F.sum("size").over(by_rank))
        .withColumn("taken", F.col("upto") - F.col("size") / 2 <= F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.when(F.col("taken"), F.col("rank"))).alias("cut"), F.first("cut_cell").alias("cut_cell"))
    )
    cuts = targets.join(cuts.withColumnRenamed("source", "cs"), F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs")
    # a source whose target or rest is 0 has no boundary cell: nothing beyond whole copies
    return rows, written(cuts), n


def _copies(rows: DataFrame, cuts: DataFrame, n: int, cap: int, seed: int) -> DataFrame:
    r = _ranked(_with_sources(rows, cuts, n), cap, seed)
    sampled = (F.col("cell") < F.col("cut_cell")) | ((F.col("cell") == F.col("cut_cell")) & (F.col("rank") <= F.col("cut")))
    return r.withColumn("copies", F.col("whole") + F.when(F.coalesce(sampled, F.lit(False)), 1).otherwise(0))


def mix_table(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words)."""
    rows, cuts, n = mix(docs, weights=weights, cap=cap, seed=seed)
    out = _copies(rows, cuts, n, cap, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 11) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns unchanged."""
    _, cuts, n = mix(docs, weights=weights, cap=cap, seed=seed)
    packed = docs.select(
        F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(1.0).alias("weight")
    )
    out = _copies(packed, cuts, n, cap, seed).where(F.col("copies") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_n")).select("row.*")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (CAST('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM {docs}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, source_size * 3 AS lim,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER o, 0))::DOUBLE
      / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS lam
  FROM s
  WINDOW o AS (ORDER BY (source_size * 3)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
    CASE WHEN lam > lim::DOUBLE / w THEN lim::DOUBLE
         ELSE w * max(CASE WHEN lam <= lim::DOUBLE / w THEN lam END) OVER () END AS target
  FROM l
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, d.u,
    least(3.0::DOUBLE, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS expected
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS part,
    CASE WHEN expected > floor(expected)
      THEN (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS rank
  FROM r
), c AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS rest,
    sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY source, rank) AS tied
  FROM q
), m AS (
  SELECT *, whole + CASE WHEN part > 0 AND rest > 0 AND upto - tied / 2.0 <= rest AND upto - tied < rest THEN 1 ELSE 0 END AS copies FROM c
)
"""

ORACLE = (
    MIX_SQL.replace("{docs}", "documents")
    + "SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM m"
)
