"""The audit log as JSON lines: a sink that keeps key order, and a source that keeps broken lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "session_id long, seq long, tool string, decision string, prev_hash string, signature string"
FIELDS = [c.split()[0] for c in ROW.split(", ")]


def write(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*FIELDS)).alias("value")).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are dropped; a line that can't be parsed is kept with bad = true."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select("value", F.from_json("value", f"{ROW}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | F.col("r.seq").isNull()
    return parsed.select(*(F.col(f"r.{f}").alias(f) for f in FIELDS), bad.alias("bad"), "value")
