"""The call log: one row per tool call, in order within its session.

The driver's ``events`` are read as calls by a fixed mapping (users' events are
cut into sessions of eight); any table with the columns of ``CALLS`` works too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION_LENGTH = 8
#: Sessions that a user may have; ids of two users never meet.
SESSIONS = 1_000_000_000
#: Columns that the operators expect of a call log.
CALLS = ("user_id", "session_id", "seq", "event_id", "ts", "value", "tool")


#: Factor by which the fullest partition of a scan may exceed an even share of the cores.
UNEVEN = 4
#: Tables of texts, with the column that deals their rows.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a scan that gives most of them to few tasks (a file of one row group), dealt to all cores by a key.

    Only small scans are looked at, by their row counts; one with many partitions stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() > UNEVEN * cores:
        return rows
    most, every = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return rows.repartition(cores, key) if every and most * cores > UNEVEN * every else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, TEXTS[name]) if name in TEXTS else rows


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = (
        F.when(F.col("event_type") == "signup", "query_customer_db")
        .when(F.col("event_type") == "view", "fetch_web_page")
        .when(F.col("event_type") == "click", "read_email")
        .when(F.col("event_type") == "purchase", "send_email")
        .when(F.col("event_id") % 2 == 0, "mystery_tool")
        .otherwise("delete_customer_record")
    )
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(order) - 1
    return (
        table(spark, sf_dir, "events")
        .select("user_id", "event_id", "ts", "value", tool.alias("tool"), n.alias("n"))
        .select(
            "user_id", (F.col("user_id") * SESSIONS + F.floor(F.col("n") / SESSION_LENGTH)).cast("long").alias("session_id"),
            (F.col("n") % SESSION_LENGTH + 1).cast("long").alias("seq"), "event_id", "ts", "value", "tool",
        )
    )


def in_session(*order: str) -> Window:
    """Per session; user_id comes first so that the log's own partitioning is kept."""
    return Window.partitionBy("user_id", "session_id").orderBy(*(order or ("seq",)))


CALLS_SQL = """calls AS (
  SELECT user_id, (user_id * 1000000000 + n // 8)::BIGINT AS session_id, (n % 8 + 1)::BIGINT AS seq, event_id, ts, value,
    CASE event_type WHEN 'signup' THEN 'query_customer_db' WHEN 'view' THEN 'fetch_web_page' WHEN 'click' THEN 'read_email'
      WHEN 'purchase' THEN 'send_email' ELSE CASE WHEN event_id % 2 = 0 THEN 'mystery_tool' ELSE 'delete_customer_record' END END AS tool
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
)"""
