"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluiceway import at_hand

#: White space of the contracts: space and \t \n \v \f \r. Words are the rest.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows an Arrow batch holds at most; texts can be long, so batches are short.
ARROW_ROWS = 512

#: Rows (of a key and a number) up to which a counted side is broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's in the one that driver and executors share: spark.checkpoint.dir.

    Only in local mode, as in tests, a temporary folder serves where that is unset. What is
    written there is removed when the driver's Python ends.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="sluiceway-")
        sc.setCheckpointDir(top)
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        top = sc.getCheckpointDir()
    path = f"{top.rstrip('/')}/sluiceway-{sc.applicationId}"
    if path not in _known:
        _known.add(path)
        atexit.register(_remove, spark, path)
    return path


_known: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file system; a session that has ended leaves it."""
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  removal is a courtesy
        pass


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(df: DataFrame) -> None:
    """Remove a table of ``written`` that nothing will read any more."""
    if path := getattr(df, "_written", None):
        _remove(df.sparkSession, path)


def counted_side(df: DataFrame) -> DataFrame:
    """A side of a join, written and counted: broadcast up to BROADCAST_ROWS, left to Spark beyond."""
    side = written(df)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, whatever the session's default."""
    at_hand(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """mapInArrow in short batches; a worker that has ended its task gives free memory back, as it stays for the next one."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return to the system what this process has freed; Arrow and glibc keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def beside(docs: DataFrame, *names: str) -> list[str]:
    """Columns of docs but for those named so in whatever case, as quoted names."""
    out = {n.lower() for n in names}
    return [f"`{c.replace('`', '``')}`" for c in docs.columns if c.lower() not in out]


def uniform(*cols: Column | str) -> Column:
    """A number in (0, 1) from a hash of the columns; reruns agree."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a column expression once inside another expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_bucket(column: Column | str, n: int) -> Column:
    """crc32 of a value's text, modulo n; null counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def text_tag() -> Column:
    """Tells the texts of one doc_id apart, in Spark and without Python."""
    return F.xxhash64("text")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` but for those that ``found`` (doc_id, tag, component_id; tag is ``text_tag``) puts under a smaller doc_id.

    Of rows that repeat a doc_id and a text, one stays: the least by a hash of all its columns. Rows without a doc_id stay.
    """
    gone = counted_side(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).distinct())
    same = (F.col("doc_id") == F.col("_d")) & (text_tag() == F.col("_t"))
    kept = docs.join(gone, same, "left_anti").select(*docs.columns)
    again = found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).count().where("count > 1").drop("count")
    again = counted_side(again)
    if again.isEmpty():
        return kept
    row = F.struct(*(F.col(c) for c in beside(docs)))
    met = kept.join(again, same).groupBy("_d", "_t").agg(F.min_by(row, F.xxhash64(*(F.col(c) for c in beside(docs)))).alias("row"))
    return kept.join(again, same, "left_anti").select(*docs.columns).union(met.select("row.*"))
