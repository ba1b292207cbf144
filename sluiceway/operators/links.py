"""Links between a call's arguments and earlier results, and containment of known texts."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from sluiceway import at_hand
from sluiceway.functions import text as T

STRONG = 16
#: Characters of known texts that one scan looks for at once; more are looked for in several scans.
BLOCK_CHARS = 8_000_000
MAX_BROADCAST_GRAMS = 1_000_000


def tokens(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per distinct evidence token of a text: keys, token_hash, token_length."""
    t = rows.select(*keys, F.explode(T.match_tokens(F.col(text))).alias("token"))
    return t.select(*keys, T.short_hash(F.col("token"), 32).alias("token_hash"), F.length("token").alias("token_length"))


def value_matches(args: DataFrame, results: DataFrame) -> DataFrame:
    """Links by shared tokens within a session: an inverted index on (session, token hash).

    ``args`` and ``results`` have session_id, seq, token_hash, token_length. A link
    is weak if it rests on one token shorter than ``STRONG``; of equally long tokens the
    least hash is the evidence.
    """
    a, r = args.alias("a"), results.alias("r")
    pairs = a.join(r, ["session_id", "token_hash"]).where(F.col("r.seq") < F.col("a.seq"))
    best = F.min_by("token_hash", F.struct(-F.col("a.token_length"), F.col("token_hash")))
    out = pairs.groupBy("session_id", F.col("a.seq").alias("child"), F.col("r.seq").alias("parent")).agg(
        F.count("*").alias("matches"), F.max("a.token_length").alias("best_length"), best.alias("best_hash")
    )
    return out.withColumn("weak", (F.col("matches") < 2) & (F.col("best_length") < STRONG))


def value_matches_of(calls: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """``value_matches`` of calls (session_id, seq, asks, key) whose arguments (asks) or results are texts of a table.

    Each text that is named is cut into tokens once; tokens travel as their hash and length.
    """
    named = texts.join(calls.select(key).distinct(), key, "left_semi")
    met = calls.join(tokens(named, text, [key]), key).drop(key)
    return value_matches(met.where("asks").drop("asks"), met.where("NOT asks").drop("asks"))


def explicit_links(args: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links by node id: a whole leaf that is the id of an earlier node of the session."""
    ids = args.where(F.col("leaf").rlike(r"^tn_[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))
    n = nodes.select("session_id", F.col("node_id").alias("leaf"), F.col("seq").alias("parent"))
    return ids.join(n, ["session_id", "leaf"]).where(F.col("parent") < F.col("seq")).select("session_id", F.col("seq").alias("child"), "parent").distinct()


def node_id(*parts: Column) -> Column:
    """A deterministic id in the form of a UUID."""
    h = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("tn_"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)))


def frontier(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, seq, tag) of nodes that hold a tag none of their parents holds."""
    tags = nodes.select("session_id", "seq", F.explode("tags").alias("tag"))
    from_parent = edges.join(
        tags.select("session_id", F.col("seq").alias("parent"), "tag"), ["session_id", "parent"]
    ).select("session_id", F.col("child").alias("seq"), "tag")
    return tags.join(from_parent, ["session_id", "seq", "tag"], "left_anti")


def automaton(needles: list[tuple[object, str]]) -> ahocorasick.Automaton:
    """All known texts as one automaton: a text is read once, however many there are."""
    ids: dict[str, list[int]] = {}
    for i, (_, text) in enumerate(needles):
        ids.setdefault(text, []).append(i)
    out = ahocorasick.Automaton()
    for text, own in ids.items():
        out.add_word(text, own)
    if ids:
        out.make_automaton()
    return out


def _scan_for(hay: DataFrame, key: str, needle: StructField, block: list[tuple[object, str]]) -> DataFrame:
    shared = hay.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS characters at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        a = automaton(known)
        kind = to_arrow_type(needle.dataType)
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column("hay")):
                hit = {k for _, own in a.iter(t.as_py() or "") for k in own}
                rows += [i] * len(hit)
                found += [known[k][0] for k in sorted(hit)]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), pa.array(found, kind)], names=[key, needle.name])

    return hay.mapInArrow(run, StructType([hay.schema[key], needle]))


def containment(rows: DataFrame, needles: DataFrame, key: str, needle_key: str, how: str) -> DataFrame:
    """(key, needle_key) where a known text is in ``text``: exact, normalized, hex or reverse (12 characters or more), or plain (any length).

    The known texts are a stated set, read in blocks of ``BLOCK_CHARS`` characters at most; each block is one automaton,
    broadcast, and one scan of the texts, which are never shuffled or copied.
    """
    forms = {
        "exact": (lambda s: s, lambda s: s), "normalized": (T.normalized, T.normalized),
        "hex": (T.normalized, lambda s: F.lower(F.hex(s.cast("binary")))), "reverse": (lambda s: s, F.reverse), "plain": (lambda s: s, lambda s: s),
    }
    at_hand(rows.sparkSession)
    of_text, of_needle = forms[how]
    ready = needles.select(F.col(needle_key).alias("k"), of_needle(F.col("text")).alias("n")).where(F.length("n") >= (1 if how == "plain" else 12))
    hay = rows.select(key, of_text(F.col("text")).alias("hay"))
    needle = StructField(needle_key, needles.schema[needle_key].dataType)
    parts, block, size = [], [], 0
    for r in ready.orderBy("k", "n").toLocalIterator():
        if block and size + len(r["n"]) > BLOCK_CHARS:
            parts.append(_scan_for(hay, key, needle, block))
            block, size = [], 0
        block.append((r["k"], r["n"]))
        size += len(r["n"])
    if block or not parts:
        parts.append(_scan_for(hay, key, needle, block))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def windows(s: Column, n: int) -> Column:
    """All runs of n characters; characters are cut once, so the cost is linear."""

    def runs(chars: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1)))
        return F.transform(at, lambda i: F.array_join(F.slice(chars, i, n), ""))

    # bound by an outer lambda; a plain expression would be evaluated again for each i
    return F.flatten(F.transform(F.array(F.split(s, "")), runs))


def fragments(rows: DataFrame, needles: DataFrame, key: str, needle_key: str, n: int = 12, longest: int = 256) -> DataFrame:
    """(key, needle_key) where any n characters of a known text (n < length <= longest) are in ``text``."""
    short = needles.where((F.length("text") > n) & (F.length("text") <= longest))
    grams = short.select(needle_key, F.explode(windows(F.col("text"), n)).alias("gram")).distinct()
    grams = F.broadcast(grams) if short.count() * longest <= MAX_BROADCAST_GRAMS else grams
    hay = rows.where(F.length("text") >= n).select(key, F.explode(windows(F.col("text"), n)).alias("gram"))
    return hay.join(grams, "gram").select(key, needle_key).distinct()


def as_of(log: DataFrame, snapshots: DataFrame, slack: str = "250 milliseconds") -> DataFrame:
    """The latest log row at or before each snapshot plus slack, per session, by one sort and no join.

    Both sides are stacked on one time line; a snapshot takes the last log row
    before it. Log rows that tie with it come first; of tied log rows the later one wins. A snapshot without a time takes the last row of its log.
    """
    shifted = F.coalesce(F.col("ts") + F.expr(f"INTERVAL {slack}"), F.lit("9999-12-31").cast(log.schema["ts"].dataType))
    line = log.select("session_id", "ts", F.lit(0).alias("kind"), F.col("seq").alias("ord"), F.struct("seq", "allowed").alias("row")).unionByName(
        snapshots.select("session_id", shifted.alias("ts"), F.lit(1).alias("kind"), F.col("snap").alias("ord"), F.lit(None).cast("struct<seq:bigint,allowed:boolean>").alias("row"))
    )
    w = Window.partitionBy("session_id").orderBy("ts", "kind", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = line.withColumn("hit", F.last("row", ignorenulls=True).over(w)).where(F.col("kind") == 1)
    return last.select("session_id", F.col("ord").alias("snap"), F.col("hit.seq").alias("log_seq"), F.col("hit.allowed").alias("allowed"))
