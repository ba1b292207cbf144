"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows.

Texts and items are lower-cased (A-Z) and cut into words; what separates words
is replaced by one space. A window is 13 consecutive words of an item (or all
its words, if fewer). All windows of all items form one automaton, with a space
at either end of a pattern so that it matches whole words only. A text is
scanned once; matches become word ranges, and these byte offsets of the original
text, since normalising a byte never moves it.

The items are collected only after their words have been counted: up to
``max_pattern_words`` words of windows form one automaton. A larger benchmark is
scanned in several blocks of items, one pass over the texts each, and the hits
are merged per document.

Edge cases: null or empty texts have no words and no hits; items without words
(null, empty) have no window; an item that repeats counts once per item_id, and
two ids with one text count twice; a null item_id is ignored; document rows that
repeat are judged each; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import map_arrow, written

WINDOW = 13
#: ASCII bytes that belong to words keep their (lower-case) value, other ASCII bytes become spaces.
FOLD = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)
#: Pattern words of one automaton: about 100 MB in memory.
MAX_PATTERN_WORDS = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(items: list[tuple[object, str | None]], width: int = WINDOW) -> dict[str, list[str]]:
    """Pattern (words with a space before each and at the end) to the ids of its items."""
    out: dict[str, set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            out[(b" " + b" ".join(words[i : i + width]) + b" ").decode("latin-1")].add(str(item))
    return {p: sorted(ids) for p, ids in out.items()}


def automaton(patterns: dict[str, list[str]]) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for p, ids in patterns.items():
        a.add_word(p, (len(p), ids))
    if not patterns:
        return None
    a.make_automaton()
    return a


def scan(a: ahocorasick.Automaton | None, text: str | None) -> tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]:
    """(words, hit word ranges [from, to), ids of items found, byte ranges in the original text)."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    words = folded.split()
    if a is None or not words:
        return len(words), [], set(), []
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    ranges, ids = [], set()
    spaces = None
    for end, (length, found) in a.iter(joined):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        lo, hi = np.searchsorted(spaces, (end - length + 1, end))
        ranges.append((int(lo), int(hi)))
        ids.update(found)
    if not ranges:
        return len(words), [], ids, []
    ranges.sort()
    merged = [list(ranges[0])]
    for lo, hi in ranges[1:]:
        if lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    is_word = np.concatenate(([False], np.frombuffer(folded, np.uint8) != 32, [False]))
    # bytes.split() also splits at \t..\r, but FOLD has turned those into spaces
    edge = np.diff(is_word.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return len(words), [(lo, hi) for lo, hi in merged], ids, [(int(starts[lo]), int(ends[hi - 1])) for lo, hi in merged]


def _scanner(items: Broadcast, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(windows(items.value, width))
        for b in batches:
            found = [scan(a, t.as_py()) for t in b.column("text")]
            span = pa.list_(pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64())]))
            word = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))
            rest = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *rest,
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([[{"from_word": i, "to_word": j} for i, j in x[1]] for x in found], word),
                    pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                    pa.array([[{"from_byte": i, "to_byte": j} for i, j in x[3]] for x in found], span),
                ],
                names=[*names, "n_words", "hits", "items", "spans"],
            )

    return run


FOUND = "n_words long, hits array<struct<from_word:long,to_word:long>>, items array<string>, spans array<struct<from_byte:long,to_byte:long>>"


def item_blocks(benchmark: DataFrame, width: int, limit: int) -> list[list[tuple[object, str | None]]]:
    """Blocks of items, each with at most ``limit`` pattern words (or one item); eight bytes count as a word at least."""
    b = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text")
    weight = F.greatest(F.size(F.split("text", "[^0-9A-Za-z]+")), F.ceil(F.octet_length("text") / 8), F.lit(1)) * width
    if (b.agg(F.sum(weight)).first()[0] or 0) <= limit:
        return [[(r[0], r[1]) for r in b.collect()]]
    blocks, block, n = [], [], 0
    for r in b.select("item_id", "text", weight.alias("w")).toLocalIterator():
        if block and n + (r[2] or 1) > limit:
            blocks.append(block)
            block, n = [], 0
        block.append((r[0], r[1]))
        n += r[2] or 1
    return [*blocks, block]


def find_items(
    docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, max_pattern_words: int = MAX_PATTERN_WORDS
) -> DataFrame:
    """doc_id with n_words, hits (word ranges), items, spans (byte ranges of the original text)."""
    blocks = item_blocks(benchmark, width, max_pattern_words)
    rows = docs.select("doc_id", "text")
    if len(blocks) == 1:
        return map_arrow(rows, _scanner(docs.sparkSession.sparkContext.broadcast(blocks[0]), width), f"doc_id {dict(docs.dtypes)['doc_id']}, {FOUND}")
    rows = written(rows.withColumn("row_key", F.expr("uuid()")))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, row_key string, {FOUND}"
    parts = [map_arrow(rows, _scanner(docs.sparkSession.sparkContext.broadcast(block), width), schema) for block in blocks]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"),
    ).drop("row_key")


def _covered(hits: str) -> F.Column:
    """Words in a union of ranges."""
    ordered = F.array_sort(F.col(hits))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(
        ordered,
        zero,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["to_word"] - F.greatest(a["to"], x["from_word"]))).alias("n"),
            F.greatest(a["to"], x["to_word"]).alias("to"),
        ),
    )["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, share: int = 20, **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and the byte spans.

    A document is contaminated if any word is hit and at least one in ``share``.
    """
    found = find_items(docs, benchmark, width=width, **options).withColumn("n_hit", _covered("hits"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, share: int = 20) -> DataFrame:
    """Rows of ``docs`` that aren't contaminated, unchanged: one pass, no join, if one automaton is enough."""
    blocks = item_blocks(benchmark, width, MAX_PATTERN_WORDS)
    if len(blocks) > 1:
        rows = written(docs.select(F.struct("*").alias("doc"), "text", F.expr("uuid()").alias("doc_id")))  # a key per row
        bad = contamination(rows.select("doc_id", "text"), benchmark, width=width, share=share).where("contaminated").select("doc_id")
        return rows.join(bad, "doc_id", "left_anti").select("doc.*")
    items = docs.sparkSession.sparkContext.broadcast(blocks[0])  # MAX_PATTERN_WORDS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(windows(items.value, width))
        for b in batches:
            keep = []
            for t in b.column("text"):
                n, ranges, _, _ = scan(a, t.as_py())
                hit = sum(j - i for i, j in ranges)
                keep.append(not (hit and share * hit >= n))
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = WINDOW) -> list[tuple]:
    """The contract, word by word, for tests."""
    import re

    fold = {i: i + 32 for i in range(65, 91)}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    needles = [(str(i), cut(t)) for i, t in items]
    out = []
    for doc, text in docs:
        w, hit, ids = cut(text), set(), set()
        for item, q in needles:
            k = min(width, len(q))
            for j in range(len(q) - k + 1) if q else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == q[j : j + k]:
                        hit.update(range(p, p + k))
                        ids.add(item)
        n = len(hit)
        out.append((doc, len(w), n, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return out


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), pat AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM pat),
win AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)
), m AS (SELECT doc_id, win.k, i, item_id FROM win JOIN pat ON win.k = pat.k AND win.p = pat.p),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
