"""Uniform shuffle into shards with exact sizes (DataFrame functions only).

The shuffle follows the communication-matrix scheme: rows are dealt into blocks
by a hash; how many rows block ``b`` sends to shard ``s`` is drawn exactly from
the multivariate hypergeometric law that a uniform permutation of all rows would
give; every block permutes its own rows and sends that many to each shard; each
shard permutes what it got. Shard sizes are fixed beforehand, at most one apart
(law ``rows``).

The matrix is drawn in SQL expressions, in two levels (groups of blocks, then
blocks within a group), so that no fold runs over more than the square root of
the number of blocks. Slots within a shard come from sub-cells: a cell's offset
is the running sum of cell counts, so a shard is never sorted in one task. Every
random number is a hash of the row, so recomputed tasks deal alike. Rows that repeat
entirely are numbered first, and the number is hashed along, so that copies are dealt
apart like any other rows. Blocks hold about ``ROWS_PER_BLOCK`` rows and ``BYTES_PER_BLOCK`` bytes of text at most, so
that what a task sorts is bounded by both.

Edge cases: null text has size 1 (0 bytes plus 1) and crc32 0; rows that repeat
entirely are interchangeable and get different slots; an empty table gives an
empty result; extra columns are carried, but for columns named shard or slot in whatever case,
which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import beside, counted_side, let, uniform, written

ROWS_PER_BLOCK = 4_000_000
BYTES_PER_BLOCK = 256 << 20
MIN_BLOCKS = 256
#: Copies of one row that are numbered in one window.
COPIES = 100


def hypergeometric(n: Column, good: Column, total: Column, u: Column) -> Column:
    """Successes among n draws without replacement from total with good successes, by inversion.

    Weights follow from the ratio of neighbouring probabilities, over ten
    standard deviations either side of the mean (what lies outside is below
    the resolution of a double).
    """

    def drawn(p: Column) -> Column:
        n, good, total, u = p["n"], p["g"], p["t"], p["u"]
        mean = n * good / F.greatest(total, F.lit(1))
        sd = F.sqrt(
            F.greatest(mean * (1 - good / F.greatest(total, F.lit(1))) * (total - n) / F.greatest(total - 1, F.lit(1)), F.lit(0.0))
        )
        lo = F.greatest(F.lit(0).cast("long"), n - total + good, (F.floor(mean - 10 * sd) - 10).cast("long"))
        hi = F.least(n, good, (F.ceil(mean + 10 * sd) + 10).cast("long"))

        def over(q: Column) -> Column:
            def ratio(k: Column) -> Column:
                return (good - k).cast("double") * (n - k) / ((k + 1).cast("double") * (total - good - n + k + 1))

            ks = F.sequence(q["lo"], F.greatest(q["lo"], q["hi"]))
            zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
            whole = F.aggregate(ks, zero, lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["s"] + a["w"]).alias("s")))["s"]
            return let(
                whole * u,
                lambda goal: q["lo"]
                + F.aggregate(
                    ks,
                    F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c")),
                    lambda a, k: F.struct(
                        (a["w"] * ratio(k)).alias("w"), (a["s"] + a["w"]).alias("s"),
                        (a["c"] + F.when((a["s"] + a["w"] < goal) & (k < q["hi"]), 1).otherwise(0)).cast("long").alias("c"),
                    ),
                )["c"],
            )

        return F.when(hi <= lo, lo).otherwise(let(F.struct(lo.alias("lo"), hi.alias("hi")), over))

    return let(F.struct(n.alias("n"), good.alias("g"), total.alias("t"), u.alias("u")), drawn)


def deal(blocks: Column, room: Column, seed: int) -> Column:
    """Fold over blocks (array of struct<id, n>): array of struct<id, row array<long>>.

    ``room`` has what each shard can still take; each block's row is one
    multivariate hypergeometric draw, shard by shard.
    """
    long0 = F.lit(0).cast("long")

    def one(block: Column, room: Column) -> Column:
        start = F.struct(
            block["n"].alias("n"), F.aggregate(room, long0, lambda a, x: a + x).alias("t"), F.array().cast("array<bigint>").alias("row")
        )

        def step(a: Column, s: Column) -> Column:
            return let(
                hypergeometric(a["n"], s["r"], a["t"], uniform(F.lit(seed), block["id"], s["i"])),
                lambda k: F.struct(
                    (a["n"] - k).alias("n"), (a["t"] - s["r"]).alias("t"), F.concat(a["row"], F.array(k)).alias("row")
                ),
            )

        numbered = F.transform(room, lambda r, i: F.struct(r.alias("r"), i.alias("i")))
        return F.aggregate(numbered, start, step)["row"]

    def fold(a: Column, block: Column) -> Column:
        return let(
            one(block, a["room"]),
            lambda row: F.struct(
                F.zip_with(a["room"], row, lambda r, k: r - k).alias("room"),
                F.concat(a["out"], F.array(F.struct(block["id"].alias("id"), row.alias("row")))).alias("out"),
            ),
        )

    none = F.array().cast("array<struct<id:bigint,row:array<bigint>>>")
    return F.aggregate(blocks, F.struct(room.alias("room"), none.alias("out")), fold)["out"]


def communication_matrix(counts: DataFrame, sizes: list[int], seed: int, width: int) -> DataFrame:
    """counts (id, n) to (id, row): rows each block sends to each shard; groups are id div width."""
    room = F.array(*(F.lit(x).cast("long") for x in sizes))
    ordered = F.sort_array(F.collect_list(F.struct("id", "n")))
    grouped = counts.withColumn("g", F.floor(F.col("id") / width).cast("long"))
    groups = grouped.groupBy("g").agg(F.sum("n").alias("n"))
    top = groups.agg(F.sort_array(F.collect_list(F.struct(F.col("g").alias("id"), "n"))).alias("blocks"))
    top = top.select(F.explode(deal(F.col("blocks"), room, seed)).alias("x")).select(F.col("x.id").alias("g"), F.col("x.row").alias("room"))
    below = grouped.groupBy("g").agg(ordered.alias("blocks")).join(top, "g")
    return below.select(F.explode(deal(F.col("blocks"), F.col("room"), seed + 1)).alias("x")).select("x.id", "x.row")


def told_apart(rows: DataFrame) -> DataFrame:
    """doc, tie with a tie of its own for each copy of a row that repeats; other ties stay.

    Copies are numbered within salted windows, so a row that makes up much of a
    table is spread. Numbers follow the order of the scan; they are written,
    as a task that runs again must find the same.
    """
    twice = counted_side(rows.groupBy("tie").count().where("count > 1").withColumnRenamed("tie", "t"))
    if twice.isEmpty():
        return rows
    met = rows.withColumn("at", F.monotonically_increasing_id()).join(twice, F.col("tie") == F.col("t"))
    salted = met.withColumn("salt", F.pmod(F.xxhash64("at"), F.ceil(F.col("count") / COPIES)))
    nth = F.row_number().over(Window.partitionBy("tie", "salt").orderBy("at"))
    copies = written(salted.withColumn("nth", nth).select("doc", F.xxhash64("tie", "salt", "nth").alias("tie")))
    return rows.join(twice, F.col("tie") == F.col("t"), "left_anti").union(copies)


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, seed: int = 23, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """All rows and columns, with shard (int) and slot (long, gapless from 0 in its shard)."""
    texts = [F.octet_length(F.col(f"`{n}`")) for n, t in docs.dtypes if t in ("string", "binary")]
    held = sum((F.coalesce(x.cast("long"), F.lit(0)) for x in texts), F.lit(0).cast("long"))
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    n_blocks = max(MIN_BLOCKS, -(-total // rows_per_block), -(-size // BYTES_PER_BLOCK))
    cells = max(1, n_blocks // n_shards)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    plain = [F.col(c) for c in beside(docs, "shard", "slot")]
    rows = told_apart(docs.select(F.struct(*plain).alias("doc"), F.xxhash64(*plain).alias("tie")))
    rows = rows.select(
        "doc", "tie", F.pmod(F.xxhash64("tie", F.lit(seed)), F.lit(n_blocks)).alias("id"),
        F.xxhash64("tie", F.lit(seed + 1)).alias("first"), F.xxhash64("tie", F.lit(seed + 2)).alias("second"),
    )
    counts = rows.groupBy("id").agg(F.count("*").alias("n"))
    matrix = written(communication_matrix(counts, sizes, seed, max(1, round(n_blocks**0.5))))
    # permute within the block: its first row[0] rows go to shard 0, the next row[1] to shard 1, ...
    at = F.row_number().over(Window.partitionBy("id").orderBy("first", "tie"))
    upto = F.transform("row", lambda _, i: F.aggregate(F.slice("row", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    sent = (
        rows.withColumn("at", at)
        .join(matrix.withColumn("upto", upto).drop("row"), "id")
        .select("doc", "tie", "second", F.size(F.filter("upto", lambda c: c < F.col("at"))).alias("shard"))
        .withColumn("cell", F.pmod(F.xxhash64("second"), F.lit(cells)))
    )
    # permute within the shard: cell after cell, each in the order of a second random number
    held = sent.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("second", "tie"))
    return (
        sent.withColumn("nth", slot)
        .join(offsets, ["shard", "cell"])
        .select("doc.*", "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"))
    )
