"""A reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to N-1 in the order of ``(doc_id, text checksum, size)``; the
permutation sends number ``r`` to position ``p``, which is shard ``p mod shards`` and
slot ``p div shards``.  Shard sizes are therefore at most one row apart and slots are
gapless, and with ``N`` and the seed anyone can compute a row's place from its number
(and, the network being invertible, the number from the place) without a table.

Only DataFrame functions are used: the numbering needs one range exchange of narrow
rows (no text) and one small count for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common as C

ROUNDS = 4
#: Steps of cycle walking that are compiled in line, and the most that are taken. A step ends the walk of at
#: least half of the rows that are left, so a row needs more than MAX_WALK with a probability under 2**-120.
INLINE_WALK, MAX_WALK = 4, 128


def domain_bits(n: int) -> tuple[int, int]:
    """Bits of the left and right half of the smallest domain ``2**bits >= n``."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def feistel(x: Column, left: int, right: int, seed: int) -> Column:
    """One application of the network to ``x`` in ``[0, 2**(left+right))``; the halves swap widths each round."""
    a, b, wa, wb = F.shiftright(x, right), x.bitwiseAND(F.lit((1 << right) - 1)), left, right
    for k in range(ROUNDS):
        keyed = F.xxhash64(F.lit(seed * ROUNDS + k), b).bitwiseAND(F.lit((1 << wa) - 1))
        a, b, wa, wb = b, a.bitwiseXOR(keyed), wb, wa
    return F.shiftleft(a, wb).bitwiseOR(b)


def permuted(df: DataFrame, number: str, n: int, seed: int, out: str) -> DataFrame:
    """Add ``out``: the place of row number ``number`` in a permutation of ``[0, n)``."""
    left, right = domain_bits(n)
    df = df.withColumn(out, feistel(F.col(number), left, right, seed))
    for _ in range(INLINE_WALK):
        df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(feistel(F.col(out), left, right, seed)))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_WALK)), F.col(out), lambda x, _: F.when(x < n, x).otherwise(feistel(x, left, right, seed)))
    df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(walk))
    return df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))


def numbered(rows: DataFrame, order: list[str], out: str = "row_number", n_ranges: int | None = None) -> tuple[DataFrame, int]:
    """Number ``rows`` from 0 in ``order`` without bringing them to one task; rows equal in ``order`` take any of their numbers.

    Range-partitions the rows, counts each range (``n_ranges`` numbers reach the driver, whatever
    the input's size), and adds the counts of the ranges before to the rank within a range.
    """
    spark = rows.sparkSession
    n_ranges = n_ranges or C.shuffle_partitions(spark)
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = C.settle(tied.repartitionByRange(n_ranges, *order, "_tie").withColumn("_range", F.spark_partition_id()), "shard-ranges")
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    offsets, total = [], 0
    for k, count in counts:
        offsets.append((k, total))
        total += count
    schema = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_offset", T.LongType())])
    before = F.broadcast(spark.createDataFrame(offsets, schema))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie"))
    out_df = ranged.withColumn("_rank", rank).join(before, "_range").withColumn(out, F.col("_offset") + F.col("_rank") - 1)
    return out_df.drop("_tie", "_range", "_rank", "_offset"), total


def shard(docs: DataFrame, n_shards: int = 8, seed: int = 20) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number)`` of every row of ``docs``.

    ``size``: UTF-8 bytes of the text plus 1; a null text has no bytes and the checksum of
    nothing.  Law ``rows``: shards are at most one row apart; ``grown_shard`` is null, as it
    belongs to another law.  A null id sorts first; rows alike in id and text are
    interchangeable.  Other columns of ``docs`` are not read.  No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    rows = permuted(rows, "row_number", n, seed, "_place")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_place") % n_shards).cast("int").alias("shard"), F.expr(f"_place div {int(n_shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
