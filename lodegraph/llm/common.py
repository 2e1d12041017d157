"""What the operators share: tables in the cluster's shared folder and word handling.

Text conventions, the same everywhere in this subpackage: white space is
``[\\x20\\x09-\\x0D]``, letters ``A-Z`` are lower-cased (no other letter is), and a
null text is an empty text.  ``bytes.lower`` and ``bytes.split`` follow exactly
these rules on UTF-8, which is why texts are handled as bytes in Python.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
WHITE_BYTES = b" \t\n\x0b\x0c\r"
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
NO_WHITE = "[^\\x20\\x09-\\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where none is set and all is one process (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        found = "file://" + os.path.join(tempfile.gettempdir(), "lodegraph-checkpoints")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows: texts are long, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def settle(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again: the lineage ends there."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`settle` that no later plan reads."""
    remove(df.sparkSession, df._settled_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df``, written down and counted, with a broadcast hint where it has at most ``max_rows`` rows (of a few numbers each)."""
    df = settle(df, "small")
    return F.broadcast(df) if df.count() <= max_rows else df


def smallest(df: DataFrame, by: Column, rows: int, of: int, ties: tuple = ()) -> DataFrame:
    """At most ``rows`` rows: those with the smallest hash ``by`` among the share of hashes that holds about ``4 * rows`` of ``of``.

    What is sorted, and what reaches one task, stays near ``4 * rows`` rows at every size.
    """
    share = min(1.0, 4 * rows / max(of, 1))
    if share < 1:
        df = df.filter(by < int(-(2**63) + share * 2**64))
    return df.orderBy(by, *ties).limit(rows)


def sampled_texts(docs: DataFrame, keys: list[tuple], max_bytes: int) -> list[str]:
    """The texts of ``keys (doc_id, text_key, size)`` in their order, while they fit into ``max_bytes``; a text counts once for each id."""
    taken, total = [], 0
    for doc_id, tk, size in dict.fromkeys(keys):
        if total + size <= max_bytes:
            taken.append((len(taken), doc_id, tk))
            total += size
    if not taken:
        return []
    wanted = docs.sparkSession.createDataFrame(taken, f"_n int, _id {docs.schema['doc_id'].dataType.simpleString()}, _tk long")
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("_key"))
    found = rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_tk")))
    return [r["text"] for r in found.dropDuplicates(["_n"]).orderBy("_n").select("text").collect()]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Bind ``value`` to a name inside an expression, so that it is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_key(text: Column) -> Column:
    """64 bits that tell apart the texts of rows that share an id."""
    return F.xxhash64(F.lit(7), text)


def to_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def stretches(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Bounds of stretches of rows whose ``sizes`` add up to ``most`` at most; a larger row is one by itself."""
    out, lo, total = [], 0, 0
    for k, size in enumerate(sizes):
        if k > lo and total + size > most:
            out.append((lo, k))
            lo, total = k, 0
        total += size
    return [*out, (lo, len(sizes))] if len(sizes) else out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
