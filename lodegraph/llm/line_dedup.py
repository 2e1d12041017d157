"""Line deduplication over levelled sorted runs of line hashes.

A *run* is a table of ``(hi, lo, n_docs)`` - a 128-bit hash of a line's key
and the number of documents seen with it - in buckets by the hash, each one sorted file, and known
to Spark as such: joins and sums over runs stream through the files as they lie, without an exchange or a sort.
A new batch is exchanged once, merge-anti-joins the runs (keys a run already counts as frequent need no
second entry) and is added as a run of level 0.  As soon as a level holds ``fanout``
runs (two, where merging should need no exchange) they are merged, bucket by bucket, into one run of the next level, so a store that has taken ``b``
batches has ``O(fanout * log b)`` runs and each hash was rewritten ``O(log b)`` times.

A line's key is the line with white space stripped at both ends and ``A-Z`` lower-cased.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RUN_SCHEMA = "hi long, lo long, n_docs long"
#: Shuffle partitions that make a bucket.  Entries are narrow, and a file costs more than its rows: a local folder starts
#: processes for each, and such a child shares all pages of its executor until it runs.
PARTITIONS_A_BUCKET = 4


def line_key(line: bytes) -> bytes:
    return line.strip(C.WHITE_BYTES).lower()


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """A store of line counts in levelled sorted runs; see the module's text.

    ``min_docs``: from this many documents on a key is frequent.  ``fanout``: runs of a
    level before they are compacted.  All files live below ``root`` in the shared folder.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, root: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.root = root or C.fresh_path(spark, "line-runs")
        self.name = f"line_runs_{uuid.uuid4().hex}"
        parts = C.shuffle_partitions(spark)
        self.buckets = min(parts, max(2 * spark.sparkContext.defaultParallelism, parts // PARTITIONS_A_BUCKET))
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, counts: DataFrame) -> str:
        run, self.written = f"{self.name}_{self.written:06d}", self.written + 1
        options = {"path": f"{self.root}/{run}", "compression": "zstd"}
        with as_they_lie(self.spark, self.buckets):
            counts.select("hi", "lo", "n_docs").write.options(**options).bucketBy(C.shuffle_partitions(self.spark), "hi", "lo").sortBy("hi", "lo").saveAsTable(run, format="parquet")
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        C.remove(self.spark, f"{self.root}/{run}")

    def new_counts(self, keys: DataFrame) -> DataFrame:
        """The counts of a batch, without the keys that a run already counts as frequent."""
        counts = keys.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"))
        for run in self.runs():
            full = self.spark.table(run).filter(F.col("n_docs") >= self.min_docs).select("hi", "lo")
            counts = counts.join(full.hint("merge"), ["hi", "lo"], "left_anti")
        return counts

    def add(self, keys: DataFrame) -> None:
        """Add a batch: ``keys`` has a row ``(hi, lo)`` for each document and distinct key in it."""
        self.levels[0].append(self._write(self.new_counts(keys)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            compact = self._write(self.totals(old))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(compact)
            for run in old:
                self._drop(run)
            level += 1

    def totals(self, runs: list[str] | None = None) -> DataFrame:
        """``(hi, lo, n_docs)`` over the given runs, or over all."""
        tables = [self.spark.table(run) for run in (self.runs() if runs is None else runs)]
        return reduce(merged, tables) if tables else self.spark.createDataFrame([], RUN_SCHEMA)

    def frequent(self) -> DataFrame:
        """``(hi, lo)`` of the frequent keys, written down."""
        with as_they_lie(self.spark, self.buckets):
            return C.settle(self.totals().filter(F.col("n_docs") >= self.min_docs).select("hi", "lo"), "line-frequent")

    def close(self) -> None:
        """Drop all runs."""
        for run in self.runs():
            self._drop(run)
        C.remove(self.spark, self.root)
        self.levels = [[]]


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sums of two runs by a merge join (a union of bucketed tables would be summed by bucket without being laid together)."""
    total = F.coalesce(a["n_docs"], F.lit(0)) + F.coalesce(b["n_docs"], F.lit(0))
    return a.join(b.hint("merge"), ["hi", "lo"], "full").select("hi", "lo", total.alias("n_docs"))


@contextmanager
def as_they_lie(spark: SparkSession, buckets: int | None = None):
    """Let Spark look whether each bucket is one file, and so sorted as a whole, and exchange into as many partitions as there are ``buckets``."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"} | ({"spark.sql.shuffle.partitions": str(buckets)} if buckets else {})
    old = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def _split_hash(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), dtype=">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, tk, hi, lo)``: one row for each document and distinct line key of at least ``min_chars`` code points."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                keys = {line_key(line) for line in C.to_bytes(text).split(b"\n")}
                keys = [k for k in keys if len(k) >= min_chars and (min_chars < 2 or len(k.decode("utf-8", "surrogatepass")) >= min_chars)]
                rows += [row] * len(keys)
                hashes += map(key_hash, keys)
            hi, lo = _split_hash(hashes)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hi), pa.array(lo)], names=["doc_id", "tk", "hi", "lo"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", C.text_key(F.col("text")).alias("tk"), "text")
    return C.in_arrow(rows, extract, f"doc_id {id_type}, tk long, hi long, lo long")


def _rewritten(docs: DataFrame, frequent_of, extra: list[str]) -> DataFrame:
    """Drop lines; ``frequent_of(batch)`` returns for each row a set-like of the hashes to drop."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = frequent_of(batch)
            n_lines, n_dropped, kept, digests = [], [], [], []
            for text, drop in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), sets, strict=True):
                lines = C.to_bytes(text).split(b"\n")
                rest = lines if not drop else [x for x in lines if not (k := line_key(x)) or key_hash(k) not in drop]
                joined = b"\n".join(rest)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(rest))
                kept.append(None if text is None else joined.decode("utf-8", "surrogatepass"))
                digests.append(hashlib.sha256(joined).hexdigest())
            out = [batch.column(batch.schema.get_field_index(c)) for c in extra]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())], names=[*extra, "n_lines", "n_dropped", "kept_text", "kept_sha256"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    return C.in_arrow(docs, rewrite, f"{schema}, n_lines long, n_dropped long, kept_text string, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_batches: int = 4, fanout: int = 2, max_broadcast_keys: int = 1_000_000) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents.

    Returns the columns of ``docs`` without ``text``, plus ``n_lines`` (before), ``n_dropped``,
    ``kept_text`` and ``kept_sha256`` (of its UTF-8 bytes).  A text is split at ``\\n``; a null or
    empty one is one empty line, which has no key and stays (a null text gives a null
    ``kept_text`` and the digest of nothing).  Rows with the same id and text are one document
    to the counts, and each keeps its row.  The documents go into the runs in ``n_batches``
    batches.  Up to ``max_broadcast_keys`` frequent keys (16 bytes each) are sent to the
    tasks; beyond that the documents are joined with their keys by a shuffle.  A very long text is split
    whole, in the memory of its lines.  A key in exactly ``min_docs`` documents is frequent.
    Columns of ``docs`` named like a result are replaced by the result.
    """
    spark = docs.sparkSession
    keys = C.settle(document_keys(docs, min_chars).withColumn("batch", F.pmod(F.col("tk"), F.lit(n_batches))), "line-keys")
    store = LineRuns(spark, min_docs, fanout)
    for b in range(n_batches):
        one = keys.filter(F.col("batch") == b).dropDuplicates(["doc_id", "tk", "hi", "lo"])
        store.add(one.select("hi", "lo"))
    frequent = store.frequent()
    store.close()
    results = ("n_lines", "n_dropped", "kept_text", "kept_sha256")
    extra = [c for c in docs.columns if c != "text" and c not in results]
    if frequent.count() <= max_broadcast_keys:
        rows = frequent.toArrow()
        packed = np.column_stack([rows.column("hi").to_numpy(), rows.column("lo").to_numpy()]).astype(">i8").tobytes()
        sent = spark.sparkContext.broadcast(frozenset(packed[i : i + 16] for i in range(0, len(packed), 16)))
        C.discard(keys)
        C.discard(frequent)
        return _rewritten(docs.select(*extra, "text"), lambda batch: [sent.value] * batch.num_rows, extra)
    hits = keys.join(frequent, ["hi", "lo"], "left_semi").dropDuplicates(["doc_id", "tk", "hi", "lo"])
    hits = hits.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("hi", "lo")).alias("_drop"))
    hits = C.settle(hits.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "_drop"), "line-hits")
    C.discard(keys)
    C.discard(frequent)
    joined = docs.select(*extra, "text").join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (C.text_key(F.col("text")) == F.col("_tk")), "left")

    def own(batch: pa.RecordBatch) -> list[set[bytes]]:
        lists = batch.column(batch.schema.get_field_index("_drop")).to_pylist()
        return [{np.array([x["hi"], x["lo"]], ">i8").tobytes() for x in drop or ()} for drop in lists]

    return _rewritten(joined.select(*extra, "text", "_drop"), own, extra)
