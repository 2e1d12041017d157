"""Katz backoff language model over word bigrams, in partitioned tables.

Tokens are a document's words (``A-Z`` lower-cased) and one end; a start symbol is the first
history.  For a history ``h`` and a token ``w``::

    P(w | h) = d(c(h, w)) * c(h, w) / c(h)   if c(h, w) > 0
             = alpha(h) * P(w)               otherwise, alpha(h) = 1 for a history never seen

``d`` are Good-Turing discounts (counts above ``LARGE`` are trusted), ``alpha(h)`` makes the
probabilities of all tokens after ``h``, the unknown one included, sum to exactly one, and
``P(w)`` is the same recursion's lower order: discounted counts whose remainder belongs to
the unknown token.

Counts and weights live in tables keyed by 64-bit hashes of tokens.  Taking logarithms the
recursion splits into a sum over a document's tokens of ``log P(w) + log alpha(h)`` and, for
bigrams that were seen, a correction ``log P(w|h) - log P(w) - log alpha(h)``, which is stored with
the bigram.  The most frequent unigrams and bigrams - a fixed number, whatever the corpus -
are sent to the tasks as sorted arrays; the occurrences they don't cover are gathered by
document within a task and looked up in the full tables: rare words by a join, pairs by
sorted, packed ranges of hashes, in which a pair of a document takes some seven bytes
(corrections, logarithms within 32 of zero, are kept to 26 binary places there).
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

LARGE = 5
#: Entries of the unigram and bigram tables that are sent to the tasks; 24 and 16 bytes each.
HEAD_WORDS, HEAD_PAIRS = 1 << 19, 1 << 20
#: Packed blocks by range of hashes: pairs of documents (kind 0), pairs of the model (1), sums of documents (2).
FIXED = 2.0**26
BLOCKS = "shard int, kind int, block binary"
#: Pairs of the model in one range, about, at most.
RANGE_PAIRS = 8_000_000
#: Tokens a task gathers before it passes on their counts; blocks, which need more memory for a token, are made of half as many
#: rows of the model, or a quarter as many tokens of documents.
GATHER = 2_000_000
START, END = np.int64(xxhash.xxh3_64_intdigest(b"\x00start") - (1 << 63)), np.int64(xxhash.xxh3_64_intdigest(b"\x00end") - (1 << 63))


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words and the end."""
    words = C.to_bytes(text).lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = out.view(np.int64)
    out[-1] = END
    return out


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = C.mix64(h.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)
    return C.mix64(x).view(np.int64)


def _counted(docs: DataFrame, pairs: bool) -> DataFrame:
    """Counts of tokens ``(w, c)`` or of pairs ``(h, w, c)``, summed over stretches of a task's rows."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        w = np.concatenate(held)
        if not pairs:
            value, count = np.unique(w, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value), pa.array(count)], names=["w", "c"])
        h = np.concatenate([x for t in held for x in (np.array([START]), t[:-1])])
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
        return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(w[first]), pa.array(np.diff(np.append(first, len(h))))], names=["h", "w", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(tokens(text))
                n += len(held[-1])
                if n >= GATHER:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return C.in_arrow(docs.select("text"), run, "h long, w long, c long" if pairs else "w long, c long")


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, plane by plane: high planes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _shards(g: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of hashes begins in sorted ``g``, and the end."""
    cuts = np.array([-(-(k << 64) // n) for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(g, cuts), [len(g)]]).astype(np.int64)


def _packed(parts: list[np.ndarray]) -> bytes:
    """Equally long or not, arrays of whole numbers as one compressed block."""
    raw = [_planes(x) for x in parts]
    head = np.array([len(raw), *[len(x) for x in raw]], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(raw))


def _unpacked(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    sizes = np.frombuffer(raw[8 : 8 + 8 * n], "<i8").tolist()
    out, at = [], 8 + 8 * n
    for size in sizes:
        out.append(_numbers(raw[at : at + size]))
        at += size
    return out


def discounts(counts: dict[int, int]) -> np.ndarray:
    """Katz's ``d(r)`` for ``r`` up to ``LARGE`` from the counts of counts; absolute discounts of a half where those are too few or uneven to give a factor within (0, 1)."""
    n = [counts.get(r, 0) for r in range(LARGE + 2)]
    d = np.ones(LARGE + 1)
    common = (LARGE + 1) * n[LARGE + 1] / n[1] if n[1] else 1.0
    for r in range(1, LARGE + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def _discount(c, d: np.ndarray):
    return F.when(c > LARGE, F.lit(1.0)).otherwise(F.element_at(F.array(*[F.lit(float(x)) for x in d[1:]]), F.least(c, F.lit(LARGE)).cast("int")))


def _count_of_counts(table: DataFrame) -> dict[int, int]:
    rows = table.filter(F.col("c") <= LARGE + 1).groupBy("c").count().collect()
    return {r["c"]: r["count"] for r in rows}


def _head(table: DataFrame, size: int) -> DataFrame:
    """The rows with the largest counts ``c``: as many whole count classes as hold at most ``size`` rows."""
    grade = F.floor(16 * F.log2(F.col("c"))).cast("int")
    classes = sorted(((r["g"], r["count"]) for r in table.filter("c > 0").groupBy(grade.alias("g")).count().collect()), reverse=True)
    least, total = None, 0
    for g, n in classes:
        total += n
        if total > size:
            break
        least = g
    return table.filter(F.lit(False)) if least is None else table.filter((F.col("c") > 0) & (grade >= least))


def _arrays(df: DataFrame, key: str) -> list[np.ndarray]:
    rows = df.toArrow()
    order = np.argsort(rows.column(key).to_numpy(), kind="stable")
    return [rows.column(c).to_numpy()[order] for c in rows.column_names]


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` in sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


@dataclass
class Model:
    """The tables of a trained model; see :func:`fit`."""

    words: DataFrame
    seen: list[DataFrame]
    histories: DataFrame
    n: int
    v: int
    log_unknown: float
    head_words: DataFrame
    head_pairs: DataFrame | None
    table: str
    n_pairs: int

    def close(self) -> None:
        """Drop the table of pairs; what :func:`score` has returned doesn't need it."""
        spark = self.words.sparkSession
        where = spark.sql(f"DESCRIBE FORMATTED {self.table}").filter("col_name = 'Location'").collect()[0]["data_type"]
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        C.remove(spark, where)


def fit(docs: DataFrame) -> Model:
    """Train on every row of ``docs``.

    ``words``: ``(w, c, logp, loga)`` - count, log10 probability and, as a history, log10 backoff weight (0 where
    it never was one; the start symbol has a row with count 0).  ``seen``: pairs ``(h, w, c, p)`` in
    parts, those whose word is among the head (a table bucketed by ``h``) and the others.  ``histories``: ``(h, ch,
    half, loga)``.  The whole corpus is counted; nothing is cut off.
    """
    spark = docs.sparkSession
    words = C.settle(_counted(docs, False).groupBy("w").agg(F.sum("c").alias("c")), "katz-words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    d1 = discounts(_count_of_counts(words))
    mass = (words.agg(F.coalesce(F.sum(_discount(F.col("c"), d1) * F.col("c")), F.lit(0.0))).collect()[0][0]) / max(n, 1)
    # where nothing was discounted, one more observation: of the unknown token
    scale = n / (n + 1) if n and mass > 1 - 1e-12 else 1.0
    unknown = 1 - mass * scale if n else 1.0

    def p1(c):
        return F.lit(scale / max(n, 1)) * _discount(c, d1) * c

    # the head's words are numbered, so that most pairs are stored with a short number instead of a hash
    top = _head(words, HEAD_WORDS).select("w", F.col("c").alias("cw")).toArrow().sort_by("w")
    top = C.settle(spark.createDataFrame(top.append_column("r", pa.array(np.arange(top.num_rows, dtype=np.int32)))), "katz-head")
    parts = C.shuffle_partitions(spark)
    pairs = _counted(docs, True).repartition(parts, "h").groupBy("h", "w").agg(F.sum("c").alias("c"))
    name = f"katz_pairs_{uuid.uuid4().hex}"
    # the rows already lie by the hash of h, as the buckets do: each task writes one of them
    known = pairs.join(F.broadcast(top.select("w", "r")), "w", "left").select("h", "r", F.when(F.col("r").isNull(), F.col("w")).alias("w"), "c")
    known.write.option("compression", "zstd").option("path", C.fresh_path(spark, "katz-pairs")).bucketBy(parts, "h").sortBy("h", "r").saveAsTable(name, format="parquet")
    del pairs, known
    release(spark)
    table = spark.table(name)
    n_pairs = table.count()
    d2 = discounts(_count_of_counts(table))

    def of_head(rows: DataFrame) -> DataFrame:
        return rows.filter("r is not null").select("h", "r", "c").join(F.broadcast(top), "r").select("h", "w", "c", p1(F.col("cw")).alias("p"))

    with_head = of_head(table)
    others = table.filter("r is null").select("h", "w", "c").join(words.select("w", F.col("c").alias("cw")), "w")
    others = C.settle(others.select("h", "w", "c", p1(F.col("cw")).alias("p")), "katz-rare-pairs")
    sums = [F.sum("c").alias("ch"), F.sum(_discount(F.col("c"), d2) * F.col("c")).alias("kept"), F.sum("p").alias("lower"), F.count(F.lit(1)).alias("types")]
    by_history = with_head.groupBy("h").agg(*sums).unionByName(others.groupBy("h").agg(*sums))
    by_history = by_history.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("ch", "kept", "lower", "types")])
    # a history all of whose pairs are trusted gives up half an observation of each
    half = F.col("kept") > F.col("ch") * (1 - 1e-9)
    left = F.when(half, 0.5 * F.col("types") / F.col("ch")).otherwise(1 - F.col("kept") / F.col("ch"))
    loga = F.log10(left) - F.log10(F.greatest(1 - F.col("lower"), F.lit(unknown)))
    with setting(spark, "spark.sql.unionOutputPartitioning", "false"):  # a union with a bucketed table isn't laid together by bucket
        histories = C.settle(by_history.select("h", "ch", half.alias("half"), loga.alias("loga")), "katz-histories")
    unigrams = words.join(histories.select(F.col("h").alias("w"), "loga"), "w", "full")
    unigrams = C.settle(unigrams.select("w", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce(F.log10(p1(F.col("c"))), F.lit(0.0)).alias("logp"), F.coalesce("loga", F.lit(0.0)).alias("loga")), "katz-unigrams")
    head_words = _head(unigrams, HEAD_WORDS).unionByName(unigrams.filter(F.col("w").isin(int(START), int(END)))).dropDuplicates(["w"])
    model = Model(unigrams, [with_head, others], histories, n, v, float(np.log10(unknown)), head_words, None, name, n_pairs)
    model.head_pairs = corrections(of_head(_head(table, HEAD_PAIRS)), histories, d2)
    rare = others.repartition(parts, "h")
    C.discard(words)
    model.seen = [corrections(part, histories, d2) for part in (with_head, rare)]
    release(spark)
    return model


def corrections(pairs: DataFrame, histories: DataFrame, d: np.ndarray) -> DataFrame:
    """``(h, w, delta)``: what a seen pair adds to its document's sum of ``log P(w) + log alpha(h)``."""
    kept = F.when(F.col("half"), F.col("c") - 0.5).otherwise(_discount(F.col("c"), d) * F.col("c"))
    return pairs.join(histories.hint("shuffle_hash"), "h").select("h", "w", (F.log10(kept / F.col("ch")) - F.log10("p") - F.col("loga")).alias("delta"))


@contextmanager
def setting(spark, key: str, value: str):
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def by_some_keys(spark):
    """Let tables that lie partitioned by the history alone be joined on history and word as they lie."""
    return setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def release(spark) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _gathered(docs: DataFrame, model: Model, head: tuple, shards: int) -> DataFrame:
    """Blocks of :data:`BLOCKS`: for stretches of documents, the sums of what the head tells (kind 2) and the pairs outside it,
    sorted by hash and packed by ranges of hashes (kind 0)."""
    n, v = model.n, model.v

    def blocks(g: np.ndarray, doc: np.ndarray, k: np.ndarray, rk: np.ndarray, sums: pa.RecordBatch) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, sums.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(sums)
        cuts, shard, block = _shards(g, shards), [int(rk[0]) % shards], [sink.getvalue().to_pybytes()]
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[s], cuts[s + 1]
            own, local = np.unique(doc[a:b], return_inverse=True)
            shard.append(s)
            block.append(_packed([np.diff(g[a:b], prepend=np.uint64(0)), local, k[a:b], rk[own]]))
        kinds = [2] + [0] * (len(shard) - 1)
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kinds, pa.int32()), pa.array(block, pa.binary())], names=["shard", "kind", "block"])

    def flush(rk: list, ids: list, held: list[np.ndarray]) -> pa.RecordBatch:
        lengths, m = np.array([len(t) for t in held]), len(held)
        w = np.concatenate(held)
        held.clear()  # two tasks of an executor do this at once: what isn't needed any more goes
        starts = np.cumsum(lengths) - lengths
        h = np.concatenate([[START], w[:-1]])
        h[starts] = START
        doc = np.repeat(np.arange(m, dtype=np.int32), lengths)
        (wk, wc, wp, wa), (pk, pd_) = head.value
        g = pair_hash(h, w)
        del h
        by_pair = np.argsort(g, kind="stable")  # a document's tokens stay in order within a pair
        g = g[by_pair]
        found, covered = _find(pk, g)
        of_pairs = np.zeros(len(w))
        of_pairs[by_pair[covered]] = pd_[found[covered]]
        g, pair_doc = g[~covered], doc[by_pair[~covered]]
        del by_pair, found, covered
        at, hit = _find(wk, w)
        count = np.where(hit, wc[at] if len(wc) else 0, 0)
        # as a token and, but for the end, as a history; the start symbol is a history once a document
        s_at, s_hit = _find(wk, np.array([START]))
        start_loga = float(wa[s_at[0]]) if s_hit[0] else 0.0
        value = np.where(hit, (wp[at] + np.where(w == END, 0.0, wa[at])) if len(wk) else 0.0, 0.0)
        value += of_pairs
        del of_pairs, at
        base = np.where(hit, np.log10((count + 1) / (n + v + 1)), 0.0)
        sums = lambda x: np.add.reduceat(x, starts)
        rare = np.flatnonzero(~hit)
        rd, rw = doc[rare], w[rare]
        order = np.lexsort((rw, rd))
        rd, rw = rd[order], rw[order]
        new = np.flatnonzero(np.concatenate([[True], (rw[1:] != rw[:-1]) | (rd[1:] != rd[:-1])])) if len(rd) else np.zeros(0, np.int64)
        k = np.diff(np.append(new, len(rd)))
        keys, r = np.array(rk, np.int64), len(new)
        none = lambda x, dtype: pa.concat_arrays([pa.array(x, dtype), pa.nulls(r, dtype)])
        sums_of = pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([keys, keys[rd[new]]])), pa.concat_arrays([pa.array(ids, id_arrow), pa.nulls(r, id_arrow)]), pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(rw[new], pa.int64())]), pa.array(np.concatenate([np.ones(m, np.int64), k])),
             none(lengths, pa.int64()), none(sums((count > 0).astype(np.int64)), pa.int64()), none(sums(base), pa.float64()), none(sums(value) + start_loga, pa.float64())],
            names=["rk", "doc_id", "w", "k", "n_tokens", "n_known", "base", "score"],
        )
        doc = pair_doc
        del w, hit, count, value, base, rare, rd, rw, order, k, pair_doc
        if len(g):  # signed order to unsigned: the negative half comes last
            turn = np.searchsorted(g, 0)
            g, doc = np.roll(g, -turn), np.roll(doc, -turn)
        g = g.view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])) if len(g) else np.zeros(0, np.int64)
        return blocks(g[new], doc[new], np.diff(np.append(new, len(g))), keys, sums_of)

    id_type = docs.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rk, ids, held, size = [], [], [], 0
        for batch in batches:
            for key, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rk.append(key)
                ids.append(own)
                held.append(tokens(text))
                size += len(held[-1])
                if size >= GATHER // 4:
                    yield flush(rk, ids, held)
                    rk, ids, held, size = [], [], [], 0
        if held:
            yield flush(rk, ids, held)

    # rows are numbered in the one pass that reads them: no two share a number
    rows = docs.select(F.monotonically_increasing_id().alias("rk"), "doc_id", "text")
    return C.in_arrow(rows, run, BLOCKS)


def _model_blocks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(h, w, delta)`` as blocks of sorted hashes and corrections."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        g = np.concatenate([x for x, _ in held])
        order = np.argsort(g, kind="stable")
        g, delta = g[order], np.concatenate([x for _, x in held])[order]
        if len(delta) and np.abs(delta).max() * FIXED >= 2**31:
            raise OverflowError("a correction of 10 ** 32 can't be stored")
        cuts = _shards(g, shards)
        full = np.flatnonzero(np.diff(cuts)).tolist()
        block = [_packed([np.diff(g[cuts[s] : cuts[s + 1]], prepend=np.uint64(0)), np.rint(delta[cuts[s] : cuts[s + 1]] * FIXED).astype("<i4").view("<u4")]) for s in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([1] * len(full), pa.int32()), pa.array(block, pa.binary())], names=["shard", "kind", "block"])

    held, n = [], 0
    for batch in batches:
        held.append((pair_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()).view(np.uint64), batch.column(2).to_numpy()))
        n += batch.num_rows
        if n >= GATHER // 2:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def _range_table(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and corrections of one range."""
    parts = [_unpacked(b) for b in blocks]
    g = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(x[0], dtype=np.uint64) for x in parts]])
    delta = np.concatenate([np.zeros(0), *[x[1].astype("<u4").view("<i4") / FIXED for x in parts]])
    order = np.argsort(g, kind="stable")
    return g[order], delta[order]


def _joined(id_arrow: pa.DataType):
    """Look the documents' pairs up in the model's: blocks come by range, the model's before the documents', and one range's part of the model is held."""
    types = [pa.int64(), id_arrow, *[pa.int64()] * 4, pa.float64(), pa.float64()]
    names = ["rk", "doc_id", "w", "k", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, table = None, [], None
        for batch in batches:
            for shard, kind, block in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if kind == 2:
                    yield from pa.ipc.open_stream(block)
                    continue
                if shard != at:
                    at, held, table = shard, [], None
                if kind == 1:  # the model's blocks of a range come first
                    held.append(block)
                    continue
                if table is None:
                    table, held = _range_table(held), []
                steps, doc, k, rk = _unpacked(block)
                found, hit = _find(table[0], np.cumsum(steps, dtype=np.uint64))
                if not hit.any():
                    continue
                sums = np.bincount(doc.astype(np.int64), weights=np.where(hit, table[1][found] * k, 0.0), minlength=len(rk))
                nulls = [pa.nulls(len(rk), t) for t in types[1:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(rk.view(np.int64)), *nulls, pa.array(sums)], names=names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs``.

    ``base_score`` adds ``log10((c+1)/(N+1*(V+1)))`` over the tokens, ``score`` is the model's log10 probability of the
    text.  A null or empty text is one end token.  Repeated rows get equal values; a null id stays null.  With an
    untrained model every token is unknown.  Other columns of ``docs`` are not read.  A very long text is held whole, as the
    hashes of its tokens.  Ties don't arise: no ranking is made.
    """
    spark = docs.sparkSession
    n, v = model.n, model.v
    words = _arrays(model.head_words.select("w", "c", "logp", "loga"), "w")
    hp = model.head_pairs.toArrow()
    g = pair_hash(hp.column("h").to_numpy().astype(np.int64), hp.column("w").to_numpy().astype(np.int64)) if hp.num_rows else np.zeros(0, np.int64)
    order = np.argsort(g, kind="stable")
    head = spark.sparkContext.broadcast((words, [g[order], hp.column("delta").to_numpy()[order] if hp.num_rows else np.zeros(0)]))
    # a document has a row of sums for each range that holds pairs of it: ranges as large as a task can hold
    shards, id_type = max(1, C.shuffle_partitions(spark) // 3, -(-model.n_pairs // RANGE_PAIRS)), docs.schema["doc_id"].dataType
    with by_some_keys(spark):
        seen = model.seen[0].unionByName(model.seen[1])
        both = _gathered(docs, model, head, shards).unionByName(seen.mapInArrow(lambda batches: _model_blocks(batches, shards), BLOCKS))
        schema = f"rk long, doc_id {id_type.simpleString()}, w long, k long, n_tokens long, n_known long, base double, score double"
        summed = C.settle(both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("kind") % 2 == 0).mapInArrow(_joined(to_arrow_type(id_type)), schema), "katz-summed")
    release(spark)
    own = summed.filter("n_tokens is not null").select("rk", "doc_id", "n_tokens", "n_known", "base", "score")
    rare = summed.filter("w is not null").select("rk", "w", "k").join(model.words.filter("c > 0").select("w", "c", "logp", "loga"), "w", "left")
    found = summed.filter("n_tokens is null and w is null").groupBy("rk").agg(F.sum("score").alias("score"))
    unknown = F.lit(model.log_unknown)
    none = F.lit(None)
    rare = rare.groupBy("rk").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("base"),
        F.sum(F.col("k") * (F.coalesce("logp", unknown) + F.coalesce("loga", F.lit(0.0)))).alias("score"),
    )
    parts = own.select("rk", "n_tokens", "n_known", "base", "score")
    parts = parts.unionByName(rare.select("rk", none.cast("long").alias("n_tokens"), "n_known", "base", "score"))
    parts = parts.unionByName(found.select("rk", none.cast("long").alias("n_tokens"), none.cast("long").alias("n_known"), none.cast("double").alias("base"), "score"))
    total = parts.groupBy("rk").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    rows = own.select("rk", "doc_id").join(total, "rk")
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
