"""Near-duplicates by one-permutation hashing, with every link confirmed on full shingle sets.

A document's set is hashed once; the hash range is cut into bins and each bin keeps its
smallest value.  Empty bins are filled by optimal densification: a bin probes others in
an order of its own until it meets a full one.  Bands of the signature are bucket keys.

Equal sets are merged first and stand for all their copies, so a group of copies costs one
row a bucket.  Candidate edges are stars: in each bucket one member is the centre, the
others are compared with it, and a bucket of ``m`` gives at most ``m - 1`` pairs.  Members whose
link to the centre fails may still belong to others, so buckets that hold more than one
component are worked on with new centres, and after ``rounds`` of these the members
outside a bucket's largest component are compared with all that lie in other components.
Pairs whose overlap is bounded too low by the shingles that only one candidate has are
left out at every step, which no link is.  No bucket, partner or candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
ROWS = 6
#: The chance that no band finds a pair at the threshold is at most this.
MISSED = 5e-5
PROBES = 64


def bands_for(percent: int) -> int:
    """The fewest bands that miss a pair at the threshold with a chance of at most ``MISSED``: 21 at 85, 33 at 80."""
    return max(1, ceil(log(MISSED) / log(1 - (percent / 100) ** ROWS))) if percent < 100 else 1


@cache
def _probes(bins: int) -> np.ndarray:
    """For each bin the order in which it probes others, from a 2-universal family of hashes."""
    i, t = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(1, PROBES + 1, dtype=np.uint64), indexing="ij")
    return (C.mix64(i * np.uint64(0x9E3779B97F4A7C15) + t * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(bins)).astype(np.int64)


@cache
def _cuts(bins: int) -> np.ndarray:
    return np.array([-(-(k << 64) // bins) for k in range(1, bins)], np.uint64)


_SALTS = C.mix64(np.arange(1, ROWS + 1, dtype=np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence where it is shorter."""
    words = C.to_bytes(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = C.mix64(total ^ h[k : k + len(total)]) + total * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(C.mix64(total))


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The densified minima of ``bins`` bins of a sorted, non-empty set."""
    edges = np.concatenate([[0], np.searchsorted(hashes, _cuts(bins))])
    full = np.append(edges[1:], len(hashes)) > edges
    at = np.arange(bins)
    empty = np.flatnonzero(~full)
    for t in range(PROBES):
        if not len(empty):
            break
        target = _probes(bins)[empty, t]
        hit = full[target]
        at[empty[hit]] = target[hit]
        empty = empty[~hit]
    if len(empty):  # so few full bins that no probe met one: the next full bin in the circle
        where = np.flatnonzero(full)
        at[empty] = where[np.searchsorted(where, empty) % len(where)]
    return hashes[edges[at]]


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    sig = signature(hashes, bands * ROWS).reshape(bands, ROWS)
    return C.mix64(C.mix64(sig + _SALTS).sum(1, dtype=np.uint64) ^ C.mix64(np.arange(101, 101 + bands, dtype=np.uint64))).view(np.int64)


def fingerprint(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def profiles(docs: DataFrame, n_bands: int) -> DataFrame:
    """``(doc_id, rk, n, fp, bands)``: set size, set fingerprint and ``n_bands`` band keys; ``rk`` finds the row again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, bands = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_set(text)
                n.append(len(hashes))
                fp.append(fingerprint(hashes))
                bands.append(band_keys(hashes, n_bands) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "rk", "n", "fp", "bands"])

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")
    return C.in_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rk long, n long, fp binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, max_broadcast: int) -> DataFrame:
    """``(fp, hashes)`` of the rows whose ``rk`` is in ``wanted``; its keys are sent to the tasks up to ``max_broadcast`` of them."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "text")
    sent = None
    if wanted.count() <= max_broadcast:
        sent = spark.sparkContext.broadcast(np.sort(wanted.toArrow().column("rk").to_numpy()))
    else:
        rows = rows.join(wanted, "rk", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent is not None:
                keys, rk = sent.value, batch.column(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(keys, rk), max(0, len(keys) - 1))
                batch = batch.filter(pa.array(keys[at] == rk if len(keys) else np.zeros(len(rk), bool)))
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["fp", "hashes"])

    return C.in_arrow(rows, run, "fp binary, hashes array<long>").dropDuplicates(["fp"])


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; the root is a component's smallest node.

    Each round hooks every node to its smallest neighbour, follows the pointers to their
    ends and contracts the links, so rounds and steps are logarithmic.  All tables stay distributed.
    """
    links = C.settle(links.select("a", "b").filter("a <> b"), "component-links")
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = C.settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "component-pointers")
        while True:
            up = pointer.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = C.settle(pointer.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "component-pointers")
            pointer = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = pointer
        else:
            up = pointer.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = C.settle(labels.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "component-labels")
        a = pointer.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = pointer.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = C.settle(links.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "component-links")
        if links.isEmpty():
            return labels


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs (a, b)`` whose sets overlap enough."""
    left = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("hb"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return joined.filter(100 * F.col("both") >= percent * (F.size("ha") + F.size("hb") - F.col("both"))).select("a", "b")


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, rounds: int = 1, max_broadcast: int = 2_000_000) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` on their sets of distinct 5-word
    shingles (a shorter text is one shingle; a null, empty or blank text has an empty set and is
    linked with nothing).  ``component_id`` is the smallest id reachable over links, ``kept`` whether
    it is the row's own.  Repeated rows are copies of each other.  A null id takes part by
    its text and never is a smallest id; a component of null ids alone has a null id and keeps them.
    Other columns of ``docs`` are not read.
    """
    profile = C.settle(profiles(docs, bands_for(percent)), "minhash-profiles")
    nodes = C.settle(profile.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("min_id"), F.min("rk").alias("rk"), F.first("n").alias("n"), F.first("bands").alias("bands")), "minhash-nodes")
    buckets = nodes.select("fp", "n", "rk", F.posexplode("bands").alias("band", "bk"))
    crowded = buckets.groupBy("bk").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = C.settle(buckets.join(crowded, "bk"), "minhash-buckets")
    labels = None
    if not members.isEmpty():
        sets = C.settle(full_sets(docs, members.select("rk").distinct(), max_broadcast), "minhash-sets")
        # shingles that no other candidate has can't be shared: they bound every overlap of their set
        alone = sets.select("fp", F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("fp").alias("fp"))
        alone = alone.filter("m = 1").groupBy("fp").agg(F.count(F.lit(1)).alias("alone"))
        # the member that shares most buckets with others is closest to what a group has in common
        about = members.groupBy("fp").agg(F.first("n").alias("n"), F.sum("m").alias("weight")).join(alone, "fp", "left")
        about = about.select("fp", "weight", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("e"))
        members = C.settle(members.select("bk", "band", "fp", "n").join(about, "fp"), "minhash-members")
        labels = _linked(members, nodes.select("fp", "bands"), sets, percent, rounds)
    where = nodes.select("fp", "min_id")
    if labels is not None:
        where = where.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = where.groupBy("root").agg(F.min("min_id").alias("component_id"))
        where = where.join(least, "root").select("fp", "component_id")
    else:
        where = where.select("fp", F.col("min_id").alias("component_id"))
    found = profile.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("fp")).alias("fp")).join(where, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked(members: DataFrame, bands: DataFrame, sets: DataFrame, percent: int, rounds: int) -> DataFrame | None:
    """Component labels of the nodes in ``members (bk, band, fp, n, e, weight)``, or None without links; ``bands (fp, bands)``.

    Two sets of ``n`` and ``cn`` shingles, ``e`` and ``ce`` of them not alone, can't be linked unless the smaller
    of ``e`` and ``ce`` is an overlap large enough for ``n + cn``; other pairs are no candidates.
    """
    alike = ((100 + percent) * F.least("e", "ce") >= percent * (F.col("n") + F.col("cn"))) & (F.col("fp") != F.col("cfp"))
    labels = links = tested = None
    for r in range(rounds + 2):
        now = members
        if labels is None:
            now = now.withColumn("root", F.col("fp"))
        else:
            now = now.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
            open_ = now.groupBy("bk").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bk")
            now = C.settle(now.join(open_, "bk", "left_semi"), "minhash-open")
            if now.isEmpty():
                break
        if r <= rounds:
            by = F.xxhash64(F.lit(r), F.col("fp")) if r else -F.col("weight")
            centre = now.groupBy("bk").agg(F.min(F.struct(by.alias("h"), "fp", "n", "e", "root")).alias("c"))
            centre = centre.select("bk", F.col("c.fp").alias("cfp"), F.col("c.n").alias("cn"), F.col("c.e").alias("ce"), F.col("c.root").alias("croot"))
            pairs = now.join(centre, "bk").filter(alike & (F.col("root") != F.col("croot")))
        else:
            sizes = now.groupBy("bk", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("bk").agg(F.max(F.struct("k", "root")).alias("top"))
            now = C.settle(now.join(sizes, "bk").withColumn("rest", F.col("root") != F.col("top.root")).drop("top").join(bands, "fp"), "minhash-rest")
            rest = now.filter("rest").select("bk", *[F.col(c).alias(f"c{c}") for c in ("fp", "n", "e", "root", "bands")])
            # a pair is made once: in the first band that both share, and by one of two outside the largest component
            first = F.array_position(F.zip_with("bands", "cbands", lambda x, y: x == y), True) == F.col("band") + 1
            once = first & (~F.col("rest") | (F.col("fp") < F.col("cfp")))
            pairs = now.join(rest, "bk").filter(alike & (F.col("root") != F.col("croot")) & once)
        pairs = _ordered(pairs, "fp", "cfp")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = C.settle(pairs, "minhash-pairs")
        new = C.settle(confirmed(pairs, sets, percent), "minhash-links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links)
    return labels
