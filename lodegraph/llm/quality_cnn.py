"""A quality classifier: a small byte-level convolutional network in numpy.

The whole document is covered by overlapping chunks of ``CHUNK`` bytes, half a chunk
apart.  Learned filters of ``WIDTH`` bytes run over every position of each chunk and are
max-pooled.  A dense layer turns a chunk's pooled responses into hidden units, these are pooled over the
document by maximum and by mean, and a logistic unit makes one probability of them.

A text's score depends on its bytes alone, to the last bit: no window reaches into another text of
the batch, and sums run in one order whatever the batch holds.

Labels are learned from a bounded sample (``max_train_rows``, ``max_train_bytes``) of the labelled rows outside
the held-out fold; everything else runs over whole texts, one batch of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CHUNK, WIDTH, FILTERS, HIDDEN = 256, 6, 12, 24
HALF = CHUNK // 2
#: Bytes convolved at once.
BLOCK = 1 << 19


@dataclass
class Network:
    """Parameters; ``taps[j, b]`` holds each filter's weight for byte ``b`` at offset ``j``."""

    taps: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def initial(rng: np.random.Generator) -> Network:
        normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        return Network(
            normal(WIDTH, 256, FILTERS, by=0.3), np.zeros(FILTERS, np.float32), normal(FILTERS, HIDDEN, by=1 / np.sqrt(FILTERS)),
            np.zeros(HIDDEN, np.float32), normal(2 * HIDDEN, by=0.1), np.zeros(1, np.float32),
        )

    def trained(self) -> list[np.ndarray]:
        return [self.taps, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts padded with zeros to whole half-chunks (two at least), end to end, and each one's first half-chunk.

    A window that begins within a text ends before the padding does.
    """
    sizes = np.array([max(2, -(-(len(t) + WIDTH - 1) // HALF)) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(starts[-1] * HALF, np.uint8)
    for text, at in zip(texts, (starts[:-1] * HALF).tolist(), strict=True):
        data[at : at + len(text)] = np.frombuffer(text, np.uint8)
    return data, starts


def _filters(net: Network, data: np.ndarray, starts: np.ndarray, argmax: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Each half-chunk's largest response of each filter (and where it was); windows that leave their text's padding don't count."""
    n_half = len(data) // HALF
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    best = np.empty((n_half, FILTERS), np.float32)
    where = np.empty((n_half, FILTERS), np.int64) if argmax else None
    step = BLOCK // HALF
    for a in range(0, n_half, step):
        b = min(n_half, a + step)
        total = net.taps[0].take(padded[a * HALF : b * HALF], axis=0)
        for j in range(1, WIDTH):
            total += net.taps[j].take(padded[a * HALF + j : b * HALF + j], axis=0)
        total = total.reshape(b - a, HALF, FILTERS)
        last = starts[1:][(starts[1:] > a) & (starts[1:] <= b)] - 1 - a
        total[last, HALF - WIDTH + 1 :] = -np.inf
        if where is not None:
            where[a:b] = total.argmax(1)
        best[a:b] = total.max(1)
    return best + net.bias, where


def features(net: Network, data: np.ndarray, starts: np.ndarray, argmax: bool = False):
    """Chunk features and each text's first chunk; a chunk is two half-chunks of one text."""
    best, where = _filters(net, data, starts, argmax)
    last = np.zeros(len(best), bool)
    last[starts[1:] - 1] = True
    left = np.flatnonzero(~last)
    pooled = np.maximum(best[left], best[left + 1])
    first = starts[:-1] - np.arange(len(starts) - 1)
    taken = None
    if where is not None:
        right = best[left + 1] > best[left]
        taken = (np.where(right, left[:, None] + 1, left[:, None]) * HALF + np.where(right, where[left + 1], where[left]), pooled > 0)
    return np.maximum(pooled, 0), first, taken


def _hidden(net: Network, x: np.ndarray) -> np.ndarray:
    """The dense layer, added up filter by filter: a matrix product may sum a row another way at another place."""
    h = np.broadcast_to(net.dense_bias, (len(x), HIDDEN)).copy()
    for k in range(FILTERS):
        h += x[:, k : k + 1] * net.dense[k]
    return np.maximum(h, 0)


def forward(net: Network, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 for each text."""
    data, starts = laid_out(texts)
    x, first, _ = features(net, data, starts)
    h = _hidden(net, x)
    counts = np.diff(np.append(first, len(h)))[:, None]
    pooled = np.concatenate([np.maximum.reduceat(h, first), np.add.reduceat(h, first) / counts], axis=1)
    logit = ((pooled * net.out).sum(1) + net.out_bias[0]).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _gradients(net: Network, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    data, starts = laid_out(texts)
    x, first, (place, live) = features(net, data, starts, argmax=True)
    h = _hidden(net, x)
    counts = np.diff(np.append(first, len(h)))
    owner = np.repeat(np.arange(len(texts)), counts)
    top = np.maximum.reduceat(h, first)
    pooled = np.concatenate([top, np.add.reduceat(h, first) / counts[:, None]], axis=1)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias[0], -40, 40)))
    d_logit = ((p - label) * weight / weight.sum()).astype(np.float32)
    d_pooled = d_logit[:, None] * net.out
    at_top = h == top[owner]
    d_h = np.where(at_top, d_pooled[owner, :HIDDEN], 0) + d_pooled[owner, HIDDEN:] / counts[owner, None]
    d_h *= h > 0
    d_filter = d_h @ net.dense.T * live
    d_taps = np.zeros_like(net.taps)
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    which = np.broadcast_to(np.arange(FILTERS), place.shape)
    for j in range(WIDTH):
        np.add.at(d_taps[j], (padded[place + j], which), d_filter)
    return [d_taps, d_filter.sum(0), x.T @ d_h, d_h.sum(0), pooled.T @ d_logit, d_logit.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 3, epochs: int = 14, rate: float = 0.01, batch: int = 32, batch_bytes: int = 1 << 19) -> Network:
    """Fit by Adam on class-balanced cross-entropy; a batch ends at ``batch`` texts or ``batch_bytes`` bytes."""
    rng = np.random.default_rng(seed)
    net = Network.initial(rng)
    share = max(labels.mean(), 1e-3) if len(labels) else 0.5
    weights = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1e-3)).astype(np.float32)
    first, second, steps = [np.zeros_like(p) for p in net.trained()], [np.zeros_like(p) for p in net.trained()], 0
    total = epochs * max(1, len(texts) // batch)
    for _ in range(epochs):
        order, lo = rng.permutation(len(texts)), 0
        while lo < len(order):
            hi, size = lo, 0
            while hi < len(order) and hi - lo < batch and (hi == lo or size + len(texts[order[hi]]) <= batch_bytes):
                size += len(texts[order[hi]])
                hi += 1
            rows, lo = order[lo:hi], hi
            steps += 1
            now = rate * max(0.05, 1 - steps / total)
            grads = _gradients(net, [texts[i] for i in rows], labels[rows].astype(np.float32), weights[rows])
            for p, g, m, v in zip(net.trained(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-7)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, max_train_rows: int, max_train_bytes: int = 64 << 20, folds: int = 5) -> tuple[list[bytes], np.ndarray]:
    """At most ``max_train_rows`` labelled texts outside fold 0, half of each label where there are enough, chosen by a hash of the id.

    Of rows that share an id, each different text counts; in the order of the hash texts are taken while they
    fit into ``max_train_bytes``, so what reaches the driver is bounded.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (C.id_bucket(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("_by", F.xxhash64(F.lit(11), "doc_id"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    half = [C.smallest(known.filter(F.col("quality") == q), F.col("_by"), max_train_rows // 2, counts.get(q, 0), ("doc_id",)) for q in (0, 1)]
    chosen = half[0].unionByName(half[1]).select("doc_id", "quality", "_by")
    rows = docs.select("doc_id", C.text_key(F.col("text")).alias("_tk"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("_size"))
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("_by", "doc_id", "_tk", "quality").agg(F.max("_size").alias("_size"))
    keys = [tuple(r) for r in rows.orderBy("_by", "doc_id", "_tk").limit(max_train_rows).select("doc_id", "_tk", "_size", "quality").collect()]
    total, fits = 0, []
    for key in keys:
        if total + key[2] <= max_train_bytes:
            fits.append(key)
            total += key[2]
    return [C.to_bytes(t) for t in C.sampled_texts(docs, [k[:3] for k in fits], max_train_bytes)], np.array([k[3] for k in fits], np.int64)


def score(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train_rows: int = 3000, folds: int = 5, network: Network | None = None, max_train_bytes: int = 64 << 20
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Only ``text`` makes the score; a null or empty text is scored as an empty chunk, a very long one whole, by itself,
    in blocks.  ``labels`` has ``doc_id`` and ``quality``; rows with other labels than 0 and 1 teach nothing, and of
    conflicting rows the lower label counts.  Without a labelled row of each class every
    score is what an untrained output unit gives.  Each row is scored by itself: equal texts get equal scores, whatever
    stands beside them; other columns of ``docs`` are not read.  A score of exactly ``threshold`` is label 1.
    """
    if network is None:
        network = train(*training_sample(docs, labels, max_train_rows, max_train_bytes, folds))
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [C.to_bytes(t) for t in batch.column(2).to_pylist()]
            scores = np.empty(len(texts))
            for lo, hi in C.stretches([len(t) for t in texts], 2 * BLOCK):
                scores[lo:hi] = forward(sent.value, texts[lo:hi])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (C.id_bucket(F.col("doc_id"), folds) == 0).alias("held_out"), "text")
    return C.in_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
