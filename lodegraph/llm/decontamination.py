"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The test items are indexed once: for every term the items that hold it, cut into blocks of
``BLOCK`` items of like thresholds, with the largest impact (the term's largest share of a
BM25 score) of the term and of each block in its list; nothing is kept for blocks without the term.  Every passage of every
document is a query: windows of words that overlap, so that each stretch as long as the longest item lies whole in one window.

A passage whose terms' largest impacts stay below the smallest threshold is passed over.  Else the terms with the
smallest impacts, as many as together stay below it, can't bring any item up by themselves: only blocks
in the lists of the others are looked at, bounded first by these terms' block maxima and the sum of the rest, then by the block maxima
of all.  In blocks that remain the search goes document-at-a-time in WAND's manner: the postings of the passage's
terms are merged in item order, and an item is scored in full only where the summed upper
bounds of the terms that can still reach it - the pivot condition - meet its threshold.
All items above their threshold (a share of the score an item gets as its own query) are
retrieved, none is lost to a cap.  A hit is *verified* on the words themselves: the item is
split into a question and an answer part - its first two thirds and the rest, as the table tells no more - and enough
word n-grams of both must be in the passage.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = 4
EDGES = b"\"'`.,;:!?()[]{}<>#$%&*|=-_/"
K1, B = 1.2, 0.75
#: What sums of a window's terms, added in different orders, may differ by.
SLACK = 1e-7
#: Windows times blocks that are bounded at once, and words that a worker remembers.
CELLS, MET_WORDS = 1 << 18, 300_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words (all letters here) without punctuation at their ends; a word of punctuation alone is dropped."""
    return [w for w in (x.strip(EDGES) for x in C.to_bytes((text or "").lower()).split()) if w]


@dataclass
class Statistics:
    """What BM25 asks of the whole benchmark: items with a word, their mean and largest length, and in how many each term is."""

    n_items: int
    mean: float
    longest: int
    df: dict[bytes, int]


def statistics(texts: list[list[bytes]]) -> Statistics:
    sizes = [len(w) for w in texts if w]
    return Statistics(len(sizes), float(np.mean(sizes)) if sizes else 1.0, max(sizes, default=0), Counter(w for words in texts for w in set(words)))


@dataclass
class Index:
    """Items in rows; postings by term and item; ``entries``: a row for each term and each block that holds it."""

    item_ids: list
    words: list[np.ndarray]  # term numbers
    terms: dict[bytes, int]
    items: np.ndarray
    impacts: np.ndarray
    term_max: np.ndarray
    term_entries: np.ndarray  # where each term's entries begin, and the end
    entry_block: np.ndarray
    entry_max: np.ndarray
    entry_postings: np.ndarray  # where each entry's postings begin, and the end
    entry_key: np.ndarray  # term * blocks + block, sorted
    n_blocks: int
    thresholds: np.ndarray
    block_thresholds: np.ndarray
    longest: int
    met: dict[bytes, int] = field(default_factory=dict)

    def numbers(self, text: str | None) -> np.ndarray:
        """The term numbers of a text's words, -1 for a word that no item has; words met are remembered with their edges."""
        raw = C.to_bytes((text or "").lower()).split()
        if len(self.met) > MET_WORDS:
            self.met.clear()
        out = np.fromiter(map(self.met.get, raw, repeat(-3)), np.int64, len(raw))
        for k in np.flatnonzero(out == -3).tolist():
            word = raw[k].strip(EDGES)
            out[k] = self.met[raw[k]] = self.terms.get(word, -1) if word else -2
        return out[out != -2]


def build(items: list[tuple], share: float, known: Statistics | None = None) -> Index:
    """Index ``(item_id, text)`` rows; items without a word are left out.  ``known``: of all items, where these are a part."""
    kept = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
    known = known or statistics([w for _, w in kept])
    n_items = len(kept)
    terms: dict[bytes, int] = {}
    rows = []
    for k, (_, words) in enumerate(kept):
        for w, n in Counter(words).items():
            rows.append((terms.setdefault(w, len(terms)), k, n))
    table = np.array(rows, np.int64).reshape(-1, 3)
    df = np.array([known.df[w] for w in terms], float)
    idf = np.log(1 + (known.n_items - df + 0.5) / (df + 0.5))
    size, tf = np.array([len(w) for _, w in kept], float), table[:, 2]
    impacts = idf[table[:, 0]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[table[:, 1]] / known.mean))
    # items in the order of their thresholds: a block's smallest one is then close to the others
    thresholds = share * np.bincount(table[:, 1], weights=impacts, minlength=n_items)
    order = np.argsort(thresholds, kind="stable")
    kept, thresholds = [kept[k] for k in order], thresholds[order]
    table[:, 1] = np.argsort(order)[table[:, 1]]
    by_term = np.lexsort((table[:, 1], table[:, 0]))
    table, impacts = table[by_term], impacts[by_term]
    n_blocks = -(-n_items // BLOCK)
    key = table[:, 0] * max(1, n_blocks) + table[:, 1] // BLOCK
    first = np.flatnonzero(np.diff(key, prepend=-1))
    entry_key = key[first]
    entry_max = np.maximum.reduceat(impacts, first) if len(first) else np.zeros(0)
    term_entries = np.searchsorted(table[first, 0], np.arange(len(terms) + 1))
    term_max = np.maximum.reduceat(entry_max, term_entries[:-1]) if len(terms) else np.zeros(0)
    block_thresholds = np.array([thresholds[b * BLOCK : (b + 1) * BLOCK].min() for b in range(n_blocks)])
    return Index(
        [i for i, _ in kept], [np.array([terms[x] for x in w], np.int32) for _, w in kept], terms, table[:, 1], impacts, term_max, term_entries, entry_key % max(1, n_blocks), entry_max,
        np.append(first, len(table)), entry_key, n_blocks, thresholds, block_thresholds, known.longest,
    )


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``begin .. begin + count - 1`` of each row, end to end."""
    return np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)


def blocks_for(index: Index, known: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Windows ``known[lo:hi]`` of terms and blocks in which an item can reach its threshold for the window's distinct terms."""
    n, n_terms, n_blocks = len(lo), len(index.terms), index.n_blocks
    key = np.unique(np.repeat(np.arange(n), hi - lo) * n_terms + known[_spread(lo, hi - lo)])
    if not len(key):
        return []
    window = key // n_terms
    term = key - window * n_terms
    most = index.term_max[term]
    order = np.lexsort((most, window))
    window, term, most = window[order], term[order], most[order]
    first = np.minimum(np.searchsorted(window, np.arange(n)), len(key) - 1)
    total = np.cumsum(most)
    total -= (total[first] - most[first])[window]
    # items lie in the order of their thresholds; a window's terms before this point stay below every threshold together
    essential = total >= index.block_thresholds[0] - SLACK
    limit = index.block_thresholds - SLACK

    def bounds(some: np.ndarray) -> np.ndarray:
        begin = index.term_entries[term[some]]
        count = index.term_entries[term[some] + 1] - begin
        at = _spread(begin, count)
        return np.bincount(np.repeat(window[some], count) * n_blocks + index.entry_block[at], index.entry_max[at], n * n_blocks).reshape(n, n_blocks)

    bound = bounds(essential)
    rest = np.bincount(window[~essential], most[~essential], n)
    able = (bound > 0) & (bound + rest[:, None] >= limit)
    if able.any():
        bound += bounds(~essential & able.any(1)[window])
        able &= bound >= limit
    return [(int(k), int(block)) for k, block in zip(*np.nonzero(able), strict=True)]


def entries_of(index: Index, terms: np.ndarray, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the blocks are in the terms' lists, and at which entry."""
    key = terms * index.n_blocks + blocks
    at = np.minimum(np.searchsorted(index.entry_key, key), len(index.entry_key) - 1)
    return index.entry_key[at] == key, at


def wand(index: Index, query: np.ndarray, block: int) -> list[tuple[int, float]]:
    """Items of one block whose score for the distinct terms ``query`` reaches their threshold."""
    end, found = (block + 1) * BLOCK, []
    hit, at = entries_of(index, query, block)
    # [item, position, end, bound]
    cursors = [[int(index.items[index.entry_postings[e]]), int(index.entry_postings[e]), int(index.entry_postings[e + 1]), float(index.entry_max[e])] for e in at[hit].tolist()]
    least = index.block_thresholds[block]
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, None
        for k, c in enumerate(cursors):
            bound += c[3]
            if bound >= least - SLACK:
                pivot = k
                break
        if pivot is None:
            break
        item = cursors[pivot][0]
        if cursors[0][0] == item:
            score = 0.0
            for c in cursors:
                if c[0] == item:
                    score += index.impacts[c[1]]
            if score >= index.thresholds[item] - SLACK:
                found.append((item, score))
            item += 1
        for c in cursors[: pivot + 1] if cursors[0][0] < item else cursors:
            while c[1] < c[2] and index.items[c[1]] < item:
                c[1] += 1
            c[0] = int(index.items[c[1]]) if c[1] < c[2] else end
        cursors = [c for c in cursors if c[0] < end]
    return found


def overlap(part: list, grams: set[tuple], size: int) -> float:
    """The share of the n-grams of ``part`` in ``grams``; of its words where it is shorter than a gram."""
    n = min(size, len(part))
    own = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    return sum(g in grams for g in own) / max(1, len(own))


def verified(item: list, passage: list, size: int, enough: float) -> bool:
    """Whether both the question (the first two thirds of an item) and the answer (the rest) are in the passage."""
    cut = max(1, -(-2 * len(item) // 3))
    for part in (item[:cut], item[cut:]):
        if part:
            n = min(size, len(part))
            grams = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
            if overlap(part, grams, size) < enough:
                return False
    return True


def search(index: Index, text: str | None, window: int, step: int, size: int, enough: float) -> list[tuple[int, int, float]]:
    """``(item, first word, score)`` of the best verified passage for each item found in ``text``."""
    at = index.numbers(text)
    if not len(at) or not index.terms:
        return []
    where = np.flatnonzero(at >= 0)
    known = at[where]
    first = np.arange(0, max(1, len(at) - window + step), step)
    last = np.minimum(first + window, len(at))
    lo, hi = np.searchsorted(where, first), np.searchsorted(where, last)
    best: dict[int, tuple[int, float]] = {}
    # A term counted as often as it occurs bounds it counted once, so running sums give a first, cheap bound.
    sums = np.concatenate([[0.0], np.cumsum(index.term_max[known])])
    able = np.flatnonzero(sums[hi] - sums[lo] >= index.block_thresholds[0] * (1 - 1e-9) - 1e-12 * sums[-1] - SLACK)
    per = max(1, CELLS // index.n_blocks)
    for a in range(0, len(able), per):
        some = able[a : a + per]
        for k, block in blocks_for(index, known, lo[some], hi[some]):
            k = int(some[k])
            for item, score in wand(index, np.unique(known[lo[k] : hi[k]]), block):
                if item in best and best[item][1] >= score:
                    continue
                if verified(index.words[item].tolist(), at[first[k] : last[k]].tolist(), size, enough):
                    best[item] = (int(first[k]), score)
    return sorted((item, at, score) for item, (at, score) in best.items())


def _all_statistics(benchmark: DataFrame) -> tuple[Statistics, DataFrame]:
    """Numbers of the whole benchmark without its terms, and these as ``(term, df)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))], names=["n", "terms"])

    items = C.settle(C.in_arrow(benchmark.select("text"), run, "n long, terms array<binary>").filter("n > 0"), "benchmark-words")
    r = items.agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("mean"), F.max("n").alias("most")).collect()[0]
    df = C.settle(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "benchmark-terms")
    C.discard(items)
    return Statistics(r["k"], r["mean"] or 1.0, r["most"] or 0, {}), df


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, gram: int = 4, enough: float = 0.75, max_index_bytes: int = 16 << 20) -> DataFrame:
    """``(doc_id, item_id, first_word, score)``: the items found in each row of ``docs``, with their best passage.

    The items are collected, indexed and sent to the tasks in groups whose texts are about ``max_index_bytes`` at most (an index
    takes some twelve times its texts); with more, the documents are searched once for each group.  Statistics and windows are those
    of all items, so the result is the same for any number of groups.  A window is twice the longest item and steps by
    half of it, so every stretch as long as an item lies in one.  Of equally good passages the first counts.  A
    null or empty text holds nothing, an item without words is found nowhere; equal items are
    all found; each row is searched by itself, a very long text window by window.  Other columns are not read.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, first_word long, score double"
    sized = benchmark.select("item_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("_size"))
    total = sized.agg(F.sum("_size").alias("s")).collect()[0]["s"] or 0
    groups = max(1, -(-2 * total // max_index_bytes)) if total > max_index_bytes else 1
    known, df = _all_statistics(benchmark) if groups > 1 else (None, None)
    out = None
    for g in range(groups):
        part = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        items = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0], x[1] or ""))
        if known:
            own = spark.createDataFrame([(w,) for w in {w for _, t in items for w in words_of(t)}], "term binary")
            known.df = {bytes(r["term"]): r["df"] for r in df.join(own, "term", "left_semi").collect()}
        found = _searched(docs, spark.sparkContext.broadcast(build(items, share, known)), schema, gram, enough)
        out = found if out is None else out.unionByName(found)
    return out


def _searched(docs: DataFrame, sent, schema: str, gram: int, enough: float) -> DataFrame:
    item_type = pa.from_numpy_dtype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        window = max(2, 2 * index.longest)
        for batch in batches:
            rows, items, first, scores = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for item, at, score in search(index, text, window, max(1, window // 2), gram, enough):
                    rows.append(row)
                    items.append(index.item_ids[item])
                    first.append(at)
                    scores.append(score)
            at = pa.array(rows, pa.int64())
            ids = pa.array(items) if items else pa.array([], item_type)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), ids, pa.array(first, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "item_id", "first_word", "score"])

    return C.in_arrow(docs.select("doc_id", "text"), run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns kept; see :func:`contaminated`.

    Rows that share an id are searched and judged by their texts.
    """
    found = contaminated(docs.select(F.struct("doc_id", C.text_key(F.col("text")).alias("tk")).alias("doc_id"), "text"), benchmark, **options)
    hit = found.select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.tk").alias("_tk")).distinct()
    hit = C.small(hit)
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_id"]) & (C.text_key(docs["text"]) == hit["_tk"]), "left_anti")
