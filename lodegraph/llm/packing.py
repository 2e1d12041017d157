"""Packing token sequences by minimum bin slack.

Documents are tokenised, closed with an end token and cut into whole windows and one
remainder each.  Only the *lengths* of the pieces matter for packing, and there are at
most ``capacity`` of them, so the plan is made from a histogram: again and again the
largest remaining length opens a window, a subset-sum dynamic program over bitsets
(Python integers) finds the multiset of remaining lengths that fills the rest of the
window closest to capacity, backtracking recovers how often each length is taken, and
this *pattern* is repeated as often as the histogram allows.  Every pattern takes some
length below the count it needs, and so at least halves that length's count: a plan
has at most ``capacity * log2(pieces)`` patterns, however many pieces there are.

Pieces of one length are numbered across the cluster (rank within a partition plus the
counts of the partitions before), and a piece's number gives its window and its offset.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Words a worker remembers the ids of, and bytes of text encoded at once (a longer text is encoded by itself).
CACHE_WORDS, GROUP_BYTES = 500_000, 1 << 18
#: Latin and Cyrillic letters that stay one letter when they are lower-cased, as old as any Unicode tables that a tokenizer
#: may know, and ASCII punctuation but the apostrophe, which may belong to the piece of what follows it.
LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u021f\u0400-\u0481\u048a-\u04ce\u04d0-\u04f5"
MARKS = re.escape("".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and b != 39))
_PLAIN = re.compile(f"[{LETTERS}0-9{MARKS}]+").fullmatch
_ALL_PLAIN = re.compile(f"[{LETTERS}0-9{MARKS} ]+").fullmatch
_PIECES = re.compile(f"[{LETTERS}]+|[0-9]|[{MARKS}]+| ").findall
#: The parts of a tokenizer's file that leave pieces as they are, but for lower case, and cut words into the pieces of :data:`_PIECES`.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
KNOWN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _for_pieces(tokenizer):
    """A tokenizer for lower-case pieces with a space between them: without the steps that change nothing there, if the file has just those."""
    from tokenizers import Tokenizer, pre_tokenizers

    steps = json.loads(tokenizer.to_str())
    if steps["normalizer"] != KNOWN_NORMALIZER or steps["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [KNOWN_SPLIT, KNOWN_BYTES]}:
        return tokenizer
    bare = Tokenizer(tokenizer.model)
    at_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), at_bytes])
    return bare


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file that drops white space and closes each of its pieces by an ending.

    Such a tokenizer never joins characters across ASCII white space, so a text's ids are those of its
    words in turn, and a word is encoded once while it is remembered.  A new word made of
    :data:`LETTERS`, digits and :data:`MARKS` alone is cut into the tokenizer's own pieces - a run of letters, one digit, a run
    of marks - which are shared between words; its other words (apostrophes, other scripts, letters that
    grow when they are lower-cased) go to the tokenizer whole.  ``A-Z`` are lower-cased first, as the
    file's normaliser does.  Beyond ``CACHE_WORDS`` the words met most often stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = _for_pieces(self.tokenizer)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.codes: dict[bytes, int] = {}
        self.start, self.length, self.hits = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.flat, self.used, self.n = np.zeros(1 << 14, np.uint32), 0, 0

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Add sequences of ids, end to end, and return the first one's code."""
        first, n, total = self.n, len(lengths), len(ids)
        while first + n > len(self.start):
            self.start, self.length, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.hits))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = ids
        self.start[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + n] = lengths
        self.hits[first : first + n] = 0
        self.used, self.n = self.used + total, first + n
        return first

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the sequences ``at``, end to end, and how many each has."""
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - ends + lengths, lengths)], lengths

    def _encoded(self, words: list[bytes], single: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of ``words``; ``single``: each should be one piece, told apart by the pieces' endings."""
        text = b" ".join(words).decode("utf-8", "replace")
        if single:
            text = text if self.bare is self.tokenizer else text.lower()
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        each = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _learn(self, words: dict[bytes, None]) -> None:
        """Encode and remember words that are not remembered yet."""
        codes, whole, plain = self.codes, [], list(words)
        text = b" ".join(plain).decode("utf-8", "replace")
        if not _ALL_PLAIN(text):
            alone = [bool(_PLAIN(x)) for x in text.split(" ")]
            whole = [w for w, x in zip(plain, alone, strict=True) if not x]
            text = " ".join([t for t, x in zip(text.split(" "), alone, strict=True) if x])
            plain = [w for w, x in zip(plain, alone, strict=True) if x]
        found = _PIECES(text)
        pieces = " ".join([x for x in found if x != " "]).encode().split()  # a word that is one piece has the key of it
        # the places of the spaces among the pieces bound the words
        bounds = [k for k, x in enumerate(found) if x == " "]
        sizes = np.diff(np.append(bounds, len(found)).astype(np.int64), prepend=-1) - 1
        fresh = [x for x in dict.fromkeys(pieces) if x not in codes]
        for new, single in ((fresh, True), (whole, False)):
            if new:
                first = self._append(*self._encoded(new, single))
                codes.update(zip(new, range(first, self.n), strict=True))
        if plain:
            at = np.fromiter(map(codes.__getitem__, pieces), np.int64, len(pieces))
            np.add.at(self.hits, at, 1)
            several = sizes > 1
            if several.any():
                ids, lengths = self._gather(at[np.repeat(several, sizes)])
                lengths = np.add.reduceat(lengths, np.cumsum(sizes[several]) - sizes[several])
                first = self._append(ids, lengths)
                codes.update(zip([plain[k] for k in np.flatnonzero(several).tolist()], range(first, self.n), strict=True))

    def _forget(self) -> None:
        """Keep the half of the words met most often, and halve what is known of how often."""
        words = list(self.codes)
        at = np.fromiter(self.codes.values(), np.int64, len(words))
        stay = np.sort(np.argsort(-self.hits[at], kind="stable")[: CACHE_WORDS // 2])
        ids, lengths = self._gather(at[stay])
        hits = self.hits[at[stay]] // 2
        self.used = self.n = 0
        self._append(ids, lengths)
        self.hits[: self.n] = hits
        self.codes = {words[k]: code for code, k in enumerate(stay.tolist())}

    def encode_all(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, end to end, each closed by ``end_id`` if one is given, and how many each has."""
        if len(self.codes) > CACHE_WORDS:
            self._forget()
        words, counts, special = [], [], {}
        for row, text in enumerate(texts):
            raw = C.to_bytes(text)
            if b"<|" in raw:  # the strings of special tokens: leave them to the tokenizer
                special[row] = np.array(self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                counts.append(0)
                continue
            own = raw.lower().split()
            words += own
            counts.append(len(own))
        at = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(at < 0).tolist()
        if miss:
            new = [words[k] for k in miss]
            self._learn(dict.fromkeys(new))
            at[miss] = np.fromiter(map(self.codes.__getitem__, new), np.int64, len(new))
        np.add.at(self.hits, at, 1)
        ids, lengths = self._gather(at)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(np.array(counts, np.int64))]
        sizes = np.diff(ends, prepend=0)
        if special or end_id is not None:
            tail = np.array([] if end_id is None else [end_id], np.uint32)
            parts = np.split(ids, ends[:-1])
            parts = [special.get(row, part) for row, part in enumerate(parts)]
            sizes = np.array([len(p) + len(tail) for p in parts], np.int64)
            ids = np.concatenate([x for p in parts for x in (p, tail)])
        return ids, sizes

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Each row of ``docs`` as windows of ``capacity`` ids and a remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokenizer(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in C.stretches([len(t or "") for t in texts], GROUP_BYTES):
                ids, sizes = encoder.encode_all(texts[lo:hi], end_id)
                ids = ids.astype("<u4", copy=False)
                per = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), per)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * capacity
                length = np.minimum(capacity, sizes[row] - start)
                cuts = ((np.cumsum(sizes) - sizes)[row] + start).tolist()
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(cuts, length.tolist(), strict=True)]
                arrays = [batch.column(0).take(pa.array(row + lo)), *(pa.array(x, pa.int64()) for x in (start, length, crc, sizes[row]))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(cuts, len(ids)), pa.int32()), pa.array(ids.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return C.in_arrow(docs.select("doc_id", "text"), cut, schema)


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` (descending, each at most ``counts`` times) whose sum is largest but at most ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left, power = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(power, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            power *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + take
            total -= length * take
    return taken


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows ``(length, first rank, windows, times in a window, first window, offset)`` and the number of windows."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths, used, rows, windows = sorted(counts, reverse=True), dict.fromkeys(counts, 0), [], 0
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        taken = fill(lengths, counts, capacity - largest)
        counts[largest] += 1
        taken[largest] = taken.get(largest, 0) + 1
        times, offset = min(counts[k] // n for k, n in taken.items()), 0
        for length in sorted(taken, reverse=True):
            n = taken[length]
            rows.append((length, used[length], times, n, windows, offset))
            used[length] += times * n
            counts[length] -= times * n
            offset += n * length
        windows += times
        lengths = [k for k in lengths if counts[k]]
    return rows, windows


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Pack the texts of ``docs`` into windows of ``capacity`` tokens.

    Returns one row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, ``with_ids``, the ``ids``.  A null or empty text is the end token alone.  Every row is
    a document of its own, whatever its id; a null id stays null.  Windows are padded to ``capacity`` at
    the end.  ``tokenizer``: path of a file for ``tokenizers`` that drops white space.  Other
    columns of ``docs`` are not read.  No rows give no rows.  A very long text is encoded whole, by itself, in the
    memory of its ids.  Pieces of one length are interchangeable: which of them gets which window follows their
    place in the stored pieces and is not defined beyond that.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, with_ids)
    uid = F.monotonically_increasing_id()
    cut = C.settle(cut.withColumn("_uid", uid).withColumn("_part", F.pmod(F.shiftright("_uid", 33), F.lit(C.shuffle_partitions(spark)))), "pack-pieces")
    counts = C.settle(cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows, _ = plan(histogram, capacity)
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast((table[:, 0] << 44 | table[:, 1], table))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_uid")) - 1
    # the numbers alone are ranked and placed; the pieces' ids stay where they are while the places are few enough to send
    slim = cut.select("_uid", "length", "_part").withColumn("_rank", rank)
    ranked = slim.join(starts, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    def place(lengths: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        keys, steps = sent.value
        for length, rank in lengths:
            length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
            step = steps[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            at = rank - step[:, 1]
            yield pd.DataFrame({"sequence_id": step[:, 4] + at // step[:, 3], "offset": step[:, 5] + at % step[:, 3] * length})

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    places = ranked.select("_uid", placed("length", "_rank").alias("_at")).select("_uid", "_at.sequence_id", "_at.offset")
    return cut.join(C.small(places), "_uid").select(*[c for c in cut.columns if not c.startswith("_")], "sequence_id", "offset")
