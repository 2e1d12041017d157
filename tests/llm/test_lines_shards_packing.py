import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegraph.llm import common as C
from lodegraph.llm import line_dedup, packing, sharding

from .helpers import LOWER, awkward, clashing, empty, table


def lines_by_hand(rows, least):
    strip = " \t\n\x0b\x0c\r"
    counts = Counter()
    for _, text in {(i, t) for i, t in rows}:
        counts.update({k for k in (x.strip(strip).translate(LOWER) for x in (text or "").split("\n")) if k})
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (k := x.strip(strip).translate(LOWER)) or counts[k] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_line_dedup_by_hand(spark, bound):
    texts = [f"Common Line {k % 2}\n  common LINE 1\t\nown {k}\n\nÉ{k % 3}" for k in range(12)]
    df = table(spark, texts).unionByName(awkward(spark).withColumn("doc_id", F.col("doc_id") + 100))
    found = line_dedup.dedup_lines(clashing(df, "n_lines", "kept_sha256"), min_docs=4, n_batches=3, fanout=2, max_broadcast_keys=bound)
    got = sorted(map(tuple, found.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)
    assert got == lines_by_hand([(r["doc_id"], r["text"]) for r in df.collect()], 4)
    assert any(r[2] for r in got)


def test_line_runs_are_levelled(spark):
    store = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for batch in range(7):
        store.add(spark.createDataFrame([(h, h) for h in range(batch, batch + 4)], "hi long, lo long"))
    assert all(len(level) < 2 for level in store.levels)
    assert len(store.levels) == 3
    want = Counter(h for b in range(7) for h in range(b, b + 4))
    assert {r["hi"] for r in store.frequent().collect()} == {h for h, n in want.items() if n >= 3}


def test_runs_are_joined_and_merged_as_they_lie(spark):
    """One exchange, of the batch; the runs' buckets are neither exchanged nor sorted."""
    store = line_dedup.LineRuns(spark, min_docs=2, fanout=4)
    for batch in range(3):
        store.add(spark.createDataFrame([(h % 5, h) for h in range(batch, batch + 40)] * 2, "hi long, lo long"))
    with line_dedup.as_they_lie(spark):
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        batch = plan(store.new_counts(spark.range(50).selectExpr("id % 5 as hi", "id as lo")))
        assert batch.count("SortMergeJoin") == 3 and batch.count("Exchange") == 1 and batch.count(" Sort ") == 1
        assert batch.count("Bucketed: true") == 3
        merged = plan(store.totals(store.runs()[:2]))
        assert "Exchange" not in merged and " Sort " not in merged and merged.count("Bucketed: true") == 2
    # a key counted as frequent by the first run has no second entry
    assert {tuple(r) for r in store.totals().collect()} == {(h % 5, h, 2) for h in range(42)}
    root = store.root
    store.close()
    assert not Path(root.removeprefix("file://")).exists() and store.runs() == []


def test_runs_have_fewer_files_than_there_are_partitions(spark):
    """A run of 64 partitions lies in 16 buckets, one file each, and is still joined and merged as it lies."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        store = line_dedup.LineRuns(spark, min_docs=2, fanout=4)
        for batch in range(2):
            store.add(spark.createDataFrame([(h % 7, h) for h in range(batch, batch + 3000)], "hi long, lo long"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
        for run in store.runs():
            assert len(list(Path(f"{store.root}/{run}".removeprefix("file://")).glob("*.parquet"))) == 16
        with line_dedup.as_they_lie(spark, store.buckets):
            merged = store.totals()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in merged and " Sort " not in merged and merged.count("Bucketed: true") == 2
        assert {tuple(r) for r in store.totals().collect()} == {(k % 7, k, 1 + (0 < k < 3000)) for k in range(3001)}
        store.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_empty_tables(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    assert sharding.shard(empty(spark)).count() == 0
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 100, 257, 1000])
def test_feistel_is_a_permutation(spark, n):
    df = sharding.permuted(spark.range(n).withColumnRenamed("id", "r"), "r", n, 5, "p")
    assert sorted(r["p"] for r in df.collect()) == list(range(n))


def test_shards_by_hand(spark):
    df = awkward(spark)
    found = sharding.shard(clashing(df, "shard", "slot"), n_shards=3).collect()
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n))
    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect() if r["doc_id"] is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found if r["doc_id"] is not None) == want
    assert {r["law"] for r in found} == {"rows"}
    again = sharding.shard(df.repartition(5), n_shards=3).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)


def test_words_are_encoded_as_whole_texts(spark):
    w = packing.WordTokenizer(packing.default_tokenizer())
    texts = [r["text"] or "" for r in awkward(spark).collect()] + ["It's, fine!! (ok) a.b,c &&& x### don't 'tis", "É, ÀB.! <|endoftext|> é, İİ", "a　b c 12,5 + ́x"] * 2
    for t in texts * 2:
        assert w.encode(t).tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids


@given(st.lists(st.text(st.sampled_from("abzAZ019 \n\t'\"<>|.,;!?-#$%&()İıßÉéǅŉΣςσжЖй\u0306\u0308日本नाﬁ\u3000\xa0\u1c80½²ⅣɐӀӏ×÷ſ"), max_size=14), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_any_texts_are_encoded_as_by_the_tokenizer(texts):
    w = packing.word_tokenizer(packing.default_tokenizer())
    ids, sizes = w.encode_all(texts, 2)
    want = [[*w.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_forgetting_words_changes_no_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    w = packing.WordTokenizer(packing.default_tokenizer())
    for k in range(60):
        text = " ".join(f"the wörd{i * k % 13}, İ<< it's" for i in range(k))
        assert w.encode(text).tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(w.codes) < 20 + 80


def test_a_word_of_one_piece_is_remembered_once():
    w = packing.WordTokenizer(packing.default_tokenizer())
    text = "Alpha beta9 it's ÉTÉ alpha -- été"
    assert w.encode(text).tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids
    assert set(w.codes) == {x.encode() for x in ("alpha", "beta9", "beta", "9", "it's", "ÉtÉ", "--", "été")}
    assert w.bare.normalizer is None


def test_a_file_with_other_steps_is_used_whole(tmp_path):
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(packing.default_tokenizer())
    other.normalizer = normalizers.NFC()
    other.save(str(tmp_path / "other.json"))
    w = packing.WordTokenizer(str(tmp_path / "other.json"))
    text = "été ÉÀÉ É é9 Ж ж! it's"
    assert w.bare is w.tokenizer
    assert w.encode(text).tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 5), max_size=12))
@settings(max_examples=150, deadline=None)
def test_plans_place_everything_once(histogram):
    rows, windows = packing.plan(histogram, 64)
    used, placed = Counter(), Counter()
    for length, first, times, n, window, offset in rows:
        assert first == used[length]
        used[length] += times * n
        for t in range(times):
            placed[window + t] += n * length
            assert offset + n * length <= 64
    assert used == Counter(histogram)
    assert len(placed) == windows
    assert windows <= max(1, 2 * -(-sum(k * n for k, n in histogram.items()) // 64))


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=6), st.integers(1, 60))
@settings(max_examples=100, deadline=None)
def test_fill_is_closest_to_the_room(counts, room):
    items = [k for k, n in counts.items() for _ in range(n)]
    sums = {0}
    for k in items:
        sums |= {s + k for s in sums if s + k <= room}
    taken = packing.fill(sorted(counts, reverse=True), counts, room)
    assert sum(k * n for k, n in taken.items()) == max(sums)
    assert all(n <= counts[k] for k, n in taken.items())


def test_packing_by_hand(spark):
    df = awkward(spark)
    found = packing.pack(clashing(df, "start", "sequence_id"), capacity=64).collect()
    t = packing.WordTokenizer(packing.default_tokenizer()).tokenizer
    want = Counter()
    for r in df.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 64):
            piece = ids[at : at + 64]
            want[r["doc_id"], at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
            assert any(x["ids"] == piece for x in found if x["doc_id"] == r["doc_id"])
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_shared_folder_is_that_of_the_session(spark):
    assert C.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
