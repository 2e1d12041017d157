"""The registered queries over the smallest tables, against plain versions of their rules."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lodegraph.llm import decontamination, license_scan, packing, pii_crf, queries, sharding

from ..conftest import SF
from .helpers import WORD
from .test_pii_repetitions import base_by_hand
from .test_quality import scan_by_hand
from .test_texts import classes_by_hand, leaks_by_hand, model_by_hand


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def place_by_hand(number, n, seed):
    """A plain Feistel network with cycle walking; the round function is a chained XXH64."""
    left, right = sharding.domain_bits(n)
    x = number
    while True:
        a, b, wa, wb = x >> right, x & ((1 << right) - 1), left, right
        for k in range(sharding.ROUNDS):
            first = xxhash.xxh64_intdigest(struct.pack("<i", seed * sharding.ROUNDS + k), 42)
            keyed = xxhash.xxh64_intdigest(struct.pack("<q", b), first) & ((1 << wa) - 1)
            a, b, wa, wb = b, a ^ keyed, wb, wa
        x = a << wb | b
        if x < n:
            return x


def test_op2(spark, rows):
    found = {r["doc_id"]: r for r in queries.op2_sharding(spark, SF).collect()}
    raw = sorted((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    assert len(found) == len(raw)
    for number, (i, crc, size) in enumerate(raw):
        place = place_by_hand(number, len(raw), 20)
        r = found[i]
        assert (r["text_crc32"], r["size"], r["shard"], r["slot"], r["grown_shard"], r["law"]) == (crc, size, place % 8, place // 8, None, "rows")


def test_op3(spark, rows):
    found = {r["doc_id"]: r for r in queries.op3_quality_classifier(spark, SF).collect()}
    again = {r["doc_id"]: r["score"] for r in queries.op3_quality_classifier(spark, SF).collect()}
    assert set(found) == {i for i, _ in rows} and {i: r["score"] for i, r in found.items()} == again
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in found.items())
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text or "", found[i]["score"]) == found[i]["score"]


def test_op4(spark, rows):
    t = packing.word_tokenizer(packing.default_tokenizer()).tokenizer
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        found, at = [], 0
        for at in range(0, len(ids), 4096):
            found.append((i, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()), len(ids)))
        want.update(found)
    found = queries.op4_packing(spark, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert sorted(by) == list(range(len(by))) and len(by) <= -(-total // 4096) + 1


def test_op6(spark, rows):
    found = {r["doc_id"]: r for r in queries.op6_pii(spark, SF).collect()}
    for i, text in rows:
        base = base_by_hand(text or "")
        kinds = Counter(k for k, _, _ in base)
        r = found[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [kinds[k] for k in range(4)]
        listed = ",".join(f"{pii_crf.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert len(spans) == r["n_spans"] and {x for x in listed.split(",") if x} <= set(spans)


def test_op7(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = license_scan.train(license_scan.sampled_lines(docs, 300))
    found = {r["doc_id"]: r for r in queries.op7_license_scan(spark, SF).collect()}
    for i, text in rows:
        n, sure, unknown, families = scan_by_hand(model, text)
        assert (found[i]["n_paragraphs"], found[i]["n_licence"], found[i]["n_unknown"], found[i]["families"]) == (n, sure, unknown, ",".join(families))
    # notices of one licence, however their line is spaced, are found where the text names it
    assert any(r["n_licence"] for r in found.values())


def test_op8(spark, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = sorted((x for x in items if decontamination.words_of(x[1])), key=lambda x: x[0])
    some = [i for i, _ in rows][:25]
    found = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontamination(spark, SF).collect()}
    some += sorted({i for i, _ in found})[:5]
    for i, text in rows:
        if i in some and len(WORD.findall(text or "")) < 3000:
            want = leaks_by_hand([t for _, t in items], text, 0.6, 4, 0.75)
            assert {b for a, b in found if a == i} == {items[k][0] for k in want}


def test_op9(spark, rows):
    found = sorted(map(tuple, queries.op9_minhash(spark, SF).collect()), key=repr)
    assert found == classes_by_hand(rows)


def test_op10(spark, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    score, *_ = model_by_hand([t for i, t in rows if not held(i)])
    found = {r["doc_id"]: r for r in queries.op10_katz(spark, SF).collect()}
    for i, text in rows:
        r, want = found[i], score(text)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), *want[:3])
        assert (r["base_score"], r["score"]) == pytest.approx(want[3:], rel=1e-6, abs=1e-6)
