import hashlib
import math
import re
import tracemalloc
import types
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import decontamination, katz, minhash, pii_crf

from .helpers import LOWER, WORD, awkward, clashing, empty, table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@pytest.mark.parametrize("text", ["a@b.c", "x a.b@c-d.e.f, @z.y a@b@c.d", "a@b c@d.e", "@@a@b.c..d@e.f", "é.x@y.z-", "a@.b a@b."])
def test_emails_by_the_pattern(text):
    assert [(s, e) for _, s, e in pii_crf.emails(text)] == [m.span() for m in EMAIL.finditer(text)]


def test_base_spans_by_hand():
    text = "ip 1.2.3.4 no 1.2.3.999 card 4111 1111 1111 1111 bad 4111111111111112 tel +1 (790) 555-2115 short +12 34"
    found = [(pii_crf.KINDS[k], text[s:e]) for k, s, e in pii_crf.base_spans(text)]
    assert found == [("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (790) 555-2115")]


def test_field_links_repetitions(spark):
    secret = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    train = [f'words token = "{hashlib.sha1(str(k).encode()).hexdigest()}" and +1 (790) 555-{k:04d} or 12 apples' for k in range(60)]
    texts = [*train, f'token = "{secret}" ' + "filler " * 50 + secret, "call +1 (790) 555-2115 then 17905552115 later", "only 12 apples and 3 pears", None, ""]
    found = pii_crf.find(clashing(table(spark, texts), "spans")).collect()
    by = {r["doc_id"]: r for r in found}
    assert Counter(s["kind"] for s in by[60]["spans"])["secret"] == 2
    assert by[62]["spans"] == by[63]["spans"] == by[64]["spans"] == []
    for r in found:
        assert all(s in r["spans"] for s in r["base_spans"])
    d = {r["doc_id"]: r for r in pii_crf.digest(pii_crf.find(table(spark, texts))).collect()}
    told = pii_crf.listing(pii_crf.base_spans(texts[61]))
    assert d[61]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert d[61]["n_phone"] == 1
    assert pii_crf.find(awkward(spark)).count() == 13
    assert pii_crf.find(empty(spark)).count() == 0


# -- decontamination


ITEMS = ["what is the name of the tall grey river beyond the hills it is called morwen", "name two herbs that grow by the old mill near the sea rosemary and thyme", "what is the name of the tall grey river beyond the hills it is called lindow"]


def bm25_by_hand(items, passage):
    docs = [decontamination.words_of(t) for t in items]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w in set(passage) if w in tf))
    return out


def test_wand_finds_all_above_their_thresholds():
    items = [" ".join(f"t{(i * 7 + j * j) % 40}" for j in range(12)) for i in range(30)]
    index = decontamination.build(list(enumerate(items)), 0.4)
    import numpy as np

    for k in range(30):
        passage = [f"t{(k * 5 + j * 3) % 40}" for j in range(18)]
        want = bm25_by_hand(items, passage)
        query = np.unique([index.terms[w] for w in passage if w in index.terms])
        got = {index.item_ids[i]: s for b in range(index.n_blocks) for i, s in decontamination.wand(index, query, b)}
        assert got == {index.item_ids[i]: s for _, b in decontamination.blocks_for(index, query, np.array([0]), np.array([len(query)])) for i, s in decontamination.wand(index, query, b)}
        limit = {index.item_ids[i]: t for i, t in enumerate(index.thresholds)}
        assert set(got) == {i for i in range(30) if want[i] >= limit[i] - 1e-9}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def leaks_by_hand(items, text, share, gram, enough):
    """Every item scored on every window by the formula, then verified on its words."""
    docs = [decontamination.words_of(t) for t in items]
    words, longest = decontamination.words_of(text), max(map(len, docs))
    full = [bm25_by_hand(items, d)[k] for k, d in enumerate(docs)]
    best = {}
    for at in range(0, max(1, len(words) - 2 * longest + longest), longest):
        passage = words[at : at + 2 * longest]
        for k, score in enumerate(bm25_by_hand(items, passage)):
            if score >= share * full[k] - 1e-9 and decontamination.verified(docs[k], passage, gram, enough) and (k not in best or score > best[k][1] + 1e-9):
                best[k] = (at, score)
    return {k: (at, round(s, 6)) for k, (at, s) in best.items()}


def test_search_by_hand():
    words = [f"v{i * i % 53}" for i in range(300)]
    items = [" ".join(words[3 * i : 3 * i + 9 + i % 7]) for i in range(40)]
    index = decontamination.build(list(enumerate(items)), 0.5)
    for k in range(25):
        text = " ".join(words[k * 5 : k * 5 + 10 + 3 * k] + [f"other{j}" for j in range(k)] + items[k].split()[::-1] + items[39 - k].split())
        got = decontamination.search(index, text, 2 * index.longest, index.longest, 2, 0.6)
        assert {index.item_ids[i]: (at, round(s, 6)) for i, at, s in got} == leaks_by_hand(items, text, 0.5, 2, 0.6)
    assert decontamination.search(index, "", 10, 5, 2, 0.6) == []


def test_leaks_are_found_and_clean_documents_kept(spark):
    filler = " ".join(f"plain{i} words of the story" for i in range(80))
    texts = [filler, f"{filler} {ITEMS[0].upper()}! {filler}", f"{filler} {ITEMS[1]} {filler} {ITEMS[2]}", "what is the name of the river", None, "", f"{ITEMS[1][:40]} {filler}"]
    bench = spark.createDataFrame([*enumerate(ITEMS), (9, None), (10, "")], "item_id long, text string")
    docs = table(spark, texts)
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(clashing(docs, "score"), bench).collect()}
    assert found == {(1, 0), (2, 1), (2, 2)}
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == {0, 3, 4, 5, 6}
    whole = sorted(map(tuple, decontamination.contaminated(docs, bench, share=0.4).collect()))
    assert sorted(map(tuple, decontamination.contaminated(docs, bench, max_index_bytes=60, share=0.4).collect())) == whole
    assert {x[:2] for x in whole} == found
    assert {r["doc_id"] for r in decontamination.clean(clashing(docs, "item_id", "_id", "_tk", "score"), bench).collect()} == {0, 3, 4, 5, 6}
    assert decontamination.contaminated(empty(spark), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.clean(awkward(spark), bench).count() == 13


# -- near-duplicates


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes_by_hand(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if root(j) == root(k) and sets[j][0] is not None]
        c = (min(ids) if ids else None) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def variants(n):
    base = [f"word{i * i % 701}" for i in range(140)]
    out = []
    for k in range(n):
        words = list(base)
        for j in range(k % 4):
            words[(k * 37 + j * 29) % 140] = f"edit{k}x{j}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_classes_by_hand(spark, bound):
    other = [" ".join(f"z{(i * k) % 97}" for i in range(40)) for k in range(3, 9)]
    df = table(spark, [*variants(40), *other, other[0], other[1] + " tail", "A b", "a B", "a b c d e", "A B C D E"]).unionByName(awkward(spark).withColumn("doc_id", F.col("doc_id") + 500))
    found = minhash.near_duplicates(clashing(df, "kept", "n"), max_broadcast=bound).collect()
    assert sorted(map(tuple, found), key=repr) == classes_by_hand([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("percent", [80, 85])
def test_bands_find_pairs_at_the_threshold(percent):
    """Recall of the candidate search against all pairs: sets of many sizes that are just alike enough."""
    rng = np.random.default_rng(percent)
    bands, missed, pairs = minhash.bands_for(percent), 0, 0
    for size in [7, 9, 12, 20, 40, 80, 150, 300] * 60:
        pool = rng.integers(0, 2**64, 2 * size, dtype=np.uint64)
        for common in range(size, 0, -1):  # the fewest common shingles that link two sets of this size
            if 100 * (common - 1) < percent * (2 * size - common + 1):
                break
        a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:common], pool[size : 2 * size - common]]))
        assert 100 * common >= percent * (2 * size - common)
        pairs += 1
        missed += not (minhash.band_keys(a, bands) == minhash.band_keys(b, bands)).any()
    assert missed <= 0.01 * pairs


def test_no_documents(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.near_duplicates(table(spark, [None, ""])).filter("kept").count() == 2


def test_components_of_chains_and_stars(spark):
    edges = [(b"a%03d" % i, b"a%03d" % (i + 1)) for i in range(40)] + [(b"s000", b"s%03d" % i) for i in range(1, 20)] + [(b"x", b"y")]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in minhash.components(df).collect()}
    assert {v for k, v in roots.items() if k.startswith(b"a")} == {b"a000"}
    assert {v for k, v in roots.items() if k.startswith(b"s")} == {b"s000"}
    assert roots[b"y"] == b"x"


# -- language model


def model_by_hand(train):
    start, end = b"\0s", b"\0e"
    toks = [[*(t or "").encode().lower().split(), end] for t in train]
    c1 = Counter(w for t in toks for w in t)
    c2 = Counter(p for t in toks for p in zip([start, *t[:-1]], t, strict=True))
    n, d1, d2 = sum(c1.values()), katz.discounts(Counter(c1.values())), katz.discounts(Counter(c2.values()))
    disc = lambda c, d: 1.0 if c > katz.LARGE else d[c]
    mass = sum(disc(c, d1) * c for c in c1.values()) / max(n, 1)
    scale = n / (n + 1) if n and mass > 1 - 1e-12 else 1.0
    p1 = {w: scale * disc(c, d1) * c / n for w, c in c1.items()}
    unknown = 1 - mass * scale if n else 1.0
    ch, kept, low, types = Counter(), defaultdict(float), defaultdict(float), Counter()
    for (h, w), c in c2.items():
        ch[h] += c
        kept[h] += disc(c, d2) * c
        low[h] += p1[w]
        types[h] += 1
    half = {h: kept[h] > ch[h] * (1 - 1e-9) for h in ch}
    alpha = {h: (0.5 * types[h] / ch[h] if half[h] else 1 - kept[h] / ch[h]) / max(1 - low[h], unknown) for h in ch}

    def p(h, w):
        if c := c2.get((h, w), 0):
            return (c - 0.5 if half[h] else disc(c, d2) * c) / ch[h]
        return alpha.get(h, 1.0) * p1.get(w, unknown)

    def score(text):
        t = [*(text or "").encode().lower().split(), end]
        base = sum(math.log10((c1[w] + 1) / (n + len(c1) + 1)) for w in t)
        return len(t), sum(w in c1 for w in t), n, base, sum(math.log10(p(h, w)) for h, w in zip([start, *t[:-1]], t, strict=True))

    return score, p, [*p1, b"\0never"], list(ch)


@pytest.mark.parametrize("head", [(1 << 19, 1 << 20), (30, 20), (0, 0)])
def test_katz_by_hand(spark, monkeypatch, head):
    monkeypatch.setattr(katz, "HEAD_WORDS", head[0])
    monkeypatch.setattr(katz, "HEAD_PAIRS", head[1])
    monkeypatch.setattr(katz, "GATHER", 200)
    texts = [" ".join(f"W{(i * i + k) % (5 + k % 7)}" for i in range(30 + k)) for k in range(40)]
    df = table(spark, texts).unionByName(awkward(spark).withColumn("doc_id", F.col("doc_id") + 100))
    train = df.filter("doc_id % 7 <> 2")
    score, p, words, histories = model_by_hand([r["text"] for r in train.collect()])
    for h in histories[:6]:
        assert abs(sum(p(h, w) for w in words) - 1) < 1e-9
    found = katz.score(clashing(df, "score"), katz.fit(train)).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = sorted(((r["doc_id"], *score(r["text"])) for r in df.collect()), key=repr)
    got = sorted(map(tuple, found), key=repr)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [y for x in got for y in x[4:]] == pytest.approx([y for x in want for y in x[4:]], rel=1e-6, abs=1e-6)


def test_katz_without_rows(spark):
    assert katz.score(empty(spark), katz.fit(empty(spark))).count() == 0
    r = katz.score(table(spark, ["a b"]), katz.fit(empty(spark))).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0)


def test_a_task_of_katz_holds_little_for_a_token(spark, monkeypatch):
    """Peak bytes while the blocks of documents are made, in a stretch of as many tokens as are gathered for counts."""
    monkeypatch.setattr(katz, "GATHER", 400_000)
    monkeypatch.setattr(katz.C, "in_arrow", lambda df, run, schema: run)
    words = np.sort(katz.tokens(" ".join(f"w{i}" for i in range(500))))
    ones = np.ones(len(words))
    head = types.SimpleNamespace(value=((words, ones, -ones, -ones), [np.sort(katz.pair_hash(words[:-1], words[1:])), ones[1:]]))
    run = katz._gathered(empty(spark), types.SimpleNamespace(n=10**6, v=10**4), head, 4)
    texts = (" ".join(f"w{(k * 7919 + i * i) % 5003}" for i in range(4000)) for k in range(100))
    batches = (pa.RecordBatch.from_pydict({"rk": [k], "doc_id": [k], "text": [t]}) for k, t in enumerate(texts))
    tracemalloc.start()
    try:
        kinds = Counter(x for block in run(batches) for x in block.column("kind").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 * katz.GATHER
    assert kinds[2] > 1 and kinds[0] == 4 * kinds[2]
