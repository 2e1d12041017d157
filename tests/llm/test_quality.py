import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodegraph.llm import license_scan, quality_cnn, quality_rules

from .helpers import WORD, awkward, clashing, empty, table


def counts_by_hand(text):
    words = WORD.findall(text or "")
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_by_hand(spark):
    more = ["a b c d e f a b c d e g a b c d e", "x x x x x x x x", "l1\nl1\n \n \nl2", "#*$ <a> | &", "a b c d e a b c d e a b c d e z"]
    df = awkward(spark).unionByName(table(spark, more, range(200, 205)))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    found = quality_rules.judge(clashing(df, "n_words", "kept"), labels).collect()
    texts = Counter((r["doc_id"], *counts_by_hand(r["text"])) for r in df.collect())
    assert Counter((r["doc_id"], *[r[c] for c in quality_rules.COUNTS]) for r in found) == texts
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])  # two labels prove nothing


def test_binomial_bound(spark):
    cases = [(0, 300, 0.01), (3, 1000, 0.01), (1, 50, 0.1), (5, 20, 0.1), (0, 1, 0.5)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for (k, n, p), r in zip(cases, [df.filter((F.col("k") == k) & (F.col("n") == n)).select(quality_rules.binomial_cdf(F.col("k"), F.col("n"), p).alias("x")).collect()[0] for k, n, p in cases], strict=True):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(r["x"] - (exact if k <= n * p else 1.0)) < 1e-9


def test_cutoffs_keep_their_promise(spark):
    words = " ".join(f"word{i}" for i in range(30))
    good = [f"{words} {k}" for k in range(2000)]
    junk = [f"{words} ### $$$ &&& ### $$$ &&& ### {k}" for k in range(50)]
    df = table(spark, good + junk).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, int(i < 2000)) for i in range(2050)], "doc_id long, quality int")
    found = quality_rules.judge(df, labels).collect()
    assert all(r["kept"] for r in found if r["doc_id"] < 2000)
    assert not any(r["kept"] for r in found if r["doc_id"] >= 2000)
    few = quality_rules.cutoffs(quality_rules.measured(df, ["doc_id", "lang"]), labels.filter("doc_id < 100"), "lang", 0.06, 0.05)
    assert few.count() == 0
    # a cutoff that would reject more of the good than alpha allows is not used
    half = labels.withColumn("quality", F.lit(1))
    rules = {r["rule"]: r["cutoff"] for r in quality_rules.cutoffs(quality_rules.measured(df, ["doc_id", "lang"]), half, "lang", 0.06, 0.05).collect()}
    assert rules["symbols"] == 150


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(empty(spark), labels).count() == 0
    assert quality_cnn.score(empty(spark), labels).count() == 0
    assert license_scan.scan(empty(spark)).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(1)
    net = quality_cnn.Network.initial(rng)
    texts = [bytes(rng.integers(97, 122, n, dtype=np.uint8)) for n in (10, 400, 700)]
    y, w = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)

    def loss():
        p = quality_cnn.forward(net, texts)
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    grads = quality_cnn._gradients(net, texts, y, w)
    for p, g in zip(net.trained(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = p[at], 3e-4
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("aeiounrst"), 5))
    good = [" ".join(word() for _ in range(60)) for _ in range(200)]
    junk = [" ".join(word() + "###" for _ in range(60)) for _ in range(100)] + [" ".join([word()] * 60) for _ in range(100)]
    df = table(spark, good + junk)
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "doc_id long, quality int")
    found = quality_cnn.score(clashing(df, "score"), labels, max_train_rows=300).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r["predicted"] == int(r["doc_id"] < 200) for r in held]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)


def test_convolution_by_hand():
    """Each text's probability from plain loops over its own bytes."""
    rng = np.random.default_rng(4)
    net = quality_cnn.Network.initial(rng)
    texts = [bytes(rng.integers(32, 123, n, dtype=np.uint8)) for n in (0, 1, 5, 122, 123, 124, 128, 250, 251, 252, 256, 400, 1000)]
    half, width = quality_cnn.HALF, quality_cnn.WIDTH
    for text, p in zip(texts, quality_cnn.forward(net, texts), strict=True):
        n_half = max(2, math.ceil((len(text) + width - 1) / half))
        data = list(text) + [0] * (n_half * half - len(text))
        response = [[sum(net.taps[j][data[i + j]][f] for j in range(width)) + net.bias[f] for f in range(quality_cnn.FILTERS)] for i in range(len(data) - width + 1)]
        hidden = []
        for c in range(n_half - 1):
            chunk = response[c * half : (c + 2) * half]
            x = np.maximum(np.max(chunk, axis=0), 0)
            hidden.append(np.maximum(x @ net.dense + net.dense_bias, 0))
        logit = np.concatenate([np.max(hidden, axis=0), np.mean(hidden, axis=0)]) @ net.out + net.out_bias[0]
        assert abs(p - 1 / (1 + math.exp(-logit))) < 1e-5


def test_scores_depend_on_the_text_alone():
    rng = np.random.default_rng(5)
    net = quality_cnn.Network.initial(rng)
    texts = [bytes(rng.integers(32, 123, n, dtype=np.uint8)) for n in (0, 1, 123, 124, 251, 252, 256, 300, 5000, 700_000, 128, 129)]
    alone = np.concatenate([quality_cnn.forward(net, [t]) for t in texts])
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1), rng.permutation(len(texts))):
        assert (quality_cnn.forward(net, [texts[i] for i in order]) == alone[list(order)]).all()


def test_training_sample_is_bounded(spark):
    df = table(spark, [f"text {i} " * 10 for i in range(60)] + ["x" * 100_000, "hot a", "hot b", "hot b"], [*range(60), 60, 7, 7, 7])
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, quality int")
    texts, marks = quality_cnn.training_sample(df, labels, 40)
    assert len(texts) == len(marks) <= 40 and 0 < sum(marks) < len(marks)
    texts, _ = quality_cnn.training_sample(df, labels, 60, 2000)
    assert 0 < sum(map(len, texts)) <= 2000


def test_classifier_takes_any_row(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, 7)], "doc_id long, quality int")
    assert quality_cnn.score(awkward(spark), labels, max_train_rows=10).count() == 13


def test_licences(spark):
    texts = ["Some text.\nReleased under the MIT License.\nmore", "licensed under the apache license, version 2.0.", "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.",
             "His driving license was lost under the table.", "The general public may use this.", None, "", "Released under the MIT License.\n" * 3]
    found = {r["doc_id"]: r for r in license_scan.scan(clashing(table(spark, texts), "families")).collect()}
    assert [found[i]["families"] for i in range(8)] == [["mit"], ["apache-2.0"], ["cc-by-nc", "gpl"], [], [], [], [], ["mit"]]
    assert [found[i]["n_licence"] for i in (0, 2, 7)] == [1, 2, 3]
    assert found[5]["n_paragraphs"] == 0
    assert license_scan.scan(awkward(spark)).count() == 13


def test_notices_wrapped_over_lines_are_seen_whole(spark):
    model = license_scan.train([f"line {k} of an ordinary text about the sea and the hills {k * k}" for k in range(80)])
    notice = license_scan.TEMPLATES["gpl"][1].split()
    wrapped = "\n".join(" ".join(notice[i : i + 4]) for i in range(0, len(notice), 4))
    texts = [f"Some text.\n{wrapped}\nAnd more of it.", "Released under the MIT License.\nLicensed under CC BY 4.0.", "Licensed under the Zlib License.", "A word.\n\nof it"]
    found = {r["doc_id"]: r for r in license_scan.scan(table(spark, texts), model).collect()}
    assert found[0]["families"] == ["gpl"]
    assert (found[1]["families"], found[1]["n_licence"]) == (["cc-by", "mit"], 2)
    assert (found[2]["n_licence"], found[2]["n_unknown"]) == (0, 1)
    assert (found[3]["n_paragraphs"], found[3]["n_licence"], found[3]["n_unknown"]) == (2, 0, 0)


def scan_by_hand(model, text, confirm=0.6):
    """The scan's rules on plain strings."""
    own = license_scan._grams_by_family()

    def judged(words):
        grams = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}  # noqa: B905
        p = license_scan._probabilities(model.weights, model.bias, grams)
        best = max((p[k], len(grams & own[k]) / len(grams), f) for k, f in enumerate(license_scan.FAMILIES))
        return best[2] if best[0] >= model.cutoff and best[1] >= confirm else "unknown" if 1 - p[-1] >= model.known else None

    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    words = [[w for w in "".join(c if c.isalnum() else " " for c in x.lower()).split()] for x in lines]
    runs, out = [[]], []
    for w in words:
        if set(w) & set(model.anchors):
            runs[-1].append(w)
        elif runs[-1]:
            runs.append([])
    for run in runs:
        found = [judged(w) for w in run]
        if len(run) > 1 and not set(found) - {None, "unknown"} and (whole := judged([x for w in run for x in w])) not in (None, "unknown"):
            found = [whole]
        out += [x for x in found if x]
    sure = [x for x in out if x != "unknown"]
    return len(lines), len(sure), len(out) - len(sure), sorted(set(sure))


def test_scan_by_hand(spark):
    model = license_scan.train(["an ordinary line of text", "one more line"])
    rng = np.random.default_rng(6)
    pool = [t for ts in license_scan.TEMPLATES.values() for t in ts] + license_scan.ORDINARY + ["of the text", "Licensed under the Sun License, version 4.", "", "2.0", "subject to the terms"]
    texts = []
    for _ in range(120):
        words = " \n".join(pool[i] for i in rng.integers(0, len(pool), 3)).split(" ")
        texts.append(" ".join(w + ("\n" if rng.random() < 0.06 else "") for w in words if rng.random() > 0.1))
    found = {r["doc_id"]: r for r in license_scan.scan(table(spark, texts), model).collect()}
    for k, text in enumerate(texts):
        r = found[k]
        assert (r["n_paragraphs"], r["n_licence"], r["n_unknown"], r["families"]) == scan_by_hand(model, text)


def test_a_source_is_in_one_fold_whole(monkeypatch):
    """What calibrates a fit is unknown to it: neither the text nor a variant of it is among its sources."""
    seen = []
    real = license_scan.fit
    monkeypatch.setattr(license_scan, "fit", lambda sources, *args: (seen.append(list(sources)), real(sources, *args))[1])
    license_scan.train(["the same line"] * 20 + ["another line"])
    every = seen[-1]
    assert sum(len(x.rows) == 1 and x.label == license_scan.NONE for x in every) == 2
    for part in seen[:4]:
        held = [x for x in every if not any(x is y for y in part)]
        assert held and all(x is not y for x in held for y in part)
    assert sum(len(every) - len(part) for part in seen[:4]) == len(every)
    for k, part in enumerate(seen[4:-1]):
        assert not any(x.label == k for x in part)


def test_anchors_lose_no_paragraph(spark):
    model = license_scan.train([])
    of = lambda text: license_scan.grams_of(text)
    rest = [" ".join(w for w in t.lower().split() if w.strip(".,") not in model.anchors) for ts in license_scan.TEMPLATES.values() for t in ts]
    for t in rest:
        grams = {g for g in of(t) if not set(g.split()) & set(model.anchors)}
        z = [model.bias[k] + sum(model.weights.get(g, [0] * 9)[k] for g in grams) for k in range(9)]
        e = [math.exp(x) for x in z]
        assert 1 - e[8] / sum(e) < model.cutoff
