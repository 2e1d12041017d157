"""Repetitions of one clear mention in long documents."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import pii_crf

from .helpers import table

TRAIN = [f'words token = "{hashlib.sha1(str(k).encode()).hexdigest()}" and +1 (790) 555-{k:04d} or 12 apples' for k in range(60)]


def plain_field():
    """A field in which repetitions alone speak, as much as a field can learn."""
    return pii_crf.Field(np.zeros((pii_crf.N_FEATURES, 6)), np.stack([np.zeros((6, 6)), *pii_crf.skip_tables(4.0)]))


@pytest.mark.parametrize("gap", [f" {'filler ' * 20}", " "])
def test_a_clear_mention_settles_fifty_repetitions(spark, gap):
    clear = f"call +49 170 1234567 {'filler ' * 20}"
    text = clear + gap.join(["01701234567"] * 50)
    found = pii_crf.find(table(spark, [text, "01701234567 " * 50]), field=plain_field()).collect()
    by = {r["doc_id"]: r for r in found}
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in by[0]["spans"]] == [("phone", "+49 170 1234567")] + [("phone", "01701234567")] * 50
    assert by[1]["spans"] == []


def test_messages_run_until_they_stop():
    """Each edge of a chain of 60 open nodes passes the clear label on: the exact marginals of the chain are reached."""
    field = pii_crf.Field(np.zeros((pii_crf.N_FEATURES, 6)), np.stack([np.eye(6) * 6.0] * 3))
    nodes = [pii_crf.Node(9 * k, 9 * k + 2, f"a{k}", 4 if k == 0 else -1, "") for k in range(61)]
    every, edges = pii_crf.linked(nodes)
    p = pii_crf.marginals(field, every, np.array(edges), np.zeros(len(every), int))
    t = np.exp(field.edges[0]) / np.exp(field.edges[0]).sum(1)
    assert p[60] == pytest.approx(np.linalg.matrix_power(t, 60)[4], abs=1e-4)


def test_an_open_hub_is_an_edge_between_two_nodes():
    edges = pii_crf.train(TRAIN).edges
    over, direct = np.exp(edges[2]) @ np.exp(edges[2]), np.exp(edges[1])
    assert over / over[0, 1] == pytest.approx(direct / direct[0, 1])


def test_what_lies_beside_a_document_changes_nothing():
    field = pii_crf.train(TRAIN)
    texts = [f"{TRAIN[0]} 12 apples 17905550000 then 12", 'key = "0a1b2c3d4e5f60718293" ' + "x1 0a1b2c3d4e5f60718293 " * 30]
    docs = [pii_crf.linked(pii_crf.nodes_of(t, pii_crf.base_spans(t))) for t in texts]
    alone = [pii_crf.marginals(field, n, np.array(e), np.zeros(len(n), int)) for n, e in docs]
    k = len(docs[0][0])
    both = pii_crf.marginals(field, docs[0][0] + docs[1][0], np.array([*docs[0][1], *((i + k, j + k, x) for i, j, x in docs[1][1])]), np.array([0] * k + [1] * len(docs[1][0])))
    assert np.array_equal(both, np.concatenate(alone))


def test_marginals_by_enumeration():
    """Message passing is exact where the edges make no circle."""
    rng = np.random.default_rng(2)
    field = pii_crf.Field(rng.normal(0, 1, (pii_crf.N_FEATURES, 6)), np.stack([(x := rng.normal(0, 1, (6, 6))) + x.T, *pii_crf.skip_tables(1.5)]))
    nodes = [pii_crf.Node(100 * k, 100 * k + 5, t, label, "") for k, (t, label) in enumerate([("x12 7", -1), ("555 1234567", 4), ("01234567 9", -1), ("n9", -1)])]
    nodes += [pii_crf.Node(0, 0, "", -1, "")]
    edges = [(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 4, 2), (4, 3, 2)][:4]
    p = pii_crf.marginals(field, nodes, np.array(edges), np.zeros(5, int))
    want = np.zeros((5, 6))
    for ys in itertools.product(range(6), repeat=5):
        if ys[1] != 4:
            continue
        total = sum(field.weights[pii_crf.features(n)].sum(0)[y] for n, y in zip(nodes, ys, strict=True) if n.label < 0)
        total += sum(field.edges[k][ys[i], ys[j]] for i, j, k in edges)
        want[np.arange(5), ys] += np.exp(total)
    assert p == pytest.approx(want / want.sum(1, keepdims=True), abs=1e-3)


def test_a_similar_token_is_learned_to_agree(spark):
    """Numbers written without the marks of a phone number are settled by a clear mention, and only by it."""
    train = [f"call +49 170 55{k:05d} or 017055{k:05d}, order 9{k:010d} of 3 apples" for k in range(100)]
    field = pii_crf.train(train)
    text = f"call +49 170 1234567 {'filler ' * 20}" + f" {'filler ' * 20}".join(["01701234567"] * 40) + f" {'filler ' * 20} 98765432101"
    found = pii_crf.find(table(spark, [text, "paid 01701234567 for 98765432101"]), field=field).collect()
    by = {r["doc_id"]: [text[s["start"] : s["end"]] for s in r["spans"]] if r["doc_id"] == 0 else r["spans"] for r in found}
    assert by[0] == ["+49 170 1234567"] + ["01701234567"] * 40
    assert by[1] == []


def test_gradient_of_the_agreement():
    for w in (0.2, 1.0, 4.0):
        v, slope = pii_crf._open_weight(w)
        up, down = pii_crf._open_weight(w + 1e-5)[0], pii_crf._open_weight(w - 1e-5)[0]
        assert slope == pytest.approx((up - down) / 2e-5, rel=1e-4)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_hand(text):
    only = lambda x: [int(c) for c in x if c in "0123456789"]
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = only(m.group())
        check = sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and check % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(only(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


@given(st.text(st.sampled_from("0123459.. +-()@a_é\n"), max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_patterns_by_hand(text):
    assert pii_crf.base_spans(text) == base_by_hand(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1111 x 4111111111111112", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255", "+49 (170) 123-4567. +1 2", "a@b.c@d.e-f.g a@b"])
def test_base_patterns_on_typical_texts(text):
    assert pii_crf.base_spans(text) == base_by_hand(text)


def test_long_parts_and_long_runs():
    assert pii_crf.base_spans("1.1.1." + "0" * 5000 + "1") == [(1, 0, 5007)]
    begin = time.perf_counter()
    for text in ("1" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1" + "(" * 1_000_000, "1 " * 50_000, "x1" * 500_000):
        pii_crf.labels_of(plain_field(), [text], 0.9)
    assert time.perf_counter() - begin < 60
