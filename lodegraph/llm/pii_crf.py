"""Personal data by rules and a skip-chain conditional random field.

Base spans come from exact patterns.  The field then labels what the patterns leave: its
nodes are a document's base spans (whose labels are evidence) and every other word with
a digit or ``@``.  Node potentials are linear in hashed shape and context features; a chain
edge joins nodes that stand close together, and *skip* edges join all nodes whose
text repeats or whose digits end alike, however far apart they are, to one hub.  Both edges
carry a learned table of label agreement.  Loopy sum-product message passing over the whole
document, until no message changes, makes marginals, so that one clear mention settles its repetitions.  Nodes whose
marginal for an entity label reaches ``certainty`` become added spans.

All weights, those of the edges included, are learned together by the pseudo-likelihood of a bounded sample's labels:
base spans, assignments of long keys, and what repeats one of these, however it is written.
Repetitions are linked as a star, so edges are linear in the nodes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Kinds in the order of the listing; the last is found by the field alone.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("other", *KINDS)
N_FEATURES = 512
#: Log potential of the labels that a clear mention does not have: no number of repetitions outvotes it.
CLEAR = -1e8
#: Characters of texts whose messages are passed at once.
STRETCH = 1 << 20
#: What agreement of repetitions weighs before any text says otherwise.
AGREE = 4.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive and not begun inside a run of digits, which changes no match but reads a long run once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+")
_WORD_END = re.compile(r"[\x20\x09-\x0D]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_KEY = re.compile(r"(?i)(?:token|key|secret|password|passwd)[\"']?[\x20\t]*[:=][\x20\t]*[\"']?([0-9A-Za-z+/_=-]{20,})")
_EDGES = "\"'`.,;:!?()[]{}<>#$%&*|="

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for place, x in enumerate(reversed(digits)):
        v = int(x) * (1 + place % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((0, start, done))
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[Span]:
    """What the exact patterns find, by start and then kind."""
    found = emails(text) if "@" in text else []
    if _MARK.search(text):
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


@dataclass
class Node:
    start: int
    end: int
    text: str
    label: int  # of a base span, as an index of LABELS; -1 if open
    before: str


def nodes_of(text: str, spans: list[Span]) -> list[Node]:
    """Base spans and the words with a digit or ``@`` that no base span touches, in order."""

    def context(start: int) -> str:
        return text[max(0, start - 24) : start].lower()

    out = [Node(s, e, text[s:e], kind + 1, context(s)) for kind, s, e in spans]
    cover = sorted((s, e) for _, s, e in spans)
    k, done, reach = 0, 0, -1
    for mark in _MARK.finditer(text):
        if mark.start() < done:
            continue
        start = mark.start()
        while start > done and text[start - 1] not in C.WHITE:
            start -= 1
        end = _WORD_END.search(text, mark.end())
        done = end.start() if end else len(text)
        raw = text[start:done]
        left = len(raw) - len(raw.lstrip(_EDGES))
        word = raw.strip(_EDGES)
        s, e = start + left, start + left + len(word)
        while k < len(cover) and cover[k][0] < done:
            reach = max(reach, cover[k][1])
            k += 1
        if word and reach <= start:
            out.append(Node(s, e, word, -1, context(s)))
    return sorted(out, key=lambda n: (n.start, n.end))


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % N_FEATURES


def features(node: Node) -> list[int]:
    t = node.text
    digits = _NOT_DIGIT.sub("", t)
    letters = sum(c.isalpha() for c in t)
    shape = re.sub(r"x{2,}", "x+", re.sub(r"d{2,}", "d+", re.sub(r"[^\W\d_]", "x", re.sub(r"[0-9]", "d", t))))
    words = re.findall(r"[^\W_]+|[=:]", node.before)[-2:]
    if not t:
        return []
    names = ["bias", "shape " + shape, f"digits {min(len(digits), 20)}", f"length {min(len(t) // 4, 12)}", f"@ {t.count('@')}", f"dots {min(t.count('.'), 4)}", f"plus {t[:1] == '+'}", f"paren {'(' in t}"]
    names += ["hex" if len(t) >= 20 and re.fullmatch(r"[0-9a-fA-F]+", t) else "", "luhn" if 12 <= len(digits) <= 19 and letters == 0 and luhn(digits) else "", f"letters {min(letters // 4, 6)}"]
    names += ["before " + w for w in words if len(words) < 2 or w in "=:" or w in ("token", "key", "secret", "password", "passwd", "mail", "tel", "phone", "card", "call")]
    return [_bucket(n) for n in names if n]


def chain_of(nodes: list[Node], near: int = 40) -> list[tuple[int, int]]:
    return [(j - 1, j) for j in range(1, len(nodes)) if nodes[j].start - nodes[j - 1].end <= near]


def groups_of(nodes: list[Node]) -> list[list[int]]:
    """Nodes that repeat each other: the last seven digits are equal, or the text of those with fewer digits."""
    by: dict[tuple[str, str], list[int]] = {}
    for j, node in enumerate(nodes):
        digits = _NOT_DIGIT.sub("", node.text)
        by.setdefault(("end", digits[-7:]) if len(digits) >= 7 else ("text", node.text.lower()), []).append(j)
    return [g for g in by.values() if len(g) > 1]


def linked(nodes: list[Node]) -> tuple[list[Node], list[tuple[int, int, int]]]:
    """The nodes with their hubs behind them, and ``(i, j, kind)``: 0 chain, 1 skip to a known hub, 2 skip to an open one.

    A hub has an empty text.  It is known where the group's base spans all have one label: it stands for these
    clear mentions, and open nodes can't outvote them.
    """
    every, out = list(nodes), [(i, j, 0) for i, j in chain_of(nodes)]
    for group in groups_of(nodes):
        told = {nodes[i].label for i in group if nodes[i].label >= 0}
        label = told.pop() if len(told) == 1 else -1
        out += [(i, len(every), 1 if label >= 0 else 2) for i in group if label < 0 or nodes[i].label < 0]
        every.append(Node(0, 0, "", label, ""))
    return every, out


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    edges: np.ndarray  # kind (chain, known hub, open hub) x labels x labels, log potentials


def _open_weight(weight: float) -> tuple[float, float]:
    """What an edge to an open hub weighs, and its derivative: two such edges over a hub make one of ``weight``."""
    n, x = len(LABELS), np.expm1(weight)
    root = np.sqrt(x * x + n * x)
    return float(np.log1p(x + root)), float((1 + (x + n / 2) / root) * np.exp(weight) / (1 + x + root))


def skip_tables(weight: float) -> tuple[np.ndarray, np.ndarray]:
    """To a known hub, and to an open one: two edges over that make the one table between its nodes."""
    one = np.eye(len(LABELS))
    return one * weight, one * _open_weight(weight)[0]


def labelled(text: str) -> tuple[list[Node], list[int]]:
    """Nodes and their labels to learn from: base spans, assigned keys, and what repeats entities of one kind."""
    spans = base_spans(text)
    keys = [m.span(1) for m in _KEY.finditer(text)]
    nodes = nodes_of(text, spans)
    own = [n.label if n.label > 0 else len(KINDS) if any(s <= n.start and n.end <= e for s, e in keys) else 0 for n in nodes]
    for group in groups_of(nodes):
        told = {own[i] for i in group} - {0}
        if len(told) == 1:
            for i in group:
                own[i] = own[i] or min(told)
    return nodes, own


def train(texts: list[str], rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Maximise the pseudo-likelihood: each label's probability given its node's features and the labels it is linked with.

    A member of a group sees the label that the group's base spans have, or else the others' labels over the open hub,
    which is summed out.  Chain potentials stay within half a unit, so that nearness alone settles nothing.
    """
    n_labels, known, chains, groups = len(LABELS), [], [], []
    flat, sizes, labels = [], [], []
    for text in texts:
        nodes, own = labelled(text)
        base = len(labels)
        for node in nodes:
            names = features(node)
            flat += names
            sizes.append(len(names))
        labels += own
        chains += [(i + base, j + base) for i, j in chain_of(nodes)]
        for group in groups_of(nodes):
            told = {nodes[i].label for i in group if nodes[i].label >= 0}
            if len(told) == 1:
                known += [(i + base, min(told)) for i in group if nodes[i].label < 0]
            else:
                groups.append([i + base for i in group if nodes[i].label < 0 or not told])
    weights, chain, agree = np.zeros((N_FEATURES, n_labels)), np.zeros((n_labels, n_labels)), np.full(1, AGREE)
    if labels:
        y, flat, n = np.array(labels), np.array(flat, np.int64), len(labels)
        row = np.repeat(np.arange(n), sizes)
        one = np.eye(n_labels)
        ends = np.array(chains, np.int64).reshape(-1, 2)
        beside = np.zeros((n, n_labels))  # how many chain neighbours have each label
        np.add.at(beside, ends[:, 0], one[y[ends[:, 1]]])
        np.add.at(beside, ends[:, 1], one[y[ends[:, 0]]])
        told = np.array(known, np.int64).reshape(-1, 2)
        member = np.array([i for g in groups for i in g], np.int64)
        others = np.concatenate([np.broadcast_to(one[y[g]].sum(0), (len(g), n_labels)) - one[y[g]] for g in groups if g] or [np.zeros((0, n_labels))])
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, chain, agree)]
        for t in range(1, rounds + 1):
            z = beside @ chain
            for k in range(n_labels):
                z[:, k] += np.bincount(row, weights[flat, k], n)
            np.add.at(z, (told[:, 0], told[:, 1]), agree[0])
            v, slope = _open_weight(agree[0])
            hub = v * (others[:, None, :] + one)  # a member's label, the hub's label
            z[member] += np.logaddexp.reduce(hub, 2)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            gap = one[y] - p
            by_hub = ((others[:, None, :] + one) * np.exp(hub - np.logaddexp.reduce(hub, 2)[:, :, None])).sum(2)
            grads = [
                np.stack([np.bincount(flat, gap[row, k], N_FEATURES) for k in range(n_labels)], 1),
                beside.T @ gap,
                np.array([gap[told[:, 0], told[:, 1]].sum() + slope * (gap[member] * by_hub).sum()]),
            ]
            grads[1] = (grads[1] + grads[1].T) / 2
            for param, grad, prior, (first, second) in zip((weights, chain, agree), grads, (0, 0, AGREE), state, strict=True):
                grad = grad / n - decay * (param - prior)
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                param += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            np.clip(chain, -0.5, 0.5, out=chain)
            np.clip(agree, 0.1, 8, out=agree)
    return Field(weights, np.stack([chain, *skip_tables(agree[0])]))


def marginals(field: Field, nodes: list[Node], edges: np.ndarray, owner: np.ndarray, tolerance: float = 1e-5) -> np.ndarray:
    """Loopy belief propagation over any number of documents at once; ``edges``: rows ``(i, j, kind)``, ``owner``: each node's document.

    A document is swept until none of its messages changes by more than ``tolerance``, whatever lies beside it.
    Where messages swing, the step is cut by a tenth after each hundred sweeps, so that they settle.
    """
    n, n_labels = len(nodes), len(LABELS)
    score = np.zeros((n, n_labels))
    for i, node in enumerate(nodes):
        if node.label >= 0:
            score[i] = CLEAR
            score[i, node.label] = 0.0
        else:
            score[i] = field.weights[features(node)].sum(0)
    if len(edges):
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        kind = np.concatenate([edges[:, 2], edges[:, 2]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(source), n_labels))
        live, doc, sweep = np.arange(len(source)), owner[source], 0
        while len(live):
            step = 0.7 * 0.9 ** (sweep // 100)
            belief = score.copy()
            np.add.at(belief, target[live], messages[live])
            out = (belief[source[live]] - messages[back[live]])[:, :, None] + field.edges[kind[live]]
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            change = step * (new - messages[live])
            messages[live] += change
            moved = np.unique(doc[live][np.abs(change).max(1) > tolerance])
            live, sweep = live[np.isin(doc[live], moved)], sweep + 1
        np.add.at(score, target, messages)
    score -= score.max(1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(1, keepdims=True)


def listing(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def labels_of(field: Field, texts: list[str | None], certainty: float) -> tuple[list[list[Span]], list[list[Span]]]:
    """The base spans of each text, and these with the spans that the field adds."""
    base, nodes, edges, owner = [], [], [], []
    for row, text in enumerate(texts):
        if not text or not _MARK.search(text):
            base.append([])
            continue
        spans = base_spans(text)
        own = nodes_of(text, spans)
        base.append(spans)
        if any(n.label < 0 for n in own):
            own, links = linked(own)
            edges += [(i + len(nodes), j + len(nodes), k) for i, j, k in links]
            nodes += own
            owner += [row] * len(own)
    every = [list(s) for s in base]
    if nodes:
        p = marginals(field, nodes, np.array(edges, np.int64).reshape(-1, 3), np.array(owner))
        best = p.argmax(1)
        for i in np.flatnonzero((best > 0) & (p.max(1) >= certainty)).tolist():
            if nodes[i].label < 0 and nodes[i].text:
                every[owner[i]].append((int(best[i]) - 1, nodes[i].start, nodes[i].end))
    return base, every


def find(docs: DataFrame, max_train_rows: int = 5000, certainty: float = 0.9, field: Field | None = None, max_train_bytes: int = 64 << 20) -> DataFrame:
    """``(doc_id, base_spans, spans)`` for every row of ``docs``; spans are arrays of ``(kind, start, end)`` in code points.

    ``spans`` holds the base spans and those the field adds.  A null or empty text has none.  Every row
    is a document of its own, repeated ids included; other columns of ``docs`` are not read.  A very long text is one
    field, held in memory whole; patterns and messages take time in proportion to its length.  A node whose two best
    labels are equally likely reaches no ``certainty`` above a half and is not added.
    The field is learned on those of ``max_train_rows`` rows, chosen by a hash of the id, that have a digit or ``@``, while
    their texts fit into ``max_train_bytes``.
    """
    if field is None:
        # rows with an equal hash are told apart by their texts, so that the choice doesn't depend on the partitions
        keys = docs.select("doc_id", C.text_key(F.col("text")).alias("_tk"), F.octet_length("text").cast("long").alias("_size"), F.col("text").rlike("[0-9@]").alias("_any"))
        some = C.smallest(keys, F.xxhash64(F.lit(13), "doc_id"), max_train_rows, docs.count(), ("_tk",))
        field = train(C.sampled_texts(docs, [(r["doc_id"], r["_tk"], r["_size"]) for r in some.collect() if r["_any"]], max_train_bytes))
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        told = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2]))]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in C.stretches([len(t or "") for t in texts], STRETCH):
                base, every = labels_of(sent.value, texts[lo:hi], certainty)
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, pa.array([told(s) for s in base], kind), pa.array([told(s) for s in every], kind)], names=["doc_id", "base_spans", "spans"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return C.in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base_spans {spans}, spans {spans}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, the digest of their listing, the listing of all spans and how many there are."""
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(told("base_spans"), 256).alias("base_sha256"), told("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
