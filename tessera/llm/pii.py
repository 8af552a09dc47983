"""Personal data: patterns plus a skip-chain conditional random field.

Base spans are the four patterns. The method adds spans where a document's own
repetitions show that a token is personal data although no pattern matches it
there: a phone number that comes again without its country code, a card number
that is broken off, an address in another spelling.

Nodes of the field are the tokens (runs without white space) that hold a digit
or ``@``; any other token cannot hold such data and is outside. Its parts:

* node scores: log-linear in the token's shape, length and left neighbour;
* chain potentials between nodes that stand side by side;
* skip potentials between consecutive occurrences, anywhere in the document,
  of equal tokens or of tokens that end in the same seven digits.

All weights are fitted together by pseudo-likelihood, with the base spans as labels, on a
bounded sample of documents.

Loopy sum-product message passing (flooding, damped, a fixed number of rounds)
runs over all documents of a chunk at once as arrays. Skip edges link only
consecutive occurrences, so a token repeated n times has n - 1 edges and costs
stay linear. Tokens inside base spans are evidence. A token whose marginal for
a kind exceeds one half is added as a span of that kind unless it overlaps a
base span; neighbours of the same kind are merged.

Scale: one narrow map. The only training cost is a sample of ``SAMPLE_DOCS``
documents with the least hash of their id, whose nodes (not texts) come to the
driver; the weights are a few thousand numbers.

Defined results: null is an empty text; repeated rows are judged one by one;
offsets are code points, end exclusive; an empty table fits zero weights; very long texts
and tokens are read whole; kinds that match in one place are all kept; of beliefs that
tie the first kind as listed counts; further columns are not read, whatever their names
(a redaction keeps them).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Taken, map_docs, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
#: Documents that the field's weights are fitted on, at most.
SAMPLE_DOCS = 2000
ROUNDS = 8
DAMPING = 0.5
EVIDENCE = 8.0
PENALTY = 0.05
LEAST_SKIP = 2.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts, so the guard changes no result and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NODE = re.compile(r"[0-9@]\S*")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Goes from @ to @: the local part is the run before it, so long runs are read once."""
    found = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by kind as listed, then start."""
    found = [(s, e, "email") for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


@dataclass
class Nodes:
    """Nodes of some documents; edges are pairs of node numbers."""

    doc: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    features: list[tuple[str, ...]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


def _shape(token: str) -> str:
    return re.sub(r"([A-Za-z9])\1+", r"\1\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token)))


def add_nodes(nodes: Nodes, doc: int, text: str, base: list[tuple[int, int, str]]) -> None:
    last: dict[str, int] = {}
    end = 0
    marks = sorted((s, e, KINDS.index(k) + 1) for s, e, k in base)
    at = 0
    for m in _NODE.finditer(text):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        before = text[end:start]
        token = text[start : m.end()]
        end = m.end()
        n = len(nodes.doc)
        while at < len(marks) and marks[at][1] <= start:
            at += 1
        nodes.label.append(marks[at][2] if at < len(marks) and marks[at][0] < end else 0)
        adjacent = n > 0 and nodes.doc[-1] == doc and not before.strip()
        if adjacent:
            nodes.chain.append((n - 1, n))
            left = nodes.features[-1][0]
        else:
            left = (before.rsplit(None, 1) or [""])[-1].lower()
        nodes.doc.append(doc)
        nodes.start.append(start)
        nodes.end.append(end)
        digits = "".join(c for c in token if "0" <= c <= "9")
        nodes.features.append(("s" + _shape(token), f"d{min(len(digits), 20)}", f"l{min(len(token), 30)}", "w" + left))
        keys = [token.strip(".,;:!?()[]<>\"'").lower()] if len(token) >= 4 else []
        if len(digits) >= 7:
            keys.append("#" + digits[-7:])
        for key in keys:
            if key in last:
                nodes.skip.append((last[key], n))
            last[key] = n


@dataclass
class Field:
    """Weights: features by name, per label; potentials are log factors."""

    unary: dict[str, np.ndarray]
    bias: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def fit(labels: list[int], features: list[tuple[str, ...]], chain: list[tuple[int, int]], skip: list[tuple[int, int]], steps: int = 120) -> Field:
    """All weights of the field together, by pseudo-likelihood: each node given the labels of its neighbours."""
    n, k = len(labels), len(LABELS)
    names = sorted({f for fs in features for f in fs})
    at = {f: i for i, f in enumerate(names)}
    y = np.asarray(labels, dtype=int)
    x = np.array([[at[f] for f in fs] for fs in features], dtype=int).reshape(n, len(features[0]) if features else 0)
    (left, right), (one, two) = (np.array(e, dtype=int).reshape(-1, 2).T for e in (chain, skip))
    known = np.eye(k)[y]
    alike = np.zeros((n, k))  # labels of the neighbours over skip edges
    np.add.at(alike, one, known[two])
    np.add.at(alike, two, known[one])
    unary, bias = np.zeros((len(names), k)), np.log(known.sum(0) + 1) - np.log(n + k)
    side, same = np.zeros((k, k)), np.zeros(1)
    params = [unary, bias, side, same]
    squares = [np.full_like(v, 1e-6) for v in params]
    for _ in range(steps if n else 0):
        z = unary[x].sum(1) + bias + same * alike
        np.add.at(z, right, side[y[left]])
        np.add.at(z, left, side.T[y[right]])
        p = np.exp(z - z.max(1, keepdims=True))
        off = p / p.sum(1, keepdims=True) - known
        by_feature, by_side = PENALTY * unary, PENALTY * side
        for j in range(x.shape[1]):
            np.add.at(by_feature, x[:, j], off)
        np.add.at(by_side, y[left], off[right])
        np.add.at(by_side.T, y[right], off[left])
        grads = [by_feature, off.sum(0), by_side, PENALTY * same + (off * alike).sum()]
        for v, g, g2 in zip(params, grads, squares):
            g2 += g**2
            v -= 0.5 * g / np.sqrt(g2)
    # Between tokens that are alike agreement weighs at least ``LEAST_SKIP``, also where the sample has few of them.
    return Field({f: unary[i] for f, i in at.items()}, bias, side, max(LEAST_SKIP, float(same[0])) * np.eye(k))


def marginals(nodes: Nodes, model: Field) -> np.ndarray:
    """Beliefs of all nodes by loopy sum-product message passing."""
    n_labels = len(LABELS)
    zero = np.zeros(n_labels)
    unary = np.array([model.bias + sum((model.unary.get(f, zero) for f in fs), zero) for fs in nodes.features]).reshape(-1, n_labels)
    seen = np.asarray(nodes.label, dtype=int)
    inside = np.flatnonzero(seen)
    unary[inside, seen[inside]] += EVIDENCE
    pairs = np.array(nodes.chain + nodes.skip, dtype=int).reshape(-1, 2)
    pots = np.stack([model.chain] * len(nodes.chain) + [model.skip] * len(nodes.skip)) if len(pairs) else np.zeros((0, n_labels, n_labels))
    src = np.concatenate([pairs[:, 0], pairs[:, 1]])
    dst = np.concatenate([pairs[:, 1], pairs[:, 0]])
    pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    sent = np.zeros((len(src), n_labels))

    def beliefs() -> np.ndarray:
        b = unary.copy()
        np.add.at(b, dst, sent)
        return b

    for _ in range(ROUNDS if len(src) else 0):
        z = (beliefs()[src] - sent[back])[:, :, None] + pots
        top = z.max(1, keepdims=True)
        new = np.log(np.exp(z - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        sent = DAMPING * sent + (1 - DAMPING) * new
    b = beliefs()
    p = np.exp(b - b.max(1, keepdims=True)) if len(b) else b
    return p / p.sum(1, keepdims=True) if len(p) else p


def added_spans(texts: list[str], bases: list[list[tuple[int, int, str]]], model: Field) -> list[list[tuple[int, int, str]]]:
    nodes = Nodes()
    for i, (text, base) in enumerate(zip(texts, bases)):
        add_nodes(nodes, i, text, base)
    added: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not nodes.skip:  # without a repetition the field says what the patterns say
        return added
    p = marginals(nodes, model)
    best = p.argmax(1)
    touched = np.zeros(len(best), dtype=bool)
    touched[[i for pair in nodes.skip for i in pair]] = True
    taken: dict[int, Taken] = {}
    for n in np.flatnonzero((best > 0) & (p.max(1) > 0.5) & touched):
        doc, kind = nodes.doc[n], LABELS[best[n]]
        text, start, end = texts[doc], nodes.start[n], nodes.end[n]
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
            end -= 1
        if doc not in taken:
            taken[doc] = Taken([(s, e) for s, e, _ in bases[doc]])
        if start == end or taken[doc].overlaps(start, end):
            continue
        spans = added[doc]
        if spans and spans[-1][2] == kind and not text[spans[-1][1] : start].strip():
            spans[-1] = (spans[-1][0], end, kind)
        else:
            spans.append((start, end, kind))
    return added


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fit on the sample of documents with the least hash of their id, one row an id (the least text)."""
    ids = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample_docs)
    texts = docs.select(id_col, text_col).join(F.broadcast(ids), id_col, "left_semi")  # sample_docs ids
    sample = texts.groupBy(id_col).agg(F.min(text_col).alias(text_col))

    def per_batch(ids: list, texts: list) -> dict:
        out: dict = {"labels": [], "features": [], "chain": [], "skip": []}
        for text in texts:
            nodes = Nodes()
            add_nodes(nodes, 0, text, base_spans(text))
            out["labels"].append(nodes.label)
            out["features"].append([list(f) for f in nodes.features])
            out["chain"].append([x for pair in nodes.chain for x in pair])
            out["skip"].append([x for pair in nodes.skip for x in pair])
        return out

    rows = map_docs(sample, per_batch, "labels array<int>, features array<array<string>>, chain array<int>, skip array<int>", id_col, text_col)
    labels: list[int] = []
    features: list[tuple[str, ...]] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    for r in sorted(rows.where(F.size("labels") > 0).collect()):
        at = len(labels)
        labels += r["labels"]
        features += [tuple(f) for f in r["features"]]
        for pairs, flat in ((chain, r["chain"]), (skip, r["skip"])):
            pairs += [(at + i, at + j) for i, j in zip(flat[::2], flat[1::2])]
    return fit(labels, features, chain, skip)


def find(texts: list[str], model: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, each by kind as listed, then start."""
    bases = [base_spans(t) for t in texts]
    order = {k: i for i, k in enumerate(KINDS)}
    return [(b, sorted(b + a, key=lambda s: (order[s[2]], s[0])) if a else b) for b, a in zip(bases, added_spans(texts, bases, model))]


def scan_documents(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def per_batch(ids: list, texts: list) -> dict:
        out: dict = {"doc_id": ids, **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
        for base, spans in find(texts, model):
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    return map_docs(docs, per_batch, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", id_col, text_col)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each maximal covered range becomes the kind of its first span, in brackets."""
    out: list[str] = []
    at = 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, model: Field) -> DataFrame:
    """docs with personal data replaced in ``text``; ``n_chars`` follows, other columns stay, null text stays null."""
    import pyarrow as pa

    schema = docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            done: list = []
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                found = find([t or "" for t in part], model)
                done += [t if t is None else redact(t, spans) for t, (_, spans) in zip(part, found)]
            cols = list(batch.columns)
            cols[at] = pa.array(done, type=batch.schema.field(at).type)
            if (c := batch.schema.get_field_index("n_chars")) >= 0:
                cols[c] = pa.array([None if t is None else len(t) for t in done], type=batch.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_documents(docs, train(docs))
