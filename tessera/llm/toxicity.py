"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased letter runs of the whole text, each counted once, hashed to
``DIMS`` values. The score is ``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)``:
the pair part lets an insult weigh more beside a mention of a group than the
two weights say on their own, which a linear model cannot learn. The pair sum
is computed in time linear in the terms.

Training: on the driver, by AdaGrad in numpy, on at most ``SAMPLE_ROWS``
labelled training rows (those with the least hash of the id), of which only the
hashed terms are collected. Odd words of a few documents cannot decide: a term takes part
if it stands in ``MIN_DOCS`` sampled documents or more and is commoner or rarer in
toxic ones by ``MIN_Z`` standard errors, either in all sampled documents or in those
that hold one of the commoner terms. The second test admits what says nothing on its own,
such as a group mention that is toxic beside an insult only. Toxic rows weigh
``TOXIC_WEIGHT`` times, as they are few.

Scoring: a narrow map over all texts; the model is a dictionary of at most a
few ten thousand hashed terms.

Defined results: null is an empty text and scores the bias, as does a text without known
terms; a null doc_id is held out; rows that repeat a doc_id are scored one by one, of
its rows one text is learnt from and its label is the greatest given; without labelled
rows every score is 0; an empty table gives no rows; very long texts are scored whole; further
columns are not read, whatever their names, and stay in ``keep_clean``.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_docs, table

DIMS = 1 << 20
RANK = 4
#: Labelled rows that the machine is fitted on, at most.
SAMPLE_ROWS = 20_000
MIN_DOCS = 6
MIN_Z = 4.0
TOXIC_WEIGHT = 4.0
EPOCHS = 30
FOLDS = 5
_TERM = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


def hashed(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (DIMS - 1)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


@dataclass
class Machine:
    bias: float
    at: dict[int, int]  # hashed term to row of the weights
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        s = v.sum(0)
        return float(self.bias + self.linear[rows].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _apart(features: list[np.ndarray], labels: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hashed term its documents, and by how many standard errors it is commoner in toxic ones."""
    n, k = np.zeros(dims), np.zeros(dims)
    for f, label in zip(features, labels):  # a document holds a term once
        n[f] += 1
        if label:
            k[f] += 1
    rate = min(max(labels.mean(), 1e-9), 1 - 1e-9) if len(labels) else 0.5
    return n, (k - n * rate) / np.sqrt(np.maximum(n, 1) * rate * (1 - rate))


def _selected(features: list[np.ndarray], labels: np.ndarray, dims: int = DIMS) -> np.ndarray:
    n, z = _apart(features, labels, dims)
    known = (n >= MIN_DOCS) & (np.abs(z) >= MIN_Z)
    worse = known & (z > 0)
    beside = np.array([bool(worse[f].any()) for f in features], dtype=bool)
    n, z = _apart([f for f, b in zip(features, beside) if b], labels[beside], dims)
    return np.flatnonzero(known | (n >= MIN_DOCS) & (np.abs(z) >= MIN_Z))


def fit(features: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, rank: int = RANK, seed: int = 7) -> Machine:
    """Weights from hashed terms (each once a document) and labels; ``features`` is emptied once it is indexed, as it may be large."""
    if not labels:
        return Machine(-np.inf, {}, np.zeros(0), np.zeros((0, rank)))
    names = _selected(features, np.array(labels) > 0)
    at = {int(x): i for i, x in enumerate(names)}
    place = np.full(DIMS, -1, dtype=np.int32)
    place[names] = np.arange(len(names))
    rows = [p[p >= 0] for p in (place[f] for f in features)]
    features.clear()
    y = np.array(labels, dtype=float)
    rng = np.random.default_rng(seed)
    d = len(names)
    w, v = np.zeros(d), rng.normal(0, 0.01, (d, rank))
    rate = np.clip(y.mean(), 1 / (len(y) + 2), 1 - 1 / (len(y) + 2))
    b = float(np.log(rate / (1 - rate)))
    gw, gv, gb = np.full(d, 1e-4), np.full((d, rank), 1e-4), 1e-4
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(order), 128):
            batch = order[start : start + 128]
            size = np.array([len(rows[i]) for i in batch])
            idx = np.concatenate([rows[i] for i in batch]) if d else np.zeros(0, dtype=np.int64)
            of = np.repeat(np.arange(len(batch)), size)
            vi = v[idx]
            s = np.stack([np.bincount(of, vi[:, k], len(batch)) for k in range(rank)], 1)
            sq = np.bincount(of, (vi * vi).sum(1), len(batch))
            z = b + np.bincount(of, w[idx], len(batch)) + 0.5 * ((s * s).sum(1) - sq)
            g = (sigmoid(z) - y[batch]) * np.where(y[batch] > 0, TOXIC_WEIGHT, 1.0) / len(batch)
            touched = np.unique(idx)
            dw = np.bincount(idx, g[of], d)[touched] + 2e-4 * w[touched]
            dv = np.stack([np.bincount(idx, g[of] * (s[of, k] - vi[:, k]), d)[touched] for k in range(rank)], 1) + 3e-3 * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= 0.2 * dw / np.sqrt(gw[touched])
            v[touched] -= 0.02 * dv / np.sqrt(gv[touched])
            gb += float(g.sum()) ** 2
            b -= 0.1 * float(g.sum()) / np.sqrt(gb)
    return Machine(b, at, w, v)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0; ``docs`` needs doc_id and text, ``labels`` doc_id and toxic."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = F.broadcast(picked.select("doc_id", F.col("toxic").cast("int").alias("toxic")))  # sample_rows ids
    texts = docs.select("doc_id", "text").join(picked.select("doc_id"), "doc_id", "left_semi")

    def per_batch(ids: list, batch: list) -> dict:
        return {"doc_id": ids, "terms": [np.array(sorted({hashed(t) for t in terms(text)}), dtype="<i4").tobytes() for text in batch]}

    # Packed, as the driver holds them all; one row an id, so that repeated rows cannot pass the bound.
    rows = map_docs(texts, per_batch, "doc_id long, terms binary").groupBy("doc_id").agg(F.min("terms").alias("terms"))
    found = rows.join(picked, "doc_id").select("doc_id", "toxic", "terms").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(t.as_buffer(), dtype="<i4") for t in found["terms"]], found["toxic"].to_pylist())


def score_texts(texts: list[str], machine: Machine, cache: dict[str, int]) -> list[float]:
    if len(cache) > 200_000:
        cache.clear()
    out = []
    for text in texts:
        rows = []
        for t in terms(text):
            r = cache.get(t)
            if r is None:
                r = cache[t] = machine.at.get(hashed(t), -1)
            if r >= 0:
                rows.append(r)
        # hashes that meet count once, as in training
        out.append(float(sigmoid(machine.logit(np.unique(np.array(rows, dtype=np.int64))))) if machine.bias > -np.inf else 0.0)
    return out


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the terms of SAMPLE_ROWS documents
    cache: dict[str, int] = {}

    def per_batch(ids: list, texts: list) -> dict:
        scores = score_texts(texts, shared.value, cache)
        return {"doc_id": ids, "held_out": [held_out(i) for i in ids], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_docs(docs, per_batch, "doc_id long, held_out boolean, score double, predicted int", id_col, text_col)


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """docs without those that score ``threshold`` or more; columns unchanged, no shuffle."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(machine)
    cache: dict[str, int] = {}

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            keep = [s < threshold for s in score_texts(texts, shared.value, cache)]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
