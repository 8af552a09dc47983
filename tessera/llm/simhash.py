"""SimHash near-dedup by a binary trie self-join.

Fingerprints: majority of the XXH64 (seed 42) bits of 3-word shingles, whole
texts, in one narrow Arrow map.

Self-join: only distinct fingerprints take part. The 64 bits are cut into four
blocks of 16; two fingerprints with at most 2 differing bits agree in at least
two whole blocks, so each of the six pairs of blocks gives one arrangement of
the bits with that pair in front, and the front 32 bits are the shuffle key
(six short rows a fingerprint; another budget takes two blocks more than it has bits). Within a task the arranged values are sorted,
which lays out their binary trie as ranges: a node is a range of equal leading
bits. The self-join starts from the nodes below each key, paired with
themselves, and goes down all node pairs of a level together: children on the
same bit keep their differing bits, children on unlike bits add one, and a
pair beyond the budget is pruned with all below it. Pairs of single leaves are
settled by a popcount at once.

Of the links that a task finds only a spanning forest leaves it: less than one
row for each row read, and connectivity is whole. Components of the remaining graph are found by star
contraction (``common.connected_components``).

Scale: text never leaves its map; what is shuffled is 16 to 24 bytes a
document. Copies of any number count once. A fingerprint can have at most 2080
others within two bits, so dense groups stay bounded by that, whatever the
number of documents.

Defined results: null, empty or blank text has fingerprint zero, linked like
any other; rows that repeat a doc_id each get their component; a null doc_id
counts only where its whole component has none (component_id null); an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, connected_components, map_docs, shared_checkpoint, shuffle_width, table

BITS = 2
SHINGLE = 3
SEED = 42
#: Ids that are broadcast at most: 8 bytes each, some 64 MB in a hash table.
MAX_SENT = 2_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text: str, n: int = SHINGLE) -> list[str]:
    w = _WORD.findall(text.translate(ASCII_LOWER))
    if len(w) <= n:
        return [" ".join(w)] if w else []
    if n == 3:
        return [f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:])]
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def fingerprints(texts: list[str]) -> np.ndarray:
    """uint64 fingerprint of each text."""
    digest = xxhash.xxh64_intdigest
    return np.array([majority(np.array([digest(s, SEED) for s in shingles(text)], dtype=np.uint64)) for text in texts], dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the uint64 hashes; zero for none."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def arrangements(budget: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each pair of ``budget`` + 2 blocks of bits: the blocks (place of the low bit, width)
    with that pair in front, and the width of the pair. Fingerprints within the budget agree
    in at least one pair.
    """
    n = budget + 2
    width = [64 // n + (b < 64 % n) for b in range(n)]
    blocks = [(sum(width[:b]), width[b]) for b in range(n)]
    return [([blocks[a], blocks[b], *(x for i, x in enumerate(blocks) if i not in (a, b))], width[a] + width[b]) for a in range(n) for b in range(a + 1, n)]


def arrange(fp: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The bits of fp with the blocks in this order, the first in front."""
    out = np.zeros_like(fp)
    for low, width in blocks:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


def trie_self_join(leaves: np.ndarray, shared: int, budget: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of sorted distinct uint64 ``leaves`` that agree in their
    first ``shared`` bits and differ in at most ``budget`` others.
    """
    n = len(leaves)
    none = np.zeros(0, dtype=np.int64)
    if n < 2:
        return none, none
    head = leaves >> np.uint64(64 - shared) if shared else np.zeros(n, dtype=np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    stop = np.append(cut[1:], n)
    lo, hi = cut[stop - cut > 1], stop[stop - cut > 1]
    a0, a1, b0, b1, err = lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64)
    found_i, found_j = [], []
    for bit in range(63 - shared, -1, -1):
        if not len(a0):
            break
        mask = np.uint64(1 << bit)

        def middle(s: np.ndarray, e: np.ndarray) -> np.ndarray:
            """First leaf of each node with this bit set: one search for prefix + bit."""
            first = leaves[s]
            want = (first & ~np.uint64((2 << bit) - 1 if bit < 63 else 2**64 - 1)) | mask
            return np.clip(np.searchsorted(leaves, want), s, e)

        am, bm = middle(a0, a1), middle(b0, b1)
        same = (a0 == b0) & (a1 == b1)
        children = [
            (a0, am, b0, bm, err, np.ones(len(a0), dtype=bool)),
            (am, a1, bm, b1, err, np.ones(len(a0), dtype=bool)),
            (a0, am, bm, b1, err + 1, np.ones(len(a0), dtype=bool)),
            (am, a1, b0, bm, err + 1, ~same),
        ]
        parts = []
        for p0, p1, q0, q1, e, ok in children:
            # an empty child, a leaf paired with itself or a spent budget ends here
            keep = ok & (p1 > p0) & (q1 > q0) & (e <= budget) & ~((p0 == q0) & (p1 - p0 == 1))
            leaf = keep & (p1 - p0 == 1) & (q1 - q0 == 1)
            i, j = p0[leaf], q0[leaf]
            near = np.bitwise_count(leaves[i] ^ leaves[j]) <= budget
            found_i.append(i[near])
            found_j.append(j[near])
            keep &= ~leaf
            parts.append((p0[keep], p1[keep], q0[keep], q1[keep], e[keep]))
        a0, a1, b0, b1, err = (np.concatenate(c) for c in zip(*parts))
    i, j = (np.concatenate(x) if x else none for x in (found_i, found_j))
    return np.minimum(i, j), np.maximum(i, j)


def spanning_forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of pairs (i, j) that connect what all pairs connect: every root is hooked once a round, by one pair."""
    root, used = np.arange(n), []
    while True:
        a, b = root[i], root[j]
        at = np.flatnonzero(a != b)
        if not len(at):
            return np.concatenate(used) if used else at
        high, low = np.maximum(a, b)[at], np.minimum(a, b)[at]
        high, first = np.unique(high, return_index=True)
        root[high] = low[first]
        used.append(at[first])
        while (nxt := root[root]).tobytes() != root.tobytes():
            root = nxt


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def links(distinct: DataFrame, budget: int = BITS) -> DataFrame:
    """(u, v): by task, linked pairs of distinct fingerprints ``fp`` that connect all its linked pairs."""
    kinds = arrangements(budget)

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (blocks, front) in enumerate(kinds):
                moved = arrange(fp, blocks)
                key = (moved >> np.uint64(64 - front)).astype(np.int64) * len(kinds) + k
                yield pa.RecordBatch.from_arrays([pa.array(key), _signed(moved), _signed(fp)], names=["key", "moved", "fp"])

    def join(batches):
        held: list[list] = [[] for _ in kinds]
        for batch in batches:
            key, moved, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            for k in range(len(kinds)):
                own = key % len(kinds) == k
                held[k].append((moved[own].view(np.uint64), fp[own]))
        for (_, front), parts in zip(kinds, held):
            if not parts:
                continue
            moved, fp = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(moved)
            moved, fp = moved[order], fp[order]
            i, j = trie_self_join(moved, front, budget)
            tree = spanning_forest(len(moved), i, j)
            for at in range(0, len(tree), 100_000):
                t = tree[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(fp[i[t]]), pa.array(fp[j[t]])], names=["u", "v"])

    moved = distinct.select("fp").mapInArrow(spread, "key long, moved long, fp long")
    return moved.repartition(shuffle_width(distinct.sparkSession), "key").mapInArrow(join, "u long, v long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id)."""

    def per_batch(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "fp": fingerprints(texts).view(np.int64)}

    marked = shared_checkpoint(map_docs(docs, per_batch, "doc_id long, fp long", id_col, text_col))
    return component_ids(marked, links(marked.select("fp").distinct()))


def component_ids(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the least id connected with each row of (doc_id, fp) by edges of fp."""
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = connected_components(edges)
    placed = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    # Copies share a fingerprint, which may be hot: the small side has one row for each, and AQE splits the other.
    of = placed.join(least, "component").select("fp", "component_id")
    return marked.select("doc_id", "fp").join(of, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", grouped: Callable[..., DataFrame] = components) -> DataFrame:
    """docs with one document of each component, the one of the smallest id; columns unchanged.

    ``grouped`` finds the components. Rows that repeat the kept id stay; rows without an id stay. Up to ``MAX_SENT`` ids that go, counted first, are
    sent to the texts; more ids and the texts meet by a shuffle of both.
    """
    gone = grouped(docs, id_col).where("doc_id <> component_id").select(F.col("doc_id").alias("__simhash_gone")).distinct()
    gone = shared_checkpoint(gone)
    gone = gone.hint("broadcast" if gone.count() <= MAX_SENT else "shuffle_hash")
    return docs.join(gone, docs[id_col] == gone["__simhash_gone"], "left_anti")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
