"""Near copies by SimHash and repeated passages by suffix arrays."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common, simhash, suffix_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """doc -> least doc reachable, by brute force over all pairs."""
    ids = [d for d, _ in fps]
    root = dict(zip(range(len(ids)), range(len(ids))))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def near_copies(n=120):
    r = random.Random(3)
    words = [f"{r.choice('abcdef')}{r.randint(0, 400)}" for _ in range(2000)]
    out = []
    for i in range(n):
        t = words[i * 7 : i * 7 + 400]
        out.append((i, " ".join(t)))
        for k in range(i % 4):
            u = list(t)
            u[r.randrange(len(u))] = "edit"
            out.append((1000 + 4 * i + k, " ".join(u)))
    return out


def test_simhash_rows(make_docs, awkward):
    rows = near_copies() + [(None if i is None else i + 5000, t) for i, t in awkward]
    got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.components(make_docs(rows)).collect()), key=str)
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = plain_components(fps)
    want = sorted(((i, f - (1 << 64) if f >> 63 else f, c) for (i, f), c in zip(fps, comp)), key=str)
    assert got == want and any(c not in (i, None) for (i, _), c in zip(rows, comp))
    kept = simhash.keep_first(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for (i, _), c in zip(rows, comp) if i == c or i is None)
    assert simhash.components(make_docs([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.lists(st.tuples(st.integers(0, 63), st.integers(0, 63), st.integers(0, 63)), max_size=30), st.integers(2, 4))
def test_trie_join(base, flips, budget):
    fp = np.unique(np.array([*base, *[base[i % len(base)] ^ (1 << a) ^ (1 << b) ^ (1 << c) for i, (a, b, c) in enumerate(flips)]], dtype=np.uint64))
    want = {(int(x), int(y)) for x in fp for y in fp if x < y and (int(x) ^ int(y)).bit_count() <= budget}
    i, j = simhash.trie_self_join(fp, 0, budget)
    assert {(int(fp[a]), int(fp[b])) for a, b in zip(i, j)} == want and len(i) == len(want)
    tree = simhash.spanning_forest(len(fp), i, j)
    ids = list(range(len(fp)))
    assert len(set(tree.tolist())) == len(tree) and plain_joined(ids, zip(i, j)) == plain_joined(ids, zip(i[tree], j[tree]))
    found = set()
    for blocks, front in simhash.arrangements(budget):
        moved = simhash.arrange(fp, blocks)
        assert len(np.unique(moved)) == len(fp)
        order = np.argsort(moved)
        i, j = simhash.trie_self_join(moved[order], front, budget)
        found |= {tuple(sorted((int(fp[order][a]), int(fp[order][b])))) for a, b in zip(i, j)}
    assert found == want


def plain_joined(ids, pairs):
    """The least member of each id's component."""
    root = dict(zip(ids, ids))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return root


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_long_chains(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (5, 5)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=50), st.booleans())
def test_suffix_array(t, by_item):
    old = suffix_dedup._induce_by_bucket
    if by_item:
        suffix_dedup._induce_by_bucket = suffix_dedup._induce_by_item
    try:
        sa = suffix_dedup.suffix_array(np.array(t))
    finally:
        suffix_dedup._induce_by_bucket = old
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    plcp = suffix_dedup.permuted_lcp(np.array(t), sa, 4)
    for a, b in zip(sa[1:], sa[:-1]):
        same = 0
        while max(a, b) + same < len(t) and t[a + same] == t[b + same]:
            same += 1
        assert min(plcp[a], 4) == min(same, 4)


def text_hash(t):
    h = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain_dedup(rows):
    """By (id, text): equal rows are one document, others of one id follow by the hashes of their texts."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, text_hash(x[1]))):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i, t] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def passages():
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdeé ") for _ in range(r.randint(1, 8))) for _ in range(n))
    common_part, short = text(60), text(8)
    out = []
    for i in range(60):
        t = text(50)
        if i % 3 == 0:
            t = t[:90] + common_part + t[90:]
        if i % 4 == 0:
            t = t + short + t[:150]
        if i % 10 == 0 and out:
            t = out[-1][1][:-7] + "!" + out[-1][1][-7:]
        out.append((i * 3, t))
    out += [(200 + i, common_part) for i in range(5)] + [(300, "a" * 1000), (301, "ab" * 300), (302, "x" * 99 + "a" * 101), (303, "a" * 100), (304, "a" * 99)]
    return out


@pytest.mark.parametrize("shard_bytes, hot", [(suffix_dedup.SHARD_BYTES, suffix_dedup.HOT), (2000, 1), (2000, 4)])
def test_passages_against_brute_force(make_docs, awkward, monkeypatch, shard_bytes, hot):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = passages() + [(None if i is None else i + 5000, t) for i, t in awkward]
    if hot == 1:  # unlike texts of one id, and of none
        rows += [(300, rows[0][1] + " and its own end " * 9), (300, rows[8][1]), (None, "é" * 700), (None, rows[6][1]), (None, rows[6][1]), (None, None)]
    got = suffix_dedup.deduplicate(make_docs(rows)).collect()
    want = plain_dedup(rows)
    found = sorted(((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got), key=str)
    assert found == sorted(((i, want[i, t]) for i, t in rows), key=str)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert sum(v[1] for v in want.values()) > 5000


def test_no_documents(make_docs):
    assert suffix_dedup.deduplicate(make_docs([])).count() == 0
