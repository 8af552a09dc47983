"""The near_dedup stage against brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tessera.llm import near_copies


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * k >= 4 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(str(d) for i, (d, _) in enumerate(rows) if d is None or least[find(i)] == d)


def edited(r, words, n):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"edit{r.randrange(10**6)}"
    return " ".join(out)


def corpus():
    r = random.Random(4)
    rows = []
    for i in range(60):
        t = [f"w{r.randrange(3000)}" for _ in range(r.randint(8, 300))]
        rows.append((i, " ".join(t)))
        rows += [(100 + 10 * i + k, edited(r, t, max(1, len(t) * (k + 1) // 80))) for k in range(i % 4)]
    t = [f"c{k}" for k in range(120)]
    rows += [(2000 + k, edited(r, t, 1)) for k in range(80)]  # one large group
    rows += [(3000 + k, " ".join(t[:90] + [f"p{k}x{j}" for j in range(30 + k)])) for k in range(60)]  # a long common passage only
    return rows


def test_edited_copies_go(spark, make_docs, awkward):
    rows = corpus() + [(None if i is None else i + 5000, t) for i, t in awkward]
    docs = make_docs(rows, clash=False)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.schema == docs.schema
    want = plain_kept(rows)
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == want
    assert not any(2001 <= int(i) < 2080 for i in want if i != "None")


def test_chain_in_a_crowd(spark, make_docs):
    """Neighbours are near copies, ends are not, and all share a crowded shingle."""
    t = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(t[8 * k : 8 * k + 200])) for k in range(20)]
    assert plain_kept(rows) == ["0"]
    assert corpus_pipeline.drop_near_copies(spark, make_docs(rows), "").count() == 1


def test_common_shingles_do_not_lose_pairs(spark, make_docs, monkeypatch):
    """The order by rarity is for the work only."""
    rows = corpus()
    monkeypatch.setattr(near_copies, "rarity", lambda counts: np.random.default_rng(1).integers(0, 255, near_copies.SLOTS).astype(np.uint8))
    monkeypatch.setattr(near_copies, "CROWD", 3)
    kept = corpus_pipeline.drop_near_copies(spark, make_docs(rows), "")
    assert sorted(str(x["doc_id"]) for x in kept.select(F.col("doc_id")).collect()) == plain_kept(rows)


def test_shingles_of_long_texts(monkeypatch):
    """Texts are hashed in pieces; sets are equal just where the plain ones are."""
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "B", "b", "éa", "\t", "long" * 9, "x" * 40]) for _ in range(n)) for n in (0, 1, 3, 5, 6, 40, 400, 3000)] + ["", " \n", "y" * 500, " a  b "]
    whole = near_copies.shingle_sets(texts)
    monkeypatch.setattr(near_copies, "PIECE", 64)
    for t, x, y in zip(texts, whole, near_copies.shingle_sets(texts)):
        assert x.tolist() == y.tolist() and len(x) == len(plain_set(t))


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    rows = lambda x: np.frombuffer(near_copies.sketch(x), dtype=np.uint8)[None, :]
    for n, m, k in [(1, 1, 0), (60, 70, 58), (500, 620, 490), (3000, 9000, 2500)]:
        x = rng.integers(0, 2**63, n + m - k, dtype=np.uint64)
        a, b = x[:n], x[n - k :]
        assert 0 < near_copies.least_differences(rows(a), rows(b))[0, 0] <= n + m - 2 * k
        assert near_copies.least_differences(rows(a), rows(a))[0, 0] == 0
        assert near_copies.least_difference(near_copies.sketch(a), near_copies.sketch(b)) == near_copies.least_differences(rows(a), rows(b))[0, 0]


def test_links_outside_the_largest_component(spark, make_docs):
    """Members that only some of a crowd are near to: nearest sketches first, all in the end."""
    r = random.Random(9)
    t = [f"c{k}" for k in range(150)]
    rows = [(k, edited(r, t, r.choice([1, 2, 3, 4, 5]))) for k in range(150)]
    kept = corpus_pipeline.drop_near_copies(spark, make_docs(rows), "")
    want = plain_kept(rows)
    assert 1 < len(want) < 100
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == want


def test_candidates_are_all_offered_in_the_end():
    """Of one shingle's nodes each pair that may be near comes out once ``most`` is large enough."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 260, 150, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(60)]
    base = sets[0]
    sets += [np.unique(np.concatenate([base[k:], sets[k + 1][:k]])) for k in range(1, 40)]
    n = np.array([len(s) for s in sets])
    sig, comp = np.arange(len(sets)), rng.integers(0, 7, len(sets))
    us, vs, more = near_copies.candidates(sig, n, comp, [near_copies.sketch(s) for s in sets], 1000)
    found = {(min(u, v), max(u, v)) for u, v in zip(np.concatenate(us).tolist(), np.concatenate(vs).tolist())}
    assert not more and near_copies.candidates(sig, n, comp, [near_copies.sketch(s) for s in sets], 1)[2]
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 5 * k >= 4 * (n[i] + n[j] - k) and comp[i] != comp[j]:
                assert (j, i) in found


def test_offers_follow_the_size_of_a_group(spark, make_docs, monkeypatch):
    """Near copies that are all apart: one offer a node and round, not one a pair, and each pair of few shingles; all are found."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[2:], rng.integers(0, 2**63, 2, dtype=np.uint64)])) for _ in range(90)]
    n, sig = np.array([len(s) for s in sets]), np.arange(90)
    us, _, more = near_copies.candidates(sig, n, sig, [near_copies.sketch(s) for s in sets], 1)
    assert more and sum(map(len, us)) < 90
    offered = []
    checkpoint = near_copies.shared_checkpoint

    def counted(df):
        out = checkpoint(df)
        if df.columns == ["u", "v", "key"]:
            offered.append(out.where("key IS NULL").count())
        return out

    monkeypatch.setattr(near_copies, "shared_checkpoint", counted)
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda nodes: nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v")))
    r = random.Random(6)
    t = [f"c{k}" for k in range(400)]
    rows = [(k, edited(r, t, 2)) for k in range(90)]
    kept = corpus_pipeline.drop_near_copies(spark, make_docs(rows), "")
    assert [x["doc_id"] for x in kept.collect()] == [0] and plain_kept(rows) == ["0"]
    assert sum(offered) < 10 * len(rows)
