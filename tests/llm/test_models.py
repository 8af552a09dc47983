"""Token counts, toxicity, language model and nearest neighbours."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ann, language_model, token_counts, toxicity

WORDS = ["the", "quick", "brown", "fox", "über", "naïve", "zzzzqq", "日本語", "a", "thequick", "foxes"]


@pytest.fixture(scope="module")
def pieces():
    return token_counts.Pieces.load(token_counts.default_vocabulary())


def plain_count(p, word):
    """Best segmentation of one word, without sharing."""
    t = token_counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(t) + 1):
        c = t[end - 1]
        ways = [(best[s][0] + p.scores[t[s:end]], -(best[s][1] + 1)) for s in range(max(0, end - p.longest), end) if t[s:end] in p.scores]
        if c not in p.scores:
            n = len(c.encode())
            ways.append((best[end - 1][0] + n * p.byte_score, -(best[end - 1][1] + n)))
        s, k = max(ways)
        best.append((s, -k))
    return best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text(alphabet="theqickbrownfxéü日7", min_size=1, max_size=12), min_size=1, max_size=25))
def test_trie_counts(pieces, words):
    trie = token_counts.PrefixTrie(pieces)
    trie.add(words)
    assert trie.terminals == {w: plain_count(pieces, w) for w in words}


def test_trie_equals_a_unigram_model(pieces):
    from tokenizers import Tokenizer, models

    tok = Tokenizer(models.Unigram([("<unk>", -1e9), *pieces.scores.items()], 0, False))
    r = random.Random(0)
    words = {"".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 14))) for _ in range(800)}
    trie = token_counts.PrefixTrie(pieces)
    trie.add(words)
    assert all(len(tok.encode(token_counts.MARK + w).tokens) == n for w, n in trie.terminals.items())
    assert trie.nodes_scored < sum(len(w) + 1 for w in words)  # prefixes are scored once


def test_token_rows(make_docs, awkward, pieces):
    got = token_counts.count_documents(make_docs(awkward)).collect()
    want = {i: (len((t or "").split()), sum(plain_count(pieces, w) for w in (t or "").split() if len(w) < 1000)) for i, t in awkward}
    assert len(got) == len(awkward)
    for r in got:
        assert r["n_pretokens"] == want[r["doc_id"]][0]
        if r["doc_id"] != 7:
            assert r["n_tokens"] == want[r["doc_id"]][1]
    assert token_counts.count_documents(make_docs([])).count() == 0


def test_small_terminal_table(pieces):
    trie = token_counts.PrefixTrie(pieces, max_terminals=3)
    for group in (["a", "ab"], ["abc", "abd"], ["a"]):
        trie.add(set(group))
        assert all(trie.terminals[w] == plain_count(pieces, w) for w in group)


# ---- toxicity ----

def test_pair_is_learned():
    """Toxic only where both terms meet: no additive model separates these four kinds."""
    r = random.Random(1)
    features, labels = [], []
    for i in range(4000):
        kind = i % 4
        f = {100 + r.randrange(50) for _ in range(8)} | ({1} if kind & 1 else set()) | ({2} if kind & 2 else set())
        features.append(np.array(sorted(f)))
        labels.append(int(kind == 3))
    m = toxicity.fit(list(features), labels)
    score = [toxicity.sigmoid(m.logit(np.array([m.at[x] for x in f if x in m.at], dtype=int))) for f in ([1], [2], [1, 2], [])]
    assert score[2] > 0.5 > max(score[0], score[1], score[3])
    assert (m.factors[m.at[1]] * m.factors[m.at[2]]).sum() > 0


def labelled(n=600):
    r = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfgl" for b in ("ara", "eno", "iku", "omu")]
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        docs.append((i, " ".join(r.choice(words) for _ in range(30)) + (" Vile scum!" if bad else "")))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_rows(spark, make_docs, awkward):
    docs, labels = labelled()
    frame = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (7, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rows = docs + [(None if i is None else i + 5000, t) for i, t in awkward]
    df = make_docs(rows)
    machine = toxicity.train(df, frame)
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, machine).collect()}
    held = [i for i, _ in docs if toxicity.held_out(i)]
    assert 50 < len(held) < 200 and all(got[i]["held_out"] == toxicity.held_out(i) for i in got)
    assert all(got[i]["predicted"] == int(i % 5 == 0) == int(got[i]["score"] >= 0.5) for i, _ in docs)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.keep_clean(df, machine)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    # nothing but texts and training labels reaches a score
    other = frame.withColumn("toxic", frame["toxic"]).where(~frame["doc_id"].isin([i for i, _ in docs if toxicity.held_out(i)]))
    again = toxicity.train(df, other)
    assert again.bias == machine.bias and np.array_equal(again.linear, machine.linear)
    none = toxicity.train(df, frame.limit(0))
    assert {r["score"] for r in toxicity.score_documents(df, none).collect()} == {0.0}
    assert toxicity.score_documents(make_docs([]), machine).count() == 0


def test_pair_sum_against_the_plain_one():
    rng = np.random.default_rng(5)
    m = toxicity.Machine(-0.3, {}, rng.normal(size=40), rng.normal(size=(40, toxicity.RANK)))
    for n in (0, 1, 2, 17):
        rows = rng.choice(40, n, replace=False)
        plain = -0.3 + sum(m.linear[i] for i in rows) + sum(float(m.factors[i] @ m.factors[j]) for a, i in enumerate(rows) for j in rows[:a])
        assert m.logit(rows) == pytest.approx(plain, abs=1e-9)


def test_terms_that_tell_only_beside_others():
    """A mention that says nothing alone, and a term of clean documents, take part."""
    r = random.Random(8)
    features, labels = [], []
    for k in range(1200):
        insult, group, kind = (r.random() < p for p in (0.3, 0.5, 0.3))
        toxic = insult and (group or r.random() < 0.2) and not kind or not insult and not group and r.random() < 0.22
        features.append(np.array([t for t, there in ((1, insult), (2, group), (3, kind), (10 + r.randrange(300), True)) if there], dtype="<i4"))
        labels.append(int(toxic))
    y = np.array(labels) > 0
    n, z = toxicity._apart(features, y, 400)
    assert z[1] > toxicity.MIN_Z and abs(z[2]) < toxicity.MIN_Z and z[3] < -toxicity.MIN_Z / 2
    assert {1, 2} <= set(toxicity._selected(features, y, 400).tolist())
    machine = toxicity.fit(list(features), labels)
    logit = lambda *terms: machine.logit(np.array([machine.at[t] for t in terms]))
    assert logit(1, 2) - logit(1) > logit(2) - machine.bias


# ---- language model ----

def corpus(n=300):
    r = random.Random(7)
    follow = {w: [r.choice(WORDS) for _ in range(3)] for w in WORDS}
    out = []
    for i in range(n):
        w = [r.choice(WORDS)]
        for _ in range(r.randint(5, 60)):
            w.append(r.choice(follow.get(w[-1], WORDS)) if r.random() < 0.9 else f"rare{r.randint(0, 500)}")
        out.append((i, " ".join(w)))
    return out


def test_language_model(make_docs, awkward, monkeypatch):
    rows = corpus() + [(None if i is None else i + 5000, t) for i, t in awkward]
    rows += [(1, "a b c"), (1, "a b c"), (10, "unlike text of one id"), (None, "a second without id"), (None, None)]
    got, found = {}, []
    for r in language_model.score_documents(make_docs(rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
        found.append((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)))
        assert r["score"] < 0 and r["held_out"] == language_model.held_out(r["doc_id"])
    count = Counter()
    for i, t in rows:
        if not language_model.held_out(i):
            count.update(language_model.tokens((t or "").encode()))
    total, v = sum(count.values()), len(count)
    assert all(r["train_tokens"] == total for x in got.values() for r in x)
    want = []
    for i, t in rows:
        w = language_model.tokens((t or "").encode())
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w)
        want.append((str(i), len(w), sum(count[x] > 0 for x in w), round(base, 5)))
    assert sorted(found) == sorted(want)
    same = sorted((r["score"] for r in got[1] if r["n_tokens"] == 4), reverse=True)
    assert len(same) == 2 and same[0] == pytest.approx(same[1])
    held = [r for i, x in got.items() for r in x if r["held_out"] and i is not None and i < 5000]
    assert len(held) > 10 and sum(r["score"] for r in held) > 1.05 * sum(r["base_score"] for r in held)
    monkeypatch.setattr(language_model, "HELD", 50)
    a, b = ({r["doc_id"]: r["score"] for r in language_model.score_documents(d).collect()} for d in (make_docs(corpus(60)), make_docs(corpus(60)).repartition(1)))
    assert a == pytest.approx(b, rel=1e-9)  # seating does not depend on partitions


def test_probabilities_sum_to_one(make_docs):
    """Over the vocabulary and the unknown word, in every context."""
    docs = make_docs(corpus(80)).select("doc_id", "text")
    state, kept = language_model.sample(language_model.training_counts(docs))
    rows = language_model.model_rows(state, kept, np.zeros(0, dtype=np.int64)).collect()
    d1, a1 = language_model.DISCOUNTS[1], language_model.STRENGTHS[1]
    held = kept[-1][language_model.CLASSES : 2 * language_model.CLASSES]
    back = np.stack([(a1 + d1 * k[: language_model.CLASSES]) / (a1 + held) for k in kept])
    unseen = np.array([language_model._unigram(np.zeros(1), np.zeros(1), k)[0] for k in kept])
    total = (back * unseen[:, None]).mean(0)
    for r in rows:
        total += (back * np.frombuffer(r["parents"])[:, None]).mean(0)
        m = np.frombuffer(r["pairs"], dtype=language_model.MODEL)
        total[m["context"]] += (m["n"] - d1 * m["tables"].astype(float)) / (a1 + held[m["context"]])
    assert np.allclose(total, 1, atol=1e-6)


def test_scores_against_a_plain_sampler(make_docs):
    """Of a few sentences: the average over many sweeps of a sampler that seats customers one by one."""
    train = [(i, t) for i, t in enumerate(["a b a b c", "b a b", "c c a b", "a b d", "d a b a"] * 3) if not language_model.held_out(i)]
    r = random.Random(2)
    (d0, d1), (a0, a1) = language_model.DISCOUNTS, language_model.STRENGTHS
    calls = [(([""] + t.split())[k], w) for _, t in train for k, w in enumerate([*t.split(), "\n"])]
    words = {w for _, w in calls}
    rooms = {c: {} for c, _ in calls}  # tables by dish: sizes
    top: dict[str, list[int]] = {}

    def prob0(w):
        n, t = sum(map(sum, top.values())), sum(map(len, top.values()))
        own = top.get(w, [])
        return (sum(own) - d0 * len(own) + (a0 + d0 * t) / (len(words) + 1)) / (a0 + n)

    def prob(c, w):
        room = rooms.get(c, {})
        n, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        own = room.get(w, [])
        return (sum(own) - d1 * len(own) + (a1 + d1 * t) * prob0(w)) / (a1 + n)

    def enter(tables, discount, fresh):
        """Seat one customer; whether at a new table."""
        masses = [x - discount for x in tables]
        u = r.random() * (sum(masses) + fresh)
        for k, m in enumerate(masses):
            u -= m
            if u < 0:
                tables[k] += 1
                return False
        tables.append(1)
        return True

    def leave(tables):
        k = r.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def add(c, w):
        t = sum(map(len, rooms[c].values()))
        if enter(rooms[c].setdefault(w, []), d1, (a1 + d1 * t) * prob0(w)):
            t0 = sum(map(len, top.values()))
            enter(top.setdefault(w, []), d0, (a0 + d0 * t0) / (len(words) + 1))

    for c, w in calls:
        add(c, w)
    probes = [("", "a"), ("a", "b"), ("b", "a"), ("b", "\n"), ("c", "c"), ("d", "zz")]
    mean = np.zeros(len(probes))
    for sweep in range(260):
        for c, w in calls:
            if leave(rooms[c][w]):
                leave(top[w])
            add(c, w)
        if sweep >= 60:
            mean += [prob(c, w) / 200 for c, w in probes]
    p = dict(zip(probes, mean))
    docs = make_docs(train).select("doc_id", "text")
    state, kept = language_model.sample(language_model.training_counts(docs))
    rows = {x["word"]: x for x in language_model.model_rows(state, kept, np.zeros(0, dtype=np.int64)).collect()}
    hashes = {w: language_model.word_hash(w.encode()) for w in [*words, "zz"]}
    held = kept[-1][language_model.CLASSES : 2 * language_model.CLASSES]
    for (c, w), want in p.items():
        klass = int(language_model.word_class(np.array([hashes[c]], dtype=np.uint64))[0]) if c else 0
        row = rows.get(int(np.uint64(hashes[w]).astype(np.int64)))
        parents = np.frombuffer(row["parents"]) if row else np.array([language_model._unigram(np.zeros(1), np.zeros(1), k)[0] for k in kept])
        value = np.mean([(a1 + d1 * k[klass]) / (a1 + held[klass]) * q for k, q in zip(kept, parents)])
        if row:
            m = np.frombuffer(row["pairs"], dtype=language_model.MODEL)
            m = m[m["context"] == klass]
            if len(m):
                value += (m["n"][0] - d1 * float(m["tables"][0])) / (a1 + held[klass])
        assert value == pytest.approx(want, rel=0.35), (c, w)


def test_seating_follows_the_restaurant_process():
    """Mean number of tables equals that of a plain simulation; large dishes go in steps."""
    r = random.Random(0)
    n, mass, growth, d = 200, 0.8, 0.3, 0.5

    def one():
        t = 1
        for i in range(1, n):
            new = mass + growth * t
            t += r.random() < new / (new + i - d * t)
        return t

    plain = np.mean([one() for _ in range(1500)])
    fast = language_model.seat(np.full(1500, n), np.full(1500, mass), np.full(1500, growth), d, np.arange(1500)).mean()
    assert fast == pytest.approx(plain, rel=0.05)
    assert 1 <= language_model.seat(np.array([10**12]), np.array([0.5]), np.array([0.1]), 0.5, 3)[0] <= 10**12


def test_training_sums_of_repeated_chunks(make_docs, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 500)
    test_probabilities_sum_to_one(make_docs)


def test_no_documents(make_docs):
    assert language_model.score_documents(make_docs([])).count() == 0


# ---- nearest neighbours ----

def vectors(spark, n=900, d=24):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(n, d)) * rng.uniform(0.5, 2, (n, 1))
    rows = [(i, [float(x) for x in v[i].astype(np.float32)], 0) for i in range(n)]
    rows += [(5000, None, 0), (5020, [0.0] * d, 0), (5040, [math.nan] * d, 0), (5060, [math.inf] * d, 0), (5080, [None] * d, 0), (5100, [1.0], 0), (None, [1.0] * d, 0)]
    rows += [(6000 + i, rows[20][1], 0) for i in range(3)] + [rows[40]]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, d=24, top=20):
    x = {i: np.array(v, dtype=np.float64) for i, v, _ in rows if i is not None and i < 5000 or i in (6000, 6001, 6002)}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = m @ x[q]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:top]
        out[int(q)] = [(int(ids[k]), float(s[k])) for k in order]
    return out


def test_exact_way_equals_brute_force(spark):
    rows, df = vectors(spark)
    got = {}
    for r in ann.search(df, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    want = brute(rows)
    assert set(got) == set(want)
    for q, w in want.items():
        assert [g[2] for g in got[q]] == list(range(1, 21))
        assert [g[0] for g in got[q]] == [v for v, _ in w] and [g[1] for g in got[q]] == pytest.approx([s for _, s in w])


def test_recall(spark):
    rows, df = vectors(spark)
    want = brute(rows)
    found = Counter()
    for r in ann.search(df).collect():
        found[r["query_id"]] += r["vec_id"] in {v for v, _ in want[r["query_id"]]}
    assert sum(found.values()) / (20 * len(want)) >= 0.9


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    two = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (20, [-1.0, 0.1], 1)], schema)
    assert sorted(map(tuple, ann.search(two).select("query_id", "rank", "vec_id").collect())) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert ann.search(spark.createDataFrame([], schema)).count() == 0


def test_footrule():
    """The posted sums are the footrule distance of the cut orders."""
    rng = np.random.default_rng(3)
    p, k = 20, 7
    a, b = (ann.orders(rng.normal(size=(1, 5)), np.eye(p, 5) + rng.normal(size=(p, 5)), k)[0].astype(int) for _ in range(2))
    place = lambda w: np.where(w > 0, k - w, k)
    assert np.abs(place(a) - place(b)).sum() == 2 * (k * (k + 1) // 2 - np.minimum(a, b).sum())
