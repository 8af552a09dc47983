import random

from pyspark.sql import functions as F

from tessera.llm import mixing as m


def water_fill(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: m.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(stopped.values())
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]]
        if not over:
            return stopped | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        stopped |= {s: 3.0 * sizes[s] for s in over}


def rows():
    r = random.Random(1)
    out = []
    for i in range(1500):
        source = r.choice(["a", "a", "a", "a", "b", "é", "Z", None, "tiny"][: 8 if i % 50 else 9])
        out.append((i, " ".join(["w"] * (3 if source == "tiny" else r.randint(0, 120))), source))
    return out


def test_targets_and_taken(make_docs):
    data = rows()
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = water_fill(sizes)
    out = m.mix(make_docs(data)).collect()
    assert len(out) == len(data)
    taken = {}
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert len(r["shards"]) <= 3 and all(0 <= s < m.SHARDS for s in r["shards"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * len(r["shards"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 3


def test_reruns_agree_whatever_the_partitions(make_docs):
    docs = make_docs(rows())
    a = sorted((r["doc_id"], r["shards"]) for r in m.mix(docs).collect())
    b = sorted((r["doc_id"], r["shards"]) for r in m.mix(docs.repartition(7)).collect())
    assert a == b


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 37), (3, 0), (4, 5000)], "rank int, quota long")
    got = {r["rank"]: r["cuts"] for r in m.splitting_tree(quotas, 8).collect()}
    for rank, quota in ((1, 1000), (2, 37), (3, 0), (4, 5000)):
        assert len(got[rank]) == 8 and got[rank] == sorted(got[rank]) and got[rank][-1] == quota
    ends = [sum(got[r][i] for r in got) for i in range(8)]
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert max(sizes) - min(sizes) <= 3  # each node halves its draws


def test_hypergeometric_draws(spark):
    n = 4000
    u = (F.col("id") + 0.5) / n
    k = m._hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(25).cast("long"), u)
    mean, low, high = spark.range(n).select(k.alias("k")).agg(F.avg("k"), F.min("k"), F.max("k")).first()
    assert abs(mean - 10) < 0.05 and low >= 0 and high <= 20


def test_awkward(make_docs, awkward):
    out = m.mix(make_docs([(i, t, "s" if i != 8 else None) for i, t in awkward])).collect()
    assert len(out) == len(awkward)
    assert m.mix(make_docs([])).count() == 0
    (r,) = m.mix(make_docs([(1, None)])).collect()
    assert r["target"] == 0 and r["size"] == 0


def test_shuffled_shards(make_docs):
    mixed = m.mix(make_docs(rows()))
    flat = m.shuffled(mixed)
    assert flat.count() == sum(len(r["shards"]) for r in mixed.collect())
