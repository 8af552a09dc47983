"""The pipeline on a small corpus, stage by stage against brute force."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as plain_decontaminate
from test_mixing import water_fill
from test_near_copies import plain_kept
from test_scans import plain_pii

from tessera.llm import toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfglmnp" for b in ("ara", "eno", "iku", "omu") for c in ("", "s", "ri")]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(25)) for i in range(6)]
    docs, labels = [], []
    for i in range(400):
        t = text(r.randint(20, 200))
        if i % 10 == 3:
            t = t.replace(" ", " vile scum ", 3)
        if i % 25 == 1:
            t = t[:40] + " " + items[i % 6][1] + " " + t[40:]
        if i % 9 == 2:
            t += f" reach joe{i}@mail.example.com or +1 (743) 555-3824"
        docs.append((i, t, "en", r.choice(["a", "b", None, "c"]), len(t)))
        labels.append((i, 1, int(i % 10 == 3)))
    docs += [(1000 + i, docs[i * 7][1], "en", "a", docs[i * 7][4]) for i in range(30)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (2002, "", "en", "a", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    before = {x["doc_id"]: x for x in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path).cache()
        rows = out.collect()
        now = {x["doc_id"]: x for x in rows}
        assert len(now) == len(rows)
        if name != "mixing":
            assert out.columns == docs.columns and out.schema == docs.schema
        if name == "toxicity":
            machine = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
            scores = toxicity.score_texts([x["text"] or "" for x in before.values()], machine, {})
            assert set(now) == {i for i, s in zip(before, scores) if s < 0.5}
            assert {i for i in before if "scum" in (before[i]["text"] or "")} == set(before) - set(now)
        elif name == "near_dedup":
            assert sorted(map(str, now)) == plain_kept([(i, x["text"]) for i, x in before.items()])
            assert not any(1000 <= i < 1030 and before.get((i - 1000) * 7) for i in now)
        elif name == "decontamination":
            judged = plain_decontaminate([(i, x["text"]) for i, x in before.items()], items)
            assert set(now) == {i for i, v in judged.items() if not v[4]} and len(now) < len(before)
        elif name == "pii":
            assert set(now) == set(before)
            for i, x in now.items():
                assert not plain_pii(x["text"] or "")
                if not plain_pii(before[i]["text"] or ""):
                    assert re.sub(r"\[[A-Z]+\]", "", x["text"] or "") in (before[i]["text"] or "") or "[" in x["text"]
        else:
            sizes = {}
            for x in before.values():
                sizes[x["source"]] = sizes.get(x["source"], 0) + len((x["text"] or "").split())
            want = water_fill(sizes)
            for r in rows:
                assert r["text"] == before[r["doc_id"]]["text"] and len([x for x in r["shards"].split(",") if x]) == len([x for x in r["places"].split(",") if x])
            taken = {r["source"]: r["t"] for r in out.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
            for s, t in want.items():
                assert abs(taken[s] - t) <= 0.02 * t
        before, docs = now, out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} == set(before)
