import hashlib
import re

import pytest

from tessera.llm import decontaminate as m

_W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Short Item here"), (3, ""), (4, None), (5, LONG), (None, "null id item words"), (10, " ".join(f"w{i}" for i in range(5, 18)))]
DOCS = [
    (100, f"before {LONG.upper()} after"), (101, " ".join(f"w{i}" for i in range(12))), (102, " ".join(f"x{i} " for i in range(300)) + "short, item... HERE"),
    (103, "w0 " + " ".join(f"w{i}" for i in range(20, 33)) + " y " + " ".join(f"w{i}" for i in range(5, 18))), (104, "null ID item words"),
    (105, "short item here short item here"), (106, " ".join(f"w{i % 40}" for i in range(5000))),
]


def brute(docs, items, n=13):
    words = lambda t: _W.findall((t or "").translate(LOW))
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[g] - {None}
        ids = ",".join(sorted(map(str, found)))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("bound", [m.MAX_WINDOWS, 1])
def test_against_brute_force(spark, make_docs, awkward, bound):
    rows = DOCS + awkward
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = m.judge_documents(make_docs(rows), items, max_windows=bound).collect()
    want = brute(rows, ITEMS)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want[r["doc_id"]], r["doc_id"]


def test_filter_keeps_columns_and_clean_rows(spark, make_docs):
    docs = make_docs(DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = m.decontaminate(docs, items)
    assert kept.columns == docs.columns
    want = {d for d, v in brute(DOCS, ITEMS).items() if not v[4]}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.first()["n_words"] == "clash"


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert m.judge_documents(make_docs([]), none).count() == 0
    (r,) = m.judge_documents(make_docs([(1, "a b")]), none).collect()
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (2, 0, False)
