"""Benchmark decontamination with a broadcast hash set of test n-grams.

Everything is DataFrame expressions. The windows of all benchmark items are
hashed into a bucket table (an array of buckets, each a list of exact
n-grams with their item ids) that a scalar subquery hands to every task. A
document is then judged inside its own row: each token window picks a bucket
by hash and is verified against the n-grams there. No row is exploded, joined
or shuffled, so a very common passage costs nothing extra.

The bucket table is broadcast only up to ``max_windows`` distinct windows (a
documented bound, checked by a count); beyond it the windows of documents are
exploded and joined by hash with the n-gram table, and verified in the same way.

Defined results: null or empty text has no words, nothing is hit; an item
without words has no window; items with equal text all count; repeated rows are
judged one by one; a null item_id counts as no item but its window still hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, table

WINDOW = 13
#: Distinct windows that may travel inside the plan.
MAX_WINDOWS = 500_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(gram array<string>, items array<bigint>), one row for each distinct window."""
    w = items.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(n - 1))),
        lambda i: F.slice(F.col("w"), i, F.lit(n)),
    )
    return w.select("item_id", F.explode(cut).alias("gram")).groupBy("gram").agg(F.collect_set("item_id").alias("items"))


def _judge(n_words: Column, hits: Column) -> Column:
    """hits: array<struct<pos, len, items>> of one document, verified."""
    covered = F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1)))))
    found = F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"])))
    return let(F.struct(covered.cast("long").alias("n_hit"), F.array_sort(F.transform(found, lambda x: x.cast("string"))).alias("items")), lambda s: F.struct(
        n_words.cast("long").alias("n_words"),
        s["n_hit"].alias("n_hit"),
        F.size(s["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(s["items"], ",").cast("binary"), 256).alias("items_sha256"),
        ((s["n_hit"] > 0) & (s["n_hit"] * 20 >= n_words)).alias("contaminated"),
    ))


def _starts(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))


def judge_documents(docs: DataFrame, items: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with the columns n_words, n_hit, n_items, items_sha256, contaminated.

    Columns of ``docs`` with these names are replaced; all others are kept.
    """
    grams = windows(items.select("item_id", "text"), n)
    lengths = grams.groupBy(F.size("gram").alias("len")).agg(F.count("*").alias("n")).collect()  # at most n rows
    total = sum(r["n"] for r in lengths)
    lens = sorted(r["len"] for r in lengths)
    if total > max_windows:
        judged = _joined(docs, grams, lens)
    else:
        judged = _probed(docs, grams, lens, total)
    for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"):
        judged = judged.withColumn(c, F.col("__decon_judged")[c])
    return judged.drop("__decon_judged")


def _probed(docs: DataFrame, grams: DataFrame, lens: list[int], total: int) -> DataFrame:
    k = 1 << max(4, (4 * total).bit_length())
    filled = grams.groupBy(F.pmod(F.xxhash64("gram"), F.lit(k)).cast("int").alias("b")).agg(
        F.collect_list(F.struct("gram", "items")).alias("grams")
    )
    packed = filled.agg(F.array_sort(F.collect_list(F.struct("b", "grams"))).alias("t")).select(
        F.transform("t", lambda x: x["grams"]).alias("lists"), F.transform("t", lambda x: x["b"]).alias("slots"),
    ).select("lists", _dense("slots", k).alias("slot"))
    seen = grams.select(F.explode("gram").alias("x")).select(F.pmod(F.xxhash64("x"), F.lit(k)).cast("int").alias("b")).distinct()
    seen = seen.agg(F.array_sort(F.collect_list("b")).alias("slots")).select(F.transform(_dense("slots", k), lambda x: x >= 0).alias("known"))
    # These columns are used once each, so they collapse into the projection and no row carries a copy of the set.
    held = docs.withColumns({"__decon_w": words(F.col("text")), "__decon_lists": packed.select("lists").scalar(), "__decon_slot": packed.select("slot").scalar(), "__decon_known": seen.scalar()})
    parts = F.struct(*[F.col(f"__decon_{c}").alias(c) for c in ("w", "lists", "slot", "known")])
    judged = let(parts, lambda x: _judge(F.size(x["w"]), _hits(x, x["w"], lens, k)))
    return held.withColumn("__decon_judged", judged).drop("__decon_w", "__decon_lists", "__decon_slot", "__decon_known")


def _hits(grams: Column, w: Column, lens: list[int], k: int) -> Column:
    """The verified hits in the words ``w``; bucket b of the set is grams.lists[grams.slot[b]], none where the slot is -1."""
    if not lens:
        return F.array().cast("array<struct<pos:int,len:int,items:array<bigint>>>")

    def of(known: Column, n: int) -> Column:
        def all_known(i: Column) -> Column:
            ok = F.get(known, i - 1)
            for j in range(1, n):
                ok = ok & F.get(known, i + (j - 1))
            return ok

        probed = F.transform(F.filter(_starts(w, n), all_known), lambda i: F.struct(
            i.alias("pos"), F.get(grams["slot"], F.pmod(F.xxhash64(F.slice(w, i, F.lit(n))), F.lit(k)).cast("int")).alias("s"),
        ))
        verified = F.transform(F.filter(probed, lambda x: x["s"] >= 0), lambda x: F.struct(
            x["pos"].alias("pos"),
            F.lit(n).alias("len"),
            F.filter(F.get(grams["lists"], x["s"]), lambda g: g["gram"] == F.slice(w, x["pos"], F.lit(n))).alias("same"),
        ))
        return F.transform(F.filter(verified, lambda x: F.size(x["same"]) > 0), lambda x: F.struct(
            x["pos"].alias("pos"), x["len"].alias("len"), F.flatten(F.transform(x["same"], lambda g: g["items"])).alias("items"),
        ))

    # A window can only occur where each of its words is some benchmark word; that is tested first, once per word.
    flags = F.transform(w, lambda x: F.get(grams["known"], F.pmod(F.xxhash64(x), F.lit(k)).cast("int")))
    return let(flags, lambda known: F.concat(*[of(known, n) for n in lens]))


def _dense(slots: str, k: int) -> Column:
    """Array of k ints: position of each bucket in the sorted list of filled ones, else -1."""
    gaps = F.transform(F.col(slots), lambda b, i: F.array_repeat(F.lit(-1), b - F.coalesce(F.get(F.col(slots), i - 1), F.lit(-1)) - 1))
    filled = F.flatten(F.transform(gaps, lambda g, i: F.concat(g, F.array(i))))
    return F.concat(filled, F.array_repeat(F.lit(-1), F.lit(k)))


def _joined(docs: DataFrame, grams: DataFrame, lens: list[int]) -> DataFrame:
    """The way for a benchmark beyond the broadcast bound: hash join of windows, verified."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def cut(w: Column) -> Column:
        def of(n: int) -> Column:
            return F.transform(_starts(w, n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.xxhash64(F.slice(w, i, F.lit(n))).alias("h")))

        return F.concat(*[of(n) for n in lens])

    # The text's hash is taken below the explosion, so that no exploded row carries or hashes a text.
    keyed = docs.select("doc_id", F.xxhash64(text).alias("th"), let(words(F.col("text")), cut).alias("cuts"))
    cand = keyed.select("doc_id", "th", F.explode("cuts").alias("x")).select("doc_id", "th", "x.*")
    hit = cand.join(grams.select(F.xxhash64("gram").alias("h"), "gram", "items"), "h")
    per = hit.groupBy(F.col("doc_id").alias("__decon_id"), F.col("th").alias("__decon_th")).agg(F.collect_set(F.struct("pos", "len", "gram", "items")).alias("__decon_hits"))
    both = docs.join(per, F.col("doc_id").eqNullSafe(F.col("__decon_id")) & (F.xxhash64(text) == F.col("__decon_th")), "left")

    def judged(x: Column) -> Column:
        true = F.filter(x["hits"], lambda h: h["gram"] == F.slice(x["w"], h["pos"], h["len"]))
        return _judge(F.size(x["w"]), true)

    none = F.array().cast("array<struct<pos:int,len:int,gram:array<string>,items:array<bigint>>>")
    parts = F.struct(words(F.col("text")).alias("w"), F.coalesce("__decon_hits", none).alias("hits"))
    return both.withColumn("__decon_judged", let(parts, judged)).drop("__decon_id", "__decon_th", "__decon_hits")


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without the contaminated ones; columns unchanged."""
    clash = {c: f"__decon_kept_{c}" for c in docs.columns if c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
    judged = judge_documents(docs.withColumnsRenamed(clash), items, **how)
    return judged.where(~F.col("contaminated")).drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated").withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark")
    return judge_documents(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ln AS (SELECT DISTINCT n FROM g),
win AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ln WHERE len(w) >= n)),
h AS (SELECT doc_id, p, win.n, item_id FROM win JOIN g ON win.n = g.n AND win.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
