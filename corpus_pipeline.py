"""Corpus pipeline: five stages over ``documents``, each calling one training-data operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. ``run`` writes each stage's rows as Parquet in
the shared folder and rereads them, so a lost executor never repeats more than
one stage.

Defined results of all stages: a null text is an empty one and stays null; a null doc_id is
no copy of another row and stays; rows that repeat a doc_id are judged one by one (of copies
those of the smallest id stay, all of them); very long texts are judged whole; an empty
table passes through as one; further columns of ``docs`` stay as they are, whatever their
names, up to the last stage, which returns columns of its own beside the text's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, near_copies, pii, simhash, toxicity
from tessera.llm.common import shared_folder, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    machine = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity 0.8) the document of the smallest id stays."""
    return simhash.keep_first(docs, grouped=near_copies.components)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind; all documents stay."""
    return pii.redact_documents(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document with its text, how many words of it the mix takes, and for each copy taken its shard and its place there.

    Sorting copies by (shard, place) gives the shuffled shards; a document that the mix does not take has none.
    """
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    places = F.transform(F.sequence(F.lit(0), F.size("shards")), lambda k: mixing.place(k))
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", (F.size("shards") * F.col("size")).alias("taken"),
        F.array_join("shards", ",").alias("shards"), F.array_join(F.slice(places, 1, F.size("shards")), ",").alias("places"), "text", "lang", "n_chars",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: The trained stages and XXH64 fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
