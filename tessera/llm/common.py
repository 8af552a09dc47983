"""Helpers shared by the training-data operators."""

from __future__ import annotations

import bisect
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Edges whose components one task finds.
ONE_TASK = 2_000_000
#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once an application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="ship")) / "tessera_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    # Whole texts in Arrow batches: fewer rows at once, where the session says nothing else.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder that the cluster names.

    ``spark.checkpoint.dir`` is honoured by Spark itself; a folder is set here
    only where none is configured and all runs on this machine, as in local tests.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for what all executors read."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; a lambda variable is never re-evaluated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z only. Pure ASCII text takes the cheaper lower(), which then does just that."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


class Taken:
    """Intervals that are taken already, with logarithmic overlap tests."""

    def __init__(self, spans: list[tuple[int, int]]):
        merged: list[list[int]] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        self.starts = [s for s, _ in merged]
        self.ends = [e for _, e in merged]

    def overlaps(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end

    def within(self, start: int, end: int) -> list[tuple[int, int]]:
        """The intervals that overlap start:end."""
        at = bisect.bisect_right(self.ends, start)
        return list(zip(self.starts[at:], self.ends[at:]))[: bisect.bisect_left(self.starts, end) - at]


def map_docs(
    docs: DataFrame,
    per_batch: Callable[[list, list], dict],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = 4_000_000,
) -> DataFrame:
    """Narrow Arrow map over (id, text); texts arrive whole, null as "".

    ``per_batch(ids, texts)`` returns columns by name in the order of ``schema``.
    It gets chunks of at most ``chunk_chars`` characters (or one longer text),
    so memory follows the chunk and not the partition.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids: list, texts: list) -> pa.RecordBatch:
            got = per_batch(ids, texts)
            return pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

        for batch in batches:
            ids: list = []
            texts: list = []
            size = 0
            for one_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(one_id)
                texts.append(text)
                size += len(text)
                if size >= chunk_chars:
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield emit(ids, texts)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) read, by hooking and pointer jumping."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (nxt := root[root]).tobytes() != root.tobytes():
            root = nxt
    part = np.flatnonzero(root != np.arange(len(nodes)))
    for s in range(0, len(part), 100_000):
        p = part[s : s + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[p]), pa.array(nodes[root[p]])], names=["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as ``u, v`` longs.

    Up to ``ONE_TASK`` edges, counted first, meet in one task (16 bytes each). More take
    alternating large-star and small-star rounds: each is one aggregation and
    one join by node, so a node of huge degree is pre-aggregated and its join
    can be split by AQE. Edges shrink to stars whose centre is the smallest
    node. Every round is checkpointed; only two numbers reach the driver.
    Both ways give the same rows.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = shared_checkpoint(edges)
    if edges.count() <= ONE_TASK:
        return shared_checkpoint(edges.repartition(1).mapInArrow(_joined, "node long, component long"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = shared_checkpoint(small)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
