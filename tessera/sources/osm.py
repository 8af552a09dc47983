"""Reading map files of any supported format into one table of elements."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from io import BytesIO
from itertools import islice
from pathlib import PurePosixPath
from xml.etree import ElementTree
from zipfile import ZipFile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_raw
from .model import COLUMNS, ELEMENT, MEMBERS, TAGS
from .osm_o5m import O5mDataSource
from .osm_pbf import PbfDataSource

_TAG = "tag array<struct<_k:string,_v:string>>"
_SCHEMAS = {
    "node": f"_id bigint, _version int, _action string, _lat double, _lon double, {_TAG}",
    "way": f"_id bigint, _version int, _action string, nd array<struct<_ref:bigint>>, {_TAG}",
    "relation": f"_id bigint, _version int, _action string, member array<struct<_type:string,_ref:bigint,_role:string>>, {_TAG}",
    "bounds": "_minlat double, _minlon double, _maxlat double, _maxlon double",
    "bound": "_box string",
}


def _filled(df: DataFrame, **values: Column) -> DataFrame:
    """All element columns, null where nothing is given."""
    kinds = dict(c.strip().split(" ", 1) for c in ELEMENT.replace(MEMBERS, "M").replace(TAGS, "T").split(","))
    kinds = {k: {"M": MEMBERS, "T": TAGS}.get(v, v) for k, v in kinds.items()}
    return df.select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def read_xml(spark: SparkSession, path: str, file_seq: int = 0) -> DataFrame:
    """Elements of an XML file (also .gz, .bz2). Deleted elements go; nodes need id, lat and lon."""
    def rows(tag: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(_SCHEMAS[tag]).load(path)

    seq = F.lit(file_seq)
    order = F.monotonically_increasing_id()
    tags = F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), F.coalesce(t["_v"], F.lit("")).alias("v"))), F.array().cast(TAGS))
    common = {"version": F.coalesce("_version", F.lit(0)), "tags": tags, "file_seq": seq, "elem_seq": order}
    live = F.coalesce(F.col("_action"), F.lit("")) != "delete"
    out = [
        _filled(rows("node").where(live & F.col("_id").isNotNull() & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()), kind=F.lit("n"), id=F.col("_id"), lat=F.col("_lat"), lon=F.col("_lon"), **common),
        _filled(rows("way").where(live & F.col("_id").isNotNull()), kind=F.lit("w"), id=F.col("_id"), refs=F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<bigint>")), **common),
        _filled(rows("relation").where(live & F.col("_id").isNotNull()), kind=F.lit("r"), id=F.col("_id"), members=F.coalesce(F.filter(F.transform(
            "member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role")),
        ), lambda m: m["type"].isin("node", "way", "relation")), F.array().cast(MEMBERS)), **common),
        _filled(rows("bounds").where("_minlat IS NOT NULL AND _minlon IS NOT NULL AND _maxlat IS NOT NULL AND _maxlon IS NOT NULL"),
                kind=F.lit("b"), lat=F.col("_minlat"), lon=F.col("_minlon"), lat2=F.col("_maxlat"), lon2=F.col("_maxlon"), file_seq=seq, elem_seq=order),
    ]
    box = rows("bound").select(F.transform(F.split("_box", ","), lambda x: x.try_cast("double")).alias("v")).where("size(v) = 4 AND forall(v, x -> x IS NOT NULL)")
    out.append(_filled(box, kind=F.lit("b"), **{c: F.col("v")[i] for i, c in enumerate(("lat", "lon", "lat2", "lon2"))}, file_seq=seq, elem_seq=order))
    return reduce(DataFrame.unionByName, out)


def _zip_rows(path: str, file_seq: int) -> Iterator[tuple]:
    """Elements of the XML file in a zip archive, streamed."""
    with ZipFile(BytesIO(open_raw(path).read())) as z:
        stem = PurePosixPath(path).stem
        stack = []
        entry = next(n for n in z.namelist() if n.startswith(stem))
        with z.open(entry) as f:
            for at, (event, e) in enumerate(ElementTree.iterparse(f, events=("start", "end"))):
                if event == "start":
                    stack.append(e)
                    continue
                stack.pop()
                if len(stack) != 1:
                    continue
                got = _zip_element(e)
                stack[0].clear()
                if got:
                    row = dict.fromkeys(COLUMNS) | got | {"file_seq": file_seq, "elem_seq": at}
                    yield tuple(row[c] for c in COLUMNS)


def _zip_element(e: ElementTree.Element) -> dict | None:
    a = e.attrib
    if e.tag == "bounds" and {"minlat", "minlon", "maxlat", "maxlon"} <= set(a):
        return {"kind": "b"} | {c: float(a[k]) for c, k in (("lat", "minlat"), ("lon", "minlon"), ("lat2", "maxlat"), ("lon2", "maxlon"))}
    if e.tag not in ("node", "way", "relation") or a.get("action") == "delete" or "id" not in a:
        return None
    out = {"kind": e.tag[0], "id": int(a["id"]), "version": int(a.get("version", 0)), "tags": [(t.get("k"), t.get("v", "")) for t in e.iter("tag")]}
    if e.tag == "node":
        return out | {"lat": float(a["lat"]), "lon": float(a["lon"])} if {"lat", "lon"} <= set(a) else None
    if e.tag == "way":
        return out | {"refs": [int(n.get("ref")) for n in e.iter("nd")]}
    return out | {"members": [(m.get("type"), int(m.get("ref")), m.get("role", "")) for m in e.iter("member") if m.get("type") in ("node", "way", "relation")]}


def read_zip(spark: SparkSession, path: str, file_seq: int = 0) -> DataFrame:
    """An XML file in a zip archive, which no reader can split: one task streams it."""
    import pandas as pd

    def run(batches):
        for _ in batches:
            rows = _zip_rows(path, file_seq)
            while part := list(islice(rows, 50_000)):
                yield pd.DataFrame(part, columns=COLUMNS).astype({c: "Int64" for c in ("id", "version", "file_seq", "elem_seq")})

    return spark.range(1).coalesce(1).mapInPandas(run, ELEMENT)


def read_osm(spark: SparkSession, *paths: str, kinds: str = "nwr") -> DataFrame:
    """Elements of all files in order; the format is told by the suffix: .o5m, .pbf, else XML (also .gz, .bz2, .zip)."""
    frames = []
    for seq, path in enumerate(paths):
        if path.endswith((".o5m", ".pbf")):
            source = O5mDataSource if path.endswith(".o5m") else PbfDataSource
            spark.dataSource.register(source)
            df = spark.read.format(source.name()).option("paths", path).option("kinds", kinds).load()
            frames.append(df.withColumn("file_seq", F.lit(seq)))
        else:
            read = read_zip if path.endswith(".zip") else read_xml
            frames.append(read(spark, path, seq).where(F.col("kind").isin(*kinds, "b")))
    return reduce(DataFrame.unionByName, frames)
