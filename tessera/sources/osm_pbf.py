"""PBF map files as a Python data source: one task for a range of file blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import open_raw
from .model import COLUMNS, ELEMENT
from .wire import fields, packed, undelta, zigzag

#: Features without which a file cannot be read right.
KNOWN_FEATURES = ("OsmSchema-V0.6", "DenseNodes")
KINDS = ("node", "way", "relation")
BLOCKS_PER_TASK = 16


class UnknownFeature(ValueError):
    """The file needs a feature that this reader does not have."""


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def block_index(path: str) -> list[tuple[str, int, int]]:
    """(type, offset, size) of all blobs; only the headers are read."""
    out = []
    with open_raw(path) as f:
        while len(head := f.read(4)) == 4:
            info = dict(fields(f.read(int.from_bytes(head, "big"))))
            out.append((info[1].decode(), f.tell(), info[3]))
            f.seek(info[3], 1)
    return out


def blob(data: bytes) -> bytes:
    parts = dict(fields(data))
    return parts[1] if 1 in parts else zlib.decompress(parts[3])


def read_header(data: bytes) -> tuple[float, float, float, float] | None:
    """Bounds (lat, lon, lat2, lon2) of a header block, after its features were checked."""
    box = None
    for n, v in fields(data):
        if n == 4 and v.decode() not in KNOWN_FEATURES:
            raise UnknownFeature(v.decode())
        if n == 1:
            e = {k: zigzag(x) / 1e9 for k, x in fields(v)}
            box = (e[4], e[1], e[3], e[2])
    return box


def _element(kind: str, **values) -> dict:
    return dict.fromkeys(COLUMNS) | {"kind": kind, "version": 0, "tags": []} | values


def read_block(data: bytes, want: frozenset[str] = frozenset("nwr")) -> Iterator[dict]:
    """Elements of a data block in file order."""
    groups, head = [], {17: 100, 19: 0, 20: 0}
    strings: list[str] = []
    for n, v in fields(data):
        if n == 1:
            strings = [s.decode("utf-8") for _, s in fields(v)]
        elif n == 2:
            groups.append(v)
        else:
            head[n] = _signed(v)

    def degree(v: int, offset: int) -> float:
        return (head[offset] + head[17] * v) / 1e9

    def pairs(keys: bytes, vals: bytes) -> list[dict]:
        return [{"k": strings[k], "v": strings[v]} for k, v in zip(packed(keys), packed(vals))]

    def version(info: bytes) -> int:
        return dict(fields(info)).get(1, 0)

    for group in groups:
        for n, v in fields(group):
            if n == 2 and "n" in want:
                d = dict(fields(v))
                ids, lats, lons = (undelta(packed(d[k], True)) for k in (1, 8, 9))
                versions = packed(dict(fields(d.get(5, b""))).get(1, b"")) or [0] * len(ids)
                flat, at = packed(d.get(10, b"")), 0
                for i, node in enumerate(ids):
                    tags = []
                    while at < len(flat) and flat[at]:
                        tags.append({"k": strings[flat[at]], "v": strings[flat[at + 1]]})
                        at += 2
                    at += 1
                    yield _element("n", id=node, version=versions[i], lat=degree(lats[i], 19), lon=degree(lons[i], 20), tags=tags)
            elif n == 1 and "n" in want:
                d = dict(fields(v))
                yield _element("n", id=zigzag(d[1]), version=version(d.get(4, b"")), lat=degree(zigzag(d[8]), 19), lon=degree(zigzag(d[9]), 20), tags=pairs(d.get(2, b""), d.get(3, b"")))
            elif n == 3 and "w" in want:
                d = dict(fields(v))
                yield _element("w", id=_signed(d[1]), version=version(d.get(4, b"")), refs=undelta(packed(d.get(8, b""), True)), tags=pairs(d.get(2, b""), d.get(3, b"")))
            elif n == 4 and "r" in want:
                d = dict(fields(v))
                refs, roles, types = undelta(packed(d.get(9, b""), True)), packed(d.get(8, b"")), packed(d.get(10, b""))
                members = [{"type": KINDS[t], "ref": r, "role": strings[s]} for t, r, s in zip(types, refs, roles)]
                yield _element("r", id=_signed(d[1]), version=version(d.get(4, b"")), members=members, tags=pairs(d.get(2, b""), d.get(3, b"")))


@dataclass
class Blocks(InputPartition):
    path: str
    file_seq: int
    first: int
    blobs: list[tuple[str, int, int]]


class PbfReader(DataSourceReader):
    def __init__(self, paths: list[str], want: frozenset[str]):
        self.paths, self.want = paths, want

    def partitions(self) -> list[Blocks]:
        out = []
        for seq, path in enumerate(self.paths):
            index = block_index(path)
            out += [Blocks(path, seq, at, index[at : at + BLOCKS_PER_TASK]) for at in range(0, len(index), BLOCKS_PER_TASK)]
        return out

    def read(self, part: Blocks) -> Iterator[tuple]:
        with open_raw(part.path) as f:
            for i, (kind, offset, size) in enumerate(part.blobs):
                f.seek(offset)
                data = blob(f.read(size))
                found: Iterator[dict] = iter(())
                if kind == "OSMHeader":
                    box = read_header(data)
                    if box:
                        found = iter([_element("b", lat=box[0], lon=box[1], lat2=box[2], lon2=box[3])])
                elif kind == "OSMData":
                    found = read_block(data, self.want)
                for k, e in enumerate(found):
                    # input order: block number, then place in the block
                    e["file_seq"], e["elem_seq"] = part.file_seq, (part.first + i) << 32 | k
                    yield tuple(_plain(e[c]) for c in COLUMNS)


def _plain(value):
    """Structs as tuples."""
    return [tuple(x.values()) if isinstance(x, dict) else x for x in value] if isinstance(value, list) else value


class PbfDataSource(DataSource):
    """``format("osm_pbf")``; options ``paths`` (comma-separated) and ``kinds`` (of n, w, r)."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return ELEMENT

    def reader(self, schema) -> PbfReader:
        paths = self.options.get("paths") or self.options["path"]
        return PbfReader(paths.split(","), frozenset(self.options.get("kinds", "nwr")))
