"""o5m map files as a Python data source: one task for each section between resets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import open_raw
from .model import COLUMNS, ELEMENT
from .osm_pbf import _element, _plain
from .wire import read_int, read_uint

NODE, WAY, RELATION, BOX, END, RESET = 0x10, 0x11, 0x12, 0xDB, 0xFE, 0xFF
#: Fixed values of the format: table entries, and characters of a pair that goes into the table.
TABLE, PAIR_LENGTH = 15000, 250
KINDS = ("node", "way", "relation")
HEADERS = (b"o5m2", b"o5c2")


class Strings:
    """The last ``TABLE`` pairs, by distance."""

    def __init__(self):
        self.pairs: list[tuple[bytes, ...]] = []

    def read(self, data: bytes, at: int, parts: int) -> tuple[tuple[bytes, ...], int]:
        if data[at]:
            back, at = read_uint(data, at)
            return self.pairs[-back], at
        at += 1
        out = []
        for _ in range(parts):
            end = data.index(0, at)
            out.append(data[at:end])
            at = end + 1
        if sum(map(len, out)) <= PAIR_LENGTH:
            self.pairs.append(tuple(out))
            if len(self.pairs) > 2 * TABLE:
                del self.pairs[:-TABLE]
        return tuple(out), at

    def read_user(self, data: bytes, at: int) -> int:
        """Skips a (number, name) pair, whose number may hold zero bytes only as its end."""
        if data[at]:
            return read_uint(data, at)[1]
        _, end = read_uint(data, at + 1)
        uid = data[at + 1 : end]
        stop = end if uid == b"\0" else data.index(0, end + 1)
        name = b"" if uid == b"\0" else data[end + 1 : stop]
        if uid == b"\0":
            stop = end  # no user: two zero bytes in all
        if len(uid) + len(name) <= PAIR_LENGTH:
            self.pairs.append((uid, name))
        return stop + 1


def sections(path: str) -> list[tuple[int, int]]:
    """(begin, end) of the runs of data sets between resets; only lengths are read."""
    with open_raw(path) as f:
        data = f.read(7)
        if data[:1] != b"\xff" or data[3:7] not in HEADERS:
            raise ValueError("not an o5m file")
        out, begin, at = [], 7, 7
        while head := f.read(11):
            kind = head[0]
            if kind >= 0xF0:
                if at > begin:
                    out.append((begin, at))
                begin = at = at + 1
                if kind == END:
                    break
            else:
                size, n = read_uint(head, 1)
                at += n + size
            f.seek(at)
        if at > begin:
            out.append((begin, at))
    return out


def read_section(data: bytes) -> Iterator[dict]:
    """Elements of a section; data sets of other kinds are skipped, deletions too."""
    strings = Strings()
    last = {NODE: 0, WAY: 0, RELATION: 0}
    time = changeset = lat = lon = way_ref = 0
    member = [0, 0, 0]
    at = 0
    while at < len(data):
        kind = data[at]
        size, at = read_uint(data, at + 1)
        end = at + size
        if kind == BOX:
            v = []
            while at < end and len(v) < 4:
                x, at = read_int(data, at)
                v.append(x / 1e7)
            yield _element("b", lat=v[1], lon=v[0], lat2=v[3], lon2=v[2])
        elif kind in last:
            d, at = read_int(data, at)
            last[kind] += d
            version = 0
            if at < end:
                version, at = read_uint(data, at)
                if version:
                    d, at = read_int(data, at)
                    time += d
                    if time:
                        d, at = read_int(data, at)
                        changeset += d
                        at = strings.read_user(data, at)
            if at >= end:  # nothing but an id and a version: a deletion
                at = end
                continue
            e = _element("nwr"[kind - NODE], id=last[kind], version=version)
            if kind == NODE:
                d, at = read_int(data, at)
                lon += d
                d, at = read_int(data, at)
                lat += d
                e["lat"], e["lon"] = lat / 1e7, lon / 1e7
            else:
                size, at = read_uint(data, at)
                stop = at + size
                if kind == WAY:
                    refs = e["refs"] = []
                    while at < stop:
                        d, at = read_int(data, at)
                        way_ref += d
                        refs.append(way_ref)
                else:
                    members = e["members"] = []
                    while at < stop:
                        d, at = read_int(data, at)
                        (text,), at = strings.read(data, at, 1)
                        t = text[0] - 0x30
                        member[t] += d
                        members.append({"type": KINDS[t], "ref": member[t], "role": text[1:].decode("utf-8")})
            while at < end:
                (k, v), at = strings.read(data, at, 2)
                e["tags"].append({"k": k.decode("utf-8"), "v": v.decode("utf-8")})
            yield e
        at = end


@dataclass
class Section(InputPartition):
    path: str
    file_seq: int
    number: int
    begin: int
    end: int


class O5mReader(DataSourceReader):
    def __init__(self, paths: list[str], want: frozenset[str]):
        self.paths, self.want = paths, want

    def partitions(self) -> list[Section]:
        return [Section(p, s, n, *cut) for s, p in enumerate(self.paths) for n, cut in enumerate(sections(p))]

    def read(self, part: Section) -> Iterator[tuple]:
        with open_raw(part.path) as f:
            f.seek(part.begin)
            data = f.read(part.end - part.begin)
        for k, e in enumerate(read_section(data)):
            if e["kind"] in self.want or e["kind"] == "b":
                e["file_seq"], e["elem_seq"] = part.file_seq, part.number << 40 | k
                yield tuple(_plain(e[c]) for c in COLUMNS)


class O5mDataSource(DataSource):
    """``format("osm_o5m")``; options as for PBF."""

    @classmethod
    def name(cls) -> str:
        return "osm_o5m"

    def schema(self) -> str:
        return ELEMENT

    def reader(self, schema) -> O5mReader:
        paths = self.options.get("paths") or self.options["path"]
        return O5mReader(paths.split(","), frozenset(self.options.get("kinds", "nwr")))
