"""Encoders of one tile: elements in input order to the bytes of a file."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterable

from ..sources.osm_o5m import NODE, PAIR_LENGTH, TABLE
from ..sources.osm_pbf import KINDS, KNOWN_FEATURES
from ..sources.wire import delta, field, packed_field, sint, uint

BATCH = 1000
Box = tuple[float, float, float, float]


def written_version(version: int, policy: str) -> int:
    return {"remove": 0, "fake": 1, "keep": version or 0}[policy]


def degree_text(value: float) -> str:
    """Seven decimals; zeros at the end go where the absolute value is below 1."""
    text = f"{value:.7f}"
    return text.rstrip("0").rstrip(".") if abs(value) < 1 else text


def _quoted(text: str) -> str:
    for plain, code in (("&", "&amp;"), ("'", "&apos;"), ("<", "&lt;"), ("\n", "&#xA;"), ("\r", "&#xD;"), ("\t", "&#x9;")):
        text = text.replace(plain, code)
    return text


def xml(elements: Iterable[dict], box: Box, policy: str = "remove") -> bytes:
    version = "0.5" if policy == "remove" else "0.6"
    out = [f"<?xml version='1.0' encoding='UTF-8'?>\n<osm version='{version}' generator='tessera'>\n"]
    out.append("<bounds minlat='%s' minlon='%s' maxlat='%s' maxlon='%s'/>\n" % tuple(map(degree_text, box)))
    for e in elements:
        name = {"n": "node", "w": "way", "r": "relation"}[e["kind"]]
        head = f"<{name} id='{e['id']}'"
        if e["kind"] == "n":
            head += f" lat='{degree_text(e['lat'])}' lon='{degree_text(e['lon'])}'"
        if policy != "remove":
            head += f" version='{written_version(e['version'], policy)}'"
        body = [f"<nd ref='{r}'/>\n" for r in e["refs"] or []] if e["kind"] == "w" else []
        if e["kind"] == "r":
            body += [f"<member type='{m['type']}' ref='{m['ref']}' role='{_quoted(m['role'])}'/>\n" for m in e["members"] or [] if m["type"]]
        body += [f"<tag k='{_quoted(t['k'])}' v='{_quoted(t['v'])}'/>\n" for t in e["tags"] or []]
        out.append(f"{head}>\n{''.join(body)}</{name}>\n" if body else f"{head}/>\n")
    return gzip.compress("".join([*out, "</osm>\n"]).encode("utf-8"), mtime=0)


def _pbf_blob(kind: str, data: bytes) -> bytes:
    body = field(2, len(data)) + field(3, zlib.compress(data))
    head = field(1, kind.encode()) + field(3, len(body))
    return len(head).to_bytes(4, "big") + head + body


class _Table:
    def __init__(self):
        self.at: dict[str, int] = {"": 0}

    def __call__(self, text: str) -> int:
        return self.at.setdefault(text, len(self.at))

    def message(self) -> bytes:
        return b"".join(field(1, s.encode("utf-8")) for s in self.at)


def _pbf_group(batch: list[dict], s: _Table, policy: str) -> bytes:
    kind = batch[0]["kind"]
    if kind == "n":
        flat = []
        for e in batch:
            flat += [x for t in e["tags"] or [] for x in (s(t["k"]), s(t["v"]))] + [0]
        n = len(batch)
        # dense information needs a version of 1 at least
        info = packed_field(1, [max(1, written_version(e["version"], policy)) for e in batch])
        zeros = b"".join(packed_field(k, [0] * n, True) for k in (2, 3, 4, 5))
        degrees = {k: [round(e[c] * 1e7) for e in batch] for k, c in ((8, "lat"), (9, "lon"))}
        dense = packed_field(1, delta([e["id"] for e in batch]), True) + field(5, info + zeros)
        dense += b"".join(packed_field(k, delta(v), True) for k, v in degrees.items())
        return field(2, dense + (packed_field(10, flat) if any(flat) else b""))
    out = b""
    for e in batch:
        tags = e["tags"] or []
        body = field(1, e["id"]) + packed_field(2, [s(t["k"]) for t in tags]) + packed_field(3, [s(t["v"]) for t in tags])
        version = written_version(e["version"], policy)
        if version:
            body += field(4, field(1, version))
        if kind == "w":
            body += packed_field(8, delta(e["refs"] or []), True)
        else:
            members = e["members"] or []
            body += packed_field(8, [s(m["role"]) for m in members]) + packed_field(9, delta([m["ref"] for m in members]), True)
            body += packed_field(10, [KINDS.index(m["type"]) for m in members])
        out += field(3 if kind == "w" else 4, body)
    return out


def pbf(elements: Iterable[dict], box: Box, policy: str = "remove") -> bytes:
    lat, lon, lat2, lon2 = (round(x * 1e9) for x in box)
    edges = b"".join(uint(k << 3) + sint(v) for k, v in ((1, lon), (2, lon2), (3, lat2), (4, lat)))
    head = field(1, edges) + b"".join(field(4, f.encode()) for f in KNOWN_FEATURES) + field(16, b"tessera")
    out = [_pbf_blob("OSMHeader", head)]
    batch: list[dict] = []

    def flush() -> None:
        if batch:
            s = _Table()
            group = _pbf_group(batch, s, policy)
            out.append(_pbf_blob("OSMData", field(1, s.message()) + field(2, group)))
            batch.clear()

    for e in elements:
        if len(batch) == BATCH or batch and batch[0]["kind"] != e["kind"]:
            flush()
        batch.append(e)
    flush()
    return b"".join(out)


class _Pairs:
    """String pairs by distance to their last use as a new entry."""

    def __init__(self):
        self.at: dict[tuple[bytes, ...], int] = {}
        self.n = 0

    def __call__(self, *parts: bytes) -> bytes:
        at = self.at.get(parts)
        if at is not None and self.n - at <= TABLE:
            return uint(self.n - at)
        if sum(map(len, parts)) <= PAIR_LENGTH:
            self.at[parts] = self.n
            self.n += 1
        return b"\0" + b"".join(p + b"\0" for p in parts)


def o5m(elements: Iterable[dict], box: Box, policy: str = "remove") -> bytes:
    """Coordinates are rounded to 1e-7 degrees."""
    edges = b"".join(sint(round(box[i] * 1e7)) for i in (1, 0, 3, 2))
    out = [b"\xff\xe0\x04o5m2\xdb", uint(len(edges)), edges]
    kind, pairs, last = None, _Pairs(), {}

    def step(name: str, value: int) -> bytes:
        d = value - last.get(name, 0)
        last[name] = value
        return sint(d)

    for e in elements:
        if e["kind"] != kind:
            kind, pairs, last = e["kind"], _Pairs(), {}
            out.append(b"\xff")
        version = written_version(e["version"], policy)
        body = step("id", e["id"]) + (uint(version) + b"\0" if version else b"\0")
        if kind == "n":
            body += step("lon", round(e["lon"] * 1e7)) + step("lat", round(e["lat"] * 1e7))
        elif kind == "w":
            refs = b"".join(step("ref", r) for r in e["refs"] or [])
            body += uint(len(refs)) + refs
        else:
            refs = b"".join(step(m["type"], m["ref"]) + pairs(f"{KINDS.index(m['type'])}{m['role']}".encode()) for m in e["members"] or [])
            body += uint(len(refs)) + refs
        body += b"".join(pairs(t["k"].encode(), t["v"].encode()) for t in e["tags"] or [])
        out += [bytes([NODE + "nwr".index(kind)]), uint(len(body)), body]
    return b"".join([*out, b"\xfe"])


#: File endings by output type.
ENDINGS = {"xml": ".osm.gz", "pbf": ".osm.pbf", "o5m": ".o5m"}
ENCODERS = {"xml": xml, "pbf": pbf, "o5m": o5m}
