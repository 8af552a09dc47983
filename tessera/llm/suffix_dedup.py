"""Repeated-passage removal with induced-sorting suffix arrays.

A byte goes if it is covered by a ``LENGTH``-byte string that also starts
earlier (in a document of smaller id, or earlier in the same one).

Sharding by content. In every window of ``LENGTH`` bytes the ``GRAM``-byte gram of
least hash (leftmost on ties) is an anchor; equal windows have equal anchors at
equal offsets. A window therefore lies inside the context of its anchor
(``REACH`` bytes before it to ``LENGTH`` bytes from it), and all occurrences of a
window meet in the shard of the anchor's hash:

1. A map over whole texts finds the anchors in arrays (rolling hashes by
   doubling, sliding minimum by doubling) and deals them to shards, packed. A
   context that occurs again within the task sends only its first occurrence;
   the others are copies and go as they stand, so hot passages are
   pre-aggregated before the shuffle.
2. In a shard, anchors that occur once end here. Of equal contexts (a hash of 48 and one of 64
   bits) the earliest stays and the others are copies. Where different
   contexts share an anchor, their bytes are asked for; an anchor with many of
   them is split by the bytes beside its gram, so it fills no task.
3. A join by document brings the bytes; the contexts go to the shards again.
   Sides on which no other context of the anchor agrees are cut off. The
   shard's text, the distinct contexts side by side, gets its suffix
   array by induced sorting: suffixes are classified as S or L, the leftmost-S
   (LMS) substrings are sorted by induction and named, names are sorted
   recursively, and the array is induced from them in two linear passes. Permuted
   common prefixes are computed in text order; only irreducible ones
   are compared, the others are one less than the one before. Suffixes that share
   ``LENGTH`` bytes are neighbours in the array, and all but the earliest
   start of such a class are removed starts.
4. Intervals are merged by document and applied to the whole text.

Induction passes over a byte alphabet go bucket by bucket in arrays; deeper
levels, whose alphabets are large, run item by item.

Defined results: null is an empty text; equal rows count as one document (a repeated row
is no copy of itself, and both get the same result); rows of one doc_id and unlike
texts are documents of their own, in order of the texts' hashes; null ids sort first, in
that order too; among equal strings the earliest stays, so there are no ties; texts below
``LENGTH`` bytes lose nothing and very long ones are whole; an empty table gives no rows;
further columns are not read, whatever their names; unpaired surrogates
cannot occur in a Spark string.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, shuffle_width, table

LENGTH = 100
GRAM = 28
#: An anchor starts at most this far into its window.
REACH = LENGTH - GRAM
#: An anchor with more distinct contexts than this is split by the bytes beside its gram.
HOT = 2000
#: Bytes beside the gram that split a hot anchor.
BESIDE = 4
#: A string reaches so far beyond the gram on one side at least.
HALF = (LENGTH - GRAM) // 2
CHUNK_BYTES = 2_000_000
#: Bytes of distinct contexts in one suffix array, unless one anchor has more: what the caches hold sorts fastest.
SHARD_BYTES = 400_000
NO_ID = -(1 << 63)
_MUL = np.uint64(0x9E3779B97F4A7C15)


# ---- suffix arrays by induced sorting ----

def _classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the suffix after them; the end is below everything."""
    n = len(t)
    s = np.zeros(n, dtype=bool)
    if n < 2:
        return s
    less, equal = t[:-1] < t[1:], t[:-1] == t[1:]
    # runs of equal characters take the class of their last one
    fixed = np.where(~equal, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(fixed[::-1])[::-1]
    s[:-1] = np.append(less, False)[np.minimum(nxt, n - 1)]
    return s


def _induce_by_bucket(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """Suffix array induced from LMS suffixes in the order given, a bucket at a time."""
    n = len(t)
    count = np.bincount(t, minlength=k)
    end = np.cumsum(count)
    begin = end - count
    sa = np.full(n, -1, dtype=np.int32)
    order = np.argsort(t[lms], kind="stable")
    seeds = lms[order]
    seed_cut = np.searchsorted(t[seeds], np.arange(k + 1))
    filled = begin.copy()

    def push(p: np.ndarray) -> None:
        """Put predecessors behind what their buckets hold, in order."""
        c = t[p]
        if len(p) == 1:
            sa[filled[c[0]]] = p[0]
            filled[c[0]] += 1
            return
        o = np.argsort(c, kind="stable")
        c, p = c[o], p[o]
        runs = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(runs, len(c)))
        sa[np.repeat(filled[c[runs]], size) + np.arange(len(c)) - np.repeat(runs, size)] = p
        filled[c[runs]] += size

    push(np.array([n - 1]))  # the last suffix is L and follows the empty one
    for c in np.flatnonzero(count):
        at = begin[c]
        while at < filled[c]:  # rounds: an L suffix may bring one of its own bucket
            stop = filled[c]
            p = sa[at:stop] - 1
            p = p[p >= 0]
            p = p[~s[p]]
            if len(p):
                push(p)
            at = stop
        p = seeds[seed_cut[c] : seed_cut[c + 1]] - 1
        p = p[p >= 0]
        p = p[~s[p]]
        if len(p):
            push(p)
    tail = end.copy()

    def push_back(p: np.ndarray) -> None:
        """As push, from the buckets' ends; p comes in descending order."""
        c = t[p]
        o = np.argsort(c, kind="stable")
        c, p = c[o], p[o]
        runs = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(runs, len(c)))
        sa[np.repeat(tail[c[runs]], size) - 1 - (np.arange(len(c)) - np.repeat(runs, size))] = p
        tail[c[runs]] -= size

    for c in np.flatnonzero(count)[::-1]:
        at = end[c]
        while at > tail[c]:
            stop = tail[c]
            p = sa[stop:at][::-1] - 1
            p = p[p >= 0]
            p = p[s[p]]
            if len(p):
                push_back(p)
            at = stop
        p = sa[begin[c] : filled[c]][::-1] - 1  # its L suffixes
        p = p[p >= 0]
        p = p[s[p]]
        if len(p):
            push_back(p)
    return sa


def _induce_by_item(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same, item by item, for alphabets of the order of the text."""
    n = len(t)
    text, small = t.tolist(), s.tolist()
    count = np.bincount(t, minlength=k)
    end = np.cumsum(count)
    head, tail = (end - count).tolist(), end.tolist()
    sa = [-1] * n
    for p in reversed(lms.tolist()):
        c = text[p]
        tail[c] -= 1
        sa[tail[c]] = p
    c = text[n - 1]
    sa[head[c]] = n - 1
    head[c] += 1
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not small[p]:
            c = text[p]
            sa[head[c]] = p
            head[c] += 1
    tail = end.tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and small[p]:
            c = text[p]
            tail[c] -= 1
            sa[tail[c]] = p
    return np.array(sa, dtype=np.int32)


def _name_substrings(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Ranks of the LMS substrings (each up to the next LMS position, inclusive), equal ones sharing theirs.

    A radix sort by words of several symbols, leading word first; only ties go on
    to the next word. A symbol is a character with its class, L before S, which
    makes the substrings prefix-free; 0 stands behind the text's end.
    """
    n = len(t)
    bits = (2 * k + 1).bit_length()
    per_word = 63 // bits
    symbol = np.zeros(n + per_word, dtype=np.int64)
    symbol[:n] = 2 * t.astype(np.int64) + s + 1
    stop = np.append(lms[1:], n) + 1  # exclusive; the last one takes in the end
    rank = np.zeros(len(lms), dtype=np.int64)
    live = np.arange(len(lms))
    at = lms.astype(np.int64)
    while len(live):
        word = np.zeros(len(live), dtype=np.int64)
        p, e = at[live], stop[live]
        for j in range(per_word):
            word = word << bits
            inside = p + j < e
            word[inside] |= symbol[np.minimum(p[inside] + j, n)]
        order = np.lexsort((word, rank[live])) if rank[live[0]] or rank[live[-1]] or len(live) < len(lms) else np.argsort(word, kind="stable")
        r, w = rank[live][order], word[order]
        fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])
        # the rank of a group is the place of its first member, so that refining moves nobody else
        first = np.maximum.accumulate(np.where(np.concatenate([[True], r[1:] != r[:-1]]), np.arange(len(r)), 0))
        place = np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
        rank[live[order]] = r + place - first
        size = np.diff(np.append(np.flatnonzero(fresh), len(r)))
        tied = np.repeat(size > 1, size)
        live = np.sort(live[order][tied])
        at[live] += per_word
        live = live[at[live] < stop[live]]
    names, dense = np.unique(rank, return_inverse=True)
    return dense.astype(np.int32), len(names)


def suffix_array(t: np.ndarray, k: int | None = None) -> np.ndarray:
    """Suffix array of an integer text; a suffix that is a prefix of another comes first."""
    n = len(t)
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    t = t.astype(np.int32, copy=False)
    k = int(t.max()) + 1 if k is None else k
    induce = _induce_by_bucket if k <= 1024 else _induce_by_item
    s = _classify(t)
    is_lms = s.copy()
    is_lms[0] = False
    is_lms[1:] &= ~s[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) == 0:
        return induce(t, s, lms, k)
    name, n_names = _name_substrings(t, s, lms, k)
    if n_names < len(lms):
        ordered = lms[suffix_array(name, n_names)]
    else:
        ordered = np.empty_like(lms)
        ordered[name] = lms
    return induce(t, s, ordered, k)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """plcp[i]: common prefix of suffix i and its predecessor in the array; up to ``limit`` at least, exact below it."""
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = np.zeros(n, dtype=bool)
    reducible[1:] = (before[1:] > 0) & (t[:-1] == t[np.maximum(before[1:] - 1, 0)])
    plcp = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(~reducible & (before >= 0))
    # A value is carried on by later, reducible positions, each one less, so it is compared to its run's length past the limit.
    heads = np.flatnonzero(~reducible)
    run = np.diff(np.append(heads, n))
    most = np.zeros(n, dtype=np.int64)
    most[heads] = run + limit
    got = 0
    while len(live):
        a, b = live + got, before[live] + got
        ok = (a < n) & (b < n)
        ok[ok] = t[a[ok]] == t[b[ok]]
        plcp[live[ok]] = got + 1
        live = live[ok]
        got += 1
        live = live[most[live] > got]
    head = np.maximum.accumulate(np.where(~reducible, i, 0))
    return np.maximum(plcp[head] - (i - head), 0)


# ---- anchors and contexts ----

def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit hash of the gram at each position, by doubling; only positions with a whole gram are valid."""
    n = len(data)
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    out, done, width = None, 0, 1
    left = gram
    while left:
        if left & 1:
            if out is None:
                out = h.copy()
            else:
                out ^= out >> np.uint32(15)
                out *= np.uint32(0x85EBCA77)
                out[: max(n - done, 0)] += h[done:]
            done += width
        left >>= 1
        if left:
            mixed = h ^ (h >> np.uint32(16))
            mixed *= np.uint32(0xC2B2AE3D)
            mixed[: max(n - width, 0)] += h[width:]
            h = mixed
            width *= 2
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x27D4EB2F)
    return out ^ (out >> np.uint32(13))


def anchors(h: np.ndarray, span: int, valid: np.ndarray) -> np.ndarray:
    """Positions of the least hash, leftmost on ties, of the ``span`` consecutive grams from each valid start."""
    n = len(h)
    if n < span or not len(valid):
        return np.zeros(0, dtype=np.int64)
    low = (h.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)  # the place decides ties
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: n - span + 1], low[span - width : n - width + 1])
    marked = np.zeros(n, dtype=bool)
    marked[(low[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return np.flatnonzero(marked)


def document_anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, place, left, right, gram hash, context hash) of all anchors of the texts."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.cumsum(size)
    begin = end - size
    starts = np.maximum(size - LENGTH + 1, 0)
    which = np.repeat(np.arange(len(texts)), starts)
    valid = np.arange(len(which)) - np.repeat(np.cumsum(starts) - starts, starts) + begin[which]
    if not len(valid):
        zero = np.zeros(0, dtype=np.int64)
        return zero, zero, zero, zero, zero.astype(np.uint64), zero.astype(np.uint64)
    h = gram_hashes(data)[: len(data) - GRAM + 1]
    at = anchors(h, REACH + 1, valid)
    doc = np.searchsorted(end, at, side="right")
    left = np.minimum(at - begin[doc], REACH)
    right = np.minimum(end[doc] - at, LENGTH)
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(data)
    context = np.array([digest(view[a:b]) for a, b in zip((at - left).tolist(), (at + right).tolist())], dtype=np.uint64)
    # a context of another shape is another context, even where its bytes are equal
    context ^= (left * 256 + right).astype(np.uint64) * _MUL
    gram = np.array([digest(view[a : a + GRAM]) for a in at.tolist()], dtype=np.uint64)
    return doc, at - begin[doc], left, right, gram, context


ANCHOR = np.dtype([("h", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("place", "<u4"), ("left", "u1"), ("right", "u1")])


def _squeeze(rec: np.ndarray) -> bytes:
    """Columns one after the other, ids and places as differences, compressed; the low 48 bits of h are kept."""
    h = rec["h"].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    parts = [h.T.tobytes(), rec["context"].tobytes()]
    for k in ("doc", "place"):
        d = np.diff(rec[k].astype(np.int64), prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8)
        parts.append(d.T.tobytes())
    parts += [rec["left"].tobytes(), rec["right"].tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unsqueeze(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    n = len(raw) // 32
    rec = np.empty(n, dtype=ANCHOR)
    h = np.zeros((n, 8), dtype=np.uint8)
    h[:, :6] = raw[: 6 * n].reshape(6, n).T
    rec["h"] = h.view("<u8")[:, 0]
    rec["context"] = raw[6 * n : 14 * n].view("<u8")
    for i, k in enumerate(("doc", "place")):
        d = np.ascontiguousarray(raw[(14 + 8 * i) * n : (22 + 8 * i) * n].reshape(8, n).T).view("<i8")[:, 0]
        rec[k] = np.cumsum(d)
    rec["left"], rec["right"] = raw[30 * n : 31 * n], raw[31 * n :]
    return rec


def _earliest(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors with the earliest occurrence of each context, the copies); by h; one row an occurrence."""
    rec = rec[np.argsort(rec["h"])]
    if len(rec) < 2:
        return rec, rec[:0]
    tie = rec["h"][1:] == rec["h"][:-1]
    group = np.concatenate([[False], tie]) | np.concatenate([tie, [False]])  # most grams are alone
    own = rec[group]
    rec[group] = own = own[np.lexsort((own["place"], own["doc"], own["context"], own["h"]))]
    same = (own["h"][1:] == own["h"][:-1]) & (own["context"][1:] == own["context"][:-1])
    again = same & (own["doc"][1:] == own["doc"][:-1]) & (own["place"][1:] == own["place"][:-1])
    first = np.ones(len(rec), dtype=bool)
    copy = np.zeros(len(rec), dtype=bool)
    at = np.flatnonzero(group)[1:]
    first[at[same]] = False
    copy[at[same & ~again]] = True
    return rec[first], rec[copy]


def _reports(rec: np.ndarray, kind: int, hot: np.ndarray | bool = False) -> pa.RecordBatch:
    """(doc, start, stop, gram, h, hot): bytes start:stop of a document; h is null for a copy, else the anchor at ``gram`` bytes from start asks for them."""
    ask = np.full(len(rec), kind == 1)
    start = rec["place"].astype(np.int64) - rec["left"]
    return pa.RecordBatch.from_arrays([
        pa.array(rec["doc"]), pa.array(start.astype(np.int32)), pa.array((rec["place"].astype(np.int64) + rec["right"]).astype(np.int32)),
        pa.array(rec["left"].astype(np.int32)), pa.array(rec["h"].astype(np.int64), mask=~ask), pa.array(np.broadcast_to(hot, len(rec))),
    ], names=["doc", "start", "stop", "gram", "h", "hot"])


_REPORT = "doc long, start int, stop int, gram int, h long, hot boolean"


def _anchor_rows(docs: DataFrame, n_shards: int) -> DataFrame:
    """(shard, anchors, doc, start, stop, gram, h, hot): packed anchors for shards, and copies within a task (shard null)."""

    def run(batches):
        def chunk(ids: list, texts: list[bytes]):
            doc, place, left, right, h, context = document_anchors(texts)
            rec = np.empty(len(doc), dtype=ANCHOR)
            rec["doc"] = np.array(ids, dtype=np.int64)[doc]
            rec["place"], rec["left"], rec["right"], rec["h"], rec["context"] = place, left, right, h & np.uint64((1 << 48) - 1), context
            first, copies = _earliest(rec)
            shard = (first["h"] >> np.uint64(8)) % np.uint64(n_shards)
            first = first[np.lexsort((first["place"], first["doc"], shard))]
            shard = ((first["h"] >> np.uint64(8)) % np.uint64(n_shards)).astype(np.int64)
            cut = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard)) if len(shard) else [0]
            blobs = [_squeeze(first[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            n = len(blobs)
            if n:
                none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]]), pa.array(blobs, pa.binary()), *none], names=["shard", "anchors", "doc", "start", "stop", "gram", "h", "hot"])
            for at in range(0, len(copies), 100_000):
                rep = _reports(copies[at : at + 100_000], 0)
                yield pa.RecordBatch.from_arrays([pa.nulls(rep.num_rows, pa.int64()), pa.nulls(rep.num_rows, pa.binary()), *rep.columns], names=["shard", "anchors", "doc", "start", "stop", "gram", "h", "hot"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(text) >= LENGTH:
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
                if size >= CHUNK_BYTES:
                    yield from chunk(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from chunk(ids, texts)

    return docs.mapInArrow(run, f"shard long, anchors binary, {_REPORT}")


def _resolve(rows: DataFrame) -> DataFrame:
    """Reports of the shards' anchors: copies of equal contexts, and contexts to look into."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(_unsqueeze(blob))
                size += len(held[-1])
            if size > 4_000_000:  # copies leave at once; what stays is one row a distinct context
                first, copies = _earliest(np.concatenate(held))
                held, size = [first], len(first) // 2
                if len(copies):
                    yield _reports(copies, 0)
        if not held:
            return
        first, copies = _earliest(np.concatenate(held))
        h = first["h"]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(cut, len(h)))
        size = np.repeat(size, size)  # distinct contexts of each row's anchor
        near = size > 1
        hot = size[near] > HOT
        for rec, kind, flag in ((copies, 0, np.zeros(len(copies), dtype=bool)), (first[near], 1, hot)):
            for at in range(0, len(rec), 100_000):
                yield _reports(rec[at : at + 100_000], kind, flag[at : at + 100_000])

    return rows.select("anchors").mapInArrow(run, _REPORT)


def _split(h: int, c: bytes, g: int) -> tuple[list[tuple[int, int, int, bytes]], list[tuple[int, int, int, bytes]]]:
    """(parts, exact) of a context of a hot anchor, its gram at ``g``: (key, offset, gram, bytes) each.

    A string that starts o bytes before the gram reaches HALF beyond it on one
    side. With BESIDE bytes or more on the other side too, it agrees on those and on
    that half, which are the key of a part. The few strings with less there are
    listed one by one, by their hash.
    """
    def key(kind: bytes, data: bytes) -> int:
        return xxhash.xxh3_64_intdigest(kind + h.to_bytes(8, "big", signed=True) + data) >> 1

    parts, exact = [], []
    if g >= BESIDE and len(c) >= g + GRAM + HALF:
        cut = max(0, g - HALF)
        parts.append((key(b"R", c[g - BESIDE : g + GRAM + HALF]), cut, g - cut, c[cut:]))
    if g >= HALF and len(c) >= g + GRAM + BESIDE:
        parts.append((key(b"L", c[g - HALF : g + GRAM + BESIDE]), 0, g, c[: g + GRAM + HALF]))
    for o in (*range(BESIDE), *range(REACH - BESIDE + 1, REACH + 1)):
        if g >= o and len(c) >= g - o + LENGTH:
            one = c[g - o : g - o + LENGTH]
            exact.append((key(b"E", one), g - o, o, one))
    return parts, exact


def _contexts(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, doc, start, gram, bytes) of the contexts asked for; without bytes, a string that is known to repeat.

    Contexts of hot anchors are split. A single string that many of them hold is
    pre-aggregated: the task sends its earliest occurrence on and reports the others.
    """
    per = asked.groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "gram", "h", "hot")).alias("asks"))
    names = ["h", "doc", "start", "gram", "bytes"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        first: dict[int, tuple[int, int, int, bytes]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, asks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for a in asks:
                    c = data[a["start"] : a["stop"]]
                    if not a["hot"]:
                        rows.append((a["h"], doc, a["start"], a["gram"], c))
                        continue
                    parts, exact = _split(a["h"], c, a["gram"])
                    rows += [(k, doc, a["start"] + at, g, part) for k, at, g, part in parts]
                    for k, at, g, one in exact:
                        here = (doc, a["start"] + at, g, one)
                        known = first.setdefault(k, here)
                        if known[:2] != here[:2]:
                            first[k], later = (known, here) if known[:2] < here[:2] else (here, known)
                            rows.append((doc, later[0], later[1], later[2], None))
            if rows:
                yield batch_of(rows)
        left = [(k, *v) for k, v in first.items()]
        for at in range(0, len(left), 50_000):
            yield batch_of(left[at : at + 50_000])

    joined = per.join(docs, per["doc"] == docs["doc_id"]).select("doc", "text", "asks")
    return joined.mapInArrow(run, "h long, doc long, start int, gram int, bytes binary")


def removed_starts(contexts: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context number, offset) of the ``LENGTH``-byte strings that an earlier one of these contexts equals."""
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    t = np.zeros(int(size.sum()) + len(size), dtype=np.int32)
    cut = np.cumsum(size + 1) - (size + 1)
    body = np.ones(len(t), dtype=bool)
    body[cut + size] = False  # the separator 0
    t[body] = np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.int32) + 1
    sa = suffix_array(t, 257)
    plcp = permuted_lcp(t, sa, LENGTH)
    which = np.repeat(np.arange(len(size)), size + 1)
    offset = np.arange(len(t)) - cut[which]
    whole = offset + LENGTH <= size[which]  # a whole string before the separator
    inside = whole[sa]
    joined = inside & (plcp[sa] >= LENGTH)  # equal to the suffix before it
    member = joined.copy()
    member[:-1] |= joined[1:]
    group = np.cumsum(~joined)[member]
    at = sa[member]
    if not len(at):
        return at, at
    w, o = which[at], offset[at]
    d, p = doc[w], start[w] + o
    order = np.lexsort((p, d, group))
    g, d, p = group[order], d[order], p[order]
    lead = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size_of = np.diff(np.append(lead, len(g)))
    # the class's least (document, start) stays; equal ones are the same occurrence
    later = (d != np.repeat(d[lead], size_of)) | (p != np.repeat(p[lead], size_of))
    return w[order][later], o[order][later]


def _trimmed(part: list[tuple]) -> list[tuple]:
    """(doc, start, bytes) of the contexts that can share a whole string with another of the same anchor.

    Such a string reaches ``HALF`` bytes to one side of the anchor's gram at least. A side on
    which no other context agrees that far is cut to less than that, and a context
    that agrees on neither side goes.
    """
    digest = xxhash.xxh3_64_intdigest
    left = [(h, digest(c[g - HALF : g + GRAM])) if g >= HALF else None for h, _, _, g, c in part]
    right = [(h, digest(c[g : g + GRAM + HALF])) if len(c) >= g + GRAM + HALF else None for h, _, _, g, c in part]
    n_left, n_right = Counter(left), Counter(right)
    out = []
    for (_, doc, start, gram, c), a, b in zip(part, left, right):
        on_left, on_right = a is not None and n_left[a] > 1, b is not None and n_right[b] > 1
        if on_left or on_right:
            cut = 0 if on_left else max(0, gram - HALF + 1)
            end = len(c) if on_right else gram + GRAM + HALF - 1
            out.append((doc, start + cut, c[cut:end]))
    return out


def _sort_contexts(contexts: DataFrame, n_shards: int) -> DataFrame:
    """(doc, start, stop) of what the suffix arrays find repeated."""

    def found(part: list[tuple]) -> pa.RecordBatch:
        part = _trimmed(part)
        doc = np.array([x[0] for x in part], dtype=np.int64)
        start = np.array([x[1] for x in part], dtype=np.int64)
        w, o = removed_starts([x[2] for x in part], doc, start) if part else (doc, doc)
        order = np.lexsort((o, w))
        w, o = w[order], o[order]
        # runs of neighbouring starts make one interval
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1] + 1)]) if len(w) else np.zeros(0, dtype=bool)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(w))[: len(head)] - 1
        return pa.RecordBatch.from_arrays([
            pa.array(doc[w[head]]), pa.array((start[w[head]] + o[head]).astype(np.int32)), pa.array((start[w[tail]] + o[tail] + LENGTH).astype(np.int32)),
        ], names=["doc", "start", "stop"])

    def run(batches):
        part, size, last = [], 0, None
        for batch in batches:
            known = pc.is_null(batch.column(4))
            if pc.any(known).as_py():
                one = batch.filter(known)
                yield pa.RecordBatch.from_arrays([one.column(1), one.column(2), pc.add(one.column(2), pa.scalar(LENGTH, pa.int32()))], names=["doc", "start", "stop"])
                batch = batch.filter(pc.invert(known))
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_BYTES and row[0] != last:  # an anchor's contexts stay together
                    yield found(part)
                    part, size = [], 0
                part.append(row)
                size += len(row[4]) + 1
                last = row[0]
        if part:
            yield found(part)

    return contexts.repartition(n_shards, "h").sortWithinPartitions("h").mapInArrow(run, "doc long, start int, stop int")


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(doc, start, stop), overlapping: bytes of documents to remove; ``docs`` has doc_id and text."""
    spark = docs.sparkSession
    n_shards = shuffle_width(spark)
    rows = _anchor_rows(docs, n_shards)
    own = rows.where("shard IS NULL").select("doc", "start", "stop", "gram", "h", "hot")
    dealt = rows.where("shard IS NOT NULL").select("shard", "anchors").repartition(n_shards, "shard")
    reports = shared_checkpoint(_resolve(dealt))
    copies = reports.where("h IS NULL").unionByName(own)
    sorted_out = _sort_contexts(_contexts(reports.where("h IS NOT NULL"), docs), n_shards)
    return copies.select("doc", "start", "stop").unionByName(sorted_out)


def keyed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(doc_id, text): ``docs`` with the documents' numbers in order; and the id of the row as given.

    A number is the id itself, or the least long for a row without one, unless rows of one id differ. Then all rows
    are numbered by (id, hash of the text): by range, with the ranges' sizes on the driver.
    """
    known = docs.withColumns({"own": F.col("doc_id"), "h": F.xxhash64("text")})
    mixed = known.groupBy("own").agg(F.min("h").alias("a"), F.max("h").alias("b")).where((F.col("a") != F.col("b")) | (F.col("own") == NO_ID))
    if mixed.isEmpty():  # no further column, so both joins with the texts share one shuffle
        return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text"), F.nullif(F.col("doc_id"), F.lit(NO_ID))
    width = shuffle_width(docs.sparkSession)
    order = [F.col("own").asc_nulls_first(), F.col("h")]
    ranked = shared_checkpoint(known.select("own", "h").distinct().repartitionByRange(width, *order).sortWithinPartitions(*order))
    sizes = {r["part"]: r["count"] for r in ranked.groupBy(F.spark_partition_id().alias("part")).count().collect()}  # a row for each partition
    before = np.cumsum([0, *[sizes.get(k, 0) for k in range(max(sizes) + 1)]])

    def number(batches):
        at = int(before[TaskContext.get().partitionId()])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.arange(at, at + batch.num_rows))], names=["r_own", "r_h", "number"])
            at += batch.num_rows

    numbers = shared_checkpoint(ranked.mapInArrow(number, "r_own long, r_h long, number long"))
    met = known.join(numbers, F.col("own").eqNullSafe(F.col("r_own")) & (F.col("h") == F.col("r_h")))
    return shared_checkpoint(met.select(F.col("number").alias("doc_id"), "text", "own")), F.col("own")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): ``kept`` holds the remaining bytes."""
    docs, own = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    cut = repeated_intervals(docs.select("doc_id", "text")).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))

    def run(batches):
        for batch in batches:
            out: dict = {"doc_id": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for text, cuts in zip(batch.column(1), batch.column(2).to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = [(s, min(e, len(data))) for s, e in _merged([(c["start"], c["stop"]) for c in cuts or []]) if s < len(data)]
                at, kept = 0, []
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
            kinds = (None, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([v if k is None else pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    joined = docs.join(cut, docs["doc_id"] == cut["doc"], "left").select(own.alias("doc_id"), "text", "cuts")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")
