"""Near copies by five-word shingles: SimHash trie self-join, settled by exact Jaccard similarity, 0.8 or more.

A document is the set of 64-bit hashes of its five-word shingles (a shorter text
is one shingle). Documents of equal sets are one node.

First the binary trie self-join (``simhash.links``) over the SimHash fingerprints of
the sets links nodes within ``BITS`` differing bits; the pairs of its spanning forest are
settled by the exact sets. This connects most copies and nearly all of a large
group, but a pair of similarity 0.8 differs in ten of 64 bits on average, beyond any
budget that a trie can search. So the rest is completed by a prefix join: two sets
of similarity 0.8 share a shingle among the first ``n - ceil(0.8 n) + 1`` of each in any
common order of shingles, so only these travel as (shingle, node, n) and meet by
shingle. The order puts rare shingles first: a table of ``SLOTS`` rough document counts
by hash, whatever the corpus. It decides the work only, never the result.

Of nodes that meet, pairs of one component need no further look; others are candidates
if their sizes and their sketches allow 0.8, bounds that never drop a pair of
that similarity. Near copies share most of their shingles, so a first round over one of ``FIRST``
shingles connects most of them, before a pair is offered once for each shingle it shares; the
rounds after it are over all shingles and the nodes that are still apart. Where more than
``CROWD`` nodes meet, a node first offers the one candidate of the nearest sketch, whatever the number of
other components, then, while they stay apart, sixteen
times as many in each round, until none is held back. So no link that could connect two
components is left out, and a first offer follows the group's size, not its square; pairs near the bound
that stay apart are all offered in the end.
What stays apart inside a crowd is compared by sketches in one task: the number
of those nodes times the crowd's.

Whole sets are read again for candidates only (and what collides with them in a bit map
of document ids) and intersected.

Defined results are those of ``simhash``: null, empty or blank texts are one node.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, map_docs, shared_checkpoint, shuffle_width

SHINGLE = 5
BITS = 3
SLOTS = 1 << 18
CROWD = 16
#: The first round is over one of so many shingles, those after it over all.
FIRST = 16
ASKED_BITS = 24
#: Bytes of text that are hashed at once.
PIECE = 1 << 18
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SLICES = 16
_SHIFT = np.uint64(64 - 18)


_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


#: One number for each byte; powers of an odd number and of its inverse modulo 2^64, as far as a piece of text needs.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = 0xD1342543DE82EF95
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_powers = [np.ones(1, dtype=np.uint64)] * 2


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, uint64 hash) of the words of UTF-8 text in lower case: differences of one running polynomial."""
    if len(data) >= len(_powers[0]):
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            x = np.full(max(1 << 20, len(data)) + 1, base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[raw] * _powers[0][: len(raw)])])
    return start, _mixed((run[end] - run[start]) * _powers[1][start])


def _pieces(texts: list[bytes]):
    """(numbers of texts, their starts, data): texts joined by line ends to pieces of about ``PIECE`` bytes; longer ones are cut at white space."""
    at, starts, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        while len(text) > PIECE and (cut := _GAP.search(text, PIECE)):
            yield [i], [0], text[: cut.start()]
            text = text[cut.start() :]
        at.append(i)
        starts.append(size)
        parts.append(text)
        size += len(text) + 1
        if size > PIECE:
            yield at, starts, b"\n".join(parts)
            at, starts, parts, size = [], [], [], 0
    if at:
        yield at, starts, b"\n".join(parts)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct uint64 hashes of each text's shingles."""
    words: list[list[np.ndarray]] = [[] for _ in texts]
    # on UTF-8 bytes lower() changes A-Z only
    for at, starts, data in _pieces([t.encode("utf-8", "surrogatepass").lower() for t in texts]):
        start, h = word_hashes(data)
        cuts = [*np.searchsorted(start, starts), len(h)]
        for i, s, e in zip(at, cuts[:-1], cuts[1:]):
            words[i].append(h[s:e])
    out = []
    for parts in words:
        w = parts[0] if len(parts) == 1 else np.concatenate(parts)
        n = min(len(w), SHINGLE)
        if n:
            h = np.full(len(w) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ w[k : len(w) - n + 1 + k]) * _MIX
                h ^= h >> np.uint64(31)
            w = np.unique(h * np.uint64(0x94D049BB133111EB))
        out.append(w)
    return out


def node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 29)


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def marked_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, sim, sketch) of each document, and (slice, counts): its task's counts of shingles by slot."""
    size = SLOTS // _SLICES

    def run(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets([t or "" for t in part.column(1).to_pylist()])
                total += np.bincount((np.concatenate(sets) >> _SHIFT).astype(np.int64), minlength=SLOTS)
                fp, sim = (np.array([f(s) for s in sets], dtype=np.uint64).view(np.int64) for f in (node, simhash.majority))
                yield out(part.column(0), pa.array(fp), pa.array(sim), pa.array([sketch(s) for s in sets], pa.binary()), None, None)
        if total.any():
            counts = [total[k * size : (k + 1) * size].tobytes() for k in range(_SLICES)]
            yield out(*[None] * 4, pa.array(range(_SLICES), pa.int32()), pa.array(counts, pa.binary()))

    def out(*columns):
        n = next(len(c) for c in columns if c is not None)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, k in zip(columns, kinds)], names=["doc_id", "fp", "sim", "sketch", "slice", "counts"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, fp long, sim long, sketch binary, slice int, counts binary")


def rarity(counts: DataFrame) -> np.ndarray:
    """uint8 for each slot of shingles: eight times the logarithm of its count, from (slice, counts)."""
    size = SLOTS // _SLICES

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(blob, dtype=np.int64)
        for k, x in sums.items():
            level = np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "level"])

    out = np.zeros(SLOTS, dtype=np.uint8)
    for r in counts.repartition(_SLICES, "slice").mapInArrow(add, "slice int, level binary").collect():  # 256 KB in all
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["level"], dtype=np.uint8)
    return out


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles' counts by slot of their low bits."""
    bits = min(8192, max(64, 4 << max(0, len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """``least_differences`` of two sketches."""
    x, y = int.from_bytes(a, "big"), int.from_bytes(b, "big")
    wide, bits = (x, len(a) * 8) if len(a) > len(b) else (y, len(b) * 8)
    small = y if len(a) > len(b) else x
    while bits > 8 * min(len(a), len(b)):
        bits //= 2
        wide = (wide >> bits) ^ (wide & ((1 << bits) - 1))
    return (wide ^ small).bit_count()


def least_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of sketches, as rows of bytes, [i, j] a lower bound of the symmetric difference: each shingle in it flips one parity."""
    while a.shape[1] != b.shape[1]:
        if a.shape[1] > b.shape[1]:
            a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
        else:
            b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def meet(batches):
    """The rows (key, sig, n) of shingles that several nodes hold."""
    held = [[batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)] for batch in batches]
    if not held:
        return
    key, sig, n = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.lexsort((sig, key))
    key, sig, n = key[order], sig[order], n[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])])
    key, sig, n = key[fresh], sig[fresh], n[fresh]
    same = key[1:] == key[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    key, sig, n = key[shared], sig[shared], n[shared]
    for at in range(0, len(key), 100_000):
        s = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(sig[s]), pa.array(n[s])], names=["key", "sig", "n"])


def candidates(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, sketches: list[bytes], most: int) -> tuple[list, list, bool]:
    """Of the nodes of one shingle the pairs of unlike components that may have similarity 0.8.

    Each node offers at most ``most`` nodes of all components that are larger here than its own, or
    follow it, those of the nearest sketches; the last value tells whether it holds back others.
    """
    _, comp, size = np.unique(comp, return_inverse=True, return_counts=True)
    rank = np.empty_like(size)
    rank[np.argsort(size, kind="stable")] = np.arange(len(size))
    comp = rank[comp]
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(sketches):
        by_length.setdefault(len(s), []).append(i)
    classes = [(np.array(at), np.frombuffer(b"".join(sketches[i] for i in at), dtype=np.uint8).reshape(len(at), -1)) for at in by_length.values()]
    us, vs, more = [], [], False
    for mine, a in classes:
        # Sketches of sets whose sizes allow 0.8 differ in length by a factor of two at most.
        others = [(at, b) for at, b in classes if b.shape[1] in (a.shape[1] // 2, a.shape[1], a.shape[1] * 2)]
        at = np.concatenate([x for x, _ in others])
        for start in range(0, len(mine), 64):
            i = mine[start : start + 64]
            difference = np.hstack([least_differences(a[start : start + 64], b) for _, b in others])
            fine = (9 * difference <= n[i][:, None] + n[at][None, :]) & (comp[i][:, None] < comp[at][None, :])
            fine &= 5 * np.minimum(n[i][:, None], n[at][None, :]) >= 4 * np.maximum(n[i][:, None], n[at][None, :])
            x, y = np.nonzero(fine)
            if not len(x):
                continue
            order = np.lexsort((sig[at[y]], difference[x, y], x))
            x, y = x[order], y[order]
            group = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            place = np.arange(len(x)) - np.repeat(group, np.diff(np.append(group, len(x))))
            keep = place < most
            more |= not keep.all()
            us.append(sig[i[x[keep]]])
            vs.append(sig[at[y[keep]]])
    return us, vs, more


def _few(key: np.ndarray, sig: np.ndarray, n: np.ndarray, comp: np.ndarray, sketches: list[bytes]):
    """Of rows in order of their keys, at most ``CROWD`` of each, all pairs of unlike components that may have similarity 0.8."""
    seen = np.zeros((0, 2), dtype=np.int64)
    place = {x: i for i, x in enumerate(sig.tolist())}  # equal nodes have equal sketches
    first = np.array([place[x] for x in sig.tolist()], dtype=np.int64)
    for step in range(1, CROWD):
        i = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else np.zeros(0, dtype=np.int64)
        if not len(i):
            break
        j = i + step
        i, j = (x[(comp[i] != comp[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))] for x in (i, j))
        pair = np.stack([np.minimum(first[i], first[j]), np.maximum(first[i], first[j])], 1)
        seen = np.unique(np.concatenate([seen, pair]), axis=0)
    for at in range(0, len(seen), 100_000):
        i, j = seen[at : at + 100_000].T
        near = np.fromiter((9 * least_difference(sketches[x], sketches[y]) <= m for x, y, m in zip(i.tolist(), j.tolist(), (n[i] + n[j]).tolist())), dtype=bool, count=len(i))
        yield sig[i[near]], sig[j[near]]


def _offer(most: int):
    def run(batches):
        """Rows (u, v, null) of candidates and (null, null, key) of shingles that hold back others, from (key, sig, n, comp, sketch)."""
        held = [([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)], batch.column(4).to_pylist()) for batch in batches]
        if not held:
            return
        key, sig, n, comp = (np.concatenate(x) for x in zip(*(a for a, _ in held)))
        sketches = [s for _, part in held for s in part]
        order = np.lexsort((sig, key))
        cuts = np.append(np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])), len(key))
        us, vs, back = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], []

        def emit() -> pa.RecordBatch:
            u, v = np.concatenate(us), np.concatenate(vs)
            pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
            keys = pa.concat_arrays([pa.nulls(len(pair), pa.int64()), pa.array(back, pa.int64())])
            nothing = pa.nulls(len(back), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(pair[:, 0]), nothing]), pa.concat_arrays([pa.array(pair[:, 1]), nothing]), keys], names=["u", "v", "key"])
            us[1:], vs[1:], back[:] = [], [], []
            return out

        large = np.diff(cuts) > CROWD
        few = order[np.repeat(~large, np.diff(cuts))]
        for u, v in _few(key[few], sig[few], n[few], comp[few], [sketches[i] for i in few]):
            us.append(u)
            vs.append(v)
            yield emit()
        for s, e in zip(cuts[:-1][large], cuts[1:][large]):
            at = order[s:e]
            if (comp[at] == comp[at[0]]).all():
                continue
            u, v, more = candidates(sig[at], n[at], comp[at], [sketches[i] for i in at], most)
            us += u
            vs += v
            if more:
                back.append(key[at[0]])
            if sum(map(len, us)) + len(back) > 100_000:
                yield emit()
        yield emit()

    return run


def _asked(ids: DataFrame) -> bytes:
    """A bit map of fixed size of the documents' ids, by hash."""
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - ASKED_BITS)
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits")).toArrow()
    out = np.zeros(1 << (ASKED_BITS - 6), dtype="<i8")
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def settled(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (u, v) of nodes whose whole sets have similarity 0.8 or more."""
    pairs = shared_checkpoint(pairs.select("u", "v").where("u <> v").distinct())
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_asked(wanted.join(nodes, "fp").select(F.col("least").alias("doc_id"))))
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - ASKED_BITS)

    def whole(batches):
        asked = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            slots = batch.column(0).to_numpy(zero_copy_only=False)
            chosen = batch.column(1).filter(pa.array((asked[slots >> 3] >> (slots & 7)) & 1 == 1))
            for at in range(0, len(chosen), 256):
                sets = shingle_sets([t or "" for t in chosen.slice(at, 256).to_pylist()])
                flat = np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                sig = np.array([node(s) for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["sig", "shingles"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(slot.alias("slot"), "text").mapInArrow(whole, "sig long, shingles array<long>")
    sets = read.join(wanted, F.col("sig") == F.col("fp"), "left_semi").dropDuplicates(["sig"])
    a, b = (sets.select(F.col("sig").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "uv")
    exact = pairs.join(a, "u").join(b, "v").withColumn("k", F.size(F.array_intersect("u_set", "v_set")))
    return shared_checkpoint(exact.where("5 * k >= 4 * (size(u_set) + size(v_set) - k)").select("u", "v"))


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): nodes of one fingerprint, and those whose fingerprints the trie self-join links."""
    heads = nodes.groupBy("sim").agg(F.min("fp").alias("head"))
    same = nodes.join(heads, "sim").where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v"))
    found = simhash.links(heads.select(F.col("sim").alias("fp")), BITS)
    for x in "uv":
        found = found.join(heads.select(F.col("sim").alias(x), F.col("head").alias(f"{x}_head")), x)
    return same.unionByName(found.select(F.col("u_head").alias("u"), F.col("v_head").alias("v")))


def prefixes(docs: DataFrame, level: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(key, sig, n): the rarest shingles of each set, of which two of similarity 0.8 share one."""

    def per_batch(ids: list, texts: list) -> dict:
        keys, sigs, sizes = [np.zeros(0, dtype=np.uint64)], [], []
        seen = set()
        for s in shingle_sets(texts):
            sig = node(s)
            if len(s) and sig not in seen:
                seen.add(sig)
                keys.append(s[np.argsort(level[s >> _SHIFT], kind="stable")[: prefix_length(len(s))]])
                sigs.append(sig)
                sizes.append(len(s))
        many = [len(k) for k in keys[1:]]
        return {
            "key": np.concatenate(keys).view(np.int64),
            "sig": np.repeat(np.array(sigs, dtype=np.uint64), many).view(np.int64),
            "n": np.repeat(np.array(sizes, dtype=np.int64), many),
        }

    return map_docs(docs, per_batch, "key long, sig long, n long", id_col, text_col)


def links(docs: DataFrame, marked: DataFrame, level: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(u, v): nodes connected just as all pairs of similarity 0.8 or more connect them."""
    width = shuffle_width(docs.sparkSession)
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("sim", "sketch")).alias("s")).select("fp", "least", "s.sim", "s.sketch")
    nodes = shared_checkpoint(nodes)
    edges = settled(docs, nodes, simhash_pairs(nodes), id_col, text_col)
    rows = prefixes(docs, level, id_col, text_col).repartition(width, "key").mapInArrow(meet, "key long, sig long, n long")
    met = shared_checkpoint(rows)
    most, first = 1, True
    while True:
        stars = connected_components(edges)
        asked = met.where(F.pmod("key", F.lit(FIRST)) == 0) if first else met
        placed = asked.join(stars, asked["sig"] == stars["node"], "left").select("key", "sig", "n", F.coalesce("component", "sig").alias("comp"))
        apart = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
        placed = placed.join(apart, "key", "left_semi").join(nodes.select(F.col("fp").alias("sig"), "sketch"), "sig")
        found = shared_checkpoint(placed.select("key", "sig", "n", "comp", "sketch").repartition(width, "key").mapInArrow(_offer(most), "u long, v long, key long"))
        stars = stars.select(F.col("node").alias("u"), F.col("component").alias("v"))
        edges = stars.unionByName(settled(docs, nodes, found.where("key IS NULL"), id_col, text_col))
        if first:
            first = False
            continue
        back = found.where("key IS NOT NULL").select("key")
        if back.isEmpty():
            return edges
        met = met.join(back, "key", "left_semi")
        most *= 16


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id); fp is the node."""
    found = shared_checkpoint(marked_documents(docs, id_col, text_col))
    level = rarity(found.where("slice IS NOT NULL").select("slice", "counts"))
    marked = found.where("slice IS NULL").select("doc_id", "fp", "sim", "sketch")
    return simhash.component_ids(marked, links(docs, marked, level, id_col, text_col))
