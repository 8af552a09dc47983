"""Language-model scoring with a hierarchical Pitman-Yor model.

Tokens are words and one end; the context of a token is the word
before it, by a 16-bit hash (``CLASSES``; class 0 before the first word), so rare words
of a large vocabulary share a context with others. Each
context has a restaurant; all of them share one parent, the unigram
restaurant, whose own parent is uniform over the training vocabulary and one
unknown word. A table of a context restaurant is a customer of the parent.

Seating is sampled by Gibbs sweeps in blocks: for a dish (word) in a restaurant
all customers are taken out and seated again one by one, each opening a new
table with the Chinese-restaurant probability given all other tables. Only
the numbers of tables matter for prediction. After ``EXACT`` customers the
seating goes on in steps of a sixteenth of those seated, so a dish with any
number of customers takes a logarithmic number of steps. The totals of tables
of each restaurant, which couple the dishes, come from the sweep before: they
are ``CLASSES`` numbers, whatever the corpus. Uniform numbers are hashes of
(sweep, dish, restaurant, step), so reruns agree and lost tasks repeat
themselves. The predictive probabilities are averaged over the ``SAMPLES`` last
sweeps.

Everything is keyed by the word. A map over the texts writes postings, one
row for each distinct word of a chunk of documents: who holds it, in which
context, how often. Such rows without the documents, summed by word, are the
dishes' customers; the postings follow the word's model, once, in sorted order and leave as
partial sums by document. Documents are known by their chunk and place in it, so rows that
share an id are told apart. A
common word has one row a chunk; its model holds at
most ``CLASSES`` contexts. The at most ``HOT`` words that are a hundredth of all tokens
or more are dealt to ``SALTS`` tasks by chunk. Words travel as 64-bit hashes. The state is a few
compressed rows a task, checkpointed after each sweep.

Defined results: null or empty text has one token, the end; every row is scored by its own
text, whether or not others share its doc_id, and a null doc_id is held out; words of
equal count are one case, there are no ties to settle; very long texts are whole; an empty
table gives no rows; further columns are not read, whatever their names; without
training documents the unknown word has probability 1 (score 0, base per the
formula with N = V = 0).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, shuffle_width, table

FOLDS = 10
CLASSES = 65536
BURN_IN = 1
SAMPLES = 2
EXACT = 48
DISCOUNTS = (0.75, 0.75)
STRENGTHS = (1.0, 1.0)
#: Bytes of text that a task counts at once, and words of one state row.
CHUNK_BYTES = 10_000_000
SHARD_WORDS = 10_000
#: Words that are so great a part of all tokens have their documents dealt to ``SALTS`` tasks.
HOT = 100
SALTS = 8
#: Sums of documents that a task holds before it sends them on.
HELD = 1_000_000
END = b"\n"  # no word holds white space


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 17)


def word_class(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(CLASSES - 1)).astype(np.int64) + 1


def tokens(text: bytes) -> list[bytes]:
    """On UTF-8 bytes lower() changes A-Z only and split() knows just the six white-space bytes."""
    return [*text.lower().split(), END]


def uniform(*keys) -> np.ndarray:
    """Counter-based uniform numbers in (0, 1), one for each row of the broadcast keys."""
    x = np.full(1, 0x9E3779B97F4A7C15, dtype=np.uint64)  # an array, so that products wrap
    for k in keys:
        x = (x ^ np.asarray(k).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(29))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def seat(customers: np.ndarray, new_mass: np.ndarray, growth: np.ndarray, discount: float, *keys) -> np.ndarray:
    """Tables of each dish after seating its customers anew.

    ``new_mass`` is (strength + discount * tables of other dishes) * parent
    probability and ``growth`` what each own table adds to it.
    """
    tables = (customers > 0).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    seated, step = 1, 0
    keys = [np.broadcast_to(np.asarray(k), customers.shape) for k in keys]
    while len(live):
        block = 1 if seated < EXACT else seated // 16
        t, c = tables[live], customers[live]
        n = np.minimum(block, c - seated)
        new = new_mass[live] + growth[live] * t
        p = new / (new + seated - discount * t)
        u = uniform(step, *[k[live] for k in keys])
        # one customer: a coin; a block: its expectation, rounded at random
        tables[live] = np.minimum(t + np.floor(n * p + u), c)
        seated += block
        step += 1
        live = live[c > seated]
    return tables


class Chunk:
    """Distinct (word, document, context) triples of some texts, sorted, with counts."""

    def __init__(self, texts: list[bytes]):
        ids: dict[bytes, int] = {}
        flat, sizes = [], []
        for text in texts:
            w = [ids.setdefault(t, len(ids)) for t in tokens(text)]
            flat.append(np.array(w, dtype=np.int32))
            sizes.append(len(w))
        self.hashes = np.array([word_hash(w) for w in ids], dtype=np.uint64)
        self.word = np.concatenate(flat)
        self.place = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        first = np.cumsum([0, *sizes[:-1]])
        self.context = np.empty(len(self.word), dtype=np.uint16)
        self.context[1:] = word_class(self.hashes)[self.word[:-1]]
        self.context[first] = 0

    def grouped(self, by_document: bool) -> tuple[np.ndarray, ...]:
        """(word, place, context, count) of distinct triples; without documents place is 0."""
        places = int(self.place[-1]) + 1 if by_document else 1
        key = self.word.astype(np.int64)
        if by_document:
            key *= places
            key += self.place
        key *= CLASSES
        key += self.context
        key.sort()
        cuts = _cuts(key)
        count = np.diff(cuts).astype(np.int32)
        key = key[cuts[:-1]]
        context = (key % CLASSES).astype(np.uint16)
        key //= CLASSES
        return (key // places).astype(np.int32), (key % places).astype(np.int32), context, count


def _cuts(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the length at the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)) if len(x) else np.zeros(1, dtype=np.int64)


def _binary(entries: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column: row i holds the records cuts[i]:cuts[i+1] of a packed array."""
    offsets = (cuts * entries.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])


def _records(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(row number, record) of all packed records in a binary column; null is empty."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // dtype.itemsize
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, dtype=np.uint8)
    return np.repeat(np.arange(len(column)), size), data.view(dtype)


def _gathered(batches, rows: int, size: int, *columns: int):
    """Batches of about so many rows and bytes of some columns.

    Array operations then cost per value and not per call, and what they expand
    follows the bytes: the rows of a common word are large and stand together.
    """
    held, n, held_bytes = [], 0, 0
    for batch in batches:
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + size - held_bytes, side="right")))
            stop = min(stop, at + max(1, rows - n), batch.num_rows)
            held.append(batch.slice(at, stop - at))
            n += stop - at
            held_bytes += int(ends[stop - 1]) - before
            at = stop
            if n >= rows or held_bytes >= size or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n, held_bytes = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _chunks(batches, chunk_bytes: int):
    """Lists of (ids, texts) from batches of (doc_id, text)."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            text = text.as_py() or b""
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= chunk_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


COUNT = np.dtype([("context", "<u2"), ("n", "<u4")])
MODEL = np.dtype([("context", "<u2"), ("n", "<u8"), ("tables", "<f4")])
#: A document of a chunk; null ids are marked.
ROW = np.dtype([("id", "<i8"), ("null", "u1"), ("tokens", "<i8")])
_SLICES = 16


def training_counts(docs: DataFrame) -> DataFrame:
    """(word, counts): one row for each training word of a chunk."""

    def run(batches):
        for ids, texts in _chunks(batches, CHUNK_BYTES):
            texts = [t for i, t in zip(ids, texts) if not held_out(i)]
            if not texts:
                continue
            chunk = Chunk(texts)
            word, _, context, count = chunk.grouped(False)
            cuts = _cuts(word)
            rec = np.empty(len(word), dtype=COUNT)
            rec["context"], rec["n"] = context, count
            yield pa.RecordBatch.from_arrays([pa.array(chunk.hashes[word[cuts[:-1]]].view(np.int64)), _binary(rec, cuts)], names=["word", "counts"])

    return docs.mapInArrow(run, "word long, counts binary")


class Shard:
    """Seating of some words: arrays over words and over (word, context) pairs."""

    FIELDS = (("words", "<u8"), ("cuts", "<i8"), ("context", "<u2"), ("n", "<u8"), ("t", "<f8"), ("t_sum", "<f8"), ("s", "<f8"), ("past", "<f8"))

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    def pack(self) -> bytes:
        parts = [getattr(self, k).astype(t).tobytes() for k, t in self.FIELDS]
        head = np.array([len(p) for p in parts], dtype="<i8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))

    @classmethod
    def unpack(cls, blob: bytes) -> Shard:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        at = 8 * len(cls.FIELDS)
        arrays = {}
        for (k, t), size in zip(cls.FIELDS, np.frombuffer(raw[:at], dtype="<i8")):
            arrays[k] = np.frombuffer(raw[at : at + size], dtype=t)
            at += size
        return cls(**arrays)

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.words)), np.diff(self.cuts))

    def parents(self) -> np.ndarray:
        """Customers of each word in the parent: its tables in all contexts."""
        return np.bincount(self.of, self.t, len(self.words))

    def totals(self) -> np.ndarray:
        """Tables by context, customers by context, then words, tables and customers of the parent."""
        own = [np.bincount(self.context, self.t, CLASSES), np.bincount(self.context, self.n.astype(np.float64), CLASSES)]
        return np.concatenate([*own, [len(self.words), self.s.sum(dtype=np.float64), self.parents().sum()]])

    def sweep(self, number: int, totals: np.ndarray, keep: bool) -> None:
        d0, d1 = DISCOUNTS
        a0, a1 = STRENGTHS
        tables, (words, tables0, customers0) = totals[:CLASSES], totals[2 * CLASSES :]
        base = 1.0 / (words + 1)
        of, t = self.of, self.t.astype(np.float64)
        # the parent's probability without what this dish itself sends up
        others = self.parents()[of] - t
        parent = (np.maximum(0, others - d0 * np.minimum(self.s[of], others)) + (a0 + d0 * tables0) * base) / (a0 + customers0)
        mass = (a1 + d1 * (tables[self.context] - t)) * parent
        self.t = seat(self.n.astype(np.int64), mass, d1 * parent, d1, number, self.words[of], self.context)
        up = self.parents()
        self.s = seat(up.astype(np.int64), (a0 + d0 * (tables0 - self.s)) * base, np.full(len(up), d0 * base), d0, number, self.words, CLASSES)
        if keep:
            self.t_sum = self.t_sum + self.t
            self.past = np.concatenate([self.past, up, self.s])


def _emit_shard(shard: Shard) -> pa.RecordBatch:
    totals = zstandard.ZstdCompressor(level=1).compress(shard.totals().tobytes())
    return pa.RecordBatch.from_arrays([pa.array([shard.pack()], pa.binary()), pa.array([totals], pa.binary())], names=["shard", "totals"])


def shards(counts: DataFrame) -> DataFrame:
    """(shard, totals): words dealt by hash, customers summed, one table for each dish to start from."""

    def run(batches):
        keys, sums, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w, c, n = (np.concatenate(x) for x in zip(*keys))
            order = np.lexsort((c, w))
            w, c, n = w[order], c[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])]))
            return w[at], c[at], np.add.reduceat(n, at)

        for batch in batches:
            word = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, rec = _records(batch.column(1), COUNT)
            keys.append((word[row], rec["context"], rec["n"].astype(np.int64)))
            held += len(row)
            if held > 1_500_000:  # sums so far: memory follows the distinct pairs, not the rows
                keys = [merged()]
                held = len(keys[0][0]) // 2
        if not keys:
            return
        w, c, n = merged()
        cuts = _cuts(w)
        for at in range(0, len(cuts) - 1, SHARD_WORDS):
            own = cuts[at : at + SHARD_WORDS + 1]
            p = slice(own[0], own[-1])
            ones = np.ones(own[-1] - own[0])
            yield _emit_shard(Shard(words=w[own[:-1]], cuts=own - own[0], context=c[p], n=n[p], t=ones, t_sum=ones * 0, s=np.ones(len(own) - 1), past=np.zeros(0)))

    width = shuffle_width(counts.sparkSession)
    return counts.repartition(width, "word").mapInArrow(run, "shard binary, totals binary")


def _totals(state: DataFrame) -> np.ndarray:
    """The sum of all shards' totals: by task, then by slice, of which each holds a sixteenth of the numbers."""
    size = -(-(2 * CLASSES + 3) // _SLICES)

    def by_task(batches):
        total = np.zeros(_SLICES * size)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total[: 2 * CLASSES + 3] += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob))
        parts = pa.array([total[k * size : (k + 1) * size].tobytes() for k in range(_SLICES)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), parts], names=["slice", "sums"])

    def by_slice(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(blob)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slice", "sums"])

    kind = "slice int, sums binary"
    out = np.zeros(_SLICES * size)
    for r in state.select("totals").mapInArrow(by_task, kind).repartition(_SLICES, "slice").mapInArrow(by_slice, kind).collect():  # 2 * CLASSES + 3 numbers
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["sums"])
    return out[: 2 * CLASSES + 3]


def sample(counts: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """Seating after all sweeps, and the totals after each kept sweep."""
    state = shared_checkpoint(shards(counts))
    totals = _totals(state)
    kept = []
    for number in range(BURN_IN + SAMPLES):
        keep = number >= BURN_IN

        def run(batches, number=number, totals=totals, keep=keep):
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    shard = Shard.unpack(blob)
                    shard.sweep(number, totals, keep)
                    yield _emit_shard(shard)

        state = shared_checkpoint(state.mapInArrow(run, "shard binary, totals binary"))
        totals = _totals(state)
        if keep:
            kept.append(totals)
    return state, kept


def _unigram(customers: np.ndarray, tables: np.ndarray, totals: np.ndarray) -> np.ndarray:
    d0, a0 = DISCOUNTS[0], STRENGTHS[0]
    words, tables0, customers0 = totals[2 * CLASSES :]
    return (customers - d0 * tables + (a0 + d0 * tables0) / (words + 1)) / (a0 + customers0)


def hot_words(state: DataFrame, train_tokens: int) -> np.ndarray:
    """Hashes of the words that are one of ``HOT`` training tokens or more often, so ``HOT`` words at most."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                sh = Shard.unpack(blob)
                n = np.add.reduceat(sh.n.astype(np.int64), sh.cuts[:-1]) if len(sh.words) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sh.words[n * HOT >= max(1, train_tokens)].view(np.int64))], names=["word"])

    return np.sort(np.array([r["word"] for r in state.select("shard").mapInArrow(run, "word long").collect()], dtype=np.int64))


_ROWS = "word long, salt int, posted boolean, chunk long, width int, entries binary, pairs binary, parents binary"


def model_rows(state: DataFrame, kept: list[np.ndarray], hot: np.ndarray) -> DataFrame:
    """(word, salt, .., pairs, parents): records of a word's contexts, its parent probability in each sample; a hot word's for each salt."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                sh = Shard.unpack(blob)
                rec = np.empty(len(sh.n), dtype=MODEL)
                rec["context"], rec["n"], rec["tables"] = sh.context, sh.n, sh.t_sum / len(kept)
                past = sh.past.reshape(len(kept), 2, len(sh.words))
                parents = np.stack([_unigram(past[k, 0].astype(float), past[k, 1].astype(float), kept[k]) for k in range(len(kept))], 1)
                words = sh.words.view(np.int64)
                for at in range(0, len(words), 2000):
                    cuts = sh.cuts[at : at + 2001]
                    end = at + len(cuts) - 1
                    columns = [_binary(rec[cuts[0] : cuts[-1]], cuts - cuts[0]), _binary(np.ascontiguousarray(parents[at:end]).reshape(-1), np.arange(end - at + 1) * len(kept))]
                    own = pa.array(words[at:end])
                    is_hot = pa.array(np.isin(words[at:end], hot))
                    for salt in range(SALTS):
                        if salt:
                            own, columns = own.filter(is_hot), [c.filter(is_hot) for c in columns]
                            is_hot = pa.array(np.ones(len(own), dtype=bool))
                        if len(own):
                            nothing = [pa.nulls(len(own), t) for t in (pa.int64(), pa.int32(), pa.binary())]
                            yield _row_batch(own, np.full(len(own), salt), False, *nothing, *columns)

    return state.select("shard").mapInArrow(run, _ROWS)


def _row_batch(word: pa.Array, salt: np.ndarray, posted: bool, *columns: pa.Array) -> pa.RecordBatch:
    names = [c.split()[0] for c in _ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([word, pa.array(salt, pa.int32()), pa.array(np.full(len(word), posted)), *columns], names=names)


def _entry(width: int) -> np.dtype:
    return np.dtype([("place", f"<u{width}"), ("context", "<u2"), ("n", "u1")])


def postings(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(word, salt, .., chunk, width, entries): which rows of a chunk hold the word; of width 0 the rows themselves.

    A chunk is named by a hash of all that is in it, so chunks of one name are equal.
    """

    def run(batches):
        for ids, texts in _chunks(batches, CHUNK_BYTES):
            rows = np.zeros(len(ids), dtype=ROW)
            rows["null"] = [i is None for i in ids]
            rows["id"] = [0 if i is None else i for i in ids]
            chunk = Chunk(texts)
            rows["tokens"] = np.bincount(chunk.place, minlength=len(ids))
            name = xxhash.xxh64(rows.tobytes(), 19)
            for t in texts:
                name.update(t)
            name = int(np.uint64(name.intdigest()).astype(np.int64))
            model = lambda n: [pa.nulls(n, pa.binary())] * 2
            yield _row_batch(pa.array([name]), np.zeros(1), True, pa.array([name]), pa.array([0], pa.int32()), pa.array([rows.tobytes()], pa.binary()), *model(1))
            word, place, context, count = chunk.grouped(True)
            width = 2 if len(ids) <= 1 << 16 else 4
            parts = (count + 254) // 255  # a count takes as many entries of at most 255 as it needs
            at = np.repeat(np.arange(len(word)), parts)
            rec = np.empty(len(at), dtype=_entry(width))
            rec["place"], rec["context"] = place[at], context[at]
            full = np.full(len(at), 255)
            full[np.cumsum(parts) - 1] = count - 255 * (parts - 1)
            rec["n"] = full
            cuts = _cuts(word[at])
            for s in range(0, len(cuts) - 1, 50_000):
                own = cuts[s : s + 50_001]
                n = len(own) - 1
                words = chunk.hashes[word[at[own[:-1]]]].view(np.int64)
                salt = np.where(np.isin(words, hot), name % SALTS, 0)
                yield _row_batch(pa.array(words), salt, True, pa.array(np.full(n, name)), pa.array(np.full(n, width, dtype=np.int32)), _binary(rec[own[0] : own[-1]], own - own[0]), *model(n))

    return docs.mapInArrow(run, _ROWS)


SUM = np.dtype([("place", "<u4"), ("known", "<f8"), ("base", "<f8"), ("score", "<f8")])


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """One record a place."""
    places, at = np.unique(np.concatenate([p["place"] for p in parts]), return_inverse=True)
    out = np.empty(len(places), dtype=SUM)
    out["place"] = places
    for k in SUM.names[1:]:
        out[k] = np.bincount(at, np.concatenate([p[k] for p in parts]), len(places))
    return out


def _partial_sums(met: DataFrame, kept: list[np.ndarray]) -> DataFrame:
    """(chunk, sums, rows): packed sums of a chunk's rows over words of a task, and the rows of each chunk.

    Sums leave once ``HELD`` of them are held, so memory does not follow the documents.
    """
    d1, a1 = DISCOUNTS[1], STRENGTHS[1]
    held = kept[-1][CLASSES : 2 * CLASSES]
    words, total = kept[-1][2 * CLASSES], held.sum()
    back_off = [(a1 + d1 * k[:CLASSES]) / (a1 + held) for k in kept]  # by context
    unseen = np.array([_unigram(np.zeros(1), np.zeros(1), k)[0] for k in kept])

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> int:
            chunk, rec = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.argsort(chunk, kind="stable")
            chunk, rec = chunk[order], rec[order]
            cuts = _cuts(chunk)
            for s, e in zip(cuts[:-1], cuts[1:]):
                c = int(chunk[s])
                sums[c] = _summed([rec[s:e], *([sums[c]] if c in sums else [])])
            return sum(map(len, sums.values()))

        def emit():
            for c, rec in sums.items():
                yield packed([c], [zstandard.ZstdCompressor(level=1).compress(rec.tobytes())], [None])
            sums.clear()

        def packed(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "sums", "rows"])

        size, last = 0, None
        for batch in _gathered(batches, 40_000, 2_000_000, 5, 6):
            if last is not None:  # the model of the last word, whose postings may go on here
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            word, posted = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            chunk, width = (pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False) for c in (3, 4))
            models = np.flatnonzero(~posted)
            if len(models):
                last = batch.slice(int(models[-1]), 1)
            named = np.flatnonzero(posted & (width == 0))
            if len(named):
                yield packed(chunk[named], [None] * len(named), batch.column(5).take(pa.array(named)).to_pylist())
            # each posting's model row: the last one before it, if it is of its word
            model = np.maximum.accumulate(np.where(posted, -1, np.arange(len(word))))
            model = np.where((model >= 0) & (word[model] == word), model, len(word))
            m_row, m = _records(batch.column(6), MODEL)
            seen = np.bincount(m_row, m["n"], len(word) + 1)  # training count of the model row's word
            plain = np.log10((seen + 0.1) / (total + 0.1 * (words + 1)))
            parents = np.tile(unseen, (len(word) + 1, 1))
            p_row, p = _records(batch.column(7), np.dtype("<f8"))
            parents[p_row[:: len(kept)]] = p.reshape(-1, len(kept))
            m_key = m_row * CLASSES + m["context"]
            m_value = (m["n"] - d1 * m["tables"].astype(np.float64)) / (a1 + held[m["context"]])
            for w in np.unique(width[width > 0]):
                rows = np.flatnonzero(width == w)
                e_row, e = _records(batch.column(5).take(pa.array(rows)), _entry(int(w)))
                of, e_row = chunk[rows][e_row], model[rows][e_row]
                context = e["context"]
                key = e_row * CLASSES + context
                prob = sum(b[context] * parents[e_row, k] for k, b in enumerate(back_off)) / len(kept)
                if len(m_key):
                    at = np.minimum(np.searchsorted(m_key, key), len(m_key) - 1)
                    prob += np.where(m_key[at] == key, m_value[at], 0.0)
                n = e["n"].astype(np.float64)
                rec = np.empty(len(e), dtype=SUM)
                rec["place"], rec["known"], rec["base"], rec["score"] = e["place"], n * (seen[e_row] > 0), n * plain[e_row], n * np.log10(prob)
                parts.append((of, rec))
                size += len(rec)
            if size > 500_000:
                size = 0
                if settle() > HELD:
                    yield from emit()
        if parts:
            settle()
        yield from emit()

    return met.mapInArrow(run, "chunk long, sums binary, rows binary")


def _document_sums(partial: DataFrame, train_tokens: int) -> DataFrame:
    """The result: a chunk's rows and their partial sums meet by its name. Of equal chunks, each has its share of the sum."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, tuple[int, bytes]] = {}
        for batch in batches:
            for c, blob, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if blob is None:
                    rows[c] = (rows[c][0] + 1 if c in rows else 1, own)
                else:
                    rec = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=SUM)
                    sums[c] = _summed([sums[c], rec]) if c in sums else rec
        for c, (times, own) in rows.items():
            row, rec = np.frombuffer(own, dtype=ROW), sums.pop(c)  # every row has an end, so every place a sum
            doc_id = pa.array(row["id"], mask=row["null"] > 0)
            for _ in range(times):
                yield pa.RecordBatch.from_arrays([
                    doc_id, pa.array([held_out(i) for i in doc_id.to_pylist()], pa.bool_()), pa.array(row["tokens"]),
                    pa.array(np.rint(rec["known"] / times).astype(np.int64)), pa.array(np.full(len(row), train_tokens)), pa.array(rec["base"] / times), pa.array(rec["score"] / times),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    width = shuffle_width(partial.sparkSession)
    return partial.repartition(width, "chunk").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    state, kept = sample(training_counts(docs))
    train_tokens = int(kept[-1][CLASSES : 2 * CLASSES].sum())
    hot = hot_words(state, train_tokens)
    width = shuffle_width(docs.sparkSession)
    met = postings(docs, hot).unionByName(model_rows(state, kept, hot)).repartition(width, "word", "salt").sortWithinPartitions("word", "salt", "posted")
    return _document_sums(_partial_sums(met, kept), train_tokens)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity by token of held-out and training documents."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
