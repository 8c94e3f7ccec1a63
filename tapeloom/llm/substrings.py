"""Exact substring dedup: bytes covered by a LENGTH-byte string that also starts in a document with a smaller id.

0. Of equal texts (by 96 bits of their MD5) only the first is looked at further: the others are covered whole.
1. Every LENGTH-byte window is named by its anchor, the GRAM-byte string in it with the smallest hash; strings that a sample
   shows to be frequent come last, so that a passage in very many documents names only windows inside itself. Equal windows
   have equal anchors. Spark brings the anchor hashes together in buckets; those of two texts or more are
   shared, and only windows with shared anchors go on.
2. Neighbouring windows with one anchor form a segment of at most 2 * LENGTH - GRAM bytes. Equal segments are put together
   before they are shuffled by anchor, with the smallest and largest id that have them, so everything that can match meets
   in one place, once for each task that found it and not once for each document.
3. Two windows that are equal agree in the bytes around their anchor, so a segment that agrees with no other of its anchor in any of
   the AROUND stretches has no window that another has. A collection of the other segments gets its Burrows-Wheeler transform and common prefixes column by column: each round
   puts one more symbol of every segment in front and inserts its suffix where the occurrences of that symbol say. Transform,
   prefix lengths and suffixes are in sequential files, read and written block by block; in memory are a place for each
   segment and a block. Runs of suffixes whose common prefixes reach LENGTH are equal windows; the smallest id of a run decides.
4. What was found for a segment is joined to the documents that have it, and by document to the texts.

Documents themselves meet only the anchors and the spans found for them, compressed and by a hash of id and text.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm.batches import slices
from tapeloom.sources import read_table, written

LENGTH, GRAM = 50, 20
#: Segments whose transform is made together, and rows of its files that are in memory at a time.
COLLECTION = 20_000
BLOCK_ROWS = 1 << 19
#: Bytes before and behind the anchor that all windows have whose anchor is at place 0 to 7, 8 to 15, 16 to 23, 24 to 30.
AROUND = [(low, LENGTH - GRAM - min(low + 7, LENGTH - GRAM)) for low in range(0, LENGTH - GRAM + 1, 8)]
#: Documents' bytes whose anchors are packed together, and segments that are made distinct together.
BLOCK_BYTES = 3_000_000
BUFFER = 60_000
#: Bytes of text whose anchors make a bucket.
BUCKET_BYTES = 20_000_000
#: Buckets are dealt to as many partitions, up to this number; with fewer, small partitions would be put together and their buckets held by one task.
MOST_PARTITIONS = 10_000
#: Documents of the sample that shows frequent strings: this number, or one in SAMPLE_ONE_IN where that is more; the sampled
#: documents that make a string frequent; the most strings handed out (8 bytes each). They decide on the order of strings, never on a result.
SAMPLE_DOCUMENTS, SAMPLE_ONE_IN, SAMPLE_ROW_BYTES = 600, 3000, 65_536
FREQUENT_IN, FREQUENT_MOST = 5, 1_000_000
#: Level at which texts are compressed for the shuffle.
PACK_LEVEL = 1
_PLACE = np.uint64((1 << 30) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(1 << 63)
#: Common prefixes are told up to this length.
_LONGEST = 65_534


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes (16 to 32) from each place: 16 bytes by doubling, then the first and the last 16."""
    with np.errstate(over="ignore"):
        level = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        factor, width = _ODD, 1
        while width < 16:
            level = level[:-width] * factor + level[width:]
            factor, width = factor * factor, width * 2
        n = len(raw) - GRAM + 1
        h = level[:n] * (factor ^ _ODD) + level[GRAM - 16 :]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(32)


class Frequent:
    """A set of gram hashes: a table by their leading bits says no at once for most others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.shift = np.uint64(64 - min(24, len(hashes).bit_length() + 5))
        self.table = np.zeros(1 << 64 - int(self.shift), bool)
        self.table[self.hashes >> self.shift] = True

    def among(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` that hold a hash of the set."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[h >> self.shift])
        return at[self.hashes[np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)] == h[at]]


NONE_FREQUENT = Frequent(np.zeros(0, np.uint64))


@functools.lru_cache(maxsize=1)
def _frequent(raw: bytes) -> Frequent:
    return Frequent(np.frombuffer(raw, np.uint64))


def anchors(raw: np.ndarray, frequent: Frequent = NONE_FREQUENT, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the anchor of every window of ``raw``, the gram hashes, and which grams are frequent; empty where no window fits."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    h = gram_hashes(raw)
    rank, often, at = h >> np.uint64(1), np.zeros(len(h), bool), frequent.among(h)
    rank[at] |= _LAST
    often[at] = True
    least = (rank & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, over = 1, length - GRAM + 1
    while width * 2 <= over:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < over:
        least = np.minimum(least[: len(least) - (over - width)], least[over - width :])
    return (least & _PLACE).astype(np.int64), h, often


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values (of all columns together) begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        np.not_equal(columns[0][1:], columns[0][:-1], out=new[1:])
        for c in columns[1:]:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _packs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of the stretches of ``values`` between ``bounds`` (of all of them) as binary values, without a copy for each."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _middle(h: np.ndarray) -> np.ndarray:
    """The bits of hashes that are told: 40 behind the leading byte, which the bucket tells; a chance agreement only lets a text be looked at further."""
    return h >> np.uint64(16) & np.uint64((1 << 40) - 1)


def _short(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 40 in five bytes each, one after another."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _long(raw: bytes) -> np.ndarray:
    """Numbers from five bytes each."""
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64)[:, 0]


def frequent_grams(docs: DataFrame, rows: int) -> bytes:
    """Sorted hashes (8 bytes each, FREQUENT_MOST at most) of the strings in FREQUENT_IN or more documents of a sample."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                if len(raw) >= LENGTH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(gram_hashes(raw)).view(np.int64))], names=["h"])

    share = min(1.0, max(SAMPLE_DOCUMENTS, rows / SAMPLE_ONE_IN) / max(1, rows))
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))
    sampled = docs.where(drawn & (F.octet_length("text") <= SAMPLE_ROW_BYTES)).select("text")
    often = sampled.mapInArrow(grams, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT_IN)
    found = often.orderBy(F.desc("count"), "h").limit(FREQUENT_MOST).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.view(np.uint64)).tobytes()


def _pack_anchors(buckets: int, frequent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, v1, v2, text) to rows (bucket, keys, counts, hashes) with the anchors of a block of documents, document by document.

    Frequent strings are shared for certain and stay out.
    """
    known = _frequent(frequent.value)
    for batch in batches:
        for part in slices(batch, 3, BLOCK_BYTES):
            hashes, owners = [], []
            for n, text in enumerate(part.column(3)):
                at, h, often = anchors(np.frombuffer(text.as_py().encode(), np.uint8), known)
                if len(at):
                    at = at[_begins(at)]
                    names = h[at[~often[at]]]
                    names.sort()
                    hashes.append(names[_begins(names)])
                    owners.append(np.full(len(hashes[-1]), n, np.int32))
            if not hashes or not sum(map(len, hashes)):
                continue
            h, own = np.concatenate(hashes), np.concatenate(owners)
            bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65_536 else bucket, kind="stable")  # within a bucket by document, within a document by hash
            bucket, h, own = bucket[order], _middle(h[order]), own[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(h)]
            keys = np.stack([part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            rows = []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                first = np.flatnonzero(np.r_[True, own[x + 1 : y] != own[x : y - 1]])
                counts = np.diff(np.r_[first, y - x]).astype(np.uint16)
                local = own[x:y][first]
                rows.append((int(bucket[x]), keys[:2, local].tobytes() + keys[2, local].astype(np.int32).tobytes(), counts.tobytes(), _short(h[x:y])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "counts", "hashes"])


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole buckets, in order, to rows (id, v1, v2, hash) with the anchors that other texts under other ids have too.

    Of equal texts only the one with the smallest id goes on; all of them have the same anchors, so every bucket
    chooses the same one.
    """
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        h = _long(b"".join([x[2] for x in held]))
        counts = np.concatenate([np.frombuffer(x[1], np.uint16) for x in held]).astype(np.int64)
        ids, v1, v2 = np.empty(len(counts), np.int64), np.empty(len(counts), np.int64), np.empty(len(counts), np.int32)
        at = 0
        for keys, some, _ in held:
            n = len(some) // 2
            ids[at : at + n], v1[at : at + n] = np.frombuffer(keys, np.int64, 2 * n).reshape(2, n)
            v2[at : at + n] = np.frombuffer(keys, np.int32, n, 16 * n)
            at += n
        held.clear()
        one_of = np.lexsort((ids, v2, v1))
        lead = np.zeros(len(ids), bool)
        lead[one_of[np.r_[True, (v1[one_of][1:] != v1[one_of][:-1]) | (v2[one_of][1:] != v2[one_of][:-1])]]] = True
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        some = lead[doc]
        h, doc = h[some], doc[some]
        if not len(h):
            return
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        own = ids[doc]
        keep = np.repeat(np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first), np.diff(np.r_[first, len(h)]))
        h, doc = h[keep], doc[keep]
        for at in range(0, len(h), 200_000):
            some = doc[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(v1[some]), pa.array(v2[some]), pa.array(h[at : at + 200_000].view(np.int64))], names=["id", "v1", "v2", "hash"])

    last = None
    for batch in batches:
        pa.default_memory_pool().release_unused()
        for at in range(batch.num_rows):
            bucket, *row = (c[at].as_py() for c in batch.columns)
            if held and bucket != last:
                yield from flush()
            last = bucket
            held.append(tuple(row))
    if held:
        yield from flush()


def _cut_segments(frequent: Frequent, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Documents (doc, id, packed text, lists of shared hashes) to buffers (anchors, segments, their order, their hashes, docs, ids, starts, places of the anchors in them); all but the segments are sorted by anchor and hash."""
    unpack, digest = zstandard.ZstdDecompressor().decompress, xxhash.xxh3_64_intdigest
    held: list[list] = [[], [], [], [], [], [], []]

    def flush() -> tuple:
        segments = held[1]
        anchor, doc, id_, start, place, counts = (np.concatenate([np.asarray(x, t) for x in held[k]]) for k, t in ((0, np.uint64), (2, np.int64), (3, np.int64), (4, np.int32), (5, np.int8), (6, np.int64)))
        hashes = np.fromiter(map(digest, segments), np.uint64, len(segments))
        order = np.lexsort((hashes, anchor))
        owner = np.repeat(np.arange(len(counts)), counts)[order]
        out = anchor[order].view(np.int64), list(segments), order, hashes[order].view(np.int64), doc[owner], id_[owner], start[order], place[order]
        for x in held:
            x.clear()
        return out

    for batch in batches:
        lists = batch.column(3)
        bounds, values = lists.offsets.to_numpy().tolist(), lists.values.to_numpy().view(np.uint64)
        for doc, id_, packed, x, y in zip(*[c.to_pylist() for c in batch.columns[:3]], bounds[:-1], bounds[1:], strict=True):
            raw = unpack(packed)
            at, h, often = anchors(np.frombuffer(raw, np.uint8), frequent)
            if not len(at):
                continue
            first = _begins(at)
            chosen = at[first]
            names, found = h[chosen], often[chosen]
            if y > x:
                known, short = np.sort(values[x:y]), _middle(names)
                found = found | (known[np.minimum(np.searchsorted(known, short), y - x - 1)] == short)
            some = np.flatnonzero(found)
            if len(some):
                stops = np.append(first[1:], len(at))[some] + (LENGTH - 1)
                starts = first[some]
                held[0].append(names[some])
                held[1] += [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                held[2].append([doc])
                held[3].append([id_])
                held[4].append(starts)
                held[5].append(chosen[some] - starts)
                held[6].append([len(some)])
            if len(held[1]) >= BUFFER:
                yield flush()
    if held[1]:
        yield flush()


def _heads(anchor: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where a run of equal anchors and hashes begins."""
    return _begins(anchor, hashes)


def _distinct_segments(frequent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to rows (anchor, segment, least, most, place): the distinct segments of a buffer, with the smallest and largest id that have them and the place of the anchor."""
    for anchor, segments, order, hashes, _, ids, _, place in _cut_segments(_frequent(frequent.value), batches):
        first = _heads(anchor, hashes)
        strings = pa.array([segments[i] for i in order[first].tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), strings, pa.array(np.minimum.reduceat(ids, first)), pa.array(np.maximum.reduceat(ids, first)), pa.array(place[first])], names=["anchor", "segment", "least", "most", "place"])


def _segment_owners(frequent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to rows (anchor, hash, docs, ids, starts): who has each distinct segment of a buffer, and where it starts there."""
    for anchor, _, _, hashes, docs, ids, starts, _ in _cut_segments(_frequent(frequent.value), batches):
        first = _heads(anchor, hashes)
        bounds = np.append(first, len(anchor))
        yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), pa.array(hashes[first]), *[_packs(c, bounds) for c in (docs, ids, starts)]], names=["anchor", "hash", "docs", "ids", "starts"])


class Columns:
    """The transform, the common prefixes and the suffixes of a collection, in order, each in a sequential file.

    A round reads the files of the round before block by block and writes new ones.
    """

    def __init__(self, folder: str, size: int, block_rows: int | None = None):
        self.folder, self.round, self.block_rows = folder, 0, min(block_rows or BLOCK_ROWS, 1 << 22)
        #: The symbol in front of a suffix, its common prefix with the one before it, its place in a text of that size.
        self.types = (np.uint8, np.uint16, np.uint32 if size < 1 << 32 else np.int64)

    def _paths(self, number: int) -> list[str]:
        return [os.path.join(self.folder, f"{number}-{k}") for k in range(len(self.types))]

    def blocks(self, some: int = 3) -> Iterator[list[np.ndarray]]:
        """Blocks of the first ``some`` files, one after another."""
        files = [open(p, "rb") for p in self._paths(self.round)[:some]]
        try:
            while len((block := [np.fromfile(f, t, self.block_rows) for f, t in zip(files, self.types, strict=False)])[0]):
                yield block
        finally:
            for f in files:
                f.close()

    def write(self, blocks) -> None:
        """Write the files of the next round and give up those of this one."""
        files = [open(p, "wb") for p in self._paths(self.round + 1)]
        for block in blocks:
            for f, a, t in zip(files, block, self.types, strict=True):
                a.astype(t, copy=False).tofile(f)
        for f in files:
            f.close()
        for p in self._paths(self.round):
            if os.path.exists(p):
                os.remove(p)
        self.round += 1


class Insertions:
    """Where the suffixes of a round go: one sequential reading of the transform and the common prefixes.

    ``at`` are the places of the suffixes that were inserted last, in order. The suffix with one more symbol in front stands
    among those that begin with this symbol as its tail stands among the tails, so the occurrences of the symbol up to it are counted.
    A common prefix changes where a suffix is put in and just after it; there it is one more than the smallest between the two tails.
    """

    def __init__(self, columns: Columns, at: np.ndarray, base: np.ndarray):
        self.targets = np.empty(len(at), np.int64)
        self.changed: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.values: list[np.ndarray] = [np.zeros(0, np.int64)]
        start, before, seen, fresh_last = 0, np.zeros(256, np.int64), np.zeros(256, bool), np.zeros(256, bool)
        smallest = np.full(256, _LONGEST, np.int64)  # of the common prefixes since the last occurrence of a symbol
        for bwt, lcp in columns.blocks(2):
            n = len(bwt)
            lo, hi = np.searchsorted(at, (start, start + n))
            # the occurrences of each symbol in this block, in order: symbol, place in the block, whether it was inserted last
            found = bwt.astype(np.uint32) << np.uint32(24) | np.arange(0, 2 * n, 2, dtype=np.uint32)
            found[at[lo:hi] - start] |= np.uint32(1)
            found.sort()
            sizes = np.bincount(bwt, minlength=256)
            first = np.cumsum(sizes) - sizes
            shift = base + before - first

            def place(k: np.ndarray, found: np.ndarray = found) -> np.ndarray:
                return (found[k] >> np.uint32(1) & np.uint32(0x7FFFFF)).astype(np.int64)

            new = np.flatnonzero(found & np.uint32(1))
            target = new + shift[found[new] >> np.uint32(24)]
            self.targets[np.searchsorted(at, place(new) + start)] = target
            k = np.concatenate([new, new[new < n - 1] + 1])
            symbol = found[k] >> np.uint32(24)
            k, symbol = k[inside := (k > first[symbol]) & (symbol > 0)], symbol[inside]
            if len(k):
                bounds = np.stack([place(k - 1) + 1, place(k) + 1], axis=1).ravel()
                self._change(k + shift[symbol], np.minimum.reduceat(np.r_[lcp, np.uint16(0)], bounds)[::2])
            symbols = np.flatnonzero(sizes)
            heads, tails = first[symbols], first[symbols] + sizes[symbols] - 1
            meets = np.flatnonzero(seen[symbols] & (symbols > 0) & ((found[heads] & np.uint32(1) > 0) | fresh_last[symbols]))
            for i in meets.tolist():
                self._change(heads[i : i + 1] + shift[symbols[i]], np.minimum(smallest[symbols[i : i + 1]], lcp[: int(place(heads[i : i + 1])[0]) + 1].min()))
            smallest = np.minimum(smallest, int(lcp.min()))
            smallest[symbols] = [int(lcp[x:].min()) if x < n else _LONGEST for x in (place(tails) + 1).tolist()]
            seen[symbols], fresh_last[symbols] = True, found[tails] & np.uint32(1) > 0
            before += sizes
            start += n

    def _change(self, at: np.ndarray, least: np.ndarray) -> None:
        self.changed.append(at)
        self.values.append(np.minimum(least, _LONGEST - 1).astype(np.int64) + 1)


def _merged(columns: Columns, at: np.ndarray, symbols: np.ndarray, places: np.ndarray, changed: np.ndarray, values: np.ndarray, rows: int) -> Iterator[list[np.ndarray]]:
    """The blocks of the files with the new suffixes put in at ``at`` (sorted) and common prefixes changed."""
    behind, start = at - np.arange(len(at)), 0
    for block in columns.blocks():
        n = len(block[0])
        stop = start + n
        lo, hi = np.searchsorted(behind, start, "left"), np.searchsorted(behind, stop, "right" if stop == rows else "left")
        begin = start + lo
        new = at[lo:hi] - begin
        kept = np.ones(n + hi - lo, bool)
        kept[new] = False
        out = []
        for old, fresh, t in zip(block, (symbols[lo:hi], 0, places[lo:hi]), columns.types, strict=True):
            a = np.empty(len(kept), t)
            a[kept], a[new] = old, fresh
            out.append(a)
        x, y = np.searchsorted(changed, (begin, begin + len(kept)))
        out[1][changed[x:y] - begin] = values[x:y]
        yield out
        start = stop


def column_wise_transform(strings: list[bytes], columns: Columns) -> np.ndarray:
    """Fill ``columns`` with the suffixes of a collection; returns the places at which the strings end.

    The text of the collection is a 0, then each string, symbols one above their bytes (UTF-8 has no byte 255), and a 0. The empty
    suffixes come first, in the order of the strings, each smaller than the next. Common prefixes are told up to 65,534.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]) + 1, np.uint8)
    inside = np.ones(len(text), bool)
    inside[0] = inside[ends] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    places = ends
    symbols, rows = text[places - 1], m
    columns.write([[symbols[i : i + columns.block_rows], np.zeros(len(symbols[i : i + columns.block_rows])), places[i : i + columns.block_rows]] for i in range(0, m, columns.block_rows)])
    counts = np.bincount(symbols, minlength=256)
    at = np.arange(m)
    while True:
        going = symbols > 0
        at, places = at[going], places[going] - 1
        if not len(at):
            return ends
        put = Insertions(columns, at, m + np.cumsum(np.r_[0, 0, counts[1:-1]]))
        changed, values = np.concatenate(put.changed), np.concatenate(put.values)
        order = np.argsort(changed, kind="stable")
        by_target = np.argsort(put.targets, kind="stable")
        at, places = put.targets[by_target], places[by_target]
        symbols = text[places - 1]
        columns.write(_merged(columns, at, symbols, places, changed[order], values[order], rows))
        counts += np.bincount(symbols, minlength=256)
        rows += len(at)


def least_owner(strings: list[bytes], owner: np.ndarray, folder: str, length: int = LENGTH, block_rows: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(string, window start, smallest owner of an equal window) for every window of every string, run after run."""
    sizes = np.array([len(s) for s in strings], np.int64)
    columns = Columns(folder, int(sizes.sum()) + len(strings) + 1, block_rows)
    ends = column_wise_transform(strings, columns)
    begins, string_at = ends - sizes, np.repeat(np.arange(len(strings), dtype=np.int32), sizes + 1)
    rest = [np.zeros(0, np.uint16), np.zeros(0, np.int64)]

    def told(lcp: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        string = string_at[place - 1]
        whole = ends[string] - place >= length
        run = np.cumsum(~(whole & (lcp >= length)))  # a suffix that shares less than a window begins a run
        at = np.flatnonzero(whole)
        string, place, run = string[at], place[at], run[at]
        if not len(at):
            return string, place, string
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        return string, place - begins[string], np.repeat(np.minimum.reduceat(owner[string], first), np.diff(np.r_[first, len(at)]))

    for _, lcp, place in columns.blocks():
        lcp, place = np.r_[rest[0], lcp], np.r_[rest[1], place.astype(np.int64)]
        cut = np.flatnonzero(lcp < length)
        cut = int(cut[-1]) if len(cut) else 0
        rest = [lcp[cut:], place[cut:]]
        if cut:
            yield told(lcp[:cut], place[:cut])
    yield told(*rest)


def agreeing(group: np.ndarray, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a segment may have a window that another one of its group has: one of the AROUND stretches about its anchor is in both, by a hash.

    ``raw`` has the segments' bytes; segments of a group differ. A chance agreement only lets a segment be looked at further.
    """
    out = np.zeros(len(group), bool)
    with np.errstate(over="ignore"):
        factors = np.cumprod(np.full(LENGTH, _ODD)) | np.uint64(1)
        for before, behind in AROUND:
            some = np.flatnonzero((place >= before) & (sizes - place - GRAM >= behind))
            steps = np.r_[np.arange(-before, 0), np.arange(GRAM, GRAM + behind)]
            h = group[some].view(np.uint64) * _ODD
            at = begins[some] + place[some]
            for step, factor in zip(steps.tolist(), factors, strict=False):
                h += (raw[at + step] + np.uint64(1)) * factor
            h ^= h >> np.uint64(29)
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            out[some[order[1:][same]]] = out[some[order[:-1][same]]] = True
    return out


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, segment, least, most, place) sorted by anchor and segment to rows (anchor, hash, runs): for segments of which something can go
    the stretches (begin, stop) under the smaller id ``by``, eight bytes each.

    A segment that is the only one of its anchor, or agrees with none of it about the anchor, has none to be ordered among: all its windows start under its
    smallest id. Without places only the former are told.
    """
    rest: pa.Table | None = None

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, least, most = (table.column(n).to_numpy() for n in ("anchor", "least", "most"))
        segment = table.column("segment").combine_chunks()
        first = np.flatnonzero(np.r_[True, pc.not_equal(segment[1:], segment[:-1]).to_numpy(zero_copy_only=False) | (anchor[1:] != anchor[:-1])])
        owner, most, group = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first), anchor[first]
        distinct = segment.take(pa.array(first))
        sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        alone = np.r_[True, group[1:] != group[:-1]] & np.r_[group[1:] != group[:-1], True]
        if "place" in table.column_names and not alone.all():
            many = np.flatnonzero(~alone)
            begins, place = (np.cumsum(sizes) - sizes)[many], table.column("place").to_numpy().astype(np.int64)[first][many]
            alone[many] = ~agreeing(group[many], np.frombuffer(distinct.buffers()[2], np.uint8), begins, sizes[many], place)
        some = np.flatnonzero(alone & (owner < most))
        found = [(some, np.zeros(len(some), np.int64), sizes[some], owner[some])]
        others = np.flatnonzero(~alone)
        if len(others):
            with tempfile.TemporaryDirectory() as folder:
                string, offset, by = (np.concatenate(x) for x in zip(*least_owner(distinct.take(pa.array(others)).to_pylist(), owner[others], folder), strict=True))
            string = others[string]
            gone = by < most[string]
            string, offset, by = string[gone], offset[gone], by[gone]
            order = np.lexsort((offset, string))
            string, offset, by = string[order], offset[order], by[order]
            head = np.r_[True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1) | (by[1:] != by[:-1])][: len(string)]
            tail = np.r_[head[1:], True][: len(string)]
            found.append((string[head], offset[head], offset[tail] + LENGTH, by[head]))
        string, begin, stop, by = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(string):
            return
        cuts = np.flatnonzero(np.r_[True, string[1:] != string[:-1]])
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.take(pa.array(string[cuts])).to_pylist()), np.uint64, len(cuts)).view(np.int64)
        runs = _packs(np.stack([begin, stop, by], axis=1).ravel(), np.append(cuts, len(string)) * 3)
        yield pa.RecordBatch.from_arrays([pa.array(group[string[cuts]]), pa.array(hashes), runs], names=["anchor", "hash", "runs"])

    for batch in batches:
        pa.default_memory_pool().release_unused()
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows >= COLLECTION:
            ends = rest.column("anchor").chunk(rest.column("anchor").num_chunks - 1)
            last = ends[len(ends) - 1].as_py()
            cut = rest.num_rows
            for chunk in reversed(rest.column("anchor").chunks):
                at = int(np.searchsorted(chunk.to_numpy(), last))
                cut -= len(chunk) - at
                if at:
                    break
            if cut:
                yield from work(rest.slice(0, cut))
                rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield from work(rest)


def _each(counts: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with ``counts`` items in a flat list: every item ``times`` of its row over, and which time it is."""
    many = np.repeat(times, counts)
    item = np.repeat(np.arange(len(many)), many)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (docs, ids, starts, runs) to rows (doc, id, spans): bytes to remove as pairs of start and stop, four bytes each, joined where they touch."""
    for batch in batches:
        docs, ids, starts, runs = (c.to_pylist() for c in batch.columns)
        owners, n_runs = np.array([len(x) // 8 for x in docs], np.int64), np.array([len(x) // 24 for x in runs], np.int64)
        doc, id_ = (np.frombuffer(b"".join(x), np.int64) for x in (docs, ids))
        start, run = np.frombuffer(b"".join(starts), np.int32).astype(np.int64), np.frombuffer(b"".join(runs), np.int64).reshape(-1, 3)
        item, which = _each(owners, n_runs)
        row = np.repeat(np.arange(len(owners)), owners)[item]
        run = run[(np.cumsum(n_runs) - n_runs)[row] + which]
        later = id_[item] > run[:, 2]
        item, run = item[later], run[later]
        if not len(item):
            continue
        begin, stop, doc, id_ = start[item] + run[:, 0], start[item] + run[:, 1], doc[item], id_[item]
        order = np.lexsort((begin, id_, doc))
        begin, stop, doc, id_ = begin[order], stop[order], doc[order], id_[order]
        own = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (id_[1:] != id_[:-1])]) - 1
        reach = np.maximum.accumulate(stop + own * (1 << 40)) - own * (1 << 40)
        head = np.r_[True, (own[1:] != own[:-1]) | (begin[1:] > reach[:-1])]
        tail = np.r_[head[1:], True]
        pairs, own = np.stack([begin[head], reach[tail]], axis=1).astype(np.int32), own[head]
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        flat, bounds = pairs.tobytes(), (np.r_[cuts, len(own)] * 8).tolist()
        spans = [flat[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        at = np.flatnonzero(head)[cuts]
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(id_[at]), pa.array(spans, pa.binary())], names=["doc", "id", "spans"])


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, packed text, ids and spans) to the id, counts, digest of the kept bytes."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for id_, packed, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            raw = unpack(packed)
            pairs = np.frombuffer(b"".join([x["spans"] for x in found or () if x["id"] == id_]), np.int32).reshape(-1, 2)
            edges = [0, len(raw)]
            if len(pairs):
                pairs = pairs[np.argsort(pairs[:, 0])]
                reach = np.maximum.accumulate(pairs[:, 1])
                head = np.r_[True, pairs[1:, 0] > reach[:-1]]
                edges = [0, *np.stack([pairs[head, 0], reach[np.r_[head[1:], True]]], axis=1).ravel().tolist(), len(raw)]
            kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
            for c, v in zip(out, (id_, len(raw), len(raw) - len(kept), len(edges) // 2 - 1, hashlib.sha256(kept).hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _whole_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, id, bytes) to one span over all of a text."""
    for batch in batches:
        pairs = np.stack([np.zeros(batch.num_rows, np.int32), batch.column(2).to_numpy().astype(np.int32)], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.tobytes() for p in pairs], pa.binary())], names=["doc", "id", "spans"])


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=PACK_LEVEL).compress
    for batch in batches:
        for part in slices(batch, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pack(t.as_py().encode()) for t in part.column(2)], pa.binary())], names=["doc", "id", "packed"])


def repeated_spans(docs: DataFrame, light: DataFrame, packed: DataFrame) -> DataFrame:
    """(``doc``, ``id``, ``spans``) of bytes covered by LENGTH-byte strings that other texts have under a smaller id.

    ``docs`` has (id, v1, v2, text), ``light`` (doc, id, v1, v2, stop), ``packed`` the texts compressed, by doc. Of equal texts only the one with the
    smallest id gets spans.
    """
    rows, size = light.agg(F.count("*"), F.coalesce(F.sum("stop"), F.lit(0))).first()
    long_enough = docs.where(F.octet_length("text") >= LENGTH)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_grams(long_enough, rows))
    buckets = size // BUCKET_BYTES + 1
    blocks = long_enough.select("id", "v1", "v2", "text").mapInArrow(functools.partial(_pack_anchors, buckets, frequent), "bucket int, keys binary, counts binary, hashes binary")
    shared = blocks.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_anchors, "id long, v1 long, v2 int, hash long")
    leads = light.where(F.col("stop") >= LENGTH).groupBy("v1", "v2").agg(F.min("id").alias("id")).select(_doc(), F.lit(None).cast("long").alias("hash"))
    lists = leads.unionByName(shared.select(_doc(), "hash")).groupBy("doc").agg(F.collect_list("hash").alias("shared"))
    met = packed.join(lists, "doc").select("doc", "id", "packed", "shared")
    segments = met.mapInArrow(functools.partial(_distinct_segments, frequent), "anchor long, segment binary, least long, most long, place byte")
    found = segments.repartition("anchor").sortWithinPartitions("anchor", "segment").mapInArrow(_repeats, "anchor long, hash long, runs binary")
    owners = met.mapInArrow(functools.partial(_segment_owners, frequent), "anchor long, hash long, docs binary, ids binary, starts binary")
    return owners.join(found, ["anchor", "hash"]).select("docs", "ids", "starts", "runs").mapInArrow(_spans, "doc long, id long, spans binary")


def _doc():
    """What stands for an id together with a text."""
    return F.xxhash64("id", "v1", "v2").alias("doc")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row.

    A null text counts as empty. Rows with a null id keep all their bytes and take none from others. Repeated rows
    are kept and get equal results; rows that share an id don't take bytes from each other. Texts count as equal if
    96 bits of their MD5 are; an equal text under a smaller id covers all of a text of LENGTH bytes or more. Further columns are left
    out, an empty table gives an empty result. Ids are whole numbers.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    md5 = F.md5("text")
    docs = docs.select("id", F.conv(F.substring(md5, 1, 15), 16, 10).cast("long").alias("v1"), F.conv(F.substring(md5, 16, 7), 16, 10).cast("int").alias("v2"), "text")
    named = docs.where("id is not null")
    light = written(named.select(_doc(), "id", "v1", "v2", F.octet_length("text").cast("long").alias("stop")), "light")
    long_enough = light.where(F.col("stop") >= LENGTH)
    earliest = long_enough.groupBy("v1", "v2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("v1", "v2", "first")
    copies = long_enough.join(earliest, ["v1", "v2"]).where("id > first").select("doc", "id", "stop").distinct().mapInArrow(_whole_spans, "doc long, id long, spans binary")
    # with an empty span for every text both joins with the packed texts are inner ones, over one and the same shuffle
    packed = named.select(_doc(), "id", "text").mapInArrow(_packed_texts, "doc long, id long, packed binary").where("doc is not null")
    empty = light.select("doc").distinct().withColumn("span", F.lit(None).cast("struct<id:bigint,spans:binary>"))
    spans = repeated_spans(named, light, packed).unionByName(copies)
    spans = spans.select("doc", F.struct("id", "spans").alias("span")).unionByName(empty).groupBy("doc").agg(F.collect_list("span").alias("spans"))
    whole = docs.where("id is null").select(F.lit(0).cast("long").alias("doc"), "id", "text").mapInArrow(_packed_texts, "doc long, id long, packed binary")
    whole = whole.select("id", "packed", F.array().cast("array<struct<id:bigint,spans:binary>>").alias("spans"))
    joined = packed.join(spans, "doc").select("id", "packed", "spans").unionByName(whole)
    return joined.mapInArrow(_cut_texts, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What :func:`remove_repeats` gives for every row of ``documents``; see there for nulls, repeats and empty tables."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))
