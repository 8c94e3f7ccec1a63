"""SimHash near-duplicates by similarity: wide fingerprints of word shingles, probed block keys, pivot tables.

A fingerprint has WORDS * 64 bits, of the distinct shingles. Two texts whose shingle sets have cosine c differ in about
acos(c) / pi of the bits, so a least similarity becomes a largest Hamming distance. The fingerprint is cut
into TABLES blocks. The bits of a block that are closest to a tie are the ones that near copies differ in, so
each text is filed under every setting of the WEAK weakest bits of each block, and near copies meet in some
block. Pairs that meet are discarded by the largest difference of their distances to reference fingerprints and
compared on all bits. A group gives out a spanning forest of its links, so what these candidates connect holds every
link that all candidates would show. There the shingle sets decide: the texts of such a part meet, in chunks of bounded size
that meet two by two, and give out a spanning forest of the pairs that are as similar as asked for. Texts travel packed, once for each chunk of their part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.batches import map_texts
from tapeloom.llm.components import components
from tapeloom.llm.simhash import bit_sums, reference_fingerprints, shingle_hashes, spanning_forest
from tapeloom.sources import written

WORDS = 4
TABLES, WEAK = 12, 3
BLOCK_BITS = WORDS * 64 // TABLES
#: Classes are dealt to buckets by their table and the leading bits of its block, 768 buckets in all, and not by each of their 96 keys; ties make the low bits the weak ones more often.
DEAL_BITS = 6
LOW_BITS = BLOCK_BITS - DEAL_BITS
#: Two standard deviations of the distance at a similarity of 0.8; the shingle sets decide.
SLACK_BITS = 12
REFERENCES = 12
#: Larger groups are split into chunks of about this size, and every two chunks meet in a task.
GROUP_ROWS = 16_384
#: Keys of one class in so many show which groups are larger; that decides on chunks, never on a result.
SHOWN_ONE_IN = 32
#: Parts with more texts or shingles are split into chunks of about this size, and every two chunks meet in a task.
PART_ROWS, PART_SHINGLES = 4_096, 1_000_000
#: Bits of the bitmap that tells which texts may have a similar one (4 MB); beyond some 10^7 of these it lets most texts through.
FILTER_BITS = 1 << 25
#: Level at which texts are compressed.
PACK_LEVEL = 1
#: Groups from this size first compare all rows with a few leading rows.
LEADER_ROWS, LEADERS = 64, 8


def distance_bound(similarity: float) -> int:
    """Largest Hamming distance of texts with at least this Jaccard similarity of shingles, with SLACK_BITS of slack."""
    cosine = 2 * similarity / (1 + similarity)
    return math.floor(math.acos(min(1.0, cosine)) / math.pi * WORDS * 64) + (SLACK_BITS if similarity < 1 else 0)


def _widened(h: np.ndarray) -> np.ndarray:
    """Each hash and WORDS - 1 more hashes made from it, [n, WORDS]."""
    out = [h]
    for c in range(1, WORDS):
        x = (h + np.uint64(c)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def set_hash(hashes: np.ndarray) -> int:
    """A signed 64-bit number that stands for a set of shingle hashes."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def wide_fingerprints(hashes: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
    """Per set of shingle hashes the fingerprint, and the places of the WEAK weakest bits of each block (a byte each)."""
    n = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate(hashes)
    lead = 2 * bit_sums(flat, n, WORDS, _widened) - n[:, None]
    fp = np.packbits((lead > 0).astype(np.uint8), axis=1, bitorder="little")
    blocks = np.abs(lead[:, : TABLES * BLOCK_BITS]).reshape(len(hashes), TABLES, BLOCK_BITS)
    weak = np.argsort(blocks, axis=2, kind="stable")[:, :, :WEAK].astype(np.uint8)
    return [r.tobytes() for r in fp], [r.tobytes() for r in weak]


def block_keys(fp: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Keys [n, TABLES * 2 ** WEAK] of fingerprints [n, bytes]: block number and bits, under every setting of the weak ones."""
    bits = np.unpackbits(fp, axis=1, bitorder="little")[:, : TABLES * BLOCK_BITS].reshape(len(fp), TABLES, BLOCK_BITS).astype(np.int64)
    value = (bits << np.arange(BLOCK_BITS)).sum(axis=2) + (np.arange(TABLES, dtype=np.int64) << BLOCK_BITS)
    keys = value[:, :, None]
    for k in range(WEAK):
        keys = np.concatenate([keys, keys ^ (np.int64(1) << weak.reshape(len(fp), TABLES, WEAK)[:, :, k, None].astype(np.int64))], axis=2)
    return keys.reshape(len(fp), -1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int16)


def linked(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links that join what is within ``distance`` in each run of equal ``group``; ``fp`` is [n, WORDS]."""
    n = len(fp)
    references = reference_fingerprints(REFERENCES * WORDS).reshape(REFERENCES, WORDS)
    table = np.stack([_apart(fp, r) for r in references])
    label, found = np.arange(n), []
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    for lo, size in zip(cuts[:-1], np.diff(cuts), strict=True):
        if size >= LEADER_ROWS:
            own = np.arange(lo, lo + size)
            for _ in range(LEADERS):
                lead, own = own[0], own[1:]
                near = _apart(fp[own], fp[lead]) <= distance
                if near.any():
                    label[own[near]] = lead
                    found.append(np.stack([np.full(near.sum(), lead), own[near]]))
                own = own[~near]
                if not len(own):
                    break
    at, held = np.arange(n), 0
    for d in range(1, n):
        at = at[at + d < n]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        near = at[label[at] != label[at + d]]
        for row in table:  # the largest coordinate difference discards
            near = near[np.abs(row[near] - row[near + d]) <= distance]
        near = near[_apart(fp[near], fp[near + d]) <= distance]
        if len(near):
            found.append(np.stack([near, near + d]))
            held += len(near)
            if held > 4 * n + 1000:
                found, held = [np.stack(spanning_forest(found, n))], 0
    return spanning_forest(found, n) if found else (at[:0], at[:0])


def _block_of(fp: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The block number ``table`` of each of the fingerprints [n, bytes] as a number: its bits are in four bytes."""
    at = table * BLOCK_BITS
    four = np.ascontiguousarray(fp[np.arange(len(fp))[:, None], (at >> 3)[:, None] + np.arange(4)]).view("<u4")[:, 0].astype(np.int64)
    return four >> (at & 7) & (1 << BLOCK_BITS) - 1


def _keys_shown(classes: DataFrame) -> DataFrame:
    """A row for each ``key`` of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                fp, weak = [_bytes_of(batch.slice(at, 1000).column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(block_keys(fp, weak).ravel().astype(np.int32))], names=["key"])

    return classes.select("fp", "weak").mapInArrow(run, "key int")


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Binary values of one size as [n, bytes]."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def dealt(fp: np.ndarray, weak: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, and the bucket (the leading bits of a key) with the weak places below it (5 bits each): a class once for each bucket that its keys are in.

    By bucket, so that what a shuffle of them takes does not depend on how many buckets of a class happen to share a partition.
    """
    weak = weak.reshape(len(fp), TABLES, WEAK).astype(np.int64)
    keys = np.stack([_block_of(fp, np.full(len(fp), t)) + (t << BLOCK_BITS) for t in range(TABLES)], axis=1)
    packed = (weak << 5 * np.arange(WEAK)).sum(axis=2)
    rows, places = [], []
    for setting in range(1 << WEAK):
        turned = weak[:, :, [k for k in range(WEAK) if setting >> k & 1]]
        row, table = np.nonzero((turned >= LOW_BITS).all(axis=2))  # other settings stay in the bucket of one of these
        rows.append(row)
        places.append((keys[row, table] ^ (np.int64(1) << turned[row, table]).sum(axis=1)) >> LOW_BITS << 5 * WEAK | packed[row, table])
    row, place = np.concatenate(rows), np.concatenate(places)
    order = np.argsort(place >> 5 * WEAK, kind="stable")
    return row[order], place[order].astype(np.int32)


def dealt_keys(place: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of rows that :func:`dealt` gave out: of each its keys in its bucket."""
    place = place.astype(np.int64)
    table = place >> 5 * WEAK + DEAL_BITS
    keys = (_block_of(fp, table) + (table << BLOCK_BITS))[:, None]
    for k in range(WEAK):
        keys = np.concatenate([keys, keys ^ (np.int64(1) << (place >> 5 * k & 31))[:, None]], axis=1)
    row, setting = np.nonzero(keys >> LOW_BITS == (place >> 5 * WEAK)[:, None])
    return row, keys[row, setting].astype(np.int32)


def _filed(classes: DataFrame) -> DataFrame:
    """A row for each key of each class: ``key``, ``fp``, ``node``, all of a key in one partition.

    A class is shuffled once for each bucket of keys, not for each key; there its keys are told from its fingerprint.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                row, place = dealt(_bytes_of(part.column(0)), _bytes_of(part.column(1)))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(place), part.column(0).take(row), part.column(2).take(row)], names=["place", "fp", "node"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key = dealt_keys(batch.column(0).to_numpy(), _bytes_of(batch.column(1)))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(1).take(row), batch.column(2).take(row)], names=["key", "fp", "node"])

    rows = classes.select("fp", "weak", "node").mapInArrow(deal, "place int, fp binary, node long")
    return rows.repartition(F.shiftright("place", 5 * WEAK)).mapInArrow(told, "key int, fp binary, node long")


def _meeting(own, chunks):
    """The numbers of the meetings of chunk ``own`` with each of ``chunks`` chunks, itself included."""
    return F.transform(F.sequence(F.lit(0), chunks - 1), lambda t: (F.least(t, own) * chunks + F.greatest(t, own)).cast("long"))


def similar_links(classes: DataFrame, distance: int) -> DataFrame:
    """Edges (``a``, ``b``) of ``node`` between classes (``fp``, ``weak``, ``node``) within ``distance`` bits that span the components."""
    some = _keys_shown(classes.where(F.pmod(F.xxhash64("node"), F.lit(SHOWN_ONE_IN)) == 0))
    chunks = F.ceil(F.col("count") * SHOWN_ONE_IN / GROUP_ROWS).cast("int")
    large = written(some.groupBy("key").count().select("key", chunks.alias("chunks")).where("chunks > 1"), "large")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    filed = _filed(classes)
    whole = filed.join(F.broadcast(large), "key", "left_anti").select("key", F.lit(0).cast("long").alias("sub"), "fp", "node")
    split = filed.join(F.broadcast(large), "key").select("key", F.explode(_meeting(own, F.col("chunks"))).alias("sub"), "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(batch.num_rows, WORDS)
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), fp, batch.column(3).to_numpy()]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            cut = change[-1] if len(change) else 0
            rest = [c[cut:] for c in cols]
            yield from emit([c[:cut] for c in cols])
        if rest is not None:
            yield from emit(rest)

    def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(cols[0]) > 1:
            group = np.cumsum(np.r_[0, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            a, b = linked(cols[2], group, distance)
            if len(a):
                pairs = np.unique(np.stack([cols[3][a], cols[3][b]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    found = whole.sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")
    if not large.isEmpty():
        found = found.unionByName(split.repartition("key", "sub").sortWithinPartitions("key", "sub", "node").mapInArrow(run, "a long, b long"))
    return found.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def joined(sets: list[np.ndarray], chunk: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of numbers of sorted ``sets`` that join what has at least this Jaccard similarity; where there are two chunks only pairs across them count.

    Each set is counted against all sets of a fitting size at once, as long as one of them is not yet joined to it.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    if len(order) < 2:
        return []
    sizes, chunk, across = sizes[order], chunk[order], chunk.min() != chunk.max()
    values, flat = np.unique(np.concatenate([sets[i] for i in order.tolist()]), return_inverse=True)
    starts = np.cumsum(np.r_[0, sizes])
    most = np.searchsorted(similarity * sizes, sizes, "right")  # a pair of such similarity has sizes no further apart
    label, mark, found = np.arange(len(order)), np.zeros(len(values), bool), []
    for i in range(len(order) - 1):
        lo, hi = i + 1, int(most[i])
        live = label[lo:hi] != label[i]
        if across:
            live &= chunk[lo:hi] != chunk[i]
        if not live.any():
            continue
        own = flat[starts[i] : starts[lo]]
        mark[own] = True
        common = np.add.reduceat(mark[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
        mark[own] = False
        near = lo + np.flatnonzero(live & (common >= similarity * (sizes[i] + sizes[lo:hi] - common)))
        if len(near):
            labels, first = np.unique(label[near], return_index=True)
            found += [(int(order[i]), int(order[j])) for j in near[first]]
            label[np.isin(label, labels)] = label[i]
    return found


def verified(parts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Edges (``a``, ``b``) that span what is joined by at least this similarity, of rows (``component``, ``sub``, ``own``, ``node``, ``packed``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, at, held, edges = zstandard.ZstdDecompressor().decompress, None, {}, []

        def flush() -> None:
            nodes = list(held)
            for i, j in joined([held[n][1] for n in nodes], np.array([held[n][0] for n in nodes]), similarity):
                edges.append((nodes[i], nodes[j]))
            held.clear()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])
            edges.clear()
            return out

        for batch in batches:
            for component, sub, own, node, packed in zip(*batch.columns, strict=True):
                if (key := (component.as_py(), sub.as_py())) != at:
                    if len(held) > 1:
                        flush()
                    held.clear()
                    at = key
                if (node := node.as_py()) not in held:  # repeated rows
                    held[node] = own.as_py(), shingle_set(unpack(packed.as_py()).decode(), shingle)
            yield told()
        if len(held) > 1:
            flush()
        yield told()

    return parts.repartition("component", "sub").sortWithinPartitions("component", "sub").mapInArrow(run, "a long, b long")


def _perhaps(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose ``node`` may be one of ``members``, by a bitmap of FILTER_BITS bits: only these are worth a shuffle of their texts."""
    bit = F.pmod(F.col("node"), F.lit(FILTER_BITS))
    seen = members.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = texts.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(seen), "bucket")
    return held.where(F.call_function("getbit", byte, F.pmod(place, F.lit(8)).cast("int")) == 1).select(*texts.columns)


def _components_of(docs: DataFrame, classes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``node`` and ``component`` over verified links between classes."""
    loose = components(written(similar_links(classes, distance_bound(similarity)), "links"))
    members = loose.unionByName(loose.select(F.col("component").alias("node"), "component").distinct())
    members = written(members.join(classes.select("node", "rep", "size"), "node"), "members")
    chunks = F.ceil(F.greatest(F.count("*") / PART_ROWS, F.sum("size") / PART_SHINGLES)).cast("int")
    large = members.groupBy("component").agg(chunks.alias("chunks")).where("chunks > 1")
    chunked = members.join(large, "component", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunked = chunked.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    texts = _perhaps(docs.select(F.col("__id").alias("rep"), "node", "packed"), members).join(chunked, ["rep", "node"])
    parts = texts.select("component", F.explode(_meeting(F.col("own"), F.col("chunks"))).alias("sub"), "own", "node", "packed")
    return components(verified(parts, similarity, shingle))


def similar_documents(df: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``component_id``, the smallest id reachable over links of at least ``similarity``, for every row.

    Every link is verified on the distinct shingles; a pair is missed only where its fingerprints do not show it.
    Null, empty and wordless texts are copies of each other; texts of fewer words than a shingle are
    linked to equal ones. Rows with a null id get the component of equal texts. Repeated rows are kept, further
    columns are left out, an empty table gives an empty result.
    """

    def fn(texts: list) -> dict:
        sets = [shingle_set(t, shingle) for t in texts]
        fp, weak = wide_fingerprints(sets)
        pack = zstandard.ZstdCompressor(level=PACK_LEVEL).compress
        return {"node": [set_hash(h) for h in sets], "fp": fp, "weak": weak, "size": [len(h) for h in sets], "packed": [pack((t or "").encode()) for t in texts]}

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    docs = written(map_texts(source, ["__id"], "__text", fn, "node long, fp binary, weak binary, size int, packed binary", most=500_000), "wide")
    classes = written(docs.groupBy("node").agg(F.min("__id").alias("rep"), F.min("fp").alias("fp"), F.min("weak").alias("weak"), F.min("size").alias("size")), "classes")
    found = _components_of(docs, classes.where("rep is not null"), similarity, shingle)
    labels = written(classes.select("node", "rep").join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("c")), "labels")
    least = labels.groupBy("c").agg(F.min("rep").alias("component_id"))
    return docs.select("__id", "node").join(labels.join(least, "c").select("node", "component_id"), "node").select(F.col("__id").alias(id_col), "component_id")
