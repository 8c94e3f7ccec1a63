"""SimHash near-duplicates: fingerprints, pivot distance tables and connected components.

Distinct fingerprints within ``distance`` bits of each other are linked. Candidates share some blocks of
the fingerprint (of ``distance + agree`` blocks at least ``agree`` are equal in every linked pair). For
each candidate the Hamming distances to PIVOTS reference fingerprints are looked up in a table; by the
triangle inequality a pair whose distances to any reference differ by more than ``distance`` cannot be
linked and is discarded; the survivors are verified bit by bit. Within a block group only a spanning forest
of its links is given out, so a group of copies never makes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.llm.batches import map_texts
from tapeloom.llm.components import components
from tapeloom.sources import read_table, written

SEED = 42
PIVOTS = 24
#: Groups with more fingerprints are split by the blocks that their key leaves out.
GROUP_ROWS = 4_000
#: Hashes whose bits are unpacked at a time.
BITS_ROWS = 65_536


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of every shingle; the whole sequence where it is shorter, nothing without words."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z are lowered, only ASCII space splits
    if not words:
        return []
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return [digest(g, SEED) for g in grams]


def bit_sums(flat: np.ndarray, counts: np.ndarray, words: int, widen) -> np.ndarray:
    """How many hashes of each text have each bit set, [texts, 64 * words].

    ``flat`` holds the hashes of all texts one after another, ``counts`` how many each has, ``widen`` makes
    [n, words] of [n] hashes. BITS_ROWS hashes are unpacked at a time, so a very long text takes no more memory.
    """
    out = np.zeros((len(counts), 64 * words), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(flat), BITS_ROWS):
        own = owner[at : at + BITS_ROWS]
        bits = np.unpackbits(np.ascontiguousarray(widen(flat[at : at + BITS_ROWS])).view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return out


def fingerprints_of(texts: list, shingle: int) -> np.ndarray:
    """Signed 64-bit fingerprint of each text: a bit is 1 if it is 1 in over half the shingle hashes."""
    hashes = [shingle_hashes(t, shingle) for t in texts]
    n = np.array([len(h) for h in hashes], np.int64)
    flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, n.sum())
    ones = bit_sums(flat, n, 1, lambda h: h[:, None])
    return np.packbits((2 * ones > n[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.int64)[:, 0]


def fingerprints(df: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the 64-bit fingerprint. Null and empty texts have fingerprint 0; rows are kept one by one."""
    return map_texts(df, [id_col], text_col, lambda texts: {"fp": fingerprints_of(texts, shingle)}, "fp long", most=1_000_000)


def block_bounds(first: int, bits: int, blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``blocks`` nearly equal blocks of ``bits`` bits."""
    cuts = [first + bits * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _key(fp: Column, blocks: list[tuple[int, int]], n: int) -> Column:
    """Number ``n`` and the bits of ``blocks`` as text-free key columns in one struct."""
    value = F.lit(0).cast("long")
    for low, width in blocks:
        value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1))
    return F.struct(F.lit(n).alias("n"), value.alias("bits"))


def spanning_forest(pairs: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for the nodes of a graph over 0..n-1 that are not smallest."""
    parent = np.arange(n)
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            break
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(n))
    return moved, parent[moved]


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints, the hashes of the first whole numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], np.uint64)


def linked(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links that join what is within ``distance`` in each run of equal ``group``."""
    table = np.stack([np.bitwise_count(fp ^ p) for p in reference_fingerprints()]).astype(np.int16)
    found: list[np.ndarray] = []
    held = 0
    at = np.arange(len(fp))
    for d in range(1, len(fp)):
        at = at[at + d < len(fp)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        near = at
        for row in table:  # the largest coordinate difference discards
            near = near[np.abs(row[near] - row[near + d]) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= distance]
        if len(near):
            found.append(np.stack([near, near + d]))
            held += len(near)
            if held > 4 * len(fp) + 1000:
                found = [np.stack(spanning_forest(found, len(fp)))]
                held = found[0].shape[1]
    return spanning_forest(found, len(fp)) if found else (at[:0], at[:0])


def links(classes: DataFrame, distance: int = 2, agree: int = 2) -> DataFrame:
    """Edges (``a``, ``b``) between distinct fingerprints (``fp``) within ``distance`` bits.

    The edges span the same components as all links do.
    """
    fp, n_blocks = F.col("fp"), distance + agree
    blocks = block_bounds(0, 64, n_blocks)
    combos = list(combinations(range(n_blocks), agree))
    keyed = classes.select("fp", F.explode(F.array(*[_key(fp, [blocks[i] for i in c], n) for n, c in enumerate(combos)])).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > GROUP_ROWS).select("key", F.lit(True).alias("large"))

    def finer(c: tuple[int, ...]) -> Column:
        """Keys from the blocks left out of combination ``c``, each cut in two, of which enough stay equal too."""
        rest = [x for i in range(n_blocks) if i not in c for x in block_bounds(*blocks[i], 2)]
        return F.array(*[_key(fp, [rest[i] for i in s], n) for n, s in enumerate(combinations(range(len(rest)), len(rest) - distance))])

    choice = F.coalesce(*[F.when(F.col("key.n") == n, finer(c)) for n, c in enumerate(combos)])
    split = keyed.join(large, "key", "left").select(
        "fp", "key", F.explode(F.when(F.col("large"), choice).otherwise(F.array(_key(fp, [], -1)))).alias("sub")
    )
    grouped = split.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp").select("key.n", "key.bits", F.col("sub.n").alias("sub_n"), F.col("sub.bits").alias("sub_bits"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            cut = change[-1] if len(change) else 0
            rest = [c[cut:] for c in cols]
            yield from emit([c[:cut] for c in cols])
        if rest is not None:
            yield from emit(rest)

    def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(cols[0]) > 1:
            group = np.cumsum(np.r_[0, np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)])
            a, b = linked(cols[4].view(np.uint64), group, distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(cols[4][a]), pa.array(cols[4][b])], names=["a", "b"])

    return grouped.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, shingle: int = 5, distance: int = 2, agree: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` and ``component_id``, the smallest id reachable over links, for every row.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null id link others and get the
    component of their fingerprint, null where no row in it has an id. Repeated ids and texts are kept row by row, further columns are left
    out, an empty table gives an empty result.
    """
    docs = written(fingerprints(df.withColumn("__id", F.col(f"`{id_col}`").cast("long")), shingle, "__id", text_col), "fingerprints")
    classes = written(docs.groupBy("fp").agg(F.min("__id").alias("rep")), "classes")
    found = components(links(classes, distance, agree))  # over fingerprints, so those that only rows without an id have link others too
    labels = written(classes.join(found, classes.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("c")), "labels")
    least = labels.groupBy("c").agg(F.min("rep").alias("component_id"))
    return docs.join(labels.join(least, "c").select("fp", "component_id"), "fp").select(F.col("__id").alias(id_col), "fp", "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; see :func:`near_duplicates` for nulls, repeats and empty tables."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
