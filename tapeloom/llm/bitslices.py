"""Exact top-k search by inner product over a bit-sliced index.

A block of rows is kept as bitmaps: for each component of the vectors one bitmap a bit, with a bit for every row of the block. A query
adds the slices of all components, shifted by the bits of its own components, with bitmap arithmetic: sums and carries of whole
bitmaps, 64 rows a word. What comes out are the slices of all scores of the block; from the most significant one downward they
tell which rows are surely among the best and which are still level. Rows level at the end are chosen by their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tapeloom.sources import read_table, written

#: Steps of a quantised component for 1.0, results of a query, and every how many-th id is a query.
SCALE, BEST, EVERY = 64, 20, 20
#: Rows of a block of the index, and queries that meet it in one task, about.
BLOCK_ROWS, BATCH = 32_768, 256
#: Components beyond this leave a score no room in a long.
LARGEST = 1 << 26
INDEX = "block long, dim int, bit int, base long, bitmap binary"
FOUND = "query long, vec_id long, score long"


def slices_of(values: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """The least value, and a bitmap (64-bit words) for each bit of what the values have above it."""
    base = int(values.min())
    above = (values - base).astype(np.uint64)
    pad = -len(values) % 64
    bits = int(above.max()).bit_length()
    return base, [np.packbits(np.pad(((above >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), (0, pad)), bitorder="little").view(np.uint64) for b in range(bits)]


def add_up(columns: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """The sum of bitmaps with the weights 2 ** (place in the list), as slices: three of a weight become one, and one of the next."""
    out, at = [], 0
    while at < len(columns):
        column, carries = columns[at], columns[at + 1] if at + 1 < len(columns) else []
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            column.append(odd ^ c)
        if len(column) == 2:
            a, b = column
            carries.append(a & b)
            column = [a ^ b]
        if carries and at + 1 == len(columns):
            columns.append(carries)
        out.append(column[0] if column else np.zeros(words, np.uint64))
        at += 1
    return out


def best_rows(slices: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the fewer than ``k`` rows that are surely among the best, and of those level with the last place."""
    sure, level = np.zeros_like(among), among
    for s in reversed(slices):
        more = level & s
        n = int(np.bitwise_count(sure | more).sum())
        if n >= k:
            level = more
            if n == k:
                return sure | more, np.zeros_like(among)
        else:
            sure, level = sure | more, level & ~s
    return sure, level


def places(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
    """Places of the set bits, the first ``most`` of them; only words with a bit are unpacked."""
    filled = np.flatnonzero(bitmap)
    filled = filled if most is None else filled[:most]
    bits = np.unpackbits(bitmap[filled].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1)
    at = np.flatnonzero(bits)
    return (filled[at // 64] * 64 + at % 64)[:most]


class Block:
    """A block of the index: slices of its components, and the rows' numbers and ids in the order of ids."""

    def __init__(self, entries: dict[str, list]):
        self.rows = self.ids = np.zeros(0, np.int64)
        self.dims: dict[int, tuple[int, dict[int, np.ndarray]]] = {}
        for dim, bit, base, raw in zip(entries["dim"], entries["bit"], entries["base"], entries["bitmap"], strict=True):
            if dim >= 0:
                own = self.dims.setdefault(dim, (base, {}))[1]
                if bit >= 0:
                    own[bit] = np.frombuffer(raw, np.uint64)
            elif dim == -1:
                self.rows = np.frombuffer(raw, np.int64)
            else:
                self.ids = np.frombuffer(raw, np.int64)
        self.words = -(-len(self.rows) // 64)
        self.all = np.packbits(np.pad(np.ones(len(self.rows), np.uint8), (0, -len(self.rows) % 64)), bitorder="little").view(np.uint64)
        self.place = {int(r): i for i, r in enumerate(self.rows)}
        self.flipped = {d: {b: ~m for b, m in own.items()} for d, (_, own) in self.dims.items()}

    def scores(self, query: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """A constant and the slices that make up the scores of all rows; where the query is negative, flipped slices are added instead."""
        constant, columns = 0, []
        for dim, (base, own) in self.dims.items():
            q = int(query[dim]) if dim < len(query) else 0
            constant += q * base
            if q < 0:
                top = 1 << (max(own, default=-1) + 1)
                constant += q * (top - 1)
            used = self.flipped[dim] if q < 0 else own
            q = abs(q)
            while q:
                shift = (q & -q).bit_length() - 1
                q &= q - 1
                for bit, bitmap in used.items():
                    while len(columns) <= shift + bit:
                        columns.append([])
                    columns[shift + bit].append(bitmap)
        return constant, add_up(columns, self.words)

    def search(self, query: np.ndarray, row: int, k: int) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the ``k`` best rows, all but the query's own; of level rows the smaller ids."""
        among = self.all
        if row in self.place:
            at = self.place[row]
            among = among.copy()
            among[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        constant, slices = self.scores(query)
        sure, level = best_rows(slices, among, k)
        found = places(sure)
        found = np.concatenate([found, places(level, k - len(found))]) if len(found) < k else found
        word, bit = found // 64, (found % 64).astype(np.uint64)
        held = [((s[word] >> bit) & np.uint64(1)).tolist() for s in slices]
        return self.ids[found], [constant + sum(int(b) << i for i, b in enumerate(bits)) for bits in zip(*held, strict=True)] if held else [constant] * len(found)


def _index(rows: DataFrame, blocks: int) -> DataFrame:
    """The table of bitmaps of ``rows`` (``row``, ``vec_id``, ``q``), dealt to so many blocks; dims -1 and -2 hold row numbers and ids."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("vec_id", "ascending"), ("row", "ascending")])
        lengths = table["q"].combine_chunks().value_lengths().to_numpy()
        flat = table["q"].combine_chunks().flatten().to_numpy().astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        block = table["block"][0].as_py()
        out = [(-1, -1, 0, table["row"].to_numpy().tobytes()), (-2, -1, 0, table["vec_id"].to_numpy().tobytes())]
        for dim in range(int(lengths.max())):
            values = np.zeros(len(lengths), np.int64)  # a shorter vector has zeros
            has = lengths > dim
            values[has] = flat[starts[has] + dim]
            base, bitmaps = slices_of(values)
            out += [(dim, -1, base, None), *((dim, b, base, m.tobytes()) for b, m in enumerate(bitmaps))]
        dims, bits, bases, raw = zip(*out, strict=True)
        for i in range(0, len(out), 64):
            cut = slice(i, i + 64)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(dims[cut]), pa.int64()), pa.array(dims[cut], pa.int32()), pa.array(bits[cut], pa.int32()), pa.array(bases[cut], pa.int64()), pa.array(raw[cut], pa.binary())], names=["block", "dim", "bit", "base", "bitmap"])

    return rows.repartition(blocks).withColumn("block", F.spark_partition_id().cast("long")).select("block", "row", "vec_id", "q").mapInArrow(build, INDEX)


def _meet(k: int):
    def meet(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if index.num_rows and queries.num_rows:
            block = Block(index.select(["dim", "bit", "base", "bitmap"]).to_pydict())
            for row, query in zip(queries["row"].to_pylist(), queries["q"], strict=True):
                ids, scores = block.search(query.values.to_numpy(), row, k)
                out[0].extend([row] * len(scores))
                out[1].extend(ids.tolist())
                out[2].extend(scores)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query", "vec_id", "score"])

    return meet


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``row`` (a number of its own), ``vec_id`` and ``q``, whole components, of the vectors that take part."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(SCALE * x.cast("double")))
    usable = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(SCALE * x.cast("double")) < LARGEST))
    return vectors.where(usable & F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), whole.cast("array<int>").alias("q"))


def top_k(vectors: DataFrame, is_query: str, k: int = BEST, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, batch: int = BATCH) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` best other rows for every row with ``is_query`` (SQL over ``vec_id``).

    Exact. Vectors that are null, hold a null, NaN or infinite component (or one beyond LARGEST steps, for which a score has no room), or have
    no id take no part; a shorter vector counts as filled with zeros. A row with an id that others have too is a row, and a query, of its own.
    Each batch of queries meets each block of the index in a task of its own; only the best of a block leave it.
    """
    held = written(quantised(vectors, id_col, vector_col), "quantised")
    queries = held.where(is_query)
    n, asked = held.count(), queries.count()
    blocks, batches = max(1, -(-n // block_rows)), max(1, -(-asked // batch))
    index = written(_index(held, blocks), "slices")
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    left = index.withColumn("batch", every(batches))
    right = queries.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches))).withColumn("block", every(blocks)).select("block", "batch", "row", "q")
    found = left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInArrow(_meet(k), FOUND)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    asks = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(asks, "query").select("query_id", "rank", "vec_id", "score")


def op11_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of each whose id 20 divides, by inner product of components in steps of 1/64; see :func:`top_k` for odd vectors."""
    return top_k(read_table(spark, sf_dir, "embeddings"), f"vec_id % {EVERY} = 0")
