"""Merkle manifest of a table: a tree over each group's rows in order, a tree over the groups, and a proof for every row.

Rows are range-sorted by group and order, so a group's leaves lie side by side over consecutive partitions. How many of a group
come before a partition follows from one summary a partition. Each partition builds every node whose leaves it holds; of those only
the topmost, which stand at ragged borders, are shuffled by their coordinate (group, level, place) and finished in blocks of some
levels. The paths above go back to the partitions that hold the leaves, where the rows wait, sorted; rows aren't shuffled again.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tapeloom.sources import read_table, written

#: Children of a node.
ARITY = 3
#: Levels finished in one shuffle: at most ARITY ** LEVELS nodes of a group meet.
LEVELS = 6
#: Rows of a partition, about.
PART_ROWS = 100_000
PROOF = "array<struct<before:string,after:string>>"


def record_digest(*columns: str | Column) -> Column:
    """SHA-256 of a record: each value as its UTF-8 byte count, a colon and the value, or ``-`` if it is null."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a digest and the siblings of its proof lead to."""
    return F.aggregate(proof, digest, lambda held, at: F.sha2(F.concat(at["before"], held, at["after"]), 256))


def _node(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def grow(digests: list[str], low: int, total: int) -> list[tuple[int, list[str]]]:
    """By level the first place and the digests of all nodes that the leaves from ``low`` on, of ``total`` in the group, determine."""
    levels = [(low, digests)]
    while total > 1:
        high, over = low + len(digests), -(-total // ARITY)
        first, last = -(-low // ARITY), over if high == total else high // ARITY
        if last <= first:
            break
        digests = [_node(digests[ARITY * i - low : min(ARITY * i + ARITY, total) - low]) for i in range(first, last)]
        low, total = first, over
        levels.append((low, digests))
    return levels


def climb(levels: list[tuple[int, list[str]]], place: int, total: int) -> tuple[list[tuple[str, str]], int, int]:
    """Siblings on the way up from a leaf as far as the levels go, and the level and place that it ends at."""
    path = []
    for level, ((low, held), (up_low, up_held)) in enumerate(itertools.pairwise(levels)):
        up = place // ARITY
        if not up_low <= up < up_low + len(up_held):
            return path, level, place
        path.append(("".join(held[ARITY * up - low : place - low]), "".join(held[place + 1 - low : min(ARITY * up + ARITY, total) - low])))
        place, total = up, -(-total // ARITY)
    return path, len(levels) - 1, place


def _borders(rows: Iterator) -> Iterator[tuple]:
    """Of a sorted partition its first key, how many groups it has, and the first and the last group with their rows."""
    first, groups, head, last = None, 0, (), ()
    for group, held in itertools.groupby(rows, key=lambda r: r[0][0]):
        n = 0
        for key, _ in held:
            first = first or key
            n += 1
        groups, last = groups + 1, (group, n)
        head = head or last
    if first:
        yield first, groups, *head, *last


def _segments(borders: list[tuple | None]) -> list[tuple | None]:
    """For each partition: its first key, how many groups it has, how many rows of its first group come before, rows in all of the first and of the last group."""
    totals: dict[tuple, int] = {}
    before = []
    for b in borders:
        if not b:
            before.append(0)
            continue
        _, groups, head, n_head, tail, n_tail = b
        before.append(totals.get(head, 0))
        totals[head] = before[-1] + n_head
        if groups > 1:
            totals[tail] = n_tail
    return [b and (b[0], b[1], skip, totals[b[2]], totals[b[4]]) for b, skip in zip(borders, before, strict=True)]


def _runs(rows: Iterable, segment: tuple) -> Iterator[tuple]:
    """The groups of a sorted partition: group, rows, place of the first one, rows of the whole group."""
    _, groups, skip, total_head, total_tail = segment
    for k, (group, held) in enumerate(itertools.groupby(rows, key=lambda r: r[0][0])):
        held = list(held)
        yield group, held, skip if k == 0 else 0, total_head if k == 0 else total_tail if k == groups - 1 else len(held)


def _ragged(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """Level, place and digest of the nodes without a parent among the levels."""
    for level, (low, held) in enumerate(levels):
        up_low, up_held = levels[level + 1] if level + 1 < len(levels) else (0, [])
        yield from ((level, low + i, d) for i, d in enumerate(held) if not up_low <= (low + i) // ARITY < up_low + len(up_held))


def _finish(block: tuple, ceiling: int) -> Iterator[tuple]:
    """The nodes of a block up to the level ``ceiling`` or the root: ``up`` for its top, ``at`` for each node that came in with its way there."""
    (group, place), came = block
    came = list(came)
    total = came[0][0]
    found = {(level, i): d for _, level, i, d, _ in came}
    level = min(level for level, _ in found)
    size = lambda at: -(-total // ARITY**at)
    while level < ceiling and size(level) > 1:
        for up in sorted({i // ARITY for at, i in found if at == level}):
            found[level + 1, up] = _node(found[level, i] for i in range(ARITY * up, min(ARITY * up + ARITY, size(level))))
        level += 1
    rooted = size(level) == 1
    yield ("up", group, total, level, 0 if rooted else place, found[level, 0 if rooted else place], rooted)
    for _, at, i, _, home in came:
        path, start, here = [], at, i
        while at < level:
            up = i // ARITY
            ring = range(ARITY * up, min(ARITY * up + ARITY, size(at)))
            path.append(("".join(found[at, j] for j in ring if j < i), "".join(found[at, j] for j in ring if j > i)))
            at, i = at + 1, up
        yield ("at", (group, start, here), (group, level, i), path, rooted, home)


class Forest:
    """Trees over the groups of an RDD of ``((group, order ...), (digest, ...))``, whose keys are all different."""

    def __init__(self, keyed: RDD, parts: int):
        self.sorted = keyed.sortByKey(numPartitions=max(2, parts))
        self.deal, n = self.sorted.partitioner.partitionFunc, self.sorted.getNumPartitions()
        borders: list[tuple | None] = [None] * n
        for at, b in self.sorted.mapPartitionsWithIndex(lambda at, rows: ((at, b) for b in _borders(rows))).collect():  # one row a partition
            borders[at] = b
        segments = _segments(borders)
        self.segments = keyed.context.broadcast(segments)
        self.groups = sum(b[1] for b in borders if b)
        self.height = max((self._height(t) for s in segments if s for t in s[3:]), default=0)
        self.parts = 1 + n // 64  # nodes at borders: some dozens a partition

        def local(at: int, rows: Iterator, segments=self.segments) -> Iterator[tuple]:
            segment = segments.value[at]
            for group, held, low, total in _runs(rows, segment) if segment else ():
                levels = grow([r[1][0] for r in held], low, total)
                whole = len(held) == total
                yield ("part", group, segment[0], levels[-1][1][0] if whole else None)
                if not whole:
                    yield from (("node", group, (total, level, i, d, segment[0])) for level, i, d in _ragged(levels))

        self.local = self.sorted.mapPartitionsWithIndex(local)
        self._close()

    @staticmethod
    def _height(total: int) -> int:
        return next(h for h in itertools.count() if ARITY**h >= total)

    def _close(self) -> None:
        """Upper levels, some at a time, then the ways to the root from the top down: ``roots`` by group, ``ways`` by home."""
        nodes = self.local.filter(lambda x: x[0] == "node").map(lambda x: x[1:])
        roots = [self.local.filter(lambda x: x[0] == "part" and x[3] is not None).map(lambda x: (x[1], x[3]))]
        carried, rounds = None, []
        for ceiling in range(LEVELS, self.height + LEVELS, LEVELS):
            mine = nodes.filter(lambda x, c=ceiling: c - LEVELS <= x[1][1] < c)
            mine = mine if carried is None else mine.union(carried)
            done = mine.map(lambda x, c=ceiling: ((x[0], x[1][2] // ARITY ** (c - x[1][1])), x[1])).groupByKey(self.parts).flatMap(lambda b, c=ceiling: _finish(b, c))
            roots.append(done.filter(lambda x: x[0] == "up" and x[6]).map(lambda x: (x[1], x[5])))
            carried = done.filter(lambda x: x[0] == "up" and not x[6]).map(lambda x: (x[1], (*x[2:6], None)))
            rounds.append(done.filter(lambda x: x[0] == "at"))
        self.roots = self.sorted.context.union(roots).coalesce(self.parts)
        above, ways = None, []
        for done in reversed(rounds):
            ended = done.filter(lambda x: x[4]).map(lambda x: (x[1], (x[3], x[5])))
            if above is not None:
                going = done.filter(lambda x: not x[4]).map(lambda x: (x[2], (x[1], x[3], x[5])))
                ended = ended.union(going.join(above, self.parts).map(lambda x: (x[1][0][0], (x[1][0][1] + x[1][1][0], x[1][0][2]))))
            above = ended
            ways.append(ended.filter(lambda x: x[1][1] is not None).map(lambda x: (x[1][1], ("way", *x[0], x[1][0]))))
        self.ways = self.sorted.context.union(ways).coalesce(self.parts) if ways else None

    def proven(self, tops: RDD) -> RDD:
        """``(row, subroot, root, path)`` for each row; ``tops`` has for each group its subroot, the path above it and the root."""
        homes = self.local.filter(lambda x: x[0] == "part").map(lambda x: (x[1], x[2]))
        news = homes.join(tops, self.parts).map(lambda x: (x[1][0], ("top", x[0], *x[1][1])))
        news = news if self.ways is None else news.union(self.ways)
        both = news.partitionBy(self.sorted.getNumPartitions(), self.deal).union(self.sorted)  # partition by partition, the news first
        if both.getNumPartitions() != self.sorted.getNumPartitions():
            raise RuntimeError("paths and rows are not dealt alike")

        def prove(at: int, rows: Iterator, segments=self.segments) -> Iterator[tuple]:
            ways, tops, first = {}, {}, []
            for row in rows:
                if row[1][0] == "way":
                    ways[row[1][1:4]] = row[1][4]
                elif row[1][0] == "top":
                    tops[row[1][1]] = row[1][2:]
                else:
                    first.append(row)
                    break
            for group, held, low, total in _runs(itertools.chain(first, rows), segments.value[at]) if first else ():
                levels = grow([r[1][0] for r in held], low, total)
                subroot, above, root = tops[group]
                for i, (_, row) in enumerate(held):
                    path, level, place = climb(levels, low + i, total)
                    yield row, subroot, root, [*path, *ways.get((group, level, place), ()), *above]

        return both.mapPartitionsWithIndex(prove)


def merkle_proofs(rows: DataFrame, group: str, order: str, digest: str, keep: list[str]) -> DataFrame:
    """``keep``, ``digest``, and for each row ``subroot`` (of its group), ``root`` (over the groups) and ``proof``.

    Leaves of a group ascend by ``order`` (a whole number, null first), then by digest, so repeated rows are leaves of their own
    and equal ones can be exchanged. Every ARITY consecutive nodes, and what is over at the end, become the SHA-256 of their joined hex
    digests until one is left; a lone leaf is its own subroot. Groups (texts, null first, by bytes) make the upper tree likewise.
    ``proof`` has for each level the digests left and right of the way up. An empty table gives no rows.
    """
    spark = rows.sparkSession
    own = rows.select(F.encode(group, "UTF-8").alias("__group"), F.col(order).cast("long").alias("__order"), F.col(digest).alias("__digest"), *keep, F.monotonically_increasing_id().alias("__tie"))
    held = written(own, "leaves")
    schema = T.StructType([*[held.schema[c] for c in keep], T.StructField(digest, T.StringType()), *T._parse_datatype_string(f"subroot string, root string, proof {PROOF}").fields])
    n = held.count()
    if not n:
        return spark.createDataFrame([], schema)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS))
    keyed = held.rdd.map(lambda r: (((r[0] is not None, bytes(r[0] or b"")), (r[1] is not None, r[1] or 0), r[2], r[-1]), (r[2], *r[3:-1])))
    leaves = Forest(keyed, parts)
    upper = Forest(leaves.roots.map(lambda x: ((True, x[0]), (x[1], x[0]))), min(parts, 1 + leaves.groups // PART_ROWS))
    tops = upper.proven(upper.roots.map(lambda x: (x[0], (x[1], [], x[1])))).map(lambda x: (x[0][1], (x[0][0], x[3], x[2])))
    out = leaves.proven(tops).map(lambda x: (*x[0][1:], x[0][0], *x[1:]))
    return spark.createDataFrame(out, schema, verifySchema=False)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf for every document, its tree's subroot and root, the digest of its siblings, and what a change of half the texts leads to.

    Null columns are ``-`` in a leaf; a null ``source`` is a source of its own, a null ``doc_id`` comes first in its source and is never
    tampered with. Repeated rows are leaves of their own; of the same ``doc_id`` the smaller leaf comes first.
    """
    docs = read_table(spark, sf_dir, "documents")
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(odd, record_digest("doc_id", "source", "lang", "n_chars", F.replace("text", F.lit("\n"), F.lit(""))))
    leaves = docs.select("doc_id", "source", record_digest("doc_id", "source", "lang", "n_chars", "text").alias("leaf"), changed.alias("changed"))
    proofs = merkle_proofs(leaves, "source", "doc_id", "leaf", ["doc_id", "changed"])
    siblings = F.concat_ws("", F.transform("proof", lambda p: F.concat(p["before"], p["after"])))
    out = proofs.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": folded(F.coalesce("changed", "leaf"), F.col("proof"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
