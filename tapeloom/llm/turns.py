"""Repair of the structure of conversations: the cheapest edits that give the order of roles ``(s?(ua)+)?``.

Rows come sorted by conversation. Many conversations of like length are repaired at a time: for every turn, from the last to the first,
the costs to the end from each state are worked out for all of them at once and kept; then all walk forward together, one
edit a step. Only faults and the first letters of roles are needed for that; texts meet the edits in a second pass, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tapeloom.sources import read_table

#: Costs of changing a role, deleting, inserting, and of a row without an end that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant; the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row that is inserted or got by a change of role.
NEXT = np.array([USER, USER, ASSISTANT, USER])
NEVER = 1 << 40
#: Row kinds of the faults.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Turns of all conversations that are repaired at a time; a longer one is alone.
TURNS = 50_000
SPACES = " \t\n\x0b\x0c\r"


def _kept(roles: np.ndarray) -> np.ndarray:
    """For each state the state after each role is kept, or -1; roles are the letters' codes."""
    out = np.full((*roles.shape, 4), -1, np.int8)
    for state in (START, SYSTEM, ASSISTANT):
        out[..., state][roles == ord("u")] = USER
    out[..., START][roles == ord("s")] = SYSTEM
    out[..., USER][roles == ord("a")] = ASSISTANT
    return out


def _with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs by state where rows may be inserted first; two are enough."""
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[..., NEXT])
    return cost


def cheapest(roles: list[np.ndarray], faults: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """Cost and edits (``K``, ``R``, ``D``, ``I`` in order; of the cheapest the first in ASCII) of each conversation, all at once.

    Arrays are laid out turn by turn over all conversations. Shorter ones begin later, so that all end together.
    """
    n = np.array([len(r) for r in roles], np.int64)
    longest, many = int(n.max(initial=0)), len(n)
    role, fault = np.zeros((longest, many), np.uint8), np.zeros((longest, many), np.uint8)
    for c, (r, f) in enumerate(zip(roles, faults, strict=True)):
        role[longest - n[c] :, c] = r
        fault[longest - n[c] :, c] = f
    costs = np.empty((longest + 1, many, 4), np.int64)  # to the end, by state
    costs[longest] = _with_inserts(np.broadcast_to(np.array([0, NEVER, NEVER, 0]), (many, 4)))
    here = np.arange(many)
    for t in range(longest - 1, -1, -1):
        after, kept = costs[t + 1], _kept(role[t])
        stays = np.where((fault[t] == BLANK) | (fault[t] == DUPLICATE), NEVER, np.where(fault[t] == CUT, TRUNCATED, 0))[:, None]
        keep = np.where(kept >= 0, np.take_along_axis(after, np.maximum(kept, 0).astype(np.int64), 1), NEVER)
        costs[t] = _with_inserts(np.minimum(DELETE + after, stays + np.minimum(keep, REROLE + after[:, NEXT])))
    at, state = longest - n, np.zeros(many, np.int64)
    total = costs[at, here, START]
    walked: list[list[int]] = [[] for _ in range(many)]
    while len(here):
        left, more = costs[at, here, state], at < longest
        open_ = ~((at == longest) & (left == 0))
        here, at, state, left, more = here[open_], at[open_], state[open_], left[open_], more[open_]
        row = np.minimum(at, longest - 1)
        down = np.minimum(at + 1, longest)
        stays = np.where(fault[row, here] == CUT, TRUNCATED, 0)
        kept = _kept(role[row, here])[np.arange(len(here)), state].astype(np.int64)
        sound = more & (fault[row, here] != BLANK) & (fault[row, here] != DUPLICATE)
        delete = more & (DELETE + costs[down, here, state] == left)
        insert = ~delete & (INSERT + costs[at, here, NEXT[state]] == left)
        keep = ~delete & ~insert & sound & (kept >= 0) & (stays + costs[down, here, np.maximum(kept, 0)] == left)
        state = np.where(delete, state, np.where(keep, kept, NEXT[state]))
        at = np.where(insert, at, down)
        for c, e in zip(here.tolist(), np.select([delete, insert, keep], [68, 73, 75], 82).tolist(), strict=True):
            walked[c].append(e)
    return total, [bytes(w) for w in walked]


class Conversation:
    """What is kept of a conversation's rows while they go by: codes, no texts."""

    def __init__(self, key):
        self.key, self.roles, self.faults, self.turns, self.seen = key, bytearray(), bytearray(), set(), set()

    def add(self, turn, letter: str, fault: int, digest: bytes) -> None:
        if fault != BLANK and digest in self.seen:
            fault = DUPLICATE
        self.seen.add(digest)
        self.roles.append(ord(letter) if letter and letter < "\x80" else 0)
        self.faults.append(fault)
        if turn is not None:
            self.turns.add(turn)

    def close(self) -> Conversation:
        """Set ``told``: gaps, rows by fault, and pairs of neighbours whose roles don't follow each other; only codes stay."""
        r = np.frombuffer(self.roles, np.uint8)
        a, b, s, u = r[:-1], r[1:], ord("s"), ord("u")
        fine = ((a == s) & (b == u)) | ((a == u) & (b == ord("a"))) | ((a == ord("a")) & (b == u))
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        self.told = gaps, *(self.faults.count(f) for f in (BLANK, DUPLICATE, CUT)), int((~fine).sum())
        self.turns = self.seen = None
        return self


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    held = None
    for batch in batches:
        for key, turn, letter, fault, digest in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held is None or held.key != key:
                if held is not None:
                    yield held.close()
                held = Conversation(key)
            if fault is not None:
                held.add(turn, letter, fault, digest)
    if held is not None:
        yield held.close()


def _together(found: Iterator[Conversation]) -> Iterator[list[Conversation]]:
    """Conversations put together by length (to the next power of two), as many as make TURNS turns."""
    waiting: dict[int, list[Conversation]] = {}
    for c in found:
        size = len(c.roles).bit_length()
        waiting.setdefault(size, []).append(c)
        if len(waiting[size]) << size >= TURNS:
            yield waiting.pop(size)
    yield from waiting.values()


REPAIRS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repairs(rows: DataFrame) -> DataFrame:
    """Faults, cost and edits of every conversation of ``rows`` (as :func:`sorted_rows` gives them).

    A row with a null ``role`` only says that there is such a conversation. Held at a time is a byte or two a turn of a conversation, and
    what tells equal rows; the edits come out as one text, so they are as long as that anyway.
    """
    narrow = rows.select("conv", "turn", F.left("role", F.lit(1)).alias("letter"), F.when(F.col("role").isNotNull(), _fault()).alias("fault"), _digest().alias("digest"), "tie", "copy")
    dealt = narrow.repartition("conv").sortWithinPartitions("conv", "turn", "tie", "copy").select("conv", "turn", "letter", "fault", "digest")
    schema = T.StructType([rows.schema["conv"], *T._parse_datatype_string(REPAIRS).fields])
    kind = pa.schema([("conv", _arrow(rows.schema["conv"].dataType)), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _together(_sorted_runs(batches)):
            costs, edits = cheapest([np.frombuffer(c.roles, np.uint8) for c in some], [np.frombuffer(c.faults, np.uint8) for c in some])
            out = [(c.key, *c.told, int(cost), e.decode()) for c, cost, e in zip(some, costs, edits, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return dealt.mapInArrow(repair, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _fault():
    """Blank or cut by the text alone; whether a row was there before is told where its conversation goes by."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)


def _digest():
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def sorted_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as the operators here take them: ``conv``, ``turn``, ``role``, ``text`` (null ones one space), ``tie``, ``copy``.

    Rows go by turn, null first; rows of one turn by the digest of role and text, then by ``copy``.
    """
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    return rows.select("*", _digest().alias("tie"), F.lit(0).alias("copy"))


def repaired_turns(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The rows of each conversation after its edits: ``conv``, ``place`` from 1, ``edit``, ``role``, ``text``."""
    kind = T.StructType([rows.schema["conv"], *T._parse_datatype_string("place long, edit string, role string, text string").fields])
    arrow = pa.schema([("conv", _arrow(rows.schema["conv"].dataType)), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, turns in _edited(batches):
            for place, turn in enumerate(turns, 1):
                out.append((key, place, *turn))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return _edits_first(rows, repaired).mapInArrow(give, kind)


def repaired_digests(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """``conv`` and ``repaired_sha256``, of the repaired ``role:text`` joined by line feeds, hashed as they go by."""
    kind = T.StructType([rows.schema["conv"], T.StructField("repaired_sha256", T.StringType())])
    arrow = pa.schema([("conv", _arrow(rows.schema["conv"].dataType)), ("repaired_sha256", pa.string())])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, turns in _edited(batches):
            digest = hashlib.sha256()
            for place, (_, role, text) in enumerate(turns):
                digest.update(f"{chr(10) * (place > 0)}{role}:{text}".encode())
            out.append((key, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return _edits_first(rows, repaired).mapInArrow(give, kind)


def _edits_first(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """Each conversation's edits (as ``text``), then its rows in order, in one partition."""
    edits = repaired.select("conv", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("tie"), F.lit(-1).alias("copy"))
    both = edits.unionByName(rows.where("role is not null")).withColumn("later", F.col("copy") >= 0)
    return both.repartition("conv").sortWithinPartitions("conv", "later", "turn", "tie", "copy").select("conv", "later", "role", "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each conversation its key and an iterator over (edit, role, text); each has to be taken whole before the next."""
    flow = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))

    def turns(edits: str) -> Iterator[tuple]:
        state = START
        for e in edits:
            new = "assistant" if state == USER else "user"
            if e == "I":
                yield e, new, ""
            else:
                _, _, role, text = next(flow)
                if e == "D":
                    continue
                if e == "R":
                    role = new
                yield e, role, text
                if role[:1] == "s":
                    state = SYSTEM
                    continue
            state = ASSISTANT if state == USER else USER

    for key, _, _, edits in flow:
        yield key, turns(edits)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the damage that the checksum of ``conv:turn`` names; a dropped row leaves one without a role."""
    name = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = rows.withColumn("__hit", F.crc32(name) % 20)
    text = F.when(F.col("__hit") == 1, "").when(F.col("__hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__hit") == 0, None).when(F.col("__hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("__hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv", "turn", role.alias("role"), text.alias("text"), "tie", copies.alias("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired text's digest of every conversation of the damaged table.

    Null roles and texts are one space, and so are null ids and turns in the checksum; a null ``conv_id`` is a conversation of its own. Rows of one
    turn (repeats, null turns) go by the digest of their role and text before damage. A role that starts with neither s, u nor a is never kept.
    """
    rows = damaged(sorted_rows(read_table(spark, sf_dir, "conversations")))
    found = repairs(rows)
    digests = repaired_digests(rows, found)
    joined = found.join(digests.withColumnRenamed("conv", "__conv"), F.col("conv").eqNullSafe(F.col("__conv")))
    return joined.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
