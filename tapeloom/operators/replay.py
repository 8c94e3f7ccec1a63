"""Order books from a tape, message by message: updates anchored on snapshots, and the state of a book after each message.

A snapshot starts a book anew, so a book is cut at its snapshots; which stretch a row is in is a running count over time buckets.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.operators.ordered import carried, running
from tapeloom.sources import written


def anchored_chain(updates: DataFrame, snapshots: DataFrame, book: str, order: list[str], first: str, last: str, keep: list[str], width: int) -> DataFrame:
    """Depth updates joined to the snapshots that they continue: ``segment`` (number of the snapshot in its book), ``event``.

    Updates carry a range of numbers (``first`` to ``last``), snapshots the number ``last`` that they stand at; both come in the order of
    ``order`` (a time as a whole number first; no two rows of a book are equal in it). A snapshot is joined with what is buffered since the snapshot before it
    and lies beyond its number, then with what follows until the next one. In a segment an update is ``bootstrap_update`` (buffered) or ``update`` where
    its range begins at the next number at the latest, ``equal_final_reapplication`` where it ends at the number reached, ``stale`` where it ends before that,
    ``sequence_gap`` where numbers are missing, and ``after_gap`` until the next snapshot. Updates of a book without any
    snapshot, and those only buffered before its first one and beyond none, are ``buffered``, without a segment.
    """
    shown = list(dict.fromkeys([book, *order, first, last, *keep]))
    marked = updates.select(*shown, F.lit(0).alias("__mark")).unionByName(snapshots.select(book, *order, last, F.lit(1).alias("__mark")), allowMissingColumns=True)
    counted = written(running(marked, book, order, width, sums={"segment": F.col("__mark")}), "segments")
    anchors = counted.where("__mark = 1").select(F.struct(F.col(book).alias("k")).alias("__book"), "segment", F.col(last).alias("__anchor"))
    # An update may continue the snapshot before it, and be buffered for the next one.
    roles = F.array(F.struct(F.col("segment").alias("segment"), F.lit(False).alias("buffered")), F.struct((F.col("segment") + 1).alias("segment"), F.lit(True).alias("buffered")))
    rows = counted.where("__mark = 0").withColumn("__book", F.struct(F.col(book).alias("k"))).withColumn("__first", F.col("segment") == 0).withColumn("__role", F.explode(roles))
    rows = rows.withColumns({"segment": F.col("__role.segment"), "__buffered": F.col("__role.buffered")})
    met = rows.join(anchors, ["__book", "segment"], "left")
    beyond = F.coalesce(F.col(last) > F.col("__anchor"), F.lit(False))
    # Each update has two rows; one that neither continues nor is beyond the next snapshot stays once, as buffered.
    met = met.where(F.when(F.col("__buffered"), beyond | (F.col("__first") & ~beyond)).otherwise(F.col("__anchor").isNotNull()))
    loose = met.where(F.col("__buffered") & ~beyond).select(*shown, F.lit(None).cast("long").alias("segment"), F.lit("buffered").alias("event"))
    held = met.where(~F.col("__buffered") | beyond).withColumn("__stretch", F.struct(F.col(book), F.col("segment")))

    def own(rows: DataFrame, w: Window) -> DataFrame:
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        # What a row needs reached before it, where the rows before it in the bucket don't reach that: a gap, unless the buckets before do.
        rows = rows.withColumn("__in", F.max(last).over(before)).withColumn("__need", F.when(~F.coalesce(F.col(first) - 1 <= F.col("__in"), F.lit(False)), F.col(first) - 1))
        return rows.withColumn("__missed", F.max("__need").over(before))

    def carry(buckets: DataFrame, before: Window, over: Window) -> DataFrame:
        held = buckets.withColumn("__until", F.greatest(F.max("__top").over(before), F.col("__base")))
        return held.withColumn("__lost", F.max(F.coalesce(F.col("__most") > F.col("__until"), F.lit(False))).over(before))

    held = carried(held, "__stretch", order, width, own, {"__top": F.max(last), "__most": F.max("__need"), "__base": F.max("__anchor")}, carry)
    held = held.withColumns({"__at": F.greatest("__until", "__in"), "__broken": F.coalesce("__lost", F.lit(False)) | F.coalesce(F.col("__missed") > F.col("__until"), F.lit(False))})
    event = F.when(F.col("__broken"), "after_gap").when(F.col(first) > F.col("__at") + 1, "sequence_gap").when(F.col(last) < F.col("__at"), "stale").when(F.col(last) == F.col("__at"), "equal_final_reapplication")
    event = event.when(F.col("__buffered"), "bootstrap_update").otherwise("update")
    return held.select(*shown, "segment", event.alias("event")).unionByName(loose)


def _digits(text: str) -> str:
    return text.replace(".", "").lstrip("0")


class _Book:
    """What books of levels and of orders have in common: the best prices of a side from ``best``."""

    def stands(self, said: tuple | None) -> bool:
        """Whether the best bid is below the best ask, and both are what is said of them (nothing, or None, says nothing)."""
        ends = [next(iter(self.best(side, 1)), None) for side in ("bid", "ask")]
        if None not in ends and ends[0] >= ends[1]:
            return False
        try:
            return all(x is None or Decimal(x) == end for x, end in zip(said or (), ends, strict=False))
        except ArithmeticError:
            return False


class Levels(_Book):
    """A book by price levels: a quantity of zero removes one, levels beyond ``depth`` of a side are dropped for good."""

    def __init__(self, depth: int):
        self.depth = depth
        self.clear()

    def clear(self) -> None:
        self.sides: dict[str, dict[Decimal, tuple[str, str]]] = {"ask": {}, "bid": {}}

    def copy(self) -> dict:
        return {side: dict(held) for side, held in self.sides.items()}

    def put_back(self, held: dict) -> None:
        self.sides = held

    def apply(self, side: str, price: str, quantity: str, *_) -> bool:
        try:
            at, size = Decimal(price), Decimal(quantity)
        except (ArithmeticError, TypeError):
            return False
        if side not in self.sides or not at.is_finite() or not size.is_finite() or size < 0:
            return False
        if size:
            self.sides[side][at] = (price, quantity)
        else:
            self.sides[side].pop(at, None)
        return True

    def best(self, side: str, n: int) -> list[Decimal]:
        return sorted(self.sides[side], reverse=side == "bid")[:n]

    def cut(self) -> int:
        gone = 0
        for side, held in self.sides.items():
            for price in sorted(held, reverse=side == "bid")[self.depth :]:
                del held[price]
                gone += 1
        return gone

    def digits(self, n: int) -> str:
        return "".join(_digits(x) for side in ("ask", "bid") for price in self.best(side, n) for x in self.sides[side][price])

    def size(self) -> int:
        return sum(map(len, self.sides.values()))


class Orders(_Book):
    """A book by orders: ``add``, ``modify`` and ``delete`` by id; a change must name an open order at its side and price. Price levels beyond ``depth`` go with all their orders."""

    def __init__(self, depth: int):
        self.depth = depth
        self.clear()

    def clear(self) -> None:
        self.orders: dict[str, list] = {}  # id: side, price, price text, quantity text, time, arrival
        self.arrived = 0

    def copy(self) -> dict:
        return {k: list(o) for k, o in self.orders.items()}

    def put_back(self, held: dict) -> None:
        self.orders = held

    def apply(self, side: str, price: str, quantity: str, event: str, order_id: str, time) -> bool:
        try:
            at, size = Decimal(price), Decimal(quantity)
        except (ArithmeticError, TypeError):
            return False
        held = self.orders.get(order_id)
        if event == "add":
            if held or side not in ("ask", "bid") or not size > 0:
                return False
            self.arrived += 1
            self.orders[order_id] = [side, at, price, quantity, time, self.arrived]
            return True
        if not held or held[:2] != [side, at] or event not in ("modify", "delete") or (event == "modify" and not size > 0):
            return False
        if event == "delete":
            del self.orders[order_id]
        else:
            held[2:5] = price, quantity, time
        return True

    def best(self, side: str, n: int) -> list[Decimal]:
        return sorted({o[1] for o in self.orders.values() if o[0] == side}, reverse=side == "bid")[:n]

    def cut(self) -> int:
        gone = [k for side in ("ask", "bid") for prices in [set(self.best(side, self.depth))] for k, o in self.orders.items() if o[0] == side and o[1] not in prices]
        for k in gone:
            del self.orders[k]
        return len(gone)

    def digits(self, n: int) -> str:
        out = []
        for side in ("ask", "bid"):
            place = {p: i for i, p in enumerate(self.best(side, n))}
            out += sorted((place[o[1]], o[4], o[5], _digits(o[2]) + _digits(o[3])) for o in self.orders.values() if o[0] == side and o[1] in place)
        return "".join(x[3] for x in out)

    def size(self) -> int:
        return len(self.orders)


def book_states(changes: DataFrame, book: str, message: list[str], place: str, snapshot: Column, columns: list[str], depth: int, width: int, orders: bool = False, strict: bool = True, levels: int = 10, atomic: bool = False, stated: tuple[str, str] | None = None) -> DataFrame:
    """The state of each book after each message: ``checksum`` (CRC32 of the ``digits`` of its best levels, asks first), ``size``, ``cut``, ``refused``, ``status``.

    ``changes`` has a row for each level (``columns``: side, price, quantity as texts) or order (and then event, id, time) that a message changes, in the order of
    ``place``; ``message`` orders messages in a book, a time as a whole number first. Rows of a snapshot start the book anew. After each message what is
    beyond ``depth`` price levels of a side is dropped and doesn't come back by itself. A change that doesn't fit is counted as refused; if
    ``strict``, the book is ``broken`` from there until its next snapshot, without a state, else it is skipped. Before the first snapshot a book is ``unanchored``.

    With ``atomic`` a message is tried on a copy of the book: it is ``rejected`` as a whole, and the book stays as it was, if a change doesn't fit, if its best bid would not be
    below its best ask, or if the best prices it states (columns ``stated``: bid and ask, on its first row, null if it states none) are not those of the book then. A
    rejected snapshot leaves the book unanchored.

    Only the book at hand is held, ``depth`` levels a side and the orders in them; the stretch from one snapshot to the next is replayed in one task, row by row as it streams by.
    """
    ranked = changes.select(F.col(book).alias("book"), *[F.col(m).cast("long").alias(f"m{i}") for i, m in enumerate(message)], F.col(place).cast("long").alias("place"), snapshot.alias("snap"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate([*columns, *(stated or ())])])
    order = [f"m{i}" for i in range(len(message))]
    begins = F.when(F.col("snap") & (F.col("place") == 0), 1).otherwise(0)
    rows = running(ranked, "book", [*order, "place"], width, sums={"stretch": begins})
    dealt = rows.repartition("book", "stretch").sortWithinPartitions("book", "stretch", *order, "place").select("book", "stretch", *order, "snap", *[f"c{i}" for i in range(len(columns) + len(stated or ()))])
    kinds = changes.schema
    schema = f"`{book}` {kinds[book].dataType.simpleString()}, " + ", ".join(f"`{m}` long" for m in message) + ", status string, checksum long, digits string, size int, cut int, refused int"
    n = len(order)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    columns_n = len(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Orders(depth) if orders else Levels(depth)
        flow = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True))
        stretch, fine, begun, fresh, out = None, True, True, True, []
        for (name, part, *at), held in itertools.groupby(flow, key=lambda r: r[: 2 + n]):
            if (name, part) != stretch:
                stretch, fine, begun = (name, part), True, part > 0
                state.clear()
                fresh = True
            refused, before, said = 0, state.copy() if atomic and begun else None, None
            for row in held:
                said = said or row[3 + n + columns_n :]
                if begun and not (fine and state.apply(*row[3 + n : 3 + n + columns_n])):
                    refused += 1
            if atomic and begun:
                if refused or not state.stands(said):
                    state.put_back(before)
                    begun = not fresh
                    out.append((name, *at, "rejected", None, None, state.size() if begun else None, 0, refused))
                    fresh = False
                    continue
                fresh = False
            fine = fine and not (strict and refused and not atomic)
            if begun and fine:
                cut, digits = state.cut(), state.digits(levels)
                out.append((name, *at, "ok", zlib.crc32(digits.encode()), digits, state.size(), cut, refused))
            else:
                out.append((name, *at, "broken" if begun else "unanchored", None, None, None, None, refused if begun else None))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(fold, schema)
