"""Order books and sequences from a tape: levels after the last snapshot, sequence audits, qualified windows, last states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.scalars import book_checksum
from tapeloom.operators.ordered import WIDE, holes, running, trailing_sum, with_previous


def open_levels(updates: DataFrame, book: str, order: list[str], side: str, level: list[str], quantity: str, snapshot: Column) -> DataFrame:
    """Levels (or orders) of each book after all updates: the last quantity (a number or its text) of each since the last snapshot, without those at zero.

    Combined before the shuffle; a book with very many updates is not gathered.
    """
    rank = F.struct(*order)
    marks = updates.groupBy(book).agg(F.max(F.when(snapshot, rank)).alias("__from"))
    since = updates.withColumn("__rank", rank).join(marks, book).where(F.col("__from").isNull() | (F.col("__rank") >= F.col("__from")))
    last = since.groupBy(book, side, *level).agg(F.max_by(quantity, "__rank").alias(quantity))
    return last.where(F.col(quantity).try_cast("decimal(38,10)") > 0)


def checksums(levels: DataFrame, book: str, side: str, price: str, quantity: str, depth: int = 10) -> DataFrame:
    """CRC32 of the ``depth`` best levels of each book; prices and quantities are texts. Only those levels leave the tasks that rank them."""
    number = F.col(price).cast("decimal(38,10)")
    rank = F.when(F.col(side) == "bid", -number).otherwise(number)
    levels = levels.withColumn("__level", F.row_number().over(Window.partitionBy(book, side).orderBy(rank, price, quantity))).where(F.col("__level") <= depth)
    item = F.struct(rank.alias("rank"), F.col(price).alias("price"), F.col(quantity).alias("qty"))
    sides = {n: F.array_sort(F.collect_list(F.when(F.col(side) == n, item))) for n in ("ask", "bid")}
    return levels.groupBy(book).agg(*[v.alias(n) for n, v in sides.items()]).select(book, book_checksum(F.col("ask"), F.col("bid"), depth).alias("checksum"))


def sequence_audit(df: DataFrame, key: str, order: list[str], first: str, last: str, width: int) -> DataFrame:
    """What the numbers of a message (``first`` to ``last``) are after those before it: ``start``, ``next``, ``gap``, ``repeat`` or ``overlap``, and how many are missing."""
    held = running(df, key, order, width, maxes={"__b": F.col(last)}, before=True)
    kind = F.when(F.col("__b").isNull(), "start").when(F.col(first) == F.col("__b") + 1, "next").when(F.col(first) > F.col("__b") + 1, "gap").when(F.col(last) <= F.col("__b"), "repeat").otherwise("overlap")
    return held.withColumn("sequence", kind).withColumn("missing", F.when(F.col("sequence") == "gap", F.col(first) - F.col("__b") - 1).otherwise(0)).drop("__b")


def change_chain(df: DataFrame, book: str, order: list[str], previous: str, current: str, snapshot: Column, width: int) -> DataFrame:
    """Each message of a book by the rule of change numbers: ``snapshot``, ``update`` where ``previous`` is the number before it, ``gap`` where it isn't, then ``invalid`` until
    the next snapshot; ``unanchored`` before the first."""
    held = df.withColumn("__snap", F.coalesce(snapshot, F.lit(False)))
    held = running(held, book, order, width, sums={"__part": F.col("__snap").cast("int")}).withColumn("__stretch", F.struct(F.col(book), F.col("__part")))
    held = with_previous(held, "__stretch", order, [current], width)
    off = ~F.col("__snap") & ~F.coalesce(F.col(previous) == F.col(f"previous_{current}"), F.lit(False))
    held = running(held.withColumn("__off", off.cast("int")), "__stretch", order, width, maxes={"__broken": F.col("__off")}, before=True)
    state = F.when(F.col("__part") == 0, "unanchored").when(F.col("__snap"), "snapshot").when(F.col("__broken") == 1, "invalid").when(F.col("__off") == 1, "gap").otherwise("update")
    return held.select(*df.columns, state.alias("state"))


def id_coverage(df: DataFrame, key: str, order: list[str], number: str, boundary: Column, width: int) -> DataFrame:
    """Numbered prints after a snapshot: ``state`` and, for a gap, the range of numbers (``missing_from``, ``missing_to``) that was skipped.

    ``boundary`` is the number that a snapshot row stands at (null for prints); what was before the first snapshot is ``before``, a print up to
    the boundary is ``covered``. Beyond it a print is ``next``, ``gap``, or ``error`` if its number is not above all before it.
    """
    held = df.withColumn("__edge", boundary)
    held = running(held, key, order, width, lasts={"__at": F.col("__edge")}, maxes={"__top": F.greatest(F.col("__edge"), F.when(F.col("__edge").isNull(), F.col(number)))}, before=True)
    prints = held.where("__edge is null")
    reached = F.greatest("__at", "__top")
    state = F.when(F.col("__at").isNull(), "before").when(F.col(number) <= F.col("__at"), "covered").when(F.col(number) <= reached, "error").when(F.col(number) == reached + 1, "next").otherwise("gap")
    out = prints.withColumn("state", state)
    gap = F.col("state") == "gap"
    return out.select(*df.columns, "state", F.when(gap, reached + 1).alias("missing_from"), F.when(gap, F.col(number) - 1).alias("missing_to"))


def qualified_windows(df: DataFrame, key: str, order: list[str], time: str, breaks: Column, usable: Column, width: int, recovers: Column | None = None) -> DataFrame:
    """Stretches of usable rows between breaks: ``start``, ``stop``, ``n``. A break closes a stretch and is in none.

    With ``recovers``, nothing counts from a break on until a row that recovers (which is in no stretch itself): a blackout. A row that breaks and recovers breaks.
    """
    held = df.withColumns({"__break": F.coalesce(breaks, F.lit(True)), "__bad": F.coalesce(breaks | ~usable, F.lit(True))})
    if recovers is not None:
        light = F.when(F.col("__break"), 0).when(recovers, 1)
        held = running(held, key, order, width, lasts={"__light": light})
        held = held.withColumn("__bad", F.col("__bad") | F.coalesce(recovers, F.lit(False)) | (F.coalesce("__light", F.lit(1)) == 0))
    runs = running(held, key, order, width, sums={"__run": F.col("__bad").cast("int")}).where(~F.col("__bad"))
    return runs.groupBy(key, "__run").agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("n")).drop("__run")


def valid_state(df: DataFrame, key: str, order: list[str], value: str, invalidates: Column) -> DataFrame:
    """The last value of each key after its last invalidation; null where nothing came after it."""
    rank = F.struct(*order)
    made = df.groupBy(key).agg(F.max(F.when(invalidates, rank)).alias("__i"), F.max(F.when(~invalidates & F.col(value).isNotNull(), F.struct(rank.alias("r"), F.col(value).alias("v")))).alias("__v"))
    return made.select(key, F.when(F.col("__i").isNull() | (F.col("__v.r") > F.col("__i")), F.col("__v.v")).alias(value))


def silences(df: DataFrame, key: str, time: str, deadline: int, end: int) -> DataFrame:
    """Stretches without a row of a stream that last longer than the deadline, up to ``end``."""
    between = holes(df, key, time, deadline).select(key, F.col("hole_from").alias("quiet_from"), F.col("hole_to").alias("quiet_to"))
    last = df.groupBy(key).agg(F.max(time).alias("quiet_from")).where(end - F.col("quiet_from") > deadline)
    return between.unionByName(last.withColumn("quiet_to", F.lit(end)))


def order_flow(df: DataFrame, key: str, time: str, bid: str, bid_size: str, ask: str, ask_size: str, order: list[str], span: int) -> DataFrame:
    """Order-flow imbalance of quotes over ``(time - span, time]``, and the imbalance of the queues now."""
    moved = with_previous(df, key, order, [bid, bid_size, ask, ask_size], WIDE * span).drop("ordinal")
    before = lambda c: F.col(f"previous_{c}")
    up = F.when(F.col(bid) >= before(bid), F.col(bid_size)).otherwise(0) - F.when(F.col(bid) <= before(bid), before(bid_size)).otherwise(0)
    down = F.when(F.col(ask) <= before(ask), F.col(ask_size)).otherwise(0) - F.when(F.col(ask) >= before(ask), before(ask_size)).otherwise(0)
    flow = moved.select(*df.columns, F.coalesce(up - down, F.lit(0)).alias("flow"))
    total = F.col(bid_size) + F.col(ask_size)
    return trailing_sum(flow, key, time, "flow", span, "pressure").withColumn("queue", F.when(total > 0, (F.col(bid_size) - F.col(ask_size)) / total))
