"""Joins in time: by exact offset, as-of within a bound, onto a complete grid, by containment.

Bounded searches cut time into buckets of the bound and send a row to the one or two buckets in which it can
be found. A key with very many rows is thereby spread over its buckets, and no key is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.scalars import bucket
from tapeloom.operators.ordered import running


def offset_join(df: DataFrame, time: str, offset: int, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Each row with the ``values`` of the row exactly ``offset`` earlier (``prior_<value>``); a hole gives null."""
    keys = keys or []
    earlier = df.select(*keys, (F.col(time) + offset).alias(time), *[F.col(v).alias(f"prior_{v}") for v in values])
    return df.join(earlier, [*keys, time], "left")


def _asof(left: DataFrame, right: DataFrame, key: str, time: str, bound: int, value: str, forward: bool) -> DataFrame:
    at = bucket(F.col(time), bound)
    reach = F.explode(F.array(at, at + (-1 if forward else 1))).alias("__b")
    asks = left.select("*", at.alias("__b"), F.lit(1).alias("__ask"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast("long").alias("__t"))
    offers = right.select(key, time, reach, F.lit(0).alias("__ask"), F.col(value).alias("__v"), F.col(time).alias("__t"))
    rows = asks.unionByName(offers, allowMissingColumns=True)
    order = [F.col(time).desc() if forward else F.col(time).asc(), F.col("__ask").asc(), F.col("__v").desc() if forward else F.col("__v").asc()]
    w = Window.partitionBy(key, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__f", F.last(F.when(F.col("__ask") == 0, F.struct("__t", "__v")), ignorenulls=True).over(w)).where("__ask = 1")
    near = F.abs(F.col("__f.__t") - F.col(time)) <= bound
    return found.select(*left.columns, F.when(near, F.col("__f.__t")).alias(f"{value}_time"), F.when(near, F.col("__f.__v")).alias(value))


def asof_backward(left: DataFrame, right: DataFrame, key: str, time: str, bound: int, value: str) -> DataFrame:
    """``left`` with ``value`` and time of the latest row of ``right`` at or before it, at most ``bound`` ago.

    Of equal times the largest value counts. Rows without a find, or with a null key or time, get nulls.
    """
    return _asof(left, right, key, time, bound, value, False)


def asof_forward(left: DataFrame, right: DataFrame, key: str, time: str, bound: int, value: str) -> DataFrame:
    """As :func:`asof_backward`, with the earliest row at or after it; of equal times the smallest value counts."""
    return _asof(left, right, key, time, bound, value, True)


def spine(df: DataFrame, time: str, width: int, name: str = "bucket") -> DataFrame:
    """Every bucket from the first to the last of ``df``, without holes, made in as many tasks as the session has by default."""
    b = bucket(F.col(time), width)
    low, high = df.agg(F.min(b), F.max(b)).first()
    return df.sparkSession.range(0 if low is None else low, 0 if low is None else high + 1).toDF(name)


def dense_grid(df: DataFrame, time: str, width: int, **measures: Column) -> DataFrame:
    """``bucket`` from the first to the last, with the measures aggregated in each; empty buckets have nulls."""
    own = df.groupBy(bucket(F.col(time), width).alias("bucket")).agg(*[c.alias(n) for n, c in measures.items()])
    return spine(df, time, width).join(own, "bucket", "left")


def missing_slots(df: DataFrame, time: str, width: int) -> DataFrame:
    """Buckets between the first and the last row in which there is no row."""
    return spine(df, time, width).join(df.select(bucket(F.col(time), width).alias("bucket")).distinct(), "bucket", "left_anti")


def followed_within(left: DataFrame, right: DataFrame, key: str, time: str, bound: int) -> DataFrame:
    """The rows of ``left`` for which ``right`` has a row of the same key in ``[time, time + bound]``."""
    at = lambda c: bucket(F.col(c), bound)
    offers = right.select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.explode(F.array(at(time), at(time) - 1)).alias("__b")).distinct()
    lhs = left.withColumn("__b0", at(time))
    cond = (F.col(key) == F.col("__k")) & (F.col("__b0") == F.col("__b")) & F.col("__t").between(F.col(time), F.col(time) + bound)
    return lhs.join(offers, cond, "left_semi").drop("__b0")


def sum_between_closes(bars: DataFrame, events: DataFrame, time: str, value: str, width: int) -> DataFrame:
    """Bars on a regular grid of closes with the sum of events in ``(close - width, close]``; none gives null."""
    close = (-bucket(-F.col(time), width) * width).alias("close")
    return bars.join(events.groupBy(close).agg(F.sum(value).alias(value)), "close", "left")


def intersect_spans(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Non-empty intersections of the spans (``key``, ``start``, ``stop``) of two tables.

    Time is cut into buckets of ``width``, a span goes to each bucket it touches, and a pair is given out in the
    bucket in which its intersection starts; so a hot key is spread over its buckets. ``width`` should be a span's usual length.
    """
    cut = lambda df: df.withColumn("__b", F.explode(F.sequence(bucket(F.col("start"), width), bucket(F.col("stop") - 1, width)))) if df is not None else None
    held = lambda df: cut(df.where("start < stop"))
    other = held(b).select(key, "__b", F.col("start").alias("__s"), F.col("stop").alias("__e"))
    met = held(a).join(other, [key, "__b"]).where((F.col("start") < F.col("__e")) & (F.col("__s") < F.col("stop")))
    met = met.where(F.col("__b") == bucket(F.greatest("start", "__s"), width))
    return met.select(key, F.greatest("start", "__s").alias("start"), F.least("stop", "__e").alias("stop"))


def _pieces(start: Column, stop: Column, levels: int) -> Column:
    """The dyadic pieces (``level``, ``piece``) that make up ``[start, stop)``: at most two a level. A piece of level l has the numbers from piece * 2^l on."""

    def at(level: Column) -> Column:
        a, b = F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level), F.call_function("shiftright", stop, level)
        piece = lambda p, there: F.when(there & (a < b), F.struct(level.alias("level"), p.alias("piece")))
        return F.array_compact(F.array(piece(a, F.pmod(a, F.lit(2)) == 1), piece(b - 1, F.pmod(b, F.lit(2)) == 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def known_at(facts: DataFrame, asks: DataFrame, key: str, values: list[str], width: int) -> DataFrame:
    """Bitemporal look-up: for each ask (``ask``, ``key``, ``received``, ``event``) the fact that was seen by then and whose interval holds the event.

    Facts have ``observed``, ``valid_from``, ``valid_to`` (exclusive, null if open). Of facts with one ``valid_from`` the first observed counts; where
    not exactly one is left, the values are null. All times are whole numbers, ``ask`` is unique.

    An interval goes to the dyadic pieces that it is made of, an ask to the pieces around its event, one a level; in a piece all intervals hold the event, so
    how many were seen by then is a running count (over buckets of ``width``), whatever the number of facts that hold it. Rows are facts and asks times the levels.
    """
    first = facts.where(F.col("valid_from").isNotNull()).groupBy(key, "valid_from").agg(F.min(F.struct("observed", "valid_to", *values)).alias("f")).select(key, "valid_from", "f.*")
    low, high, last = first.agg(F.min("valid_from"), F.max(F.greatest("valid_from", "valid_to")), F.lit(0)).first()
    ends = asks.agg(F.max("event")).first()[0]
    if low is None or ends is None:
        return asks.select(*asks.columns, *[F.lit(None).cast(facts.schema[v].dataType).alias(v) for v in values])
    beyond = max(high, ends) + 1
    levels = max(1, (beyond - low).bit_length())
    stop = F.coalesce("valid_to", F.lit(beyond).cast("long")) - low
    lane = F.struct(F.col(key).alias("key"), F.col("__p.level").alias("level"), F.col("__p.piece").alias("piece")).alias("__lane")
    seen = first.withColumn("__p", F.explode(_pieces(F.col("valid_from") - low, stop, levels)))
    seen = seen.select(lane, F.col("observed").alias("__t"), F.lit(0).alias("__ask"), F.struct("valid_from", *values).alias("__v"), F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"))
    around = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", F.col("event") - low, level).alias("piece")))
    asked = asks.where((F.col("event") >= low) & F.col("received").isNotNull()).withColumn("__p", F.explode(around))
    asked = asked.select(lane, F.col("received").alias("__t"), F.lit(1).alias("__ask"), F.lit(None).cast(seen.schema["__v"].dataType).alias("__v"), "ask")
    counted = running(seen.unionByName(asked), "__lane", ["__t", "__ask"], width, sums={"__n": 1 - F.col("__ask")}, lasts={"__found": F.col("__v")})
    one = counted.where("__ask = 1").groupBy("ask").agg(F.sum("__n").alias("__n"), F.max("__found").alias("__v")).where("__n = 1")
    return asks.join(one, "ask", "left").select(*asks.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def uncovered(expected: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    """Expected rows that are not held: empty where coverage is complete."""
    return expected.join(held.select(*on).distinct(), on, "left_anti")


def paired_by_month(primary: DataFrame, control: DataFrame, ts: str, value: str) -> DataFrame:
    """Decisions on the last day of a month beside those on the 15th of the same month; the last of a day counts."""
    from tapeloom.functions.scalars import calendar_key

    def chosen(df: DataFrame, is_control: bool, name: str) -> DataFrame:
        keyed = df.withColumn("month", calendar_key(F.col(ts), is_control)).where("month is not null")
        return keyed.groupBy("month").agg(F.max_by(value, F.struct(ts, value)).alias(name))

    return chosen(primary, False, "primary").join(chosen(control, True, "control"), "month")


def lanes_of(df: DataFrame, key: str, lane: str) -> DataFrame:
    """For each key the lanes it occurs in, in order, and how many."""
    return df.select(key, lane).distinct().groupBy(key).agg(F.array_sort(F.collect_set(lane)).alias("lanes"), F.count("*").alias("n"))


def total_order(streams: dict[str, DataFrame], order: list[str], columns: list[str]) -> DataFrame:
    """Rows of several streams as one, ordered by ``order``, then by the streams' places in the mapping."""
    merged = [df.select(F.lit(n).alias("rank"), F.lit(name).alias("stream"), *columns) for n, (name, df) in enumerate(streams.items())]
    out = merged[0]
    for df in merged[1:]:
        out = out.unionByName(df)
    return out.orderBy(*order, "rank")
