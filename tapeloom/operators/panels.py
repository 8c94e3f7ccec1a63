"""Audits of series and panels: validators in one pass, duplicates by preference, clocks, due slots, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.scalars import bucket, finite
from tapeloom.operators.ordered import holes, numbered, running, with_previous


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """One row: the number of rows, and for each rule how many break it; a rule that can't be told is broken."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def candle_rules(o: str, h: str, l: str, c: str, v: str) -> dict[str, Column]:  # noqa: E741
    """Rules of a bar: all prices positive, the high above and the low below both ends, a volume of zero or more."""
    prices = [F.col(x) for x in (o, h, l, c)]
    return {
        "bad_price": reduce(lambda a, b: a & b, [p > 0 for p in prices]),
        "bad_high": F.col(h) >= F.greatest(o, c, l),
        "bad_low": F.col(l) <= F.least(o, c, h),
        "bad_volume": F.col(v) >= 0,
        "not_finite": finite(*[p.cast("double") for p in prices]),
    }


def preferred(df: DataFrame, keys: list[str], source: str, values: list[str], latest: bool = False) -> DataFrame:
    """One row for each key, from the source first (or last) in order; combined before the shuffle, no window."""
    pick = (F.max if latest else F.min)(F.struct(source, *values)).alias("__r")
    return df.groupBy(*keys).agg(pick, F.count("*").alias("n")).select(*keys, F.col(f"__r.{source}").alias(source), *[F.col(f"__r.{v}").alias(v) for v in values], "n")


def superseded(finer: DataFrame, coarser: DataFrame, period: Column, name: str = "period") -> DataFrame:
    """Rows of both, without those of ``finer`` in a period that ``coarser`` has."""
    held = coarser.select(period.alias(name)).distinct()
    kept = finer.withColumn(name, period).join(held, name, "left_anti").drop(name)
    return kept.withColumn("source", F.lit("finer")).unionByName(coarser.withColumn("source", F.lit("coarser")))


def clock_audit(df: DataFrame, key: str, order: list[str], time: str, step: int, width: int) -> DataFrame:
    """Steps of a clock by key: duplicates, steps backwards and gaps, and the first row that has one."""
    moved = with_previous(df, key, order, [time], width).withColumn("__d", F.col(time) - F.col(f"previous_{time}"))
    kinds = F.when(F.col("__d") == 0, "duplicate").when(F.col("__d") < 0, "backwards").when(F.col("__d") > step, "gap")
    counts = {"duplicates": "duplicate", "backwards": "backwards", "gaps": "gap"}
    return moved.withColumn("__k", kinds).groupBy(key).agg(*[F.count_if(F.col("__k") == v).alias(n) for n, v in counts.items()], F.min(F.when(F.col("__k").isNotNull(), F.col(order[0]))).alias("first_bad"))


def irregular_holes(df: DataFrame, key: str, time: str, step: str, slack: int, width: int) -> DataFrame:
    """Neighbouring rows further apart than the larger of their own steps (a column) and a slack; of rows at one time the last in order of steps counts before a hole, the first after it."""
    ends = df.where(F.col(time).isNotNull()).groupBy(key, time).agg(F.min(step).alias("__low"), F.max(step).alias("__high"))
    held = with_previous(ends, key, [time], [time, "__high"], width)
    far = F.col(time) - F.col(f"previous_{time}") > F.greatest("previous___high", "__low") + slack
    return held.where(far).select(key, F.col(f"previous_{time}").alias("hole_from"), F.col(time).alias("hole_to"))


def due_slots(df: DataFrame, key: str, time: str, step: int) -> DataFrame:
    """Slots due after a row and before the next one of its key, where there is none: ``due``."""
    gaps = holes(df, key, time, 2 * step - 1)
    return gaps.select(key, F.explode(F.sequence(F.col("hole_from") + step, F.col("hole_to") - step, F.lit(step))).alias("due"))


def consecutive_runs(df: DataFrame, key: str, index: str, width: int = 10_000) -> DataFrame:
    """Runs of consecutive numbers of a key: ``first``, ``last``, ``n``."""
    held = numbered(df.where(F.col(index).isNotNull()).select(key, index).distinct(), key, [index], width, "__n")
    return held.withColumn("__i", F.col(index) - F.col("__n")).groupBy(key, "__i").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("__i")


def span_holes(spans: DataFrame, key: str, width: int) -> DataFrame:
    """Holes between the end of what came before and the next span of a key."""
    held = running(spans.groupBy(key, "start").agg(F.max("stop").alias("stop")), key, ["start"], width, maxes={"hole_from": F.col("stop")}, before=True)
    return held.where(F.col("start") > F.col("hole_from")).select(key, "hole_from", F.col("start").alias("hole_to"))


def axis_steps(df: DataFrame, time: str, width: int) -> DataFrame:
    """One row on the axis of a panel: its slots, first and last, the different steps between neighbours, and rows off the grid."""
    axis = df.select(F.col(time).alias("a")).distinct()
    ahead = axis.select((F.col("a") + width).alias("a"))
    even = axis.join(ahead, "a", "left_semi").agg(F.count("*").alias("even"))
    return axis.agg(F.count("*").alias("slots"), F.min("a").alias("first"), F.max("a").alias("last"), F.count_if(F.pmod("a", F.lit(width)) != 0).alias("off_grid")).crossJoin(F.broadcast(even))


def latest_per_key(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key with their place from the end."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def best_levels(df: DataFrame, key: str, side: str, price: str, quantity: str, depth: int) -> DataFrame:
    """The ``depth`` best levels of each side: bids from the highest price down, asks from the lowest up; levels without quantity are gone."""
    rank = F.when(F.col(side) == "bid", -F.col(price)).otherwise(F.col(price))
    return df.where(F.col(quantity) > 0).withColumn("level", F.row_number().over(Window.partitionBy(key, side).orderBy(rank, quantity))).where(F.col("level") <= depth)


def slots_of(df: DataFrame, time: str, width: int, name: str = "slot") -> DataFrame:
    """The slots in which there are rows."""
    return df.select(bucket(F.col(time), width).alias(name)).distinct()
