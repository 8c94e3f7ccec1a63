"""Ranks within groups of any size: splitters deal a group into buckets in order, counts of the buckets before make places exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.operators.ordered import running

#: Buckets of a group at most, about; one row in so many is drawn as a splitter, so smaller groups have one bucket; salts of a join of rows with their group.
SPLITS, LEAST_ROWS, SALTS = 1024, 1_000_000, 16


def attach(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row a group, null keys equal), joined on salted keys, so that a group with very many rows is spread."""
    salted = rows.withColumns({"__g": F.struct(*on), "__salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    held = groups.withColumn("__g", F.struct(*on)).drop(*on).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(held, ["__g", "__salt"]).drop("__g", "__salt")


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank", least_rows: int = LEAST_ROWS) -> DataFrame:
    """``rank`` (from 1) of each row in its group by ``order``, ascending, null first, and ``group_rows``; equal rows get different ranks.

    Splitters are rows drawn by their hash, of those SPLITS a group at equal steps; a bucket is what lies between two of them, so buckets are in order whatever
    was drawn. No task holds a group; rows are shuffled once to their splitters and once to their bucket.
    """
    held = df.withColumn("__o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).withColumn("__all", F.lit(0))
    groups = ["__all", *groups]
    drawn = F.when(F.pmod(F.xxhash64("__o"), F.lit(least_rows)) == 0, F.col("__o"))
    splitters = held.groupBy(*groups).agg(F.count("*").alias("group_rows"), F.array_sort(F.collect_set(drawn)).alias("__s"))
    apart = F.greatest(F.ceil(F.size("__s") / SPLITS), F.lit(1))
    splitters = splitters.withColumn("__s", F.filter("__s", lambda s, i: i % apart == 0))
    dealt = attach(held, splitters, groups).withColumn("__b", F.size(F.filter("__s", lambda s: s <= F.col("__o")))).drop("__s")
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("__g", F.struct(*groups))
    skipped = dealt.groupBy("__g", "__b").agg(F.count("*").alias("__n")).select("__g", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__skip"))
    placed = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__o")))
    return placed.join(skipped, ["__g", "__b"]).select(*df.columns, (F.col("__i") + F.col("__skip")).alias(name), "group_rows")


def cross_section_rank(df: DataFrame, day: str, value: str, tie: str, eligible: Column, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``rank`` from 1 by falling value within a day, ties by ``tie``, and ``ranked``, how many are; both null for rows that are not eligible."""
    held = df.withColumn("__e", F.coalesce(eligible, F.lit(False)))
    out = ranked(held, [day, "__e"], [F.col(value).isNull(), -F.col(value), F.col(tie)], "__r", least_rows)
    return out.select(*df.columns, F.when(F.col("__e"), F.col("__r")).alias("rank"), F.when(F.col("__e"), F.col("group_rows")).alias("ranked"))


def legs(ranked_rows: DataFrame, percent: int) -> DataFrame:
    """``leg`` 1 for the top and -1 for the bottom ``percent`` of the ``ranked`` rows of a day (see :func:`cross_section_rank`), rounded down; else 0."""
    size = F.floor(F.col("ranked") * percent / 100)
    return ranked_rows.withColumn("leg", F.when(F.col("rank") <= size, 1).when(F.col("rank") > F.col("ranked") - size, -1).otherwise(0))


def adjusted_p(df: DataFrame, p: str, tie: str, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg adjusted values of a family of tests (one row a test, ``tie`` unique), of any size."""
    held = ranked(df, [], [F.col(p), F.col(tie)], "__r", least_rows).withColumn("__one", F.lit(0))
    m, r, v = F.col("group_rows"), F.col("__r"), F.col(p)
    held = held.withColumns({"__r": r.cast("long"), "__up": (m - r).cast("long"), "bonferroni": F.least(F.lit(1.0), v * m)})
    held = running(held, "__one", ["__r"], least_rows, maxes={"__h": v * (m - r + 1)})
    held = running(held, "__one", ["__up"], least_rows, maxes={"__b": -(v * m / r)})
    return held.select(*df.columns, "bonferroni", F.least(F.lit(1.0), "__h").alias("holm"), F.least(F.lit(1.0), -F.col("__b")).alias("bh"))
