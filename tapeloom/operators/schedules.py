"""Schedules that look back at what they chose: greedy selection, hysteresis, episodes, positions.

A greedy choice of one span at a time is a chain: after a row comes the first row that starts when it has stopped. Chains are followed within blocks of
rows, all blocks at once, and from block to block by doubling: the row at which a block is left, then the one two blocks are left, four, and so on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapeloom.functions.scalars import bucket
from tapeloom.operators.ordered import numbered, running
from tapeloom.sources import written

#: Rows of a block within which a chain is followed in one task.
BLOCK = 65_536


def _followers(df: DataFrame, key: str, start: str, stop: str, tie: str, width: int) -> DataFrame:
    """Rows with ``__n``, their number by start and tie, and ``__next``, that of the first row after them that starts when they have stopped."""
    rows = numbered(df, key, [start, tie], width, "__n")
    offers = rows.select(F.col(key).alias("__key"), (-F.col(start)).alias("__t"), F.lit(0).alias("__ask"), (-F.col("__n")).alias("__m"), F.col("__n").alias("__offer"), F.lit(None).cast("long").alias("__n"))
    asks = rows.select(F.col(key).alias("__key"), (-F.col(stop)).alias("__t"), F.lit(1).alias("__ask"), F.col("__n").alias("__m"), F.lit(None).cast("long").alias("__offer"), "__n")
    # From the latest time back, the last offer passed is the first one that starts at or after a stop.
    found = running(offers.unionByName(asks), "__key", ["__t", "__ask", "__m"], width, lasts={"__next": F.col("__offer")}).where("__ask = 1")
    nexts = found.select(F.struct(F.col("__key").alias("k")).alias("__k"), "__n", F.when(F.col("__next").isNotNull(), F.greatest("__next", F.col("__n") + 1)).alias("__next"))
    counted = rows.withColumn("__k", F.struct(F.col(key).alias("k")))
    return counted.join(nexts, ["__k", "__n"])


def _left(block: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each row of a block leaves it (-1: it ends)."""
    block = block.sort_values("__n")
    n, follow = block["__n"].to_numpy(), block["__next"].fillna(-1).to_numpy().astype(np.int64)
    base, last = n[0], n[-1]
    while (inside := (follow >= base) & (follow <= last)).any():
        follow[inside] = follow[follow[inside] - base]
    return pd.DataFrame({"__k": block["__k"], "__n": n, "__next": follow})


def non_overlapping(df: DataFrame, key: str, start: str, stop: str, tie: str, width: int, block: int | None = None) -> DataFrame:
    """The rows a greedy choice takes in order of their start, one open at a time; a row may start when another stops.

    Starts and stops are whole numbers, ``tie`` is unique among rows of a key that start together; rows without a start or stop are never taken. ``width`` is
    that of the time buckets. Any number of rows of a key is spread over its blocks; from block to block it takes as many rounds as the logarithm of their number.
    """
    block = block or BLOCK
    rows = written(_followers(df.where(F.col(start).isNotNull() & F.col(stop).isNotNull()), key, start, stop, tie, width).withColumn("__block", bucket(F.col("__n"), block)), "followers")
    kind = rows.schema["__k"].dataType.simpleString()
    blocks = (rows.agg(F.max("__block")).first()[0] or 0) + 1
    taken = rows.where("__n = 1").select("__k", F.col("__n").alias("__at"))
    if blocks > 1:
        jumps = written(rows.select("__k", "__n", "__next", "__block").groupBy("__k", "__block").applyInPandas(lambda b: _left(b), f"__k {kind}, __n long, __next long").where("__next > 0"), "jumps")
        for _ in range((blocks - 1).bit_length()):
            further = taken.join(jumps, (taken["__k"] == jumps["__k"]) & (taken["__at"] == jumps["__n"])).select(taken["__k"], F.col("__next").alias("__at"))
            taken = written(taken.unionByName(further).distinct(), "taken")
            hop = jumps.select(F.col("__k").alias("__h"), F.col("__n").alias("__from"), F.col("__next").alias("__to"))
            jumps = written(jumps.join(hop, (F.col("__k") == F.col("__h")) & (F.col("__next") == F.col("__from"))).select("__k", "__n", F.col("__to").alias("__next")), "jumps")
    entries = taken.groupBy("__k", bucket(F.col("__at"), block).alias("__block")).agg(F.min("__at").alias("__at"))  # a last row without length points to a number beyond the end

    def follow(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("__n")
        n, nexts = held["__n"].to_numpy(), held["__next"].fillna(-1).to_numpy().astype(np.int64)
        at, chosen = held["__at"].iloc[0], np.zeros(len(n), bool)
        if not pd.isna(at):
            at = int(at)
            while n[0] <= at <= n[-1]:
                chosen[at - n[0]] = True
                at = nexts[at - n[0]]
        return held[chosen][["__k", "__n"]]

    marked = rows.select("__k", "__n", "__next", "__block").join(entries, ["__k", "__block"], "left")
    chosen = marked.groupBy("__k", "__block").applyInPandas(follow, f"__k {kind}, __n long")
    return rows.join(chosen, ["__k", "__n"], "left_semi").select(*df.columns)


def capped(df: DataFrame, key: str, start: str, stop: str, tie: str, at_once: int) -> DataFrame:
    """The rows a greedy choice takes in order of their start, at most ``at_once`` open at a time; a row may start when another stops.

    What may start depends on all that is open, so a key is gone through in order in one task, row by row as it streams by; only the stops of what is open are held.
    """
    dealt = df.repartition(key).sortWithinPartitions(key, start, tie)
    names, schema = df.columns, to_arrow_schema(df.schema)
    at_key, at_start, at_stop = (names.index(c) for c in (key, start, stop))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, busy = object(), []
        for batch in batches:
            kept = []
            for k, a, z in zip(*(batch.column(i).to_pylist() for i in (at_key, at_start, at_stop)), strict=True):
                if k != held:
                    held, busy = k, []
                while busy and a is not None and busy[0] <= a:
                    heapq.heappop(busy)
                kept.append(a is not None and z is not None and len(busy) < at_once)
                if kept[-1]:
                    heapq.heappush(busy, z)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(kept)).columns, schema=schema)

    return dealt.mapInArrow(take, df.schema)


def episodes(df: DataFrame, key: str, start: str, stop: str, tie: str, signal: str, end: int, width: int) -> DataFrame:
    """By key the numbers of episodes taken and of rows without a signal, beyond the end, and while another was open."""
    fit = F.coalesce(F.col(signal), F.lit(False))
    inside = F.col(stop) <= end
    taken = non_overlapping(df.where(fit & inside), key, start, stop, tie, width).groupBy(F.struct(F.col(key).alias("k")).alias("__k")).agg(F.count("*").alias("taken"))
    counts = df.groupBy(key).agg(F.count_if(~fit).alias("no_signal"), F.count_if(fit & ~inside).alias("boundary"), F.count_if(fit & inside).alias("__fit")).withColumn("__k", F.struct(F.col(key).alias("k")))
    held = counts.join(taken, "__k", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return held.select(key, "taken", "no_signal", "boundary", (F.col("__fit") - F.col("taken")).alias("busy"))


def hysteresis(df: DataFrame, key: str, order: list[str], score: Column, enter: float, hold: float, width: int) -> DataFrame:
    """``held``: 1 from where the score reaches ``enter`` until it falls below ``hold``, else 0. No state is needed: the last crossing decides."""
    crossing = F.when(score >= enter, 1).when(F.coalesce(score < hold, F.lit(True)), 0)
    return running(df, key, order, width, lasts={"held": crossing}).withColumn("held", F.coalesce("held", F.lit(0)))


def positions(fills: DataFrame, key: str, order: list[str], quantity: str, price: str) -> DataFrame:
    """Position after all fills of a key (signed quantities): ``position``, ``entry`` (average price of what is open), ``realised``.

    A fill against the position realises against the average; one beyond it turns the position at its own price. Fills of a key are gone
    through in order as they stream by; three numbers are held. Fills without quantity or price don't count.
    """
    held = fills.select(F.col(key).alias("key"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(quantity).cast("double").alias("q"), F.col(price).cast("double").alias("p")).where("q is not null and p is not null")
    dealt = held.repartition("key").sortWithinPartitions("key", *[f"o{i}" for i in range(len(order))]).select("key", "q", "p")
    kind = f"`{key}` {fills.schema[key].dataType.simpleString()}, position double, entry double, realised double"
    arrow = to_arrow_schema(T._parse_datatype_string(kind))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, position, entry, realised = object(), 0.0, 0.0, 0.0
        first = True
        for batch in batches:
            for k, q, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if first or k != at:
                    if not first:
                        out.append((at, position, entry, realised))
                    at, position, entry, realised, first = k, 0.0, 0.0, 0.0, False
                after = position + q
                if position * q >= 0:
                    entry = 0.0 if after == 0 else (position * entry + q * p) / after
                else:
                    realised += min(abs(q), abs(position)) * (p - entry) * (1 if position > 0 else -1)
                    entry = 0.0 if after == 0 else p if abs(q) > abs(position) else entry
                position = after
        if not first:
            out.append((at, position, entry, realised))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(fold, kind)
