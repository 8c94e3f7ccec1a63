"""Aggregations of a tape: bars, signed flow, spans, conflicts, and statistics of gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.operators.ordered import numbered


def bars(df: DataFrame, keys: list, order: list[str], price: str, size: str) -> DataFrame:
    """Open, high, low, close, volume and number of rows by key."""
    first, last = F.min(F.struct(*order, price)).alias("__o"), F.max(F.struct(*order, price)).alias("__c")
    made = df.groupBy(*keys).agg(first, last, F.max(price).alias("high"), F.min(price).alias("low"), F.sum(size).alias("volume"), F.count("*").alias("n"))
    return made.withColumn("open", F.col(f"__o.{price}")).withColumn("close", F.col(f"__c.{price}")).drop("__o", "__c")


def signed_flow(df: DataFrame, keys: list, amount: str, buys: Column) -> DataFrame:
    """Signed and total amount, and number of rows by key."""
    return df.groupBy(*keys).agg(F.sum(F.when(buys, F.col(amount)).otherwise(-F.col(amount))).alias("signed"), F.sum(amount).alias("total"), F.count("*").alias("n"))


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that occur with different values; smallest and largest show it without counting distinct ones."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).where("n > 1 and low <> high")


def gain_block(df: DataFrame, keys: list[str], gain: str) -> DataFrame:
    """Number, mean, sample deviation, ratio, share of wins and profit factor of gains."""
    up, down = F.sum(F.when(F.col(gain) > 0, F.col(gain))), -F.sum(F.when(F.col(gain) < 0, F.col(gain)))
    made = df.groupBy(*keys).agg(F.count(gain).alias("n"), F.avg(gain).alias("mean"), F.stddev_samp(gain).alias("sd"), F.avg((F.col(gain) > 0).cast("double")).alias("wins"), up.alias("__up"), down.alias("__down"))
    return made.withColumn("ratio", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd"))).withColumn("factor", F.when(F.col("__down") > 0, F.col("__up") / F.col("__down"))).drop("__up", "__down")


def stressed(df: DataFrame, gain: str, fee_bps: float, levels: tuple[float, ...] = (1.0, 1.5, 2.0)) -> DataFrame:
    """A row for each stress level, with ``net``: the gain less a round trip of fees at that level."""
    out = df.withColumn("stress", F.explode(F.array(*[F.lit(x) for x in levels])))
    return out.withColumn("net", F.col(gain) - 2 * fee_bps / 10_000 * F.col("stress"))


def hac_mean(df: DataFrame, keys: list[str], index: str, value: str, lags: int) -> DataFrame:
    """Mean and Bartlett-weighted long-run standard error of a series; autocovariances by an offset join of the index."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    dev = df.join(mean, keys).select(*keys, index, (F.col(value) - F.col("mean")).alias("d"))
    lagged = dev.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(lags)))).select(*keys, "k", (F.col(index) + F.col("k")).alias(index), F.col("d").alias("e"))
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (lags + 1)))
    summed = dev.join(lagged, [*keys, index]).groupBy(*keys).agg(F.sum(weight * F.col("d") * F.col("e")).alias("s"))
    return mean.join(summed, keys).select(*keys, "n", "mean", (F.sqrt(F.greatest(F.col("s"), F.lit(0.0))) / F.col("n")).alias("error"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that don't occur equally often in two relations of the same columns, with the counts ``n_a`` and ``n_b``."""
    both = a.withColumn("__in", F.lit(True)).unionByName(b.withColumn("__in", F.lit(False)))
    counted = both.groupBy(*a.columns).agg(F.count_if(F.col("__in")).alias("n_a"), F.count_if(~F.col("__in")).alias("n_b"))
    return counted.where("n_a <> n_b")


def record_text(columns: list[str | Column]) -> Column:
    """A record as one text: each value as its length in bytes, a colon and the value, ``-`` if null; different records have different texts."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])


def multiset_digest(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """``n`` and ``digest`` of the rows as a multiset, by ``keys`` if given: the order of rows and their parts don't matter, repeats do.

    The digest is the SHA-256 of ``n`` and the sums of two 60-bit pieces of each row's SHA-256, joined by colons, so any engine that has SHA-256 gives the
    same, and sums of parts add up.
    """
    h = F.sha2(record_text(columns), 256)
    piece = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    held = df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), piece(1).alias("__a"), piece(16).alias("__b"))
    zero = F.lit(0).cast("decimal(38,0)")
    return held.withColumn("digest", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.coalesce("__a", zero).cast("string"), F.coalesce("__b", zero).cast("string")), 256)).drop("__a", "__b")


def fingerprint(df: DataFrame, time: str) -> DataFrame:
    """One row that does not depend on the order of rows: count, first and last time, and the :func:`multiset_digest` over all columns by name."""
    span = df.agg(F.min(time).alias("first"), F.max(time).alias("last"))
    return multiset_digest(df, sorted(df.columns)).crossJoin(F.broadcast(span)).select("n", "first", "last", "digest")  # a row each


def ordered_digest(df: DataFrame, order: list[str], columns: list[str], width: int) -> DataFrame:
    """``n`` and ``digest`` of rows in an order (``order[0]`` a whole number, unique together): each row counts with its place, so no task has to see all of them."""
    held = numbered(df.withColumn("__one", F.lit(0)), "__one", order, width, "__place")
    return multiset_digest(held, ["__place", *columns])


def pinned(df: DataFrame, digest: str, expected: str, what: str) -> DataFrame:
    """``df``, if ``digest`` is the expected one; else it is refused."""
    if digest != expected:
        raise ValueError(f"{what} has the digest {digest}, not {expected}")
    return df


def bound_exclusions(universe: DataFrame, exclusions: DataFrame, key: str, pin: str = "pin") -> tuple[DataFrame, DataFrame]:
    """The universe (distinct keys) without the keys excluded for it, and the exclusions that were made for another one.

    Each exclusion carries the digest of the universe that it was drawn up for; one with another digest doesn't hold here.
    """
    keys = universe.select(key).distinct()
    own = multiset_digest(keys, [key]).select(F.col("digest").alias("__own"))
    marked = exclusions.crossJoin(F.broadcast(own))  # one row
    held = marked.where(F.col(pin).eqNullSafe(F.col("__own"))).select(key).distinct()
    return keys.join(held, key, "left_anti"), marked.where(~F.col(pin).eqNullSafe(F.col("__own"))).drop("__own")


def coverage(spine: DataFrame, *sides: DataFrame) -> DataFrame:
    """Slots of ``spine``, those that all of ``sides`` have, and the share that lacks one; all tables have one column, the slot."""
    name, held = spine.columns[0], spine
    for n, s in enumerate(sides):
        held = held.join(s.distinct().withColumn(f"__{n}", F.lit(1)), name, "left")
    full = F.lit(True)
    for n in range(len(sides)):
        full = full & F.col(f"__{n}").isNotNull()
    return held.agg(F.count("*").alias("slots"), F.count_if(full).alias("complete"), F.avg((~full).cast("double")).alias("gap_fraction"))
