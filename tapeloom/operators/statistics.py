"""Statistics of trading studies: folds, weights, tests, overfitting, bootstraps. Series stay in Spark; only parameters are in Python."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def walk_forward(spark: SparkSession, n: int, train: int, test: int, holdout: int, expanding: bool = True) -> DataFrame:
    """Folds over ``n`` positions: ``fold``, ``train_from``, ``train_to``, ``test_from``, ``test_to`` (ends exclusive); the last ``holdout`` positions are in none."""
    count = max(0, (n - holdout - train) // test)
    fold = F.col("id")
    start = F.lit(0) if expanding else fold * test
    return spark.range(count).select(fold.alias("fold"), start.cast("long").alias("train_from"), (fold * test + train).alias("train_to"), (fold * test + train).alias("test_from"), (fold * test + train + test).alias("test_to"))


def in_folds(df: DataFrame, folds: DataFrame, position: str) -> DataFrame:
    """Rows with each fold they are tested in; folds are few and broadcast."""
    return df.join(F.broadcast(folds), (F.col(position) >= F.col("test_from")) & (F.col(position) < F.col("test_to")))


def net_gain(gross: Column, cost: Column, stress: float, paid: Column, received: Column) -> Column:
    """Gross less stressed costs and funding paid, with funding received divided by the stress."""
    return gross - cost * stress - paid * stress + received / stress


def position_weight(vol: Column, target: float, most: float) -> Column:
    """Weight that brings a volatility to its target, at most ``most``; null where the volatility isn't positive."""
    return F.when(vol > 0, F.least(F.lit(most), target / vol))


def hac_test(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """``n``, ``mean``, ``lags``, ``error`` and ``t`` with Bartlett weights, lags by the size: the whole part of 4 (n / 100) ** (2/9)."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).withColumn("lags", F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int"))
    dev = df.join(mean, keys).select(*keys, index, "lags", (F.col(value) - F.col("mean")).alias("d"))
    lagged = dev.select(*keys, F.explode(F.sequence(F.lit(0), "lags")).alias("k"), F.col(index), F.col("d").alias("e"))
    lagged = lagged.select(*keys, "k", (F.col(index) + F.col("k")).alias(index), "e")
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (F.col("lags") + 1)))
    summed = dev.join(lagged, [*keys, index]).groupBy(*keys).agg(F.sum(weight * F.col("d") * F.col("e")).alias("s"))
    error = F.sqrt(F.greatest(F.col("s"), F.lit(0.0))) / F.col("n")
    return mean.join(summed, keys).select(*keys, "n", "mean", "lags", error.alias("error"), F.when(error > 0, F.col("mean") / error).alias("t"))


def upper_tail(t: Column, freedom: Column) -> Column:
    """Probability that Student's t with ``freedom`` degrees is above ``t``."""

    @F.pandas_udf("double")
    def tail(ts: pd.Series, ns: pd.Series) -> pd.Series:
        def one(x: float, n: float) -> float:
            if x != x or n != n or n <= 0:
                return float("nan")
            half = 0.5 * incomplete_beta(n / 2, 0.5, n / (n + x * x))
            return half if x >= 0 else 1 - half

        return pd.Series([one(x, n) for x, n in zip(ts, ns, strict=True)])

    return tail(t.cast("double"), freedom.cast("double"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by the continued fraction in Lentz's form."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 300):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + part * d)
            c = 1 + part / c
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function."""

    @F.pandas_udf("double")
    def cdf(zs: pd.Series) -> pd.Series:
        return zs.map(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), na_action="ignore")

    return cdf(z.cast("double"))


def sharpe_block(df: DataFrame, keys: list[str], gain: str) -> DataFrame:
    """``n``, ``ratio`` (mean over sample deviation), population ``skew`` and plain ``kurt`` by key."""
    made = df.groupBy(*keys).agg(F.count(gain).alias("n"), (F.avg(gain) / F.stddev_samp(gain)).alias("ratio"), F.skewness(gain).alias("skew"), (F.kurtosis(gain) + 3).alias("kurt"))
    return made


def sharpe_score(ratio: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Standard score of a ratio above a benchmark, with its skew and kurtosis; its :func:`normal_cdf` is the probabilistic ratio."""
    spread = 1 - skew * ratio + (kurt - 1) / 4 * ratio * ratio
    return F.when((spread > 0) & (n > 1), (ratio - benchmark) * F.sqrt(n - 1) / F.sqrt(spread))


def expected_best_ratio(variance: float, trials: int) -> float:
    """Largest ratio to be expected of so many trials without skill, whose ratios have that variance."""
    if trials < 2:
        return 0.0
    euler = 0.5772156649015329
    inv = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - euler) * inv(1 - 1 / trials) + euler * inv(1 - 1 / (trials * math.e)))


def split_table(spark: SparkSession, blocks: int) -> DataFrame:
    """``split``, ``block``, ``inside``: every choice of half of the blocks (an even number, 16 at most)."""
    rows = [(n, b, b in chosen) for n, chosen in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    return spark.createDataFrame(rows, "split int, block int, inside boolean")


def overfit_splits(stats: DataFrame, splits: DataFrame, config: str, gain: str) -> DataFrame:
    """For each split the configuration that is best inside, the average rank it has outside, and the logit of that rank.

    ``stats`` has a row for each ``config`` and ``block`` with the summed ``gain``; blocks are of one size. Of equals inside the first
    configuration counts.
    """
    sums = stats.join(F.broadcast(splits), "block").groupBy("split", config).agg(F.sum(F.when(F.col("inside"), F.col(gain))).alias("i"), F.sum(F.when(~F.col("inside"), F.col(gain))).alias("o"))
    w = Window.partitionBy("split").orderBy("o")
    ties, all_of = F.count("*").over(Window.partitionBy("split", "o")), F.count("*").over(Window.partitionBy("split"))
    ranked = sums.withColumns({"rank": F.rank().over(w) + (ties - 1) / 2.0, "m": all_of})
    best = ranked.groupBy("split").agg(F.max_by(F.struct(config, "rank", "m"), F.struct("i", -F.col(config))).alias("b"))
    share = F.col("b.rank") / (F.col("b.m") + 1)
    return best.select("split", F.col(f"b.{config}").alias(config), F.col("b.rank").alias("rank"), F.log(share / (1 - share)).alias("logit"))


def circular_blocks(df: DataFrame, position: str, value: str, n: int, block: int, draws: int, start: Column | None = None) -> DataFrame:
    """Means of ``draws`` circular block bootstraps of a series of ``n`` positions from 0: ``draw``, ``mean``.

    ``start`` is where block ``b`` of draw ``draw`` starts, by default a hash of both. Rows are made in tasks, ``n`` for each draw.
    """
    begin = F.pmod(F.xxhash64("draw", "b") if start is None else start, F.lit(n))
    blocks = -(-n // block)
    rows = df.sparkSession.range(draws).toDF("draw").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("begin", begin)
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("b") * block + F.col("j") < n)
    rows = rows.select("draw", F.pmod(F.col("begin") + F.col("j"), F.lit(n)).alias(position))
    return rows.join(df.select(position, value), position).groupBy("draw").agg(F.avg(value).alias("mean"))


def shared_resamples(df: DataFrame, cells: list[str], day: str, value: str, days: int, draws: int, index: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Bootstraps of all cells over the same resampled days: ``cells``, ``events``, ``mean``, and ``means``, the mean of each draw (null where it has no events).

    Days are numbered from 0 to ``days`` - 1. Place ``j`` of draw ``b`` takes the day ``index(b, j)`` (a hash of both by default), whatever the cell, so cells can be
    compared draw by draw. A cell is held as two arrays over its days, from one aggregation; draws are worked out from them in place, without a row for a draw or place.
    """
    index = index or (lambda b, j: F.pmod(F.xxhash64(b, j), F.lit(days)))
    daily = df.groupBy(*cells, day).agg(F.sum(value).cast("double").alias("s"), F.count(value).alias("n"))
    held = daily.groupBy(*cells).agg(F.map_from_entries(F.collect_list(F.struct(day, F.struct("s", "n")))).alias("m"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    axis = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    held = held.withColumn("m", F.transform(axis(days), lambda d: F.coalesce(F.element_at("m", d.cast(df.schema[day].dataType)), zero)))
    add = lambda a, x: F.struct((a["s"] + x["s"]).alias("s"), (a["n"] + x["n"]).alias("n"))
    mean = lambda a: F.when(a["n"] > 0, a["s"] / a["n"])
    total = F.aggregate("m", zero, add)
    draw = lambda b: F.aggregate(axis(days), zero, lambda a, j: add(a, F.get("m", index(b, j).cast("int"))), mean)
    return held.select(*cells, total["n"].alias("events"), mean(total).alias("mean"), F.transform(axis(draws), draw).alias("means"))


def resample_bounds(resamples: DataFrame, low: int, high: int) -> DataFrame:
    """``low``-th and ``high``-th smallest mean (from 1), and ``below``: the share of draws at or below zero (of those with events)."""
    held = resamples.withColumn("__m", F.array_sort(F.array_compact("means")))
    share = F.size(F.filter("__m", lambda m: m <= 0)) / F.size("__m")
    return held.withColumns({"low": F.get("__m", F.lit(low - 1)), "high": F.get("__m", F.lit(high - 1)), "below": F.when(F.size("__m") > 0, share)}).drop("__m", "means")


def deflated_ratios(df: DataFrame, trials: list[str], gain: str) -> DataFrame:
    """For each trial its ratio, the ratio that the best of so many trials without skill would show (``benchmark``, from the variance of all ratios), the ``score`` above it, and
    ``deflated``: how probable a true ratio above that benchmark is, with the trial's skew and kurtosis. Trials whose gains don't vary have no ratio and don't count."""
    made = sharpe_block(df, trials, gain).where("ratio is not null")
    all_of = made.agg(F.count("*").alias("__m"), F.var_samp("ratio").alias("__v")).first()
    benchmark = expected_best_ratio(all_of["__v"] or 0.0, all_of["__m"])
    score = sharpe_score(F.col("ratio"), F.lit(benchmark), F.col("n"), F.col("skew"), F.col("kurt"))
    return made.withColumns({"benchmark": F.lit(benchmark), "score": score, "deflated": normal_cdf(score)})


def order_statistics(means: DataFrame, low: int, high: int) -> DataFrame:
    """The ``low``-th and ``high``-th smallest means (from 1); bootstraps have a few thousand rows."""
    return means.agg(F.array_sort(F.collect_list("mean")).alias("m")).select(F.get("m", F.lit(low - 1)).alias("low"), F.get("m", F.lit(high - 1)).alias("high"))


def label(n: Column, least: int, p: Column, level: float, stressed: Column) -> Column:
    """``not_enough_data``, ``no_edge``, ``fragile`` (significant, but not under stress) or ``passes``."""
    return F.when(n < least, "not_enough_data").when(F.coalesce(p > level, F.lit(True)), "no_edge").when(F.coalesce(stressed <= 0, F.lit(True)), "fragile").otherwise("passes")


def day_clusters(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Mean over events, mean over days of the days' means, and their numbers."""
    days = df.groupBy(*keys, day).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return days.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("by_event"), F.avg("m").alias("by_day"), F.sum("n").alias("events"), F.count("*").alias("days"))
