"""Audits and reports of studies: spans against the days they need, sources against each other, control schedules, brackets, continuity."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.scalars import bucket
from tapeloom.operators.joins import intersect_spans
from tapeloom.operators.ordered import equity_drawdown


def held_through(spans: DataFrame, held: DataFrame, key: str, day: str) -> DataFrame:
    """Spans of days (``key``, ``start``, ``stop``, both inside) with the days they lack: ``missing``, ``first_missing``, and ``held_to``: the last day before the first that is missing.

    ``held_to`` is null where the first day is missing. Spans become a row a day; a span's days meet the days that there are by key and day.
    """
    days = spans.select(key, "start", "stop", F.explode(F.sequence("start", "stop")).alias(day)).distinct()
    there = held.select(key, day).distinct().withColumn("__there", F.lit(True))
    joined = days.join(there, [key, day], "left")
    lost = F.when(F.col("__there").isNull(), F.col(day))
    out = joined.groupBy(key, "start", "stop").agg(F.count(lost).alias("missing"), F.min(lost).alias("first_missing"))
    last = F.coalesce(F.col("first_missing") - 1, F.col("stop"))
    return out.withColumn("held_to", F.when(last >= F.col("start"), last))


def source_census(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How two sources of one series agree: slots that are ``equal``, ``differ``, are ``only_a`` or ``only_b``, and slots with ``repeats`` in either."""
    one = lambda df, n: df.groupBy(*keys).agg(F.min(value).alias(f"__{n}"), F.max(value).alias(f"__{n}_high"), F.count("*").alias(f"__{n}_n"))
    met = one(a, "a").join(one(b, "b"), keys, "full")
    both = F.col("__a_n").isNotNull() & F.col("__b_n").isNotNull()
    same = F.coalesce((F.col("__a") == F.col("__b")) & (F.col("__a_high") == F.col("__b_high")), F.lit(False))
    repeats = (F.coalesce("__a_n", F.lit(0)) > 1) | (F.coalesce("__b_n", F.lit(0)) > 1)
    return met.agg(F.count_if(both & same).alias("equal"), F.count_if(both & ~same).alias("differ"), F.count_if(F.col("__b_n").isNull()).alias("only_a"), F.count_if(F.col("__a_n").isNull()).alias("only_b"), F.count_if(repeats).alias("repeats"))


def qualified_slots(events: DataFrame, key: str, time: str, slot: int, slack: int) -> DataFrame:
    """By key, over all slots from its first to its last: ``required``, ``met`` (an event at most ``slack`` from the slot's time), ``off`` (events that are at no slot), and ``qualifies`` (none missing, none off)."""
    near = bucket(F.col(time) + slack, slot)
    at = events.select(key, near.alias("__s"), (F.col(time) - near * slot > slack).alias("__off"))
    found = at.groupBy(key).agg(F.min(F.when(~F.col("__off"), F.col("__s"))).alias("__a"), F.max(F.when(~F.col("__off"), F.col("__s"))).alias("__z"), F.count_if("__off").alias("off"))
    met = at.where(~F.col("__off")).distinct().groupBy(key).agg(F.count("*").alias("met"))
    out = found.join(met, key, "left").withColumns({"required": F.coalesce(F.col("__z") - F.col("__a") + 1, F.lit(0)), "met": F.coalesce("met", F.lit(0))})
    return out.select(key, "required", "met", "off", ((F.col("required") == F.col("met")) & (F.col("off") == 0) & (F.col("met") > 0)).alias("qualifies"))


def control_schedules(schedule: DataFrame, side: str) -> DataFrame:
    """Each decision as it is, the other way round, and always long: ``variant`` and ``position``."""
    kinds = F.array(F.struct(F.lit("own").alias("variant"), F.col(side).alias("position")), F.struct(F.lit("opposite").alias("variant"), (-F.col(side)).alias("position")), F.struct(F.lit("always").alias("variant"), F.lit(1).cast(schedule.schema[side].dataType).alias("position")))
    return schedule.withColumn("__v", F.explode(kinds)).select(*schedule.columns, "__v.*")


def bracket_exits(entries: DataFrame, bars: DataFrame, key: str, at: str, longest: int) -> DataFrame:
    """The first bar within ``longest`` after an entry that touches its ``target`` or ``stop`` (long): ``exit_at``, ``reason``; a bar that touches both stops. Without a touch ``timeout`` at the last."""
    ahead = entries.withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(longest))))
    ahead = ahead.select(key, F.col(at).alias("__entry"), (F.col(at) + F.col("__n")).alias(at), "target", "stop")
    hit = ahead.join(bars.select(key, at, "high", "low"), [key, at])
    reason = F.when(F.col("low") <= F.col("stop"), "stop").when(F.col("high") >= F.col("target"), "target")
    first = hit.withColumn("__r", reason).where("__r is not null").groupBy(key, F.col("__entry").alias(at)).agg(F.min(F.struct(F.col(at).alias("exit_at"), F.col("__r").alias("reason"))).alias("__x"))
    out = entries.join(first, [key, at], "left")
    return out.select(*entries.columns, F.coalesce("__x.exit_at", F.col(at) + longest).alias("exit_at"), F.coalesce("__x.reason", F.lit("timeout")).alias("reason"))


def continuity(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Of two lanes of spans by key: how long each is covered (``span_a``, ``span_b``), and how long both are (``overlap``), in how many pieces. Spans of a lane don't overlap."""
    length = lambda df, n: df.groupBy(key).agg(F.sum(F.col("stop") - F.col("start")).alias(n))
    both = intersect_spans(a, b, key, width).groupBy(key).agg(F.sum(F.col("stop") - F.col("start")).alias("overlap"), F.count("*").alias("pieces"))
    out = length(a, "span_a").join(length(b, "span_b"), key, "full").join(both, key, "left")
    return out.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("span_a", "span_b", "overlap", "pieces")])


def report_block(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of a portfolio's periods (``gross``, ``cost``, ``paid``, ``received``, ``turnover``, ``forced``): periods, traded ones, net gain, and the share of gross that costs take."""
    net = F.col("gross") - F.col("cost") - F.col("paid") + F.col("received")
    sums = {c: F.sum(c) for c in ("gross", "cost", "paid", "received", "turnover", "forced")}
    out = periods.groupBy(*keys).agg(F.count("*").alias("periods"), F.count_if(F.col("turnover") > 0).alias("traded"), *[v.alias(c) for c, v in sums.items()], F.sum(net).alias("net"), F.count_if(net > 0).alias("gains"))
    return out.withColumn("cost_share", F.when(F.col("gross") > 0, F.col("cost") / F.col("gross")))


def conservative_p(iid: Column, hac: Column, n: Column, floor: int) -> Column:
    """The larger of two p-values, and 1 for a family with fewer than ``floor`` cases, or where either can't be told."""
    return F.when(n >= floor, F.coalesce(F.when(iid.isNotNull() & hac.isNotNull(), F.greatest(iid, hac)), F.lit(1.0))).otherwise(1.0)


def funding_rules(rate: str, hours: str, time: str, longest: float = 0.05) -> dict[str, Column]:
    """Rules of a funding settlement: a rate that is there and within bounds, an interval of 1, 2, 4 or 8 hours, a time (microseconds) on a full hour that the interval divides."""
    hour = F.col(time) / 3_600_000_000
    return {
        "no_rate": F.col(rate).isNotNull(), "rate_out_of_bounds": F.abs(rate) <= longest, "bad_interval": F.col(hours).isin(1, 2, 4, 8),
        "off_the_hour": F.pmod(F.col(time), F.lit(3_600_000_000)) == 0, "off_the_interval": F.pmod(F.floor(hour), F.col(hours)) == 0,
    }


def metrics_rules(interest: str, value: str, ratio: str, time: str) -> dict[str, Column]:
    """Rules of a metrics row: open interest and its value there together and not negative, a positive ratio, a time (microseconds) on five minutes."""
    return {
        "half_missing": F.col(interest).isNull() == F.col(value).isNull(), "negative": (F.coalesce(interest, F.lit(0)) >= 0) & (F.coalesce(value, F.lit(0)) >= 0),
        "value_without_interest": ~((F.col(interest) == 0) & (F.col(value) > 0)), "bad_ratio": F.col(ratio) > 0, "off_the_grid": F.pmod(F.col(time), F.lit(300_000_000)) == 0,
    }


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys and no spaces, as one spelling of the document; null where it is no JSON. Numbers with a fraction take their shortest form."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
            except ValueError:
                return None

        return texts.map(one, na_action="ignore")

    return canonical(text)


def reject_tally(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows by key and ``reason``: the first of the rules (in order) that a row breaks or can't be judged by, or ``accepted``."""
    reason = F.lit("accepted")
    for name, ok in reversed(rules.items()):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    return df.groupBy(*keys, reason.alias("reason")).agg(F.count("*").alias("n"))


def account_summary(periods: DataFrame, fold: str, order: list[str], gain: str, fee: str, width: int, per_year: int = 365) -> DataFrame:
    """By fold the last ``equity`` (gains less fees, from 0), the largest ``drawdown``, ``fees``, periods and the annualised ``sharpe``."""
    run = equity_drawdown(periods.withColumn("__net", F.col(gain) - F.col(fee)), fold, order, "__net", width)
    out = run.groupBy(fold).agg(F.max_by("equity", F.struct(*order)).alias("equity"), F.max("drawdown").alias("drawdown"), F.sum(fee).alias("fees"), F.count("*").alias("n"), F.avg("__net").alias("__m"), F.stddev_samp("__net").alias("__s"))
    return out.withColumn("sharpe", F.when(F.col("__s") > 0, F.col("__m") / F.col("__s") * per_year**0.5)).drop("__m", "__s")


def pair_problems(legs: DataFrame, pair: str, cap: float, order: list[str] | None = None) -> DataFrame:
    """What is wrong with each pair of legs (``market`` spot or perp, signed ``units``, ``weight``): a carry pair is long spot and short perp in equal units, with weights up to ``cap`` in all.

    A sum of doubles depends on their order in its last bits. With ``order`` (unique in a pair) weights that come to the cap but for these bits are added leg by
    leg in it; all other pairs are told apart by the sum that is combined before the shuffle.
    """
    keyed = legs.withColumn("__k", F.struct(F.col(pair).alias("k")))
    made = keyed.groupBy("__k").agg(
        F.count("*").alias("__n"), F.count_if((F.col("market") == "spot") & (F.col("units") > 0)).alias("__long"), F.count_if((F.col("market") == "perp") & (F.col("units") < 0)).alias("__short"),
        F.sum("units").alias("__sum"), F.sum(F.abs("weight")).alias("__w"),
    )
    if order:
        close = made.where(F.abs(F.col("__w") - cap) <= F.col("__n") * 2.3e-16 * F.greatest(F.col("__w"), F.lit(cap))).select("__k")  # as far as two orders can be apart
        w = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        added = keyed.join(close, "__k", "left_semi").where("weight <> 0").select("__k", F.struct(*order).alias("__o"), F.sum(F.abs("weight")).over(w).alias("__in_order"))
        made = made.join(added.groupBy("__k").agg(F.max_by("__in_order", "__o").alias("__in_order")), "__k", "left").withColumn("__w", F.coalesce("__in_order", "__w"))
    rules = {"not_two_legs": F.col("__n") != 2, "no_long_spot": F.col("__long") != 1, "no_short_perp": F.col("__short") != 1, "unequal_units": F.coalesce(F.col("__sum") != 0, F.lit(True)), "over_the_cap": F.coalesce(F.col("__w") > cap, F.lit(True))}
    return made.select(F.col("__k.k").alias(pair), F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])), ",").alias("problems"))


def parsed_candles(lines: DataFrame, text: str, width: int) -> DataFrame:
    """Lines ``time,open,high,low,close,volume`` as typed columns, with ``problem``: ``fields``, ``number``, ``price`` (not positive, or the high or low is not one), ``grid``, or null."""
    parts = F.split(text, ",")
    held = lines.withColumn("__p", parts)
    numbers = {n: F.get("__p", F.lit(i)).try_cast("long" if n == "time" else "decimal(28,8)") for i, n in enumerate(("time", "open", "high", "low", "close", "volume"))}
    held = held.withColumns(numbers)
    missing = held["time"].isNull()
    for n in ("open", "high", "low", "close", "volume"):
        missing = missing | F.col(n).isNull()
    fine = (F.col("low") > 0) & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close")) & (F.col("volume") >= 0)
    problem = F.when(F.size("__p") != 6, "fields").when(missing, "number").when(~fine, "price").when(F.pmod("time", F.lit(width)) != 0, "grid")
    return held.withColumn("problem", problem).drop("__p")


def snapshot_problems(candles: DataFrame, key: str, width: int) -> DataFrame:
    """Of each snapshot of candles: how many there are, how many have a problem, how many slots between its first and last are missing, and repeated ones."""
    good = F.when(F.col("problem").isNull(), F.col("time"))
    made = candles.groupBy(key, "time").agg(F.count("*").alias("__n"), F.count_if(F.col("problem").isNotNull()).alias("__bad"), F.max(good).alias("__t"))
    span = F.coalesce((F.max("__t") - F.min("__t")) / width + 1, F.lit(0)).cast("long")
    again = F.sum(F.greatest(F.col("__n") - F.col("__bad") - 1, F.lit(0)))
    return made.groupBy(key).agg(F.sum("__n").alias("n"), F.sum("__bad").alias("bad"), (span - F.count("__t")).alias("missing"), again.alias("repeats"))


def run_completeness(held: DataFrame, listings: DataFrame, key: str, day: str) -> DataFrame:
    """Of each listed key (``listed``, ``delisted``: its first and last day, the latter null while it trades) the days that lack a row: ``early`` before its first row, ``late`` after its
    last, ``inside``; and ``outside``, rows beyond its listing. ``until``, the last day of all rows, stands for a missing end; a key without rows is ``early`` throughout."""
    days = held.select(key, day).distinct()
    until = days.agg(F.max(day).alias("__until"))
    span = listings.crossJoin(F.broadcast(until)).select(key, "listed", F.coalesce("delisted", "__until").alias("__end"))  # one row
    joined = span.join(days, key, "left")
    within = F.col(day).between(F.col("listed"), F.col("__end"))
    made = joined.groupBy(key, "listed", "__end").agg(F.min(F.when(within, F.col(day))).alias("__a"), F.max(F.when(within, F.col(day))).alias("__z"), F.count_if(within).alias("__n"), F.count_if(~within).alias("outside"))
    whole = F.greatest(F.col("__end") - F.col("listed") + 1, F.lit(0))
    early, late = F.when(F.col("__a").isNull(), whole).otherwise(F.col("__a") - F.col("listed")), F.coalesce(F.col("__end") - F.col("__z"), F.lit(0))
    return made.select(key, early.alias("early"), late.alias("late"), F.coalesce(F.col("__z") - F.col("__a") + 1 - F.col("__n"), F.lit(0)).alias("inside"), "outside")
