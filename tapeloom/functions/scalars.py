"""Scalar expressions that the tape operators share."""

from __future__ import annotations

from functools import reduce
from math import log

import pyarrow as pa
from pyspark.sql import Column, functions as F


def micros(column: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")


def bucket(t: Column, width: int) -> Column:
    """Number of the half-open bucket of ``width`` that holds ``t``; negative times are floored."""
    return F.call_function("div", t - F.pmod(t, F.lit(width)), F.lit(width))


def first_positive(*candidates: Column) -> Column:
    """The first candidate above zero, null where there is none."""
    return F.coalesce(*[F.when(c > 0, c) for c in candidates])


def finite(*values: Column) -> Column:
    """Whether all values are there, and neither NaN nor infinite."""
    return reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) for v in values])


def side(value: Column, threshold: float, long_only: bool = False) -> Column:
    """1 above the threshold, -1 below its negative (0 where only long), else 0."""
    return F.when(value > threshold, 1).when((value < -threshold) & F.lit(not long_only), -1).otherwise(0)


def canonical_decimal(value: Column) -> Column:
    """Fixed-point text without exponent and without trailing zeros."""
    text = F.format_string("%s", value.cast("decimal(38,10)").cast("string"))
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(value.isNotNull(), trimmed)


def mid_price(bid: Column, ask: Column) -> Column:
    """Middle of two prices in decimals; null unless both are positive and the bid doesn't exceed the ask."""
    b, a = (x.try_cast("decimal(20,10)") for x in (bid, ask))
    return F.when((b > 0) & (a >= b), ((b + a) / 2).cast("decimal(20,10)"))


def redact(text: Column) -> Column:
    """Values of credential-shaped settings replaced."""
    return F.regexp_replace(text, r"(?i)(token|secret|password|apikey)=\S+", "$1=***")


def epoch_timestamp(value: Column, unit: str) -> Column:
    """Timestamp of a whole number of seconds, milli-, micro- or nanoseconds (``s``, ``ms``, ``us``, ``ns``) since 1970; no floating point."""
    per = {"s": value * 1_000_000, "ms": value * 1000, "us": value, "ns": bucket(value, 1000)}
    return F.timestamp_micros(per[unit])


def epoch_unit(value: Column) -> Column:
    """The unit that a time since 1970 of that size is in, for years from 1973 on."""
    return F.when(value < 100_000_000_000, "s").when(value < 100_000_000_000_000, "ms").when(value < 100_000_000_000_000_000, "us").otherwise("ns")


def usable(complete: Column, gap: Column, *values: Column) -> Column:
    """Whether a bucket is complete, without a gap, and has all values."""
    return reduce(lambda a, b: a & b, [F.coalesce(complete, F.lit(False)), ~F.coalesce(gap, F.lit(True)), *[v.isNotNull() for v in values]])


def half_spread(bid: Column, ask: Column, fallback: Column) -> Column:
    """Half the distance of a valid quote, else the fallback."""
    return F.when((bid > 0) & (ask >= bid), (ask - bid) / 2).otherwise(fallback)


def spread_bps(bid: Column, ask: Column) -> Column:
    """Distance of a valid quote in hundredths of a per cent of its middle."""
    return F.when((bid > 0) & (ask >= bid), (ask - bid) * 20_000 / (ask + bid))


def side_of(token: Column, buys: tuple[str, ...], sells: tuple[str, ...]) -> Column:
    """``buy`` or ``sell`` for the words a venue uses, null for others."""
    known = F.lower(F.trim(token))
    return F.when(known.isin(*buys), "buy").when(known.isin(*sells), "sell")


def settlement_safe(t: Column, horizon: int, width: int) -> Column:
    """Whether no settlement of a grid of ``width`` lies in ``(t, t + horizon]``."""
    return bucket(t, width) == bucket(t + horizon, width)


def calendar_key(ts: Column, control: bool) -> Column:
    """Year times 12 plus month of a decision day: the last of a month, for the control the 15th; else null."""
    day = F.dayofmonth(ts)
    return F.when(day == (F.lit(15) if control else F.dayofmonth(F.last_day(ts))), F.year(ts) * 12 + F.month(ts))


def price_quantum(price: Column, max_decimals: int) -> Column:
    """Step of prices with five significant digits and at most ``max_decimals`` decimals; one at most. Decimals in, decimals out."""
    exponent = F.floor(F.log10(price.cast("double"))).cast("int")
    steps = F.lit(None).cast("decimal(38,10)")
    for e in range(-6, 5):
        steps = F.when(exponent == e, F.lit(f"{10.0 ** min(0, max(e - 4, -max_decimals)):.10f}").cast("decimal(38,10)")).otherwise(steps)
    return F.when(exponent > 4, F.lit("1").cast("decimal(38,10)")).otherwise(steps)


def rounded_price(price: Column, side: Column, max_decimals: int, protective: bool = False) -> Column:
    """Price on its grid, away from the trader for a fill (buys up), for a protective order the other way."""
    step = price_quantum(price, max_decimals)
    up = (side > 0) if not protective else (side < 0)
    steps = (price.cast("decimal(38,10)") / step).cast("decimal(38,10)")
    return (F.when(up, F.ceil(steps)).otherwise(F.floor(steps)).cast("decimal(28,0)") * step).cast("decimal(38,10)")


def lot_floor(quantity: Column, lot: str) -> Column:
    """Largest multiple of the lot that isn't above the quantity."""
    step = F.lit(lot).cast("decimal(20,10)")
    return (F.floor((quantity.cast("decimal(28,10)") / step).cast("decimal(38,10)")).cast("decimal(20,0)") * step).cast("decimal(38,10)")


def checksum_digits(number: Column) -> Column:
    """A number's text without its point and leading zeros, as book checksums take it."""
    return F.regexp_replace(F.replace(number, F.lit("."), F.lit("")), "^0+", "")


def book_checksum(asks: Column, bids: Column, depth: int = 10) -> Column:
    """CRC32 over prices and quantities of the best levels, asks first. Levels are arrays of (price, qty) texts, best first."""
    joined = [F.array_join(F.transform(F.slice(side, 1, depth), lambda x: F.concat(checksum_digits(x["price"]), checksum_digits(x["qty"]))), "") for side in (asks, bids)]
    return F.crc32(F.concat(*joined))


def leg_size(n: Column, fraction: str) -> Column:
    """Whole part of ``n`` times a fraction given as text: 100 times 0.29 is 29."""
    return F.floor(n.cast("decimal(18,0)") * F.lit(fraction).cast("decimal(10,8)")).cast("long")


def hash_draw(*parts: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of the parts: the same on every run, for breaking ties."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def slot_of(t: Column, interval: int, slack: int) -> Column:
    """Number of the settlement a print belongs to; it may come up to ``slack`` early."""
    return bucket(t + slack, interval)


def log_kind(line: Column) -> Column:
    """Kind of a log line by the words in it."""
    kinds = (("ping", r"(?i)ping.?timeout|pong"), ("gap", r"(?i)\bgap\b|sequence"), ("reconnect", r"(?i)reconnect"), ("error", r"(?i)error|exception"))
    return F.coalesce(*[F.when(line.rlike(p), k) for k, p in kinds], F.lit("other"))


def charged_bps(entry: Column, label: Column, side: Column, cost: float) -> Column:
    """Move from entry to label in the direction of the side, in hundredths of a per cent, less the cost."""
    return F.when(entry > 0, side * (label - entry) / entry * 10_000 - cost)


def hedged_weights(direction: Column, beta: Column, cap: float) -> Column:
    """Weights (``own``, ``hedge``) of a position and its hedge of minus beta, with the sum of sizes at the cap."""
    own = direction * cap / (1 + F.abs(beta))
    return F.struct(own.alias("own"), (-own * beta).alias("hedge"))


def reasons(**conditions: Column) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def first_status(held: Column, order: tuple[str, ...]) -> Column:
    """The status that comes first in ``order`` of those in the array ``held``."""
    return F.get(F.array_intersect(F.array(*map(F.lit, order)), held), 0)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b) of prices as doubles, as IEEE 754 has it: infinite where one of them is zero, NaN where both are; null where either is null or the ratio is negative.

    The logarithm is the C library's: Java's differs from it in the last bit of one ratio in thirteen, which shows in sums that come to zero or are rounded.
    """

    @F.arrow_udf("double")
    def natural(ratios: pa.Array) -> pa.Array:
        return pa.array([log(x) if x is not None and not x <= 0 else None for x in ratios.to_pylist()], pa.float64())

    inf, whole = F.lit(float("inf")), natural(F.try_divide(a, b))
    return F.when((a == 0) & (b == 0), float("nan")).when(a == 0, F.when(b.isNotNull(), -inf)).when(b == 0, F.when(a > 0, inf)).otherwise(whole)


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as ``round`` of other engines does it: scaled, to the nearest whole number (halves away from zero), scaled back.

    ``F.round`` rounds the shortest decimal text instead, and has no -0.0, which is what a negative number below half a unit comes to here.
    """
    scaled = value * float(10**digits)
    near = F.rint(scaled)
    whole = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) / 2).otherwise(near)
    return F.when(F.abs(whole) == float("inf"), value).otherwise(whole / float(10**digits))


def sign_of(value: Column) -> Column:
    """1, -1 or 0 as a double; NaN is above all numbers, null gives 0."""
    return F.when(value > 0, 1.0).when(value < 0, -1.0).otherwise(0.0)
