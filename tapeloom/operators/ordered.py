"""Ordered analytics over keyed rows: last of a bucket, forward fill, holes, islands, rolling windows, drawdowns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.scalars import bucket

#: Width of time buckets in spans that are looked back over.
WIDE = 16


def _bucketed(df: DataFrame, key: str, order: list[str], width: int) -> DataFrame:
    """With ``__k``, the key in a structure (never null itself, so windows and joins deal rows alike and one shuffle serves both), and the time bucket ``__b``."""
    return df.withColumns({"__k": F.struct(F.col(key).alias("k")), "__b": bucket(F.col(order[0]), width)})


def running(df: DataFrame, key: str, order: list[str], width: int, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """Running sums, maxima and last values that aren't null, by key in order, without one task for a whole key.

    ``order[0]`` is a time as a whole number; it is cut into buckets of ``width``. Rows are ordered within a bucket; what the
    buckets before give is worked out on one row a bucket and joined back, so a hot key is spread over its buckets.
    Rows are shuffled once. With ``before`` a row itself doesn't count; ``order`` has to be unique in a key then.
    """
    sums, maxes, lasts = sums or {}, maxes or {}, lasts or {}
    made = {**sums, **maxes, **lasts}
    held = _bucketed(df, key, order, width).withColumns({f"__{n}": c for n, c in made.items()})
    own = Window.partitionBy("__k", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    rank = F.struct(*order)
    agg = [F.sum(f"__{n}").alias(f"__{n}") for n in sums] + [F.max(f"__{n}").alias(f"__{n}") for n in maxes]
    agg += [F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), rank)).alias(f"__{n}") for n in lasts]
    earlier = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    over = {**{n: F.sum for n in sums}, **{n: F.max for n in maxes}, **{n: lambda c: F.last(c, ignorenulls=True) for n in lasts}}
    carry = held.groupBy("__k", "__b").agg(*agg).select("__k", "__b", *[fn(f"__{n}").over(earlier).alias(f"__carry_{n}") for n, fn in over.items()])
    rows = held.select("*", *[fn(f"__{n}").over(own).alias(f"__own_{n}") for n, fn in over.items()])
    joined = rows.join(carry, ["__k", "__b"])

    def together(n: str) -> Column:
        own_n, carry_n = F.col(f"__own_{n}"), F.col(f"__carry_{n}")
        if n in sums:
            return F.when(own_n.isNull(), carry_n).otherwise(own_n + F.coalesce(carry_n, F.lit(0)))
        return F.greatest(own_n, carry_n) if n in maxes else F.coalesce(own_n, carry_n)

    return joined.select(*df.columns, *[together(n).alias(n) for n in made])


def last_per_bucket(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each group and the number of rows; aggregated before the shuffle, no window."""
    last = F.max(F.struct(*order, *values)).alias("__last")
    return df.groupBy(*keys).agg(last, F.count("*").alias("n")).select(*keys, *[F.col(f"__last.{v}").alias(v) for v in values], "n")


def forward_fill(df: DataFrame, key: str, order: list[str], values: list[str], width: int) -> DataFrame:
    """Each value, or the last one before it in its session that isn't null (``filled_<value>``); see :func:`running` for ``width``."""
    return running(df, key, order, width, lasts={f"filled_{v}": F.col(v) for v in values})


def with_previous(df: DataFrame, key: str, order: list[str], values: list[str], width: int) -> DataFrame:
    """``ordinal`` of each row in its key and the values of the row before (``previous_<value>``), null at the first."""
    own = Window.partitionBy("__k", "__b").orderBy(*order)
    rows = _bucketed(df, key, order, width).withColumns({"__row": F.struct(*values), "__n": F.row_number().over(own), "__lag": F.lag(F.struct(*values)).over(own)})
    ends = _bucketed(df, key, order, width).groupBy("__k", "__b").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__last"), F.count("*").alias("__count"))
    before = Window.partitionBy("__k").orderBy("__b")
    ends = ends.select("__k", "__b", F.lag("__last").over(before).alias("__end"), F.coalesce(F.sum("__count").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__skip"))
    joined = rows.join(ends, ["__k", "__b"])
    last = F.when(F.col("__n") == 1, F.col("__end")).otherwise(F.col("__lag"))
    return joined.select(*df.columns, (F.col("__n") + F.col("__skip")).alias("ordinal"), *[last[v].alias(f"previous_{v}") for v in values])


def numbered(df: DataFrame, key: str, order: list[str], width: int, name: str = "ordinal") -> DataFrame:
    """The place of each row in its key, from 1; ``order`` has to be unique in a key."""
    return running(df, key, order, width, sums={name: F.lit(1).cast("long")})


def with_halo(df: DataFrame, key: str, axis: str, span: int, width: int) -> DataFrame:
    """Rows dealt by key and bucket of ``axis`` (``__k``, ``__b``), and those within ``span`` before a bucket once more in it (``__halo``).

    A window by ``__k`` and ``__b`` then sees all that lies less than ``span`` before its rows, so a hot key runs in as many tasks as it has buckets.
    Drop the rows with ``__halo`` after the window. Buckets are ``span`` wide at least.
    """
    width = max(width, span)
    own = bucket(F.col(axis), width)
    reach = F.when(F.col(axis) + span > (own + 1) * width, F.array(own, own + 1)).otherwise(F.array(own))
    rows = df.withColumns({"__k": F.struct(F.col(key).alias("k")), "__own": own}).withColumn("__b", F.explode(reach))
    return rows.withColumn("__halo", ~F.col("__b").eqNullSafe(F.col("__own"))).drop("__own")


#: Rows of a bucket of :func:`rolling_rows`.
ROWS = 65_536


def rolling_rows(df: DataFrame, key: str, order: list[str], first: int, last: int, width: int, made: Callable[[Window], dict[str, Column]]) -> DataFrame:
    """Columns over a frame of rows, from ``first`` to ``last`` relative to each (0 at most), without one task for a whole key.

    ``made`` gets the window and gives columns by name. Rows are numbered within their key (``order`` unique; buckets of ``width``), then dealt in buckets of numbers.
    """
    rows = with_halo(numbered(df, key, order, width, "__n"), key, "__n", 1 - first, ROWS)
    window = Window.partitionBy("__k", "__b").orderBy("__n").rowsBetween(first, last)
    out = rows.select("*", *[c.alias(n) for n, c in made(window).items()])
    return out.where(~F.col("__halo")).drop("__k", "__b", "__halo", "__n")


def holes(df: DataFrame, key: str, time: str, step: int) -> DataFrame:
    """Neighbouring rows of a key further apart than ``step``: ``hole_from``, ``hole_to``."""
    held = with_previous(df.where(F.col(time).isNotNull()).groupBy(key, time).agg(F.count("*").alias("__n")), key, [time], [time], WIDE * step)
    return held.where(F.col(time) - F.col(f"previous_{time}") > step).select(key, F.col(f"previous_{time}").alias("hole_from"), F.col(time).alias("hole_to"))


def carried(df: DataFrame, key: str, order: list[str], width: int, own: Callable[[DataFrame, Window], DataFrame], summary: dict[str, Column], carry: Callable[[DataFrame, Window, Window], DataFrame]) -> DataFrame:
    """Rows with the columns that ``own`` adds over their bucket up to each row, and those that ``carry`` makes of the summaries of the buckets before.

    ``carry`` gets a row for each bucket of a key, a window over those before it, and one that ends at it. This is for values that depend on one another, for
    which :func:`running` would run over its own result.
    """
    rows = own(_bucketed(df, key, order, width), Window.partitionBy("__k", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    over = Window.partitionBy("__k").orderBy("__b")
    held = carry(rows.groupBy("__k", "__b").agg(*[c.alias(n) for n, c in summary.items()]), over.rowsBetween(Window.unboundedPreceding, -1), over).drop(*summary)
    return rows.join(held, ["__k", "__b"]).drop("__k", "__b")


def bursts(df: DataFrame, key: str, time: str, gap: int, width: int) -> DataFrame:
    """Runs of rows at most ``gap`` apart: ``start``, ``stop`` and ``n``. Rows without a time are a run of their own."""

    def own(rows: DataFrame, w: Window) -> DataFrame:
        step = F.col(time) - F.lag(time).over(Window.partitionBy("__k", "__b").orderBy(time))
        return rows.withColumn("__far", F.when(step > gap, 1).otherwise(0)).withColumn("__in", F.sum("__far").over(w))

    def carry(buckets: DataFrame, before: Window, over: Window) -> DataFrame:
        fresh = F.when(F.col("__first") - F.lag("__last").over(over) <= gap, 0).otherwise(1)
        return buckets.withColumn("__fresh", fresh).withColumn("__runs", F.coalesce(F.sum(F.col("__breaks") + F.col("__fresh")).over(before), F.lit(0)) + F.col("__fresh")).drop("__fresh")

    rows = carried(df.select(key, time), key, [time], width, own, {"__first": F.min(time), "__last": F.max(time), "__breaks": F.sum("__far")}, carry)
    runs = rows.groupBy(key, (F.col("__runs") + F.col("__in")).alias("__run"))
    return runs.agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("n")).drop("__run")


def streaks(df: DataFrame, key: str, order: list[str], flag: Column, width: int) -> DataFrame:
    """``streak``: how many rows in a row, up to this one, have the flag. ``order`` has to be unique in a key."""

    def own(rows: DataFrame, w: Window) -> DataFrame:
        return rows.withColumn("__n", F.count("*").over(w)).withColumn("__miss", F.max(F.when(~F.coalesce(flag, F.lit(False)), F.col("__n"))).over(w))

    def carry(buckets: DataFrame, before: Window, over: Window) -> DataFrame:
        rows = buckets.withColumn("__skip", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        return rows.withColumn("__unbroken", F.col("__skip") - F.coalesce(F.last(F.col("__skip") + F.col("__last"), ignorenulls=True).over(before), F.lit(0))).drop("__skip")

    rows = carried(df, key, order, width, own, {"__rows": F.count("*"), "__last": F.max("__miss")}, carry)
    return rows.select(*df.columns, (F.col("__n") - F.coalesce("__miss", -F.col("__unbroken"))).alias("streak"))


def merge_spans(df: DataFrame, key: str, width: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """Union of overlapping or touching spans of each key."""
    # In a bucket a span is a head if no earlier one of the bucket reaches it; it begins a union if none of the buckets before does either.
    heads = F.when(~F.coalesce(F.col(start) <= F.col("__reach"), F.lit(False)), F.col(start))

    def own(rows: DataFrame, w: Window) -> DataFrame:
        return rows.withColumn("__reach", F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__head", F.max(heads).over(w))

    def carry(buckets: DataFrame, before: Window, over: Window) -> DataFrame:
        reached = buckets.withColumn("__until", F.max("__top").over(before))
        begun = F.when(~F.coalesce(F.col("__last") <= F.col("__until"), F.lit(False)), F.col("__last"))
        return reached.withColumn("__from", F.last(begun, ignorenulls=True).over(before))

    rows = carried(df.select(key, start, stop), key, [start, stop], width, own, {"__top": F.max(stop), "__last": F.max("__head")}, carry)
    begins = F.when(F.coalesce(F.col("__head") <= F.col("__until"), F.lit(False)), F.col("__from")).otherwise(F.col("__head"))
    return rows.groupBy(key, begins.alias("__from")).agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("__from")


def equity_drawdown(df: DataFrame, key: str, order: list[str], gain: str, width: int) -> DataFrame:
    """Running ``equity``, its ``peak`` (0 at least) and ``drawdown``."""

    def own(rows: DataFrame, w: Window) -> DataFrame:
        return rows.withColumn("__in", F.sum(gain).over(w)).withColumn("__high", F.max("__in").over(w))

    def carry(buckets: DataFrame, before: Window, over: Window) -> DataFrame:
        held = buckets.withColumn("__start", F.sum("__sum").over(before))
        return held.withColumn("__peak", F.max(F.coalesce("__start", F.lit(0)) + F.col("__top")).over(before))

    rows = carried(df, key, order, width, own, {"__sum": F.sum(gain), "__top": F.max("__in")}, carry)
    start = F.coalesce("__start", F.lit(0))
    equity = F.when(F.col("__in").isNull(), F.col("__start")).otherwise(F.col("__in") + start)
    run = rows.select(*df.columns, equity.alias("equity"), F.greatest(F.lit(0), F.col("__high") + start, F.col("__peak")).alias("peak"))
    return run.withColumn("drawdown", F.col("peak") - F.col("equity"))


def rolling_beta(df: DataFrame, key: str, order: list[str], y: str, x: str, rows: int, width: int) -> DataFrame:
    """``beta`` of y on x over the last ``rows`` rows and the ``residual`` of the last one; null while there are fewer or x does not vary."""

    def made(w: Window) -> dict[str, Column]:
        n, total = F.count(x).over(w), lambda c: F.sum(c).over(w)
        var = n * total(F.col(x) * F.col(x)) - total(x) * total(x)
        return {"beta": F.when((n == rows) & (var > 0), (n * total(F.col(x) * F.col(y)) - total(x) * total(y)) / var), "__mx": total(x) / rows, "__my": total(y) / rows}

    out = rolling_rows(df, key, order, 1 - rows, 0, width, made)
    return out.withColumn("residual", F.col(y) - F.col("__my") - F.col("beta") * (F.col(x) - F.col("__mx"))).drop("__mx", "__my")


def trailing_sum(df: DataFrame, key: str, time: str, value: str, span: int, name: str = "trailing") -> DataFrame:
    """``trailing``: sum of the values in ``(time - span, time]``."""
    rows = with_halo(df, key, time, span, WIDE * span)
    w = Window.partitionBy("__k", "__b").orderBy(time).rangeBetween(1 - span, 0)
    return rows.withColumn(name, F.sum(value).over(w)).where(~F.col("__halo")).drop("__k", "__b", "__halo")


def chain_state(df: DataFrame, key: str, order: list[str], previous: str, current: str, width: int, reset: str | None = None) -> DataFrame:
    """Sequence audit: ``snapshot`` (first), ``maintenance_reset`` (the flag ``reset``, and numbers start again), ``update`` (chained), ``no_update`` (repeats), else ``gap``."""
    held = with_previous(df, key, order, [current], width)
    last, reset = F.col(f"previous_{current}"), F.col(reset) if reset else F.lit(False)
    state = F.when(last.isNull(), "snapshot").when(reset & (F.col(current) < last), "maintenance_reset").when(F.col(current) == last, "no_update").when(F.col(previous) == last, "update")
    return held.select(*df.columns, state.otherwise("gap").alias("state"))
