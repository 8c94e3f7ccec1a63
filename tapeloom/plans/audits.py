"""Audits and reports of studies as queries over the tape, footers of the tables' files, and views by series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import scalars as fn
from tapeloom.operators import aggregates as agg, audits, books, ordered, panels
from tapeloom.plans.market import _digest_sql
from tapeloom.plans.registry import DAY, HOUR, MINUTE, kind, query, tape
from tapeloom.sources import read_table, work_dir
from tapeloom.sources.footers import footer_statistics, footer_totals

# footers


@query("""SELECT name AS "column", low, high, nulls, n FROM (SELECT 'l_orderkey' AS name, min(l_orderkey)::VARCHAR AS low, max(l_orderkey)::VARCHAR AS high, count(*) - count(l_orderkey) AS nulls, count(*) AS n FROM lineitem UNION ALL
 SELECT 'l_returnflag', min(l_returnflag), max(l_returnflag), count(*) - count(l_returnflag), count(*) FROM lineitem)""")
def s16_footer_statistics(spark, sf):
    """Least and largest values by the footers alone, over all row groups of the files of a table."""
    stats = footer_statistics(spark, read_table(spark, sf, "lineitem").inputFiles())
    low, top = (F.when(F.col("kind") == "INT64", F.col(c).cast("long")) for c in ("low", "high"))
    made = stats.where(F.col("column").isin("l_orderkey", "l_returnflag")).groupBy("column").agg(
        F.coalesce(F.min(low).cast("string"), F.min("low")).alias("low"), F.coalesce(F.max(top).cast("string"), F.max("high")).alias("high"), F.sum("nulls").alias("nulls"), F.sum("n").alias("n")
    )
    return made.select("column", "low", "high", "nulls", "n")


@query("SELECT CAST(o_orderkey % 4 AS BIGINT) AS part, count(*) AS rows, min(o_orderkey)::VARCHAR AS low, max(o_orderkey)::VARCHAR AS high FROM orders GROUP BY 1")
def s17_totals_before_reading(spark, sf):
    """Rows and bounds of the files of each part, known from footers before a row is read."""
    path = f"{work_dir(spark)}-parts"
    orders = read_table(spark, sf, "orders")
    orders.withColumn("part", F.col("o_orderkey") % 4).repartition("part").write.partitionBy("part").option("parquet.block.size", 65_536).parquet(path)
    stats = footer_statistics(spark, spark.read.parquet(path).inputFiles())
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    bounds = stats.where(F.col("column") == "o_orderkey").groupBy(part.alias("part")).agg(F.min(F.col("low").cast("long")).cast("string").alias("low"), F.max(F.col("high").cast("long")).cast("string").alias("high"))
    return footer_totals(stats).groupBy(part.alias("part")).agg(F.sum("rows").alias("rows")).join(bounds, "part")


# chains of numbers


@query("""WITH n AS (SELECT *, event_type = 'signup' AS snap, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e), s AS (SELECT *, sum(snap::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS part, n * 5 AS cur, CASE WHEN c % 9 = 0 THEN n * 5 - 7 ELSE n * 5 - 5 END AS prev FROM n),
 o AS (SELECT *, CASE WHEN NOT snap AND (lag(cur) OVER (PARTITION BY user_id, part ORDER BY t, event_id) = prev) IS NOT TRUE THEN 1 ELSE 0 END AS off FROM s),
 b AS (SELECT *, coalesce(max(off) OVER (PARTITION BY user_id, part ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broken FROM o)
 SELECT event_id, CASE WHEN part = 0 THEN 'unanchored' WHEN snap THEN 'snapshot' WHEN broken = 1 THEN 'invalid' WHEN off = 1 THEN 'gap' ELSE 'update' END AS state FROM b""")
def t11_change_numbers_after_a_snapshot(spark, sf):
    """Updates that name the change before them; one that doesn't ends the book until its next snapshot."""
    rows = ordered.numbered(tape(spark, sf), "user_id", ["t", "event_id"], DAY, "n")
    rows = rows.withColumns({"cur": F.col("n") * 5, "prev": F.col("n") * 5 - F.when(F.col("c") % 9 == 0, 7).otherwise(5)})
    return books.change_chain(rows, "user_id", ["t", "event_id"], "prev", "cur", F.col("event_type") == "signup", DAY).select("event_id", "state")


@query("""WITH n AS (SELECT *, CASE WHEN event_type = 'signup' THEN 4 * row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) + k % 5 END AS edge, 4 * row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - CASE WHEN c % 4 = 0 THEN 5 ELSE c % 4 END AS id FROM e),
 p AS (SELECT *, last_value(edge IGNORE NULLS) OVER w AS edge_at, max(coalesce(edge, id)) OVER w AS top FROM n WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 q AS (SELECT *, greatest(edge_at, top) AS reached, CASE WHEN edge_at IS NULL THEN 'before' WHEN id <= edge_at THEN 'covered' WHEN id <= greatest(edge_at, top) THEN 'error' WHEN id = greatest(edge_at, top) + 1 THEN 'next' ELSE 'gap' END AS state FROM p WHERE edge IS NULL)
 SELECT event_id, state, CASE WHEN state = 'gap' THEN reached + 1 END AS missing_from, CASE WHEN state = 'gap' THEN id - 1 END AS missing_to FROM q""")
def t10_ids_covered_after_a_snapshot(spark, sf):
    """Prints by number after a snapshot's boundary: skipped ranges, and numbers that come again."""
    rows = ordered.numbered(tape(spark, sf), "user_id", ["t", "event_id"], DAY, "n")
    rows = rows.withColumn("id", 4 * F.col("n") - F.when(F.col("c") % 4 == 0, 5).otherwise(F.col("c") % 4))
    out = books.id_coverage(rows, "user_id", ["t", "event_id"], "id", F.when(F.col("event_type") == "signup", 4 * F.col("n") + F.col("k") % 5), DAY)
    return out.select("event_id", "state", "missing_from", "missing_to")


# spans, sources, slots

_SPANS = "p AS (SELECT DISTINCT user_id, t // 86400000000 AS start, t // 86400000000 + k % 6 AS stop FROM e WHERE event_type = 'error'), d AS (SELECT DISTINCT user_id, t // 86400000000 AS day FROM e WHERE event_type <> 'error')"


def _spans(spark, sf):
    e = tape(spark, sf).withColumn("day", fn.bucket(F.col("t"), DAY))
    spans = kind(e, "error").select("user_id", F.col("day").alias("start"), (F.col("day") + F.col("k") % 6).alias("stop")).distinct()
    return spans, e.where("event_type <> 'error'").select("user_id", "day")


@query(f"""WITH {_SPANS}, x AS (SELECT user_id, start, stop, unnest(range(start, stop + 1)) AS day FROM p), m AS (SELECT user_id, start, stop, count(*) FILTER (d.day IS NULL) AS missing, min(x.day) FILTER (d.day IS NULL) AS first_missing FROM x LEFT JOIN d USING (user_id, day) GROUP BY 1, 2, 3)
 SELECT *, CASE WHEN coalesce(first_missing - 1, stop) >= start THEN coalesce(first_missing - 1, stop) END AS held_to FROM m""")
def x13_x14_held_through(spark, sf):
    """What each span of a position lacks, and the last day that it can be held through."""
    spans, days = _spans(spark, sf)
    return audits.held_through(spans, days, "user_id", "day")


@query("""WITH a AS (SELECT user_id, t // 3600000000 AS hour, min(k % 8) AS lo, max(k % 8) AS hi, count(*) AS n FROM e WHERE event_type = 'view' GROUP BY 1, 2), b AS (SELECT user_id, t // 3600000000 AS hour, min(k % 8) AS lo, max(k % 8) AS hi, count(*) AS n FROM e WHERE event_type <> 'view' GROUP BY 1, 2)
 SELECT count(*) FILTER (a.n > 0 AND b.n > 0 AND a.lo = b.lo AND a.hi = b.hi) AS equal, count(*) FILTER (a.n > 0 AND b.n > 0 AND NOT (a.lo = b.lo AND a.hi = b.hi)) AS differ, count(*) FILTER (b.n IS NULL) AS only_a, count(*) FILTER (a.n IS NULL) AS only_b, count(*) FILTER (a.n > 1 OR b.n > 1) AS repeats FROM a FULL JOIN b USING (user_id, hour)""")
def x26_source_census(spark, sf):
    """Slot by slot agreement of two sources of a series."""
    e = tape(spark, sf).select("user_id", fn.bucket(F.col("t"), HOUR).alias("hour"), (F.col("k") % 8).alias("rate"), "event_type")
    return audits.source_census(kind(e, "view"), e.where("event_type <> 'view'"), ["user_id", "hour"], "rate")


@query("""WITH a AS (SELECT user_id, (t + 1200000000) // 3600000000 AS s, t - (t + 1200000000) // 3600000000 * 3600000000 > 1200000000 AS off FROM e), f AS (SELECT user_id, min(s) FILTER (NOT off) AS a, max(s) FILTER (NOT off) AS z, count(*) FILTER (off) AS off, count(DISTINCT s) FILTER (NOT off) AS met FROM a GROUP BY 1)
 SELECT user_id, coalesce(z - a + 1, 0) AS required, met, off, coalesce(z - a + 1, 0) = met AND off = 0 AND met > 0 AS qualifies FROM f""")
def x33_qualified_slots(spark, sf):
    """Whether every hour has its event within twenty minutes, and none lies elsewhere."""
    return audits.qualified_slots(tape(spark, sf), "user_id", "t", HOUR, 20 * MINUTE)


# schedules and brackets

_BARS = "b AS (SELECT user_id, t // 86400000000 AS day, max(c) AS high, min(c) AS low, arg_max(c, (t, event_id)) AS close FROM e GROUP BY 1, 2)"


def _bars(spark, sf):
    return tape(spark, sf).groupBy("user_id", fn.bucket(F.col("t"), DAY).alias("day")).agg(F.max("c").alias("high"), F.min("c").alias("low"), F.max_by("c", F.struct("t", "event_id")).alias("close"))


@query(f"WITH {_BARS}, s AS (SELECT user_id, day, CASE WHEN close > 1000 THEN 1 ELSE -1 END AS side FROM b) SELECT user_id, day, side, variant, CASE variant WHEN 'own' THEN side WHEN 'opposite' THEN -side ELSE 1 END AS position FROM s, (VALUES ('own'), ('opposite'), ('always')) v(variant)")
def x42_control_schedules(spark, sf):
    """A schedule beside its opposite and the one that is always long."""
    schedule = _bars(spark, sf).select("user_id", "day", F.when(F.col("close") > 1000, 1).otherwise(-1).alias("side"))
    return audits.control_schedules(schedule, "side")


@query(f"""WITH {_BARS}, s AS (SELECT user_id, day, close + 300 AS target, close - 200 AS stop FROM b), h AS (SELECT s.user_id, s.day, b.day AS hit_at, CASE WHEN low <= stop THEN 'stop' WHEN high >= target THEN 'target' END AS reason FROM s JOIN b ON b.user_id = s.user_id AND b.day BETWEEN s.day + 1 AND s.day + 5),
 f AS (SELECT user_id, day, min(hit_at) AS hit_at, arg_min(reason, hit_at) AS reason FROM h WHERE reason IS NOT NULL GROUP BY 1, 2) SELECT user_id, day, target, stop, coalesce(hit_at, day + 5) AS exit_at, coalesce(reason, 'timeout') AS reason FROM s LEFT JOIN f USING (user_id, day)""")
def x44_bracket_exits(spark, sf):
    """The bar that first touches the target or the stop of an entry, five days ahead at most."""
    bars = _bars(spark, sf)
    entries = bars.select("user_id", "day", (F.col("close") + 300).alias("target"), (F.col("close") - 200).alias("stop"))
    return audits.bracket_exits(entries, bars, "user_id", "day", 5)


_RUNS = "SELECT user_id, min(t) AS start, max(t) AS stop FROM (SELECT user_id, t, sum(f) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 43200000000 THEN 0 ELSE 1 END AS f FROM e WHERE event_type {0})) GROUP BY user_id, g"


@query(f"""WITH a AS ({_RUNS.format("= 'view'")}), b AS ({_RUNS.format("<> 'view'")}), o AS (SELECT user_id, sum(least(a.stop, b.stop) - greatest(a.start, b.start))::BIGINT AS overlap, count(*) AS pieces FROM a JOIN b USING (user_id) WHERE a.start < b.stop AND b.start < a.stop AND a.start < a.stop AND b.start < b.stop GROUP BY 1)
 SELECT user_id, coalesce(sa, 0)::BIGINT AS span_a, coalesce(sb, 0)::BIGINT AS span_b, coalesce(overlap, 0) AS overlap, coalesce(pieces, 0) AS pieces FROM (SELECT user_id, sum(stop - start) AS sa FROM a GROUP BY 1) FULL JOIN (SELECT user_id, sum(stop - start) AS sb FROM b GROUP BY 1) USING (user_id) LEFT JOIN o USING (user_id)""")
def x57_continuity_of_two_lanes(spark, sf):
    """How long two lanes are covered, and how long both."""
    e = tape(spark, sf)
    one, two = (ordered.bursts(df, "user_id", "t", 12 * HOUR, DAY).select("user_id", "start", "stop") for df in (kind(e, "view"), e.where("event_type <> 'view'")))
    return audits.continuity(one, two, "user_id", DAY)


@query("""WITH p AS (SELECT user_id % 4 AS config, t // 604800000000 AS week, t // 86400000000 AS day, sum(c) AS gross, sum(k) AS cost, sum(k % 7) AS paid, sum(k % 5) AS received, sum(CASE WHEN k > 20 THEN k ELSE 0 END) AS turnover, count(*) FILTER (event_type = 'error') AS forced FROM e GROUP BY 1, 2, 3)
 SELECT config, week, count(*) AS periods, count(*) FILTER (turnover > 0) AS traded, sum(gross)::BIGINT AS gross, sum(cost)::BIGINT AS cost, sum(paid)::BIGINT AS paid, sum(received)::BIGINT AS received, sum(turnover)::BIGINT AS turnover, sum(forced)::BIGINT AS forced, sum(gross - cost - paid + received)::BIGINT AS net, count(*) FILTER (gross - cost - paid + received > 0) AS gains, round(CASE WHEN sum(gross) > 0 THEN sum(cost)::DOUBLE / sum(gross)::DOUBLE END, 9) AS cost_share FROM p GROUP BY 1, 2""")
def x16_report_block(spark, sf):
    """The report of a portfolio by configuration and window."""
    e = tape(spark, sf).withColumns({"config": F.col("user_id") % 4, "week": fn.bucket(F.col("t"), 7 * DAY), "day": fn.bucket(F.col("t"), DAY)})
    made = {"gross": F.sum("c"), "cost": F.sum("k"), "paid": F.sum(F.col("k") % 7), "received": F.sum(F.col("k") % 5), "turnover": F.sum(F.when(F.col("k") > 20, F.col("k")).otherwise(0)), "forced": F.count_if(F.col("event_type") == "error")}
    periods = e.groupBy("config", "week", "day").agg(*[v.alias(n) for n, v in made.items()])
    return audits.report_block(periods, ["config", "week"]).withColumn("cost_share", F.round("cost_share", 9))


@query("SELECT user_id, CASE WHEN n < 60 THEN 1.0 ELSE coalesce(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END, 1.0) END::DOUBLE AS p FROM (SELECT user_id, count(*) AS n, round(avg(k) / 100, 9) AS a, CASE WHEN min(k) > 0 THEN NULL ELSE round(avg(c % 100) / 100, 9) END AS b FROM e GROUP BY 1)")
def m15_conservative_p(spark, sf):
    """The larger of two p-values, and 1 for small families."""
    u = tape(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("k") / 100, 9).alias("a"), F.when(F.min("k") <= 0, F.round(F.avg(F.col("c") % 100) / 100, 9)).alias("b"))
    return u.select("user_id", audits.conservative_p(F.col("a"), F.col("b"), F.col("n"), 60).alias("p"))


# validators


@query("""WITH f AS (SELECT CASE WHEN k % 19 = 0 THEN NULL ELSE (k - 50) / 800.0::DOUBLE END AS rate, CASE k % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END AS hours, CASE WHEN c % 3 = 0 THEN t ELSE t // 3600000000 * 3600000000 END AS t FROM e)
 SELECT count(*) AS n, count(*) FILTER (rate IS NULL) AS no_rate, count(*) FILTER ((abs(rate) <= 0.05) IS NOT TRUE) AS rate_out_of_bounds, count(*) FILTER (hours NOT IN (1, 2, 4, 8)) AS bad_interval, count(*) FILTER (t % 3600000000 <> 0) AS off_the_hour, count(*) FILTER (t // 3600000000 % hours <> 0) AS off_the_interval FROM f""")
def a3_funding_validator(spark, sf):
    f = tape(spark, sf).select(F.when(F.col("k") % 19 != 0, (F.col("k") - 50) / 800).alias("rate"), F.expr("CASE k % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END").alias("hours"), F.when(F.col("c") % 3 == 0, F.col("t")).otherwise(fn.bucket(F.col("t"), HOUR) * HOUR).alias("t"))
    return panels.violations(f, **audits.funding_rules("rate", "hours", "t"))


@query("""WITH m AS (SELECT CASE WHEN k % 11 <> 0 THEN k - 3 END AS oi, CASE WHEN k % 13 <> 0 THEN c - 20 END AS v, k % 7 AS ratio, CASE WHEN c % 5 = 0 THEN t ELSE t // 300000000 * 300000000 END AS t FROM e)
 SELECT count(*) AS n, count(*) FILTER ((oi IS NULL) <> (v IS NULL)) AS half_missing, count(*) FILTER (coalesce(oi, 0) < 0 OR coalesce(v, 0) < 0) AS negative, count(*) FILTER ((NOT (oi = 0 AND v > 0)) IS NOT TRUE) AS value_without_interest, count(*) FILTER (ratio <= 0) AS bad_ratio, count(*) FILTER (t % 300000000 <> 0) AS off_the_grid FROM m""")
def a4_metrics_validator(spark, sf):
    m = tape(spark, sf).select(F.when(F.col("k") % 11 != 0, F.col("k") - 3).alias("oi"), F.when(F.col("k") % 13 != 0, F.col("c") - 20).alias("v"), (F.col("k") % 7).alias("ratio"), F.when(F.col("c") % 5 == 0, F.col("t")).otherwise(fn.bucket(F.col("t"), 5 * MINUTE) * 5 * MINUTE).alias("t"))
    return panels.violations(m, **audits.metrics_rules("oi", "v", "ratio", "t"))


@query("""SELECT event_id, '{"a":{"b":[' || c || ',true],"y":"' || event_type || '"},"z":' || k || '}' AS canonical, sha256('{"a":{"b":[' || c || ',true],"y":"' || event_type || '"},"z":' || k || '}') AS digest FROM e""")
def f25_canonical_json(spark, sf):
    """Documents in one spelling, whatever the order of their keys and their spaces."""
    text = F.expr("""concat('{ "z" : ', CAST(k AS STRING), ', "a": {"y":"', event_type, '", "b": [', CAST(c AS STRING), ' ,true]} }')""")
    return tape(spark, sf).select("event_id", audits.canonical_json(text).alias("canonical")).withColumn("digest", F.sha2("canonical", 256))


# views by series


@query("""SELECT concat('hist_bn_', event_type, '_', CASE WHEN user_id % 2 = 0 THEN 'spot' ELSE 'perp' END) AS view, count(*) AS n, count(DISTINCT strftime(make_timestamp(t), '%Y-%m')) AS months, min(t) AS first, max(t) AS last FROM e GROUP BY 1
 UNION ALL SELECT concat('hist_hl_funding_', event_type), count(*), count(DISTINCT strftime(make_timestamp(t), '%Y-%m')), min(t), max(t) FROM e WHERE k > 50 GROUP BY 1""")
def v38_u3_views_by_series(spark, sf):
    """A view for each series over its month files, in two catalogs; what both catalogs hold, read through the views."""
    from tapeloom.sources.archives import series_views

    e = tape(spark, sf).withColumn("month", F.date_format(F.timestamp_micros("t"), "yyyy-MM"))
    market = F.when(F.col("user_id") % 2 == 0, "spot").otherwise("perp")
    one, two = f"{work_dir(spark)}-bn", f"{work_dir(spark)}-hl"
    e.select("t", "c", F.concat_ws("_", "event_type", market).alias("series"), "month").write.partitionBy("series", "month").parquet(one)
    e.where("k > 50").select("t", "c", F.concat_ws("_", F.lit("funding"), "event_type").alias("series"), "month").write.partitionBy("series", "month").parquet(two)
    views = series_views(spark, one, "hist_bn") | series_views(spark, two, "hist_hl")
    rows = [spark.table(name).select(F.lit(name).alias("view"), "t", "month") for name in sorted(views)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.groupBy("view").agg(F.count("*").alias("n"), F.countDistinct("month").alias("months"), F.min("t").alias("first"), F.max("t").alias("last"))


# accounts, rejects, pairs, candles, months


@query("""WITH d AS (SELECT user_id % 5 AS fold, t // 86400000000 AS day, sum(c - 1000) AS gain, sum(k) AS fee FROM e GROUP BY 1, 2), q AS (SELECT *, sum(gain - fee) OVER (PARTITION BY fold ORDER BY day) AS equity FROM d), p AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY fold ORDER BY day)) - equity AS dd FROM q)
 SELECT fold, arg_max(equity, day)::BIGINT AS equity, max(dd)::BIGINT AS drawdown, sum(fee)::BIGINT AS fees, count(*) AS n, round(avg(gain - fee) / stddev_samp(gain - fee) * sqrt(365), 6) AS sharpe FROM p GROUP BY 1""")
def a26_account_by_fold(spark, sf):
    """Equity, drawdown, fees and annualised ratio of each fold."""
    days = tape(spark, sf).groupBy((F.col("user_id") % 5).alias("fold"), fn.bucket(F.col("t"), DAY).alias("day")).agg(F.sum(F.col("c") - 1000).alias("gain"), F.sum("k").alias("fee"))
    return audits.account_summary(days, "fold", ["day"], "gain", "fee", 30).withColumn("sharpe", F.round("sharpe", 6))


@query("SELECT user_id, CASE WHEN (c > 300) IS NOT TRUE THEN 'bad_price' WHEN (CASE WHEN k % 17 <> 0 THEN k END > 5) IS NOT TRUE THEN 'bad_size' WHEN event_type = 'error' THEN 'unknown_side' ELSE 'accepted' END AS reason, count(*) AS n FROM e GROUP BY 1, 2")
def a27_reject_tally(spark, sf):
    """Why prints were not taken, by lane; the first rule that is broken counts."""
    rules = {"bad_price": F.col("c") > 300, "bad_size": F.when(F.col("k") % 17 != 0, F.col("k")) > 5, "unknown_side": F.col("event_type") != "error"}
    return audits.reject_tally(tape(spark, sf), ["user_id"], rules)


@query("""WITH l AS (SELECT user_id * 100 + t // 86400000000 % 100 AS pair, CASE WHEN k % 2 = 0 THEN 'spot' ELSE 'perp' END AS market, CASE WHEN k % 2 = 0 THEN c % 3 ELSE -(c % 3) END AS units, k / 100.0::DOUBLE AS weight FROM e),
 g AS (SELECT pair, count(*) <> 2 AS a, count(*) FILTER (market = 'spot' AND units > 0) <> 1 AS b, count(*) FILTER (market = 'perp' AND units < 0) <> 1 AS c, sum(units) <> 0 AS d, sum(abs(weight)) > 0.9 AS f FROM l GROUP BY 1)
 SELECT pair, concat_ws(',', CASE WHEN a THEN 'not_two_legs' END, CASE WHEN b THEN 'no_long_spot' END, CASE WHEN c THEN 'no_short_perp' END, CASE WHEN d THEN 'unequal_units' END, CASE WHEN f THEN 'over_the_cap' END) AS problems FROM g""")
def x50_carry_pairs(spark, sf):
    """Pairs that are not long spot and short perp in equal units under a cap."""
    e = tape(spark, sf)
    units = F.when(F.col("k") % 2 == 0, F.col("c") % 3).otherwise(-(F.col("c") % 3))
    legs = e.select((F.col("user_id") * 100 + fn.bucket(F.col("t"), DAY) % 100).alias("pair"), F.when(F.col("k") % 2 == 0, "spot").otherwise("perp").alias("market"), units.alias("units"), (F.col("k") / 100).alias("weight"), "event_id")
    return audits.pair_problems(legs, "pair", 0.9, ["event_id"])


_LINE = "concat_ws(',', CAST({t} AS {s}), concat(CAST(c AS {s}), '.50'), CAST(c + k % 5 - 1 AS {s}), CASE WHEN k % 23 = 0 THEN 'x' ELSE CAST(c - k % 3 AS {s}) END, CAST(c - k % 2 AS {s}), CASE WHEN k % 19 <> 0 THEN CAST(k AS {s}) END)"


@query(f"""WITH l AS (SELECT user_id, string_split({_LINE.format(t="t // 3600000000 * 3600 + CASE WHEN k % 29 = 0 THEN 7 ELSE 0 END", s="VARCHAR")}, ',') AS p FROM e),
 v AS (SELECT user_id, len(p) AS size, TRY_CAST(p[1] AS BIGINT) AS time, TRY_CAST(p[2] AS DECIMAL(28,8)) AS o, TRY_CAST(p[3] AS DECIMAL(28,8)) AS h, TRY_CAST(p[4] AS DECIMAL(28,8)) AS l, TRY_CAST(p[5] AS DECIMAL(28,8)) AS c, TRY_CAST(p[6] AS DECIMAL(28,8)) AS v FROM l),
 x AS (SELECT user_id, time, CASE WHEN size <> 6 THEN 'fields' WHEN time IS NULL OR o IS NULL OR h IS NULL OR l IS NULL OR c IS NULL OR v IS NULL THEN 'number' WHEN NOT (l > 0 AND h >= greatest(o, c, l) AND l <= least(o, c) AND v >= 0) THEN 'price' WHEN time % 3600 <> 0 THEN 'grid' END AS problem FROM v),
 g AS (SELECT user_id, time, count(*) AS n, count(problem) AS bad, max(CASE WHEN problem IS NULL THEN time END) AS good FROM x GROUP BY 1, 2)
 SELECT user_id, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, (coalesce((max(good) - min(good)) // 3600 + 1, 0) - count(good))::BIGINT AS missing, sum(greatest(n - bad - 1, 0))::BIGINT AS repeats FROM g GROUP BY 1""")
def x68_candle_snapshots(spark, sf):
    """Candle lines parsed and judged, and the snapshots that they make up."""
    time = fn.bucket(F.col("t"), HOUR) * 3600 + F.when(F.col("k") % 29 == 0, 7).otherwise(0)
    lines = tape(spark, sf).withColumn("at", time).select("user_id", F.expr(_LINE.format(t="at", s="STRING")).alias("line"))
    return audits.snapshot_problems(audits.parsed_candles(lines, "line", 3600), "user_id", 3600)


@query("SELECT event_id, rtrim(rtrim(CAST((CAST(c AS DECIMAL(20,10)) / 8 + CAST(c + k AS DECIMAL(20,10)) / 8)::DECIMAL(20,10) / 2 AS DECIMAL(20,10))::VARCHAR, '0'), '.') AS middle FROM e WHERE c > 0".replace("(CAST(c AS DECIMAL(20,10)) / 8 + CAST(c + k AS DECIMAL(20,10)) / 8)::DECIMAL(20,10) / 2", "(2 * c + k) / 16.0"))
def p10_mid_texts(spark, sf):
    """The middle of two prices as plain text, digit by digit."""
    e = tape(spark, sf).where("c > 0")
    eighths = lambda c: (c.cast("decimal(20,10)") / 8).cast("decimal(20,10)").cast("string")
    return e.select("event_id", fn.canonical_decimal(fn.mid_price(eighths(F.col("c")), eighths(F.col("c") + F.col("k")))).alias("middle"))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, last_day(o_orderdate) AS ends FROM orders), r AS (SELECT 1 AS run, DATE '1995-06-10' AS until UNION ALL SELECT 2, DATE '1996-02-01'),
 g AS (SELECT run, month, CASE WHEN ends < until THEN 'settled' ELSE 'provisional' END AS state, count(*) AS n FROM o, r WHERE month >= '1995-01' AND month <= '1996-06' GROUP BY ALL)
 SELECT run, month, state, n, run = 1 OR state = 'provisional' OR month >= '1995-06' AS written FROM g""")
def k5_provisional_and_settled_months(spark, sf):
    """Two runs of a month writer: settled months stay, provisional ones are replaced, and settle later."""
    from tapeloom.sources.archives import write_settling_months

    orders = read_table(spark, sf, "orders").withColumn("month_of", F.date_format("o_orderdate", "yyyy-MM")).where("month_of between '1995-01' and '1996-06'").drop("month_of")
    path, out = f"{work_dir(spark)}-months", None
    for run, until in ((1, "1995-06-10"), (2, "1996-02-01")):
        told = write_settling_months(orders, path, F.col("o_orderdate"), ["o_orderdate", "o_orderkey"], until).select(F.lit(run).alias("run"), "month", "state", F.col("rows").alias("n"), "written")
        out = told if out is None else out.unionByName(told)
    return out


@query("""WITH v AS (SELECT 'near' AS catalog, 'own_' || event_type AS view, count(*) AS n FROM e WHERE event_type <> 'error' GROUP BY 2 UNION ALL SELECT 'far', 'own_' || event_type, count(*) FROM e WHERE k < 50 GROUP BY 2 UNION ALL SELECT 'near', 'by_hand', count(*) FROM e WHERE c > 500)
 SELECT catalog, view, CASE WHEN view <> 'by_hand' THEN 'series' END AS owner, n FROM v""")
def s12_s13_u3_k13_stored_catalogs(spark, sf):
    """Two stored catalogs with views of one name; one is generated anew with fewer series, and a view made by hand stays in it."""
    from functools import reduce

    from tapeloom.sources.archives import generate_catalog, union_of_catalogs

    path = work_dir(spark)
    e = tape(spark, sf)
    e.write.parquet(f"{path}/e")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    names = {alias: f"{path.rsplit('/', 1)[-1].replace('-', '_')}_{alias}" for alias in ("near", "far")}
    series = lambda kept, more: {f"own_{x}": f"SELECT * FROM parquet.`{path}/e` WHERE event_type = '{x}'{more}" for x in kept}
    generate_catalog(spark, names["near"], f"{path}/near", series(kinds, ""), "series")
    generate_catalog(spark, names["far"], f"{path}/far", series(kinds, " AND k < 50"), "series")
    spark.sql(f"CREATE VIEW `{names['near']}`.by_hand AS SELECT * FROM parquet.`{path}/e` WHERE c > 500")
    generate_catalog(spark, names["near"], f"{path}/near", series([x for x in kinds if x != "error"], ""), "series")
    found = union_of_catalogs(spark, names)
    counts = [spark.table(f"`{names[r['catalog']]}`.`{r['view']}`").agg(F.lit(r["catalog"]).alias("catalog"), F.lit(r["view"]).alias("view"), F.count("*").alias("n")) for r in found.collect()]
    return found.join(reduce(lambda a, b: a.unionByName(b), counts), ["catalog", "view"])


_CANDLE = "max(k) || '.5' AS high, CASE WHEN count(*) % 7 = 0 THEN 'n/a' ELSE min(k) || '.25' END AS low, arg_min(k, (t, event_id)) || '.0' AS open, arg_max(k, (t, event_id)) || '.0' AS close, sum(c) || '' AS volume"


@query(f"""WITH b AS (SELECT 'hour' AS interval, t // 3600000000 * 3600000000 AS t, {_CANDLE} FROM e GROUP BY 2 UNION ALL SELECT 'day', t // 86400000000 * 86400000000 AS t, {_CANDLE} FROM e GROUP BY 2)
 SELECT interval, t AS opened, open::DOUBLE AS open, high::DOUBLE AS high, TRY_CAST(low AS DOUBLE) AS low, close::DOUBLE AS close, volume::DOUBLE AS volume, (TRY_CAST(low AS DOUBLE) IS NULL)::INT AS bad FROM b""")
def s18_day_and_hour_candles(spark, sf):
    """Candle files of two intervals, each with its unit of time, as typed bars; bad cells are counted."""
    from tapeloom.sources.archives import typed_bars

    e, path, rank = tape(spark, sf), f"{work_dir(spark)}-candles", F.struct("t", "event_id")
    text = lambda c, tail: F.concat(c.cast("string"), F.lit(tail))
    for name, width, unit in (("hour", HOUR, 1000), ("day", DAY, 1_000_000)):
        at = fn.bucket(F.col("t"), width)
        low = F.when(F.count("*") % 7 == 0, "n/a").otherwise(text(F.min("k"), ".25"))
        made = {"high": text(F.max("k"), ".5"), "low": low, "open": text(F.min_by("k", rank), ".0"), "close": text(F.max_by("k", rank), ".0"), "volume": text(F.sum("c"), "")}
        e.groupBy(at.alias("at")).agg(*[v.alias(c) for c, v in made.items()]).select(fn.bucket(F.col("at") * width, unit).cast("string").alias("t"), *made).write.parquet(f"{path}/interval={name}")
    bars = typed_bars(spark, path)
    return bars.select("interval", F.unix_micros("opened").alias("opened"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")], "bad")


@query("""WITH d AS (SELECT DISTINCT user_id, t // 86400000000 AS day FROM e WHERE event_type = 'view'), l AS (SELECT user_id, min(t // 86400000000) + user_id % 3 - 1 AS listed, CASE WHEN user_id % 4 <> 0 THEN max(t // 86400000000) - user_id % 5 + 1 END AS delisted FROM e GROUP BY 1),
 s AS (SELECT user_id, listed, coalesce(delisted, (SELECT max(day) FROM d)) AS ends FROM l), m AS (SELECT user_id, listed, ends, min(day) FILTER (day BETWEEN listed AND ends) AS a, max(day) FILTER (day BETWEEN listed AND ends) AS z, count(day) FILTER (day BETWEEN listed AND ends) AS n, count(day) FILTER (day NOT BETWEEN listed AND ends) AS outside FROM s LEFT JOIN d USING (user_id) GROUP BY 1, 2, 3)
 SELECT user_id, CASE WHEN a IS NULL THEN greatest(ends - listed + 1, 0) ELSE a - listed END AS early, coalesce(ends - z, 0) AS late, coalesce(z - a + 1 - n, 0) AS inside, outside FROM m""")
def x19_runs_from_listing_to_delisting(spark, sf):
    """Days that a listed lane lacks before its first row, after its last, and between; rows outside its listing."""
    e = tape(spark, sf).withColumn("day", fn.bucket(F.col("t"), DAY))
    listings = e.groupBy("user_id").agg((F.min("day") + F.col("user_id") % 3 - 1).alias("listed"), F.when(F.col("user_id") % 4 != 0, F.max("day") - F.col("user_id") % 5 + 1).alias("delisted"))
    return audits.run_completeness(kind(e, "view"), listings, "user_id", "day")


@query(f"""WITH n AS ({_digest_sql("e", ["event_id", "k"], "user_id")}), o AS ({_digest_sql("(SELECT * FROM e WHERE event_type <> 'error' OR k > 20)", ["event_id", "k"], "user_id")})
 SELECT n.user_id, CASE WHEN n.user_id % 7 = 0 THEN 'write' WHEN n.user_id % 5 = 0 THEN 'rebuild' WHEN o.digest IS NULL OR n.user_id % 4 = 0 THEN 'untracked' WHEN o.digest = n.digest THEN 'audit' ELSE 'other_sources' END AS decision FROM n LEFT JOIN o USING (user_id)""")
def k9_what_to_do_with_outputs(spark, sf):
    """An output for each lane, with the digest of the sources that was recorded and that of now."""
    from tapeloom.sources.archives import output_decision

    e = tape(spark, sf)
    now = agg.multiset_digest(e, ["event_id", "k"], ["user_id"]).select("user_id", F.col("digest").alias("now"))
    old = agg.multiset_digest(e.where("event_type <> 'error' or k > 20"), ["event_id", "k"], ["user_id"]).select("user_id", F.when(F.col("user_id") % 4 != 0, F.col("digest")).alias("old"))
    return now.join(old, "user_id", "left").select("user_id", output_decision(F.col("old"), F.col("now"), F.col("user_id") % 7 != 0, F.col("user_id") % 5 == 0).alias("decision"))
