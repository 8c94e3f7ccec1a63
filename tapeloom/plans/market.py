"""Queries of joins in time, validators, aggregates and ordered analytics over the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import scalars as fn
from tapeloom.operators import aggregates as agg, joins, ordered, panels, ranks
from tapeloom.plans.registry import DAY, HOUR, MINUTE, kind, query, tape
from tapeloom.sources import read_table

# joins


@query("SELECT a.event_id, b.event_id AS source_id FROM e a JOIN e b ON a.event_type = 'error' AND b.event_type = CASE WHEN a.k % 2 = 0 THEN 'view' ELSE 'click' END AND b.user_id = a.user_id AND b.t // 3600000000 = a.t // 3600000000")
def j2_join_on_a_payload_channel(spark, sf):
    e = tape(spark, sf).withColumn("hour", fn.bucket(F.col("t"), HOUR))
    marks = kind(e, "error").select("event_id", "user_id", "hour", F.when(F.col("k") % 2 == 0, "view").otherwise("click").alias("event_type"))
    return marks.join(e.select(F.col("event_id").alias("source_id"), "user_id", "hour", "event_type"), ["user_id", "hour", "event_type"]).select("event_id", "source_id")


@query("SELECT user_id, s.side, sum(CASE WHEN s.side = 'bid' THEN k ELSE c END) AS total FROM e, (VALUES ('bid'), ('ask')) s(side) GROUP BY ALL")
def j6_two_sides(spark, sf):
    sides = F.explode(F.array(F.struct(F.lit("bid").alias("side"), F.col("k").alias("v")), F.struct(F.lit("ask").alias("side"), F.col("c").alias("v"))))
    return tape(spark, sf).select("user_id", sides.alias("s")).groupBy("user_id", "s.side").agg(F.sum("s.v").alias("total"))


@query("""WITH f AS (SELECT user_id, k % 10 AS valid_from, min((t, valid_to, c)) AS r FROM (SELECT *, CASE WHEN k < 50 THEN k % 10 + 4 END AS valid_to FROM e WHERE event_type = 'view') GROUP BY 1, 2),
 a AS (SELECT event_id AS ask, user_id, t AS received, k % 12 AS event FROM e WHERE event_type = 'error'),
 m AS (SELECT ask, count(*) AS n, min(r[3]) AS c FROM a JOIN f USING (user_id) WHERE r[1] <= received AND valid_from <= event AND (r[2] IS NULL OR event < r[2]) GROUP BY 1)
 SELECT ask, CASE WHEN n = 1 THEN c END AS c FROM a LEFT JOIN m USING (ask)""".replace("min((t, valid_to, c)) AS r", "arg_min([t, valid_to, c], [t, coalesce(valid_to, -1), c]) AS r"))
def j9_bitemporal_facts(spark, sf):
    e = tape(spark, sf)
    facts = kind(e, "view").select("user_id", (F.col("k") % 10).alias("valid_from"), F.when(F.col("k") < 50, F.col("k") % 10 + 4).alias("valid_to"), F.col("t").alias("observed"), "c")
    asks = kind(e, "error").select(F.col("event_id").alias("ask"), "user_id", F.col("t").alias("received"), (F.col("k") % 12).alias("event"))
    return joins.known_at(facts, asks, "user_id", ["c"], DAY).select("ask", "c")


@query("""SELECT DISTINCT b.bucket FROM (SELECT unnest(range(min(t) // 3600000000, max(t) // 3600000000 + 1)) AS bucket FROM e) b WHERE bucket NOT IN (SELECT (t + 60000000) // 3600000000 FROM e WHERE event_type = 'signup' AND k < 40)""")
def j14_uncovered_buckets(spark, sf):
    e = tape(spark, sf)
    settled = kind(e, "signup").where("k < 40").select(fn.slot_of(F.col("t"), HOUR, MINUTE).alias("bucket"))
    return joins.uncovered(joins.spine(e, "t", HOUR), settled, ["bucket"])


@query("SELECT a.day, a.n, b.c FROM (SELECT t // 86400000000 AS day, count(*) AS n FROM e GROUP BY 1) a LEFT JOIN (SELECT (t + 60000000) // 86400000000 AS day, sum(c) AS c FROM e WHERE event_type = 'signup' GROUP BY 1) b USING (day)")
def j15_settlements_by_day(spark, sf):
    e = tape(spark, sf)
    days = e.groupBy(fn.bucket(F.col("t"), DAY).alias("day")).agg(F.count("*").alias("n"))
    return days.join(kind(e, "signup").groupBy(fn.slot_of(F.col("t"), DAY, MINUTE).alias("day")).agg(F.sum("c").alias("c")), "day", "left")


@query("SELECT a.minute, a.n, b.n AS prior_n FROM (SELECT t // 60000000 AS minute, count(*) AS n FROM e GROUP BY 1) a LEFT JOIN (SELECT t // 60000000 AS minute, count(*) AS n FROM e GROUP BY 1) b ON b.minute = a.minute - 5")
def j16_lagged_snapshots(spark, sf):
    minutes = tape(spark, sf).groupBy(fn.bucket(F.col("t"), MINUTE).alias("minute")).agg(F.count("*").alias("n"))
    return joins.offset_join(minutes, "minute", 5, ["n"])


@query("""WITH d AS (SELECT o_orderdate AS ts, o_totalprice AS v, year(o_orderdate) * 12 + month(o_orderdate) AS month FROM orders)
 SELECT a.month, a.v AS primary, b.v AS control, round(a.v - b.v, 4) AS excess FROM (SELECT month, arg_max(v, (ts, v)) AS v FROM d WHERE day(ts) = day(last_day(ts)) GROUP BY 1) a JOIN (SELECT month, arg_max(v, (ts, v)) AS v FROM d WHERE day(ts) = 15 GROUP BY 1) b USING (month)""".replace("AS primary", 'AS "primary"'))
def j17_m20_calendar_pairs(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"))
    return joins.paired_by_month(o, o, "ts", "v").withColumn("excess", F.round(F.col("primary") - F.col("control"), 4))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS lanes, count(DISTINCT event_type) AS n FROM e GROUP BY 1")
def j19_lanes_of_keys(spark, sf):
    found = joins.lanes_of(tape(spark, sf), "user_id", "event_type")
    return found.withColumn("lanes", F.array_join("lanes", ","))


@query("SELECT event_type AS stream, event_id, t FROM e WHERE event_type IN ('view', 'click', 'error')")
def j20_o1_three_streams_in_order(spark, sf):
    e = tape(spark, sf)
    return joins.total_order({n: kind(e, n) for n in ("view", "click", "error")}, ["t", "event_id"], ["event_id", "t"]).drop("rank")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j21_declared_universe(spark, sf):
    universe = read_table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read_table(spark, sf, "orders").join(universe, "o_custkey", "left_semi").select("o_orderkey")


# validators and aggregates


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (NOT (k BETWEEN 1 AND 95)) AS bad_rate, count(*) FILTER (c <= 0) AS bad_size, count(*) FILTER (t % 2 = 1) AS odd FROM e WHERE event_type = 'view' GROUP BY 1""")
def a2_a3_a4_validators(spark, sf):
    v = kind(tape(spark, sf), "view")
    return panels.violations(v, bad_rate=F.col("k").between(1, 95), bad_size=F.col("c") > 0, odd=F.col("t") % 2 == 0).withColumn("event_type", F.lit("view"))


@query("""WITH b AS (SELECT user_id, t // 86400000000 AS day, arg_min(c, t) AS o, max(c) - k0 AS h, min(c) AS l, arg_max(c, t) AS c, sum(k) AS v FROM (SELECT *, k % 2 AS k0 FROM e) GROUP BY 1, 2, k0)
 SELECT count(*) AS n, count(*) FILTER (NOT (o > 0 AND h > 0 AND l > 0 AND c > 0)) AS bad_price, count(*) FILTER (h < greatest(o, c, l)) AS bad_high, count(*) FILTER (l > least(o, c, h)) AS bad_low, count(*) FILTER (v < 0) AS bad_volume, 0 AS not_finite FROM b""")
def a5_candle_validator(spark, sf):
    bars = agg.bars(tape(spark, sf).withColumn("k0", F.col("k") % 2), ["user_id", fn.bucket(F.col("t"), DAY).alias("day"), "k0"], ["t"], "c", "k").withColumn("high", F.col("high") - F.col("k0"))
    return panels.violations(bars, **panels.candle_rules("open", "high", "low", "close", "volume"))


@query("SELECT event_type, CASE WHEN count(*) FILTER (unit = 'ms') = count(*) THEN 'ms' WHEN count(*) FILTER (unit = 'us') = count(*) THEN 'us' ELSE 'mixed' END AS unit FROM (SELECT event_type, CASE WHEN event_type = 'view' OR (event_type = 'error' AND k < 50) THEN 'ms' ELSE 'us' END AS unit FROM e) GROUP BY 1")
def a7_unit_of_a_column(spark, sf):
    ms = (F.col("event_type") == "view") | ((F.col("event_type") == "error") & (F.col("k") < 50))
    e = tape(spark, sf).withColumn("unit", fn.epoch_unit(F.when(ms, fn.bucket(F.col("t"), 1000)).otherwise(F.col("t"))))
    return e.groupBy("event_type").agg(F.when(F.min("unit") == F.max("unit"), F.min("unit")).otherwise("mixed").alias("unit"))


@query("SELECT 'events' AS side, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last, count(*) AS n FROM events UNION ALL SELECT 'orders', min(epoch_us(o_orderdate)), max(epoch_us(o_orderdate)), count(*) FROM orders UNION ALL SELECT 'all', min(t), max(t), count(*) FROM (SELECT epoch_us(ts) AS t FROM events UNION ALL SELECT epoch_us(o_orderdate) FROM orders)")
def a8_a9_u1_spans_of_a_union(spark, sf):
    both = read_table(spark, sf, "events").select(F.lit("events").alias("side"), fn.micros("ts").alias("t")).unionByName(read_table(spark, sf, "orders").select(F.lit("orders").alias("side"), fn.micros("o_orderdate").alias("t")))
    return both.rollup("side").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n")).withColumn("side", F.coalesce("side", F.lit("all")))


@query("SELECT event_type, k % 2 AS direction, count(*) AS n, sum(octet_length(encode(props))) AS bytes FROM e GROUP BY ALL")
def a10_channels_and_bytes(spark, sf):
    return tape(spark, sf).groupBy("event_type", (F.col("k") % 2).alias("direction")).agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes"))


@query("""WITH s AS (SELECT unnest(range(min(t) // 3600000000, max(t) // 3600000000 + 1)) AS h FROM e), v AS (SELECT DISTINCT t // 3600000000 AS h FROM e WHERE event_type = 'view'), c AS (SELECT DISTINCT t // 3600000000 AS h FROM e WHERE event_type = 'click')
 SELECT count(*) AS slots, count(*) FILTER (v.h IS NOT NULL AND c.h IS NOT NULL) AS complete, round(avg(CASE WHEN v.h IS NULL OR c.h IS NULL THEN 1.0 ELSE 0.0 END), 9) AS gap_fraction FROM s LEFT JOIN v ON s.h = v.h LEFT JOIN c ON s.h = c.h""")
def a12_a13_hour_coverage(spark, sf):
    e = tape(spark, sf)
    found = agg.coverage(joins.spine(e, "t", HOUR, "h"), *[panels.slots_of(kind(e, n), "t", HOUR, "h") for n in ("view", "click")])
    return found.withColumn("gap_fraction", F.round("gap_fraction", 9))


#: A row as one text, and the pieces of its SHA-256, in SQL.
def _digest_sql(table: str, columns: list[str], by: str = "") -> str:
    text = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns)
    sums = ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {at}, 15) AS BIGINT)), 0)::VARCHAR" for at in (1, 16))
    keys = f"{by}, " if by else ""
    return f"SELECT {keys}count(*) AS n, sha256(concat_ws(':', count(*)::VARCHAR, {sums})) AS digest FROM (SELECT *, sha256({text}) AS h FROM {table}){f' GROUP BY {by}' if by else ''}"


@query(f"SELECT n, first, last, digest FROM ({_digest_sql('e', ['c', 'event_id', 'event_type', 'k', 't'])}), (SELECT min(t) AS first, max(t) AS last FROM e)")
def a14_relation_fingerprint(spark, sf):
    """A digest that any engine with SHA-256 gives, whatever the order of rows."""
    return agg.fingerprint(tape(spark, sf).select("event_id", "event_type", "t", "c", "k"), "t")


@query(f"WITH w AS (SELECT user_id, t, k, row_number() OVER (ORDER BY t, event_id) AS place FROM e WHERE k % 3 = 0) {_digest_sql('w', ['place', 'user_id', 'k'])}")
def x38_ordered_digest(spark, sf):
    """The digest of a list in its order, to be compared with a pinned one."""
    return agg.ordered_digest(tape(spark, sf).where("k % 3 = 0"), ["t", "event_id"], ["user_id", "k"], DAY)


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM e), p AS ({_digest_sql('u', ['user_id'])}), q AS ({_digest_sql("(SELECT DISTINCT user_id FROM e WHERE k > 90)", ['user_id'])}),
 x AS (SELECT user_id, CASE WHEN event_type = 'error' THEN p.digest ELSE q.digest END AS pin FROM e, p, q WHERE c % 50 = 0 AND event_type IN ('error', 'signup'))
 SELECT user_id, 'kept' AS state FROM u WHERE user_id NOT IN (SELECT user_id FROM x, p WHERE pin = digest) UNION ALL SELECT user_id, 'refused' FROM x, p WHERE pin <> digest""")
def x22_exclusions_bound_to_a_universe(spark, sf):
    """Exclusions hold only for the universe whose digest they carry."""
    e = tape(spark, sf)
    whole, part = (agg.multiset_digest(df.select("user_id").distinct(), ["user_id"]).select(F.col("digest").alias(n)) for df, n in ((e, "p"), (e.where("k > 90"), "q")))
    listed = e.where("c % 50 = 0 and event_type in ('error', 'signup')").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(part))  # a row each
    listed = listed.select("user_id", F.when(F.col("event_type") == "error", F.col("p")).otherwise(F.col("q")).alias("pin"))
    kept, refused = agg.bound_exclusions(e.select("user_id"), listed, "user_id")
    return kept.withColumn("state", F.lit("kept")).unionByName(refused.select("user_id", F.lit("refused").alias("state")))


@query("""SELECT t // 60000000 AS minute, sum(CASE WHEN event_type = 'view' THEN c ELSE -c END) AS signed, sum(c) AS total, count(*) AS n, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS sessions, count(*) - count(DISTINCT event_id) AS repeats FROM e GROUP BY 1""")
def a16_flow_by_minute(spark, sf):
    made = [F.sum(F.when(F.col("event_type") == "view", F.col("c")).otherwise(-F.col("c"))).alias("signed"), F.sum("c").alias("total"), F.count("*").alias("n")]
    sessions = F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), ",").alias("sessions")
    return tape(spark, sf).groupBy(fn.bucket(F.col("t"), MINUTE).alias("minute")).agg(*made, sessions, (F.count("*") - F.countDistinct("event_id")).alias("repeats"))


@query("SELECT user_id, string_agg(code || '=' || n, ',' ORDER BY code) AS codes, any_value(last) AS last FROM (SELECT user_id, k % 4 AS code, count(*) AS n, arg_max(event_type, (t, event_id)) FILTER (true) AS x FROM e WHERE event_type IN ('error', 'signup') GROUP BY 1, 2) JOIN (SELECT user_id, arg_max(event_type, (t, event_id)) AS last FROM e WHERE event_type IN ('error', 'signup') GROUP BY 1) USING (user_id) GROUP BY 1")
def a18_nested_counters(spark, sf):
    """Counts by code within a profile as a map, and the last value seen."""
    e = tape(spark, sf).where("event_type in ('error', 'signup')")
    codes = e.groupBy("user_id", (F.col("k") % 4).alias("code")).agg(F.count("*").alias("n"), F.max(F.struct("t", "event_id", "event_type")).alias("l"))
    held = codes.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("codes"), F.max("l")["event_type"].alias("last"))
    return held.select("user_id", F.array_join(F.transform("codes", lambda x: F.concat_ws("=", x["code"], x["n"])), ",").alias("codes"), "last")


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'signup') THEN 'signup' END AS status, count(*) AS n FROM e GROUP BY 1")
def a19_a27_a28_first_status(spark, sf):
    e = tape(spark, sf).groupBy("user_id").agg(F.collect_set("event_type").alias("held"), F.count("*").alias("n"))
    return e.select("user_id", fn.first_status(F.col("held"), ("error", "purchase", "signup")).alias("status"), "n")


@query("SELECT user_id, day, quantile_cont(n, 0.5) OVER w AS middle, CASE WHEN n >= 2 * quantile_cont(n, 0.5) OVER w THEN true ELSE false END AS burst FROM (SELECT user_id, t // 86400000000 AS day, count(*) AS n FROM e GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")
def a23_a24_rolling_medians(spark, sf):
    days = tape(spark, sf).groupBy("user_id", fn.bucket(F.col("t"), DAY).alias("day")).agg(F.count("*").alias("n"))
    out = ordered.rolling_rows(days, "user_id", ["day"], -7, -1, 100, lambda w: {"middle": F.expr("percentile(n, 0.5)").over(w)})
    return out.select("user_id", "day", "middle", F.coalesce(F.col("n") >= 2 * F.col("middle"), F.lit(False)).alias("burst"))


@query("""WITH d AS (SELECT user_id % 5 AS fold, t // 86400000000 AS day, sum(c - 1000) / 100000.0 AS r FROM e GROUP BY 1, 2) SELECT fold, count(*) AS n, round(avg(r), 8) AS mean, round(sum(r), 6) AS total, round(avg(r) / stddev_samp(r) * sqrt(365), 6) AS sharpe, round(sum(CASE WHEN r > 0 THEN r ELSE 0 END), 6) AS gains FROM d GROUP BY 1""")
def a21_a25_a26_m14_by_fold(spark, sf):
    days = tape(spark, sf).groupBy((F.col("user_id") % 5).alias("fold"), fn.bucket(F.col("t"), DAY).alias("day")).agg((F.sum(F.col("c") - 1000) / 100000.0).alias("r"))
    made = {"mean": F.round(F.avg("r"), 8), "total": F.round(F.sum("r"), 6), "sharpe": F.round(F.avg("r") / F.stddev_samp("r") * 365**0.5, 6), "gains": F.round(F.sum(F.greatest("r", F.lit(0.0))), 6)}
    return days.groupBy("fold").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in made.items()])


# ordered analytics


@query("SELECT user_id, t // 3600000000 AS hour, arg_min(c, (event_type, c)) AS c, min(event_type) AS source, count(*) AS n FROM e GROUP BY 1, 2")
def w2_preferred_source(spark, sf):
    e = tape(spark, sf).select("user_id", fn.bucket(F.col("t"), HOUR).alias("hour"), F.col("event_type").alias("source"), "c")
    return panels.preferred(e, ["user_id", "hour"], "source", ["c"])


@query("SELECT user_id, t // 3600000000 AS hour, arg_max(c, (event_type, c)) AS c, max(event_type) AS source, count(*) AS n FROM e GROUP BY 1, 2")
def w3_latest_source(spark, sf):
    e = tape(spark, sf).select("user_id", fn.bucket(F.col("t"), HOUR).alias("hour"), F.col("event_type").alias("source"), "c")
    return panels.preferred(e, ["user_id", "hour"], "source", ["c"], latest=True)


@query("SELECT event_id, source FROM (SELECT event_id, 'coarser' AS source FROM e WHERE event_type = 'view' AND k < 30 UNION ALL SELECT event_id, 'finer' FROM e WHERE event_type = 'click' AND t // 3600000000 NOT IN (SELECT t // 3600000000 FROM e WHERE event_type = 'view' AND k < 30))")
def u6_coarser_supersedes(spark, sf):
    e = tape(spark, sf).select("event_id", "event_type", "t", "k")
    return panels.superseded(kind(e, "click"), kind(e, "view").where("k < 30"), fn.bucket(F.col("t"), HOUR)).select("event_id", "source")


@query("SELECT user_id, t AS hole_from, nt AS hole_to FROM (SELECT user_id, t, lead(t) OVER w AS nt, greatest(k, lead(k) OVER w) * 600000000 AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE nt - t > s + 60000000")
def w7_irregular_holes(spark, sf):
    return panels.irregular_holes(tape(spark, sf).withColumn("step", F.col("k") * 10 * MINUTE), "user_id", "t", "step", MINUTE, DAY)


@query("""SELECT user_id, count(*) FILTER (d = 0) AS duplicates, count(*) FILTER (d < 0) AS backwards, count(*) FILTER (d > 3) AS gaps, min(event_id) FILTER (d = 0 OR d < 0 OR d > 3) AS first_bad FROM (SELECT user_id, event_id, k - lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM e) GROUP BY 1""")
def w8_x2_clock_audit(spark, sf):
    return panels.clock_audit(tape(spark, sf), "user_id", ["event_id"], "k", 3, 1000)


_RETURNS = "WITH d AS (SELECT user_id, t // 86400000000 AS day, avg(c) AS p FROM e GROUP BY 1, 2), r AS (SELECT a.user_id, a.day, ln(a.p / b1.p) AS r1, ln(a.p / b3.p) AS r3 FROM d a LEFT JOIN d b1 ON b1.user_id = a.user_id AND b1.day = a.day - 1 LEFT JOIN d b3 ON b3.user_id = a.user_id AND b3.day = a.day - 3)"


def _returns(spark, sf):
    days = tape(spark, sf).groupBy("user_id", fn.bucket(F.col("t"), DAY).alias("day")).agg(F.avg("c").alias("p"))
    for n in (1, 3):
        days = joins.offset_join(days, "day", n, ["p"], ["user_id"]).withColumnRenamed("prior_p", f"p{n}")
    return days.select("user_id", "day", "p", *[fn.log_ratio(F.col("p"), F.col(f"p{n}")).alias(f"r{n}") for n in (1, 3)])  # after both joins, so that Python runs in no stage of its own


@query(f"{_RETURNS} SELECT user_id, day, round(r1, 9) AS r1, round(r3, 9) AS r3, (CASE WHEN r1 > 0 THEN 1.0 WHEN r1 < 0 THEN -1.0 ELSE 0.0 END + CASE WHEN r3 > 0 THEN 1.0 WHEN r3 < 0 THEN -1.0 ELSE 0.0 END) / 2 AS trend FROM r WHERE r1 IS NOT NULL AND r3 IS NOT NULL")
def w9_w10_lookback_returns(spark, sf):
    """Log returns over exact lookbacks, and the mean of their signs; a hole gives none, a price of zero an infinite one."""
    r = _returns(spark, sf).where("r1 is not null and r3 is not null")
    return r.select("user_id", "day", fn.rounded(F.col("r1"), 9).alias("r1"), fn.rounded(F.col("r3"), 9).alias("r3"), ((fn.sign_of(F.col("r1")) + fn.sign_of(F.col("r3"))) / 2).alias("trend"))


@query(f"{_RETURNS} SELECT user_id, day, round(CASE WHEN count(r1) OVER w = 5 THEN stddev_samp(r1) OVER w END, 9) AS vol, round(CASE WHEN count(r1) OVER w = 5 AND sum(r1 * r1) OVER w > 0 THEN sum(r1) OVER w / sqrt(sum(r1 * r1) OVER w) END, 9) AS score FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS 4 PRECEDING)")
def w11_w18_w19_w20_volatility_and_momentum(spark, sf):
    """Realised volatility and volatility-scaled momentum of the last five rows, only where all have a return."""
    r = _returns(spark, sf)

    def made(w):
        full, squares = F.count("r1").over(w) == 5, F.sum(F.col("r1") * F.col("r1")).over(w)
        return {"vol": F.when(full, F.stddev_samp("r1").over(w)), "score": F.when(full & (squares > 0), F.sum("r1").over(w) / F.sqrt(squares))}

    return ordered.rolling_rows(r, "user_id", ["day"], -4, 0, 100, made).select("user_id", "day", fn.rounded(F.col("vol"), 9).alias("vol"), fn.rounded(F.col("score"), 9).alias("score"))


@query("""WITH s AS (SELECT user_id, event_id, t, avg(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS 2 PRECEDING) AS m FROM e WHERE event_type = 'signup')
 SELECT p.event_id, round(arg_max(s.m, s.t), 6) AS m FROM e p LEFT JOIN s ON s.user_id = p.user_id AND s.t <= p.t AND p.t - s.t <= 259200000000 WHERE p.event_type = 'purchase' GROUP BY 1""")
def w12_mean_of_last_settlements(spark, sf):
    e = tape(spark, sf)
    means = ordered.rolling_rows(kind(e, "signup"), "user_id", ["t", "event_id"], -2, 0, DAY, lambda w: {"m": F.avg("c").over(w)})
    found = joins.asof_backward(kind(e, "purchase").select("event_id", "user_id", "t"), means, "user_id", "t", 72 * HOUR, "m")
    return found.select("event_id", F.round("m", 6).alias("m"))


@query(f"{_RETURNS} SELECT user_id, day, round(CASE WHEN count(*) OVER w = 4 AND day - min(day) OVER w = 3 AND count(r1) OVER w = 4 THEN sum(r1) OVER w END, 9) AS held FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS 3 PRECEDING)")
def w15_whole_window_features(spark, sf):
    """A feature that is null unless its whole window is there without a hole and traded."""

    def made(w):
        whole = (F.count("*").over(w) == 4) & (F.col("day") - F.min("day").over(w) == 3) & (F.count("r1").over(w) == 4)
        return {"held": F.when(whole, F.sum("r1").over(w))}

    return ordered.rolling_rows(_returns(spark, sf), "user_id", ["day"], -3, 0, 100, made).select("user_id", "day", fn.rounded(F.col("held"), 9).alias("held"))


@query("SELECT a.hour, a.n, a.n >= 2 * b.n AS shock FROM (SELECT t // 3600000000 AS hour, count(*) AS n FROM e GROUP BY 1) a LEFT JOIN (SELECT t // 3600000000 AS hour, count(*) AS n FROM e GROUP BY 1) b ON b.hour = a.hour - 1")
def w22_shock_against_the_hour_before(spark, sf):
    hours = tape(spark, sf).groupBy(fn.bucket(F.col("t"), HOUR).alias("hour")).agg(F.count("*").alias("n"))
    return joins.offset_join(hours, "hour", 1, ["n"]).select("hour", "n", (F.col("n") >= 2 * F.col("prior_n")).alias("shock"))


@query("SELECT event_id, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id) AS paid FROM e")
def w24_prefix_sums(spark, sf):
    return ordered.running(tape(spark, sf), "user_id", ["t", "event_id"], DAY, sums={"paid": F.col("c")}).select("event_id", "paid")


@query("""SELECT p.event_id, coalesce(min(v.t) FILTER (v.k >= 80 OR v.k <= 15), p.t + 43200000000) AS leaves, CASE arg_min(CASE WHEN v.k >= 80 THEN 1 ELSE -1 END, (v.t, v.event_id)) FILTER (v.k >= 80 OR v.k <= 15) WHEN 1 THEN 'target' WHEN -1 THEN 'stop' ELSE 'deadline' END AS by
 FROM e p LEFT JOIN e v ON v.event_type = 'view' AND v.user_id = p.user_id AND v.t > p.t AND v.t <= p.t + 43200000000 WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.t""")
def w25_first_crossing(spark, sf):
    """The first row after an entry at or beyond either bound, else the deadline; entries and rows meet in buckets of the deadline."""
    e, bound = tape(spark, sf), 12 * HOUR
    entries = kind(e, "purchase").select("event_id", "user_id", F.col("t").alias("t0"), F.explode(F.array(fn.bucket(F.col("t"), bound), fn.bucket(F.col("t"), bound) + 1)).alias("b"))
    crossed = kind(e, "view").where("k >= 80 or k <= 15").select("user_id", F.col("event_id").alias("of"), "t", (F.col("k") >= 80).alias("up"), fn.bucket(F.col("t"), bound).alias("b"))
    met = entries.join(crossed, ["user_id", "b"], "left")
    near = (F.col("t") > F.col("t0")) & (F.col("t") <= F.col("t0") + bound)
    first = met.groupBy("event_id", "t0").agg(F.min(F.when(near, F.struct("t", "of", "up"))).alias("f"))
    return first.select("event_id", F.coalesce("f.t", F.col("t0") + bound).alias("leaves"), F.when(F.col("f.up"), "target").when(~F.col("f.up"), "stop").otherwise("deadline").alias("by"))


@query("SELECT a.event_id, round(b.c::DOUBLE / a.c - 1, 9) AS forward FROM e a LEFT JOIN LATERAL (SELECT c FROM e v WHERE v.event_type = 'view' AND v.user_id = a.user_id AND v.t >= a.t + 3600000000 AND v.t <= a.t + 3600000000 + 86400000000 ORDER BY v.t, v.c LIMIT 1) b ON true WHERE a.event_type = 'view' AND a.c > 0")
def w26_m23_forward_returns(spark, sf):
    """Return to the first price an hour or more later, within a day."""
    views = kind(tape(spark, sf), "view").where("c > 0")
    asks = views.select("event_id", "user_id", (F.col("t") + HOUR).alias("t"), F.col("c").alias("c0"))
    allv = kind(tape(spark, sf), "view")
    found = joins.asof_forward(asks, allv, "user_id", "t", DAY, "c")
    return found.select("event_id", fn.rounded(F.col("c") / F.col("c0") - 1, 9).alias("forward"))


@query("""SELECT user_id, hole_from, t AS hole_to FROM (SELECT user_id, t, max(t + k * 600000000) OVER (PARTITION BY user_id ORDER BY t, t + k * 600000000 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hole_from FROM e) WHERE t > hole_from""")
def w29_x56_holes_between_spans(spark, sf):
    spans = tape(spark, sf).select("user_id", F.col("t").alias("start"), (F.col("t") + F.col("k") * 10 * MINUTE).alias("stop"))
    return panels.span_holes(spans, "user_id", DAY)


@query("WITH m AS (SELECT DISTINCT o_custkey AS key, year(o_orderdate) * 12 + month(o_orderdate) AS i FROM orders) SELECT key, min(i) AS first, max(i) AS last, count(*) AS n FROM (SELECT key, i, i - row_number() OVER (PARTITION BY key ORDER BY i) AS g FROM m) GROUP BY key, g")
def w30_month_runs(spark, sf):
    months = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("i"))
    return panels.consecutive_runs(months, "key", "i")


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS place FROM e) WHERE place <= 5")
def w35_last_prints(spark, sf):
    return panels.latest_per_key(tape(spark, sf), "user_id", ["t", "event_id"], 5).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("SELECT user_id, side, level, price FROM (SELECT user_id, CASE WHEN c % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, c AS price, row_number() OVER (PARTITION BY user_id, c % 2 ORDER BY CASE WHEN c % 2 = 0 THEN -c ELSE c END, k) AS level FROM e WHERE k > 0) WHERE level <= 3")
def o6_o8_best_levels(spark, sf):
    e = tape(spark, sf).withColumn("side", F.when(F.col("c") % 2 == 0, "bid").otherwise("ask"))
    return panels.best_levels(e, "user_id", "side", "c", "k", 3).select("user_id", "side", F.col("level").cast("long").alias("level"), F.col("c").alias("price"))


@query("SELECT event_type, user_id AS config, round(m, 6) AS mean FROM (SELECT event_type, user_id, avg(c) AS m, row_number() OVER (PARTITION BY event_type ORDER BY avg(c) DESC, user_id) AS r FROM e GROUP BY 1, 2) WHERE r = 1")
def o4_x9_m24_best_config(spark, sf):
    """The configuration with the best mean, the first of equals; combined before the shuffle."""
    means = tape(spark, sf).groupBy("event_type", F.col("user_id").alias("config")).agg(F.avg("c").alias("m"))
    best = means.groupBy("event_type").agg(F.max_by(F.struct("config", "m"), F.struct("m", -F.col("config"))).alias("b"))
    return best.select("event_type", "b.config", F.round("b.m", 6).alias("mean"))


@query("SELECT user_id, n, place FROM (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS place FROM e GROUP BY 1) WHERE place <= 10")
def o5_o7_leaderboard(spark, sf):
    """The ten lanes with most rows; ranks without a task that sees all lanes."""
    lanes = tape(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return ranks.ranked(lanes, [], [-F.col("n"), F.col("user_id")], "place").where("place <= 10").select("user_id", "n", F.col("place").cast("long").alias("place"))


@query("SELECT user_id, t AS hole_from, nt AS hole_to FROM (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nt FROM e) WHERE nt - t > 43200000000 ORDER BY nt - t DESC, user_id LIMIT 20")
def o3_hole_samples(spark, sf):
    held = ordered.holes(tape(spark, sf), "user_id", "t", 12 * HOUR)
    return held.orderBy((F.col("hole_to") - F.col("hole_from")).desc(), "user_id").limit(20)
