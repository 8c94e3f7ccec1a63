"""Queries by name and their SQL. The events table stands for the tape: users are lanes, values are prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.scalars import bucket, canonical_decimal, first_positive, mid_price, redact, side
from tapeloom.operators import aggregates as agg, joins, ordered, ranks
from tapeloom.plans.registry import DAY, EVENTS, HOUR, MINUTE, kind as _kind, query, tape
from tapeloom.sources import read_table

_E = f"WITH {EVENTS}"

@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS sum_price, count(*) AS n FROM lineitem GROUP BY ALL")
def a10_group_totals(spark, sf):
    li = read_table(spark, sf, "lineitem")
    price = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), price.alias("sum_price"), F.count("*").alias("n"))


flagship = a10_group_totals


@query("SELECT event_id, event_type, k FROM e WHERE k >= 50 AND event_type IN ('view', 'click')")
def v2_payload_fields(spark, sf):
    return tape(spark, sf).where("k >= 50 and event_type in ('view', 'click')").select("event_id", "event_type", "k")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'")
def j1_marker_to_source(spark, sf):
    """Equi-join of detail rows to their source, constants pushed to both scans."""
    marks = read_table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    return marks.join(read_table(spark, sf, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j3_left_outer_counts(spark, sf):
    o = read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return read_table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_type, (t // 3600000000) AS bucket, count(*) AS n, sum(c) AS cents FROM e GROUP BY 1, 2")
def p2_bucket_totals(spark, sf):
    return tape(spark, sf).groupBy("event_type", bucket(F.col("t"), HOUR).alias("bucket")).agg(F.count("*").alias("n"), F.sum("c").alias("cents"))


@query("SELECT event_id, CASE WHEN value > 20 THEN 1 WHEN value < -20 THEN -1 ELSE 0 END AS side, CASE WHEN k > 0 THEN k WHEN c > 0 THEN c END AS first_up FROM e")
def p6_p14_scalars(spark, sf):
    return tape(spark, sf).select("event_id", side(F.col("value"), 20).cast("int").alias("side"), first_positive(F.col("k"), F.col("c")).alias("first_up"))


@query("SELECT event_id, k || '.5' AS mid, rtrim(rtrim(CAST(CAST(c AS DECIMAL(18,4)) / 100 AS DECIMAL(18,4))::VARCHAR, '0'), '.') AS shown, sha256(props) AS digest, regexp_replace('token=' || k || ' x', '(?i)(token|secret|password|apikey)=\\S+', '\\1=***') AS clean FROM e WHERE k > 0")
def f_scalar_functions(spark, sf):
    e = tape(spark, sf).where("k > 0")
    mid = mid_price(F.col("k").cast("string"), (F.col("k") + 1).cast("string"))
    return e.select("event_id", canonical_decimal(mid).alias("mid"), canonical_decimal(F.col("c").cast("decimal(18,4)") / 100).alias("shown"), F.sha2("props", 256).alias("digest"), redact(F.concat(F.lit("token="), "k", F.lit(" x"))).alias("clean"))


@query("""SELECT a.event_type, a.bucket, a.cents, b.cents AS prior_cents FROM (SELECT event_type, t // 3600000000 AS bucket, sum(c) AS cents FROM e GROUP BY 1, 2) a
 LEFT JOIN (SELECT event_type, t // 3600000000 AS bucket, sum(c) AS cents FROM e GROUP BY 1, 2) b ON a.event_type = b.event_type AND a.bucket = b.bucket + 1""")
def j8_offset_join(spark, sf):
    return joins.offset_join(p2_bucket_totals(spark, sf).drop("n"), "bucket", 1, ["cents"], ["event_type"])


@query("""SELECT p.event_id, max(v.t) AS c_time, arg_max(v.c, (v.t, v.c)) AS c FROM e p LEFT JOIN e v ON v.event_type = 'view' AND v.user_id = p.user_id AND v.t <= p.t AND p.t - v.t <= 7200000000
 WHERE p.event_type = 'purchase' GROUP BY 1""")
def j10_asof_backward(spark, sf):
    e = tape(spark, sf)
    found = joins.asof_backward(_kind(e, "purchase").select("event_id", "user_id", "t"), _kind(e, "view"), "user_id", "t", 2 * HOUR, "c")
    return found.select("event_id", "c_time", "c")


@query("""SELECT p.event_id, min(v.t) AS c_time, arg_min(v.c, (v.t, v.c)) AS c FROM e p LEFT JOIN e v ON v.event_type = 'click' AND v.user_id = p.user_id AND v.t >= p.t AND v.t - p.t <= 3600000000
 WHERE p.event_type = 'view' GROUP BY 1""")
def j11_asof_forward(spark, sf):
    e = tape(spark, sf)
    found = joins.asof_forward(_kind(e, "view").select("event_id", "user_id", "t"), _kind(e, "click"), "user_id", "t", HOUR, "c")
    return found.select("event_id", "c_time", "c")


@query("""SELECT s.bucket, x.views, x.clicks FROM (SELECT unnest(range(min(t) // 600000000, max(t) // 600000000 + 1)) AS bucket FROM e) s
 LEFT JOIN (SELECT t // 600000000 AS bucket, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks FROM e GROUP BY 1) x USING (bucket)""")
def j7_dense_grid(spark, sf):
    return joins.dense_grid(tape(spark, sf), "t", 10 * MINUTE, views=F.count_if(F.col("event_type") == "view"), clicks=F.count_if(F.col("event_type") == "click"))


@query("SELECT event_id FROM e p WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM e x WHERE x.event_type = 'error' AND x.user_id = p.user_id AND x.t BETWEEN p.t AND p.t + 14400000000)")
def j12_followed_within(spark, sf):
    e = tape(spark, sf)
    return joins.followed_within(_kind(e, "purchase").select("event_id", "user_id", "t"), _kind(e, "error"), "user_id", "t", 4 * HOUR).select("event_id")


@query("""SELECT s.close, x.c FROM (SELECT DISTINCT CAST(ceil(t / 28800000000) AS BIGINT) * 28800000000 AS close FROM e WHERE event_type = 'view') s
 LEFT JOIN (SELECT CAST(ceil(t / 28800000000) AS BIGINT) * 28800000000 AS close, sum(c) AS c FROM e WHERE event_type = 'signup' GROUP BY 1) x USING (close)""")
def j13_sum_between_closes(spark, sf):
    e = tape(spark, sf)
    closes = _kind(e, "view").select((F.ceil(F.col("t") / (8 * HOUR)) * 8 * HOUR).cast("long").alias("close")).distinct()
    return joins.sum_between_closes(closes, _kind(e, "signup"), "t", "c", 8 * HOUR)


_SPANS = """, g AS (SELECT user_id, event_type, t, CASE WHEN t - lag(t) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY t) AS island FROM g), s AS (SELECT user_id, event_type, min(t) AS start, max(t) AS stop FROM i GROUP BY user_id, event_type, island)"""


@query("""SELECT a.user_id, greatest(a.t, b.t) AS start, least(a.t + a.k * 600000000, b.t + b.k * 600000000) AS stop FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click'
 WHERE greatest(a.t, b.t) < least(a.t + a.k * 600000000, b.t + b.k * 600000000)""")
def j18_intersect_spans(spark, sf):
    spans = tape(spark, sf).select("user_id", "event_type", F.col("t").alias("start"), (F.col("t") + F.col("k") * 10 * MINUTE).alias("stop"))
    return joins.intersect_spans(_kind(spans, "view"), _kind(spans, "click"), "user_id", 8 * HOUR)


@query("SELECT bucket FROM (SELECT unnest(range(min(t) // 60000000, max(t) // 60000000 + 1)) AS bucket FROM e) EXCEPT SELECT t // 60000000 FROM e")
def j22_missing_slots(spark, sf):
    return joins.missing_slots(tape(spark, sf), "t", MINUTE)


@query("SELECT coalesce(a.c_nationkey, b.s_nationkey) AS nation, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) b ON a.c_nationkey = b.s_nationkey WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def j23_multiset_difference(spark, sf):
    """Rows of two relations that do not occur equally often, with both counts."""
    a, b = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return agg.multiset_difference(a, b)


@query("SELECT count(*) AS n, count(*) FILTER (value <= 0) AS not_positive, count(*) FILTER (k IS NULL) AS no_k, count(*) FILTER (event_type = 'error') AS errors, min(t) AS first_t, max(t) AS last_t FROM e")
def a1_conditional_counts(spark, sf):
    return tape(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("value") <= 0).alias("not_positive"), F.count_if(F.col("k").isNull()).alias("no_k"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("SELECT user_id, t // 3600000000 AS hour, count(*) AS n, min(c) AS low, max(c) AS high FROM e GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT c) > 1")
def a6_conflicts(spark, sf):
    return agg.conflicts(tape(spark, sf).withColumn("hour", bucket(F.col("t"), HOUR)), ["user_id", "hour"], "c")


@query("""SELECT event_type, t // 86400000000 AS day, arg_min(c, t) AS open, max(c) AS high, min(c) AS low, arg_max(c, t) AS close, sum(k) AS volume, count(*) AS n FROM e GROUP BY 1, 2""")
def a15_bars(spark, sf):
    return agg.bars(tape(spark, sf), ["event_type", bucket(F.col("t"), 24 * HOUR).alias("day")], ["t"], "c", "k")


@query("SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN c ELSE -c END) AS signed, sum(c) AS total, count(*) AS n FROM e GROUP BY 1")
def a16_signed_flow(spark, sf):
    return agg.signed_flow(tape(spark, sf), ["user_id"], "c", F.col("event_type") == "purchase")


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(errors, 0) AS errors, coalesce(signups, 0) AS signups FROM (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS signups FROM events WHERE event_type = 'signup' GROUP BY 1) b ON a.user_id = b.user_id")
def a17_full_outer_counts(spark, sf):
    both = read_table(spark, sf, "events").where("event_type in ('error', 'signup')")
    return both.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "signup").alias("signups"))


@query("SELECT event_type, round(sum((c - m) ** 3) / count(*) / (sum((c - m) ** 2) / count(*)) ** 1.5, 6) AS skew, round(sum((c - m) ** 4) / count(*) / (sum((c - m) ** 2) / count(*)) ** 2, 6) AS kurt FROM (SELECT event_type, c, avg(c) OVER (PARTITION BY event_type) AS m FROM e) GROUP BY 1")
def a29_moments(spark, sf):
    return tape(spark, sf).groupBy("event_type").agg(F.round(F.skewness("c"), 6).alias("skew"), F.round(F.kurtosis("c") + 3, 6).alias("kurt"))


@query("SELECT user_id, t // 86400000000 AS day, arg_max(event_type, (t, event_id)) AS event_type, arg_max(c, (t, event_id)) AS c, count(*) AS n FROM e GROUP BY 1, 2")
def w1_last_per_bucket(spark, sf):
    return ordered.last_per_bucket(tape(spark, sf).withColumn("day", bucket(F.col("t"), 24 * HOUR)), ["user_id", "day"], ["t", "event_id"], ["event_type", "c"])


@query("SELECT event_id, row_number() OVER w AS ordinal, lag(event_type) OVER w AS previous, lag(c) OVER w AS previous_c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def w4_lifecycle(spark, sf):
    found = ordered.with_previous(tape(spark, sf), "user_id", ["t", "event_id"], ["event_type", "c"], 24 * HOUR)
    return found.select("event_id", "ordinal", F.col("previous_event_type").alias("previous"), "previous_c")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN c END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS filled_bid FROM e")
def w5_forward_fill(spark, sf):
    e = tape(spark, sf).withColumn("bid", F.when(F.col("event_type") == "purchase", F.col("c")))
    return ordered.forward_fill(e, "user_id", ["t", "event_id"], ["bid"], 24 * HOUR).select("event_id", "filled_bid")


@query("SELECT user_id, t AS hole_from, nt AS hole_to FROM (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nt FROM e) WHERE nt - t > 43200000000")
def w6_holes(spark, sf):
    return ordered.holes(tape(spark, sf), "user_id", "t", 12 * HOUR)


@query(f"{_E}{_SPANS} SELECT user_id, event_type, start, stop FROM s")
def w13_islands(spark, sf):
    lanes = tape(spark, sf).withColumn("lane", F.struct("user_id", "event_type"))
    return ordered.bursts(lanes, "lane", "t", 6 * HOUR, 24 * HOUR).select("lane.user_id", "lane.event_type", "start", "stop")


@query("""SELECT event_id, CASE WHEN up THEN row_number() OVER (PARTITION BY user_id, grp ORDER BY t, event_id) - CASE WHEN grp = 0 THEN 0 ELSE 1 END ELSE 0 END AS streak
 FROM (SELECT *, c > 1000 AS up, sum(CASE WHEN c > 1000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS grp FROM e)""")
def w14_streaks(spark, sf):
    return ordered.streaks(tape(spark, sf), "user_id", ["t", "event_id"], F.col("c") > 1000, 24 * HOUR).select("event_id", "streak")


_DAYS = "SELECT t // 86400000000 AS day, user_id, sum(c) AS v, count(*) AS n FROM e GROUP BY 1, 2"


def _user_days(spark, sf):
    return tape(spark, sf).groupBy(bucket(F.col("t"), 24 * HOUR).alias("day"), "user_id").agg(F.sum("c").alias("v"), F.count("*").alias("n"))


@query(f"{_E}, d AS ({_DAYS}), r AS (SELECT *, CASE WHEN n >= 2 THEN row_number() OVER (PARTITION BY day, n >= 2 ORDER BY v DESC, user_id) END AS rank FROM d) SELECT *, CASE WHEN rank <= x THEN 1 WHEN rank > m - x THEN -1 ELSE 0 END AS leg FROM (SELECT *, count(rank) OVER (PARTITION BY day) AS m, count(rank) OVER (PARTITION BY day) * 20 // 100 AS x FROM r)".replace("SELECT *, CASE WHEN rank <= x", "SELECT day, user_id, v, n, rank, CASE WHEN rank <= x"))
def w16_w17_rank_and_legs(spark, sf):
    ranked = ranks.cross_section_rank(_user_days(spark, sf), "day", "v", "user_id", F.col("n") >= 2)
    return ranks.legs(ranked, 20).withColumns({"rank": F.col("rank").cast("long")}).drop("ranked")


@query(f"{_E}, d AS ({_DAYS}), q AS (SELECT *, sum(v - 2000) OVER (PARTITION BY user_id ORDER BY day) AS equity FROM d), p AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY user_id ORDER BY day)) AS peak FROM q) SELECT user_id, day, equity, peak, peak - equity AS drawdown FROM p")
def w23_drawdown(spark, sf):
    gains = _user_days(spark, sf).withColumn("g", F.col("v") - 2000)
    return ordered.equity_drawdown(gains, "user_id", ["day"], "g", 7).select("user_id", "day", "equity", "peak", "drawdown")


@query(f"{_E}, d AS ({_DAYS}) SELECT user_id, day, CASE WHEN count(n) OVER w = 5 AND 5 * sum(n * n) OVER w > (sum(n) OVER w) ** 2 THEN CAST(5 * sum(v * n) OVER w - sum(v) OVER w * sum(n) OVER w AS DOUBLE) / CAST(5 * sum(n * n) OVER w - sum(n) OVER w * sum(n) OVER w AS DOUBLE) END AS beta, round(v - avg(v) OVER w - beta * (n - avg(n) OVER w), 6) + 0.0 AS residual FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS 4 PRECEDING)")
def w21_rolling_beta(spark, sf):
    return ordered.rolling_beta(_user_days(spark, sf), "user_id", ["day"], "v", "n", 5, 100).select("user_id", "day", "beta", (F.round("residual", 6) + 0.0).alias("residual"))


@query("SELECT event_id, sum(c) OVER (PARTITION BY user_id ORDER BY t RANGE 21599999999 PRECEDING) AS trailing FROM e")
def t14_trailing_sum(spark, sf):
    return ordered.trailing_sum(tape(spark, sf), "user_id", "t", "c", 6 * HOUR).select("event_id", "trailing")


@query("""SELECT user_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, stop) AS island FROM (SELECT user_id, t AS start, t + k * 600000000 AS stop,
 CASE WHEN t > max(t + k * 600000000) OVER (PARTITION BY user_id ORDER BY t, t + k * 600000000 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS fresh FROM e)) GROUP BY user_id, island""".replace("CASE WHEN t >", "CASE WHEN (t >").replace("1 PRECEDING) IS NOT", "1 PRECEDING)) IS NOT"))
def w28_merge_spans(spark, sf):
    spans = tape(spark, sf).select("user_id", F.col("t").alias("start"), (F.col("t") + F.col("k") * 10 * MINUTE).alias("stop"))
    return ordered.merge_spans(spans, "user_id", 24 * HOUR)


@query("SELECT event_id, CASE WHEN lk IS NULL THEN 'snapshot' WHEN event_type = 'error' AND k < lk THEN 'maintenance_reset' WHEN k = lk THEN 'no_update' WHEN k - 1 = lk THEN 'update' ELSE 'gap' END AS state FROM (SELECT event_id, event_type, k, lag(k) OVER (PARTITION BY user_id ORDER BY t, event_id) AS lk FROM e)")
def t5_chain_state(spark, sf):
    e = tape(spark, sf).withColumns({"before": F.col("k") - 1, "reset": F.col("event_type") == "error"})
    return ordered.chain_state(e, "user_id", ["t", "event_id"], "before", "k", DAY, "reset").select("event_id", "state")


@query("SELECT event_type, round(avg(c), 6) AS mean, count(*) AS n, round(stddev_samp(c), 6) AS sd, round(avg(CASE WHEN c > 1000 THEN 1.0 ELSE 0.0 END), 6) AS wins, round((avg(c) - 1000) / stddev_samp(c), 6) AS ratio, round(sum(greatest(c - 1000, 0)) / sum(greatest(1000 - c, 0)), 6) AS factor FROM e GROUP BY 1")
def a20_gain_block(spark, sf):
    e = tape(spark, sf).withColumn("g", F.col("c") - 1000)
    return agg.gain_block(e, ["event_type"], "g").select("event_type", F.round(F.col("mean") + 1000, 6).alias("mean"), "n", *[F.round(c, 6).alias(c) for c in ("sd", "wins", "ratio", "factor")])


@query("SELECT event_id, stress, round(value - 2 * 10 / 10000 * stress, 8) AS net FROM events, (VALUES (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) s(stress)")
def m2_stressed_costs(spark, sf):
    return agg.stressed(read_table(spark, sf, "events"), "value", 10.0).select("event_id", "stress", F.round("net", 8).alias("net"))


@query("""WITH f AS (SELECT c_nationkey AS test, (count(*) % 97 + 1) / 1000.0::DOUBLE AS p FROM customer GROUP BY 1), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, test) AS r FROM f)
 SELECT test, round(least(1, p * m), 9) AS bonferroni, round(least(1, max(p * (m - r + 1)) OVER (ORDER BY r)), 9) AS holm, round(least(1, min(p * m / r) OVER (ORDER BY r DESC)), 9) AS bh FROM r""")
def m8_adjusted_p(spark, sf):
    tests = read_table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("test")).agg(((F.count("*") % 97 + 1) / F.lit(1000.0)).alias("p"))
    return ranks.adjusted_p(tests, "p", "test").select("test", *[F.round(c, 9).alias(c) for c in ("bonferroni", "holm", "bh")])


@query(f"""{_E}, d AS (SELECT event_type, t // 86400000000 AS day, sum(c) AS v FROM e GROUP BY 1, 2), m AS (SELECT event_type, avg(v) AS mean, count(v) AS n FROM d GROUP BY 1), x AS (SELECT event_type, day, v - mean AS z FROM d JOIN m USING (event_type))
 SELECT event_type, n, round(mean, 4) AS mean, round(sqrt(greatest(0, s)) / n, 4) AS error FROM m JOIN (SELECT a.event_type, sum(a.z * b.z * CASE WHEN a.day = b.day THEN 1.0 ELSE 2 * (1 - (a.day - b.day) / 4.0) END) AS s FROM x a JOIN x b ON a.event_type = b.event_type AND a.day - b.day BETWEEN 0 AND 3 GROUP BY 1) USING (event_type)""")
def m6_hac_mean(spark, sf):
    days = tape(spark, sf).groupBy("event_type", bucket(F.col("t"), 24 * HOUR).alias("day")).agg(F.sum("c").alias("v"))
    return agg.hac_mean(days, ["event_type"], "day", "v", 3).select("event_type", "n", F.round("mean", 4).alias("mean"), F.round("error", 4).alias("error"))


@query("SELECT event_id, user_id, t FROM e ORDER BY t, event_id LIMIT 50")
def o2_ordered_limit(spark, sf):
    return tape(spark, sf).orderBy("t", "event_id").limit(50).select("event_id", "user_id", "t")


@query("SELECT hour, count(*) AS sides FROM (SELECT DISTINCT t // 3600000000 AS hour, event_type FROM e WHERE event_type IN ('error', 'signup')) GROUP BY 1 HAVING max(event_type) = 'error' UNION ALL SELECT DISTINCT t // 3600000000, 0 FROM e WHERE event_type IN ('error', 'signup')")
def u5_set_difference(spark, sf):
    """Hours with errors and no signups, then the union of both sets of hours."""
    hours = lambda name: _kind(tape(spark, sf), name).select(bucket(F.col("t"), HOUR).alias("hour"))
    alone = hours("error").subtract(hours("signup")).withColumn("sides", F.lit(1).cast("long"))
    return alone.unionByName(hours("error").union(hours("signup")).distinct().withColumn("sides", F.lit(0).cast("long")))
