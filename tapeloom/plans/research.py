"""Queries of statistics, schedules, books and panels over the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import scalars as fn
from tapeloom.operators import aggregates as agg, books, joins, ordered, panels, schedules, statistics as st
from tapeloom.plans.registry import DAY, HOUR, MINUTE, kind, query, tape

# statistics

_DAILY = "d AS (SELECT user_id % 4 AS config, t // 86400000000 - 19723 AS day, sum(c - 1010) / 100000.0 AS r, count(*) AS n FROM e GROUP BY 1, 2)"


def _daily(spark, sf):
    return tape(spark, sf).groupBy((F.col("user_id") % 4).alias("config"), (fn.bucket(F.col("t"), DAY) - 19723).alias("day")).agg((F.sum(F.col("c") - 1010) / 100000.0).alias("r"), F.count("*").alias("n"))


@query(f"WITH {_DAILY}, f AS (SELECT i AS fold, 0 AS train_from, i * 4 + 8 AS train_to, i * 4 + 8 AS test_from, i * 4 + 12 AS test_to FROM range(3) r(i)) SELECT fold, config, train_to, count(*) AS n, round(sum(r), 8) AS total FROM d JOIN f ON day >= test_from AND day < test_to GROUP BY ALL")
def m1_m17_walk_forward(spark, sf):
    """Thirty days: eight to learn from at first, four to test, ten kept back and in no fold."""
    folds = st.walk_forward(spark, 30, 8, 4, 10)
    return st.in_folds(_daily(spark, sf), folds, "day").groupBy("fold", "config", "train_to").agg(F.count("*").alias("n"), F.round(F.sum("r"), 8).alias("total"))


@query("SELECT event_id, round(value - 0.2 * 1.5 - k / 100.0 * 1.5 + c / 10000.0 / 1.5, 8) AS net, round(CASE WHEN k > 0 THEN least(2.0, 40.0 / k) END, 8) AS weight FROM e")
def m3_m4_x7_net_gains_and_weights(spark, sf):
    net = st.net_gain(F.col("value"), F.lit(0.2), 1.5, F.col("k") / 100.0, F.col("c") / 10000.0)
    return tape(spark, sf).select("event_id", F.round(net, 8).alias("net"), F.round(st.position_weight(F.col("k"), 40.0, 2.0), 8).alias("weight"))


@query("""SELECT p.event_id, coalesce(sum(s.c) FILTER (s.k >= 50), 0) AS paid, coalesce(sum(s.c) FILTER (s.k < 50), 0) AS received FROM e p LEFT JOIN e s ON s.event_type = 'signup' AND s.user_id = p.user_id AND s.t > p.t AND s.t <= p.t + 172800000000 WHERE p.event_type = 'purchase' GROUP BY 1""")
def m5_x15_held_funding(spark, sf):
    """Funding paid and received while a position is held: running sums at both ends, taken as of them."""
    e, hold = tape(spark, sf), 48 * HOUR
    sums = ordered.running(kind(e, "signup"), "user_id", ["t", "event_id"], DAY, sums={"up": F.when(F.col("k") >= 50, F.col("c")).otherwise(0), "down": F.when(F.col("k") < 50, F.col("c")).otherwise(0)})
    sums = sums.groupBy("user_id", "t").agg(F.max("up").alias("up"), F.max("down").alias("down")).withColumn("both", F.struct("up", "down"))
    entries = kind(e, "purchase").select("event_id", "user_id", "t")
    at = lambda df, name: joins.asof_backward(df, sums, "user_id", "t", 40 * DAY, "both").select("event_id", F.col("both.up").alias(f"{name}_up"), F.col("both.down").alias(f"{name}_down"))
    ends = at(entries.withColumn("t", F.col("t") + hold), "to")
    both = at(entries, "from").join(ends, "event_id")
    less = lambda n: (F.coalesce(f"to_{n}", F.lit(0)) - F.coalesce(f"from_{n}", F.lit(0)))
    return both.select("event_id", less("up").alias("paid"), less("down").alias("received"))


@query(f"""WITH {_DAILY}, m AS (SELECT config, avg(r) AS mean, count(r) AS n, CAST(floor(4 * pow(count(r) / 100.0, 2.0 / 9)) AS INT) AS lags FROM d GROUP BY 1), x AS (SELECT config, day, lags, r - mean AS z FROM d JOIN m USING (config))
 SELECT config, n, lags, round(mean, 8) AS mean, round(sqrt(greatest(0, s)) / n, 8) AS error, round(mean / (sqrt(greatest(0, s)) / n), 5) AS t FROM m JOIN (SELECT a.config, sum(a.z * b.z * CASE WHEN a.day = b.day THEN 1.0 ELSE 2 * (1 - (a.day - b.day) / (a.lags + 1.0)) END) AS s FROM x a JOIN x b ON a.config = b.config AND a.day - b.day BETWEEN 0 AND a.lags GROUP BY 1) USING (config)""")
def m6_hac_test(spark, sf):
    out = st.hac_test(_daily(spark, sf), ["config"], "day", "r")
    return out.select("config", "n", "lags", F.round("mean", 8).alias("mean"), F.round("error", 8).alias("error"), F.round("t", 5).alias("t"))


@query("SELECT k, round(0.5 - atan(k / 20.0) / pi(), 9) AS one, round(0.5 - k / 20.0 / (2 * sqrt(2 + pow(k / 20.0, 2))), 9) AS two, round(greatest(0.5 - atan(k / 20.0) / pi(), 0.5 - k / 20.0 / (2 * sqrt(2 + pow(k / 20.0, 2)))), 9) AS most FROM (SELECT DISTINCT k FROM e)")
def m7_m15_student_tails(spark, sf):
    """Upper tails of Student's t with one and two degrees of freedom, which have closed forms, and the larger of both."""
    t = F.col("k") / 20.0
    ks = tape(spark, sf).select("k").distinct().select("k", st.upper_tail(t, F.lit(1)).alias("a"), st.upper_tail(t, F.lit(2)).alias("b"))
    return ks.select("k", F.round("a", 9).alias("one"), F.round("b", 9).alias("two"), F.round(F.greatest("a", "b"), 9).alias("most"))


@query(f"""WITH {_DAILY}, m AS (SELECT config, avg(r) AS a, count(*) AS n, stddev_samp(r) AS sd, stddev_pop(r) AS sp FROM d GROUP BY 1), s AS (SELECT config, any_value(m.n) AS n, any_value(a / sd) AS ratio, avg(pow((r - a) / sp, 3)) AS skew, avg(pow((r - a) / sp, 4)) AS kurt FROM d JOIN m USING (config) GROUP BY 1),
 z AS (SELECT config, (ratio - 0.05) * sqrt(n - 1) / sqrt(1 - skew * ratio + (kurt - 1) / 4 * ratio * ratio) AS z FROM s)
 SELECT config, round(z, 6) AS z, round(0.5 + sum(exp(-pow(z * (i + 0.5) / 2000, 2) / 2)) * z / 2000 / sqrt(2 * pi()), 6) AS p FROM z, range(2000) r(i) GROUP BY config, z""")
def m9_x12_probabilistic_ratios(spark, sf):
    s = st.sharpe_block(_daily(spark, sf), ["config"], "r")
    s = s.withColumn("z", st.sharpe_score(F.col("ratio"), F.lit(0.05), F.col("n"), F.col("skew"), F.col("kurt"))).withColumn("p", st.normal_cdf(F.col("z")))
    return s.select("config", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query(f"""WITH {_DAILY}, b AS (SELECT config, day // 5 AS block, sum(r) AS g FROM d WHERE day < 30 GROUP BY 1, 2), s AS (SELECT i FROM range(64) r(i) WHERE bit_count(i) = 3),
 x AS (SELECT i, config, sum(CASE WHEN (i >> block) & 1 = 1 THEN g ELSE 0 END) AS ins, sum(CASE WHEN (i >> block) & 1 = 1 THEN 0 ELSE g END) AS outs FROM s, b GROUP BY 1, 2),
 r AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY outs) + (count(*) OVER (PARTITION BY i, outs) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY i) AS m FROM x),
 y AS (SELECT i, arg_max(config, (ins, -config)) AS config, arg_max(rank, (ins, -config)) AS rank, any_value(m) AS m FROM r GROUP BY 1)
 SELECT config, count(*) AS n, round(avg(rank), 6) AS rank, count(*) FILTER (ln(rank / (m + 1) / (1 - rank / (m + 1))) <= 0) AS overfit FROM y GROUP BY 1""")
def m10_m11_x10_overfit_splits(spark, sf):
    """All choices of three of six blocks: how often the best inside is in the lower half outside."""
    stats = _daily(spark, sf).where("day < 30").groupBy("config", fn.bucket(F.col("day"), 5).cast("int").alias("block")).agg(F.sum("r").alias("g"))
    found = st.overfit_splits(stats, st.split_table(spark, 6), "config", "g")
    return found.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("rank"), F.count_if(F.col("logit") <= 0).alias("overfit"))


@query(f"""WITH {_DAILY}, s AS (SELECT day, avg(r) AS v FROM d WHERE day < 30 GROUP BY 1), x AS (SELECT i, avg(v) AS m FROM (SELECT i, ((i * 7 + b * 13) % 30 + j) % 30 AS day FROM range(200) a(i), range(6) c(b), range(5) g(j)) JOIN s USING (day) GROUP BY 1)
 SELECT round(list_sort(list(m))[5], 9) AS low, round(list_sort(list(m))[195], 9) AS high FROM x""")
def m12_m13_a22_block_bootstrap(spark, sf):
    """200 circular blocks of five days with given starts; their fifth smallest and largest means."""
    series = _daily(spark, sf).where("day < 30").groupBy("day").agg(F.avg("r").alias("v"))
    means = st.circular_blocks(series, "day", "v", 30, 5, 200, F.col("draw") * 7 + F.col("b") * 13)
    return st.order_statistics(means, 5, 195).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("""WITH d AS (SELECT event_type, t // 86400000000 - 19723 AS day, sum(c - 1000) AS s, count(c) AS n FROM e GROUP BY 1, 2), x AS (SELECT b, (b * 7 + j * 13 + (b * j) % 11) % 31 AS day FROM range(50) r(b), range(31) q(j)),
 m AS (SELECT event_type, b, sum(s)::DOUBLE / sum(n) AS mean FROM x JOIN d USING (day) GROUP BY 1, 2), o AS (SELECT event_type, list_sort(list(mean)) AS m, avg((mean <= 0)::INT) AS below FROM m GROUP BY 1)
 SELECT event_type, events, round(mean, 6) AS mean, round(m[3], 6) AS low, round(m[48], 6) AS high, round(below, 6) AS below FROM o JOIN (SELECT event_type, sum(n)::BIGINT AS events, sum(s)::DOUBLE / sum(n) AS mean FROM d WHERE day BETWEEN 0 AND 30 GROUP BY 1) USING (event_type)""")
def m13_shared_resamples(spark, sf):
    """All kinds of events over the same 50 draws of days: bounds of their means, and the share of draws that are not above zero."""
    e = tape(spark, sf).withColumns({"day": (fn.bucket(F.col("t"), DAY) - 19723).cast("int"), "g": F.col("c") - 1000})
    drawn = st.shared_resamples(e, ["event_type"], "day", "g", 31, 50, lambda b, j: (b * 7 + j * 13 + (b * j) % 11) % 31)
    out = st.resample_bounds(drawn, 3, 48)
    return out.select("event_type", "events", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "below")])


def _inverse_normal(p: str) -> str:
    """The quantile of the standard normal distribution at ``p`` >= 0.5 as SQL, by a rational approximation (relative error 1.2e-9)."""
    # Coefficients of the approximation.
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
    r, q = f"(({p} - 0.5) * ({p} - 0.5))", f"sqrt(-2 * ln(1 - {p}))"
    return f"(CASE WHEN {p} <= 0.97575 THEN {_horner(a, r)} * ({p} - 0.5) / {_horner(b, r)} ELSE -{_horner(c, q)} / {_horner(d, q)} END)"


def _horner(cs: tuple, x: str) -> str:
    out = f"CAST({cs[0]!r} AS DOUBLE)"
    for c in cs[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


_BEST = f"sqrt(v) * ((1 - 0.5772156649015329::DOUBLE) * {_inverse_normal('(1 - 1.0::DOUBLE / m)')} + 0.5772156649015329::DOUBLE * {_inverse_normal('(1 - 1.0::DOUBLE / (m * exp(1.0)))')})"


@query(f"""WITH g AS (SELECT user_id, count(*) AS n, avg(c - 1000) AS mean, stddev_samp(c) AS sd FROM e GROUP BY 1), r AS (SELECT user_id, n, g.mean / sd AS ratio FROM g WHERE sd > 0),
 k AS (SELECT user_id, avg((c - 1000 - mean) ** 3) / avg((c - 1000 - mean) ** 2) ** 1.5 AS skew, avg((c - 1000 - mean) ** 4) / avg((c - 1000 - mean) ** 2) ** 2 AS kurt FROM e JOIN g USING (user_id) GROUP BY 1), a AS (SELECT count(*) AS m, var_samp(ratio) AS v FROM r)
 SELECT user_id, n, round(ratio, 8) AS ratio, round(best, 6) AS benchmark, round((ratio - best) * sqrt(n - 1) / sqrt(1 - skew * ratio + (kurt - 1) / 4 * ratio * ratio), 4) AS score FROM r JOIN k USING (user_id), (SELECT {_BEST} AS best FROM a)""")
def m9_x11_deflated_ratios(spark, sf):
    """Ratios of all lanes against what the best of so many without skill would show; the probability itself is compared in the tests."""
    out = st.deflated_ratios(tape(spark, sf).withColumn("g", F.col("c") - 1000), ["user_id"], "g")
    return out.select("user_id", "n", F.round("ratio", 8).alias("ratio"), F.round("benchmark", 6).alias("benchmark"), F.round("score", 4).alias("score"))


@query("SELECT event_type, round(sum(c)::DOUBLE / count(*), 6) AS by_event, round(avg(m), 6) AS by_day, sum(n)::BIGINT AS events, count(*) AS days FROM (SELECT event_type, t // 86400000000 AS day, sum(c) AS c, avg(c) AS m, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1".replace("sum(c)::DOUBLE / count(*)", "sum(c)::DOUBLE / sum(n)"))
def a22_day_clusters(spark, sf):
    d = st.day_clusters(tape(spark, sf).withColumn("day", fn.bucket(F.col("t"), DAY)), ["event_type"], "day", "c")
    return d.select("event_type", F.round("by_event", 6).alias("by_event"), F.round("by_day", 6).alias("by_day"), "events", "days")


@query("SELECT user_id, CASE WHEN n < 60 THEN 'not_enough_data' WHEN p > 0.5 THEN 'no_edge' WHEN s <= 1000 THEN 'fragile' ELSE 'passes' END AS label, n >= 60 AND s > 1000 AS confirmed FROM (SELECT user_id, count(*) AS n, avg(k) / 100 AS p, avg(c) AS s FROM e GROUP BY 1)")
def m16_m22_x8_labels(spark, sf):
    u = tape(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), (F.avg("k") / 100).alias("p"), F.avg("c").alias("s"))
    return u.select("user_id", st.label(F.col("n"), 60, F.col("p"), 0.5, F.col("s") - 1000).alias("label"), ((F.col("n") >= 60) & (F.col("s") > 1000)).alias("confirmed"))


@query("SELECT event_type, t // 604800000000 AS week, round(arg_max(c, (t, event_id))::DOUBLE / arg_min(c, (t, event_id)) - 1, 8) AS held FROM e WHERE c > 0 GROUP BY 1, 2")
def m18_x46_buy_and_hold(spark, sf):
    rank = F.struct("t", "event_id")
    weeks = tape(spark, sf).where("c > 0").groupBy("event_type", fn.bucket(F.col("t"), 7 * DAY).alias("week")).agg(F.max_by("c", rank).alias("z"), F.min_by("c", rank).alias("a"))
    return weeks.select("event_type", "week", F.round(F.col("z") / F.col("a") - 1, 8).alias("held"))


@query("""WITH h AS (SELECT t // 3600000000 AS hour, avg(c) FILTER (event_type = 'view') AS a, avg(c) FILTER (event_type = 'click') AS b FROM e GROUP BY 1), x AS (SELECT d.lag, f.fee, CASE WHEN p.a > q.a THEN 1 ELSE -1 END * (n.b - p.b) / p.b * 10000 - 4 * f.fee AS r FROM h p JOIN h q ON q.hour = p.hour - 1, (VALUES (1), (2)) d(lag), (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) f(fee), h n WHERE n.hour = p.hour + d.lag AND p.a IS NOT NULL AND q.a IS NOT NULL)
 SELECT lag, fee, count(r) AS n, round(avg(r), 4) AS mean, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS hits FROM x WHERE r IS NOT NULL GROUP BY 1, 2""")
def m21_lead_and_lag(spark, sf):
    """What a move of one lane in an hour earns in another after one and two hours, at two fees."""
    avg = lambda n: F.avg(F.when(F.col("event_type") == n, F.col("c")))
    h = tape(spark, sf).groupBy(fn.bucket(F.col("t"), HOUR).alias("hour")).agg(avg("view").alias("a"), avg("click").alias("b"))
    now = joins.offset_join(h, "hour", 1, ["a"]).where("a is not null and prior_a is not null")
    ahead = h.select("hour", F.col("b").alias("later"), F.explode(F.array(F.lit(1), F.lit(2))).alias("lag")).select((F.col("hour") - F.col("lag")).alias("hour"), "lag", "later")
    made = now.join(ahead, "hour").withColumn("fee", F.explode(F.array(F.lit(1.0), F.lit(2.0))))
    r = F.when(F.col("a") > F.col("prior_a"), 1).otherwise(-1) * (F.col("later") - F.col("b")) / F.col("b") * 10_000 - 4 * F.col("fee")
    out = made.withColumn("r", r).where("r is not null").groupBy("lag", "fee").agg(F.count("r").alias("n"), F.round(F.avg("r"), 4).alias("mean"), F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("hits"))
    return out


# schedules


@query("""WITH RECURSIVE s AS (SELECT user_id, t AS a, t + k * 600000000 AS z, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
 g AS (SELECT user_id, n, z AS free, true AS kept FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.n, CASE WHEN s.a >= g.free THEN s.z ELSE g.free END, s.a >= g.free FROM g JOIN s ON s.user_id = g.user_id AND s.n = g.n + 1)
 SELECT event_id FROM g JOIN s USING (user_id, n) WHERE kept""")
def w31_greedy_selection(spark, sf):
    spans = tape(spark, sf).select("user_id", "event_id", F.col("t").alias("start"), (F.col("t") + F.col("k") * 10 * MINUTE).alias("stop"))
    return schedules.non_overlapping(spans, "user_id", "start", "stop", "event_id", DAY).select("event_id")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, t AS a, t + k * 6000000000 AS z, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
 g AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, false AS kept, []::BIGINT[] AS busy FROM (SELECT DISTINCT user_id FROM s) UNION ALL
 SELECT user_id, n, event_id, len(open) < 10, CASE WHEN len(open) < 10 THEN open || [z] ELSE open END FROM (SELECT s.*, list_filter(g.busy, lambda x: x > s.a) AS open FROM g JOIN s ON s.user_id = g.user_id AND s.n = g.n + 1))
 SELECT event_id FROM g WHERE kept""")
def w32_at_most_ten_open(spark, sf):
    """Spans chosen in order of their start, ten open at a time."""
    spans = tape(spark, sf).select("user_id", "event_id", F.col("t").alias("start"), (F.col("t") + F.col("k") * 100 * MINUTE).alias("stop"))
    return schedules.capped(spans, "user_id", "start", "stop", "event_id", 10).select("event_id")


@query("""WITH RECURSIVE s AS (SELECT user_id, t AS a, t + k * 600000000 AS z, k % 10 <> 0 AS signal, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
 g AS (SELECT user_id, 0::BIGINT AS n, -1::BIGINT AS free, '' AS state FROM (SELECT DISTINCT user_id FROM s) UNION ALL SELECT s.user_id, s.n, CASE WHEN s.signal AND s.z <= 1706400000000000 AND s.a >= g.free THEN s.z ELSE g.free END, CASE WHEN NOT s.signal THEN 'no_signal' WHEN s.z > 1706400000000000 THEN 'boundary' WHEN s.a < g.free THEN 'busy' ELSE 'taken' END FROM g JOIN s ON s.user_id = g.user_id AND s.n = g.n + 1)
 SELECT user_id, count(*) FILTER (state = 'taken') AS taken, count(*) FILTER (state = 'no_signal') AS no_signal, count(*) FILTER (state = 'boundary') AS boundary, count(*) FILTER (state = 'busy') AS busy FROM g WHERE n > 0 GROUP BY 1""")
def w32_w33_episodes(spark, sf):
    spans = tape(spark, sf).select("user_id", "event_id", F.col("t").alias("start"), (F.col("t") + F.col("k") * 10 * MINUTE).alias("stop"), (F.col("k") % 10 != 0).alias("signal"))
    return schedules.episodes(spans, "user_id", "start", "stop", "event_id", "signal", 1_706_400_000_000_000, DAY)


@query("SELECT event_id, coalesce(last_value(CASE WHEN k >= 80 THEN 1 WHEN k < 40 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) AS held FROM e")
def w34_x47_hysteresis(spark, sf):
    return schedules.hysteresis(tape(spark, sf), "user_id", ["t", "event_id"], F.col("k"), 80, 40, DAY).select("event_id", "held")


@query("""WITH RECURSIVE f AS (SELECT user_id, CASE WHEN k % 2 = 0 THEN k ELSE -k END::DOUBLE AS q, c::DOUBLE AS p, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
 g AS (SELECT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS realised FROM (SELECT DISTINCT user_id FROM f) UNION ALL
 SELECT f.user_id, f.n, pos + q, CASE WHEN pos + q = 0 THEN 0.0 WHEN pos * q >= 0 THEN (pos * entry + q * p) / (pos + q) WHEN abs(q) > abs(pos) THEN p ELSE entry END, realised + CASE WHEN pos * q >= 0 THEN 0.0 ELSE least(abs(q), abs(pos)) END * (p - entry) * sign(pos) FROM g JOIN f ON f.user_id = g.user_id AND f.n = g.n + 1)
 SELECT user_id, round(arg_max(pos, n), 6) AS position, round(arg_max(entry, n), 4) AS entry, round(arg_max(realised, n), 2) AS realised, round(arg_max(pos * (1000 - entry), n), 2) AS unrealised FROM g GROUP BY 1""")
def t23_t24_positions(spark, sf):
    fills = tape(spark, sf).withColumn("q", F.when(F.col("k") % 2 == 0, F.col("k")).otherwise(-F.col("k")))
    p = schedules.positions(fills, "user_id", ["t", "event_id"], "q", "c")
    return p.select("user_id", F.round("position", 6).alias("position"), F.round("entry", 4).alias("entry"), F.round("realised", 2).alias("realised"), F.round(F.col("position") * (1000 - F.col("entry")), 2).alias("unrealised"))


# books and sequences

_BOOK = "b AS (SELECT user_id, t, event_id, CASE WHEN c % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, k % 20 AS price, c % 4 AS qty, event_type = 'signup' AS snap FROM e)"


def _book(spark, sf):
    side = F.when(F.col("c") % 2 == 0, "bid").otherwise("ask").alias("side")
    return tape(spark, sf).select("user_id", "t", "event_id", side, (F.col("k") % 20).alias("price"), (F.col("c") % 4).alias("qty"), (F.col("event_type") == "signup").alias("snap"))


@query(f"""WITH {_BOOK}, s AS (SELECT user_id, max((t, event_id)) FILTER (snap) AS f FROM b GROUP BY 1) SELECT user_id, side, price, qty FROM (SELECT user_id, side, price, arg_max(qty, (t, event_id)) AS qty FROM b JOIN s USING (user_id) WHERE f IS NULL OR (t, event_id) >= f GROUP BY 1, 2, 3) WHERE qty > 0""".replace("max((t, event_id)) FILTER (snap) AS f", "max(t * 1000000 + event_id) FILTER (snap) AS f").replace("(t, event_id) >= f", "t * 1000000 + event_id >= f").replace("t * 1000000", "t::HUGEINT * 1000000"))
def t2_t3_t6_t31_open_levels(spark, sf):
    """Levels of each book after its last snapshot; orders by id work alike, with the id as the level."""
    return books.open_levels(_book(spark, sf), "user_id", ["t", "event_id"], "side", ["price"], "qty", F.col("snap"))


@query("SELECT user_id, event_id, CASE WHEN b IS NULL THEN 'start' WHEN k = b + 1 THEN 'next' WHEN k > b + 1 THEN 'gap' WHEN k + 3 <= b THEN 'repeat' ELSE 'overlap' END AS sequence, CASE WHEN k > b + 1 THEN k - b - 1 ELSE 0 END AS missing FROM (SELECT user_id, event_id, k, max(k + 3) OVER (PARTITION BY user_id, t // 86400000000 ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e)")
def t7_t8_t10_t11_sequences(spark, sf):
    """Messages with ranges of numbers: chained, with a gap, repeated or overlapping what came before on the day."""
    e = tape(spark, sf).withColumns({"last": F.col("k") + 3, "lane": F.struct("user_id", fn.bucket(F.col("t"), DAY).alias("day"))})
    return books.sequence_audit(e, "lane", ["t", "event_id"], "k", "last", DAY).select("user_id", "event_id", "sequence", "missing")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (c <= p) AS regressions FROM (SELECT user_id, c, lag(c) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e) GROUP BY 1")
def t4_t19_increasing_ids(spark, sf):
    rows = ordered.with_previous(tape(spark, sf), "user_id", ["t", "event_id"], ["c"], DAY)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("c") <= F.col("previous_c")).alias("regressions"))


@query("SELECT user_id % 7 AS id, k, count(*) AS n, min(c) AS low, max(c) AS high FROM e GROUP BY 1, 2 HAVING count(*) > 1 AND min(c) <> max(c)")
def t1_corrupt_prints(spark, sf):
    """Ids that stand for different prints."""
    return agg.conflicts(tape(spark, sf).withColumn("id", F.col("user_id") % 7), ["id", "k"], "c")


@query("SELECT event_type, t AS quiet_from, nt AS quiet_to FROM (SELECT event_type, t, coalesce(lead(t) OVER (PARTITION BY event_type ORDER BY t), 1706745600000000) AS nt FROM e) WHERE nt - t > 14400000000")
def t13_starved_streams(spark, sf):
    return books.silences(tape(spark, sf), "event_type", "t", 4 * HOUR, 1_706_745_600_000_000)


@query("""SELECT p.event_id, h.h AS minutes, min(v.t) AS c_time FROM e p CROSS JOIN (VALUES (1), (5), (30)) h(h) LEFT JOIN e v ON v.event_type = 'click' AND v.t >= p.t + h.h * 60000000 AND v.t <= p.t + h.h * 60000000 + 3600000000 WHERE p.event_type = 'error' GROUP BY 1, 2""")
def t16_labels_by_horizon(spark, sf):
    """The first quote at each horizon after a decision, an hour late at most."""
    e = tape(spark, sf).withColumn("one", F.lit(1))
    asks = kind(e, "error").select("event_id", "one", "t", F.explode(F.array(F.lit(1), F.lit(5), F.lit(30))).alias("minutes")).withColumn("t", F.col("t") + F.col("minutes") * MINUTE)
    return joins.asof_forward(asks, kind(e, "click"), "one", "t", HOUR, "c").select("event_id", "minutes", "c_time")


@query("""SELECT user_id, min(t) AS start, max(t) AS stop, count(*) AS n FROM (SELECT *, sum(bad) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM (SELECT *, CASE WHEN event_type = 'error' OR k < 10 THEN 1 ELSE 0 END AS bad FROM e)) WHERE bad = 0 GROUP BY user_id, run""")
def t20_x37_qualified_windows(spark, sf):
    return books.qualified_windows(tape(spark, sf), "user_id", ["t", "event_id"], "t", F.col("event_type") == "error", F.col("k") >= 10, DAY)


@query("""WITH s AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' THEN 1 END AS light FROM e), b AS (SELECT *, CASE WHEN event_type IN ('error', 'signup') OR k < 10 OR coalesce(last_value(light IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 1) = 0 THEN 1 ELSE 0 END AS bad FROM s)
 SELECT user_id, min(t) AS start, max(t) AS stop, count(*) AS n FROM (SELECT *, sum(bad) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM b) WHERE bad = 0 GROUP BY user_id, run""")
def t20_blackout_until_recovery(spark, sf):
    """As above, but after a break nothing counts until a row that recovers."""
    return books.qualified_windows(tape(spark, sf), "user_id", ["t", "event_id"], "t", F.col("event_type") == "error", F.col("k") >= 10, DAY, F.col("event_type") == "signup")


@query("SELECT user_id, CASE WHEN i IS NULL OR v > i THEN c END AS c FROM (SELECT user_id, max(t) FILTER (event_type = 'error') AS i, max(t) FILTER (event_type <> 'error') AS v, arg_max(c, (t, event_id)) FILTER (event_type <> 'error') AS c FROM e GROUP BY 1)")
def t30_valid_state(spark, sf):
    return books.valid_state(tape(spark, sf), "user_id", ["t", "event_id"], "c", F.col("event_type") == "error")


@query("""WITH q AS (SELECT event_id, user_id, t, k AS b, c % 10 AS bs, k + 1 + c % 3 AS a, c % 7 AS az FROM e), l AS (SELECT *, lag(b) OVER w AS pb, lag(bs) OVER w AS pbs, lag(a) OVER w AS pa, lag(az) OVER w AS paz FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 f AS (SELECT *, coalesce(CASE WHEN b >= pb THEN bs ELSE 0 END - CASE WHEN b <= pb THEN pbs ELSE 0 END - CASE WHEN a <= pa THEN az ELSE 0 END + CASE WHEN a >= pa THEN paz ELSE 0 END, 0) AS flow, pb IS NULL AS fresh FROM l)
 SELECT event_id, sum(CASE WHEN fresh THEN 0 ELSE flow END) OVER (PARTITION BY user_id ORDER BY t RANGE 21599999999 PRECEDING) AS pressure, round(CASE WHEN bs + az > 0 THEN (bs - az)::DOUBLE / (bs + az) END, 9) AS queue FROM f""")
def t14_order_flow(spark, sf):
    quotes = tape(spark, sf).select("event_id", "user_id", "t", F.col("k").alias("b"), (F.col("c") % 10).alias("bs"), (F.col("k") + 1 + F.col("c") % 3).alias("a"), (F.col("c") % 7).alias("az"))
    out = books.order_flow(quotes, "user_id", "t", "b", "bs", "a", "az", ["t", "event_id"], 6 * HOUR)
    return out.select("event_id", "pressure", F.round("queue", 9).alias("queue"))


# panels

_PANEL = "p AS (SELECT user_id, t // 86400000000 AS day, avg(c) AS v, count(*) AS n FROM e GROUP BY 1, 2)"


@query(f"WITH {_PANEL} SELECT count(*) AS n, count(*) FILTER (NOT v > 600) AS low, count(*) FILTER (NOT n >= 2) AS thin, count(*) - count(DISTINCT user_id * 100000 + day) AS repeats FROM p")
def x1_x4_x5_panel_rules(spark, sf):
    panel = tape(spark, sf).groupBy("user_id", fn.bucket(F.col("t"), DAY).alias("day")).agg(F.avg("c").alias("v"), F.count("*").alias("n"))
    held = panels.violations(panel, low=F.col("v") > 600, thin=F.col("n") >= 2)
    repeats = panel.groupBy("user_id", "day").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeats"))
    return held.crossJoin(repeats)


@query("SELECT count(*) AS slots, min(h) AS first, max(h) AS last, count(*) FILTER (h % 3600000000 <> 0) AS off_grid, (SELECT count(*) FROM (SELECT DISTINCT t // 3600000000 * 3600000000 AS h FROM e) a WHERE h - 3600000000 IN (SELECT t // 3600000000 * 3600000000 FROM e)) AS even FROM (SELECT DISTINCT t // 3600000000 * 3600000000 AS h FROM e)")
def x3_even_axis(spark, sf):
    axis = tape(spark, sf).select((fn.bucket(F.col("t"), HOUR) * HOUR).alias("h"))
    return panels.axis_steps(axis, "h", HOUR)


@query("""SELECT event_id, t + 60000000 AS fill, t + 60000000 + k * 60000000 AS leaves FROM e WHERE t + 60000000 + k * 60000000 < 1706400000000000 AND event_type = 'view'""")
def x6_next_periods(spark, sf):
    """Fill and exit of a decision, strictly inside the window."""
    p = kind(tape(spark, sf), "view").select("event_id", (F.col("t") + MINUTE).alias("fill"), (F.col("t") + MINUTE + F.col("k") * MINUTE).alias("leaves"))
    return p.where(F.col("leaves") < 1_706_400_000_000_000)


@query("""WITH d AS (SELECT DISTINCT user_id, t // 86400000000 AS day FROM e), r AS (SELECT user_id, min(day) AS a, max(day) AS z FROM d GROUP BY 1) SELECT user_id, day FROM (SELECT user_id, unnest(range(a, z + 1)) AS day FROM r) EXCEPT SELECT user_id, day FROM d""")
def x13_x19_x33_missing_days(spark, sf):
    """Days of a run for which there is no row."""
    days = tape(spark, sf).select("user_id", fn.bucket(F.col("t"), DAY).alias("day")).distinct()
    due = days.groupBy("user_id").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return joins.uncovered(due, days, ["user_id", "day"])


@query("""WITH s AS (SELECT DISTINCT user_id, t // 28800000000 AS slot FROM e WHERE event_type = 'view'), x AS (SELECT user_id, unnest(range(slot + 1, nt)) AS due FROM (SELECT user_id, slot, lead(slot) OVER (PARTITION BY user_id ORDER BY slot) AS nt FROM s) WHERE nt > slot + 1)
 SELECT x.user_id, due FROM x WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = x.user_id AND e.t // 28800000000 = due)""")
def x17_x18_x20_due_slots(spark, sf):
    """Settlements due between two others of a lane, on slots in which the lane traded."""
    e = tape(spark, sf).withColumn("slot", fn.bucket(F.col("t"), 8 * HOUR))
    due = panels.due_slots(kind(e, "view").select("user_id", "slot").distinct(), "user_id", "slot", 1)
    return due.join(e.select("user_id", F.col("slot").alias("due")).distinct(), ["user_id", "due"], "left_semi")


@query("""WITH s AS (SELECT user_id, min(t // 28800000000) AS a, max(t // 28800000000) AS z FROM e WHERE event_type = 'view' GROUP BY 1), r AS (SELECT user_id, min(t // 28800000000) AS a0, max(t // 28800000000) AS z0 FROM e GROUP BY 1)
 SELECT user_id, 'start' AS edge, unnest(range(a0, a)) AS due FROM s JOIN r USING (user_id) UNION ALL SELECT user_id, 'end', unnest(range(z + 1, z0 + 1)) FROM s JOIN r USING (user_id)""")
def x21_dues_at_the_edges(spark, sf):
    slots = tape(spark, sf).withColumn("slot", fn.bucket(F.col("t"), 8 * HOUR))
    view = F.when(F.col("event_type") == "view", F.col("slot"))
    r = slots.groupBy("user_id").agg(F.min(view).alias("a"), F.max(view).alias("z"), F.min("slot").alias("a0"), F.max("slot").alias("z0"))
    start = r.where("a0 < a").select("user_id", F.lit("start").alias("edge"), F.explode(F.sequence("a0", F.col("a") - 1)).alias("due"))
    return start.unionByName(r.where("z < z0").select("user_id", F.lit("end").alias("edge"), F.explode(F.sequence(F.col("z") + 1, "z0")).alias("due")))


@query("""SELECT s.slot, x.v FROM (SELECT unnest(range(5683104, 5683104 + 288)) AS slot) s LEFT JOIN (SELECT t // 300000000 AS slot, nullif(arg_min(k, (t, event_id)), 0) AS v FROM e GROUP BY 1) x USING (slot)""".replace("5683104", "5680512"))
def x23_x24_x25_day_of_slots(spark, sf):
    """A day on its clock of 288 slots: what is missing or zero is null."""
    first = 5_680_512
    day = tape(spark, sf).where(fn.bucket(F.col("t"), 5 * MINUTE).between(first, first + 287))
    held = day.groupBy(fn.bucket(F.col("t"), 5 * MINUTE).alias("slot")).agg(F.nullif(F.min_by("k", F.struct("t", "event_id")), F.lit(0)).alias("v"))
    return spark.range(first, first + 288).toDF("slot").join(held, "slot", "left")


@query("SELECT coalesce(a.hour, b.hour) AS hour, coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM (SELECT t // 3600000000 AS hour, k // 10 AS k, count(*) AS n FROM e WHERE event_type = 'view' GROUP BY 1, 2) a FULL JOIN (SELECT t // 3600000000 AS hour, k // 10 AS k, count(*) AS n FROM e WHERE event_type = 'click' GROUP BY 1, 2) b ON a.hour = b.hour AND a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def x26_u4_census(spark, sf):
    """Two recordings of one series compared as multisets."""
    rows = lambda n: kind(tape(spark, sf), n).select(fn.bucket(F.col("t"), HOUR).alias("hour"), fn.bucket(F.col("k"), 10).alias("k"))
    return agg.multiset_difference(rows("view"), rows("click"))


@query("""WITH g AS (SELECT unnest(range(min(t) // 3600000000, max(t) // 3600000000 + 1)) * 3600000000 AS at FROM e UNION SELECT t FROM e WHERE event_type = 'signup'), m AS (SELECT t, arg_max(c, (t, c)) AS c FROM e WHERE event_type = 'view' GROUP BY 1)
 SELECT g.at, arg_max(m.c, m.t) AS mark FROM g LEFT JOIN m ON m.t <= g.at AND g.at - m.t <= 1800000000 GROUP BY 1""")
def x27_x28_frames(spark, sf):
    """A grid together with events, and the mark at each place, half an hour old at most."""
    e = tape(spark, sf).withColumn("one", F.lit(1))
    grid = joins.spine(e, "t", HOUR).select((F.col("bucket") * HOUR).alias("t")).union(kind(e, "signup").select("t")).distinct().withColumn("one", F.lit(1))
    return joins.asof_backward(grid, kind(e, "view"), "one", "t", 30 * MINUTE, "c").select(F.col("t").alias("at"), F.col("c").alias("mark"))


@query("""WITH b AS (SELECT user_id, t // 86400000000 AS day, max(c) - min(c) AS range, arg_max(c, (t, event_id)) AS close, max(c) AS high FROM e GROUP BY 1, 2), s AS (SELECT *, quantile_cont(range, 0.5) OVER w AS middle, max(high) OVER w AS top FROM b WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
 SELECT user_id, day, range < middle AS compressed, coalesce(range < middle AND close >= top, false) AS breakout FROM s""")
def x41_x42_x44_compression_setups(spark, sf):
    """Days with a range below the median of the five before, and of those the ones that close at a new high."""
    rank = F.struct("t", "event_id")
    b = tape(spark, sf).groupBy("user_id", fn.bucket(F.col("t"), DAY).alias("day")).agg((F.max("c") - F.min("c")).alias("range"), F.max_by("c", rank).alias("close"), F.max("c").alias("high"))
    s = ordered.rolling_rows(b, "user_id", ["day"], -5, -1, 100, lambda w: {"middle": F.expr("percentile(range, 0.5)").over(w), "top": F.max("high").over(w)})
    narrow = F.col("range") < F.col("middle")
    return s.select("user_id", "day", narrow.alias("compressed"), F.coalesce(narrow & (F.col("close") >= F.col("top")), F.lit(False)).alias("breakout"))


@query("SELECT user_id, count(*) AS bursts, sum(n)::BIGINT AS n FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY t) AS g FROM (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 7200000000 THEN 0 ELSE 1 END AS f FROM e)) GROUP BY 1, 2) GROUP BY 1")
def x57_x60_burst_counts(spark, sf):
    found = ordered.bursts(tape(spark, sf), "user_id", "t", 2 * HOUR, DAY)
    return found.groupBy("user_id").agg(F.count("*").alias("bursts"), F.sum("n").alias("n"))


@query("SELECT 'unknown' AS problem, count(*) AS n FROM e WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) UNION ALL SELECT 'repeated', count(*) FROM (SELECT user_id FROM e GROUP BY 1 HAVING count(*) > 60)")
def x62_x50_catalogue_rules(spark, sf):
    """References that lead nowhere, and keys that are not unique."""
    from tapeloom.sources import read_table

    e, known = tape(spark, sf), read_table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"))
    lost = joins.uncovered(e.select("user_id"), known, ["user_id"]).agg(F.lit("unknown").alias("problem"), F.count("*").alias("n"))
    return lost.unionByName(e.groupBy("user_id").count().where("count > 60").agg(F.lit("repeated").alias("problem"), F.count("*").alias("n")))


@query("SELECT event_id, concat_ws(':', 'x', event_type, user_id::VARCHAR) AS instrument, CASE WHEN event_type IN ('view', 'click') THEN 'buy' WHEN event_type = 'error' THEN 'sell' END AS side, t // 1000 AS time_ms, rtrim(rtrim(CAST(CAST(c AS DECIMAL(18,4)) / 100 AS DECIMAL(18,4))::VARCHAR, '0'), '.') AS price FROM e")
def x63_x64_x68_normal_trades(spark, sf):
    e = tape(spark, sf)
    price = fn.canonical_decimal((F.col("c").cast("decimal(18,4)") / 100).cast("decimal(18,4)"))
    return e.select("event_id", F.concat_ws(":", F.lit("x"), "event_type", "user_id").alias("instrument"), fn.side_of(F.col("event_type"), ("view", "click"), ("error",)).alias("side"), fn.bucket(F.col("t"), 1000).alias("time_ms"), price.alias("price"))
