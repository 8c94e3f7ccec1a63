"""Queries of the scalar expressions: prices, times, texts, flags. ``k`` and ``c`` of the tape stand for prices and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import scalars as fn
from tapeloom.plans.registry import HOUR, query, tape
from tapeloom.sources import read_table


@query("SELECT event_id, TRY_CAST(CASE WHEN k % 5 = 0 THEN 'bad' ELSE k::VARCHAR END AS BIGINT) AS number, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS bad FROM e WHERE t >= epoch_us(TIMESTAMP '2024-01-05') AND t < epoch_us(TIMESTAMP '2024-01-20') AND k BETWEEN 3 AND 80")
def p1_p3_safe_casts_in_ranges(spark, sf):
    """A cell that is no number becomes null and is counted; a half-open range of time and a closed one of values."""
    e = tape(spark, sf).where((F.col("t") >= 1_704_412_800_000_000) & (F.col("t") < 1_705_708_800_000_000) & F.col("k").between(3, 80))
    number = F.when(F.col("k") % 5 == 0, "bad").otherwise(F.col("k").cast("string")).try_cast("long")
    return e.select("event_id", number.alias("number"), number.isNull().cast("int").alias("bad"))


@query("SELECT event_id, NOT (isnan(v) OR isinf(v)) AS finite FROM (SELECT event_id, CASE k % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE value END AS v FROM e)")
def p4_f8_finite_values(spark, sf):
    v = F.when(F.col("k") % 4 == 0, F.lit("NaN").cast("double")).when(F.col("k") % 4 == 1, F.lit("Infinity").cast("double")).otherwise(F.col("value"))
    return tape(spark, sf).select("event_id", fn.finite(v).alias("finite"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS by_us, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f') AS by_ms, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS by_s, CASE k % 4 WHEN 0 THEN 's' WHEN 1 THEN 'ms' WHEN 2 THEN 'us' ELSE 'ns' END AS unit,
 strftime(ts, '%Y-%m-%d %H:%M') AS text, t // 1000 AS ms FROM e""")
def p5_p19_f9_f10_epochs(spark, sf):
    t = F.col("t")
    units = F.when(F.col("k") % 4 == 0, F.floor(t / 1_000_000)).when(F.col("k") % 4 == 1, F.floor(t / 1000)).when(F.col("k") % 4 == 2, t).otherwise(t * 1000)
    made = {"by_us": fn.epoch_timestamp(t, "us"), "by_ms": fn.epoch_timestamp(fn.bucket(t, 1000), "ms"), "by_s": fn.epoch_timestamp(fn.bucket(t, 1_000_000), "s")}
    out = tape(spark, sf).select("event_id", *[F.date_format(v, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(n) for n, v in made.items()], fn.epoch_timestamp(t, "us").alias("at"), fn.epoch_unit(units).alias("unit"), "t")
    return out.select("*", F.date_format("at", "yyyy-MM-dd HH:mm").alias("text"), fn.bucket(F.col("t"), 1000).alias("ms")).drop("t", "at")


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN k > 0 THEN k END WHEN c > 0 THEN c END AS price, k >= 50 AND NOT event_type = 'error' AND c IS NOT NULL AS usable FROM e")
def p7_p8_family_and_usability(spark, sf):
    """Spot prices for spot lanes, derivative prices for the others, never one for the other; usable buckets."""
    spot = F.col("event_type").isin("view", "click")
    price = F.when(spot, fn.first_positive(F.col("k"))).otherwise(fn.first_positive(F.col("c")))
    return tape(spark, sf).select("event_id", price.alias("price"), fn.usable(F.col("k") >= 50, F.col("event_type") == "error", F.col("c")).alias("usable"))


@query("""SELECT event_id, CASE WHEN k > 0 AND c >= k * 20 THEN (c / 20.0 + k) / 2 END AS mid, CASE WHEN k > 0 AND c >= k * 20 THEN (c / 20.0 - k) / 2 ELSE 0.5 END AS half, round(CASE WHEN k > 0 AND c >= k * 20 THEN (c / 20.0 - k) * 20000 / (c / 20.0 + k) END, 6) AS bps FROM e""")
def p9_p11_p12_quotes(spark, sf):
    bid, ask = F.col("k").cast("double"), F.col("c") / 20.0
    mid = F.when((bid > 0) & (ask >= bid), (bid + ask) / 2)
    return tape(spark, sf).select("event_id", mid.alias("mid"), fn.half_spread(bid, ask, F.lit(0.5)).alias("half"), F.round(fn.spread_bps(bid, ask), 6).alias("bps"))


@query("SELECT event_id, CASE WHEN lower(event_type) IN ('view', 'click') THEN 'buy' WHEN lower(event_type) = 'error' THEN 'sell' END AS side, CAST(sign(c - 1000) AS INT) AS sign FROM e")
def p13_p16_sides_and_signs(spark, sf):
    return tape(spark, sf).select("event_id", fn.side_of(F.concat(F.lit(" "), F.upper("event_type")), ("view", "click"), ("error",)).alias("side"), F.signum(F.col("c") - 1000).cast("int").alias("sign"))


@query("SELECT event_id, t // 28800000000 = (t + 7200000000) // 28800000000 AS safe, CASE WHEN day(ts) = day(last_day(ts)) THEN year(ts) * 12 + month(ts) END AS turn, CASE WHEN day(ts) = 15 THEN year(ts) * 12 + month(ts) END AS control FROM e")
def p17_p18_calendar(spark, sf):
    return tape(spark, sf).select("event_id", fn.settlement_safe(F.col("t"), 2 * HOUR, 8 * HOUR).alias("safe"), fn.calendar_key(F.col("ts"), False).alias("turn"), fn.calendar_key(F.col("ts"), True).alias("control"))


_PROPS = """'{"flag": ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ', "a": {"b": [' || k || ', ' || c || ']}}'"""


@query(f"SELECT event_id, json_extract_string(p, '$.flag') = 'true' AS flag, CAST(json_extract_string(p, '$.a.b[1]') AS BIGINT) AS second, length(p) AS bytes, i - 1 AS position, CAST(x AS BIGINT) AS number FROM (SELECT *, unnest(json_extract_string(p, '$.a.b[*]')) AS x, generate_subscripts(json_extract_string(p, '$.a.b[*]'), 1) AS i FROM (SELECT event_id, {_PROPS} AS p FROM e))")
def f1_f3_f4_f5_f11_f30_payloads(spark, sf):
    """Bytes to text, a typed flag, a declared structure, an array with positions, and its bytes."""
    text = F.format_string('{"flag": %s, "a": {"b": [%d, %d]}}', F.when(F.col("k") % 2 == 0, "true").otherwise("false"), F.col("k"), F.col("c"))
    e = tape(spark, sf).select("event_id", F.encode(text, "UTF-8").alias("payload")).withColumn("text", F.decode("payload", "UTF-8"))
    e = e.withColumn("p", F.from_json("text", "flag boolean, a struct<b: array<bigint>>"))
    flag = F.get_json_object("text", "$.flag").cast("boolean")
    return e.select("event_id", flag.alias("flag"), F.get("p.a.b", F.lit(1)).alias("second"), F.octet_length("payload").cast("long").alias("bytes"), F.posexplode("p.a.b").alias("position", "number")).withColumn("position", F.col("position").cast("long"))


@query("SELECT event_id, printf('$.data.levels[%d]', k) AS path, printf('%016x', event_id) AS hex, coalesce(nullif(k, 5), -1) AS held, greatest(k, c) AS most, concat_ws(':', 'venue', event_type, user_id::VARCHAR) AS instrument, regexp_matches(event_type, 'pong|view') AS pong FROM e")
def f6_f7_x61_x65_texts(spark, sf):
    e = tape(spark, sf)
    return e.select(
        "event_id", F.format_string("$.data.levels[%d]", "k").alias("path"), F.lpad(F.lower(F.hex("event_id")), 16, "0").alias("hex"), F.coalesce(F.nullif("k", F.lit(5)), F.lit(-1)).alias("held"),
        F.greatest("k", "c").alias("most"), F.concat_ws(":", F.lit("venue"), "event_type", "user_id").alias("instrument"), F.lower("event_type").rlike("pong|view").alias("pong"),
    )


@query("""SELECT event_type, count(*) AS n, bit_xor(k * 1000003 + c) AS mixed, round(sum(ln(c + 1)), 4) AS logs, round(sum(sqrt(c)), 4) AS roots, round(sum(exp(-k / 100.0)), 6) AS decay, round(sum(abs(c - 1000)), 0) AS apart FROM e GROUP BY 1""")
def f12_f15_mixes_and_sums(spark, sf):
    agg = {"n": F.count("*"), "mixed": F.bit_xor(F.col("k") * 1000003 + F.col("c")), "logs": F.round(F.sum(F.log(F.col("c") + 1)), 4), "roots": F.round(F.sum(F.sqrt("c")), 4), "decay": F.round(F.sum(F.exp(-F.col("k") / 100.0)), 6)}
    return tape(spark, sf).groupBy("event_type").agg(*[v.alias(k) for k, v in agg.items()], F.round(F.sum(F.abs(F.col("c") - 1000)).cast("double"), 0).alias("apart"))


@query("""SELECT event_id, CAST(round(q, 10) AS DOUBLE) AS quantum, CAST((CASE WHEN k % 2 = 0 THEN ceil(p / q) ELSE floor(p / q) END) * q AS DOUBLE) AS adverse, CAST((CASE WHEN k % 2 = 0 THEN floor(p / q) ELSE ceil(p / q) END) * q AS DOUBLE) AS protective, CAST(floor(p / 0.25) * 0.25 AS DOUBLE) AS lots
 FROM (SELECT *, CASE WHEN p >= 10000 THEN 1.0 WHEN p >= 1000 THEN 0.1 WHEN p >= 100 THEN 0.01 ELSE 0.001 END AS q FROM (SELECT event_id, k, CAST(CAST(c * (k + 1) AS DECIMAL(18,4)) / 13 AS DECIMAL(18,4)) AS p FROM e WHERE c > 0))""")
def f16_f17_f18_x54_price_grids(spark, sf):
    """Prices of five significant digits and three decimals at most, rounded away from the trader and to their protection; whole lots."""
    p, side = (F.col("c") * (F.col("k") + 1)).cast("decimal(18,4)"), F.when(F.col("k") % 2 == 0, 1).otherwise(-1)
    e = tape(spark, sf).where("c > 0").select("event_id", (p / 13).cast("decimal(18,4)").alias("p"), side.alias("side"))
    made = {"quantum": fn.price_quantum(F.col("p"), 3), "adverse": fn.rounded_price(F.col("p"), F.col("side"), 3), "protective": fn.rounded_price(F.col("p"), F.col("side"), 3, True), "lots": fn.lot_floor(F.col("p"), "0.25")}
    return e.select("event_id", *[v.cast("double").alias(n) for n, v in made.items()])


@query("""SELECT user_id, string_agg(ltrim(replace(px, '.', ''), '0') || ltrim(replace(qty, '.', ''), '0'), '' ORDER BY n) AS digits FROM (SELECT user_id, (k + 100)::VARCHAR || '.' || (k % 7)::VARCHAR AS px, '0.0' || (k + 1)::VARCHAR AS qty, row_number() OVER (PARTITION BY user_id ORDER BY k, event_id) AS n FROM e) WHERE n <= 10 GROUP BY 1""")
def f14_book_digits(spark, sf):
    """What a book checksum is taken over: best levels, without points and leading zeros."""
    level = F.struct("k", "event_id", F.concat((F.col("k") + 100).cast("string"), F.lit("."), (F.col("k") % 7).cast("string")).alias("price"), F.concat(F.lit("0.0"), (F.col("k") + 1).cast("string")).alias("qty"))
    best = tape(spark, sf).groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(level)), 1, 10).alias("levels"))
    digits = F.array_join(F.transform("levels", lambda x: F.concat(fn.checksum_digits(x["price"]), fn.checksum_digits(x["qty"]))), "")
    return best.select("user_id", digits.alias("digits"))


@query("SELECT event_id, rtrim(rtrim(CAST(CAST(c AS DECIMAL(18,4)) / 8 AS DECIMAL(18,6))::VARCHAR, '0'), '.') AS text, c > k * 20 AS above FROM e")
def f19_f20_x66_x67_decimal_texts(spark, sf):
    v = (F.col("c").cast("decimal(18,4)") / 8).cast("decimal(18,6)")
    above = F.col("c").cast("string").cast("decimal(38,10)") > (F.col("k") * 20).cast("string").cast("decimal(38,10)")
    return tape(spark, sf).select("event_id", fn.canonical_decimal(v).alias("text"), above.alias("above"))


@query("""SELECT l_orderkey, l_linenumber, strftime(l_shipdate + (CASE WHEN summer THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END), '%Y-%m-%d %H:%M') || CASE WHEN summer THEN ' CEST' ELSE ' CET' END AS label
 FROM (SELECT l_orderkey, l_linenumber, l_shipdate, l_shipdate >= make_timestamp(y, 3, 31 - (dayofweek(make_date(y, 3, 31))::INT), 1, 0, 0) AND l_shipdate < CASE WHEN y < 1996 THEN make_timestamp(y, 9, 30 - (dayofweek(make_date(y, 9, 30))::INT), 1, 0, 0) ELSE make_timestamp(y, 10, 31 - (dayofweek(make_date(y, 10, 31))::INT), 1, 0, 0) END AS summer FROM (SELECT *, year(l_shipdate) AS y FROM lineitem))""")
def f21_civil_time(spark, sf):
    """Local time of Amsterdam with its name, summer time from the last Sunday of March to that of October (September before 1996)."""
    li, zone = read_table(spark, sf, "lineitem"), "Europe/Amsterdam"
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("l_shipdate").cast("timestamp_ntz"))
    hours = F.timestamp_diff("HOUR", F.col("l_shipdate").cast("timestamp_ntz"), local)
    return li.select("l_orderkey", "l_linenumber", F.concat(F.date_format(local, "yyyy-MM-dd HH:mm"), F.when(hours == 2, " CEST").otherwise(" CET")).alias("label"))


_LINE = "CASE k % 5 WHEN 0 THEN 'ws Ping-Timeout after 20s' WHEN 1 THEN 'sequence gap at ' || k WHEN 2 THEN 'will reconnect in 5s' WHEN 3 THEN 'ValueError raised' ELSE 'info ' || event_type END"


@query(f"SELECT CASE k % 5 WHEN 0 THEN 'ping' WHEN 1 THEN 'gap' WHEN 2 THEN 'reconnect' WHEN 3 THEN 'error' ELSE 'other' END AS kind, coalesce(nullif(regexp_extract({_LINE}, 'at ([0-9]+)', 1), ''), '-') AS number, count(*) AS n FROM e GROUP BY ALL".replace(_LINE, f"({_LINE})").replace("event_type END", "'x' END"))
def f22_f23_log_lines(spark, sf):
    line = F.expr("CASE k % 5 WHEN 0 THEN 'ws Ping-Timeout after 20s' WHEN 1 THEN concat('sequence gap at ', k) WHEN 2 THEN 'will reconnect in 5s' WHEN 3 THEN 'ValueError raised' ELSE 'info x' END")
    lines = tape(spark, sf).select(line.alias("line"))
    number = F.nullif(F.regexp_extract("line", "at ([0-9]+)", 1), F.lit(""))
    return lines.groupBy(fn.log_kind(F.col("line")).alias("kind"), F.coalesce(number, F.lit("-")).alias("number")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, (k * 29) // 100 AS legs, ('0x' || substr(sha256(event_id || ':' || user_id), 1, 13))::BIGINT / 4503599627370496.0 AS draw, (t + 60000000) // 28800000000 AS slot, ((t + 60000000) // 28800000000 + 1) * 28800000000 AS next_slot FROM e""")
def f26_f27_f28_f29_slots_and_draws(spark, sf):
    t = F.col("t")
    slot = fn.slot_of(t, 8 * HOUR, 60_000_000)
    return tape(spark, sf).select("event_id", fn.leg_size(F.col("k"), "0.29").alias("legs"), fn.hash_draw(F.col("event_id"), F.col("user_id")).alias("draw"), slot.alias("slot"), ((slot + 1) * 8 * HOUR).alias("next_slot"))


@query("""SELECT event_id, round((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * (c - k) / k * 10000 - 12.5, 6) AS bps, round((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * 2.0 / (1 + k / 50.0), 8) AS own, round(-(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * 2.0 / (1 + k / 50.0) * k / 50.0, 8) AS hedge FROM e WHERE k > 0""")
def x39_x49_charged_moves_and_hedges(spark, sf):
    side = F.when(F.col("k") % 2 == 0, 1).otherwise(-1)
    w = fn.hedged_weights(side, F.col("k") / 50.0, 2.0)
    return tape(spark, sf).where("k > 0").select("event_id", F.round(fn.charged_bps(F.col("k"), F.col("c"), side, 12.5), 6).alias("bps"), F.round(w["own"], 8).alias("own"), F.round(w["hedge"], 8).alias("hedge"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN c > 3000 THEN 'notional' END, CASE WHEN k < 20 THEN 'stale' END, CASE WHEN event_type = 'error' THEN 'health' END], lambda x: x IS NOT NULL), ',') AS reasons, c * 10000 // (k + 1) AS size FROM e""")
def t28_t29_x52_limits_and_sizes(spark, sf):
    """Which limits a position breaks, in order, and the size that risks one per cent over its stop, in millionths."""
    held = fn.reasons(notional=F.col("c") > 3000, stale=F.col("k") < 20, health=F.col("event_type") == "error")
    return tape(spark, sf).select("event_id", F.array_join(held, ",").alias("reasons"), F.call_function("div", F.col("c") * 10_000, F.col("k") + 1).alias("size"))
