"""Queries of file sources and sinks, and of streams: what is written to the shared folder is read again and compared."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tapeloom.functions import scalars as fn
from tapeloom.plans.registry import DAY, HOUR, query, tape
from tapeloom.sources import archives, read_table, work_dir
from tapeloom.streaming import lanes, tape as streams


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN k END AS k, CASE WHEN event_id % 2 = 1 THEN c END AS c, CASE event_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS part FROM e")
def s1_s2_s15_parts_by_name(spark, sf):
    """Two parts with different columns; a hidden one is no part."""
    e, path = tape(spark, sf), work_dir(spark)
    e.where("event_id % 2 = 0").select("event_id", "k").write.parquet(f"{path}/even")
    e.where("event_id % 2 = 1").select("event_id", "c").write.parquet(f"{path}/odd")
    found = archives.read_parts(spark, f"{path}/even", f"{path}/odd", f"{path}/_hidden")
    return found.select("event_id", "k", "c", F.element_at(F.split("part", "/"), -2).alias("part"))


@query("SELECT event_id, row_number() OVER (ORDER BY k, event_id) - 1 AS row, true AS sealed FROM e")
def s3_s4_k6_physical_order(spark, sf):
    """Rows in the order in which they were written, from a part whose digest was recorded."""
    path = work_dir(spark)
    tape(spark, sf).select("event_id", "k").coalesce(1).sortWithinPartitions("k", "event_id").write.parquet(path)
    digest = archives.digests(spark, path).where("file like '%.parquet'").first()["sha256"]
    sealed = archives.sealed_part(spark, f"{path}/*.parquet", digest).select(F.col("event_id").alias("of"))
    rows = archives.physical_rows(spark, path).select("event_id", "row")
    return rows.join(sealed, F.col("event_id") == F.col("of"), "left").select("event_id", "row", F.col("of").isNotNull().alias("sealed"))


@query("SELECT event_id, event_type, k FROM e WHERE event_type IN ('view', 'error') AND t >= 1704153600000000 AND t < 1704758400000000")
def s5_declared_channels(spark, sf):
    """Channels and a span of time, as conditions on the stored columns, so that the scan skips what cannot match."""
    raw = read_table(spark, sf, "events").where(F.col("event_type").isin("view", "error") & (F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-09").cast("timestamp_ntz")))
    return raw.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id::VARCHAR AS id, event_type AS kind, k::VARCHAR AS k FROM e")
def s6_s7_strict_csv(spark, sf):
    path = work_dir(spark)
    tape(spark, sf).select("event_id", "event_type", "k").write.option("header", False).csv(path)
    return archives.strict_csv(spark, [path], ["id", "kind", "k"])


@query("SELECT event_id::VARCHAR AS id, k::VARCHAR AS k, 'archive-' || (user_id % 5) || '.zip' AS source FROM e")
def s8_s9_s10_zip_members(spark, sf):
    """Archives with and without a header, columns picked by name, their digests checked."""
    e = tape(spark, sf).select("event_id", "event_type", "k", (F.col("user_id") % 5).alias("of"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        of, held = int(rows["of"].iloc[0]), io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("rows.csv", rows[["event_id", "event_type", "k"]].to_csv(index=False, header=["id", "kind", "k"] if of % 2 else False))
        return pd.DataFrame([{"path": f"archive-{of}.zip", "content": held.getvalue()}])

    packed = e.groupBy("of").applyInPandas(pack, "path string, content binary").withColumn("sha256", F.sha2("content", 256))
    return archives.zip_rows(packed, ["id", "kind", "k"], ["id", "k"], most=10_000_000)


@query("SELECT event_id, props AS payload, octet_length(encode(props)) AS bytes FROM events")
def s11_base64_payloads(spark, sf):
    staged = read_table(spark, sf, "events").select("event_id", F.base64(F.encode("props", "UTF-8")).alias("payload"))
    out = archives.from_base64(staged, "payload")
    return out.select("event_id", F.decode("payload", "UTF-8").alias("payload"), F.octet_length("payload").cast("long").alias("bytes"))


@query("SELECT a.event_id, b.n FROM events a JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) b USING (event_type)")
def s12_s13_k13_two_catalogs(spark, sf):
    """Views of two catalogs under their aliases, joined by name."""
    e = read_table(spark, sf, "events")
    own = {"live_events", "hist_counts"}
    archives.register_views(spark, "live", {"events": e}, own)
    archives.register_views(spark, "hist", {"counts": e.groupBy("event_type").agg(F.count("*").alias("n"))}, own)
    return spark.table("live_events").join(spark.table("hist_counts"), "event_type").select("event_id", "n")


@query("SELECT event_id, t FROM e WHERE event_type = 'signup' AND k = 7")
def s14_bounded_fetch(spark, sf):
    return archives.bounded(tape(spark, sf).where("event_type = 'signup' and k = 7").select("event_id", "t"), ["t"], 1_000_000)


@query("SELECT user_id, t // 1000 AS ts, value AS close, coalesce(nullif(k % 3, 0) * 4, 8) AS hours FROM e")
def s18_s19_typed_bars(spark, sf):
    """Typed rows of bars and settlements; an interval that isn't given is eight hours."""
    return tape(spark, sf).select("user_id", fn.bucket(F.col("t"), 1000).alias("ts"), F.col("value").alias("close"), F.coalesce(F.nullif(F.col("k") % 3, F.lit(0)) * 4, F.lit(8)).alias("hours"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, true AS ordered FROM orders GROUP BY 1")
def k3_k4_k5_k7_k8_month_folders(spark, sf):
    """One folder a month, ordered within; months that are written again are replaced."""
    o, path = read_table(spark, sf, "orders"), work_dir(spark)
    month = F.date_format("o_orderdate", "yyyy-MM")
    archives.write_months(o.where("year(o_orderdate) = 1995"), path, month, ["o_orderdate", "o_orderkey"])
    archives.write_months(o, path, month, ["o_orderdate", "o_orderkey"])
    back = spark.read.parquet(path).select(F.col("month").cast("string").alias("month"), "o_orderkey", "o_orderdate", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    ahead = back.select("month", "f", (F.col("i") - 1).alias("i"), F.struct("o_orderdate", "o_orderkey").alias("ahead"))
    held = back.join(ahead, ["month", "f", "i"], "left")
    after = F.col("ahead").isNull() | (F.struct("o_orderdate", "o_orderkey") < F.col("ahead"))
    return held.groupBy("month").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.bool_and(after).alias("ordered"))


def _stream(spark, sf):
    """``events`` as a stream of files, with the columns of the tape."""
    schema = read_table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return e.withColumns({"at": F.col("ts").cast("timestamp"), "t": fn.micros("ts"), "k": F.get_json_object("props", "$.k").cast("long")})


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t33_stream_windows(spark, sf):
    """Windows of event time over a stream, in a complete result."""
    done = streams.run_available(streams.windowed_totals(_stream(spark, sf), "event_type", "at", "value", lateness="40 days"), "complete")
    return done.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, count(DISTINCT k) AS n FROM e GROUP BY 1")
def t1_stream_distinct_prints(spark, sf):
    done = streams.run_available(streams.distinct_prints(_stream(spark, sf).select("user_id", "k", "at"), ["user_id", "k"], "at", "40 days"))
    return done.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, CASE WHEN p IS NULL THEN 'start' WHEN k = p + 1 THEN 'next' WHEN k = p THEN 'repeat' WHEN k > p THEN 'gap' ELSE 'back' END AS state FROM (SELECT user_id, event_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e)")
def t5_t9_stream_chains(spark, sf):
    """The last number of each lane kept as state from batch to batch."""
    rows = _stream(spark, sf).select("user_id", "event_id", "k")
    return streams.run_available(streams.chained(rows, "user_id", "k", "event_id", "event_id"), "update")


@query("SELECT t // 86400000000 AS day, count(*) AS n FROM e GROUP BY 1")
def f9_days(spark, sf):
    return tape(spark, sf).groupBy(fn.bucket(F.col("t"), DAY).alias("day")).agg(F.count("*").alias("n"))


#: Rows arrive by their time, one in ten some hours later; stages of five days, as the feed delivers them.
_STAGES = 7
_ARRIVED = "t + CASE WHEN k % 10 = 0 THEN k * 3600000000 ELSE 0 END"
_FED = f"f AS (SELECT *, {_ARRIVED} AS arrived, least(greatest(({_ARRIVED} - 1704067200000000) // 432000000000, 0), {_STAGES - 1}) AS stage FROM e)"


def _feed(spark, sf):
    arrived = F.col("t") + F.when(F.col("k") % 10 == 0, F.col("k") * HOUR).otherwise(0)
    stage = F.least(F.greatest(fn.bucket(arrived - 1_704_067_200_000_000, 5 * DAY), F.lit(0)), F.lit(_STAGES - 1))
    rows = tape(spark, sf).select("user_id", "event_id", "event_type", "t", "k", F.timestamp_micros("t").alias("at"), arrived.alias("arrived"), stage.cast("int").alias("stage"))
    return lanes.staged(rows, "stage", _STAGES)


@query(f"""WITH {_FED}, l AS (SELECT user_id, stage, t // 1000 < max(t // 1000) OVER (PARTITION BY user_id ORDER BY stage, arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 7200000 AS late FROM f)
 SELECT user_id, count(*) AS n, count(*) FILTER (late) AS late FROM l GROUP BY 1""")
def t33_late_rows(spark, sf):
    """Rows more than two hours behind their lane, by lane; none is dropped."""
    rows = _feed(spark, sf).withColumn("order", F.concat(F.lpad(F.col("arrived").cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 20, "0")))
    done = streams.run_available(lanes.with_lateness(rows, "user_id", "at", "order", 7_200_000))
    return done.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("late").alias("late"))


@query("""WITH s AS (SELECT user_id, event_id, t // 1000 AS ms, k, lag(k) OVER w AS pk, lag(t // 1000) OVER w AS pms, lead(t // 1000) OVER w AS nms, (SELECT max(t // 1000) FROM e) AS latest FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t // 1000, event_id))
 SELECT user_id, event_id, CASE WHEN pk IS NULL OR ms - pms > 86400000 THEN 'start' WHEN k = pk + 1 THEN 'next' WHEN k = pk THEN 'repeat' WHEN k > pk THEN 'gap' ELSE 'back' END AS state, NULL::BIGINT AS quiet_from FROM s
 UNION ALL SELECT user_id, NULL, 'silent', ms FROM s WHERE coalesce(nms, latest - 7200000) - ms > 86400000""")
def t5_t13_stream_chains_and_silences(spark, sf):
    """Chains of numbers with a state that a timer drops after a day of silence, and the silences, as the feed comes in by time."""
    rows = tape(spark, sf).withColumn("stage", F.least(F.greatest(fn.bucket(F.col("t") - 1_704_067_200_000_000, 5 * DAY), F.lit(0)), F.lit(_STAGES - 1)).cast("int"))
    feed = lanes.staged(rows.select("user_id", "event_id", "k", F.timestamp_micros("t").alias("at"), "stage"), "stage", _STAGES)
    return streams.run_available(lanes.chained_until_silent(feed, "user_id", "k", "at", "event_id", "event_id", 86_400_000, "2 hours"))


@query("""WITH s AS (SELECT event_type, t, sum(fresh) OVER (PARTITION BY event_type ORDER BY t, event_id) AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) < 5400000000 THEN 0 ELSE 1 END AS fresh FROM e)),
 w AS (SELECT event_type, min(t) AS start, max(t) + 5400000000 AS stop, count(*) AS n FROM s GROUP BY event_type, run) SELECT event_type, start, stop, n FROM w WHERE stop // 1000 <= (SELECT max(t) FROM e) // 1000 - 345600000""")
def t33_stream_sessions(spark, sf):
    """Sessions without a break of 90 minutes, given out once the watermark is past them; rows come up to four days late."""
    done = streams.run_available(streams.sessions(_feed(spark, sf), "event_type", "at", "90 minutes", "96 hours"))
    return done.select("event_type", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")
