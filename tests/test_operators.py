"""Edge cases of the tape operators on small tables."""

from pyspark.sql import functions as F

from tapeloom.functions.scalars import bucket, canonical_decimal, finite, mid_price, redact
from tapeloom.operators import joins, ordered
from tapeloom.streaming import tape


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_asof_takes_the_bound_and_breaks_ties(spark):
    left = spark.createDataFrame([("a", 10), ("a", 100), ("b", 5), (None, 5)], "key string, t long")
    right = spark.createDataFrame([("a", 1, 7), ("a", 10, 8), ("a", 10, 9), ("b", 6, 1)], "key string, t long, v long")
    assert got(joins.asof_backward(left, right, "key", "t", 20, "v")) == sorted([("a", 10, 10, 9), ("a", 100, None, None), ("b", 5, None, None), (None, 5, None, None)], key=repr)
    assert got(joins.asof_forward(left.where("key = 'b'"), right, "key", "t", 20, "v")) == [("b", 5, 6, 1)]


def test_offset_join_does_not_slide_over_a_hole(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (4, 40)], "t long, v long")
    assert got(joins.offset_join(df, "t", 1, ["v"]).select("t", "prior_v")) == [(1, None), (2, 10), (4, None)]


def test_grid_of_an_empty_table_is_empty(spark):
    df = spark.createDataFrame([], "t long, v long")
    assert joins.dense_grid(df, "t", 10, n=F.count("*")).collect() == []
    assert joins.missing_slots(df, "t", 10).collect() == []


def test_merge_spans_joins_touching_ones(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 1, 2), ("a", 9, 10)], "k string, start long, stop long")
    assert got(ordered.merge_spans(df, "k", 4).select("start", "stop")) == [(0, 7), (9, 10)]


def test_scalars(spark):
    df = spark.createDataFrame([("1.50", "1.70", -1), ("x", "2", 25), (None, "2", 0)], "bid string, ask string, t long")
    out = df.select(canonical_decimal(mid_price(F.col("bid"), F.col("ask"))), bucket(F.col("t"), 10), redact(F.lit("a Token=abc b")), finite(F.lit(1.0), F.lit(float("nan")))).collect()
    assert [tuple(r) for r in out] == [("1.6", -1, "a Token=*** b", False), (None, 2, "a Token=*** b", False), (None, 0, "a Token=*** b", False)]


def test_stream_counts_as_the_batch_does(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tape.windowed_totals(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "event_type", "ts", "value")
    query = stream.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    batch = rows.groupBy(F.window("ts", "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert got(spark.table("totals").select("start", "event_type", "n")) == got(batch)
