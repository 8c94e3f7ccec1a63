"""Footers, digests, digits of JSON, audits of spans and sources, books tried on a copy."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import aggregates as agg, audits, books, replay
from tapeloom.sources import views
from tapeloom.sources.archives import series_views
from tapeloom.sources.footers import footer_statistics, footer_totals


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_row_groups_have_the_bounds_of_their_rows(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(1)
    want = []
    for f in range(3):
        rows = [rng.choice([None, rng.randint(-99, 99)]) for _ in range(100)]
        pq.write_table(pa.table({"v": pa.array(rows, pa.int64()), "s": [str(x) for x in rows]}), tmp_path / f"{f}.parquet", row_group_size=30)
        for g in range(4):
            held = [x for x in rows[30 * g : 30 * g + 30] if x is not None]
            want.append((f"{f}.parquet", g, len(rows[30 * g : 30 * g + 30]), str(min(held)), str(max(held)), len(rows[30 * g : 30 * g + 30]) - len(held)))
    stats = footer_statistics(spark, [f"{tmp_path}/{f}.parquet" for f in range(3)])
    out = stats.where("column = 'v'").select(F.element_at(F.split("file", "/"), -1), "row_group", "row_group_rows", "low", "high", "nulls")
    assert got(out) == sorted(want, key=repr)
    assert [(r["rows"], r["row_groups"]) for r in footer_totals(stats).collect()] == [(100, 4)] * 3
    assert footer_statistics(spark, []).collect() == []


def test_digests(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (3, "1:a")]
    df = spark.createDataFrame(rows, "n int, s string")
    one = lambda d, c=("n", "s"): agg.multiset_digest(d, list(c)).first()["digest"]
    assert one(df) == one(df.repartition(3)) != one(df.distinct()) and one(df) != one(df.withColumn("s", F.coalesce("s", F.lit("-"))))
    listed = df.withColumn("t", F.monotonically_increasing_id())
    turned = listed.withColumn("t", -F.col("t"))
    assert agg.ordered_digest(listed, ["t"], ["n"], 5).first() == agg.ordered_digest(listed.repartition(2), ["t"], ["n"], 10**15).first() != agg.ordered_digest(turned, ["t"], ["n"], 5).first()
    assert agg.multiset_digest(df.limit(0), ["n"]).first()["n"] == 0
    assert agg.pinned(df, "x", "x", "list") is df
    with pytest.raises(ValueError, match="the list has the digest x, not y"):
        agg.pinned(df, "x", "y", "the list")


@pytest.mark.parametrize(
    "text",
    ['{"a": 2.10, "b": [5.00000000, -1e5, "3.0"], "c": "x: 1, \\" 2", "d": null, "e": true}', "[1,2,3]", '{"k1": "v2"}', "7.50", '{"broken": "1', "", '{"a":"' + "9" * 50_000 + '", "b": 1.0}', "[" + ",".join(["1.50", '"2"'] * 20_000) + "]"],
)
def test_bare_numbers_are_quoted_and_nothing_else(spark, text):
    out = spark.createDataFrame([(text,)], "x string").select(views.quoted_numbers(F.col("x"))).first()[0]
    parts = re.split(r'("(?:[^"\\]|\\.)*"|"[^"]*$)', text)
    want = "".join(p if p.startswith('"') else re.sub(r"-?[0-9][0-9.eE+-]*", lambda m: f'"{m[0]}"', p) for p in parts)
    assert out == want


def test_levels_of_both_sides(spark):
    text = '{"channel":"l2Book","data":{"coin":"B","time":7,"levels":[[{"px":"1.10","sz":2.50,"n":3},{"px":1.00,"sz":"1","n":1}],[{"px":"1.20","sz":"4","n":9}]]}}'
    half = '{"data":{"coin":"C","levels":[[],[{"px":"3","sz":"1","n":1}]]}}'
    rows = [(1, "hyperliquid", "BTC-PERP", "l2Book", "s", i, 0, 0, "inbound", "text", "utf-8", bytearray(t.encode()), "") for i, t in enumerate([text, half, "{", '{"data":{"levels":null}}'])]
    out = views.build_view(spark.createDataFrame(rows, views.RECORD), views.VIEWS["l2"])
    assert got(out.select("message_ordinal", "coin", "side", "level_index", "price", "size")) == [(0, "B", "ask", 0, "1.20", "4"), (0, "B", "bid", 0, "1.10", "2.50"), (0, "B", "bid", 1, "1.00", "1"), (1, "C", "ask", 0, "3", "1")]


def test_books_tried_on_a_copy(spark):
    rows = [
        (1, 0, True, "ask", "10", "1", None, None), (1, 1, True, "bid", "9", "1", None, None), (2, 0, False, "bid", "9.5", "2", "9.5", "10"), (3, 0, False, "bid", "9.7", "2", "9.6", None), (4, 0, False, "ask", "11", "1", None, None),
        (4, 1, False, "bid", "10", "1", None, None), (5, 0, False, "ask", "10", "x", None, None), (6, 0, False, "ask", "10", "0", None, None), (7, 0, True, "ask", "5", "1", None, None), (7, 1, True, "bid", "6", "1", None, None), (8, 0, False, "ask", "5", "2", None, None),
        (9, 0, True, "ask", "5", "3", None, None),
    ]
    df = spark.createDataFrame([("b", *r) for r in rows], "book string, m long, place int, snap boolean, side string, price string, qty string, bid string, ask string")
    out = replay.book_states(df, "book", ["m"], "place", F.col("snap"), ["side", "price", "qty"], 10, 4, atomic=True, stated=("bid", "ask"))
    assert [(r.m, r.status, r.digits) for r in out.orderBy("m").collect()] == [
        (1, "ok", "10191"), (2, "ok", "10195291"), (3, "rejected", None), (4, "rejected", None), (5, "rejected", None), (6, "ok", "95291"), (7, "rejected", None), (8, "unanchored", None), (9, "ok", "53"),
    ]


def test_chains_of_numbers(spark):
    rows = [("a", 1, False, 0, 5), ("a", 2, True, 0, 6), ("a", 3, False, 6, 8), ("a", 4, False, 7, 9), ("a", 5, False, 9, 10), ("a", 6, True, 0, 20), ("a", 7, False, 20, 21)]
    df = spark.createDataFrame(rows, "b string, t long, snap boolean, p long, c long")
    assert [r.state for r in books.change_chain(df, "b", ["t"], "p", "c", F.col("snap"), 2).orderBy("t").collect()] == ["unanchored", "snapshot", "update", "gap", "invalid", "snapshot", "update"]
    prints = spark.createDataFrame([("a", 1, 3, None), ("a", 2, None, 10), ("a", 3, 9, None), ("a", 4, 11, None), ("a", 5, 14, None), ("a", 6, 12, None), ("a", 7, 15, None)], "b string, t long, id long, edge long")
    out = books.id_coverage(prints, "b", ["t"], "id", F.col("edge"), 3).orderBy("t").collect()
    assert [(r.state, r.missing_from, r.missing_to) for r in out] == [("before", None, None), ("covered", None, None), ("next", None, None), ("gap", 12, 13), ("error", None, None), ("next", None, None)]


def test_held_through_and_brackets(spark):
    spans = spark.createDataFrame([("a", 1, 4), ("a", 3, 3), ("b", 1, 2)], "k string, start long, stop long")
    held = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 2)], "k string, day long")
    assert got(audits.held_through(spans, held, "k", "day")) == [("a", 1, 4, 1, 3, 2), ("a", 3, 3, 1, 3, None), ("b", 1, 2, 0, None, 2)]
    entries = spark.createDataFrame([("a", 0, 12, 8), ("a", 2, 30, 1), ("a", 3, 11, 9)], "k string, day long, target long, stop long")
    bars = spark.createDataFrame([("a", 1, 11, 9), ("a", 2, 13, 9), ("a", 4, 20, 5)], "k string, day long, high long, low long")
    assert got(audits.bracket_exits(entries, bars, "k", "day", 3).select("day", "exit_at", "reason")) == [(0, 2, "target"), (2, 5, "timeout"), (3, 4, "stop")]


def test_series_views_follow_the_folder(spark, tmp_path):
    df = spark.createDataFrame([("a/B", "2024-01", 1), ("c", "2024-02", 2)], "series string, month string, t long")
    df.write.partitionBy("series", "month").parquet(f"{tmp_path}/one")
    assert sorted(series_views(spark, f"{tmp_path}/one", "hist_x")) == ["hist_x_a_b", "hist_x_c"] and got(spark.table("hist_x_c")) == [(2, "2024-02")]
    df.where("series = 'c'").write.partitionBy("series", "month").parquet(f"{tmp_path}/two")
    series_views(spark, f"{tmp_path}/two", "hist_x")
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("hist_x")] == ["hist_x_c"]


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"d": [1, 2.50], "c": "é"}}',), ("nonsense",), (None,), ("NaN",)], "x string")
    assert [r[0] for r in df.select(audits.canonical_json(F.col("x"))).collect()] == ['{"a":{"c":"é","d":[1,2.5]},"b":1}', None, None, None]
    assert json.loads('{"a": 1}') == {"a": 1}


def test_work_is_cleared(spark):
    import os

    from tapeloom.sources import clear_work, written

    clear_work(spark)
    held = written(spark.range(3), "note")
    path = held.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert held.count() == 3 and os.path.isdir(path)
    assert clear_work(spark) == 1 and not os.path.exists(path) and clear_work(spark) == 0


def test_a_view_of_others_is_not_replaced(spark, tmp_path):
    from tapeloom.sources.archives import generate_catalog

    one = {"a": "SELECT 1 AS x", "b": "SELECT 2 AS x"}
    assert generate_catalog(spark, "views_here", f"{tmp_path}/c", one, "me") == {"made": ["a", "b"], "dropped": [], "foreign": []}
    spark.sql("CREATE VIEW views_here.c AS SELECT 3 AS x")
    assert generate_catalog(spark, "views_here", f"{tmp_path}/c", {"b": "SELECT 4 AS x"}, "me") == {"made": ["b"], "dropped": ["a"], "foreign": ["c"]}
    with pytest.raises(ValueError, match="views of others have these names: c"):
        generate_catalog(spark, "views_here", f"{tmp_path}/c", {"c": "SELECT 5 AS x"}, "me")
    assert [spark.table(f"views_here.{n}").first()[0] for n in ("b", "c")] == [4, 3]
    spark.sql("DROP DATABASE views_here CASCADE")


def test_settling_months(spark, tmp_path):
    from tapeloom.sources.archives import write_settling_months

    df = spark.createDataFrame([("2024-01-05", 1), ("2024-02-07", 2), ("2024-02-09", 3)], "d string, v int").withColumn("d", F.to_date("d"))
    told = lambda until, rows=df: got(write_settling_months(rows, f"{tmp_path}/m", F.col("d"), ["v"], until))
    there = lambda: got(spark.read.parquet(f"{tmp_path}/m").select("state", "v"))
    assert told("2024-02-20") == [("2024-01", "settled", 1, True), ("2024-02", "provisional", 2, True)]
    more = df.unionByName(spark.createDataFrame([("2024-01-06", 9)], "d string, v int").withColumn("d", F.to_date("d")))
    assert told("2024-03-01", more) == [("2024-01", "settled", 2, False), ("2024-02", "settled", 2, True)]
    assert there() == [("settled", 1), ("settled", 2), ("settled", 3)]
