"""File sources, sinks, statistics, schedules and books on small inputs, with what they refuse."""

import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import scalars as fn
from tapeloom.operators import books, ordered, panels, schedules, statistics as st
from tapeloom.sources import archives
from tapeloom.sources.views import VIEWS, build_view


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def packed(*members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in members:
            z.writestr(name, text)
    return held.getvalue()


def test_zip_members(spark):
    rows = [("a.zip", packed(("x.csv", "t,p,q\n1,2.50,3\n"))), ("b.zip", packed(("x.csv", "4,5,6\n7,8,9\n")))]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert got(archives.zip_rows(df, ["t", "p", "q"], ["p"])) == [("2.50", "a.zip"), ("5", "b.zip"), ("8", "b.zip")]
    for bad in (df.withColumn("sha256", F.lit("0")), spark.createDataFrame([("c.zip", packed(("x", "1,2,3"), ("y", "1,2,3")))], df.schema)):
        with pytest.raises(Exception, match="digest|one member"):
            archives.zip_rows(bad, ["t", "p", "q"], ["p"]).collect()
    with pytest.raises(Exception, match="more than 1 rows"):
        archives.zip_rows(df, ["t", "p", "q"], ["p"], most=1).collect()


def test_csv_and_sealed_parts_refuse(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        archives.strict_csv(spark, [str(tmp_path / "a.csv")], ["x", "y"]).collect()
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="digest"):
        archives.sealed_part(spark, str(tmp_path / "p" / "*.parquet"), "00")


def test_bounded_and_outputs_and_views(spark, tmp_path):
    assert archives.bounded(spark.range(3), ["id"], 3).count() == 3
    with pytest.raises(ValueError, match="more than 2"):
        archives.bounded(spark.range(3), ["id"], 2)
    assert archives.decide_output(None, {"a": "1"}, exists=False) == "write"
    assert archives.decide_output({"a": "1"}, {"a": "1"}, exists=True) == "audit"
    assert archives.decide_output({"a": "1"}, {"a": "2"}, exists=True, rebuild=True) == "rebuild"
    for recorded in (None, {"a": "2"}):
        with pytest.raises(ValueError):
            archives.decide_output(recorded, {"a": "1"}, exists=True)
    archives.write_pair(str(tmp_path), "r", {"b": 1, "a": 2}, "text")
    assert (tmp_path / "r.json").read_text() == '{"a":2,"b":1}'
    with pytest.raises(FileExistsError):
        archives.write_pair(str(tmp_path), "r", {}, "")
    assert archives.register_views(spark, "mine", {"x": spark.range(1)}) == ["mine_x"]
    with pytest.raises(ValueError, match="somebody else"):
        archives.register_views(spark, "mine", {"x": spark.range(1)})
    assert archives.register_views(spark, "mine", {"x": spark.range(1)}, {"mine_x"}) == ["mine_x"]


def test_months_replace_only_themselves(spark, tmp_path):
    path, month = str(tmp_path / "m"), F.col("m")
    first = spark.createDataFrame([("2024-01", 2), ("2024-01", 1), ("2024-02", 5)], "m string, v long")
    archives.write_months(first, path, month, ["v"])
    archives.write_months(spark.createDataFrame([("2024-02", 7)], first.schema), path, month, ["v"])
    assert got(spark.read.parquet(path).select("m", "v")) == [("2024-01", 1), ("2024-01", 2), ("2024-02", 7)]


def test_payload_views_of_real_frames(spark):
    frame = '{"channel":"trades","data":[{"coin":"BTC","side":"B","px":"1.10","sz":"0.5","hash":"0x1","time":7,"tid":1125899906842624,"users":["u","v"]},{"coin":"BTC","side":"A","px":2.10,"sz":"1","hash":"0x2","time":8,"tid":2}]}'
    base = ("hyperliquid", "BTC-PERP", "trades", "s", "inbound", "text")
    rows = [(1, *base[:4], 5, 50, 500, *base[4:], "utf-8", frame.encode(), ""), (1, *base[:4], 6, 60, 600, *base[4:], "utf-8", b"{broken", ""), (1, *base[:4], 7, 70, 700, *base[4:], "utf-8", b'{"data":[]}', "")]
    from tapeloom.sources.views import RECORD

    out = build_view(spark.createDataFrame(rows, RECORD), VIEWS["trades"]).collect()
    assert [(r.event_index, r.side, r.price, r.trade_id, r.buyer) for r in sorted(out, key=lambda r: r.event_index)] == [(0, "B", "1.10", "1125899906842624", "u"), (1, "A", "2.10", "2", None)]


def test_running_values_over_any_width(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc") if rng.random() > 0.1 else None, rng.randint(-50, 50), n, rng.choice([None, 1, 2, 5])) for n in range(300)]
    df = spark.createDataFrame(rows, "key string, t long, n long, v long")
    want = []
    for key in {r[0] for r in rows}:
        total = most = last = None
        for _, _, n, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if v is not None:
                total, most, last = (total or 0) + v, max(most or v, v), v
            want.append((key, n, total, most, last))
    for width in (1, 7, 1000):
        out = ordered.running(df, "key", ["t", "n"], width, {"s": F.col("v")}, {"m": F.col("v")}, {"l": F.col("v")})
        assert got(out.select("key", "n", "s", "m", "l")) == sorted(want, key=repr)


def test_statistics_against_known_values(spark):
    df = spark.createDataFrame([(2.228139, 10), (1.96, 100000), (-1.0, 5), (0.0, 3)], "t double, n long")
    tails = [r[0] for r in df.select(st.upper_tail(F.col("t"), F.col("n"))).collect()]
    assert [round(x, 4) for x in tails] == [0.025, 0.025, 0.8184, 0.5]
    assert round(st.expected_best_ratio(1.0, 100), 3) == 2.531 and st.expected_best_ratio(1.0, 1) == 0
    assert [round(r[0], 4) for r in spark.createDataFrame([(1.96,), (-1.0,)], "z double").select(st.normal_cdf(F.col("z"))).collect()] == [0.975, 0.1587]
    splits = st.split_table(spark, 4)
    assert splits.where("inside").groupBy("split").count().collect()[0]["count"] == 2 and splits.select("split").distinct().count() == 6


@pytest.mark.parametrize("at_once", [1, 2, 10])
def test_greedy_selection_with_a_cap(spark, at_once):
    rng = random.Random(at_once)
    rows = [(rng.choice("ab"), a := rng.randint(0, 60), a + rng.randint(1, 20), n) for n in range(80)]
    want = []
    for key in "ab":
        held = []
        for _, a, z, n in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
            if sum(stop > a for stop in held) < at_once:
                held.append(z)
                want.append(n)
    out = schedules.capped(spark.createDataFrame(rows, "k string, start long, stop long, n long"), "k", "start", "stop", "n", at_once)
    assert sorted(r.n for r in out.collect()) == sorted(want)


def test_books(spark):
    rows = [("b", 1, "bid", "9.9", "1", False), ("b", 2, "bid", "10.0", "2.50", True), ("b", 3, "ask", "10.1", "0.05", False), ("b", 4, "ask", "10.2", "1", False), ("b", 5, "ask", "10.2", "0", False)]
    df = spark.createDataFrame(rows, "book string, n long, side string, price string, qty string, snap boolean")
    levels = books.open_levels(df, "book", ["n"], "side", ["price"], "qty", F.col("snap"))
    assert got(levels.select("side", "price", "qty")) == [("ask", "10.1", "0.05"), ("bid", "10.0", "2.50")]
    assert got(books.checksums(levels, "book", "side", "price", "qty")) == [("b", zlib.crc32(b"10151002" + b"50"))]
    seq = spark.createDataFrame([("a", 1, 1, 3), ("a", 2, 4, 5), ("a", 3, 8, 9), ("a", 4, 9, 9), ("a", 5, 9, 12)], "k string, n long, lo long, hi long")
    assert [(r.sequence, r.missing) for r in books.sequence_audit(seq, "k", ["n"], "lo", "hi", 2).orderBy("n").collect()] == [("start", 0), ("next", 0), ("gap", 2), ("repeat", 0), ("overlap", 0)]


def test_price_grids_and_slots(spark):
    df = spark.createDataFrame([("12345.678", 1), ("0.123456", -1), ("987654.3", 1)], "p string, side int").withColumn("p", F.col("p").cast("decimal(20,8)"))
    out = df.select(fn.rounded_price(F.col("p"), F.col("side"), 6).cast("double"), fn.rounded_price(F.col("p"), F.col("side"), 6, True).cast("double"), fn.lot_floor(F.col("p"), "0.1").cast("double")).collect()
    assert [tuple(r) for r in out] == [(12346.0, 12345.0, 12345.6), (0.12345, 0.12346, 0.1), (987655.0, 987654.0, 987654.3)]
    assert got(panels.due_slots(spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "k string, t long"), "k", "t", 1)) == [("a", 2), ("a", 3)]
