"""Queries against their SQL on small tables of odd values."""

from functools import reduce
from math import log
from operator import add

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_catalog import rows

from tapeloom.functions import scalars as fn
from tapeloom.operators import audits
from tapeloom.plans import ORACLE_SQL, QUERIES, record_views
from tapeloom.sources import work_dir
from tapeloom.sources.views import VIEWS
from tapeloom.streaming import lanes


def same(spark, folder, name, events):
    """Whether a query gives what its SQL gives over these events (event_id, ts, user_id, event_type, value, k)."""
    frame = pd.DataFrame([(i, pd.Timestamp(ts), u, kind, float(v), f'{{"k": {k}}}') for i, ts, u, kind, v, k in events], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    con = duckdb.connect()
    con.execute("create table events as select * replace (ts::timestamp as ts) from frame")
    con.execute(f"copy events to '{folder}/events.parquet' (format parquet)")
    want = con.execute(ORACLE_SQL[name])
    return rows(QUERIES[name](spark, str(folder)).toPandas()) == rows(want.df())


RETURNS = ["w9_w10_lookback_returns", "w11_w18_w19_w20_volatility_and_momentum", "w15_whole_window_features"]


@pytest.mark.parametrize("name", RETURNS)
def test_days_without_a_price_give_infinite_returns(spark, tmp_path, name):
    zero = {1: [], 2: [3], 3: [0], 4: [11], 5: [4, 5], 6: [2, 9]}  # days on which a lane's price is zero
    events = [(12 * u + d, f"2024-01-{d + 1:02d} 05:00:00", u, "view", 0 if d in days else 10 + (7 * d + u) % 5, d) for u, days in zero.items() for d in range(12)]
    assert same(spark, tmp_path, name, events)


@pytest.mark.parametrize("name", RETURNS[1:])
def test_windows_that_come_to_nothing_have_the_sign_of_zero_of_the_sql(spark, tmp_path, name):
    lanes = [(55, 49, 58, 52, 55, 49, 58), (46, 38, 6, 58, 46, 38, 6), (34, 54, 20, 46, 34), (5, 51, 18, 31, 5, 5), (35, 60, 20, 29, 35, 35), (7, 7, 7, 7, 7, 7)]
    events = [(10 * u + d, f"2024-01-{d + 1:02d} 05:00:00", u, "view", cents / 100, d) for u, prices in enumerate(lanes) for d, cents in enumerate(prices)]
    assert same(spark, tmp_path, name, events)


def test_logs_and_rounding_agree_with_the_sql_in_every_bit(spark):
    pairs = pd.DataFrame([(a / 7, b / 3) for a in range(1, 90) for b in range(1, 60)], columns=["a", "b"])
    odd = [(k + 0.5) / 1e9 for k in range(-300, 300)] + [(k + 0.5) / 512 for k in range(-300, 300)] + [-4e-10, 4e-10, 0.0, -0.0, 1e300, float("inf"), float("-inf")]
    vals = pd.DataFrame({"v": [log(a / b) for a, b in pairs.itertuples(index=False)] + odd})
    frame = duckdb.sql("select a, b, ln(a / b) as r from pairs").df()
    found = spark.createDataFrame(pairs).select("a", "b", fn.log_ratio(F.col("a"), F.col("b")).alias("r")).toPandas()
    assert sorted(found.itertuples(index=False, name=None)) == sorted(frame.itertuples(index=False, name=None))
    want = duckdb.sql("select v, round(v, 9) as nine, round(v, 4) as four from vals").df()
    found = spark.createDataFrame(vals).select("v", fn.rounded(F.col("v"), 9).alias("nine"), fn.rounded(F.col("v"), 4).alias("four")).toPandas()
    assert sorted(map(repr, found.itertuples(index=False, name=None))) == sorted(map(repr, want.itertuples(index=False, name=None)))


def test_returns_between_two_digits_are_rounded_as_the_sql_does(spark, tmp_path):
    name, prices = "w26_m23_forward_returns", [(5120, 2431), (5120, 2433), (5120, 7679), (1024, 1), (2048, 3), (900, 900)]
    events = [(2 * u + i, f"2024-01-01 {5 + 2 * i:02d}:00:00", u, "view", cents / 100, u) for u, pair in enumerate(prices) for i, cents in enumerate(pair)]
    assert same(spark, tmp_path, name, events)
    want = duckdb.sql(ORACLE_SQL[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall()
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))) == sorted(map(repr, want))


def test_weights_at_the_cap_are_added_in_order_of_events(spark, tmp_path):
    legs = [(10, 20, 60), (60, 20, 10), (20, 30, 40), (40, 30, 20), (20, 10, 60), (90,), (91,), (45, 45), (0, 90), (60, 30, 0)]
    events = []
    for u, weights in enumerate(legs):
        events += [(10 * u + i, f"2024-01-01 05:00:{10 * i:02d}", u, "view", 3 + i, k) for i, k in enumerate(weights)]
    whole = spark.createDataFrame([(e[2], e[5] / 100, e[0]) for e in events], "pair long, weight double, n long").withColumns({"market": F.lit("spot"), "units": F.lit(1)})
    want = {u: reduce(add, (w / 100 for w in weights)) > 0.9 for u, weights in enumerate(legs)}
    for parts in (1, 7):  # rows lie in any order
        found = audits.pair_problems(whole.repartition(parts).sortWithinPartitions(F.desc("n")), "pair", 0.9, ["n"]).collect()
        assert {r["pair"]: "over_the_cap" in r["problems"] for r in found} == want
    assert same(spark, tmp_path, "x50_carry_pairs", events)


class Held:
    """State of one shard, as a processor sees it."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_late_rows_of_many_lanes_are_told_in_one_call():
    late, state = lanes._Late("order", ["lane_text", "order"], 10), Held()
    late.init(state)
    found = []
    for batch in ([("=a", "1", 100), ("=b", "1", 5), ("=a", "2", 89), ("", "1", 50), ("=a", "3", 90)], [("=b", "1", 1), ("", "1", 39), ("=a", "1", 99), ("=c", "1", 0)]):
        frame = pd.DataFrame(batch, columns=["lane_text", "order", "at_ms"])
        found.append([tuple(r) for out in late.handleInputRows((0,), iter([frame]), None) for r in out[["lane_text", "order", "late"]].to_numpy()])
    assert found == [[("", "1", False), ("=a", "1", False), ("=a", "2", True), ("=a", "3", False), ("=b", "1", False)], [("", "1", True), ("=a", "1", False), ("=b", "1", False), ("=c", "1", False)]]
    assert dict(zip(*state.value, strict=True)) == {"": 50, "=a": 100, "=b": 5, "=c": 0}


class Times:
    def __init__(self, at):
        self.at = at

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.at  # noqa: E731, N815


def test_chains_of_many_lanes_share_a_state_and_a_timer():
    chain, state = lanes._Chain("n", "id", "id", 10), Held()
    chain.init(state)

    def told(frames):
        return [(r.lane_text, None if pd.isna(r.id) else r.id, r.state, None if pd.isna(r.quiet_from) else r.quiet_from) for f in frames for r in f.itertuples()]

    def given(*rows):
        return told(chain.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["lane_text", "id", "n", "at_ms"])]), None))

    assert given(("=a", 1, 5, 0), ("=b", 2, 1, 4), ("=a", 3, 6, 10), ("=a", 4, 6, 21)) == [
        ("=a", 1, "start", None), ("=a", 3, "next", None), ("=a", 4, "start", None), ("=b", 2, "start", None), ("=a", None, "silent", 10)]
    assert state.timers == {15}
    assert given(("=a", 5, 9, 20), ("=a", 6, 2, 22), ("=c", 7, 1, 30)) == [("=a", 5, "gap", None), ("=a", 6, "back", None), ("=c", 7, "start", None)]
    assert state.timers == {15}
    state.timers.discard(15)  # the engine drops a timer that it has called
    assert told(chain.handleExpiredTimer((0,), Times(33), Times(15))) == [("=a", None, "silent", 22), ("=b", None, "silent", 4)]
    assert state.timers == {41} and state.value[0] == ["=c"]
    assert told(chain.handleExpiredTimer((0,), Times(60), Times(41))) == [("=c", None, "silent", 30)]
    assert state.value is None


def test_records_of_a_small_file_are_parsed_on_all_cores(spark):
    records = record_views.records_of(spark, "/root/testdata/sf0.001", VIEWS["binance_usdm_context"])
    assert records.where("frame_type = 'marker'").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_feed_reads_one_stage_a_batch_from_files_that_grow_with_it(spark, monkeypatch):
    monkeypatch.setattr(lanes, "FILE_ROWS", 10)
    table = spark.createDataFrame([(i, s) for i, s in enumerate([0] * 45 + [2] + [3] * 2 + [9])], "row long, stage int")
    feed, seen = lanes.staged(table, "stage", 5), []

    def put(batch, number):
        seen.append((sorted({r["stage"] for r in batch.select("stage").collect()}), batch.count(), batch.select(F.input_file_name()).distinct().count()))

    feed.writeStream.foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", f"{work_dir(spark)}-c").start().awaitTermination()
    assert [s[:2] for s in seen] == [([0], 45), ([2], 1), ([3], 2)]
    assert seen[0][2] == 5
