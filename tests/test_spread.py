"""Operators that spread a key over tasks, on a single hot key, against plain versions; books replayed; streams that stop and go on."""

import random
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F

from tapeloom.operators import books, joins, ordered, ranks, replay, schedules, statistics as st
from tapeloom.streaming import lanes, tape


def got(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    """One key with nearly all rows, holes in its times, ties, nulls and a null key."""
    rng = random.Random(2)
    rows = [("a", rng.randint(0, 3000) if i % 50 else None, i, rng.choice([None, rng.randint(-9, 9)])) for i in range(1500)]
    rows += [(None, rng.randint(0, 40), 2000 + i, i) for i in range(20)] + [("b", 5, 3000, 1)]
    return spark.createDataFrame(rows, "k string, t long, id long, v long").cache()


@pytest.mark.parametrize("width", [7, 100, 10**9])
@pytest.mark.parametrize("before", [False, True])
def test_running_values(hot, width, before):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    rows = hot.where("t is not null")
    want = rows.select("id", F.sum("v").over(w), F.max("v").over(w), F.last("v", ignorenulls=True).over(w))
    out = ordered.running(rows, "k", ["t", "id"], width, sums={"s": F.col("v")}, maxes={"m": F.col("v")}, lasts={"l": F.col("v")}, before=before)
    assert got(out, "id", "s", "m", "l") == got(want)


@pytest.mark.parametrize("width", [10, 10**9])
def test_streaks_bursts_unions_and_drawdowns(hot, width):
    w, all_of = Window.partitionBy("k").orderBy("t", "id"), hot.where("t is not null")
    plain = all_of.withColumn("g", F.sum(F.when(F.col("v") > 0, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    plain = plain.select("id", F.sum(F.when(F.col("v") > 0, 1).otherwise(0)).over(Window.partitionBy("k", "g").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert got(ordered.streaks(all_of, "k", ["t", "id"], F.col("v") > 0, width), "id", "streak") == got(plain)
    fresh = all_of.withColumn("f", F.when(F.col("t") - F.lag("t").over(w) <= 3, 0).otherwise(1)).withColumn("g", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = fresh.groupBy("k", "g").agg(F.min("t"), F.max("t"), F.count("*")).drop("g")
    assert got(ordered.bursts(all_of, "k", "t", 3, width)) == got(runs)
    spans = all_of.select("k", F.col("t").alias("start"), (F.col("t") + F.coalesce(F.abs("v"), F.lit(0)) % 4 + F.when(F.col("id") % 400 == 0, 500).otherwise(0)).alias("stop"))
    want = []
    for k, a, z in sorted(map(tuple, spans.collect()), key=lambda r: (str(r[0]), r[1], r[2])):
        if want and want[-1][0] == k and a <= want[-1][2]:
            want[-1][2] = max(want[-1][2], z)
        else:
            want.append([k, a, z])
    assert got(ordered.merge_spans(spans, "k", width)) == sorted(map(tuple, want), key=repr)
    equity = all_of.withColumn("e", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    equity = equity.select("id", "e", F.greatest(F.lit(0), F.max("e").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    assert got(ordered.equity_drawdown(all_of, "k", ["t", "id"], "v", width), "id", "equity", "peak") == got(equity)


def test_windows_with_a_halo(hot, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 40)
    by_time = hot.select("id", F.sum("v").over(Window.partitionBy("k").orderBy("t").rangeBetween(-9, 0)).alias("s"))
    for wide in (1, 16):
        monkeypatch.setattr(ordered, "WIDE", wide)
        out = ordered.trailing_sum(hot, "k", "t", "v", 10)
        assert got(out, "id", "trailing") == got(by_time)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-30, -1)
    rows = hot.where("t is not null")
    made = ordered.rolling_rows(rows, "k", ["t", "id"], -30, -1, 100, lambda w: {"m": F.expr("percentile(v, 0.5)").over(w), "n": F.count("*").over(w)})
    assert got(made, "id", "m", "n") == got(rows.select("id", F.expr("percentile(v, 0.5)").over(w), F.count("*").over(w)))
    assert "hashpartitioning(__k" in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [1, 3, 10**6])
def test_ranks_and_adjusted_values(spark, hot, least):
    day = hot.withColumn("day", F.when(F.col("id") % 50 == 0, None).otherwise(F.lit(1)))
    plain = day.where("v > 0").select("id", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("v"), "id")).alias("rank"))
    out = ranks.cross_section_rank(day, "day", "v", "id", F.col("v") > 0, least)
    assert got(out.where("rank is not null"), "id", "rank") == got(plain) and out.count() == hot.count()
    tests = spark.createDataFrame([(i, (i * 7919 % 500 + 1) / 5000) for i in range(400)], "id int, p double")
    p = sorted((r.p, r.id) for r in tests.collect())
    holm, low, want = 0.0, 1.0, {}
    for r, (v, i) in enumerate(p, 1):
        holm = max(holm, v * (len(p) - r + 1))
        want[i] = [min(1, v * len(p)), min(1, holm)]
    for r, (v, i) in reversed(list(enumerate(p, 1))):
        low = min(low, v * len(p) / r)
        want[i].append(low)
    for r in ranks.adjusted_p(tests, "p", "id", least).collect():
        assert [r.bonferroni, r.holm, r.bh] == pytest.approx(want[r.id])
    assert ranks.adjusted_p(tests.limit(0), "p", "id").collect() == []


@pytest.mark.parametrize("block", [4, 100, 10**6])
def test_greedy_chain_over_blocks(spark, block):
    rng = random.Random(block)
    rows = [(k, a, a + rng.choice([0, 0, 1, 5, 40]), i) for i, (k, a) in enumerate((rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 300)) for _ in range(500))]
    rows += [("a", None, 5, 900), ("a", 5, None, 901)]
    want, free = [], {}
    for k, a, z, i in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (str(r[0]), r[1], r[3])):
        if a >= free.get(k, -1):
            want.append((i,))
            free[k] = z
    df = spark.createDataFrame(rows, "k string, start long, stop long, id long")
    assert got(schedules.non_overlapping(df, "k", "start", "stop", "id", 50, block), "id") == sorted(want, key=repr)
    assert got(schedules.capped(df.where("start is not null and stop is not null"), "k", "start", "stop", "id", 1), "id") == sorted(want, key=repr)
    assert schedules.non_overlapping(df.limit(0), "k", "start", "stop", "id", 50).collect() == []


def test_bitemporal_facts(spark):
    rng = random.Random(6)
    facts = [("a" if i % 9 else None, a, None if rng.random() < 0.1 else a + rng.choice([1, 2, 7, 300]), rng.randint(0, 99), i) for i, a in ((i, rng.randint(-200, 200)) for i in range(150))]
    asks = [(i, "a" if i % 7 else None, rng.choice([None, *range(0, 110, 5)]), rng.randint(-230, 230)) for i in range(300)]
    first = {}
    for k, a, z, seen, v in facts:
        first[k, a] = min(first.get((k, a), (10**9,)), (seen, z is not None, z or 0, v))
    want = []
    for i, k, received, event in asks:
        held = [f[3] for (key, a), f in first.items() if key == k and received is not None and f[0] <= received and a <= event and (not f[1] or event < f[2])]
        want.append((i, held[0] if len(held) == 1 else None))
    f, q = spark.createDataFrame(facts, "k string, valid_from long, valid_to long, observed long, v long"), spark.createDataFrame(asks, "ask long, k string, received long, event long")
    assert got(joins.known_at(f, q, "k", ["v"], 20), "ask", "v") == sorted(want, key=repr)
    assert {r.v for r in joins.known_at(f.limit(0), q, "k", ["v"], 20).collect()} == {None}


def test_resamples_are_shared(spark):
    rng = random.Random(1)
    rows = [(c, d, rng.random()) for c in ("x", "y", "z") for d in range(12) for _ in range(rng.randint(0 if c == "z" else 1, 4))]
    df = spark.createDataFrame([*rows, *[("w", d, v) for c, d, v in rows if c == "x"]], "cell string, day int, v double")
    out = {r.cell: r for r in st.shared_resamples(df, ["cell"], "day", "v", 12, 30).collect()}
    assert out["x"].means == out["w"].means and out["x"].means != out["y"].means
    index = lambda b, j: (b * 5 + j * 7) % 12
    for r in st.shared_resamples(df, ["cell"], "day", "v", 12, 9, index).collect():
        for b, m in enumerate(r.means):
            taken = [v for j in range(12) for c, d, v in rows if c == ("x" if r.cell == "w" else r.cell) and d == index(b, j)]
            assert m == pytest.approx(sum(taken) / len(taken)) if taken else m is None


def test_deflated_ratio_of_noise_and_of_skill(spark):
    rng = random.Random(5)
    rows = [(c, rng.gauss(0.5 if c == 0 else 0.0, 1)) for c in range(40) for _ in range(200)]
    out = {r.c: r for r in st.deflated_ratios(spark.createDataFrame(rows, "c int, g double"), ["c"], "g").collect()}
    assert out[0].deflated > 0.95 and max(out[c].deflated for c in range(1, 40)) < 0.9 and out[0].benchmark > 0


def _levels(messages, depth, n):
    """The states of a book of levels; a message is (snapshot, [(side, price, quantity)])."""
    sides, begun = {"ask": {}, "bid": {}}, False
    for snapshot, changes in messages:
        if snapshot:
            sides, begun = {"ask": {}, "bid": {}}, True
        for side, price, quantity in changes:
            sides[side].pop(Decimal(price), None)
            if Decimal(quantity):
                sides[side][Decimal(price)] = (price, quantity)
        text = ""
        for side, down in (("ask", False), ("bid", True)):
            best = sorted(sides[side], reverse=down)
            for p in best[depth:]:
                del sides[side][p]
            text += "".join(x.replace(".", "").lstrip("0") for p in best[:n] for x in sides[side][p])
        yield (zlib.crc32(text.encode()) if begun else None)


def test_book_states_with_cuts_and_snapshots_of_many_levels(spark):
    rng = random.Random(9)
    messages = [(i % 40 == 7, [(rng.choice(["bid", "ask"]), f"{rng.randint(1, 30)}.{rng.choice(['5', '50'])}", rng.choice(["0", "0.00", "1.10", "2"])) for _ in range(12 if i % 40 == 7 else rng.randint(1, 3))]) for i in range(300)]
    rows = [("a", i, place, snapshot, *change) for i, (snapshot, changes) in enumerate(messages) for place, change in enumerate(changes)]
    df = spark.createDataFrame(rows, "book string, m long, place int, snap boolean, side string, price string, qty string")
    out = replay.book_states(df, "book", ["m"], "place", F.col("snap"), ["side", "price", "qty"], 5, 50, levels=3)
    assert [r.checksum for r in out.orderBy("m").collect()] == list(_levels(messages, 5, 3))
    bad = df.withColumn("qty", F.when((F.col("m") == 60) & (F.col("place") == 0), "x").otherwise(F.col("qty")))
    states = {r.m: r.status for r in replay.book_states(bad, "book", ["m"], "place", F.col("snap"), ["side", "price", "qty"], 5, 50).collect()}
    assert [states[m] for m in (6, 7, 59, 60, 86, 87)] == ["unanchored", "ok", "ok", "broken", "broken", "ok"]


def test_recorded_checksum_of_a_book(spark):
    """Ten levels a side, of small prices, with the checksum that goes with them."""
    asks = [("0.05005", "0.00000500"), ("0.05010", "0.00000500"), ("0.05015", "0.00000500"), ("0.05020", "0.00000500"), ("0.05025", "0.00000500"), ("0.05030", "0.00000500"), ("0.05035", "0.00000500"), ("0.05040", "0.00000500"), ("0.05045", "0.00000500"), ("0.05050", "0.00000500")]
    bids = [("0.05000", "0.00000500"), ("0.04995", "0.00000500"), ("0.04990", "0.00000500"), ("0.04980", "0.00000500"), ("0.04975", "0.00000500"), ("0.04970", "0.00000500"), ("0.04965", "0.00000500"), ("0.04960", "0.00000500"), ("0.04955", "0.00000500"), ("0.04950", "0.00000500")]
    rows = [("x", 0, i, True, side, p, q) for i, (side, (p, q)) in enumerate([("ask", x) for x in asks] + [("bid", x) for x in bids])]
    df = spark.createDataFrame(rows, "book string, m long, place int, snap boolean, side string, price string, qty string")
    (state,) = replay.book_states(df, "book", ["m"], "place", F.col("snap"), ["side", "price", "qty"], 10, 10).collect()
    assert (state.checksum, state.size) == (974947235, 20)


def test_orders_by_id(spark):
    rows = [
        ("b", 1, True, "bid", "10.0", "1", "add", "x", "1"), ("b", 2, False, "bid", "10.0", "2", "add", "y", "2"), ("b", 3, False, "bid", "10.0", "5", "modify", "x", "3"), ("b", 4, False, "bid", "11.0", "5", "modify", "x", "4"),
        ("b", 5, False, "bid", "9.0", "1", "add", "z", "5"), ("b", 6, False, "bid", "11.0", "7", "add", "w", "6"), ("b", 7, False, "bid", "10.0", "0", "delete", "y", "7"), ("b", 8, False, "bid", "9.0", "1", "delete", "z", "8"),
    ]
    df = spark.createDataFrame(rows, "book string, m long, snap boolean, side string, price string, qty string, event string, id string, time string").withColumn("place", F.lit(0))
    run = lambda strict: [(r.m, r.status, r.digits, r.cut, r.refused) for r in replay.book_states(df, "book", ["m"], "place", F.col("snap"), ["side", "price", "qty", "event", "id", "time"], 2, 5, orders=True, strict=strict).orderBy("m").collect()]
    want = [(1, "ok", "1001", 0, 0), (2, "ok", "10011002", 0, 0), (3, "ok", "10021005", 0, 0), (4, "ok", "10021005", 0, 1), (5, "ok", "10021005901", 0, 0), (6, "ok", "110710021005", 1, 0), (7, "ok", "11071005", 0, 0), (8, "ok", "11071005", 0, 1)]
    assert run(False) == want
    assert [x[:2] for x in run(True)] == [(m, "ok" if m < 4 else "broken") for m in range(1, 9)]


def test_anchored_chain_by_hand(spark):
    u = [("a", 1, 1, 3), ("a", 2, 4, 6), ("a", 4, 7, 9), ("a", 5, 7, 9), ("a", 6, 12, 13), ("a", 7, 14, 15), ("a", 9, 16, 16), ("b", 1, 1, 2), ("c", 1, 1, 2), ("c", 3, 9, 9)]
    s = [("a", 3, 5), ("a", 8, 14), ("c", 2, 5)]
    ups, snaps = spark.createDataFrame(u, "book string, t long, f long, l long"), spark.createDataFrame(s, "book string, t long, l long")
    out = replay.anchored_chain(ups, snaps, "book", ["t"], "f", "l", [], 3)
    want = [
        ("a", 1, None, "buffered"), ("a", 2, 1, "bootstrap_update"), ("a", 4, 1, "update"), ("a", 5, 1, "equal_final_reapplication"), ("a", 6, 1, "sequence_gap"), ("a", 7, 1, "after_gap"),
        ("a", 7, 2, "bootstrap_update"), ("a", 9, 2, "update"), ("b", 1, None, "buffered"), ("c", 1, None, "buffered"), ("c", 3, 1, "sequence_gap"),
    ]
    assert got(out, "book", "t", "segment", "event") == sorted(want, key=repr)


def test_blackout(spark):
    rows = [("a", i, kind) for i, kind in enumerate("oobooroobro")]
    df = spark.createDataFrame(rows, "k string, t long, kind string")
    out = books.qualified_windows(df, "k", ["t"], "t", F.col("kind") == "b", F.lit(True), 2, F.col("kind") == "r")
    assert got(out, "start", "stop", "n") == [(0, 1, 2), (10, 10, 1), (6, 7, 2)]


def test_a_stream_that_stops_goes_on_alike(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b"]), i, rng.randint(0, 5), i * 10_000_000 + rng.randint(0, 9) * 1_000_000) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, id long, n long, t long").withColumn("at", F.timestamp_micros("t")).drop("t")

    def run(state, files):
        folder = f"{tmp_path}/{files}"
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return tape.run_available(lanes.chained_until_silent(stream, "k", "n", "at", "id", "id", 25_000, "1 second"), state=state)

    def put(files, low, high):
        df.where(F.col("id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{files}")

    put("whole", 0, 60)
    whole = got(run(f"{tmp_path}/s1", "whole"))
    put("parts", 0, 25)
    run(f"{tmp_path}/s2", "parts")
    put("parts", 25, 40)
    put("parts", 40, 60)
    assert got(run(f"{tmp_path}/s2", "parts")) == whole
    assert got(run(f"{tmp_path}/s2", "parts")) == whole  # nothing new
    assert {r[2] for r in whole} >= {"start", "silent", "gap"}
