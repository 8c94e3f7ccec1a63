"""Books replayed message by message, as queries over the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import ordered, replay
from tapeloom.plans.registry import DAY, query, tape

#: Numbers of an update follow those before it in its book; some are missing, some are given twice. Snapshots lag behind.
_RANGES = "n AS (SELECT user_id, t, event_id, k, c, event_type = 'signup' AS snap, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e)"
_FIRST, _LAST = "3 * n - CASE WHEN c % 37 = 0 THEN 0 ELSE 2 END", "3 * n - CASE WHEN c % 13 = 0 THEN 3 ELSE 0 END"


def _numbered(spark, sf):
    rows = ordered.with_previous(tape(spark, sf).select("user_id", "t", "event_id", "k", "c", "event_type"), "user_id", ["t", "event_id"], ["k"], DAY)
    return rows.withColumn("n", F.col("ordinal").cast("long"))


def _anchored_sql(first: str, last: str, anchor: str) -> str:
    return f"""WITH {_RANGES}, s AS (SELECT *, sum(snap::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS seg FROM n), u AS (SELECT user_id, t, event_id, seg, {first} AS f, {last} AS l FROM s WHERE NOT snap), a AS (SELECT user_id, seg, {anchor} AS anchor FROM s WHERE snap),
 r AS (SELECT u.user_id, t, event_id, u.seg AS segment, f, l, false AS buffered, anchor FROM u JOIN a ON a.user_id = u.user_id AND a.seg = u.seg UNION ALL SELECT u.user_id, t, event_id, a.seg, f, l, true, anchor FROM u JOIN a ON a.user_id = u.user_id AND a.seg = u.seg + 1 WHERE l > anchor),
 p AS (SELECT *, greatest(anchor, max(l) OVER (PARTITION BY user_id, segment ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS reached FROM r),
 g AS (SELECT *, coalesce(max((f > reached + 1)::INT) OVER (PARTITION BY user_id, segment ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broken FROM p)
 SELECT user_id, event_id, CAST(segment AS BIGINT) AS segment, CASE WHEN broken = 1 THEN 'after_gap' WHEN f > reached + 1 THEN 'sequence_gap' WHEN l < reached THEN 'stale' WHEN l = reached THEN 'equal_final_reapplication' WHEN buffered THEN 'bootstrap_update' ELSE 'update' END AS event FROM g
 UNION ALL SELECT user_id, event_id, NULL, 'buffered' FROM u WHERE seg = 0 AND NOT EXISTS (FROM r WHERE r.event_id = u.event_id)"""


@query(_anchored_sql(_FIRST, _LAST, "3 * n - k % 12"))
def t6_snapshot_and_chained_updates(spark, sf):
    """Buffered and following updates of each snapshot, with gaps, repeats, and snapshots that lag behind."""
    rows = _numbered(spark, sf)
    updates = rows.where("event_type <> 'signup'").select("user_id", "t", "event_id", F.expr(_FIRST).alias("f"), F.expr(_LAST).alias("l"))
    snapshots = rows.where("event_type = 'signup'").select("user_id", "t", "event_id", F.expr("3 * n - k % 12").alias("l"))
    return replay.anchored_chain(updates, snapshots, "user_id", ["t", "event_id"], "f", "l", [], DAY).select("user_id", "event_id", "segment", "event")


@query(_anchored_sql("n - CASE WHEN c % 41 = 0 THEN 0 WHEN c % 17 = 0 THEN 1 ELSE 0 END + CASE WHEN c % 29 = 0 THEN 2 ELSE 0 END", "n - CASE WHEN c % 41 = 0 THEN 0 WHEN c % 17 = 0 THEN 1 ELSE 0 END + CASE WHEN c % 29 = 0 THEN 2 ELSE 0 END", "n - k % 5"))
def t7_nonces_from_a_snapshot(spark, sf):
    """Updates numbered one by one: buffered, joined to a snapshot's nonce, then each one more than the one before."""
    nonce = "n - CASE WHEN c % 41 = 0 THEN 0 WHEN c % 17 = 0 THEN 1 ELSE 0 END + CASE WHEN c % 29 = 0 THEN 2 ELSE 0 END"
    rows = _numbered(spark, sf)
    updates = rows.where("event_type <> 'signup'").select("user_id", "t", "event_id", F.expr(nonce).alias("nonce"))
    snapshots = rows.where("event_type = 'signup'").select("user_id", "t", "event_id", F.expr("n - k % 5").alias("nonce"))
    return replay.anchored_chain(updates, snapshots, "user_id", ["t", "event_id"], "nonce", "nonce", [], DAY).select("user_id", "event_id", "segment", "event")


_CHANGE = ["CASE WHEN c % 2 = 0 THEN 'bid' ELSE 'ask' END AS side", "concat(CAST(k % 20 AS STRING), '.50') AS price", "concat('0.', CAST(c % 4 AS STRING)) AS qty"]
_SHOWN = "ltrim(replace(%s, '.', ''), '0')"


@query(f"""WITH RECURSIVE m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, event_type = 'signup' AS snap, {", ".join(_CHANGE).replace("AS STRING", "AS VARCHAR")}, CASE WHEN c % 2 = 0 THEN -(k % 20) ELSE k % 20 END AS r, c % 4 AS q FROM e),
 g AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n, false AS anchored, []::STRUCT(r BIGINT, d VARCHAR)[] AS ask, []::STRUCT(r BIGINT, d VARCHAR)[] AS bid, 0::BIGINT AS cut FROM (SELECT DISTINCT user_id FROM m)
 UNION ALL SELECT user_id, event_id, n, anchored, ask[1:4], bid[1:4], greatest(len(ask) - 4, 0) + greatest(len(bid) - 4, 0) FROM
 (SELECT m.user_id, m.event_id, m.n, anchored OR snap AS anchored, CASE WHEN side = 'ask' AND (anchored OR snap) THEN list_sort(list_filter(CASE WHEN snap THEN [] ELSE ask END, lambda x: x.r <> m.r) || CASE WHEN q > 0 THEN [{{'r': m.r, 'd': {_SHOWN % "price"} || {_SHOWN % "qty"}}}] ELSE [] END) WHEN snap THEN [] ELSE ask END AS ask,
 CASE WHEN side = 'bid' AND (anchored OR snap) THEN list_sort(list_filter(CASE WHEN snap THEN [] ELSE bid END, lambda x: x.r <> m.r) || CASE WHEN q > 0 THEN [{{'r': m.r, 'd': {_SHOWN % "price"} || {_SHOWN % "qty"}}}] ELSE [] END) WHEN snap THEN [] ELSE bid END AS bid FROM g JOIN m ON m.user_id = g.user_id AND m.n = g.n + 1))
 SELECT user_id, event_id, CASE WHEN anchored THEN 'ok' ELSE 'unanchored' END AS status, CASE WHEN anchored THEN array_to_string(list_transform(ask[1:3], lambda x: x.d), '') || array_to_string(list_transform(bid[1:3], lambda x: x.d), '') END AS digits, CASE WHEN anchored THEN len(ask) + len(bid) END::INT AS size, CASE WHEN anchored THEN cut END::INT AS cut FROM g WHERE n > 0""")
def t2_book_at_each_message(spark, sf):
    """Levels with deletes, re-adds and cuts at a depth of four; what the checksum of three levels is made from, after every message."""
    e = tape(spark, sf).selectExpr("user_id", "t", "event_id", "0 AS place", "event_type = 'signup' AS snap", *_CHANGE)
    out = replay.book_states(e, "user_id", ["t", "event_id"], "place", F.col("snap"), ["side", "price", "qty"], 4, DAY, levels=3)
    return out.select("user_id", "event_id", "status", "digits", "size", "cut")


@query(f"""WITH RECURSIVE m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, event_type = 'signup' AS snap, {", ".join(_CHANGE).replace("AS STRING", "AS VARCHAR")}, CASE WHEN c % 2 = 0 THEN -(k % 20) ELSE k % 20 END AS r, c % 4 AS q FROM e),
 g AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n, false AS anchored, []::STRUCT(r BIGINT, d VARCHAR)[] AS ask, []::STRUCT(r BIGINT, d VARCHAR)[] AS bid, false AS rejected FROM (SELECT DISTINCT user_id FROM m)
 UNION ALL SELECT user_id, event_id, n, CASE WHEN crossed AND snap THEN false ELSE anchored END, CASE WHEN crossed THEN CASE WHEN snap THEN [] ELSE old_ask END ELSE ask END, CASE WHEN crossed THEN CASE WHEN snap THEN [] ELSE old_bid END ELSE bid END, crossed FROM
 (SELECT *, anchored AND len(ask) > 0 AND len(bid) > 0 AND -bid[1].r >= ask[1].r AS crossed FROM
 (SELECT m.user_id, m.event_id, m.n, snap, anchored OR snap AS anchored, ask AS old_ask, bid AS old_bid, CASE WHEN side = 'ask' AND (anchored OR snap) THEN list_sort(list_filter(CASE WHEN snap THEN [] ELSE ask END, lambda x: x.r <> m.r) || CASE WHEN q > 0 THEN [{{'r': m.r, 'd': {_SHOWN % "price"} || {_SHOWN % "qty"}}}] ELSE [] END) WHEN snap THEN [] ELSE ask END AS ask,
 CASE WHEN side = 'bid' AND (anchored OR snap) THEN list_sort(list_filter(CASE WHEN snap THEN [] ELSE bid END, lambda x: x.r <> m.r) || CASE WHEN q > 0 THEN [{{'r': m.r, 'd': {_SHOWN % "price"} || {_SHOWN % "qty"}}}] ELSE [] END) WHEN snap THEN [] ELSE bid END AS bid FROM g JOIN m ON m.user_id = g.user_id AND m.n = g.n + 1)))
 SELECT user_id, event_id, CASE WHEN rejected THEN 'rejected' WHEN anchored THEN 'ok' ELSE 'unanchored' END AS status, CASE WHEN anchored AND NOT rejected THEN array_to_string(list_transform(ask[1:10], lambda x: x.d), '') || array_to_string(list_transform(bid[1:10], lambda x: x.d), '') END AS digits, CASE WHEN anchored THEN len(ask) + len(bid) END::INT AS size FROM g WHERE n > 0""")
def t9_messages_tried_on_a_copy(spark, sf):
    """Messages that would cross the book are rejected as a whole."""
    e = tape(spark, sf).selectExpr("user_id", "t", "event_id", "0 AS place", "event_type = 'signup' AS snap", *_CHANGE)
    out = replay.book_states(e, "user_id", ["t", "event_id"], "place", F.col("snap"), ["side", "price", "qty"], 100, DAY, atomic=True)
    return out.select("user_id", "event_id", "status", "digits", "size")


_ORDER = [
    "CASE WHEN k % 2 = 0 THEN 'bid' ELSE 'ask' END AS side", "concat(CAST(k % 12 AS STRING), '.0') AS price", "CAST(c % 5 AS STRING) AS qty",
    "CASE WHEN c % 7 < 4 THEN 'add' WHEN c % 7 < 6 THEN 'modify' ELSE 'delete' END AS event", "concat(CAST(k % 12 AS STRING), '-', CAST(c % 3 AS STRING)) AS id",
]


@query(f"""WITH RECURSIVE m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, event_type = 'signup' AS snap, {", ".join(_ORDER).replace("AS STRING", "AS VARCHAR")}, CASE WHEN k % 2 = 0 THEN -(k % 12) ELSE k % 12 END AS r FROM e),
 g AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n, false AS anchored, []::STRUCT(side VARCHAR, r BIGINT, ts BIGINT, n BIGINT, d VARCHAR, id VARCHAR)[] AS o, 0 AS refused, 0::BIGINT AS cut FROM (SELECT DISTINCT user_id FROM m)
 UNION ALL SELECT user_id, event_id, n, anchored, list_filter(o, lambda x: list_contains(list_sort(list_distinct(list_transform(list_filter(o, lambda y: y.side = x.side), lambda y: y.r)))[1:3], x.r)), refused,
 len(list_filter(o, lambda x: NOT list_contains(list_sort(list_distinct(list_transform(list_filter(o, lambda y: y.side = x.side), lambda y: y.r)))[1:3], x.r))) FROM (
 SELECT user_id, event_id, n, anchored, CASE WHEN NOT anchored OR NOT fits THEN o WHEN event = 'add' THEN o || [{{'side': side, 'r': r, 'ts': n, 'n': n, 'd': d, 'id': id}}] WHEN event = 'delete' THEN list_filter(o, lambda x: x.id <> p.id) ELSE list_transform(o, lambda x: CASE WHEN x.id = p.id THEN {{'side': x.side, 'r': x.r, 'ts': p.n, 'n': x.n, 'd': p.d, 'id': x.id}} ELSE x END) END AS o, (anchored AND NOT fits)::INT AS refused FROM (
 SELECT *, CASE WHEN event = 'add' THEN qty <> '0' AND len(list_filter(o, lambda x: x.id = q.id)) = 0 ELSE len(list_filter(o, lambda x: x.id = q.id AND x.side = q.side AND x.r = q.r)) = 1 AND (event = 'delete' OR qty <> '0') END AS fits FROM (
 SELECT m.user_id, m.event_id, m.n, anchored OR snap AS anchored, CASE WHEN snap THEN [] ELSE o END AS o, side, r, event, id, qty, {_SHOWN % "price"} || {_SHOWN % "qty"} AS d FROM g JOIN m ON m.user_id = g.user_id AND m.n = g.n + 1) q) p))
 SELECT user_id, event_id, CASE WHEN anchored THEN 'ok' ELSE 'unanchored' END AS status, CASE WHEN anchored THEN array_to_string(list_transform(list_sort(list_transform(list_filter(o, lambda x: x.side = 'ask'), lambda x: {{'r': x.r, 'ts': x.ts, 'n': x.n, 'd': x.d}})), lambda x: x.d), '') || array_to_string(list_transform(list_sort(list_transform(list_filter(o, lambda x: x.side = 'bid'), lambda x: {{'r': x.r, 'ts': x.ts, 'n': x.n, 'd': x.d}})), lambda x: x.d), '') END AS digits,
 CASE WHEN anchored THEN len(o) END::INT AS size, CASE WHEN anchored THEN cut END::INT AS cut, CASE WHEN anchored THEN refused END::INT AS refused FROM g WHERE n > 0""")
def t3_orders_at_each_message(spark, sf):
    """Orders added, modified and deleted by id, changes that fit no open order refused, three price levels a side."""
    e = ordered.with_previous(tape(spark, sf).selectExpr("user_id", "t", "event_id", "0 AS place", "event_type = 'signup' AS snap", *_ORDER), "user_id", ["t", "event_id"], ["side"], DAY)
    e = e.withColumn("time", F.lpad(F.col("ordinal").cast("string"), 12, "0"))
    out = replay.book_states(e, "user_id", ["t", "event_id"], "place", F.col("snap"), ["side", "price", "qty", "event", "id", "time"], 3, DAY, orders=True, strict=False)
    return out.select("user_id", "event_id", "status", "digits", "size", "cut", "refused")
