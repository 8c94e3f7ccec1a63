"""The payload views as queries, over records made from ``events`` by one text expression that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.plans.registry import query
from tapeloom.sources import read_table
from tapeloom.sources.views import MARKERS, VIEWS, View, build_markers, build_view, filled_quotes, order_lifecycle, subscription_events

#: Id of the inventory for each view.
IDS = dict(
    zip(VIEWS, "v2 v3 v4 v5 v9 v10 v11 v13 v14 v15 v16 v17 v18 v19 v20 v21 v22 v23 v24 v25 v26 v27 v28 v29 v30 v31 v32 v33 v34 v35 v36 v37".split(), strict=True)
)


def _value(kind: str, n: int, at: str = "", bare: bool = False) -> str:
    """A JSON value of field ``n`` as an expression of both engines; some are null. ``bare`` numbers stand without quotes, zeros at their end included."""
    if kind.startswith("raw:"):
        return kind[4:]
    number = f"(event_id * {n + 3} + user_id{at}) % 97"
    if kind == "boolean":
        shown = f"CASE WHEN {number} % 2 = 0 THEN 'true' ELSE 'false' END"
    elif kind == "long":
        shown = f"CAST({number} AS STRING)"
    else:
        mark = "" if bare else '"'
        shown = f"concat('{mark}', CAST({number} AS STRING), '.', CAST({number} % 7 AS STRING), '0{mark}')"
    return f"CASE WHEN (event_id + {n}) % 11 = 0 THEN 'null' ELSE {shown} END"


def _object(parts: list[tuple[str, str, str]], at: str = "", fixed: dict[str, str] | None = None, bare: bool = False) -> str:
    """An object with the fields at their paths as an expression of both engines."""
    tree: dict = {}
    for n, (_, path, kind) in enumerate(parts):
        if path in (fixed or {}):
            continue
        node = tree
        steps = path.replace("[", ".[").split(".")
        for step in steps[:-1]:
            node = node.setdefault(step, {})
        node[steps[-1]] = (kind, n)

    def text(node) -> list[str]:
        if isinstance(node, tuple):
            return [_value(*node, at, bare)]
        array = any(k.startswith("[") for k in node)
        out = ["'['" if array else "'{'"]
        for i, (k, v) in enumerate(node.items()):
            out += [f"'{', ' if i else ''}'" if array else f"'{', ' if i else ''}\"{k}\": '", *text(v)]
        return [*out, "']'" if array else "'}'"]

    pieces = text(tree)[:-1] if not fixed else ["'{'", *[f"'\"{k}\": ', {v}, ', '" for k, v in fixed.items()], "'\"z\": 0'", *(["', '"] if tree else []), *text(tree)[1:-1]]
    return "concat(" + ", ".join([*pieces, "'}'"]) + ")"


def payload(view: View, bare: bool = False) -> str:
    """The text of a marker or message of the view; with ``bare`` numbers, or with all of them quoted."""
    fixed = {}
    if view.source:
        fixed["raw_message_ordinal"] = "CAST(2 * event_id AS STRING)"
    if view.source.startswith("$"):
        other = "'\"market_batch\"'" if view.unsourced else "'\"elsewhere\"'"
        fixed[view.source[1:]] = f"CASE WHEN event_id % 13 = 0 THEN {other} WHEN event_id % 17 = 0 THEN '\"none\"' ELSE '\"feed\"' END"
    one, two = (_object(view.parts(True), f" + {k}", bare=bare) for k in (0, 40)) if view.events else ("", "")
    array = f"CASE event_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN concat('[', {one}, ']') ELSE concat('[', {one}, ', ', {two}, ']') END"
    if len(view.arrays()) > 1:
        sides = [("", path, f"raw:{array.replace('event_id % 3', f'(event_id + {k}) % 3')}") for k, (_, path) in enumerate(view.arrays())]
        return _object([*view.parts(), *sides], fixed=fixed, bare=bare)
    body = _object(view.parts(), fixed=fixed, bare=bare)
    if not view.events:
        return body
    return f"concat(substr({body}, 1, length({body}) - 1), {chr(39)}{', ' if view.parts() or fixed else ''}\"{view.events_at}\": {chr(39)}, {array}, '}}')"


def _lane(view: View) -> tuple[str, str, str, str]:
    """(channel of the record, direction, frame type, channel of the message) of generated records."""
    return view.channels[0], "local" if view.source else "inbound", "marker" if view.source else "text", "feed" if view.source.startswith("$") else view.source


def records_of(spark: SparkSession, sf_dir: str, view: View, bare: bool = True) -> DataFrame:
    """Raw records for a view: a record for each event, with bare numbers in its arrays' elements and fields, and for views of markers the message before it."""
    # Texts and their parsing cost far more than the two numbers that they are made of: those are spread over all cores, however few splits the file has.
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id").repartition(2 * spark.sparkContext.defaultParallelism, "event_id")
    channel, direction, frame, source = _lane(view)

    def made(text: str, ordinal: str, channel: str, direction: str, frame: str) -> DataFrame:
        held = e.select(F.expr("CAST(user_id % 5 AS STRING)").alias("session_id"), F.expr(ordinal).alias("message_ordinal"), F.expr(text).alias("text"))
        return held.select(
            F.lit(1).alias("schema_version"), F.lit(view.venue).alias("venue"), F.lit(view.product).alias("product"), F.lit(channel).alias("channel"), "session_id", "message_ordinal",
            (F.col("message_ordinal") * 1000).alias("received_utc_ns"), (F.col("message_ordinal") * 10).alias("received_monotonic_ns"), F.lit(direction).alias("direction"), F.lit(frame).alias("frame_type"),
            F.lit("utf-8").alias("payload_encoding"), F.encode("text", "UTF-8").alias("payload_bytes"), F.sha2("text", 256).alias("payload_sha256"),
        )

    own = made(payload(view, bare), "2 * event_id + 1", channel, direction, frame)
    return own.unionByName(made("concat('{\"n\": ', CAST(event_id AS STRING), '}')", "2 * event_id", source, "inbound", "text")) if source else own


def _field(root: str, path: str, kind: str) -> str:
    found = f"json_extract_string({root}, '$.{path}')"
    return found if kind == "string" else f"TRY_CAST({found} AS {'BIGINT' if kind == 'long' else 'BOOLEAN'})"


def view_sql(view: View) -> str:
    """The same view written out with the JSON functions of SQL."""
    _, _, _, source = _lane(view)
    fixed = "".join(f", '{v}' AS {k}" for k, v in view.constants.items())
    fields = "".join(f", {_field('p', path, kind)} AS {name}" for name, path, kind in view.parts())
    events = "".join(f", {_field('x', path, kind)} AS {name}" for name, path, kind in view.parts(True))
    position = f", i - 1 AS {view.position}" if view.position else ""
    heads = "CAST(user_id % 5 AS VARCHAR) AS session_id, 2 * event_id + 1 AS "
    if view.source:
        heads += "normalization_message_ordinal, 2 * event_id AS raw_message_ordinal, received_utc_ns, received_monotonic_ns, frame_type, payload_sha256"
    else:
        heads += "message_ordinal, (2 * event_id + 1) * 1000 AS received_utc_ns, (2 * event_id + 1) * 10 AS received_monotonic_ns"
    rows = f"WITH r AS (SELECT event_id, user_id, {payload(view)} AS p FROM events)"
    if view.source:
        rows += ", s AS (SELECT event_id AS of_event, 2000 * event_id AS received_utc_ns, 20 * event_id AS received_monotonic_ns, 'text' AS frame_type, sha256(concat('{\"n\": ', CAST(event_id AS VARCHAR), '}')) AS payload_sha256 FROM events)"
    table = "r"
    if len(view.arrays()) > 1:
        sides = [f"SELECT event_id, user_id, p, '{side}' AS side, unnest(json_extract(p, '$.{path}[*]')) AS x, generate_subscripts(json_extract(p, '$.{path}[*]'), 1) AS i FROM r" for side, path in view.arrays()]
        rows += f", x AS ({' UNION ALL '.join(sides)})"
        table, events = "x", f", side{events}"
    elif view.events:
        empty = " UNION ALL SELECT event_id, user_id, p, NULL, NULL FROM r WHERE json_array_length(p, '$." + view.events_at + "') = 0" if view.keep_empty else ""
        rows += f", x AS (SELECT event_id, user_id, p, unnest(json_extract(p, '$.{view.events_at}[*]')) AS x, generate_subscripts(json_extract(p, '$.{view.events_at}[*]'), 1) AS i FROM r{empty})"
        table = "x"
    fixed += f", p AS {view.whole}" if view.whole else ""
    out = f"{rows} SELECT {heads}{fixed}{fields}{position}{events} FROM {table}"
    if view.source:
        channel = f"json_extract_string(p, '$.{view.source[1:]}')"
        on = "of_event = event_id" + (f" AND {channel} = '{source}'" if view.source.startswith("$") else "")
        out += f" {'LEFT ' if view.unsourced else ''}JOIN s ON {on}"
        if view.unsourced:
            out += f" WHERE of_event IS NOT NULL OR coalesce({channel} NOT IN ({', '.join(repr(c) for c in view.unsourced)}), true)"
    return out


def _register(name: str, view: View) -> None:
    query(view_sql(view), f"{IDS[name]}_{name}")(lambda spark, sf: build_view(records_of(spark, sf, view), view))


for _name, _view in VIEWS.items():
    _register(_name, _view)


@query(f"SELECT * FROM ({view_sql(VIEWS['l2'])}) WHERE side = 'bid'")
def v4_l2_bids(spark, sf):
    """The bids of the level view."""
    return build_view(records_of(spark, sf, VIEWS["l2"]), VIEWS["l2"]).where("side = 'bid'")


@query(f"""WITH p AS (SELECT event_id, user_id, {payload(VIEWS["kraken_spot_trades"])} AS own, concat('{{"n": ', CAST(event_id AS VARCHAR), '}}') AS message FROM events)
 SELECT CAST(user_id % 5 AS VARCHAR) AS session_id, 2 * event_id + 1 AS message_ordinal, 'normalized_trade' AS channel, 'local' AS direction, 'marker' AS frame_type, 1000 * (2 * event_id + 1) AS received_utc_ns, own AS payload, sha256(own) AS payload_sha256 FROM p
 UNION ALL SELECT CAST(user_id % 5 AS VARCHAR), 2 * event_id, 'trade', 'inbound', 'text', 2000 * event_id, message, sha256(message) FROM p""")
def v1_raw_records(spark, sf):
    """All raw records, markers and messages, as they stand."""
    r = records_of(spark, sf, VIEWS["kraken_spot_trades"], bare=False)
    return r.select("session_id", "message_ordinal", "channel", "direction", "frame_type", "received_utc_ns", F.decode("payload_bytes", "UTF-8").alias("payload"), "payload_sha256")


@query(f"""SELECT *, row_number() OVER w AS observation_index, lag(event) OVER w AS previous_event, lag(order_quantity) OVER w AS previous_order_quantity FROM ({view_sql(VIEWS["kraken_spot_l3_order_events"])}) v
 WINDOW w AS (PARTITION BY session_id, order_id ORDER BY raw_message_ordinal, data_index NULLS FIRST, wire_order NULLS LAST)""")
def v12_kraken_spot_l3_order_lifecycle(spark, sf):
    view = VIEWS["kraken_spot_l3_order_events"]
    return order_lifecycle(build_view(records_of(spark, sf, view), view))


_FILLED = ", ".join(f"last_value({c}_update IGNORE NULLS) OVER w AS {c}" for c in ("bid_price", "bid_quantity", "ask_price", "ask_quantity", "last_price"))


def _register_filled(key: str, name: str) -> None:
    view = VIEWS[name]
    sql = f"SELECT *, bid_price IS NOT NULL AND ask_price IS NOT NULL AS bbo_complete FROM (SELECT *, {_FILLED} FROM ({view_sql(view)}) v WINDOW w AS (PARTITION BY session_id ORDER BY raw_message_ordinal ROWS UNBOUNDED PRECEDING))"
    query(sql, key)(lambda spark, sf: filled_quotes(build_view(records_of(spark, sf, view), view)))


_register_filled("v18_bitvavo_spot_bbo", "bitvavo_spot_quotes")
_register_filled("v22_bitvavo_mdpro_spot_bbo", "bitvavo_mdpro_spot_quotes")


def _register_marker(key: str, name: str) -> None:
    view = MARKERS[name]
    made = View("any", "any", view.channels, view.fields)
    fields = "".join(f", {_field('p', path, kind)} AS {n}" for n, path, kind in view.parts())
    sql = f"SELECT CAST(user_id % 5 AS VARCHAR) AS session_id, 2 * event_id + 1 AS message_ordinal, (2 * event_id + 1) * 1000 AS received_utc_ns, (2 * event_id + 1) * 10 AS received_monotonic_ns{fields}, p AS marker_json FROM (SELECT event_id, user_id, {payload(made)} AS p FROM events)"

    def run(spark, sf):
        local = records_of(spark, sf, made, bare=False).withColumns({"direction": F.lit("local"), "frame_type": F.lit("marker")})
        return build_markers(local, view)

    query(sql, key)(run)


_register_marker("v6_sessions", "sessions")
_register_marker("v8_data_quality_events", "data_quality_events")

_SUBSCRIBED = "CASE event_id % 4 WHEN 0 THEN concat('{\"subscription_type\": \"', event_type, '\", \"event\": \"sent\"}') WHEN 1 THEN concat('{\"data\": {\"subscription\": {\"type\": \"', event_type, '\"}}}') WHEN 2 THEN concat('{\"args\": [{\"channel\": \"', event_type, '\"}]}') ELSE '{\"x\": 1}' END"


@query(f"""SELECT CAST(user_id % 5 AS VARCHAR) AS session_id, event_id AS message_ordinal, d AS direction, CASE d WHEN 'local' THEN json_extract_string(p, '$.event') WHEN 'outbound' THEN 'subscription_payload_sent' ELSE 'subscription_response_received' END AS event,
 coalesce(json_extract_string(p, '$.subscription_type'), json_extract_string(p, '$.data.subscription.type'), json_extract_string(p, '$.args[0].channel')) AS subscription_type, p AS payload_text
 FROM (SELECT *, {_SUBSCRIBED} AS p, CASE event_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'outbound' ELSE 'inbound' END AS d FROM events)""")
def v7_subscription_events(spark, sf):
    e = read_table(spark, sf, "events")
    r = e.select(
        F.lit("subscription").alias("channel"), F.expr("CAST(user_id % 5 AS STRING)").alias("session_id"), F.col("event_id").alias("message_ordinal"), F.lit(0).alias("received_utc_ns"), F.lit(0).alias("received_monotonic_ns"),
        F.expr("CASE event_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'outbound' ELSE 'inbound' END").alias("direction"), F.lit("text").alias("frame_type"), F.encode(F.expr(_SUBSCRIBED), "UTF-8").alias("payload_bytes"),
    )
    return subscription_events(r).drop("received_utc_ns", "received_monotonic_ns", "frame_type")
