"""Typed views over raw records: one declaration a view, one builder.

A raw record is a message as it was received, or a marker that a collector wrote beside it (``direction`` local,
``frame_type`` marker) with the number of the message it was made from. A view takes the records of its channels, parses their
payload once with a declared schema, joins markers to their message, and gives a row for each record or for each element of an
array in it. Conditions on venue, product, channel and direction reach the scan of both sides; prices stay text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tapeloom.operators.ordered import running, with_previous

#: Columns of a raw record.
RECORD = (
    "schema_version int, venue string, product string, channel string, session_id string, message_ordinal long, received_utc_ns long,"
    " received_monotonic_ns long, direction string, frame_type string, payload_encoding string, payload_bytes binary, payload_sha256 string"
)
#: Messages of a session that are gone through in one task.
MESSAGES = 100_000
_TYPES = {"long": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType()}


@dataclass(frozen=True)
class View:
    """A view: fields are ``name``, ``name=path`` or ``name:type``; a path has names, dots and [numbers]."""

    venue: str
    product: str
    channels: tuple[str, ...]
    fields: str
    #: Fields of an element of the array at ``events_at``, given out with its number under ``position`` if named. Several arrays, one a side, are ``bid=path|ask=path``.
    events: str = ""
    events_at: str = "events"
    position: str = ""
    #: A record without elements gives a row of nulls.
    keep_empty: bool = False
    #: Channel of the message that a marker was made from, "$name" if the payload names it; empty for views of messages.
    source: str = ""
    #: Records whose payload names none of these channels need no message.
    unsourced: tuple[str, ...] = ()
    constants: dict[str, str] = field(default_factory=dict)
    #: Name under which the whole payload is given out as text, if any.
    whole: str = ""

    def parts(self, events: bool = False) -> list[tuple[str, str, str]]:
        """(name, path, type) of the fields, or of those of an element."""
        out = []
        for item in (self.events if events else self.fields).split():
            name, _, kind = item.partition(":")
            name, _, path = name.partition("=")
            out.append((name, path or name, kind or "string"))
        return out


    def arrays(self) -> list[tuple[str, str]]:
        """(side, path) of the arrays with elements; the side is empty if there is one array only."""
        return [tuple(x.split("=")) if "=" in x else ("", x) for x in self.events_at.split("|")] if self.events else []


#: What goes before a number outside strings, with whole strings in it, and the number. No step back is ever taken, so it is linear.
_BARE = r'\G((?:[^"0-9-]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)(-?[0-9][0-9.eE+-]*+)'


def quoted_numbers(text: Column) -> Column:
    """JSON with its bare numbers quoted as they stand, so that a parser into texts keeps every digit (``2.10``, ``5.00000000``)."""
    return F.regexp_replace(text, _BARE, '$1"$2"')


def _parsed(text: Column, schema: T.StructType) -> Column:
    """A payload parsed once: behind a generator no later filter, join or field makes the parser run again."""
    return F.explode(F.array(F.from_json(quoted_numbers(text), schema)))


def _schema(parts: list[tuple[str, str, str]], arrays: list[str] = (), element: T.StructType | None = None) -> T.StructType:
    """What a payload is parsed into: every leaf as text, so that no digit of a number is lost."""
    tree: dict = {}
    for path in [p for _, p, _ in parts] + list(arrays):
        at = tree
        for step in path.replace("[", ".[").split("."):
            at = at.setdefault("[]" if step.startswith("[") else step, {})
    for path in arrays:
        at = tree
        for step in path.replace("[", ".[").split("."):
            at = at["[]" if step.startswith("[") else step]
        at["[]"] = element

    def typed(node) -> T.DataType:
        if isinstance(node, T.DataType):
            return node
        if not node:
            return T.StringType()
        return T.ArrayType(typed(node["[]"])) if "[]" in node else T.StructType([T.StructField(k, typed(v)) for k, v in node.items()])

    return typed(tree)


def _at(root: Column, path: str) -> Column:
    for step in path.replace("[", ".[").split("."):
        root = F.get(root, int(step[1:-1])) if step.startswith("[") else root[step]
    return root


def _picked(root: Column, parts: list[tuple[str, str, str]]) -> list[Column]:
    return [(_at(root, path) if kind == "string" else _at(root, path).try_cast(_TYPES[kind])).alias(name) for name, path, kind in parts]


def _elements(view: View) -> Column:
    """The elements of all arrays of a view, each with its side and its place in its own array."""

    def placed(side: str, path: str) -> Column:
        return F.transform(_at(F.col("__p"), path), lambda x, i: F.struct(F.lit(side).alias("side"), i.alias("position"), x.alias("event")))

    made = [placed(side, path) for side, path in view.arrays()]
    return made[0] if len(made) == 1 else F.concat(*[F.coalesce(m, F.array().cast("array<struct<side:string,position:int,event:" + _schema(view.parts(True)).simpleString() + ">>")) for m in made])


def build_view(records: DataFrame, view: View) -> DataFrame:
    """The rows of a view over raw records. A malformed payload has null fields and no elements; a marker whose message is not there is left out."""
    own = records.where(F.col("channel").isin(*view.channels) & (F.col("direction") == ("local" if view.source else "inbound")))
    if view.venue:
        own = own.where((F.col("venue") == view.venue) & (F.col("product") == view.product))
    if view.source:
        own = own.where("frame_type = 'marker'")
    element = _schema(view.parts(True)) if view.events else None
    needed = view.parts() + ([("__source", view.source[1:], "string")] if view.source.startswith("$") else [])
    needed += [("__raw", "raw_message_ordinal", "string")] if view.source else []
    schema = _schema(needed, [path for _, path in view.arrays()], element)
    parsed = own.withColumn("__p", _parsed(F.decode("payload_bytes", "UTF-8"), schema))
    fixed = [F.lit(v).alias(k) for k, v in view.constants.items()]
    if view.source:
        heads = ["session_id", F.col("message_ordinal").alias("normalization_message_ordinal"), F.col("__p.raw_message_ordinal").try_cast("long").alias("raw_message_ordinal")]
    else:
        heads = ["session_id", "message_ordinal", "received_utc_ns", "received_monotonic_ns"]
    channel = [_at(F.col("__p"), view.source[1:]).alias("__channel")] if view.source.startswith("$") else []
    whole = [F.decode("payload_bytes", "UTF-8").alias(view.whole)] if view.whole else []
    rows = parsed.select(*heads, *fixed, *channel, *whole, *_picked(F.col("__p"), view.parts()), *([_elements(view).alias("__events")] if element else []))
    if element:
        explode = F.explode_outer if view.keep_empty else F.explode
        rows = rows.select(*[c for c in rows.columns if c != "__events"], explode("__events").alias("__x"))
        place = [F.col("__x.position").cast("long").alias(view.position)] if view.position else []
        place += [F.col("__x.side").alias("side")] if len(view.arrays()) > 1 else []
        rows = rows.select(*[c for c in rows.columns if not c.startswith("__") or c == "__channel"], *place, *_picked(F.col("__x.event"), view.parts(True)))
    if not view.source:
        return rows
    message = records.where((F.col("venue") == view.venue) & (F.col("product") == view.product) & (F.col("direction") == "inbound"))
    if not channel:
        message = message.where(F.col("channel") == view.source)
    message = message.select(
        F.col("session_id").alias("__session"), F.col("message_ordinal").alias("__ordinal"), F.col("channel").alias("__of"), "received_utc_ns", "received_monotonic_ns", "frame_type", "payload_sha256"
    )
    met = (F.col("session_id") == F.col("__session")) & (F.col("raw_message_ordinal") == F.col("__ordinal"))
    if channel:
        met = met & (F.col("__channel") == F.col("__of"))
    joined = rows.join(message, met, "left" if view.unsourced else "inner")
    if view.unsourced:
        joined = joined.where(F.col("__ordinal").isNotNull() | ~F.coalesce(F.col("__channel").isin(*view.unsourced), F.lit(False)))
    return joined.drop("__session", "__ordinal", "__of", "__channel")


def order_lifecycle(orders: DataFrame) -> DataFrame:
    """Order events with their number within the order, and the event and quantity before."""
    held = orders.withColumns({"__order": F.struct("session_id", "order_id"), "__last": F.col("wire_order").isNull()})
    found = with_previous(held, "__order", ["raw_message_ordinal", "data_index", "__last", "wire_order"], ["event", "order_quantity"], MESSAGES)
    return found.select(*orders.columns, F.col("ordinal").cast("long").alias("observation_index"), "previous_event", "previous_order_quantity")


def filled_quotes(updates: DataFrame) -> DataFrame:
    """Partial quote updates (``*_update``) with the last known values of their session, and whether both sides are known."""
    lasts = {c.removesuffix("_update"): F.col(c) for c in updates.columns if c.endswith("_update")}
    out = running(updates, "session_id", ["raw_message_ordinal", "normalization_message_ordinal"], MESSAGES, lasts=lasts)
    return out.withColumn("bbo_complete", F.col("bid_price").isNotNull() & F.col("ask_price").isNotNull())


def subscription_events(records: DataFrame) -> DataFrame:
    """What was subscribed and answered, under whichever of the known paths a venue names it."""
    own, text = records.where(F.col("channel").isin("subscription", "subscriptionResponse")), F.decode("payload_bytes", "UTF-8")
    event = F.when(F.col("direction") == "local", F.get_json_object(text, "$.event")).when(F.col("direction") == "outbound", "subscription_payload_sent").otherwise("subscription_response_received")
    kinds = [F.get_json_object(text, p) for p in ("$.subscription_type", "$.subscription.type", "$.data.subscription.type", "$.arg.channel", "$.args[0].channel")]
    return own.select("session_id", "message_ordinal", "received_utc_ns", "received_monotonic_ns", "direction", "frame_type", event.alias("event"), F.coalesce(*kinds).alias("subscription_type"), text.alias("payload_text"))


# Venues, products, channels and field names of the recorded formats.
_LEVEL = "wire_order:long side side_index:long action price quantity"
_HL, _KR, _OKX = ("hyperliquid", "BTC-PERP"), ("kraken", "BTC/USD"), ("okx", "BTC-USDT-SWAP")
_BV, _BN, _BNU = ("bitvavo", "BTC-EUR"), ("binance", "BTCUSDT-SPOT"), ("binance", "BTCUSDT-USDS-M-PERPETUAL")
_DB, _PM, _CB = ("deribit", "BTC-DERIVATIVES"), ("polymarket", "BTC-CRYPTO-RESEARCH"), ("coinbase", "BTC-USD")
_QUOTE = "market bid_price_update=bid_price bid_quantity_update=bid_quantity ask_price_update=ask_price ask_quantity_update=ask_quantity last_price_update=last_price"
_FILL = "event_index:long market trade_id price quantity taker_side event_time_ms event_time_ns"
VIEWS = {
    "trades": View(*_HL, ("trades",), "", "coin side price=px size=sz hash event_time_ms=time trade_id=tid buyer=users[0] seller=users[1]", "data", "event_index"),
    "bbo": View(
        *_HL, ("bbo",),
        "coin=data.coin event_time_ms=data.time bid_price=data.bbo[0].px bid_size=data.bbo[0].sz bid_order_count=data.bbo[0].n ask_price=data.bbo[1].px ask_size=data.bbo[1].sz ask_order_count=data.bbo[1].n",
    ),
    "l2": View(*_HL, ("l2Book",), "coin=data.coin event_time_ms=data.time", "price=px size=sz order_count=n", "bid=data.levels[0]|ask=data.levels[1]", "level_index"),
    "derivative_context": View(
        *_HL, ("activeAssetCtx",),
        "coin=data.coin funding=data.ctx.funding open_interest=data.ctx.openInterest oracle_price=data.ctx.oraclePx mark_price=data.ctx.markPx mid_price=data.ctx.midPx previous_day_price=data.ctx.prevDayPx day_notional_volume=data.ctx.dayNtlVlm",
    ),
    "kraken_spot_trades": View(*_KR, ("normalized_trade",), "message_type", "event_index:long symbol side price quantity=qty order_type trade_id event_timestamp=timestamp", source="trade"),
    "kraken_spot_l2_events": View(
        *_KR, ("normalized_book",), "message_type symbol message_timestamp checksum", "data_index:long wire_order:long side side_index:long action price quantity=qty", source="book"
    ),
    "kraken_spot_l3_order_events": View(
        *_KR, ("normalized_level3",), "message_type symbol message_timestamp checksum",
        "data_index:long wire_order:long side side_index:long event event_source order_id limit_price order_quantity=order_qty order_timestamp=timestamp", source="level3",
    ),
    "okx_swap_trades": View(*_OKX, ("normalized_trades-all",), "", "event_index:long instrument_id trade_id price quantity side source event_time_ms", source="trades-all"),
    "okx_swap_bbo": View(*_OKX, ("normalized_bbo-tbt",), "instrument_id event_time_ms seq_id", "wire_order:long side side_index:long price quantity order_count", source="bbo-tbt"),
    "okx_swap_l2_events": View(
        *_OKX, ("normalized_books",), "instrument_id message_type event_time_ms checksum_wire prev_seq_id seq_id sequence_event", _LEVEL + " order_count", keep_empty=True, source="books"
    ),
    "okx_swap_derivative_context": View(
        *_OKX, ("normalized_context",),
        "source_channel context_type instrument_id event_time_ms funding_rate next_funding_rate funding_time_ms next_funding_time_ms premium open_interest_contracts open_interest_currency open_interest_usd mark_price index_price",
        source="$source_channel",
    ),
    "bitvavo_spot_trades": View(*_BV, ("normalized_trades",), "", _FILL, source="trades", constants={"feed_product": "standard"}),
    "bitvavo_spot_quotes": View(*_BV, ("normalized_ticker",), _QUOTE, source="ticker", constants={"feed_product": "standard"}),
    "bitvavo_spot_l2_events": View(
        *_BV, ("normalized_book",), "source_channel market message_type nonce venue_timestamp_ns sequence_event", _LEVEL, keep_empty=True, source="$source_channel", constants={"feed_product": "standard"}
    ),
    "bitvavo_mdpro_spot_l2_events": View(
        *_BV, ("normalized_mdpro_book",), "source_channel market message_type deprecated_nonce venue_timestamp_ns sequence_start sequence_end sequence_event", _LEVEL,
        source="$source_channel", constants={"feed_product": "market_data_pro"},
    ),
    "bitvavo_mdpro_spot_trades": View(*_BV, ("normalized_mdpro_trades",), "", _FILL, source="mdpro_trades", constants={"feed_product": "market_data_pro"}),
    "bitvavo_mdpro_spot_quotes": View(*_BV, ("normalized_mdpro_ticker",), _QUOTE, source="mdpro_ticker", constants={"feed_product": "market_data_pro"}),
    "binance_spot_trades": View(
        *_BN, ("normalized_spot_trade",), "symbol trade_id price quantity exchange_event_time trade_time timestamp_unit buyer_was_maker:boolean aggressor_side", source="$source_channel"
    ),
    "binance_spot_bbo": View(*_BN, ("normalized_spot_bbo",), "symbol update_id bid_price bid_quantity ask_price ask_quantity", source="$source_channel"),
    "binance_spot_l2_events": View(
        *_BN, ("normalized_spot_depth",), "source_channel message_type symbol exchange_event_time last_update_id first_update_id final_update_id sequence_event", _LEVEL, keep_empty=True, source="$source_channel"
    ),
    "binance_usdm_context": View(
        *_BNU, ("normalized_usdm_context",),
        "source_channel context_type symbol exchange_event_time transaction_time update_id aggregate_trade_id first_trade_id last_trade_id price quantity normal_quantity bid_price bid_quantity"
        " ask_price ask_quantity mark_price index_price estimated_settle_price mark_moving_average funding_rate next_funding_time open_interest side order_type time_in_force order_status average_price"
        " last_filled_quantity accumulated_filled_quantity buyer_was_maker:boolean aggressor_side rpi_excluded:boolean incomplete_snapshot:boolean",
        source="$source_channel",
    ),
    "deribit_btc_trades": View(
        *_DB, ("normalized_trades",), "source_channel",
        "wire_order:long trade_seq trade_id direction price amount event_time_ms tick_direction index_price mark_price contracts liquidation implied_volatility=iv", source="$source_channel",
    ),
    "deribit_btc_l2_events": View(
        *_DB, ("normalized_book",), "source_channel instrument_name message_type event_time_ms change_id prev_change_id", _LEVEL, source="$source_channel"
    ),
    "deribit_btc_derivative_context": View(
        *_DB, ("normalized_derivative_ticker", "normalized_index", "normalized_dvol"),
        "source_channel instrument_name instrument_kind index_name event_time_ms state mark_price index_price open_interest current_funding funding_8h best_bid_price best_bid_amount best_ask_price best_ask_amount volatility",
        source="$source_channel",
    ),
    "deribit_btc_option_sample": View(
        *_DB, ("normalized_option_ticker",),
        "source_channel instrument_name expiry_code strike option_type event_time_ms state underlying_index underlying_price mark_price mark_iv bid_iv ask_iv best_bid_price best_bid_amount best_ask_price best_ask_amount"
        " open_interest delta=greeks.delta gamma=greeks.gamma vega=greeks.vega theta=greeks.theta rho=greeks.rho",
        source="$source_channel",
    ),
    "polymarket_crypto_market_metadata": View(
        *_PM, ("normalized_market_metadata",),
        "record_type source_channel frame_wire_order:long event_id market_id market slug question end_time active:boolean closed:boolean enable_order_book:boolean accepting_orders:boolean neg_risk:boolean outcome_index outcome asset_id"
        " tick_size min_order_size old_tick_size new_tick_size timestamp_ms metadata_origin",
        source="$source_frame_channel", unsourced=("tick_size_change", "market_batch"),
    ),
    "polymarket_crypto_l2_events": View(
        *_PM, ("normalized_l2",), "source_channel frame_wire_order:long market asset_id message_type timestamp_ms frame_hash=opaque_hash",
        "wire_order:long side side_index:long action price size opaque_hash", source="$source_frame_channel",
    ),
    "polymarket_crypto_bbo": View(*_PM, ("normalized_bbo",), "source_channel frame_wire_order:long market asset_id best_bid best_ask spread timestamp_ms", source="$source_frame_channel"),
    "polymarket_crypto_last_trade_prices": View(
        *_PM, ("normalized_last_trade_price",), "frame_wire_order:long market asset_id price size fee_rate_bps side timestamp_ms transaction_hash complete_trade_tape:boolean", source="$source_frame_channel"
    ),
    "coinbase_public_events": View(*_CB, ("normalized",), "", source="$feed_product", whole="normalized"),
    "coinbase_spot_trades": View(*_CB, ("normalized_trade",), "trade_id price size maker_side aggressor_side event_time", source="$feed_product"),
    "coinbase_spot_l2_events": View(*_CB, ("normalized_l2",), "action event_time", "side price size", "levels", source="$feed_product"),
}
MARKERS = {
    "sessions": View("", "", ("session",), "event reason previous_session_id"),
    "data_quality_events": View("", "", ("data_quality",), "event reason raw_message_ordinal"),
}


def build_markers(records: DataFrame, view: View) -> DataFrame:
    """Local markers of any venue, with their text."""
    own = records.where(F.col("channel").isin(*view.channels) & (F.col("direction") == "local") & (F.col("frame_type") == "marker")).withColumn("marker_json", F.decode("payload_bytes", "UTF-8"))
    return own.withColumn("__p", _parsed(F.col("marker_json"), _schema(view.parts()))).select("session_id", "message_ordinal", "received_utc_ns", "received_monotonic_ns", *_picked(F.col("__p"), view.parts()), "marker_json")
