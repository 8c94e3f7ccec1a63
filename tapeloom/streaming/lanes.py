"""Lanes of a stream watched with state and event-time timers: late rows, chains of numbers, silences.

State is a value or two a lane. Lanes are dealt by hash to SHARDS groups, each with the values of its lanes as one state, so a micro-batch takes a call and a state
read and written for each shard, not for each lane. A shard has one timer, ``expiry`` beyond the lane of it that has been quiet for longest; lanes drop out
of the state once the watermark is there, so those that have ended don't pile up. What is given out is the same whether a timer or the lane's next row finds the silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.sources import work_dir

#: Groups that lanes are dealt to.
SHARDS = 1024
#: Rows of a stage of a feed for each of its files.
FILE_ROWS = 200_000
#: Before any time.
_NEVER = -(1 << 62)


def _millis(time: str) -> Column:
    return F.unix_millis(F.col(time))


def _dealt(stream: DataFrame, key: str, time: str) -> DataFrame:
    """With ``lane_text``, the key as a text (empty for null), its shard, and the time in milliseconds; rows reach a processor as named tuples, whose names begin with a letter."""
    lane = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    return stream.withColumns({"lane_text": lane, "at_ms": _millis(time)}).withColumn("lane_shard", F.pmod(F.xxhash64("lane_text"), F.lit(SHARDS)))


def _key_of(kind: str) -> Column:
    return F.when(F.col("lane_text") != "", F.expr("substr(lane_text, 2)")).cast(kind)


class _Late(StatefulProcessor):
    """Marks rows that are further behind the latest of their lane than is allowed."""

    def __init__(self, order: str, columns: list[str], allowed: int):
        self.order, self.columns, self.allowed = order, columns, allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "lane array<string>, at array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = pd.concat(list(rows)).sort_values(["lane_text", self.order], kind="stable")
        known = self.latest.get()
        before = dict(zip(known[0], known[1], strict=True)) if known else {}
        reached = held["at_ms"].groupby(held["lane_text"]).cummax()
        prior = reached.groupby(held["lane_text"]).shift().fillna(_NEVER).astype("int64").clip(lower=held["lane_text"].map(before).fillna(_NEVER).astype("int64"))
        for lane, at in reached.groupby(held["lane_text"]).max().items():
            before[lane] = max(int(at), before.get(lane, _NEVER))
        self.latest.update((list(before), list(before.values())))
        yield held[self.columns].assign(late=(held["at_ms"] < prior - self.allowed).to_numpy())

    def close(self) -> None:
        pass


class _Chain(StatefulProcessor):
    """The last number and time of each lane, until the lane has been silent for too long."""

    def __init__(self, number: str, order: str, rows: str, expiry: int):
        self.number, self.order, self.rows, self.expiry = number, order, rows, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "lane array<string>, number array<bigint>, at array<bigint>")

    def _known(self) -> dict[str, tuple]:
        known = self.last.get()
        return {lane: (n, at) for lane, n, at in zip(*known, strict=True)} if known else {}

    def _keep(self, known: dict[str, tuple]) -> None:
        """Keep the lanes as they are, and set the timer of the one that is quiet for longest."""
        if not known:
            self.last.clear()
            return
        self.last.update((list(known), [n for n, _ in known.values()], [at for _, at in known.values()]))
        self.handle.registerTimer(self._due(known))

    def _due(self, known: dict[str, tuple]) -> int:
        return min(at for _, at in known.values()) + self.expiry + 1

    def _out(self, lanes, rows, states, quiet) -> pd.DataFrame:
        return pd.DataFrame({"lane_text": lanes, self.rows: pd.array(rows, "Int64"), "state": states, "quiet_from": pd.array(quiet, "Int64")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = pd.concat(list(rows)).sort_values(["lane_text", "at_ms", self.order], kind="stable")
        known = self._known()
        if known:
            self.handle.deleteTimer(self._due(known))
        lane, at = held["lane_text"], held["at_ms"].to_numpy()
        number = held[self.number].astype("Int64")
        first = (lane != lane.shift()).to_numpy()
        # The number and time before each row: of the row before it in its lane, or of the state.
        state_at = lane.map({k: v[1] for k, v in known.items()}).astype("Int64")
        state_n = lane.map({k: v[0] for k, v in known.items()}).astype("Int64")
        last_n = number.shift().where(~first, state_n)
        last_at = np.maximum(np.where(first, _NEVER, np.r_[_NEVER, at[:-1]]), state_at.fillna(_NEVER).to_numpy("int64"))
        there = last_at != _NEVER
        silent = there & (at - np.where(there, last_at, at) > self.expiry)
        is_true = lambda c: c.fillna(False).to_numpy(bool)
        state = np.select([~there | silent, is_true(number == last_n + 1), is_true(number == last_n), is_true(number > last_n)], ["start", "next", "repeat", "gap"], "back")
        ends = np.r_[first[1:], True]
        tops = np.maximum(at, last_at)
        known |= {k: (None if pd.isna(n) else int(n), int(t)) for k, n, t in zip(lane[ends], number[ends], tops[ends], strict=True)}
        self._keep(known)
        yield self._out(lane.to_numpy(), held[self.rows].to_numpy(), state, [None] * len(held))
        if silent.any():
            n = int(silent.sum())
            yield self._out(lane.to_numpy()[silent], [None] * n, ["silent"] * n, last_at[silent])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, now = self._known(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        gone = {k: at for k, (_, at) in known.items() if at + self.expiry + 1 <= now}
        self._keep({k: v for k, v in known.items() if k not in gone})
        yield self._out(list(gone), [None] * len(gone), ["silent"] * len(gone), list(gone.values()))

    def close(self) -> None:
        pass


def with_lateness(stream: DataFrame, key: str, time: str, order: str, allowed_ms: int) -> DataFrame:
    """All rows, with ``late``: more than ``allowed_ms`` behind the latest row of the lane that came before; nothing is dropped, so late rows can be counted and kept aside.

    Rows of a micro-batch count in the order of ``order``, later batches after them.
    """
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    others = [c for c in stream.columns if c != key]
    kinds = ", ".join(f"`{c}` {types[c]}" for c in others)
    found = _dealt(stream, key, time).drop(key).groupBy("lane_shard").transformWithStateInPandas(_Late(order, ["lane_text", *others], allowed_ms), f"`lane_text` string, {kinds}, late boolean", "append", "none")
    return found.withColumn(key, _key_of(types[key])).select(*stream.columns, "late")


def chained_until_silent(stream: DataFrame, key: str, number: str, time: str, order: str, rows: str, expiry_ms: int, lateness: str) -> DataFrame:
    """For each row whether its number follows the one before it in its lane (``start``, ``next``, ``repeat``, ``gap``, ``back``), and a row ``silent``, with ``quiet_from``
    in milliseconds, for each stretch without rows that is longer than ``expiry_ms``; after it the lane starts anew.

    A silence at the end of a lane is told once the watermark (``lateness`` behind the latest row of all) is past it. Rows behind the watermark are left out.
    """
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    held = _dealt(stream, key, time).withWatermark(time, lateness)
    schema = f"`lane_text` string, `{rows}` long, state string, quiet_from long"
    found = held.groupBy("lane_shard").transformWithStateInPandas(_Chain(number, order, rows, expiry_ms), schema, "append", "eventTime")
    return found.select(_key_of(types[key]).alias(key), rows, "state", "quiet_from")


def staged(df: DataFrame, stage: str, stages: int, files: int | None = None) -> DataFrame:
    """A table as a feed: a stream that reads one stage (a number from 0 on) a micro-batch, in their order; stages without rows are left out.

    Every stage has ``files`` files, by default one for each FILE_ROWS rows of the largest; a stage with fewer rows than files is filled up with empty ones. The table itself is worked out once.
    """
    spark, base = df.sparkSession, work_dir(df.sparkSession)
    path = f"{base}-feed"
    df.where(F.col(stage).between(0, stages - 1)).write.partitionBy(stage).option("compression", "zstd").parquet(f"{base}-stages")
    held = spark.read.schema(df.schema).parquet(f"{base}-stages").select(*df.columns)
    sizes = {r[0]: r[1] for r in held.groupBy(stage).count().collect()}
    files = files or max(2, -(-max(sizes.values(), default=0) // FILE_ROWS))
    for done, n in enumerate(sorted(sizes) or [0]):
        held.where(F.col(stage) == n).repartition(files).write.mode("append").option("compression", "zstd").parquet(path)
        for _ in range(files * (done + 1) - len(spark.read.schema(df.schema).parquet(path).inputFiles())):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
