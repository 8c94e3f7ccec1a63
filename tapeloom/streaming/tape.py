"""The tape as a stream: exactly-once prints, windows with late data, sessions, sequence audits with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.sources import work_dir

#: Partitions of a stream's state for each core, at most.
STATE_PARTS = 3


def distinct_prints(stream: DataFrame, keys: list[str], time: str, lateness: str = "10 minutes") -> DataFrame:
    """First print of each key; state is dropped behind the watermark."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_totals(stream: DataFrame, key: str, time: str, value: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Count and sum by key and window of event time; rows later than the watermark are left out."""
    counted = stream.withWatermark(time, lateness).groupBy(F.window(time, width), key)
    return counted.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Runs of events of a key that are less than ``gap`` apart."""
    counted = stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")


def chained(stream: DataFrame, key: str, number: str, order: str, rows: str = "row") -> DataFrame:
    """For each row whether its number follows the one before it in its key (``start``, ``next``, ``repeat``, ``gap``, ``back``); the last number is kept as state.

    Within a micro-batch rows are taken in the order of ``order``; a row that comes in a later batch counts after it.
    """

    def audit(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(frames)).sort_values(order, kind="stable")
        last = state.get[0] if state.exists else None
        out = []
        for n in held[number]:
            out.append("start" if last is None else "next" if n == last + 1 else "repeat" if n == last else "gap" if n > last else "back")
            last = int(n)
        state.update((last,))
        yield pd.DataFrame({key: group[0], rows: held[rows].to_numpy(), "state": out})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"`{key}` {kinds[key]}, `{rows}` {kinds[rows]}, state string"
    return stream.groupBy(key).applyInPandasWithState(audit, schema, "last long", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str = "append", state: str | None = None) -> DataFrame:
    """Run a stream over what is there now and give its result as a table in the shared folder; with ``complete`` the last one replaces the others.

    A batch is written to a folder of its own number, so one that is run again after a failure replaces itself. ``state`` names the folder of an earlier run
    to go on from; results of both are then in it.
    """
    spark = stream.sparkSession
    path = state or f"{work_dir(spark)}-stream"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{'all' if mode == 'complete' else f'batch-{number:08d}'}")

    provider, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    # Each partition of state is opened and committed in every batch, so there are no more than a few for each core.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), STATE_PARTS * spark.sparkContext.defaultParallelism)
    settings = {provider: rocks, "spark.sql.shuffle.partitions": str(parts)}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)  # timers and typed state need RocksDB; a stream keeps the settings that it began with
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    query.awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/rows/none")
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
