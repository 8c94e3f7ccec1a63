"""Files as sources and sinks: parts with their names, sealed parts, strict CSV, ZIP archives, month folders, view catalogs."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_parts(spark: SparkSession, *paths: str) -> DataFrame:
    """All Parquet parts under the paths, columns united by name, with ``part``, the path of the file; names from ``.`` or ``_`` on are no parts."""
    shown = [p for p in paths if not p.rstrip("/").rsplit("/", 1)[-1].startswith((".", "_"))]
    return spark.read.option("mergeSchema", True).parquet(*shown).withColumn("part", F.col("_metadata.file_path"))


def physical_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows with their place in their file: ``part`` and ``row``."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("row"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under a path, read by Spark: ``file``, ``sha256``, ``bytes``. Each file is read whole, so files should be parts of ordinary size."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def sealed_part(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A single part, read only if its digest is the one that was recorded."""
    found = [r["sha256"] for r in digests(spark, path).where("file not like '\\\\_%' and file not like '.%'").limit(2).collect()]
    if found != [sha256]:
        raise ValueError(f"{path}: expected one part with digest {sha256}, found {found}")
    return spark.read.parquet(path)


def strict_csv(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Headerless CSV, every cell as text; a row with another number of cells fails the read."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("mode", "FAILFAST").option("header", False).csv(paths)


def zip_rows(archives: DataFrame, columns: list[str], keep: list[str], member: str = "", most: int | None = None) -> DataFrame:
    """Rows of CSV members of ZIP archives (``path``, ``content``, and ``sha256`` if recorded): the columns ``keep`` as text, and ``source``.

    An archive has one member or the one that is named. A first row that repeats the column names, or has no digit, is a header. A digest
    that differs, another number of cells, or more than ``most`` rows fail.
    """
    checked = "sha256" in archives.columns
    source = archives.select("path", "content", F.col("sha256") if checked else F.lit(None).cast("string").alias("sha256"))

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content, expected in frame.itertuples(index=False):
                if expected is not None and hashlib.sha256(content).hexdigest() != expected:
                    raise ValueError(f"{path}: digest differs from the recorded one")
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if not member or n == member]
                    if len(names) != 1:
                        raise ValueError(f"{path}: expected one member, found {names}")
                    with archive.open(names[0]) as f:
                        first = f.readline().decode().rstrip("\r\n").split(",")
                        header = first == columns or not any(c.isdigit() for c in "".join(first))
                    with archive.open(names[0]) as f:
                        seen = 0
                        for part in pd.read_csv(f, header=None, names=range(len(columns)), skiprows=int(header), dtype=str, keep_default_na=False, chunksize=100_000, index_col=False, on_bad_lines="error"):
                            seen += len(part)
                            if most is not None and seen > most:
                                raise ValueError(f"{path}: more than {most} rows")
                            part.columns = columns
                            yield part[keep].assign(source=path)

    return source.mapInPandas(unpack, ", ".join(f"`{c}` string" for c in [*keep, "source"]))


def from_base64(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a column of base64 text as bytes."""
    return df.withColumn(column, F.unbase64(F.col(column)))


def bounded(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The rows in order, refused if there are more than ``most``: one more than that is asked for and counted."""
    held = df.orderBy(*order).limit(most + 1)
    if held.count() > most:
        raise ValueError(f"more than {most} rows")
    return held


def typed_bars(spark: SparkSession, path: str, prices: str = "decimal(28,8)") -> DataFrame:
    """Candle files of text columns under ``interval=day`` and ``interval=hour`` as typed bars: ``interval``, ``opened`` (a timestamp; days are in seconds, hours in milliseconds), prices, ``volume``.

    A cell that is no number is null, and the row says so in ``bad``, the number of such cells. Conditions on ``interval`` skip the other's files.
    """
    raw = spark.read.schema("interval string, t string, open string, high string, low string, close string, volume string").parquet(path)
    cells = {c: F.col(c).try_cast(prices) for c in ("open", "high", "low", "close", "volume")}
    per = F.when(F.col("interval") == "day", 1_000_000).otherwise(1000)
    time = F.col("t").try_cast("long")
    bad = sum((F.col(c).isNotNull() & v.isNull()).cast("int") for c, v in {"t": time, **cells}.items())
    return raw.select("interval", F.timestamp_micros(time * per).alias("opened"), *[v.alias(c) for c, v in cells.items()], bad.alias("bad"))


def write_months(df: DataFrame, path: str, month: Column, order: list[str]) -> None:
    """One folder a month (``month=...``), in one job; months that ``df`` has are replaced, others stay.

    Rows are dealt by ranges of month and order, so a month of any size has as many tasks as it needs; its files are ordered within and, by name, among each other.
    """
    held = df.withColumn("month", month)
    out = held.repartitionByRange("month", *order).sortWithinPartitions("month", *order).write.partitionBy("month")
    out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_settling_months(df: DataFrame, path: str, time: Column, order: list[str], known_until: str) -> DataFrame:
    """Months of settlements: one that ends before the day ``known_until`` is ``settled``, a later one ``provisional``; gives ``month``, ``state``, ``rows`` and ``written``.

    A month goes to ``state=.../month=...``. A settled month that is there is never written again; a provisional one is replaced, and goes once it is settled.
    """
    spark = df.sparkSession
    month = F.date_format(time, "yyyy-MM")
    state = F.when(F.last_day(time) < F.lit(known_until).cast("date"), "settled").otherwise("provisional")
    held = df.withColumns({"month": month, "state": state})
    system = _file_system(spark, path)
    there = {}
    for s in ("settled", "provisional"):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state={s}")
        there[s] = {f.getPath().getName().removeprefix("month=") for f in system.listStatus(folder)} if system.exists(folder) else set()
    counts = held.groupBy("month", "state").agg(F.count("*").alias("rows"))
    fresh = ~((F.col("state") == "settled") & F.col("month").isin(*there["settled"])) if there["settled"] else F.lit(True)
    out = held.where(fresh).repartitionByRange("state", "month", *order).sortWithinPartitions("state", "month", *order).write.partitionBy("state", "month")
    out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    settled = {r["month"] for r in counts.where("state = 'settled'").collect()}  # one row a month
    for m in there["provisional"] & (settled | there["settled"]):
        system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state=provisional/month={m}"), True)
    return counts.withColumn("written", fresh)


def _file_system(spark: SparkSession, path: str):
    """Spark's own file system for a path."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """A table ordered over all its files."""
    df.orderBy(*order).write.mode("errorifexists").parquet(path)


def output_decision(recorded: Column, sources: Column, exists: Column, rebuild: Column) -> Column:
    """:func:`decide_output` for a table of outputs, by the digests of their sources: ``write``, ``audit``, ``rebuild``, or why it is refused: ``untracked`` or ``other_sources``."""
    there = F.coalesce(exists, F.lit(False))
    return F.when(~there, "write").when(F.coalesce(rebuild, F.lit(False)), "rebuild").when(recorded.isNull(), "untracked").when(recorded == sources, "audit").otherwise("other_sources")


def decide_output(recorded: dict[str, str] | None, sources: dict[str, str], exists: bool, rebuild: bool = False) -> str:
    """What to do with an output: ``write`` a new one, ``audit`` one of the same sources, ``rebuild``, or refuse one that is untracked or of other sources."""
    if not exists:
        return "write"
    if rebuild:
        return "rebuild"
    if recorded is None:
        raise ValueError("the output is there, but its sources are not recorded")
    if recorded != sources:
        raise ValueError(f"the output was made from other sources: {sorted(set(recorded.items()) ^ set(sources.items()))}")
    return "audit"


def write_pair(folder: str, name: str, document: dict, text: str) -> None:
    """A result as JSON with sorted keys and as text, both new or none; for a driver's own results."""
    made = {f"{name}.json": json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False), f"{name}.md": text}
    if any(os.path.exists(os.path.join(folder, n)) for n in made):
        raise FileExistsError(f"{folder}/{name} is there")
    for n, body in made.items():
        with open(os.path.join(folder, f".{n}"), "x", encoding="utf-8") as f:
            f.write(body)
    for n in made:
        os.replace(os.path.join(folder, f".{n}"), os.path.join(folder, n))


def register_views(spark: SparkSession, prefix: str, tables: dict[str, DataFrame], own: set[str] | frozenset[str] = frozenset()) -> list[str]:
    """Each table as a temporary view ``prefix_name``; a view of that name that isn't in ``own`` is somebody else's and stays."""
    names = {t.name for t in spark.catalog.listTables()}
    made = []
    for name, df in sorted(tables.items()):
        view = f"{prefix}_{name}"
        if view in names and view not in own:
            raise ValueError(f"{view} is a view of somebody else")
        df.createOrReplaceTempView(view)
        made.append(view)
    return made


def series_views(spark: SparkSession, folder: str, prefix: str) -> dict[str, str]:
    """A temporary view ``<prefix>_<series>`` for each series of a folder written by ``series`` and ``month``; by name, its condition.

    The series are what the folder's own partitions say, so a view reads only the files of its series; views of the prefix whose series is gone are dropped.
    """
    whole = spark.read.parquet(folder)
    found = sorted(r[0] for r in whole.select("series").distinct().collect())  # one row a series
    made = {f"{prefix}_{re.sub(r'[^0-9a-z]+', '_', str(s).lower())}": s for s in found}
    if len(made) != len(found):
        raise ValueError("series whose views would have one name")
    for table in spark.catalog.listTables():
        if table.isTemporary and table.name.startswith(f"{prefix}_") and table.name not in made:
            spark.catalog.dropTempView(table.name)
    for name, s in made.items():
        whole.where(F.col("series") == s).drop("series").createOrReplaceTempView(name)
    return {n: f"series = '{s}'" for n, s in made.items()}


#: Property of a stored view that says who generates it.
OWNER = "generated_by"


def _stored(spark: SparkSession, catalog: str) -> dict[str, str | None]:
    """The stored views of a catalog and their owners."""
    names = [r["viewName"] for r in spark.sql(f"SHOW VIEWS IN `{catalog}`").collect() if not r["isTemporary"]]
    owners = {n: [r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES `{catalog}`.`{n}`").collect() if r["key"] == OWNER] for n in names}
    return {n: o[0] if o else None for n, o in owners.items()}


def generate_catalog(spark: SparkSession, catalog: str, folder: str, views: dict[str, str], owner: str) -> dict[str, list[str]]:
    """Store views (name to query) in a catalog: ``made``, ``dropped`` (own ones that are no longer asked for) and ``foreign`` (of others, left as they are).

    A name that a view of another owner has is refused before anything is changed.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{catalog}` LOCATION '{folder}'")
    there = _stored(spark, catalog)
    if taken := sorted(n for n in views if n in there and there[n] != owner):
        raise ValueError(f"views of others have these names: {', '.join(taken)}")
    stale = sorted(n for n, o in there.items() if o == owner and n not in views)
    for name in stale:
        spark.sql(f"DROP VIEW `{catalog}`.`{name}`")
    for name, query in views.items():
        spark.sql(f"CREATE OR REPLACE VIEW `{catalog}`.`{name}` TBLPROPERTIES ('{OWNER}' = '{owner}') AS {query}")
    return {"made": sorted(views), "dropped": stale, "foreign": sorted(n for n, o in there.items() if o != owner)}


def union_of_catalogs(spark: SparkSession, catalogs: dict[str, str]) -> DataFrame:
    """The stored views of several catalogs (alias to name): ``catalog``, ``view``, ``owner``; lists of names, no rows of tables."""
    rows = [(alias, n, o) for alias, name in catalogs.items() for n, o in sorted(_stored(spark, name).items())]
    return spark.createDataFrame(rows, "catalog string, view string, owner string")
