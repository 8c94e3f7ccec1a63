"""Bounded draws of labelled rows, for fitting a classifier on the driver."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F


def drawn_labels(labels: DataFrame, rows: int, label_col: str, key: str = "doc_id") -> DataFrame:
    """About ``rows`` rows of each label (0 and 1), drawn by a hash of the key; all of them where there are fewer.

    The number of rows is in the parameter, not in the size of the table, so the result may be broadcast.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(key).isNotNull()).select(key, label_col).distinct()
    counts = {r[0]: r[1] for r in known.groupBy(label_col).count().collect()}
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    drawn = [(F.col(label_col) == y) & (place <= int(min(1.0, rows / n) * (1 << 30))) for y, n in counts.items()]
    return known.where(functools.reduce(lambda a, b: a | b, drawn, F.lit(False)))
