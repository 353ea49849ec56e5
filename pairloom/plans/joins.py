"""Equi-joins of rows with their groups where single groups may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A group is hot with more than 1 / HOT of all rows, so fewer than HOT groups are.
HOT = 4096


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row for each key ``on``), which has the number of rows of a key in ``size``.

    Keys with more than total / HOT rows are fewer than HOT, whatever the data: those groups
    are broadcast, and their rows stay where they are.  All other rows are shuffled by key.
    Null keys match nothing.  Columns: those of ``rows``, then those of ``groups`` but the key.
    """
    hot = groups.where(F.col(size) > total / HOT)
    cold = groups.where(F.col(size) <= total / HOT)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    columns = [*rows.columns, *[c for c in groups.columns if c not in on]]
    return near.select(*columns).unionByName(far.select(*columns))
