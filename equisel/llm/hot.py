"""Joining a grouped table back to its rows when one group may hold a large
share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A group with more than 1/SHARE of the rows is hot, so there are fewer than SHARE of them.
SHARE = 256


def join_back(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = SHARE) -> DataFrame:
    """``rows`` inner-joined with ``groups`` (one row per ``key``; ``size``: its
    number of rows, ``total``: their sum). Rows of hot groups never move: the
    hot groups, fewer than ``share`` by arithmetic, are broadcast. The others
    meet in an equi-join, where no key has more than total / share rows. Both
    inputs are read twice, so hand in written tables or plain scans."""
    hot = groups.where(F.col(size) * F.lit(share) > F.lit(total))
    still = rows.join(F.broadcast(hot), key)
    moved = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) * F.lit(share) <= F.lit(total)), key)
    return still.unionByName(moved)
