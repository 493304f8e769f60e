"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000  # a key with more than one in so many rows is heavy, so there are fewer heavy keys than this


def join_one(many: DataFrame, one: DataFrame, key: str, copies: str, how: str = "inner") -> DataFrame:
    """``many`` with the columns of ``one``, which has one row a key and in ``copies`` the number of rows that the key has in ``many``.

    Fewer than ``SHARE`` keys can hold more than one in ``SHARE`` of the rows: their rows of ``one`` are broadcast, and their rows of ``many`` stay
    where they are. Only the others are shuffled. ``one`` is read several times and should be a written table. Null keys match nothing;
    ``how`` is inner or left.
    """
    total = one.agg(F.sum(copies)).first()[0] or 0
    heavy = F.broadcast(one.where(F.col(copies) > total / SHARE))  # fewer than SHARE rows, by what heavy means
    light = one.where(F.col(copies) <= total / SHARE)
    return many.join(heavy.select(key), key, "left_anti").join(light, key, how).unionByName(many.join(heavy, key))
