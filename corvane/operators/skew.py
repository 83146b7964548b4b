"""Joins whose hot keys are split over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from corvane.session import staged

#: A key is hot when it holds more than this share of all rows of the large side; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 512
MIN_ROWS = 50_000


def salted_join(large: DataFrame, keyed: DataFrame, on: str, weight: str, spread: list[str], how: str = "inner") -> DataFrame:
    """Join large with keyed, which has one row per key and, in `weight`, the key's number of rows in large.

    keyed must be staged, as it is read several times. Hot keys get ceil(rows / limit) salts: large rows choose theirs by
    a hash of the `spread` columns, keyed rows are repeated once per salt. The list of hot keys that is broadcast has at
    most 1 / HOT_SHARE rows whatever the input. `how` is inner or left. `weight` is dropped. Null keys never match.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    limit = max(MIN_ROWS, int(total * HOT_SHARE))
    salts = F.ceil(F.col(weight) / F.lit(limit)).cast("int")
    hot = keyed.filter(F.col(weight) > limit).select(F.col(on), salts.alias("_salts"))
    if hot.isEmpty():
        return large.join(keyed.drop(weight), on, how)
    pick = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"))
    left = large.join(F.broadcast(hot), on, "left").withColumn("_salt", pick).drop("_salts")
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > limit, salts - 1).otherwise(0)))).drop(weight)
    return left.join(right, [on, "_salt"], how).drop("_salt")


def hot_keys(large: DataFrame, on: str) -> DataFrame | None:
    """on, _salts for the hot keys of large: at most 1 / HOT_SHARE rows; None if there are none. large is read once; to salt
    several joins alike."""
    rows = Observation()
    counts = large.groupBy(on).agg(F.count("*").alias("_n")).observe(rows, F.sum("_n").alias("total"))
    heavy = staged(counts.filter(F.col("_n") > MIN_ROWS), "hot")
    limit = max(MIN_ROWS, int((rows.get.get("total") or 0) * HOT_SHARE))
    hot = heavy.filter(F.col("_n") > limit)
    return None if hot.isEmpty() else hot.select(on, F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))


def salted(large: DataFrame, hot: DataFrame | None, on: str, spread: list[str]) -> DataFrame:
    """large with `_salt`, for joins on (on, _salt) with spread_out()."""
    if hot is None:
        return large.selectExpr("*", "0 AS _salt")
    pick = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"))
    return large.join(F.broadcast(hot.withColumnRenamed(hot.columns[0], on)), on, "left").withColumn("_salt", pick).drop("_salts")


def spread_out(keyed: DataFrame, hot: DataFrame | None, on: str) -> DataFrame:
    """keyed with one row per salt of its key."""
    if hot is None:
        return keyed.selectExpr("*", "0 AS _salt")
    last = F.coalesce(F.col("_salts") - 1, F.lit(0))
    return keyed.join(F.broadcast(hot.withColumnRenamed(hot.columns[0], on)), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")
