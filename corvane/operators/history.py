"""History of changing entity attributes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.scalars import key
from corvane.operators.sequence import Differs, stretches, unequal
from corvane.sources.tables import table


def layer_value(c: str) -> Column:
    return F.lower(F.trim(c))


def score_value(c: str) -> Column:
    return F.round(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), 4)


#: Satellites, slowest changing first: the attribute and the value by which two states of it are compared.
SATELLITES = {"layer": layer_value, "cached_r_score": score_value}


def states(holons: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One observed state per id and updated_at: id, updated_at, layer, cached_r_score.

    The row of holons counts, otherwise the one exported last; ties by the larger values. Rows without id or updated_at
    have no place in a history and are left out.
    """
    at = F.col("updated_at").cast("timestamp_ntz")
    values = [f(c).alias(c) for c, f in SATELLITES.items()]
    both = holons.select(key(F.col("id")).alias("id"), at.alias("updated_at"), F.lit(1).alias("current"), F.lit(None).cast("timestamp_ntz").alias("seen"), *values).unionByName(
        snapshots.select(key(F.col("id")).alias("id"), at.alias("updated_at"), F.lit(0).alias("current"), F.col("snapshot_at").cast("timestamp_ntz").alias("seen"), *values)
    )
    best = F.max(F.struct("current", "seen", *SATELLITES)).alias("s")
    return (
        both.filter(F.col("id").isNotNull() & F.col("updated_at").isNotNull())
        .groupBy("id", "updated_at").agg(best).select("id", "updated_at", *[f"s.{c}" for c in SATELLITES])
    )


def _hashed(rows: DataFrame) -> DataFrame:
    for c in SATELLITES:
        rows = rows.withColumn(f"hash_{c}", F.xxhash64(c))
    return rows


def _new(attributes: list[str]) -> Differs:
    """A row appended to a satellite of these attributes: another id, or another hash of one of them."""

    def differs(before: pa.Table, here: pa.Table) -> np.ndarray:
        return reduce(np.logical_or, [unequal(before.column(c), here.column(c)) for c in ("id", *[f"hash_{a}" for a in attributes])])

    return differs


def _appended(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """The rows of hashed states that a satellite of these attributes gets, with valid_from, valid_to (null while current) and
    is_current by lead over them.

    The states are range-partitioned by (id, updated_at), so an id with a third of all states is split like any other.
    """
    hashes = [f"hash_{c}" for c in attributes]
    led = stretches(rows, ["id", "updated_at"], ["id", "updated_at", *hashes], _new(attributes), next_=("id", "updated_at"))
    to = F.when(F.col("_next.id") == F.col("id"), F.col("_next.updated_at"))
    return led.withColumnRenamed("updated_at", "valid_from").withColumn("valid_to", to).withColumn("is_current", to.isNull())


def satellite(rows: DataFrame, attribute: str) -> DataFrame:
    """The satellite of one attribute: id, value as text, hash_diff, valid_from, valid_to, is_current. rows: of changes()."""
    return _appended(rows, [attribute]).select(
        "id", F.lit(attribute).alias("attribute"), F.col(attribute).cast("string").alias("value"),
        F.hex(F.col(f"hash_{attribute}")).alias("hash_diff"), "valid_from", "valid_to", "is_current",
    )


def versions(holons: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The versions of all attributes together: a version starts where any satellite gets a row, that is where the hash of
    its attribute differs from that of the state just before."""
    return _appended(_hashed(states(holons, snapshots)), list(SATELLITES))


def changes(holons: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The states that add to any satellite: id, updated_at, the attributes and their hashes."""
    return versions(holons, snapshots).withColumnRenamed("valid_from", "updated_at").select("id", "updated_at", *SATELLITES, *[f"hash_{c}" for c in SATELLITES])


def _both(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("holons", "holon_snapshots")]


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions(*_both(spark, sf_dir))
    return rows.select("id", F.floor(F.unix_micros(F.col("valid_from").cast("timestamp")) / 1_000_000).cast("long").alias("valid_from_s"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(*_both(spark, sf_dir)).select("id", "layer", "cached_r_score", "valid_from", "valid_to", "is_current")


def satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(*_both(spark, sf_dir))
    return satellite(rows, "layer").unionByName(satellite(rows, "cached_r_score")).drop("hash_diff")


_ID = "trim(regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g'), '-')"
_STATES_SQL = f"""
WITH both_ AS (
  SELECT {_ID} AS id, updated_at, 1 AS cur, NULL::TIMESTAMP AS seen, lower(trim(layer)) AS layer, round(coalesce(cached_r_score, 0.0), 4) AS score FROM holons
  UNION ALL SELECT {_ID}, updated_at, 0, snapshot_at, lower(trim(layer)), round(coalesce(cached_r_score, 0.0), 4) FROM holon_snapshots
), one AS (
  SELECT * FROM both_ WHERE id <> '' AND updated_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, updated_at ORDER BY cur DESC, seen DESC NULLS LAST, layer DESC NULLS LAST, score DESC) = 1
), flagged AS (
  SELECT *, row_number() OVER w = 1 OR lag(layer) OVER w IS DISTINCT FROM layer AS new_layer,
    row_number() OVER w = 1 OR lag(score) OVER w IS DISTINCT FROM score AS new_score
  FROM one WINDOW w AS (PARTITION BY id ORDER BY updated_at)
)"""

QUERIES = {"p5_found": found, "p5_history": history, "p5_satellites": satellites}
SQL = {
    "p5_found": _STATES_SQL + " SELECT id, CAST(floor(epoch_us(updated_at) / 1000000) AS BIGINT) AS valid_from_s FROM flagged WHERE new_layer OR new_score",
    "p5_history": _STATES_SQL + """
        SELECT id, layer, score AS cached_r_score, updated_at AS valid_from, lead(updated_at) OVER v AS valid_to, lead(updated_at) OVER v IS NULL AS is_current
        FROM flagged WHERE new_layer OR new_score WINDOW v AS (PARTITION BY id ORDER BY updated_at)""",
    "p5_satellites": _STATES_SQL + """
        SELECT id, 'layer' AS attribute, layer AS value, updated_at AS valid_from, lead(updated_at) OVER v AS valid_to, lead(updated_at) OVER v IS NULL AS is_current
        FROM flagged WHERE new_layer WINDOW v AS (PARTITION BY id ORDER BY updated_at)
        UNION ALL SELECT id, 'cached_r_score', CAST(score AS VARCHAR), updated_at, lead(updated_at) OVER v, lead(updated_at) OVER v IS NULL
        FROM flagged WHERE new_score WINDOW v AS (PARTITION BY id ORDER BY updated_at)""",
}
