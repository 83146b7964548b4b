"""References to records that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.scalars import key
from corvane.operators.skew import salted_join
from corvane.session import staged
from corvane.sources.tables import table

HOLON_FILE = r"(?:^|/)knowledge/(?:[^/]+/)*([^/]+)\.md$"
BEGINNING = "0001-01-01 00:00:00"


def target_key(target: Column) -> Column:
    """The id an audit target names: itself, or, for a path, the holon whose file it is; any other path names nothing."""
    path = F.trim(target)
    return F.when(F.instr(target, "/") > 0, key(F.nullif(F.regexp_extract(path, HOLON_FILE, 1), F.lit("")))).otherwise(key(target))


def references(evidence: DataFrame, relations: DataFrame, audit_log: DataFrame) -> DataFrame:
    """Every reference in long form: ref_table, ref_field, row_key, at, key, holons_only. Null and blank are none."""

    def part(df: DataFrame, name: str, field: str, row: Column, at: str, to: Column, only: bool) -> DataFrame:
        return df.select(
            F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), row.alias("row_key"),
            F.col(at).cast("timestamp_ntz").alias("at"), to.alias("key"), F.lit(only).alias("holons_only"),
        )

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    triple = F.concat_ws("|", text("source_id"), text("target_id"), text("relation_type"))
    parts = [
        part(evidence, "evidence", "holon_id", F.col("id"), "created_at", key(F.col("holon_id")), True),
        part(relations, "relations", "source_id", triple, "created_at", key(F.col("source_id")), False),
        part(relations, "relations", "target_id", triple, "created_at", key(F.col("target_id")), False),
        part(audit_log, "audit_log", "target_id", F.col("id"), "timestamp", target_key(F.col("target_id")), False),
    ]
    return reduce(DataFrame.unionByName, parts).filter(F.col("key").isNotNull())


def orphans(holons: DataFrame, evidence: DataFrame, relations: DataFrame, audit_log: DataFrame) -> DataFrame:
    """References that do not resolve: ref_table, ref_field, row_key, at; repeated rows as often as they come.

    Tagged parent and child keys are united in long form and grouped by key, with partial aggregation before the shuffle;
    what is left of a key is the first instant it exists, per parent table, and the first instant it is referred to. Only
    keys with a reference before that instant, or without it, go back to their rows, by a join that splits hot keys.

    Nulls: a parent without created_at exists from the beginning; a reference without a time resolves if its parent exists
    at all. Null row ids stay null. Extra columns are ignored.
    """
    refs = references(evidence, relations, audit_log)
    none = F.lit(None).cast("timestamp_ntz")

    def parents(df: DataFrame, tag: str) -> DataFrame:
        born = F.coalesce(F.col("created_at").cast("timestamp_ntz"), F.lit(BEGINNING).cast("timestamp_ntz"))
        return df.select(
            key(F.col("id")).alias("key"),
            (born if tag == "holons" else none).alias("holon_from"),
            born.alias("any_from"),
            none.alias("narrow_at"), none.alias("wide_at"), F.lit(0).alias("refs"),
        ).filter(F.col("key").isNotNull())

    latest = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    at = F.coalesce("at", latest)
    children = refs.select(
        "key", none.alias("holon_from"), none.alias("any_from"),
        F.when(F.col("holons_only"), at).alias("narrow_at"), F.when(~F.col("holons_only"), at).alias("wide_at"), F.lit(1).alias("refs"),
    )
    grouped = (
        parents(holons, "holons").unionByName(parents(evidence, "evidence")).unionByName(children)
        .groupBy("key")
        .agg(*[F.min(c).alias(c) for c in ("holon_from", "any_from", "narrow_at", "wide_at")], F.sum("refs").alias("refs"))
    )
    narrow = F.col("narrow_at").isNotNull() & (F.col("holon_from").isNull() | (F.col("narrow_at") < F.col("holon_from")))
    wide = F.col("wide_at").isNotNull() & (F.col("any_from").isNull() | (F.col("wide_at") < F.col("any_from")))
    lacking = staged(grouped.filter(narrow | wide).select("key", "holon_from", "any_from", "refs"), "lacking")
    born = F.when(F.col("holons_only"), F.col("holon_from")).otherwise(F.col("any_from"))
    found = salted_join(refs, lacking, "key", "refs", ["row_key", "at"])
    return found.filter(born.isNull() | (F.coalesce("at", latest) < born)).select("ref_table", "ref_field", "row_key", "at")


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("holons", "evidence", "relations", "audit_log")]


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orphans(*_tables(spark, sf_dir))
    return rows.select("ref_table", "ref_field", "row_key", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per table, field and month."""
    return found(spark, sf_dir).groupBy("ref_table", "ref_field", "period").agg(F.count("*").alias("orphans"))


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


def _sql_key(c: str) -> str:
    return f"nullif({_SLUG.format(c)}, '')"


_FOUND_SQL = f"""
WITH refs AS (
  SELECT 'evidence' AS ref_table, 'holon_id' AS ref_field, id AS row_key, created_at AS made, {_sql_key('holon_id')} AS k, true AS narrow FROM evidence
  UNION ALL SELECT 'relations', 'source_id', source_id || '|' || target_id || '|' || relation_type, created_at, {_sql_key('source_id')}, false FROM relations
  UNION ALL SELECT 'relations', 'target_id', source_id || '|' || target_id || '|' || relation_type, created_at, {_sql_key('target_id')}, false FROM relations
  UNION ALL SELECT 'audit_log', 'target_id', id, "timestamp",
    CASE WHEN contains(target_id, '/') THEN {_sql_key("regexp_extract(trim(target_id), '(?:^|/)knowledge/(?:[^/]+/)*([^/]+)[.]md$', 1)")} ELSE {_sql_key('target_id')} END, false FROM audit_log
), h AS (SELECT {_sql_key('id')} AS k, min(created_at) AS born FROM holons GROUP BY 1),
e AS (SELECT {_sql_key('id')} AS k, min(created_at) AS born FROM evidence GROUP BY 1)
SELECT DISTINCT ref_table, ref_field, row_key, strftime(made, '%Y-%m') AS period
FROM refs LEFT JOIN h ON h.k = refs.k LEFT JOIN e ON e.k = refs.k
WHERE refs.k IS NOT NULL AND NOT coalesce(h.born <= made, false) AND (narrow OR NOT coalesce(e.born <= made, false))
"""

QUERIES = {"p2_found": found, "p2_by_period": by_period}
SQL = {
    "p2_found": _FOUND_SQL,
    "p2_by_period": f"SELECT ref_table, ref_field, period, count(*) AS orphans FROM ({_FOUND_SQL}) GROUP BY ALL",
}
