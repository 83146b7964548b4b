"""The tables as the engine sees them: ids as slugs, one row per key, layers in one spelling.

Every operator of this package that takes holons, evidence, relations, waivers or audit rows takes them in this form.
Rows without a key are left out. Of holons with one id the row updated last counts, of other repeated keys the one
created last; where these tie, the row that is larger in the other columns, in turn. Extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.scalars import key
from corvane.sources.tables import table

#: Every operator that depends on time takes the instant; this is the one the named queries use.
AS_OF = "2023-01-01 00:00:00"


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def layer_name(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low == "invalid", low).otherwise(F.upper(low))


def _latest(df: DataFrame, keys: dict[str, Column], tiers: list[dict[str, Column]]) -> DataFrame:
    """One row per key, as it is stored: the largest in the order of all columns, tier by tier.

    A tier's columns are taken from the largest prefix of a row that ends with that tier. The prefixes of the largest row
    are the largest prefixes, so all columns come from one row, and tiers nobody asks for are never read.
    """
    every = {c: v for tier in tiers for c, v in tier.items()}
    named = df.select(*[v.alias(f"_k_{c}") for c, v in keys.items()], *[v.alias(c) for c, v in every.items()])
    for c in keys:
        named = named.filter(F.col(f"_k_{c}").isNotNull())
    picked, upto = [], []
    for tier in tiers:
        upto += list(tier)
        picked += [F.max(F.struct(*upto))[c].alias(c) for c in tier]
    return named.groupBy(*[F.col(f"_k_{c}").alias(c) for c in keys]).agg(*picked)


def _cols(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def holons(df: DataFrame) -> DataFrame:
    state = {"updated_at": F.col("updated_at"), "cached_r_score": F.col("cached_r_score"), "layer": layer_name(F.col("layer"))}
    about = _cols("type", "kind", "context_id", "scope", "created_at") | {"parent_id": key(F.col("parent_id"))}
    return _latest(df, {"id": key(F.col("id"))}, [state, about, _cols("title", "content")])


def evidence(df: DataFrame) -> DataFrame:
    state = {"created_at": F.col("created_at"), "holon_id": key(F.col("holon_id"))} | _cols("verdict", "valid_until")
    return _latest(df, {"id": key(F.col("id"))}, [state, _cols("type", "assurance_level", "carrier_ref"), _cols("content")])


def relations(df: DataFrame) -> DataFrame:
    keys = {"source_id": key(F.col("source_id")), "target_id": key(F.col("target_id")), "relation_type": F.col("relation_type")}
    return _latest(df, keys, [_cols("created_at", "congruence_level")])


def waivers(df: DataFrame) -> DataFrame:
    state = {"created_at": F.col("created_at"), "evidence_id": key(F.col("evidence_id"))} | _cols("waived_until", "waived_by")
    return _latest(df, {"id": key(F.col("id"))}, [state, _cols("rationale")])


def audit(df: DataFrame) -> DataFrame:
    row = _cols("timestamp", "context_id", "tool_name", "operation") | {"actor": F.lower("actor"), "target_id": F.col("target_id"), "input_hash": F.col("input_hash"), "result": F.upper("result")}
    return _latest(df, {"id": key(F.col("id"))}, [row, _cols("details")])


def work_records(orders: DataFrame) -> DataFrame:
    """Work with a start, an end and a JSON ledger, as the orders table has it."""
    end = F.expr("o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 7 AS INT))")
    ms = (F.col("o_orderkey") % 7 * 86_400_000).cast("long")
    return orders.select(
        F.concat(F.lit("work-"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("method_ref"),
        F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("")), F.lit("System")).alias("performer_ref"),
        F.col("o_orderdate").alias("started_at"), end.alias("ended_at"), F.to_json(F.struct(ms.alias("duration_ms"))).alias("resource_ledger"),
    )


def characteristics(part: DataFrame) -> DataFrame:
    """Measurements in key-value form, as the part table has them."""
    holon = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    size = part.select(holon.alias("holon_id"), F.lit("size").alias("name"), F.lit("ratio").alias("scale"), F.col("p_size").cast("string").alias("value"), F.lit("cm").alias("unit"))
    brand = part.select(holon, F.lit("brand"), F.lit("nominal"), F.col("p_brand"), F.lit(None).cast("string"))
    return size.union(brand)


@dataclass(frozen=True)
class Base:
    """The tables of one folder."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def holons(self) -> DataFrame:
        return holons(self.raw("holons"))

    @cached_property
    def evidence(self) -> DataFrame:
        return evidence(self.raw("evidence"))

    @cached_property
    def relations(self) -> DataFrame:
        return relations(self.raw("relations"))

    @cached_property
    def waivers(self) -> DataFrame:
        return waivers(self.raw("waivers"))

    @cached_property
    def audit(self) -> DataFrame:
        return audit(self.raw("audit_log"))


def _k(c: str) -> str:
    return f"nullif(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-'), '')"


_LAYER = "CASE WHEN lower(trim(layer)) = 'invalid' THEN 'invalid' ELSE upper(trim(layer)) END"


def _one(keys: str, *order: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in order)}) = 1"


#: The same in SQL: h, e, r, w and a.
VIEWS = f"""
h AS (SELECT {_k('id')} AS id, type, kind, {_LAYER} AS layer, title, content, context_id, scope, {_k('parent_id')} AS parent_id, cached_r_score, created_at, updated_at FROM holons WHERE {_k('id')} IS NOT NULL
  {_one(_k('id'), 'updated_at', 'cached_r_score', _LAYER, 'type', 'kind', 'context_id', 'scope', 'created_at', _k('parent_id'), 'title', 'content')}),
e AS (SELECT {_k('id')} AS id, {_k('holon_id')} AS holon_id, type, content, verdict, assurance_level, carrier_ref, valid_until, created_at FROM evidence WHERE {_k('id')} IS NOT NULL
  {_one(_k('id'), 'created_at', _k('holon_id'), 'verdict', 'valid_until', 'type', 'assurance_level', 'carrier_ref', 'content')}),
r AS (SELECT {_k('source_id')} AS source_id, {_k('target_id')} AS target_id, relation_type, congruence_level, created_at FROM relations
  WHERE {_k('source_id')} IS NOT NULL AND {_k('target_id')} IS NOT NULL AND relation_type IS NOT NULL {_one(_k('source_id') + ', ' + _k('target_id') + ', relation_type', 'created_at', 'congruence_level')}),
w AS (SELECT {_k('id')} AS id, {_k('evidence_id')} AS evidence_id, waived_by, waived_until, rationale, created_at FROM waivers WHERE {_k('id')} IS NOT NULL
  {_one(_k('id'), 'created_at', _k('evidence_id'), 'waived_until', 'waived_by', 'rationale')}),
a AS (SELECT {_k('id')} AS id, "timestamp", tool_name, operation, lower(actor) AS actor, target_id, input_hash, upper(result) AS result, details, context_id FROM audit_log WHERE {_k('id')} IS NOT NULL
  {_one(_k('id'), '"timestamp"', 'context_id', 'tool_name', 'operation', 'lower(actor)', 'target_id', 'input_hash', 'upper(result)', 'details')})
"""


def sql(body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{VIEWS}{', ' + more if more else ''} {body}"


def json_of(c: str) -> str:
    """A text as a JSON value, in SQL."""
    out = c
    for sign, escape in {"\\": "\\\\", '"': '\\"', "<": "\\u003c", ">": "\\u003e", "&": "\\u0026"}.items():
        out = f"replace({out}, '{sign}', '{escape}')"
    return f"""coalesce('"' || {out} || '"', 'null')"""
