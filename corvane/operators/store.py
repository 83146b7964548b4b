"""Lookups, listings, inserts, updates and upserts over the tables of model.py.

Functions take one id, layer or context, or a table of all that are asked for; the named queries at the end answer for
all at once, which is how a batch engine is used; ordered listings tell each row's place. Writes return the new state of the table: Parquet files are not updated in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import scalars as S
from corvane.operators import model
from corvane.operators.model import AS_OF, Base, as_of, json_of, sql
from corvane.operators.sequence import running_total
from corvane.session import partitions, staged
from corvane.sources import schemas

WHOLES = ("componentOf", "constituentOf")


def indexed(df: DataFrame) -> DataFrame:
    """A keyed table staged in the order of id: a filter on the id reads the row groups it can be in, and nothing is aggregated
    again."""
    return staged(df.repartitionByRange(partitions(df.sparkSession), "id").sortWithinPartitions("id"), "indexed")


def by_id(df: DataFrame, id_: str) -> DataFrame:
    """The row of one id; for more than one lookup, of an indexed() table."""
    return df.filter(F.col("id") == id_).limit(1)


def lookups(df: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of all ids asked for (id; repeated and null ones do not matter)."""
    return df.join(asked.select("id").distinct(), "id", "left_semi")


def titles(holons: DataFrame, asked: DataFrame) -> DataFrame:
    """id, title of all ids asked for; the id itself where the title is blank or the holon unknown."""
    named = holons.select("id", F.nullif("title", F.lit("")).alias("_t"))
    return asked.select("id").filter("id IS NOT NULL").distinct().join(named, "id", "left").select("id", F.coalesce("_t", "id").alias("title"))


def where(df: DataFrame, newest: str, **equal: str) -> DataFrame:
    """Rows equal in the given columns, newest first, ties by id. A null value matches nothing."""
    for c, v in equal.items():
        df = df.filter(F.col(c) == v)
    return df.orderBy(F.col(newest).desc(), *(["id"] if "id" in df.columns else []))


def recent(audit: DataFrame, n: int) -> DataFrame:
    """The n latest audit rows; ties by id. A top-k: no full sort."""
    return audit.orderBy(F.col("timestamp").desc(), "id").limit(n)


def latest(df: DataFrame, per: str, newest: str) -> DataFrame:
    """One row per value of `per`, the newest; ties to the smaller id; rows without an instant are the oldest. Two
    aggregates and no window: hot groups combine before the shuffle."""
    rest = [c for c in df.columns if c != per]
    at = F.coalesce(F.col(newest).cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    ties = df.groupBy(per, at.alias("_at")).agg(F.min_by(F.struct(*rest), "id").alias("_r"))
    return ties.groupBy(per).agg(F.max_by("_r", "_at").alias("_r")).select(per, *[f"_r.{c}" for c in rest])


def appended(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """df and rows; rows whose key is there already are an error. Missing columns become null."""
    clash = clashes(df, rows, keys)
    if not clash.isEmpty():
        raise ValueError(f"rows with a key that exists: {clash.first()}")
    return df.unionByName(rows, allowMissingColumns=True)


def clashes(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of rows that cannot be inserted: they exist in df, come several times, or have a null in them."""
    some = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    bad = counted.filter((F.col("_n") > 1) | some).select(*keys)
    return counted.join(df.select(*keys), keys, "left_semi").select(*keys).unionByName(bad).distinct()


def inserted(df: DataFrame, rows: DataFrame, name: str, at: Column) -> DataFrame:
    """df with rows as new rows of the table `name`: defaults where columns are missing, `at` as the time of making. Rows whose
    key exists are refused, as clashes() tells; of several new ones with a key the largest is taken."""
    keys = schemas.keys(name)
    new = schemas.conformed(rows, name, at).dropna(subset=keys)
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
    old = schemas.conformed(df, name)
    return old.unionByName(one.join(old.select(*keys), keys, "left_anti"))


def upserted(df: DataFrame, rows: DataFrame, keys: list[str], change: list[str]) -> DataFrame:
    """df with the `change` columns taken from rows where the key is known, and rows added where it is not.

    rows must have one row per key. A full outer join on the key; what df had otherwise is kept.
    """
    old, new = df.withColumn("_old", F.lit(True)), rows.select(*keys, F.struct(*[c for c in rows.columns if c not in keys]).alias("_n"), F.lit(True).alias("_new"))
    joined = old.join(new, keys, "full")
    has = [c for c in rows.columns if c not in keys]

    def value(c: str) -> Column:
        if c not in has:
            return F.col(c)
        pick = F.col("_new") if c in change else F.col("_old").isNull()
        return F.when(pick, F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*keys, *[value(c) for c in df.columns if c not in keys])


def updated(df: DataFrame, changes: DataFrame, value: str, at: Column | None = None) -> DataFrame:
    """df with `value` from changes (id, value) where an id is there; updated_at becomes `at` for those rows if given."""
    new = changes.select("id", F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    out = df.join(new, "id", "left")
    columns = [F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(c)).alias(c) if c == value else F.when(F.col("_hit"), at).otherwise(F.col(c)).alias(c) if c == "updated_at" and at is not None else F.col(c) for c in df.columns]
    return out.select(*columns)


def moved(holons: DataFrame, moves: DataFrame, at: Column) -> DataFrame:
    """moves: id, from_layer, to_layer. A holon moves only out of the layer named; updated_at becomes `at`."""
    ok = holons.select("id", "layer").join(moves, "id").filter(F.col("layer") == F.col("from_layer"))
    return updated(holons, ok.select("id", F.col("to_layer").alias("layer")), "layer", at)


def audit_rows(calls: DataFrame, at: Column) -> DataFrame:
    """calls: id, tool_name, operation, actor, target_id, result, input (map of strings), details -> audit rows, with the hash of
    the canonical JSON of the input."""
    entries = F.map_from_entries(F.array_sort(F.map_entries("input")))
    return calls.select(
        "id", at.alias("timestamp"), "tool_name", "operation", "actor", "target_id", S.short_hash(S.json_text(entries)).alias("input_hash"),
        "result", "details", F.lit("default").alias("context_id"),
    )


# Named queries -----------------------------------------------------------------------------------------------------


def q(f):
    return lambda spark, sf_dir: f(Base(spark, sf_dir))


def _ranked(df: DataFrame, per: str, newest: str) -> DataFrame:
    """Place of each row within its group, newest first, ties by id; a group of any size is spread over the tasks."""
    keyed = df.withColumn("_age", -F.unix_micros(F.col(newest).cast("timestamp"))).withColumn("_one", F.lit(1))
    return running_total(keyed, per, ["_age", "id"], "_one").select(*df.columns, (F.col("_before") + 1).cast("int").alias("place"))


def _listed(df: DataFrame, per: str, newest: str) -> DataFrame:
    """Every row with its place in its group, newest first; rows without an instant are the oldest. A null group is none."""
    rows = df.filter(F.col(per).isNotNull()).withColumn("_at", F.coalesce(F.col(newest).cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")))
    return _ranked(rows, per, "_at").drop("_at")


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("id"))


def _new_holons(b: Base) -> DataFrame:
    """A proposal for every holon: half of them of an id that exists."""
    return b.holons.select(F.when(F.length("id") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("-next"))).alias("id"), "type", "kind", F.lit("L0").alias("layer"), "title", F.lit("").alias("content"), "context_id", "scope", F.col("id").alias("parent_id"))


def _new_relations(b: Base) -> DataFrame:
    """Every relation again, and turned round."""
    return b.relations.select("source_id", "target_id", "relation_type").unionByName(b.relations.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation_type")).distinct()


def _measures(b: Base) -> DataFrame:
    return model.characteristics(b.raw("part")).withColumn("id", F.concat("holon_id", F.lit("-"), "name"))


def _new_evidence(b: Base) -> DataFrame:
    """An audit of every evidence row, valid until a text that is a date, an instant or neither."""
    text = F.when(F.length("id") % 3 == 0, F.date_format("valid_until", "yyyy-MM-dd")).when(F.length("id") % 3 == 1, F.lit("12:30")).otherwise(F.date_format("valid_until", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return b.evidence.select(F.concat("id", F.lit("-audit")).alias("id"), "holon_id", F.lit("audit_report").alias("type"), F.lit("").alias("content"), "verdict", S.parse_instant(text).alias("valid_until"))


def _calls(b: Base) -> DataFrame:
    """The audited call of every waiver."""
    until = F.date_format("waived_until", "yyyy-MM-dd")
    return b.waivers.select(F.concat(F.lit("log-"), "id").alias("id"), F.lit("check_decay").alias("tool_name"), F.lit("waive").alias("operation"), F.lit("user").alias("actor"), F.col("evidence_id").alias("target_id"), F.lit("SUCCESS").alias("result"), F.create_map(F.lit("until"), until, F.lit("rationale"), F.col("rationale")).alias("input"), F.lit("").alias("details"))


def _states(b: Base) -> tuple[DataFrame, DataFrame]:
    """The state of every context of holons, and what the audit log says since."""
    old = b.holons.filter("context_id IS NOT NULL").groupBy("context_id").agg(F.max("updated_at").alias("updated_at"))
    new = b.audit.filter("context_id IS NOT NULL").groupBy("context_id").agg(F.max_by("id", F.struct("timestamp", "id")).alias("last_commit"))
    return schemas.conformed(old, "state"), schemas.conformed(new, "state", as_of()).withColumn("assurance_threshold", F.lit(0.9))


STATE = ["active_role", "active_session_id", "active_role_context", "last_commit", "assurance_threshold", "updated_at"]


def _upsert_rows(b: Base) -> DataFrame:
    """New levels for every relation that verifies something, and a new relation for every waiver."""
    known = b.relations.filter(F.col("relation_type") == "verifiedBy").select("source_id", "target_id", "relation_type", F.lit(1).alias("congruence_level"), as_of().alias("created_at"))
    fresh = b.waivers.groupBy("evidence_id").agg(F.min("id").alias("t")).select(F.col("evidence_id").alias("source_id"), F.col("t").alias("target_id"), F.lit("waivedBy").alias("relation_type"), F.lit(3).alias("congruence_level"), as_of().alias("created_at"))
    return known.unionByName(fresh)


def _latest_layers(b: Base) -> DataFrame:
    rows = b.raw("holon_snapshots").select(S.key(F.col("id")).alias("id"), F.struct("updated_at", "snapshot_at", model.layer_name(F.col("layer")).alias("layer")).alias("s"))
    return rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("s.updated_at").alias("u"), F.max("s").alias("s")).select("id", "s.layer")


QUERIES = {
    "holon_ids": q(lambda b: b.holons.select("id")),
    "holon_by_id": q(lambda b: b.holons),
    "holon_titles": q(lambda b: b.holons.select("id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("id")).alias("title"))),
    "holon_lookup": q(lambda b: lookups(b.holons.select("id", "title", "layer"), _ids(b.evidence, "holon_id"))),
    "holon_title_lookup": q(lambda b: titles(b.holons, _ids(b.relations, "target_id"))),
    "evidence_lookup": q(lambda b: lookups(b.evidence.select("id", "holon_id", "verdict"), _ids(b.waivers, "evidence_id"))),
    "holon_insert": q(lambda b: inserted(b.holons, _new_holons(b), "holons", as_of()).select("id", "layer", "parent_id", "cached_r_score", "created_at", "updated_at")),
    "holon_insert_clashes": q(lambda b: clashes(b.holons, _new_holons(b), ["id"])),
    "relation_insert": q(lambda b: inserted(b.relations, _new_relations(b), "relations", as_of())),
    "evidence_insert": q(lambda b: inserted(b.evidence, _new_evidence(b), "evidence", as_of()).select("id", "holon_id", "valid_until", "created_at")),
    "audit_insert": q(lambda b: inserted(b.audit, audit_rows(_calls(b), as_of()), "audit_log", as_of()).select("id", "timestamp", "tool_name", "target_id", "input_hash", "context_id")),
    "work_insert": q(lambda b: inserted(model.work_records(b.raw("orders")).filter("performer_ref = 'F'"), model.work_records(b.raw("orders")), "work_records", as_of()).select("id", "performer_ref", "created_at")),
    "characteristic_insert": q(lambda b: inserted(_measures(b).limit(0), _measures(b), "characteristics", as_of())),
    "state_upsert": q(lambda b: upserted(*_states(b), ["context_id"], STATE)),
    "schema_evolved": q(lambda b: schemas.conformed(b.raw("holons").drop("parent_id", "cached_r_score"), "holons")),
    "rscore_update": q(lambda b: updated(b.holons.select("id", "cached_r_score", "updated_at"), b.evidence.filter("holon_id IS NOT NULL").groupBy(F.col("holon_id").alias("id")).agg(F.min(S.verdict_score(F.col("verdict"))).alias("cached_r_score")), "cached_r_score", as_of())),
    "layer_moves": q(lambda b: moved(b.holons.select("id", "layer", "updated_at"), b.holons.select("id", F.when(F.length("id") % 2 == 0, "L2").otherwise("L1").alias("from_layer"), F.when(F.length("id") % 2 == 0, "L1").otherwise("L0").alias("to_layer")), as_of())),
    "holons_by_layer": q(lambda b: _listed(b.holons.select("layer", "id", "created_at"), "layer", "created_at")),
    "children_by_parent": q(lambda b: _ranked(b.holons.filter("parent_id IS NOT NULL").select("parent_id", "id", "created_at"), "parent_id", "created_at")),
    "layer_counts": q(lambda b: b.holons.groupBy("context_id", "layer").agg(F.count("*").alias("count"))),
    "latest_by_context": q(lambda b: latest(b.holons.select("context_id", "id", "layer", "updated_at"), "context_id", "updated_at")),
    "layer_update": q(lambda b: updated(b.holons.select("id", "layer", "updated_at"), _latest_layers(b), "layer", as_of())),
    "evidence_by_holon": q(lambda b: _listed(b.evidence.select("holon_id", "id", "verdict", "created_at"), "holon_id", "created_at")),
    "evidence_with_carrier": q(lambda b: b.evidence.filter("carrier_ref IS NOT NULL AND carrier_ref <> ''").select("id", "holon_id", "carrier_ref")),
    "evidence_by_id": q(lambda b: b.evidence),
    "valid_until_parsed": q(lambda b: b.evidence.select("id", S.parse_instant(F.when(F.length("id") % 3 == 0, F.date_format("valid_until", "yyyy-MM-dd")).when(F.length("id") % 3 == 1, F.lit("soon")).otherwise(F.date_format("valid_until", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).cast("timestamp_ntz").alias("valid_until"))),
    "relations_by_target": q(lambda b: b.relations.groupBy("target_id", "relation_type").agg(F.count("*").alias("n"), F.min("source_id").alias("first_source"))),
    "relation_rows_by_target": q(lambda b: b.relations.select("target_id", "relation_type", "source_id", "congruence_level", "created_at")),
    "components_of": q(lambda b: b.relations.filter("relation_type = 'componentOf'").select("target_id", "source_id", "congruence_level")),
    "dependencies": q(lambda b: b.relations.filter(F.col("relation_type").isin(*WHOLES)).select("source_id", "target_id", "congruence_level")),
    "dependents": q(lambda b: b.relations.filter(F.col("relation_type").isin(*WHOLES)).groupBy("target_id").agg(F.count("*").alias("n_dependents"))),
    "dependent_rows": q(lambda b: b.relations.filter(F.col("relation_type").isin(*WHOLES)).select("target_id", "source_id", "relation_type", "congruence_level")),
    "collection_members": q(lambda b: b.relations.filter("relation_type = 'memberOf'").select("target_id", "source_id")),
    "relation_upsert": q(lambda b: upserted(b.relations, _upsert_rows(b), ["source_id", "target_id", "relation_type"], ["congruence_level"])),
    "relation_duplicates": q(lambda b: b.raw("relations").groupBy(S.key(F.col("source_id")).alias("source_id"), S.key(F.col("target_id")).alias("target_id"), "relation_type").agg(F.count("*").alias("n")).filter("n > 1")),
    "work_durations": q(lambda b: model.work_records(b.raw("orders")).select("id", "performer_ref", F.get_json_object("resource_ledger", "$.duration_ms").cast("long").alias("duration_ms"), S.days_between(F.col("ended_at"), F.col("started_at")).alias("days"))),
    "characteristics_by_holon": q(lambda b: model.characteristics(b.raw("part"))),
    "audit_by_context": q(lambda b: b.audit.groupBy("context_id").agg(F.count("*").alias("n"), F.max("timestamp").alias("last_at"), F.max_by("id", F.struct("timestamp", "id")).alias("last_id"))),
    "audit_rows_by_context": q(lambda b: _listed(b.audit, "context_id", "timestamp")),
    "audit_by_target": q(lambda b: _listed(b.audit.filter("target_id <> ''").select("target_id", "id", "timestamp", "result"), "target_id", "timestamp")),
    "recent_audit_topk": q(lambda b: recent(b.audit.select("id", "timestamp", "actor", "result"), 50)),
    "active_waiver_per_evidence": q(lambda b: latest(b.waivers.filter(F.col("waived_until") > as_of()).select("evidence_id", "id", "waived_until", "waived_by"), "evidence_id", "waived_until")),
    "waivers_by_evidence": q(lambda b: _ranked(b.waivers.select("evidence_id", "id", "created_at"), "evidence_id", "created_at")),
    "all_active_waivers": q(lambda b: b.waivers.filter(F.col("waived_until") > as_of()).select("id", "evidence_id", "waived_until", "rationale")),
    "constraint_violations": q(lambda b: b.raw("holons").filter(~F.col("cached_r_score").between(0.0, 1.0)).select(F.lit("holons.cached_r_score").alias("rule"), "id").unionByName(b.raw("relations").filter(~F.col("congruence_level").between(0, 3)).select(F.lit("relations.congruence_level").alias("rule"), F.col("source_id").alias("id")))),
}

SQL = {
    "holon_ids": sql("SELECT id FROM h"),
    "holon_by_id": sql("SELECT * FROM h"),
    "holon_titles": sql("SELECT id, coalesce(nullif(title, ''), id) AS title FROM h"),
    "holon_lookup": sql("SELECT id, title, layer FROM h WHERE id IN (SELECT holon_id FROM e)"),
    "holon_title_lookup": sql("SELECT x.id, coalesce(nullif(title, ''), x.id) AS title FROM (SELECT DISTINCT target_id AS id FROM r) x LEFT JOIN h ON h.id = x.id"),
    "evidence_lookup": sql("SELECT id, holon_id, verdict FROM e WHERE id IN (SELECT evidence_id FROM w)"),
    "holon_insert": sql(f"""SELECT id, layer, parent_id, cached_r_score, created_at, updated_at FROM h
        UNION ALL SELECT id || '-next', 'L0', id, CAST(0.0 AS DOUBLE), TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}' FROM h WHERE length(id) % 2 = 1 AND id || '-next' NOT IN (SELECT id FROM h)"""),
    "holon_insert_clashes": sql("SELECT id FROM h WHERE length(id) % 2 = 0"),
    "relation_insert": sql(f"""SELECT source_id, target_id, relation_type, congruence_level, created_at FROM r
        UNION ALL SELECT target_id, source_id, relation_type, 3, TIMESTAMP '{AS_OF}' FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.source_id = x.target_id AND y.target_id = x.source_id AND y.relation_type = x.relation_type)"""),
    "evidence_insert": sql(f"""SELECT id, holon_id, valid_until, created_at FROM e
        UNION ALL SELECT id || '-audit', holon_id, CASE length(id) % 3 WHEN 0 THEN date_trunc('day', valid_until) WHEN 1 THEN NULL ELSE date_trunc('second', valid_until) END, TIMESTAMP '{AS_OF}' FROM e"""),
    "audit_insert": sql(f"""SELECT id, "timestamp", tool_name, target_id, input_hash, context_id FROM a
        UNION ALL SELECT 'log-' || id, TIMESTAMP '{AS_OF}', 'check_decay', evidence_id, substr(sha256('{{"rationale":' || {json_of('rationale')} || ',"until":"' || strftime(waived_until, '%Y-%m-%d') || '"}}'), 1, 16), 'default' FROM w"""),
    "work_insert": f"SELECT 'work-' || o_orderkey AS id, o_orderstatus AS performer_ref, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE TIMESTAMP '{AS_OF}' END AS created_at FROM orders",
    "characteristic_insert": f"""SELECT 'p' || p_partkey || '-size' AS id, 'p' || p_partkey AS holon_id, 'size' AS name, 'ratio' AS scale, CAST(p_size AS VARCHAR) AS value, 'cm' AS unit, TIMESTAMP '{AS_OF}' AS created_at FROM part
        UNION ALL SELECT 'p' || p_partkey || '-brand', 'p' || p_partkey, 'brand', 'nominal', p_brand, NULL, TIMESTAMP '{AS_OF}' FROM part""",
    "state_upsert": sql(f"""SELECT context_id, NULL::VARCHAR AS active_role, NULL::VARCHAR AS active_session_id, NULL::VARCHAR AS active_role_context, n.last_commit,
        CASE WHEN n.context_id IS NULL THEN 0.8 ELSE 0.9 END::DOUBLE AS assurance_threshold, CASE WHEN n.context_id IS NULL THEN o.updated_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at
        FROM (SELECT context_id, max(updated_at) AS updated_at FROM h WHERE context_id IS NOT NULL GROUP BY 1) o FULL JOIN (SELECT context_id, arg_max(id, ("timestamp", id)) AS last_commit FROM a WHERE context_id IS NOT NULL GROUP BY 1) n USING (context_id)"""),
    "schema_evolved": "SELECT id, type, kind, layer, title, content, context_id, scope, NULL::VARCHAR AS parent_id, CAST(0.0 AS DOUBLE) AS cached_r_score, created_at, updated_at FROM holons",
    "rscore_update": sql(f"""SELECT h.id, CASE WHEN s.id IS NULL THEN cached_r_score ELSE s.v END AS cached_r_score, CASE WHEN s.id IS NULL THEN updated_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at FROM h LEFT JOIN
        (SELECT holon_id AS id, min(CAST(CASE lower(verdict) WHEN 'pass' THEN 1.0 WHEN 'degrade' THEN 0.5 ELSE 0.0 END AS DOUBLE)) AS v FROM e WHERE holon_id IS NOT NULL GROUP BY 1) s ON s.id = h.id"""),
    "layer_moves": sql(f"""SELECT id, CASE WHEN ok THEN CASE WHEN even THEN 'L1' ELSE 'L0' END ELSE layer END AS layer, CASE WHEN ok THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at
        FROM (SELECT *, length(id) % 2 = 0 AS even, coalesce(layer = CASE WHEN length(id) % 2 = 0 THEN 'L2' ELSE 'L1' END, false) AS ok FROM h)"""),
    "holons_by_layer": sql("SELECT layer, id, created_at, row_number() OVER (PARTITION BY layer ORDER BY created_at DESC NULLS LAST, id)::INT AS place FROM h WHERE layer IS NOT NULL"),
    "children_by_parent": sql("SELECT parent_id, id, created_at, row_number() OVER (PARTITION BY parent_id ORDER BY created_at DESC NULLS LAST, id)::INT AS place FROM h WHERE parent_id IS NOT NULL"),
    "layer_counts": sql("SELECT context_id, layer, count(*) AS count FROM h GROUP BY ALL"),
    "latest_by_context": sql("SELECT context_id, id, layer, updated_at FROM h QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY updated_at DESC NULLS LAST, id) = 1"),
    "layer_update": sql(
        f"SELECT h.id, CASE WHEN s.id IS NOT NULL THEN s.layer ELSE h.layer END AS layer, CASE WHEN s.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at FROM h LEFT JOIN s ON s.id = h.id",
        f"""s AS (SELECT {model._k('id')} AS id, CASE WHEN lower(trim(layer)) = 'invalid' THEN 'invalid' ELSE upper(trim(layer)) END AS layer FROM holon_snapshots
        QUALIFY row_number() OVER (PARTITION BY {model._k('id')} ORDER BY updated_at DESC NULLS LAST, snapshot_at DESC NULLS LAST, CASE WHEN lower(trim(layer)) = 'invalid' THEN 'invalid' ELSE upper(trim(layer)) END DESC) = 1)"""),
    "evidence_by_holon": sql("SELECT holon_id, id, verdict, created_at, row_number() OVER (PARTITION BY holon_id ORDER BY created_at DESC NULLS LAST, id)::INT AS place FROM e WHERE holon_id IS NOT NULL"),
    "evidence_with_carrier": sql("SELECT id, holon_id, carrier_ref FROM e WHERE carrier_ref IS NOT NULL AND carrier_ref <> ''"),
    "evidence_by_id": sql("SELECT * FROM e"),
    "valid_until_parsed": sql("SELECT id, CASE length(id) % 3 WHEN 0 THEN date_trunc('day', valid_until) WHEN 1 THEN NULL ELSE date_trunc('second', valid_until) END AS valid_until FROM e"),
    "relations_by_target": sql("SELECT target_id, relation_type, count(*) AS n, min(source_id) AS first_source FROM r GROUP BY ALL"),
    "relation_rows_by_target": sql("SELECT target_id, relation_type, source_id, congruence_level, created_at FROM r"),
    "components_of": sql("SELECT target_id, source_id, congruence_level FROM r WHERE relation_type = 'componentOf'"),
    "dependencies": sql("SELECT source_id, target_id, congruence_level FROM r WHERE relation_type IN ('componentOf', 'constituentOf')"),
    "dependents": sql("SELECT target_id, count(*) AS n_dependents FROM r WHERE relation_type IN ('componentOf', 'constituentOf') GROUP BY 1"),
    "dependent_rows": sql("SELECT target_id, source_id, relation_type, congruence_level FROM r WHERE relation_type IN ('componentOf', 'constituentOf')"),
    "collection_members": sql("SELECT target_id, source_id FROM r WHERE relation_type = 'memberOf'"),
    "relation_upsert": sql(f"""SELECT source_id, target_id, relation_type, created_at, CASE WHEN relation_type = 'verifiedBy' THEN 1 ELSE congruence_level END AS congruence_level FROM r
        UNION ALL SELECT evidence_id, min(id), 'waivedBy', TIMESTAMP '{AS_OF}', 3 FROM w GROUP BY evidence_id"""),
    "relation_duplicates": sql(f"SELECT {model._k('source_id')} AS source_id, {model._k('target_id')} AS target_id, relation_type, count(*) AS n FROM relations GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "work_durations": "SELECT 'work-' || o_orderkey AS id, o_orderstatus AS performer_ref, o_orderkey % 7 * 86400000 AS duration_ms, CAST(o_orderkey % 7 AS INT) AS days FROM orders",
    "characteristics_by_holon": """SELECT 'p' || p_partkey AS holon_id, 'size' AS name, 'ratio' AS scale, CAST(p_size AS VARCHAR) AS value, 'cm' AS unit FROM part
        UNION ALL SELECT 'p' || p_partkey, 'brand', 'nominal', p_brand, NULL FROM part""",
    "audit_by_context": sql('SELECT context_id, count(*) AS n, max("timestamp") AS last_at, arg_max(id, ("timestamp", id)) AS last_id FROM a GROUP BY 1'),
    "audit_rows_by_context": sql('SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY "timestamp" DESC NULLS LAST, id)::INT AS place FROM a WHERE context_id IS NOT NULL'),
    "audit_by_target": sql("""SELECT target_id, id, "timestamp", result, row_number() OVER (PARTITION BY target_id ORDER BY "timestamp" DESC NULLS LAST, id)::INT AS place FROM a WHERE target_id IS NOT NULL AND target_id <> ''"""),
    "recent_audit_topk": sql('SELECT id, "timestamp", actor, result FROM a ORDER BY "timestamp" DESC NULLS LAST, id LIMIT 50'),
    "active_waiver_per_evidence": sql(f"SELECT evidence_id, id, waived_until, waived_by FROM w WHERE waived_until > TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY waived_until DESC, id) = 1"),
    "waivers_by_evidence": sql("SELECT evidence_id, id, created_at, row_number() OVER (PARTITION BY evidence_id ORDER BY created_at DESC NULLS LAST, id)::INT AS place FROM w"),
    "all_active_waivers": sql(f"SELECT id, evidence_id, waived_until, rationale FROM w WHERE waived_until > TIMESTAMP '{AS_OF}'"),
    "constraint_violations": "SELECT 'holons.cached_r_score' AS rule, id FROM holons WHERE NOT cached_r_score BETWEEN 0.0 AND 1.0 UNION ALL SELECT 'relations.congruence_level', source_id FROM relations WHERE NOT congruence_level BETWEEN 0 AND 3",
}
