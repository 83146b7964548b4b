"""Questions over several tables: changed carriers, decisions to review, search, listings, status; and scalar functions on whole tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import scalars as S
from corvane.operators import freshness, reliability
from corvane.operators.model import Base, as_of, json_of, sql
from corvane.operators.store import latest, q
from corvane.session import removed_at_end, shared_dir
from corvane.sources import tables

CONFIG = ("package.json", "go.mod", "Cargo.toml", "pyproject.toml", "Dockerfile")


def stale_carriers(evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """Evidence whose carrier is among the changed files."""
    return evidence.join(changed.select(F.col("path").alias("carrier_ref")).distinct(), "carrier_ref", "left_semi")


def decisions_to_review(holons: DataFrame, relations: DataFrame, evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """decision_id, holon_id, evidence_id, carrier_ref: decisions that select a holon whose evidence rests on a changed file."""
    moved = stale_carriers(evidence, changed).select("holon_id", F.col("id").alias("evidence_id"), "carrier_ref")
    chosen = relations.filter("relation_type = 'selects'").select(F.col("source_id").alias("id"), F.col("target_id").alias("holon_id"))
    made = chosen.join(holons.filter("layer = 'DRR'").select("id"), "id", "left_semi")
    return made.join(moved, "holon_id").select(F.col("id").alias("decision_id"), "holon_id", "evidence_id", "carrier_ref")


def drifted(changed: DataFrame, files: tuple[str, ...] = CONFIG) -> DataFrame:
    """Changed files that define the context: a file of one of the given names in any folder."""
    return changed.filter(F.element_at(F.split("path", "/"), -1).isin(*files) | F.col("path").startswith("config/"))


def search(holons: DataFrame, scores: DataFrame, words: list[str]) -> DataFrame:
    """Holons with any of the words in title or content, case ignored, and r where the layer is L1, L2 or DRR."""
    text = F.lower(F.concat_ws(" ", "title", "content"))
    hit = reduce(Column.__or__, [text.contains(w.lower()) for w in words], F.lit(False))
    rated = F.col("layer").isin("L1", "L2", "DRR")
    return holons.filter(hit).join(scores.select("id", "r"), "id", "left").select("id", "title", "layer", F.when(rated, F.round("r", 6)).alias("r"))


def decision_listing(holons: DataFrame, relations: DataFrame) -> DataFrame:
    """decision_id, title, relation_type, holon_id, holon_title: what each decision selects and rejects, in long form."""
    links = relations.filter(F.col("relation_type").isin("selects", "rejects")).select(F.col("source_id").alias("id"), "relation_type", F.col("target_id").alias("holon_id"))
    made = holons.filter("layer = 'DRR'").select("id", "title").join(links, "id", "left")
    names = holons.select(F.col("id").alias("holon_id"), F.col("title").alias("holon_title"))
    return made.join(names, "holon_id", "left").select(F.col("id").alias("decision_id"), "title", "relation_type", "holon_id", "holon_title")


def status(holons: DataFrame, stale: DataFrame) -> DataFrame:
    """Per context: holons per layer, the layer updated last, and how many holons have stale evidence."""
    counts = holons.groupBy("context_id").agg(*[F.count_if(F.col("layer") == layer).alias(f"n_{layer.lower()}") for layer in ("L0", "L1", "L2", "DRR", "invalid")])
    last = latest(holons.select("context_id", "id", "layer", "updated_at"), "context_id", "updated_at").select("context_id", F.col("layer").alias("last_layer"))
    old = stale.select(F.col("holon_id").alias("id")).distinct().join(holons.select("id", "context_id"), "id").groupBy("context_id").agg(F.count("*").alias("_n"))
    return counts.join(last, "context_id").join(old, "context_id", "left").withColumn("n_stale", F.coalesce("_n", F.lit(0))).drop("_n")


def _changed(b: Base) -> DataFrame:
    """A change list as a name-status diff prints it, of all carriers under src and config."""
    lines = b.evidence.filter(F.col("carrier_ref").rlike("^(src|config)/")).select(F.concat(F.lit("M\t"), F.col("carrier_ref")).alias("value")).distinct()
    return tables.changed_files(lines)


def _files(b: Base) -> DataFrame:
    """The Markdown projection of holons; where the kind is missing, someone has edited the file since."""
    edited = F.concat("document", F.lit("\nedited"))
    return tables.projection(b.holons, "kind").select("path", F.when(F.col("kind").isNull(), edited).otherwise(F.col("document")).alias("document"))


def _markdown(b: Base) -> DataFrame:
    """The files of _files(), written to the shared folder and read again."""
    folder = f"{shared_dir(b.spark)}/corvane-markdown-{uuid.uuid4().hex}"
    tables.write_markdown(_files(b), folder)
    removed_at_end(b.spark, folder)
    return tables.read_markdown(b.spark, folder)


def _documents(b: Base) -> DataFrame:
    return b.raw("documents")


def _targets(b: Base) -> DataFrame:
    return b.audit.filter("target_id LIKE '%/%'")


QUERIES = {
    "carrier_staleness": q(lambda b: stale_carriers(b.evidence, _changed(b)).select("id", "holon_id", "carrier_ref")),
    "decisions_to_review": q(lambda b: decisions_to_review(b.holons, b.relations, b.evidence, _changed(b))),
    "context_drift": q(lambda b: drifted(_changed(b))),
    "keyword_search": q(lambda b: search(b.holons, reliability.reliability(b.holons, b.evidence, b.relations, as_of()), ["ledger", "quota"])),
    "drr_listing": q(lambda b: decision_listing(b.holons, b.relations)),
    "status_summary": q(lambda b: status(b.holons, freshness.stale_evidence(b.holons, b.evidence, b.waivers, as_of()))),
    "slugify": q(lambda b: b.holons.select("id", S.slug(F.col("title")).alias("slug"))),
    "content_hash": q(lambda b: _documents(b).select("doc_id", S.content_hash(F.col("text")).alias("content_hash"))),
    "input_hash": q(lambda b: b.audit.select("id", S.short_hash(S.canonical_json({"tool": F.col("tool_name"), "actor": F.col("actor")})).alias("input_hash"))),
    "tamper_check": q(lambda b: tables.validated(_files(b)).select("path", "tampered", "expected", "actual")),
    "markdown_files": q(lambda b: tables.validated(_markdown(b)).select("path", "tampered", "expected", "actual")),
    "self_healing": q(lambda b: tables.healed(_files(b).withColumn("path", F.concat(F.lit("/"), "path")), b.holons).select("path", "was_tampered", S.tampered(F.col("document")).alias("still_tampered"))),
    "path_holon_id": q(lambda b: _targets(b).select("id", S.holon_id_of_path(F.col("target_id")).alias("holon_id"))),
    "path_layer": q(lambda b: _targets(b).select("id", S.layer_of_path(F.col("target_id")).alias("layer"))),
    "format_vocabulary": q(lambda b: _documents(b).select("doc_id", S.format_vocabulary(F.col("text")).alias("vocabulary"))),
    "format_invariants": q(lambda b: _documents(b).select("doc_id", S.format_invariants(F.col("text")).alias("invariants"))),
    "carrier_of_kind": q(lambda b: b.holons.select("id", S.carrier_of_kind(F.col("kind")).alias("carrier"), S.relation_of_kind(F.col("kind")).alias("relation_type"))),
    "level_clamp": q(lambda b: b.relations.select("source_id", "target_id", "relation_type", S.clamp_level(F.col("congruence_level")).alias("level"), S.penalty(S.clamp_level(F.col("congruence_level"))).alias("penalty"))),
    "default_expiry": q(lambda b: b.evidence.select("id", S.default_expiry(F.col("created_at")).cast("string").alias("expires"), S.two_places(S.verdict_score(F.col("verdict"))).alias("score"))),
    "file_names": q(lambda b: b.evidence.select("id", S.evidence_file(F.col("created_at"), F.col("type"), F.col("holon_id")).alias("name"))),
    "decision_files": q(lambda b: b.holons.filter("layer = 'DRR'").select("id", S.decision_file(F.col("created_at"), F.col("title")).alias("name"))),
    "optional_texts": q(lambda b: b.evidence.select("id", F.nullif("carrier_ref", F.lit("")).alias("carrier_ref"), F.nullif("assurance_level", F.lit("")).alias("assurance_level"))),
}

_CHANGED = "changed AS (SELECT DISTINCT 'M' AS status, carrier_ref AS path FROM e WHERE regexp_matches(carrier_ref, '^(src|config)/'))"
_TEXT = "('# ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(content, ''))"
_ITEMS = "CASE WHEN regexp_matches(text, '{p}') THEN array_to_string(['{a}' || split_part(s, chr(2), 1) || '{b}' || trim(split_part(s, chr(2), 2), E' \\n\\t\\r') for s in string_split(regexp_replace(text, '{p}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) if contains(s, chr(2))], chr(10)) ELSE text END"
SQL = {
    "carrier_staleness": sql("SELECT id, holon_id, carrier_ref FROM e WHERE carrier_ref IN (SELECT path FROM changed)", _CHANGED),
    "decisions_to_review": sql("SELECT h.id AS decision_id, e.holon_id, e.id AS evidence_id, e.carrier_ref FROM h JOIN r ON r.source_id = h.id AND relation_type = 'selects' JOIN e ON e.holon_id = r.target_id WHERE layer = 'DRR' AND carrier_ref IN (SELECT path FROM changed)", _CHANGED),
    "context_drift": sql("SELECT status, path FROM changed WHERE starts_with(path, 'config/') OR parse_filename(path) IN ('package.json', 'go.mod', 'Cargo.toml', 'pyproject.toml', 'Dockerfile')", _CHANGED),
    "keyword_search": sql("SELECT h.id, h.title, h.layer, CASE WHEN h.layer IN ('L1', 'L2', 'DRR') THEN round(score.r, 6) END AS r FROM h JOIN score ON score.id = h.id WHERE contains(lower(concat_ws(' ', h.title, h.content)), 'ledger') OR contains(lower(concat_ws(' ', h.title, h.content)), 'quota')", reliability._R, True),
    "drr_listing": sql("SELECT h.id AS decision_id, h.title, r.relation_type, r.target_id AS holon_id, t.title AS holon_title FROM h LEFT JOIN r ON r.source_id = h.id AND r.relation_type IN ('selects', 'rejects') LEFT JOIN h t ON t.id = r.target_id WHERE h.layer = 'DRR'"),
    "status_summary": sql("""SELECT context_id, count(*) FILTER (layer = 'L0') AS n_l0, count(*) FILTER (layer = 'L1') AS n_l1, count(*) FILTER (layer = 'L2') AS n_l2, count(*) FILTER (layer = 'DRR') AS n_drr, count(*) FILTER (layer = 'invalid') AS n_invalid,
        arg_max(layer, (updated_at, row_)) AS last_layer, count(*) FILTER (id IN (SELECT holon_id FROM stale)) AS n_stale FROM (SELECT *, -row_number() OVER (ORDER BY id) AS row_ FROM h) GROUP BY 1""", freshness._STALE),
    "slugify": sql("SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM h"),
    "content_hash": "SELECT doc_id, substr(sha256(text), 1, 32) AS content_hash FROM documents",
    "input_hash": sql(f"""SELECT id, substr(sha256('{{"actor":' || {json_of('actor')} || ',"tool":' || {json_of('tool_name')} || '}}'), 1, 16) AS input_hash FROM a"""),
    "tamper_check": sql(f"SELECT 'knowledge/' || layer || '/' || id || '.md' AS path, kind IS NULL AS tampered, substr(sha256({_TEXT}), 1, 32) AS expected, substr(sha256({_TEXT} || CASE WHEN kind IS NULL THEN chr(10) || 'edited' ELSE '' END), 1, 32) AS actual FROM h"),
    "markdown_files": sql(f"SELECT 'knowledge/' || layer || '/' || id || '.md' AS path, kind IS NULL AS tampered, substr(sha256({_TEXT}), 1, 32) AS expected, substr(sha256({_TEXT} || CASE WHEN kind IS NULL THEN chr(10) || 'edited' ELSE '' END), 1, 32) AS actual FROM h"),
    "self_healing": sql("SELECT '/knowledge/' || layer || '/' || id || '.md' AS path, kind IS NULL AS was_tampered, kind IS NULL AND layer = 'DRR' AS still_tampered FROM h"),
    "path_holon_id": sql(r"SELECT id, regexp_extract(target_id, '/knowledge/(?:L[012]|invalid)/([^/]+)\.md$', 1) AS holon_id FROM a WHERE contains(target_id, '/')"),
    "path_layer": sql("SELECT id, regexp_extract(target_id, '/knowledge/(L[012]|invalid)/', 1) AS layer FROM a WHERE contains(target_id, '/')"),
    "format_vocabulary": "SELECT doc_id, " + _ITEMS.format(p=S.TERM, a="- **", b="**: ") + " AS vocabulary FROM documents",
    "format_invariants": "SELECT doc_id, " + _ITEMS.format(p=S.NUMBER, a="", b=". ") + " AS invariants FROM documents",
    "carrier_of_kind": sql("SELECT id, CASE WHEN kind = 'episteme' THEN 'formal-logic' ELSE 'internal-logic' END AS carrier, CASE WHEN kind = 'episteme' THEN 'constituentOf' ELSE 'componentOf' END AS relation_type FROM h"),
    "level_clamp": sql("SELECT source_id, target_id, relation_type, CASE WHEN congruence_level BETWEEN 1 AND 3 THEN congruence_level ELSE 3 END AS level, CAST(CASE congruence_level WHEN 2 THEN 0.1 WHEN 1 THEN 0.4 ELSE 0.0 END AS DOUBLE) AS penalty FROM r"),
    "default_expiry": sql("SELECT id, strftime(CAST(created_at AS DATE) + 90, '%Y-%m-%d') AS expires, CASE lower(verdict) WHEN 'pass' THEN '1.00' WHEN 'degrade' THEN '0.50' ELSE '0.00' END AS score FROM e"),
    "file_names": sql("SELECT id, concat_ws('-', strftime(created_at, '%Y-%m-%d'), type, holon_id) || '.md' AS name FROM e"),
    "decision_files": sql("SELECT id, 'DRR-' || strftime(created_at, '%Y-%m-%d') || '-' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS name FROM h WHERE layer = 'DRR'"),
    "optional_texts": sql("SELECT id, nullif(carrier_ref, '') AS carrier_ref, nullif(assurance_level, '') AS assurance_level FROM e"),
}
