"""Expired evidence, waivers, and the freshness report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.scalars import days_between, parse_instant
from corvane.operators.model import AS_OF, Base, as_of, sql
from corvane.operators.store import q

SOON_DAYS = 30


def stale_evidence(holons: DataFrame, evidence: DataFrame, waivers: DataFrame, at: Column) -> DataFrame:
    """evidence_id, holon_id, title, layer, evidence_type, days_overdue.

    Stale is what expired on a day before that of `at` and has no waiver that still runs. Evidence of an unknown holon is
    left out. Days are whole days from the day of expiry to `at`. Waivers are aggregated before the join.
    """
    latest = waivers.groupBy(F.col("evidence_id").alias("id")).agg(F.max("waived_until").alias("_until"))
    old = evidence.filter(F.to_date("valid_until") < F.to_date(at)).select("id", "holon_id", F.col("type").alias("evidence_type"), days_between(at, F.to_date("valid_until")).alias("days_overdue"))
    unwaived = old.join(latest, "id", "left").filter(F.col("_until").isNull() | (F.col("_until") < at))
    about = holons.select(F.col("id").alias("holon_id"), "title", "layer")
    return unwaived.join(about, "holon_id").select(F.col("id").alias("evidence_id"), "holon_id", "title", "layer", "evidence_type", "days_overdue")


def active_waivers(holons: DataFrame, evidence: DataFrame, waivers: DataFrame, at: Column) -> DataFrame:
    """Waivers that still run, with their holon; days_until_expiry truncated; expires_soon within 30 days."""
    live = waivers.filter(F.col("waived_until") > at).select("evidence_id", "waived_until", "waived_by", "rationale")
    joined = live.join(evidence.select(F.col("id").alias("evidence_id"), "holon_id"), "evidence_id").join(holons.select(F.col("id").alias("holon_id"), "title"), "holon_id")
    days = days_between(F.col("waived_until"), at)
    return joined.select("evidence_id", "holon_id", "title", "waived_until", "waived_by", "rationale", days.alias("days_until_expiry"), (days <= SOON_DAYS).alias("expires_soon"))


def report_sections(stale: DataFrame, waived: DataFrame) -> DataFrame:
    """section, item, line: the lines of the freshness report in (section, item) order. A line per row, so no report has to
    fit in one value: the stale rows by holon, worst first, then the waivers and their warnings; or that all is fresh."""
    row = F.format_string("| %s | %s | EXPIRED | %d days overdue |", "evidence_id", "evidence_type", "days_overdue")
    lines = stale.select(F.lit(2).alias("section"), F.concat_ws(" ", "holon_id", F.lit("1"), F.lpad((1_000_000 - F.col("days_overdue")).cast("string"), 8, "0"), "evidence_id").alias("item"), row.alias("line"))
    heads = stale.select("holon_id", "title", "layer").distinct().select(F.lit(2).alias("section"), F.concat_ws(" ", "holon_id", F.lit("0")).alias("item"), F.format_string("#### %s (%s)", F.coalesce("title", F.lit("")), F.coalesce("layer", F.lit(""))).alias("line"))
    count = stale.agg(F.countDistinct("holon_id").alias("n")).select(
        F.lit(1).alias("section"), F.lit("").alias("item"),
        F.when(F.col("n") == 0, "### All holons FRESH ✓").otherwise(F.format_string("### STALE (%d holons require action)", "n")).alias("line"))
    cells = F.format_string("| %s | %s | %s | %s | %s |", F.coalesce("title", F.lit("")), F.col("evidence_id"), F.date_format("waived_until", "yyyy-MM-dd"), F.col("waived_by"), F.coalesce("rationale", F.lit("")))
    until = F.concat_ws(" ", F.date_format("waived_until", "yyyy-MM-dd HH:mm:ss"), "evidence_id")
    waivers = waived.select(F.lit(3).alias("section"), until.alias("item"), cells.alias("line"))
    warn = waived.filter("expires_soon").select(F.lit(4).alias("section"), until.alias("item"), F.format_string("⚠️ Waiver for %s expires in %d days", "evidence_id", "days_until_expiry").alias("line"))
    return count.unionByName(heads).unionByName(lines).unionByName(waivers).unionByName(warn)


def waiver_requests(requests: DataFrame, evidence: DataFrame, at: Column) -> DataFrame:
    """requests (evidence_id, until, rationale) with the instant that `until` names and what is wrong: unknown evidence, a
    missing value, no date, or one in the past. problem is null for a good request."""
    known = requests.join(evidence.select(F.col("id").alias("evidence_id"), F.lit(True).alias("_known")), "evidence_id", "left")
    when = parse_instant(F.col("until")).cast("timestamp_ntz")
    problem = (
        F.when((F.coalesce("until", F.lit("")) == "") | (F.coalesce("rationale", F.lit("")) == ""), "until and rationale are required")
        .when(F.col("_known").isNull(), "unknown evidence").when(when.isNull(), "until is no date").when(when < at, "until is not in the future")
    )
    return known.select("evidence_id", "until", "rationale", when.alias("waived_until"), problem.alias("problem"))


def _stale(b: Base) -> DataFrame:
    return stale_evidence(b.holons, b.evidence, b.waivers, as_of())


def _waived(b: Base) -> DataFrame:
    return active_waivers(b.holons, b.evidence, b.waivers, as_of())


QUERIES = {
    "stale_evidence": q(_stale),
    "stale_holons": q(lambda b: _stale(b).groupBy("holon_id").agg(F.count("*").alias("n_stale"), F.max("days_overdue").alias("worst"))),
    "stale_holon_count": q(lambda b: _stale(b).agg(F.countDistinct("holon_id").alias("n"))),
    "active_waivers": q(_waived),
    "expiring_waivers_30d": q(lambda b: _waived(b).filter("expires_soon").select("evidence_id", "days_until_expiry")),
    "freshness_report": q(lambda b: report_sections(_stale(b), _waived(b))),
    "waiver_requests": q(lambda b: waiver_requests(b.waivers.select("evidence_id", F.date_format("waived_until", "yyyy-MM-dd").alias("until"), "rationale"), b.evidence, as_of())),
}

_STALE = f"""stale AS (SELECT e.id AS evidence_id, e.holon_id, h.title, h.layer, e.type AS evidence_type,
    CAST(trunc(epoch_us(TIMESTAMP '{AS_OF}' - date_trunc('day', e.valid_until)) / 86400000000) AS INT) AS days_overdue
  FROM e JOIN h ON h.id = e.holon_id LEFT JOIN (SELECT evidence_id, max(waived_until) AS until FROM w GROUP BY 1) x ON x.evidence_id = e.id
  WHERE CAST(e.valid_until AS DATE) < DATE '{AS_OF[:10]}' AND (until IS NULL OR until < TIMESTAMP '{AS_OF}')),
waived AS (SELECT w.evidence_id, e.holon_id, h.title, w.waived_until, w.waived_by, w.rationale, CAST(trunc(epoch_us(w.waived_until - TIMESTAMP '{AS_OF}') / 86400000000) AS INT) AS days_until_expiry
  FROM w JOIN e ON e.id = w.evidence_id JOIN h ON h.id = e.holon_id WHERE w.waived_until > TIMESTAMP '{AS_OF}')"""
SQL = {
    "stale_evidence": sql("SELECT * FROM stale", _STALE),
    "stale_holons": sql("SELECT holon_id, count(*) AS n_stale, max(days_overdue) AS worst FROM stale GROUP BY 1", _STALE),
    "stale_holon_count": sql("SELECT count(DISTINCT holon_id) AS n FROM stale", _STALE),
    "active_waivers": sql("SELECT *, days_until_expiry <= 30 AS expires_soon FROM waived", _STALE),
    "expiring_waivers_30d": sql("SELECT evidence_id, days_until_expiry FROM waived WHERE days_until_expiry <= 30", _STALE),
    "freshness_report": sql("""SELECT 1 AS section, '' AS item, CASE WHEN count(*) = 0 THEN '### All holons FRESH ✓' ELSE printf('### STALE (%d holons require action)', count(DISTINCT holon_id)) END AS line FROM stale
        UNION ALL SELECT DISTINCT 2, holon_id || ' 0', printf('#### %s (%s)', coalesce(title, ''), coalesce(layer, '')) FROM stale
        UNION ALL SELECT 2, concat_ws(' ', holon_id, '1', lpad(CAST(1000000 - days_overdue AS VARCHAR), 8, '0'), evidence_id), printf('| %s | %s | EXPIRED | %d days overdue |', evidence_id, evidence_type, days_overdue) FROM stale
        UNION ALL SELECT 3, strftime(waived_until, '%Y-%m-%d %H:%M:%S') || ' ' || evidence_id, printf('| %s | %s | %s | %s | %s |', coalesce(title, ''), evidence_id, strftime(waived_until, '%Y-%m-%d'), waived_by, coalesce(rationale, '')) FROM waived
        UNION ALL SELECT 4, strftime(waived_until, '%Y-%m-%d %H:%M:%S') || ' ' || evidence_id, printf('⚠️ Waiver for %s expires in %d days', evidence_id, days_until_expiry) FROM waived WHERE days_until_expiry <= 30""", _STALE),
    "waiver_requests": sql(f"""SELECT w.evidence_id, strftime(waived_until, '%Y-%m-%d') AS until, rationale, date_trunc('day', waived_until) AS waived_until,
        CASE WHEN coalesce(rationale, '') = '' THEN 'until and rationale are required' WHEN e.id IS NULL THEN 'unknown evidence' WHEN date_trunc('day', waived_until) < TIMESTAMP '{AS_OF}' THEN 'until is not in the future' END AS problem
        FROM w LEFT JOIN e ON e.id = w.evidence_id"""),
}
