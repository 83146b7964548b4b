"""Repeated consecutive events collapsed into one event with its count and duration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.scalars import key
from corvane.operators.sequence import stretches, unequal
from corvane.operators.skew import salted_join
from corvane.session import staged
from corvane.sources.tables import table

GAP_SECONDS = 600
#: A digest cut short has at least so many digits.
LEAST_DIGITS = 8
#: Distinct written names that are sent to every task; more of them are joined by a shuffle that splits hot names.
SENT_NAMES = 20_000


def name_tokens(name: Column) -> Column:
    """A tool name as lower-case tokens joined by _: camel case split, a version after @ dropped, decoration as tokens."""
    bare = F.regexp_replace(F.trim(name), r"@.*$", "")
    split = F.regexp_replace(F.regexp_replace(bare, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(split), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def aliases(catalog: DataFrame) -> DataFrame:
    """alias, entry: each entry's own name as tokens, and the name without a first token that most entries share. An alias
    that several entries have is left to the entry of which it is the whole name, or to none."""
    # A catalogue is a table of names: one task reads it, and nothing below shuffles.
    names = catalog.filter(F.col("tool_name").isNotNull()).select(F.col("tool_name").alias("entry")).coalesce(1).distinct()
    names = names.withColumn("alias", F.regexp_replace(F.regexp_replace(F.lower("entry"), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")).filter("alias <> ''")
    head = names.withColumn("_first", F.substring_index("alias", "_", 1)).withColumn("_long", F.instr("alias", "_") > 0)
    shared = head.filter("_long").groupBy("_first").agg(F.count("*").alias("_n")).filter(F.col("_n") * 2 > names.count()).select("_first")
    short = head.filter("_long").join(shared, "_first", "left_semi").select("entry", F.expr("substring(alias, length(_first) + 2)").alias("alias"), F.lit(False).alias("whole"))
    both = names.select("entry", "alias", F.lit(True).alias("whole")).unionByName(short)
    kept = both.groupBy("alias").agg(F.max(F.when(F.col("whole"), F.col("entry"))).alias("_own"), F.max("entry").alias("_one"), F.min("entry").alias("_least"))
    return kept.filter(F.col("_own").isNotNull() | (F.col("_one") == F.col("_least"))).select("alias", F.coalesce("_own", "_one").alias("entry"))


def tools(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """tool_name, tool for the distinct written names: the catalogue entry with the longest alias at the end of the name's
    tokens, or, of a name without separators, the one whose alias it is without separators. A name that denotes none
    stands for itself, as tokens. Equi-joins of distinct names with aliases: a catalogue of any size."""
    known = aliases(catalog)  # small and without a shuffle: cheaper made twice than written
    written = names.filter(F.col("tool_name").isNotNull()).select("tool_name", F.coalesce(name_tokens(F.col("tool_name")), F.lit("")).alias("_tokens"))
    parts = F.split("_tokens", "_")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    suffix = written.select("tool_name", "_tokens", F.posexplode(tails).alias("_at", "alias")).join(known, "alias", "left")
    best = suffix.groupBy("tool_name", "_tokens").agg(F.min_by("entry", F.when(F.col("entry").isNotNull(), F.col("_at"))).alias("_entry"))
    glued = known.groupBy(F.regexp_replace("alias", "_", "").alias("_glued")).agg(F.max_by("entry", F.struct(F.length(F.regexp_replace("alias", "[^_]", "")), F.length("alias"), "entry")).alias("_whole"))
    out = best.withColumn("_glued", F.regexp_replace("_tokens", "_", "")).join(glued, "_glued", "left")
    return out.select("tool_name", F.coalesce("_entry", "_whole", "_tokens").alias("tool"))


def digest(stored: Column) -> Column:
    """The hex digits of a stored hash: without blanks, case, a scheme such as sha256: or a leading 0x. Null where blank."""
    bare = F.regexp_replace(F.lower(stored), r"\s+", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"^[a-z0-9_-]+[:=]", ""), r"^0x|=+$", ""), F.lit(""))


def same_digest(a: str | None, b: str | None) -> bool:
    """Equal, or the shorter, of 8 digits or more, begins the longer. Null equals only null."""
    if a is None or b is None:
        return a is b
    return a == b or (min(len(a), len(b)) >= LEAST_DIGITS and (a.startswith(b) or b.startswith(a)))


def events(audit_log: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per event: id, context_id, timestamp, tool, digest. Rows with one id are one event, the earliest counts;
    ids and contexts are compared by their slug. Rows without an id cannot be named and are left out; a null tool name is
    the empty string."""
    named = staged(tools(audit_log.select("tool_name").distinct(), catalog), "tools")
    count = named.count()
    # Names and hashes shrink before the shuffle; few names go to every task, many are joined with hot ones split.
    if count <= SENT_NAMES:
        log = audit_log.join(F.broadcast(named), "tool_name", "left")
    else:
        weights = audit_log.filter(F.col("tool_name").isNotNull()).groupBy("tool_name").agg(F.count("*").alias("_w"))
        log = salted_join(audit_log, staged(named.join(weights, "tool_name"), "tools"), "tool_name", "_w", ["id"], "left")
    row = F.struct(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("id"), F.coalesce(key(F.col("context_id")), F.lit("")).alias("context_id"),
        F.coalesce("tool", F.lit("")).alias("tool"), digest(F.col("input_hash")).alias("digest"),
    )
    one = log.select("id", "timestamp", "context_id", "tool", "input_hash").filter(key(F.col("id")).isNotNull()).groupBy(key(F.col("id")).alias("_key")).agg(F.min(row).alias("e"))
    return one.select("e.*")


def breaks(gap_seconds: int):
    """Whether an event does not continue the run of the one before."""

    def differs(before: pa.Table, here: pa.Table) -> np.ndarray:
        gap = pc.subtract(here.column("at"), before.column("at"))
        apart = unequal(before.column("context_id"), here.column("context_id")) | unequal(before.column("tool"), here.column("tool"))
        apart |= ~np.asarray(pc.fill_null(pc.less_equal(gap, gap_seconds * 1_000_000), False))
        # Unequal digests may still be one, cut short.
        cut = np.flatnonzero(~apart & unequal(before.column("digest"), here.column("digest")))
        apart[cut] = [not same_digest(a, b) for a, b in zip(before.column("digest").take(cut).to_pylist(), here.column("digest").take(cut).to_pylist())]
        return apart

    return differs


def collapsed(rows: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Each run of neighbouring equal events as one row: context_id, tool, first_id, last_id, first_at, last_at, n_events,
    duration_s.

    Boundary-only: an event is kept where it differs from its predecessor in context, tool or digest, or comes more than
    gap_seconds later. Over the kept rows, the next start gives the rest: the difference of positions is the count, and
    the event before that start is the end of the run. Contexts are range-partitioned by time, never gathered in one
    task. An event without a timestamp is a run of its own.
    """
    placed = rows.withColumn("at", F.unix_micros(F.col("timestamp").cast("timestamp"))).drop("timestamp")
    led = stretches(placed, ["context_id", "at", "id"], ["context_id", "tool", "digest", "id", "at"], breaks(gap_seconds), last=("id", "at"))
    end = F.col("_last.at")
    return led.select(
        "context_id", "tool", F.col("id").alias("first_id"), F.col("_last.id").alias("last_id"),
        F.timestamp_micros(F.col("at")).cast("timestamp_ntz").alias("first_at"), F.timestamp_micros(end).cast("timestamp_ntz").alias("last_at"),
        F.col("_count").alias("n_events"), ((end - F.col("at")) / 1e6).alias("duration_s"),
    )


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(events(table(spark, sf_dir, "audit_log"), table(spark, sf_dir, "tool_catalog")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).filter(F.col("n_events") >= 2).select("first_id", "last_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event or run of events, as one row with its count and duration."""
    return _runs(spark, sf_dir)


_TOKENS = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(trim({0}), '@.*$', ''), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_')"""
_SQL = rf"""
WITH named AS (
  SELECT tool_name AS entry, {_TOKENS.format('tool_name')} AS alias FROM tool_catalog
), first_ AS (SELECT split_part(alias, '_', 1) AS f FROM named WHERE contains(alias, '_') GROUP BY 1 HAVING count(*) * 2 > (SELECT count(*) FROM named)),
alias AS (SELECT entry, alias FROM named UNION SELECT entry, substr(alias, length(f) + 2) FROM named JOIN first_ ON starts_with(alias, f || '_')),
written AS (SELECT DISTINCT tool_name FROM audit_log),
tool AS (
  SELECT tool_name, entry FROM written JOIN alias ON {_TOKENS.format('tool_name')} = alias OR ends_with({_TOKENS.format('tool_name')}, '_' || alias)
  QUALIFY row_number() OVER (PARTITION BY tool_name ORDER BY length(alias) DESC) = 1
), event AS (
  SELECT id, context_id, "timestamp" AS ts, coalesce(entry, tool_name, '') AS tool,
    nullif(regexp_replace(regexp_replace(regexp_replace(lower(input_hash), '\s', '', 'g'), '^[a-z0-9_-]+[:=]', ''), '^0x', ''), '') AS digest
  FROM audit_log LEFT JOIN tool USING (tool_name) QUALIFY row_number() OVER (PARTITION BY id ORDER BY "timestamp") = 1
), flagged AS (
  SELECT *, coalesce(lag(tool) OVER w = tool AND ts - lag(ts) OVER w <= INTERVAL 600 SECONDS
    AND ((digest IS NULL AND lag(digest) OVER w IS NULL) OR digest = lag(digest) OVER w OR (least(length(digest), length(lag(digest) OVER w)) >= 8
      AND (starts_with(digest, lag(digest) OVER w) OR starts_with(lag(digest) OVER w, digest)))), false) AS same
  FROM event WINDOW w AS (PARTITION BY context_id ORDER BY ts, id)
), numbered AS (
  SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY context_id ORDER BY ts, id) AS run FROM flagged
), run AS (
  SELECT context_id, arg_min(tool, (ts, id)) AS tool, arg_min(id, (ts, id)) AS first_id, arg_max(id, (ts, id)) AS last_id, min(ts) AS first_at, max(ts) AS last_at,
    count(*) AS n_events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s
  FROM numbered GROUP BY context_id, run
)"""

QUERIES = {"p1_found": found, "p1_runs": runs}
SQL = {"p1_found": _SQL + " SELECT first_id, last_id FROM run WHERE n_events >= 2", "p1_runs": _SQL + " SELECT * FROM run"}
