"""Scalar functions. All are compositions of built-in expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def slug(x: Column) -> Column:
    """Lower case, each run of characters outside a-z and 0-9 one hyphen, no hyphen at either end. Null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def key(x: Column) -> Column:
    """Slug used as an identifier: blank counts as null."""
    return F.nullif(slug(x), F.lit(""))


def content_hash(x: Column) -> Column:
    """First 32 hex digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 32)


def short_hash(x: Column) -> Column:
    """First 16 hex digits of SHA-256, as audit rows carry them."""
    return F.substring(F.sha2(x, 256), 1, 16)


#: Characters that are written as escapes inside JSON strings.
ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def json_text(x: Column) -> Column:
    """A struct or map as JSON with nulls written as null, and with `<`, `>`, `&` and the two line separators escaped."""
    out = F.to_json(x, {"ignoreNullFields": "false"})
    for sign, escape in ESCAPED.items():
        out = F.replace(out, F.lit(sign), F.lit(escape))
    return out


def canonical_json(pairs: dict[str, Column]) -> Column:
    """A JSON object with its keys in sorted order."""
    return json_text(F.struct(*[pairs[k].alias(k) for k in sorted(pairs)]))


def has_frontmatter(doc: Column) -> Column:
    return F.coalesce(doc.startswith("---\n") & (F.locate("\n---\n", doc, 4) > 0), F.lit(False))


def frontmatter(doc: Column) -> Column:
    """The block between the opening and the closing fence; null without one."""
    return F.when(has_frontmatter(doc), F.substring(doc, F.lit(5), F.locate("\n---\n", doc, 4) - F.lit(5)))


def body(doc: Column) -> Column:
    """What follows the frontmatter; the whole text where there is none."""
    return F.when(has_frontmatter(doc), F.substring(doc, F.locate("\n---\n", doc, 4) + F.lit(5), F.length(doc))).otherwise(doc)


def stored_hash(doc: Column) -> Column:
    """The content_hash line of the frontmatter; null where it is missing."""
    return F.nullif(F.regexp_extract(frontmatter(doc), r"(?m)^content_hash:\s*([a-f0-9]+)\s*$", 1), F.lit(""))


def tampered(doc: Column) -> Column:
    """True where a stored hash exists and differs from the hash of the body. No frontmatter or no hash: False."""
    return F.coalesce(stored_hash(doc) != content_hash(body(doc)), F.lit(False))


def holon_id_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"/knowledge/(?:L[012]|invalid)/([^/]+)\.md$", 1)


def layer_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"/knowledge/(L[012]|invalid)/", 1)


#: The shape of a vocabulary term and of a numbered invariant.
TERM = r"([A-Z][a-zA-Z0-9_\[\],<>]+):\s*"
NUMBER = r"(\d+)\.\s+"


def _itemised(x: Column, pattern: str, left: str, right: str) -> Column:
    """Each match of pattern opens a line: left, the matched group, right, the trimmed text up to the next match."""
    lead = F.regexp_replace(x, pattern, "\u0001$1\u0002")
    items = F.filter(F.split(lead, "\u0001"), lambda s: F.instr(s, "\u0002") > 0)
    lines = F.transform(items, lambda s: F.concat(F.lit(left), F.substring_index(s, "\u0002", 1), F.lit(right), F.trim(F.regexp_replace(F.substring_index(s, "\u0002", -1), r"\s+$", ""))))
    return F.when(x.rlike(pattern), F.array_join(lines, "\n")).otherwise(x)


def format_vocabulary(x: Column) -> Column:
    """One Markdown bullet per `Term: definition`; unchanged where no term is found."""
    return _itemised(x, TERM, "- **", "**: ")


def format_invariants(x: Column) -> Column:
    """One line per numbered invariant; unchanged where no number is found."""
    return _itemised(x, NUMBER, "", ". ")


#: The two forms of an instant that are understood, RFC 3339 and a plain date.
RFC_3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
PLAIN_DATE = r"^\d{4}-\d{2}-\d{2}$"


def parse_instant(x: Column) -> Column:
    """An RFC 3339 instant or a plain date; anything else, such as a year, a month or a time of day, is null."""
    return F.when(x.rlike(RFC_3339) | x.rlike(PLAIN_DATE), F.try_to_timestamp(F.translate(x, ",", ".")))


def carrier_of_kind(kind: Column) -> Column:
    return F.when(kind == "episteme", "formal-logic").otherwise("internal-logic")


def relation_of_kind(kind: Column) -> Column:
    return F.when(kind == "episteme", "constituentOf").otherwise("componentOf")


def clamp_level(level: Column) -> Column:
    """Congruence levels outside 1..3, and null, become 3."""
    return F.when(level.between(1, 3), level).otherwise(3)


def penalty(level: Column) -> Column:
    """Congruence penalty; fixed values 0, 0.1, 0.4, otherwise 0.9."""
    return F.when(level == 3, 0.0).when(level == 2, 0.1).when(level == 1, 0.4).otherwise(0.9)


def verdict_score(verdict: Column) -> Column:
    """1 for pass, 0.5 for degrade, 0 for everything else, whatever the case."""
    return F.when(F.lower(verdict) == "pass", 1.0).when(F.lower(verdict) == "degrade", 0.5).otherwise(0.0)


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", x)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days between two instants, truncated toward zero."""
    return ((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86400000000)).cast("int")


def evidence_file(day: Column, kind: Column, target: Column) -> Column:
    return F.concat(F.concat_ws("-", F.date_format(day, "yyyy-MM-dd"), kind, target), F.lit(".md"))


def decision_file(day: Column, title: Column) -> Column:
    return F.concat(F.lit("DRR-"), F.date_format(day, "yyyy-MM-dd"), F.lit("-"), slug(title), F.lit(".md"))


def default_expiry(day: Column) -> Column:
    """90 days on, as a date."""
    return F.date_add(day.cast("date"), 90)
