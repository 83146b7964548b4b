import pytest
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.sources import tables


def value(spark, f, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("x", "y"), [
    ("Hello World", "hello-world"), ("Another_Test-Case", "another-test-case"), ("  leading and trailing   ", "leading-and-trailing"),
    ("-dash-start-and-end-", "dash-start-and-end"), ("", ""), (None, None), ("---", ""), ("Ä1", "1"),
])
def test_slug(spark, x, y):
    assert value(spark, S.slug, x) == y


def test_key_of_blank_is_null(spark):
    assert value(spark, S.key, " - ") is None


def test_hashes(spark):
    assert len(value(spark, S.content_hash, "any")) == 32
    assert len(value(spark, S.short_hash, "any")) == 16


def test_tamper(spark):
    doc = tables.with_hash({"kind": F.lit("system"), "a": F.lit(None)}, F.col("x"))
    rows = spark.createDataFrame([("body",), ("",), (None,)], "x string").select(doc.alias("document"), F.lit("p").alias("path"))
    assert [r.tampered for r in tables.validated(rows).collect()] == [False] * 3
    edited = rows.withColumn("document", F.concat("document", F.lit("!")))
    assert [r.tampered for r in tables.validated(edited).collect()] == [True] * 3
    assert rows.first().document.startswith("---\na: \nkind: system\ncontent_hash: ")


@pytest.mark.parametrize("x", ["plain", "---\nno end", "---\nkind: a\n---\nbody", None])
def test_without_hash_nothing_is_tampered(spark, x):
    assert value(spark, S.tampered, x) is False


def test_paths(spark):
    assert value(spark, S.holon_id_of_path, "/foo/knowledge/L0/test-hypo.md") == "test-hypo"
    assert value(spark, S.holon_id_of_path, "/foo/decisions/DRR-123.md") == ""
    assert value(spark, S.layer_of_path, "/x/knowledge/invalid/test.md") == "invalid"
    assert value(spark, S.layer_of_path, "/x/decisions/DRR.md") == ""


def test_vocabulary_and_invariants(spark):
    assert value(spark, S.format_vocabulary, "Channel: a thing. Message: one. Result[T,E]: either.") == "- **Channel**: a thing.\n- **Message**: one.\n- **Result[T,E]**: either."
    assert value(spark, S.format_vocabulary, "nothing here") == "nothing here"
    assert value(spark, S.format_invariants, "1. Python 3.12+ only. 2. DuckDB. 3. Telethon.") == "1. Python 3.12+ only.\n2. DuckDB.\n3. Telethon."
    assert value(spark, S.format_invariants, None) is None


def test_instants(spark):
    assert str(value(spark, S.parse_instant, "2022-01-02")) == "2022-01-02 00:00:00"
    assert str(value(spark, S.parse_instant, "2022-01-02T03:04:05Z")) == "2022-01-02 03:04:05"
    assert str(value(spark, S.parse_instant, "2022-01-02T03:04:05.25+02:00")) == "2022-01-02 01:04:05.250000"
    for x in ("soon", "2023", "2023-05", "12:30", "2023-02-30", "2023-01-01 10:00:00", "2023-01-01T10:00", "2023-01-01T25:00:00Z", " 2023-01-01", "", None):
        assert value(spark, S.parse_instant, x) is None, x


def test_json(spark):
    got = spark.createDataFrame([("a<b>&\u2028", None)], "x string, y string").select(S.canonical_json({"z": F.col("x"), "a": F.col("y")}).alias("j")).first().j
    assert got == '{"a":null,"z":"a\\u003cb\\u003e\\u0026\\u2028"}'


def test_penalties_and_scores(spark):
    assert [value(spark, S.penalty, c, "int") for c in (3, 2, 1, 0, 9)] == [0.0, 0.1, 0.4, 0.9, 0.9]
    assert [value(spark, S.clamp_level, c, "int") for c in (0, 1, 3, 4, None)] == [3, 1, 3, 3, 3]
    assert [value(spark, S.verdict_score, v) for v in ("PASS", "degrade", "fail", "refine", None)] == [1.0, 0.5, 0.0, 0.0, 0.0]


def test_changed_files(spark):
    lines = spark.createDataFrame([("M\ta.go",), ("R100\told\tnew",), ("junk",)], "value string")
    assert sorted(map(tuple, tables.changed_files(lines).collect())) == [("M", "a.go"), ("R100", "new")]


def test_healing(spark):
    holons = spark.createDataFrame([("h1", "t", "system", "L0", "T", "C", None), ("d", "t", None, "DRR", None, None, None)], "id string, type string, kind string, layer string, title string, content string, scope string")
    files = tables.projection(holons).withColumn("path", F.concat(F.lit("/"), "path"))
    spoiled = files.withColumn("document", F.concat("document", F.lit("x")))
    got = {r.path: (r.document, r.was_tampered) for r in tables.healed(spoiled, holons).collect()}
    want = {r.path: r.document for r in files.collect()}
    assert got["/knowledge/L0/h1.md"] == (want["/knowledge/L0/h1.md"], True)
    assert got["/knowledge/DRR/d.md"][0].endswith("x")  # its path names no holon
