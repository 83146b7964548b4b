from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.llm import runs

CATALOG = ["acme_audit", "acme_audit_tree", "acme_test", "acme_check_decay", "view_check"]
LOG = "id string, context_id string, timestamp timestamp_ntz, tool_name string, input_hash string, digest string, _prev int"
T0 = datetime(2022, 1, 1)


@pytest.mark.parametrize(("name", "want"), [
    ("acme_audit_tree", "acme_audit_tree"), ("audit_tree", "acme_audit_tree"), ("AcmeAuditTree", "acme_audit_tree"), ("ACME_AUDIT ", "acme_audit"), ("ns__acme__acme_test", "acme_test"),
    ("acme/acme_check_decay@2.0", "acme_check_decay"), ("check-decay", "acme_check_decay"), ("acme check decay", "acme_check_decay"), ("View_Check", "view_check"), ("VIEWCHECK", "view_check"),
    ("other", "other"), (None, ""), ("", ""),
])
def test_tool_names(spark, name, want):
    catalog = spark.createDataFrame([(c,) for c in CATALOG] + [(None,)], "tool_name string")
    log = spark.createDataFrame([("e1", "x", T0, name, None, "", 1)], LOG)
    assert runs.events(log, catalog).first().tool == want


@pytest.mark.parametrize(("a", "b", "want"), [
    ("0x4FC0b91092a79556", "4fc0b91092a79556 ", True), ("sha256:4fc0b91092a79556", "4fc0b910", True), ("4fc0b91", "4fc0b91092a79556", False), ("4fc0b91", "4FC0B91", True),
    (None, " ", True), (None, "4fc0b910", False), ("4fc0b91092a7", "4fc0b91192a7", False),
])
def test_digests(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(runs.digest(F.col("a")), runs.digest(F.col("b"))).first()
    assert runs.same_digest(*row) is want


def collapsed(spark, rows):
    catalog = spark.createDataFrame([(c,) for c in CATALOG] + [(None,)], "tool_name string")
    log = spark.createDataFrame([(i, c, None if s is None else T0 + timedelta(seconds=s), n, h, "clash", 1) for i, c, s, n, h in rows], LOG)
    return {(r.first_id, r.last_id): (r.n_events, r.duration_s) for r in runs.collapsed(runs.events(log, catalog)).collect()}


def test_runs(spark):
    got = collapsed(spark, [
        ("a1", "x", 0, "audit", "abcdef0123"), ("a2", "x", 600, "acme_audit", "ABCDEF01"), ("a2", "x", 600, "acme_audit", "ABCDEF01"), ("a3", "x", 1201, "audit", "abcdef0123"),
        ("a5", "x", 1300, "audit", None), ("a4", "x", 1300, "audit", " "), ("b1", "y", 1300, "audit", None), (None, "y", 1, "audit", None), ("n1", None, None, None, None),
    ])
    assert got == {("a1", "a2"): (2, 600.0), ("a3", "a3"): (1, 0.0), ("a4", "a5"): (2, 0.0), ("b1", "b1"): (1, 0.0), ("n1", "n1"): (1, None)}


def test_one_hot_context(spark):
    got = collapsed(spark, [(f"e{i:04}", "hot", i, "audit" if (i // 7) % 2 else "test", "0123456789") for i in range(700)])
    assert len(got) == 100 and set(got.values()) == {(7, 6.0)}


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_large_catalogues(spark, n):
    catalog = spark.range(n).select(F.concat(F.lit("acme_tool_"), F.col("id").cast("string")).alias("tool_name"), F.lit(0).alias("alias"))
    names = spark.createDataFrame([("Acme/AcmeTool_7",), ("tool-1999",), ("acmetool12",), ("tool_x",)], "tool_name string")
    got = {r.tool_name: r.tool for r in runs.tools(names, catalog).collect()}
    assert got == {"Acme/AcmeTool_7": "acme_tool_7", "tool-1999": "acme_tool_1999", "acmetool12": "acme_tool_12", "tool_x": "tool_x"}


def test_many_written_names(spark, monkeypatch):
    monkeypatch.setattr(runs, "SENT_NAMES", 0)
    test_runs(spark)


def test_nothing(spark):
    assert collapsed(spark, []) == {}
