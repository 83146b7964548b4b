"""The plans are the ones wanted: columns pruned, filters pushed, no needless shuffle, no Python in the core's expressions."""

import re

import pytest

import __spark_entry__
from corvane.operators.model import Base
from corvane.sources.tables import table


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(table(spark, folder, "evidence").filter("verdict = 'pass'").select("id"))
    assert "EqualTo(verdict,pass)" in text and re.search(r"ReadSchema: struct<id:string,verdict:string>", text)


def test_listing_reads_only_what_it_lists(spark, folder):
    text = plan(Base(spark, folder).holons.select("layer", "id"))
    assert text.count("Exchange") <= 3 and "content" not in re.search(r"ReadSchema: (.*)", text)[1]


def test_evidence_scores_take_one_shuffle_per_key(spark, folder):
    from corvane.operators import model, reliability

    text = plan(reliability.self_scores(model.evidence(table(spark, folder, "evidence")), model.as_of()))
    tree = text[: text.index("(1)")] if "(1)" in text else text
    assert tree.count("Exchange") <= 2 and "Python" not in text and "content" not in re.search(r"ReadSchema: (.*)", text)[1]


@pytest.mark.parametrize("name", ["holon_lookup", "layer_counts", "components_of", "stale_evidence", "status_summary", "slugify", "tamper_check"])
def test_core_queries_stay_in_the_jvm(spark, folder, name):
    text = plan(__spark_entry__.queries()[name](spark, folder))
    assert not re.search("Python|Pandas|MapInArrow|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_every_query_has_a_stable_name_and_sql_of_its_own():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and all(re.fullmatch(r"[a-z0-9_]+", n) for n in names)
