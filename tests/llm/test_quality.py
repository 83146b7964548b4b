import os

import numpy as np
import pytest

from corvane.llm import quality

COMMON_WORDS = frozenset("the of and to in a is that it was for on as with by at this from had has we than after der die und que la el de".split())
COMMON = quality.Tokens({w: i for i, w in enumerate(sorted(COMMON_WORDS), 1)})
PROSE = "The reviewers had asked for a report on the state of the ledger. It was written by the team in a week, and it is still in use.\nAfter that we moved to a plan that was made for the cluster."
LIST = "- static broker\n- Alpha depot (33 commits)\n- narrow timetable\n- [x] ledger leases\n- open items"
TABLE = "layer,verdict,carrier,scope\n0.97,pass,mirror,L1\n0.33,fail,router,L0\n12,pass,-,L2"
TRACE = "    at partition.Gate.promotes(basket.go:498)\n    at forecast.Drift.delays(component.go:123)\n" * 4
LOOP = "On balance, we would " * 40
LONG = "\n".join(" ".join(f"{w} {i}{k}" if k % 2 else w for k, w in enumerate(PROSE.split())) for i in range(300))
CASES = {1: (PROSE, "prose"), 2: (LIST, "list"), 3: (TABLE, "table"), 4: (TRACE, "junk"), 5: (LOOP, "junk"), 6: (None, "junk"), 7: (" \n\t", "junk"), 8: ("~~~~ #### ....", "junk"), 9: (PROSE.lower().replace(".", ""), "prose"), 10: (LONG, "prose")}


def test_statistics():
    got = dict(zip(quality.STATISTICS, quality.statistics_of("The end. Of it!\n\nx 12", COMMON)))
    assert (got["n_words"], got["n_lines"], got["n_chars"]) == (6, 2, 15)
    assert got["punctuated_lines"] == 0.5 and got["common_words"] == pytest.approx(3 / 6) and got["digit_ratio"] == pytest.approx(2 / 15) and got["symbol_ratio"] == pytest.approx(2 / 15)
    assert all(x == 0 for x in quality.statistics_of(None, COMMON)) and all(x == 0 for x in quality.statistics_of("  ", COMMON))


def test_unicode_blanks():
    assert quality.statistics_of("a b c\x0bd\r\ne İ", COMMON)[0] == 6


def test_types(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, (t, _) in CASES.items() for _ in range(5)], "doc_id long, text string, n_words string")
    words = spark.createDataFrame([(w,) for w in COMMON_WORDS] + [(None,)], "word string")
    labels = spark.createDataFrame([(d, k) for d, (_, k) in CASES.items()] + [(99, "prose"), (1, "unheard of")], "doc_id long, text_class string")
    for known in (labels, None):
        got = quality.typed(quality.staged(quality.statistics(docs, words)), known).collect()
        assert len(got) == 50
        assert {r.doc_id: r.is_prose for r in got} == {d: k == "prose" for d, (_, k) in CASES.items()}


def test_nothing(spark):
    docs, words = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "word string")
    assert quality.typed(quality.staged(quality.statistics(docs, words))).count() == 0


def test_votes():
    codes = np.array([0, 5, quality.PATTERNS - 1])
    v = quality.votes(codes)
    assert (v[0] == 0).all() and (v[2] == [len(c) for _, c in quality.FUNCTIONS]).all()


@pytest.mark.parametrize("seed", range(3))
def test_learning_recovers_accuracies(seed):
    """Documents whose votes are drawn from known accuracies are told apart without any label."""
    rng = np.random.default_rng(seed)
    n = len(quality.KINDS)
    kind = rng.choice(n, 4000, p=[0.7] + [0.3 / (n - 1)] * (n - 1))
    code = np.zeros(4000, int)
    for name, cuts in quality.FUNCTIONS:
        p = np.clip(np.array([quality.prior(k, name) for k in range(n)])[kind] + rng.normal(0, 0.02), 0.02, 0.98)
        code = code * (len(cuts) + 1) + np.where(rng.random(4000) < p, len(cuts), rng.integers(0, len(cuts), 4000))
    codes, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    post, tables = quality.learned(codes, counts.astype(float), np.zeros((len(codes), 4)))
    assert ((post[inverse, 0] >= 0.5) == (kind == 0)).mean() > 0.97
    assert all(t.max() <= quality.SUREST + 0.01 for t, (_, cuts) in zip(tables, quality.FUNCTIONS) if len(cuts) == 1)


def test_no_function_decides_alone():
    """Two functions that speak for prose are outvoted by what the others say, whichever they are."""
    for alone in ("sentence_share", "sentence_lines", "common_words"):
        code = 0
        for name, cuts in quality.FUNCTIONS:
            high = name in (alone, "distinct_trigrams", "n_words", "plain_words", "listed_lines", "short_lines")
            code = code * (len(cuts) + 1) + len(cuts) * high
        post, _ = quality.learned(np.array([code]), np.array([1.0]), np.zeros((1, 4)))
        assert post[0].argmax() == 1, alone


def test_very_long_tokens_and_words_without_end():
    for text in ("x" * 100_000, "lorem ipsum " * 50_000, "é" * 20_000 + " the end"):
        got = dict(zip(quality.STATISTICS, quality.statistics_of(text, COMMON)))
        assert got["n_chars"] == len("".join(text.split())) and got["n_words"] == len(text.split())


def test_labels_of_the_test_tables(spark, folder):
    """Held out: labels judged by a model that saw none."""
    d = os.path.join(os.path.dirname(folder), "sf0.01")
    stats = quality.staged(quality.statistics(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/common_words.parquet")))
    rows = quality.typed(stats).join(spark.read.parquet(f"{d}/doc_labels.parquet"), "doc_id").collect()
    assert sum(r.is_prose == (r.text_class == "prose") for r in rows) / len(rows) > 0.95


def test_types_of_labels_held_out(spark, folder):
    """Learned with every other label, judged on the rest: each type nine times in ten."""
    d = os.path.join(os.path.dirname(folder), "sf0.1")
    stats = quality.staged(quality.statistics(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/common_words.parquet")))
    labels = spark.read.parquet(f"{d}/doc_labels.parquet")
    rows = quality.typed(stats, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("text_class", "text_type").collect()
    for kind in quality.TYPES:
        own = [r.text_type == kind for r in rows if r.text_class == kind]
        assert len(own) > 10 and sum(own) / len(own) >= 0.9, kind
