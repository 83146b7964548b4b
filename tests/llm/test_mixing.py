import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing

DOC = "doc_id long, text string, source string, code int, n_tokens int, block int"
TARGET = "source string, target_share double, max_repeats int"

needs_vocabulary = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no vocabulary here")


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 4097])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 3)) == list(range(n))


def test_draws_add_up():
    slots = np.array([1000, 37, 0, 2963])
    shards, size = 16, 250
    dealt = [mixing.drawn(i, slots, size, 1) for i in range(shards)]
    counts = [np.bincount(which, minlength=4) for which, _ in dealt]
    assert (sum(counts) == slots).all() and all(c.sum() == size for c in counts)
    assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*dealt)))) == [(i, k) for i, n in enumerate(slots) for k in range(n)]
    share = np.array([c[3] / size for c in counts])
    assert len({tuple(c) for c in counts}) > 1 and 0.01 < share.std() < 0.06  # about sqrt(.74 * .26 / 250)


def test_draws_at_any_size():
    """Far more slots than a sampler's range: numbers stay inside their sources, shares are right."""
    slots = np.array([150_000_000_000, 50_000_000_000, 7])
    for shard in (0, 12_345_678, 48_828_125):
        which, k = mixing.drawn(shard, slots, 4096, 3)
        assert (k >= 0).all() and (k < slots[which]).all() and len(set(zip(which, k))) == len(k)
        assert len(k) < 4096 or abs((which == 0).mean() - 0.75) < 0.04


def test_plan():
    goal = {"a": (0.5, 1), "b": (0.3, 2), "none": (0.2, 3)}
    plan = {s.name: s for s in mixing.planned({"a": 10_000, "b": 1_500}, goal, 10)}
    assert plan["none"].slots == 0 and plan["b"].slots == 300 and plan["a"].slots == 500
    more = {s.name: s.slots for s in mixing.planned({"a": 10_000, "b": 1_500}, goal, 10, 9_000)}
    assert more["b"] == 300 and more["a"] == 600
    assert all(s.slots == 0 for s in mixing.planned({}, goal, 10))


@needs_vocabulary
def test_mix(spark):
    docs = [(i, f"text number {i} of the large source, with words " * 4, "Big Source", 0, 0, 0) for i in range(200)]
    docs += [(1000 + i, f"small {i} piece of text", ["small", "SMALL ", "sm-all"][i % 2], 0, 0, 0) for i in range(30)]
    docs += [(2000 + i, "small 0 piece of text", "small", 0, 0, 0) for i in range(50)]
    docs += [(3000, None, "small", 0, 0, 0), (3001, " \n", "small", 0, 0, 0), (3002, "untargeted", "other", 0, 0, 0), (3003, "nowhere", None, 0, 0, 0), (None, "no id", "small", 0, 0, 0), (3004, "long " * 3000, "big-source", 0, 0, 0)]
    goal = spark.createDataFrame([("big_source", 0.8, 1), ("Small", 0.2, 3), ("absent", 0.1, 3), (None, 0.1, 1), ("zero", 0.0, 1)], TARGET)
    mix = mixing.mixed(spark.createDataFrame(docs, DOC), goal, block_tokens=8)
    rows = mixing.used(mix).collect()
    ids = {r.doc_id for r in rows}
    assert not ids & {3000, 3001, 3002, 3003, None} and not ids & set(range(2000, 2050))
    assert all(r.repeats <= (3 if r.source == "small" else 1) for r in rows) and max(r.repeats for r in rows if r.source == "small") == 3
    assert all(r.used_tokens <= r.repeats * r.n_tokens for r in rows)
    total = sum(r.used_tokens for r in rows)
    assert abs(sum(r.used_tokens for r in rows if r.source == "small") / total - 0.2) < 0.02
    # Every place holds one block, and the pieces of a block fill it.
    places = mix.slots.groupBy("shard", "place").count().filter("count > 1").count()
    assert places == 0 and mix.pieces.groupBy("source", "block").agg(F.sum("piece_tokens").alias("n")).filter("n > 8").count() == 0
    assert {r.rule: r.n for r in mixing.broken(mix, 8).collect()} == dict.fromkeys(["documents cut into pieces", "full blocks", "repeats of blocks", "slots as planned", "repeats of documents", "shares to a block"], 0)
    again = {tuple(r) for r in mixing.used(mixing.mixed(spark.createDataFrame(docs, DOC), goal, block_tokens=8)).collect()}
    assert again == {tuple(r) for r in rows}


@needs_vocabulary
def test_nothing(spark):
    docs, goal = spark.createDataFrame([], DOC), spark.createDataFrame([], TARGET)
    assert mixing.used(mixing.mixed(docs, goal)).count() == 0
    full = spark.createDataFrame([("a", 1.0, 1)], TARGET)
    assert mixing.used(mixing.mixed(docs, full)).count() == 0
