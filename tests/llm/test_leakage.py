import random

import numpy as np
import pytest

from corvane.llm import leakage

DOC = "doc_id long, text string, item_id int"
ITEM = "item_id long, body string, doc_id int"


def brute(docs, items, least):
    out = {}
    for d, text in docs:
        w = leakage.words(text)
        for i, body in items:
            v = leakage.words(body)
            best = max((k for a in range(len(w)) for b in range(len(v)) for k in [next((k for k in range(min(len(w) - a, len(v) - b)) if w[a + k] != v[b + k]), min(len(w) - a, len(v) - b))]), default=0)
            if best >= least:
                out[d, i] = best
    return out


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, 0) for x in docs], DOC)
    i = spark.createDataFrame([(*x, 0) for x in items], ITEM)
    return {(r.doc_id, r.item_id): r.match_words for r in leakage.matches(d, i, **kw).collect()}


@pytest.mark.parametrize(("seed", "shard"), [(1, 10**6), (2, 50), (3, 1)])
def test_against_brute_force(spark, seed, shard):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(3, 25)))) for i in range(8)]
    docs = [(d, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 30))) + " " + (rng.choice(items)[1] if d % 3 else "")) for d in range(30)]
    assert found(spark, docs, items, least=5, shard_words=shard) == brute(docs, items, 5)


def test_edges(spark):
    body = " ".join(f"word{i}" for i in range(20))
    items = [(1, body), (2, None), (3, ""), (4, "short one"), (5, " ".join(f"word{i}" for i in range(12)) + " other end"), (None, body)]
    part = "Word2, WORD3; word4_word5 (word6) word7-word8 word9 word10\nword11 word12... word13!"
    docs = [(1, "x " + body.upper()), (2, part), (3, None), (4, " "), (5, body), (6, " ".join(f"word{i}" for i in range(11))), (7, ("noise " * 50000) + body)]
    got = found(spark, docs, items)
    assert got == {(1, 1): 20, (1, 5): 12, (2, 1): 12, (5, 1): 20, (5, 5): 12, (7, 1): 20, (7, 5): 12}


def test_a_match_does_not_cross_documents(spark):
    body = " ".join(f"w{i}" for i in range(14))
    assert found(spark, [(1, " ".join(f"w{i}" for i in range(7))), (2, " ".join(f"w{i}" for i in range(7, 14)))], [(1, body)]) == {}


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_CHARS", 60)
    items = [(i, " ".join(f"v{i}x{k}" for k in range(12))) for i in range(6)]
    other = [(100 + i, " ".join(f"v{i}x{k}" for k in range(11)) + " else") for i in range(6)] + [(200, None), (201, "")]
    assert found(spark, [(i, b) for i, b in items] + other, items) == {(i, i): 12 for i in range(6)}


def test_looped_text_meets_each_item_once():
    import tracemalloc

    phrase = " ".join(f"p{i}" for i in range(12))
    items = leakage.Items([(i, f"own{i} {phrase} {phrase} end{i}") for i in range(200)], 12)
    text = np.array([items.code[w] for w in phrase.split()] * 10_000 + [0], np.int64)
    tracemalloc.start()
    doc, item, place, where, length = items.search(text, np.array([0]))
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert sorted(item) == list(range(200)) and set(length) == {24} and set(place) == {1} and set(where) == {0} and set(doc) == {0}


def test_ranks():
    rng = np.random.default_rng(3)
    codes = np.append(rng.integers(1, 3, 200), 0)
    rank = leakage.ranks(codes, 300)
    order = sorted(range(len(codes)), key=lambda i: tuple(codes[i:]))
    assert [int(x) for x in np.argsort(rank, kind="stable")] == order


def test_nothing(spark):
    assert found(spark, [], []) == {} and found(spark, [(1, "a b")], []) == {}
    docs = spark.createDataFrame([(1, "a", 0)], DOC)
    hits = spark.createDataFrame([], "doc_id long")
    assert leakage.decontaminated(docs, hits).count() == 1
