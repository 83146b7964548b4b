import random

import numpy as np
import pytest

from corvane.llm import neardup
from corvane.operators import skew
from corvane.session import staged

HOLON = "id string, title string, content string, updated_at timestamp_ntz, class int, n int, tokens string"


def families(rng, n, words=40):
    """Texts in families of small edits."""
    out = {}
    for f in range(n):
        base = [f"w{rng.randrange(900)}" for _ in range(words)]
        for k in range(rng.choice([1, 1, 2, 5])):
            text = list(base)
            for _ in range(rng.randrange(8)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(900)}"
            out[f"d{f}-{k}"] = " ".join(text)
    return out


def brute(texts, threshold):
    sets = {k: set(t.split()) for k, t in texts.items()}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] | sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def found(spark, texts):
    holons = spark.createDataFrame([(k, None, t, None, 1, 1, "x") for k, t in texts.items()], HOLON)
    members, classes = neardup.holon_classes(holons)
    return {tuple(r) for r in neardup.id_pairs(members, classes, neardup.similar(classes)).collect()}


@pytest.mark.parametrize("bucket", [64, 1])
def test_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    texts = families(random.Random(4), 120)
    texts |= {"copy-1": texts["d0-0"], "copy-2": texts["d0-0"], "blank-1": "", "blank-2": " ", "long": " ".join(f"x{i}" for i in range(5000))}
    assert found(spark, texts) == brute(texts, neardup.THRESHOLD)


def test_exactly_at_the_threshold(spark):
    common = [f"c{i}" for i in range(7)]
    texts = {"a": " ".join([*common, "x", "y", "z"]), "b": " ".join(common)}
    assert found(spark, texts) == {("a", "b")}


@pytest.mark.parametrize("least", [50_000, 5])
def test_many_copies(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "MIN_ROWS", least)
    texts = {f"c{i:02}": "one two three" for i in range(80)} | {"z": "one two three four"}
    got = found(spark, texts)
    assert len(got) == 80 * 79 // 2 + 80


def test_streamed_pairs_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 40, 3000)).astype(np.int64)
    cls = np.arange(3000, dtype=np.int64)
    cuts = [0, 1, 500, 501, 1700, 3000]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(cls[a:b])], names=["key", "class"]) for a, b in zip(cuts, cuts[1:])]
    pairs, over = set(), set()
    for out in neardup._pairs(iter(batches)):
        for k, a, b in zip(*(out.column(i).to_pylist() for i in range(3))):
            pairs.add((a, b)) if b is not None else over.add((k, a))
    size = {k: int((keys == k).sum()) for k in set(keys)}
    assert over == {(int(k), int(c)) for k, c in zip(keys, cls) if size[k] > neardup.BUCKET}
    assert pairs == {(int(a), int(b)) for k in size if size[k] <= neardup.BUCKET for a in cls[keys == k] for b in cls[keys == k] if a < b}


@pytest.mark.parametrize("seed", range(4))
def test_sketches_lose_no_pair(seed):
    rng = np.random.default_rng(seed)
    a, b = [], []
    for _ in range(300):
        n = int(rng.choice([1, 3, 20, 60, 70, 500, 3000]))
        x = rng.integers(-(2**62), 2**62, n)
        y = x[rng.random(n) < rng.choice([0.6, 0.7, 0.8, 1.0])]
        a.append(x), b.append(np.concatenate([y, rng.integers(-(2**62), 2**62, int(rng.integers(0, n // 5 + 2)))]))
    sizes = [np.array([len(v) for v in s]) for s in (a, b)]
    may = neardup.may_reach(sizes[0], [neardup.sketch(v) for v in a], sizes[1], [neardup.sketch(v) for v in b], 0.7)
    both = np.array([len(np.intersect1d(x, y)) for x, y in zip(a, b)])
    true = both >= 0.7 * (sizes[0] + sizes[1] - both) - 1e-9
    assert may[true].all() and 0.05 < true.mean() < 0.95 and may[~true].mean() < 0.5


def test_crowded_blocks_are_small():
    """1,024 long texts with most words their own: sketches, not sets, are compared."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**62, 1600)
    sets = [np.concatenate([common, rng.integers(0, 2**62, 400)]) for _ in range(1024)]
    bits = [neardup.sketch(v) for v in sets]
    rows = [{"class": list(range(k, k + 512)), "size": [2000] * 512, "bits": bits[k : k + 512]} for k in (0, 512)]
    tracemalloc.start()
    got = neardup._block_pairs(pd.DataFrame(rows), 0.7)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert len(got) == 0 or len(got) <= 512 * 512  # 1,600 of 2,400 words are common: under 0.7


def test_groups(spark, monkeypatch):
    monkeypatch.setattr(skew, "MIN_ROWS", 1)
    nodes = spark.createDataFrame([(i,) for i in range(30)], "node long")
    links = staged(spark.createDataFrame([(i, i + 1) for i in range(0, 12)] + [(20, 21)], "a long, b long"))
    got = {r.node: (r.group, r.n_links) for r in neardup.labelled(nodes, links).collect()}
    assert all(got[i][0] == 0 for i in range(13)) and got[21] == (20, 1) and got[29] == (29, 0) and got[5] == (0, 2)


def test_parameters():
    for n in (10, 10**5, 10**9):
        b, r = neardup.bands_and_rows(n, 0.7, 0.999)
        assert 1 - (1 - 0.7**r) ** b >= 0.999


def test_nothing(spark):
    assert found(spark, {}) == set()
