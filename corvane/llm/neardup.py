"""Near-duplicate records with small edits: MinHash banding, then verification on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.scalars import key
from corvane.operators.skew import hot_keys, salted, salted_join, spread_out
from corvane.session import partitions, staged
from corvane.sources.tables import table

THRESHOLD = 0.7
RECALL = 0.999
#: Members of a band bucket that are paired one by one; larger buckets go block against block.
BUCKET = 64
#: Members, and bytes of sketches, of one block.
BLOCK, BLOCK_BYTES = 1_024, 1 << 22
DOCS_AT_ONCE = 2_000


def bands_and_rows(n: int, threshold: float, recall: float, background: float = 0.1, chance: float = 0.1) -> tuple[int, int]:
    """Bands and rows for a collection of n sets.

    Rows: as many as keep the chance partners of a set in a band few, n * background**rows being `chance`, where background is
    the similarity of unrelated sets; so rows grow with log n and the candidates in proportion to n. Bands: as many as find a
    pair exactly at the threshold with the target recall; pairs above it are found more surely.
    """
    rows = max(4, math.ceil(math.log(max(n, 1) / chance) / -math.log(background) - 1e-9))
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(tokens: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band. tokens: the 64-bit hashes of all sets end to end; offsets: where each begins and ends."""
    seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    words, at = np.unique(tokens, return_inverse=True)
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    for b in range(bands):
        code = np.full(len(offsets) - 1, b + 1, np.uint64)
        for r in range(rows):
            hashed = (_mixed(words ^ seeds[b * rows + r]) >> np.uint64(32)).astype(np.uint32)
            code = _mixed(code * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashed[at], offsets[:-1]).astype(np.uint64))
        out[:, b] = code
    return out


def banded(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """class, band key for each class and band. classes: class, tokens (array of long, not empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(at, DOCS_AT_ONCE)
                lists = batch.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sizes = np.diff(lists.offsets.to_numpy())
                keys = band_keys(flat, np.concatenate([[0], np.cumsum(sizes)]), bands, rows)
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "class"])

    return classes.select("class", "tokens").mapInArrow(run, "key long, class long")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: the pairs of each bucket of up to BUCKET members as (null key, a, b); the members
    of a larger one as (key, class, null). At most a batch and a bucket are held."""
    names = ["key", "a", "b"]
    hot, keep_k, keep_c = None, np.empty(0, np.int64), np.empty(0, np.int64)

    def paired(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch | None:
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(edge, len(k)))
        left, right = [], []
        for gap in range(1, min(BUCKET, int(size.max(initial=1)))):
            # Neighbours at this distance within a bucket of no more than BUCKET members.
            i = np.flatnonzero(k[gap:] == k[:-gap])
            left.append(c[i]), right.append(c[i + gap])
        if not left or not sum(map(len, left)):
            return None
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=names)

    def overflow(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.nulls(len(c), pa.int64())], names=names)

    for batch in batches:
        k = np.concatenate([keep_k, batch.column(0).to_numpy()])
        c = np.concatenate([keep_c, batch.column(1).to_numpy()])
        if not len(k):
            continue
        if hot is not None:  # the bucket that ran over at the end of the last batch
            n = int(np.searchsorted(k != hot, True))
            if n:
                yield overflow(k[:n], c[:n])
            k, c = k[n:], c[n:]
            if not len(k):
                continue
            hot = None
        last = int(np.flatnonzero(k == k[-1])[0])
        yield from _closed(k[:last], c[:last], paired, overflow)
        keep_k, keep_c = k[last:], c[last:]
        if len(keep_k) > BUCKET:
            yield overflow(keep_k, keep_c)
            hot, keep_k, keep_c = int(keep_k[0]), keep_k[:0], keep_c[:0]
    yield from _closed(keep_k, keep_c, paired, overflow)


def _closed(k, c, paired, overflow):
    if not len(k):
        return
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.repeat(np.diff(np.append(edge, len(k))), np.diff(np.append(edge, len(k))))
    if (big := size > BUCKET).any():
        yield overflow(k[big], c[big])
    k, c = k[~big & (size > 1)], c[~big & (size > 1)]
    if len(k) and (pairs := paired(k, c)) is not None:
        yield pairs


def sketch(tokens: np.ndarray) -> bytes:
    """A set of 64-bit hashes as a bit map: a bit per hash modulo a power of two, some 4 times the size of the set, or up to 8. Maps of other
    lengths are made comparable by folding the longer one."""
    width = max(256, 1 << int(4 * max(len(tokens), 1) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[_mixed(tokens.view(np.uint64)) & np.uint64(width - 1)] = 1
    return np.packbits(bits).tobytes()


def sketches(classes: DataFrame) -> DataFrame:
    """class, size, bits of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            bits = [sketch(flat[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int32)), pa.array(bits, pa.binary())], names=["class", "size", "bits"])

    return classes.select("class", "tokens").mapInArrow(run, "class long, size int, bits binary")


def _maps(bits: list[bytes], words: int) -> np.ndarray:
    """Bit maps of equal length as rows of 64-bit words, folded to `words`."""
    m = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
    while m.shape[1] > words:
        # The low bits of a hash choose the place, so the halves lie on each other.
        m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
    return m


def _may(size_a: np.ndarray, set_a: np.ndarray, size_b: np.ndarray, set_b: np.ndarray, both: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets can reach the threshold. A bit set in one map and not in the other stands for a member at least that the
    other lacks, so the common members are at most the size less those bits: no pair that reaches it is lost."""
    common = np.minimum(size_a - (set_a - both), size_b - (set_b - both))
    return common >= threshold * (size_a + size_b - common) - 1e-9


def may_reach(size_a: np.ndarray, bits_a: list[bytes], size_b: np.ndarray, bits_b: list[bytes], threshold: float) -> np.ndarray:
    """_may() for pairs given side by side."""
    out = np.zeros(len(size_a), bool)
    long_a, long_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (bits_a, bits_b))
    code = long_a * (long_b.max(initial=0) + 1) + long_b
    for c in np.unique(code):
        i = np.flatnonzero(code == c)
        words = int(min(long_a[i[0]], long_b[i[0]])) // 8
        a, b = _maps([bits_a[k] for k in i], words), _maps([bits_b[k] for k in i], words)
        counts = [np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b, a & b)]
        out[i] = _may(size_a[i], counts[0], size_b[i], counts[1], counts[2], threshold)
    return out


def _block_pairs(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of one block against another, or against itself, the pairs that can reach the threshold. A row per block: lists of class,
    size and bits. A row of the one against all of the other at a time: memory is that of the blocks."""
    x, y = pdf.iloc[0], pdf.iloc[-1]
    left, right = [], []
    long_y = np.array([len(v) for v in y["bits"]])
    class_x, class_y, size_x, size_y = (np.asarray(v, np.int64) for v in (x["class"], y["class"], x["size"], y["size"]))
    for length in np.unique(long_y):
        js = np.flatnonzero(long_y == length)
        folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in range(len(class_x)):
            words = min(len(x["bits"][i]), int(length)) // 8
            if words not in folded:
                m = _maps([y["bits"][j] for j in js], words)
                folded[words] = m, np.bitwise_count(m).sum(1, dtype=np.int64)
            m, set_y = folded[words]
            own = _maps([x["bits"][i]], words)
            both = np.bitwise_count(m & own).sum(1, dtype=np.int64)
            ok = _may(size_x[i], np.bitwise_count(own).sum(), size_y[js], set_y, both, threshold)
            hit = js[ok & ((class_y[js] > class_x[i]) if len(pdf) == 1 else (class_y[js] != class_x[i]))]
            left.append(np.full(len(hit), class_x[i])), right.append(class_y[hit])
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _crowded(members: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of buckets too large to pair one by one: exact, in blocks of sketches.

    A bucket is cut into blocks by a hash of the member, few enough in number that a block has some BLOCK members and
    BLOCK_BYTES; each pair of blocks is one small task input that compares sketches in place, so no task sees the bucket,
    no set is copied, and only pairs that can reach the threshold leave it. Buckets of several bands with the same
    members are compared once.
    """
    members = staged(members, "crowded")
    often = staged(members.groupBy("class").agg(F.count("*").alias("_w")).join(maps, "class"), "often")
    placed = staged(salted_join(members, often, "class", "_w", ["key"]), "placed")
    buckets = placed.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("bits")).alias("_bytes"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("who"), F.min("class").alias("least"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("_bytes") / BLOCK_BYTES)).cast("int")
    one = staged(buckets.groupBy("n", "who", "least").agg(F.min("key").alias("key"), F.max(blocks).alias("blocks")).select("key", "blocks", "n"), "buckets")
    own = salted_join(placed, one, "key", "n", ["class"]).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    packed = own.groupBy("key", "own").agg(*[F.collect_list(c).alias(c) for c in ("class", "size", "bits")], F.max("blocks").alias("blocks"))
    units = staged(packed, "blocks").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class", "size", "bits")
    return units.groupBy("key", "i", "j").applyInPandas(lambda pdf: _block_pairs(pdf, threshold), "a long, b long")


def _kept(pairs: DataFrame, maps: DataFrame, hot_a: DataFrame | None, hot_b: DataFrame | None, threshold: float) -> DataFrame:
    """The candidate pairs whose sketches can reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = [batch.column(k).to_numpy().astype(np.int64) for k in (2, 4)], [batch.column(k).to_pylist() for k in (3, 5)]
            ok = pa.array(may_reach(sizes[0], bits[0], sizes[1], bits[1], threshold))
            yield batch.select([0, 1]).filter(ok)

    a = spread_out(maps.select(F.col("class").alias("a"), F.col("size").alias("na"), F.col("bits").alias("ba")), hot_a, "a")
    b = spread_out(maps.select(F.col("class").alias("b"), F.col("size").alias("nb"), F.col("bits").alias("bb")), hot_b, "b")
    joined = salted(pairs, hot_a, "a", ["b"]).join(a, ["a", "_salt"]).drop("_salt")
    joined = salted(joined, hot_b, "b", ["a"]).join(b, ["b", "_salt"]).drop("_salt")
    return joined.select("a", "b", "na", "ba", "nb", "bb").mapInArrow(run, "a long, b long")


def similar(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """a < b, similarity: the pairs of classes whose token sets have a Jaccard similarity of threshold or more.

    classes: class (long, unique), tokens (array of distinct longs); staged. Empty sets are like nothing. A pair at the
    threshold is found with probability `recall`, a closer one more surely; every candidate is verified on the full sets.
    """
    spark = classes.sparkSession
    filled = classes.filter(F.size("tokens") > 0)
    bands, rows = bands_and_rows(filled.count(), threshold, recall)
    n = partitions(spark)
    keys = banded(filled, bands, rows)
    bucketed = keys.repartition(n, "key").sortWithinPartitions("key")  # one long: a radix sort
    out = staged(bucketed.mapInArrow(_pairs, "key long, a long, b long"), "buckets")
    pairs = out.filter(F.col("b").isNotNull()).select("a", "b")
    crowd = out.filter(F.col("b").isNull()).select("key", F.col("a").alias("class"))
    maps = staged(sketches(filled), "sketches")
    if not crowd.isEmpty():
        pairs = pairs.unionByName(_crowded(crowd, maps, threshold))
    pairs = staged(pairs.distinct(), "pairs")
    hot_a, hot_b = hot_keys(pairs, "a"), hot_keys(pairs, "b")  # a text with a great many partners
    pairs = staged(_kept(pairs, maps, hot_a, hot_b, threshold), "kept")
    left = spread_out(classes.select(F.col("class").alias("a"), F.col("tokens").alias("ta")), hot_a, "a")
    right = spread_out(classes.select(F.col("class").alias("b"), F.col("tokens").alias("tb")), hot_b, "b")
    joined = salted(pairs, hot_a, "a", ["b"]).join(left, ["a", "_salt"]).drop("_salt")
    joined = salted(joined, hot_b, "b", ["a"]).join(right, ["b", "_salt"]).drop("_salt")
    common = F.size(F.array_intersect("ta", "tb"))
    joined = joined.select("a", "b", common.alias("_both"), (F.size("ta") + F.size("tb")).alias("_sum"))
    # Compared as integers times the threshold's decimal, so that a similarity of exactly the threshold counts.
    exact = F.col("_both") * 1_000_000 >= F.lit(round(threshold * 1_000_000)) * (F.col("_sum") - F.col("_both"))
    return joined.filter(exact).select("a", "b", (F.col("_both") / (F.col("_sum") - F.col("_both"))).alias("similarity"))


def word_set(title: Column, content: Column) -> Column:
    """The distinct runs of a-z and 0-9 of title, a space, and content, lower-cased; nulls as empty texts."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    return F.array_distinct(F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != ""))


def holon_classes(holons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, class; classes: class, tokens, n), both staged. Holons with equal word sets are one class.

    Of rows with the same id the one updated last counts. Word sets are told apart by 128 bits of hash, words by 64.
    """
    words = F.array_sort(F.transform(word_set(F.col("title"), F.col("content")), lambda w: F.xxhash64(w)))
    rows = holons.select(key(F.col("id")).alias("id"), F.struct("updated_at", words.alias("tokens")).alias("s")).filter(F.col("id").isNotNull())
    code = F.struct(F.xxhash64("s.tokens").alias("x"), F.xxhash64(F.lit(1), "s.tokens").alias("y")).alias("code")
    one = staged(rows.groupBy("id").agg(F.max("s").alias("s")).select("id", code, F.col("s.tokens").alias("tokens")), "holons")
    grouped = one.groupBy("code").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    classes = staged(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = salted_join(one.select("id", "code"), classes.select("code", "class", F.col("n").alias("_w")), "code", "_w", ["id"])
    return staged(members.select("id", "class"), "members"), classes.select("class", "tokens", "n")


def id_pairs(members: DataFrame, classes: DataFrame, alike: DataFrame) -> DataFrame:
    """id_a < id_b for the members of alike classes, and of one class: the form the result is asked for in.

    The expansion joins members by class; hot classes are split. Its size is that of the result.
    """
    several = classes.filter((F.col("n") > 1) & (F.size("tokens") > 0)).select("class", F.col("class").alias("other"))
    both = alike.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(several)
    hot = hot_keys(members, "class")
    placed = salted(members, hot, "class", ["id"])
    first = spread_out(both, hot, "class").join(placed.withColumnRenamed("id", "x"), ["class", "_salt"]).select("x", F.col("class").alias("from"), F.col("other").alias("class"))
    full = spread_out(first, hot, "class").join(placed.withColumnRenamed("id", "y"), ["class", "_salt"])
    return full.filter((F.col("from") != F.col("class")) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, group, n_links: connected components of undirected links a-b by min-label hooking with shortcuts.

    Each round takes the least group among neighbours and then that group's own group; rounds grow with the logarithm
    of the diameter. Labels of all nodes stay distributed.
    """
    two = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    degree = two.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    hot = hot_keys(two, "b")
    two = staged(salted(two, hot, "b", ["a"]), "links")
    label = staged(degree.select("node", F.col("node").alias("group")), "labels")
    while True:
        near = two.join(spread_out(label.select(F.col("node").alias("b"), "group"), hot, "b"), ["b", "_salt"]).groupBy(F.col("a").alias("node")).agg(F.min("group").alias("low"))
        hooked = staged(label.join(near, "node").select("node", "group", F.least("group", "low").alias("new")), "hook")
        # A group's root moves to the least label any of its members saw, then everyone follows the root.
        roots = hooked.groupBy(F.col("group").alias("root")).agg(F.min("new").alias("to"), F.count("*").alias("_w"))
        moved = salted_join(hooked.withColumnRenamed("group", "root"), staged(roots, "roots"), "root", "_w", ["node"])
        after = staged(moved.select("node", F.col("root").alias("was"), F.least("new", "to").alias("group")), "labels")
        label = after.select("node", "group")
        if after.filter(F.col("group") != F.col("was")).isEmpty():
            break
    marks = label.join(degree, "node")
    return nodes.join(marks, "node", "left").select("node", F.coalesce("group", "node").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, classes = holon_classes(table(spark, sf_dir, "holons"))
    return id_pairs(members, classes, similar(classes))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per holon: the least id of its group of near-duplicates, its class links, and the copies in its class."""
    members, classes = holon_classes(table(spark, sf_dir, "holons"))
    alike = staged(similar(classes), "alike")
    marks = labelled(classes.select(F.col("class").alias("node")), alike)
    sized = classes.select(F.col("class").alias("node"), "n").join(marks, "node")
    rows = staged(members.withColumnRenamed("class", "node").join(sized, "node"), "rows")
    names = staged(rows.groupBy("group").agg(F.min("id").alias("group_id"), F.count("*").alias("_w")), "names")
    return salted_join(rows, names, "group", "_w", ["id"]).select("id", "group_id", F.col("n_links").cast("long").alias("n_links"), F.col("n").alias("n_copies"))


_WORDS = """list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(content, '')), '[a-z0-9]+')))"""
_SQL = f"""
WITH one AS (
  SELECT trim(regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g'), '-') AS id, {_WORDS} AS words FROM holons
  QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g'), '-') ORDER BY updated_at DESC) = 1
), w AS (SELECT id, len(words) AS n, unnest(words) AS word FROM one),
both_ AS (SELECT a.id AS id_a, b.id AS id_b, a.n + b.n AS total, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2, 3)
SELECT id_a, id_b FROM both_ WHERE c * 10 >= 7 * (total - c)
"""
_GROUPS = _SQL.replace("WITH one", "WITH RECURSIVE one").replace("SELECT id_a, id_b FROM both_", ", pair AS (SELECT id_a, id_b FROM both_") + """),
link AS (SELECT id_a AS x, id_b AS y FROM pair UNION SELECT id_b, id_a FROM pair),
reach AS (SELECT id AS x, id AS y FROM one UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
class AS (SELECT id, words, count(*) OVER (PARTITION BY words) AS n_copies FROM one)
SELECT c.id, min(r.y) AS group_id, n_copies,
  (SELECT count(DISTINCT o.words) FROM link l JOIN class o ON o.id = l.y WHERE l.x = c.id AND o.words <> c.words) AS n_links
FROM class c JOIN reach r ON r.x = c.id GROUP BY c.id, n_copies, c.words
"""

QUERIES = {"p4_found": found, "p4_groups": groups}
SQL = {"p4_found": _SQL, "p4_groups": _GROUPS}
