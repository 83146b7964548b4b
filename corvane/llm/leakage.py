"""Evaluation passages that leak into documents: suffix arrays over shards of the documents, searched with every test suffix."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.session import staged
from corvane.sources.tables import table

#: Consecutive words that make a leak.
LEAST_WORDS = 12
#: Words of documents in one suffix array. A longer document makes an array of its own.
SHARD_WORDS = 1_500_000
#: Characters of test items searched at once.
ITEM_CHARS = 4_000_000
#: The map of all items' passages has two to the power of so many bits.
FILTER_BITS = 27
WORD = re.compile(r"[^\W_]+")
MATCHES = "doc_id long, item_id long, match_words int, doc_word int, item_word int"


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased; an underscore is neither. None has none."""
    return WORD.findall(text.lower()) if text else []


def ranks(codes: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix of codes among all, compared up to `depth` codes: prefix doubling. 0 ends a suffix."""
    rank = codes.astype(np.int64)
    k = 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] if k < len(rank) else 0
        after[codes == 0] = 0
        _, new = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)
        rank = new.astype(np.int64)
        if int(rank.max(initial=0)) == len(rank) - 1:
            break
        k *= 2
    return rank


class Items:
    """Test items as codes of their own vocabulary, with the start of every suffix of `least` words or more."""

    def __init__(self, rows: list[tuple[int, str | None]], least: int):
        self.least = least
        self.code: dict[str, int] = {}
        codes, starts, item, place, longest = [], [], [], [], 0
        for item_id, body in rows:
            own = [self.code.setdefault(w, len(self.code) + 1) for w in words(body)]
            n = max(0, len(own) - least + 1)
            starts.extend(range(len(codes), len(codes) + n))
            item.extend([item_id] * n)
            place.extend(range(n))
            codes.extend([*own, 0])
            longest = max(longest, len(own))
        self.codes, self.starts = np.array(codes, np.int64), np.array(starts, np.int64)
        self.item, self.place, self.longest = np.array(item, np.int64), np.array(place, np.int64), longest

    def search(self, text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """The longest match of each document of a shard with each item: document, item, place in the item, position in text,
        length in words; of several the earliest in the document, then in the item.

        text: codes of the shard's words, 0 for a word no item has and between documents; begins: where each document
        begins. Only suffixes that begin with `least` words of the vocabulary can match, so only stretches of such words
        enter the suffix array. Occurrences are never paired with one another: of a phrase that a text repeats and many
        items share, each item meets the text once.
        """
        none = (np.empty(0, np.int64),) * 5
        known = np.concatenate([[False], text != 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        begin, end = edge[::2], edge[1::2]
        keep = end - begin >= self.least
        begin, end = begin[keep], end[keep]
        if not len(begin) or not len(self.starts):
            return none
        size = end - begin + 1  # and a 0
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        codes = np.where(at == np.repeat(end, size), 0, text[np.minimum(at, len(text) - 1)])
        left = np.repeat(end, size) - at
        rank = ranks(codes, self.longest)
        suffix = np.flatnonzero(left >= self.least)
        suffix = suffix[np.argsort(rank[suffix], kind="stable")]
        low, high = (self._bounds(codes, suffix, self.starts, self.least, after) for after in (False, True))
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return none
        # A range of the suffix array per passage of `least` words: they are disjoint, so their entries are at most the text.
        ranges, which = np.unique(low[hit], return_inverse=True)
        until = np.zeros(len(ranges), np.int64)
        until[which] = high[hit]
        many = until - ranges
        entry = np.repeat(ranges - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        doc = np.searchsorted(begins, at[suffix[entry]], side="right") - 1
        # Which document holds which passage at all, and, by that, the test suffixes to compare with each document.
        pair = np.unique(np.repeat(np.arange(len(ranges)), many) * len(begins) + doc)
        part, held = np.divmod(pair, len(begins))
        by_part = np.argsort(which, kind="stable")
        count = np.bincount(which, minlength=len(ranges))
        each = count[part]
        window = hit[by_part[np.repeat((np.cumsum(count) - count)[part] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())]]
        held = np.repeat(held, each)
        # Of a document's suffixes, the one before and the one after the test suffix have the longest match with it.
        size = len(suffix) + 1
        place = doc * size + entry
        order = np.argsort(place)
        place, where = place[order], at[suffix[entry]][order]
        full = np.zeros(len(self.starts), np.int64)
        full[hit] = self._bounds(codes, suffix, self.starts[hit], self.longest, False)
        next_ = np.searchsorted(place, held * size + full[window])
        length = np.zeros(len(window), np.int64)
        for side in (next_ - 1, next_):
            ok = (side >= 0) & (side < len(place))
            ok[ok] = place[side[ok]] // size == held[ok]
            near = suffix[place[side[ok]] % size]
            length[ok] = np.maximum(length[ok], self._common(codes, near, self.starts[window[ok]]))
        # The longest of each document and item, there the earliest in the document, then in the item.
        item = self.item[window]
        order = np.lexsort((-length, item, held))
        window, held, item, length = window[order], held[order], item[order], length[order]
        first = np.concatenate([[True], (held[1:] != held[:-1]) | (item[1:] != item[:-1])])
        best = length == length[np.flatnonzero(first)[np.cumsum(first) - 1]]
        window, held, item, length = window[best], held[best], item[best], length[best]
        low, high = (self._bounds(codes, suffix, self.starts[window], length, after) for after in (False, True))
        span = np.stack([np.searchsorted(place, held * size + low), np.searchsorted(place, held * size + high)], 1).reshape(-1)
        earliest = np.minimum.reduceat(np.append(where, len(text)), span)[::2]
        order = np.lexsort((self.place[window], earliest, item, held))
        window, held, item, length, earliest = window[order], held[order], item[order], length[order], earliest[order]
        first = np.concatenate([[True], (held[1:] != held[:-1]) | (item[1:] != item[:-1])])
        return held[first], item[first], self.place[window[first]], earliest[first], length[first]

    def _bounds(self, codes: np.ndarray, suffix: np.ndarray, starts: np.ndarray, depth: int | np.ndarray, after: bool) -> np.ndarray:
        """For each test suffix the first entry of the suffix array that does not sort before it, or (after) sorts behind
        it, compared by the first `depth` words: all binary searches advance together."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(suffix), np.int64)
        depth = np.broadcast_to(depth, len(starts))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            order = np.zeros(len(open_), np.int64)
            live = np.arange(len(open_))
            for t in range(int(depth[open_].max())):
                a, b = codes[suffix[mid[live]] + t], self.codes[starts[open_[live]] + t]
                order[live] = np.sign(a - b)
                live = live[(a == b) & (a != 0) & (depth[open_[live]] > t + 1)]
                if not live.size:
                    break
            down = order <= 0 if after else order < 0
            low[open_] = np.where(down, mid + 1, low[open_])
            high[open_] = np.where(down, high[open_], mid)
        return low

    def _common(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the text at a and the items at b have in common from there on."""
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        while live.size:
            x, y = codes[a[live] + out[live]], self.codes[b[live] + out[live]]
            live = live[(x == y) & (x != 0)]
            out[live] += 1
        return out


def _shards(items: Items, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[np.ndarray] = []
        held = 0
        get = items.code.get

        def flush() -> Iterator[pa.RecordBatch]:
            begin = np.cumsum([0] + [len(t) for t in texts[:-1]]).astype(np.int64)
            doc, item, place, where, length = items.search(np.concatenate(texts), begin)
            columns = [pa.array([ids[d] for d in doc], pa.int64()), pa.array(item), pa.array(length.astype(np.int32)), pa.array((where - begin[doc]).astype(np.int32)), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "match_words", "doc_word", "item_word"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = [get(w, 0) for w in words(text.as_py())]
                if len(codes) < items.least:
                    continue
                codes.append(0)
                ids.append(doc_id)
                texts.append(np.array(codes, np.int64))
                held += len(codes)
                if held >= shard_words:
                    yield from flush()
                    ids, texts, held = [], [], 0
        if texts:
            yield from flush()

    return run


def passage_hashes(hashes: np.ndarray, least: int) -> np.ndarray:
    """A hash for each `least` consecutive words, from the words' hashes."""
    n = len(hashes) - least + 1
    out = np.zeros(max(n, 0), np.uint64)
    for t in range(least if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[t : t + n]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FILTER_BITS)


def _suspects(documents: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """doc_id, text of the documents that may hold a passage of any item; bits: a map of the hashes of all items' passages.
    None that holds one is missed."""
    data = np.packbits(bits).tobytes()  # 2 ** FILTER_BITS / 8 bytes, whatever the number of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = np.unpackbits(np.frombuffer(data, np.uint8)), {}
        for batch in batches:
            keep = []
            for text in batch.column(1):
                found = words(text.as_py())
                if len(cache) > 1_000_000:
                    cache.clear()
                for w in set(found) - cache.keys():
                    cache[w] = xxhash.xxh64_intdigest(w)
                keep.append(bool(known[passage_hashes(np.array([cache[w] for w in found], np.uint64), least)].any()))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def matches(documents: DataFrame, eval_items: DataFrame, least: int = LEAST_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id, match_words, doc_word, item_word: each document with each item of which it holds at least `least`
    consecutive words, the length of the longest such passage and where it begins, in words, in either.

    Each task builds suffix arrays over shards of its documents and binary-searches every suffix of every item in them;
    documents are read once, whole, and never shuffled. Items are sent to the tasks in blocks of bounded size. Where there
    are several blocks, one pass over the documents with a map of the hashes of all passages leaves those that may hold
    one, and only these are read again per block. A null or short text, and a null or short body, match nothing; every
    copy of a document is reported.
    """
    chars = eval_items.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = -(-chars // ITEM_CHARS) or 1
    texts = documents.select("doc_id", "text")

    def block(b: int) -> list[tuple[int, str | None]]:
        part = eval_items if blocks == 1 else eval_items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        return [(r[0], r[1]) for r in part.select("item_id", "body").filter(F.col("item_id").isNotNull()).distinct().sort("item_id").collect()]

    if blocks > 1:
        bits = np.zeros(1 << FILTER_BITS, np.uint8)
        for b in range(blocks):
            for _, body in block(b):
                bits[passage_hashes(np.array([xxhash.xxh64_intdigest(w) for w in words(body)], np.uint64), least)] = 1
        texts = staged(_suspects(texts, bits, least), "suspects")
    found = None
    for b in range(blocks):
        one = texts.mapInArrow(_shards(Items(block(b), least), shard_words), MATCHES)
        found = one if found is None else found.unionByName(one)
    return found


def decontaminated(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """documents without those that hold a passage of an item."""
    return documents.join(hits.select("doc_id").distinct(), "doc_id", "left_anti")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("doc_id", "item_id")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


def leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test item with the number of documents that hold a passage of it and the longest such passage."""
    hits = _matches(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("match_words").alias("longest"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite")
    return items.join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return decontaminated(documents, staged(_matches(spark, sf_dir).select("doc_id"), "hits"))


_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest([array_to_string(w[i:i + 11], ' ') for i in range(1, len(w) - 10)]) AS g FROM d WHERE len(w) >= 12),
eg AS (SELECT item_id, unnest([array_to_string(w[i:i + 11], ' ') for i in range(1, len(w) - 10)]) AS g FROM e WHERE len(w) >= 12),
hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))
"""
_LONG = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(range(len(w) - 11)) AS at_, unnest([array_to_string(w[i:i + 11], ' ') for i in range(1, len(w) - 10)]) AS g FROM d WHERE len(w) >= 12),
eg AS (SELECT item_id, unnest(range(len(w) - 11)) AS place, unnest([array_to_string(w[i:i + 11], ' ') for i in range(1, len(w) - 10)]) AS g FROM e WHERE len(w) >= 12),
both_ AS (SELECT doc_id, item_id, at_, place, at_ - row_number() OVER (PARTITION BY doc_id, item_id, at_ - place ORDER BY at_) AS island FROM dg JOIN eg USING (g)),
run AS (SELECT doc_id, item_id, count(*) + 11 AS n, min(at_) AS at_, min(place) AS place FROM both_ GROUP BY doc_id, item_id, at_ - place, island),
best AS (SELECT doc_id, item_id, CAST(n AS INT) AS match_words, CAST(at_ AS INT) AS doc_word, CAST(place AS INT) AS item_word FROM run
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, at_, place) = 1)
"""

QUERIES = {"p6_found": found, "p6_passages": passages, "p6_leaked_items": leaked_items, "p6_clean": clean}
SQL = {
    "p6_found": _SQL + "SELECT doc_id, item_id FROM hit",
    "p6_passages": _LONG + "SELECT * FROM best",
    "p6_leaked_items": _LONG + "SELECT item_id, suite, count(doc_id) AS n_docs, coalesce(max(match_words), 0) AS longest FROM eval_items LEFT JOIN best USING (item_id) GROUP BY 1, 2",
    "p6_clean": _SQL + "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)",
}
