"""Mixing sources to target weights, in tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions.scalars import key
from corvane.operators.sequence import running_total
from corvane.session import partitions, staged
from corvane.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 128
SHARD_SLOTS = 4_096


@dataclass(frozen=True)
class Source:
    """A source of the plan: `share` of the targets as given, `blocks` to draw from, and `slots`, the draws it gets."""

    name: str
    share: float
    max_repeats: int
    tokens: int
    blocks: int
    slots: int


def sized(documents: DataFrame, sources: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, code, n_tokens of the documents of the given sources with a text; code is a 128-bit hash of the text.

    Whole texts are tokenized, in Arrow batches, once; special tokens are ordinary text. Null and blank texts, and rows
    without doc_id, are left out.
    """
    with open(tokenizer, "rb") as f:
        data = f.read()  # a fixed vocabulary, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(t.as_py())) for t in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n], names=["doc_id", "source", "code", "n_tokens"])

    text = F.col("text")
    rows = documents.select("doc_id", key(F.col("source")).alias("source"), F.md5(text.cast("binary")).alias("code"), "text")
    rows = rows.filter(F.col("doc_id").isNotNull() & text.rlike(r"\S") & F.col("source").isin(sources))
    return rows.mapInArrow(run, "doc_id long, source string, code string, n_tokens long")


def distinct_texts(sizes: DataFrame) -> DataFrame:
    """One row per text: of copies, the document with the least doc_id stands for all, in its own source."""
    one = sizes.groupBy("code").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d"))
    return one.select("d.doc_id", "d.source", "d.n_tokens").filter(F.col("n_tokens") > 0)


def wanted(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, max_repeats); the table says what is wanted, a row a source, and is collected. Sources are compared by slug; of repeated ones the shares add up and the least cap
    holds. Rows without a source or a positive share are left out; a missing cap is 1, caps under 1 are 0."""
    rows = targets.groupBy(key(F.col("source")).alias("source")).agg(F.sum("target_share"), F.min(F.coalesce("max_repeats", F.lit(1)))).collect()
    return {r[0]: (float(r[1]), max(0, int(r[2]))) for r in sorted(rows, key=lambda r: r[0] or "") if r[0] and r[1] and r[1] > 0}


def planned(tokens: dict[str, int], targets: dict[str, tuple[float, int]], block_tokens: int, total_tokens: int | None = None) -> list[Source]:
    """The slots each source gets.

    Without total_tokens the total is the largest at which every source that has documents reaches its share within its
    cap. With it, sources that would exceed their cap are filled to it and the rest shares what is left in proportion,
    as far as caps allow. A source without documents gets nothing; its share falls to the others in proportion.
    """
    rows = [(s, share, cap, tokens.get(s, 0)) for s, (share, cap) in targets.items()]
    blocks = {s: -(-n // block_tokens) for s, _, _, n in rows}
    most = {s: blocks[s] * cap for s, _, cap, _ in rows}
    live = {s: share for s, share, _, _ in rows if most[s] > 0}
    slots = dict.fromkeys(targets, 0)
    if live:
        weight = sum(live.values())
        if total_tokens is None:
            total = min(most[s] * weight / share for s, share in live.items())
            slots |= {s: min(most[s], round(total * share / weight)) for s, share in live.items()}
        else:
            left, open_ = total_tokens / block_tokens, dict(live)
            while open_:
                weight = sum(open_.values())
                full = {s for s, share in open_.items() if left * share / weight >= most[s]}
                if not full:
                    slots |= {s: min(most[s], round(left * share / weight)) for s, share in open_.items()}
                    break
                for s in full:
                    slots[s] = most[s]
                    left -= most[s]
                    open_.pop(s)
    return [Source(s, share, cap, n, blocks[s], slots[s]) for s, share, cap, n in rows]


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at `index`: a four-round Feistel network, walked until it falls inside."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 2**63, 4, dtype=np.uint64)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            f = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def drawn(shard: int, counts: np.ndarray, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(source, number of the draw of that source) at each place of an output shard; counts: the slots of each source.

    All slots are laid out source after source and dealt to the places of all shards by a pseudorandom permutation. So
    the counts of a shard are multinomial draws given their totals, which come out exactly; every task finds its own
    shards alone, at any number of slots, and no draw comes twice.
    """
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    slot = permuted(np.arange(shard * shard_slots, min((shard + 1) * shard_slots, total)), total, [seed])
    which = np.searchsorted(ends, slot, side="right")
    return which, slot - (ends - counts)[which]


def slots(spark: SparkSession, plan: list[Source], seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, place, source, block: which block of which source stands at each place of each output shard.

    The k-th draw of a source maps to block perm(k mod blocks) of its (k div blocks)-th pass, each pass with a
    permutation of its own; so a block recurs only after all others, and never more than max_repeats times.
    """
    used = [s for s in plan if s.slots > 0]
    counts = np.array([s.slots for s in used], np.int64)
    shards = -(-int(counts.sum()) // shard_slots)
    names = np.array([s.name for s in used], object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                which, k = drawn(int(shard), counts, shard_slots, seed)
                block = np.zeros(len(k), np.int64)
                for i in np.unique(which):
                    own = np.flatnonzero(which == i)
                    lap, at = np.divmod(k[own], used[i].blocks)
                    for p in np.unique(lap):
                        block[own[lap == p]] = permuted(at[lap == p], used[i].blocks, [seed, int(i), int(p)])
                yield pd.DataFrame({"shard": shard, "place": np.arange(len(k)), "source": names[which], "block": block})

    rows = spark.range(0, shards, 1, max(1, min(shards, 4 * partitions(spark))))
    return rows.mapInPandas(run, "shard long, place long, source string, block long")


def pieces(texts: DataFrame, block_tokens: int) -> DataFrame:
    """Texts packed end to end into blocks of block_tokens, per source, in the order of a hash of doc_id: doc_id, source,
    n_tokens, block, from_token (of the document), piece_tokens. The last block of a source may be short."""
    at = running_total(texts.withColumn("_hash", F.xxhash64("doc_id")), "source", ["_hash", "doc_id"], "n_tokens").drop("_hash")
    first, last = F.floor(F.col("_before") / block_tokens), F.floor((F.col("_before") + F.col("n_tokens") - 1) / block_tokens)
    cut = at.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("_before"), F.col("block") * block_tokens)
    end = F.least(F.col("_before") + F.col("n_tokens"), (F.col("block") + 1) * block_tokens)
    return cut.select("doc_id", "source", "n_tokens", "block", (start - F.col("_before")).alias("from_token"), (end - start).alias("piece_tokens"))


@dataclass(frozen=True)
class Mix:
    plan: list[Source]
    pieces: DataFrame
    slots: DataFrame


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 20, tokenizer: str = TOKENIZER) -> Mix:
    """Plan a mix and lay out its blocks. Documents of sources without a target are not used; copies of a text count as
    one text, so that no text is used more than max_repeats times however often it is stored."""
    spark = documents.sparkSession
    goal = wanted(targets)
    texts = staged(distinct_texts(sized(documents, list(goal), tokenizer)), "texts")
    tokens = {r[0]: int(r[1]) for r in texts.groupBy("source").agg(F.sum("n_tokens")).collect()}  # one row per target
    plan = planned(tokens, goal, block_tokens, total_tokens)
    return Mix(plan, pieces(texts, block_tokens), slots(spark, plan, seed))


def used(mix: Mix) -> DataFrame:
    """Blocks joined by index: doc_id, source, n_tokens, repeats (the most often any part of the document is used), and
    used_tokens, for the documents chosen."""
    times = mix.slots.groupBy("source", "block").agg(F.count("*").alias("times"))
    joined = mix.pieces.join(times.hint("merge"), ["source", "block"])  # either side grows with the data
    return joined.groupBy("doc_id", "source").agg(F.first("n_tokens").alias("n_tokens"), F.max("times").alias("repeats"), F.sum(F.col("times") * F.col("piece_tokens")).alias("used_tokens"))


def _mixed(spark: SparkSession, sf_dir: str) -> Mix:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return used(_mixed(spark, sf_dir))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: the pieces of documents at each place of each output shard."""
    mix = _mixed(spark, sf_dir)
    return mix.slots.join(mix.pieces.drop("n_tokens").hint("merge"), ["source", "block"]).select("shard", "place", "source", "block", "doc_id", "from_token", "piece_tokens")


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of the targets with its target and actual share, what it has and what is used of it."""
    mix = _mixed(spark, sf_dir)
    plan = spark.createDataFrame([(s.name, s.share, s.max_repeats, s.tokens) for s in mix.plan], "source string, target_share double, max_repeats int, tokens_available long")
    sums = used(mix).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("used_tokens").alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    sums = staged(sums, "sums")
    total = sums.agg(F.sum("tokens_used")).first()[0] or 1
    zero = F.lit(0).cast("long")
    return plan.join(sums, "source", "left").select(
        "source", "target_share", (F.coalesce("tokens_used", zero) / F.lit(total)).alias("actual_share"), "max_repeats",
        F.coalesce("most_repeats", zero).alias("most_repeats"), "tokens_available", F.coalesce("tokens_used", zero).alias("tokens_used"), F.coalesce("n_docs", zero).alias("n_docs"),
    )


def broken(mix: Mix, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """rule, n: how often each thing that holds of every mix does not: pieces make up whole documents, blocks are full but for
    the last of a source, no block or document is used more often than its source may be, the slots drawn are those
    planned, and, where no source is at its cap, shares are right to a block."""
    spark = mix.slots.sparkSession
    plan = spark.createDataFrame([(s.name, s.share, s.max_repeats, s.blocks, s.slots) for s in mix.plan], "source string, share double, cap int, blocks long, planned long")
    cut, dealt = staged(mix.pieces, "pieces"), staged(mix.slots, "slots")
    docs = cut.groupBy("doc_id").agg(F.sum("piece_tokens").alias("t"), F.max("n_tokens").alias("n")).filter("t <> n")
    full = cut.groupBy("source", "block").agg(F.sum("piece_tokens").alias("t")).join(F.broadcast(plan), "source").filter((F.col("t") != block_tokens) & (F.col("block") != F.col("blocks") - 1))
    often = dealt.groupBy("source", "block").agg(F.count("*").alias("n")).join(F.broadcast(plan), "source").filter("n > cap OR block >= blocks OR block < 0")
    got = plan.join(dealt.groupBy("source").agg(F.count("*").alias("n")), "source", "left").filter("coalesce(n, 0) <> planned")
    capped = used(mix).join(F.broadcast(plan), "source").filter("repeats > cap")
    live = sum(s.share for s in mix.plan if s.blocks * s.max_repeats)
    total = sum(s.slots for s in mix.plan)
    # At the largest total one source is at its cap by construction and still has its share.
    off = sum(abs(s.slots - total * s.share / live) > 1 for s in mix.plan if s.blocks * s.max_repeats)
    counts = {"documents cut into pieces": docs, "full blocks": full, "repeats of blocks": often, "slots as planned": got, "repeats of documents": capped}
    rows = [(rule, df.count()) for rule, df in counts.items()] + [("shares to a block", off)]
    return spark.createDataFrame(rows, "rule string, n long")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken(_mixed(spark, sf_dir))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of as many tokens as the documents have, small sources filled up to their caps."""
    documents = table(spark, sf_dir, "documents")
    total = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    return used(mixed(documents, table(spark, sf_dir, "mix_targets"), total_tokens=total // 4))


QUERIES = {"p7_mix": chosen, "p7_layout": layout, "p7_shares": shares, "p7_mix_of_all": asked, "p7_rules": rules}
SQL = {
    "p7_rules": "SELECT unnest(['documents cut into pieces', 'full blocks', 'repeats of blocks', 'slots as planned', 'repeats of documents', 'shares to a block']) AS rule, CAST(0 AS BIGINT) AS n",
}
