"""Parent-child links to full hierarchies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions.scalars import key
from corvane.operators.skew import salted_join
from corvane.session import staged
from corvane.sources.tables import table

#: Links that one task solves at once: some 200 bytes each in pandas.
BLOCK_ROWS = 150_000
#: A level that leaves more than this share of its links is followed by doubling instead of another one.
SHRINKS = 0.9
SOLVED = "id string, top string, off long, low string, state string"


def parent_links(holons: DataFrame) -> DataFrame:
    """id, up, near: one row per distinct id; up is null where the parent is null, blank or no holon; near is the context, in
    which most links stay. Staged.

    Of an id's rows the one updated last gives the parent. Rows without an id are left out.
    """
    near = F.col("context_id") if "context_id" in holons.columns else F.lit(None).cast("string")
    rows = holons.select(key(F.col("id")).alias("id"), key(F.col("parent_id")).alias("up"), "updated_at", near.alias("near")).filter(F.col("id").isNotNull())
    one = staged(rows.groupBy("id").agg(F.max(F.struct("updated_at", "up", "near")).alias("s")).select("id", F.col("s.up").alias("up"), F.col("s.near").alias("near")), "nodes")
    child = one.filter(F.col("up").isNotNull())
    named = child.groupBy("up").agg(F.count("*").alias("children"))
    # Every parent that is named, the missing ones too: either kind may be hot.
    parents = staged(named.join(one.select(F.col("id").alias("up"), F.lit(True).alias("real")), "up", "left"), "parents")
    linked = salted_join(child, parents, "up", "children", ["id"]).select("id", F.when(F.col("real"), F.col("up")).alias("up"), "near")
    return staged(linked.unionByName(one.filter(F.col("up").isNull())), "links")


def solve_block(links: pd.DataFrame) -> pd.DataFrame:
    """A weighted disjoint-set forest over the links of one block.

    links: id, up (null: id is a root), off (steps from id to up), low (smallest id among those steps). A node starts as a
    set of its own; a link hangs it below the representative of the set its upper end is in, with its offset to that, and
    paths are compressed with their offsets as they are walked. A link whose upper end is already in the set below its
    node closes a cycle. Every node gets the top it hangs from and its offset: state root (top is a root, off the depth),
    open (top lies in another block) or cycle (low is the smallest id on the cycle).
    """
    ids, ups, offs, lows = (links[c].tolist() for c in ("id", "up", "off", "low"))
    place = {x: i for i, x in enumerate(ids)}
    n = len(ids)
    above, steps, least = list(range(n)), [0] * n, list(lows)  # least: over the steps up to the representative
    ring: dict[int, str] = {}

    def find(x: int) -> int:
        way = []
        while above[x] != x:
            way.append(x)
            x = above[x]
        for y in reversed(way):
            up = above[y]
            if up != x:
                steps[y] += steps[up]
                least[y] = min(least[y], least[up])
                above[y] = x
        return x

    for x, up in enumerate(ups):
        j = place.get(up) if isinstance(up, str) else None
        if j is None:
            continue
        top = find(j)
        low = lows[x] if j == top else min(lows[x], least[j])
        if top == x:
            ring[x] = low
        else:
            above[x], steps[x], least[x] = top, offs[x] + steps[j], low
    rows = []
    for x in range(n):
        top = find(x)
        if top in ring:
            rows.append((ids[x], ids[top], -1, ring[top], "cycle"))
        elif not isinstance(ups[top], str):
            rows.append((ids[x], ids[top], steps[x], lows[x], "root"))
        else:
            rows.append((ids[x], ups[top], steps[x] + offs[top], lows[top] if x == top else min(least[x], lows[top]), "open"))
    return pd.DataFrame(rows, columns=["id", "top", "off", "low", "state"])


def _placed(links: DataFrame, count: int, block_rows: int, seed: int) -> DataFrame:
    """links with `_block`, so that many of them have both ends in one block.

    First by `near`: a context stays together, one larger than a block in pieces. Elsewhere, and inside a large context, a
    coin is tossed for every id: a node with heads stays at its own place, one with tails goes to that of its upper end;
    so a link from tails to heads is inside a block however many blocks there are, a quarter of all at least.
    """
    blocks = -(-count // block_rows)
    heads = F.xxhash64("id", F.lit(seed)) % 2 == 0
    mate = F.when(heads, F.col("id")).otherwise(F.coalesce("up", "id"))
    if "near" not in links.columns:
        return links.withColumn("_block", F.pmod(F.xxhash64(mate, F.lit(seed)), F.lit(blocks)).cast("int"))
    # Contexts larger than half a block: at most two per block.
    large = links.filter(F.col("near").isNotNull()).groupBy("near").agg(F.count("*").alias("_n")).filter(F.col("_n") > block_rows / 2)
    large = staged(large.select("near", F.ceil(F.col("_n") * 2 / block_rows).cast("int").alias("_pieces")), "large")
    piece = F.when(F.col("near").isNull(), F.xxhash64(mate, F.lit(seed))).when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64(mate, F.lit(seed)), F.col("_pieces"))).otherwise(0)
    return links.join(large, "near", "left").withColumn("_block", F.pmod(F.xxhash64("near", piece), F.lit(2 * blocks)).cast("int")).drop("near", "_pieces")


def _solved(links: DataFrame) -> DataFrame:
    return staged(links.groupBy("_block").applyInPandas(lambda pdf: solve_block(pdf), SOLVED), "forest")


def _doubled(links: DataFrame, count: int) -> DataFrame:
    """Distributed pointer doubling, for links too many for a block and too spread to shrink: exact, log2(count) rounds.

    Takes staged weighted links, gives rows as solve_block does, none of them open. Only unfinished rows are joined.
    """
    roots = links.filter(F.col("up").isNull()).select("id", F.col("id").alias("top"), F.lit(0).cast("long").alias("off"), "low", F.lit("root").alias("state"))
    live = links.filter(F.col("up").isNotNull()).select("id", F.col("up").alias("top"), "off", "low")
    done = roots
    for _ in range(int(np.ceil(np.log2(count + 1))) + 1):
        live = staged(live, "double")
        step = live.select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("off").alias("_off"), F.col("low").alias("_low"))
        weights = live.groupBy("top").agg(F.count("*").alias("_w"))
        ends = done.select(F.col("id").alias("top"), F.col("top").alias("_root"), F.col("off").alias("_depth"))
        hop = staged(weights.join(step, "top", "left").join(ends, "top", "left"), "hop")
        joined = staged(salted_join(live, hop, "top", "_w", ["id"]), "joined")
        over = joined.filter(F.col("_root").isNotNull())
        done = done.unionByName(over.select("id", F.col("_root").alias("top"), (F.col("off") + F.col("_depth")).alias("off"), "low", F.lit("root").alias("state")))
        live = joined.filter(F.col("_root").isNull()).select("id", F.col("_top").alias("top"), (F.col("off") + F.col("_off")).alias("off"), F.least("low", "_low").alias("low"))
        if live.isEmpty():
            return done
    # Whatever still moves circles; from a node of the cycle the window covers the cycle alone.
    live = staged(live, "circling")
    hop = staged(live.groupBy("top").agg(F.count("*").alias("_w")).join(live.select(F.col("id").alias("top"), F.col("low").alias("_low")), "top"), "hop")
    ring = salted_join(live, hop, "top", "_w", ["id"])
    return done.unionByName(ring.select("id", "top", F.lit(-1).cast("long").alias("off"), F.col("_low").alias("low"), F.lit("cycle").alias("state")))


def _resolved(links: DataFrame, block_rows: int, level: int = 0) -> DataFrame:
    """Rows as solve_block gives them, none open, for a closed set of staged links."""
    count = links.count()
    if count <= block_rows:
        return _solved(links.withColumn("_block", F.lit(0)))
    local = _solved(_placed(links, count, block_rows, level))
    still = local.filter(F.col("state") == "open")
    tops = staged(still.groupBy("top").agg(F.count("*").alias("_w")), "tops")
    # The next level has only the nodes that links of other blocks point to: a closed, smaller set of weighted links.
    # A node that its own block led to a root or a cycle stands there as a root; what its block found is added below.
    needed = staged(local.join(tops.select(F.col("top").alias("id")), "id", "left_semi"), "needed")
    live = F.col("state") == "open"
    upper = staged(needed.select("id", F.when(live, F.col("top")).alias("up"), F.when(live, F.col("off")).otherwise(0).cast("long").alias("off"), "low"), "upper")
    size = upper.count()
    above = staged(_resolved(upper, block_rows, level + 1) if size <= count * SHRINKS else _doubled(upper, size), "above")
    known = needed.filter(~live).select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("off").alias("_off"), F.col("low").alias("_low"), F.col("state").alias("_state"))
    above = _hung(above, known, "left")
    ends = above.select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("off").alias("_off"), F.col("low").alias("_low"), F.col("state").alias("_state"))
    return staged(local.filter(~live).unionByName(_hung(still, ends, "inner")), "level")


def _hung(rows: DataFrame, ends: DataFrame, how: str) -> DataFrame:
    """rows led on from their top to where the top itself ends; without an end there, as they are."""
    weights = rows.groupBy("top").agg(F.count("*").alias("_w"))
    joined = salted_join(rows, staged(weights.join(ends, "top", how), "ends"), "top", "_w", ["id"], how)
    ring = F.coalesce(F.col("_state") == "cycle", F.lit(False)) | (F.col("_state").isNull() & (F.col("state") == "cycle"))
    return joined.select(
        "id",
        F.coalesce("_top", "top").alias("top"),
        F.when(ring, -1).otherwise(F.col("off") + F.coalesce("_off", F.lit(0))).cast("long").alias("off"),
        F.when(F.col("_state") == "cycle", F.col("_low")).otherwise(F.col("low")).alias("low"),
        F.coalesce("_state", "state").alias("state"),
    )


def forest(links: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, root_id, depth for links of parent_links(). On or below a cycle: depth -1, root_id the smallest id on it."""
    weighted = staged(links.select("id", "up", F.lit(1).cast("long").alias("off"), F.col("id").alias("low"), "near"), "weighted")
    looped = F.col("state") == "cycle"
    return _resolved(weighted, block_rows).select("id", F.when(looped, F.col("low")).otherwise(F.col("top")).alias("root_id"), F.when(looped, -1).otherwise(F.col("off")).cast("long").alias("depth"))


def paths(links: DataFrame, ends: DataFrame) -> DataFrame:
    """id, path, n_descendants: the ids from the root down to the node, by parent traversal in doubling steps, and how many nodes
    hang below it.

    Each round appends to a node's path the path of the node where it stopped, and adds to a node's count those of the
    nodes that stopped at it; so depth d takes log2(d) rounds. The join is by that node's id and splits hot ones. Nodes on
    or below a cycle have no path. The paths are as large as the sum of depths, whatever the method; the counts are not.
    """
    fine = links.join(ends.filter(F.col("depth") >= 0).select("id", "depth"), "id")
    deepest = ends.agg(F.max("depth")).first()[0] or 0
    rows = staged(fine.select("id", F.col("up").alias("next"), F.array("id").alias("up_path"), F.lit(1).cast("long").alias("n")), "paths")
    for _ in range(int(np.ceil(np.log2(deepest + 1))) if deepest > 0 else 0):
        live = rows.filter(F.col("next").isNotNull())
        weights = staged(live.groupBy("next").agg(F.count("*").alias("_w"), F.sum("n").alias("_more")), "weights")
        hop = rows.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("up_path").alias("_path"))
        counted = rows.join(weights.select(F.col("next").alias("id"), "_more"), "id", "left").withColumn("n", F.col("n") + F.coalesce("_more", F.lit(0))).drop("_more")
        joined = salted_join(counted.filter(F.col("next").isNotNull()), staged(weights.drop("_more").join(hop, "next"), "hop"), "next", "_w", ["id"])
        rows = staged(joined.select("id", F.col("_next").alias("next"), F.concat("up_path", "_path").alias("up_path"), "n").unionByName(counted.filter(F.col("next").isNull())), "paths")
    return rows.select("id", F.reverse("up_path").alias("path"), (F.col("n") - 1).alias("n_descendants"))


def descendants(walked: DataFrame) -> DataFrame:
    """ancestor_id, descendant_id, distance for every node and each of its ancestors."""
    steps = walked.select(F.col("id").alias("descendant_id"), F.size("path").alias("_n"), F.posexplode("path").alias("_at", "ancestor_id"))
    return steps.filter(F.col("_at") < F.col("_n") - 1).select("ancestor_id", "descendant_id", (F.col("_n") - 1 - F.col("_at")).cast("long").alias("distance"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(parent_links(table(spark, sf_dir, "holons")))


def in_small_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """found() in blocks of 200 links, so that levels of blocks are merged on small tables as well."""
    return forest(parent_links(table(spark, sf_dir, "holons")), 200)


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each holon with its root, depth, path of ids from the root, number of descendants and whether it hangs on a cycle."""
    links = parent_links(table(spark, sf_dir, "holons"))
    ends = staged(forest(links), "ends")
    walked = paths(links, ends)
    return ends.join(walked, "id", "left").select(
        "id", "root_id", "depth", F.array_join("path", " / ").alias("path"), F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants"), (F.col("depth") < 0).alias("on_or_below_cycle"))


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = parent_links(table(spark, sf_dir, "holons"))
    return descendants(paths(links, staged(forest(links), "ends")))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ancestor_id, depth, place: each holon's line of ancestors, root first; depth counts up from the holon itself, which is
    0. A parent that is no holon ends the line; a holon on or below a cycle has none."""
    links = parent_links(table(spark, sf_dir, "holons"))
    steps = paths(links, staged(forest(links), "ends")).select("id", F.size("path").alias("_n"), F.posexplode("path").alias("_at", "ancestor_id"))
    return steps.select("id", "ancestor_id", (F.col("_n") - 1 - F.col("_at")).cast("long").alias("depth"), (F.col("_at") + 1).cast("long").alias("place"))


_KEY = "nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), '')"
_LINKS_SQL = f"""
RECURSIVE one AS (
  SELECT {_KEY.format('id')} AS id, {_KEY.format('parent_id')} AS up FROM holons WHERE {_KEY.format('id')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_KEY.format('id')} ORDER BY updated_at DESC NULLS LAST, {_KEY.format('parent_id')} DESC NULLS LAST) = 1
), links AS (SELECT o.id, p.id AS up FROM one o LEFT JOIN one p ON p.id = o.up),
down AS (
  SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, id AS path FROM links WHERE up IS NULL
  UNION ALL SELECT l.id, d.root_id, d.depth + 1, d.path || ' / ' || l.id FROM down d JOIN links l ON l.up = d.id
)"""
_RING_SQL = """, lost AS (SELECT l.* FROM links l ANTI JOIN down USING (id)),
walk AS (
  SELECT id AS start_id, id, up FROM lost
  UNION SELECT w.start_id, l.id, l.up FROM walk w JOIN lost l ON l.id = w.up
), ring AS (SELECT DISTINCT a.start_id FROM walk a WHERE a.up = a.start_id),
ended AS (
  SELECT id, root_id, depth, path FROM down
  UNION ALL SELECT w.start_id, min(w.id), CAST(-1 AS BIGINT), NULL FROM walk w JOIN ring r ON r.start_id = w.id GROUP BY 1
)"""

QUERIES = {"p3_found": found, "p3_hierarchy": hierarchy, "p3_descendants": closure, "holon_lineage": lineage, "forest_in_small_blocks": in_small_blocks}
SQL = {
    "p3_found": f"WITH {_LINKS_SQL}{_RING_SQL} SELECT id, root_id, depth FROM ended",
    "forest_in_small_blocks": f"WITH {_LINKS_SQL}{_RING_SQL} SELECT id, root_id, depth FROM ended",
    "p3_hierarchy": f"""WITH {_LINKS_SQL}{_RING_SQL},
        pairs AS (SELECT unnest(string_split(path, ' / ')[:-2]) AS id FROM down),
        below AS (SELECT id, count(*) AS n FROM pairs GROUP BY 1)
        SELECT e.id, root_id, depth, path, coalesce(n, 0) AS n_descendants, depth < 0 AS on_or_below_cycle FROM ended e LEFT JOIN below b ON b.id = e.id""",
    "holon_lineage": f"""WITH {_LINKS_SQL}
        SELECT id, unnest(string_split(path, ' / ')) AS ancestor_id, unnest(range(depth, -1, -1)) AS depth, unnest(range(1, depth + 2)) AS place FROM down""",
    "p3_descendants": f"""WITH {_LINKS_SQL}
        SELECT unnest(string_split(path, ' / ')[:-2]) AS ancestor_id, id AS descendant_id, unnest(range(depth, 0, -1)) AS distance FROM down""",
}
