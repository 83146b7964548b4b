"""Reachability over dependency edges, and links that would close a cycle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import scalars as S
from corvane.functions.scalars import clamp_level, relation_of_kind
from corvane.operators.model import AS_OF, Base, as_of, sql
from corvane.operators.skew import hot_keys, salted, spread_out
from corvane.operators.store import WHOLES, q
from corvane.session import partitions, staged


#: Steps along links in one job.
HOPS = 8
#: A graph of up to so many links is sent to the tasks as numbers, and its names with it.
LINKS = 1 << 21
#: Bytes of the map in which a task marks what its seeds have met, and pairs that it finds in one go.
SEEN, FOUND = 1 << 27, 1 << 21


def edges(relations: DataFrame) -> DataFrame:
    """node, to: from parts to wholes."""
    return relations.filter(F.col("relation_type").isin(*WHOLES)).select(F.col("source_id").alias("node"), F.col("target_id").alias("to")).distinct()


def _followed(rows: DataFrame, steps: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows (seed, node, top, on) and what lies one step behind those that are on, but not above level `top` if there is one.

    Rows are read once, so the plan grows by a join and an aggregate a step; only what this step found first is on.
    """
    met = _met(rows, "on", steps, hot)
    may = "to IS NOT NULL AND (top IS NULL OR coalesce(level <= top, false))"
    here, there = "named_struct('node', node, 'on', false)", "named_struct('node', to, 'on', true)"
    out = met.selectExpr("seed", "top", f"inline(if({may}, array({here}, {there}), array({here})))")
    return out.groupBy("seed", "node").agg(F.expr("max(top) AS top"), F.expr("min(on) AS on"))


def _met(rows: DataFrame, if_: str, steps: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows with the steps from their node, for rows that satisfy if_: the key of any other matches nothing. A node stands there
    for many seeds, the links hold a hot node many times: the links' salt splits both."""
    keyed = rows.selectExpr("*", f"if({if_}, node, concat('~', node)) AS _key")
    return spread_out(keyed, hot, "_key").join(steps.withColumnRenamed("node", "_key"), ["_key", "_salt"], "left")


def reachable(seeds: DataFrame | None, links: DataFrame) -> DataFrame:
    """seed, node: everything each seed reaches over links, itself included. seeds: seed, or None for all nodes that a link
    leaves; links: node, to.

    Up to LINKS links each task holds the graph and searches from its share of the seeds: no pair is shuffled, and there is
    one job however deep the graph is. A larger graph is followed frontier by frontier.
    """
    links = staged(links.select("node", "to").filter("node IS NOT NULL AND to IS NOT NULL"), "links")
    seeds = (links.select(F.col("node").alias("seed")) if seeds is None else seeds.select("seed")).filter("seed IS NOT NULL").distinct()
    return _searched(seeds, links) if links.count() <= LINKS else _by_frontier(seeds, links)


def _searched(seeds: DataFrame, links: DataFrame) -> DataFrame:
    spark = links.sparkSession
    table = links.toArrow()
    ends = [table.column(c).combine_chunks() for c in ("node", "to")]
    names = pc.unique(pa.chunked_array(ends, pa.string()))
    node, to = (pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int32) for x in ends)
    first = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(names)))])
    graph = spark.sparkContext.broadcast((first, to[np.argsort(node, kind="stable")], names))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, to, names = graph.value
        n, seen = len(names), np.zeros(0, bool)
        for batch in batches:
            at = pc.index_in(batch.column(0), value_set=names)
            alone = batch.column(0).filter(pc.is_null(at))  # outside all links
            yield pa.RecordBatch.from_arrays([alone, alone], ["seed", "node"])
            at = at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            many = max(1, SEEN // max(1, n))
            if len(seen) < min(many, len(at)) * n:
                seen = np.zeros(min(many, len(at)) * n, bool)
            for i in range(0, len(at), many):
                for some, pairs in reach_of(at[i : i + many], first, to, seen):
                    for j in range(0, len(pairs), 1 << 17):
                        own, met = np.divmod(pairs[j : j + (1 << 17)], n)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(some[own])), names.take(pa.array(met))], ["seed", "node"])

    # Each task's share of the pairs is larger than its share of the seeds.
    return seeds.repartition(4 * partitions(spark)).mapInArrow(search, "seed string, node string")


def reach_of(seeds: np.ndarray, first: np.ndarray, to: np.ndarray, seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What seeds reach in a graph of numbers: the links of node x lead to to[first[x] : first[x + 1]].

    Seeds, and the pairs of them as (place of the seed among these) * (number of nodes) + node, in order. Where the pairs, or the
    links looked at in a step, are more than FOUND, half the seeds at a time. seen is false throughout before and after.
    """
    n = len(first) - 1
    pairs = np.arange(len(seeds)) * n + seeds
    seen[pairs] = True
    found, total = [pairs], len(pairs)
    while len(pairs):
        own, node = np.divmod(pairs, n)
        counts = first[node + 1] - first[node]
        after = np.cumsum(counts)
        if len(seeds) > 1 and total + after[-1] > FOUND:
            break
        step = np.arange(after[-1]) + np.repeat(first[node] - after + counts, counts)
        pairs = np.repeat(own * n, counts) + to[step]
        pairs = np.unique(pairs[~seen[pairs]])
        seen[pairs] = True
        found.append(pairs)
        total += len(pairs)
    every = np.concatenate(found)
    seen[every] = False
    if len(pairs):
        yield from reach_of(seeds[: len(seeds) // 2], first, to, seen)
        yield from reach_of(seeds[len(seeds) // 2 :], first, to, seen)
    else:
        yield seeds, np.sort(every)


def _by_frontier(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Frontier by frontier, HOPS steps a job: only pairs found in the last step are followed, and those known from jobs
    before are dropped by an anti join, so cycles end and the number of steps is the longest shortest path. Hot nodes are
    salted."""
    hot = hot_keys(links, "node")
    steps = staged(salted(links, hot, "node", ["to"]).withColumn("level", F.lit(None).cast("int")), "steps")
    known = staged(seeds.select("seed", F.col("seed").alias("node")), "front")
    front = known
    while not front.isEmpty():
        found = front.select("seed", "node", F.lit(None).cast("int").alias("top"), F.lit(True).alias("on"))
        for _ in range(HOPS):
            found = _followed(found, steps, hot)
        found = staged(found.drop("top").join(known, ["seed", "node"], "left_anti"), "front")
        known = known.unionByName(found.select("seed", "node"))
        front = found.filter("on").select("seed", "node")
    return known


def levels(links: DataFrame) -> DataFrame:
    """node, level: the longest way to a node from one that no link leads to; null on a cycle and behind one.

    Nodes leave in the order of their level, HOPS levels a job, and their links with them: each link is followed once.
    """
    hot = hot_keys(links, "node")
    steps = staged(salted(links, hot, "node", ["to"]), "steps")
    waits = links.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("waits"))
    named = links.select("node").unionByName(links.select(F.col("to").alias("node"))).distinct()
    live = staged(named.join(waits, "node", "left").select("node", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(0).alias("level")).withColumn("new", F.col("waits") == 0), "live")
    done = [live.filter("waits = 0")]
    at = 0
    while not live.filter("new").isEmpty():
        rows = live.withColumn("old", F.col("waits") == 0)
        for _ in range(HOPS):
            at += 1
            own = "named_struct('node', node, 'waits', waits, 'level', level, 'old', old, 'was', waits = 0, 'told', 0L)"
            told = "named_struct('node', to, 'waits', bigint(NULL), 'level', int(NULL), 'old', boolean(NULL), 'was', boolean(NULL), 'told', 1L)"
            both = _met(rows, "new", steps, hot).selectExpr(f"inline(if(to IS NULL, array({own}), array({own}, {told})))")
            rows = both.groupBy("node").agg(F.expr("max(waits) - sum(told) AS waits"), F.expr("max(level) AS level"), F.expr("max(old) AS old"), F.expr("max(was) AS was"))
            rows = rows.selectExpr("node", "waits", "waits = 0 AND NOT was AS new", f"if(waits = 0 AND NOT was, {at}, level) AS level", "old")
        rows = staged(rows, "peeled")
        done.append(rows.filter("waits = 0 AND NOT old"))
        live = rows.filter("waits > 0 OR new").drop("old")
        steps = staged(steps.join(live.select("node"), "node", "left_semi"), "steps")
    left = live.filter("waits > 0").select("node", F.lit(None).cast("int").alias("level"))
    return reduce(DataFrame.unionByName, [d.select("node", "level") for d in done]).unionByName(left)


def closing(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """candidates (source, target) with would_cycle: whether target already reaches source. Source = target is a cycle.

    Directed by the pairs: a node off the cycles is reached only from lower levels(), so most pairs are decided without a
    search, and the search for the others follows only what lies on a level up to that of the highest source wanted. A
    target whose sources are all found is not followed further.
    """
    pairs = candidates.select("source", "target").distinct()
    level = staged(levels(links), "levels")
    # Ids outside all links reach nothing and are reached by nothing.
    placed = pairs.join(level.select(F.col("node").alias("source"), "level", F.lit(True).alias("_s")), "source", "left").withColumnRenamed("level", "high")
    placed = placed.join(level.select(F.col("node").alias("target"), "level", F.lit(True).alias("_t")), "target", "left").withColumnRenamed("level", "low")
    # A source on no cycle and behind none is reached only from such nodes, and from lower ones.
    can = F.col("_s") & F.col("_t") & (F.col("source") != F.col("target")) & (F.col("high").isNull() | (F.coalesce(F.col("low") < F.col("high"), F.lit(False))))
    open_ = staged(placed.filter(can).select("source", "target", "high"), "open")
    hits = [candidates.sparkSession.createDataFrame([], "source string, target string")]
    hot = hot_keys(links, "node")
    ranked = links.join(level.select(F.col("node").alias("to"), "level"), "to")
    steps = staged(salted(ranked, hot, "node", ["to"]), "steps")
    known = None
    front = _wanted(open_).withColumn("node", F.col("seed"))
    while not open_.isEmpty():
        found = front.withColumn("on", F.lit(True))
        for _ in range(HOPS):
            found = _followed(found, steps, hot)
        found = found.select("seed", "node", "on") if known is None else found.select("seed", "node", "on").join(known, ["seed", "node"], "left_anti")
        found = staged(found, "front")
        known = found.select("seed", "node") if known is None else known.unionByName(found.select("seed", "node"))
        hit = staged(open_.join(found.select(F.col("seed").alias("target"), F.col("node").alias("source")), ["source", "target"], "left_semi").select("source", "target"), "hits")
        hits.append(hit)
        alive = found.filter("on").select("seed", "node")
        open_ = staged(open_.join(hit, ["source", "target"], "left_anti").join(alive.select(F.col("seed").alias("target")).distinct(), "target", "left_semi"), "open")
        front = alive.join(_wanted(open_), "seed")
    found = reduce(DataFrame.unionByName, hits).withColumn("_hit", F.lit(True))
    rows = candidates.join(found, ["source", "target"], "left")
    return rows.select(*candidates.columns, (F.coalesce("_hit", F.lit(False)) | F.coalesce(F.col("source") == F.col("target"), F.lit(False))).alias("would_cycle"))


def _wanted(open_: DataFrame) -> DataFrame:
    """seed, top: the targets to search from, and the highest level of the sources wanted; null: no bound."""
    return open_.groupBy(F.col("target").alias("seed")).agg(F.when(F.count_if(F.col("high").isNull()) == 0, F.max("high")).alias("top"))


def proposal_links(proposals: DataFrame, holons: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations that proposals add: proposals are id, kind, level, depends_on (array of ids).

    The dependency is the source. Unknown dependencies, a proposal itself, and links that would close a cycle with the
    relations there are get no relation; a level outside 1..3 becomes 3. Each (source, target, type) comes once, with the
    highest level asked for.
    """
    wanted = proposals.withColumn("source", F.explode("depends_on")).select("source", F.col("id").alias("target"), relation_of_kind(F.col("kind")).alias("relation_type"), clamp_level(F.col("level")).alias("congruence_level"))
    known = wanted.join(holons.select(F.col("id").alias("source")), "source", "left_semi").filter(F.col("source") != F.col("target"))
    pairs = staged(known, "wanted")
    open_ = closing(pairs.select("source", "target").distinct(), edges(relations)).filter(~F.col("would_cycle"))
    return pairs.join(open_.select("source", "target"), ["source", "target"]).groupBy(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "relation_type").agg(F.max("congruence_level").cast("int").alias("congruence_level"))


def proposal_rows(proposals: DataFrame, at: Column) -> DataFrame:
    """The holons that proposals (id, kind, title, content, context_id, scope, parent_id) become: hypotheses in layer L0."""
    return proposals.select(S.key(F.col("id")).alias("id"), F.lit("hypothesis").alias("type"), "kind", F.lit("L0").alias("layer"), "title", "content", "context_id", "scope", "parent_id", F.lit(0.0).alias("cached_r_score"), at.alias("created_at"), at.alias("updated_at")).filter("id IS NOT NULL")


def proposal_members(proposals: DataFrame, holons: DataFrame, at: Column) -> DataFrame:
    """memberOf relations of proposals (id, decision_context) to a decision context that exists and is another holon."""
    wanted = proposals.select(S.key(F.col("id")).alias("source_id"), S.key(F.col("decision_context")).alias("target_id")).filter("source_id <> target_id").distinct()
    known = wanted.join(holons.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return known.select("source_id", "target_id", F.lit("memberOf").alias("relation_type"), F.lit(3).alias("congruence_level"), at.alias("created_at"))


def decision_rows(decisions: DataFrame, at: Column) -> DataFrame:
    """The holons that decisions (title, content, context_id, winner) become: layer DRR, named by day and title, with the winner as
    parent."""
    name = F.regexp_replace(S.decision_file(at, F.col("title")), r"\.md$", "")
    return decisions.select(S.key(name).alias("id"), F.lit("decision").alias("type"), F.lit("DRR").alias("layer"), "title", "content", "context_id", F.nullif("winner", F.lit("")).alias("parent_id"), at.alias("created_at")).filter("id IS NOT NULL")


def decision_links(decisions: DataFrame) -> DataFrame:
    """selects and rejects relations of decisions (id, winner, rejected: array). Blank ids and the winner are not rejected."""
    chosen = decisions.filter(F.coalesce("winner", F.lit("")) != "").select(F.col("id").alias("source_id"), F.lit("selects").alias("relation_type"), F.col("winner").alias("target_id"))
    others = decisions.select("id", "winner", F.explode("rejected").alias("t")).filter((F.col("t") != "") & ~F.col("t").eqNullSafe(F.col("winner")))
    return chosen.unionByName(others.select(F.col("id").alias("source_id"), F.lit("rejects").alias("relation_type"), F.col("t").alias("target_id"))).distinct()


def _proposals(b: Base) -> DataFrame:
    """Each holon proposed again on top of its parent, itself and its context."""
    return b.holons.select("id", "kind", F.length("id").alias("level"), F.array("parent_id", "id", "context_id").alias("depends_on"))


def _decisions(b: Base) -> DataFrame:
    return b.holons.filter("layer = 'DRR'").select("id", F.col("parent_id").alias("winner"), F.array(F.lit(""), "parent_id", "context_id").alias("rejected"))


QUERIES = {
    "reachability": q(lambda b: reachable(None, edges(b.relations))),
    "would_create_cycle": q(lambda b: closing(b.relations.filter("relation_type = 'dependsOn'").select(F.col("source_id").alias("source"), F.col("target_id").alias("target")), edges(b.relations))),
    "self_loops": q(lambda b: b.relations.filter("source_id = target_id").select("source_id", "relation_type")),
    "proposal_links": q(lambda b: proposal_links(_proposals(b), b.holons, b.relations)),
    "proposal_rows": q(lambda b: proposal_rows(b.holons.withColumn("id", F.concat("title", F.lit(" "), "id")), as_of())),
    "proposal_members": q(lambda b: proposal_members(b.holons.select("id", F.col("parent_id").alias("decision_context")), b.holons, as_of())),
    "decision_rows": q(lambda b: decision_rows(b.holons.filter("layer = 'DRR'").withColumn("winner", F.col("parent_id")), as_of())),
    "decision_links": q(lambda b: decision_links(_decisions(b))),
}

_G = """
ed AS (SELECT DISTINCT source_id AS node, target_id AS to_ FROM r WHERE relation_type IN ('componentOf', 'constituentOf')),
reach AS (SELECT node AS seed, node FROM (SELECT node FROM ed UNION SELECT to_ FROM ed UNION SELECT target_id FROM r WHERE relation_type = 'dependsOn' UNION SELECT id FROM h)
  UNION SELECT seed, to_ FROM reach JOIN ed USING (node))
"""
SQL = {
    "reachability": sql("SELECT seed, node FROM reach WHERE seed IN (SELECT node FROM ed)", _G, True),
    "would_create_cycle": sql("SELECT source_id AS source, target_id AS target, EXISTS (SELECT 1 FROM reach WHERE seed = target_id AND node = source_id) AS would_cycle FROM r WHERE relation_type = 'dependsOn'", _G, True),
    "self_loops": sql("SELECT source_id, relation_type FROM r WHERE source_id = target_id"),
    "proposal_links": sql("""SELECT p.id AS source_id, x.id AS target_id, CASE WHEN x.kind = 'episteme' THEN 'constituentOf' ELSE 'componentOf' END AS relation_type, 3 AS congruence_level
        FROM h x JOIN h p ON p.id IN (x.parent_id, x.context_id) AND p.id <> x.id WHERE NOT EXISTS (SELECT 1 FROM reach WHERE seed = x.id AND node = p.id)""", _G, True),
    "proposal_rows": sql(f"""SELECT nullif(trim(regexp_replace(lower(title || ' ' || id), '[^a-z0-9]+', '-', 'g'), '-'), '') AS id, 'hypothesis' AS type, kind, 'L0' AS layer, title, content, context_id, scope, parent_id, CAST(0.0 AS DOUBLE) AS cached_r_score, TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at FROM h WHERE title IS NOT NULL"""),
    "proposal_members": sql(f"SELECT h.id AS source_id, p.id AS target_id, 'memberOf' AS relation_type, 3 AS congruence_level, TIMESTAMP '{AS_OF}' AS created_at FROM h JOIN h p ON p.id = h.parent_id WHERE h.id <> p.id"),
    "decision_rows": sql(f"""SELECT trim('drr-{AS_OF[:10]}-' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), '-') AS id, 'decision' AS type, 'DRR' AS layer, title, content, context_id, parent_id, TIMESTAMP '{AS_OF}' AS created_at FROM h WHERE layer = 'DRR' AND title IS NOT NULL"""),
    "decision_links": sql("""SELECT id AS source_id, 'selects' AS relation_type, parent_id AS target_id FROM h WHERE layer = 'DRR' AND parent_id IS NOT NULL
        UNION SELECT id, 'rejects', context_id FROM h WHERE layer = 'DRR' AND context_id <> '' AND context_id IS DISTINCT FROM parent_id"""),
}
