"""Reliability of holons: verdict scores, decay, congruence penalties and the weakest link over the dependency graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.scalars import penalty, verdict_score
from corvane.operators.graph import closing, reachable
from corvane.operators.model import AS_OF, Base, as_of, sql
from corvane.operators.sequence import running_total
from corvane.operators.skew import hot_keys, salted, salted_join, spread_out
from corvane.operators.store import q, updated
from corvane.session import staged

EXPIRED = 0.1
#: Rounds of relaxation, or steps along a path, in one job.
ROUNDS = 8


def evidence_scores(evidence: DataFrame, at: Column) -> DataFrame:
    """id, holon_id, score, expired. An expired row scores 0.1 whatever its verdict; an instant equal to `at` is not expired."""
    old = F.coalesce(F.col("valid_until").cast("timestamp_ntz") < at, F.lit(False))
    return evidence.select("id", "holon_id", F.when(old, EXPIRED).otherwise(verdict_score(F.col("verdict"))).alias("score"), old.alias("expired"))


def self_scores(evidence: DataFrame, at: Column) -> DataFrame:
    """holon_id, self_score (the mean), n_evidence, n_expired, decay_penalty (0.9 per expired row). Evidence of no holon is left out."""
    rows = evidence_scores(evidence, at).filter(F.col("holon_id").isNotNull())
    return rows.groupBy("holon_id").agg(
        F.avg("score").alias("self_score"), F.count("*").alias("n_evidence"), F.sum(F.col("expired").cast("long")).alias("n_expired"),
        (F.sum(F.col("expired").cast("long")) * 0.9).alias("decay_penalty"),
    )


def dependencies(relations: DataFrame) -> DataFrame:
    """id, dep, level: what a holon rests on. Of componentOf the source is the dependency, of dependsOn the target. Rows
    without a level are skipped; equal rows count once."""
    known = relations.filter(F.col("congruence_level").isNotNull())
    parts = known.filter("relation_type = 'componentOf'").select(F.col("target_id").alias("id"), F.col("source_id").alias("dep"), F.col("congruence_level").alias("level"))
    needs = known.filter("relation_type = 'dependsOn'").select(F.col("source_id").alias("id"), F.col("target_id").alias("dep"), F.col("congruence_level").alias("level"))
    return parts.union(needs).distinct()


def reliability(holons: DataFrame, evidence: DataFrame, relations: DataFrame, at: Column) -> DataFrame:
    """id, self_score, r for every holon and every id that something depends on, known or not.

    r is the least, over all paths along dependencies, of the self score at the end less the penalties on the way, not
    under 0; a path that would come back to itself ends there with 1. A node settles when all it rests on has: it then
    tells its value along its links, once, and leaves with them, several levels per job. What never settles reaches a
    cycle; there paths are enumerated, stopping where they leave the cyclic part, return, or have lost everything.
    Hot dependencies are salted.
    """
    links = staged(dependencies(relations).groupBy("id", "dep").agg(F.max(penalty(F.col("level"))).alias("pen")), "links")
    waits = links.groupBy("id").agg(F.count("*").alias("waits"))
    named = holons.select("id").unionByName(links.select("id")).unionByName(links.select(F.col("dep").alias("id"))).distinct()
    own = self_scores(evidence, at).select(F.col("holon_id").alias("id"), "self_score")
    first = named.join(own, "id", "left").join(waits, "id", "left").select("id", F.coalesce("self_score", F.lit(0.0)).alias("self_score"), F.lit(1.0).alias("best"), F.coalesce("waits", F.lit(0)).alias("waits"))
    live = staged(first.withColumn("new", F.col("waits") == 0), "live")
    hot = hot_keys(links, "dep")
    edges = staged(salted(links, hot, "dep", ["id"]), "edges")
    settled = [_worth(live.filter("waits = 0"))]
    while not live.filter("new").isEmpty():
        rows = live.selectExpr("*", "waits = 0 AS old")
        for _ in range(ROUNDS):
            rows = _told(rows, edges, hot)
        rows = staged(rows, "told")
        settled.append(_worth(rows.filter("waits = 0 AND NOT old")))
        # Settled nodes have told their values, but for those of the last round; their links are not read again.
        live = rows.filter("waits > 0 OR new").drop("old")
        edges = staged(edges.join(live.select(F.col("id").alias("dep")), "dep", "left_semi"), "edges")
    done = reduce(DataFrame.unionByName, settled)
    open_ = live.filter("waits > 0").select("id", F.least("self_score", "best").alias("own"), "self_score")
    if open_.isEmpty():
        return done
    return done.unionByName(_cyclic(open_, edges, hot))


def _worth(rows: DataFrame) -> DataFrame:
    return rows.select("id", "self_score", F.least("self_score", "best").alias("r"))


def _told(rows: DataFrame, edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    """One level: new nodes tell those that rest on them. rows: id, self_score, best, waits (unsettled dependencies), new, old
    (settled before this job). Each row is read once, so the plan grows by a join and an aggregate a level; only rows that
    have something to tell meet links."""
    # The key of a row that is silent matches nothing.
    met = spread_out(rows.selectExpr("*", "if(new, id, concat('~', id)) AS dep"), hot, "dep").join(edges.withColumnRenamed("id", "to"), ["dep", "_salt"], "left")
    # A row comes once per salt and once per link; all of its own columns are the same there.
    own = "named_struct('id', id, 'self_score', self_score, 'best', best, 'waits', waits, 'told', 0L, 'old', old, 'was', waits = 0)"
    told = "named_struct('id', to, 'self_score', double(NULL), 'best', greatest(0D, least(self_score, best) - pen), 'waits', bigint(NULL), 'told', 1L, 'old', boolean(NULL), 'was', boolean(NULL))"
    both = met.selectExpr(f"inline(if(to IS NULL, array({own}), array({own}, {told})))")
    grouped = both.groupBy("id").agg(F.expr("max(self_score) AS self_score"), F.expr("min(best) AS best"), F.expr("max(waits) - sum(told) AS waits"), F.expr("max(old) AS old"), F.expr("max(was) AS was"))
    return grouped.selectExpr("id", "self_score", "best", "waits", "waits = 0 AND NOT was AS new", "old")


def _cyclic(open_: DataFrame, edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Values of the nodes that reach a cycle, by their simple paths among one another. open_: id, self_score, and own, the least
    of the self score and of what the settled dependencies leave; edges: dep, _salt, id, pen among them."""
    open_ = staged(open_, "open")
    ends = spread_out(open_.select(F.col("id").alias("dep"), "own"), hot, "dep").join(edges, ["dep", "_salt"]).select(F.col("id").alias("_key"), "dep", "pen", F.col("own").alias("_own"))
    ends = staged(ends, "steps")
    hot_from = hot_keys(ends, "_key")
    ends = staged(salted(ends, hot_from, "_key", ["dep"]), "ends")

    def extended(rows: DataFrame) -> DataFrame:
        """Each open path by one step; a closed one as it is, joined by a key of its own that matches nothing."""
        # A hot node's row goes to every salt; where it meets no step it ends as it is, which changes no minimum.
        step = spread_out(rows.selectExpr("*", "if(on, node, concat('~', root)) AS _key"), hot_from, "_key").join(ends, ["_key", "_salt"], "left")
        step = step.selectExpr("*", "dep IS NOT NULL AS _hit", "coalesce(array_contains(path, dep), false) AS _back", "lost + coalesce(pen, 0D) AS _lost")
        step = step.selectExpr("*", "_hit AND NOT _back AND _lost < 1 - 1e-9 AS _on", "greatest(0D, if(_back, 1D, _own) - _lost) AS _worth")
        return step.selectExpr(
            "root", "coalesce(dep, node) AS node", "if(_on, concat(path, array(dep)), path) AS path", "_lost AS lost",
            "if(_hit, least(best, _worth), best) AS best", "_on AS on",
        )

    front = open_.select(F.col("id").alias("root"), F.col("id").alias("node"), F.array("id").alias("path"), F.lit(0.0).alias("lost"), F.col("own").alias("best"), F.lit(True).alias("on"))
    found = []
    while True:
        for _ in range(ROUNDS):
            front = extended(front)
        front = staged(front, "front")
        found.append(front.groupBy("root").agg(F.min("best").alias("v")))
        front = front.filter("on")
        if front.isEmpty():
            break
    least = reduce(DataFrame.unionByName, found).groupBy("root").agg(F.min("v").alias("r"))
    return open_.join(least.withColumnRenamed("root", "id"), "id").select("id", "self_score", "r")


def _rested(relations: DataFrame, scores: DataFrame) -> DataFrame:
    """dependencies() with the penalty and the r of the dependency, by a join that splits hot dependencies."""
    deps = staged(dependencies(relations), "deps")
    weights = deps.groupBy("dep").agg(F.count("*").alias("_w"))
    keyed = staged(weights.join(scores.select(F.col("id").alias("dep"), F.col("r").alias("_r")), "dep"), "keyed")
    return salted_join(deps, keyed, "dep", "_w", ["id"]).withColumn("pen", penalty(F.col("level")))


def factor_rows(holons: DataFrame, evidence: DataFrame, relations: DataFrame, at: Column) -> DataFrame:
    """id, factor, n: the factors of reports() in long form, for holons with so many that they should not be one value: expired
    evidence (n rows), no evidence, and each penalised dependency."""
    own = self_scores(evidence, at).select(F.col("holon_id").alias("id"), "n_expired")
    known = holons.select("id").join(own, "id", "left")
    aged = known.filter("n_expired > 0").select("id", F.lit("Evidence expired (Decay applied)").alias("factor"), F.col("n_expired").alias("n"))
    bare = known.filter("n_expired IS NULL").select("id", F.lit("No evidence found (L0)"), F.lit(1).cast("long"))
    deps = dependencies(relations).filter(penalty(F.col("level")) > 0).select("id", F.concat(F.lit("CL Penalty applied for "), "dep"), F.lit(1).cast("long")).distinct()
    return aged.union(bare).union(deps.join(holons.select("id"), "id", "left_semi"))


def cycle_factors(relations: DataFrame) -> DataFrame:
    """id, dep, factor: every link along which evaluating id comes back to id, that is where dep rests on id in its turn. The
    note belongs to the second visit, which counts as 1; it is no part of the report of a holon evaluated first."""
    links = dependencies(relations).select("id", "dep").distinct()
    back = closing(links.select(F.col("id").alias("source"), F.col("dep").alias("target")), links.select(F.col("id").alias("node"), F.col("dep").alias("to")))
    return back.filter("would_cycle").select(F.col("source").alias("id"), F.col("target").alias("dep"), F.lit("Cycle detected, skipping re-evaluation").alias("factor"))


def reports(holons: DataFrame, evidence: DataFrame, relations: DataFrame, at: Column, scores: DataFrame | None = None) -> DataFrame:
    """One row per known holon: r, self_score, weakest_link, decay_penalty, factors.

    weakest_link is the direct dependency with the least r less its penalty, ties to the smaller id, null if all are worth
    1; factors name expired evidence, missing evidence and penalised dependencies. factor_rows() has them one a row.
    """
    scores = staged(reliability(holons, evidence, relations, at) if scores is None else scores, "scores")
    deps = _rested(relations, scores)
    worth = F.greatest(F.lit(0.0), F.col("_r") - F.col("pen"))
    notes = F.array_sort(F.collect_set(F.when(F.col("pen") > 0, F.concat(F.lit("CL Penalty applied for "), F.col("dep")))))
    link = deps.withColumn("worth", F.round(worth, 9)).groupBy("id").agg(F.min(F.struct("worth", "dep")).alias("_w"), notes.alias("_notes"))
    own = self_scores(evidence, at).select(F.col("holon_id").alias("id"), "n_evidence", "n_expired", "decay_penalty")
    none = F.array().cast("array<string>")
    rows = holons.select("id", "title", "layer").join(scores, "id").join(own, "id", "left").join(link, "id", "left")
    factors = F.concat(
        F.array_repeat(F.lit("Evidence expired (Decay applied)"), F.coalesce("n_expired", F.lit(0)).cast("int")),
        F.when(F.coalesce("n_evidence", F.lit(0)) == 0, F.array(F.lit("No evidence found (L0)"))).otherwise(none),
        F.coalesce("_notes", none),
    )
    return rows.select(
        "id", "title", "layer", F.round("r", 6).alias("r"), F.round("self_score", 6).alias("self_score"),
        F.when(F.col("_w.worth") < 1.0, F.col("_w.dep")).alias("weakest_link"), F.round(F.coalesce("decay_penalty", F.lit(0.0)), 6).alias("decay_penalty"), factors.alias("factors"),
    )


def report_text(rows: DataFrame) -> DataFrame:
    """id and the Markdown report of each row of reports()."""
    bullets = F.when(F.size("factors") > 0, F.concat(F.lit("\n**Factors:**\n"), F.array_join(F.transform("factors", lambda f: F.concat(F.lit("- "), f, F.lit("\n"))), "")))
    text = F.concat(
        F.format_string("## Reliability Report: %s\n\n**R_eff: %.2f**\n- Self Score: %.2f\n", "id", "r", "self_score"),
        F.coalesce(F.concat(F.lit("- Weakest Link: "), F.col("weakest_link"), F.lit("\n")), F.lit("")),
        F.when(F.col("decay_penalty") > 0, F.format_string("- Decay Penalty: %.2f\n", "decay_penalty")).otherwise(""), F.coalesce(bullets, F.lit("")),
    )
    return rows.select("id", text.alias("report"))


def tree_scores(holons: DataFrame, evidence: DataFrame, relations: DataFrame, at: Column) -> DataFrame:
    """id, r, factors of reports() for every id that audit_tree() can show: known or not, with a level or without."""
    known = staged(reliability(holons, evidence, relations, at), "known")
    ends = relations.filter(F.col("relation_type").isin("componentOf", "memberOf")).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    own = self_scores(evidence, at).select(F.col("holon_id").alias("id"), "self_score")
    # What reliability() leaves out rests on nothing.
    others = ends.join(known, "id", "left_anti").join(own, "id", "left").select("id", F.coalesce("self_score", F.lit(0.0)).alias("self_score"))
    scores = staged(known.unionByName(others.withColumn("r", F.col("self_score"))), "scored")
    named = scores.select("id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("layer"))
    return scores.select("id", "r").join(reports(named, evidence, relations, at, scores).select("id", "factors"), "id")


def audit_tree(root: str, holons: DataFrame, relations: DataFrame, scores: DataFrame) -> DataFrame:
    """line: the tree below root in depth-first order, as audit_trees() has it. Factors are shown if scores have them, as tree_scores() do."""
    one = holons.sparkSession.createDataFrame([(root,)], "root_id string")
    parts = _parts(relations)
    return _lines(_walked(one, parts), holons, relations, scores).orderBy("path", "kind", "nth", "who").select("line")


def audit_trees(holons: DataFrame, relations: DataFrame, scores: DataFrame) -> DataFrame:
    """root_id, position (from 1), line: every tree in depth-first order. Each node with its r and title, then its factors, components
    and members; scores as of tree_scores().

    Roots are the holons, and the unknown ids with parts or members, that are no part of another; of a cycle, or several
    that share nodes, that hangs on none of these the smallest id is one. So every holon is in a tree; the tree of an id that
    is no root is part of its root's, audit_tree() shows it alone.
    Follows componentOf from the whole to its parts, level by level; a missing level of congruence shows as 3. A part
    that is its own ancestor is shown and not followed. Ordered by the array of ids on the way, as components come by id.
    """
    parts = _parts(relations)
    links = parts.filter("node <> part").select("node", F.col("part").alias("to"))
    wholes = relations.filter(F.col("relation_type").isin("componentOf", "memberOf")).select(F.col("target_id").alias("id"))
    free = holons.select("id").unionByName(wholes).distinct().join(links.select(F.col("to").alias("id")), "id", "left_anti")
    nodes = _walked(free.select(F.col("id").alias("root_id")), parts)
    rest = staged(links.join(nodes.select("node"), "node", "left_anti"), "rest")
    if not rest.isEmpty():
        nodes = nodes.unionByName(_walked(_heads(rest), parts))
    lines = _lines(nodes, holons, relations, scores).withColumn("root_id", F.col("path")[0]).withColumn("_one", F.lit(1))
    placed = running_total(lines, "root_id", ["path", "kind", "nth", "who"], "_one")  # a tree of any size is spread over the tasks
    return placed.select("root_id", (F.col("_before") + 1).cast("int").alias("position"), "line")


def _parts(relations: DataFrame) -> DataFrame:
    return staged(relations.filter("relation_type = 'componentOf'").select(F.col("target_id").alias("node"), F.col("source_id").alias("part"), F.coalesce("congruence_level", F.lit(3)).alias("level")), "parts")


def _heads(links: DataFrame) -> DataFrame:
    """root_id: the smallest id of each cyclic part of links (node, to) that nothing outside it leads to."""
    seeds = links.select(F.col("node").alias("seed")).distinct()
    pairs = staged(reachable(seeds, links).filter("seed <> node"), "pairs")
    back = pairs.select(F.col("seed").alias("node"), F.col("node").alias("seed"), F.lit(True).alias("_back"))
    below = pairs.join(back, ["seed", "node"], "left").filter(F.col("_back").isNull() | (F.col("seed") < F.col("node")))
    return seeds.join(below.select(F.col("node").alias("seed")), "seed", "left_anti").select(F.col("seed").alias("root_id"))


def _walked(roots: DataFrame, parts: DataFrame) -> DataFrame:
    """node, path, at, level for every way down from the roots (root_id), however deep."""
    front = staged(roots.select(F.col("root_id").alias("node"), F.array("root_id").alias("path"), F.lit(0).alias("at"), F.lit(3).alias("level")), "tree")
    seen = [front]
    while not front.isEmpty():
        front = staged(front.filter(F.size(F.array_distinct("path")) == F.size("path")).select("node", "path", "at").join(parts, "node").select(F.col("part").alias("node"), F.concat("path", F.array("part")).alias("path"), (F.col("at") + 1).alias("at"), "level"), "tree")
        seen.append(front)
    return reduce(DataFrame.unionByName, seen)


def _lines(nodes: DataFrame, holons: DataFrame, relations: DataFrame, scores: DataFrame) -> DataFrame:
    """path, kind, nth, who, by which the lines are ordered, and line."""
    factors = F.col("factors") if "factors" in scores.columns else F.array().cast("array<string>")
    about = staged(scores.select("id", "r", factors.alias("factors")).join(holons.select("id", F.nullif(F.col("title"), F.lit("")).alias("title")), "id", "left"), "about")
    shown = nodes.join(about.withColumnRenamed("id", "node"), "node", "left")
    head = F.format_string("[%s R:%.2f] %s", F.col("node"), F.round(F.coalesce("r", F.lit(0.0)), 6), F.coalesce("title", "node"))
    indent = F.expr("repeat('  ', at)")
    arrow = F.when(F.col("at") > 0, F.concat(F.expr("repeat('  ', at - 1)"), F.lit("  --(CL:"), F.col("level").cast("string"), F.lit(")-->\n"))).otherwise("")
    lines = shown.select("path", F.lit(0).alias("kind"), F.lit(0).alias("nth"), F.lit("").alias("who"), F.concat(arrow, indent, head).alias("line"))
    noted = shown.select("path", "at", F.posexplode("factors").alias("nth", "factor")).select("path", F.lit(1).alias("kind"), "nth", F.lit("").alias("who"), F.concat(indent, F.lit("  ! "), F.col("factor")).alias("line"))
    members = relations.filter("relation_type = 'memberOf'").select(F.col("target_id").alias("node"), F.col("source_id").alias("member"))
    inside = nodes.join(members, "node").join(about.withColumnRenamed("id", "member"), "member", "left")
    note = F.format_string("    - [%s R:%.2f] %s", F.col("member"), F.round(F.coalesce("r", F.lit(0.0)), 6), F.coalesce("title", "member"))
    # Members come after all components of the node: the path is closed by a sign that sorts behind every id.
    listed = inside.select(F.concat("path", F.array(F.lit("~"))).alias("path"), F.lit(3).alias("kind"), F.lit(0).alias("nth"), F.col("member").alias("who"), F.concat(indent, note).alias("line"))
    headed = inside.select(F.concat("path", F.array(F.lit("~"))).alias("path"), F.lit(2).alias("kind"), F.lit(0).alias("nth"), F.lit("").alias("who"), F.concat(indent, F.lit("  [members]")).alias("line")).distinct()
    return lines.unionByName(noted).unionByName(headed).unionByName(listed)


def _scores(b: Base) -> DataFrame:
    return reliability(b.holons, b.evidence, b.relations, as_of())


def _reports(b: Base) -> DataFrame:
    return reports(b.holons, b.evidence, b.relations, as_of())


QUERIES = {
    "self_score": q(lambda b: self_scores(b.evidence, as_of()).select("holon_id", F.round("self_score", 6).alias("self_score"), "n_evidence")),
    "decay_penalty": q(lambda b: self_scores(b.evidence, as_of()).select("holon_id", "n_expired", F.round("decay_penalty", 6).alias("decay_penalty"))),
    "direct_dependencies": q(lambda b: dependencies(b.relations).withColumn("penalty", penalty(F.col("level")))),
    "reliability": q(lambda b: _scores(b).select("id", F.round("self_score", 6).alias("self_score"), F.round("r", 6).alias("r"))),
    "reliability_report": q(lambda b: report_text(_reports(b))),
    "weakest_links": q(lambda b: _reports(b).select("id", "r", "weakest_link")),
    "reliability_l2_comparison": q(lambda b: _reports(b).filter("layer = 'L2'").select("id", "title", "r", "weakest_link")),
    "rscore_writeback": q(lambda b: updated(b.holons.select("id", "cached_r_score", "updated_at"), _scores(b).select("id", F.round("r", 6).alias("cached_r_score")), "cached_r_score")),
    "factors": q(lambda b: factor_rows(b.holons, b.evidence, b.relations, as_of())),
    "cycle_factors": q(lambda b: cycle_factors(b.relations)),
    "audit_tree": q(lambda b: audit_trees(b.holons, b.relations, tree_scores(b.holons, b.evidence, b.relations, as_of()))),
}

_R = f"""
sc AS (SELECT id, holon_id, CASE WHEN valid_until < TIMESTAMP '{AS_OF}' THEN 1 ELSE 0 END AS old,
    CAST(CASE WHEN valid_until < TIMESTAMP '{AS_OF}' THEN 0.1 WHEN lower(verdict) = 'pass' THEN 1.0 WHEN lower(verdict) = 'degrade' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS s FROM e WHERE holon_id IS NOT NULL),
own AS (SELECT holon_id, avg(s) AS self_score, count(*) AS n_evidence, sum(old) AS n_expired FROM sc GROUP BY 1),
dep AS (SELECT target_id AS id, source_id AS dep, congruence_level AS level FROM r WHERE relation_type = 'componentOf' AND congruence_level IS NOT NULL
  UNION SELECT source_id, target_id, congruence_level FROM r WHERE relation_type = 'dependsOn' AND congruence_level IS NOT NULL),
pen AS (SELECT id, dep, level, CAST(CASE level WHEN 3 THEN 0.0 WHEN 2 THEN 0.1 WHEN 1 THEN 0.4 ELSE 0.9 END AS DOUBLE) AS pen FROM dep),
node AS (SELECT id FROM h UNION SELECT id FROM pen UNION SELECT dep FROM pen),
scored AS (SELECT node.id, coalesce(self_score, 0.0) AS self_score FROM node LEFT JOIN own ON own.holon_id = node.id),
walk AS (SELECT id AS root, id AS at_, [id] AS path, CAST(0.0 AS DOUBLE) AS lost, false AS back FROM node
  UNION ALL SELECT root, dep, list_append(path, dep), lost + pen, list_contains(path, dep) FROM walk JOIN pen ON pen.id = walk.at_ WHERE NOT back AND lost < 1 - 1e-9),
score AS (SELECT root AS id, any_value(o.self_score) AS self_score, min(greatest(0.0, CASE WHEN back THEN 1.0 ELSE n.self_score END - lost)) AS r
  FROM walk JOIN scored n ON n.id = at_ JOIN scored o ON o.id = root GROUP BY root),
link AS (SELECT pen.id, arg_min(dep, (round(greatest(0.0, score.r - pen), 9), dep)) AS weakest, min(greatest(0.0, score.r - pen)) AS worth FROM pen JOIN score ON score.id = dep GROUP BY 1),
report AS (SELECT h.id, title, layer, round(score.r, 6) AS r, CASE WHEN round(worth, 9) < 1 THEN weakest END AS weakest_link FROM h JOIN score ON score.id = h.id LEFT JOIN link ON link.id = h.id)
"""

_NOTED = """
notes AS (SELECT id, list_sort(list(DISTINCT 'CL Penalty applied for ' || dep)) AS notes FROM pen WHERE pen > 0 GROUP BY 1)"""

#: The trees: roots, what they reach, heads of cyclic parts, ways down, scores and factors of all that is shown, lines.
_TREE = """,
tp AS (SELECT target_id AS node, source_id AS part, coalesce(congruence_level, 3) AS level FROM r WHERE relation_type = 'componentOf'),
tl AS (SELECT DISTINCT node, part FROM tp WHERE node <> part),
tm AS (SELECT target_id AS node, source_id AS member FROM r WHERE relation_type = 'memberOf'),
tfree AS (SELECT id FROM (SELECT id FROM h UNION SELECT node FROM tp UNION SELECT node FROM tm) WHERE id NOT IN (SELECT part FROM tl)),
tcov AS (SELECT id AS node FROM tfree UNION SELECT part FROM tcov JOIN tl ON tl.node = tcov.node),
trest AS (SELECT * FROM tl WHERE node NOT IN (SELECT node FROM tcov)),
treach AS (SELECT node AS seed, part AS node FROM trest UNION SELECT seed, part FROM treach JOIN trest ON trest.node = treach.node),
tlater AS (SELECT a.node FROM treach a LEFT JOIN treach b ON b.seed = a.node AND b.node = a.seed WHERE a.seed <> a.node AND (b.seed IS NULL OR a.seed < a.node)),
troot AS (SELECT id FROM tfree UNION SELECT node FROM trest WHERE node NOT IN (SELECT node FROM tlater)),
twalk AS (SELECT id AS node, [id] AS path, 0 AS deep, 3 AS level, false AS back FROM troot
  UNION ALL SELECT part, list_append(path, part), deep + 1, tp.level, list_contains(path, part) FROM twalk JOIN tp ON tp.node = twalk.node WHERE NOT back),
tends AS (SELECT DISTINCT unnest([source_id, target_id]) AS id FROM r WHERE relation_type IN ('componentOf', 'memberOf')),
tsc AS (SELECT id, r FROM score UNION ALL SELECT id, coalesce(self_score, 0.0) FROM tends LEFT JOIN own ON holon_id = id WHERE id NOT IN (SELECT id FROM score)),
about AS (SELECT tsc.id, printf('[%s R:%.2f] %s', tsc.id, round(round(r, 6), 2), coalesce(nullif(title, ''), tsc.id)) AS head,
    list_concat(list_concat(['Evidence expired (Decay applied)' for i in range(coalesce(n_expired, 0)::BIGINT)], CASE WHEN n_evidence IS NULL THEN ['No evidence found (L0)'] ELSE [] END), coalesce(notes, [])) AS f
  FROM tsc LEFT JOIN h ON h.id = tsc.id LEFT JOIN own ON own.holon_id = tsc.id LEFT JOIN notes ON notes.id = tsc.id),
shown AS (SELECT twalk.*, head, f FROM twalk JOIN about ON about.id = twalk.node),
tline AS (SELECT path, 0 AS kind, 0 AS nth, '' AS who, CASE WHEN deep > 0 THEN repeat('  ', deep - 1) || '  --(CL:' || level || ')-->' || chr(10) ELSE '' END || repeat('  ', deep) || head AS line FROM shown
  UNION ALL SELECT path, 1, unnest(range(len(f)))::INT, '', repeat('  ', deep) || '  ! ' || unnest(f) FROM shown
  UNION ALL SELECT DISTINCT list_append(path, '~'), 2, 0, '', repeat('  ', deep) || '  [members]' FROM shown JOIN tm ON tm.node = shown.node
  UNION ALL SELECT list_append(path, '~'), 3, 0, member, repeat('  ', deep) || '    - ' || about.head FROM shown JOIN tm ON tm.node = shown.node JOIN about ON about.id = member)"""

SQL = {
    "factors": sql("""SELECT h.id, 'Evidence expired (Decay applied)' AS factor, n_expired::BIGINT AS n FROM h JOIN own ON own.holon_id = h.id WHERE n_expired > 0
        UNION ALL SELECT id, 'No evidence found (L0)', 1 FROM h WHERE id NOT IN (SELECT holon_id FROM own)
        UNION ALL SELECT DISTINCT pen.id, 'CL Penalty applied for ' || dep, 1 FROM pen JOIN h ON h.id = pen.id WHERE pen > 0""", _R, True),
    "cycle_factors": sql("SELECT DISTINCT pen.id, pen.dep, 'Cycle detected, skipping re-evaluation' AS factor FROM pen JOIN rests ON rests.id = pen.dep AND rests.dep = pen.id", _R.rstrip() + """,
        rests AS (SELECT dep AS id, dep FROM pen UNION SELECT rests.id, pen.dep FROM rests JOIN pen ON pen.id = rests.dep)""", True),
    "audit_tree": sql("SELECT path[1] AS root_id, row_number() OVER (PARTITION BY path[1] ORDER BY path, kind, nth, who)::INT AS position, line FROM tline", _R.rstrip() + "," + _NOTED + _TREE, True),
    "self_score": sql("SELECT holon_id, round(self_score, 6) AS self_score, n_evidence FROM own", _R, True),
    "decay_penalty": sql("SELECT holon_id, CAST(n_expired AS BIGINT) AS n_expired, round(n_expired * CAST(0.9 AS DOUBLE), 6) AS decay_penalty FROM own", _R, True),
    "direct_dependencies": sql("SELECT id, dep, level, pen AS penalty FROM pen", _R, True),
    "reliability": sql("SELECT id, round(self_score, 6) AS self_score, round(r, 6) AS r FROM score", _R, True),
    "weakest_links": sql("SELECT id, r, weakest_link FROM report", _R, True),
    "reliability_l2_comparison": sql("SELECT id, title, r, weakest_link FROM report WHERE layer = 'L2'", _R, True),
    "reliability_report": sql("""SELECT report.id, printf('## Reliability Report: %s' || chr(10) || chr(10) || '**R_eff: %.2f**' || chr(10) || '- Self Score: %.2f' || chr(10), report.id, round(report.r, 2), round(round(score.self_score, 6), 2))
        || coalesce('- Weakest Link: ' || weakest_link || chr(10), '') || CASE WHEN n_expired > 0 THEN printf('- Decay Penalty: %.2f' || chr(10), round(n_expired * CAST(0.9 AS DOUBLE), 6)) ELSE '' END
        || CASE WHEN len(f) > 0 THEN chr(10) || '**Factors:**' || chr(10) || array_to_string(['- ' || x || chr(10) for x in f], '') ELSE '' END AS report
        FROM report JOIN score ON score.id = report.id LEFT JOIN own ON own.holon_id = report.id LEFT JOIN factor_ ON factor_.id = report.id""", _R.rstrip() + "," + _NOTED + """,
        factor_ AS (SELECT h.id, list_concat(list_concat(['Evidence expired (Decay applied)' for i in range(coalesce(n_expired, 0)::BIGINT)], CASE WHEN n_evidence IS NULL THEN ['No evidence found (L0)'] ELSE [] END), coalesce(notes, [])) AS f
          FROM h LEFT JOIN own ON own.holon_id = h.id LEFT JOIN notes ON notes.id = h.id)""", True),
    "rscore_writeback": sql("SELECT h.id, round(score.r, 6) AS cached_r_score, updated_at FROM h JOIN score ON score.id = h.id", _R, True),
}
