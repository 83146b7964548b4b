import random

import pandas as pd
import pytest
from conftest import day
from hypothesis import given, settings, strategies as st

from corvane.operators import graph, hierarchy, model, reliability, skew, store

HOLON = "id string, parent_id string, updated_at timestamp_ntz, title string, extra int, `top` string"


def ends(up: dict) -> dict:
    """id -> (root, depth), by walking."""
    out = {}
    for x in up:
        way, y = [], x
        while up.get(y) in up and y not in way:
            way.append(y)
            y = up[y]
        if y in way:
            out[x] = (min(way[way.index(y) :]), -1)
        else:
            out[x] = (y, len(way))
    return out


def random_parents(rng, n, loops):
    ids = [f"n{i}" for i in range(n)]
    up = {x: rng.choice([*ids[:i], "ghost", None]) if i else None for i, x in enumerate(ids)}
    if loops:
        for _ in range(n // 8):
            up[rng.choice(ids)] = rng.choice(ids)
    return up


@given(st.integers(0, 10**6), st.integers(1, 60), st.booleans())
@settings(max_examples=60, deadline=None)
def test_one_block(seed, n, loops):
    up = random_parents(random.Random(seed), n, loops)
    links = pd.DataFrame([(x, u if u in up else None, 1, x) for x, u in up.items()], columns=["id", "up", "off", "low"])
    got = hierarchy.solve_block(links)
    assert {r.id: (r.low if r.state == "cycle" else r.top, r.off) for r in got.itertuples()} == ends(up)


def rows(up):
    return [(x, u, day(1), "t", 1, "clash") for x, u in up.items()]


@pytest.mark.parametrize(("seed", "loops"), [(1, True), (2, False), (3, True)])
def test_many_blocks(spark, monkeypatch, seed, loops):
    """Blocks of one context, of pieces of a large one, and of coin tosses: merged to the end, without doubling."""
    monkeypatch.setattr(skew, "MIN_ROWS", 2)
    monkeypatch.setattr(hierarchy, "SHRINKS", 9.0)
    up = random_parents(random.Random(seed), 60, loops)
    near = {"1": None, "2": "hot", "3": "hot"}
    data = spark.createDataFrame([(*r, near.get(r[0][-1], r[0][-1])) for r in rows(up)], HOLON + ", context_id string")
    got = {r.id: (r.root_id, r.depth) for r in hierarchy.forest(hierarchy.parent_links(data), 9).collect()}
    assert got == ends(up)


def test_doubling(spark):
    up = random_parents(random.Random(5), 80, True) | {f"c{i}": f"c{i + 1}" for i in range(40)} | {"c40": None}
    links = spark.createDataFrame([(x, u if u in up else None, 1, x) for x, u in up.items()], "id string, up string, off long, low string")
    got = {r.id: (r.low if r.state == "cycle" else r.top, r.off) for r in hierarchy._doubled(links, len(up)).collect()}
    assert got == ends(up)


def test_deep_chain_and_paths(spark):
    up = {f"c{i:03}": f"c{i - 1:03}" if i else None for i in range(70)} | {"a": "b", "b": "a", "x": "a"}
    links = hierarchy.parent_links(spark.createDataFrame(rows(up), HOLON))
    found = hierarchy.forest(links, 20)
    walked = hierarchy.paths(links, found).collect()
    assert {r.id: r.n_descendants for r in walked} == {f"c{i:03}": 69 - i for i in range(70)}
    paths = {r.id: r.path for r in walked}
    assert paths["c069"] == [f"c{i:03}" for i in range(70)] and paths["c000"] == ["c000"]
    assert not {"a", "b", "x"} & set(paths)


def test_parents_dirty(spark):
    data = [("A b", None, day(1), "t", 1, ""), ("c", "A_B", day(1), "t", 1, ""), ("c", "A_B", day(1), "t", 1, ""), ("d", " ", day(1), None, None, None), ("e", "ghost", day(1), "t", 1, ""), (None, "c", day(1), "t", 1, ""), ("s", "S", day(1), "t", 1, "")]
    got = {r.id: (r.root_id, r.depth) for r in hierarchy.forest(hierarchy.parent_links(spark.createDataFrame(data, HOLON))).collect()}
    assert got == {"a-b": ("a-b", 0), "c": ("a-b", 1), "d": ("d", 0), "e": ("e", 0), "s": ("s", -1)}


def test_no_holons(spark):
    links = hierarchy.parent_links(spark.createDataFrame([], HOLON))
    assert hierarchy.forest(links).count() == 0
    assert hierarchy.paths(links, hierarchy.forest(links)).count() == 0


def test_salted_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "MIN_ROWS", 10)
    large = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i int")
    from corvane.session import staged

    keyed = staged(large.groupBy("k").count().withColumnRenamed("count", "w").filter("k <> 'k3'").selectExpr("k", "w", "length(k) AS v"))
    for how in ("inner", "left"):
        want = sorted(map(str, large.join(keyed.drop("w"), "k", how).select("k", "i", "v").collect()))
        assert sorted(map(str, skew.salted_join(large, keyed, "k", "w", ["i"], how).select("k", "i", "v").collect())) == want


EVIDENCE = "id string, holon_id string, verdict string, valid_until timestamp_ntz, created_at timestamp_ntz, type string, content string, assurance_level string, carrier_ref string"
RELATION = "source_id string, target_id string, relation_type string, congruence_level int, created_at timestamp_ntz"
NOW = day(15)


def scores(spark, proofs, edges):
    ids = sorted({h for h, *_ in proofs} | {"A"})
    holons = spark.createDataFrame([(h, "t", "L0") for h in ids], "id string, title string, layer string")
    ev = spark.createDataFrame([(f"e{i}", h, v, d, day(1), "", "", "", "") for i, (h, v, d) in enumerate(proofs)], EVIDENCE)
    rel = spark.createDataFrame([(s, t, k, c, day(1)) for s, t, k, c in edges], RELATION)
    return holons, ev, rel, model.as_of(str(NOW))


def r(spark, proofs, edges, who="A"):
    return round({x.id: x.r for x in reliability.reliability(*scores(spark, proofs, edges)).collect()}[who], 6)


GOOD, OLD = day(16), day(14)
PART = "componentOf"


@pytest.mark.parametrize(("proofs", "edges", "want"), [
    ([("A", "pass", GOOD)], [], 1.0), ([("A", "pass", OLD)], [], 0.1), ([("A", "pass", GOOD), ("B", "fail", GOOD)], [("B", "A", PART, 3)], 0.0),
    ([("A", "pass", GOOD), ("B", "pass", GOOD)], [("B", "A", PART, 1)], 0.6),
    ([("A", "pass", GOOD), ("B", "pass", GOOD), ("C", "pass", GOOD)], [("B", "A", PART, 3), ("C", "B", PART, 3), ("A", "C", PART, 3)], 1.0),
    ([("A", "pass", GOOD), ("B", "fail", GOOD)], [("B", "A", "memberOf", 3)], 1.0), ([], [], 0.0),
    ([("A", "pass", GOOD), ("A", "fail", GOOD)], [], 0.5), ([("A", "fail", OLD)], [], 0.1), ([("A", "refine", GOOD)], [], 0.0), ([("A", "pass", None)], [], 1.0),
    ([("A", "pass", NOW)], [], 1.0), ([("A", "pass", GOOD), ("B", "pass", GOOD)], [("B", "A", PART, 2)], 0.9), ([("A", "pass", GOOD), ("B", "pass", GOOD)], [("B", "A", PART, 0)], 0.1),
    ([("A", "pass", GOOD), ("B", "fail", GOOD)], [("B", "A", PART, None)], 1.0), ([("A", "pass", GOOD), ("B", "fail", GOOD)], [("A", "B", "dependsOn", 3)], 0.0),
    ([("A", "pass", GOOD), ("B", "fail", GOOD)], [("B", "A", "constituentOf", 3)], 1.0), ([("A", "pass", GOOD)], [("ghost", "A", PART, 3)], 0.0),
    ([("A", "pass", GOOD), ("B", "pass", GOOD)], [("B", "A", PART, 2), ("A", "B", PART, 2)], 0.8),
    ([("A", "pass", GOOD), ("B", "pass", GOOD), ("C", "pass", GOOD), ("D", "degrade", GOOD)], [("B", "A", PART, 3), ("C", "A", PART, 3), ("D", "B", PART, 3), ("D", "C", PART, 0)], 0.0),
])
def test_reliability(spark, proofs, edges, want):
    assert r(spark, proofs, edges) == want


def by_paths(own, deps, x, way=()):
    """Path-scoped recursion."""
    best = own.get(x, 0.0)
    for d, pen in deps.get(x, ()):
        below = 1.0 if d in (*way, x) else by_paths(own, deps, d, (*way, x))
        best = min(best, max(0.0, below - pen))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_reliability_of_random_graphs(spark, monkeypatch, seed):
    monkeypatch.setattr(skew, "MIN_ROWS", 2)
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(24)]
    proofs = [(x, rng.choice(["pass", "degrade", "pass"]), GOOD) for x in ids]
    edges = list({(*rng.sample(ids, 2), PART, rng.choice([0, 1, 2, 3, 3, 3])) for _ in range(28)})
    own = {x: {"pass": 1.0, "degrade": 0.5}[v] for x, v, _ in proofs}
    deps = {}
    for s, t, _, c in edges:
        deps.setdefault(t, []).append((s, {3: 0.0, 2: 0.1, 1: 0.4, 0: 0.9}[c]))
    got = {x.id: round(x.r, 6) for x in reliability.reliability(*scores(spark, proofs, edges)).collect()}
    for x in ids:
        assert got[x] == round(by_paths(own, deps, x), 6), x


def test_report_and_tree(spark):
    args = scores(spark, [("A", "pass", GOOD), ("B", "degrade", GOOD)], [("B", "A", PART, 2), ("M", "A", "memberOf", 3)])
    report = reliability.reports(*args).filter("id = 'A'")
    row = report.first()
    assert (row.r, row.weakest_link, row.factors) == (0.4, "b" if row.weakest_link == "b" else "B", ["CL Penalty applied for B"])
    assert "**R_eff: 0.40**" in reliability.report_text(report).first().report
    found = reliability.reliability(*args)
    lines = [x.line for x in reliability.audit_tree("A", args[0], args[2], found).collect()]
    assert lines == ["[A R:0.40] t", "  --(CL:2)-->\n  [B R:0.50] t", "  [members]", "    - [M R:0.00] M"]
    noted = [x.line for x in reliability.audit_tree("A", args[0], args[2], reliability.tree_scores(*args)).collect()]
    assert noted[:2] == ["[A R:0.40] t", "  ! CL Penalty applied for B"]
    assert {(x.id, x.factor, x.n) for x in reliability.factor_rows(*args).collect()} == {("A", "CL Penalty applied for B", 1)}


def test_cycle_factors(spark):
    part = [("b", "a"), ("a", "b"), ("c", "b"), ("s", "s"), ("d", "c")]
    rel = scores(spark, [], [(s, t, PART, 3) for s, t in part] + [("x", "y", PART, None)])[2]
    got = {(x.id, x.dep) for x in reliability.cycle_factors(rel).collect()}
    assert got == {("a", "b"), ("b", "a"), ("s", "s")}


def test_levels_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(skew, "MIN_ROWS", 1)
    monkeypatch.setattr(graph, "HOPS", 2)
    rng = random.Random(7)
    ids = [f"n{i}" for i in range(30)]
    links = {(a, b) for a, b in (rng.sample(range(30), 2) for _ in range(34)) for a, b in [(min(a, b), max(a, b))]} | {(5, 2), (9, 9)}
    df = spark.createDataFrame([(ids[a], ids[b]) for a, b in links], "node string, to string")
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b), todo.append(b)
        return seen

    level = {x.node: x.level for x in graph.levels(df).collect()}
    named = {x for link in links for x in link}
    assert set(level) == {ids[x] for x in named}
    for x in named:
        above = [y for y in named if x in reach(y)]
        cyclic = any(y in reach(y) for y in [*above, x])
        assert (level[ids[x]] is None) == cyclic
        assert cyclic or level[ids[x]] == max((level[ids[a]] + 1 for a, b in links if b == x), default=0)
    pairs = [(a, b) for a in range(31) for b in range(0, 31, 3)]
    name = lambda i: ids[i] if i < 30 else "elsewhere"
    got = {(x.source, x.target): x.would_cycle for x in graph.closing(spark.createDataFrame([(name(a), name(b)) for a, b in pairs] + [(None, "n1")], "source string, target string"), df).collect()}
    assert got.pop((None, "n1")) is False
    assert got == {(name(a), name(b)): a == b or (b < 30 and a in reach(b)) for a, b in pairs}


def test_a_long_chain_in_a_tree(spark):
    _, _, rel, _ = scores(spark, [], [(f"n{i + 1:03}", f"n{i:03}", PART, 3) for i in range(100)])
    rows = reliability.audit_trees(spark.createDataFrame([("n000", "t")], "id string, title string"), rel, spark.createDataFrame([("n100", 1.0)], "id string, r double")).collect()
    assert sorted(r.position for r in rows) == list(range(1, 102)) and max(rows, key=lambda r: r.position).line.endswith("[n100 R:1.00] n100")


def test_every_tree(spark):
    part = [("b", "a"), ("c", "b"), ("c", "ghost"), ("y", "x"), ("x", "y"), ("w", "y"), ("z", "w"), ("w", "z"), ("s", "s")]
    args = scores(spark, [(x, "pass", GOOD) for x in "abcsxyzw"], [*((s, t, PART, 3) for s, t in part), ("a", "club", "memberOf", 3)])
    trees = {}
    for x in sorted(reliability.audit_trees(args[0], args[2], reliability.reliability(*args)).collect(), key=lambda x: (x.root_id, x.position)):
        trees.setdefault(x.root_id, []).append((x.position, x.line.split("[")[1].split("]")[0].split(" ")[0]))
    want = {"A": "A", "a": "abc", "ghost": ["ghost", "c"], "club": ["club", "members", "a"], "s": "ss", "x": "xywzwx"}
    assert trees == {k: list(enumerate(v, 1)) for k, v in want.items()}


def test_tree_with_factors(spark):
    args = scores(spark, [("A", "pass", OLD), ("A", "pass", OLD), ("B", "pass", GOOD), ("u", "pass", GOOD)], [("B", "A", PART, 2), ("g", "A", PART, None), ("u", "A", "memberOf", 3)])
    holons = args[0].filter("id <> 'u'")
    found = reliability.tree_scores(holons, *args[1:])
    assert [x.line for x in reliability.audit_tree("A", holons, args[2], found).collect()] == [
        "[A R:0.10] t", "  ! Evidence expired (Decay applied)", "  ! Evidence expired (Decay applied)", "  ! CL Penalty applied for B",
        "  --(CL:2)-->\n  [B R:1.00] t", "  --(CL:3)-->\n  [g R:0.00] g", "    ! No evidence found (L0)", "  [members]", "    - [u R:1.00] u",
    ]


def test_tree_deeper_than_32(spark):
    _, _, rel, _ = scores(spark, [], [(f"n{i + 1}", f"n{i}", PART, 3) for i in range(36)])
    holons = spark.createDataFrame([("n0", "t")], "id string, title string")
    found = spark.createDataFrame([("n36", 1.0)], "id string, r double")
    assert reliability.audit_tree("n0", holons, rel, found).collect()[36].line.endswith("[n36 R:1.00] n36")


def test_reachable_and_cycles(spark, monkeypatch):
    monkeypatch.setattr(skew, "MIN_ROWS", 1)
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("c", "a")], "node string, to string")
    seeds = spark.createDataFrame([("a",), ("f",), (None,)], "seed string")
    got = {}
    for x in graph.reachable(seeds, links).collect():
        got.setdefault(x.seed, set()).add(x.node)
    assert got == {"a": set("abcdef"), "f": {"f"}}
    cand = spark.createDataFrame([("f", "a"), ("a", "f"), ("q", "q")], "source string, target string")
    assert {(x.source, x.target): x.would_cycle for x in graph.closing(cand, links).collect()} == {("f", "a"): True, ("a", "f"): False, ("q", "q"): True}


@pytest.mark.parametrize("sizes", [(1 << 21, 1 << 27, 1 << 21), (1 << 21, 200, 30), (1 << 21, 1, 1), (0, 1, 1)])
def test_reachable_of_random_graphs(spark, monkeypatch, sizes):
    """In the tasks, in blocks and halves of seeds, and frontier by frontier; deep without a job for every few steps."""
    written = []
    monkeypatch.setattr(graph, "staged", lambda df, label: written.append(label) or real(df, label))
    from corvane.session import staged as real

    for name, value in zip(("LINKS", "SEEN", "FOUND"), sizes):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(7)
    links = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)} | {(f"c{i}", f"c{i + 1}") for i in range(12)} | {("c9", "n0"), ("é", "c12")}
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            new = out.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    df = spark.createDataFrame([*links, *list(links)[:5], (None, "n1"), ("n1", None)], "node string, to string")
    ids = [*out, "elsewhere"]
    for seeds in (spark.createDataFrame([(x,) for x in [*ids, "c0", None]], "seed string"), None):
        got = sorted(map(tuple, graph.reachable(seeds, df).collect()))
        assert got == sorted((a, b) for a in (ids if seeds else out) for b in reach(a))
    assert sizes[0] == 0 or written == ["links", "links"]
    assert graph.reachable(spark.createDataFrame([("x",)], "seed string"), df.filter("false")).collect() == [("x", "x")]


def test_proposals_and_decisions(spark):
    holons = spark.createDataFrame([("api",), ("auth",), ("new",)], "id string")
    props = spark.createDataFrame([("new", "system", 9, ["api", "auth", "ghost", "new", None]), ("api", "episteme", 1, ["new"])], "id string, kind string, level int, depends_on array<string>")
    rel = spark.createDataFrame([("api", "new", PART, 3, day(1))], RELATION)
    got = sorted(map(tuple, graph.proposal_links(props, holons, rel).collect()))
    assert got == [("api", "new", "componentOf", 3), ("auth", "new", "componentOf", 3)]
    made = spark.createDataFrame([("d", "w", ["", "w", "x", None])], "id string, winner string, rejected array<string>")
    assert sorted(map(tuple, graph.decision_links(made).collect())) == [("d", "rejects", "x"), ("d", "selects", "w")]


def test_store(spark):
    rel = spark.createDataFrame([("a", "b", PART, 1, day(1))], RELATION)
    new = spark.createDataFrame([("a", "b", PART, 3, day(2)), ("c", "d", PART, None, day(2))], RELATION)
    keys = ["source_id", "target_id", "relation_type"]
    got = sorted((x.source_id, x.congruence_level, x.created_at) for x in store.upserted(rel, new, keys, ["congruence_level"]).collect())
    assert got == [("a", 3, day(1)), ("c", None, day(2))]
    with pytest.raises(ValueError):
        store.appended(rel, new, keys)
    assert store.appended(rel, new.filter("source_id = 'c'"), keys).count() == 2
    assert [tuple(x) for x in store.clashes(rel, new.union(new.filter("source_id = 'c'")), keys).orderBy("source_id").collect()] == [("a", "b", PART), ("c", "d", PART)]
    fresh = spark.createDataFrame([("a", "b", PART, "extra"), ("e", "f", PART, "extra"), (None, "f", PART, "extra")], "source_id string, target_id string, relation_type string, waits string")
    got = {(x.source_id, x.congruence_level, x.created_at) for x in store.inserted(rel, fresh, "relations", model.as_of(str(day(4)))).collect()}
    assert got == {("a", 1, day(1)), ("e", 3, day(4))}
    logs = spark.createDataFrame([("l1", "default", day(1)), ("l2", "default", day(1)), ("l3", None, None)], "id string, context_id string, timestamp timestamp_ntz")
    assert [x.id for x in store.recent(logs, 1).collect()] == ["l1"]
    assert [x.id for x in store.where(logs, "timestamp", context_id="default").collect()] == ["l1", "l2"]
    assert {x.context_id: x.id for x in store.latest(logs, "context_id", "timestamp").collect()} == {"default": "l1", None: "l3"}
    holons = spark.createDataFrame([("h", "L1", day(1)), ("i", "L0", day(1))], "id string, layer string, updated_at timestamp_ntz")
    moves = spark.createDataFrame([("h", "L1", "L2"), ("i", "L1", "L2")], "id string, from_layer string, to_layer string")
    assert {x.id: (x.layer, x.updated_at) for x in store.moved(holons, moves, model.as_of(str(day(3)))).collect()} == {"h": ("L2", day(3)), "i": ("L0", day(1))}


def test_lookups(spark, folder):
    from test_plans import plan

    holons = spark.createDataFrame([("h", "T", day(1)), ("i", "", day(2)), ("j", None, day(1))], "id string, title string, created_at timestamp_ntz")
    asked = spark.createDataFrame([("h", 1), ("h", 2), ("i", 1), ("x", 1), (None, 1)], "id string, title int")
    assert sorted(x.id for x in store.lookups(holons, asked).collect()) == ["h", "i"]
    assert {x.id: x.title for x in store.titles(holons, asked).collect()} == {"h": "T", "i": "i", "x": "x"}
    one = store.by_id(store.indexed(holons), "i")
    assert one.first().created_at == day(2) and "EqualTo(id,i)" in plan(one)


def test_schemas(spark):
    from corvane.sources import schemas

    old = spark.createDataFrame([("h", "L0", 1)], "id string, layer string, extra int")
    row = schemas.conformed(old, "holons", model.as_of(str(day(2)))).first()
    assert (row.id, row.cached_r_score, row.parent_id, row.created_at, row.updated_at) == ("h", 0.0, None, day(2), day(2)) and len(row) == 12
    assert all(set(schemas.keys(t)) <= set(schemas.schema(t).names) for t in schemas.TABLES)


def test_audit_rows(spark):
    calls = spark.createDataFrame([("l1", "tool", "op", "agent", "h", "SUCCESS", {"b": "2", "a": "1"}, None), ("l2", "tool", "op", "agent", None, "SUCCESS", {"a": "1", "b": "2"}, None), ("l3", None, None, None, None, None, None, None)], "id string, tool_name string, operation string, actor string, target_id string, result string, input map<string,string>, details string")
    rows = {x.id: x for x in store.audit_rows(calls, model.as_of(str(day(3)))).collect()}
    assert rows["l1"].input_hash == rows["l2"].input_hash and len(rows["l1"].input_hash) == 16 and rows["l3"].input_hash is None
    assert rows["l1"].context_id == "default" and rows["l1"].timestamp == day(3)


def test_every_table_empty(spark):
    from corvane.operators import freshness, search

    holons, ev, rel, at = scores(spark, [], [])
    holons, ev, rel = holons.limit(0), ev.limit(0), rel.limit(0)
    assert reliability.reliability(holons, ev, rel, at).count() == 0
    assert reliability.reports(holons, ev, rel, at).count() == 0
    assert graph.reachable(spark.createDataFrame([], "seed string"), graph.edges(rel)).count() == 0
    assert graph.closing(spark.createDataFrame([], "source string, target string"), graph.edges(rel)).count() == 0
    wv = spark.createDataFrame([], "id string, evidence_id string, waived_until timestamp_ntz, waived_by string, rationale string")
    assert freshness.stale_evidence(holons, ev, wv, at).count() == 0
    assert search.decision_listing(holons, rel).count() == 0
