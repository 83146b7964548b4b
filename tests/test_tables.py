from conftest import day

import __spark_entry__
from corvane.operators import freshness, history, model, references, sequence
from pyspark.sql import functions as F


def test_stretches(spark):
    data = [(k, i) for k in ("a", "b", None) for i in range(30)]

    def differs(before, here):
        i, j = (t.column("i").to_numpy() // 10 for t in (before, here))
        return sequence.unequal(before.column("k"), here.column("k")) | (i != j)

    want = sorted(data, key=lambda r: (r[0] or "", r[1]))
    for ranges in (1, 7, 40):
        rows = sequence.stretches(spark.createDataFrame(data, "k string, i int"), ["k", "i"], ["k", "i"], differs, ("k", "i"), ("k", "i"), ranges)
        got = sorted(((r.k, r.i, tuple(r._last), tuple(r._next) if r._next else None, r._count) for r in rows.collect()), key=lambda r: (r[0] or "", r[1]))
        assert got == [(*want[j], want[j + 9], want[j + 10] if j < 80 else None, 10) for j in range(0, 90, 10)]


def test_one_stretch_over_all_ranges(spark):
    rows = sequence.stretches(spark.range(100), ["id"], ["id"], lambda before, here: here.column("id").to_numpy() == 97, ("id",), ("id",), 9)
    assert sorted((r.id, r._last.id, r._next and r._next.id, r._count) for r in rows.collect()) == [(0, 96, 97, 97), (97, 99, None, 3)]


def test_edges_are_no_more_than_the_ranges(spark, monkeypatch):
    """However many groups there are, what is broadcast is a row per range."""
    sent = []
    monkeypatch.setattr(sequence.F, "broadcast", lambda df: (sent.append(df.count()), df)[1])
    rows = spark.range(3000).selectExpr("id % 1000 AS g", "id", "1 AS v")
    assert {r.g: r.n for r in sequence.running_total(rows, "g", ["id"], "v", 6).groupBy("g").agg(F.sum("_before").alias("n")).collect()} == dict.fromkeys(range(1000), 3)
    sequence.stretches(rows, ["g", "id"], ["g"], lambda before, here: sequence.unequal(before.column("g"), here.column("g")), ranges=6)
    assert sent == [6, 6]


def test_running_total(spark):
    data = [("hot", i, 1) for i in range(40)] + [("b", 0, 5), ("b", 1, None), ("b", 2, 2)]
    got = sequence.running_total(spark.createDataFrame(data, "g string, i int, v int"), "g", ["i"], "v", 5).collect()
    assert {(r.g, r.i): r._before for r in got} == {**{("hot", i): i for i in range(40)}, ("b", 0): 0, ("b", 1): 5, ("b", 2): 5}


HOLON = "id string, layer string, cached_r_score double, updated_at timestamp_ntz, created_at timestamp_ntz, seen string"
SNAP = "id string, layer string, cached_r_score double, updated_at timestamp_ntz, snapshot_at timestamp_ntz, current int"


def test_history(spark):
    holons = spark.createDataFrame([("h", "L1", 0.5, day(5), day(1), "clash"), (None, "L0", None, day(1), day(1), "")], HOLON)
    snaps = spark.createDataFrame([
        ("H", " l0", None, day(1), day(2), 1), ("h", "L0", 0.0, day(2), day(3), 1), ("h", "L0", 0.30001, day(3), day(4), 1), ("h", "L0", 0.9, day(3), day(3), 1),
        ("h", "L0", 0.3, day(4), day(5), 1), ("h", "L9", 0.1, day(5), day(9), 1), ("gone", None, 0.1, day(1), day(1), 1), ("gone", None, 0.1, None, day(1), 1),
    ], SNAP)
    rows = history.changes(holons, snaps)
    got = {(r.id, r.valid_from): (r.layer, r.cached_r_score, r.valid_to) for r in history.versions(holons, snaps).collect()}
    assert got == {
        ("h", day(1)): ("l0", 0.0, day(3)), ("h", day(3)): ("l0", 0.3, day(5)), ("h", day(5)): ("l1", 0.5, None), ("gone", day(1)): (None, 0.1, None),
    }
    slow = {(r.id, r.valid_from) for r in history.satellite(rows, "layer").collect()}
    assert slow == {("h", day(1)), ("h", day(5)), ("gone", day(1))}


def test_history_of_one_hot_id(spark):
    snaps = spark.createDataFrame([("hot", "L0", float(i // 10) / 10, day(1, second=i % 60, hour=i // 60), day(2), 1) for i in range(200)], SNAP)
    assert history.versions(spark.createDataFrame([], HOLON), snaps).count() == 20


def test_history_of_nothing(spark):
    none = spark.createDataFrame([], HOLON), spark.createDataFrame([], SNAP)
    rows = history.changes(*none)
    assert history.versions(*none).count() == 0 and history.satellite(rows, "layer").count() == 0


EV = "id string, holon_id string, created_at timestamp_ntz, key string"
REL = "source_id string, target_id string, relation_type string, created_at timestamp_ntz, ref_table string"
LOG = "id string, target_id string, timestamp timestamp_ntz, at string"
H = "id string, created_at timestamp_ntz, refs int"


def test_orphans(spark):
    holons = spark.createDataFrame([("h1", day(5), 1), ("h1", day(3), 1), ("old", None, 1), (None, day(1), 1)], H)
    ev = spark.createDataFrame([("e1", "H1", day(4), ""), ("e2", "h1", day(2), ""), ("e2", "h1", day(2), ""), ("e3", "e1", day(9), ""), ("e4", None, day(1), ""), ("e5", " ", day(1), ""), ("e6", "old", None, "")], EV)
    rel = spark.createDataFrame([("e1", "h1", "verifiedBy", day(9), ""), ("h1", "ghost", "selects", day(9), ""), ("h1", None, None, day(9), "")], REL)
    log = spark.createDataFrame([("l1", "./x/knowledge/L0/h1.md", day(9), ""), ("l2", "x/decisions/a.md", day(9), ""), ("l3", "/knowledge/L1/Nope.md", day(9), ""), ("l4", "unknown", None, "")], LOG)
    got = {(r.ref_table, r.ref_field, r.row_key) for r in references.orphans(holons, ev, rel, log).collect()}
    assert got == {("evidence", "holon_id", "e2"), ("evidence", "holon_id", "e3"), ("relations", "target_id", "h1|ghost|selects"), ("audit_log", "target_id", "l3"), ("audit_log", "target_id", "l4")}


def test_orphans_of_nothing(spark):
    assert references.orphans(*[spark.createDataFrame([], s) for s in (H, EV, REL, LOG)]).count() == 0


def test_freshness(spark):
    at = model.as_of("2022-01-15 12:00:00")
    holons = spark.createDataFrame([("h", "T", "L2")], "id string, title string, layer string")
    ev = spark.createDataFrame([("e1", "h", "t", day(10)), ("e2", "h", "t", day(15)), ("e3", "h", "t", None), ("e4", "ghost", "t", day(1)), ("e5", "h", "t", day(1)), ("e6", "h", "t", day(2))], "id string, holon_id string, type string, valid_until timestamp_ntz")
    wv = spark.createDataFrame([("w1", "e5", day(20), "me", "r"), ("w2", "e6", day(3), "me", None)], "id string, evidence_id string, waived_until timestamp_ntz, waived_by string, rationale string")
    stale = freshness.stale_evidence(holons, ev, wv, at)
    assert {(r.evidence_id, r.days_overdue) for r in stale.collect()} == {("e1", 5), ("e6", 13)}
    live = freshness.active_waivers(holons, ev, wv, at)
    assert [(r.evidence_id, r.days_until_expiry, r.expires_soon) for r in live.collect()] == [("e5", 4, True)]
    lines = [r.line for r in freshness.report_sections(stale, live).orderBy("section", "item").collect()]
    assert lines[:4] == ["### STALE (1 holons require action)", "#### T (L2)", "| e6 | t | EXPIRED | 13 days overdue |", "| e1 | t | EXPIRED | 5 days overdue |"]
    assert freshness.report_sections(stale.limit(0), live.limit(0)).first().line.startswith("### All holons FRESH")
    asked = spark.createDataFrame([("e1", "2022-02-01", "r"), ("e1", "2022-01-01", "r"), ("no", "2022-02-01", "r"), ("e1", "soon", "r"), ("e1", None, "r")], "evidence_id string, until string, rationale string")
    problems = sorted(str(r.problem) for r in freshness.waiver_requests(asked, ev, at).collect())
    assert problems == ["None", "unknown evidence", "until and rationale are required", "until is no date", "until is not in the future"]


def test_stream(spark, folder):
    from corvane.streaming import audit

    path = f"{folder}/audit_log.parque[t]"
    assert audit.drained(spark, path).agg(F.sum("n_events")).first()[0] == model.audit(spark.read.parquet(path)).count()
    live = audit.daily_activity(audit.audit_stream(spark, path))
    assert live.isStreaming and live.columns == ["day", "result", "n_events"]


def test_listings_have_every_row(spark, folder):
    queries = __spark_entry__.queries()
    for rows, counts, n in [("audit_rows_by_context", "audit_by_context", "n"), ("relation_rows_by_target", "relations_by_target", "n"), ("dependent_rows", "dependents", "n_dependents")]:
        assert queries[rows](spark, folder).count() == queries[counts](spark, folder).agg({n: "sum"}).first()[0]
    got = queries["audit_rows_by_context"](spark, folder).filter("context_id = 'default'").orderBy("place").collect()
    assert [x.place for x in got] == list(range(1, len(got) + 1)) and got == sorted(got, key=lambda x: (-x.timestamp.timestamp(), x.id))


def test_winner_is_a_row_that_was_written(spark):
    schema = "id string, type string, kind string, layer string, title string, content string, context_id string, scope string, parent_id string, cached_r_score double, created_at timestamp_ntz, updated_at timestamp_ntz"
    tied = [("h", "t", None, "L0", "A1", "zzz", "c", None, None, 0.5, day(1), day(2)), ("H", "t", None, "l0", "B2", "aaa", "c", None, None, 0.5, day(1), day(2)), ("h", "t", "k", "L0", "A0", "a", "b", None, None, 0.5, day(1), day(1))]
    row = model.holons(spark.createDataFrame(tied, schema)).first()
    assert (row.id, row.title, row.content, row.kind, row.layer) == ("h", "B2", "aaa", None, "L0")
    assert model.holons(spark.createDataFrame(tied, schema)).select("content").first().content == "aaa"


def test_waiver_of_this_instant(spark):
    asked = spark.createDataFrame([("e", "2022-01-15", "why"), ("e", "2022-01-14", "why"), ("e", "2022-01-15T00:00:00Z", "why"), ("e", "12:30", "why")], "evidence_id string, until string, rationale string")
    got = [r.problem for r in freshness.waiver_requests(asked, spark.createDataFrame([("e",)], "id string"), model.as_of(str(day(15)))).collect()]
    assert got == [None, "until is not in the future", None, "until is no date"]


def test_markdown_files(spark, tmp_path):
    from corvane.sources import tables

    docs = [("knowledge/L0/a b.md", "---\nx: 1\n---\nbody\n\n"), ("decisions/d=1%.md", ""), ("é.md", "one line"), (None, "nowhere"), ("n.md", None)]
    tables.write_markdown(spark.createDataFrame(docs, "path string, document string"), str(tmp_path / "md"))
    assert {(r.path, r.document) for r in tables.read_markdown(spark, str(tmp_path / "md")).collect()} == set(docs[:3])


def test_markdown_file_each(spark, tmp_path):
    """A folder a task, not one a document; files hold the bytes of their documents, and only those written last."""
    from corvane.session import partitions
    from corvane.sources import tables

    docs = {f"knowledge/L0/h{i}.md": f"text {i}" for i in range(300)} | {"": "no name", "..": "up", "a.gz": "plain", "%2F\n": "\r\né"}
    tables.write_markdown(spark.createDataFrame([("old.md", "old")], "path string, document string"), str(tmp_path / "md"))
    tables.write_markdown(spark.createDataFrame([*docs.items(), ("..", "UP")], "path string, document string"), str(tmp_path / "md"))
    made = list((tmp_path / "md").rglob("*"))
    assert len([x for x in made if x.is_dir()]) <= partitions(spark)
    assert sorted(x.read_bytes() for x in made if x.is_file()) == sorted(v.encode() for v in docs.values())
    assert {r.path: r.document for r in tables.read_markdown(spark, str(tmp_path / "md")).collect()} == docs


def test_stream_counts_ids_once(spark, tmp_path):
    from corvane.sources import schemas
    from corvane.streaming import audit

    rows = [("a", day(1), "t", "o", "x", None, None, "success", None, "c"), ("A ", day(2), "t", "o", "x", None, None, "ERROR", None, "c"), ("b", day(1), "t", "o", "x", None, None, "Success", None, "c"), (None, day(1), "t", "o", "x", None, None, "Success", None, "c")]
    frame = spark.createDataFrame(rows, schemas.schema("audit_log"))
    frame.repartition(3).write.parquet(str(tmp_path / "log"))
    assert [tuple(r) for r in audit.drained(spark, str(tmp_path / "log")).collect()] == [("2022-01-01", "SUCCESS", 2)]
    (tmp_path / "none").mkdir()
    assert audit.drained(spark, str(tmp_path / "none")).count() == 0
    live = audit.daily_activity(audit.audit_stream(spark, str(tmp_path / "log")), "9 days")
    run = live.writeStream.format("memory").queryName("live_days").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(r.n_events for r in spark.table("live_days").collect()) == 2
