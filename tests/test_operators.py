"""Operators on small hand-built tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.operators import catalog, compare, graph, inventory, observations, projection, retention, rules
from tracewell.streaming import latest

T0 = datetime(2026, 1, 1)
OCC = "scan_id long, source_snapshot_id long, source_resource_id long, target_resource_id long, relation_type string, anchor_text string, rel string, dom_path string, link_role string, scope_decision string, in_scope boolean, discovered_at timestamp"
SNAP = "id long, scan_id long, resource_id long, http_status long, fetch_state string, crawl_depth long, fetched_at timestamp"


def occurrence(anchor, rel=None, path="body/a", target=2, source=10):
    return (1, source, source // 10, target, "page_link", anchor, rel, path, None, "crawlable", True, T0)


def test_edge_with_repeated_occurrences(spark):
    rows = [occurrence("Go", path="header/nav/a"), occurrence(" Go ", "nofollow", "main/a"), occurrence(" "), occurrence(None, target=3), occurrence("x", target=None)]
    snaps = spark.createDataFrame([(10, 1, 1, 200, "ok", 0, T0), (20, 1, 2, 200, "ok", 1, T0)], SNAP)
    got = {r.target_resource_id: r for r in graph.edges(spark.createDataFrame(rows, OCC), snaps).collect()}
    e = got[2]
    assert (e.occurrence_count, e.unique_anchor_text_count, e.nofollow_occurrence_count, e.empty_anchor_occurrence_count, e.target_snapshot_id) == (3, 1, 1, 1, 20)
    assert (e.header_dom_count, e.nav_dom_count, e.main_dom_count, e.body_dom_count) == (1, 0, 1, 1)
    assert got[3].target_snapshot_id is None and set(got) == {2, 3}


def test_heavy_edge(spark):
    n = 10_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("scan_id"), F.lit(10).cast("long").alias("source_snapshot_id"), F.lit(1).cast("long").alias("source_resource_id"), F.lit(2).cast("long").alias("target_resource_id"), F.lit("page_link").alias("relation_type"), F.when(F.col("id") % 20 == 0, "").otherwise(F.format_string("Anchor %02d", F.col("id") % 11)).alias("anchor_text"), F.when(F.col("id") % 10 == 0, "nofollow").alias("rel"), F.when(F.col("id") % 3 == 0, "nav").otherwise("main").alias("dom_path"), F.lit(None).cast("string").alias("link_role"), F.lit(T0).alias("discovered_at"))
    e = graph.edges(rows, spark.createDataFrame([(10, 1, 1, 200, "ok", 0, T0)], SNAP)).first()
    assert (e.occurrence_count, e.unique_anchor_text_count, e.nofollow_occurrence_count, e.empty_anchor_occurrence_count, e.nav_dom_count) == (n, 11, 1000, 500, 3334)
    assert graph.anchor_samples(rows).first().anchors == [f"Anchor {k:02d}" for k in range(5)]


def test_empty_graph(spark):
    o, s = spark.createDataFrame([], OCC), spark.createDataFrame([], SNAP)
    assert graph.edges(o, s).count() == graph.discovered_nodes(o, s).count() == 0
    assert graph.edge_totals(graph.edges(o, s)).first().available_occurrences == 0


def test_neighbourhood_order_and_limit(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 1), (2, 4), (5, 4), (9, 8)], "a long, b long")
    start = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.hop) for r in graph.neighbourhood(pairs, start, 3).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)}
    assert [r.id for r in graph.neighbourhood(pairs, start, 3, 3).orderBy("hop", "id").collect()] == [1, 2, 3]


def test_limits_and_reasons():
    with pytest.raises(ValueError):
        graph.GraphLimits(nodes=5000).checked()
    assert graph.truncation_reasons({"nodes": 101, "edges": 5}, graph.GraphLimits()) == ["node_limit"]


def test_paging_contract(spark):
    df = spark.range(10)
    with pytest.raises(ValueError):
        catalog.page(df, 251)
    with pytest.raises(ValueError):
        catalog.ordered(df, {"id": "id"}, "name")
    assert [r.id for r in catalog.page(catalog.ordered(df, {"id": "id"}, "id", True), 3, 2).collect()] == [7, 6, 5]


def test_predicates(spark):
    df = spark.createDataFrame([(1, "Aa%b", 200, "/Docs/x", None), (2, None, None, "/docs/y", "html_page"), (3, "zz", 404, None, "image")], "id long, t string, http_status long, path string, kind string")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(catalog.search_any("A%", "t")) == [1] and ids(catalog.search_any(None, "t")) == [1, 2, 3]
    assert ids(catalog.status_family("none")) == [2] and ids(catalog.status_family("4xx")) == [3]
    assert ids(catalog.path_under("/docs")) == [2] and ids(catalog.path_under("/docs", like=True)) == [1, 2]
    assert ids(catalog.null_state("not_requested", "t")) == [2]
    assert ids(catalog.is_page(F.col("kind"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == [2]


def side(spark, rows):
    return spark.createDataFrame(rows, "resource_id long, snapshot_id long, http_status long, fetch_state string, crawl_depth long, content_hash string, document_hash string, page_title string, response_time_ms long, inbound_occurrences long, outbound_occurrences long")


def test_change_classes(spark):
    base = [(1, 11, 200, "ok", 0, "a", "d", "T", 5, 0, 0), (2, 12, 200, "ok", 0, "a", "d", "T", 5, 0, 0), (3, 13, 200, "ok", 0, "a", "d", "T", 5, 1, 0), (4, 14, 200, "ok", 0, "a", "d", "T", 5, 0, 0), (5, 15, 200, "ok", 0, "a", None, "T", 5, 0, 0), (6, 16, 200, "ok", 0, None, None, None, None, 0, 0), (7, 17, 200, "ok", 0, "a", "d", "T", 5, 0, 0)]
    target = [(1, 21, 200, "ok", 0, "b", "e", "T", 6, 0, 0), (2, 22, 200, "ok", 0, "b", "d", "U", 5, 0, 0), (3, 23, 200, "ok", 0, "a", "d", "T", 5, 2, 0), (4, 24, 200, "ok", 0, "b", "d", "T", 5, 0, 0), (5, 25, 200, "ok", 0, "a", None, "T", 5, 0, 0), (6, 26, 200, "ok", 0, None, None, None, None, 0, 0), (8, 28, 200, "ok", 0, "a", "d", "T", 5, 0, 0)]
    got = {r.resource_id: r for r in compare.page_diff(side(spark, base), side(spark, target)).collect()}
    assert {k: r.primary_change_class for k, r in got.items()} == {1: "substantive_change", 2: "metadata_change", 3: "technical_change", 4: "normalization_only", 5: "no_tracked_change", 6: "indeterminate", 7: "not_applicable", 8: "not_applicable"}
    assert got[7].presence_state == "not_observed_in_target" and got[8].presence_state == "newly_observed"
    assert (got[1].changed_field_count, got[1].response_time_ms_delta, got[6].response_time_ms_delta) == (1, 1, None)
    assert "removed" not in {r.presence_state for r in got.values()}


def test_bag_difference_counts_copies(spark):
    b, t = (spark.createDataFrame([("x",)] * n + [(o,)], "k string") for n, o in ((2, "b"), (3, "t")))
    got = {r.k: tuple(r)[1:] for r in compare.bag_diff(b, t, ["k"]).collect()}
    assert got == {"x": (2, 1, 0), "b": (0, 0, 1), "t": (0, 1, 0)}


def test_coverage_and_eligibility():
    done = {"scan_id": 1, "site_id": 1, "status": "completed", "scope": "s", "seeds": "x"}
    assert compare.coverage(done, done | {"scan_id": 2}) == ("comparable", [])
    assert compare.coverage(done, done | {"scope": "t"}) == ("comparable_with_warnings", ["scope_differs"])
    assert compare.coverage(done, done | {"status": "failed"})[0] == "limited"
    with pytest.raises(ValueError):
        compare.eligible(done, done)


def test_latest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, "k", T0, "a"), (2, "k", T0, "b"), (3, "k", datetime(2025, 1, 1), "c"), (4, None, T0, "d")], "id long, key string, observed_at timestamp, v string")
    assert sorted(r.id for r in observations.latest_per_key(df, ["key"]).collect()) == [2, 4]


def test_history_with_a_gap(spark):
    scans = spark.createDataFrame([(k, datetime(2026, k, 1)) for k in (1, 2, 3)], "scan_id long, created_at timestamp")
    snaps = spark.createDataFrame([(1, 1, 7, 200, "ok", 0, T0), (2, 3, 7, 404, "ok", 1, T0)], SNAP)
    a, b = observations.change_history(snaps, scans).orderBy("id").collect()
    assert (a.label, a.scans_between, b.label, b.scans_between, b.status_changed, b.fetch_state_changed) == ("first_observation", 0, "multiple_changes", 1, True, False)


def test_rules_are_idempotent(spark):
    pages = spark.createDataFrame([(1, "http://a/x.html", "A.com", "/x.html", None), (2, "http://a/y/", "b.com", "/y/", "q=1")], "site_page_id long, normalized_url string, host string, path string, query string")
    C = rules.Condition
    rs = [rules.Rule(1, 5, [C("host", "equals", "a.COM", case_sensitive=True)]), rules.Rule(2, 5, [C("filename", "glob", "*.HTML"), C("query", "contains", "Q=")], "any"), rules.Rule(3, 6, [C("path", "regex", "^/[xz]", negate=True)]), rules.Rule(4, 7, [])]
    m = rules.matches(pages, rs)
    assert {(r.site_page_id, r.rule_id) for r in m.collect()} == {(1, 1), (1, 2), (2, 2), (2, 3), (1, 4), (2, 4)}
    none = m.where("false")
    first = rules.reconcile(m, none)
    assert {r.action for r in first.collect()} == {"add"}
    assert {r.action for r in rules.reconcile(m, rules.after(first)).collect()} == {"keep"}
    excluded = spark.createDataFrame([(1, 5)], "site_page_id long, category_id long")
    assert {r.action for r in rules.reconcile(m, m, excluded).where("site_page_id = 1 and category_id = 5").collect()} == {"remove"}
    with pytest.raises(ValueError):
        rules.condition_column(C("path", "regex", "(a+)+$"))


@pytest.mark.parametrize(("glob", "text", "hit"), [("*.html", "a.html", True), ("a?c", "abc", True), ("a?c", "abbc", False), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.c", "abc", False), ("[ab]*", "bzz", True)])
def test_globs(spark, glob, text, hit):
    assert spark.range(1).select(F.lit(text).rlike(rules.glob_pattern(glob))).first()[0] is hit


def test_unreferenced_ignores_null_references(spark):
    ids = spark.range(5).select("id")
    refs = spark.createDataFrame([(1,), (None,)], "x long")
    assert sorted(r.id for r in retention.unreferenced(ids, "id", [refs, spark.range(3, 4)]).collect()) == [0, 2, 4]


def test_membership_refresh(spark):
    old, new = (spark.createDataFrame([(1, u) for u in us], "source_id long, normalized_url string") for us in (["a", "b"], ["b", "c"]))
    assert {r.normalized_url: (r.is_current, r.action) for r in inventory.refresh_membership(old, new).collect()} == {"a": (False, "expired"), "b": (True, "kept"), "c": (True, "inserted")}


def test_checksum_ignores_order_but_not_copies(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    a = projection.checksum(df).first()[0]
    assert a == projection.checksum(df.repartition(7).orderBy(F.desc("id"))).first()[0]
    assert a != projection.checksum(df.union(df.limit(1))).first()[0]
    assert projection.checksum(df.where("false")).first()[0] == projection.checksum(spark.range(0)).first()[0]


def test_projection_life_cycle(spark, tmp_path):
    s = projection.ProjectionStore(spark, f"file://{tmp_path}/p")
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert s.status(1) == "missing" and s.read(1, lambda: df).count() == 10
    digest = s.build("b1", 1, df, 10)
    assert s.status(1) == "active" and s.active(1) == "b1" and digest == projection.checksum(df).first()[0]
    assert s.read(1, lambda: df.where("false")).exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        s.build("b2", 1, df, 11)
    assert s.active(1) == "b1"
    s.build("b3", 1, df.where("id < 5"))
    assert s.active(1) == "b3" and {r.build_id: r.status for r in s.states().collect()} == {"b1": "superseded", "b2": "failed", "b3": "ready"}
    s.delete(1)
    assert s.active(1) is None and s.status(1) == "cancelled"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "k", T0, "ready"), (2, "k", datetime(2026, 1, 1, 0, 30), "failed"), (3, "j", datetime(2026, 1, 1, 5), "ready")], "id long, key string, observed_at timestamp, outcome string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df in (("latest", latest.latest_stream(stream, ["key"])), ("hourly", latest.hourly_outcomes(stream))):
        q = df.writeStream.format("memory").queryName(f"s_{name}").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c_{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r.key, r.id) for r in spark.table("s_latest").collect()} == {("k", 2), ("j", 3)}
    assert sorted((r.outcome, r.n) for r in spark.table("s_hourly").collect()) == [("failed", 1), ("ready", 1), ("ready", 1)]


def test_tasks_of_occurrences_follow_the_rows(spark, small, monkeypatch):
    from tracewell.sources import fixtures

    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    v = fixtures.Views(spark, small)
    o = v.occurrences(dense=True)
    assert o.rdd.getNumPartitions() == -(-v.table("lineitem").count() // 100) > 8
    # Counters of edges are grouped where the occurrences are.
    counters = graph.edge_counters(o, "role=link_role", "scope=scope_decision")
    assert counters.rdd.getNumPartitions() == o.rdd.getNumPartitions()


def test_resource_aggregate_deals_a_hot_resource_to_several_tasks(spark):
    import random

    from tracewell.operators import inventory

    rng = random.Random(3)
    fields = ("resource_id", "evidence", "evidence_id", "scan_id", "source_snapshot_id", "http_status", "kind", "rule", "extension", "in_scope", "evidence_at", "fetched_at")
    made = []
    for k in range(600):
        kind = rng.choice(("observed", "anchor", "embedded"))
        seen = kind == "observed"
        made.append((0 if k % 3 else rng.randrange(5), kind, k, rng.choice((1, 2, None)), None if seen else rng.randrange(40), 200 + k if seen else None, rng.choice(("a", "b")), "r", None, rng.choice((True, False, None)), None if seen else rng.randrange(99), rng.choice((None, 1, 2)) if seen else None))
    rows = [dict(zip(fields, r, strict=True)) for r in made]
    e = spark.createDataFrame(made, "resource_id long, evidence string, evidence_id long, scan_id long, source_snapshot_id long, http_status long, kind string, rule string, extension string, in_scope boolean, evidence_at long, fetched_at long")
    for c in inventory.LATEST:
        e = e if c in e.columns else e.withColumn(c, F.col("evidence_id"))
    resources = spark.createDataFrame([(k, "n", "h", "/", "htm") for k in range(5)], "id long, normalized_url string, host string, path string, path_extension string")
    got = inventory.resource_aggregate(e, resources, tasks=7)
    assert "hashpartitioning(resource_id#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 7), REPARTITION_BY_NUM" in plan
    for found in (got, inventory.resource_aggregate(e, resources)):
        rs = {r.resource_id: r for r in found.collect()}
        assert len(rs) == 5
        for k, r in rs.items():
            own = [x for x in rows if x["resource_id"] == k]
            seen, refs = [x for x in own if x["evidence"] == "observed"], [x for x in own if x["evidence"] != "observed"]
            last = max(seen, key=lambda x: (x["fetched_at"] or 0, x["evidence_id"]))
            assert (r.http_status, r.snapshot_id, r.kind) == (last["http_status"], last["evidence_id"], last["kind"])
            assert (r.observed_count, r.occurrence_count) == (len(seen), len(refs))
            assert r.source_page_count == len({x["source_snapshot_id"] for x in refs}) and r.scan_count == len({x["scan_id"] for x in own} - {None})
            assert (r.in_scope_count, r.out_scope_count) == tuple(sum(x["in_scope"] is v for x in own) for v in (True, False))
            assert (r.first_discovered, r.latest_discovered) == (min(x["evidence_at"] for x in refs), max(x["evidence_at"] for x in refs))
    # The sources of one resource lie in several parts, each of which is grouped on its own.
    assert e.where("resource_id = 0").select(F.pmod(F.xxhash64("source_snapshot_id"), F.lit(inventory.SOURCE_PARTS))).distinct().count() > 1
