"""All tracked fields of resources and links, patterns with a limit, what goes with a scan."""

from __future__ import annotations

from tracewell.operators import compare, graph, retention, rules


def test_all_fields_of_a_resource_are_tracked(spark):
    names = [f for f in compare.RESOURCE_FIELDS if f not in ("observed", "discovered_only")]
    assert len(compare.RESOURCE_FIELDS) == 16 and len(compare.LINK_FIELDS) == 11
    base = {n: 1 for n in names}

    def side(rows):
        return spark.createDataFrame([(k, "u", "h", "/p", 5, *[(base | change).get(n) for n in names]) for k, change in rows], "resource_id long, normalized_url string, host string, path string, snapshot_id long, " + ", ".join(f"{n} long" for n in names))

    changes = [(k, {n: 2}) for k, n in enumerate(names)] + [(50, {}), (51, {"observed_count": 0, "http_status": None}), (52, {})]
    target = side([*changes, (99, {})])
    got = {r.resource_id: r for r in compare.full_resource_diff(side([(k, {}) for k, _ in changes] + [(98, {})]), target).collect()}
    assert [got[k].changed_fields for k in range(len(names))] == [[n] for n in names]
    assert (got[50].change_state, got[51].changed_fields) == ("no_tracked_change", ["observed", "discovered_only", "http_status", "observed_count"])
    assert got[51].status_changed and got[51].observed_state_changed and got[51].occurrence_delta == 0
    assert [(got[k].presence_state, got[k].change_state, got[k].changed_field_count, got[k].occurrence_delta, got[k].host) for k in (98, 99)] == [(compare.GONE, "not_applicable", 0, None, "h"), (compare.NEW, "not_applicable", 0, None, "h")]


def test_all_fields_of_a_link_are_tracked(spark):
    def links(*rows):
        return spark.createDataFrame([(1, 10, s, t, a, role, scope, scope == "in", rel, path) for s, t, a, role, scope, rel, path in rows], "scan_id long, source_snapshot_id long, source_resource_id long, target_resource_id long, anchor_text string, link_role string, scope_decision string, in_scope boolean, rel string, dom_path string")

    one = (1, 2, "a", "nav", "in", "", "html/body/nav/a")
    diff = lambda b, t: compare.full_link_diff(graph.tracked_edges(links(*b)), graph.tracked_edges(links(*t))).first()
    same = diff([one, (1, 2, "b", None, "in", "", "html/body/p/a")], [(1, 2, "b", None, "in", "", "html/body/p/a"), one])
    assert (same.change_state, same.changed_fields) == ("no_tracked_change", [])
    assert diff([one], [(1, 2, "a", "foot", "in", "", "html/body/nav/a")]).changed_fields == ["role_counts"]
    assert diff([one], [(1, 2, "a", "nav", "in", "", "html/body/footer/a")]).changed_fields == ["region_counts"]
    assert diff([one], [(1, 2, "a", "nav", "out", "nofollow", "html/body/nav/a")]).changed_fields == ["follow_count", "nofollow_occurrence_count", "in_scope_count", "out_scope_count", "scope_counts"]
    gone = diff([one, one], [(3, 4, "a", "nav", "in", "", "")])
    assert {gone.occurrence_delta} <= {-2, 1} and gone.change_state == "not_applicable"


def test_patterns_may_not_take_forever(spark):
    C = rules.Condition
    pages = spark.createDataFrame([(1, "a" * 40 + "!", "H", "/x/", None), (2, "aaa", "h", "/y.HTML", "q=1"), (3, None, None, None, None)], "site_page_id long, normalized_url string, host string, path string, query string")
    rs = [
        rules.Rule(1, 5, [C("normalized_url", "regex", "^(a|aa)+$")]), rules.Rule(2, 5, [C("host", "equals", "H", case_sensitive=True)]), rules.Rule(3, 6, [C("normalized_url", "regex", "(x+)+y", negate=True), C("filename", "glob", "*.html")]),
        rules.Rule(4, 7, [C("normalized_url", "regex", "^(a|aa)+$"), C("query", "contains", "Q=")], "any"), rules.Rule(5, 7, [C("path", "regex", "[")]), rules.Rule(6, 8, [C("path", "regex", "(b+)+")], active=False),
    ]
    got = sorted((r.site_page_id, r.rule_id, (r.error or "").split(":")[0]) for r in rules.evaluate(pages, rs).collect())
    slow, wrong = "pattern took too long", "invalid pattern"
    assert got == [(1, 1, slow), (1, 2, ""), (1, 4, slow), (1, 5, wrong), (2, 1, ""), (2, 2, ""), (2, 3, ""), (2, 4, ""), (2, 5, wrong), (3, 5, wrong)]
    assert rules.evaluate(pages, rs[1:2]).columns == ["site_page_id", "rule_id", "category_id", "error"]


def test_what_goes_with_a_scan(spark):
    snaps = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (1, 12, "b"), (2, 10, "a"), (None, 13, "c"), (1, 14, None)], "scan_id long, resource_id long, sha256 string")
    links = spark.createDataFrame([(1, 20), (1, 13), (2, 21), (1, None)], "scan_id long, target_resource_id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "baseline_scan_id long, target_scan_id long")
    blobs = spark.createDataFrame([("a", 5), ("b", 7), ("c", 9)], "sha256 string, size long")
    row = retention.deletion_preview(snaps, links, pairs, blobs, 1, [spark.createDataFrame([(14,)], "r long")]).first()
    assert tuple(row) == (4, 3, 2, 3, 1, 7, 1)
    assert tuple(retention.deletion_preview(snaps, links, pairs, blobs, 77).first()) == (0, 0, 0, 0, 0, 0, 0)
