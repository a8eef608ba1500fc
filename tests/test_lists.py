"""Named lists: filters, sorts and pages on small frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewell.operators import lists, observations, rules
from tracewell.sources import documents


def ids(df, key="id"):
    return [r[key] for r in df.collect()]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://a.test/x", None, "Home", "a.test", "/x", 200, 0, None, 3, None), (2, "https://b.test/100%", "https://b.test/y", None, "b.test", "/y", None, 2, "timeout", None, "captured"), (3, "https://a.test/z", None, "Zed", "a.test", "/z", 404, None, None, 3, None)]
    return spark.createDataFrame(rows, "id long, requested_url string, final_url string, page_title string, host string, path string, http_status long, crawl_depth long, error_type string, inbound_occurrences long, rendered_state string")


def test_page_filters(pages):
    def got(**f):
        return sorted(ids(lists.PAGES.where(pages, **f)))

    assert got() == [1, 2, 3] and got(search="HOME") == [1] and got(search="0%") == [2] and got(search="_") == []
    assert got(host="A.TEST") == [1, 3] and got(path_prefix="/X") == [1] and got(min_depth=1) == [2] and got(max_depth=1) == [1] and got(depth=2, status=None) == [2]
    assert got(error_state="with_errors") == [2] and got(error_state="without_errors") == [1, 3] and got(error_state="any") == [1, 2, 3]
    assert got(rendered_state="not_requested") == [1, 3] and got(rendered_state="captured") == [2] and got(rendered_state="any") == [1, 2, 3]
    with pytest.raises(ValueError):
        got(colour="red")


def test_sorts(pages):
    assert ids(lists.PAGES.read(pages, "status")) == [2, 1, 3] and ids(lists.PAGES.read(pages, "status", True)) == [3, 1, 2]
    # the tie-breaker turns with the sort where the list says so, and nulls count as zero where it says so
    assert ids(lists.PAGES.read(pages, "inbound")) == [2, 1, 3] and ids(lists.PAGES.read(pages, "inbound", True)) == [3, 1, 2]
    assert ids(lists.PAGES.read(pages, "status", True, 1, 1)) == [1]
    with pytest.raises(ValueError):
        lists.PAGES.read(pages, "colour")
    with pytest.raises(ValueError):
        lists.PAGES.read(pages, "status", limit=251)


def test_every_sort_and_filter_is_a_column_expression(spark):
    for name, listing in vars(lists).items():
        if isinstance(listing, lists.Listing):
            assert all(isinstance(s, str) or s() is not None for s in listing.sorts.values()), name
            for key, f in listing.filters.items():
                for value in (1, "observed"):
                    try:
                        assert f(value) is None or type(f(value)).__name__ == "Column", (name, key)
                    except (TypeError, AttributeError):
                        assert isinstance(value, (int, str))


def test_link_filters(spark):
    rows = [(1, "a", "R", 200), (2, "b", None, 301)]
    df = spark.createDataFrame(rows, "id long, rel string, link_role string, http_status long")
    assert ids(lists.INBOUND.where(df, link_role="legacy_unclassified")) == [2] and ids(lists.INBOUND.where(df, link_role="R", source_status=200)) == [1]


def test_comparison_filters(spark):
    df = spark.createDataFrame(
        [(1, "s", "t", "observed_in_both", {"nav": 1}, None, 2), (2, "s", "u", "not_observed", {"nav": 0}, {"body": 2}, -5), (3, "v", "t", "newly_observed", None, {"nav": 4}, 0)],
        "id long, source_url string, target_url string, presence_state string, baseline_roles map<string,int>, target_roles map<string,int>, occurrence_delta long",
    )
    assert sorted(ids(lists.COMPARED_LINKS.where(df, role="nav"))) == [1, 3] and ids(lists.COMPARED_LINKS.where(df, min_occurrence_delta=3)) == [2] and ids(lists.COMPARED_LINKS.read(df, "unknown", True)) == [3, 1, 2]
    p = spark.createDataFrame([(1, "no_change", "observed_in_both"), (2, "metadata_change", "observed_in_both"), (3, "no_change", "not_observed")], "id long, primary_change_class string, presence_state string")
    assert sorted(ids(lists.COMPARED_PAGES.where(p, changed_only=True))) == [2, 3] and len(ids(lists.COMPARED_PAGES.where(p, changed_only=False))) == 3


def test_counts_and_flags(spark):
    df = spark.createDataFrame([(1, 0, 2, True), (2, 1, 0, None), (3, None, 0, False)], "id long, warning_count int, viewport int, in_scope boolean")
    assert ids(lists.RENDERED.where(df, has_warnings=True)) == [2] and sorted(ids(lists.RENDERED.where(df, has_warnings=False))) == [1, 3] and ids(lists.RENDERED.where(df, has_viewport_screenshot=True)) == [1]
    refs = df.withColumn("optional", F.lit(False)).withColumn("child_snapshot_id", F.when(F.col("id") == 1, 9))
    assert ids(lists.DOCUMENT_REFERENCES.where(refs, in_scope=False)) == [3] and ids(lists.DOCUMENT_REFERENCES.where(refs, fetched=True)) == [1]


def test_notes(spark):
    notes = spark.createDataFrame([(1, 5, None, None, False, 1, "a", "b"), (2, 5, None, None, True, 0, "c", "d"), (3, None, 7, None, False, 2, "a", "")], "id long, website_property_id long, scan_id long, site_page_id long, is_pinned boolean, updated_at long, title string, body string")
    assert ids(lists.target_notes(notes, website_property_id=5)) == [2, 1] and ids(lists.target_notes(notes, website_property_id=5, pinned=False)) == [1] and ids(lists.target_notes(notes, search="A", scan_id=7)) == [3]
    for bad in ({}, {"scan_id": 1, "site_page_id": 2}, {"colour": 1}):
        with pytest.raises(ValueError):
            lists.target_notes(notes, **bad)


def test_render_candidates(spark):
    rows = [(1, 1, "u1", "u1", "ok", 1, 5), (2, 2, "u2", "u2", "ok", 0, 9), (3, 3, None, "u3", "ok", 0, 1), (4, None, "u4", "u4", "ok", 0, 1), (5, 5, "u5", "u5", "failed", 0, 1), (6, 6, "u6", "start", "ok", 4, 9)]
    df = spark.createDataFrame(rows, "id long, html_blob_id long, final_url string, requested_url string, fetch_state string, crawl_depth long, fetched_at long")
    assert ids(lists.render_candidates(df, "start", F.lit(True))) == [6, 2, 1] and ids(lists.render_candidates(df, "start", F.lit(True), most=1)) == [6] and ids(lists.render_candidates(df, "start", F.lit(True), "none")) == []
    assert ids(lists.render_candidates(df, "none of them", F.lit(True), "starting_page")) == [2] and ids(lists.render_candidates(df, "x", F.col("id") == 1, "starting_page")) == []


def test_ties_revisions_and_exclusions(spark):
    o = spark.createDataFrame([(1, 7, 5), (2, 7, 5), (3, 7, 4), (4, 8, None)], "id long, resource_id long, observed_at long")
    assert sorted(ids(observations.latest_ties(o, ["resource_id"]))) == [1, 2]
    history = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "rule_id long, revision int, definition string")
    rule = spark.createDataFrame([(1, "b"), (2, "x")], "rule_id long, definition string")
    assert sorted(map(tuple, rules.revisions(history, rule).collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "x")]
    assert sorted(map(tuple, rules.revisions(history, rule.withColumn("definition", F.lit("a"))).collect())) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "a")]
    e = spark.createDataFrame([(1, 1), (2, 1)], "site_page_id long, category_id long")
    assert sorted(map(tuple, rules.set_exclusions(e, add=e.where("site_page_id = 1").withColumn("category_id", F.lit(9)), remove=e.where("site_page_id = 2")).collect())) == [(1, 1), (1, 9)]


def test_sitemaps_of_sitemaps(spark):
    def index(*urls):
        return ("<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>").encode()

    pages = b"<urlset><url><loc>p</loc></url><url><loc>q</loc></url></urlset>"
    bodies = spark.createDataFrame([("a", index("b", "c", "a", "gone")), ("b", index("c", "d")), ("c", pages), ("d", index("e")), ("e", pages), ("bad", b"<x")], "url string, body binary")

    def states(roots, **k):
        maps, entries = documents.expand_sitemaps(bodies, spark.createDataFrame([(r,) for r in roots], "url string"), **k)
        return sorted((r.url, r.depth, r.state) for r in maps.collect()), sorted((r.sitemap_url, r.loc) for r in entries.collect()), {r.url for r in maps.where("truncated").collect()}

    got, entries, cut = states(["a", "bad"], max_depth=2)
    assert got == [("a", 0, "sitemapindex"), ("a", 1, "cycle"), ("b", 1, "sitemapindex"), ("bad", 0, "invalid"), ("c", 1, "urlset"), ("d", 2, "sitemapindex"), ("e", 3, "depth_limit"), ("gone", 1, "not_recorded")]
    assert entries == [("c", "p"), ("c", "q")] and cut == set()
    got, entries, cut = states(["a"], max_children=1)
    assert [x[0] for x in got] == ["a", "b", "c"] and entries == [("c", "p"), ("c", "q")] and cut == {"a", "b"}
