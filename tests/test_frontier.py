"""Trees, sitemaps and crawls: order, budgets, cycles."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracewell.operators import frontier
from tracewell.operators.ordering import numbered
from tracewell.sources import documents


def refs(spark, pairs):
    return spark.createDataFrame([(a, k, b) for k, (a, b) in enumerate(pairs)], "parent_id string, position long, child_id string")


def files(spark, *ids, size=10, plain=()):
    return spark.createDataFrame([(i, size, i not in plain) for i in ids], "id string, bytes long, is_index boolean")


def roots(spark, *ids):
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, position long")


def test_numbers_and_running_sums(spark):
    r = random.Random(1)
    rows = [(k, r.randrange(1000), r.choice([None, 1, 2, 5])) for k in range(500)]
    got = numbered(spark.createDataFrame(rows, "id long, k long, n long"), [F.asc("k"), F.asc("id")], {"total": "n"}).collect()
    total, want = 0, {}
    for at, (i, _, n) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])), 1):
        total += n or 0
        want[i] = (at, total)
    assert {x.id: (x.number, x.total) for x in got} == want
    assert numbered(spark.createDataFrame([], "id long"), [F.asc("id")]).collect() == []


def test_components_against_brute_force(spark):
    r = random.Random(2)
    pairs = {(r.randrange(40), r.randrange(40)) for _ in range(55)}
    reach = set(pairs)
    while new := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= new
    want = {a: max(b for x, b in reach if x == a and (b, a) in reach) for a, _ in reach if (a, a) in reach}
    got = frontier.strong_components(spark.createDataFrame([*pairs, (None, 1), (2, None)], "a long, b long")).collect()
    assert {x.node: x.component for x in got} == want and len(got) == len(want)
    assert frontier.strong_components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect() == []


def test_tree_sees_cycles_of_documents_met_another_way(spark):
    tree = frontier.document_tree(refs(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "b"), ("c", "a"), ("c", "c"), ("b", None)]), files(spark, "a", "b", "c"), roots(spark, "a"))
    assert [(x.id, x.depth, x.number) for x in tree.documents.orderBy("number").collect()] == [("a", 0, 1), ("b", 1, 2), ("c", 1, 3)]
    flags = {(x.parent_id, x.child_id): (x.forms_cycle, x.closes_loop) for x in tree.references.collect()}
    assert flags == {("a", "b"): (False, False), ("a", "c"): (False, False), ("b", "c"): (False, True), ("c", "b"): (False, True), ("c", "a"): (True, True), ("c", "c"): (True, True)}
    assert tree.stop_reason is None
    rows = {x.id: (x.parents, x.in_cycle, x.closes_loop) for x in frontier.tree_rows(tree).collect()}
    assert rows == {"a": (1, True, True), "b": (2, False, True), "c": (3, True, True)}


def test_tree_budgets_stop_the_expansion(spark):
    pairs = [("r", "x"), ("r", "y"), ("r", "z"), ("x", "p"), ("y", "q"), ("z", "s"), ("p", "t")]
    every = files(spark, "r", "x", "y", "z", "p", "q", "s", "t")

    def run(**k):
        tree = frontier.document_tree(refs(spark, pairs), every, roots(spark, "r"), **k)
        return [x.id for x in tree.documents.orderBy("number").collect()], tree.stop_reason

    assert run() == (["r", "x", "y", "z", "p", "q", "s", "t"], None)
    assert run(max_documents=3) == (["r", "x", "y"], "max_total_documents")
    assert run(max_documents=4) == (["r", "x", "y", "z"], "max_total_documents")
    assert run(max_bytes=35) == (["r", "x", "y"], "max_total_bytes")
    assert run(max_depth=1) == (["r", "x", "y", "z"], None)
    # r is the first index and x the second: with three, those after them aren't followed.
    assert run(max_indexes=3) == (["r", "x", "y", "z", "p"], None)


def test_tree_of_unrecorded_and_plain_documents(spark):
    tree = frontier.document_tree(refs(spark, [("a", "b"), ("a", "m"), ("b", "c")]), files(spark, "a", "b", "c", plain=("b",)), roots(spark, "a", "a"))
    assert [(x.id, x.state, x.bytes) for x in tree.documents.orderBy("number").collect()] == [("a", "index", 10), ("b", "document", 10), ("m", "not_recorded", 0)]


def test_sitemaps_report_cycles_of_siblings(spark):
    index = lambda *locs: ("<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>").encode()
    bodies = spark.createDataFrame([("a", index("b", "c")), ("b", index("c")), ("c", index("b", "d")), ("d", b"<urlset><url><loc>u</loc></url></urlset>")], "url string, body binary")
    maps, entries = documents.expand_sitemaps(bodies, spark.createDataFrame([("a",)], "url string"))
    assert sorted((x.url, x.depth, x.state) for x in maps.collect()) == [("a", 0, "sitemapindex"), ("b", 1, "sitemapindex"), ("b", 2, "cycle"), ("c", 1, "sitemapindex"), ("c", 2, "cycle"), ("d", 2, "urlset")]
    assert [x.loc for x in entries.collect()] == ["u"]
    # Met twice without a cycle: read once, no error.
    bodies = spark.createDataFrame([("a", index("b", "c")), ("b", index("c")), ("c", b"<urlset></urlset>")], "url string, body binary")
    maps, _ = documents.expand_sitemaps(bodies, spark.createDataFrame([("a",)], "url string"))
    assert sorted((x.url, x.state) for x in maps.collect()) == [("a", "sitemapindex"), ("b", "sitemapindex"), ("c", "urlset")]


def test_crawl_tries_again_when_the_queue_is_empty(spark):
    links = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate([("s", "x"), ("s", "y"), ("x", "deep"), ("y", "z"), ("z", "w"), ("f", "never")])], "a string, b string, position long")
    tries = spark.createDataFrame([("x", 1, "retryable"), ("x", 2, "ok"), ("f", 1, "failed"), ("w", 1, "retryable"), ("w", 2, "retryable"), ("w", 3, "retryable")], "id string, attempt int, outcome string")

    def run(*seeds, depth=9, pages=99):
        got, reason = frontier.crawl(links, tries, roots(spark, *seeds), depth, pages)
        return [(x.id, x.depth, x.attempts, x.outcome) for x in got.orderBy("number").collect()], reason

    whole = [("s", 0, 1, "ok"), ("f", 0, 1, "failed"), ("x", 1, 2, "ok"), ("y", 1, 1, "ok"), ("z", 2, 1, "ok"), ("w", 3, 3, "retryable"), ("deep", 2, 1, "ok")]
    assert run("s", "f") == (whole, "queue_exhausted")
    assert run("s", "f", depth=1) == (whole[:4], "queue_exhausted")
    assert run("s", "f", pages=5) == (whole[:5], "queue_exhausted")
    assert run("s", "f", pages=1) == (whole[:1], "page_limit_reached")
