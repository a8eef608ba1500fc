"""Presentation, category numbers, manual lines, ordered fingerprints, collisions, packed blobs and reports in small."""

from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators import compare, evidence, graph, inventory, lists, observations, presentation, retention, rules
from tracewell.sources import documents


def test_metric_rows(spark):
    rows = [
        ("crux", "lcp", 2500.0, "ms"), ("crux", "lcp", 4000.5, "ms"), ("pagespeed", "lcp", 1005.0, "ms"), ("crux", "cls", 0.1005, "score"), ("crux", "cls", 0.0, "score"), ("pagespeed", "performance_score", 0.5, "score"),
        ("pagespeed", "performance_score", 0.945, None), ("crux", "ttfb", 0.5, "ms"), ("crux", "inp", 1.5, "ms"), ("crux", "inp", 501.25, None), ("crux", "other", 1.0, "ms"), ("crux", "fcp", None, "ms"), (None, "fcp", 12.0, "frames"), ("crux", "fcp", float("nan"), "ms"),
    ]
    got = presentation.metric_rows(spark.createDataFrame(rows, "provider string, metric string, value double, unit string").withColumn("label", F.lit("own"))).collect()
    assert [(r.metric, r.position, r.formatted_value, r.assessment) for r in got] == [
        ("lcp", 3, "2.50 s", "good"), ("lcp", 3, "4.00 s", "poor"), ("lcp", 3, "1.00 s", None), ("cls", 4, "0.101", "needs_improvement"), ("cls", 4, "0", "good"), ("performance_score", 1, "50", "needs_improvement"),
        ("performance_score", 1, "94", "good"), ("ttfb", 9, "0 ms", None), ("inp", 8, "2 ms", "good"), ("inp", 8, "501.25", "poor"), ("fcp", 2, "12 frames", None),
    ]
    assert got[0].label == "Largest Contentful Paint"
    assert presentation.metric_rows(spark.createDataFrame([], "provider string, metric string, value double, unit string")).count() == 0


def test_audit_lists(spark):
    rows = [
        (1, "b", None, 0.2, "binary", 5.0, None), (1, "a", "opportunity", None, None, None, None), (1, "c", None, None, "numeric", 5.0, 9.0), (1, "d", "table", 0.9, "numeric", None, None), (1, "e", None, None, "binary", None, None),
        (1, "f", None, 0.1, "manual", None, None), (1, "speed-index", None, 0.1, "numeric", None, None), (1, "g", None, 0.9, "informative", None, None), (2, "a", None, None, None, None, 0.0),
    ]
    df = spark.createDataFrame(rows, "report_id long, audit_id string, details_type string, score double, score_mode string, savings_ms double, savings_bytes double")
    got = sorted((r.report_id, r.list, r["rank"], r.audit_id) for r in presentation.audit_lists(df, 3).collect())
    assert got == [(1, "diagnostics", 1, "d"), (1, "diagnostics", 2, "g"), (1, "diagnostics", 3, "e"), (1, "opportunities", 1, "c"), (1, "opportunities", 2, "b"), (1, "opportunities", 3, "a"), (2, "opportunities", 1, "a")]
    assert sum(r.list == "opportunities" for r in presentation.audit_lists(df, 1).collect()) == 2


def test_category_overview(spark):
    categories = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "category_id int, name string")
    assigned = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], "id int, category_id int")
    supports = spark.createDataFrame([(10, "manual"), (10, "rule"), (10, "rule"), (11, "rule"), (99, "rule"), (12, None)], "assignment_id int, support_type string")
    other = spark.createDataFrame([(1,), (1,), (3,), (None,)], "category_id int")
    got = {r.name: tuple(r)[2:] for r in rules.category_overview(categories, assigned, supports, other, other.where("category_id = 3")).collect()}
    assert got == {"a": (2, 1, 2, 2, 0), "b": (1, 0, 0, 0, 0), "c": (0, 0, 0, 1, 1)}


def test_site_pages(spark):
    pages = spark.createDataFrame([(1, "u1", "o"), (2, "u2", None), (3, "u3", "o"), (4, "u4", None)], "id int, normalized_url string, owner_label string")
    assigned = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (None, 7)], "site_page_id int, category_id int")
    notes = spark.createDataFrame([(2,), (2,), (3,)], "site_page_id int")
    ids = lambda **f: sorted(r.id for r in lists.site_pages(pages, assigned, notes, **f).collect())
    assert ids() == [1, 2, 3, 4] and ids(category=7) == [1] and ids(uncategorized=True) == [3, 4]
    assert ids(has_notes=True) == [2, 3] and ids(has_notes=False) == [1, 4] and ids(has_notes=False, uncategorized=True, unassigned_owner=True) == [4]
    assert ids(category=7, uncategorized=True) == []
    with pytest.raises(ValueError):
        ids(colour=1)


def test_node_filters(spark):
    rows = [(1, 0, "h", "/a/b", 200, "fetched", None, 3, 0), (2, 1, "h", "/a_b", 404, "failed", "timeout", None, 2), (3, 2, "k", "/c", None, "pending", None, 1, None)]
    df = spark.createDataFrame(rows, "id int, crawl_depth int, host string, path string, http_status int, fetch_state string, error_type string, inbound_occurrences long, outbound_occurrences long")
    ids = lambda **f: sorted(r.id for r in lists.NODES.where(df, **f).collect())
    assert ids(status="any") == [1, 2, 3] and ids(status="none") == [3] and ids(status="4xx") == [2] and ids(host="H") == [1, 2] and ids(path_prefix="/a/") == [1]
    assert ids(min_depth=1, max_depth=1) == [2] and ids(error_state="with_errors") == [2] and ids(error_state="without_errors") == [1, 3] and ids(min_inbound=1) == [1, 3] and ids(min_outbound=1) == [2] and ids(fetch_state="pending") == [3]


def test_content_page(spark):
    pages = spark.createDataFrame([(1, None), (2, "x"), (3, "s"), (4, "p"), (5, "u")], "id int, sha256 string")
    artifacts = spark.createDataFrame([("s", "complete", 3), ("p", "partial", 1), ("u", "unavailable", 0)], "sha256 string, extraction_state string, section_count int")
    sections = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, "c"), ("p", 0, "d")], "sha256 string, position int, heading string")
    got = sorted((r.id, r.content_status, r.total, r.heading or "") for r in evidence.content_page(pages, artifacts, sections, 2, 1).collect())
    assert got == [(1, "not_applicable", 0, ""), (2, "not_prepared", 0, ""), (3, "complete", 3, "b"), (3, "complete", 3, "c"), (4, "partial", 1, ""), (5, "unavailable", 0, "")]
    with pytest.raises(ValueError):
        evidence.content_page(pages, artifacts, sections, 0)


def test_latest_content(spark):
    s = spark.createDataFrame(
        [(1, 1, 7, "fetched", "x", 5), (2, 2, 7, "fetched", "x", None), (3, 2, 7, "failed", "x", 99), (4, 2, 7, "fetched", None, 99), (5, 1, 8, "fetched", "x", 5), (6, 1, 8, "fetched", "y", 5), (7, 3, 7, "fetched", "x", 50), (8, 1, 9, "fetched", "x", 1)],
        "id int, scan_id int, resource_id int, fetch_state string, sha256 string, fetched_at int",
    )
    scans = spark.createDataFrame([(1, 1, 1), (2, 1, 6), (3, 2, 2)], "scan_id int, site_id int, created_at int")
    mine = spark.createDataFrame([(1, 7), (1, 8), (1, 8), (2, 7)], "site_id int, resource_id int")
    assert sorted(tuple(r) for r in observations.latest_content(s, scans, mine).collect()) == [(1, 7, 2), (1, 8, 6), (2, 7, 7)]


def test_add_lines(spark):
    old = spark.createDataFrame([("k1", "old1"), ("k2", "old2"), (None, "junk")], "policy_key string, raw_url string")
    lines = spark.createDataFrame([(1, "a", "k1", True), (2, "b", "k3", True), (3, "c", "k3", True), (4, "d", "k4", False), (5, "e", "k4", False), (6, "junk", None, None), (7, "junk", None, None)], "position int, raw_url string, policy_key string, in_scope boolean")
    report, after = inventory.add_lines(old, lines)
    assert [r.outcome for r in report.orderBy("position").collect()] == ["duplicate", "accepted", "duplicate", "rejected", "duplicate", "rejected", "rejected"]
    assert sorted((r.policy_key or "", r.raw_url) for r in after.collect()) == [("", "junk")] * 3 + [("k1", "a"), ("k2", "old2"), ("k3", "c"), ("k4", "e")]
    again, _ = inventory.add_lines(after, lines)
    assert {r.outcome for r in again.where("policy_key is not null").collect()} == {"duplicate"}


def test_ordered_seed_fingerprint(spark):
    seeds = [(1, "u1", "r1", 0, "in"), (2, None, "r2", 0, "in"), (3, "u1", "r3", 1, "out")]
    origins = [(1, 1, "manual", 4, "r1", None), (2, 1, "sitemap", 5, "r1", "{}"), (3, 9, "manual", 4, "x", None)]
    s = "id int, normalized_url string, requested_url string, depth int, scope_decision string"
    o = "id int, seed_id int, origin_type string, source_id int, raw_url string, metadata string"

    def of(a, b):
        return inventory.ordered_seed_fingerprint(spark.createDataFrame(a, s).repartition(3), spark.createDataFrame(b, o)).first().fingerprint

    swapped = [(2, 1, "manual", 4, "r1", None), (1, 1, "sitemap", 5, "r1", "{}"), origins[2]]
    assert of(seeds, origins) == of(seeds[::-1], origins[::-1]) != of(seeds, swapped)
    assert len({of(seeds, origins), of(seeds[:2], origins), of(seeds, []), of([], [])}) == 4


def test_occurrence_fingerprint(spark):
    values = {f: f"v {f} é/\"" for f in compare.OCCURRENCE_FIELDS} | {"rel": None}
    df = spark.createDataFrame([values], ", ".join(f"{f} string" for f in compare.OCCURRENCE_FIELDS))
    expected = hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert df.select(compare.occurrence_fingerprint().alias("h")).first().h == expected


def test_collision_reasons_and_signals(spark):
    b = "https://h.test/a"
    groups = {
        1: [b, b], 2: [b, b + "/"], 3: [b, b + "%2Fc", b + "//c"], 4: [b + "?x=1&y=2", b + "?y=2&x=1"], 5: [b + "?x=a+b", b + "?x=a%20b"], 6: [b + "?x=%26", b + "?x=1"], 7: [b, b + "b"], 8: [b + "?x=1", b + "?x=2"], 9: ["http://h.test/a", b], 10: [b, None], 11: [b + "/%2e%2E/c", b + "/d"], 12: [b + "%23", b],
    }
    df = spark.createDataFrame([(k, u) for k, urls in groups.items() for u in urls], "resource_id int, candidate string")
    got = {r.reason: r.resources for r in retention.collision_reasons(df).collect()}
    assert got == {
        "trailing_slash_path": 1, "encoded_slash_path": 1, "repeated_slash_path": 1, "query_component_order": 1, "query_plus_percent_space": 1, "query_encoded_reserved": 1, "other_path_difference": 1, "other_query_difference": 1, "unknown": 1,
        "encoded_dot_path": 1, "other_encoded_reserved_path": 1,
    }
    urls = ["http://h.test:80/a%2Fb", "http://h.test:80/a%2Fb", "https://xn--a.test/?q=%2f&Q=1+1", "https://h.test/?k&x=%20#+", None]
    got = {r.signal: (r.rows, r.distinct_spellings) for r in retention.signal_counts(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert {k: n for k, n in got.items() if n[0]} == {
        "encoded_slash": (3, 2), "encoded_slash_in_path": (2, 1), "encoded_slash_in_query": (1, 1), "explicit_default_port": (2, 1), "idna_host": (1, 1), "repeated_query_parameter": (1, 1), "plus_in_query": (1, 1), "percent_space_in_query": (1, 1), "plus_space_ambiguity": (2, 2), "key_only_query_parameter": (1, 1),
    }
    assert {tuple(r)[1:] for r in retention.signal_counts(spark.createDataFrame([], "url string")).collect()} == {(0, 0)}


def test_gunzipped(spark, monkeypatch):
    packed = gzip.compress(b"body" * 100)
    rows = [(1, packed), (2, None), (3, packed[:-9]), (4, b"plain"), (5, packed + gzip.compress(b"more")), (6, gzip.compress(b"")), (7, b""), (8, gzip.compress(b"x" * 1001))]
    df = retention.gunzipped(spark.createDataFrame(rows, "id int, data binary").withColumn("blob_state", F.lit("own")), "data", 1000)
    assert retention.gunzipped(spark.createDataFrame([], "id int, content binary"), "content").columns == ["id", "content", "blob_state"]
    monkeypatch.setattr(retention, "UNPACKED", 500)
    got = {r.id: (r.blob_state, None if r.content is None else bytes(r.content)) for r in df.collect()}
    assert got == {1: ("stored", b"body" * 100), 2: ("missing", None), 3: ("corrupt", None), 4: ("corrupt", None), 5: ("stored", b"body" * 100 + b"more"), 6: ("stored", b""), 7: ("corrupt", None), 8: ("too_large", None)}


def test_axe_report(spark):
    rule = {"id": "r2", "impact": "serious", "description": "d", "helpUrl": "http://x", "tags": ["b", "a"], "nodes": [{"target": ["a", ["b"]], "html": "<" * 5000, "impact": None}]}
    docs = [json.dumps({"violations": [rule, {"id": "r1", "helpUrl": "https://x"}, {}], "incomplete": [rule], "passes": [{}, {}], "inapplicable": []}), "{", None, "[]", "{}"]
    got = [r.r for r in spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", documents.axe_report(F.col("d")).alias("r")).orderBy("i").collect()]
    assert [r.state for r in got] == ["ready", "malformed", "missing", "malformed", "ready"] and [len(r.rules) for r in got] == [4, 0, 0, 0, 0]
    r = got[0]
    assert (r.violation_rule_count, r.violation_node_count, r.incomplete_rule_count, r.incomplete_node_count, r.pass_rule_count, r.inapplicable_rule_count) == (3, 1, 1, 1, 2, 0)
    assert [(x.result_type, x.position, x.rule_id, x.help_url) for x in r.rules] == [("violation", 1, "", None), ("violation", 2, "r1", "https://x"), ("violation", 3, "r2", None), ("incomplete", 1, "r2", None)]
    node = r.rules[2].nodes[0]
    assert (node.position, node.target, len(node.html), node.html_original_length, node.html_truncated, node.failure_summary) == (1, ["a", '["b"]'], 4096, 5000, True, "") and r.rules[2].tags == ["a", "b"]
    value = {k: node[k] for k in ("position", "impact", "target", "html", "html_original_length", "html_truncated", "failure_summary")}
    assert node.sha256 == hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_a_report_makes_what_is_asked(spark):
    long = "<" * 4097
    htmls = ["é" * 3000, "é" * 4097, long, "<p>" + "😀" * 4093, "😀" * 4094 + "<p>", "", None, 'a"\\\n\x01']
    doc = json.dumps({"violations": [{"id": "b", "nodes": [{"html": x} for x in htmls]}, {"id": "a", "nodes": []}], "incomplete": [{"id": "a", "help": str(k)} for k in range(3)]}, ensure_ascii=False)
    picked = (("rule_id", "nodes"), ("html_truncated", "sha256"), lambda n: n["position"] == 3)
    df = spark.createDataFrame([(doc,)], "doc string").select(documents.axe_report(F.col("doc")).alias("r"), documents.axe_report(F.col("doc"), *picked).alias("p"))
    r, p = df.first()
    assert [(n.html, n.html_original_length, n.html_truncated) for n in r.rules[1].nodes] == [((x or "")[:4096], len(x or ""), len(x or "") > 4096) for x in htmls]
    assert [x.help for x in r.rules[2:]] == ["0", "1", "2"]
    value = lambda x, names: {k: ([y.asDict() for y in x[k]] if k == "nodes" else x[k]) for k in names}
    sha = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert [n.sha256 for n in r.rules[1].nodes][:7] == [sha(value(n, documents.NODE_FIELDS)) for n in r.rules[1].nodes][:7]
    assert r.rules[1].sha256 != r.rules[0].sha256 == sha(value(r.rules[0], documents.RULE_FIELDS))
    assert [x.asDict(True) for x in p.rules] == [{"rule_id": x.rule_id, "nodes": [{"html_truncated": n.html_truncated, "sha256": n.sha256 if n.position == 3 else None} for n in x.nodes]} for x in r.rules]


def test_a_report_is_an_object_or_malformed(spark):
    # Repeated names and other text than strict JSON were malformed with rules; wrong types and what follows an object count no more than before.
    docs = {'{"violations":[],"violations":[{"id":"a"}]}': ("ready", 1), "{'violations':[{'id':'a'}]}": ("malformed", 0), '{"violations":NaN}': ("malformed", 0), ' {"violations":[{"id":"a"}]} x': ("ready", 1), '[{"violations":[{"id":"a"}]}]': ("malformed", 0)}
    docs |= {'{"violations":[{}],"passes":[{"a":1,"a":2}]}': ("ready", 1)}
    docs |= {'{"violations":{"id":"a"},"incomplete":[{}],"passes":3}': ("ready", 1), '{"violations":[{"id":"a"}': ("malformed", 0), '{"violations":[{"id":"a"}],"fault":"x"}': ("ready", 1), "": ("malformed", 0), "null": ("malformed", 0), '"{"': ("malformed", 0)}
    rows = spark.createDataFrame([(d,) for d in docs], "doc string").select("doc", documents.axe_report(F.col("doc")).alias("r")).collect()
    assert {x.doc: (x.r.state, len(x.r.rules)) for x in rows} == docs


def test_reports_are_made_in_the_tasks_that_read_them(spark, tmp_path):
    from tracewell.plans.workspace_queries import _reports
    from tracewell.sources.fixtures import Views

    lines = [(1, 7, 1, 2.0, "R"), (1, 8, 2, 41.0, "A"), (1, 9, 3, 1.0, "R"), (2, 7, 2, 3.0, None), (3, None, 1, 1.0, "R"), (4, 5, None, 2.0, "N"), (5, 1, 2, None, "R"), (10, 1, 1, 1.0, "R"), (1234567890, 12345678901, 1, 0.0, "R")]
    names = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    docs = _reports(Views(spark, str(tmp_path)))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    # Lines are shuffled once and without their markup.
    assert plan.count("Exchange ") == 1 and "repeat(" in plan and "repeat(" not in plan[plan.index("Exchange ") :]
    want = {}
    for key, *values in lines:
        x = dict(zip(names[1:], values, strict=True))
        node = {"target": ["html", "body"]} | ({} if x["l_quantity"] is None else {"html": "<" * int(x["l_quantity"]) * 100}) | {"failureSummary": "fix it"}
        rule = {} if None in (x["l_partkey"], x["l_linenumber"]) else {"id": f"rule-{str(x['l_partkey'])[:9]:0>9}-{x['l_linenumber']}"}
        rule |= {"impact": "serious"} | ({} if x["l_linenumber"] is None else {"nodes": [node] * (1 + x["l_linenumber"] % 2)})
        report = want.setdefault(key, {"violations": [], "incomplete": []})
        if x["l_returnflag"] is not None:
            report["violations" if x["l_returnflag"] == "R" else "incomplete"].append(rule)
    got = {r.id: r.doc for r in docs.collect()}
    assert got.pop(10) == '{"violations":[{"id"' and got.pop(1234567890) == '{"violations":[{"id"' and want.keys() - got.keys() == {10, 1234567890}
    by_id = lambda d: {k: sorted(map(json.dumps, v)) for k, v in d.items()}
    assert {k: by_id(json.loads(d)) for k, d in got.items()} == {k: by_id(want[k]) for k in got}


def test_rule_preview(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "h" if i % 2 else None, "/", None) for i in range(1, 9)], "site_page_id int, normalized_url string, host string, path string, query string")
    rule = rules.Rule(5, 1, (rules.Condition("host", "equals", "H"),), active=False)
    held = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (3, 5), (5, 6)], "site_page_id int, rule_id int")
    barred = spark.createDataFrame([(3, 1), (5, 1), (7, 2), (4, 1)], "site_page_id int, category_id int")
    counts, samples = rules.rule_preview(pages, rule, spark.createDataFrame([(8, 1), (8, 1), (7, 2)], "site_page_id int, category_id int"), held, barred, 3, 2)
    assert counts.first().asDict() == {"total_pages": 8, "matching_pages": 4, "currently_assigned": 1, "would_gain": 1, "would_lose": 2, "excluded_matches": 2}
    assert sorted((r.site_page_id, r.matched) for r in samples.collect()) == [(1, True), (2, False), (3, True), (4, False), (5, True)]
    assert rules.rule_preview(pages.where("false"), rule, held.withColumn("category_id", F.lit(1)), held, barred)[0].first().total_pages == 0


def test_index_column_and_truncation(spark):
    df = spark.createDataFrame([(b"# T\n## Docs\n- [A](a.md): note\n", "https://e.test/x/llms.txt"), (None, "https://e.test/"), (b"\xff", None)], "data binary, base string")
    got = [r.x for r in df.select(documents.ai_index_column(F.col("data"), F.col("base")).alias("x")).collect()]
    assert (got[0].title, got[0].links[0].url, got[0].links[0].note, got[0].links[0].optional, got[0].warnings) == ("T", "https://e.test/x/a.md", "note", False, [])
    assert got[1] is None and got[2].warnings == ["invalid_utf8", "missing_title", "no_references"]
    n = spark.createDataFrame([(101, 250, None), (100, 251, 101), (None, None, None)], "n int, e int, u int").select(graph.truncated(graph.GraphLimits(), F.col("n"), F.col("e"), F.col("u")).alias("r"))
    assert [r.r for r in n.collect()] == [["node_limit"], ["edge_limit", "unfetched_node_limit"], []]


def test_packed_blobs_are_made_in_slices(spark, small):
    from tracewell.plans.workspace_queries import blob_gunzip
    from tracewell.sources.fixtures import Views

    plan = blob_gunzip(Views(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 2
