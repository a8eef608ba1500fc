"""Queries that read the named lists, each by its own filters and one of its sorts, over columns made from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, lists, observations, projection, rules
from ..sources.fixtures import Views
from .book import Book

BOOK = Book()

PAGES = {"pages_list": "SELECT s.id, s.scan_id, r.normalized_url AS requested_url, CAST(NULL AS VARCHAR) AS final_url, r.host AS page_title, lower(r.host) AS host, '/' || r.host AS path, http_status, crawl_depth, response_time_ms, CASE WHEN fetch_state = 'P' THEN 'timeout' END AS error_type, 'text/html' AS content_type, CASE WHEN s.id % 3 = 0 THEN 'captured' END AS rendered_state, coalesce(n.inbound, 0) AS inbound_occurrences FROM snapshots s JOIN resources r ON r.id = s.resource_id LEFT JOIN (SELECT target_resource_id, count(*) AS inbound FROM occurrences GROUP BY 1) n ON n.target_resource_id = s.resource_id"}


def _pages(v: Views) -> DataFrame:
    r = v.resources().select(F.col("id").alias("resource_id"), "normalized_url", "host")
    s = lists.counts_for_order(v.snapshots().join(r, "resource_id"), "resource_id", inbound_occurrences=(v.occurrences(), "target_resource_id"))
    return s.select(
        "id", "scan_id", F.col("normalized_url").alias("requested_url"), F.lit(None).cast("string").alias("final_url"), F.col("host").alias("page_title"), F.lower("host").alias("host"), F.concat(F.lit("/"), "host").alias("path"), "http_status", "crawl_depth", "response_time_ms",
        F.when(F.col("fetch_state") == "P", "timeout").alias("error_type"), F.lit("text/html").alias("content_type"), F.when(F.col("id") % 3 == 0, "captured").alias("rendered_state"), "inbound_occurrences",
    )


@BOOK.query("SELECT id, requested_url, inbound_occurrences FROM pages_list WHERE requested_url ILIKE '%1%' AND host = 'building' AND crawl_depth BETWEEN 2 AND 4 AND error_type IS NULL AND rendered_state IS NULL AND path ILIKE '/build%' ORDER BY inbound_occurrences DESC, id DESC LIMIT 200", "snapshots", "resources", "occurrences", extra=PAGES)
def list_pages(v: Views) -> DataFrame:
    return lists.PAGES.read(_pages(v), "inbound", True, 200, search="1", host="BUILDING", min_depth=2, max_depth=4, error_state="without_errors", rendered_state="not_requested", path_prefix="/build").select("id", "requested_url", "inbound_occurrences")


@BOOK.query("SELECT id, http_status FROM pages_list WHERE error_type IS NOT NULL AND crawl_depth = 3 ORDER BY http_status NULLS FIRST, id LIMIT 100 OFFSET 5", "snapshots", "resources", "occurrences", extra=PAGES)
def list_pages_with_errors(v: Views) -> DataFrame:
    return lists.PAGES.read(_pages(v), "status", False, 100, 5, depth=3, error_state="with_errors").select("id", "http_status")


def _links(v: Views) -> DataFrame:
    """Link occurrences with their sources; a key of order and line stands for an id."""
    line, order = v.table("lineitem"), v.table("orders")
    s = v.snapshots().select(F.col("id").alias("l_orderkey"), "http_status", "crawl_depth")
    o = order.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("page_title"), F.concat(F.lit("https://site.test/"), F.col("o_custkey").cast("string")).alias("requested_url"))
    return line.join(s, "l_orderkey").join(o, "l_orderkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "http_status", "crawl_depth", "requested_url", F.lit(None).cast("string").alias("final_url"), "page_title", F.concat(F.lit("Anchor "), F.col("l_linenumber").cast("string")).alias("anchor_text"),
        F.concat(F.lit("/p/"), F.col("l_partkey").cast("string")).alias("raw_href"), F.concat(F.lit("https://site.test/p/"), F.col("l_partkey").cast("string")).alias("resolved_url"), F.col("l_linestatus").alias("scope_decision"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("link_role"), F.when(F.col("l_tax") == 0, "nofollow noopener").otherwise("").alias("rel"), F.col("l_shipdate").alias("discovered_at"),
    )


LINKS = {
    "links": """SELECT l_orderkey * 10 + l_linenumber AS id, s.http_status, s.crawl_depth, 'https://site.test/' || o_custkey AS requested_url, CAST(NULL AS VARCHAR) AS final_url, o_orderpriority AS page_title, 'Anchor ' || l_linenumber AS anchor_text, '/p/' || l_partkey AS raw_href,
    'https://site.test/p/' || l_partkey AS resolved_url, l_linestatus AS scope_decision, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS link_role, CASE WHEN l_tax = 0 THEN 'nofollow noopener' ELSE '' END AS rel, l_shipdate AS discovered_at
    FROM lineitem JOIN snapshots s ON s.id = l_orderkey JOIN orders ON o_orderkey = l_orderkey"""
}


@BOOK.query("SELECT id, requested_url, http_status FROM links WHERE (requested_url ILIKE '%12%' OR page_title ILIKE '%12%' OR anchor_text ILIKE '%12%' OR raw_href ILIKE '%12%' OR resolved_url ILIKE '%12%') AND scope_decision = 'O' AND rel ILIKE '%noopener%' AND link_role IS NULL ORDER BY coalesce(final_url, requested_url) DESC, id DESC LIMIT 250", "snapshots", extra=LINKS)
def list_inbound_links(v: Views) -> DataFrame:
    return lists.INBOUND.read(_links(v), "source_url", True, 250, search="12", scope="O", rel="NoOpener", link_role="legacy_unclassified").select("id", "requested_url", "http_status")


@BOOK.query("SELECT id, discovered_at, raw_href FROM links WHERE (anchor_text ILIKE '%/p/7%' OR raw_href ILIKE '%/p/7%' OR resolved_url ILIKE '%/p/7%') AND link_role = 'R' ORDER BY discovered_at, id LIMIT 250", "snapshots", extra=LINKS)
def list_outgoing_links(v: Views) -> DataFrame:
    return lists.OUTGOING.read(_links(v), "discovered_at", False, 250, search="/p/7", link_role="R").select("id", "discovered_at", "raw_href")


INVENTORY = {
    "inv": """SELECT target_resource_id AS resource_id, any_value(normalized_url) AS normalized_url, any_value(lower(host)) AS host, any_value('/' || normalized_url) AS path, CASE WHEN target_resource_id % 2 = 0 THEN 'image' ELSE 'document' END AS kind, 'image/x-' || target_resource_id % 4 AS mime_type, count(*) AS occurrence_count,
    count(DISTINCT source_resource_id) AS source_page_count, count(*) FILTER (WHERE in_scope) AS in_scope_count, count(*) FILTER (WHERE NOT in_scope) AS out_scope_count, count(*) FILTER (WHERE link_role = 'R') AS observed_count, target_resource_id * 10 AS declared_size
    FROM occurrences JOIN resources ON resources.id = target_resource_id GROUP BY target_resource_id"""
}


def _inventory(v: Views) -> DataFrame:
    r = v.resources().select(F.col("id").alias("resource_id"), "normalized_url", F.lower("host").alias("host"))
    o = v.occurrences().withColumnRenamed("target_resource_id", "resource_id")
    n = o.groupBy("resource_id").agg(F.count("*").alias("occurrence_count"), F.countDistinct("source_resource_id").alias("source_page_count"), F.count_if("in_scope").alias("in_scope_count"), F.count_if(~F.col("in_scope")).alias("out_scope_count"), F.count_if(F.col("link_role") == "R").alias("observed_count"))
    kind = F.when(F.col("resource_id") % 2 == 0, "image").otherwise("document")
    return n.join(r, "resource_id").select("*", F.concat(F.lit("/"), "normalized_url").alias("path"), kind.alias("kind"), F.concat(F.lit("image/x-"), (F.col("resource_id") % 4).cast("string")).alias("mime_type"), (F.col("resource_id") * 10).alias("declared_size"))


@BOOK.query(
    "SELECT resource_id, occurrence_count, source_page_count FROM inv WHERE kind = 'image' AND mime_type ILIKE '%X-2%' AND observed_count > 0 AND out_scope_count > 0 AND declared_size >= 100 AND declared_size <= 100000 AND source_page_count > 1 AND host <> 'brand#13' AND (normalized_url ILIKE '%a%' OR path ILIKE '%a%') ORDER BY occurrence_count DESC, resource_id LIMIT 250",
    "snapshots", "occurrences", "resources", extra=INVENTORY,
)
def list_resources(v: Views) -> DataFrame:
    asked = dict(kind="image", mime_type="X-2", evidence_state="observed", scope_state="out_of_scope", min_size=100, max_size=100_000, multiple_sources=True, external_to="Brand#13", search="A")
    return lists.RESOURCES.read(_inventory(v), "occurrence_count", True, 250, **asked).select("resource_id", "occurrence_count", "source_page_count")


def _stored(v: Views, scan_id: int, rows: DataFrame) -> DataFrame:
    """``rows`` as a validated, active build, read back; filters and columns are pushed into its files."""
    store = projection.ProjectionStore(v.spark, projection.shared_folder(v.spark, "projection"))
    store.build("first", scan_id, rows)
    return store.read(scan_id, lambda: rows)


@BOOK.query(
    "SELECT resource_id, occurrence_count, source_page_count FROM inv WHERE kind = 'image' AND mime_type ILIKE '%X-2%' AND observed_count > 0 AND out_scope_count > 0 AND declared_size >= 100 AND declared_size <= 100000 AND source_page_count > 1 AND host <> 'brand#13' AND (normalized_url ILIKE '%a%' OR path ILIKE '%a%') ORDER BY occurrence_count DESC, resource_id LIMIT 250",
    "snapshots", "occurrences", "resources", extra=INVENTORY,
)
def list_resources_projected(v: Views) -> DataFrame:
    """The same list over a stored build of the inventory."""
    asked = dict(kind="image", mime_type="X-2", evidence_state="observed", scope_state="out_of_scope", min_size=100, max_size=100_000, multiple_sources=True, external_to="Brand#13", search="A")
    return lists.RESOURCES.read(_stored(v, 0, _inventory(v)), "occurrence_count", True, 250, **asked).select("resource_id", "occurrence_count", "source_page_count")


@BOOK.query("SELECT id, requested_url, inbound_occurrences FROM pages_list WHERE requested_url ILIKE '%1%' AND host = 'building' AND crawl_depth BETWEEN 2 AND 4 AND error_type IS NULL AND rendered_state IS NULL AND path ILIKE '/build%' ORDER BY inbound_occurrences DESC, id DESC LIMIT 200", "snapshots", "resources", "occurrences", extra=PAGES)
def list_pages_projected(v: Views) -> DataFrame:
    """The same list over a stored build of the pages."""
    return lists.PAGES.read(_stored(v, 0, _pages(v)), "inbound", True, 200, search="1", host="BUILDING", min_depth=2, max_depth=4, error_state="without_errors", rendered_state="not_requested", path_prefix="/build").select("id", "requested_url", "inbound_occurrences")


def projected_reads(v: Views) -> dict[str, Callable[[], DataFrame]]:
    """The projected lists as what they are meant for: reads of builds that were made before. For the bench."""
    resources, pages = _stored(v, 0, _inventory(v)), _stored(v, 0, _pages(v))
    asked = dict(kind="image", mime_type="X-2", evidence_state="observed", scope_state="out_of_scope", min_size=100, max_size=100_000, multiple_sources=True, external_to="Brand#13", search="A")
    of_pages = dict(search="1", host="BUILDING", min_depth=2, max_depth=4, error_state="without_errors", rendered_state="not_requested", path_prefix="/build")
    return {
        "read_resources_projected": lambda: lists.RESOURCES.read(resources, "occurrence_count", True, 250, **asked).select("resource_id", "occurrence_count", "source_page_count"),
        "read_pages_projected": lambda: lists.PAGES.read(pages, "inbound", True, 200, **of_pages).select("id", "requested_url", "inbound_occurrences"),
        "read_resource_summary_projected": lambda: resources.groupBy("kind").agg(F.count("*").alias("n"), F.sum("occurrence_count").alias("occurrences")),
    }


EDGES = {
    "sides": "SELECT scan_id, source_resource_id AS s, target_resource_id AS t, count(*) AS n, count(*) FILTER (WHERE link_role = 'A') AS a FROM dense WHERE scan_id IN (1995, 1996) GROUP BY 1, 2, 3",
    "diffs": """SELECT coalesce(b.s, g.s) * 100 + coalesce(b.t, g.t) AS id, CASE WHEN b.s IS NULL THEN 'newly_observed' WHEN g.s IS NULL THEN 'not_observed' ELSE 'observed_in_both' END AS presence_state, coalesce(b.a, 0) AS ba, coalesce(g.a, 0) AS ta, coalesce(b.n, 0) AS baseline_occurrence_count, coalesce(g.n, 0) AS target_occurrence_count
    FROM (SELECT * FROM sides WHERE scan_id = 1995) b FULL JOIN (SELECT * FROM sides WHERE scan_id = 1996) g ON b.s = g.s AND b.t = g.t""",
}


def _compared_links(v: Views) -> DataFrame:
    """Edges of two scans side by side, with their counts by role as maps."""
    o = v.occurrences(dense=True).where("scan_id in (1995, 1996)").groupBy(F.col("source_resource_id").alias("s"), F.col("target_resource_id").alias("t"), "scan_id", "link_role").agg(F.count("*").alias("n"))
    edge = o.groupBy("s", "t", "scan_id").agg(F.map_from_entries(F.collect_list(F.struct("link_role", "n"))).alias("roles"), F.sum("n").alias("n"))
    base, target = (edge.where(F.col("scan_id") == y).select("s", "t", F.col("roles").alias(f"{side}_roles"), F.col("n").alias(f"{side}_occurrence_count")) for side, y in (("baseline", 1995), ("target", 1996)))
    both = base.join(target, ["s", "t"], "full")
    presence = F.when(F.col("baseline_roles").isNull(), "newly_observed").when(F.col("target_roles").isNull(), "not_observed").otherwise("observed_in_both")
    both = both.fillna(0, subset=["baseline_occurrence_count", "target_occurrence_count"])
    return both.select((F.col("s") * 100 + F.col("t")).alias("id"), presence.alias("presence_state"), "baseline_roles", "target_roles", "baseline_occurrence_count", "target_occurrence_count", (F.col("target_occurrence_count") - F.col("baseline_occurrence_count")).alias("occurrence_delta"))


@BOOK.query("SELECT id, presence_state, target_occurrence_count - baseline_occurrence_count AS occurrence_delta FROM diffs WHERE presence_state = 'observed_in_both' AND (ba > 0 OR ta > 0) AND abs(target_occurrence_count - baseline_occurrence_count) >= 1 ORDER BY 3 DESC, id LIMIT 250", "dense", extra=EDGES)
def list_compared_links(v: Views) -> DataFrame:
    return lists.COMPARED_LINKS.read(_compared_links(v), "occurrence_delta", True, 250, presence="observed_in_both", role="A", min_occurrence_delta=1).select("id", "presence_state", "occurrence_delta")


SITE_PAGES = {"site_pages": "SELECT c_custkey AS id, c_name AS normalized_url, c_mktsegment AS path, lower(c_mktsegment) AS host, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'owner ' || c_nationkey END AS owner_label, CASE WHEN c_nationkey % 2 = 0 THEN 'review' ELSE 'done' END AS workflow_status, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS observation_count, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS note_count FROM customer"}


def _site_pages(v: Views) -> DataFrame:
    c = v.table("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("normalized_url"), F.col("c_mktsegment").alias("path"), F.lower("c_mktsegment").alias("host"), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("owner "), F.col("c_nationkey").cast("string"))).alias("owner_label"),
        F.when(F.col("c_nationkey") % 2 == 0, "review").otherwise("done").alias("workflow_status"),
    )
    return lists.counts_for_order(c, "id", observation_count=(v.table("orders"), "o_custkey"), note_count=(v.table("events"), "user_id"))


@BOOK.query("SELECT id, observation_count, note_count FROM site_pages WHERE workflow_status = 'review' AND owner_label ILIKE '%1%' AND observation_count >= 3 AND path LIKE 'B%' ORDER BY note_count DESC, id LIMIT 250", extra=SITE_PAGES)
def list_site_pages(v: Views) -> DataFrame:
    return lists.SITE_PAGES.read(_site_pages(v), "notes", True, 250, workflow="review", owner="1", min_observations=3, path_prefix="B").select("id", "observation_count", "note_count")


@BOOK.query("SELECT id, observation_count FROM site_pages WHERE owner_label IS NULL AND (normalized_url ILIKE '%9%' OR path ILIKE '%9%') ORDER BY observation_count, id LIMIT 250", extra=SITE_PAGES)
def list_unowned_pages(v: Views) -> DataFrame:
    return lists.SITE_PAGES.read(_site_pages(v), "observations", False, 250, unassigned_owner=True, search="9").select("id", "observation_count")


@BOOK.query("SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS scan_count FROM nation WHERE (n_name ILIKE '%an%') AND n_regionkey = 2 ORDER BY scan_count DESC, id DESC LIMIT 50")
def list_sites(v: Views) -> DataFrame:
    n = v.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("base_url"), F.lit("").alias("description"), F.col("n_regionkey").alias("group_key"))
    return lists.SITES.read(lists.counts_for_order(n, "id", scan_count=(v.table("customer"), "c_nationkey")), "scan_count", True, search="AN", group=2).select("id", "name", "scan_count")


@BOOK.query("SELECT p_partkey AS id, p_name AS normalized_url FROM part WHERE p_retailprice > 1000 AND p_size % 3 = 0 AND (p_name ILIKE '%a%' OR p_type ILIKE '%a%') ORDER BY p_name DESC, id LIMIT 250")
def list_source_entries(v: Views) -> DataFrame:
    e = v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("normalized_url"), F.col("p_type").alias("raw_url"), (F.col("p_retailprice") > 1000).alias("is_current"), (F.col("p_size") % 3).alias("source_type"))
    return lists.SOURCE_ENTRIES.read(e, "url", True, 250, search="a", current_state="current", source_type=0).select("id", "normalized_url")


RENDERED = {"rendered": "SELECT event_id AS id, user_id, event_type AS capture_state, CAST(value AS BIGINT) % 4 AS warning_count, CAST(value AS BIGINT) % 3 AS page_error_count, CAST(value AS BIGINT) % 5 AS console_message_count, CAST(value AS BIGINT) % 2 AS blocked_request_count, CASE WHEN user_id % 2 = 0 THEN 1 END AS viewport, CASE WHEN user_id % 3 = 0 THEN 1 END AS full_page, 0 AS dom, ts AS finished_at FROM (SELECT * REPLACE (floor(value) AS value) FROM events)"}


@BOOK.query("SELECT id, coalesce(viewport, 0) + coalesce(full_page, 0) + dom + console_message_count + blocked_request_count AS score FROM rendered WHERE capture_state = 'click' AND warning_count > 0 AND page_error_count = 0 AND viewport = 1 AND full_page IS NULL ORDER BY score DESC, id LIMIT 250", extra=RENDERED)
def list_rendered(v: Views) -> DataFrame:
    n = F.floor("value")
    e = v.table("events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("capture_state"), (n % 4).alias("warning_count"), (n % 3).alias("page_error_count"), (n % 5).alias("console_message_count"), (n % 2).alias("blocked_request_count"), F.when(F.col("user_id") % 2 == 0, 1).alias("viewport"),
        F.when(F.col("user_id") % 3 == 0, 1).alias("full_page"), F.lit(0).alias("dom"),
    )
    out = lists.RENDERED.read(e, "browser_evidence", True, 250, capture_state="click", has_warnings=True, has_page_errors=False, has_viewport_screenshot=True, has_full_page_screenshot=False)
    return out.select("id", lists.RENDERED.sorts["browser_evidence"]().cast("long").alias("score"))


@BOOK.query(
    """SELECT resource_id AS page_id, any_value(outcome) FILTER (WHERE profile = 'click') AS desktop_outcome, CAST(coalesce(sum(v) FILTER (WHERE profile = 'click'), 0) AS BIGINT) AS desktop_violations FROM (SELECT *, CAST(floor(metric) AS BIGINT) % 4 AS v FROM (SELECT *, row_number() OVER (PARTITION BY resource_id, profile ORDER BY observed_at DESC, id DESC) AS rn FROM observations) WHERE rn = 1) GROUP BY 1
    HAVING (any_value(outcome) FILTER (WHERE profile = 'click') = 'ready' OR any_value(outcome) FILTER (WHERE profile = 'view') = 'ready') AND (coalesce(sum(v) FILTER (WHERE profile = 'click'), 0) > 0 OR coalesce(sum(v) FILTER (WHERE profile = 'view'), 0) > 0) ORDER BY desktop_violations DESC, page_id LIMIT 250""",
    "observations",
)
def list_accessibility_pages(v: Views) -> DataFrame:
    latest = observations.latest_per_key(v.observations(), ["resource_id", "profile"]).withColumn("v", F.floor("metric") % 4)
    own = [F.max(F.when(F.col("profile") == p, F.col("outcome"))).alias(f"{n}_outcome") for n, p in (("desktop", "click"), ("mobile", "view"))]
    own += [F.coalesce(F.sum(F.when(F.col("profile") == p, F.col("v"))), F.lit(0)).alias(f"{n}_violations") for n, p in (("desktop", "click"), ("mobile", "view"))]
    rows = latest.groupBy(F.col("resource_id").alias("page_id")).agg(*own)
    return lists.ACCESSIBILITY_PAGES.read(rows, "desktop", True, 250, outcome="ready", has_violations=True).select("page_id", "desktop_outcome", "desktop_violations")


@BOOK.query("SELECT s.id, s.resource_id FROM (SELECT s.*, row_number() OVER (ORDER BY CASE WHEN s.id = 33 THEN 0 ELSE 1 END, s.crawl_depth NULLS FIRST, s.fetched_at NULLS FIRST, s.id) AS rn FROM snapshots s WHERE s.scan_id = 1996 AND s.fetch_state <> 'P' AND s.resource_id % 2 = 0) s WHERE rn <= 100", "snapshots")
def render_candidates(v: Views) -> DataFrame:
    s = v.snapshots().where("scan_id = 1996").select("id", "resource_id", "crawl_depth", "fetched_at", F.when(F.col("fetch_state") == "P", "failed").otherwise("ok").alias("fetch_state"), F.col("id").alias("html_blob_id"), F.col("id").cast("string").alias("final_url"), F.col("id").cast("string").alias("requested_url"))
    return lists.render_candidates(s, "33", F.col("resource_id") % 2 == 0).select("id", "resource_id")


@BOOK.query("SELECT o.resource_id, o.id, o.observed_at FROM observations o JOIN (SELECT resource_id, max(observed_at) AS observed_at FROM observations GROUP BY 1) m ON m.resource_id = o.resource_id AND m.observed_at = o.observed_at", "observations")
def latest_with_ties(v: Views) -> DataFrame:
    return observations.latest_ties(v.observations(), ["resource_id"]).select("resource_id", "id", "observed_at")


@BOOK.query("SELECT l.l_orderkey AS node_id, o.o_orderpriority AS rule, c.c_mktsegment AS outcome, n.n_name AS page FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE c.c_mktsegment = 'BUILDING' AND l.l_quantity > 45")
def rule_occurrences(v: Views) -> DataFrame:
    """Nodes with their rule, observation and page (line items, orders, customers, nations)."""
    nodes = v.table("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("node_id"), F.col("l_orderkey").alias("rule_row_id"))
    found = v.table("orders").select(F.col("o_orderkey").alias("rule_row_id"), F.col("o_custkey").alias("observation_id"), F.col("o_orderpriority").alias("rule"))
    seen = v.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("observation_id"), F.col("c_nationkey").alias("resource_id"), F.col("c_mktsegment").alias("outcome"))
    pages = v.table("nation").select(F.col("n_nationkey").alias("resource_id"), F.col("n_name").alias("page"))
    return evidence.rule_occurrences(nodes, found, seen, pages).select("node_id", "rule", "outcome", "page")


@BOOK.query("SELECT p_partkey AS site_page_id, p_size AS category_id, CASE WHEN p_size > 25 AND p_partkey % 2 = 0 THEN 'kept' WHEN p_size > 25 THEN 'added' ELSE 'removed' END AS action FROM part WHERE p_size > 25 OR p_partkey % 2 = 0")
def bulk_assignment(v: Views) -> DataFrame:
    """Parts of a large size are to have it as their category, even ones have it, the others are to lose it."""
    p = v.table("part").select(F.col("p_partkey").alias("site_page_id"), F.col("p_size").alias("category_id"))
    return rules.bulk_assign(p.where("site_page_id % 2 = 0"), add=p.where("category_id > 25"), remove=p.where("category_id <= 25"))


# ---- the other lists, each with rows ----


@BOOK.query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, id DESC LIMIT 200")
def list_scans(v: Views) -> DataFrame:
    o = v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return lists.SCANS.read(o, "created_at", True, 200, status="F").select("id", "status")


@BOOK.query("SELECT o_orderkey AS id, round(CAST(o_totalprice AS DOUBLE), 3) AS seconds FROM orders ORDER BY o_totalprice DESC, id DESC LIMIT 100")
def list_scans_by_duration(v: Views) -> DataFrame:
    begun = F.lit("1996-01-01 00:00:00").cast("timestamp")
    o = v.table("orders").select(F.col("o_orderkey").alias("id"), F.lit("F").alias("status"), begun.alias("started_at"), F.timestamp_micros((F.unix_micros(begun) + F.round(F.col("o_totalprice").cast("double") * 1_000_000).cast("long")).cast("long")).alias("finished_at"))
    return lists.SCANS.read(o, "duration", True, 100).select("id", F.round(((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1_000_000).cast("double"), 3).alias("seconds"))


@BOOK.query("SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS scan_count FROM nation WHERE n_name ILIKE '%a%' AND n_nationkey % 3 <> 0 ORDER BY scan_count DESC, id DESC LIMIT 50")
def list_active_sites(v: Views) -> DataFrame:
    n = v.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("base_url"), F.lit("").alias("description"), (F.col("n_nationkey") % 3 != 0).alias("is_active"))
    return lists.SITES.read(lists.counts_for_order(n, "id", scan_count=(v.table("customer"), "c_nationkey")), "scan_count", True, search="A", state="active").select("id", "name", "scan_count")


@BOOK.query("SELECT p_partkey AS id, p_name AS normalized_url FROM part WHERE p_partkey % 2 = 0 AND p_size % 3 = 1 AND (p_name ILIKE '%a%' OR p_type ILIKE '%a%') ORDER BY p_name DESC, id LIMIT 250")
def list_current_source_entries(v: Views) -> DataFrame:
    e = v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("normalized_url"), F.col("p_type").alias("raw_url"), (F.col("p_partkey") % 2 == 0).alias("is_current"), (F.col("p_size") % 3).alias("source_type"))
    return lists.SOURCE_ENTRIES.read(e, "url", True, 250, search="a", current_state="current", source_type=1).select("id", "normalized_url")


@BOOK.query("SELECT doc_id AS id, n_chars AS size FROM documents WHERE lang = 'en' AND doc_id % 4 = 1 ORDER BY n_chars DESC NULLS LAST, id DESC LIMIT 250")
def list_documents(v: Views) -> DataFrame:
    d = v.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("requested_url"), F.lit(None).cast("string").alias("final_url"), F.lit("").alias("parsed_title"), F.col("lang").alias("document_kind"), (F.col("doc_id") % 4).alias("parent_depth_min"), F.col("n_chars").alias("network_bytes_transferred"))
    return lists.DOCUMENTS.read(d, "size", True, 250, kind="en", depth=1).select("id", F.col("network_bytes_transferred").alias("size"))


@BOOK.query("SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R' AND l_tax = 0 ORDER BY id LIMIT 250")
def list_document_references(v: Views) -> DataFrame:
    r = v.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), (F.col("l_linestatus") == "O").alias("in_scope"), (F.col("l_returnflag") == "R").alias("optional"), F.when(F.col("l_tax") == 0, F.col("l_orderkey")).alias("child_snapshot_id"))
    return lists.DOCUMENT_REFERENCES.read(r, "position", False, 250, in_scope=True, optional=False, fetched=True).select("id")


@BOOK.query("SELECT event_id AS id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 250")
def list_network(v: Views) -> DataFrame:
    e = v.table("events").select(F.col("event_id").alias("id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("resource_type"), F.lit("").alias("redacted_url"))
    return lists.NETWORK.read(e, "sequence", False, 250, resource_type="click").select("id")


@BOOK.query("SELECT event_id AS id FROM events WHERE event_type ILIKE '%ic%' ORDER BY event_id LIMIT 250")
def list_console_messages(v: Views) -> DataFrame:
    e = v.table("events").select(F.col("event_id").alias("id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("text"), F.lit("log").alias("message_type"))
    return lists.CONSOLE.read(e, "sequence", False, 250, search="IC", message_type="log").select("id")


@BOOK.query("SELECT o_orderkey AS id, o_custkey - o_orderkey % 100 AS delta FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY delta DESC, id DESC LIMIT 100")
def list_rule_runs(v: Views) -> DataFrame:
    o = v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("trigger_type"), F.col("o_custkey").alias("rule_supports_added"), (F.col("o_orderkey") % 100).alias("rule_supports_removed"))
    return lists.RULE_RUNS.read(o, "supports_delta", True, 100, status="O", trigger="1-URGENT").select("id", (F.col("rule_supports_added") - F.col("rule_supports_removed")).alias("delta"))


@BOOK.query("SELECT p_partkey AS id, n AS condition_count FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_partkey % 2 = 1 AND p_name ILIKE '%o%' AND p_size < 30 ORDER BY n, id LIMIT 100")
def list_rules(v: Views) -> DataFrame:
    p = v.table("part").where("p_size < 30").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 2 == 1).alias("is_active"))
    rows = lists.counts_for_order(p, "id", condition_count=(v.table("lineitem"), "l_partkey")).where("condition_count > 0")
    return lists.RULES.read(rows, "condition_count", False, 100, search="O", state="active").select("id", "condition_count")


@BOOK.query("SELECT id, resource_id FROM snapshots WHERE http_status = 200 AND scan_id = 1995 ORDER BY fetched_at DESC, id LIMIT 250", "snapshots")
def list_page_history(v: Views) -> DataFrame:
    s = v.snapshots().withColumn("website_property_id", F.col("scan_id"))
    return lists.HISTORY.read(s, "fetched_at", True, 250, http_status=200, site=1995).select("id", "resource_id")


@BOOK.query("SELECT n_nationkey AS id FROM nation ORDER BY n_name LIMIT 20")
def list_categories(v: Views) -> DataFrame:
    return lists.CATEGORIES.read(v.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("normalized_name")), "name", False, 20).select("id")
