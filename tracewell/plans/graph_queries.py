"""Queries over the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, graph, projected
from ..operators.projection import shared_folder, stored
from ..sources.fixtures import Views
from .book import Book

BOOK = Book()
SCAN = 1996
STAMP = "yyyy-MM-dd HH:mm:ss"

EDGES = """SELECT o.scan_id, o.source_snapshot_id, o.source_resource_id, o.target_resource_id, t.id AS target_snapshot_id, count(*) AS occurrence_count,
    count(DISTINCT nullif(trim(anchor_text), '')) AS unique_anchor_text_count, count(*) FILTER (WHERE rel ILIKE '%nofollow%') AS nofollow_occurrence_count,
    count(*) FILTER (WHERE anchor_text IS NULL OR trim(anchor_text) = '') AS empty_anchor_occurrence_count, strftime(min(discovered_at), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(discovered_at), '%Y-%m-%d %H:%M:%S') AS last_seen,
    count(*) FILTER (WHERE dom_path LIKE '%header%') AS header_dom_count, count(*) FILTER (WHERE dom_path LIKE '%footer%' AND dom_path NOT LIKE '%header%') AS footer_dom_count,
    count(*) FILTER (WHERE dom_path LIKE '%nav%' AND dom_path NOT LIKE '%header%' AND dom_path NOT LIKE '%footer%') AS nav_dom_count,
    count(*) FILTER (WHERE dom_path LIKE '%aside%') AS aside_dom_count, count(*) FILTER (WHERE dom_path LIKE '%main%') AS main_dom_count, count(*) FILTER (WHERE dom_path = 'html/body/div/a') AS body_dom_count
    FROM {src} o LEFT JOIN snapshots t ON t.scan_id = o.scan_id AND t.resource_id = o.target_resource_id GROUP BY ALL"""
METRICS = """SELECT s.*, coalesce(i.n, 0) AS inbound_occurrences, coalesce(i.d, 0) AS inbound_sources, coalesce(u.n, 0) AS outbound_occurrences, coalesce(u.d, 0) AS outbound_targets, r.normalized_url, r.host
    FROM snapshots s JOIN resources r ON r.id = s.resource_id
    LEFT JOIN (SELECT target_resource_id, count(*) n, count(DISTINCT source_snapshot_id) d FROM occurrences WHERE scan_id = 1996 GROUP BY 1) i ON i.target_resource_id = s.resource_id
    LEFT JOIN (SELECT source_resource_id, count(*) n, count(DISTINCT target_resource_id) d FROM occurrences WHERE scan_id = 1996 GROUP BY 1) u ON u.source_resource_id = s.resource_id WHERE s.scan_id = 1996"""


def _edges(v: Views, dense: bool) -> DataFrame:
    e = graph.edges(graph.page_links(v.occurrences(dense)), v.snapshots())
    return e.withColumn("first_seen", F.date_format("first_discovered_at", STAMP)).withColumn("last_seen", F.date_format("last_discovered_at", STAMP)).drop("first_discovered_at", "last_discovered_at")


@BOOK.query(EDGES.format(src="occurrences"), "snapshots", "occurrences")
def edge_aggregate(v: Views) -> DataFrame:
    return _edges(v, False)


@BOOK.query(EDGES.format(src="dense"), "snapshots", "dense")
def edge_aggregate_dense(v: Views) -> DataFrame:
    return _edges(v, True)


@BOOK.query("SELECT * FROM e ORDER BY source_snapshot_id, target_snapshot_id NULLS LAST, target_resource_id LIMIT 250", "snapshots", "occurrences", extra={"e": EDGES.format(src="occurrences")})
def edge_top(v: Views) -> DataFrame:
    return graph.edge_page(_edges(v, False), graph.GraphLimits().checked().edges)


@BOOK.query("SELECT count(*) AS available_edges, CAST(coalesce(sum(occurrence_count), 0) AS BIGINT) AS available_occurrences FROM e", "snapshots", "occurrences", extra={"e": EDGES.format(src="occurrences")})
def edge_evidence_totals(v: Views) -> DataFrame:
    return graph.edge_totals(_edges(v, False))


@BOOK.query("SELECT * FROM e WHERE source_snapshot_id = (SELECT min(source_snapshot_id) FROM e)", "snapshots", "dense", extra={"e": EDGES.format(src="dense")})
def single_edge_summary(v: Views) -> DataFrame:
    occurrences = v.occurrences(True)
    first = occurrences.agg(F.min("source_snapshot_id").alias("source_snapshot_id"))
    e = graph.edges(occurrences.join(F.broadcast(first), "source_snapshot_id", "left_semi"), v.snapshots())
    return e.withColumn("first_seen", F.date_format("first_discovered_at", STAMP)).withColumn("last_seen", F.date_format("last_discovered_at", STAMP)).drop("first_discovered_at", "last_discovered_at")


@BOOK.query(
    """SELECT source_snapshot_id, target_resource_id, 'role' AS kind, coalesce(link_role, 'legacy_unclassified') AS label, count(*) AS n FROM dense GROUP BY ALL
    UNION ALL SELECT source_snapshot_id, target_resource_id, 'scope', coalesce(scope_decision, 'legacy_unclassified'), count(*) FROM dense GROUP BY ALL""",
    "dense",
)
def edge_role_scope_maps(v: Views) -> DataFrame:
    return graph.edge_counters(v.occurrences(True), "role=link_role", "scope=scope_decision")


@BOOK.query(
    """SELECT source_snapshot_id, target_resource_id, array_to_string(list_sort(list(DISTINCT trim(anchor_text)))[1:5], '|') AS anchors FROM dense WHERE trim(anchor_text) <> '' GROUP BY 1, 2""",
    "dense",
)
def anchor_samples_top5(v: Views) -> DataFrame:
    return graph.anchor_samples(v.occurrences(True)).withColumn("anchors", F.array_join("anchors", "|"))


@BOOK.query(
    "SELECT id, resource_id, normalized_url, crawl_depth, inbound_sources, outbound_targets, inbound_occurrences, outbound_occurrences, rtrim(normalized_url, '/') = 'Customer#000000001' AS is_start FROM m ORDER BY is_start DESC, crawl_depth NULLS FIRST, inbound_sources DESC, outbound_targets DESC, normalized_url, id LIMIT 100",
    "snapshots", "occurrences", "resources", extra={"m": METRICS},
)
def node_topk(v: Views) -> DataFrame:
    m = graph.node_metrics(v.snapshots().where(F.col("scan_id") == SCAN), graph.page_links(v.occurrences(), SCAN), v.resources())
    return graph.node_top(m, graph.GraphLimits(), "Customer#000000001/").select("id", "resource_id", "normalized_url", "crawl_depth", "inbound_sources", "outbound_targets", "inbound_occurrences", "outbound_occurrences", "is_start")


@BOOK.query("SELECT id, http_status, fetch_state, crawl_depth, inbound_sources, outbound_targets FROM m WHERE crawl_depth BETWEEN 1 AND 3 AND http_status BETWEEN 200 AND 299 AND inbound_sources >= 1 AND outbound_targets >= 2 AND host = 'BUILDING'", "snapshots", "occurrences", "resources", extra={"m": METRICS})
def node_filters(v: Views) -> DataFrame:
    m = graph.node_metrics(v.snapshots().where(F.col("scan_id") == SCAN), graph.page_links(v.occurrences(), SCAN), v.resources())
    m = m.where(catalog.between("crawl_depth", 1, 3) & catalog.status_family("2xx") & catalog.between("inbound_sources", 1, None) & catalog.between("outbound_targets", 2, None) & (F.col("host") == "BUILDING"))
    return m.select("id", "http_status", "fetch_state", "crawl_depth", "inbound_sources", "outbound_targets")


@BOOK.query("SELECT o.scan_id, o.target_resource_id, count(*) AS inbound_occurrences, count(DISTINCT source_snapshot_id) AS inbound_sources FROM occurrences o WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.scan_id = o.scan_id AND s.resource_id = o.target_resource_id) GROUP BY 1, 2", "snapshots", "occurrences")
def discovered_nodes(v: Views) -> DataFrame:
    return graph.discovered_nodes(v.occurrences(), v.snapshots())


@BOOK.query("SELECT * FROM (SELECT o.scan_id, o.target_resource_id, count(*) AS inbound_occurrences, count(DISTINCT source_snapshot_id) AS inbound_sources FROM occurrences o WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.scan_id = o.scan_id AND s.resource_id = o.target_resource_id) GROUP BY 1, 2) ORDER BY inbound_sources DESC, inbound_occurrences DESC, scan_id, target_resource_id LIMIT 50", "snapshots", "occurrences")
def discovered_nodes_top(v: Views) -> DataFrame:
    return graph.discovered_nodes(v.occurrences(), v.snapshots(), 50)


@BOOK.query("SELECT target_resource_id, count(*) AS total, count(DISTINCT source_snapshot_id) AS sources, count(DISTINCT nullif(trim(anchor_text), '')) AS anchors, count(*) FILTER (WHERE rel = 'nofollow') AS nofollow, count(*) FILTER (WHERE source_resource_id = target_resource_id) AS self_links FROM occurrences GROUP BY 1", "occurrences")
def inbound_summary(v: Views) -> DataFrame:
    return graph.inbound_summary(v.occurrences())


@BOOK.query("SELECT source_snapshot_id, count(*) AS total, count(*) FILTER (WHERE rel = 'nofollow') AS nofollow, count(*) FILTER (WHERE in_scope) AS in_scope FROM occurrences GROUP BY 1", "occurrences")
def outgoing_summary(v: Views) -> DataFrame:
    return graph.outgoing_summary(v.occurrences())


@BOOK.query("SELECT target_resource_id, coalesce(link_role, 'legacy_unclassified') AS role, count(*) AS n FROM occurrences GROUP BY 1, 2", "occurrences")
def inbound_role_counts(v: Views) -> DataFrame:
    return graph.role_counts(v.occurrences(), "target_resource_id")


@BOOK.query("SELECT source_snapshot_id, coalesce(link_role, 'legacy_unclassified') AS role, count(*) AS n FROM occurrences GROUP BY 1, 2", "occurrences")
def outgoing_role_counts(v: Views) -> DataFrame:
    return graph.role_counts(v.occurrences(), "source_snapshot_id")


@BOOK.query("SELECT o.source_snapshot_id, o.target_resource_id, count(*) AS n FROM occurrences o WHERE o.source_snapshot_id IN (SELECT id FROM snapshots WHERE crawl_depth = 1) AND o.target_resource_id IN (SELECT id FROM resources WHERE host = 'BUILDING') GROUP BY 1, 2", "snapshots", "occurrences", "resources")
def edges_between_sets(v: Views) -> DataFrame:
    found = graph.edges_between(v.occurrences(), v.snapshots().where("crawl_depth = 1"), v.resources().where("host = 'BUILDING'"))
    return found.groupBy("source_snapshot_id", "target_resource_id").agg(F.count("*").alias("n"))


@BOOK.query("SELECT source_snapshot_id, target_resource_id, count(*) AS n FROM dense WHERE (source_snapshot_id, target_resource_id) IN (SELECT source_snapshot_id, target_resource_id FROM dense GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1, 2", "dense")
def repeated_edge_occurrences(v: Views) -> DataFrame:
    d = v.occurrences(True)
    keys = d.groupBy("source_snapshot_id", "target_resource_id").count().where("count >= 2").drop("count")
    return graph.of_edges(d, keys).groupBy("source_snapshot_id", "target_resource_id").agg(F.count("*").alias("n"))


PAIRS = "SELECT DISTINCT source_resource_id AS a, target_resource_id AS b FROM occurrences WHERE scan_id = 1996"


def _pairs(v: Views) -> DataFrame:
    return graph.page_links(v.occurrences(), SCAN).select(F.col("source_resource_id").alias("a"), F.col("target_resource_id").alias("b")).distinct()


@BOOK.query("SELECT b AS id FROM p WHERE a IN (1, 4, 7, 10) UNION SELECT a FROM p WHERE b IN (1, 4, 7, 10)", "occurrences", extra={"p": PAIRS})
def neighbour_union(v: Views) -> DataFrame:
    return graph.neighbours(_pairs(v), v.spark.createDataFrame([(1,), (4,), (7,), (10,)], "id long"))


@BOOK.query(
    "SELECT id, CAST(min(hop) AS INT) AS hop FROM (SELECT 7 AS id, 0 AS hop UNION ALL SELECT y, 1 FROM u WHERE x = 7 UNION ALL SELECT u2.y, 2 FROM u u1 JOIN u u2 ON u1.y = u2.x WHERE u1.x = 7) GROUP BY 1", "occurrences",
    extra={"p": PAIRS, "u": "SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p"},
)
def bfs_two_hops(v: Views) -> DataFrame:
    return graph.neighbourhood(_pairs(v), v.spark.createDataFrame([(7,)], "id long"), 2)


@BOOK.query(
    "SELECT * FROM (SELECT id, CAST(min(hop) AS INT) AS hop FROM (SELECT 7 AS id, 0 AS hop UNION ALL SELECT y, 1 FROM u WHERE x = 7 UNION ALL SELECT u2.y, 2 FROM u u1 JOIN u u2 ON u1.y = u2.x WHERE u1.x = 7) GROUP BY 1) ORDER BY hop, id LIMIT 20", "occurrences",
    extra={"p": PAIRS, "u": "SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p"},
)
def bfs_limited(v: Views) -> DataFrame:
    return graph.neighbourhood(_pairs(v), v.spark.createDataFrame([(7,)], "id long"), 2, 20)


@BOOK.query(
    """SELECT id, round(CAST(least(16.0, greatest(3.0, 3 + sqrt(inbound_occurrences) * 2.2)) AS DOUBLE), 6) AS size, round(CAST(least(16.0, greatest(3.0, 8.0 - crawl_depth)) AS DOUBLE), 6) AS depth_size, round(CAST(least(6.0, greatest(1.0, 1 + sqrt(outbound_occurrences))) AS DOUBLE), 6) AS width,
    CASE WHEN http_status IS NULL THEN coalesce(fetch_state, 'unknown') ELSE CAST(floor(http_status / 100) AS INT) || 'xx' END AS status_label FROM m""",
    "snapshots", "occurrences", "resources", extra={"m": METRICS},
)
def node_display(v: Views) -> DataFrame:
    m = graph.node_metrics(v.snapshots().where(F.col("scan_id") == SCAN), graph.page_links(v.occurrences(), SCAN), v.resources())
    return m.select("id", F.round(graph.node_size(F.col("inbound_occurrences")), 6).alias("size"), F.round(graph.depth_size(F.col("crawl_depth")), 6).alias("depth_size"), F.round(graph.edge_width(F.col("outbound_occurrences")), 6).alias("width"), catalog.status_label(F.col("http_status"), F.col("fetch_state")).alias("status_label"))


@BOOK.query("SELECT id, is_start FROM (SELECT resource_id AS id, resource_id = 1 AS is_start FROM snapshots WHERE scan_id = 1996) n WHERE is_start OR id IN (SELECT a FROM p UNION SELECT b FROM p)", "snapshots", "occurrences", extra={"p": PAIRS})
def nodes_without_isolates(v: Views) -> DataFrame:
    nodes = v.snapshots().where(F.col("scan_id") == SCAN).select(F.col("resource_id").alias("id"), (F.col("resource_id") == 1).alias("is_start"))
    return graph.without_isolates(nodes, _pairs(v))


@BOOK.query(
    "SELECT s.id, r.normalized_url, s.http_status, s.crawl_depth, coalesce(i.n, 0) AS inbound_occurrences FROM snapshots s JOIN resources r ON r.id = s.resource_id LEFT JOIN (SELECT target_resource_id, count(*) n FROM occurrences WHERE scan_id = 1996 GROUP BY 1) i ON i.target_resource_id = s.resource_id WHERE s.scan_id = 1996 AND lower(r.normalized_url) LIKE '%customer%' AND r.host IN ('BUILDING') AND s.http_status BETWEEN 300 AND 399 ORDER BY inbound_occurrences DESC, s.id LIMIT 50",
    "snapshots", "occurrences", "resources",
)
def page_list_filtered(v: Views) -> DataFrame:
    inbound = graph.inbound_metrics(v.occurrences().where(F.col("scan_id") == SCAN))
    pages = catalog.page_list(v.snapshots().where(F.col("scan_id") == SCAN), v.resources(), inbound)
    pages = pages.where(catalog.search_any("CUSTOMER", "normalized_url", "host") & (F.col("host") == "BUILDING") & catalog.status_family("3xx"))
    out = catalog.page(catalog.ordered(pages, {"inbound": "inbound_occurrences", "url": "normalized_url"}, "inbound", descending=True))
    return out.select("id", "normalized_url", "http_status", "crawl_depth", "inbound_occurrences")


@BOOK.query("SELECT id, response_time_ms, http_status FROM snapshots WHERE http_status IS NULL OR crawl_depth = 5 ORDER BY http_status NULLS FIRST, id LIMIT 100 OFFSET 20", "snapshots")
def page_list_second_page(v: Views) -> DataFrame:
    rows = v.snapshots().where(catalog.status_family("none") | (F.col("crawl_depth") == 5))
    return catalog.page(catalog.ordered(rows, {"status": "http_status"}, "status"), 100, 20).select("id", "response_time_ms", "http_status")


@BOOK.query("SELECT * FROM (SELECT o.source_snapshot_id, o.target_resource_id, o.anchor_text, o.link_role, row_number() OVER (ORDER BY o.anchor_text, o.source_snapshot_id, o.target_resource_id, o.link_role, o.rel, o.dom_path, o.discovered_at) AS place FROM occurrences o JOIN snapshots s ON s.id = o.source_snapshot_id WHERE o.in_scope AND s.http_status BETWEEN 200 AND 299 AND o.link_role = 'N' AND lower(o.anchor_text) LIKE '%anchor 3%') WHERE place <= 50", "snapshots", "occurrences")
def inbound_links_page(v: Views) -> DataFrame:
    from pyspark.sql import Window

    s = v.snapshots().where(catalog.status_family("2xx")).select(F.col("id").alias("source_snapshot_id"))
    rows = v.occurrences().join(s, "source_snapshot_id", "left_semi").where(catalog.search_any("anchor 3", "anchor_text") & catalog.tri_state(True, F.col("in_scope")) & (F.col("link_role") == "N"))
    keys = ["anchor_text", "source_snapshot_id", "target_resource_id", "link_role", "rel", "dom_path", "discovered_at"]
    top = catalog.page(rows.orderBy(*keys), 50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*keys)).cast("long")).select("source_snapshot_id", "target_resource_id", "anchor_text", "link_role", "place")


# ---- projected reads ----

NEAR = {
    "p": PAIRS, "u": "SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p",
    "near": "SELECT * FROM (SELECT id, CAST(min(hop) AS INT) AS hop FROM (SELECT 7 AS id, 0 AS hop UNION ALL SELECT y, 1 FROM u WHERE x = 7 UNION ALL SELECT u2.y, 2 FROM u u1 JOIN u u2 ON u1.y = u2.x WHERE u1.x = 7) GROUP BY 1) ORDER BY hop, id LIMIT 60",
    "e": "SELECT source_resource_id AS source_id, target_resource_id AS target_id, count(*) AS occurrences FROM occurrences WHERE scan_id = 1996 GROUP BY 1, 2",
    "nodes": "SELECT source_id AS id FROM e UNION SELECT target_id FROM e",
}


def _projected(v: Views) -> projected.ProjectedScan:
    """The scan's pages, links and summary, laid out by key."""
    links = graph.page_links(v.occurrences(), SCAN).groupBy(F.col("source_resource_id").alias("source_id"), F.col("target_resource_id").alias("target_id")).agg(F.count("*").alias("occurrences"))
    links = stored(links, "links")
    pages = links.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    out = projected.ProjectedScan(v.spark, shared_folder(v.spark, "projected"))
    out.write(pages, links, links.agg(F.count("*").alias("links"), F.sum("occurrences").alias("occurrences"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets")))
    return out


@BOOK.query("SELECT id, hop FROM near", "occurrences", extra=NEAR)
def projected_neighbourhood(v: Views) -> DataFrame:
    return v.spark.createDataFrame(_projected(v).around(7, 2, 60, missing_ok=True), "id long, hop int")


@BOOK.query("SELECT source_id, target_id, occurrences FROM e WHERE source_id IN (SELECT id FROM near) AND target_id IN (SELECT id FROM near)", "occurrences", extra=NEAR)
def projected_graph_links(v: Views) -> DataFrame:
    return _projected(v).graph(7, 2, 60, missing_ok=True)[1]


@BOOK.query("SELECT count(*) AS links, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM e", "occurrences", extra=NEAR)
def projected_summary(v: Views) -> DataFrame:
    return _projected(v).summary()


@BOOK.query(
    """SELECT id, coalesce(o.n, 0) AS links_out, CAST(coalesce(o.s, 0) AS BIGINT) AS links_out_occurrences, coalesce(i.n, 0) AS links_in, CAST(coalesce(i.s, 0) AS BIGINT) AS links_in_occurrences FROM (SELECT id FROM near WHERE id IN (SELECT id FROM nodes)) LEFT JOIN (SELECT source_id AS id, count(*) AS n, sum(occurrences) AS s FROM e GROUP BY 1) o USING (id)
    LEFT JOIN (SELECT target_id AS id, count(*) AS n, sum(occurrences) AS s FROM e GROUP BY 1) i USING (id)""",
    "occurrences", extra=NEAR,
)
def projected_page_details(v: Views) -> DataFrame:
    """Keyed reads of the pages around one: their links in and out."""
    p = _projected(v)
    return p.detail([i for i, _ in p.around(7, 2, 60, missing_ok=True)])
