"""Queries over provider reports, indexes and sitemaps, reuse of responses, text measures, rule previews and stored links."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import compare, comparisons, evidence, graph, inventory, projection, retention, rules
from ..sources import documents
from ..sources.fixtures import Views
from . import evidence_queries
from .book import Book
from .compare_queries import BASE, TARGET, TRACKED_LINKS

BOOK = Book()

# ---- reports ----


@BOOK.query(
    """SELECT id, metric, CAST(value AS DOUBLE) AS value, unit FROM (SELECT event_id AS id, 'first-contentful-paint' AS metric, floor(value * 10) AS value, 'millisecond' AS unit FROM events UNION ALL SELECT event_id, 'speed-index', event_id, 'millisecond' FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, 'cumulative-layout-shift', 0.25, 'unitless' FROM events)
    WHERE id % 7 > 0 AND value IS NOT NULL"""
)
def lab_metrics(v: Views) -> DataFrame:
    """Lab reports: a third have no speed index, a seventh are cut, and one audit is no metric."""
    k = F.col("event_id")
    audits = F.concat_ws(
        ",", F.concat(F.lit('"first-contentful-paint":{"numericValue":'), F.floor(F.col("value") * 10).cast("string"), F.lit("}")), F.when(k % 3 > 0, F.concat(F.lit('"speed-index":{"numericValue":'), k.cast("string"), F.lit("}"))),
        F.lit('"cumulative-layout-shift":{"numericValue":0.25},"uses-http2":{"numericValue":1}'),
    )
    doc = F.concat(F.lit('{"lighthouseResult":{"audits":{'), audits, F.when(k % 7 > 0, "}}}").otherwise("}"))
    rows = v.table("events").select(k.alias("id"), F.explode(documents.pagespeed_metrics(doc)).alias("metric", "v"))
    return rows.select("id", "metric", "v.value", "v.unit")


@BOOK.query(
    "SELECT event_id AS id, 'largest_contentful_paint' AS metric, CAST(event_id AS DOUBLE) AS value FROM events UNION ALL SELECT event_id, 'cumulative_layout_shift', 0.05 FROM events WHERE event_id % 2 = 0"
)
def field_metrics(v: Views) -> DataFrame:
    """Field records: a percentile as a number, one as text, one that is no number, and a metric without a histogram."""
    k = F.col("event_id")
    doc = F.concat(
        F.lit('{"record":{"metrics":{"largest_contentful_paint":{"histogram":[{"start":0}],"percentiles":{"p75":'), k.cast("string"), F.lit('}},"cumulative_layout_shift":{"histogram":[],"percentiles":{"p75":"'),
        F.when(k % 2 == 0, "0.05").otherwise("none"), F.lit('"}},"first_contentful_paint":{"percentiles":{"p75":1}}}}}'),
    )
    return v.table("events").select(k.alias("id"), F.explode(documents.field_metrics(doc)).alias("metric", "value"))


def _index(v: Views) -> DataFrame:
    k = F.col("page_id").cast("string")
    title = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("# Site "), k, F.lit(" #\n")))
    text = F.concat(title, F.lit("> About it\n\nWords\n## Docs\n- [A](a/"), k, F.lit("): note\n```\n- [No](no)\n```\nplain [text](x)\n## Optional\n* [B](https://o.test/"), k, F.lit(")\n"))
    return v.table("pages").select("page_id", documents.ai_index_column(text.cast("binary"), F.lit("https://h.test/docs/llms.txt")).alias("x"))


@BOOK.query(
    """SELECT page_id, CASE WHEN page_id % 5 > 0 THEN 'Site ' || page_id END AS title, 'About it' AS summary, CASE WHEN page_id % 5 > 0 THEN 'Words' END AS intro, 'https://h.test/docs/a/' || page_id || ' note,https://o.test/' || page_id || ' -' AS links, CAST(1 AS INT) AS optional, CASE WHEN page_id % 5 = 0 THEN 'missing_title' ELSE '' END AS warnings FROM pages"""
)
def markdown_indexes(v: Views) -> DataFrame:
    links = F.array_join(F.transform("x.links", lambda y: F.concat_ws(" ", y["url"], F.coalesce(y["note"], F.lit("-")))), ",")
    return _index(v).select("page_id", "x.title", "x.summary", "x.intro", links.alias("links"), F.size(F.filter("x.links", lambda y: y["optional"])).alias("optional"), F.array_join("x.warnings", ",").alias("warnings"))


def _body(text: Column, packed: Column) -> Column:
    @F.pandas_udf("binary")
    def run(text: pd.Series, packed: pd.Series) -> pd.Series:
        return pd.Series([gzip.compress(t.encode(), mtime=0) if p else t.encode() for t, p in zip(text, packed, strict=True)], dtype=object)

    return run(text, packed)


@BOOK.query("SELECT page_id, CASE WHEN page_id % 3 <> 1 THEN 'urlset' END AS kind, CASE WHEN page_id % 3 = 1 THEN 'not gzip' END AS error, CASE WHEN page_id % 3 <> 1 THEN url END AS loc FROM pages")
def packed_sitemaps(v: Views) -> DataFrame:
    """Sitemaps of one URL: a third packed, a third packed by name only, a third plain."""
    k = F.col("page_id")
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>"))
    s = documents.sitemap_column(_body(xml, k % 3 == 0), F.when(k % 3 < 2, "s.xml.gz").otherwise("s.xml"))
    return v.table("pages").select("page_id", s.alias("s")).select("page_id", "s.kind", "s.error", F.try_element_at("s.entries", F.lit(1))["loc"].alias("loc"))


# ---- responses, texts, blobs, references ----


@BOOK.query("SELECT o_orderkey AS id, o_orderkey % 4 < 2 AND o_orderstatus <> 'F' AS reusable FROM orders")
def reusable_responses(v: Views) -> DataFrame:
    vary = F.element_at(F.array(F.lit(None).cast("string"), F.lit("Accept, User-Agent"), F.lit("Cookie"), F.lit("accept, *")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    control = F.when(F.col("o_orderstatus") == "F", "max-age=0, No-Store").when(F.col("o_orderstatus") == "O", "MAX-AGE=60")
    return v.table("orders").select(F.col("o_orderkey").alias("id"), classify.reusable(vary, control).alias("reusable"))


@BOOK.query("""SELECT sha256('[{"key":"accept","value":"' || o_orderpriority || '"},{"key":"user-agent","value":"' || o_orderstatus || '"}]') AS variant, count(*) AS n FROM orders GROUP BY 1""")
def response_variants(v: Views) -> DataFrame:
    headers = F.create_map(F.lit("user-agent"), F.col("o_orderstatus"), F.lit("cookie"), F.col("o_orderkey").cast("string"), F.lit("accept"), F.col("o_orderpriority"))
    return v.table("orders").groupBy(classify.variant_fingerprint(headers).alias("variant")).agg(F.count("*").alias("n"))


@BOOK.query("SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS words FROM documents")
def text_word_counts(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", classify.word_count(F.col("text")).alias("words"))


@BOOK.query("SELECT count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT sha256, min(size) AS size FROM (SELECT sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents WHERE doc_id % 3 > 0 AND text IS NOT NULL) WHERE sha256 NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) GROUP BY 1)")
def blobs_to_write(v: Views) -> DataFrame:
    d = v.table("documents").where("text is not null")
    fresh = retention.new_blobs(d.where("doc_id % 3 > 0"), "text", retention.blob_table(d.where("doc_id % 3 = 0"), "text"))
    return fresh.agg(F.count("*").alias("blobs"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))


@BOOK.query("SELECT o_orderkey AS id, o_custkey AS target_resource_id FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 9 > 0")
def reference_targets(v: Views) -> DataFrame:
    """References by URL: a quarter have no identity, a ninth name no known resource."""
    k = F.col("o_orderkey")
    named = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("normalized_url"))
    refs = v.table("orders").join(named.select(F.col("id").alias("o_custkey"), "normalized_url"), "o_custkey")
    refs = refs.select(k.alias("id"), F.when(k % 4 == 0, None).when(k % 9 == 0, F.lit("unknown")).otherwise(F.col("normalized_url")).alias("normalized_target_url"))
    return evidence.reference_occurrences(refs, named).select(refs["id"], "target_resource_id")


@BOOK.query("SELECT source_snapshot_id, count(*) AS embedded FROM occurrences WHERE link_role = 'R' GROUP BY 1", "snapshots", "occurrences")
def embedded_counts(v: Views) -> DataFrame:
    return inventory.counts_by(v.occurrences().where("link_role = 'R'"), "source_snapshot_id", "embedded")


@BOOK.query(
    """SELECT scan_id, array_to_string(list_filter([CASE WHEN nodes > 100 THEN 'node_limit' END, CASE WHEN edges > 3000 THEN 'edge_limit' END, CASE WHEN unfetched > 100 THEN 'unfetched_node_limit' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT scan_id, count(*) AS nodes FROM snapshots GROUP BY 1)
    LEFT JOIN (SELECT scan_id, count(*) AS edges FROM (SELECT DISTINCT scan_id, source_snapshot_id, target_resource_id FROM occurrences) GROUP BY 1) USING (scan_id) LEFT JOIN (SELECT o.scan_id, count(DISTINCT target_resource_id) AS unfetched FROM occurrences o WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.scan_id = o.scan_id AND s.resource_id = o.target_resource_id) GROUP BY 1) USING (scan_id)""",
    "snapshots", "occurrences",
)
def graph_truncation(v: Views) -> DataFrame:
    """Which limits cut the graph of each scan."""
    s, o = v.snapshots(), v.occurrences()
    count = lambda df, name: df.groupBy("scan_id").agg(F.count("*").alias(name))
    n = count(s, "nodes").join(count(o.select("scan_id", "source_snapshot_id", "target_resource_id").distinct(), "edges"), "scan_id", "left").join(count(graph.discovered_nodes(o, s), "unfetched"), "scan_id", "left")
    reasons = graph.truncated(graph.GraphLimits(100, 3000, 100), F.col("nodes"), F.col("edges"), F.col("unfetched"))
    return n.select("scan_id", F.array_join(reasons, ",").alias("reasons"))


# ---- rule preview ----

PREVIEW = evidence_queries.RULE_SQL | {
    "m": "SELECT site_page_id, normalized_url, site_page_id IN (SELECT site_page_id FROM matched WHERE rule_id = 1) AS hit, site_page_id % 7 = 0 AS barred, site_page_id % 50 = 0 OR (site_page_id % 3 <> 0 AND site_page_id IN (SELECT site_page_id FROM matched WHERE rule_id = 1)) AS supported, site_page_id % 4 = 0 AS assigned FROM rule_pages",
}


def _preview(v: Views) -> tuple[DataFrame, DataFrame]:
    pages = evidence_queries._rule_pages(v)
    rule = next(r for r in evidence_queries.RULES if r.rule_id == 1)
    some = lambda where: pages.where(where).select("site_page_id", F.lit(10).alias("category_id"))
    held = rules.matches(pages, [rule]).where("site_page_id % 3 != 0").select("site_page_id", "rule_id").unionByName(pages.where("site_page_id % 50 = 0").select("site_page_id", F.lit(1).cast("long").alias("rule_id")))
    return rules.rule_preview(pages, rule, some("site_page_id % 4 = 0"), held, some("site_page_id % 7 = 0"))


@BOOK.query(
    "SELECT count(*) AS total_pages, count(*) FILTER (WHERE hit) AS matching_pages, count(*) FILTER (WHERE assigned) AS currently_assigned, count(*) FILTER (WHERE hit AND NOT barred AND NOT supported) AS would_gain, count(*) FILTER (WHERE supported AND NOT (hit AND NOT barred)) AS would_lose, count(*) FILTER (WHERE hit AND barred) AS excluded_matches FROM m",
    extra=PREVIEW,
)
def rule_preview_counts(v: Views) -> DataFrame:
    return _preview(v)[0]


@BOOK.query("SELECT * FROM (SELECT site_page_id, normalized_url, hit AS matched FROM m WHERE hit ORDER BY site_page_id LIMIT 10) UNION ALL SELECT * FROM (SELECT site_page_id, normalized_url, hit FROM m WHERE NOT hit ORDER BY site_page_id LIMIT 5)", extra=PREVIEW)
def rule_preview_samples(v: Views) -> DataFrame:
    return _preview(v)[1]


# ---- stored comparison of links ----


@BOOK.query(
    """SELECT 'links' AS kind, presence_state, state, count(*) AS n FROM (SELECT CASE WHEN b IS NULL THEN 'newly_observed' WHEN t IS NULL THEN 'not_observed_in_target' ELSE 'observed_in_both' END AS presence_state, CASE WHEN b IS NULL OR t IS NULL THEN 'not_applicable' WHEN k > 0 THEN 'changed' ELSE 'no_tracked_change' END AS state FROM counted) GROUP BY ALL""",
    "dense", extra=TRACKED_LINKS,
)
def comparison_links_overview(v: Views) -> DataFrame:
    """A stored comparison of the links of two scans, each a validated build, read as its overview."""
    edges = graph.tracked_edges(v.occurrences(dense=True).where(F.col("scan_id").isin(BASE, TARGET)))
    builds = projection.ProjectionStore(v.spark, projection.shared_folder(v.spark, "edges"))
    for scan in (BASE, TARGET):
        builds.build(f"links-{scan}", scan, edges.where(F.col("scan_id") == scan))
    store = comparisons.ComparisonStore(v.spark, projection.shared_folder(v.spark, "comparison"), builds)
    asked = store.request(*({"scan_id": k, "site_id": 1, "status": "completed"} for k in (BASE, TARGET)))
    store.execute(asked["build_id"], lambda b, t: {"links": compare.full_link_diff(b, t)}, {"links": ["source_resource_id", "target_resource_id"]})
    return store.overview(asked["comparison_id"], {"links": "change_state"})
