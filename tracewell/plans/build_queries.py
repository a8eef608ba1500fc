"""Queries over stored comparisons, full projections and aggregates, deletions, identity audits and site helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import compare, comparisons, graph, inventory, observations, projection, retention
from ..sources.fixtures import Views
from .book import Book
from .compare_queries import BASE, PAGE_SQL, SHOWN, TARGET, side
from .evidence_queries import EVIDENCE, _evidence

BOOK = Book()

# ---- stored comparisons ----

SIDES = [{"scan_id": BASE, "site_id": 1, "status": "completed"}, {"scan_id": TARGET, "site_id": 1, "status": "completed"}]


def _compared(v: Views) -> comparisons.ComparisonStore:
    """A store with the current comparison of two projected scans."""
    store = projection.ProjectionStore(v.spark, projection.shared_folder(v.spark, "projection"))
    for scan in (BASE, TARGET):
        store.build(f"pages-{scan}", scan, side(v, scan))
    out = comparisons.ComparisonStore(v.spark, projection.shared_folder(v.spark, "comparison"), store)
    out.execute(out.request(*SIDES)["build_id"], lambda b, t: {"pages": compare.page_diff(b, t)}, {"pages": ["resource_id"]})
    return out


@BOOK.query(f"SELECT {', '.join(SHOWN)} FROM diff", "snapshots", "occurrences", extra=PAGE_SQL)
def comparison_stored_pages(v: Views) -> DataFrame:
    return _compared(v).read(f"{BASE}-{TARGET}", "pages").select(*SHOWN)


@BOOK.query("SELECT 'pages' AS kind, presence_state, primary_change_class AS state, count(*) AS n FROM diff GROUP BY ALL", "snapshots", "occurrences", extra=PAGE_SQL)
def comparison_overview(v: Views) -> DataFrame:
    return _compared(v).overview(f"{BASE}-{TARGET}", {"pages": "primary_change_class"})


SITE_SCANS = "SELECT c_nationkey * 10000 + year(o_orderdate) AS scan_id, c_nationkey AS site_id, min(o_orderdate) AS created_at, CASE WHEN count(*) % 4 = 0 THEN 'failed' ELSE 'completed' END AS status FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey, year(o_orderdate)"


@BOOK.query("SELECT scan_id, lag(scan_id) OVER (PARTITION BY site_id ORDER BY created_at, scan_id) AS previous_scan_id FROM site_scans WHERE status = 'completed'", extra={"site_scans": SITE_SCANS})
def previous_finished_scans(v: Views) -> DataFrame:
    year = F.year("o_orderdate").cast("long")
    o = v.table("orders").join(v.table("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("site_id"), year.alias("year"))
    scans = o.agg(F.min("o_orderdate").alias("created_at"), F.when(F.count("*") % 4 == 0, "failed").otherwise("completed").alias("status"))
    return comparisons.previous_finished(scans.withColumn("scan_id", F.col("site_id") * 10000 + F.col("year"))).select("scan_id", "previous_scan_id")


# ---- full rows ----

FULL = EVIDENCE | {
    "full_evidence": """SELECT *, CASE WHEN evidence = 'observed' THEN evidence_id END AS snapshot_id, 'u' || resource_id AS final_url, CASE WHEN http_status = 200 THEN 'text/html' END AS mime_type, 'f' || size % 10 AS filename, size AS declared_size, size * 2 AS network_bytes,
    size AS response_time_ms, 'rule_' || kind AS rule, CASE WHEN evidence = 'embedded' THEN 'png' END AS extension, source_snapshot_id % 1000 AS evidence_at FROM evidence""",
    "newest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY fetched_at DESC, evidence_id DESC) AS rn FROM full_evidence WHERE evidence = 'observed') WHERE rn = 1",
    "sums": """SELECT resource_id, max(kind) AS kind, max(rule) AS rule, max(extension) AS extension, count(*) FILTER (WHERE evidence = 'observed') AS observed_count, count(*) FILTER (WHERE evidence <> 'observed') AS occurrence_count, count(DISTINCT source_snapshot_id) AS source_page_count,
    count(*) FILTER (WHERE evidence = 'anchor') AS anchor_count, count(*) FILTER (WHERE evidence = 'embedded') AS embedded_count, count(*) FILTER (WHERE in_scope) AS in_scope_count, count(*) FILTER (WHERE NOT in_scope) AS out_scope_count,
    min(evidence_at) FILTER (WHERE evidence <> 'observed') AS first_discovered, max(evidence_at) FILTER (WHERE evidence <> 'observed') AS latest_discovered, count(DISTINCT scan_id) AS scan_count FROM full_evidence GROUP BY 1""",
}


@BOOK.query(
    """SELECT r.id AS resource_id, r.normalized_url, r.host, '/' || r.host AS path, coalesce(s.extension, 'htm') AS file_extension, coalesce(n.kind, s.kind, 'unknown') AS kind, coalesce(n.rule, s.rule, 'fallback_unknown') AS classification_source, n.snapshot_id, n.final_url, n.http_status, n.mime_type,
    n.filename, n.declared_size, n.network_bytes, n.fetched_at, n.response_time_ms, observed_count, occurrence_count, source_page_count, anchor_count, embedded_count, in_scope_count, out_scope_count, first_discovered, latest_discovered, scan_count
    FROM sums s JOIN resources r ON r.id = s.resource_id LEFT JOIN newest n ON n.resource_id = s.resource_id""",
    "snapshots", "occurrences", "resources", extra=FULL,
)
def resource_aggregate_full(v: Views) -> DataFrame:
    e, size = _evidence(v), F.col("size")
    e = e.withColumns(
        {
            "snapshot_id": F.when(F.col("evidence") == "observed", F.col("evidence_id")), "final_url": F.concat(F.lit("u"), F.col("resource_id").cast("string")), "mime_type": F.when(F.col("http_status") == 200, "text/html"), "filename": F.concat(F.lit("f"), (size % 10).cast("string")),
            "declared_size": size, "network_bytes": size * 2, "response_time_ms": size, "rule": F.concat(F.lit("rule_"), "kind"), "extension": F.when(F.col("evidence") == "embedded", "png"), "evidence_at": F.col("source_snapshot_id") % 1000,
        }
    )
    return inventory.resource_aggregate(e, v.resources().withColumn("path", F.concat(F.lit("/"), "host")).withColumn("path_extension", F.lit("htm")), v.tasks())


@BOOK.query(
    """SELECT s.id, s.resource_id, coalesce(i.n, 0) AS inbound_occurrences, coalesce(u.n, 0) AS outbound_occurrences, coalesce(e.n, 0) AS embedded_resource_count, coalesce(k.n, 0) AS seed_origin_count, k.n IS NOT NULL AS is_seed, b.raw_size, b.stored_size,
    CASE WHEN s.id % 3 = 0 THEN 'captured' END AS rendered_capture_state, CASE WHEN s.id % 3 = 0 THEN s.id % 7 ELSE 0 END AS rendered_network_count FROM snapshots s
    LEFT JOIN (SELECT target_resource_id AS k, count(*) AS n FROM occurrences WHERE scan_id = 1996 GROUP BY 1) i ON i.k = s.resource_id LEFT JOIN (SELECT source_resource_id AS k, count(*) AS n FROM occurrences WHERE scan_id = 1996 GROUP BY 1) u ON u.k = s.resource_id
    LEFT JOIN (SELECT source_snapshot_id AS k, count(*) AS n FROM occurrences WHERE link_role = 'R' GROUP BY 1) e ON e.k = s.id LEFT JOIN (SELECT resource_id AS k, count(*) AS n FROM observations GROUP BY 1) k ON k.k = s.resource_id
    LEFT JOIN (SELECT doc_id, size AS raw_size, size // 2 AS stored_size FROM blobs) b ON b.doc_id = s.id WHERE scan_id = 1996""",
    "snapshots", "occurrences", "observations", "blobs",
)
def page_projection_full(v: Views) -> DataFrame:
    s = v.snapshots().where(F.col("scan_id") == BASE).withColumn("sha256", F.col("id").cast("string"))
    o = v.occurrences()
    blobs = v.blobs().select(F.col("doc_id").cast("string").alias("sha256"), F.col("size").alias("raw_size"), F.floor(F.col("size") / 2).alias("stored_size"))
    rendered = s.where("id % 3 = 0").select(F.col("id").alias("snapshot_id"), F.lit("captured").alias("rendered_capture_state"), (F.col("id") % 7).alias("rendered_network_count"))
    p = projection.full_page_projection(s, graph.page_links(o, BASE), v.resources(), blobs, o.where("link_role = 'R'"), v.observations(), rendered)
    return p.select("id", "resource_id", "inbound_occurrences", "outbound_occurrences", "embedded_resource_count", "seed_origin_count", "is_seed", "raw_size", "stored_size", "rendered_capture_state", "rendered_network_count")


COUNTS = {k: f"SELECT scan_id, string_agg(label || '=' || n, ',' ORDER BY label) AS {k} FROM (SELECT scan_id, coalesce(CAST({c} AS VARCHAR), 'none') AS label, count(*) AS n FROM snapshots GROUP BY ALL) GROUP BY 1" for k, c in (("fetch_state_counts", "fetch_state"), ("http_status_counts", "http_status"), ("depth_counts", "crawl_depth"))}


@BOOK.query(
    """SELECT p.*, coalesce(link_occurrences, 0) AS link_occurrences, coalesce(links, 0) AS links, resources, fetch_state_counts, http_status_counts, depth_counts
    FROM (SELECT scan_id, count(*) AS pages, count(*) FILTER (WHERE http_status BETWEEN 200 AND 399 AND response_time_ms % 9 <> 0) AS succeeded, count(*) FILTER (WHERE response_time_ms % 9 = 0) AS with_errors, max(crawl_depth) AS max_depth FROM snapshots GROUP BY 1) p
    LEFT JOIN (SELECT scan_id, count(*) AS link_occurrences, count(DISTINCT (source_snapshot_id, target_resource_id)) AS links FROM occurrences GROUP BY 1) USING (scan_id) LEFT JOIN (SELECT scan_id, count(DISTINCT resource_id) AS resources FROM evidence GROUP BY 1) USING (scan_id)
    LEFT JOIN fetch_state_counts USING (scan_id) LEFT JOIN http_status_counts USING (scan_id) LEFT JOIN depth_counts USING (scan_id)""",
    "snapshots", "occurrences", extra=EVIDENCE | COUNTS,
)
def scan_summary_full(v: Views) -> DataFrame:
    s = v.snapshots().withColumn("error_type", F.when(F.col("response_time_ms") % 9 == 0, "timeout"))
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return projection.full_scan_summary(s, v.occurrences(), _evidence(v)).withColumns({c: text(c) for c in COUNTS})


AUDITED = {
    "audits": "SELECT *, CAST(floor(metric) AS BIGINT) % 5 AS violation_rules, CAST(floor(metric) AS BIGINT) % 7 AS violation_nodes, rule_id % 3 AS incomplete_rules FROM observations",
    "last": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id, profile ORDER BY observed_at DESC, id DESC) AS rn FROM audits) WHERE rn = 1",
}


def _audits(v: Views) -> DataFrame:
    whole = F.floor("metric").cast("long")
    return v.observations().withColumns({"violation_rules": whole % 5, "violation_nodes": whole % 7, "incomplete_rules": F.col("rule_id") % 3})


@BOOK.query(
    """SELECT count(DISTINCT resource_id) AS pages_audited, count(DISTINCT profile) AS profiles_audited, count(DISTINCT resource_id) FILTER (WHERE violation_rules > 0) AS pages_with_violations, CAST(coalesce(sum(violation_rules), 0) AS BIGINT) AS violation_rules,
    CAST(coalesce(sum(violation_nodes), 0) AS BIGINT) AS affected_nodes, CAST(coalesce(sum(incomplete_rules), 0) AS BIGINT) AS needs_review_rules, count(*) FILTER (WHERE outcome = 'failed') AS failed_latest, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') AS latest_observed_at FROM last""",
    "observations", extra=AUDITED,
)
def audit_summary(v: Views) -> DataFrame:
    return observations.audit_summary(_audits(v)).withColumn("latest_observed_at", F.date_format("latest_observed_at", "yyyy-MM-dd HH:mm:ss"))


@BOOK.query("SELECT CASE rule_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'minor' ELSE 'unknown' END AS impact, count(*) AS n FROM last WHERE outcome = 'ready' AND id % 3 > 0 GROUP BY 1", "observations", extra=AUDITED)
def audit_impact_counts(v: Views) -> DataFrame:
    kind = F.col("rule_id") % 4
    rules = v.observations().select(F.col("id").alias("observation_id"), F.when(F.col("id") % 3 > 0, "violation").otherwise("pass").alias("result_type"), F.when(kind == 0, "critical").when(kind == 1, "serious").when(kind == 2, "minor").alias("impact"))
    return observations.impact_counts(_audits(v), rules)


# ---- deletion ----

DELETION = {
    "pages": "SELECT *, md5('b' || response_time_ms % 3000) AS sha256 FROM snapshots",
    "pairs": "SELECT scan_id AS b, scan_id + 1 AS t FROM scans",
    "known": "SELECT resource_id AS id FROM snapshots WHERE scan_id = 1996 UNION SELECT target_resource_id FROM occurrences WHERE scan_id = 1996",
    "gone": "SELECT id FROM known WHERE id NOT IN (SELECT resource_id FROM snapshots WHERE scan_id <> 1996) AND id NOT IN (SELECT target_resource_id FROM occurrences WHERE scan_id <> 1996) AND id NOT IN (SELECT resource_id FROM observations WHERE outcome = 'failed' AND resource_id IS NOT NULL)",
}


def _deletion(v: Views) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    s = v.snapshots().withColumn("sha256", F.md5(F.concat(F.lit("b"), (F.col("response_time_ms") % 3000).cast("string"))))
    before = {"snapshots": s, "occurrences": v.occurrences(), "comparisons": v.scans().select(F.col("scan_id").alias("baseline_scan_id"), (F.col("scan_id") + 1).alias("target_scan_id")), "resources": v.resources(), "blobs": s.select("sha256").distinct()}
    return before, retention.delete_scan(**before, scan_id=1996, pinned=[v.observations().where("outcome = 'failed'").select("resource_id")])


@BOOK.query(
    """SELECT 'snapshots' AS "table", count(*) AS deleted FROM pages WHERE scan_id = 1996 UNION ALL SELECT 'occurrences', count(*) FROM occurrences WHERE scan_id = 1996 UNION ALL SELECT 'comparisons', count(*) FROM pairs WHERE b = 1996 OR t = 1996
    UNION ALL SELECT 'resources', count(*) FROM resources WHERE id IN (SELECT id FROM gone) UNION ALL SELECT 'blobs', count(DISTINCT sha256) FROM pages WHERE scan_id = 1996 AND sha256 NOT IN (SELECT sha256 FROM pages WHERE scan_id <> 1996)""",
    "scans", "snapshots", "occurrences", "resources", "observations", extra=DELETION,
)
def scan_deletion(v: Views) -> DataFrame:
    return retention.deleted_counts(*_deletion(v))


@BOOK.query("SELECT id FROM resources WHERE id NOT IN (SELECT id FROM gone)", "snapshots", "occurrences", "resources", "observations", extra=DELETION)
def resources_after_deletion(v: Views) -> DataFrame:
    return _deletion(v)[1]["resources"].select("id")


# ---- identity audit ----

AUDIT = {
    "urls": "SELECT p_partkey AS id, 'https://s' || p_size % 3 || '.example/' || CASE WHEN p_size > 25 THEN 'P' ELSE 'p' END || CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 97 ELSE p_partkey END || CASE WHEN p_size % 2 = 0 THEN '/' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_size % 4 = 0 THEN '?b=1&a=2' ELSE '?a=2&b=1' END ELSE '' END AS url FROM part",
    "ids": "SELECT *, CASE WHEN id % 11 <> 0 THEN lower(url) END AS candidate FROM urls",
    "spelled": "SELECT id AS resource_id, CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN id % 6 = 1 THEN candidate || l_linenumber WHEN id % 6 = 2 THEN 'other' ELSE candidate END AS candidate FROM ids JOIN lineitem ON l_partkey = id WHERE id % 13 > 3",
    "seen": "SELECT resource_id, count(DISTINCT candidate) AS identities, min(candidate) AS seen, count(*) FILTER (WHERE candidate IS NULL) AS errors FROM spelled GROUP BY 1",
    "sharing": "SELECT candidate, count(*) AS n FROM ids WHERE candidate IS NOT NULL GROUP BY 1",
    "classes": """SELECT id, url, i.candidate, coalesce(identities, 0) AS identities, coalesce(errors, 0) AS errors, CASE WHEN n > 1 THEN 'candidate_v2_merge' WHEN coalesce(identities, 0) > 1 THEN 'current_over_collapse_candidate'
    WHEN i.candidate IS NULL OR (coalesce(identities, 0) = 0 AND errors > 0) THEN 'insufficient_provenance' WHEN i.candidate <> url OR seen <> i.candidate THEN 're_key_only' WHEN coalesce(identities, 0) = 0 AND url LIKE '%?%' THEN 'insufficient_provenance' ELSE 'unchanged' END AS identity_class
    FROM ids i LEFT JOIN seen ON resource_id = id LEFT JOIN sharing s ON s.candidate = i.candidate""",
    "parts": "SELECT regexp_extract(url, '^https://[^/]+', 0) AS site, regexp_extract(url, '^https://[^/]+([^?]*)', 1) AS path, regexp_extract(url, '[?](.*)$', 1) AS query FROM urls",
}


def _urls(v: Views) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    query = F.when(key % 5 == 0, F.when(size % 4 == 0, "?b=1&a=2").otherwise("?a=2&b=1")).otherwise("")
    name = F.when(key % 4 == 0, key % 97).otherwise(key).cast("string")
    return v.table("part").select(key.alias("id"), F.concat(F.lit("https://s"), (size % 3).cast("string"), F.lit(".example/"), F.when(size > 25, "P").otherwise("p"), name, F.when(size % 2 == 0, "/").otherwise(""), query).alias("url"))


def _classes(v: Views) -> DataFrame:
    ids = _urls(v).withColumn("candidate", F.when(F.col("id") % 11 != 0, F.lower("url")))
    spelled = F.when(F.col("l_suppkey") % 7 == 0, None).when(F.col("id") % 6 == 1, F.concat("candidate", F.col("l_linenumber").cast("string"))).when(F.col("id") % 6 == 2, "other").otherwise(F.col("candidate"))
    evidence = ids.where("id % 13 > 3").join(v.table("lineitem").select("l_partkey", "l_suppkey", "l_linenumber"), F.col("l_partkey") == F.col("id")).select(F.col("id").alias("resource_id"), spelled.alias("candidate"))
    return retention.identity_classes(ids, evidence)


@BOOK.query("SELECT * FROM classes", extra=AUDIT)
def identity_audit(v: Views) -> DataFrame:
    return _classes(v)


@BOOK.query("SELECT " + ", ".join(f"count(*) FILTER (WHERE identity_class = '{c}') AS {c}" for c in ("unchanged", "re_key_only", "current_over_collapse_candidate", "candidate_v2_merge", "insufficient_provenance")) + ", CASE WHEN bool_or(identity_class = 'candidate_v2_merge') THEN 'CANDIDATE_MERGE_REQUIRES_REVIEW' ELSE 'SPLIT_MECHANICALLY_RECOVERABLE' END AS severity FROM classes", extra=AUDIT)
def identity_severity(v: Views) -> DataFrame:
    return retention.audit_severity(_classes(v))


@BOOK.query(
    """SELECT 'path_case' AS kind, count(*) AS groups FROM (SELECT 1 FROM parts GROUP BY site, lower(path), query HAVING count(DISTINCT path) > 1) UNION ALL SELECT 'trailing_slash', count(*) FROM (SELECT 1 FROM parts GROUP BY site, rtrim(path, '/'), query HAVING count(DISTINCT path LIKE '%/') > 1)
    UNION ALL SELECT 'query_order', count(*) FROM (SELECT 1 FROM parts WHERE query <> '' GROUP BY site, path, list_sort(string_split(query, '&')) HAVING count(*) > 1)""",
    extra=AUDIT,
)
def url_distinctions(v: Views) -> DataFrame:
    return retention.distinction_counts(_urls(v))


# ---- sites ----


@BOOK.query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'http://site' || c_custkey || '.example/' WHEN 1 THEN 'http://site' || c_custkey || '.example:8080/a?b=1' WHEN 2 THEN 'https://site' || c_custkey || '.example/x' END AS base_url FROM customer")
def site_base_urls(v: Views) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" HTTP://Site"), key, F.lit(".Example:80"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("http://me@SITE"), key, F.lit(".example:8080/a?b=1#c"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("site"), key, F.lit(".EXAMPLE/x"))).otherwise(F.concat(F.lit("ftp://site"), key))
    return v.table("customer").select(F.col("c_custkey").alias("id"), urls.site_base_url(raw).alias("base_url"))


@BOOK.query("SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'none' ELSE p_brand || ' ' || p_size END AS classification FROM part")
def site_classification_keys(v: Views) -> DataFrame:
    raw = F.when(F.col("p_size") % 10 == 0, " \t ").otherwise(F.concat(F.lit("  "), "p_brand", F.lit("  \n  "), F.col("p_size").cast("string"), F.lit(" ")))
    return v.table("part").select(F.col("p_partkey").alias("id"), urls.classification_key(raw, "none").alias("classification"))


@BOOK.query("SELECT event_id AS id, " + ", ".join(f"coalesce(strftime(CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE '{z}', '%Y-%m-%d %H:%M'), 'Not available') AS {n}" for n, z in (("new_york", "America/New_York"), ("kathmandu", "Asia/Kathmandu"))) + " FROM events")
def times_in_zones(v: Views) -> DataFrame:
    return v.table("events").select(F.col("event_id").alias("id"), urls.in_zone(F.col("ts"), "America/New_York").alias("new_york"), urls.in_zone(F.col("ts"), "Asia/Kathmandu").alias("kathmandu"))


# ---- all tracked fields of resources ----

_SIDE = {"b": 1995, "t": 1996}
TRACKED = dict(FULL)
for _s, _scan in _SIDE.items():
    TRACKED[f"evidence_{_s}"] = f"SELECT * FROM full_evidence WHERE scan_id = {_scan}"
    TRACKED |= {f"{k}_{_s}": FULL[k].replace("full_evidence", f"evidence_{_s}") for k in ("newest", "sums")}
    TRACKED[f"side_{_s}"] = f"""SELECT r.id AS resource_id, r.normalized_url, {{'kind': coalesce(n.kind, s.kind, 'unknown'), 'rule': coalesce(n.rule, s.rule, 'fallback_unknown'), 'observed': observed_count > 0, 'final_url': n.final_url, 'http_status': n.http_status, 'mime_type': n.mime_type, 'filename': n.filename, 'declared_size': n.declared_size,
        'occurrence_count': occurrence_count, 'source_page_count': source_page_count, 'anchor_count': anchor_count, 'embedded_count': embedded_count, 'in_scope_count': in_scope_count, 'out_scope_count': out_scope_count, 'observed_count': observed_count}} AS f
        FROM sums_{_s} s JOIN resources r ON r.id = s.resource_id LEFT JOIN newest_{_s} n ON n.resource_id = s.resource_id"""
_NAMES = ["kind", "rule", "observed", "observed", "final_url", "http_status", "mime_type", "filename", "declared_size", "occurrence_count", "source_page_count", "anchor_count", "embedded_count", "in_scope_count", "out_scope_count", "observed_count"]


ORACLE_RESOURCES = (
    "SELECT resource_id, normalized_url, CASE WHEN b IS NULL THEN 'newly_observed' WHEN t IS NULL THEN 'not_observed_in_target' ELSE 'observed_in_both' END AS presence_state, CASE WHEN b IS NULL OR t IS NULL THEN 0 ELSE k END AS changed_field_count, CASE WHEN b IS NULL OR t IS NULL THEN 'not_applicable' WHEN k > 0 THEN 'changed' ELSE 'no_tracked_change' END AS change_state,"
    " b IS NOT NULL AND t IS NOT NULL AND b.http_status IS DISTINCT FROM t.http_status AS status_changed, b IS NOT NULL AND t IS NOT NULL AND b.observed IS DISTINCT FROM t.observed AS observed_state_changed, t.occurrence_count - b.occurrence_count AS occurrence_delta, t.source_page_count - b.source_page_count AS source_page_delta, t.declared_size - b.declared_size AS declared_size_delta"
    " FROM (SELECT *, " + " + ".join(f"CAST(b.{n} IS DISTINCT FROM t.{n} AS BIGINT)" for n in _NAMES) + " AS k FROM (SELECT coalesce(b.resource_id, t.resource_id) AS resource_id, coalesce(b.normalized_url, t.normalized_url) AS normalized_url, b.f AS b, t.f AS t FROM side_b b FULL JOIN side_t t ON b.resource_id = t.resource_id))"
)


def _inventories(v: Views) -> dict[int, DataFrame]:
    """The full inventory of each of two scans."""
    e, size = _evidence(v).where(F.col("scan_id").isin(*_SIDE.values())), F.col("size")
    e = e.withColumns(
        {
            "snapshot_id": F.when(F.col("evidence") == "observed", F.col("evidence_id")), "final_url": F.concat(F.lit("u"), F.col("resource_id").cast("string")), "mime_type": F.when(F.col("http_status") == 200, "text/html"), "filename": F.concat(F.lit("f"), (size % 10).cast("string")),
            "declared_size": size, "network_bytes": size * 2, "response_time_ms": size, "rule": F.concat(F.lit("rule_"), "kind"), "extension": F.when(F.col("evidence") == "embedded", "png"), "evidence_at": F.col("source_snapshot_id") % 1000,
        }
    )
    r = v.resources().withColumn("path", F.concat(F.lit("/"), "host")).withColumn("path_extension", F.lit("htm"))
    return {k: inventory.resource_aggregate(e.where(F.col("scan_id") == k), r, v.tasks()) for k in _SIDE.values()}


@BOOK.query(ORACLE_RESOURCES, "snapshots", "occurrences", "resources", extra=TRACKED)
def resource_diff_full(v: Views) -> DataFrame:
    diff = compare.full_resource_diff(*_inventories(v).values())
    return diff.select("resource_id", "normalized_url", "presence_state", "changed_field_count", "change_state", "status_changed", "observed_state_changed", "occurrence_delta", "source_page_delta", "declared_size_delta")


@BOOK.query(
    "SELECT 'resources' AS kind, presence_state, change_state AS state, count(*) AS n FROM (" + ORACLE_RESOURCES + ") GROUP BY ALL", "snapshots", "occurrences", "resources", extra=TRACKED,
)
def comparison_resources_overview(v: Views) -> DataFrame:
    """A stored comparison of two inventories, each a validated build, read as its overview."""
    builds = projection.ProjectionStore(v.spark, projection.shared_folder(v.spark, "inventories"))
    for scan, rows in _inventories(v).items():
        builds.build(f"resources-{scan}", scan, rows)
    store = comparisons.ComparisonStore(v.spark, projection.shared_folder(v.spark, "comparison"), builds)
    asked = store.request(*({"scan_id": k, "site_id": 1, "status": "completed"} for k in _SIDE.values()))
    store.execute(asked["build_id"], lambda b, t: {"resources": compare.full_resource_diff(b, t)}, {"resources": ["resource_id"]})
    return store.overview(asked["comparison_id"], {"resources": "change_state"})


@BOOK.query(
    """SELECT s.id, s.resource_id, s.scan_id, k.site_name, CASE WHEN s.response_time_ms % 3 = 0 THEN 'parsed' WHEN s.response_time_ms % 3 = 1 THEN 'failed' END AS parse_state, r.capture_state
    FROM snapshots s JOIN scans USING (scan_id) LEFT JOIN (SELECT n_nationkey AS site_id, n_name AS site_name FROM nation) k ON k.site_id = s.scan_id % 30 LEFT JOIN (SELECT event_id AS id, min(event_type) AS capture_state FROM events GROUP BY 1) r ON r.id = s.id""",
    "scans", "snapshots",
)
def page_history(v: Views) -> DataFrame:
    """Observations with their scan, and site, artifact and rendering where there are any."""
    third = F.col("response_time_ms") % 3
    s = v.snapshots().withColumn("sha256", F.when(third < 2, F.concat(F.lit("b"), F.col("response_time_ms").cast("string"))))
    scans = v.scans().withColumns({"site_id": F.col("scan_id") % 30, "scan_status": F.lit("completed")})
    artifacts = s.where("sha256 is not null").select("sha256", F.when(third == 0, "parsed").otherwise("failed").alias("parse_state"))
    sites = v.table("nation").select(F.col("n_nationkey").cast("long").alias("site_id"), F.col("n_name").alias("site_name"))
    got = observations.page_history(s, scans, sites, artifacts, v.table("events").select(F.col("event_id").alias("snapshot_id"), F.col("event_type").alias("capture_state")))
    return got.select("id", "resource_id", "scan_id", "site_name", "parse_state", "capture_state")
