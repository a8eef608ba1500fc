"""Queries over inventories, observations, history, rules, retention and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import privacy
from ..operators import catalog, inventory, observations, projection, retention, rules
from ..sources.fixtures import Views
from .book import Book

BOOK = Book()
PROFILES = ["click", "purchase", "view", "signup", "error"]
STAMP, STAMP_SQL = "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"

# ---- inventory ----

EVIDENCE = {
    "evidence": """SELECT 'observed' AS evidence, id AS evidence_id, scan_id, resource_id, CAST(NULL AS BIGINT) AS source_snapshot_id, http_status, response_time_ms AS size, CASE WHEN http_status = 200 THEN 'html_page' END AS kind, CAST(NULL AS BOOLEAN) AS in_scope, fetched_at FROM snapshots
    UNION ALL SELECT 'embedded', source_snapshot_id * 10, scan_id, target_resource_id, source_snapshot_id, NULL, NULL, 'image', in_scope, NULL FROM occurrences WHERE link_role = 'R'
    UNION ALL SELECT 'anchor', source_snapshot_id * 10 + 1, scan_id, target_resource_id, source_snapshot_id, NULL, NULL, 'unknown', in_scope, NULL FROM occurrences WHERE link_role <> 'R'"""
}


def _evidence(v: Views) -> DataFrame:
    seen = v.snapshots().select(F.col("id").alias("evidence_id"), "scan_id", "resource_id", F.lit(None).cast("long").alias("source_snapshot_id"), "http_status", F.col("response_time_ms").alias("size"), F.when(F.col("http_status") == 200, "html_page").alias("kind"), F.lit(None).cast("boolean").alias("in_scope"), "fetched_at")
    embedded = F.col("link_role") == "R"
    refs = v.occurrences().select(
        F.when(embedded, "embedded").otherwise("anchor").alias("evidence"), (F.col("source_snapshot_id") * 10 + F.when(embedded, 0).otherwise(1)).alias("evidence_id"), "scan_id", F.col("target_resource_id").alias("resource_id"), "source_snapshot_id",
        F.when(embedded, "image").otherwise("unknown").alias("kind"), "in_scope",
    )
    return inventory.evidence_of(seen, refs)


@BOOK.query("SELECT evidence, count(*) AS n, count(DISTINCT resource_id) AS resources, CAST(sum(size) AS BIGINT) AS total_size FROM evidence GROUP BY 1", "snapshots", "occurrences", extra=EVIDENCE)
def resource_evidence_union(v: Views) -> DataFrame:
    return _evidence(v).groupBy("evidence").agg(F.count("*").alias("n"), F.countDistinct("resource_id").alias("resources"), F.sum("size").alias("total_size"))


INVENTORY = """SELECT e.resource_id, count(*) AS evidence_count, count(*) FILTER (WHERE evidence = 'observed') AS observed_count, count(*) FILTER (WHERE evidence = 'embedded') AS embedded_count, count(*) FILTER (WHERE evidence = 'anchor') AS anchor_count,
    count(DISTINCT source_snapshot_id) AS source_count, any_value(l.http_status) AS latest_status, any_value(l.size) AS latest_size, coalesce(any_value(l.kind), max(e.kind), 'unknown') AS kind, coalesce(bool_or(in_scope), false) AS any_in_scope,
    CASE WHEN count(*) FILTER (WHERE evidence = 'observed') > 0 THEN 'observed' ELSE 'discovered' END AS evidence_state
    FROM evidence e LEFT JOIN (SELECT resource_id, http_status, size, kind FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY fetched_at DESC, evidence_id DESC) rn FROM evidence WHERE evidence = 'observed') WHERE rn = 1) l ON l.resource_id = e.resource_id GROUP BY e.resource_id"""


@BOOK.query(INVENTORY, "snapshots", "occurrences", extra=EVIDENCE)
def resource_inventory(v: Views) -> DataFrame:
    return inventory.resource_inventory(_evidence(v))


@BOOK.query("SELECT * FROM inv WHERE evidence_state = 'observed' AND latest_size >= 100000 AND source_count > 1 ORDER BY evidence_count DESC NULLS LAST, resource_id LIMIT 250", "snapshots", "occurrences", extra=EVIDENCE | {"inv": INVENTORY})
def resource_inventory_filtered(v: Views) -> DataFrame:
    rows = inventory.inventory_filter(inventory.resource_inventory(_evidence(v)), state="observed", min_size=100_000, multi_source=True)
    return catalog.page(catalog.ordered(rows, {"evidence": "evidence_count"}, "evidence", True, ("resource_id",)), 250)


@BOOK.query("SELECT kind, count(*) AS resources, count(*) FILTER (WHERE evidence_state = 'observed') AS observed, count(*) FILTER (WHERE evidence_state = 'discovered') AS discovered FROM inv GROUP BY 1", "snapshots", "occurrences", extra=EVIDENCE | {"inv": INVENTORY})
def resource_summary(v: Views) -> DataFrame:
    return inventory.resource_summary(inventory.resource_inventory(_evidence(v)))


@BOOK.query("SELECT resource_id, scan_id, max(CASE WHEN evidence = 'observed' THEN http_status END) AS http_status, bool_or(evidence = 'observed') AS observed, CAST(sum(CASE WHEN evidence = 'observed' THEN 0 ELSE 1 END) AS BIGINT) AS referrals FROM evidence GROUP BY 1, 2", "snapshots", "occurrences", extra=EVIDENCE)
def resource_history(v: Views) -> DataFrame:
    return inventory.resource_history(_evidence(v))


@BOOK.query("SELECT evidence, resource_id, CAST(row_number() OVER (PARTITION BY resource_id ORDER BY fetched_at DESC, evidence_id DESC) AS INT) AS observed_rank, evidence_id FROM evidence WHERE evidence = 'observed'", "snapshots", "occurrences", extra=EVIDENCE)
def observed_ranks(v: Views) -> DataFrame:
    return inventory.ranked_observations(_evidence(v)).where("evidence = 'observed'").select("evidence", "resource_id", "observed_rank", "evidence_id")


@BOOK.query("SELECT evidence, evidence_id, source_snapshot_id, in_scope FROM evidence WHERE evidence <> 'observed' AND resource_id = 5", "snapshots", "occurrences", extra=EVIDENCE)
def resource_occurrences(v: Views) -> DataFrame:
    e = _evidence(v)
    return inventory.resource_occurrences(e.where("evidence = 'anchor'").drop("evidence"), e.where("evidence = 'embedded'").drop("evidence"), 5).select("evidence", "evidence_id", "source_snapshot_id", "in_scope")


# ---- source entries ----

ENTRIES = {"entries": "SELECT p_partkey AS id, p_size % 5 AS source_id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type END AS normalized_url, CASE p_size % 3 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'manual' ELSE 'robots' END AS source_type, p_retailprice > 1000 AS is_current FROM part"}


def _entries(v: Views) -> DataFrame:
    size = F.col("p_size")
    return v.table("part").select(F.col("p_partkey").alias("id"), (size % 5).alias("source_id"), F.when(F.col("p_partkey") % 17 == 0, None).otherwise(F.col("p_type")).alias("normalized_url"), F.when(size % 3 == 0, "sitemap").when(size % 3 == 1, "manual").otherwise("robots").alias("source_type"), (F.col("p_retailprice") > 1000).alias("is_current"))


@BOOK.query("SELECT coalesce(normalized_url, 'invalid:' || id) AS entry_key, count(*) AS entries, min(id) AS first_id, min_by(source_id, id) AS first_source, array_to_string(list_sort(list(DISTINCT source_type)), ',') AS source_types FROM entries GROUP BY 1", extra=ENTRIES)
def inventory_grouped(v: Views) -> DataFrame:
    return inventory.group_entries(_entries(v))


@BOOK.query("SELECT source_id, count(*) AS entries, count(*) FILTER (WHERE is_current) AS current FROM entries GROUP BY 1", extra=ENTRIES)
def source_current_counts(v: Views) -> DataFrame:
    return inventory.current_counts(_entries(v))


@BOOK.query(
    """SELECT coalesce(e.source_id, f.source_id) AS source_id, coalesce(e.normalized_url, f.normalized_url) AS normalized_url, f.source_id IS NOT NULL AS is_current, CASE WHEN e.source_id IS NULL THEN 'inserted' WHEN f.source_id IS NOT NULL THEN 'kept' ELSE 'expired' END AS action
    FROM (SELECT DISTINCT source_id, normalized_url FROM entries WHERE id % 2 = 0 AND normalized_url IS NOT NULL) e FULL JOIN (SELECT DISTINCT source_id, normalized_url FROM entries WHERE id % 3 = 0 AND normalized_url IS NOT NULL) f ON e.source_id = f.source_id AND e.normalized_url = f.normalized_url""",
    extra=ENTRIES,
)
def membership_refresh(v: Views) -> DataFrame:
    e = _entries(v).where("normalized_url is not null")
    return inventory.refresh_membership(e.where("id % 2 = 0"), e.where("id % 3 = 0"))


@BOOK.query(
    """SELECT coalesce(e.normalized_url, n.normalized_url) AS normalized_url, CASE WHEN n.normalized_url IS NULL THEN e.source_id ELSE n.source_id END AS source_id, CASE WHEN e.normalized_url IS NULL THEN 'insert' WHEN n.normalized_url IS NULL OR n.source_id = e.source_id THEN 'unchanged' ELSE 'update' END AS action
    FROM (SELECT normalized_url, max_by(source_id, id) AS source_id FROM entries WHERE is_current AND normalized_url IS NOT NULL GROUP BY 1) e FULL JOIN (SELECT normalized_url, max_by(source_id, id) AS source_id FROM entries WHERE NOT is_current AND normalized_url IS NOT NULL GROUP BY 1) n ON e.normalized_url = n.normalized_url""",
    extra=ENTRIES,
)
def source_entry_upsert(v: Views) -> DataFrame:
    e = _entries(v).where("normalized_url is not null")
    old = e.where("is_current").groupBy("normalized_url").agg(F.max_by("source_id", "id").alias("source_id"))
    return inventory.upsert(old, e.where("not is_current"), "normalized_url", ["source_id"])


@BOOK.query("SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN 'invalid' WHEN p_size >= 45 THEN 'out_of_scope' WHEN p_partkey IN (SELECT target_resource_id FROM occurrences) THEN 'source_and_crawl' ELSE 'source_only' END AS classification FROM part", "occurrences")
def inventory_classification(v: Views) -> DataFrame:
    crawled = v.occurrences().select(F.col("target_resource_id").alias("p_partkey")).distinct().withColumn("crawled", F.lit(True))
    p = v.table("part").join(crawled, "p_partkey", "left")
    return p.select(F.col("p_partkey").alias("id"), inventory.classification(F.col("p_partkey") % 17 != 0, F.col("p_size") < 45, F.coalesce("crawled", F.lit(False))).alias("classification"))


@BOOK.query("SELECT p_type AS policy_key, min_by(p_name, (p_size, p_name)) AS url, min(p_size) AS priority, count(*) AS origins FROM part GROUP BY 1 ORDER BY min(p_size), p_type LIMIT 100")
def scan_seeds(v: Views) -> DataFrame:
    return inventory.seeds(v.table("part").select(F.col("p_type").alias("policy_key"), F.col("p_name").alias("url"), F.col("p_size").alias("priority")), 100)


# ---- observations ----

LATEST = {"latest": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY resource_id, profile ORDER BY observed_at DESC, id DESC) AS rn FROM observations) WHERE rn = 1"}


@BOOK.query(f"SELECT id, resource_id, profile, strftime(observed_at, '{STAMP_SQL}') AS observed_at, outcome, metric, rule_id FROM latest", "observations", extra=LATEST)
def latest_observation_per_key(v: Views) -> DataFrame:
    return observations.latest_per_key(v.observations(), ["resource_id", "profile"]).withColumn("observed_at", F.date_format("observed_at", STAMP))


@BOOK.query("SELECT profile, count(DISTINCT resource_id) AS measured, count(DISTINCT CASE WHEN outcome = 'ready' THEN resource_id END) AS ready FROM latest GROUP BY 1", "observations", extra=LATEST)
def latest_then_ready_coverage(v: Views) -> DataFrame:
    return observations.ready_coverage(v.observations())


@BOOK.query("SELECT resource_id, " + ", ".join(f"max(CASE WHEN profile = '{p}' THEN outcome END) AS {p}_outcome, max(CASE WHEN profile = '{p}' THEN metric END) AS {p}_metric" for p in PROFILES) + ", count(DISTINCT rule_id) AS rules FROM latest GROUP BY 1", "observations", extra=LATEST)
def profile_pivot(v: Views) -> DataFrame:
    return observations.profile_pivot(v.observations(), PROFILES)


@BOOK.query("SELECT rule_id, outcome, count(DISTINCT resource_id) AS pages, count(*) AS observations, " + ", ".join(f"bool_or(profile = '{p}') AS in_{p}" for p in PROFILES) + " FROM latest GROUP BY 1, 2", "observations", extra=LATEST)
def rule_aggregate(v: Views) -> DataFrame:
    return observations.rule_aggregate(v.observations(), PROFILES)


@BOOK.query("SELECT count(DISTINCT resource_id) AS pages, count(DISTINCT profile) AS profiles, count(DISTINCT CASE WHEN outcome = 'failed' THEN resource_id END) AS failed_pages, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) AS observations FROM latest", "observations", extra=LATEST)
def observation_summary(v: Views) -> DataFrame:
    return observations.summary(v.observations())


@BOOK.query("SELECT resource_id, profile, id, CAST(rank AS INT) AS rank FROM (SELECT resource_id, profile, id, row_number() OVER (PARTITION BY resource_id, profile ORDER BY observed_at DESC, id DESC) AS rank FROM observations) WHERE rank <= 3", "observations")
def newest_observations(v: Views) -> DataFrame:
    return observations.newest(v.observations(), ["resource_id", "profile"], 3).select("resource_id", "profile", "id", "rank")


@BOOK.query("SELECT resource_id, min_by(id, rank) AS id, CAST(min(rank) AS INT) AS rank FROM (SELECT resource_id, id, outcome, row_number() OVER (PARTITION BY resource_id ORDER BY observed_at DESC, id DESC) AS rank FROM observations) WHERE rank <= 20 AND outcome = 'ready' GROUP BY 1", "observations")
def revalidation_candidates(v: Views) -> DataFrame:
    return observations.revalidation_candidate(v.observations(), ["resource_id"], F.col("outcome") == "ready")


@BOOK.query(f"SELECT resource_id, count(*) FILTER (WHERE http_status = 200) AS page_observations, strftime(min(CASE WHEN http_status = 200 THEN fetched_at END), '{STAMP_SQL}') AS first_seen, strftime(max(CASE WHEN http_status = 200 THEN fetched_at END), '{STAMP_SQL}') AS last_seen, count(*) AS observations FROM snapshots GROUP BY 1", "snapshots")
def page_rollup(v: Views) -> DataFrame:
    r = observations.page_rollup(v.snapshots(), F.coalesce(F.col("http_status") == 200, F.lit(False)))
    return r.withColumn("first_seen", F.date_format("first_seen", STAMP)).withColumn("last_seen", F.date_format("last_seen", STAMP))


@BOOK.query(
    """SELECT resource_id, scan_id, id, previous_id, ps IS DISTINCT FROM http_status AND previous_id IS NOT NULL AS status_changed, pf IS DISTINCT FROM fetch_state AND previous_id IS NOT NULL AS fetch_state_changed, pd IS DISTINCT FROM crawl_depth AND previous_id IS NOT NULL AS depth_changed,
    CASE WHEN previous_id IS NULL THEN 'first_observation' ELSE CASE CAST(ps IS DISTINCT FROM http_status AS INT) + CAST(pf IS DISTINCT FROM fetch_state AS INT) + CAST(pd IS DISTINCT FROM crawl_depth AS INT) WHEN 0 THEN 'no_change' WHEN 1 THEN CASE WHEN ps IS DISTINCT FROM http_status THEN 'status' WHEN pf IS DISTINCT FROM fetch_state THEN 'fetch_state' ELSE 'depth' END ELSE 'multiple_changes' END END AS label,
    coalesce(ordinal - po - 1, 0) AS scans_between FROM (SELECT s.*, c.ordinal, lag(s.id) OVER w AS previous_id, lag(http_status) OVER w AS ps, lag(fetch_state) OVER w AS pf, lag(crawl_depth) OVER w AS pd, lag(ordinal) OVER w AS po
    FROM snapshots s JOIN (SELECT *, row_number() OVER (ORDER BY created_at, scan_id) AS ordinal FROM scans) c ON c.scan_id = s.scan_id WINDOW w AS (PARTITION BY resource_id ORDER BY c.created_at, s.scan_id, s.id))""",
    "snapshots", "scans",
)
def page_change_history(v: Views) -> DataFrame:
    return observations.change_history(v.snapshots(), v.scans())


@BOOK.query("SELECT scan_id, lag(scan_id) OVER (ORDER BY created_at, scan_id) AS previous_scan_id FROM scans", "scans")
def adjacent_scan(v: Views) -> DataFrame:
    return observations.adjacent_scans(v.scans()).select("scan_id", "previous_scan_id")


@BOOK.query("SELECT c_nationkey AS site_id, n_name AS site, count(DISTINCT scan_id) AS scans, max(scan_id) AS latest_scan_id, max_by(s.id, (scan_id, fetched_at, s.id)) AS latest_snapshot_id FROM snapshots s JOIN customer ON c_custkey = resource_id JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2", "snapshots")
def site_latest_scan(v: Views) -> DataFrame:
    c = v.table("customer").select(F.col("c_custkey").alias("resource_id"), F.col("c_nationkey").alias("site_id"))
    s = observations.latest_scan(v.snapshots().join(c, "resource_id"), "site_id")
    return s.join(F.broadcast(v.table("nation").select(F.col("n_nationkey").alias("site_id"), F.col("n_name").alias("site"))), "site_id")


@BOOK.query("SELECT n_nationkey AS site_id, r_name AS site_group FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(n_name) LIKE '%1%' AND n_regionkey IN (1, 2, 3) ORDER BY n_name, n_nationkey LIMIT 50")
def site_filters(v: Views) -> DataFrame:
    sites = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = sites.where(catalog.search_any("1", "n_name") & F.col("n_regionkey").isin(1, 2, 3))
    return catalog.page(rows.orderBy("n_name", "n_nationkey")).select(F.col("n_nationkey").alias("site_id"), F.col("r_name").alias("site_group"))


@BOOK.query("SELECT scan_id, count(*) AS pages, count(*) FILTER (WHERE http_status BETWEEN 200 AND 399) AS succeeded, count(*) FILTER (WHERE http_status NOT BETWEEN 200 AND 399) AS failed, count(*) FILTER (WHERE http_status IS NULL) AS without_status, max(crawl_depth) AS max_depth, CAST(sum(response_time_ms) AS BIGINT) AS total_response_ms FROM snapshots GROUP BY 1", "snapshots")
def scan_summary(v: Views) -> DataFrame:
    return projection.scan_summary(v.snapshots())


COUNTERS = "SELECT scan_id, 'fetch_state' AS kind, fetch_state AS label, count(*) AS n FROM snapshots GROUP BY ALL UNION ALL SELECT scan_id, 'http_status', coalesce(CAST(http_status AS VARCHAR), 'none'), count(*) FROM snapshots GROUP BY ALL UNION ALL SELECT scan_id, 'depth', CAST(crawl_depth AS VARCHAR), count(*) FROM snapshots GROUP BY ALL"


@BOOK.query(COUNTERS, "snapshots")
def scan_counters(v: Views) -> DataFrame:
    return projection.scan_counters(v.snapshots())


# ---- workspace tags and history ----


@BOOK.query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def pages_with_notes(v: Views) -> DataFrame:
    return catalog.has_any(v.table("documents").select("doc_id", "source"), v.table("labels").where("quality = 1"), "doc_id", True)


@BOOK.query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pages_uncategorized(v: Views) -> DataFrame:
    return catalog.has_any(v.table("documents").select("doc_id", "source"), v.table("labels"), "doc_id", False)


@BOOK.query("SELECT c.category_id, coalesce(count(DISTINCT page_id), 0) AS pages, count(DISTINCT page_id) FILTER (WHERE support_type = 'manual') AS manual_pages, count(DISTINCT page_id) FILTER (WHERE support_type = 'automatic') AS automatic_pages FROM (SELECT unnest([0, 1, 2]) AS category_id) c LEFT JOIN (SELECT doc_id AS page_id, quality AS category_id, 'manual' AS support_type FROM labels UNION ALL SELECT doc_id, toxic, 'automatic' FROM labels) s ON s.category_id = c.category_id GROUP BY 1")
def category_counts_filter(v: Views) -> DataFrame:
    lab = v.table("labels")
    supports = lab.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("category_id"), F.lit("manual").alias("support_type")).union(lab.select("doc_id", "toxic", F.lit("automatic")))
    return rules.category_counts(v.spark.createDataFrame([(0,), (1,), (2,)], "category_id int"), supports)


@BOOK.query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS previous_role, length(text) AS size FROM conversations")
def history_turns(v: Views) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    return v.table("conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous_role"), F.length("text").cast("long").alias("size"))


# ---- rules ----

C = rules.Condition
RULES = [
    rules.Rule(1, 10, (C("host", "equals", "brand#13"),)),
    rules.Rule(2, 10, (C("path", "starts_with", "STANDARD"), C("path", "ends_with", "steel")), "all"),
    rules.Rule(3, 11, (C("path", "contains", "BRASS", case_sensitive=True), C("path", "glob", "small*")), "any"),
    rules.Rule(4, 12, (C("normalized_url", "regex", r"part\s*#?0*[0-9]*7$"), C("host", "equals", "Brand#11", negate=True))),
    rules.Rule(5, 13, (), "all", active=False),
]
RULE_SQL = {
    "rule_pages": "SELECT p_partkey AS site_page_id, p_name AS normalized_url, p_brand AS host, p_type AS path FROM part",
    "matched": """SELECT site_page_id, 1 AS rule_id, 10 AS category_id FROM rule_pages WHERE lower(host) = 'brand#13' UNION ALL SELECT site_page_id, 2, 10 FROM rule_pages WHERE lower(path) LIKE 'standard%' AND lower(path) LIKE '%steel'
    UNION ALL SELECT site_page_id, 3, 11 FROM rule_pages WHERE path LIKE '%BRASS%' OR lower(path) LIKE 'small%' UNION ALL SELECT site_page_id, 4, 12 FROM rule_pages WHERE regexp_matches(lower(normalized_url), 'part\\s*#?0*[0-9]*7$') AND lower(host) <> 'brand#11'""",
    "existing": "SELECT site_page_id, category_id, rule_id FROM matched WHERE site_page_id % 3 <> 0 UNION ALL SELECT site_page_id, 99, 9 FROM rule_pages WHERE site_page_id % 50 = 0",
    "excluded": "SELECT DISTINCT site_page_id, 10 AS category_id FROM rule_pages WHERE site_page_id % 7 = 0",
    "actions": """SELECT site_page_id, category_id, rule_id, CASE WHEN there AND (NOT wanted OR barred) THEN 'remove' WHEN there THEN 'keep' WHEN barred THEN 'suppressed' ELSE 'add' END AS action FROM (SELECT coalesce(d.site_page_id, e.site_page_id) AS site_page_id, coalesce(d.category_id, e.category_id) AS category_id, coalesce(d.rule_id, e.rule_id) AS rule_id,
    d.site_page_id IS NOT NULL AS wanted, e.site_page_id IS NOT NULL AS there, (coalesce(d.site_page_id, e.site_page_id), coalesce(d.category_id, e.category_id)) IN (SELECT site_page_id, category_id FROM excluded) AS barred FROM matched d FULL JOIN existing e ON d.site_page_id = e.site_page_id AND d.category_id = e.category_id AND d.rule_id = e.rule_id)""",
}


def _rule_pages(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("site_page_id"), F.col("p_name").alias("normalized_url"), F.col("p_brand").alias("host"), F.col("p_type").alias("path"), F.lit(None).cast("string").alias("query"))


def _actions(v: Views) -> DataFrame:
    pages = _rule_pages(v)
    desired = rules.matches(pages, RULES)
    stale = pages.where("site_page_id % 50 = 0").select("site_page_id", F.lit(99).cast("long").alias("category_id"), F.lit(9).cast("long").alias("rule_id"))
    existing = desired.where("site_page_id % 3 != 0").select("site_page_id", "category_id", "rule_id").unionByName(stale)
    return rules.reconcile(desired, existing, pages.where("site_page_id % 7 = 0").select("site_page_id", F.lit(10).cast("long").alias("category_id")))


@BOOK.query("SELECT site_page_id, CAST(rule_id AS BIGINT) AS rule_id, CAST(category_id AS BIGINT) AS category_id FROM matched", extra=RULE_SQL)
def rule_matches(v: Views) -> DataFrame:
    return rules.matches(_rule_pages(v), RULES)


@BOOK.query("SELECT site_page_id, CAST(category_id AS BIGINT) AS category_id, CAST(rule_id AS BIGINT) AS rule_id, action FROM actions", extra=RULE_SQL)
def rule_reconcile(v: Views) -> DataFrame:
    return _actions(v)


@BOOK.query("SELECT action, count(DISTINCT site_page_id) AS pages FROM actions GROUP BY 1", extra=RULE_SQL)
def rule_preview(v: Views) -> DataFrame:
    return rules.preview(_actions(v))[0]


@BOOK.query("SELECT site_page_id, CAST(category_id AS BIGINT) AS category_id, count(*) AS supports FROM actions WHERE action IN ('add', 'keep') GROUP BY 1, 2", extra=RULE_SQL)
def rule_assignments(v: Views) -> DataFrame:
    return rules.assignments(rules.after(_actions(v)))


@BOOK.query("SELECT CAST(coalesce(sum(own), 0) AS BIGINT) AS supports_removed, count(*) FILTER (WHERE others = 0) AS assignments_removed, count(*) FILTER (WHERE others > 0) AS assignments_retained FROM (SELECT count(*) FILTER (WHERE rule_id = 2) AS own, count(*) FILTER (WHERE rule_id <> 2) AS others FROM actions WHERE action IN ('add', 'keep') GROUP BY site_page_id, category_id) WHERE own > 0", extra=RULE_SQL)
def rule_deletion_preview(v: Views) -> DataFrame:
    return rules.deletion_preview(rules.after(_actions(v)), 2)


@BOOK.query(
    """SELECT coalesce(a.site_page_id, m.site_page_id, x.site_page_id) AS site_page_id, CAST(coalesce(a.category_id, m.category_id, x.category_id) AS BIGINT) AS category_id, CASE WHEN m.site_page_id IS NOT NULL AND coalesce(supports, 0) > 0 THEN 'manual_and_automatic' WHEN m.site_page_id IS NOT NULL THEN 'manual' WHEN x.site_page_id IS NOT NULL THEN 'excluded' ELSE 'automatic' END AS provenance, coalesce(supports, 0) AS supports
    FROM (SELECT site_page_id, category_id, count(*) AS supports FROM actions WHERE action IN ('add', 'keep') GROUP BY 1, 2) a FULL JOIN (SELECT site_page_id, 10 AS category_id FROM rule_pages WHERE site_page_id % 11 = 0) m ON a.site_page_id = m.site_page_id AND a.category_id = m.category_id
    FULL JOIN excluded x ON x.site_page_id = coalesce(a.site_page_id, m.site_page_id) AND x.category_id = coalesce(a.category_id, m.category_id)""",
    extra=RULE_SQL,
)
def rule_provenance(v: Views) -> DataFrame:
    pages = _rule_pages(v)
    ten = F.lit(10).cast("long").alias("category_id")
    return rules.provenance(rules.after(_actions(v)), pages.where("site_page_id % 11 = 0").select("site_page_id", ten), pages.where("site_page_id % 7 = 0").select("site_page_id", ten))


LIMITED = [
    rules.Rule(21, 70, [rules.Condition("normalized_url", "regex", "^([a-z]+ )*[a-z]*oo[a-z]*( [a-z]+)*$")]), rules.Rule(22, 70, [rules.Condition("normalized_url", "regex", r"^(?P<a>\w)\w* (?:\w+ )*(?P=a)\w*$"), rules.Condition("path", "starts_with", "promo")]),
    rules.Rule(23, 71, [rules.Condition("path", "contains", "brass")]), rules.Rule(24, 72, [rules.Condition("host", "regex", "^(b+r*a*n*d*)+#1"), rules.Condition("path", "glob", "*STEEL")], "any"), rules.Rule(25, 73, [rules.Condition("path", "regex", "([")]),
]


@BOOK.query(
    """SELECT p_partkey AS site_page_id, rule_id, category_id, error FROM part, (SELECT CAST(a AS BIGINT) AS rule_id, CAST(b AS BIGINT) AS category_id, CASE WHEN a = 25 THEN 'invalid pattern' END AS error, a AS own FROM (VALUES (21, 70), (22, 70), (23, 71), (24, 72), (25, 73)) x(a, b)) k
    WHERE CASE own WHEN 21 THEN regexp_matches(lower(p_name), '^([a-z]+ )*[a-z]*oo[a-z]*( [a-z]+)*$') WHEN 22 THEN len(string_split(p_name, ' ')) > 1 AND substr(lower(p_name), 1, 1) = substr(lower(string_split(p_name, ' ')[-1]), 1, 1) AND lower(p_type) LIKE 'promo%'
    WHEN 23 THEN lower(p_type) LIKE '%brass%' WHEN 24 THEN lower(p_brand) LIKE 'brand#1%' OR lower(p_type) LIKE '%steel' ELSE TRUE END"""
)
def rule_matches_limited(v: Views) -> DataFrame:
    """Rules with nested repetition, back references and a wrong pattern beside a plain one."""
    got = rules.evaluate(_rule_pages(v), LIMITED, 1.0)
    return got.withColumn("error", F.substring_index("error", ":", 1))


# ---- retention and identity ----


@BOOK.query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND p_partkey NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def deletable_resources(v: Views) -> DataFrame:
    c = v.table("part").select(F.col("p_partkey").alias("id"))
    return retention.unreferenced(c, "id", [v.table("lineitem").where("l_quantity > 49").select("l_partkey"), v.table("orders").where("o_totalprice > 400000").select("o_custkey"), v.table("labels").where("toxic = 1").select("doc_id")])


@BOOK.query("SELECT sha256(text) AS sha256, min(octet_length(encode(text))) AS size, count(*) AS rows FROM documents GROUP BY 1")
def blob_dedupe(v: Views) -> DataFrame:
    return retention.blob_table(v.table("documents"), "text")


@BOOK.query("SELECT p.source, count(*) FILTER (WHERE owners = 1) AS unique_keys, count(*) FILTER (WHERE owners > 1) AS shared_keys FROM (SELECT DISTINCT sha256, source FROM blobs) p JOIN (SELECT sha256, count(DISTINCT source) AS owners FROM blobs GROUP BY 1) o USING (sha256) GROUP BY 1", "blobs")
def shared_blobs(v: Views) -> DataFrame:
    return retention.shared_by(v.blobs(), "sha256", "source")


@BOOK.query("SELECT DISTINCT sha256 FROM blobs WHERE sha256 NOT IN (SELECT sha256 FROM blobs WHERE doc_id % 3 = 0)", "blobs")
def missing_artifacts(v: Views) -> DataFrame:
    b = v.blobs()
    return retention.missing_artifacts(b.select("sha256").distinct(), b.where("doc_id % 3 = 0"))


@BOOK.query("SELECT doc_id, CASE WHEN sha256 IN (SELECT sha256 FROM blobs WHERE lang = 'en' AND sha256 IS NOT NULL) THEN size END AS size FROM blobs", "blobs")
def blob_read(v: Views) -> DataFrame:
    docs = v.table("documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"))
    stored = docs.where("lang = 'en'").dropDuplicates(["sha256"])
    return retention.read_blobs(docs.drop("content"), stored).select("doc_id", F.length("content").cast("long").alias("size"))


@BOOK.query(
    """SELECT (SELECT count(*) FROM snapshots WHERE scan_id = 1996) AS snapshots, (SELECT count(*) FROM occurrences WHERE scan_id = 1996) AS occurrences, (SELECT count(DISTINCT resource_id) FROM snapshots WHERE scan_id = 1996 AND resource_id NOT IN (SELECT resource_id FROM snapshots WHERE scan_id <> 1996) AND resource_id NOT IN (SELECT target_resource_id FROM occurrences WHERE scan_id <> 1996)) AS resources_released""",
    "snapshots", "occurrences",
)
def deletion_impact(v: Views) -> DataFrame:
    return retention.deletion_impact(v.snapshots(), v.occurrences(), 1996)


@BOOK.query("SELECT 'lineitem' AS \"table\", count(*) AS rows FROM lineitem WHERE l_partkey % 10 = 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 10 = 0 AND o_custkey IN (SELECT p_partkey FROM part)")
def identity_dependents(v: Views) -> DataFrame:
    return retention.dependents(v.table("part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("id")), {"lineitem": (v.table("lineitem"), "l_partkey"), "orders": (v.table("orders"), "o_custkey")})


@BOOK.query("SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT c_custkey FROM customer) THEN p_partkey WHEN p_size > 10 THEN p_size END AS resource_id FROM part")
def alias_resolution(v: Views) -> DataFrame:
    """Parts as ids; those that are customers stand for themselves, larger ones have their size as an alias."""
    p = v.table("part")
    aliases = p.where("p_size > 10").select(F.col("p_partkey").alias("legacy_id"), F.col("p_size").cast("long").alias("resource_id"))
    return retention.resolve_alias(p.select(F.col("p_partkey").alias("id")), aliases, v.table("customer").select(F.col("c_custkey").alias("id")))


@BOOK.query("SELECT d.doc_id, strategy FROM (SELECT doc_id FROM documents WHERE lang = 'en') d CROSS JOIN (SELECT unnest(['mobile', 'desktop']) AS strategy) s")
def task_expansion(v: Views) -> DataFrame:
    return v.table("documents").where("lang = 'en'").select("doc_id", F.explode(F.array(F.lit("mobile"), F.lit("desktop"))).alias("strategy"))


@BOOK.query("SELECT id, metric_name, value, CASE WHEN value <= good THEN 'good' WHEN value <= fair THEN 'needs_improvement' ELSE 'poor' END AS rating FROM (SELECT event_id AS id, 'cumulative_layout_shift' AS metric_name, round(value / 100, 4) AS value, 0.1 AS good, 0.25 AS fair FROM events)")
def metric_ratings(v: Views) -> DataFrame:
    e = v.table("events").select(F.col("event_id").alias("id"), F.lit("cumulative_layout_shift").alias("metric_name"), F.round(F.col("value") / 100, 4).alias("value"))
    return e.withColumn("rating", observations.metric_rating(F.col("metric_name"), F.col("value")))


@BOOK.query("SELECT report_id, audit_id, CAST(rank AS INT) AS rank FROM (SELECT l_orderkey AS report_id, l_partkey AS audit_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY savings DESC, l_partkey) AS rank FROM (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS savings FROM lineitem GROUP BY 1, 2)) WHERE rank <= 3")
def top_audits(v: Views) -> DataFrame:
    a = v.table("lineitem").groupBy(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("audit_id")).agg(F.max("l_extendedprice").alias("savings"))
    return observations.top_audits(a, 3).select("report_id", "audit_id", "rank")


@BOOK.query()
def projection_checksum(v: Views) -> DataFrame:
    return projection.checksum(v.snapshots())


@BOOK.query()
def seed_fingerprint(v: Views) -> DataFrame:
    return inventory.seed_fingerprint(inventory.seeds(v.table("part").select(F.col("p_type").alias("policy_key"), F.col("p_name").alias("url"), F.col("p_size").alias("priority"))))


DELETION = {"kept": "SELECT *, 'b' || response_time_ms % 5000 AS sha256 FROM snapshots", "files": "SELECT sha256, min(response_time_ms) AS size FROM kept GROUP BY 1", "pairs": "SELECT scan_id - 1 AS baseline_scan_id, scan_id AS target_scan_id FROM scans"}


@BOOK.query(
    """SELECT (SELECT count(*) FROM snapshots WHERE scan_id = 1996) AS snapshots, (SELECT count(*) FROM occurrences WHERE scan_id = 1996) AS occurrences, (SELECT count(*) FROM pairs WHERE 1996 IN (baseline_scan_id, target_scan_id)) AS comparisons,
    (SELECT count(*) FROM (SELECT resource_id AS r FROM snapshots WHERE scan_id = 1996 UNION SELECT target_resource_id FROM occurrences WHERE scan_id = 1996) WHERE r NOT IN (SELECT resource_id FROM snapshots WHERE scan_id <> 1996) AND r NOT IN (SELECT target_resource_id FROM occurrences WHERE scan_id <> 1996)) AS resources_released,
    count(*) FILTER (WHERE NOT shared) AS blobs_released, CAST(coalesce(sum(size) FILTER (WHERE NOT shared), 0) AS BIGINT) AS bytes_released, count(*) FILTER (WHERE shared) AS blobs_shared FROM (SELECT *, sha256 IN (SELECT sha256 FROM kept WHERE scan_id <> 1996) AS shared FROM files WHERE sha256 IN (SELECT sha256 FROM kept WHERE scan_id = 1996))""",
    "scans", "snapshots", "occurrences", extra=DELETION,
)
def deletion_preview(v: Views) -> DataFrame:
    """What goes with a scan, the blobs that it alone refers to included."""
    s = v.snapshots().withColumn("sha256", F.concat(F.lit("b"), (F.col("response_time_ms") % 5000).cast("string")))
    pairs = v.scans().select((F.col("scan_id") - 1).alias("baseline_scan_id"), F.col("scan_id").alias("target_scan_id"))
    return retention.deletion_preview(s, v.occurrences(), pairs, s.groupBy("sha256").agg(F.min("response_time_ms").alias("size")), 1996)


@BOOK.query(
    """SELECT resource_id, asked_site_id, min_by(id, rank) AS id, CAST(min(rank) AS INT) AS rank FROM (SELECT s.resource_id, a.site_id AS asked_site_id, s.id, fetch_state, row_number() OVER (PARTITION BY s.resource_id, a.site_id ORDER BY s.scan_id % 2 = a.site_id DESC, fetched_at DESC, s.id DESC) AS rank
    FROM snapshots s JOIN (SELECT DISTINCT resource_id, resource_id % 2 AS site_id FROM snapshots) a USING (resource_id)) WHERE rank <= 20 AND fetch_state = 'F' GROUP BY 1, 2""",
    "snapshots",
)
def site_first_candidates(v: Views) -> DataFrame:
    s = v.snapshots().withColumn("site_id", F.col("scan_id") % 2)
    return observations.site_first_candidate(s.select("resource_id", (F.col("resource_id") % 2).alias("site_id")), s, F.col("fetch_state") == "F")


@BOOK.query("SELECT report_id, audit_id, CAST(rank AS INT) AS rank FROM (SELECT l_orderkey AS report_id, l_partkey AS audit_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY score NULLS LAST, l_partkey) AS rank FROM (SELECT l_orderkey, l_partkey, min(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS score FROM lineitem GROUP BY 1, 2)) WHERE rank <= 3")
def top_diagnostics(v: Views) -> DataFrame:
    a = v.table("lineitem").groupBy(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("audit_id")).agg(F.min(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("score"))
    return observations.top_diagnostics(a, 3).select("report_id", "audit_id", "rank")


_BASE = "split_part(split_part(url, '?', 1), '#', 1)"


@BOOK.query(f"SELECT page_id, 'see ' || {_BASE} || '?token=%5BREDACTED%5D&x=' || page_id || ' and ' || {_BASE} || '?Key=%5BREDACTED%5D&b=2 end' AS shown FROM pages")
def text_redaction(v: Views) -> DataFrame:
    """Texts with two URLs: secrets, a user and a fragment go."""
    base, k = F.substring_index(F.substring_index("url", "?", 1), "#", 1), F.col("page_id").cast("string")
    text = F.concat(F.lit("see "), F.regexp_replace(base, "://", "://me:pw@"), F.lit("?token=T&x="), k, F.lit("#top and "), base, F.lit("?Key=1&b=2 end"))
    return v.table("pages").select("page_id", privacy.redacted_text(text, 10_000).alias("shown"))
