"""Queries that compare two scans (1996 with 1997)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import compare, graph, lists, projection
from ..sources.fixtures import Views
from .book import Book

BOOK = Book()
BASE, TARGET = 1996, 1997

SIDE = """SELECT s.resource_id, s.id AS snapshot_id, http_status, fetch_state, crawl_depth, md5(CAST(crawl_depth AS VARCHAR)) AS content_hash, CASE WHEN resource_id % 5 = 0 THEN NULL ELSE md5(CAST(crawl_depth % 3 AS VARCHAR)) END AS document_hash,
    'T' || (response_time_ms % 4) AS page_title, response_time_ms, coalesce(i.n, 0) AS inbound_occurrences, coalesce(u.n, 0) AS outbound_occurrences FROM snapshots s
    LEFT JOIN (SELECT target_resource_id, count(*) n FROM occurrences WHERE scan_id = {scan} GROUP BY 1) i ON i.target_resource_id = s.resource_id
    LEFT JOIN (SELECT source_resource_id, count(*) n FROM occurrences WHERE scan_id = {scan} GROUP BY 1) u ON u.source_resource_id = s.resource_id WHERE scan_id = {scan}"""
BOTH = "b.resource_id IS NOT NULL AND t.resource_id IS NOT NULL"
FLAGS = {"http_status_changed": "http_status", "fetch_state_changed": "fetch_state", "depth_changed": "crawl_depth", "title_changed": "page_title", "inbound_links_changed": "inbound_occurrences", "outbound_links_changed": "outbound_occurrences"}
PAGE_SQL = {
    "b": SIDE.format(scan=BASE),
    "t": SIDE.format(scan=TARGET),
    "p": "SELECT coalesce(b.resource_id, t.resource_id) AS resource_id, b.snapshot_id AS b_snapshot_id, t.snapshot_id AS t_snapshot_id, CASE WHEN "
    + BOTH
    + " THEN 'observed_in_both' WHEN t.resource_id IS NOT NULL THEN 'newly_observed' ELSE 'not_observed_in_target' END AS presence_state, "
    + ", ".join(f"({BOTH} AND b.{c} IS DISTINCT FROM t.{c}) AS {n}" for n, c in FLAGS.items())
    + f""", CASE WHEN NOT ({BOTH}) THEN 'not_applicable' WHEN b.content_hash = t.content_hash THEN 'same' ELSE 'changed' END AS exact_source_state, CASE WHEN NOT ({BOTH}) THEN 'not_applicable' WHEN b.document_hash IS NOT NULL AND t.document_hash IS NOT NULL THEN CASE WHEN b.document_hash = t.document_hash THEN 'same' ELSE 'changed' END WHEN b.content_hash = t.content_hash THEN 'same' ELSE 'unavailable' END AS document_content_state,
    CASE WHEN NOT ({BOTH}) THEN 'not_applicable' WHEN b.page_title IS DISTINCT FROM t.page_title THEN 'changed' ELSE 'same' END AS metadata_state, t.response_time_ms - b.response_time_ms AS response_time_ms_delta FROM b FULL JOIN t ON b.resource_id = t.resource_id""",
    "q": """SELECT *, CASE WHEN presence_state <> 'observed_in_both' THEN 'not_applicable' WHEN http_status_changed OR fetch_state_changed OR depth_changed OR inbound_links_changed OR outbound_links_changed THEN 'changed' ELSE 'same' END AS technical_state, document_content_state = 'changed' AS content_changed FROM p""",
    "diff": """SELECT *, CAST(http_status_changed AS BIGINT) + CAST(fetch_state_changed AS BIGINT) + CAST(depth_changed AS BIGINT) + CAST(title_changed AS BIGINT) + CAST(inbound_links_changed AS BIGINT) + CAST(outbound_links_changed AS BIGINT) + CAST(content_changed AS BIGINT) AS changed_field_count,
    CASE WHEN presence_state <> 'observed_in_both' THEN 'not_applicable' WHEN document_content_state = 'changed' THEN 'substantive_change' WHEN metadata_state = 'changed' THEN 'metadata_change' WHEN technical_state = 'changed' THEN 'technical_change' WHEN exact_source_state = 'changed' AND document_content_state = 'same' THEN 'normalization_only' WHEN exact_source_state = 'same' THEN 'no_tracked_change' ELSE 'indeterminate' END AS primary_change_class FROM q""",
}
SHOWN = ["resource_id", "b_snapshot_id", "t_snapshot_id", "presence_state", *FLAGS, "exact_source_state", "document_content_state", "metadata_state", "technical_state", "content_changed", "changed_field_count", "primary_change_class", "response_time_ms_delta"]


def side(v: Views, scan: int) -> DataFrame:
    """One scan's page projection as the comparison takes it."""
    o = graph.page_links(v.occurrences(), scan)
    m = v.snapshots().where(F.col("scan_id") == scan).join(graph.inbound_metrics(o), "resource_id", "left").join(graph.outbound_metrics(o), "resource_id", "left").fillna(0, subset=["inbound_occurrences", "outbound_occurrences"])
    return m.select(
        "resource_id", F.col("id").alias("snapshot_id"), "http_status", "fetch_state", "crawl_depth", F.md5(F.col("crawl_depth").cast("string").cast("binary")).alias("content_hash"),
        F.when(F.col("resource_id") % 5 != 0, F.md5((F.col("crawl_depth") % 3).cast("string").cast("binary"))).alias("document_hash"), F.concat(F.lit("T"), (F.col("response_time_ms") % 4).cast("string")).alias("page_title"),
        "response_time_ms", "inbound_occurrences", "outbound_occurrences",
    )


def _pages(v: Views) -> DataFrame:
    return compare.page_diff(side(v, BASE), side(v, TARGET))


@BOOK.query(f"SELECT {', '.join(SHOWN)} FROM diff", "snapshots", "occurrences", extra=PAGE_SQL)
def page_full_outer_diff(v: Views) -> DataFrame:
    return _pages(v).select(*SHOWN)


@BOOK.query("SELECT presence_state, primary_change_class, count(*) AS n FROM diff GROUP BY 1, 2", "snapshots", "occurrences", extra=PAGE_SQL)
def change_class(v: Views) -> DataFrame:
    return compare.counts(_pages(v), "primary_change_class")


@BOOK.query("SELECT resource_id, primary_change_class, changed_field_count FROM diff WHERE presence_state = 'observed_in_both' AND primary_change_class IN ('metadata_change', 'technical_change') AND changed_field_count > 0 AND abs(response_time_ms_delta) >= 1000 ORDER BY changed_field_count DESC, resource_id LIMIT 250", "snapshots", "occurrences", extra=PAGE_SQL)
def comparison_page_filters(v: Views) -> DataFrame:
    rows = _pages(v).where((F.col("presence_state") == compare.BOTH) & F.col("primary_change_class").isin("metadata_change", "technical_change") & (F.col("changed_field_count") > 0) & (F.abs("response_time_ms_delta") >= 1000))
    return rows.orderBy(F.desc("changed_field_count"), "resource_id").limit(250).select("resource_id", "primary_change_class", "changed_field_count")


@BOOK.query("SELECT d.resource_id, CASE WHEN t_snapshot_id IS NOT NULL THEN 'page_observed' WHEN o.resource_id IS NULL THEN 'not_observed' WHEN o.fetch_state = 'failed' THEN 'fetch_failed' ELSE 'observed_as_non_page' END AS t_presence_detail FROM diff d LEFT JOIN (SELECT resource_id, CASE fetch_state WHEN 'P' THEN 'failed' ELSE fetch_state END AS fetch_state FROM snapshots WHERE scan_id = 1998) o ON o.resource_id = d.resource_id", "snapshots", "occurrences", extra=PAGE_SQL)
def presence_details(v: Views) -> DataFrame:
    other = v.snapshots().where("scan_id = 1998").select("resource_id", F.col("id").alias("snapshot_id"), F.when(F.col("fetch_state") == "P", "failed").otherwise(F.col("fetch_state")).alias("fetch_state"))
    return compare.presence_detail(_pages(v), other, "t").select("resource_id", "t_presence_detail")


FULL_SIDE = """SELECT s.resource_id, http_status, fetch_state, crawl_depth, md5('c' || crawl_depth) AS content_hash, CASE WHEN s.resource_id % 5 <> 0 THEN md5('n' || crawl_depth % 4) END AS normalized_hash, CASE WHEN s.resource_id % 5 <> 0 THEN md5('v' || crawl_depth % 2) END AS dependency_hash,
    CASE WHEN s.resource_id % 5 <> 0 THEN md5('d' || crawl_depth % 3) END AS document_hash, md5('h' || crawl_depth % 2) AS head_hash, 'u' || response_time_ms % 50 AS final_url, response_time_ms % 3 AS redirects, 'T' || response_time_ms % 2 AS page_title, 'D' || response_time_ms % 5 AS meta_description,
    CASE WHEN response_time_ms % 7 = 0 THEN 'fr' END AS language, coalesce(n.occ, 0) AS outbound_occurrences, coalesce(n.targets, 0) AS outbound_targets, response_time_ms % 4 AS embedded_resource_count, fetch_state AS rendered_capture_state, response_time_ms % 6 AS rendered_network_count, response_time_ms,
    ['x' || crawl_depth % 4] AS volatile, ['y' || crawl_depth % 2] AS versions FROM snapshots s LEFT JOIN (SELECT source_resource_id, count(*) AS occ, count(DISTINCT target_resource_id) AS targets FROM occurrences WHERE scan_id = {scan} GROUP BY 1) n ON n.source_resource_id = s.resource_id WHERE scan_id = {scan}"""
FULL_FLAGS = {
    "http_status_changed": ["http_status"], "fetch_state_changed": ["fetch_state"], "final_url_changed": ["final_url"], "redirect_state_changed": ["redirects"], "depth_changed": ["crawl_depth"], "outbound_links_changed": ["outbound_occurrences", "outbound_targets"], "embedded_resources_changed": ["embedded_resource_count"],
    "rendered_state_changed": ["rendered_capture_state"], "rendered_counts_changed": ["rendered_network_count"], "head_changed": ["head_hash"], "title_changed": ["page_title"], "language_changed": ["language"],
}
_differ = lambda fs: "(" + " OR ".join(f"b.{f} IS DISTINCT FROM t.{f}" for f in fs) + ")"
_known = lambda h: f"CASE WHEN NOT paired THEN 'not_applicable' WHEN b.{h} IS NOT NULL AND t.{h} IS NOT NULL THEN CASE WHEN b.{h} = t.{h} THEN 'same' ELSE 'changed' END WHEN b.content_hash = t.content_hash THEN 'same' ELSE 'unavailable' END"
FULL_SQL = {
    "fb": FULL_SIDE.format(scan=BASE), "ft": FULL_SIDE.format(scan=TARGET),
    "fp": "SELECT coalesce(b.resource_id, t.resource_id) AS resource_id, b.resource_id IS NOT NULL AND t.resource_id IS NOT NULL AS paired, " + ", ".join(f"paired AND {_differ(fs)} AS {n}" for n, fs in FULL_FLAGS.items())
    + f", CASE WHEN NOT paired THEN 'not_applicable' WHEN b.content_hash = t.content_hash THEN 'same' ELSE 'changed' END AS exact_source_state, {_known('normalized_hash')} AS normalized_source_state, {_known('document_hash')} AS document_content_state, CASE WHEN NOT paired THEN 'not_applicable' WHEN {_differ(['page_title', 'meta_description', 'language'])} THEN 'changed' ELSE 'same' END AS metadata_state,"
    + f" paired AND b.normalized_hash IS NOT NULL AND t.normalized_hash IS NOT NULL AND {_differ(['content_hash', 'normalized_hash'])} AS asked, b.versions IS DISTINCT FROM t.versions AS versions_differ, b.dependency_hash IS DISTINCT FROM t.dependency_hash AS rest_differs, CAST(t.response_time_ms - b.response_time_ms AS DOUBLE) AS response_time_ms_delta FROM fb b FULL JOIN ft t ON b.resource_id = t.resource_id",
    "fq": "SELECT *, document_content_state = 'changed' AS content_changed, CASE WHEN NOT paired THEN 'not_applicable' WHEN " + " OR ".join(n for n in list(FULL_FLAGS)[:9]) + " OR (asked AND (versions_differ OR rest_differs AND document_content_state <> 'changed' AND metadata_state <> 'changed')) THEN 'changed' ELSE 'same' END AS technical_state FROM fp",
    "fd": "SELECT *, " + " + ".join(f"CAST({n} AS BIGINT)" for n in [*FULL_FLAGS, "content_changed"])
    + " AS changed_field_count, CASE WHEN NOT paired THEN 'not_applicable' WHEN document_content_state = 'changed' THEN 'substantive_change' WHEN metadata_state = 'changed' THEN 'metadata_change' WHEN technical_state = 'changed' THEN 'technical_change' WHEN exact_source_state = 'changed' AND normalized_source_state = 'same' THEN 'normalization_only' WHEN exact_source_state = 'same' THEN 'no_tracked_change' ELSE 'indeterminate' END AS primary_change_class FROM fq",
}
FULL_SHOWN = ["resource_id", *FULL_FLAGS, "content_changed", "exact_source_state", "normalized_source_state", "document_content_state", "metadata_state", "technical_state", "primary_change_class", "changed_field_count", "response_time_ms_delta"]


def full_side(v: Views, scan: int) -> DataFrame:
    """One scan's pages with the fields that the full comparison takes."""
    o = graph.page_links(v.occurrences(), scan).groupBy(F.col("source_resource_id").alias("resource_id")).agg(F.count("*").alias("outbound_occurrences"), F.countDistinct("target_resource_id").alias("outbound_targets"))
    s = v.snapshots().where(F.col("scan_id") == scan).join(o, "resource_id", "left").fillna(0, subset=["outbound_occurrences", "outbound_targets"])
    depth, ms = F.col("crawl_depth"), F.col("response_time_ms")

    def text(prefix: str, x: Column) -> Column:
        return F.concat(F.lit(prefix), x.cast("string"))

    known = lambda x: F.when(F.col("resource_id") % 5 != 0, x)
    return s.select(
        "resource_id", "http_status", "fetch_state", "crawl_depth", F.md5(text("c", depth)).alias("content_hash"), known(F.md5(text("n", depth % 4))).alias("normalized_hash"), known(F.md5(text("v", depth % 2))).alias("dependency_hash"), known(F.md5(text("d", depth % 3))).alias("document_hash"),
        F.md5(text("h", depth % 2)).alias("head_hash"), text("u", ms % 50).alias("final_url"), (ms % 3).alias("redirects"), text("T", ms % 2).alias("page_title"), text("D", ms % 5).alias("meta_description"), F.when(ms % 7 == 0, "fr").alias("language"), "outbound_occurrences", "outbound_targets",
        (ms % 4).alias("embedded_resource_count"), F.col("fetch_state").alias("rendered_capture_state"), (ms % 6).alias("rendered_network_count"), "response_time_ms", F.array(text("x", depth % 4)).alias("volatile"), F.array(text("y", depth % 2)).alias("versions"),
    )


@BOOK.query(f"SELECT {', '.join(FULL_SHOWN)} FROM fd", "snapshots", "occurrences", extra=FULL_SQL)
def page_diff_all_flags(v: Views) -> DataFrame:
    return compare.full_page_diff(full_side(v, BASE), full_side(v, TARGET)).select(*FULL_SHOWN)


@BOOK.query("SELECT resource_id, primary_change_class, changed_field_count FROM fd WHERE (primary_change_class IN ('substantive_change', 'metadata_change', 'technical_change') OR NOT paired) AND redirect_state_changed AND content_changed ORDER BY changed_field_count DESC, resource_id LIMIT 250", "snapshots", "occurrences", extra=FULL_SQL)
def list_compared_pages(v: Views) -> DataFrame:
    d = compare.full_page_diff(full_side(v, BASE), full_side(v, TARGET)).withColumn("id", F.col("resource_id")).withColumn("content_state", F.col("document_content_state"))
    return lists.COMPARED_PAGES.read(d, "changed_field_count", True, 250, changed_only=True, redirect_changed=True, content="changed").select("resource_id", "primary_change_class", "changed_field_count")


R_FIELDS = ["http_status", "fetch_state", "crawl_depth", "page_title"]
R_CHANGED = [f"CASE WHEN presence_state = 'observed_in_both' AND {n} THEN '{c}' END" for n, c in list(FLAGS.items())[:4]]


@BOOK.query(f"SELECT resource_id, presence_state, concat_ws(',', {', '.join(R_CHANGED)}) AS changed_fields, CASE WHEN presence_state <> 'observed_in_both' THEN presence_state WHEN http_status_changed OR fetch_state_changed OR depth_changed OR title_changed THEN 'changed' ELSE 'same' END AS change_state FROM diff", "snapshots", "occurrences", extra=PAGE_SQL)
def resource_diff(v: Views) -> DataFrame:
    return compare.resource_diff(side(v, BASE), side(v, TARGET), R_FIELDS).select("resource_id", "presence_state", "changed_fields", "change_state")


LINKS = {
    "e": "SELECT scan_id, source_resource_id, target_resource_id, source_snapshot_id, count(*) AS n, count(*) FILTER (WHERE rel = 'nofollow') AS nf, count(*) FILTER (WHERE in_scope) AS sc FROM dense GROUP BY ALL",
    "lb": "SELECT source_resource_id, target_resource_id, max_by(n, source_snapshot_id) AS n, max_by(nf, source_snapshot_id) AS nf, max_by(sc, source_snapshot_id) AS sc FROM e WHERE scan_id = 1996 GROUP BY 1, 2",
    "lt": "SELECT source_resource_id, target_resource_id, max_by(n, source_snapshot_id) AS n, max_by(nf, source_snapshot_id) AS nf, max_by(sc, source_snapshot_id) AS sc FROM e WHERE scan_id = 1997 GROUP BY 1, 2",
    "links": """SELECT coalesce(b.source_resource_id, t.source_resource_id) AS source_resource_id, coalesce(b.target_resource_id, t.target_resource_id) AS target_resource_id, b.n AS b_n, t.n AS t_n,
    CASE WHEN b.source_resource_id IS NULL THEN 'newly_observed' WHEN t.source_resource_id IS NULL THEN 'not_observed_in_target' WHEN b.n <> t.n OR b.nf <> t.nf OR b.sc <> t.sc THEN 'changed' ELSE 'same' END AS change_state
    FROM lb b FULL JOIN lt t ON b.source_resource_id = t.source_resource_id AND b.target_resource_id = t.target_resource_id""",
}


def _links(v: Views) -> DataFrame:
    d = v.occurrences(True)
    e = d.groupBy("scan_id", "source_resource_id", "target_resource_id", "source_snapshot_id").agg(F.count("*").alias("n"), F.count_if(F.col("rel") == "nofollow").alias("nf"), F.count_if("in_scope").alias("sc"))
    return compare.link_diff(e.where(F.col("scan_id") == BASE), e.where(F.col("scan_id") == TARGET), ["n", "nf", "sc"])


@BOOK.query("SELECT source_resource_id, target_resource_id, b_n, t_n, change_state FROM links", "dense", extra=LINKS)
def link_diff(v: Views) -> DataFrame:
    return _links(v).select("source_resource_id", "target_resource_id", "b_n", "t_n", "change_state")


@BOOK.query(
    "SELECT id AS resource_id, " + ", ".join(f"count(*) FILTER (WHERE way = '{w}' AND change_state = '{s}') AS {w}_edges_{n}" for w in ("outgoing", "incoming") for s, n in (("newly_observed", "newly_observed"), ("not_observed_in_target", "not_observed"), ("changed", "changed")))
    + " FROM (SELECT 'outgoing' AS way, source_resource_id AS id, change_state FROM links UNION ALL SELECT 'incoming', target_resource_id, change_state FROM links) WHERE change_state <> 'same' GROUP BY 1",
    "dense", extra=LINKS,
)
def page_topology(v: Views) -> DataFrame:
    return compare.topology(_links(v))


@BOOK.query("SELECT CASE change_state WHEN 'newly_observed' THEN change_state WHEN 'not_observed_in_target' THEN change_state ELSE 'observed_in_both' END AS presence_state, change_state, count(*) AS n FROM links GROUP BY 1, 2", "dense", extra=LINKS)
def comparison_counts(v: Views) -> DataFrame:
    return compare.counts(_links(v), "change_state")


COUNTERS = "SELECT scan_id, 'fetch_state' AS kind, fetch_state AS label, count(*) AS n FROM snapshots GROUP BY ALL UNION ALL SELECT scan_id, 'http_status', coalesce(CAST(http_status AS VARCHAR), 'none'), count(*) FROM snapshots GROUP BY ALL UNION ALL SELECT scan_id, 'depth', CAST(crawl_depth AS VARCHAR), count(*) FROM snapshots GROUP BY ALL"


@BOOK.query("SELECT kind, label, coalesce(b.n, 0) AS baseline, coalesce(t.n, 0) AS target, coalesce(t.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT * FROM c WHERE scan_id = 1996) b FULL JOIN (SELECT * FROM c WHERE scan_id = 1997) t USING (kind, label)", "snapshots", extra={"c": COUNTERS})
def summary_delta(v: Views) -> DataFrame:
    c = projection.scan_counters(v.snapshots())
    return compare.summary_delta(c.where(F.col("scan_id") == BASE), c.where(F.col("scan_id") == TARGET))


@BOOK.query(
    """SELECT coalesce(b.target_resource_id, t.target_resource_id) AS target_resource_id, coalesce(b.link_role, t.link_role) AS link_role, coalesce(b.anchor_text, t.anchor_text) AS anchor_text, least(coalesce(b.n, 0), coalesce(t.n, 0)) AS present_in_both, greatest(0, coalesce(t.n, 0) - coalesce(b.n, 0)) AS newly_observed, greatest(0, coalesce(b.n, 0) - coalesce(t.n, 0)) AS not_observed_in_target
    FROM (SELECT target_resource_id, link_role, anchor_text, count(*) n FROM dense WHERE scan_id = 1996 GROUP BY ALL) b FULL JOIN (SELECT target_resource_id, link_role, anchor_text, count(*) n FROM dense WHERE scan_id = 1997 GROUP BY ALL) t ON b.target_resource_id = t.target_resource_id AND b.link_role = t.link_role AND b.anchor_text = t.anchor_text""",
    "dense",
)
def occurrence_bag_diff(v: Views) -> DataFrame:
    d = v.occurrences(True)
    return compare.bag_diff(d.where(F.col("scan_id") == BASE), d.where(F.col("scan_id") == TARGET), ["target_resource_id", "link_role", "anchor_text"])


@BOOK.query()
def comparison_checksum(v: Views) -> DataFrame:
    return projection.checksum(_pages(v))


# ---- all tracked fields ----

_TEXT = lambda c: f"string_agg({c} || '=' || n, ',' ORDER BY {c})"
TRACKED_LINKS = {
    "d": "SELECT *, CASE WHEN dom_path LIKE '%header%' THEN 'header' WHEN dom_path LIKE '%footer%' THEN 'footer' WHEN dom_path LIKE '%nav%' THEN 'nav' WHEN dom_path LIKE '%aside%' THEN 'aside' WHEN dom_path LIKE '%main%' THEN 'main' ELSE 'body' END AS region FROM dense",
    **{c: f"SELECT scan_id, source_snapshot_id, target_resource_id, {_TEXT(c)} AS counts FROM (SELECT scan_id, source_snapshot_id, target_resource_id, {c}, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1, 2, 3" for c in ("link_role", "scope_decision", "region")},
    "sides": """SELECT e.*, r.counts AS roles, s.counts AS scopes, g.counts AS regions FROM (SELECT scan_id, source_snapshot_id, target_resource_id, max(source_resource_id) AS source_resource_id, count(*) AS n, count(DISTINCT nullif(trim(anchor_text), '')) AS anchors, count(*) FILTER (WHERE trim(anchor_text) = '') AS blank,
        count(*) FILTER (WHERE rel = 'nofollow') AS nf, count(*) FILTER (WHERE rel <> 'nofollow') AS fo, count(*) FILTER (WHERE in_scope) AS ins, count(*) FILTER (WHERE NOT in_scope) AS outs FROM d GROUP BY 1, 2, 3) e
        JOIN link_role r USING (scan_id, source_snapshot_id, target_resource_id) JOIN scope_decision s USING (scan_id, source_snapshot_id, target_resource_id) JOIN region g USING (scan_id, source_snapshot_id, target_resource_id)""",
    "paired": f"SELECT coalesce(b.source_resource_id, t.source_resource_id) AS source_resource_id, coalesce(b.target_resource_id, t.target_resource_id) AS target_resource_id, b, t FROM (SELECT sides AS b, * FROM sides WHERE scan_id = {BASE}) b FULL JOIN (SELECT sides AS t, * FROM sides WHERE scan_id = {TARGET}) t ON b.source_resource_id = t.source_resource_id AND b.target_resource_id = t.target_resource_id",
    "counted": "SELECT *, " + " + ".join(f"CAST(b.{c} IS DISTINCT FROM t.{c} AS BIGINT)" for c in ("n", "anchors", "blank", "nf", "fo", "ins", "outs", "roles", "scopes", "regions")) + " AS k FROM paired",
}


@BOOK.query(
    """SELECT source_resource_id, target_resource_id, CASE WHEN b IS NULL THEN 'newly_observed' WHEN t IS NULL THEN 'not_observed_in_target' ELSE 'observed_in_both' END AS presence_state, CASE WHEN b IS NULL OR t IS NULL THEN 0 ELSE k END AS changed_field_count,
    CASE WHEN b IS NULL OR t IS NULL THEN 'not_applicable' WHEN k > 0 THEN 'changed' ELSE 'no_tracked_change' END AS change_state, coalesce(t.n, 0) - coalesce(b.n, 0) AS occurrence_delta FROM counted""",
    "dense", extra=TRACKED_LINKS,
)
def link_diff_full(v: Views) -> DataFrame:
    e = graph.tracked_edges(v.occurrences(dense=True).where(F.col("scan_id").isin(BASE, TARGET)))
    diff = compare.full_link_diff(*(e.where(F.col("scan_id") == k) for k in (BASE, TARGET)))
    return diff.select("source_resource_id", "target_resource_id", "presence_state", "changed_field_count", "change_state", "occurrence_delta")
