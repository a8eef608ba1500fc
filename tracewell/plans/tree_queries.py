"""Queries over evidence rows and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup, urls
from ..operators import evidence, frontier, graph
from ..sources import documents as sources
from ..sources.fixtures import Views
from .book import Book

BOOK = Book()
PARTS = "SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM pages"


@BOOK.query(
    "SELECT a.host, a.path, max_by(b.path, length(b.path)) AS parent_path FROM p a LEFT JOIN p b ON a.host = b.host AND a.path <> b.path AND (b.path = '/' OR starts_with(a.path, b.path || '/')) GROUP BY 1, 2",
    extra={"u": f"SELECT DISTINCT host, CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS path FROM ({PARTS})", "p": "SELECT host, path FROM u UNION SELECT host, regexp_replace(path, '/[^/]*$', '') FROM u WHERE path LIKE '/%/%'"},
)
def url_hierarchy(v: Views) -> DataFrame:
    p = v.table("pages").select(urls.parts(F.col("url")).alias("u")).select("u.host", F.regexp_replace("u.path", "(?<=.)/+$", "").alias("path")).distinct()
    up = p.where(F.col("path").like("/%/%")).select("host", F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return evidence.url_hierarchy(p.union(up).distinct())


#: A tree of thirds over all parts, with references back to the grandparent, from some to themselves, and between pairs of neighbours.
REFS = {
    "refs": """SELECT p_partkey // 3 AS parent_id, p_partkey AS position, p_partkey AS child_id FROM part UNION ALL SELECT p_partkey, 2000000000 + p_partkey, p_partkey // 9 FROM part WHERE p_partkey % 5 = 0
    UNION ALL SELECT p_partkey, 3000000000 + p_partkey, p_partkey + 1 - 2 * (p_partkey % 2) FROM part WHERE p_partkey % 8 > 5 UNION ALL SELECT p_partkey, 4000000000, p_partkey FROM part WHERE p_partkey % 13 = 0""",
    "files": "SELECT p_partkey AS id, CAST(100 * p_size AS BIGINT) AS bytes, p_partkey % 4 <> 2 AS is_index FROM part WHERE p_partkey % 11 <> 0",
}


def _refs(v: Views) -> DataFrame:
    k = F.col("k")
    p = v.table("part").select(F.col("p_partkey").alias("k"))
    ref = lambda rows, parent, position, child: rows.select(parent.cast("long").alias("parent_id"), position.cast("long").alias("position"), child.cast("long").alias("child_id"))
    out = ref(p, F.floor(k / 3), k, k).unionByName(ref(p.where("k % 5 = 0"), k, k + 2_000_000_000, F.floor(k / 9)))
    return out.unionByName(ref(p.where("k % 8 > 5"), k, k + 3_000_000_000, k + 1 - 2 * (k % 2))).unionByName(ref(p.where("k % 13 = 0"), k, F.lit(4_000_000_000), k))


def _files(v: Views) -> DataFrame:
    return v.table("part").where("p_partkey % 11 != 0").select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("long") * 100).alias("bytes"), (F.col("p_partkey") % 4 != 2).alias("is_index"))


def _root(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(1, 1)], "id long, position long")


@BOOK.query("SELECT child_id, count(*) AS parents, count(DISTINCT parent_id) AS distinct_parents FROM refs GROUP BY 1", extra=REFS)
def document_parent_counts(v: Views) -> DataFrame:
    return evidence.parent_counts(_refs(v))


def _tree_sql(depth: int, documents: int, size: int, indexes: int) -> dict[str, str]:
    """The expansion in order, level by level: documents d, references l; ``reach`` says who reaches whom among them."""
    out = {"q0": "SELECT 1 AS id, 0 AS first, 1 AS second, [1] AS path"}
    for k in range(depth + 1):
        base = "0 AS n, 0 AS b, 0 AS x" if not k else "max(number) AS n, max(total_bytes) AS b, max(indexes) AS x FROM (" + " UNION ALL ".join(f"SELECT * FROM d{j}" for j in range(k)) + ")"
        out[f"n{k}"] = f"""SELECT q.*, f.bytes, f.is_index, {k} AS depth, n + row_number() OVER o AS number, b + sum(coalesce(bytes, 0)) OVER o AS total_bytes, x + sum(CASE WHEN is_index THEN 1 ELSE 0 END) OVER o AS indexes
            FROM q{k} q LEFT JOIN files f USING (id), (SELECT {base}) WINDOW o AS (ORDER BY first, second, id ROWS UNBOUNDED PRECEDING)"""
        out[f"d{k}"] = f"SELECT * FROM n{k} WHERE number <= {documents} AND total_bytes <= {size}"
        out[f"l{k}"] = f"SELECT parent_id, position, child_id, number AS first, path, list_contains(path, child_id) AS forms_cycle, {k} < {depth} AND indexes < {indexes} AND NOT list_contains(path, child_id) AS followed FROM d{k} JOIN refs ON parent_id = d{k}.id WHERE is_index"
        stopped = f"(SELECT count(*) FROM n{k}) = (SELECT count(*) FROM d{k})"
        met = " UNION ALL ".join(f"SELECT id FROM d{j}" for j in range(k + 1))
        out[f"q{k + 1}"] = f"SELECT child_id AS id, arg_min(first, (first, position)) AS first, arg_min(position, (first, position)) AS second, list_append(arg_min(path, (first, position)), child_id) AS path FROM l{k} WHERE followed AND {stopped} AND child_id NOT IN ({met}) GROUP BY child_id"
    out["d"] = " UNION ALL ".join(f"SELECT id, depth, number, total_bytes, is_index FROM d{k}" for k in range(depth + 1))
    out["l"] = " UNION ALL ".join(f"SELECT parent_id, position, child_id, forms_cycle, followed FROM l{k}" for k in range(depth + 1))
    out["e"] = "SELECT DISTINCT parent_id AS a, child_id AS b FROM l WHERE child_id IN (SELECT id FROM d)"
    return REFS | out


REACH = "WITH RECURSIVE reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)"
LOOPS = "SELECT l.*, p.depth AS depth, EXISTS (SELECT 1 FROM reach WHERE a = child_id AND b = parent_id) AND c.depth <= p.depth AS closes_loop FROM l JOIN d p ON p.id = parent_id LEFT JOIN d c ON c.id = child_id"


@BOOK.query(f"SELECT * FROM ({REACH} SELECT parent_id, position, child_id, forms_cycle, followed, coalesce(closes_loop, FALSE) AS closes_loop FROM ({LOOPS}))", extra=_tree_sql(4, 100000, 1 << 30, 100000))
def document_tree_references(v: Views) -> DataFrame:
    tree = frontier.document_tree(_refs(v), _files(v), _root(v), 4, 100_000, 1 << 30, 100_000)
    return tree.references.select("parent_id", "position", "child_id", "forms_cycle", "followed", "closes_loop")


@BOOK.query(
    f"""SELECT * FROM ({REACH} SELECT id, CAST(depth AS INT) AS depth, number, CASE WHEN is_index IS NULL THEN 'not_recorded' WHEN is_index THEN 'index' ELSE 'document' END AS state, coalesce(parents, 0) AS parents, coalesce(in_cycle, FALSE) AS in_cycle, coalesce(closes_loop, FALSE) AS closes_loop
    FROM d LEFT JOIN (SELECT child_id AS id, count(*) AS parents, bool_or(forms_cycle) AS in_cycle, bool_or(closes_loop) AS closes_loop FROM ({LOOPS}) GROUP BY 1) USING (id))""",
    extra=_tree_sql(4, 100000, 1 << 30, 100000),
)
def document_tree(v: Views) -> DataFrame:
    tree = frontier.document_tree(_refs(v), _files(v), _root(v), 4, 100_000, 1 << 30, 100_000)
    return frontier.tree_rows(tree).select("id", "depth", "number", "state", "parents", "in_cycle", "closes_loop")


@BOOK.query("SELECT id, CAST(depth AS INT) AS depth, number, CAST(total_bytes AS BIGINT) AS total_bytes, 'max_total_bytes' AS stop_reason FROM d", extra=_tree_sql(6, 500, 60000, 20))
def document_tree_byte_budget(v: Views) -> DataFrame:
    tree = frontier.document_tree(_refs(v), _files(v), _root(v), 6, 500, 60_000, 20)
    return tree.documents.select("id", "depth", "number", "total_bytes", F.lit(tree.stop_reason).alias("stop_reason"))


@BOOK.query("SELECT id, CAST(depth AS INT) AS depth, number, CAST(total_bytes AS BIGINT) AS total_bytes, 'max_total_documents' AS stop_reason FROM d", extra=_tree_sql(6, 40, 1 << 30, 1000))
def document_tree_document_budget(v: Views) -> DataFrame:
    tree = frontier.document_tree(_refs(v), _files(v), _root(v), 6, 40, 1 << 30, 1000)
    return tree.documents.select("id", "depth", "number", "total_bytes", F.lit(tree.stop_reason).alias("stop_reason"))


def _crawl_sql(depth: int, pages: int) -> dict[str, str]:
    """Steps of a crawl: levels, and when there are none left a round of second tries and their levels. s: pages settled."""
    out = {"tries": "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'retryable' WHEN p_partkey % 10 = 3 THEN 'failed' ELSE 'ok' END AS outcome FROM part", "t0": "SELECT 1 AS id, 1 AS number, 0 AS depth, 1 AS attempt, 'ok' AS outcome"}
    kinds = ["level"] * depth + (["retry"] + ["level"] * depth) * depth
    waits = 0
    for k, kind in enumerate(kinds, 1):
        if kind == "level":
            before = " UNION ALL ".join(f"SELECT id FROM t{j}" for j in range(k))
            out[f"t{k}"] = f"""SELECT f.id, f.number, f.depth, 1 AS attempt, coalesce(tries.outcome, 'ok') AS outcome FROM (SELECT id, depth, (SELECT count(DISTINCT id) FROM ({before})) + row_number() OVER (ORDER BY first, second, id) AS number FROM
                (SELECT child_id AS id, arg_min(t.depth, (t.number, r.position)) + 1 AS depth, arg_min(t.number, (t.number, r.position)) AS first, arg_min(r.position, (t.number, r.position)) AS second FROM t{k - 1} t JOIN (SELECT parent_id, child_id, min(position) AS position FROM refs GROUP BY 1, 2) r ON r.parent_id = t.id
                WHERE t.outcome = 'ok' AND t.depth < {depth} AND child_id NOT IN ({before}) GROUP BY 1)) f LEFT JOIN tries USING (id) WHERE f.number <= {pages}"""
        else:
            since = " UNION ALL ".join(f"SELECT * FROM t{j}" for j in range(waits, k))
            out[f"t{k}"] = f"SELECT id, number, depth, 2 AS attempt, CASE WHEN id % 4 = 0 THEN 'retryable' ELSE 'ok' END AS outcome FROM ({since}) WHERE outcome = 'retryable' AND attempt = 1"
            waits = k
    out["s"] = " UNION ALL ".join(f"SELECT * FROM t{j} WHERE NOT (outcome = 'retryable' AND attempt = 1)" for j in range(len(kinds) + 1))
    return REFS | out


@BOOK.query("SELECT id, CAST(depth AS INT) AS depth, number, CAST(attempt AS INT) AS attempts, outcome FROM s", extra=_crawl_sql(4, 150))
def crawl_order(v: Views) -> DataFrame:
    """Every sixth page is retryable at first, and every twelfth still at the second try; every tenth fails."""
    k = F.col("k")
    p = v.table("part").select(F.col("p_partkey").alias("k"))
    first = p.select(k.alias("id"), F.lit(1).alias("attempt"), F.when(k % 6 == 0, "retryable").when(k % 10 == 3, "failed").otherwise("ok").alias("outcome"))
    second = p.where("k % 6 = 0").select(k.alias("id"), F.lit(2).alias("attempt"), F.when(k % 4 == 0, "retryable").otherwise("ok").alias("outcome"))
    links = _refs(v).select(F.col("parent_id").alias("a"), F.col("child_id").alias("b"), "position")
    return frontier.crawl(links, first.unionByName(second), _root(v), 4, 150, 2)[0]


@BOOK.query("SELECT user_id AS observation_id, bool_or(event_type = 'click') AS has_screenshot, bool_or(event_type = 'view') AS has_dom, bool_or(event_type = 'purchase') AS has_network_log, count(*) AS artifacts FROM events GROUP BY 1")
def artifact_flags(v: Views) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "screenshot").when(F.col("event_type") == "view", "dom").when(F.col("event_type") == "purchase", "network_log").otherwise("other")
    return evidence.artifact_flags(v.table("events").select(F.col("user_id").alias("observation_id"), kind.alias("artifact_type")))


@BOOK.query("SELECT p.doc_id, CASE WHEN p.doc_id % 10 = 0 THEN 'not_applicable' WHEN p.sha256 NOT IN (SELECT sha256 FROM blobs WHERE doc_id % 4 = 1) THEN 'not_prepared' ELSE 'complete' END AS content_status FROM blobs p", "blobs")
def content_status(v: Views) -> DataFrame:
    b = v.blobs()
    done = b.where("doc_id % 4 = 1").select("sha256").distinct().withColumn("extraction_state", F.lit("complete"))
    pages = b.select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("sha256")).alias("sha256"))
    return evidence.content_status(pages, done).select("doc_id", "content_status")


@BOOK.query("SELECT s.id, CASE WHEN fetch_state = 'P' THEN 'Crawler error' WHEN http_status IS NULL THEN 'No HTTP status' ELSE CAST(http_status // 100 AS VARCHAR) || 'xx' END AS status, coalesce('Depth ' || crawl_depth, 'Depth unknown') AS depth, coalesce(fetch_state, 'Unknown fetch state') AS fetch, CASE WHEN resource_id % 3 = 0 THEN '/a/' ELSE '/' END AS path FROM snapshots s", "snapshots")
def node_categories(v: Views) -> DataFrame:
    s = v.snapshots().withColumn("kind", F.lit("page")).withColumn("error_type", F.when(F.col("fetch_state") == "P", "timeout")).withColumn("path", F.when(F.col("resource_id") % 3 == 0, "//a/b").otherwise("/"))
    return s.select("id", *[evidence.category_key(k).alias(n) for k, n in (("status", "status"), ("depth", "depth"), ("fetch_state", "fetch"), ("path", "path"))])


@BOOK.query("SELECT page_id, count(*) AS n FROM pages WHERE html LIKE '%<h1>%' AND page_id % 2 = 0 GROUP BY 1")
def section_validation(v: Views) -> DataFrame:
    """The first headings of every second page say that they are their own parents; these pages, and no others, are faulty."""
    s = markup.page_sections(v.table("pages"))
    broken = (F.col("page_id") % 2 == 0) & (F.col("level") == 1)
    moved = s.withColumn("parent", F.when(broken, F.col("position")).otherwise(F.col("parent")))
    return evidence.section_faults(moved).groupBy("page_id").agg(F.lit(1).cast("long").alias("n"))


@BOOK.query()
def page_occurrences(v: Views) -> DataFrame:
    """Anchors of the recorded pages as occurrences: normalised, scoped and with their target's identity."""
    a = markup.page_anchors(v.table("pages")).select("page_id", "url", "position", "role", urls.normalized(F.col("resolved")).alias("normalized_target_url"))
    p = a.withColumn("u", urls.parts(F.col("normalized_target_url")))
    own = F.lower(F.parse_url("url", F.lit("HOST")))
    decision = F.when(F.col("u.host").isNull(), "invalid_url").when(F.col("u.host") != own, "external").otherwise("crawlable")
    rows = p.select("page_id", "position", "role", "normalized_target_url", decision.alias("scope_decision"))
    return evidence.anchor_occurrences(rows, evidence.resources_of(rows, "normalized_target_url", urls.V2))


@BOOK.query("SELECT r.l_orderkey AS id, r.url AS normalized_url, c.child_snapshot_id, e.entry_id FROM (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS url FROM lineitem) r LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS url, max(o_orderkey) AS child_snapshot_id FROM orders GROUP BY 1) c ON c.url = r.url LEFT JOIN (SELECT CAST(p_size AS VARCHAR) AS url, min(p_partkey) AS entry_id FROM part GROUP BY 1) e ON e.url = r.url")
def linked_references(v: Views) -> DataFrame:
    refs = v.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("normalized_url"))
    children = v.table("orders").select(F.col("o_custkey").cast("string").alias("normalized_url"), F.col("o_orderkey").alias("id"))
    entries = v.table("part").select(F.col("p_size").cast("string").alias("normalized_url"), F.col("p_partkey").alias("id"))
    return evidence.link_documents(refs, children, entries)


@BOOK.query("SELECT kind, n FROM (SELECT 'edges' AS kind, count(*) AS n FROM (SELECT DISTINCT source_snapshot_id, target_resource_id FROM occurrences) UNION ALL SELECT 'nodes', count(*) FROM snapshots)", "occurrences", "snapshots")
def graph_totals(v: Views) -> DataFrame:
    e = graph.edges(v.occurrences(), v.snapshots()).agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "n")
    return e.union(v.snapshots().agg(F.count("*").alias("n")).select(F.lit("nodes"), "n"))


@BOOK.query("SELECT 'n' || c_nationkey AS sitemap_url, 2 AS depth, 'c' || c_custkey AS loc FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region))")
def sitemap_expansion(v: Views) -> DataFrame:
    """Customers as entries of their nations' sitemaps, these as children of their regions', these of one index, which each region names again."""
    return sources.expand_sitemaps(_sitemaps(v), v.spark.createDataFrame([("root",)], "url string"))[1].select("sitemap_url", "depth", "loc")


@BOOK.query("SELECT 'root' AS url, 0 AS depth, 'sitemapindex' AS state UNION ALL SELECT 'root', 2, 'cycle' UNION ALL SELECT 'r' || r_regionkey, 1, 'sitemapindex' FROM region UNION ALL SELECT 'n' || n_nationkey, 2, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 'urlset' ELSE 'not_recorded' END FROM nation")
def sitemap_states(v: Views) -> DataFrame:
    return sources.expand_sitemaps(_sitemaps(v), v.spark.createDataFrame([("root",)], "url string"))[0].select("url", "depth", "state")


def _sitemaps(v: Views) -> DataFrame:
    """Recorded bodies (url, body): an index of regions, an index of nations for each, a list of customers for each nation."""

    def body(rows: DataFrame, url, loc, kind: str, *more: str) -> DataFrame:
        item = "url" if kind == "urlset" else "sitemap"
        part = F.concat(F.lit(f"<{item}><loc>"), loc, F.lit(f"</loc></{item}>"))
        text = F.concat(F.lit(f"<{kind}>"), F.array_join(F.collect_list("part"), ""), F.lit("".join(more) + f"</{kind}>"))
        return rows.select(url.alias("url"), part.alias("part")).groupBy("url").agg(text.cast("binary").alias("body"))

    named = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    root = body(v.table("region"), F.lit("root"), named("r", "r_regionkey"), "sitemapindex")
    regions = body(v.table("nation"), named("r", "n_regionkey"), named("n", "n_nationkey"), "sitemapindex", "<sitemap><loc>root</loc></sitemap>")
    return root.union(regions).union(body(v.table("customer"), named("n", "c_nationkey"), named("c", "c_custkey"), "urlset"))
