"""Canonical evidence tables made from the driver's tables.

``Views`` is the Spark side; ``VIEW_SQL`` states the same definitions for the oracle. A scan is a year of orders, a
resource is a customer or part key, a snapshot is a customer's latest order of the year, a link occurrence is a line
item of such an order (duplicates stay), an observation is an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Lines of orders in a task, about: what sorts and groups of a task hold does not grow with the tables.
TASK_ROWS = 200_000


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def scans(self) -> DataFrame:
        return self.table("orders").groupBy(F.year("o_orderdate").cast("long").alias("scan_id")).agg(F.min("o_orderdate").alias("created_at"))

    def snapshots(self) -> DataFrame:
        """One observation of a resource a scan: the latest by (fetched_at, id)."""
        o = self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.year("o_orderdate").cast("long").alias("scan_id"),
            F.col("o_custkey").alias("resource_id"),
            F.col("o_orderdate").alias("fetched_at"),
            F.col("o_orderstatus").alias("fetch_state"),
            F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 301).cast("long").alias("http_status"),
            F.substring("o_orderpriority", 1, 1).cast("long").alias("crawl_depth"),
            F.floor("o_totalprice").cast("long").alias("response_time_ms"),
        )
        w = Window.partitionBy("scan_id", "resource_id").orderBy(F.desc("fetched_at"), F.desc("id"))
        return o.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")

    def tasks(self) -> int:
        """Tasks for what is made of line items: they follow the number of rows."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table("lineitem").count() // TASK_ROWS))

    def occurrences(self, dense: bool = False) -> DataFrame:
        """Link occurrences of the snapshots; ``dense`` maps targets to ten resources, so that edges repeat."""
        table = self.table("lineitem")
        # Dealt by the source, which grouping edges then does not shuffle again, to tasks that follow the number of rows.
        tasks = self.tasks()
        line = table.select(
            F.col("l_orderkey").alias("source_snapshot_id"),
            (F.col("l_suppkey") % 10 if dense else F.col("l_partkey")).cast("long").alias("target_resource_id"),
            F.lit("page_link").alias("relation_type"),
            F.col("l_returnflag").alias("link_role"),
            F.col("l_linestatus").alias("scope_decision"),
            (F.col("l_linestatus") == "O").alias("in_scope"),
            F.when(F.col("l_tax") == 0, "nofollow").otherwise("").alias("rel"),
            F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("Anchor "), F.col("l_linenumber").cast("string"))).alias("anchor_text"),
            F.element_at(F.array(*map(F.lit, DOM_PATHS)), (F.col("l_suppkey") % len(DOM_PATHS) + 1).cast("int")).alias("dom_path"),
            F.col("l_shipdate").alias("discovered_at"),
        )
        s = self.snapshots().select(F.col("id").alias("source_snapshot_id"), F.col("scan_id"), F.col("resource_id").alias("source_resource_id"))
        return line.repartition(tasks, "source_snapshot_id").join(s.repartition(tasks, "source_snapshot_id"), "source_snapshot_id")

    def resources(self) -> DataFrame:
        c = self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("normalized_url"), F.col("c_mktsegment").alias("host"))
        p = self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("normalized_url"), F.col("p_brand").alias("host"))
        return c.unionByName(p.join(c.select("id"), "id", "left_anti"))

    def observations(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("resource_id"), F.col("event_type").alias("profile"), F.col("ts").alias("observed_at"),
            F.when(F.col("value") < 5, "failed").otherwise("ready").alias("outcome"), F.col("value").alias("metric"), F.get_json_object("props", "$.k").cast("long").alias("rule_id"),
        )

    def blobs(self) -> DataFrame:
        return self.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("size"), "source", "lang")


DOM_PATHS = ["html/body/header/nav/a", "html/body/main/p/a", "html/body/nav/a", "html/body/aside/a", "html/body/footer/a", "html/body/div/a"]

VIEW_SQL = {
    "scans": "SELECT CAST(year(o_orderdate) AS BIGINT) AS scan_id, min(o_orderdate) AS created_at FROM orders GROUP BY 1",
    "snapshots": """SELECT * EXCLUDE (rn) FROM (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS scan_id, o_custkey AS resource_id, o_orderdate AS fetched_at, o_orderstatus AS fetch_state,
        CAST(CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 301 END AS BIGINT) AS http_status, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS crawl_depth, CAST(floor(o_totalprice) AS BIGINT) AS response_time_ms,
        row_number() OVER (PARTITION BY year(o_orderdate), o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "occurrences": """SELECT l_orderkey AS source_snapshot_id, l_partkey AS target_resource_id, 'page_link' AS relation_type, l_returnflag AS link_role, l_linestatus AS scope_decision, l_linestatus = 'O' AS in_scope,
        CASE WHEN l_tax = 0 THEN 'nofollow' ELSE '' END AS rel, CASE WHEN l_linenumber = 1 THEN '' ELSE 'Anchor ' || l_linenumber END AS anchor_text,
        ['html/body/header/nav/a', 'html/body/main/p/a', 'html/body/nav/a', 'html/body/aside/a', 'html/body/footer/a', 'html/body/div/a'][CAST(l_suppkey % 6 AS INT) + 1] AS dom_path, l_shipdate AS discovered_at,
        s.scan_id, s.resource_id AS source_resource_id FROM lineitem JOIN snapshots s ON s.id = l_orderkey""",
    "dense": """SELECT l_orderkey AS source_snapshot_id, l_suppkey % 10 AS target_resource_id, 'page_link' AS relation_type, l_returnflag AS link_role, l_linestatus AS scope_decision, l_linestatus = 'O' AS in_scope,
        CASE WHEN l_tax = 0 THEN 'nofollow' ELSE '' END AS rel, CASE WHEN l_linenumber = 1 THEN '' ELSE 'Anchor ' || l_linenumber END AS anchor_text,
        ['html/body/header/nav/a', 'html/body/main/p/a', 'html/body/nav/a', 'html/body/aside/a', 'html/body/footer/a', 'html/body/div/a'][CAST(l_suppkey % 6 AS INT) + 1] AS dom_path, l_shipdate AS discovered_at,
        s.scan_id, s.resource_id AS source_resource_id FROM lineitem JOIN snapshots s ON s.id = l_orderkey""",
    "resources": "SELECT c_custkey AS id, c_name AS normalized_url, c_mktsegment AS host FROM customer UNION ALL SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)",
    "observations": "SELECT event_id AS id, user_id AS resource_id, event_type AS profile, ts AS observed_at, CASE WHEN value < 5 THEN 'failed' ELSE 'ready' END AS outcome, value AS metric, CAST(json_extract_string(props, '$.k') AS BIGINT) AS rule_id FROM events",
    "blobs": "SELECT doc_id, sha256(text) AS sha256, length(text) AS size, source, lang FROM documents",
}
NEEDS = {"occurrences": ["snapshots"], "dense": ["snapshots"]}


def oracle(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """Oracle SQL: ``body`` after the definitions of the views it names (and theirs), then ``extra`` ones."""
    names: list[str] = []
    for v in views:
        for x in [*NEEDS.get(v, []), v]:
            if x not in names:
                names.append(x)
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
