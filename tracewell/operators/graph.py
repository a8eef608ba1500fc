"""Link graph: metrics, edges, samples, discovered nodes, neighbourhoods (inventory rows J2-J9, A2-A9, A13, A14, A32, A33, L6-L9, T1, T2, U3, G1-G4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGIONS = ("header", "footer", "nav", "aside", "main")


@dataclass(frozen=True)
class GraphLimits:
    """Limits of a graph read; ``checked`` refuses values outside the allowed range."""

    nodes: int = 100
    edges: int = 250
    unfetched: int = 100
    MAX_NODES = 3000
    MAX_EDGES = 10_000

    def checked(self) -> GraphLimits:
        if not (1 <= self.nodes <= self.MAX_NODES and 0 <= self.edges <= self.MAX_EDGES and 0 <= self.unfetched <= self.MAX_NODES):
            raise ValueError("graph limits out of range")
        return self


def dom_region(path: Column) -> Column:
    """The region of a DOM path; the first that occurs in the order header, footer, nav, aside, main, else body."""
    out = F.lit("body")
    for name in reversed(REGIONS):
        out = F.when(path.ilike(f"%{name}%"), name).otherwise(out)
    return out


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def is_nofollow(rel: Column) -> Column:
    return F.coalesce(rel.ilike("%nofollow%"), F.lit(False))


def page_links(occurrences: DataFrame, scan_id: int | None = None) -> DataFrame:
    out = occurrences.where(F.col("relation_type") == "page_link")
    return out if scan_id is None else out.where(F.col("scan_id") == scan_id)


def inbound_metrics(occurrences: DataFrame) -> DataFrame:
    """Per target: occurrences and distinct source snapshots (targets without identity are left out)."""
    return occurrences.where("target_resource_id is not null").groupBy(F.col("target_resource_id").alias("resource_id")).agg(F.count("*").alias("inbound_occurrences"), F.countDistinct("source_snapshot_id").alias("inbound_sources"))


def outbound_metrics(occurrences: DataFrame) -> DataFrame:
    return occurrences.where("target_resource_id is not null").groupBy(F.col("source_resource_id").alias("resource_id")).agg(F.count("*").alias("outbound_occurrences"), F.countDistinct("target_resource_id").alias("outbound_targets"))


def edges(occurrences: DataFrame, snapshots: DataFrame, self_links: bool = True) -> DataFrame:
    """One row an edge (source snapshot, target resource) with counts, region counts and first and last sighting.

    Occurrences are grouped before the join to the target's snapshot: the join then moves edges, not occurrences."""
    region = dom_region(F.col("dom_path"))
    grouped = occurrences.where("target_resource_id is not null")
    if not self_links:
        grouped = grouped.where("source_resource_id != target_resource_id")
    grouped = grouped.groupBy("scan_id", "source_snapshot_id", "source_resource_id", "target_resource_id").agg(
        F.count("*").alias("occurrence_count"),
        F.countDistinct(F.nullif(F.trim("anchor_text"), F.lit(""))).alias("unique_anchor_text_count"),
        F.count_if(is_nofollow(F.col("rel"))).alias("nofollow_occurrence_count"),
        F.count_if(blank(F.col("anchor_text"))).alias("empty_anchor_occurrence_count"),
        F.min("discovered_at").alias("first_discovered_at"),
        F.max("discovered_at").alias("last_discovered_at"),
        *[F.count_if(region == r).alias(f"{r}_dom_count") for r in REGIONS],
    )
    target = snapshots.select("scan_id", F.col("resource_id").alias("target_resource_id"), F.col("id").alias("target_snapshot_id"))
    residual = F.greatest(F.lit(0).cast("long"), F.col("occurrence_count") - sum((F.col(f"{r}_dom_count") for r in REGIONS), F.lit(0)))
    return grouped.join(target, ["scan_id", "target_resource_id"], "left").withColumn("body_dom_count", residual)


def tracked_edges(occurrences: DataFrame) -> DataFrame:
    """Edges with everything that a comparison of two scans tracks: counts, self link, maps of roles, scopes and regions."""
    keys = ["source_snapshot_id", "target_resource_id"]
    known = occurrences.where("target_resource_id is not null")
    rows = known.groupBy("scan_id", *keys).agg(
        F.max("source_resource_id").alias("source_resource_id"), F.count("*").alias("occurrence_count"), F.countDistinct(F.nullif(F.trim("anchor_text"), F.lit(""))).alias("unique_anchor_text_count"),
        F.count_if(blank(F.col("anchor_text"))).alias("empty_anchor_occurrence_count"), F.count_if(~is_nofollow(F.col("rel"))).alias("follow_count"), F.count_if(is_nofollow(F.col("rel"))).alias("nofollow_occurrence_count"),
        F.count_if("in_scope").alias("in_scope_count"), F.count_if(~F.col("in_scope")).alias("out_scope_count"),
    )
    maps = counter_maps(edge_counters(known.withColumn("region", dom_region(F.col("dom_path"))), "role=link_role", "scope=scope_decision", "region=region"))
    wide = maps.groupBy(*keys).pivot("kind", ["region", "role", "scope"]).agg(F.first("counts")).select(*keys, *[F.col(k).alias(f"{k}_counts") for k in ("region", "role", "scope")])
    return rows.withColumn("self_link", F.col("source_resource_id") == F.col("target_resource_id")).join(wide, keys, "left")


def edge_page(found: DataFrame, limit: int = 250) -> DataFrame:
    """The first edges by source, then fetched targets before others, then target."""
    return found.orderBy("source_snapshot_id", F.asc_nulls_last("target_snapshot_id"), "target_resource_id").limit(limit)


def edge_totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("available_edges"), F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("available_occurrences"))


def edge_counters(occurrences: DataFrame, *kinds: str) -> DataFrame:
    """Counters of an edge as rows: source, target, kind (of ``kinds``), label, n."""
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c), F.lit("legacy_unclassified")).alias("label")) for k, c in (x.split("=") for x in kinds)])).alias("x")
    return occurrences.select("source_snapshot_id", "target_resource_id", stacked).groupBy("source_snapshot_id", "target_resource_id", "x.kind", "x.label").agg(F.count("*").alias("n"))


def counter_maps(counters: DataFrame) -> DataFrame:
    """The counters of each edge and kind as one map with sorted keys."""
    return counters.groupBy("source_snapshot_id", "target_resource_id", "kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("counts"))


def anchor_samples(occurrences: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` distinct trimmed anchors of each edge, in order.

    Anchors are made distinct, then ranked with a limit that each task applies before the shuffle, so that no more than
    ``n`` of an edge are ever collected."""
    text = F.trim("anchor_text")
    distinct = occurrences.where(F.coalesce(text, F.lit("")) != "").select("source_snapshot_id", "target_resource_id", text.alias("anchor")).distinct()
    rank = F.row_number().over(Window.partitionBy("source_snapshot_id", "target_resource_id").orderBy("anchor"))
    first = distinct.withColumn("rank", rank).where(F.col("rank") <= n)
    return first.groupBy("source_snapshot_id", "target_resource_id").agg(F.array_sort(F.collect_list("anchor")).alias("anchors"))


def node_metrics(snapshots: DataFrame, occurrences: DataFrame, resources: DataFrame) -> DataFrame:
    """Snapshots with both metrics (zero where there is none) and their URL."""
    zero = ["inbound_occurrences", "inbound_sources", "outbound_occurrences", "outbound_targets"]
    out = snapshots.join(inbound_metrics(occurrences), "resource_id", "left").join(outbound_metrics(occurrences), "resource_id", "left")
    return out.join(resources.select(F.col("id").alias("resource_id"), "normalized_url", "host"), "resource_id").fillna(0, subset=zero)


def node_top(metrics: DataFrame, limits: GraphLimits, starting_url: str = "") -> DataFrame:
    """The graph's nodes: starting page, depth, inbound sources, outbound targets, URL, id."""
    n = limits.checked().nodes
    return metrics.withColumn("is_start", starting_page(F.col("normalized_url"), starting_url)).orderBy(F.desc("is_start"), "crawl_depth", F.desc("inbound_sources"), F.desc("outbound_targets"), "normalized_url", "id").limit(n)


def starting_page(url: Column, starting_url: str, exact: bool = False) -> Column:
    """Whether a URL is the starting page; unless ``exact``, a trailing slash makes no difference."""
    return url == F.lit(starting_url) if exact else F.rtrim(url, F.lit("/")) == F.lit(starting_url.rstrip("/"))


def truncation_reasons(available: dict[str, int], limits: GraphLimits) -> list[str]:
    """Which limits cut the graph, by name."""
    asked = {"node_limit": ("nodes", limits.nodes), "edge_limit": ("edges", limits.edges), "unfetched_node_limit": ("unfetched", limits.unfetched)}
    return [name for name, (key, most) in asked.items() if available.get(key, 0) > most]


def truncated(limits: GraphLimits, nodes: Column, edges: Column, unfetched: Column) -> Column:
    """``truncation_reasons`` of numbers in columns, for many graphs at once; null counts as zero."""
    asked = {"node_limit": (nodes, limits.nodes), "edge_limit": (edges, limits.edges), "unfetched_node_limit": (unfetched, limits.unfetched)}
    return F.filter(F.array(*[F.when(available > most, F.lit(name)) for name, (available, most) in asked.items()]), lambda x: x.isNotNull())


def discovered_nodes(occurrences: DataFrame, snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """Targets that were linked but not fetched in their scan, with occurrences and distinct sources."""
    seen = snapshots.select("scan_id", F.col("resource_id").alias("target_resource_id"))
    out = occurrences.where("target_resource_id is not null").join(seen, ["scan_id", "target_resource_id"], "left_anti")
    out = out.groupBy("scan_id", "target_resource_id").agg(F.count("*").alias("inbound_occurrences"), F.countDistinct("source_snapshot_id").alias("inbound_sources"))
    return out if limit is None else out.orderBy(F.desc("inbound_sources"), F.desc("inbound_occurrences"), "scan_id", "target_resource_id").limit(limit)


def edges_between(occurrences: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Occurrences whose source snapshot and target resource are both in the given id sets."""
    return occurrences.join(sources.select(F.col("id").alias("source_snapshot_id")), "source_snapshot_id", "left_semi").join(targets.select(F.col("id").alias("target_resource_id")), "target_resource_id", "left_semi")


def of_edges(occurrences: DataFrame, keys: DataFrame) -> DataFrame:
    """Occurrences of the given (source_snapshot_id, target_resource_id) pairs."""
    return occurrences.join(keys, ["source_snapshot_id", "target_resource_id"], "left_semi")


def inbound_summary(occurrences: DataFrame) -> DataFrame:
    return occurrences.where("target_resource_id is not null").groupBy("target_resource_id").agg(
        F.count("*").alias("total"),
        F.countDistinct("source_snapshot_id").alias("sources"),
        F.countDistinct(F.nullif(F.trim("anchor_text"), F.lit(""))).alias("anchors"),
        F.count_if(is_nofollow(F.col("rel"))).alias("nofollow"),
        F.count_if(F.col("source_resource_id") == F.col("target_resource_id")).alias("self_links"),
    )


def outgoing_summary(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("source_snapshot_id").agg(F.count("*").alias("total"), F.count_if(is_nofollow(F.col("rel"))).alias("nofollow"), F.count_if("in_scope").alias("in_scope"))


def role_counts(occurrences: DataFrame, key: str) -> DataFrame:
    return occurrences.groupBy(key, F.coalesce("link_role", F.lit("legacy_unclassified")).alias("role")).agg(F.count("*").alias("n"))


def neighbours(edge_pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outgoing and incoming neighbours of ``nodes`` (id), each once; ``edge_pairs`` has (a, b)."""
    out = edge_pairs.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
    return out.union(edge_pairs.join(nodes.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id"))).distinct()


def neighbourhood(edge_pairs: DataFrame, start: DataFrame, hops: int, max_nodes: int | None = None) -> DataFrame:
    """(id, hop) of all nodes within ``hops`` of ``start`` (id), undirected, nearest first; ties by ascending id."""
    found = start.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = found
    for hop in range(1, hops + 1):
        frontier = neighbours(edge_pairs, frontier).join(found, "id", "left_anti").withColumn("hop", F.lit(hop))
        found = found.unionByName(frontier)
    return found if max_nodes is None else found.orderBy("hop", "id").limit(max_nodes)


# ---- derived display values ----


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def node_size(metric: Column) -> Column:
    return clamp(F.lit(3.0) + F.sqrt(metric.cast("double")) * 2.2, 3.0, 16.0)


def depth_size(depth: Column) -> Column:
    return clamp(F.lit(8.0) - depth.cast("double"), 3.0, 16.0)


def edge_width(count: Column) -> Column:
    return clamp(F.lit(1.0) + F.sqrt(count.cast("double")), 1.0, 6.0)


def without_isolates(nodes: DataFrame, edge_pairs: DataFrame) -> DataFrame:
    """Nodes (id, is_start) that have an edge, and starting nodes."""
    linked = edge_pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("linked", F.lit(True))
    return nodes.join(linked, "id", "left").where(F.coalesce("linked", F.lit(False)) | F.col("is_start")).drop("linked")
