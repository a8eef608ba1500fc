"""From extracted facts to evidence rows, and trees over them (inventory rows X7, X10-X13, A26, A27, J26, P17, L14, T7, G2, F21, J19, Q9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- identities and occurrences ----


def resources_of(urls: DataFrame, url: str, version: str) -> DataFrame:
    """One resource an identity (version, normalised URL), with an id that any run gives it."""
    u = urls.where(F.col(url).isNotNull()).select(F.col(url).alias("normalized_url")).distinct()
    p = u.withColumn("normalization_version", F.lit(version))
    return p.select(F.xxhash64("normalization_version", "normalized_url").alias("id"), "normalization_version", "normalized_url", F.lower(F.try_parse_url("normalized_url", F.lit("HOST"))).alias("host"), F.coalesce(F.nullif(F.try_parse_url("normalized_url", F.lit("PATH")), F.lit("")), F.lit("/")).alias("path"))


def anchor_occurrences(anchors: DataFrame, resources: DataFrame) -> DataFrame:
    """Anchors (normalized_target_url, scope_decision) with their target's id; targets that are no identity stay without."""
    r = resources.select(F.col("id").alias("target_resource_id"), F.col("normalized_url").alias("normalized_target_url"))
    return anchors.join(r, "normalized_target_url", "left").withColumn("in_scope", F.col("scope_decision").isin("crawlable", "already_seen"))


def reference_occurrences(references: DataFrame, resources: DataFrame) -> DataFrame:
    """Embedded references with their target's id; those that are no identity are left out."""
    r = resources.select(F.col("id").alias("target_resource_id"), F.col("normalized_url").alias("normalized_target_url"))
    return references.join(r, "normalized_target_url")


def link_documents(references: DataFrame, children: DataFrame, entries: DataFrame) -> DataFrame:
    """References with the child snapshot and the inventory entry of their URL, null where there is none."""
    c = children.groupBy("normalized_url").agg(F.max("id").alias("child_snapshot_id"))
    e = entries.groupBy("normalized_url").agg(F.min("id").alias("entry_id"))
    return references.join(c, "normalized_url", "left").join(e, "normalized_url", "left")


# ---- sections ----


def section_faults(sections: DataFrame) -> DataFrame:
    """Documents whose sections contradict themselves: (page_id, fault).

    Positions run from zero without gaps, parents stand before their children, and a section's subtree counts are its
    own plus its children's."""
    n = sections.groupBy("page_id").agg(F.count("*").alias("n"), F.min("position").alias("low"), F.max("position").alias("high"), F.countDistinct("position").alias("distinct"))
    gaps = n.where("low != 0 or high != n - 1 or distinct != n").select("page_id", F.lit("positions").alias("fault"))
    order = sections.where("parent is not null and parent >= position").select("page_id", F.lit("parent_order").alias("fault"))
    below = sections.where("parent is not null").groupBy("page_id", F.col("parent").alias("position")).agg(F.sum("subtree_words").alias("w"), F.count("*").alias("c"), F.sum(F.col("descendants") + 1).alias("d"))
    sums = sections.join(below, ["page_id", "position"], "left").fillna(0, subset=["w", "c", "d"]).where("subtree_words != words + w or children != c or descendants != d").select("page_id", F.lit("subtree").alias("fault"))
    return gaps.union(order).union(sums).distinct()


def content_status(pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Whether structured content can be read: not_applicable without a blob, not_prepared without an artifact, else its state."""
    a = artifacts.select("sha256", "extraction_state")
    state = F.when(F.col("sha256").isNull(), "not_applicable").when(F.col("extraction_state").isNull(), "not_prepared").otherwise(F.col("extraction_state"))
    return pages.join(a, "sha256", "left").withColumn("content_status", state)


#: Why content is partial, missing or can't be read.
CONTENT_REASONS = {
    "not_applicable": "This observation has no retained HTML ContentBlob.", "not_prepared": "Structured content has not been prepared for this retained HTML blob.",
    "partial": "Extraction completed with deterministic bounds.", "unavailable": "The retained HTML could not be parsed.",
}


def content_page(pages: DataFrame, artifacts: DataFrame, sections: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of the sections of each of ``pages`` (with sha256), as rows with content_status, reason and total; a page
    without sections there is one row whose section columns are null.

    ``artifacts`` has sha256, extraction_state and section_count, ``sections`` sha256, position and others. Positions run from
    zero without gaps (``section_faults``), so a page of them is a filter that reaches the scan, not a sort."""
    if limit < 1 or offset < 0:
        raise ValueError("page out of range")
    status = content_status(pages, artifacts)
    total = artifacts.select("sha256", F.col("section_count").alias("total"))
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in CONTENT_REASONS.items() for x in pair]), F.col("content_status"))
    shown = sections.where(F.col("position").between(offset, offset + limit - 1))
    return status.withColumn("reason", reason).join(total, "sha256", "left").withColumn("total", F.coalesce("total", F.lit(0))).join(shown, "sha256", "left")


# ---- rendered pages ----

ARTIFACTS = ("screenshot", "dom", "network_log")


def artifact_flags(artifacts: DataFrame) -> DataFrame:
    """Per observation which artifacts it has, and how many."""
    return artifacts.groupBy("observation_id").agg(*[F.bool_or(F.col("artifact_type") == t).alias(f"has_{t}") for t in ARTIFACTS], F.count("*").alias("artifacts"))


def rendered_index(observed: DataFrame, flags: DataFrame) -> DataFrame:
    """Rendered observations with artifact flags and the additive evidence score that sorts them."""
    out = observed.join(flags, "observation_id", "left").fillna(False, subset=[f"has_{t}" for t in ARTIFACTS]).fillna(0, subset=["artifacts"])
    score = F.col("network_count") + F.col("console_count") + F.col("error_count") + F.col("artifacts")
    return out.withColumn("evidence_score", score)


def category_key(by: str) -> Column:
    """What colours a graph node: status, fetch_state, depth, host, path, error or seed. Discovered nodes are one group."""
    first = F.filter(F.split(F.col("path"), "/"), lambda x: x != "")
    error = F.col("error_type")
    keys = {
        "status": lambda: F.when(error.isNotNull(), "Crawler error").when(F.col("http_status").isNull(), "No HTTP status").otherwise(F.concat(F.floor(F.col("http_status") / 100).cast("string"), F.lit("xx"))),
        "fetch_state": lambda: F.coalesce("fetch_state", F.lit("Unknown fetch state")), "depth": lambda: F.coalesce(F.concat(F.lit("Depth "), F.col("crawl_depth").cast("string")), F.lit("Depth unknown")),
        "host": lambda: F.coalesce("host", F.lit("Host unknown")), "path": lambda: F.when(F.coalesce(F.size(first), F.lit(0)) <= 0, "/").otherwise(F.concat(F.lit("/"), F.try_element_at(first, F.lit(1)), F.lit("/"))),
        "error": lambda: F.coalesce(error, F.lit("No crawler error")), "seed": lambda: F.when(F.col("is_seed"), "Scan seed").otherwise("Discovered by crawl"),
    }
    return F.when(F.col("kind") == "discovered", "Discovered").otherwise(keys[by]())


# ---- trees ----


def parent_counts(references: DataFrame) -> DataFrame:
    """References per child document."""
    return references.where("child_id is not null").groupBy("child_id").agg(F.count("*").alias("parents"), F.countDistinct("parent_id").alias("distinct_parents"))


def url_hierarchy(pages: DataFrame) -> DataFrame:
    """(host, path, parent_path): the longest recorded path of the host above each path; null at the top.

    Paths are compared by their segments, so a trailing slash makes no difference. Each path names its own ancestors,
    so this is an equality join, not a comparison of prefixes."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    p = pages.select("host", parts.alias("parts")).distinct().select("host", "parts", F.concat(F.lit("/"), F.array_join("parts", "/")).alias("path"))
    above = F.when(F.size("parts") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("parts") - 1)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, k), "/"))))
    named = p.select("host", "path", F.explode(above).alias("parent_path"))
    hit = named.join(p.select("host", F.col("path").alias("parent_path")), ["host", "parent_path"], "left_semi")
    best = hit.groupBy("host", "path").agg(F.max_by("parent_path", F.length("parent_path")).alias("parent_path"))
    return p.select("host", "path").join(best, ["host", "path"], "left")


def rule_occurrences(nodes: DataFrame, rules: DataFrame, observations: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes with the rule row, the observation and the page that they were found in."""
    return nodes.join(rules, "rule_row_id").join(observations, "observation_id").join(pages, "resource_id")
