"""Deterministic comparison of two scans (inventory rows J16-J19, D1-D18, U4, A17-A19, F23-F25, P9-P11, L10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import json_hash
from ..functions.markup import difference_categories

BOTH, NEW, GONE = "observed_in_both", "newly_observed", "not_observed_in_target"


def eligible(baseline: dict, target: dict) -> None:
    """Raises unless the scans differ, belong to one site and are both finished."""
    if baseline["scan_id"] == target["scan_id"] or baseline["site_id"] != target["site_id"]:
        raise ValueError("two different scans of one site are needed")
    if not {baseline["status"], target["status"]} <= {"completed", "completed_with_errors", "completed_with_warnings", "failed", "cancelled", "interrupted"}:
        raise ValueError("both scans must be finished")


def coverage(baseline: dict, target: dict) -> tuple[str, list[str]]:
    """How far two scans can be compared, and why not fully."""
    warnings = [f"{f}_differs" for f in ("scope", "seeds") if baseline.get(f) != target.get(f)]
    warnings += [f"{side}_{s['status']}" for side, s in (("baseline", baseline), ("target", target)) if s["status"] != "completed"]
    limited = any(s["status"] in ("failed", "cancelled") for s in (baseline, target))
    return "limited" if limited else "comparable_with_warnings" if warnings else "comparable", sorted(warnings)


def full_outer(baseline: DataFrame, target: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both sides' values as ``b_`` and ``t_`` columns by key, with the presence state. Keys are never null."""
    b = baseline.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    t = target.select(*keys, *[F.col(v).alias(f"t_{v}") for v in values], F.lit(True).alias("in_t"))
    presence = F.when(F.col("in_b").isNotNull() & F.col("in_t").isNotNull(), BOTH).when(F.col("in_t").isNotNull(), NEW).otherwise(GONE)
    return b.join(t, keys, "full").withColumn("presence_state", presence).drop("in_b", "in_t")


def differs(value: str) -> Column:
    """Null-safe inequality, only where both sides were observed."""
    return (F.col("presence_state") == BOTH) & ~F.col(f"b_{value}").eqNullSafe(F.col(f"t_{value}"))


def with_flags(pairs: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """A flag for each group of fields that differ, and the number of flags set."""
    for name, fields in groups.items():
        flag = F.lit(False)
        for f in fields:
            flag = flag | differs(f)
        pairs = pairs.withColumn(name, flag)
    return pairs.withColumn("changed_field_count", sum((F.col(n).cast("long") for n in groups), F.lit(0).cast("long")))


def equality_state(value: str) -> Column:
    """not_applicable unless in both, unavailable if a side is unknown, else same or changed."""
    b, t = F.col(f"b_{value}"), F.col(f"t_{value}")
    return F.when(F.col("presence_state") != BOTH, "not_applicable").when(b.isNull() | t.isNull(), "unavailable").when(b == t, "same").otherwise("changed")


def source_state(value: str, exact: Column) -> Column:
    """As ``equality_state``, but an unknown side counts as same if the exact sources are."""
    state = equality_state(value)
    return F.when((state == "unavailable") & (exact == "same"), "same").otherwise(state)


def tuple_state(values: list[str]) -> Column:
    """same or changed for the whole tuple, nulls equal."""
    changed = F.lit(False)
    for v in values:
        changed = changed | differs(v)
    return F.when(F.col("presence_state") != BOTH, "not_applicable").when(changed, "changed").otherwise("same")


def technical_state(flags: list[str]) -> Column:
    changed = F.lit(False)
    for f in flags:
        changed = changed | F.col(f)
    return F.when(F.col("presence_state") != BOTH, "not_applicable").when(changed, "changed").otherwise("same")


def change_class(document: Column, metadata: Column, technical: Column, exact: Column, normalized: Column) -> Column:
    """The first class that applies: substance, metadata, technique, normalisation only, none; else indeterminate."""
    return (
        F.when(F.col("presence_state") != BOTH, "not_applicable")
        .when(document == "changed", "substantive_change")
        .when(metadata == "changed", "metadata_change")
        .when(technical == "changed", "technical_change")
        .when((exact == "changed") & (normalized == "same"), "normalization_only")
        .when(exact == "same", "no_tracked_change")
        .otherwise("indeterminate")
    )


def delta(value: str) -> Column:
    """Target minus baseline, null if a side is."""
    return F.col(f"t_{value}") - F.col(f"b_{value}")


def page_diff(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """Pages of two projections by resource: presence, flags, states, class, response time delta.

    Columns of a side: resource_id, snapshot_id, http_status, fetch_state, crawl_depth, content_hash, document_hash,
    page_title, response_time_ms, inbound_occurrences, outbound_occurrences."""
    values = ["snapshot_id", "http_status", "fetch_state", "crawl_depth", "content_hash", "document_hash", "page_title", "response_time_ms", "inbound_occurrences", "outbound_occurrences"]
    groups = {
        "http_status_changed": ["http_status"], "fetch_state_changed": ["fetch_state"], "depth_changed": ["crawl_depth"], "title_changed": ["page_title"],
        "inbound_links_changed": ["inbound_occurrences"], "outbound_links_changed": ["outbound_occurrences"],
    }
    out = full_outer(baseline, target, ["resource_id"], values)
    out = out.withColumn("exact_source_state", equality_state("content_hash"))
    out = out.withColumn("document_content_state", source_state("document_hash", F.col("exact_source_state"))).withColumn("metadata_state", tuple_state(["page_title"]))
    out = with_flags(out, groups).withColumn("content_changed", F.col("document_content_state") == "changed").withColumn("changed_field_count", F.col("changed_field_count") + F.col("content_changed").cast("long"))
    out = out.withColumn("technical_state", technical_state(["http_status_changed", "fetch_state_changed", "depth_changed", "inbound_links_changed", "outbound_links_changed"]))
    cls = change_class(F.col("document_content_state"), F.col("metadata_state"), F.col("technical_state"), F.col("exact_source_state"), F.col("document_content_state"))
    return out.withColumn("primary_change_class", cls).withColumn("response_time_ms_delta", delta("response_time_ms"))


#: The fields of each flag of a page, the flags that are technical, and the fields of the metadata state.
PAGE_FLAGS = {
    "content_changed": ["content_hash"], "head_changed": ["head_hash"], "http_status_changed": ["http_status"], "fetch_state_changed": ["fetch_state"], "final_url_changed": ["final_url"], "redirect_state_changed": ["redirects"], "content_type_changed": ["content_type"],
    "title_changed": ["page_title"], "canonical_changed": ["canonical_url"], "robots_changed": ["robots_directives"], "language_changed": ["language"], "depth_changed": ["crawl_depth"], "inbound_links_changed": ["inbound_sources", "inbound_occurrences"],
    "outbound_links_changed": ["outbound_targets", "outbound_occurrences"], "embedded_resources_changed": ["embedded_resource_count"], "rendered_state_changed": ["rendered_capture_state"],
    "rendered_counts_changed": ["rendered_network_count", "rendered_console_count", "rendered_page_error_count", "rendered_artifact_count"],
}
TECHNICAL_FLAGS = ["http_status_changed", "fetch_state_changed", "final_url_changed", "redirect_state_changed", "content_type_changed", "depth_changed", "inbound_links_changed", "outbound_links_changed", "embedded_resources_changed", "rendered_state_changed", "rendered_counts_changed"]
METADATA = ["page_title", "meta_description", "canonical_url", "robots_directives", "language"]
SOURCE = {"content_hash": "exact_sha256", "normalized_hash": "normalized_sha256", "dependency_hash": "dependency_sha256", "document_hash": "document_sha256", "volatile": "volatile", "versions": "versions"}
DELTAS = ["response_time_ms", "network_bytes", "raw_html_size", "stored_html_size"]


def full_page_diff(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """Pages of two projections by resource with all 17 flags, the five states, difference categories, class and deltas.

    A side has resource_id, the fields of ``PAGE_FLAGS``, ``METADATA``, ``SOURCE`` (the analysis of its source, null where
    there is none) and ``DELTAS``; whatever it lacks counts as unknown on that side. ``content_changed`` follows the
    document state, not the bytes."""
    fields = list(dict.fromkeys([f for fs in PAGE_FLAGS.values() for f in fs] + METADATA + [*SOURCE] + DELTAS))

    def side(df: DataFrame) -> DataFrame:
        kinds = {"volatile": "array<string>", "versions": "array<string>"}
        return df.withColumns({f: F.lit(None).cast(kinds.get(f, "string")) for f in fields if f not in df.columns})

    out = full_outer(side(baseline), side(target), ["resource_id"], fields)
    exact = equality_state("content_hash")
    out = out.withColumns({"exact_source_state": exact, "normalized_source_state": source_state("normalized_hash", exact), "document_content_state": source_state("document_hash", exact), "metadata_state": tuple_state(METADATA), "head_state": equality_state("head_hash")})
    flags = {n: F.col("document_content_state") == "changed" if n == "content_changed" else reduce(lambda a, b: a | b, [differs(f) for f in fs]) for n, fs in PAGE_FLAGS.items()}
    out = out.withColumns(flags)
    b, t = (F.struct(*[F.col(f"{s}_{f}").alias(k) for f, k in SOURCE.items()]) for s in ("b", "t"))
    analysed = (F.col("presence_state") == BOTH) & F.col("b_normalized_hash").isNotNull() & F.col("t_normalized_hash").isNotNull()
    none = F.array().cast("array<string>")
    out = out.withColumn("source_difference_categories", F.when(analysed, difference_categories(b, t, F.col("metadata_state") == "changed")).otherwise(none))
    technical = reduce(lambda a, b: a | b, [F.col(f) for f in TECHNICAL_FLAGS]) | F.arrays_overlap("source_difference_categories", F.array(F.lit("dependency"), F.lit("unclassified")))
    out = out.withColumn("technical_state", F.when(F.col("presence_state") != BOTH, "not_applicable").when(technical, "changed").otherwise("same"))
    states = [F.col(c) for c in ("document_content_state", "metadata_state", "technical_state", "exact_source_state", "normalized_source_state")]
    out = out.withColumn("primary_change_class", change_class(*states)).withColumn("changed_field_count", sum((F.col(n).cast("long") for n in PAGE_FLAGS), F.lit(0).cast("long")))
    return out.withColumns({f"{d}_delta": F.col(f"t_{d}").cast("double") - F.col(f"b_{d}").cast("double") for d in DELTAS})


def presence_detail(pairs: DataFrame, other: DataFrame, side: str) -> DataFrame:
    """For pages that one side lacks: what that side saw instead, from its latest snapshot that was no page
    (``other``: resource_id, snapshot_id, fetch_state)."""
    o = other.select("resource_id", F.col("snapshot_id").alias("__s"), F.col("fetch_state").alias("__f"))
    detail = F.when(F.col(f"{side}_snapshot_id").isNotNull(), "page_observed").when(F.col("__s").isNull(), "not_observed").when(F.col("__f") == "failed", "fetch_failed").otherwise("observed_as_non_page")
    return pairs.join(o, "resource_id", "left").withColumn(f"{side}_presence_detail", detail).drop("__s", "__f")


def resource_diff(baseline: DataFrame, target: DataFrame, fields: list[str]) -> DataFrame:
    """Resources by id with the number and names of fields that changed."""
    out = full_outer(baseline, target, ["resource_id"], fields)
    changed = F.filter(F.array(*[F.when(differs(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    out = out.withColumn("changed_fields", F.array_join(changed, ",")).withColumn("changed_field_count", F.size(changed).cast("long"))
    state = F.when(F.col("presence_state") != BOTH, F.col("presence_state")).when(F.col("changed_field_count") > 0, "changed").otherwise("same")
    return out.withColumn("change_state", state)


def link_diff(baseline: DataFrame, target: DataFrame, fields: list[str]) -> DataFrame:
    """Links by (source resource, target resource). Of several snapshots of a source the one with the greatest id counts."""
    keys = ["source_resource_id", "target_resource_id"]

    def one(df: DataFrame) -> DataFrame:
        best = df.groupBy(*keys).agg(F.max_by(F.struct(*fields), "source_snapshot_id").alias("r"))
        return best.select(*keys, *[F.col(f"r.{f}").alias(f) for f in fields])

    out = full_outer(one(baseline), one(target), keys, fields)
    changed = sum((differs(f).cast("long") for f in fields), F.lit(0).cast("long"))
    out = out.withColumn("changed_field_count", changed)
    return out.withColumn("change_state", F.when(F.col("presence_state") != BOTH, F.col("presence_state")).when(F.col("changed_field_count") > 0, "changed").otherwise("same"))


#: The fields of a resource and of a link that count as a change.
RESOURCE_FIELDS = [
    "kind", "classification_source", "observed", "discovered_only", "final_url", "http_status", "mime_type", "filename", "declared_size", "occurrence_count", "source_page_count", "anchor_count", "embedded_count",
    "in_scope_count", "out_scope_count", "observed_count",
]
LINK_FIELDS = [
    "occurrence_count", "unique_anchor_text_count", "empty_anchor_occurrence_count", "follow_count", "nofollow_occurrence_count", "self_link", "in_scope_count", "out_scope_count", "role_counts", "scope_counts", "region_counts",
]


def tracked(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """changed_fields, changed_field_count and change_state of ``full_outer`` pairs: which ``fields`` differ, nulls being a
    value, where both sides were observed. Maps must come as sorted entries."""
    changed = F.filter(F.array(*[F.when(differs(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    state = F.when(F.col("presence_state") != BOTH, "not_applicable").when(F.size("changed_fields") > 0, "changed").otherwise("no_tracked_change")
    return pairs.withColumn("changed_fields", changed).withColumns({"changed_field_count": F.size("changed_fields").cast("long"), "change_state": state})


def full_resource_diff(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """Resources of two inventories (``inventory.resource_aggregate``) by id with all tracked fields of both sides.

    A side that never saw a resource has nulls; deltas are null unless both sides have the number."""

    def side(df: DataFrame) -> DataFrame:
        return df.withColumns({"observed": F.col("observed_count") > 0, "discovered_only": F.col("observed_count") == 0}).select("resource_id", "normalized_url", "host", "path", "snapshot_id", *RESOURCE_FIELDS)

    own = ["normalized_url", "host", "path"]
    out = tracked(full_outer(side(baseline), side(target), ["resource_id"], [*own, "snapshot_id", *RESOURCE_FIELDS]), RESOURCE_FIELDS)
    out = out.withColumns({c: F.coalesce(f"b_{c}", f"t_{c}") for c in own}).drop(*[f"{s}_{c}" for s in "bt" for c in own])
    out = out.withColumns({"status_changed": differs("http_status"), "observed_state_changed": differs("observed")})
    return out.withColumns({f"{n}_delta": delta(c) for n, c in (("occurrence", "occurrence_count"), ("source_page", "source_page_count"), ("declared_size", "declared_size"))})


def full_link_diff(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """Links of two scans by (source resource, target resource) with all tracked fields, maps of roles, scopes and regions
    included. A side has source_snapshot_id and ``LINK_FIELDS``; of several snapshots of a source the greatest id counts.

    A missing side counts as no occurrences in the delta; its other fields are null."""
    keys = ["source_resource_id", "target_resource_id"]
    maps = {f: F.array_sort(F.map_entries(f)) for f in LINK_FIELDS if f.endswith("_counts")}

    def side(df: DataFrame) -> DataFrame:
        best = df.withColumns(maps).groupBy(*keys).agg(F.max_by(F.struct("source_snapshot_id", *LINK_FIELDS), "source_snapshot_id").alias("r"))
        return best.select(*keys, "r.*")

    out = tracked(full_outer(side(baseline), side(target), keys, ["source_snapshot_id", *LINK_FIELDS]), LINK_FIELDS)
    count = lambda s: F.coalesce(f"{s}_occurrence_count", F.lit(0))
    return out.withColumn("occurrence_delta", count("t") - count("b"))


def topology(links: DataFrame) -> DataFrame:
    """Per page: newly observed, not observed and changed edges, outgoing and incoming."""
    ends = F.explode(F.array(F.struct(F.lit("outgoing").alias("way"), F.col("source_resource_id").alias("id")), F.struct(F.lit("incoming").alias("way"), F.col("target_resource_id").alias("id")))).alias("e")
    rows = links.where("change_state != 'same'").select(ends, "change_state")
    columns = [F.count_if((F.col("e.way") == way) & (F.col("change_state") == state)).alias(f"{way}_edges_{name}") for way in ("outgoing", "incoming") for state, name in ((NEW, "newly_observed"), (GONE, "not_observed"), ("changed", "changed"))]
    return rows.groupBy(F.col("e.id").alias("resource_id")).agg(*columns)


def counts(rows: DataFrame, state: str) -> DataFrame:
    return rows.groupBy("presence_state", state).agg(F.count("*").alias("n"))


def summary_delta(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """Counters (kind, label, n) of two scans side by side over the union of their keys."""
    b, t = (x.groupBy("kind", "label").agg(F.sum("n").alias(side)) for x, side in ((baseline, "baseline"), (target, "target")))
    out = b.join(t, ["kind", "label"], "full").fillna(0, subset=["baseline", "target"])
    return out.withColumn("delta", F.col("target") - F.col("baseline"))


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the columns as JSON in this order (nulls kept apart from empty values)."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def bag_diff(baseline: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Per key how often it is in both, only newly, only formerly (bags: the smaller count is common)."""
    b, t = baseline.groupBy(*key).agg(F.count("*").alias("b")), target.groupBy(*key).agg(F.count("*").alias("t"))
    out = b.join(t, key, "full").fillna(0, subset=["b", "t"])
    zero = F.lit(0).cast("long")
    return out.select(*key, F.least("b", "t").alias("present_in_both"), F.greatest(zero, F.col("t") - F.col("b")).alias("newly_observed"), F.greatest(zero, F.col("b") - F.col("t")).alias("not_observed_in_target"))


#: Fields that tell occurrences of a link apart.
OCCURRENCE_FIELDS = ("raw_href", "resolved_url", "anchor_text", "title", "aria_label", "rel", "target", "dom_path", "scope_decision", "link_role", "link_role_rule", "link_context")


def occurrence_fingerprint() -> Column:
    """SHA-256 of an occurrence's canonical JSON: all ``OCCURRENCE_FIELDS``, nulls too, sorted, text as it is."""
    return json_hash({f: F.col(f) for f in OCCURRENCE_FIELDS})
