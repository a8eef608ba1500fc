"""Resource inventory: evidence union, aggregates, history, source entries (inventory rows U1, U2, A10-A12, A28-A31, W1, J13, U8, Q10, F33, C9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_union(observed: DataFrame, embedded: DataFrame, anchors: DataFrame) -> DataFrame:
    """The three kinds of evidence under one schema; what a kind doesn't have is null."""
    out = observed.withColumn("evidence", F.lit("observed"))
    for kind, df in (("embedded", embedded), ("anchor", anchors)):
        out = out.unionByName(df.withColumn("evidence", F.lit(kind)), allowMissingColumns=True)
    return out


def evidence_of(observed: DataFrame, references: DataFrame) -> DataFrame:
    """As ``evidence_union``, of references that name their kind in ``evidence`` already: they are read once for both kinds."""
    return observed.withColumn("evidence", F.lit("observed")).unionByName(references, allowMissingColumns=True)


def ranked_observations(evidence: DataFrame) -> DataFrame:
    """Evidence with the rank of observations, latest first by (fetched_at, id), within each resource; filters belong before it."""
    w = Window.partitionBy("resource_id", F.col("evidence") == "observed").orderBy(F.desc_nulls_last("fetched_at"), F.desc("evidence_id"))
    return evidence.withColumn("observed_rank", F.when(F.col("evidence") == "observed", F.row_number().over(w)))


def resource_inventory(evidence: DataFrame) -> DataFrame:
    """One row a resource: counts by evidence, the latest observation's values, and the alphabetically last kind where nothing was observed.

    The latest value is taken by max_by, a partial aggregate, so no window sorts a hot resource in one task."""
    observed = F.col("evidence") == "observed"
    key = F.struct("fetched_at", "evidence_id")

    def latest(c: str) -> Column:
        return F.max_by(F.when(observed, F.struct(F.col(c).alias("v"))), F.when(observed, key))["v"]

    return evidence.groupBy("resource_id").agg(
        F.count("*").alias("evidence_count"),
        F.count_if(observed).alias("observed_count"),
        F.count_if(F.col("evidence") == "embedded").alias("embedded_count"),
        F.count_if(F.col("evidence") == "anchor").alias("anchor_count"),
        F.countDistinct("source_snapshot_id").alias("source_count"),
        latest("http_status").alias("latest_status"),
        latest("size").alias("latest_size"),
        F.coalesce(latest("kind"), F.max("kind"), F.lit("unknown")).alias("kind"),
        F.coalesce(F.bool_or("in_scope"), F.lit(False)).alias("any_in_scope"),
    ).withColumn("evidence_state", F.when(F.col("observed_count") > 0, "observed").otherwise("discovered"))


#: Fields of the latest observation that a resource's row shows.
LATEST = ("snapshot_id", "final_url", "http_status", "mime_type", "filename", "declared_size", "network_bytes", "fetched_at", "response_time_ms")


#: Parts of a resource's evidence that are grouped on their own, by source, and rows of evidence in a task, about.
SOURCE_PARTS, TASK_ROWS = 8, 200_000


def resource_aggregate(evidence: DataFrame, resources: DataFrame, tasks: int | None = None) -> DataFrame:
    """One full row a resource: all aggregates over its evidence, the latest observation's fields, its URL's parts.

    ``evidence`` has the fields of ``LATEST``, kind, rule, extension, source_snapshot_id, in_scope, evidence_at (when a
    reference was discovered) and scan_id; ``resources`` has id, normalized_url, host, path, path_extension. The latest
    observation is one max_by over all its fields.

    Evidence is dealt to ``tasks`` tasks (None: it is counted first), which follow its rows, by resource and a part of its
    sources; what a task sorts does not grow with the table, and a hot resource is in several. No source is in two
    parts, so that their counts of sources add up."""
    tasks = tasks or max(evidence.sparkSession.sparkContext.defaultParallelism, -(-evidence.count() // TASK_ROWS))
    observed = F.col("evidence") == "observed"
    newest = F.when(observed, F.struct("fetched_at", "evidence_id"))
    counts = {"observed_count": observed, "occurrence_count": ~observed, "anchor_count": F.col("evidence") == "anchor", "embedded_count": F.col("evidence") == "embedded", "in_scope_count": F.col("in_scope"), "out_scope_count": ~F.col("in_scope")}
    part = F.pmod(F.xxhash64("source_snapshot_id"), F.lit(SOURCE_PARTS)).alias("part")
    parts = evidence.select("*", part).repartition(tasks, "resource_id", "part").groupBy("resource_id", "part").agg(
        F.max_by(F.when(observed, F.struct(*LATEST, "kind", "rule")), newest).alias("l"), F.max(newest).alias("l_at"),
        *[F.max(c).alias(f"any_{c}") for c in ("kind", "rule", "extension")], *[F.count_if(c).alias(k) for k, c in counts.items()],
        F.countDistinct("source_snapshot_id").alias("source_page_count"), F.collect_set("scan_id").alias("scans"),
        F.min(F.when(~observed, F.col("evidence_at"))).alias("first_discovered"), F.max(F.when(~observed, F.col("evidence_at"))).alias("latest_discovered"),
    )
    rows = parts.repartition(tasks, "resource_id").groupBy("resource_id").agg(
        F.max_by("l", "l_at").alias("l"), *[F.max(c).alias(c) for c in ("any_kind", "any_rule", "any_extension", "latest_discovered")], F.min("first_discovered").alias("first_discovered"),
        *[F.sum(c).alias(c) for c in (*counts, "source_page_count")], F.size(F.array_distinct(F.flatten(F.collect_list("scans")))).cast("long").alias("scan_count"),
    )
    named = resources.select(F.col("id").alias("resource_id"), "normalized_url", "host", "path", "path_extension")
    return rows.join(named, "resource_id").select(
        "resource_id", "normalized_url", "host", "path", F.coalesce("any_extension", "path_extension").alias("file_extension"),
        F.coalesce("l.kind", "any_kind", F.lit("unknown")).alias("kind"), F.coalesce("l.rule", "any_rule", F.lit("fallback_unknown")).alias("classification_source"),
        *[F.col(f"l.{c}").alias(c) for c in LATEST],
        "observed_count", "occurrence_count", "source_page_count", "anchor_count", "embedded_count", "in_scope_count", "out_scope_count", "first_discovered", "latest_discovered", "scan_count",
    )


def inventory_filter(inventory: DataFrame, kind: str | None = None, state: str | None = None, min_size: int | None = None, max_size: int | None = None, multi_source: bool | None = None) -> DataFrame:
    """Filters over the aggregates (after the grouping)."""
    out = inventory
    for value, condition in (
        (kind, F.col("kind") == kind), (state, F.col("evidence_state") == state), (min_size, F.col("latest_size") >= F.lit(min_size)), (max_size, F.col("latest_size") <= F.lit(max_size)),
        (multi_source, (F.col("source_count") > 1) == F.lit(bool(multi_source))),
    ):
        out = out if value is None else out.where(condition)
    return out


def resource_summary(inventory: DataFrame) -> DataFrame:
    """Counts by kind, split into observed and only discovered."""
    return inventory.groupBy("kind").agg(F.count("*").alias("resources"), F.count_if(F.col("evidence_state") == "observed").alias("observed"), F.count_if(F.col("evidence_state") == "discovered").alias("discovered"))


def resource_history(evidence: DataFrame) -> DataFrame:
    """Per resource and scan: the status observed, whether it was fetched, how often it was referred to."""
    observed = F.col("evidence") == "observed"
    return evidence.groupBy("resource_id", "scan_id").agg(F.max(F.when(observed, F.col("http_status"))).alias("http_status"), F.max(observed.cast("int")).cast("boolean").alias("observed"), F.sum((~observed).cast("long")).alias("referrals"))


def resource_occurrences(anchors: DataFrame, embedded: DataFrame, resource_id: int) -> DataFrame:
    """Every reference to one resource, as an anchor or embedded."""
    keep = F.col("resource_id") == resource_id
    return anchors.where(keep).withColumn("evidence", F.lit("anchor")).unionByName(embedded.where(keep).withColumn("evidence", F.lit("embedded")), allowMissingColumns=True)


def counts_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


# ---- source entries ----


def classification(valid: Column, in_scope: Column, crawled: Column) -> Column:
    return F.when(~valid, "invalid").when(~in_scope, "out_of_scope").when(crawled, "source_and_crawl").otherwise("source_only")


def group_entries(entries: DataFrame) -> DataFrame:
    """Entries by normalised URL: first member's attributes, number of entries, sorted source types. Entries without a
    valid URL stay single."""
    key = F.coalesce("normalized_url", F.concat(F.lit("invalid:"), F.col("id").cast("string")))
    first = F.min_by(F.struct("id", "source_id"), "id")
    return entries.groupBy(key.alias("entry_key")).agg(F.count("*").alias("entries"), first["id"].alias("first_id"), first["source_id"].alias("first_source"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("source_types"))


def current_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source_id").agg(F.count("*").alias("entries"), F.count_if("is_current").alias("current"))


def refresh_membership(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """Existing entries (source_id, normalized_url) after a refresh: those fetched again are current, others are not, new ones are added."""
    key = ["source_id", "normalized_url"]
    e = existing.select(*key).distinct().withColumn("known", F.lit(True))
    f = fetched.select(*key).distinct().withColumn("is_current", F.lit(True))
    out = e.join(f, key, "full")
    return out.select(*key, F.coalesce("is_current", F.lit(False)).alias("is_current"), F.when(F.col("known").isNull(), "inserted").when(F.col("is_current"), "kept").otherwise("expired").alias("action"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Existing rows with incoming values laid over them; ``action`` tells insert, update or unchanged. Of incoming rows
    with one key the last by ``id`` counts."""
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*values), "id").alias("new"))
    out = existing.select(key, F.struct(*values).alias("old")).join(last, key, "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull() | F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("update")
    return out.select(key, *[F.when(F.col("new").isNull(), F.col(f"old.{v}")).otherwise(F.col(f"new.{v}")).alias(v) for v in values], action.alias("action"))


def add_lines(existing: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What adding lines to a source by hand does: ``lines`` with outcome, and the entries (policy_key, raw_url) after it.

    ``lines`` has position, raw_url, policy_key (null for what is no URL) and in_scope; ``existing`` policy_key and raw_url, one
    row a key. A line whose key an entry or an earlier line has is a duplicate and gives the entry its spelling; others are
    accepted, or rejected if they are out of scope. Lines that are no URL are entries of their own, and rejected."""
    by_key = lines.where("policy_key is not null").groupBy("policy_key").agg(F.min("position").alias("first"), F.max_by("raw_url", "position").alias("last_raw"))
    known = existing.where("policy_key is not null").select("policy_key", F.col("raw_url").alias("old_raw"), F.lit(True).alias("there"))
    keys = by_key.join(known, "policy_key", "full")
    found = lines.join(keys.select("policy_key", "first", "there"), "policy_key", "left")
    again = F.coalesce("there", F.lit(False)) | (F.col("position") > F.col("first"))
    outcome = F.when(F.col("policy_key").isNull(), "rejected").when(again, "duplicate").when(F.coalesce("in_scope", F.lit(False)), "accepted").otherwise("rejected")
    single = existing.where("policy_key is null").select("policy_key", "raw_url").unionByName(lines.where("policy_key is null").select("policy_key", "raw_url"))
    after = keys.select("policy_key", F.coalesce("last_raw", "old_raw").alias("raw_url")).unionByName(single)
    return found.withColumn("outcome", outcome).select(*lines.columns, "outcome"), after


def seeds(origins: DataFrame, limit: int | None = None) -> DataFrame:
    """Seeds of a scan: origins (policy_key, url, origin, priority) once each by policy key, first origin first."""
    out = origins.groupBy("policy_key").agg(F.min_by("url", F.struct("priority", "url")).alias("url"), F.min("priority").alias("priority"), F.count("*").alias("origins"))
    return out if limit is None else out.orderBy("priority", "policy_key").limit(limit)


def seed_fingerprint(seed_rows: DataFrame) -> DataFrame:
    """One hash over all seeds, whatever their order: their hashes are added up in parts, as in ``projection.checksum``."""
    from .projection import hash_sums

    h = F.sha2(F.concat_ws("\x1f", "policy_key", "url", F.col("priority").cast("string")), 256).alias("h")
    return hash_sums(seed_rows.select(h)).select(F.col("x").alias("fingerprint"))


def ordered_seed_fingerprint(seed_rows: DataFrame, origins: DataFrame) -> DataFrame:
    """One hash over a scan's seeds (id, normalized_url, requested_url, depth, scope_decision) with their origins (id, seed_id,
    origin_type, source_id, raw_url, metadata), in the order of URL, seed and origin; seeds without an origin count too.

    Rows are numbered by range partitions and hashed with their number, and the hashes are added up, so that the order
    counts and yet no task holds the list."""
    from ..functions.classify import json_hash
    from .ordering import numbered
    from .projection import hash_sums

    o = origins.select(F.col("seed_id").alias("id"), F.col("id").alias("origin_id"), "origin_type", "source_id", "raw_url", "metadata")
    rows = numbered(seed_rows.join(o, "id", "left"), [F.col("normalized_url").asc_nulls_first(), F.col("id"), F.col("origin_id").asc_nulls_first()])
    fields = {"depth": "depth", "scope": "scope_decision", "origin": "origin_type", "source": "source_id", "raw_url": "raw_url", "metadata": "metadata", "number": "number"}
    h = json_hash({"url": F.coalesce("normalized_url", "requested_url")} | {k: F.col(c) for k, c in fields.items()})
    return hash_sums(rows.select(h.alias("h"))).select(F.col("x").alias("fingerprint"))
