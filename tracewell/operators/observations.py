"""Observations over time: latest per key, history, pivots, coverage (inventory rows W1-W11, A15, A20-A26, J11, J13, J14, J21, J22, L16, L18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], time: str = "observed_at", tie: str = "id") -> DataFrame:
    """The row with the greatest (time, tie) of each key, all columns.

    Written as a partial aggregate (max_by of the row), so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(df.columns)


def latest_ties(df: DataFrame, keys: list[str], time: str = "observed_at") -> DataFrame:
    """All rows that share their key's greatest time (a groupwise maximum joined back; ties give several rows)."""
    most = df.groupBy(*keys).agg(F.max(time).alias("__most"))
    return df.join(most, keys).where(F.col(time) == F.col("__most")).select(df.columns)


def newest(df: DataFrame, keys: list[str], n: int, time: str = "observed_at", tie: str = "id") -> DataFrame:
    """The newest ``n`` rows of each key with their rank; Spark cuts each key's rows before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ready_coverage(df: DataFrame) -> DataFrame:
    """Measured resources by profile, and those whose latest observation is ready (the filter comes after the latest)."""
    latest = latest_per_key(df, ["resource_id", "profile"])
    return latest.groupBy("profile").agg(F.countDistinct("resource_id").alias("measured"), F.countDistinct(F.when(F.col("outcome") == "ready", F.col("resource_id"))).alias("ready"))


def profile_pivot(df: DataFrame, profiles: list[str]) -> DataFrame:
    """One row a resource: the latest outcome and metric of each profile, and its number of distinct rules."""
    latest = latest_per_key(df, ["resource_id", "profile"])
    columns = [c for p in profiles for c in (F.max(F.when(F.col("profile") == p, F.col("outcome"))).alias(f"{p}_outcome"), F.max(F.when(F.col("profile") == p, F.col("metric"))).alias(f"{p}_metric"))]
    return latest.groupBy("resource_id").agg(*columns, F.countDistinct("rule_id").alias("rules"))


def rule_aggregate(df: DataFrame, profiles: list[str]) -> DataFrame:
    """Current evidence by rule and outcome: pages, observations, in which profiles."""
    latest = latest_per_key(df, ["resource_id", "profile"])
    present = [F.bool_or(F.col("profile") == p).alias(f"in_{p}") for p in profiles]
    return latest.groupBy("rule_id", "outcome").agg(F.countDistinct("resource_id").alias("pages"), F.count("*").alias("observations"), *present)


def summary(df: DataFrame) -> DataFrame:
    latest = latest_per_key(df, ["resource_id", "profile"])
    return latest.agg(F.countDistinct("resource_id").alias("pages"), F.countDistinct("profile").alias("profiles"), F.countDistinct(F.when(F.col("outcome") == "failed", F.col("resource_id"))).alias("failed_pages"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count("*").alias("observations"))


def audit_summary(df: DataFrame) -> DataFrame:
    """One row over the latest observation of each page and profile (violation_rules, violation_nodes, incomplete_rules)."""
    latest = latest_per_key(df, ["resource_id", "profile"])
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("violation_rules", "violation_rules"), ("violation_nodes", "affected_nodes"), ("incomplete_rules", "needs_review_rules"))]
    pages = F.countDistinct(F.when(F.col("violation_rules") > 0, F.col("resource_id")))
    return latest.agg(F.countDistinct("resource_id").alias("pages_audited"), F.countDistinct("profile").alias("profiles_audited"), pages.alias("pages_with_violations"), *sums, F.count_if(F.col("outcome") == "failed").alias("failed_latest"), F.max("observed_at").alias("latest_observed_at"))


def impact_counts(df: DataFrame, rules: DataFrame) -> DataFrame:
    """impact, n: violations (``rules``: observation_id, result_type, impact) of the latest observations that are ready."""
    latest = latest_per_key(df, ["resource_id", "profile"]).where("outcome = 'ready'").select(F.col("id").alias("observation_id"))
    rows = rules.where("result_type = 'violation'").join(latest, "observation_id", "left_semi")
    return rows.groupBy(F.coalesce("impact", F.lit("unknown")).alias("impact")).agg(F.count("*").alias("n"))


def page_rollup(snapshots: DataFrame, is_page: Column) -> DataFrame:
    """Per resource: page observations with first and last time, and observations of any kind."""
    return snapshots.groupBy("resource_id").agg(F.count_if(is_page).alias("page_observations"), F.min(F.when(is_page, F.col("fetched_at"))).alias("first_seen"), F.max(F.when(is_page, F.col("fetched_at"))).alias("last_seen"), F.count("*").alias("observations"))


def scan_ordinals(scans: DataFrame) -> DataFrame:
    """Scans with their place in (created_at, scan_id); scans are few, the window is over them alone."""
    return scans.withColumn("ordinal", F.row_number().over(Window.orderBy("created_at", "scan_id")).cast("long"))


def adjacent_scans(scans: DataFrame, key: str | None = None) -> DataFrame:
    """Each scan with the one before it (of the same ``key``). Scans are few; without a key they are one sequence."""
    w = (Window.partitionBy(key) if key else Window).orderBy("created_at", "scan_id")
    return scans.withColumn("previous_scan_id", F.lag("scan_id").over(w))


TRACKED = {"status": "http_status", "fetch_state": "fetch_state", "depth": "crawl_depth"}


def change_history(snapshots: DataFrame, scans: DataFrame, tracked: dict[str, str] = TRACKED) -> DataFrame:
    """Each observation of a page with what changed since the page's previous one, a label and the scans between.

    The label is first_observation, no_change, multiple_changes or the single change's name."""
    s = snapshots.join(scan_ordinals(scans), "scan_id")  # the adaptive planner broadcasts the scans if they are small
    w = Window.partitionBy("resource_id").orderBy("created_at", "scan_id", "id")
    s = s.withColumn("previous_id", F.lag("id").over(w)).withColumn("between", F.col("ordinal") - F.lag("ordinal").over(w) - 1)
    for c in tracked.values():
        s = s.withColumn(f"__{c}", F.lag(c).over(w))
    first = F.col("previous_id").isNull()
    flags = {name: ~first & ~F.col(c).eqNullSafe(F.col(f"__{c}")) for name, c in tracked.items()}
    changed = F.filter(F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()]), lambda x: x.isNotNull())
    out = s.withColumn("changes", changed)
    label = F.when(first, "first_observation").when(F.size("changes") == 0, "no_change").when(F.size("changes") > 1, "multiple_changes").otherwise(F.element_at("changes", 1))
    return out.select("resource_id", "scan_id", "id", "previous_id", *[f.alias(f"{n}_changed") for n, f in flags.items()], label.alias("label"), F.coalesce("between", F.lit(0)).alias("scans_between"))


def page_history(snapshots: DataFrame, scans: DataFrame, sites: DataFrame, artifacts: DataFrame, rendered: DataFrame) -> DataFrame:
    """Every observation of a page with its scan, and where there are any its site, the artifact of its body and what was
    rendered of it. ``scans`` has scan_id, site_id, scan_status, created_at; ``sites`` site_id, site_name; ``artifacts``
    sha256, parse_state; ``rendered`` snapshot_id, capture_state, one row a key each. Of several artifacts of a body, or
    captures of a snapshot, the least state counts, so that an observation stays one row."""
    one = lambda df, key, value: df.groupBy(key).agg(F.min(value).alias(value))
    out = snapshots.join(scans.select("scan_id", "site_id", "scan_status", "created_at"), "scan_id").join(one(sites, "site_id", "site_name"), "site_id", "left")
    out = out.join(one(artifacts, "sha256", "parse_state"), "sha256", "left")
    return out.join(one(rendered, "snapshot_id", "capture_state").withColumnRenamed("snapshot_id", "id"), "id", "left")


def latest_content(snapshots: DataFrame, scans: DataFrame, site_pages: DataFrame) -> DataFrame:
    """Per page of a site (``site_pages``: site_id, resource_id) its latest fetched observation with a body: site_id,
    resource_id, id. Time is fetched_at, else when the scan (scan_id, site_id, created_at) was made; ties go to the greater id."""
    rows = snapshots.where("fetch_state = 'fetched' and sha256 is not null").join(scans.select("scan_id", "site_id", "created_at"), "scan_id")
    best = rows.groupBy("site_id", "resource_id").agg(F.max(F.struct(F.coalesce("fetched_at", "created_at").alias("at"), "id")).alias("b")).select("site_id", "resource_id", F.col("b.id").alias("id"))
    return best.join(site_pages.select("site_id", "resource_id").distinct(), ["site_id", "resource_id"], "left_semi")


def latest_scan(snapshots: DataFrame, by: str) -> DataFrame:
    """Per key: number of scans, latest scan id and its newest observation."""
    return snapshots.groupBy(by).agg(F.countDistinct("scan_id").alias("scans"), F.max("scan_id").alias("latest_scan_id"), F.max_by("id", F.struct("scan_id", "fetched_at", "id")).alias("latest_snapshot_id"))


def revalidation_candidate(df: DataFrame, keys: list[str], reusable: Column, n: int = 20) -> DataFrame:
    """Of the newest ``n`` rows of a key, the first that can be used again."""
    return newest(df, keys, n).where(reusable).groupBy(*keys).agg(F.min_by("id", "rank").alias("id"), F.min("rank").alias("rank"))


#: Upper bounds of good and of fair for each metric.
THRESHOLDS = {"largest_contentful_paint": (2500.0, 4000.0), "interaction_to_next_paint": (200.0, 500.0), "cumulative_layout_shift": (0.1, 0.25), "first_contentful_paint": (1800.0, 3000.0), "time_to_first_byte": (800.0, 1800.0)}


def metric_rating(metric: Column, value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (good, fair) in THRESHOLDS.items():
        out = F.when(metric == name, F.when(value <= good, "good").when(value <= fair, "needs_improvement").when(value.isNotNull(), "poor")).otherwise(out)
    return out


def top_audits(audits: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` audits with most savings of each report."""
    w = Window.partitionBy("report_id").orderBy(F.desc_nulls_last("savings"), "audit_id")
    return audits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_diagnostics(audits: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` worst audits of each report (report_id, audit_id, score): known scores first, the lowest of them first."""
    w = Window.partitionBy("report_id").orderBy(F.asc_nulls_last("score"), "audit_id")
    return audits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def site_first_candidate(asked: DataFrame, snapshots: DataFrame, reusable: Column, n: int = 20) -> DataFrame:
    """For each asked page (resource_id, site_id): of the newest ``n`` snapshots (id, resource_id, site_id, fetched_at), those
    of its own site before all others, the first that can be used again. Without a site only time counts."""
    own = asked.select("resource_id", F.col("site_id").alias("__site")).distinct()
    rows = snapshots.join(own, "resource_id").withColumn("__same", F.coalesce((F.col("site_id") == F.col("__site")) & F.col("__site").isNotNull(), F.lit(False)))
    w = Window.partitionBy("resource_id", "__site").orderBy(F.desc("__same"), F.desc_nulls_last("fetched_at"), F.desc("id"))
    rows = rows.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= n) & reusable)
    return rows.groupBy("resource_id", F.col("__site").alias("asked_site_id")).agg(F.min_by("id", "rank").alias("id"), F.min("rank").alias("rank"))
