"""Named lists: which filters and sorts each list of the product has (inventory rows P1-P4, P7-P12, P14-P20, P22, P23, L1-L5, L10-L17, J12).

A list is a declaration over column names; ``read`` turns it into one filter, one order with a tie-breaker and one page,
so Catalyst pushes the filter into the scan and runs order and limit as one top-k. A projection with the same columns is
read by the same list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog

Filter = Callable[[object], Column | None]
#: A column's name, or what makes a column once there is a session.
Sort = str | Callable[[], Column]


def equals(column: str) -> Filter:
    return lambda x: F.col(column) == x


def lowered(column: str) -> Filter:
    return lambda x: F.col(column) == str(x).lower()


def contains(*columns: str) -> Filter:
    return lambda x: catalog.search_any(x, *columns) if x else None


def prefix(column: str, like: bool = False) -> Filter:
    return lambda x: catalog.path_under(x, column, like) if x else None


def at_least(column: str) -> Filter:
    return lambda x: F.coalesce(F.col(column), F.lit(0)) >= x


def at_most(column: str) -> Filter:
    return lambda x: F.col(column) <= x


def from_(column: str) -> Filter:
    return lambda x: F.col(column) >= x


def flag(column: str) -> Filter:
    """Equal to a truth value."""
    return lambda x: F.col(column) == F.lit(bool(x))


def counted(*columns: str) -> Filter:
    """True: some count is above zero; False: all are zero."""

    def run(x: object) -> Column:
        c = [F.coalesce(F.col(k), F.lit(0)) for k in columns]
        return reduce(lambda a, b: a | b, [k > 0 for k in c]) if x else reduce(lambda a, b: a & b, [k == 0 for k in c])

    return run


def present(column: str) -> Filter:
    """True: not null; False: null."""
    return lambda x: F.col(column).isNotNull() if x else F.col(column).isNull()


def named(**states: Callable[[], Column]) -> Filter:
    """A state by name; other names filter nothing."""
    return lambda x: states[str(x)]() if str(x) in states else None


def or_null(column: str, name: str) -> Filter:
    """``name`` stands for null, any other value for itself."""
    return lambda x: F.col(column).isNull() if x == name else F.col(column) == x


def in_map(key_columns: Sequence[str]) -> Filter:
    """Some of the maps has the key with a count above zero."""
    return lambda x: reduce(lambda a, b: a | b, [F.coalesce(F.try_element_at(F.col(c), F.lit(x)), F.lit(0)) > 0 for c in key_columns])


@dataclass(frozen=True)
class Listing:
    filters: dict[str, Filter] = field(default_factory=dict)
    sorts: dict[str, Sort] = field(default_factory=dict)
    tie: str = "id"
    tie_turns: bool = False  # the tie-breaker goes down with a descending sort
    default: str | None = None  # what an unknown sort means; without one it is an error

    def where(self, df: DataFrame, **values: object) -> DataFrame:
        """``df`` under the given filters; None filters nothing, an unknown filter is an error."""
        for name, value in values.items():
            if name not in self.filters:
                raise ValueError(f"unknown filter: {name}")
            if value is not None and (condition := self.filters[name](value)) is not None:
                df = df.where(condition)
        return df

    def order(self, df: DataFrame, sort: str, descending: bool = False) -> DataFrame:
        """``df`` by a whitelisted sort; nulls first ascending and last descending."""
        key = self.sorts.get(sort, self.sorts.get(self.default) if self.default else None)
        if key is None:
            raise ValueError(f"unknown sort: {sort}")
        key = F.col(key) if isinstance(key, str) else key()
        tie = F.col(self.tie)
        return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), tie.desc() if descending and self.tie_turns else tie.asc())

    def read(self, df: DataFrame, sort: str, descending: bool = False, limit: int = catalog.DEFAULT_PAGE, offset: int = 0, **values: object) -> DataFrame:
        return catalog.page(self.order(self.where(df, **values), sort, descending), limit, offset)


def zero(column: str) -> Sort:
    return lambda: F.coalesce(F.col(column), F.lit(0))


def same(*names: str, **renamed: str) -> dict[str, Sort]:
    """Sorts named as their columns, and others."""
    return {n: n for n in names} | renamed


def shown_url() -> Column:
    return F.coalesce("final_url", "requested_url")


PAGES = Listing(
    {
        "search": contains("requested_url", "final_url", "page_title"), "status": equals("http_status"), "host": lowered("host"), "path_prefix": prefix("path", like=True), "depth": equals("crawl_depth"), "min_depth": from_("crawl_depth"),
        "max_depth": at_most("crawl_depth"), "error_state": named(with_errors=lambda: F.col("error_type").isNotNull(), without_errors=lambda: F.col("error_type").isNull()), "rendered_state": lambda x: catalog.null_state(x, "rendered_state"),
    },
    same("requested_url", status="http_status", title="page_title", depth="crawl_depth", content_type="content_type", duration="response_time_ms") | {"error": "error_type", "inbound": zero("inbound_occurrences"), "rendered_state": lambda: F.coalesce("rendered_state", F.lit("not_requested"))},
    tie_turns=True,
)

SCANS = Listing(
    {"status": equals("status")},
    same("created_at", "started_at", "finished_at", "status", "starting_url", "discovered_count", "stop_reason") | {"duration": lambda: catalog.duration_seconds(F.col("started_at"), F.coalesce("finished_at", "started_at"))},
    tie_turns=True,
)

_LINK_ROLE = or_null("link_role", "legacy_unclassified")
INBOUND = Listing(
    {"search": contains("requested_url", "final_url", "page_title", "anchor_text", "raw_href", "resolved_url"), "scope": equals("scope_decision"), "source_status": equals("http_status"), "rel": contains("rel"), "link_role": _LINK_ROLE},
    same("anchor_text", "scope_decision", "link_role", "raw_href", "rel", "discovered_at", source_status="http_status", source_depth="crawl_depth") | {"source_url": shown_url},
    tie_turns=True,
)
OUTGOING = Listing({"search": contains("anchor_text", "raw_href", "resolved_url"), "scope": equals("scope_decision"), "link_role": _LINK_ROLE}, same("discovered_at"), tie_turns=True)

RESOURCES = Listing(
    {
        "search": contains("normalized_url", "path"), "kind": equals("kind"), "mime_type": contains("mime_type"), "extension": lowered("file_extension"), "host": lowered("host"), "status": equals("http_status"),
        "evidence_state": named(observed=lambda: F.col("observed_count") > 0, discovered_only=lambda: F.col("observed_count") == 0), "scope_state": named(in_scope=lambda: F.col("in_scope_count") > 0, out_of_scope=lambda: F.col("out_scope_count") > 0),
        "internal_to": lowered("host"), "external_to": lambda x: F.col("host") != str(x).lower(), "min_size": from_("declared_size"), "max_size": at_most("declared_size"), "multiple_sources": lambda x: F.col("source_page_count") > 1 if x else None,
    },
    same("kind", "mime_type", "http_status", "declared_size", "occurrence_count", "source_page_count", "in_scope_count", "first_discovered", "latest_discovered", url="normalized_url", observed="observed_count"),
    tie="resource_id",
)

def changed() -> Column:
    return F.col("primary_change_class").isin("substantive_change", "metadata_change", "technical_change") | (F.col("presence_state") != "observed_in_both")


COMPARED_PAGES = Listing(
    {
        "search": contains("normalized_url"), "presence": equals("presence_state"), "change": equals("change_state"), "changed_only": lambda x: changed() if x else None, "content": equals("content_state"), "head": equals("head_state"), "host": lowered("host"),
        "path_prefix": prefix("path"), "http_changed": flag("http_status_changed"), "redirect_changed": flag("redirect_state_changed"), "rendered_changed": flag("rendered_state_changed"),
        "links_changed": lambda x: (F.col("inbound_links_changed") == bool(x)) | (F.col("outbound_links_changed") == bool(x)), "baseline_status": equals("baseline_http_status"), "target_status": equals("target_http_status"),
    },
    {
        "url": "normalized_url", "presence": "presence_state", "change": "change_state", "content": "document_content_state", "metadata": "metadata_state", "technical": "technical_state", "raw_source": "exact_source_state", "baseline_status": "baseline_http_status",
        "target_status": "target_http_status", "changed_field_count": "changed_field_count", "response_time_delta": "response_time_ms_delta", "byte_delta": "network_bytes_delta",
        "link_change_count": lambda: reduce(lambda a, b: a + b, [F.col(f"{way}_edges_{how}") for way in ("outgoing", "incoming") for how in ("newly_observed", "not_observed", "changed")]),
    },
    default="url",
)
COMPARED_RESOURCES = Listing(
    {"search": contains("normalized_url"), "presence": equals("presence_state"), "change": equals("change_state"), "kind": equals("target_kind"), "mime": equals("target_mime_type"), "host": lowered("host"), "status_changed": flag("status_changed"), "observed_state_changed": flag("observed_state_changed")},
    same(url="normalized_url", presence="presence_state", change="change_state", kind="target_kind", mime="target_mime_type", status="target_http_status", size_delta="declared_size_delta", occurrence_delta="occurrence_delta", source_page_delta="source_page_delta"),
    default="url",
)
COMPARED_LINKS = Listing(
    {
        "search": contains("source_url", "target_url"), "presence": equals("presence_state"), "change": equals("change_state"), "role": in_map(("baseline_roles", "target_roles")), "scope": in_map(("baseline_scopes", "target_scopes")),
        "min_occurrence_delta": lambda x: F.abs("occurrence_delta") >= x,
    },
    same("occurrence_delta", source="source_url", target="target_url", presence="presence_state", change="change_state", baseline_occurrences="baseline_occurrence_count", target_occurrences="target_occurrence_count"),
    default="source",
)

SITE_PAGES = Listing(
    {
        "search": contains("normalized_url", "path"), "host": lowered("host"), "path_prefix": prefix("path"), "workflow": equals("workflow_status"), "owner": contains("owner_label"), "unassigned_owner": lambda x: F.col("owner_label").isNull() if x else None,
        "min_observations": at_least("observation_count"),
    },
    same(url="normalized_url", observations="observation_count", first_observed="first_observed_at", latest_observed="latest_observed_at", owner="owner_label", workflow="workflow_status") | {"categories": zero("category_count"), "notes": zero("note_count")},
)

NODES = Listing(
    {
        "min_depth": from_("crawl_depth"), "max_depth": at_most("crawl_depth"), "host": lowered("host"), "path_prefix": prefix("path"), "status": named(none=lambda: F.col("http_status").isNull(), **{f"{k}xx": partial(catalog.status_family, f"{k}xx") for k in range(1, 6)}),
        "fetch_state": equals("fetch_state"), "error_state": named(with_errors=lambda: F.col("error_type").isNotNull(), without_errors=lambda: F.col("error_type").isNull()), "min_inbound": at_least("inbound_occurrences"), "min_outbound": at_least("outbound_occurrences"),
    },
    same(depth="crawl_depth", inbound="inbound_occurrences", outbound="outbound_occurrences", url="normalized_url"),
)

SITES = Listing(
    {"search": contains("name", "base_url", "description"), "group": equals("group_key"), "locale": equals("locale"), "platform": equals("platform_key"), "ownership": equals("ownership_key"), "state": named(active=lambda: F.col("is_active"), inactive=lambda: ~F.col("is_active"))},
    same("name", "base_url", "created_at", "updated_at", "latest_scan_at", classification="group_key", state="is_active") | {"scan_count": zero("scan_count")},
    tie_turns=True,
)
SITE_SCANS = Listing({}, same("created_at", "started_at", "finished_at", "status", "starting_url"), tie_turns=True)

SOURCE_ENTRIES = Listing(
    {"search": contains("raw_url", "normalized_url"), "current_state": named(current=lambda: F.col("is_current"), not_current=lambda: ~F.col("is_current")), "validation": equals("validation_state"), "scope": equals("scope_decision"), "source_type": equals("source_type"), "source_id": equals("source_id")},
    same(url="normalized_url"),
)
DOCUMENTS = Listing(
    {"search": contains("requested_url", "final_url", "parsed_title"), "kind": equals("document_kind"), "role": equals("document_role"), "fetch_state": equals("fetch_state"), "parse_state": equals("parse_state"), "changed": equals("change_state"), "depth": equals("parent_depth_min")},
    same(url="requested_url", depth="parent_depth_min", fetched="fetched_at", size="network_bytes_transferred"),
    tie_turns=True,
)
DOCUMENT_REFERENCES = Listing({"search": contains("raw_url", "resolved_url", "label"), "in_scope": flag("in_scope"), "optional": flag("optional"), "fetched": present("child_snapshot_id")}, same(position="id"))

RENDERED = Listing(
    {
        "search": contains("requested_url", "final_url", "page_title", "document_title"), "capture_state": equals("capture_state"), "navigation_status": equals("navigation_http_status"), "has_warnings": counted("warning_count"), "has_page_errors": counted("page_error_count"),
        "has_console_messages": counted("console_message_count"), "has_blocked_requests": counted("blocked_request_count"), "has_viewport_screenshot": counted("viewport"), "has_full_page_screenshot": counted("full_page"), "has_rendered_dom": counted("dom"),
    },
    same("capture_state", "warning_count", "page_error_count", duration="duration_ms", navigation_status="navigation_http_status", capture_time="finished_at") | {"page_url": shown_url, "browser_evidence": lambda: F.coalesce("viewport", F.lit(0)) + F.coalesce("full_page", F.lit(0)) + F.coalesce("dom", F.lit(0)) + F.col("console_message_count") + F.col("blocked_request_count")},
)
NETWORK = Listing({"search": contains("redacted_url"), "resource_type": equals("resource_type")}, same("sequence"))
CONSOLE = Listing({"search": contains("text"), "message_type": equals("message_type")}, same("sequence"))
PAGE_ERRORS = Listing({"search": contains("message")}, same("sequence"))

ACCESSIBILITY_PAGES = Listing(
    {
        "outcome": lambda x: (F.col("desktop_outcome") == x) | (F.col("mobile_outcome") == x), "impact": named(critical=lambda: F.col("critical_rules") > 0, serious=lambda: F.col("serious_rules") > 0),
        "has_violations": lambda x: (F.col("desktop_violations") > 0) | (F.col("mobile_violations") > 0) if x else (F.col("desktop_violations") == 0) & (F.col("mobile_violations") == 0), "needs_review": counted("needs_review_rules"),
    },
    same(page="page_url", audited="last_audited_at", desktop="desktop_violations", mobile="mobile_violations", critical="critical_rules", serious="serious_rules", needs_review="needs_review_rules"),
    tie="page_id", default="audited",
)

HISTORY = Listing(
    {"site": equals("website_property_id"), "scan_status": equals("scan_status"), "http_status": equals("http_status"), "fetch_state": equals("fetch_state"), "error_state": PAGES.filters["error_state"], "retrieval_method": equals("retrieval_method"), "parse_method": equals("parse_method")},
    same("fetched_at"),
)
RULES = Listing(
    {"search": contains("name"), "category": equals("category_id"), "state": named(active=lambda: F.col("is_active"), inactive=lambda: ~F.col("is_active"))},
    same("name", "updated_at", "last_evaluated_at", active="is_active", category="category_name", mode="match_mode", match_count="current_match_count", excluded_count="current_excluded_count") | {"condition_count": zero("condition_count")},
)
RULE_RUNS = Listing(
    {"status": equals("status"), "trigger": equals("trigger_type"), "date_from": from_("created_at"), "date_to": at_most("created_at")},
    same("created_at", "started_at", "finished_at", "status", "page_count", "rule_count", "match_count", trigger="trigger_type", excluded_count="exclusions_suppressing_matches", evaluator="evaluator_version")
    | {"supports_delta": lambda: F.col("rule_supports_added") - F.col("rule_supports_removed"), "assignments_delta": lambda: F.col("effective_assignments_added") - F.col("effective_assignments_removed")},
    tie_turns=True,
)
CATEGORIES = Listing({}, same("sort_order", "created_at", name="normalized_name"))


def counts_for_order(df: DataFrame, key: str, **others: tuple[DataFrame, str]) -> DataFrame:
    """``df`` with a count of each other table's rows by key, grouped before they are joined; zero where there is none."""
    for name, (other, column) in others.items():
        n = other.groupBy(F.col(column).alias("__key")).agg(F.count("*").alias(name))
        df = df.join(n, df[key] == n["__key"], "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return df


def site_pages(pages: DataFrame, assigned: DataFrame, notes: DataFrame, category: int | None = None, uncategorized: bool = False, has_notes: bool | None = None, **filters: object) -> DataFrame:
    """``pages`` (id and the columns of ``SITE_PAGES``) under all filters of the list: those over columns, and those that ask
    whether there are assignments (site_page_id, category_id), of one category or of any, or notes (site_page_id)."""
    keyed = lambda df: df.withColumn("id", F.col("site_page_id"))
    out = SITE_PAGES.where(pages, **filters)
    if category is not None:
        out = catalog.has_any(out, keyed(assigned.where(F.col("category_id") == category)), "id", True)
    if uncategorized:
        out = catalog.has_any(out, keyed(assigned), "id", False)
    return catalog.has_any(out, keyed(notes), "id", has_notes)


def target_notes(notes: DataFrame, search: str | None = None, pinned: bool | None = None, **target: int | None) -> DataFrame:
    """Notes of exactly one target (site, scan or page), pinned ones first, then the newest."""
    given = {k: v for k, v in target.items() if v is not None}
    if len(given) != 1 or not set(given) <= {"website_property_id", "scan_id", "site_page_id"}:
        raise ValueError("a note list has exactly one target")
    ((column, value),) = given.items()
    out = notes.where(F.col(column) == value).where(catalog.search_any(search, "title", "body"))
    if pinned is not None:
        out = out.where(F.col("is_pinned") == pinned)
    return out.orderBy(F.desc("is_pinned"), F.desc("updated_at"), F.desc("id"))


def rule_order(df: DataFrame) -> DataFrame:
    """Accessibility rules: most pages first, then most nodes, then by rule."""
    return df.orderBy(F.desc("pages"), F.desc("nodes"), "rule_id")


def render_candidates(snapshots: DataFrame, starting_url: str, in_scope: Column, mode: str = "all", most: int = 100) -> DataFrame:
    """Snapshots to render: fetched HTML pages in scope, the starting page first, then by depth, time and id.

    ``starting_page`` takes the first one alone, if it is the starting page or at depth 0; ``none`` takes nothing."""
    able = F.col("html_blob_id").isNotNull() & F.col("final_url").isNotNull() & ~F.col("fetch_state").eqNullSafe("failed")
    start = F.when(F.col("requested_url") == starting_url, 0).otherwise(1)
    rows = snapshots.where(able & in_scope).orderBy(start, F.col("crawl_depth").asc_nulls_first(), F.col("fetched_at").asc_nulls_first(), "id")
    if mode == "none":
        return rows.limit(0)
    if mode == "starting_page":
        return rows.limit(1).where((F.col("requested_url") == starting_url) | (F.col("crawl_depth") == 0))
    return rows.limit(most)
