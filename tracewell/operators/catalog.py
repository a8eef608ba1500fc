"""Catalog reads: filters, whitelisted sorts, pages with totals (inventory rows P1-P26, L1-L5, L10-L17, A1, J1, J3, J7, J8, J12)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PAGE, MAX_PAGE = 50, 250


def search_any(term: str | None, *columns: str) -> Column:
    """Whether any column holds the term, whatever its case; ``%`` and ``_`` are literal."""
    if not term:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False))
    return out


def host_is(host: str | None, column: str = "host") -> Column:
    return F.lit(True) if not host else F.col(column) == host.lower()


def path_under(prefix: str | None, column: str = "path", like: bool = False) -> Column:
    """Literal, case-sensitive prefix; with ``like`` the compatible form that ignores case and reads ``%`` and ``_`` as wild."""
    if not prefix:
        return F.lit(True)
    return F.col(column).ilike(prefix + "%") if like else F.startswith(F.col(column), F.lit(prefix))


def status_family(family: str | None, column: str = "http_status") -> Column:
    """2xx .. 5xx, or ``none`` for pages without a status."""
    if not family:
        return F.lit(True)
    if family == "none":
        return F.col(column).isNull()
    base = int(family[0]) * 100
    return F.col(column).between(base, base + 99)


def status_label(status: Column, state: Column, error: Column | None = None) -> Column:
    """``error``, else the fetch state where there is no status, else its family."""
    out = F.when(status.isNull(), F.coalesce(state, F.lit("unknown"))).otherwise(F.concat(F.floor(status / 100).cast("string"), F.lit("xx")))
    return out if error is None else F.when(error.isNotNull(), "error").otherwise(out)


def between(column: str, low: float | None, high: float | None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= low)
    return out if high is None else out & (F.col(column) <= high)


def tri_state(value: bool | None, condition: Column) -> Column:
    """No filter, the condition, or its opposite."""
    return F.lit(True) if value is None else condition if value else ~condition


def null_state(state: str | None, column: str, missing: str = "not_requested") -> Column:
    """``any``, ``missing`` for null, or equality."""
    if state in (None, "any"):
        return F.lit(True)
    return F.col(column).isNull() if state == missing else F.col(column) == state


def has_any(df: DataFrame, other: DataFrame, key: str, wanted: bool | None) -> DataFrame:
    """EXISTS, NOT EXISTS or no filter against ``other`` by key."""
    if wanted is None:
        return df
    return df.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi" if wanted else "left_anti")


def is_page(kind: Column, blob: Column, content_type: Column) -> Column:
    """The page predicate over observations; an observation without kind, blob and content type is none."""
    html = content_type.ilike("text/html%") | content_type.ilike("application/xhtml+xml%")
    return F.coalesce((kind == "html_page") | blob.isNotNull() | html, blob.isNotNull())


def shown_url(final: Column, requested: Column) -> Column:
    return F.coalesce(final, requested)


def ordered(df: DataFrame, sorts: dict[str, Column | str], sort: str, descending: bool = False, tie: Iterable[str] = ("id",)) -> DataFrame:
    """Ordered by a whitelisted key, then by the tie-breakers; nulls first ascending and last descending."""
    if sort not in sorts:
        raise ValueError(f"unknown sort: {sort}")
    key = sorts[sort]
    key = F.col(key) if isinstance(key, str) else key
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), *tie)


def page(df: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """One page of an ordered frame."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("page out of range")
    return df.offset(offset).limit(limit)


def total(df: DataFrame) -> int:
    return df.count()


def page_list(snapshots: DataFrame, resources: DataFrame, inbound: DataFrame) -> DataFrame:
    """Snapshots with their resource and inbound counts, zero where there is none."""
    r = resources.select(F.col("id").alias("resource_id"), "normalized_url", "host")
    return snapshots.join(r, "resource_id").join(inbound, "resource_id", "left").fillna(0, subset=["inbound_occurrences", "inbound_sources"])


def duration_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
