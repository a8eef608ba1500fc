"""How provider measurements are shown (inventory rows F29, L18)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metrics in the order in which they are shown, and their labels.
LABELS = {
    "performance_score": "Performance score", "fcp": "First Contentful Paint", "lcp": "Largest Contentful Paint", "cls": "Cumulative Layout Shift", "tbt": "Total Blocking Time",
    "speed_index": "Speed Index", "server_response_time": "Server response time", "inp": "Interaction to Next Paint", "ttfb": "Time to First Byte",
}
#: Upper bounds of good and of fair for metrics of field data, and the field data's provider.
FIELD_BOUNDS, FIELD_PROVIDER = {"lcp": (2500.0, 4000.0), "inp": (200.0, 500.0), "cls": (0.1, 0.25)}, "crux"
#: Lower bounds of good and of fair for a score.
SCORE, SCORE_BOUNDS = "performance_score", (0.9, 0.5)
#: Audits that are metrics, and how the scores of others may be shown.
METRIC_AUDITS = ("first-contentful-paint", "largest-contentful-paint", "cumulative-layout-shift", "total-blocking-time", "speed-index", "server-response-time")
DIAGNOSTIC_MODES = ("informative", "numeric", "binary")


def shown_value(metric: str, value: float, unit: str) -> str:
    if metric == SCORE:
        return str(round(value * 100))
    if unit == "ms":
        return f"{value / 1000:.2f} s" if value >= 1000 else f"{round(value)} ms"
    if unit == "score":
        return f"{value:.3f}".rstrip("0").rstrip(".")
    return f"{value:g} {unit}".strip()


def formatted(metric: Column, value: Column, unit: Column) -> Column:
    """Values as they are shown. Rounding goes by the exact binary value, which Spark's own formats don't."""

    @F.pandas_udf("string")
    def run(metric: pd.Series, value: pd.Series, unit: pd.Series) -> pd.Series:
        return pd.Series([shown_value(*x) for x in zip(metric, value, unit, strict=True)], dtype=object)

    return run(metric, value, unit)


def assessment(provider: Column, metric: Column, value: Column) -> Column:
    """good, needs_improvement or poor; null where the provider gives no bounds for the metric."""
    good, fair = SCORE_BOUNDS
    out = F.when(metric == SCORE, F.when(value >= good, "good").when(value >= fair, "needs_improvement").otherwise("poor"))
    for name, (good, fair) in FIELD_BOUNDS.items():
        out = out.when((provider == FIELD_PROVIDER) & (metric == name), F.when(value <= good, "good").when(value <= fair, "needs_improvement").otherwise("poor"))
    return out


def metric_rows(metrics: DataFrame) -> DataFrame:
    """``metrics`` (provider, metric, value, unit and others) with position, label, formatted_value and assessment.

    Unknown metrics and those without a value are not shown. A missing unit counts as empty."""
    names = list(LABELS)
    known = metrics.where(F.col("metric").isin(names) & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    table = F.create_map(*[F.lit(x) for name in names for x in (name, LABELS[name])])
    value, unit = F.col("value").cast("double"), F.coalesce("unit", F.lit(""))
    return known.withColumns(
        {
            "position": F.array_position(F.array(*map(F.lit, names)), F.col("metric")).cast("int"), "label": F.element_at(table, F.col("metric")),
            "formatted_value": formatted(F.col("metric"), value, unit), "assessment": assessment(F.col("provider"), F.col("metric"), value),
        }
    )


def audit_lists(audits: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` opportunities and diagnostics of each report, as rows with ``list`` and ``rank``.

    ``audits`` has report_id, audit_id, details_type, score, score_mode, savings_ms and savings_bytes. What saves something
    is an opportunity, by savings of time, of bytes, then id; other audits that aren't metrics are diagnostics, the worst
    known score first."""
    saves = F.coalesce(F.col("details_type") == "opportunity", F.lit(False)) | F.col("savings_ms").isNotNull() | F.col("savings_bytes").isNotNull()
    shown = F.when(saves, "opportunities").when(~F.col("audit_id").isin(*METRIC_AUDITS) & F.col("score_mode").isin(*DIAGNOSTIC_MODES), "diagnostics")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    first = F.when(F.col("list") == "opportunities", -zero("savings_ms")).otherwise(F.col("score").isNull().cast("double"))
    second = F.when(F.col("list") == "opportunities", -zero("savings_bytes")).otherwise(zero("score"))
    w = Window.partitionBy("report_id", "list").orderBy(first, second, "audit_id")
    rows = audits.withColumn("list", shown).where("list is not null")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
