"""Streaming forms of two batch operators; the batch engine has no streams, so this is an extension.

``latest_stream`` keeps the newest observation of each key, ``hourly_outcomes`` counts outcomes by event time with a
watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(observations: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key so far (update or complete mode)."""
    rest = [c for c in observations.columns if c not in keys]
    best = observations.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("observed_at", "id")).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def hourly_outcomes(observations: DataFrame, late: str = "2 hours") -> DataFrame:
    """Outcomes by hour of observation; rows later than the watermark are not counted any more."""
    timed = observations.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", late)
    return timed.groupBy(F.window("observed_at", "1 hour"), "outcome").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "outcome", "n")
