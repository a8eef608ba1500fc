"""Parsed pages kept by content (inventory rows X8, X9, D5): each distinct body is parsed once and feeds everything.

An artifact is what one parse of a body gives: head metadata, anchors, embedded references, sections and the analysis of
the source. Its key is the body's hash, the parser's version, the hash of the parser's configuration and the base URL,
against which links are resolved. Artifacts lie in one folder for each version and configuration; a run parses what an
anti-join of the asked keys with the stored ones leaves, in one Arrow pass, and appends it. A body that can't be parsed
is stored as failed and not tried again. ``force`` parses anew: the newest generation of a key counts.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import markup
from .projection import folder_exists

VERSION = "markup-1"
CONFIG = {"max_sections": markup.MAX_SECTIONS, "max_characters": markup.MAX_CHARACTERS}
PARTS = {"page": markup.PAGE_SCHEMA, "anchors": markup.ANCHOR_SCHEMA, "references": markup.REFERENCE_SCHEMA, "sections": markup.SECTION_SCHEMA, "source": markup.SOURCE_SCHEMA}
KEY = ["blob", "base_url"]
#: Bodies that a parse holds at a time, and bodies of a task, about.
SLICE, TASK_BODIES = 64, 4096


def blob_of(html: str) -> F.Column:
    return F.sha2(F.col(html).cast("binary"), 256)


def key_of(blob: str, base_url: str) -> F.Column:
    """Hash and base URL as one text, whether there is a URL or not."""
    return F.concat(F.col(blob), F.coalesce(F.concat(F.lit("1"), F.col(base_url)), F.lit("0")))


def parse(bodies: DataFrame, config: dict) -> DataFrame:
    """blob, base_url, state, error and the parts of each row of ``bodies`` (blob, base_url, html)."""
    ddl = "blob string, base_url string, state string, error string, " + ", ".join(f"{n} {t}" for n, t in PARTS.items())
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def one(blob: str, url: str | None, html: str) -> dict:
        row = {"blob": blob, "base_url": url, "state": "parsed", "error": None}
        try:
            root = markup.tree(html)
            found = {**markup.page_parts(root, url or ""), "sections": markup.sections(root, **config)[0], "source": markup.analysed(html, root)}
        except Exception as e:  # a body that breaks the parser must not break the run
            return {**row, "state": "failed", "error": f"{type(e).__name__}: {e}"[:500]}
        return {**row, **found}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE).to_pylist()
                yield pa.RecordBatch.from_pylist([one(r["blob"], r["base_url"], r["html"]) for r in rows], schema=schema)

    return bodies.select("blob", "base_url", "html").mapInArrow(run, ddl)


class ArtifactStore:
    """The artifacts of one parser version and configuration under a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, version: str = VERSION, config: dict | None = None):
        self.spark, self.config = spark, config or CONFIG
        digest = hashlib.sha256(json.dumps(self.config, sort_keys=True).encode()).hexdigest()[:16]
        self.path = f"{folder.rstrip('/')}/version={version}/config={digest}"

    def _all(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if folder_exists(self.spark, self.path) else None

    def rows(self) -> DataFrame | None:
        """The newest artifact of each key; None before the first run."""
        rows = self._all()
        if rows is None:
            return None
        newest = rows.groupBy(*KEY).agg(F.max("generation").alias("generation"))
        same = [rows[k].eqNullSafe(newest[k]) for k in [*KEY, "generation"]]
        return rows.join(newest, [*same], "left_semi")

    def prepare(self, pages: DataFrame, url: str = "url", html: str = "html", force: bool = False) -> int:
        """Parse the bodies of ``pages`` that have no artifact yet (all of them with ``force``); how many were parsed."""
        asked = pages.where(F.col(html).isNotNull()).select(blob_of(html).alias("blob"), F.col(url).alias("base_url"), F.col(html).alias("html"))
        # Bodies are moved once, by key, to tasks that follow their number; what joins and groups them by key stays there.
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-pages.count() // TASK_BODIES))
        asked = asked.withColumn("key", key_of(*KEY)).repartition(tasks, "key")
        stored = None if force else self._all()
        if stored is not None:
            asked = asked.join(stored.select(key_of(*KEY).alias("key")).repartition(tasks, "key"), "key", "left_anti")
        counted = Observation()
        fresh = parse(asked.dropDuplicates(["key"]), self.config).withColumn("generation", F.lit(time.time_ns()))
        fresh.observe(counted, F.count("*").alias("n")).write.mode("append").option("compression", "zstd").parquet(self.path)
        return counted.get["n"]

    def attach(self, pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
        """``pages`` without the body, with its blob, state, error and parts; a page without a body or an artifact has nulls."""
        out = pages.withColumn("blob", blob_of(html)).drop(html)
        rows = self.rows()
        if rows is None:
            return out.withColumns({"state": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), **{n: F.lit(None).cast(t) for n, t in PARTS.items()}})
        parts = rows.select(F.col("blob").alias("__blob"), F.col("base_url").alias("__url"), "state", "error", *PARTS)
        return out.join(parts, (F.col("blob") == F.col("__blob")) & F.col(url).eqNullSafe(F.col("__url")), "left").drop("__blob", "__url")


def source_side(attached: DataFrame, resource_id: str) -> DataFrame:
    """One side of ``compare.full_page_diff`` from attached pages: what their bodies say."""
    page, source = F.col("page"), F.col("source")
    return attached.select(
        F.col(resource_id).alias("resource_id"), source["exact_sha256"].alias("content_hash"), source["normalized_sha256"].alias("normalized_hash"), source["dependency_sha256"].alias("dependency_hash"),
        source["document_sha256"].alias("document_hash"), source["volatile"].alias("volatile"), source["versions"].alias("versions"), page["head_sha256"].alias("head_hash"), page["title"].alias("page_title"),
        page["description"].alias("meta_description"), page["canonical"].alias("canonical_url"), page["robots"].alias("robots_directives"), page["language"].alias("language"), F.size("references").alias("embedded_resource_count"),
    )
