"""Materialised projections: build, validate, checksum, activate, route (inventory rows M1-M11, D14, D15, A16, SC14-SC16).

A build writes Parquet under ``build_id=`` folders, is validated against what it was built from, and becomes active by
one small manifest entry written last. Readers take the newest compatible ready build, or the dynamic query.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, inventory
from .manifest import Manifest, latest

VERSION = "projection-1"
STATES = ("queued", "building", "ready", "failed", "cancelled", "interrupted", "superseded")
OPEN = ("queued", "building")
MANIFEST = "build_id string, scan_id long, version string, status string, rows long, checksum string, sources map<string, long>, sequence long"
MANIFEST_FIELDS = ("build_id", "scan_id", "version", "status", "rows", "checksum", "sources", "sequence")


def page_projection(snapshots: DataFrame, occurrences: DataFrame, resources: DataFrame) -> DataFrame:
    return graph.node_metrics(snapshots, occurrences, resources)


def full_page_projection(snapshots: DataFrame, occurrences: DataFrame, resources: DataFrame, blobs: DataFrame, embedded: DataFrame, seed_origins: DataFrame, rendered: DataFrame, starting_url: str = "") -> DataFrame:
    """Pages with their link metrics, stored sizes (``blobs``: sha256, raw_size, stored_size), embedded references
    (source_snapshot_id), seeds (resource_id, one row an origin) and rendering (snapshot_id, capture state and counts).

    What is counted is grouped before it is joined, so that a page has one row."""
    out = page_projection(snapshots, occurrences, resources)
    counts = {"embedded_resource_count": (embedded, "source_snapshot_id", "id"), "seed_origin_count": (seed_origins, "resource_id", "resource_id")}
    for name, (df, key, own) in counts.items():
        n = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias(name))
        out = out.join(n, out[own] == n["__key"], "left").drop("__key").fillna(0, subset=[name])
    r = rendered.withColumnRenamed("snapshot_id", "__snapshot")
    out = out.join(blobs.select("sha256", "raw_size", "stored_size"), "sha256", "left").join(r, out["id"] == r["__snapshot"], "left").drop("__snapshot")
    out = out.fillna(0, subset=[c for c in rendered.columns if c.startswith("rendered_") and c.endswith("_count")])
    return out.withColumn("is_seed", F.col("seed_origin_count") > 0).withColumn("is_starting_page", graph.starting_page(F.col("normalized_url"), starting_url))


def link_projection(occurrences: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Edges with their counts, role, scope and region maps and anchor samples."""
    keys = ["source_snapshot_id", "target_resource_id"]
    with_region = occurrences.withColumn("region", graph.dom_region(F.col("dom_path")))
    maps = graph.counter_maps(graph.edge_counters(with_region, "role=link_role", "scope=scope_decision", "region=region"))
    wide = maps.groupBy(*keys).pivot("kind", ["region", "role", "scope"]).agg(F.first("counts"))
    wide = wide.select(*keys, *[F.col(k).alias(f"{k}_counts") for k in ("region", "role", "scope")])
    return graph.edges(occurrences, snapshots).join(wide, keys, "left").join(graph.anchor_samples(occurrences), keys, "left")


def resource_projection(evidence: DataFrame) -> DataFrame:
    """The inventory's rows, one a resource, to be stored: lists read them with their filters pushed down."""
    return inventory.resource_inventory(evidence)


def scan_summary(snapshots: DataFrame) -> DataFrame:
    """Per scan: pages, successes (2xx and 3xx), failures, statusless, greatest depth, mean response time."""
    ok = F.col("http_status").between(200, 399)
    return snapshots.groupBy("scan_id").agg(F.count("*").alias("pages"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(F.col("http_status").isNull()).alias("without_status"), F.max("crawl_depth").alias("max_depth"), F.sum("response_time_ms").alias("total_response_ms"))


def scan_counters(snapshots: DataFrame) -> DataFrame:
    """Counters of each scan as rows (scan_id, kind, label, n)."""
    kinds = {"fetch_state": "fetch_state", "http_status": "http_status", "depth": "crawl_depth"}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("label")) for k, c in kinds.items()])).alias("x")
    return snapshots.select("scan_id", rows).groupBy("scan_id", "x.kind", "x.label").agg(F.count("*").alias("n"))


def full_scan_summary(snapshots: DataFrame, occurrences: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per scan: totals of pages, resources and links, successes (2xx and 3xx without an error), and its counters as maps.

    ``snapshots`` has error_type besides the fields of ``scan_counters``. Labels are few, so a map is small at any size."""
    ok = F.col("http_status").between(200, 399) & F.col("error_type").isNull()
    pages = snapshots.groupBy("scan_id").agg(F.count("*").alias("pages"), F.count_if(ok).alias("succeeded"), F.count_if(F.col("error_type").isNotNull()).alias("with_errors"), F.max("crawl_depth").alias("max_depth"))
    links = occurrences.groupBy("scan_id").agg(F.count("*").alias("link_occurrences"), F.countDistinct("source_snapshot_id", "target_resource_id").alias("links"))
    resources = evidence.groupBy("scan_id").agg(F.countDistinct("resource_id").alias("resources"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n"))))
    maps = scan_counters(snapshots).groupBy("scan_id").pivot("kind", ["fetch_state", "http_status", "depth"]).agg(entries)
    maps = maps.select("scan_id", *[F.col(k).alias(f"{k}_counts") for k in ("fetch_state", "http_status", "depth")])
    return pages.join(links, "scan_id", "left").join(resources, "scan_id", "left").join(maps, "scan_id", "left").fillna(0, subset=["link_occurrences", "links", "resources"])


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One SHA-256 over a whole table, whatever its order or partitioning.

    Row hashes are added up in parts of 60 bits, so that a table of any size is a handful of sums (repeated rows count
    as often as they stand); the hash is over the sums and the number of rows."""
    return hash_sums(df.select(row_hash(columns or df.columns).alias("h"))).select(F.col("x").alias("checksum"))


def hash_sums(hashes: DataFrame) -> DataFrame:
    """x: SHA-256 over the number of the hashes ``h`` (64 hex digits) and their sums in parts of 60 bits."""
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(5)]
    return hashes.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256).alias("x"))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for builds in the shared place that ``spark.checkpoint.dir`` names. Where it is unset, a local session
    takes the warehouse, and one with executors elsewhere, which might not see that, is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to a new shared folder and read back: a loop's plan stays short, and lost executors cost no level twice."""
    folder = shared_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class BuildOpen(RuntimeError):
    """Another build of the scan is open."""


class BuildLost(RuntimeError):
    """The build was cancelled or replaced while it ran."""


class ProjectionStore:
    """Builds of one kind under a folder. A scan has one open build at most: builders that start side by side see the
    first one's entry, and a build becomes active only if its own entry is still the last one it wrote."""

    def __init__(self, spark: SparkSession, folder: str, stale_after: float = 6 * 3600):
        """An open build that wrote nothing for ``stale_after`` seconds counts as failed."""
        self.spark, self.folder, self.stale_after = spark, folder.rstrip("/"), stale_after
        self.log = Manifest(spark, f"{self.folder}/manifest")

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(e.get(f) for f in MANIFEST_FIELDS) for e in self.log.entries()], MANIFEST)

    def _entry(self, build_id: str, scan_id: int, status: str, rows: int = 0, digest: str = "", sources: dict[str, int] | None = None) -> dict:
        return {"build_id": build_id, "scan_id": scan_id, "version": VERSION, "status": status, "rows": rows, "checksum": digest, "sources": sources or {}, "written": time.time()}

    def _record(self, build_id: str, scan_id: int, status: str) -> None:
        self.log.commit(lambda _: self._entry(build_id, scan_id, status))

    def claim(self, build_id: str, scan_id: int) -> None:
        """Open a build of a scan, or go on with it if it was interrupted."""

        def decide(entries: list[dict]) -> dict:
            for e in latest(entries).values():
                if e["scan_id"] == scan_id and e["status"] in OPEN and e["build_id"] != build_id and time.time() - e["written"] < self.stale_after:
                    raise BuildOpen(e["build_id"])
            return self._entry(build_id, scan_id, "building")

        self.log.commit(decide)

    def build(
        self, build_id: str, scan_id: int, df: DataFrame | Callable[..., DataFrame], expected_rows: int | None = None, inputs: dict[str, DataFrame] | None = None,
        reconcile: dict[str, Column] | None = None, chunks: int = 1, key: str | None = None, progress: Callable[[int, int], None] = lambda done, of: None,
    ) -> str:
        """Write, validate and activate a build; returns its checksum. A failure leaves the former build active.

        With ``inputs``, ``df`` is a function of them by name; their rows are counted by the pass that writes the build, and the
        counts are kept in the manifest as what the build was made from. ``reconcile`` names, for an input, the aggregate of
        the stored rows that must equal its count. With ``chunks``, rows are dealt by the hash of ``key`` and written chunk by
        chunk; a build that fails meanwhile is ``interrupted``, and building it again goes on after the last whole chunk."""
        path = f"{self.folder}/data/build_id={build_id}"
        self.claim(build_id, scan_id)
        seen = {name: Observation() for name in inputs or {}}
        try:
            if inputs is not None:
                df = df(**{name: d.observe(seen[name], F.count("*").alias("n")) for name, d in inputs.items()})
            for k in range(chunks):
                part = f"{path}/chunk={k}" if chunks > 1 else path
                if chunks == 1 or not folder_exists(self.spark, f"{part}/_SUCCESS"):
                    (df.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == k) if chunks > 1 else df).write.mode("overwrite").parquet(part)
                progress(k + 1, chunks)
            stored = self._rows(build_id, df.schema)
            # Where all chunks were there already, or some were, the inputs are counted on their own.
            sources = {name: o.get["n"] if chunks == 1 else inputs[name].count() for name, o in seen.items()}
            sums = stored.agg(F.count("*").alias("__n"), *[c.alias(name) for name, c in (reconcile or {}).items()]).first()
            digest = checksum(stored).first()[0]
            if expected_rows is not None and sums["__n"] != expected_rows:
                raise ValueError(f"{sums['__n']} rows stored, {expected_rows} expected")
            for name in reconcile or {}:
                if (sums[name] or 0) != sources[name]:
                    raise ValueError(f"{name}: {sources[name]} read, {sums[name]} in the build")
        except Exception as e:
            if chunks == 1:
                remove_folder(self.spark, path)
            if self._end(build_id, self._entry(build_id, scan_id, "failed" if chunks == 1 else "interrupted")) is None:
                raise BuildLost(build_id) from e
            raise
        if self._end(build_id, self._entry(build_id, scan_id, "ready", sums["__n"], digest, sources)) is None:
            remove_folder(self.spark, path)
            raise BuildLost(build_id)
        return digest

    def _end(self, build_id: str, entry: dict) -> dict | None:
        """Commit the end of a build; None if it is no longer building."""
        return self.log.commit(lambda entries: entry if latest(entries)[build_id]["status"] == "building" else None)

    def _rows(self, build_id: str, schema: T.StructType | None = None) -> DataFrame:
        path = f"{self.folder}/data/build_id={build_id}"
        parts = [f"{path}/{x}" for x in folder_names(self.spark, path) if x.startswith("chunk=")]
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(*(parts or [path]))

    def states(self) -> DataFrame:
        """The last state of each build; a ready build that a newer ready one of its scan replaced is superseded."""
        last = self.manifest().groupBy("build_id").agg(F.max_by(F.struct(*MANIFEST_FIELDS[1:]), "sequence").alias("r")).select("build_id", "r.*")
        newest = F.max(F.when(F.col("status") == "ready", F.col("sequence"))).over(Window.partitionBy("scan_id"))
        return last.withColumn("status", F.when((F.col("status") == "ready") & (F.col("sequence") < newest), "superseded").otherwise(F.col("status")))

    def active(self, scan_id: int) -> str | None:
        row = self.states().where((F.col("scan_id") == scan_id) & (F.col("status") == "ready") & (F.col("version") == VERSION)).first()
        return row.build_id if row else None

    def read(self, scan_id: int, dynamic: Callable[[], DataFrame]) -> DataFrame:
        """The active build of a scan, or the dynamic query where none is compatible; both have the same columns."""
        build = self.active(scan_id)
        return self.stored(build) if build else dynamic()

    def stored(self, build_id: str) -> DataFrame:
        return self._rows(build_id)

    def status(self, scan_id: int) -> str:
        """active, else the newest failed or cancelled, else version_mismatch, else missing."""
        rows = self.states().where(F.col("scan_id") == scan_id).orderBy(F.desc("sequence")).collect()
        if any(r.status == "ready" and r.version == VERSION for r in rows):
            return "active"
        if rows and rows[0].status in ("failed", "cancelled", "interrupted", *OPEN):
            return rows[0].status
        return "version_mismatch" if rows else "missing"

    def delete(self, scan_id: int) -> None:
        """Cancel all builds of a scan and remove their folders."""
        for r in self.states().where((F.col("scan_id") == scan_id) & F.col("status").isin("ready", "superseded", "interrupted", *OPEN)).collect():
            self._record(r.build_id, scan_id, "cancelled")
            remove_folder(self.spark, f"{self.folder}/data/build_id={r.build_id}")


def result_tag(path: str, query: str, version: str, build_id: str) -> str:
    """Entity tag of a materialised result."""
    import hashlib

    return hashlib.sha256("\x1f".join((path, query, version, build_id)).encode()).hexdigest()
