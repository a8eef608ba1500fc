"""Stored comparisons: coverage, builds, queueing, reads (inventory rows D2, D14-D17, SC15).

A comparison is a pair of scans. A build of it waits until both scans have a ready projection, notes which builds it
took and their checksums, writes one Parquet folder for each kind of row, is validated, and becomes current by one
manifest row. A build's newest manifest row is its state. What a failed or cancelled build has written is removed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import compare, observations
from .manifest import Manifest, latest
from .projection import BuildLost, ProjectionStore, checksum, remove_folder

VERSION = "comparison-1"
OPEN = ("waiting_for_projections", "queued", "building")
#: Reasons to stop that are no warning, and states of a finished scan.
NORMAL_STOPS = ("completed", "queue_empty", "queue_exhausted")
FINISHED = ("completed", "completed_with_errors")
STATE = "comparison_id string, baseline_scan_id long, target_scan_id long, version string, status string, baseline_build string, target_build string, baseline_checksum string, target_checksum string, coverage_state string, warnings array<string>, rows map<string, long>, checksum string, sequence long"
MANIFEST = f"build_id string, {STATE}"
FIELDS = [f.strip().split(" ")[0] for f in STATE.replace("map<string, long>", "map").split(",")]

Sides = Callable[[DataFrame, DataFrame], dict[str, DataFrame]]


class ProjectionsMissing(RuntimeError):
    """A scan of the comparison has no ready projection."""


class Cancelled(RuntimeError):
    """The build was cancelled between two kinds of rows."""


def coverage(baseline: dict, target: dict, normal_stops: Sequence[str] = NORMAL_STOPS) -> dict:
    """How far two scans can be compared, and why not fully.

    A scan has status, starting_url, scope (anything that JSON states), seed_fingerprint, stop_reason, failed_count."""

    def digest(x: object) -> str:
        return hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    sides = {"baseline": baseline, "target": target}
    scopes = {name: digest(s.get("scope")) for name, s in sides.items()}
    differing = {"scope_changed": scopes, **{w: {name: s.get(f) for name, s in sides.items()} for w, f in (("starting_url_changed", "starting_url"), ("seed_inputs_changed", "seed_fingerprint"))}}
    warnings = {w for w, values in differing.items() if values["baseline"] != values["target"]}
    for name, s in sides.items():
        stop = s.get("stop_reason")
        if s["status"] != "completed":
            warnings.add(f"{name}_{s['status']}")
        if stop and stop not in normal_stops:
            warnings |= {f"{name}_stop_reason:{stop}"} | ({f"{name}_stopped_by_limit"} if "limit" in stop or stop.startswith("max_") else set())
        if s.get("failed_count"):
            warnings.add(f"{name}_fetch_failures")
    limited = any(s["status"] in ("failed", "cancelled", "interrupted") for s in sides.values())
    state = "limited" if limited else "comparable_with_warnings" if warnings else "comparable"
    return {"coverage_state": state, "warnings": sorted(warnings), **{f"{name}_scope_fingerprint": x for name, x in scopes.items()}}


def previous_finished(scans: DataFrame, key: str = "site_id") -> DataFrame:
    """Each finished scan of a site with the finished one before it by (created_at, scan_id): what is compared by itself."""
    return observations.adjacent_scans(scans.where(F.col("status").isin(*FINISHED) & F.col(key).isNotNull()), key)


class ComparisonStore:
    """Builds of comparisons under a folder, over the projections of one store."""

    def __init__(self, spark: SparkSession, folder: str, projections: ProjectionStore):
        self.spark, self.folder, self.projections = spark, folder.rstrip("/"), projections
        self.log = Manifest(spark, f"{self.folder}/manifest")

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(e.get(f) for f in ["build_id", *FIELDS]) for e in self.log.entries()], MANIFEST)

    def states(self) -> DataFrame:
        """The last state of each build; a ready build that a newer ready one replaced is superseded."""
        last = self.manifest().groupBy("build_id").agg(F.max_by(F.struct(*FIELDS), "sequence").alias("r")).select("build_id", "r.*")
        newest = F.max(F.when(F.col("status") == "ready", F.col("sequence"))).over(Window.partitionBy("comparison_id", "version"))
        return last.withColumn("status", F.when((F.col("status") == "ready") & (F.col("sequence") < newest), "superseded").otherwise(F.col("status")))

    def _record(self, state: dict, **change: object) -> dict:
        return self.log.commit(lambda _: {**state, **change})

    def _move(self, state: dict, allowed: Sequence[str], **change: object) -> dict:
        """``_record``, only if the build's last entry has one of the ``allowed`` states; else the build is lost."""
        moved = self.log.commit(lambda entries: {**state, **change} if latest(entries)[state["build_id"]]["status"] in allowed else None)
        if moved is None:
            raise BuildLost(state["build_id"])
        return moved

    def _one(self, condition) -> dict | None:
        row = self.states().where(condition).orderBy(F.desc("sequence")).first()
        return row.asDict() if row else None

    def current(self, comparison_id: str) -> dict | None:
        return self._one((F.col("comparison_id") == comparison_id) & (F.col("status") == "ready") & (F.col("version") == VERSION))

    def _prepared(self, state: dict) -> bool:
        return all(self.projections.active(state[f"{side}_scan_id"]) for side in ("baseline", "target"))

    def request(self, baseline: dict, target: dict, force: bool = False) -> dict:
        """The state of the build that will answer: an open one, else the current one unless ``force``, else a new one,
        queued if both projections are ready, waiting otherwise."""
        compare.eligible(baseline, target)
        comparison = f"{baseline['scan_id']}-{target['scan_id']}"
        state = {"build_id": uuid.uuid4().hex, "comparison_id": comparison, "baseline_scan_id": baseline["scan_id"], "target_scan_id": target["scan_id"], "version": VERSION, "rows": {}}
        state |= {k: v for k, v in coverage(baseline, target).items() if k in FIELDS}
        state["status"] = "queued" if self._prepared(state) else "waiting_for_projections"
        found: list[dict] = []

        def decide(entries: list[dict]) -> dict | None:
            own = [e for e in latest(entries).values() if e["comparison_id"] == comparison and e["version"] == VERSION]
            ready = [e for e in own if e["status"] == "ready" and not force]
            found[:] = sorted([e for e in own if e["status"] in OPEN] or ready, key=lambda e: e["sequence"])[-1:]
            return None if found else state

        return self.log.commit(decide) or found[0]

    def wake(self, scan_id: int) -> list[str]:
        """Queue the waiting builds of a scan whose projections are both ready now; their ids."""
        own = (F.col("baseline_scan_id") == scan_id) | (F.col("target_scan_id") == scan_id)
        waiting = [r.asDict() for r in self.states().where(own & (F.col("status") == "waiting_for_projections")).collect()]
        return [self._record(s, status="queued")["build_id"] for s in waiting if self._prepared(s)]

    def request_adjacent(self, scans: DataFrame, scan_id: int) -> dict | None:
        """Ask for the comparison of a finished, projected scan with its site's finished scan before it, if there is one."""
        if self.projections.active(scan_id) is None:
            return None
        row = previous_finished(scans).where((F.col("scan_id") == scan_id) & F.col("previous_scan_id").isNotNull()).first()
        if row is None:
            return None
        ends = (row.previous_scan_id, scan_id)
        known = {r.scan_id: r.asDict() for r in scans.where(F.col("scan_id").isin(*ends)).collect()}
        return self.request(*(known[k] for k in ends))

    def execute(self, build_id: str, sides: Sides, keys: dict[str, Sequence[str]], covered: dict | None = None, cancelled: Callable[[], bool] = lambda: False) -> dict:
        """Build: ``sides`` makes the rows of each kind from the two projections. A failure leaves the former build current;
        a build that is cancelled or taken over meanwhile raises ``BuildLost``. ``covered`` replaces the coverage that the
        request found.

        Each kind's rows must have a presence_state and be one a key; the checksum is over all kinds and ignores the order."""
        state = self._one(F.col("build_id") == build_id)
        if state is None or state["status"] not in OPEN:
            raise ValueError(f"no open build {build_id}")
        if not self._prepared(state):
            self._record(state, status="waiting_for_projections")
            raise ProjectionsMissing(build_id)
        pinned = {f"{side}_build": self.projections.active(state[f"{side}_scan_id"]) for side in ("baseline", "target")}
        digests = {r.build_id: r.checksum for r in self.projections.states().where(F.col("build_id").isin(*pinned.values())).collect()}
        state = self._move(state, OPEN, status="building", **pinned, **{k.replace("_build", "_checksum"): digests[b] for k, b in pinned.items()}, **{k: covered[k] for k in ("coverage_state", "warnings") if covered})
        path = f"{self.folder}/data/build_id={build_id}"
        rows, parts = {}, []
        try:
            for kind, df in sorted(sides(*(self.projections.stored(pinned[f"{side}_build"]) for side in ("baseline", "target"))).items()):
                if cancelled():
                    raise Cancelled(build_id)
                # In order of the key, so that a read of some keys skips the other files and row groups.
                spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                df.repartitionByRange(spread, *keys[kind]).sortWithinPartitions(*keys[kind]).write.mode("overwrite").parquet(f"{path}/{kind}")
                stored = self.spark.read.schema(df.schema).parquet(f"{path}/{kind}")
                n = stored.agg(F.count("*").alias("n"), F.countDistinct(F.struct(*keys[kind])).alias("keys"), F.count_if(F.col("presence_state").isin(compare.BOTH, compare.NEW, compare.GONE)).alias("placed")).first()
                if not n.n == n.keys == n.placed:
                    raise ValueError(f"{kind}: {n.n} rows, {n.keys} keys, {n.placed} with a known presence state")
                rows[kind] = n.n
                parts.append(f"{kind}:{checksum(stored).first()[0]}")
        except Exception as e:
            remove_folder(self.spark, path)
            self._move(state, ("building",), status="cancelled" if isinstance(e, Cancelled) else "failed")
            raise
        return self._move(state, ("building",), status="ready", rows=rows, checksum=hashlib.sha256("\n".join(parts).encode()).hexdigest())

    def read(self, comparison_id: str, kind: str) -> DataFrame | None:
        """Rows of the current build, for the lists of compared pages, resources and links; None without a build."""
        found = self.current(comparison_id)
        return self.spark.read.parquet(f"{self.folder}/data/build_id={found['build_id']}/{kind}") if found else None

    def detail(self, comparison_id: str, kind: str, **key: object) -> dict | None:
        """The one row of a kind with this key in the current build, all fields of both sides; None where there is none.
        A page, resource or link that does not belong to the comparison is none either."""
        rows = self.read(comparison_id, kind)
        found = None if rows is None else rows.where(" AND ".join(f"`{k}` = {int(x)}" for k, x in key.items())).first()
        return None if found is None else found.asDict(recursive=True)

    def overview(self, comparison_id: str, states: dict[str, str]) -> DataFrame | None:
        """kind, presence_state, state, n over the current build; ``states`` names each kind's column of changes."""
        out = None
        for kind, column in states.items():
            if (rows := self.read(comparison_id, kind)) is not None:
                n = compare.counts(rows, column).select(F.lit(kind).alias("kind"), "presence_state", F.col(column).alias("state"), "n")
                out = n if out is None else out.union(n)
        return out

    def listing(self) -> DataFrame:
        """One row a comparison: its newest build's state, and which build is current."""
        current = F.max(F.when(F.col("status") == "ready", F.col("build_id"))).alias("current_build")
        return self.states().groupBy("comparison_id").agg(F.max_by("status", "sequence").alias("status"), F.max_by("build_id", "sequence").alias("newest_build"), current, F.max("sequence").alias("sequence"))

    def delete(self, scan_id: int) -> int:
        """Cancel and remove all builds of a scan's comparisons; their number."""
        own = (F.col("baseline_scan_id") == scan_id) | (F.col("target_scan_id") == scan_id)
        found = [r.asDict() for r in self.states().where(own & (F.col("status") != "cancelled")).collect()]
        for s in found:
            self._record(s, status="cancelled")
            remove_folder(self.spark, f"{self.folder}/data/build_id={s['build_id']}")
        return len(found)
