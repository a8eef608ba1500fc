"""Stored comparisons, blob stores, deletions and audits on small hand-built tables."""

from __future__ import annotations

import os

import pytest

from tracewell.functions import urls
from tracewell.operators import compare, comparisons, projection, retention

SIDES = [{"scan_id": 1, "site_id": 7, "status": "completed"}, {"scan_id": 2, "site_id": 7, "status": "completed"}]
KEYS = {"pages": ["resource_id"]}


def pages(b, t):
    return {"pages": compare.resource_diff(b, t, ["x"])}


@pytest.fixture
def stores(spark, tmp_path):
    p = projection.ProjectionStore(spark, f"file://{tmp_path}/p")
    return p, comparisons.ComparisonStore(spark, f"file://{tmp_path}/c", p)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "resource_id long, x string")


def test_comparison_waits_builds_and_is_superseded(spark, stores, tmp_path):
    p, c = stores
    p.build("p1", 1, rows(spark, (1, "a"), (2, "b")))
    first = c.request(*SIDES)
    assert first["status"] == "waiting_for_projections" and c.wake(2) == [] and c.read("1-2", "pages") is None
    with pytest.raises(comparisons.ProjectionsMissing):
        c.execute(first["build_id"], pages, KEYS)
    p.build("p2", 2, rows(spark, (2, "c"), (3, None)))
    assert c.wake(2) == [first["build_id"]] and c.request(*SIDES)["status"] == "queued"
    done = c.execute(first["build_id"], pages, KEYS, comparisons.coverage(*SIDES))
    assert (done["status"], done["rows"], done["baseline_build"], done["target_build"], done["coverage_state"]) == ("ready", {"pages": 3}, "p1", "p2", "comparable")
    assert {r.resource_id: r.change_state for r in c.read("1-2", "pages").collect()} == {1: compare.GONE, 2: "changed", 3: compare.NEW}
    assert c.request(*SIDES)["build_id"] == first["build_id"]
    again = c.request(*SIDES, force=True)
    assert again["build_id"] != first["build_id"]
    assert c.execute(again["build_id"], pages, KEYS)["checksum"] == done["checksum"]
    assert {r.build_id: r.status for r in c.states().collect()} == {first["build_id"]: "superseded", again["build_id"]: "ready"}
    assert [(r.comparison_id, r.status, r.current_build) for r in c.listing().collect()] == [("1-2", "ready", again["build_id"])]
    assert c.overview("1-2", {"pages": "change_state"}).count() == 3
    assert c.delete(2) == 2 and c.read("1-2", "pages") is None and os.listdir(f"{tmp_path}/c/data") == []


def test_failed_and_cancelled_builds_leave_the_former_one(spark, stores, tmp_path):
    p, c = stores
    for k in (1, 2):
        p.build(f"p{k}", k, rows(spark, (1, "a")))
    kept = c.execute(c.request(*SIDES)["build_id"], pages, KEYS)["build_id"]
    twice = c.request(*SIDES, force=True)["build_id"]
    with pytest.raises(ValueError, match="2 rows, 1 keys"):
        c.execute(twice, lambda b, t: {"pages": pages(b, t)["pages"].union(pages(b, t)["pages"])}, KEYS)
    stopped = c.request(*SIDES, force=True)["build_id"]
    with pytest.raises(comparisons.Cancelled):
        c.execute(stopped, pages, KEYS, cancelled=lambda: True)
    assert c.current("1-2")["build_id"] == kept and os.listdir(f"{tmp_path}/c/data") == [f"build_id={kept}"]
    assert {r.status for r in c.states().collect()} == {"ready", "failed", "cancelled"}
    with pytest.raises(ValueError):
        c.execute(stopped, pages, KEYS)


def test_adjacent_comparison(spark, stores):
    p, c = stores
    scans = spark.createDataFrame([(1, 7, 10, "completed"), (2, 7, 20, "failed"), (3, 7, 20, "completed_with_errors"), (4, 8, 5, "completed"), (5, None, 1, "completed")], "scan_id long, site_id long, created_at long, status string")
    assert c.request_adjacent(scans, 3) is None
    for k in (3, 4):
        p.build(f"p{k}", k, rows(spark, (1, "a")))
    assert c.request_adjacent(scans, 3)["comparison_id"] == "1-3" and c.request_adjacent(scans, 4) is None
    assert sorted((r.scan_id, r.previous_scan_id) for r in comparisons.previous_finished(scans).where("previous_scan_id is not null").collect()) == [(3, 1)]


def test_coverage_names_what_differs():
    b = {"status": "completed", "scope": {"b": 1, "a": 2}, "starting_url": "u", "seed_fingerprint": "f", "stop_reason": "queue_empty"}
    assert comparisons.coverage(b, b | {"scope": {"a": 2, "b": 1}})["warnings"] == []
    got = comparisons.coverage(b | {"status": "failed"}, b | {"scope": {}, "starting_url": "v", "seed_fingerprint": "g", "stop_reason": "max_pages", "failed_count": 2})
    assert got["coverage_state"] == "limited"
    assert got["warnings"] == ["baseline_failed", "scope_changed", "seed_inputs_changed", "starting_url_changed", "target_fetch_failures", "target_stop_reason:max_pages", "target_stopped_by_limit"]


def test_blob_store(spark, tmp_path):
    s = retention.BlobStore(spark, f"file://{tmp_path}/b", "document")
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "yy"), (4, None)], "id long, t string")
    s.add(df, "t")
    s.add(df, "t")
    assert sorted((bytes(r.content), r.size) for r in s.all().collect()) == [(b"x", 1), (b"yy", 2)]
    keys = df.selectExpr("id", "sha2(t, 256) as sha256")
    assert sorted((r.id, r.blob_state) for r in s.read(keys).collect()) == [(1, "stored"), (2, "stored"), (3, "stored"), (4, "missing")]
    after = s.sweep(keys.where("id < 3"), "g2")
    assert [bytes(r.content) for r in after.all().collect()] == [b"x"] and s.all().count() == 2
    assert retention.BlobStore(spark, f"file://{tmp_path}/b", "artifact").all().count() == 0


def test_deletion_keeps_shared_pinned_and_scanless_rows(spark):
    snaps = spark.createDataFrame([(1, 1, 10, "a"), (2, 1, 11, "b"), (3, 2, 10, "a"), (4, None, 12, "c"), (5, 1, 13, None)], "id long, scan_id long, resource_id long, sha256 string")
    occ = spark.createDataFrame([(1, 14), (2, 15), (1, 15), (1, None)], "scan_id long, target_resource_id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (None, 4)], "baseline_scan_id long, target_scan_id long")
    before = {"snapshots": snaps, "occurrences": occ, "comparisons": pairs, "resources": spark.range(10, 17), "blobs": spark.createDataFrame([("a",), ("b",), ("c",)], "sha256 string")}
    left = retention.delete_scan(**before, scan_id=1, pinned=[spark.createDataFrame([(13,), (None,)], "r long")])
    assert sorted(r.id for r in left["resources"].collect()) == [10, 12, 13, 15, 16]
    assert sorted(r.sha256 for r in left["blobs"].collect()) == ["a", "c"]
    assert {r.table: r.deleted for r in retention.deleted_counts(before, left).collect()} == {"snapshots": 3, "occurrences": 3, "comparisons": 1, "resources": 2, "blobs": 1}


def test_identity_classes(spark):
    r = spark.createDataFrame([(1, "a", "a"), (2, "b", "a"), (3, "c", "c"), (4, "d", None), (5, "e", "E"), (6, "h://f/?q=1", "h://f/?q=1"), (7, "g", "g"), (8, "i", "i")], "id long, url string, candidate string")
    e = spark.createDataFrame([(3, "c"), (3, "x"), (7, "g"), (7, None), (8, None)], "resource_id long, candidate string")
    got = {x.id: x.identity_class for x in retention.identity_classes(r, e).collect()}
    assert got == {1: retention.MERGE, 2: retention.MERGE, 3: retention.OVER_COLLAPSE, 4: retention.NO_PROVENANCE, 5: retention.RE_KEY, 6: retention.NO_PROVENANCE, 7: retention.UNCHANGED, 8: retention.NO_PROVENANCE}
    empty = retention.audit_severity(retention.identity_classes(r.limit(0), e)).first()
    assert (empty.unchanged, empty.severity) == (0, "SAFE_TO_REKEY")


def test_site_helpers(spark):
    assert [urls.site_base(x) for x in (" Bücher.example ", "http://a.example:80/x?y#z", "https://u:p@B.example:444")] == ["https://xn--bcher-kva.example/", "http://a.example/x?y", "https://b.example:444/"]
    for bad in ("ftp://a.example", "https://", "", "http://a.example:x"):
        with pytest.raises(ValueError):
            urls.site_base(bad)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("  a \t b ",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(urls.classification_key(F.col("c"), "none")).collect()] == ["a b", "none", "none"]
    with pytest.raises(Exception, match="64 characters"):
        spark.createDataFrame([("x" * 65,)], "c string").select(urls.classification_key(F.col("c"), "none")).collect()
    assert spark.sql("select timestamp_ntz'2024-01-01 00:30' as t union all select null").select(urls.in_zone(F.col("t"), "Asia/Tokyo").alias("z")).orderBy("z").collect()[0].z == "2024-01-01 09:30"
