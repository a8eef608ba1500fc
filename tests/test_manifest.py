"""Builders that work side by side, builds that resume, counts of what a build was made from."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tracewell.operators import comparisons, projection
from tracewell.operators.manifest import Manifest

SCANS = [{"scan_id": 1, "site_id": 7, "status": "completed"}, {"scan_id": 2, "site_id": 7, "status": "completed_with_errors"}]


def rows(spark, *values):
    return spark.createDataFrame(list(values), "resource_id long, x string")


def test_writers_side_by_side_lose_no_entry(spark, tmp_path):
    logs = [Manifest(spark, f"file://{tmp_path}/m") for _ in range(4)]

    def write(k):
        for _ in range(8):
            # Each entry states how many it saw, which must be all before it.
            logs[k].commit(lambda entries: {"build_id": f"b{k}", "seen": len(entries)})

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    got = Manifest(spark, f"file://{tmp_path}/m").entries()
    assert [e["seen"] for e in got] == list(range(32)) and [e["sequence"] for e in got] == list(range(1, 33))
    assert sorted({e["build_id"] for e in got}) == ["b0", "b1", "b2", "b3"] and not [n for n in os.listdir(f"{tmp_path}/m") if n.endswith(".tmp")]
    assert logs[0].commit(lambda entries: None) is None


def test_one_open_build_a_scan(spark, tmp_path):
    one, two = (projection.ProjectionStore(spark, f"file://{tmp_path}/p") for _ in range(2))
    one.claim("a", 1)
    with pytest.raises(projection.BuildOpen, match="a"):
        two.build("b", 1, rows(spark, (1, "x")))
    two.build("c", 2, rows(spark, (1, "x")))
    # An open build that has been silent for long makes way, and can't become active afterwards.
    three = projection.ProjectionStore(spark, f"file://{tmp_path}/p", stale_after=0)
    three.build("d", 1, rows(spark, (1, "x")))
    assert one.active(1) == "d" and one.status(1) == "active"


def test_a_cancelled_build_does_not_become_active(spark, tmp_path):
    s = projection.ProjectionStore(spark, f"file://{tmp_path}/p")
    s.build("a", 1, rows(spark, (1, "x")))

    def late(done, of):
        projection.ProjectionStore(spark, f"file://{tmp_path}/p").delete(1)

    with pytest.raises(projection.BuildLost):
        s.build("b", 1, rows(spark, (1, "y")), progress=late)
    assert s.active(1) is None and os.listdir(f"{tmp_path}/p/data") == []


def test_builds_count_what_they_read(spark, tmp_path):
    s = projection.ProjectionStore(spark, f"file://{tmp_path}/p")
    pages, links = rows(spark, (1, "a"), (2, "b"), (3, None)), spark.createDataFrame([(1,), (1,), (3,)], "resource_id long")

    def make(pages, links):
        return pages.join(links.groupBy("resource_id").agg(F.count("*").alias("n")), "resource_id", "left").fillna(0, subset=["n"])

    s.build("a", 1, make, 3, {"pages": pages, "links": links}, {"links": F.sum("n"), "pages": F.count("*")})
    assert s.states().first().sources == {"pages": 3, "links": 3}
    with pytest.raises(ValueError, match="links: 4 read, 3 in the build"):
        s.build("b", 1, make, None, {"pages": pages, "links": links.union(spark.createDataFrame([(9,)], "r long"))}, {"links": F.sum("n")})
    assert s.active(1) == "a" and {r.build_id: r.status for r in s.states().collect()} == {"a": "ready", "b": "failed"}


def test_a_build_in_chunks_goes_on_where_it_stopped(spark, tmp_path):
    s = projection.ProjectionStore(spark, f"file://{tmp_path}/p")
    df = rows(spark, *((k, str(k)) for k in range(200)))
    whole = s.build("w", 1, df)
    seen = []

    def stop(done, of):
        seen.append(done)
        if done == 2:
            raise KeyError("lost")

    with pytest.raises(KeyError):
        s.build("c", 1, df, chunks=5, key="resource_id", progress=stop)
    assert s.status(1) == "active" and s.active(1) == "w"
    first = os.stat(f"{tmp_path}/p/data/build_id=c/chunk=0/_SUCCESS").st_mtime_ns
    assert s.build("c", 1, df, 200, chunks=5, key="resource_id", progress=lambda d, of: seen.append(d)) == whole
    assert seen == [1, 2, 1, 2, 3, 4, 5] and os.stat(f"{tmp_path}/p/data/build_id=c/chunk=0/_SUCCESS").st_mtime_ns == first
    assert s.active(1) == "c" and s.read(1, lambda: df).columns == df.columns and s.read(1, lambda: df).count() == 200


def test_comparisons_know_their_coverage_and_refuse_other_states(spark, tmp_path):
    p = projection.ProjectionStore(spark, f"file://{tmp_path}/p")
    stores = [comparisons.ComparisonStore(spark, f"file://{tmp_path}/c", p) for _ in range(2)]
    for k in (1, 2):
        p.build(f"p{k}", k, rows(spark, (1, "a")))
    with ThreadPoolExecutor(2) as pool:
        asked = list(pool.map(lambda c: c.request(*SCANS), stores))
    assert asked[0]["build_id"] == asked[1]["build_id"] and asked[0]["warnings"] == ["target_completed_with_errors"]
    made = lambda state: lambda b, t: {"pages": b.withColumn("presence_state", F.lit(state))}
    with pytest.raises(ValueError, match="0 with a known presence state"):
        stores[0].execute(asked[0]["build_id"], made("removed"), {"pages": ["resource_id"]})
    again = stores[1].request(*SCANS)
    assert stores[1].execute(again["build_id"], made("observed_in_both"), {"pages": ["resource_id"]})["coverage_state"] == "comparable_with_warnings"
    assert stores[0].current("1-2")["build_id"] == again["build_id"]


def test_details_of_a_stored_comparison(spark, tmp_path):
    p = projection.ProjectionStore(spark, f"file://{tmp_path}/p")
    c = comparisons.ComparisonStore(spark, f"file://{tmp_path}/c", p)
    for k in (1, 2):
        p.build(f"p{k}", k, rows(spark, *((i, str(i * k)) for i in range(100 * k))))
    assert c.detail("1-2", "pages", resource_id=3) is None
    from tracewell.operators import compare

    c.execute(c.request(*SCANS)["build_id"], lambda b, t: {"pages": compare.tracked(compare.full_outer(b, t, ["resource_id"], ["x"]), ["x"])}, {"pages": ["resource_id"]})
    got = c.detail("1-2", "pages", resource_id=3)
    assert (got["b_x"], got["t_x"], got["changed_fields"], got["change_state"]) == ("3", "6", ["x"], "changed")
    assert c.detail("1-2", "pages", resource_id=150)["presence_state"] == "newly_observed" and c.detail("1-2", "pages", resource_id=999) is None
