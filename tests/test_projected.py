"""Keyed reads of a laid-out projection, and differences of many sources."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import projected, source_diff


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    r = random.Random(3)
    links = {(r.randrange(300), r.randrange(300)) for _ in range(450)} | {(5, 5)}
    patch = pytest.MonkeyPatch()
    patch.setattr(projected, "FOLDER_ROWS", 40)
    s = projected.ProjectedScan(spark, f"file://{tmp_path_factory.mktemp('scan')}/s")
    frame = spark.createDataFrame([(a, b, a % 3 + 1) for a, b in links] + [(7, None, 1)], "source_id long, target_id long, occurrences long")
    s.write(spark.range(300).withColumn("title", F.concat(F.lit("t"), "id")), frame, spark.createDataFrame([(300, len(links))], "pages long, links long"))
    yield s, links
    patch.undo()


def around(links, focus, hops, most):
    seen, frontier = {focus: 0}, {focus}
    for hop in range(1, hops + 1):
        found = {y for a, b in links for x, y in ((a, b), (b, a)) if x in frontier} - set(seen)
        frontier = set(sorted(found)[: most - len(seen)])
        seen |= dict.fromkeys(frontier, hop)
    return sorted(seen.items(), key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize(("focus", "hops", "most"), [(5, 1, 500), (5, 3, 500), (11, 2, 9), (0, 0, 5)])
def test_neighbourhood(scan, focus, hops, most):
    s, links = scan
    assert s.around(focus, hops, most) == around(links, focus, hops, most)


def test_graph_and_details(scan):
    s, links = scan
    ids = {i for i, _ in around(links, 5, 2, 500)}
    pages, among = s.graph(5, 2, 500, self_links=False)
    assert {r.id for r in pages.collect()} == ids and {(r.source_id, r.target_id) for r in among.collect()} == {(a, b) for a, b in links if a in ids and b in ids and a != b}
    got = {r.id: (r.title, r.links_out, r.links_in) for r in s.detail([5, 7, 299, 4711]).collect()}
    assert got == {k: (f"t{k}", sum(a == k for a, _ in links) + (k == 7), sum(b == k for _, b in links)) for k in (5, 7, 299)}
    assert s.summary().first().links == len(links)
    with pytest.raises(ValueError, match="no page"):
        s.around(4711, 1)
    with pytest.raises(ValueError, match="more than"):
        s.pages(range(projected.MOST_IDS + 1))


def test_a_focus_that_the_scan_does_not_have(scan):
    s, _ = scan
    assert s.around(4711, 2, missing_ok=True) == [(4711, 0)]
    pages, among = s.graph(4711, 2, missing_ok=True)
    assert pages.collect() == [] and among.collect() == [] and s.detail([4711]).collect() == []


def test_a_scan_without_links(spark, tmp_path):
    s = projected.ProjectedScan(spark, f"file://{tmp_path}/s")
    s.write(spark.range(0), spark.createDataFrame([], "source_id long, target_id long, occurrences long"), spark.createDataFrame([(0,)], "links long"))
    assert s.around(7, 2, missing_ok=True) == [(7, 0)] and s.graph(7, 2, missing_ok=True)[1].collect() == [] and s.detail([7]).collect() == []
    s.write(spark.range(1), spark.createDataFrame([(0, None, 1)], "source_id long, target_id long, occurrences long"), spark.createDataFrame([(1,)], "links long"))
    assert s.around(0, 2) == [(0, 0)] and [r.links_out for r in s.detail([0]).collect()] == [1]


def test_a_read_lists_only_the_folders_it_needs(scan):
    s, links = scan
    assert len({f for f in s.spark.read.parquet(f"{s.folder}/links-out").inputFiles()}) > 8
    # The scan reads one partition of the folders, and the id reaches the files' statistics.
    plan = s.links_from([5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan.split("PartitionFilters: [")[1].split("]")[0] and "source_id" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_differences_of_sources(spark):
    script = "<script src='/_Incapsula_Resource?a=1&cb={}'></script>\nx"
    pairs = [
        (1, None, b"a", None), (2, b"a", None, None), (3, b"a" * 200, b"b", None), (4, b"\xff", b"a", None), (5, b"a\nb", b"a\nb", None), (6, b"a\nb\nc", b"a\nX\nc", None), (7, script.format(1).encode(), script.format(2).encode(), None),
        (8, b"", b"\n".join(b"%d" % k for k in range(30)), None), (9, "ä".encode("latin-1"), "ö".encode("latin-1"), "latin-1"), (10, b"a", b"b", "no-such"), (11, None, None, None), (12, None, b"c" * 300, None),
    ]
    frame = spark.createDataFrame(pairs, "id long, before binary, after binary, enc string")
    run = lambda **k: {r.id: r for r in source_diff.source_diffs(frame, ["id"], encoding="enc", max_input=150, max_lines=20, **k).collect()}
    got = run()
    assert {k: r.state for k, r in got.items()} == {1: "baseline_missing", 2: "target_missing", 3: "too_large", 4: "decoding_failed", 5: "identical", 6: "available", 7: "available", 8: "truncated", 9: "available", 10: "decoding_failed", 11: "baseline_missing", 12: "baseline_missing"}
    assert set(source_diff.STATES) == {r.state for r in got.values()}
    assert got[6].diff_text.split("\n") == ["--- Baseline", "+++ Target", "@@ -1,3 +1,3 @@", " a", "-b", "+X", " c"] and (got[6].lines_added, got[6].lines_removed) == (1, 1)
    assert len(got[8].diff_text.split("\n")) == 20 and got[8].lines_added == 30
    assert run(meaningful=True)[7].state == "identical"
    assert len(run(max_output=10)[6].diff_text.encode()) == 10
    assert source_diff.source_diffs(frame.where("false"), ["id"]).collect() == []


def test_limits_of_pairs(spark):
    frame = spark.createDataFrame([(1, b"a" * 30, b"b", 30), (2, b"a" * 31, b"b", 30), (3, b"a" * 99, b"b", 99), (4, None, b"b" * 99, 9)], "id long, before binary, after binary, most long")
    got = source_diff.source_diffs(frame, ["id"], max_input=F.col("most")).collect()
    assert {r.id: r.state for r in got} == {1: "available", 2: "too_large", 3: "available", 4: "baseline_missing"}


@pytest.mark.parametrize("name", ["source_diff_exact", "source_diff_meaningful"])
def test_long_pages_are_compared(spark, tmp_path, name):
    import duckdb

    from tracewell.registry import ORACLE_SQL, QUERIES

    pages = f"{tmp_path}/pages.parquet"
    duckdb.execute(f"copy (select k as page_id, 'https://a.test/' || k as url, repeat('<p>é</p>', 10 * (1 + k % 3 * 1000)) as html from range(40) t(k)) to '{pages}' (format parquet)")
    want = duckdb.connect()
    want.execute(f"create view pages as select * from '{pages}'")
    rows = QUERIES[name](spark, str(tmp_path)).select("page_id", "state", "lines_added", "lines_removed").collect()
    assert sorted(map(tuple, rows)) == sorted(want.execute(f"select page_id, state, lines_added, lines_removed from ({ORACLE_SQL[name]})").fetchall())
