"""The store of parsed pages: what is parsed again and what not, and what feeds the page diff."""

from __future__ import annotations

from tracewell.operators import artifacts, compare

PAGE = "<html lang=en><head><title>T</title></head><body><nav><a href=x>l</a></nav><h1>H</h1><p>words here</p><img src=i.png></body></html>"


def pages(spark, *rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, blob2 string")


def test_a_body_is_parsed_once_for_each_key(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path))
    two = pages(spark, (1, "http://h/a", PAGE, None), (2, "http://h/a", PAGE, None), (3, "http://h/b", PAGE, None), (4, None, PAGE, None), (5, "http://h/c", None, None), (6, "http://h/d", "", None))
    assert store.attach(two).where("state is not null").count() == 0 and store.rows() is None
    assert store.prepare(two) == 4 and store.prepare(two) == 0
    got = {r.page_id: r for r in store.attach(two).collect()}
    assert len(got) == 6 and got[5].state is None and got[6].anchors == [] and got[4].anchors[0].resolved == "x"
    assert [got[k].anchors[0].resolved for k in (1, 2, 3)] == ["http://h/x"] * 3 and got[1].sections[-1].words == 3 and got[1].page.title == "T" and got[1].references[0].raw == "i.png"
    # A new version or configuration begins anew, force adds a generation and the newest counts once.
    assert artifacts.ArtifactStore(spark, str(tmp_path), version="markup-2").prepare(two) == 4
    assert artifacts.ArtifactStore(spark, str(tmp_path), config={**artifacts.CONFIG, "max_sections": 1}).prepare(two) == 4
    assert store.prepare(two, force=True) == 4 and store.rows().count() == 4 and store.attach(two).count() == 6


def test_a_body_that_breaks_the_parser_is_kept_as_failed(spark, tmp_path, monkeypatch):
    store = artifacts.ArtifactStore(spark, str(tmp_path), config={"no_such_parameter": 1})
    rows = pages(spark, (1, "u", PAGE, None))
    assert store.prepare(rows) == 1 and store.prepare(rows) == 0
    got = store.attach(rows).first()
    assert got.state == "failed" and "no_such_parameter" in got.error and got.page is None


def test_sources_feed_the_page_diff(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path))
    changed = [PAGE, PAGE + "<!-- c -->", PAGE.replace("words", "other"), PAGE.replace("<title>T", "<title>U"), None]
    base, target = pages(spark, *((k, "u", PAGE, None) for k in range(5))), pages(spark, *((k, "u", h, None) for k, h in enumerate(changed)))
    assert store.prepare(base.unionByName(target)) == 4
    diff = compare.full_page_diff(*(artifacts.source_side(store.attach(s), "page_id") for s in (base, target)))
    assert {r.resource_id: r.primary_change_class for r in diff.collect()} == {0: "no_tracked_change", 1: "technical_change", 2: "substantive_change", 3: "metadata_change", 4: "metadata_change"}


def test_bodies_go_to_tasks_by_their_number_and_move_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "TASK_BODIES", 10, raising=False)
    store = artifacts.ArtifactStore(spark, str(tmp_path))
    rows = pages(spark, *((k, f"http://h/{k % 100}" if k % 100 else None, PAGE, None) for k in range(200)))
    assert store.prepare(rows) == 100 and store.prepare(rows) == 0
    files = [f for f in store.rows().inputFiles() if spark.read.parquet(f).count()]
    assert len(files) > 10 and store.attach(rows).where("state = 'parsed'").count() == 200


def test_a_body_is_read_once_for_all_its_parts(monkeypatch):
    from html.parser import HTMLParser

    from tracewell.functions import markup

    read, feed = [], HTMLParser.feed
    monkeypatch.setattr(HTMLParser, "feed", lambda self, x: (read.append(len(x)), feed(self, x)))
    source = '<script src="/_Incapsula_Resource?a=1&cb=1"></script><link href="/wp-content/a.css?ver=6.1">' + PAGE
    root = markup.tree(source)
    found = markup.analysed(source, root)
    assert read == [len(source)] and (found["volatile"], found["versions"]) == (["1"], ["asset /wp-content/a.css 6.1"])
