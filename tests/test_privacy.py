"""What recorded URLs, headers and texts show; candidates of the own site; worst audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import privacy
from tracewell.operators import observations


def test_urls_and_texts(spark):
    assert privacy.shown_url("https://me:pw@Shop.test:8443/a?Token=x&b=&c=d%20e#f") == "https://shop.test:8443/a?Token=%5BREDACTED%5D&b=&c=d+e"
    assert privacy.shown_url("https://h:99999999/") == privacy.BAD and len(privacy.shown_url("https://h/" + "x" * 5000)) == 4096
    rows = [(1, "no link"), (2, None), (3, 'a <a href="http://h/?sig=1">b</a> https://h/?q=1&code=2'), (4, "x" * 50)]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id long, t string").select("id", privacy.redacted_text(F.col("t"), 200).alias("t")).collect()}
    assert got == {1: "no link", 2: None, 3: 'a <a href="http://h/?sig=%5BREDACTED%5D">b</a> https://h/?q=1&code=%5BREDACTED%5D', 4: "x" * 50}
    assert spark.createDataFrame(rows, "id long, t string").select(privacy.redacted_text(F.col("t"), 7).alias("t")).collect()[3].t == "x" * 7


def test_headers(spark):
    rows = [({"Referer": "https://u:p@h/?key=1", "COOKIE": "c", "Accept": "y" * 3000, "Origin": None},), ({},), (None,), ({"Location": "http://h/?token=1", "ETag": "e"},)]
    frame = spark.createDataFrame(rows, "h map<string, string>")
    asked = [r[0] for r in frame.select(privacy.redacted_headers(F.col("h"))).collect()]
    assert asked == [{"accept": "y" * 2048, "referer": "https://h/?key=%5BREDACTED%5D"}, {}, None, {}]
    assert frame.select(privacy.redacted_headers(F.col("h"), response=True)).collect()[3][0] == {"etag": "e", "location": "http://h/?token=%5BREDACTED%5D"}


def test_candidates_of_the_own_site_come_first(spark):
    s = spark.createDataFrame([(1, 5, 7, 10, True), (2, 5, 8, 90, True), (3, 5, 7, 20, False), (4, 5, None, 95, True)], "id long, resource_id long, site_id long, fetched_at long, ok boolean")
    ask = lambda site, n=20: [(r.id, r["rank"]) for r in observations.site_first_candidate(spark.createDataFrame([(5, site)], "resource_id long, site_id long"), s, F.col("ok"), n).collect()]
    assert ask(7) == [(1, 2)] and ask(8) == [(2, 1)] and ask(None) == [(4, 1)] and ask(7, 1) == []


def test_worst_audits(spark):
    a = spark.createDataFrame([(1, "a", None), (1, "b", 0.5), (1, "c", 0.1), (1, "d", 0.1), (2, "e", None)], "report_id long, audit_id string, score double")
    assert sorted((r.report_id, r["rank"], r.audit_id) for r in observations.top_diagnostics(a, 3).collect()) == [(1, 1, "c"), (1, 2, "d"), (1, 3, "b"), (2, 1, "e")]
