"""Contracts with what runs outside the engine."""

import datetime as dt

from pyspark.sql import functions as F

from quarrylark.sources import contracts as C


def test_fetches(spark):
    df = spark.createDataFrame([(200, None), (304, None), (403, None), (404, None), (429, None), (503, None), (418, None), (None, "timeout")], "s int, e string")
    assert [r[0] for r in df.select(C.fetch_kind(F.col("s"), F.col("e"))).collect()] == ["OK", "NOT_MODIFIED", "BLOCKED", "NOT_FOUND", "RATE_LIMITED", "SERVER_ERROR", "HTTP_ERROR", "TIMEOUT"]
    at = dt.datetime(2026, 9, 16)
    rows = [("a", "u", "OK", 200, 1, at, None), ("a", "v", "TIMEOUT", None, 3, at, None), ("b", "u", "OK", 200, 1, at, None), ("c", "u", "ROBOTS_DISALLOWED", None, 0, at, None)]
    assert {r.source: (r.status, r.last_error) for r in C.source_status(spark.createDataFrame(rows, C.FETCHES)).collect()} == {"a": ("PARTIAL", "TIMEOUT"), "b": ("SUCCESS", None), "c": ("SKIPPED", "ROBOTS_DISALLOWED")}
    assert [C.retry_after("TIMEOUT", k) for k in range(4)] == [2, 4, 8, None] and C.retry_after("RATE_LIMITED", 0, 500) == 60 and C.retry_after("NOT_FOUND", 0) is None


def test_robots():
    r = C.parse_robots("User-agent: *\nDisallow: /a\nAllow: /a/b$\nCrawl-delay: 2\nSitemap: https://x/s.xml\nUser-agent: own\nDisallow:", 200)
    assert r["delay"] == 2 and r["sitemaps"] == ["https://x/s.xml"]
    assert [C.robots_allow(r, p) for p in ("/", "/a/c", "/a/b", "/a/bc")] == [True, False, True, False]
    assert not C.robots_allow(C.parse_robots(None, None), "/") and C.robots_allow(C.parse_robots("", 404), "/x")
    assert C.robots_allow(C.parse_robots("User-agent: *\nDisallow: /\nUser-agent: own\nDisallow:", 200, "own"), "/x")


def test_reviews_and_secrets(spark):
    assert C.read_review('Sure: {"fit": 180, "years": "x", "veto": true, "languages": ["en"]} done')["fit"] == 100
    assert C.read_review("none") is None and C.read_review("{bad}") is None
    assert C.invented_codes("see 3fa2c and 00000", {"3fa2c"}) == ["00000"]
    df = spark.createDataFrame([("api_key=abc123 x",), ("plain",)], "t string")
    assert [r[0] for r in df.select(C.redact_secrets(F.col("t"))).collect()] == ["[redacted] x", "plain"]


def test_configuration(spark):
    terms = spark.createDataFrame([("tech", "gis", 5, "gis", "geo", None)], "kind string, canonical string, weight int, pattern string, family string, requires string")
    assert C.load_taxonomy(spark, terms, direct=["x"]).terms[0].canonical == "gis"
    names = spark.createDataFrame([("Geo Maps",), ("Geo Catering",), ("Other",)], "name string")
    assert [r.name for r in C.employer_targets(names, "geo", "catering").collect()] == ["Geo Maps"]
    assert spark.range(1).select(C.keep_last(F.array(*[F.lit(k) for k in range(5)]), 2)).first()[0] == [3, 4]
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted(tuple(r) for r in C.union_distinct([a, b], "k").collect()) == [(1, "a"), (2, "b")]
    C.register_platform("own", lambda d: d)
    assert "own" in C.PLATFORM_PARSERS
