"""Sources with shapes of their own: scraped frames, checked searches, result
lists, sitemap trees, web searches, rates (SRC-09, SRC-15, SRC-19, SRC-20,
SRC-31, SRC-33, SRC-39)."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.functions.text import column_udf
from quarrylark.functions.urls import canonical_url, detect_board, is_aggregator, is_http_url
from quarrylark.sources.html import html_text, sitemap_entries

#: The windows in days that a search service takes, the files of a sitemap tree that are read.
WINDOWS, SITEMAP_FILES, SITEMAP_LEVELS = [1, 3, 7, 14, 31], 6, 3


def scraped_rows(frame: DataFrame) -> DataFrame:
    """Observations of a scraper's frame (SRC-09): NaN, "nan", "None" and empty
    cells are null, bounds of pay become one text, repeated ids stay once.
    Needs landed, id, site, title, company, job_url, location, description,
    date_posted, min_amount, max_amount, currency, interval, is_remote."""
    told = lambda c: F.when(~F.lower(F.trim(F.col(c))).isin("", "nan", "none", "nat"), F.trim(F.col(c)))
    amount = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).cast("bigint").cast("string")
    low, high = amount("min_amount"), amount("max_amount")
    pay = F.nullif(F.concat_ws(" ", told("currency"), F.nullif(F.concat_ws("-", low, F.when(~high.eqNullSafe(low), high)), F.lit("")), F.when(told("interval").isNotNull(), F.concat(F.lit("per "), F.lower(told("interval"))))), F.lit(""))
    rows = frame.where(told("title").isNotNull()).select(
        "landed", F.lower(told("site")).alias("source_name"), F.lit("aggregator").alias("source_type"), F.concat_ws(":", F.lower(told("site")), told("id")).alias("native_id"), told("title").alias("title"), told("company").alias("company"),
        told("job_url").alias("url"), told("location").alias("location_raw"), html_text(told("description")).alias("description"), F.when(F.coalesce(low, high).isNotNull(), pay).alias("salary"), told("date_posted").alias("posted"), F.expr("try_cast(is_remote AS boolean)").alias("remote_flag"),
    )
    rest = [c for c in rows.columns if c != "native_id"]
    return rows.groupBy("native_id").agg(F.min_by(F.struct(*rest), "landed").alias("r")).select("native_id", "r.*")


def checked_searches(bodies: DataFrame, now: Column, days: int) -> DataFrame:
    """Postings of searches whose service drops parameters it does not know
    (SRC-15): landed, status, and of good answers id, title, company, url,
    posted. An answer that ignored the search word is FAILED and gives no rows;
    one that ignored another parameter is PARTIAL. Closed postings and those
    older than `days` go, repeated ones stay with the first answer."""
    ignored = F.transform(F.from_json(F.get_json_object("body", "$.meta.ignored_params"), "array<struct<param:string>>"), lambda p: p["param"])
    items = F.from_json(F.get_json_object("body", "$.data"), "array<struct<public_slug:string,title:string,company:string,url:string,posted_at:string,closed_at:string>>")
    read = bodies.select("landed", F.coalesce(ignored, F.array().cast("array<string>")).alias("ignored"), items.alias("items"))
    dropped = F.arrays_overlap("ignored", F.array(F.lit("q_fields"), F.lit("sort"), F.lit("limit")))
    read = read.withColumn("status", F.when(F.col("items").isNull() | F.array_contains("ignored", "q"), "FAILED").when(dropped, "PARTIAL").otherwise("SUCCESS"))
    rows = read.select("landed", "status", F.when(F.col("status") != "FAILED", F.col("items")).alias("items")).select("landed", "status", F.posexplode("items").alias("pos", "i")).select("landed", "status", "pos", "i.*")
    rows = rows.withColumn("posted", F.expr("try_cast(posted_at AS timestamp)")).withColumn("id", F.coalesce("public_slug", "url"))
    rows = rows.where(F.col("id").isNotNull() & F.col("closed_at").isNull() & (F.col("posted").isNull() | (F.col("posted") >= now - F.make_interval(days=F.lit(days)))))
    columns = ["landed", "status", "title", "company", "url", "posted"]
    return rows.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("landed", "pos")).alias("r")).select("id", "r.*")


def result_list(bodies: DataFrame, country: str = "Canada") -> DataFrame:
    """Postings of a job bank's result pages (SRC-19), each an article with a
    number: landed, native_id, title, company, location_raw, salary, posted,
    url. bodies: landed, origin, body. `City (ON)` reads `City, ON`."""
    articles = F.regexp_extract_all("body", F.lit(r"""(?is)(<article\b[^>]*\bid=["']article-[0-9]+["'].*?</article>)"""), 1)
    a = bodies.select("landed", "origin", F.posexplode(articles).alias("pos", "a"))
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(html_text(c), r"\s+", " ")), F.lit(""))
    item = lambda kind: plain(F.regexp_extract("a", rf"""(?is)<li\b[^>]*class=["'][^"']*\b{kind}\b[^"']*["'][^>]*>(.*?)</li>""", 1))
    number = F.regexp_extract("a", r"""(?i)\bid=["']article-([0-9]+)["']""", 1)
    title = plain(F.regexp_extract("a", r"""(?is)<[a-z0-9]+\b[^>]*class=["'][^"']*\bnoctitle\b[^"']*["'][^>]*>(.*?)</""", 1))
    place = F.regexp_replace(F.regexp_replace(item("location"), r"^(?:Location|Emplacement|Lieu)\s*", ""), r"\s*\(([A-Z]{2})\)$", ", $1")
    return a.where(title.isNotNull()).select(
        "landed", "pos", F.concat(F.lit("jobbank:"), number).alias("native_id"), title.alias("title"), item("business").alias("company"), F.concat_ws(", ", F.nullif(place, F.lit("")), F.lit(country)).alias("location_raw"),
        F.nullif(F.regexp_replace(item("salary"), r"^(?:Salary|Salaire)\s*:?\s*", ""), F.lit("")).alias("salary"), item("date").alias("posted"), F.concat("origin", F.lit("/jobsearch/jobposting/"), number).alias("url"),
    )


def search_window(days: Column) -> Column:
    """The smallest window that a service takes and that holds so many days,
    else its largest (SRC-20)."""
    out = None
    for w in WINDOWS:
        out = F.when(days <= w, w) if out is None else out.when(days <= w, w)
    return out.otherwise(WINDOWS[-1])


def _plain_bytes(body: pd.Series) -> pd.Series:
    def one(b):
        if b is None:
            return None
        try:
            return (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else bytes(b)).decode("utf-8", "replace")
        except (OSError, EOFError):
            return ""

    return body.map(one)


def file_text(body: Column) -> Column:
    """The text of a file's bytes, unpacked if gzipped; empty if it is broken."""
    return column_udf(_plain_bytes, "string")(body)


def sitemap_tree(roots: DataFrame, files: DataFrame, most: int = SITEMAP_FILES, levels: int = SITEMAP_LEVELS) -> DataFrame:
    """(root, url, lastmod) of the pages that sitemaps name (SRC-31). roots:
    root (the URL of a site's map); files: loc, body (bytes as landed). An
    index's maps are read down to `levels`, the `most` newest of each site and
    level; a page that several maps name is listed once, with its latest date."""
    texts = files.select("loc", sitemap_entries(file_text(F.col("body"))).alias("entries"))
    level = roots.select("root", F.col("root").alias("loc"))
    pages = None
    for _ in range(levels):
        found = level.join(texts, "loc").select("root", F.explode("entries").alias("e")).select("root", "e.*")
        here = found.where(F.col("kind") == "url").select("root", F.col("loc").alias("url"), "lastmod")
        pages = here if pages is None else pages.unionByName(here)
        below = found.where(F.col("kind") == "sitemap").groupBy("root", "loc").agg(F.max("lastmod").alias("lastmod"))
        newest = F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("lastmod", F.lit("")).alias("m"), "loc")), asc=False), 1, most)
        level = below.groupBy("root").agg(newest.alias("n")).select("root", F.explode("n.loc").alias("loc"))
    return pages.where(is_http_url(F.col("url"))).groupBy("root", "url").agg(F.max("lastmod").alias("lastmod"))


def search_discoveries(bodies: DataFrame, known: DataFrame, aggregators: list[str]) -> DataFrame:
    """What web searches lead to (SRC-33): (kind, ats, slug, url, n) of new
    boards, and of other pages off the aggregators, once for each canonical
    URL. bodies: landed, body, the JSON of one service or the page of another,
    whose links carry their target in a parameter. known: ats, slug."""
    results = F.transform(F.from_json(F.get_json_object("body", "$.results"), "array<struct<url:string>>"), lambda r: r["url"])
    links = F.transform(F.regexp_extract_all("body", F.lit(r"[?&]uddg=([^&\"'#]+)"), 1), lambda u: F.coalesce(F.try_url_decode(u), u))
    urls = bodies.select(F.explode(F.coalesce(results, links)).alias("u")).where(is_http_url(F.col("u"))).select(canonical_url(F.col("u")).alias("url"), detect_board(F.col("u")).alias("b"))
    boards = urls.where(F.col("b.slug").isNotNull()).groupBy("b.ats", "b.slug").agg(F.min("url").alias("url"), F.count("*").alias("n"))
    boards = boards.join(known.select("ats", "slug"), ["ats", "slug"], "left_anti").select(F.lit("board").alias("kind"), "ats", "slug", "url", "n")
    none = F.lit(None).cast("string")
    pages = urls.where(F.col("b").isNull() & ~is_aggregator(F.col("url"), aggregators)).groupBy("url").agg(F.count("*").alias("n"))
    return boards.unionByName(pages.select(F.lit("page").alias("kind"), none.alias("ats"), none.alias("slug"), "url", "n"))


def rate_rows(bodies: DataFrame) -> DataFrame:
    """(currency, per_eur) of the latest landed answer (SRC-39): an object of
    rates to a base; the base is 1, another base than EUR is converted."""
    last = bodies.orderBy(F.desc("landed")).limit(1).select(F.upper(F.get_json_object("body", "$.base")).alias("base"), F.from_json(F.get_json_object("body", "$.rates"), "map<string,double>").alias("rates"))
    rates = last.select(F.explode(F.map_concat(F.map_filter("rates", lambda k, v: k != F.col("base")), F.create_map("base", F.lit(1.0)))).alias("currency", "rate"), F.when(F.col("base") == "EUR", 1.0).otherwise(F.try_element_at("rates", F.lit("EUR"))).alias("eur"))
    return rates.where((F.col("rate") > 0) & (F.col("eur") > 0)).select("currency", (F.col("rate") / F.col("eur")).alias("per_eur"))
