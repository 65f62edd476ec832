"""Landed feeds as observations (SRC-01 to SRC-40 but those of listings and
html, DAT-06).

A connector never calls the network: bodies are landed as (source, body)
rows or files, with the outcome of the fetch. Each feed is a declaration:
where its items are, and an expression per field over an item's VARIANT. A
body that doesn't parse gives no rows and a status row."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.functions.places import DEFAULT
from quarrylark.functions.text import repair_entities
from quarrylark.operators.state import rotate
from quarrylark.session import bounded_batches
from quarrylark.sources.html import html_text, html_to_text

FIELDS = ["native_id", "title", "company", "url", "apply_url", "location_raw", "description", "salary", "posted", "employment_type", "remote"]


@dataclass(frozen=True)
class Pay:
    """Where an item's pay is: a currency, or the path of one; the paths of
    its bounds and of its unit."""

    low: str
    high: str
    currency: str | None = None
    unit: str | None = None


@dataclass(frozen=True)
class JsonFeed:
    """items: path of the array; fields: JSON paths, tried in order; a path
    that ends in [*] joins an array's values (of objects their names) with
    commas, paths joined by + are the bounds of a range, and .*. stands for
    any key of an object, the first in order that has a value. remote_only:
    a board of remote work, whose place is what it is restricted to. page: what
    an id is put behind where an item has no url. closed: the path of what only
    closed postings have. made: fields made of the item and its board."""

    name: str
    items: str
    fields: dict[str, list[str]]
    source_type: str = "feed"
    require: str = "title"
    reliable_date: bool = True
    remote_only: bool = False
    pay: Pay | None = None
    page: str | None = None
    closed: str | None = None
    made: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)


def _f(**paths: str) -> dict[str, list[str]]:
    return {k: v.split("|") for k, v in paths.items()}


ISO_COUNTRIES = {code.upper(): name for code, name in DEFAULT.countries.items() if len(code) == 2}


def _at(item: Column, path: str) -> Column:
    """What stands at a path, null if it is empty."""
    return F.nullif(F.trim(F.get_json_object(item, path)), F.lit(""))


def _duties(item: Column, board: Column) -> Column:
    head = "$.MatchedObjectDescriptor"
    duties = F.array_join(F.from_json(F.get_json_object(item, f"{head}.UserArea.Details.MajorDuties"), "array<string>"), " ")
    return F.nullif(F.concat_ws("\n\n", _at(item, f"{head}.UserArea.Details.JobSummary"), _at(item, f"{head}.QualificationSummary"), F.nullif(duties, F.lit(""))), F.lit(""))


def _schedules(item: Column, board: Column) -> Column:
    named = F.from_json(F.get_json_object(item, "$.MatchedObjectDescriptor.PositionSchedule"), "array<struct<Name:string>>")
    return F.array_join(named["Name"], ", ")


def _german_place(item: Column, board: Column) -> Column:
    at = "$.stellenlokationen[0].adresse"
    return F.concat_ws(", ", _at(item, f"{at}.ort"), F.initcap(F.replace(_at(item, f"{at}.region"), F.lit("_"), F.lit(" "))), F.lit("Germany"))


def _mostly_home(item: Column, board: Column) -> Column:
    return F.when((_at(item, "$.homeofficemoeglich") == "true") & (_at(item, "$.homeofficeprozent").try_cast("int") >= 90), "true")


def _workday(item: Column, board: Column) -> tuple[Column, Column, Column, Column]:
    """tenant, server, site of `tenant/server/site`, and the requisition."""
    part = lambda k: F.get(F.split(board, "/"), F.lit(k))
    return part(0), part(1), part(2), F.upper(_at(item, "$.bulletFields[0]"))


def _workday_id(item: Column, board: Column) -> Column:
    tenant, _, _, requisition = _workday(item, board)
    return F.when(requisition.isNotNull(), F.concat_ws(":", F.lower(tenant), requisition))


def _workday_url(item: Column, board: Column) -> Column:
    tenant, server, site, _ = _workday(item, board)
    return F.concat(F.lit("https://"), tenant, F.lit("."), server, F.lit(".myworkdayjobs.com/"), site, _at(item, "$.externalPath"))


def _slug_place(item: Column, board: Column) -> Column:
    """The place, with the first country's name where it is not in it."""
    codes = F.from_json(F.get_json_object(item, "$.countries"), "array<string>")
    names = F.create_map(*[F.lit(x) for code, name in ISO_COUNTRIES.items() for x in (code, name)])
    country = F.get(F.filter(F.transform(codes, lambda c: F.try_element_at(names, F.upper(c))), lambda c: c.isNotNull()), F.lit(0))
    place = _at(item, "$.location")
    return F.when(place.isNotNull() & F.contains(F.lower(place), F.lower(country)), place).otherwise(F.nullif(F.concat_ws(", ", place, country), F.lit("")))


#: Public response shapes of the services.
FEEDS = [
    JsonFeed("remotive", "$.jobs", _f(native_id="$.id", title="$.title", company="$.company_name", url="$.url", location_raw="$.candidate_required_location", description="$.description", salary="$.salary", posted="$.publication_date", employment_type="$.job_type"), remote_only=True),
    JsonFeed("jobicy", "$.jobs", _f(native_id="$.id", title="$.jobTitle", company="$.companyName", url="$.url", location_raw="$.jobGeo", description="$.jobDescription|$.jobExcerpt", posted="$.pubDate", employment_type="$.jobType[*]"), remote_only=True, pay=Pay("$.annualSalaryMin", "$.annualSalaryMax", "$.salaryCurrency")),
    JsonFeed("himalayas", "$.jobs", _f(native_id="$.guid|$.applicationLink", title="$.title", company="$.companyName", url="$.applicationLink|$.guid", location_raw="$.locationRestrictions[*]", description="$.description|$.excerpt", posted="$.pubDate|$.publishedAt", employment_type="$.employmentType"), remote_only=True, pay=Pay("$.minSalary", "$.maxSalary", "$.currency")),
    JsonFeed("arbeitnow", "$.data", _f(native_id="$.slug", title="$.title", company="$.company_name", url="$.url", location_raw="$.location", description="$.description", posted="$.created_at", employment_type="$.job_types[*]", remote="$.remote")),
    JsonFeed("remoteok", "$", _f(native_id="$.id", title="$.position", company="$.company", url="$.url", apply_url="$.apply_url", location_raw="$.location", description="$.description", posted="$.epoch|$.date"), remote_only=True, pay=Pay("$.salary_min", "$.salary_max", "USD")),
    JsonFeed(
        "usajobs", "$.SearchResult.SearchResultItems",
        _f(native_id="$.MatchedObjectDescriptor.PositionID|$.MatchedObjectDescriptor.PositionURI", title="$.MatchedObjectDescriptor.PositionTitle", company="$.MatchedObjectDescriptor.OrganizationName|$.MatchedObjectDescriptor.DepartmentName", url="$.MatchedObjectDescriptor.PositionURI", apply_url="$.MatchedObjectDescriptor.ApplyURI[0]", location_raw="$.MatchedObjectDescriptor.PositionLocationDisplay", posted="$.MatchedObjectDescriptor.PublicationStartDate"),
        "government", pay=Pay("$.MatchedObjectDescriptor.PositionRemuneration[0].MinimumRange", "$.MatchedObjectDescriptor.PositionRemuneration[0].MaximumRange", "USD", "$.MatchedObjectDescriptor.PositionRemuneration[0].Description"), made={"description": _duties, "employment_type": _schedules},
    ),
    JsonFeed("adzuna", "$.results", _f(native_id="$.id", title="$.title", company="$.company.display_name", url="$.redirect_url", location_raw="$.location.display_name", description="$.description", salary="$.salary_min+$.salary_max", posted="$.created"), "aggregator"),
    JsonFeed("jooble", "$.jobs", _f(native_id="$.id", title="$.title", company="$.company", url="$.link", location_raw="$.location", description="$.snippet", salary="$.salary", posted="$.updated"), "aggregator", reliable_date=False),
    JsonFeed("jsearch", "$.data", _f(native_id="$.job_id", title="$.job_title", company="$.employer_name", url="$.job_apply_link", location_raw="$.job_city|$.job_country", description="$.job_description", posted="$.job_posted_at_datetime_utc", remote="$.job_is_remote"), "aggregator"),
    JsonFeed("reliefweb", "$.data", _f(native_id="$.id", title="$.fields.title", company="$.fields.source[0].name", url="$.fields.url", location_raw="$.fields.country[0].name", description="$.fields.body", posted="$.fields.date.created")),
    JsonFeed("workable_search", "$.jobs", _f(native_id="$.id", title="$.title", company="$.company.title", url="$.url", location_raw="$.location.city|$.location.countryName", description="$.description", posted="$.created"), "aggregator"),
    JsonFeed(
        "freehire", "$.data", _f(native_id="$.public_slug|$.url", title="$.title", company="$.company", url="$.url", description="$.description", posted="$.posted_at|$.created_at"), "aggregator",
        pay=Pay("$.enrichment.salary_min", "$.enrichment.salary_max", "$.enrichment.salary_currency", "$.enrichment.salary_period"), page="https://freehire.dev/jobs/", closed="$.closed_at",
        made={"location_raw": _slug_place, "remote": lambda i, b: F.when(_at(i, "$.work_mode") == "remote", "true"), "employment_type": lambda i, b: F.replace(_at(i, "$.enrichment.employment_type"), F.lit("_"), F.lit(" ")), "url": lambda i, b: F.substring_index(_at(i, "$.url"), "?utm_", 1)},
    ),
    JsonFeed("hn_hiring", "$.hits", _f(native_id="$.objectID", title="$.comment_text", url="$.story_url", description="$.comment_text", posted="$.created_at"), "feed"),
    JsonFeed(
        "bundesagentur", "$.ergebnisliste", _f(native_id="$.referenznummer", title="$.stellenangebotsTitel", company="$.firma", apply_url="$.externeURL", description="$.stellenangebotsBeschreibung", posted="$.datumErsteVeroeffentlichung|$.veroeffentlichungszeitraum.von"), "government",
        pay=Pay("$.gehaltsspanneVon", "$.gehaltsspanneBis", "EUR", "$.verguetungsangabe"), page="https://www.arbeitsagentur.de/jobsuche/jobdetail/",
        made={"location_raw": _german_place, "remote": _mostly_home, "employment_type": lambda i, b: F.when(_at(i, "$.arbeitszeitVollzeit") == "true", "Full-time")},
    ),
    JsonFeed("eures", "$.jvs", _f(native_id="$.id", title="$.translations.en.title|$.translations.fr.title|$.translations.*.title|$.title", company="$.employer.name", location_raw="$.locationMap", description="$.translations.en.description|$.translations.fr.description|$.translations.*.description|$.description", posted="$.creationDate"), "government"),
    JsonFeed("france_travail", "$.resultats", _f(native_id="$.id", title="$.intitule", company="$.entreprise.nom", url="$.origineOffre.urlOrigine", apply_url="$.contact.urlPostulation", location_raw="$.lieuTravail.libelle", description="$.description", salary="$.salaire.libelle", posted="$.dateCreation"), "government", page="https://candidat.francetravail.fr/offres/recherche/detail/"),
    JsonFeed("greenhouse", "$.jobs", _f(native_id="$.id", title="$.title", url="$.absolute_url", location_raw="$.location.name", posted="$.first_published|$.updated_at"), "ats", made={"description": lambda i, b: html_text(_at(i, "$.content"))}),  # its HTML is escaped once more
    JsonFeed("lever", "$", _f(native_id="$.id", title="$.text", url="$.hostedUrl", location_raw="$.categories.location", description="$.descriptionPlain|$.description", posted="$.createdAt", employment_type="$.categories.commitment"), "ats"),
    JsonFeed("ashby", "$.jobs", _f(native_id="$.id", title="$.title", url="$.jobUrl", location_raw="$.location", description="$.descriptionPlain|$.descriptionHtml", posted="$.publishedAt", employment_type="$.employmentType", remote="$.isRemote"), "ats"),
    JsonFeed("smartrecruiters", "$.content", _f(native_id="$.id", title="$.name", company="$.company.name", url="$.ref", location_raw="$.location.fullLocation|$.location.city", posted="$.releasedDate", employment_type="$.typeOfEmployment.label", remote="$.location.remote"), "ats"),
    JsonFeed("workable", "$.jobs", _f(native_id="$.shortcode", title="$.title", url="$.url", location_raw="$.city|$.country", description="$.description", posted="$.published_on", remote="$.telecommuting"), "ats"),
    JsonFeed("recruitee", "$.offers", _f(native_id="$.id", title="$.title", company="$.company_name", url="$.careers_url", location_raw="$.location", description="$.description", posted="$.published_at", remote="$.remote"), "ats"),
    JsonFeed("workday", "$.jobPostings", _f(title="$.title", location_raw="$.locationsText", posted="$.postedOn"), "ats", reliable_date=False, made={"native_id": _workday_id, "url": _workday_url}),
    JsonFeed("oracle", "$.items[0].requisitionList", _f(native_id="$.Id", title="$.Title", location_raw="$.PrimaryLocation", description="$.ShortDescriptionStr", posted="$.PostedDate"), "ats"),
    JsonFeed("tenders", "$.notices", _f(native_id="$.publication-number|$.id", title="$.notice-title|$.title", company="$.buyer-name", url="$.links.html", location_raw="$.buyer-country", posted="$.publication-date"), "government"),
    JsonFeed("procurement_notices", "$.procnotices", _f(native_id="$.id", title="$.bid_description|$.project_name", company="$.contact_organization", url="$.url", location_raw="$.project_ctry_name", posted="$.noticedate"), "government"),
]
BY_NAME = {f.name: f for f in FEEDS}


#: What a service's words for the unit of pay mean.
PAY_WORDS = {"JAHRESGEHALT": "yearly", "MONATSGEHALT": "monthly", "STUNDENLOHN": "hourly"}


def _json(text: Column, path: Column) -> Column:
    """get_json_object with a path that is a column."""
    return F.call_function("get_json_object", text, path)


def _one(item: Column, path: Column) -> Column:
    """The text at one path of a declaration."""
    range_, any_key, list_ = F.split(path, r"\+"), F.split(path, r"\.\*\.", 2), F.rtrim(path, F.lit("[*]"))
    bound = lambda k: F.nullif(_json(item, F.get(range_, F.lit(k))), F.lit(""))
    both = F.nullif(F.concat_ws("-", bound(0), F.when(~bound(1).eqNullSafe(bound(0)), bound(1))), F.lit(""))
    node = F.from_json(_json(item, F.get(any_key, F.lit(0))), "map<string,string>")
    keyed = F.transform(F.array_sort(F.map_keys(node)), lambda k: _json(F.element_at(node, k), F.concat(F.lit("$."), F.get(any_key, F.lit(1)))))
    array = F.from_json(_json(item, list_), "array<string>")
    named = F.transform(array, lambda e: F.coalesce(_json(e, F.lit("$.name")), e))
    listed = F.coalesce(F.array_join(F.filter(named, lambda e: F.length(e) > 0), ", "), _json(item, list_))
    return F.when(path.contains("+"), both).when(path.contains(".*."), F.get(F.filter(keyed, lambda v: F.length(v) > 0), F.lit(0))).when(path.endswith("[*]"), listed).otherwise(_json(item, path))


def _value(item: Column, paths: Column) -> Column:
    """The first text that is not empty."""
    said = F.transform(paths, lambda p: F.nullif(F.trim(_one(item, p)), F.lit("")))
    return F.get(F.filter(said, lambda v: v.isNotNull()), F.lit(0))


def _specs(spark: SparkSession, feeds: list[JsonFeed]) -> DataFrame:
    """The declarations as rows, one a feed."""
    kind = "source string, source_type string, items string, require string, reliable boolean, remote_only boolean, page string, closed string, fields map<string,array<string>>, pay struct<low:string,high:string,currency:string,unit:string>"
    pay = lambda f: (f.pay.low, f.pay.high, f.pay.currency, f.pay.unit) if f.pay else None
    return spark.createDataFrame([(f.name, f.source_type, f.items, f.require, f.reliable_date, f.remote_only, f.page, f.closed, f.fields, pay(f)) for f in feeds], kind)


def _items(bodies: DataFrame, feeds: list[JsonFeed]) -> DataFrame:
    """Bodies beside their feed's declaration, with the array of items. The
    declarations are configuration, one row a feed."""
    rows = bodies if "board" in bodies.columns else bodies.withColumn("board", F.lit(None).cast("string"))
    rows = rows.select("landed", "source", "board", "body").join(F.broadcast(_specs(bodies.sparkSession, feeds)), "source")
    array = F.when(F.col("items") == "$", F.col("body")).otherwise(_json(F.col("body"), F.col("items")))
    return rows.withColumn("array", F.from_json(array, "array<string>"))


def _pay(item: Column) -> Column:
    at = lambda name: _json(item, F.col(f"pay.{name}"))
    bound = lambda name: F.coalesce(F.nullif(F.nullif(at(name), F.lit("0")), F.lit("")), F.lit(""))
    currency = F.when(F.col("pay.currency").startswith("$"), at("currency")).otherwise(F.col("pay.currency"))
    words = F.create_map(*[F.lit(x) for kv in PAY_WORDS.items() for x in kv])
    unit = F.coalesce(F.try_element_at(words, at("unit")), at("unit"))
    said = F.concat_ws(" ", F.nullif(currency, F.lit("")), F.concat(bound("low"), F.lit("–"), bound("high")), F.nullif(unit, F.lit("")))
    return F.when((bound("low") != "") | (bound("high") != ""), said)


def parse_feeds(bodies: DataFrame, feeds: list[JsonFeed] | None = None) -> DataFrame:
    """Observations of landed bodies of any feeds (SRC-01), in one pass: items
    without the required field go (a notice, say), closed ones too, repeated
    ids of a source stay once, the first body wins. bodies: landed (order),
    source, body and, where a feed's links need it, board."""
    feeds = FEEDS if feeds is None else feeds
    rows = _items(bodies, feeds).withColumn("items", F.col("array")).drop("array").select("*", F.posexplode("items").alias("pos", "item"))
    item, board = F.col("item"), F.col("board")
    rows = rows.where(F.col("closed").isNull() | _json(item, F.col("closed")).isNull())

    def read(f: str) -> Column:
        value = _value(item, F.try_element_at(F.col("fields"), F.lit(f)))
        for feed in feeds:
            if f in feed.made:
                value = F.when(F.col("source") == feed.name, F.nullif(F.trim(feed.made[f](item, board)), F.lit(""))).otherwise(value)
        return value.alias(f)

    rows = rows.select("landed", "pos", "source", "source_type", "require", "reliable", "remote_only", "page", _pay(item).alias("pay_said"), *[read(f) for f in FIELDS])
    rows = rows.withColumn("url", F.coalesce("url", F.concat("page", "native_id"))).where(F.try_element_at(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f))]), F.col("require")).isNotNull())
    rows = rows.withColumn("key", F.coalesce("native_id", "url", F.concat_ws("|", "landed", "pos")))
    first = rows.groupBy("source", "key").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("source", "key")]), F.struct("landed", "pos")).alias("r")).select("source", "r.*")
    place = F.when(F.col("remote_only"), F.concat_ws(" - ", F.lit("Remote"), "location_raw")).otherwise(F.col("location_raw"))
    return first.select(
        F.col("source").alias("source_name"), "source_type", F.when(F.col("native_id").isNotNull(), F.concat_ws(":", "source", "native_id")).alias("native_id"),
        "title", "company", "url", F.coalesce("apply_url", "url").alias("apply_url"), place.alias("location_raw"), html_text(F.col("description")).alias("description"), F.coalesce("salary", "pay_said").alias("salary"), "posted",
        (F.col("reliable") & F.col("posted").isNotNull()).alias("posted_at_reliable"), "employment_type", F.when(F.col("remote_only"), F.lit(True)).otherwise(F.expr("try_cast(remote AS boolean)")).alias("remote_flag"), F.lit("api").alias("extraction_method"), "landed", "pos",
    )


def parse_feed(bodies: DataFrame, feed: JsonFeed) -> DataFrame:
    """parse_feeds of bodies (landed, body) of one feed."""
    return parse_feeds(bodies.withColumn("source", F.lit(feed.name)), [feed])


def feed_status(bodies: DataFrame, feed: JsonFeed) -> DataFrame:
    """(landed, status, n): SUCCESS, PARTIAL if items lack the required field,
    FAILED if the body doesn't have the shape."""
    rows = _items(bodies.withColumn("source", F.lit(feed.name)), [feed])
    good = F.size(F.filter("array", lambda i: _value(i, F.try_element_at(F.col("fields"), F.col("require"))).isNotNull()))
    return rows.select("landed", F.when(F.col("array").isNull(), "FAILED").when(good < F.size("array"), "PARTIAL").otherwise("SUCCESS").alias("status"), F.coalesce(F.when(F.col("array").isNotNull(), good), F.lit(0)).alias("n"))


def board_rows(lists: DataFrame, details: DataFrame) -> DataFrame:
    """A board's list with its details, which win where present (SRC-21,
    SRC-24): both native_id, description."""
    d = details.select("native_id", F.col("description").alias("full"))
    return lists.join(d, "native_id", "left").withColumn("description", F.coalesce("full", "description")).drop("full")


def union_pages(pages: DataFrame, key: str = "native_id") -> DataFrame:
    """Pages of term queries as one list, the first page wins (SRC-28, SRC-29)."""
    return pages.groupBy(key).agg(F.min_by(F.struct(*[c for c in pages.columns if c != key]), F.struct("landed", "pos")).alias("r")).select(key, "r.*")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def parse_rss(body: str) -> list[dict]:
    """Items of an RSS or Atom feed; full content before summaries; a touched
    date is no posting date (SRC-07)."""
    try:
        root = ElementTree.fromstring(repair_entities(body.strip()))
    except ElementTree.ParseError:
        return []
    out = []
    for item in root.iter():
        if _local(item.tag) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for child in item:
            value = (child.text or "").strip() or child.attrib.get("href", "")
            got.setdefault(_local(child.tag), value)
        posted = got.get("pubdate") or got.get("published") or got.get("date")
        out.append({"title": html_to_text(got.get("title")), "url": got.get("link") or got.get("id"), "description": html_to_text(got.get("encoded") or got.get("content") or got.get("description") or got.get("summary")), "posted": posted or got.get("updated"), "posted_at_reliable": bool(posted), "native_id": got.get("guid") or got.get("id")})
    return [x for x in out if x["title"]]


def rss_rows(bodies: DataFrame) -> DataFrame:
    schema = "landed long, title string, url string, description string, posted string, posted_at_reliable boolean, native_id string"

    def run(batches):
        for b in batches:
            yield pd.DataFrame([{"landed": k, **r} for k, body in zip(b.landed, b.body, strict=True) for r in parse_rss(body or "")], columns=[c.split()[0] for c in schema.split(", ")])

    bounded_batches(bodies.sparkSession)
    return bodies.select("landed", "body").mapInPandas(run, schema)


def personio_rows(bodies: DataFrame) -> DataFrame:
    """Positions of a board's XML; a page of HTML gives none (SRC-27)."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?s)(<position>.*?</position>)"), 1)
    x = lambda path: F.nullif(F.trim(F.xpath_string("p", F.lit(path))), F.lit(""))
    return bodies.where(~F.lower(F.substring("body", 1, 200)).contains("<html")).select("landed", F.explode(blocks).alias("p")).select("landed", x("position/id").alias("native_id"), x("position/name").alias("title"), x("position/office").alias("location_raw"), x("position/schedule").alias("employment_type"))


def cdx_boards(lines: DataFrame, known: DataFrame) -> DataFrame:
    """New boards in crawl index lines (SRC-34): line is JSON with a url."""
    from quarrylark.functions.urls import detect_board

    boards = lines.select(detect_board(F.get_json_object("line", "$.url")).alias("b")).where(F.col("b.slug").isNotNull()).select("b.ats", "b.slug").distinct()
    return boards.join(known.select("ats", "slug"), ["ats", "slug"], "left_anti")


def probe_grid(slugs: DataFrame, platforms: list[str]) -> DataFrame:
    """Slugs for each platform (SRC-36, JOIN-22); platforms are a short list."""
    return slugs.select("slug", F.explode(F.array(*[F.lit(p) for p in platforms])).alias("ats"))


def query_grid(countries: DataFrame, terms: list[str], cursor: int, budget: int) -> tuple[DataFrame, Column]:
    """The next (country, term) queries after a cursor, and the next cursor
    (JOIN-23). countries: place (their order), country; each asks the terms in
    turn, so the grid is never gathered."""
    asked = countries.select("place", "country", F.posexplode(F.array(*map(F.lit, terms))).alias("turn_of", "term"))
    taken, following = rotate(asked.withColumn("order", F.struct("place", "turn_of")), "order", cursor, budget)
    return taken.select("country", "term"), following


def read_xlsx(content: bytes) -> list[list[str]]:
    """Cells of the first sheet of a workbook, as text (SRC-37)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter():
            if _local(row.tag) != "row":
                continue
            cells: dict[int, str] = {}
            for k, c in enumerate(x for x in row if _local(x.tag) == "c"):
                letters = re.match(r"[A-Z]+", c.attrib.get("r", ""))
                at = k
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                v = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                cells[at] = shared[int(v)] if c.attrib.get("t") == "s" and v else v
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return rows


def read_csv_rows(body: str) -> list[dict]:
    return list(csv.DictReader(io.StringIO(body)))


def html_table(body: str) -> list[list[str]]:
    """Rows of all tables of a page (SRC-37)."""
    out = []
    for row in re.findall(r"(?is)<tr\b.*?</tr>", body):
        out.append([html_to_text(c) for c in re.findall(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", row)])
    return [r for r in out if r]


def load_toml(spark: SparkSession, text: str, table: str, schema: str) -> DataFrame:
    """An array of tables of a TOML text as rows (SRC-40)."""
    import tomllib

    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in tomllib.loads(text).get(table, [])], schema)


def union_observations(parts: list[DataFrame]) -> DataFrame:
    """Sources in order as one table; obs_seq = (source ordinal, landed, pos)
    as one number, so the order doesn't depend on partitions (SET-01)."""
    out = None
    for k, p in enumerate(parts):
        q = p.withColumn("obs_seq", F.lit(k).cast("long") * (1 << 48) + F.col("landed").cast("long") * (1 << 24) + F.col("pos").cast("long"))
        out = q if out is None else out.unionByName(q, allowMissingColumns=True)
    return out


def knows_text(candidates: DataFrame, texts: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Candidates whose full text is not fresh already (FLT-16): id, aliases."""
    fresh = texts.where(F.col("seen") >= now - F.make_interval(days=F.lit(days))).select(F.col("canonical_id").alias("alias"))
    known = candidates.select("id", F.explode(F.array_distinct(F.concat(F.array("id"), "aliases"))).alias("alias")).join(fresh, "alias", "left_semi").select("id").distinct()
    return candidates.join(known, "id", "left_anti")
