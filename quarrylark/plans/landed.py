"""Queries of the connectors: bodies of every declared shape are made from the
tables' ids and read back (SRC, EXT)."""

from __future__ import annotations

import gzip
import json
import re

import pandas as pd
from pyspark.sql import functions as F

from quarrylark.functions import text, urls
from quarrylark.plans.bindings import NOW, now, table
from quarrylark.plans.registry import query
from quarrylark.sources import feeds, html, listings

def _sql(value: str | None, number: str) -> str:
    if value is None:
        return "NULL"
    parts = str(value).replace("'", "''").split("@")
    return "concat(" + f", {number}, ".join(f"'{p}'" for p in parts) + ")"


def _case(number: str, cases: list[str]) -> str:
    return f"CASE {number} % {len(cases)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


#: Answers as the services give them, and what has to be read from each: source, board, body, then native id, title,
#: company, url, apply url, place, description, salary, employment, remote. @ is the document's number, L its language.
_N = None
_ANSWERS = [
    ("remotive", _N, '{"job-count":2,"jobs":[{"legal":"notice"},{"id":@,"url":"https://r.example/@","title":"Role @ L","company_name":"Firm L","job_type":"full_time","publication_date":"2024-01-02T03:04:05","candidate_required_location":"Europe","salary":"","description":"<p>Maps&nbsp;@ &amp; more</p>"}]}',
     "@", "Role @ L", "Firm L", "https://r.example/@", "https://r.example/@", "Remote - Europe", "Maps @ & more", _N, "full_time", True),
    ("jobicy", _N, '{"jobs":[{"id":@,"jobTitle":"Role @ L","companyName":"Firm","url":"https://j.example/@","jobGeo":"","jobType":["full-time","contract"],"jobExcerpt":"Short @","annualSalaryMin":@1,"annualSalaryMax":@2,"salaryCurrency":"CAD"}]}',
     "@", "Role @ L", "Firm", "https://j.example/@", "https://j.example/@", "Remote", "Short @", "CAD @1–@2", "full-time, contract", True),
    ("himalayas", _N, '{"jobs":[{"guid":"h-@","title":"Role @","companyName":"Firm","applicationLink":"https://h.example/@","locationRestrictions":[{"alpha2":"L","name":"Land L"},"Spain"],"excerpt":"Short @","employmentType":"Full Time","minSalary":0,"maxSalary":@9,"currency":"EUR","publishedAt":"2024-01-02"}]}',
     "h-@", "Role @", "Firm", "https://h.example/@", "https://h.example/@", "Remote - Land L, Spain", "Short @", "EUR –@9", "Full Time", True),
    ("arbeitnow", _N, '{"data":[{"slug":"role-@","company_name":"Firm","title":"Role @","description":"Long @","remote":false,"url":"https://a.example/@","job_types":["berufseinstieg"],"location":"Berlin","created_at":1704164645}]}',
     "role-@", "Role @", "Firm", "https://a.example/@", "https://a.example/@", "Berlin", "Long @", _N, "berufseinstieg", False),
    ("remoteok", _N, '[{"legal":"notice"},{"id":"@","epoch":1704164645,"company":"Firm","position":"Role @","url":"https://o.example/@","apply_url":"https://o.example/@/apply","location":"L","description":"Long @","salary_min":@0,"salary_max":@5},{"id":"@","position":"Role again"}]',
     "@", "Role @", "Firm", "https://o.example/@", "https://o.example/@/apply", "Remote - L", "Long @", "USD @0–@5", _N, True),
    ("usajobs", _N, '{"SearchResult":{"SearchResultItems":[{"MatchedObjectId":"7@","MatchedObjectDescriptor":{"PositionID":"P-@","PositionTitle":"Role @","PositionURI":"https://u.example/@","ApplyURI":["https://u.example/@/apply"],"PositionLocationDisplay":"Denver, Colorado","DepartmentName":"Interior","PositionSchedule":[{"Name":"Full-time","Code":"1"},{"Name":"Shift"}],"PositionRemuneration":[{"MinimumRange":"@1","MaximumRange":"@2","Description":"Per Year"}],"QualificationSummary":"Quality @","UserArea":{"Details":{"JobSummary":"Long @","MajorDuties":["Map.","Measure."]}}}}]}}',
     "P-@", "Role @", "Interior", "https://u.example/@", "https://u.example/@/apply", "Denver, Colorado", "Long @\n\nQuality @\n\nMap. Measure.", "USD @1–@2 Per Year", "Full-time, Shift", _N),
    ("adzuna", _N, '{"results":[{"id":"@","title":"Role @","company":{"display_name":"Firm"},"redirect_url":"https://z.example/@","location":{"display_name":"Leeds"},"description":"Short @","salary_min":@1,"salary_max":@1,"created":"2024-01-02T03:04:05Z"}]}',
     "@", "Role @", "Firm", "https://z.example/@", "https://z.example/@", "Leeds", "Short @", "@1", _N, _N),
    ("jooble", _N, '{"totalCount":1,"jobs":[{"id":@,"title":"Role @","company":"Firm","link":"https://l.example/@","location":"Lyon","snippet":"Short @","salary":"@ EUR","updated":"2024-01-02"}]}',
     "@", "Role @", "Firm", "https://l.example/@", "https://l.example/@", "Lyon", "Short @", "@ EUR", _N, _N),
    ("jsearch", _N, '{"data":[{"job_id":"s@==","job_title":"Role @","employer_name":"Firm","job_apply_link":"https://s.example/@","job_city":"","job_country":"US","job_description":"Long @","job_is_remote":true}]}',
     "s@==", "Role @", "Firm", "https://s.example/@", "https://s.example/@", "US", "Long @", _N, _N, True),
    ("reliefweb", _N, '{"data":[{"id":"@","fields":{"title":"Role @","url":"https://w.example/@","body":"Long @","source":[{"name":"Firm"},{"name":"Other"}],"country":[{"name":"Chad"}],"date":{"created":"2024-01-02"}}}]}',
     "@", "Role @", "Firm", "https://w.example/@", "https://w.example/@", "Chad", "Long @", _N, _N, _N),
    ("workable_search", _N, '{"jobs":[{"id":"k@","title":"Role @","company":{"title":"Firm"},"url":"https://k.example/@","location":{"city":"Porto","countryName":"Portugal"},"description":"Long @","created":"2024-01-02"}]}',
     "k@", "Role @", "Firm", "https://k.example/@", "https://k.example/@", "Porto", "Long @", _N, _N, _N),
    ("freehire", _N, '{"data":[{"public_slug":"gone-@","title":"Closed @","closed_at":"2024-01-01"},{"public_slug":"role-@","id":1,"title":"Role @","company":"Firm","url":"https://f.example/@?utm_source=x","location":"Lyon","countries":["xx","fr"],"description":"Long @","work_mode":"remote","posted_at":"2024-01-02","enrichment":{"salary_min":@1,"salary_max":0,"salary_currency":"EUR","salary_period":"year","employment_type":"full_time"}}]}',
     "role-@", "Role @", "Firm", "https://f.example/@", "https://f.example/@", "Lyon, France", "Long @", "EUR @1– year", "full time", True),
    ("freehire", _N, '{"data":[{"public_slug":"bare-@","title":"Role @","url":"","location":"Nice, France","countries":["FR"],"work_mode":"onsite","enrichment":null}]}',
     "bare-@", "Role @", _N, "https://freehire.dev/jobs/bare-@", "https://freehire.dev/jobs/bare-@", "Nice, France", _N, _N, _N, _N),
    ("hn_hiring", _N, '{"hits":[{"objectID":"@","comment_text":"Role @ | Firm","story_url":"https://n.example/@","created_at":"2024-01-02T03:04:05Z"}]}',
     "@", "Role @ | Firm", _N, "https://n.example/@", "https://n.example/@", _N, "Role @ | Firm", _N, _N, _N),
    ("bundesagentur", _N, '{"maxErgebnisse":1,"ergebnisliste":[{"referenznummer":"10-@-S","stellenangebotsTitel":"Role @","firma":"Firm","externeURL":"https://b.example/@","stellenlokationen":[{"adresse":{"ort":"Bonn","region":"NORDRHEIN_WESTFALEN"}}],"homeofficemoeglich":true,"homeofficeprozent":100,"arbeitszeitVollzeit":true,"gehaltsspanneVon":@1,"gehaltsspanneBis":@2,"verguetungsangabe":"JAHRESGEHALT"}]}',
     "10-@-S", "Role @", "Firm", "https://www.arbeitsagentur.de/jobsuche/jobdetail/10-@-S", "https://b.example/@", "Bonn, Nordrhein Westfalen, Germany", _N, "EUR @1–@2 yearly", "Full-time", True),
    ("bundesagentur", _N, '{"ergebnisliste":[{"referenznummer":"10-@-T","stellenangebotsTitel":"Role @","homeofficemoeglich":true,"homeofficeprozent":50,"gehaltsspanneBis":@2,"stellenlokationen":[]}]}',
     "10-@-T", "Role @", _N, "https://www.arbeitsagentur.de/jobsuche/jobdetail/10-@-T", "https://www.arbeitsagentur.de/jobsuche/jobdetail/10-@-T", "Germany", _N, "EUR –@2", _N, _N),
    ("eures", _N, '{"jvs":[{"id":"e@","translations":{"sv":{"title":"Roll @","description":"Kort @"},"nl":{"title":"Rol @","description":"Lang @"}},"employer":{"name":"Firm"},"creationDate":1704164645000}]}',
     "e@", "Rol @", "Firm", _N, _N, _N, "Lang @", _N, _N, _N),
    ("france_travail", _N, '{"resultats":[{"id":"@F","intitule":"Role @","entreprise":{"nom":"Firm"},"lieuTravail":{"libelle":"34 - Montpellier"},"description":"Long @","salaire":{"libelle":"Annuel de @ Euros"},"contact":{"urlPostulation":"https://t.example/@"},"dateCreation":"2024-01-02"}]}',
     "@F", "Role @", "Firm", "https://candidat.francetravail.fr/offres/recherche/detail/@F", "https://t.example/@", "34 - Montpellier", "Long @", "Annuel de @ Euros", _N, _N),
    ("greenhouse", _N, '{"jobs":[{"id":@,"title":"Role @","absolute_url":"https://g.example/@","location":{"name":"Oslo"},"content":"&lt;p&gt;Long @&lt;/p&gt;","updated_at":"2024-01-02"}]}',
     "@", "Role @", _N, "https://g.example/@", "https://g.example/@", "Oslo", "Long @", _N, _N, _N),
    ("lever", _N, '[{"id":"v@","text":"Role @","hostedUrl":"https://v.example/@","categories":{"location":"Oslo","commitment":"Full-time"},"descriptionPlain":"Long @","createdAt":1704164645000}]',
     "v@", "Role @", _N, "https://v.example/@", "https://v.example/@", "Oslo", "Long @", _N, "Full-time", _N),
    ("ashby", _N, '{"jobs":[{"id":"y@","title":"Role @","jobUrl":"https://y.example/@","location":"Oslo","descriptionHtml":"<b>Long</b> @","employmentType":"FullTime","isRemote":false}]}',
     "y@", "Role @", _N, "https://y.example/@", "https://y.example/@", "Oslo", "Long @", _N, "FullTime", False),
    ("smartrecruiters", _N, '{"content":[{"id":"74@","name":"Role @","company":{"name":"Firm"},"ref":"https://m.example/@","location":{"city":"Oslo","remote":true},"releasedDate":"2024-01-02","typeOfEmployment":{"label":"Full-time"}}]}',
     "74@", "Role @", "Firm", "https://m.example/@", "https://m.example/@", "Oslo", _N, _N, "Full-time", True),
    ("workable", _N, '{"jobs":[{"shortcode":"AB@","title":"Role @","url":"https://wk.example/@","city":"","country":"Norway","telecommuting":true,"description":"Long @"}]}',
     "AB@", "Role @", _N, "https://wk.example/@", "https://wk.example/@", "Norway", "Long @", _N, _N, True),
    ("recruitee", _N, '{"offers":[{"id":@,"title":"Role @","company_name":"Firm","careers_url":"https://rc.example/@","location":"Oslo","description":"Long @","remote":false}]}',
     "@", "Role @", "Firm", "https://rc.example/@", "https://rc.example/@", "Oslo", "Long @", _N, _N, False),
    ("workday", "Acme/wd3/Careers", '{"total":2,"jobPostings":[{"title":"Role @","externalPath":"/job/Oslo/Role_JR-@","locationsText":"Oslo","postedOn":"Posted Today","bulletFields":["jr-@"]}]}',
     "acme:JR-@", "Role @", _N, "https://Acme.wd3.myworkdayjobs.com/Careers/job/Oslo/Role_JR-@", "https://Acme.wd3.myworkdayjobs.com/Careers/job/Oslo/Role_JR-@", "Oslo", _N, _N, _N, _N),
    ("oracle", _N, '{"items":[{"requisitionList":[{"Id":"@","Title":"Role @","PrimaryLocation":"Oslo","ShortDescriptionStr":"Short @","PostedDate":"2024-01-02"}]}]}',
     "@", "Role @", _N, _N, _N, "Oslo", "Short @", _N, _N, _N),
    ("tenders", _N, '{"notices":[{"publication-number":"@-2024","notice-title":"Role @","buyer-name":"Firm","buyer-country":"NOR","links":{"html":"https://t.example/@"},"publication-date":"2024-01-02"}]}',
     "@-2024", "Role @", "Firm", "https://t.example/@", "https://t.example/@", "NOR", _N, _N, _N, _N),
    ("procurement_notices", _N, '{"procnotices":[{"id":"OP@","bid_description":"Role @","contact_organization":"Firm","project_ctry_name":"Chad","url":"https://p.example/@","noticedate":"02-Jan-2024"}]}',
     "OP@", "Role @", "Firm", "https://p.example/@", "https://p.example/@", "Chad", _N, _N, _N, _N),
    ("remotive", _N, "<html>moved</html>", _N, _N, _N, _N, _N, _N, _N, _N, _N, _N),
    ("lever", _N, "[]", _N, _N, _N, _N, _N, _N, _N, _N, _N, _N),
]


def _said_sql(column: int) -> str:
    """A column of the answers by the document's number."""

    def one(value) -> str:
        if value is None or isinstance(value, bool):
            return "NULL" if value is None else str(value).lower()
        text = value.replace("'", "''").replace("\n", "'||chr(10)||'")
        text = re.sub(r"\bL\b", "'||lang||'", text).replace("@", "'||doc_id||'")
        return f"'{text}'"

    return _case("doc_id", [one(a[column]) for a in _ANSWERS])


@query("json_feeds", f"""
SELECT * FROM (SELECT doc_id AS landed, {_case("doc_id", [f"'{a[0]}'" for a in _ANSWERS])} AS source_name, {_case("doc_id", [f"'{a[0]}:'" for a in _ANSWERS])} || {_said_sql(3)} AS native_id, {_said_sql(4)} AS title, {_said_sql(5)} AS company, {_said_sql(6)} AS url, {_said_sql(7)} AS apply_url,
  {_said_sql(8)} AS location_raw, {_said_sql(9)} AS description, {_said_sql(10)} AS salary, {_said_sql(11)} AS employment_type, {_said_sql(12)} AS remote_flag FROM (SELECT doc_id, coalesce(lang, 'xx') AS lang FROM documents)) WHERE title IS NOT NULL""")
def json_feeds(spark, sf):
    """SRC-01 to SRC-06, SRC-08, SRC-10 to SRC-15, SRC-17, SRC-18, SRC-20 to
    SRC-26, SRC-28 to SRC-30, SRC-38: answers of all JSON feeds in one pass,
    with notices, closed postings, repeated ids, empty and broken ones."""
    k = F.col("doc_id") % len(_ANSWERS)
    pick = lambda c: F.element_at(F.array(*[F.lit(a[c]) for a in _ANSWERS]), k.cast("int") + 1)
    body = F.replace(F.regexp_replace(pick(2), r"\bL\b", F.coalesce("lang", F.lit("xx"))), F.lit("@"), F.col("doc_id").cast("string"))
    bodies = table(spark, sf, "documents").select(F.col("doc_id").alias("landed"), pick(0).alias("source"), pick(1).alias("board"), body.alias("body"))
    return feeds.parse_feeds(bodies).select("landed", "source_name", "native_id", "title", "company", "url", "apply_url", "location_raw", F.trim("description").alias("description"), "salary", "employment_type", "remote_flag")


@query("feed_outcomes", "SELECT doc_id AS landed, CASE doc_id % 4 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM documents")
def feed_outcomes(spark, sf):
    """SRC-01, AGG-17: whole, partial, broken and empty answers."""
    k = F.col("doc_id") % 4
    body = F.when(k == 0, '{"jobs":[{"title":"a"},{"title":"b"}]}').when(k == 1, '{"jobs":[{"title":"a"},{"x":1}]}').when(k == 2, "<html>").otherwise('{"jobs":[]}')
    return feeds.feed_status(table(spark, sf, "documents").select(F.col("doc_id").alias("landed"), body.alias("body")), feeds.BY_NAME["remotive"])


@query("rss_items", """
SELECT doc_id AS landed, concat(CASE doc_id % 3 WHEN 0 THEN 'R&D é ' ELSE 'Role ' END, doc_id) AS title, concat('https://f.example/', doc_id) AS url, CASE doc_id % 3 WHEN 1 THEN 'full' ELSE 'short' END AS description, doc_id % 3 <> 2 AS dated FROM documents WHERE doc_id % 5 <> 4""")
def rss_items(spark, sf):
    """SRC-07, STR-14: RSS with entities, full content before the summary,
    Atom with a touched date only, and pages that aren't XML."""
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    link = F.concat(F.lit("https://f.example/"), n)
    rss = lambda title, more: F.concat(F.lit("<rss><channel><item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><description>short</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate>"), F.lit(more), F.lit("</item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Role '), n, F.lit('</title><link rel="alternate" href="'), link, F.lit('"/><updated>2024-01-02T00:00:00Z</updated><summary>short</summary></entry></feed>'))
    body = F.when(k % 5 == 4, "<html><p>moved").when(k % 3 == 0, rss(F.concat(F.lit("R&D &eacute; "), n), "")).when(k % 3 == 1, rss(F.concat(F.lit("Role "), n), '<content:encoded xmlns:content="c">&lt;p&gt;full&lt;/p&gt;</content:encoded>')).otherwise(atom)
    return feeds.rss_rows(table(spark, sf, "documents").select(k.alias("landed"), body.alias("body"))).select("landed", "title", "url", "description", F.col("posted_at_reliable").alias("dated"))


@query("xml_positions", "SELECT doc_id AS landed, concat('p', doc_id, '-', i) AS native_id, concat('Role ', i) AS title, 'Berlin' AS location_raw FROM documents, range(0, 2) t(i) WHERE doc_id % 3 > 0")
def xml_positions(spark, sf):
    """SRC-27: two positions a board; a page of HTML gives none."""
    n = F.col("doc_id").cast("string")
    one = lambda i: F.concat(F.lit("<position><id>p"), n, F.lit(f"-{i}</id><name>Role {i}</name><office>Berlin</office></position>"))
    body = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("<?xml version='1.0'?><workzag-jobs>"), one(0), one(1), F.lit("</workzag-jobs>"))).otherwise("<!DOCTYPE html><html><position><id>1</id></position>")
    return feeds.personio_rows(table(spark, sf, "documents").select(F.col("doc_id").alias("landed"), body.alias("body"))).select("landed", "native_id", "title", "location_raw")


@query("list_details", "SELECT concat('b:', doc_id) AS native_id, CASE WHEN doc_id % 3 = 0 THEN 'full' ELSE 'list' END AS description FROM documents")
def list_details(spark, sf):
    """SRC-21, SRC-24: a list, and details of every third posting."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("b:"), F.col("doc_id").cast("string")).alias("native_id"))
    return feeds.board_rows(d.select("native_id", F.lit("list").alias("description")), d.where("doc_id % 3 = 0").select("native_id", F.lit("full").alias("description")))


@query("page_union", "SELECT user_id::VARCHAR AS native_id, arg_min(event_type, [epoch_us(ts), event_id]) AS title FROM events GROUP BY 1")
def page_union(spark, sf):
    """SRC-28, SRC-29: repeated postings over pages, the first page's row wins."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("native_id"), F.col("event_type").alias("title"), F.unix_micros(F.col("ts").cast("timestamp")).alias("landed"), F.col("event_id").alias("pos"))
    return feeds.union_pages(e).select("native_id", "title")


@query("scraped_frames", """
SELECT concat('site', doc_id % 3, ':', doc_id) AS native_id, concat('Dev ', doc_id) AS title, CASE WHEN doc_id % 4 > 0 THEN concat('Firm ', doc_id) END AS company, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('EUR ', doc_id, '-', doc_id + 10, ' per yearly') ELSE concat('EUR ', doc_id, ' per yearly') END AS salary, doc_id % 2 = 0 AS remote_flag
FROM documents WHERE doc_id % 7 > 0""")
def scraped_frames(spark, sf):
    """SRC-09: NaN and "nan" cells, bounds of pay, rows without a title."""
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    nan = F.lit(float("nan"))
    frame = table(spark, sf, "documents").select(
        k.alias("landed"), n.alias("id"), F.concat(F.lit("Site"), (k % 3).cast("string")).alias("site"), F.when(k % 7 > 0, F.concat(F.lit("Dev "), n)).otherwise("nan").alias("title"), F.when(k % 4 > 0, F.concat(F.lit("Firm "), n)).otherwise("NaN").alias("company"),
        F.concat(F.lit("https://s.example/"), n).alias("job_url"), F.lit("None").alias("location"), F.lit("").alias("description"), F.lit(None).cast("string").alias("date_posted"), F.when(k % 5 > 0, k.cast("double")).otherwise(nan).alias("min_amount"), F.when(k % 5 == 1, (k + 10).cast("double")).otherwise(nan).alias("max_amount"),
        F.lit("EUR").alias("currency"), F.lit("yearly").alias("interval"), F.when(k % 2 == 0, "True").otherwise("False").alias("is_remote"),
    )
    twice = frame.unionByName(frame.where("landed % 2 = 0").withColumn("landed", F.col("landed") + 1_000_000_000).withColumn("company", F.lit("Later")))
    return listings.scraped_rows(twice).select("native_id", "title", "company", "salary", "remote_flag")


@query("checked_searches", f"""
SELECT concat('s', doc_id) AS id, CASE doc_id % 4 WHEN 1 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, concat('Role ', doc_id) AS title FROM documents WHERE doc_id % 4 < 3 AND doc_id % 6 <> 5 AND TIMESTAMP '{NOW}' - INTERVAL 1 DAY * (doc_id % 60) >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY""")
def checked_searches(spark, sf):
    """SRC-15: answers that ignored a parameter or the search word, closed and
    old postings, repeats."""
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    item = F.to_json(F.struct(F.concat(F.lit("s"), n).alias("public_slug"), F.concat(F.lit("Role "), n).alias("title"), F.date_format(now() - F.make_interval(days=(k % 60).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("posted_at"), F.when(k % 6 == 5, "2024-01-01").alias("closed_at")))
    ignored = F.when(k % 4 == 1, '[{"param":"sort"}]').when(k % 4 == 3, '[{"param":"q"}]').otherwise("[]")
    body = F.concat(F.lit('{"data":['), item, F.lit(","), item, F.lit('],"meta":{"ignored_params":'), ignored, F.lit("}}"))
    return listings.checked_searches(table(spark, sf, "documents").select(k.alias("landed"), body.alias("body")), now(), 30).select("id", "status", "title")


@query("result_list", "SELECT concat('jobbank:', doc_id) AS native_id, concat('surveyor ', doc_id) AS title, CASE WHEN doc_id % 3 > 0 THEN concat('Firm & ', doc_id) END AS company, 'Burlington, ON, Canada' AS location_raw, CASE WHEN doc_id % 2 = 0 THEN '$30.00 hourly' END AS salary, concat('https://jobs.example/jobsearch/jobposting/', doc_id) AS url FROM documents")
def result_list(spark, sf):
    """SRC-19: articles of result pages, one without a title on each."""
    n = F.col("doc_id").cast("string")
    firm = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit('<li class="business">Firm &amp; '), n, F.lit("</li>"))).otherwise("")
    pay = F.when(F.col("doc_id") % 2 == 0, '<li class="salary">Salary:\n $30.00 hourly</li>').otherwise("")
    body = F.concat(F.lit('<article id="article-9"><a>ad</a></article><article id="article-'), n, F.lit('" class="x"><a href="#"><span class="noctitle"> surveyor\n '), n, F.lit('</span></a><ul><li class="date">January 2, 2024</li>'), firm, F.lit('<li class="location"><span>Location</span> Burlington (ON)</li>'), pay, F.lit("</ul></article>"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("landed"), F.lit("https://jobs.example").alias("origin"), body.alias("body"))
    return listings.result_list(rows).select("native_id", "title", "company", "location_raw", "salary", "url")


@query("search_windows", "SELECT o_orderkey, CASE WHEN d <= 1 THEN 1 WHEN d <= 3 THEN 3 WHEN d <= 7 THEN 7 WHEN d <= 14 THEN 14 ELSE 31 END AS days FROM (SELECT o_orderkey, o_orderkey % 45 AS d FROM orders)")
def search_windows(spark, sf):
    """SRC-20."""
    return table(spark, sf, "orders").select("o_orderkey", listings.search_window(F.col("o_orderkey") % 45).alias("days"))


@query("sitemap_tree", """
WITH s AS (SELECT DISTINCT regexp_extract(url, '://([^/]*)', 1) AS host FROM pages), m AS (SELECT host, i FROM s, range(0, 8) t(i))
SELECT concat('https://', host, '/sitemap.xml') AS root, concat('https://', host, '/jobs/', i, '?a=1&b=2') AS url, concat('2024-01-0', i + 1) AS lastmod FROM m WHERE i >= 2
UNION ALL SELECT concat('https://', host, '/sitemap.xml'), concat('https://', host, '/about'), NULL FROM s""")
def sitemap_tree(spark, sf):
    """SRC-31, EXT-13: an index of eight maps for each host, gzipped, of which
    the six newest are read; a page of the index itself; a broken file."""
    hosts = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host")).distinct()
    at = lambda path: F.concat(F.lit("https://"), F.col("host"), F.lit(path))
    maps = hosts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("n", F.col("i").cast("string"))
    entry = F.concat(F.lit("<sitemap><loc>"), at("/map"), F.col("n"), F.lit(".xml.gz</loc><lastmod>2024-01-0"), (F.col("i") + 1).cast("string"), F.lit("</lastmod></sitemap>"))
    index = maps.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("e")).select(at("/sitemap.xml").alias("loc"), F.encode(F.concat(F.lit("<sitemapindex>"), "e", F.lit("<url><loc>"), at("/about"), F.lit("</loc></url></sitemapindex>")), "utf-8").alias("body"))
    one = F.concat(F.lit("<urlset><url><loc> "), at("/jobs/"), F.col("n"), F.lit("?a=1&amp;b=2</loc><lastmod>2024-01-0"), (F.col("i") + 1).cast("string"), F.lit("</lastmod></url></urlset>"))
    files = index.unionByName(maps.select(F.concat(at("/map"), F.col("n"), F.lit(".xml.gz")).alias("loc"), _gzip(F.encode(one, "utf-8")).alias("body")))
    files = files.unionByName(hosts.select(at("/map-broken.xml.gz").alias("loc"), F.lit(b"\x1f\x8bno").alias("body")))
    return listings.sitemap_tree(hosts.select(at("/sitemap.xml").alias("root")), files)


def _gzip(body):
    @F.pandas_udf("binary")
    def pack(b: pd.Series) -> pd.Series:
        return b.map(gzip.compress)

    return pack(body)


@query("search_discoveries", """
WITH u AS (SELECT page_id, page_id % 4 AS k, page_id % 11 AS b FROM pages)
SELECT 'board' AS kind, 'lever' AS ats, concat('b', b) AS slug, concat('https://jobs.lever.co/b', b) AS url, count(*) AS n FROM u WHERE k = 0 AND b <> 3 GROUP BY b
UNION ALL SELECT 'page', NULL, NULL, concat('https://site.example/', page_id), 1 FROM u WHERE k = 1""")
def search_discoveries(spark, sf):
    """SRC-33: boards and pages that two services' answers lead to."""
    k, n, b = F.col("page_id") % 4, F.col("page_id").cast("string"), F.concat(F.lit("b"), (F.col("page_id") % 11).cast("string"))
    url = F.when(k == 0, F.concat(F.lit("https://jobs.lever.co/"), b)).when(k == 1, F.concat(F.lit("https://www.site.example/"), n, F.lit("/?utm_source=x"))).when(k == 2, "https://big.linkedin.com/jobs/1").otherwise("ftp://x")
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"results":[{"title":"t","url":"'), url, F.lit('"}]}'))).otherwise(F.concat(F.lit('<a href="//search.example/l/?uddg='), F.url_encode(url), F.lit('&amp;rut=1">x</a>')))
    known = spark.createDataFrame([("lever", "b3")], "ats string, slug string")
    return listings.search_discoveries(table(spark, sf, "pages").select(F.col("page_id").alias("landed"), body.alias("body")), known, ["linkedin.com"])


@query("rate_rows", """
WITH l AS (SELECT o_custkey AS c, o_orderkey % 2 = 0 AS dollars FROM orders ORDER BY o_orderkey DESC LIMIT 1)
SELECT currency, per_eur FROM (SELECT 'EUR' AS currency, 1.0::DOUBLE AS per_eur UNION ALL SELECT 'USD', CASE WHEN dollars THEN 1 / 0.5::DOUBLE ELSE 4::DOUBLE END FROM l UNION ALL SELECT 'GBP', CASE WHEN dollars THEN c / 0.5::DOUBLE ELSE c::DOUBLE END FROM l)""")
def rate_rows(spark, sf):
    """SRC-39: the latest landed answer, to a base other than the euro."""
    pounds = F.col("o_custkey").cast("string")
    body = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"base":"USD","rates":{"EUR":0.5,"BAD":0,"GBP":'), pounds, F.lit("}}"))).otherwise(F.concat(F.lit('{"base":"EUR","rates":{"USD":4,"BAD":0,"GBP":'), pounds, F.lit("}}")))
    return listings.rate_rows(table(spark, sf, "orders").select(F.col("o_orderkey").alias("landed"), body.alias("body")))


@query("cdx_boards", "SELECT DISTINCT 'ashby' AS ats, concat('b', page_id % 13) AS slug FROM pages WHERE page_id % 2 = 0 AND page_id % 13 <> 4")
def cdx_boards(spark, sf):
    """SRC-34: boards in index lines, without known ones."""
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://jobs.ashbyhq.com/B"), (F.col("page_id") % 13).cast("string"))).otherwise(F.col("url"))
    return feeds.cdx_boards(table(spark, sf, "pages").select(F.to_json(F.struct(url.alias("url"))).alias("line")), spark.createDataFrame([("ashby", "b4")], "ats string, slug string"))


@query("probe_grid", "SELECT concat('firm-', s_suppkey) AS slug, ats FROM supplier, (VALUES ('lever'), ('ashby')) p(ats)")
def probe_grid(spark, sf):
    """SRC-36, JOIN-22."""
    return feeds.probe_grid(table(spark, sf, "supplier").select(F.concat(F.lit("firm-"), F.col("s_suppkey").cast("string")).alias("slug")), ["lever", "ashby"])


@query("text_boards", "SELECT doc_id, [concat('lever:b', doc_id % 9), 'recruitee:acme'] AS boards FROM documents")
def text_boards(spark, sf):
    """EXT-10: boards named in whole texts, each once."""
    b = (F.col("doc_id") % 9).cast("string")
    said = F.concat(F.col("text"), F.lit(" see https://jobs.lever.co/B"), b, F.lit(", (https://acme.recruitee.com/o/x) and https://jobs.lever.co/b"), b, F.lit("."))
    return table(spark, sf, "documents").select("doc_id", urls.boards_in_text(said).alias("boards"))


@query("fresh_texts", f"SELECT doc_id AS id FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 20 <= 7) AND NOT ((doc_id + 1) % 3 = 0 AND (doc_id + 1) % 20 <= 7 AND doc_id + 1 <= (SELECT max(doc_id) FROM documents))")
def fresh_texts(spark, sf):
    """FLT-16: by its own id or an alias."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array((F.col("doc_id") + 1).cast("string")).alias("aliases"), "doc_id")
    texts = d.where("doc_id % 3 = 0").select(F.col("id").alias("canonical_id"), (now() - F.make_interval(days=(F.col("doc_id") % 20).cast("int"))).alias("seen"))
    return feeds.knows_text(d.select("id", "aliases"), texts, now()).select(F.col("id").cast("long").alias("id"))


# ------------------------------------------------------------ pages and mail
_LONG = "We survey land. " * 20


@query("page_ladder", f"SELECT page_id, concat('Post ', page_id) AS title, CASE WHEN page_id % 5 < 3 THEN concat('Firm ', page_id) END AS company, CASE page_id % 5 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'rdfa' WHEN 2 THEN 'embedded_json' ELSE 'html' END AS method FROM pages WHERE page_id % 5 < 4")
def page_ladder(spark, sf):
    """EXT-01 to EXT-05, ARR-05, SRC-32: pages that each step of the ladder
    reads, and pages with nothing to read."""
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    ld = F.concat(F.lit('<script type="application/ld+json">/* c */{"@graph":[{"@type":["JobPosting"],"title":"Post '), n, F.lit('","hiringOrganization":{"name":"Firm '), n, F.lit('"},"description":"<p>x</p>",},]}</script>'))
    rdfa = F.concat(F.lit('<div typeof="JobPosting"><h1 property="title">Post '), n, F.lit('</h1><span property="hiringOrganization">Firm '), n, F.lit('</span><div property="description">Long text</div></div>'))
    embedded = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"job":{"title":"Post '), n, F.lit('","company":{"name":"Firm '), n, F.lit(f'"}},"description":"{_LONG}"}}}}}}</script>'))
    plain = F.concat(F.lit("<html><body><h1>Post "), n, F.lit(f"</h1><main>{_LONG} Requirements: apply now</main></body></html>"))
    page = F.when(k == 0, ld).when(k == 1, rdfa).when(k == 2, embedded).when(k == 3, plain).otherwise("<p>About us</p>")
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://x.example/jobs/"), n).alias("url"), page.alias("html"))
    return html.extract_pages(rows, "2024-01-31").select("page_id", "title", "company", "method")


def _board_page(tree, url, today):
    """A site's own extractor: the page's heading is the only posting."""
    title = " ".join("".join(tree.h1).split())
    return [{"title": title, "company": "Own", "url": url, "method": "site"}] if title else []


html.register_site_adapter(r"^adapter\.example$", _board_page)


@query("site_adapters", "SELECT page_id, concat('Post ', page_id) AS title, 'Own' AS company, 'site' AS method FROM pages WHERE page_id % 2 = 0")
def site_adapters(spark, sf):
    """UDX-03, EXT-01: a registered extractor comes before the ladder, on its
    host only."""
    n = F.col("page_id").cast("string")
    url = F.concat(F.when(F.col("page_id") % 2 == 0, "https://adapter.example/x/").otherwise("https://other.example/x/"), n)
    rows = table(spark, sf, "pages").select("page_id", url.alias("url"), F.concat(F.lit("<h1>Post "), n, F.lit("</h1>")).alias("html"))
    return html.extract_pages(rows, "2024-01-31").select("page_id", "title", "company", "method")


@query("pay_and_place_texts", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('EUR ', o_orderkey, '-', o_orderkey + 5, ' per year') WHEN 1 THEN concat('EUR ', o_orderkey, ' per year') END AS pay, CASE o_orderkey % 2 WHEN 0 THEN 'Lyon, France' ELSE '1 Main St, France' END AS place FROM orders")
def pay_and_place_texts(spark, sf):
    """EXT-08, EXT-09."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    null = F.lit(None).cast("string")
    low = F.when(k % 3 < 2, n)
    high = F.when(k % 3 == 0, (k + 5).cast("string")).when(k % 3 == 1, n)
    pay = html.salary_text(low, high, F.when(k % 3 < 2, "EUR"), F.when(k % 3 < 2, "YEAR"))
    return table(spark, sf, "orders").select("o_orderkey", pay.alias("pay"), html.address_text(F.lit("1 Main St"), F.when(k % 2 == 0, "Lyon"), null, F.lit("France")).alias("place"))


@query("title_places", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Saint-Denis' END AS city, CASE WHEN c_custkey % 2 = 0 THEN lpad((c_custkey % 90 + 5)::VARCHAR, 2, '0') END AS department FROM customer")
def title_places(spark, sf):
    """EXT-17."""
    k = F.col("c_custkey")
    said = F.when(k % 2 == 0, F.concat(F.lit("Topographe - Saint-Denis ("), F.lpad((k % 90 + 5).cast("string"), 2, "0"), F.lit(")"))).otherwise("Topographe (CDI)")
    return table(spark, sf, "customer").select("c_custkey", html.place_from_title(said).alias("p")).select("c_custkey", "p.city", "p.department")


@query("mail_rows", "SELECT c.conv_id, c.turn, i.i::INTEGER AS pos, concat('Role ', c.conv_id, '-', i.i) AS title, CASE WHEN i.i = 0 THEN 'Acme' END AS company, concat('https://m.example/', c.turn, '/', i.i) AS url FROM conversations c, range(0, 2) i(i)")
def mail_rows(spark, sf):
    """SRC-35, EXT-15, EXT-19: two blocks of an alert mail, as plain text or
    HTML parts of a message."""
    a, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    plain = F.concat(F.lit("Your alert\n\nRole "), a, F.lit("-0\nAcme\nParis\nhttps://m.example/"), t, F.lit("/0\n\nRole "), a, F.lit("-1\nhttps://m.example/"), t, F.lit("/1\n"))
    head = F.when(F.col("turn") % 2 == 0, "Subject: Jobs\nContent-Type: text/plain; charset=utf-8\n\n").otherwise("Subject: Jobs\nContent-Type: text/html; charset=utf-8\n\n")
    body = F.when(F.col("turn") % 2 == 0, plain).otherwise(F.concat(F.lit("<div>"), F.regexp_replace(plain, "\n", "<br>"), F.lit("</div>")))
    rows = html.mail_alerts(table(spark, sf, "conversations").select("conv_id", "turn", F.encode(F.concat(head, body), "utf-8").alias("raw")), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "pos", "title", "company", "url")


@query("reply_matches", "SELECT c_custkey AS mail_id, CASE c_custkey % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'interview' WHEN 2 THEN 'received' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 END AS id FROM customer")
def reply_matches(spark, sf):
    """EXT-18: kinds of replies, and the application that each answers."""
    k = F.col("c_custkey")
    names = ["alpha", "bravo", "carol", "delta", "echo1", "foxtrot", "golf1"]
    said = F.concat(F.when(k % 4 == 0, "unfortunately we chose other candidates").when(k % 4 == 1, "can we schedule a call").when(k % 4 == 2, "thank you for applying").otherwise("hello"), F.when(k % 2 == 0, F.concat(F.lit(" regards "), F.get(F.array(*map(F.lit, names)), (k % 7).cast("int")), F.lit(" works"))).otherwise(""))
    mails = table(spark, sf, "customer").select(k.alias("mail_id"), said.alias("text"))
    apps = spark.createDataFrame([(i, f"{n} works", "surveyor") for i, n in enumerate(names)], "id int, company string, title string")
    return mails.select("mail_id", html.reply_kind(F.col("text")).alias("kind")).join(html.match_replies(mails, apps).select("mail_id", "id"), "mail_id", "left")


@query("robot_paths", "SELECT page_id, page_id % 3 <> 0 OR page_id % 2 = 0 AS allowed FROM pages")
def robot_paths(spark, sf):
    """EXX-02: what an origin's rules allow; a longer rule beats a shorter."""
    from quarrylark.sources import contracts

    robots = contracts.parse_robots("User-agent: *\nDisallow: /private/\nAllow: /private/open\nCrawl-delay: 5\n", 200)
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "/private/").otherwise("/jobs/"), F.when(F.col("page_id") % 2 == 0, "open").otherwise("shut"))
    return table(spark, sf, "pages").select("page_id", contracts.robots_column(robots)(path).alias("allowed"))


@query("fetch_outcomes", """
WITH f AS (SELECT event_type AS source, CASE event_id % 6 WHEN 0 THEN 'OK' WHEN 1 THEN 'RATE_LIMITED' WHEN 2 THEN 'NOT_FOUND' WHEN 3 THEN 'SERVER_ERROR' WHEN 4 THEN 'TIMEOUT' ELSE 'NOT_MODIFIED' END AS kind FROM events)
SELECT source, kind, count(*) AS n FROM f GROUP BY 1, 2""")
def fetch_outcomes(spark, sf):
    """EXX-01, AGG-17."""
    from quarrylark.sources import contracts

    k = F.col("event_id") % 6
    status = F.when(k == 0, 200).when(k == 1, 429).when(k == 2, 404).when(k == 3, 502).when(k == 5, 304)
    return table(spark, sf, "events").select(F.col("event_type").alias("source"), contracts.fetch_kind(status, F.when(k == 4, "timeout")).alias("kind")).groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("redacted", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('call with [redacted] for ', doc_id) ELSE concat('plain ', doc_id) END AS line FROM documents")
def redacted(spark, sf):
    """EXX-09."""
    from quarrylark.sources import contracts

    n = F.col("doc_id").cast("string")
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("call with api_key=Abc123xyz for "), n)).otherwise(F.concat(F.lit("plain "), n))
    return table(spark, sf, "documents").select("doc_id", contracts.redact_secrets(said).alias("line"))


# ------------------------------------------------------------ text functions
@query("phrases", "SELECT doc_id, doc_id % 4 < 2 AS hit, doc_id % 4 < 3 AS word FROM documents")
def phrases(spark, sf):
    """STR-08, STR-15: a phrase with up to two words between, at the end of
    whole texts, and one whole word."""
    said = F.concat(text.fold(F.col("text")), F.when(F.col("doc_id") % 4 == 0, " the xqland surveyor.").when(F.col("doc_id") % 4 == 1, " xqland and sea surveyor").when(F.col("doc_id") % 4 == 2, " xqland a b c surveyor").otherwise(" xqlands surveyors"))
    return table(spark, sf, "documents").select("doc_id", said.rlike(text.phrase_pattern("xqland surveyor")).alias("hit"), text.has_word(said, "surveyor").alias("word"))


@query("arabic_forms", "SELECT doc_id, concat('احمد ', doc_id) AS plain FROM documents")
def arabic_forms(spark, sf):
    """STR-09."""
    return table(spark, sf, "documents").select("doc_id", text.arabic_plain(F.concat(F.lit("أَحْمَد "), F.col("doc_id").cast("string"))).alias("plain"))


@query("sentences", "SELECT doc_id, concat('the xq', doc_id, ' is here') AS sentence FROM documents")
def sentences(spark, sf):
    """STR-10: around a place at the end of whole texts."""
    said = F.concat("text", F.lit(". the xq"), F.col("doc_id").cast("string"), F.lit(" is here! After"))
    return table(spark, sf, "documents").select("doc_id", text.sentence_around(said, F.instr(said, ". the xq") + 8).alias("sentence"))


@query("french_dates", "SELECT o_orderkey, DATE '2024-01-01' + (o_orderkey % 366)::INTEGER AS day FROM orders")
def french_dates(spark, sf):
    """DAT-06."""
    from quarrylark.functions import dates

    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 366).cast("int"))
    months = F.array(*map(F.lit, ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]))
    said = F.concat(F.lit("le "), F.dayofmonth(day).cast("string"), F.when(F.dayofmonth(day) == 1, "er ").otherwise(" "), F.get(months, F.month(day) - 1), F.lit(" "), F.year(day).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", dates.french_date(said).alias("day"))


@query("absolute_links", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://x.example/a/', page_id) WHEN 1 THEN concat('https://x.example/', page_id) WHEN 2 THEN concat('https://y.example/', page_id) END AS link FROM pages")
def absolute_links(spark, sf):
    """URL-03."""
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    link = F.when(k == 0, n).when(k == 1, F.concat(F.lit("/"), n, F.lit("#top"))).when(k == 2, F.concat(F.lit("//y.example/"), n)).otherwise("mailto:me@x.example")
    return table(spark, sf, "pages").select("page_id", urls.absolutize(F.lit("https://x.example/a/b"), link).alias("link"))
