"""The engine's queries by name, each with its DuckDB equivalent where SQL has
one. Queries read their whole tables; limits are top-k features only."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quarrylark.functions import dates, money, places, text, urls
from quarrylark.operators import adjust, identity, insights, scoring, select, state
from quarrylark.operators.graph import components
from quarrylark.plans import commands, durable, landed, rows  # noqa: F401  their queries are registered as they are imported
from quarrylark.plans.bindings import NOW, SQL_TITLE, TAXONOMY, now, scored, sql_fold, sql_scored, table, title
from quarrylark.plans.registry import ORACLE_SQL, QUERIES, query
from quarrylark.sources import html
from quarrylark.streaming import pipelines


def _golden(column: str, cases: list[tuple], value) -> str:
    """A CASE over the cases' numbers."""
    return f"CASE {column} % {len(cases)} " + " ".join(f"WHEN {k} THEN {value(c)}" for k, c in enumerate(cases)) + " END"


def _said(column, cases: list[tuple], field: int = 0):
    out = None
    for k, c in enumerate(cases):
        here = column % len(cases) == k
        out = F.when(here, F.lit(c[field])) if out is None else out.when(here, F.lit(c[field]))
    return out


# ---------------------------------------------------------------- scoring
_SCORED = f"WITH {sql_scored()}"
_TIER = "CASE tier WHEN 'high' THEN 0 WHEN 'possible' THEN 1 ELSE 2 END"


@query("matches_top", f"{_SCORED} SELECT doc_id, title, score, tier FROM scored WHERE tier <> 'rejected' AND NOT regexp_matches(title, '(^|[^a-z0-9])(thing|moron)($|[^a-z0-9])') ORDER BY {_TIER}, score DESC, doc_id LIMIT 20")
def matches_top(spark, sf):
    """VIEW-01, SCR-08, FLT-05, TOP-02: the best accepted, unmuted matches."""
    rows = scored(spark, sf).where((F.col("tier") != "rejected") & ~select.muted(F.col("title"), F.lit(""), ["thing", "moron"]))
    return rows.orderBy(select.tier_rank(F.col("tier")), F.desc("score"), "doc_id").limit(20).select("doc_id", "title", "score", "tier")


@query("title_kind", f"{_SCORED} SELECT doc_id, kind, negative FROM scored")
def title_kind(spark, sf):
    """SCR-01."""
    d = table(spark, sf, "documents").select("doc_id", text.fold(title()).alias("t"))
    return d.select("doc_id", scoring.title_kind(F.col("t"), TAXONOMY).alias("kind"), scoring.negative_title(F.col("t"), TAXONOMY).alias("negative"))


@query("prefilter", f"{_SCORED} SELECT doc_id FROM scored WHERE NOT negative AND (kind IN ('direct', 'adjacent', 'domain_title', 'domain_term') OR (kind = 'generic' AND source = 'src0'))")
def prefilter(spark, sf):
    """FLT-01."""
    d = table(spark, sf, "documents")
    return d.where(scoring.title_prefilter(text.fold(title()), TAXONOMY, F.col("source") == "src0")).select("doc_id")


def _hits(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.fold(F.col("text")).alias("body"))
    return scoring.with_hits(scoring.settled(d, "body"), "body", TAXONOMY).drop("body")


#: Phrases of common words, with fillers allowed between them, and one that needs another.
_PHRASES = [("of the", 0, None), ("the and", 2, None), ("in the", 1, "of the"), ("de la", 2, None), ("la de los", 2, None), ("der die", 2, None), ("and of the", 3, None), ("es el", 1, None), ("the the the", 2, "the and")]


@query("phrase_terms", "SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN t{k}" + (f" AND t{[p[0] for p in _PHRASES].index(need)}" if need else "") + f" THEN '{said}' END" for k, (said, _, need) in enumerate(_PHRASES)
) + "], lambda x: x IS NOT NULL)), ',') AS terms FROM (SELECT doc_id, " + ", ".join(f"regexp_matches(said, '{text.phrase_pattern(said, fillers)}') AS t{k}" for k, (said, fillers, _) in enumerate(_PHRASES)) + " FROM (SELECT doc_id, coalesce(lower(text), '') AS said FROM documents))")
def phrase_terms(spark, sf):
    """AGG-13, JOIN-19, STR-08: terms of several words with guards, by the
    index, over whole texts; the SQL runs their patterns."""
    tax = replace(TAXONOMY, terms=[scoring.Term("tech", said, 1, text.phrase_pattern(said, fillers), "f", need) for said, fillers, need in _PHRASES])
    d = scoring.with_hits(table(spark, sf, "documents").select("doc_id", F.lower("text").alias("said")), "said", tax)
    return d.select("doc_id", F.array_join(F.array_sort(F.transform("hits", lambda h: h["canonical"])), ",").alias("terms"))


@query("term_hits", f"{_SCORED} SELECT doc_id, terms FROM scored WHERE terms <> ''")
def term_hits(spark, sf):
    """SCR-02, AGG-13, JOIN-19, TOP-05."""
    d = _hits(spark, sf)
    return d.where(F.size("hits") > 0).select("doc_id", F.array_join(F.transform("hits", lambda h: h["canonical"]), ",").alias("terms"))


@query("family_counts", f"{_SCORED} SELECT unnest(string_split(families, ',')) AS family, count(*) AS n FROM scored WHERE families <> '' GROUP BY 1")
def family_counts(spark, sf):
    """AGG-14."""
    d = _hits(spark, sf).select(F.explode(scoring.family_list(F.col("hits"))).alias("family"))
    return insights.tally(d, "family")


@query("skill_coverage", f"{_SCORED} SELECT doc_id, have_weight::INTEGER AS have_weight, lack_weight::INTEGER AS lack_weight, tech_points::INTEGER AS tech_points FROM scored")
def skill_coverage(spark, sf):
    """SCR-06, MAT-04."""
    return scored(spark, sf).select("doc_id", "have_weight", "lack_weight", "tech_points")


@query("score_breakdown", f"{_SCORED} SELECT doc_id, title_points::INTEGER AS title_points, tech_points::INTEGER AS tech_points, domain_points::INTEGER AS domain_points, resp_points::INTEGER AS resp_points, location_points::INTEGER AS location_points, score, tier, title_only, reasons FROM scored")
def score_breakdown(spark, sf):
    """SCR-07 to SCR-09, AGG-13."""
    return scored(spark, sf).select("doc_id", "title_points", "tech_points", "domain_points", "resp_points", "location_points", "score", "tier", "title_only", F.array_join("reasons", ",").alias("reasons"))


@query("tiers", f"{_SCORED} SELECT tier, count(*) AS n FROM scored GROUP BY tier")
def tiers(spark, sf):
    """AGG-05, AGG-20."""
    return insights.tally(scored(spark, sf), "tier")


@query("near_misses", f"{_SCORED} SELECT doc_id, score FROM scored WHERE tier = 'rejected' AND reasons = 'LOW_SCORE' AND (score >= 35 OR tech_points + domain_points + resp_points >= 15)")
def near_misses(spark, sf):
    """FLT-07, SET-06."""
    rows = scored(spark, sf)
    return rows.where(scoring.near_miss(F.col("tier"), F.col("reasons"), F.col("score"), F.col("tech_points") + F.col("domain_points") + F.col("resp_points"))).select("doc_id", "score")


@query("score_range", f"{_SCORED} SELECT doc_id, score, tier FROM scored WHERE score BETWEEN 40 AND 60 AND (tier <> 'rejected' OR reasons = 'LOW_SCORE')")
def score_range(spark, sf):
    """FLT-13, VIEW-02."""
    return select.in_range(scored(spark, sf), 60, 40).select("doc_id", "score", "tier")


@query("read_model", f"""{_SCORED} SELECT id, code, title, tier, score FROM (
  SELECT doc_id AS id, substr(sha1(doc_id::VARCHAR), 1, 5) AS code, title, tier, score FROM scored WHERE tier <> 'rejected' ORDER BY {_TIER}, score DESC, doc_id LIMIT 800)
UNION ALL SELECT * FROM (SELECT doc_id AS id, substr(sha1(doc_id::VARCHAR), 1, 5) AS code, title, tier, score FROM scored WHERE tier = 'rejected' AND score >= 35 AND reasons = 'LOW_SCORE' ORDER BY score DESC, doc_id LIMIT 100)""")
def read_model(spark, sf):
    """TOP-03, PRJ-02, FLT-18, VIEW-13, SNK-06."""
    return select.index_rows(scored(spark, sf).withColumnRenamed("doc_id", "id"))


@query("work_queue", f"{_SCORED} SELECT id, turn::INTEGER AS turn, score FROM (SELECT doc_id AS id, CASE WHEN tier <> 'rejected' THEN 0 WHEN reasons = 'LOW_SCORE' AND score >= 35 THEN 1 ELSE 2 END AS turn, score FROM scored) ORDER BY turn, score DESC, id LIMIT 40")
def work_queue(spark, sf):
    """TOP-04."""
    rows = scored(spark, sf).withColumnRenamed("doc_id", "id").withColumn("near_miss", (F.array_join("reasons", ",") == "LOW_SCORE") & (F.col("score") >= 35))
    return select.work_queue(rows).select("id", "turn", "score")


@query("title_rank", f"{_SCORED} SELECT kind, CASE kind WHEN 'direct' THEN 0 WHEN 'adjacent' THEN 1 WHEN 'domain_title' THEN 2 WHEN 'domain_term' THEN 3 WHEN 'generic' THEN 4 ELSE 5 END::INTEGER AS rank, count(*) AS n FROM scored GROUP BY ALL")
def title_rank(spark, sf):
    """SCR-10."""
    return insights.tally(scored(spark, sf).select("kind", scoring.title_rank(F.col("kind")).alias("rank")), "kind", "rank")


# ------------------------------------------------------------------- text
@query("fold_text", f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def fold_text(spark, sf):
    """STR-01."""
    return table(spark, sf, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("fold_exact", f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def fold_exact(spark, sf):
    """STR-01 by full decomposition."""
    return table(spark, sf, "documents").select("doc_id", text.fold_exact(F.col("text")).alias("folded"))


@query("normalize_title", rf"SELECT doc_id, trim(regexp_replace({sql_fold(SQL_TITLE)}, '[^a-z0-9+/#]+', ' ', 'g')) AS t FROM documents")
def normalize_title(spark, sf):
    """STR-03."""
    return table(spark, sf, "documents").select("doc_id", text.normalize_title(title()).alias("t"))


_FORMS = "|".join(text.LEGAL_FORMS)
_NAME = "concat(replace(s_name, '#', ' '), CASE s_suppkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' Holding Ltd.' ELSE '' END)"


def _sql_company(x: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace({sql_fold(x)}, '[^a-z0-9]+', ' ', 'g')), '( ({_FORMS}))+$', ''))"


def _suppliers(spark, sf):
    tail = F.when(F.col("s_suppkey") % 4 == 0, ", Inc.").when(F.col("s_suppkey") % 4 == 1, " GmbH").when(F.col("s_suppkey") % 4 == 2, " Holding Ltd.").otherwise("")
    return table(spark, sf, "supplier").withColumn("name", F.concat(F.replace(F.col("s_name"), F.lit("#"), F.lit(" ")), tail))


@query("normalize_company", f"SELECT s_suppkey, {_sql_company(_NAME)} AS company FROM supplier")
def normalize_company(spark, sf):
    """STR-02."""
    return _suppliers(spark, sf).select("s_suppkey", text.normalize_company(F.col("name")).alias("company"))


_COMMON = "[" + ", ".join(f"'{w}'" for w in text.COMMON_NAME_WORDS) + "]"
_CORE = "array_to_string(list_filter(string_split(%s, ' '), lambda w: NOT list_contains(" + _COMMON + ", w)), ' ')"


@query("core_name", f"SELECT s_suppkey, core, length(replace(core, ' ', '')) >= 4 AS distinctive FROM (SELECT s_suppkey, {_CORE % _sql_company(_NAME)} AS core FROM supplier)")
def core_name(spark, sf):
    """STR-04."""
    rows = _suppliers(spark, sf).select("s_suppkey", text.core_name(F.col("name")).alias("core"))
    return rows.withColumn("distinctive", text.distinctive(F.col("core")))


@query("slug_candidates", f"SELECT s_suppkey, concat_ws(' ', replace(c, ' ', ''), replace(c, ' ', '-'), CASE WHEN contains(c, ' ') THEN string_split(c, ' ')[1] END) AS slugs FROM (SELECT s_suppkey, {_sql_company(_NAME)} AS c FROM supplier)")
def slug_candidates(spark, sf):
    """STR-05."""
    return _suppliers(spark, sf).select("s_suppkey", F.array_join(text.slug_candidates(F.col("name")), " ").alias("slugs"))


@query("short_codes", "SELECT doc_id, substr(sha1(text), 1, 20) AS content_id, substr(sha1(doc_id::VARCHAR), 1, 5) AS code FROM documents")
def short_codes(spark, sf):
    """STR-06, JOIN-20."""
    return table(spark, sf, "documents").select("doc_id", text.short_hash(F.col("text")).alias("content_id"), text.job_code(F.col("doc_id").cast("string")).alias("code"))


@query("truncate_text", f"SELECT doc_id, CASE WHEN length(t) > 30 THEN concat(rtrim(substr(t, 1, 29)), '…') ELSE t END AS short FROM (SELECT doc_id, {SQL_TITLE} AS t FROM documents)")
def truncate_text(spark, sf):
    """STR-07."""
    return table(spark, sf, "documents").select("doc_id", text.truncate(title(), 30).alias("short"))


def _sql_language() -> str:
    counts = {k: f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in v)}], x)))" for k, v in text.FUNCTION_WORDS.items()}
    best = "greatest(" + ", ".join(counts) + ")"
    return f"SELECT doc_id, CASE WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in counts) + " END AS language FROM (SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in counts.items()) + f" FROM (SELECT doc_id, string_split(regexp_replace({sql_fold('text')}, '[^a-z]+', ' ', 'g'), ' ') AS w FROM documents))"


@query("language_guess", _sql_language())
def language_guess(spark, sf):
    """STR-11, SRC-17."""
    return table(spark, sf, "documents").select("doc_id", text.guess_language(F.col("text")).alias("language"))


@query("search_words", f"SELECT doc_id FROM documents WHERE contains({sql_fold('text')}, 'that') AND contains({sql_fold('text')}, 'thing')")
def search_words(spark, sf):
    """FLT-12, VIEW-03."""
    return select.search(table(spark, sf, "documents"), "That thing", ["text"]).select("doc_id")


@query("muted_anti", f"SELECT doc_id FROM documents WHERE NOT regexp_matches({sql_fold(SQL_TITLE)}, '(^|[^a-z0-9])(the|que)($|[^a-z0-9])') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def muted_anti(spark, sf):
    """FLT-05, FLT-06, JOIN-15."""
    d = table(spark, sf, "documents")
    hidden = table(spark, sf, "labels").where("toxic = 1")
    return select.exclude(d.where(~select.muted(title(), F.lit(""), ["the", "que"])), hidden, key="doc_id").select("doc_id")


@query("content_dups", f"SELECT content_id, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, substr(sha1({sql_fold('text')}), 1, 20) AS content_id FROM documents) GROUP BY 1 HAVING count(*) > 1")
def content_dups(spark, sf):
    """ARR-02 by a hash key."""
    d = table(spark, sf, "documents").select("doc_id", text.short_hash(text.fold(F.col("text"))).alias("content_id"))
    return d.groupBy("content_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("same_posting_groups", f"SELECT posting, count(*) AS n, min(doc_id) AS best FROM (SELECT doc_id, concat(source, '|', trim(regexp_replace({sql_fold(SQL_TITLE)}, '[^a-z0-9+/#]+', ' ', 'g'))) AS posting FROM documents) GROUP BY 1")
def same_posting_groups(spark, sf):
    """AGG-18."""
    return select.same_posting(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("company"), title().alias("title")))


@query("diagnostics_grep", "SELECT doc_id, source FROM (SELECT doc_id, source, n_chars, lang FROM documents) d WHERE contains(lower(concat('{\"doc_id\":', doc_id, ',\"source\":\"', source, '\",\"n_chars\":', n_chars, ',\"lang\":\"', lang, '\"}')), 'src1\"')")
def diagnostics_grep(spark, sf):
    """FLT-14, PRJ-03, VIEW-16."""
    return select.diagnostics(table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang"), 'SRC1"').select("doc_id", "source")


# -------------------------------------------------------------------- URLs
_HOST = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '')"


@query("url_hosts", f"SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM (SELECT page_id, {_HOST} AS host FROM pages)")
def url_hosts(spark, sf):
    """URL-02."""
    return table(spark, sf, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"), urls.registrable_domain(F.col("url")).alias("domain"))


_TRACK = "[" + ", ".join(f"'{p}'" for p in urls.TRACKING) + "]"
_SAID_URL = "concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_page=', page_id, '&pk_x=1&z=a%20b&empty=&Gh_Src=2#top')"


@query("url_canonical", rf"""
WITH u AS (SELECT page_id, {_SAID_URL} AS url FROM pages),
a AS (SELECT page_id, url, {_HOST} AS host, regexp_replace(url, '#.*$', '') AS rest FROM u),
b AS (SELECT page_id, host, regexp_replace(regexp_replace(regexp_extract(rest, '^[A-Za-z]+://[^/?#]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: length(regexp_extract(p, '=(.*)$', 1)) > 0 AND NOT list_contains({_TRACK}, lower(regexp_extract(p, '^([^=]*)', 1))) AND NOT regexp_matches(lower(p), '^(utm_|_ga|hsa_|pk_)'))) AS q FROM a)
SELECT page_id, concat('https://', host, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN len(q) > 0 THEN concat('?', replace(array_to_string(q, '&'), '%20', '+')) ELSE '' END) AS canonical FROM b""")
def url_canonical(spark, sf):
    """URL-01, FLT-11, with parameters that track, are empty or encoded."""
    u = F.col("url")
    said = F.concat(u, F.when(u.contains("?"), "&").otherwise("?"), F.lit("utm_page="), F.col("page_id").cast("string"), F.lit("&pk_x=1&z=a%20b&empty=&Gh_Src=2#top"))
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(said).alias("canonical"))


@query("url_tests", "SELECT page_id, regexp_matches(lower(url), '^https?://') AS http, regexp_matches(lower(url), '/(?:jobs?|careers?|positions?|vacanc(?:y|ies)|openings?|emplois?|offres?|stellen)(?:[/?-]|$)') AS job_like, regexp_matches(lower(url), '://([^/]*[.])?example[.]org([/?#:]|$)') AS aggregator FROM pages")
def url_tests(spark, sf):
    """FLT-11, FLT-20."""
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.is_http_url(u).alias("http"), urls.looks_like_job_url(u).alias("job_like"), urls.is_aggregator(u, ["example.org"]).alias("aggregator"))


#: (URL with {b} for a board and {k} for a number, ats, slug, native id)
_BOARD_FORMS = [
    ("https://boards.greenhouse.io/Board{b}/jobs/{k}", "greenhouse", "board{b}", "greenhouse:{k}"), ("https://boards-api.greenhouse.io/v1/boards/board{b}/jobs/{k}?x=1", "greenhouse", "board{b}", "greenhouse:{k}"), ("https://boards.greenhouse.io/embed/job_app?for=board{b}&token={k}", "greenhouse", "board{b}", "greenhouse:{k}"),
    ("https://www.acme{b}.com/careers?gh_jid={k}", "greenhouse", None, "greenhouse:{k}"), ("https://jobs.lever.co/Board{b}", "lever", "board{b}", None), ("https://api.eu.lever.co/v0/postings/board{b}/01234567-89AB-cdef-0123-{k:012}", "lever", "board{b}", "lever:01234567-89ab-cdef-0123-{k:012}"),
    ("https://jobs.ashbyhq.com/board{b}/01234567-89ab-cdef-0123-{k:012}/application", "ashby", "board{b}", "ashby:01234567-89ab-cdef-0123-{k:012}"), ("https://careers.smartrecruiters.com/Board{b}/{k:012}-engineer", "smartrecruiters", "board{b}", "smartrecruiters:{k:012}"), ("https://apply.workable.com/board{b}/j/a{k:012}", "workable", "board{b}", None),
    ("https://apply.workable.com/board{b}/j/ab{k:06}", "workable", "board{b}", "workable:AB{k:06}"), ("https://board{b}.recruitee.com/o/dev-{k}", "recruitee", "board{b}", "recruitee:board{b}:dev-{k}"), ("https://board{b}.jobs.personio.de/job/{k}", "personio", "board{b}", "personio:board{b}:{k}"),
    ("https://board{b}.wd3.myworkdayjobs.com/en-US/Site/job/Paris/Dev_jr{k}", "workday", "board{b}", "workday:board{b}:JR{k}"), ("https://board{b}.fa.em2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/{k}", "oracle", "board{b}.fa.em2", "oracle:board{b}.em2:{k}"), ("https://example.org/board{b}/jobs/{k}", None, None, None),
]


def _sql_form(form: str | None) -> str:
    if form is None:
        return "NULL"
    parts = form.replace("{b}", "|b|").replace("{k:012}", "|k12|").replace("{k:06}", "|k6|").replace("{k}", "|k|").split("|")
    names = {"b": "page_id % 7", "k": "page_id", "k12": "printf('%012d', page_id)", "k6": "printf('%06d', page_id)"}
    return "concat(" + ", ".join(names[p] if i % 2 else f"'{p}'" for i, p in enumerate(parts)) + ")"


def _cases(column: int) -> str:
    return f"CASE page_id % {len(_BOARD_FORMS)} " + " ".join(f"WHEN {i} THEN {_sql_form(f[column])}" for i, f in enumerate(_BOARD_FORMS)) + " END"


@query("board_detect", f"SELECT page_id, {_cases(1)} AS ats, {_cases(2)} AS slug, {_cases(3)} AS native_id FROM pages")
def board_detect(spark, sf):
    """EXT-11, EXT-12: every platform's forms, with page ids in them."""
    k, b = F.col("page_id"), (F.col("page_id") % 7).cast("string")
    url = None
    for i, (form, *_) in enumerate(_BOARD_FORMS):
        said = F.format_string(form.replace("%", "%%").replace("{b}", "%1$s").replace("{k:012}", "%2$012d").replace("{k:06}", "%2$06d").replace("{k}", "%2$d"), b, k)
        url = F.when(k % len(_BOARD_FORMS) == i, said) if url is None else url.when(k % len(_BOARD_FORMS) == i, said)
    return table(spark, sf, "pages").select("page_id", urls.detect_board(url).alias("b")).select("page_id", "b.ats", "b.slug", "b.native_id")


# ------------------------------------------------------------- extraction
_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(%s, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query("page_title", "SELECT page_id, " + _UNESCAPE % r"trim(regexp_replace(regexp_replace(CASE WHEN length(h) > 0 THEN h ELSE t END, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))" + r" AS title FROM (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)")
def page_title(spark, sf):
    """EXT-05."""
    return table(spark, sf, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query("page_links", r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref=["'']([^"''#]+)', 1) AS l FROM pages),
b AS (SELECT page_id, unnest(l) AS href, unnest(range(len(l))) AS k FROM a)
SELECT page_id, href FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY min(k)) AS r FROM b GROUP BY page_id, href) WHERE r <= 400""")
def page_links(spark, sf):
    """EXT-06."""
    return table(spark, sf, "pages").select("page_id", F.explode(html.page_links(F.col("html"))).alias("href"))


@query("page_text", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', concat(chr(10), chr(10)), 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM (SELECT page_id, " + _UNESCAPE % r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>', ' ', 'g'), '(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer)\b|br)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')" + " AS u FROM pages)")
def page_text(spark, sf):
    """EXT-07."""
    return table(spark, sf, "pages").select("page_id", html.html_text(F.col("html")).alias("body"))


@query("page_postings", f"SELECT page_id, concat('Post ', page_id) AS title, {_HOST} AS company, 'jsonld' AS method FROM pages")
def page_postings(spark, sf):
    """EXT-01 to EXT-05, SRC-32: postings found by the ladder, with each page
    wrapped as one that carries structured data."""
    p = table(spark, sf, "pages")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"JobPosting","title":"Post '), F.col("page_id").cast("string"), F.lit('","hiringOrganization":{"name":"'), urls.host_of(F.col("url")), F.lit('"},"description":"<p>x</p>",}</script>'))
    return html.extract_pages(p.withColumn("html", F.concat(ld, "html")), "2024-01-31").select("page_id", "title", "company", "method")


@query("json_fields", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, coalesce(props::JSON ->> '$.absent', 'none') AS other FROM events")
def json_fields(spark, sf):
    """ARR-04."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("none")).alias("other"))


#: (first line of a comment, company, role, place)
_HEADERS = [
    ("Acme | Data Engineer | Remote, EU", "Acme", "Data Engineer", "Remote, EU"), ("Acme | ONSITE | Senior GIS analyst", "Acme", "Senior GIS analyst", "ONSITE"), ("Acme Corp (YC 20) |Surveyor| Full-time", "Acme Corp (YC 20)", "Surveyor", None), ("Acme | Berlin, DE | | Lead designer | hybrid", "Acme", "Lead designer", "Berlin, DE"),
    ("Hiring for many roles", None, None, None), ("Acme |", None, None, None), (" | Acme | Scientist ", "Acme", "Scientist", None),
]


@query("header_split", "SELECT conv_id, turn, " + ", ".join(_golden("(conv_id + turn)", _HEADERS, (lambda k: lambda c: f"'{c[k]}'" if c[k] else "NULL")(k)) + f" AS {name}" for k, name in ((1, "company"), (2, "posting_role"), (3, "place"))) + " FROM conversations")
def header_split(spark, sf):
    """EXT-16, SRC-16."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", html.split_header(_said(F.col("conv_id") + F.col("turn"), _HEADERS)).alias("h")).select("conv_id", "turn", "h.company", F.col("h.role").alias("posting_role"), F.col("h.location").alias("place"))


# ------------------------------------------------------------ dates, money
#: (date as written, ISO); the last is made from the row
_DATES = [
    ("2024-01-16T12:00:00Z", "2024-01-16T12:00:00Z"), ("2024-01-16T12:00:00.123+02:00", "2024-01-16T10:00:00Z"), ("1705406400", "2024-01-16T12:00:00Z"), ("1705406400000", "2024-01-16T12:00:00Z"), ("16 January 2024", "2024-01-16T00:00:00Z"), ("Tue, 16 Jan 2024 12:00:00 +0000", "2024-01-16T12:00:00Z"),
    ("16.01.2024", "2024-01-16T00:00:00Z"), ("soon", None), ("", None),
]


@query("date_parse", f"SELECT o_orderkey, {_golden('o_orderkey', _DATES, lambda c: f"'{c[1]}'" if c[1] else 'NULL')} AS iso, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso_own, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS iso_text FROM orders")
def date_parse(spark, sf):
    """DAT-01, DAT-02: texts of every form, and each row's own date as ISO text
    and as a written date."""
    at = F.col("o_orderdate").cast("timestamp")
    read = lambda c: dates.to_iso(dates.parse_datetime(c))
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", read(_said(F.col("o_orderkey"), _DATES)).alias("iso"), read(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso_own"), read(F.date_format(at, "d MMMM yyyy")).alias("iso_text"))


@query("ages", f"SELECT event_id, floor(epoch(TIMESTAMP '{NOW}' - ts) / 86400)::INTEGER AS days, ceil(floor(epoch(TIMESTAMP '{NOW}' - ts) / 3600) / 24)::INTEGER AS window_days FROM events")
def ages(spark, sf):
    """DAT-03, DAT-07."""
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.select("event_id", dates.days_ago(F.col("at"), now()).alias("days"), F.ceil(F.floor(dates.age_hours(F.col("at"), now())) / 24).cast("int").alias("window_days"))


@query("deadline_badges", "SELECT o_orderkey, CASE WHEN d < 0 THEN 'closed' WHEN d = 0 THEN 'today' WHEN d <= 14 THEN concat(d, ' d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS badge FROM (SELECT *, datediff('day', DATE '1998-07-01', o_orderdate::DATE) AS d FROM orders)")
def deadline_badges(spark, sf):
    """DAT-08, ADJ-09."""
    return table(spark, sf, "orders").select("o_orderkey", dates.deadline_badge(F.to_date("o_orderdate"), F.lit("1998-07-01").cast("date")).alias("badge"))


#: (text with {n} for a number, country, low, high, currency, period)
_PAY_FORMS = [
    ("€{n}k - {m}k per year", None, "n * 1000", "(n + 10) * 1000", "EUR", "year"), ("£{n},500.50 per annum", None, "n * 1000 + 500", "n * 1000 + 500", "GBP", "year"), ("{n}.000 - {m}.000 EUR", None, "n * 1000", "(n + 10) * 1000", "EUR", "year"), ("up to {n} 000 chf a year", None, None, "n * 1000", "CHF", "year"),
    ("${n} an hour, 37-hour week", "Canada", "n", "n", "CAD", "hour"), ("{n}-{m}k plus 10% bonus", "France", "n * 1000", "(n + 10) * 1000", "EUR", "year"), ("${n}k, 25 days leave", "Germany", "n * 1000", "n * 1000", "USD", "year"), ("competitive, {n} of us", None, None, None, None, None), ("€{n}0 per day x 13", None, "n * 10", "n * 10", "EUR", "day"),
]


def _pay_case(column: int) -> str:
    said = lambda v: "NULL" if v is None else v if column < 4 else f"'{v}'"
    return f"CASE p_partkey % {len(_PAY_FORMS)} " + " ".join(f"WHEN {i} THEN {said(f[column])}" for i, f in enumerate(_PAY_FORMS)) + " END"


@query("salary_parse", f"""
SELECT p_partkey, low::DOUBLE AS low, high::DOUBLE AS high, currency, period, (high * CASE period WHEN 'hour' THEN 2080 WHEN 'day' THEN 260 ELSE 1 END)::DOUBLE AS per_year FROM (
  SELECT p_partkey, {_pay_case(2)} AS low, {_pay_case(3)} AS high, {_pay_case(4)} AS currency, {_pay_case(5)} AS period FROM (SELECT p_partkey, p_size + 19 AS n FROM part))""")
def salary_parse(spark, sf):
    """MAT-01, MAT-02, over texts of many shapes made from part sizes."""
    n = F.col("p_size") + 19
    said = country = None
    for i, (form, place, *_) in enumerate(_PAY_FORMS):
        one, here = F.format_string(form.replace("%", "%%").replace("{n}", "%1$d").replace("{m}", "%2$d"), n, n + 10), F.col("p_partkey") % len(_PAY_FORMS) == i
        said, country = (F.when(here, one), F.when(here, F.lit(place))) if said is None else (said.when(here, one), country.when(here, F.lit(place)))
    rows = table(spark, sf, "part").select("p_partkey", money.parse_salary(said, country).alias("s")).select("p_partkey", "s.*")
    return rows.withColumn("per_year", money.per_year(F.col("high"), F.col("period")))


def _rates(spark):
    return spark.createDataFrame([("EUR", 1.0), ("USD", 1.08), ("GBP", 0.85)], "currency string, per_eur double")


@query("convert_currency", """
SELECT o_orderkey, currency, round_even(o_totalprice / per_eur, 0) AS euros FROM (
  SELECT o_orderkey, o_totalprice, CASE c_nationkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'XXX' END AS currency FROM orders JOIN customer ON o_custkey = c_custkey) o
LEFT JOIN (VALUES ('EUR', 1.0::DOUBLE), ('USD', 1.08::DOUBLE), ('GBP', 0.85::DOUBLE)) r(cur, per_eur) ON r.cur = o.currency""")
def convert_currency(spark, sf):
    """JOIN-09, MAT-03, ADJ-10."""
    n = F.col("c_nationkey") % 4
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", F.col("o_totalprice").alias("amount"), F.when(n == 0, "EUR").when(n == 1, "USD").when(n == 2, "GBP").otherwise("XXX").alias("currency"))
    return adjust.with_euros(o, _rates(spark)).select("o_orderkey", "currency", "euros")


# ---------------------------------------------------------------- identity
_SIGHT = "SELECT event_id, user_id, event_type, ts, (props::JSON ->> '$.k')::BIGINT AS k FROM events"


@query("components", """
WITH RECURSIVE k AS (SELECT doc_id, unnest([concat('t:', substr(sha1(text), 1, 20)), concat('s:', substr(text, 1, 40))]) AS key FROM documents),
e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b USING (key) WHERE a.doc_id <> b.doc_id),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS node, least(x, min(y)) AS component FROM r GROUP BY x""")
def components_query(spark, sf):
    """AGG-01: documents joined by equal texts or equal openings."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.concat(F.lit("t:"), text.short_hash(F.col("text"))), F.concat(F.lit("s:"), F.substring("text", 1, 40)))).alias("key"))
    first = d.groupBy("key").agg(F.min("doc_id").alias("first"))
    return components(d.join(first, "key"), "doc_id", "first")


def _observations(spark, sf):
    """Documents as observations: copies share a content id, sources differ in
    authority."""
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    kind = F.when(n % 4 == 0, "ats").when(n % 4 == 1, "feed").when(n % 4 == 2, "aggregator").otherwise("search")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("obs_seq"), F.concat(F.lit("doc:"), text.short_hash(F.col("text"))).alias("native"), kind.alias("source_type"), F.when(n % 3 == 0, "api").otherwise("html").alias("extraction_method"),
        title().alias("title"), F.when(n % 2 == 0, F.col("source")).otherwise("").alias("company"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit(None).cast("string").alias("apply_url"), F.lit("").alias("salary"), F.col("text").alias("description"), F.lit(None).cast("timestamp").alias("posted_at"), F.lit(False).alias("posted_at_reliable"), (n < 10).alias("from_rotation"), F.col("source").alias("board_key"),
    ).withColumn("priority", identity.priority(F.col("source_type"), F.col("extraction_method"))).withColumn("keys", F.array("native"))


@query("fused_fields", f"""
WITH a AS (SELECT doc_id, substr(sha1(text), 1, 20) AS g, source, {SQL_TITLE} AS title, text, regexp_extract(source, '([0-9]+)$', 1)::INTEGER AS n FROM documents),
o AS (SELECT *, CASE n % 4 WHEN 0 THEN 100 WHEN 1 THEN 55 WHEN 2 THEN 40 ELSE 20 END + CASE WHEN n % 3 = 0 THEN 5 ELSE -15 END AS p, CASE WHEN n % 2 = 0 THEN source END AS company FROM a)
SELECT concat('doc:', g) AS key, arg_min(title, [-p, doc_id]) AS title, max(p)::INTEGER AS priority, arg_min(company, [-p, doc_id]) FILTER (company IS NOT NULL) AS company,
  arg_min(concat('https://', source, '.example.com/', doc_id), [-p, doc_id]) AS url, bool_and(n < 10) AS from_rotation, array_to_string(list_sort(list_distinct(list(source))), ',') AS boards, count(*) AS n_observations FROM o GROUP BY g""")
def fused_fields(spark, sf):
    """AGG-02 to AGG-04."""
    o = _observations(spark, sf).withColumn("group", F.col("native"))
    return identity.fuse(o).select(F.col("group").alias("key"), "title", "priority", "company", "url", "from_rotation", F.array_join("board_keys", ",").alias("boards"), "n_observations")


@query("observation_groups", """
WITH o AS (SELECT doc_id, substr(sha1(text), 1, 20) AS g, doc_id % 4 AS r, doc_id - doc_id % 4 AS b FROM documents),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY g) AS lone, count(*) OVER (PARTITION BY g) AS copies FROM o)
SELECT c.doc_id AS obs_seq, CASE WHEN c.copies > 1 THEN c.lone WHEN c.r = 2 AND d.copies = 1 THEN d.doc_id
  WHEN c.r = 3 AND coalesce(d.copies, 2) > 1 AND e.copies = 1 THEN e.doc_id ELSE c.doc_id END AS "group" FROM c LEFT JOIN c d ON d.doc_id = c.b LEFT JOIN c e ON e.doc_id = c.b + 2""")
def observation_groups(spark, sf):
    """AGG-01, SET-01, ARR-01, ARR-02: components and the ordered replay. Copies
    share a feed's id. Of four others in a row the third shares the first's
    page, the second its title alone under another platform's id, the fourth
    its page under another id of the platform."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("feed:"), text.short_hash(F.col("text"))).alias("copy"), (F.col("doc_id") % 4).alias("r"), (F.col("doc_id") - F.col("doc_id") % 4).cast("string").alias("b"))
    many = d.groupBy("copy").agg((F.count("*") > 1).alias("many"))
    own = F.when(F.col("r") == 0, F.concat(F.lit("greenhouse:acme:"), "b")).when(F.col("r") == 1, F.concat(F.lit("lever:acme:"), "b")).when(F.col("r") == 2, F.concat(F.lit("alerts:"), "b")).otherwise(F.concat(F.lit("greenhouse:acme:other"), "b"))
    page = F.when(F.col("r") != 1, F.concat(F.lit("url:"), "b"))
    keys = F.when(F.col("many"), F.array("copy")).otherwise(F.array_compact(F.array(own, page)))
    fuzzy = F.when(~F.col("many") & (F.col("r") < 2), F.concat(F.lit("fz:"), "b"))
    return identity.group_observations(d.join(many, "copy").select(F.col("doc_id").alias("obs_seq"), keys.alias("keys"), fuzzy.alias("fuzzy")))


_ALIAS = """s AS (SELECT user_id, (props::JSON ->> '$.k')::BIGINT AS k, max(ts) AS last_seen FROM events GROUP BY 1, 2),
j AS (SELECT user_id, max(last_seen) AS last_seen, list_distinct(list(k)) AS ks FROM s GROUP BY 1),
idx AS (SELECT alias, arg_max(user_id, [epoch_us(last_seen), user_id]) AS cid, max(last_seen) AS last_seen FROM (SELECT user_id, last_seen, unnest(ks) AS alias FROM j) GROUP BY 1)"""


def _alias_index(spark, sf, prefix):
    """Users as stored jobs: what their events name are aliases, and each has
    an id of one platform."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit(prefix), F.get_json_object("props", "$.k")).alias("k"))
    jobs = e.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.collect_set("k").alias("ks")).withColumn("canonical_id", F.format_string("u%05d", "user_id"))
    jobs = jobs.withColumn("aliases", F.concat("ks", F.array(F.concat(F.lit("lever:"), (F.col("user_id") % 3).cast("string")))))
    return identity.alias_index(jobs).where(F.col("alias").startswith(prefix))


def _sightings(spark, sf):
    """Events as groups with an id of a platform, but for every fifth."""
    k = F.get_json_object("props", "$.k").cast("int")
    own = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("lever:"), (F.col("event_id") % 3).cast("string")))
    return table(spark, sf, "events").select(F.col("event_id").alias("group"), k.alias("k"), own.alias("own"))


@query("fuzzy_state_join", f"WITH {_ALIAS} SELECT event_id AS \"group\", printf('u%05d', cid) AS canonical_id FROM events e JOIN idx ON (e.props::JSON ->> '$.k')::BIGINT = alias WHERE idx.last_seen >= TIMESTAMP '{NOW}' - INTERVAL 2 DAY AND (event_id % 5 = 0 OR event_id % 3 = cid % 3)")
def fuzzy_state_join(spark, sf):
    """JOIN-02, STA-02, STA-03, WIN-08: jobs of another platform id are vetoed."""
    g = _sightings(spark, sf).select("group", F.array_compact(F.array("own")).alias("keys"), F.concat(F.lit("fz:"), F.col("k").cast("string")).alias("fuzzy"))
    return identity.resolve_fuzzy(g, _alias_index(spark, sf, "fz:"), now(), 2)


@query("resolve_ids", f"""
WITH {_ALIAS}, q AS (SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events), a AS (SELECT event_id, 0 AS o, k FROM q UNION ALL SELECT event_id, 1, k + 1 FROM q)
SELECT event_id AS "group", printf('u%05d', arg_min(cid, o)) AS canonical_id FROM a JOIN idx ON a.k = alias WHERE event_id % 5 = 0 OR event_id % 3 = cid % 3 GROUP BY 1""")
def resolve_ids(spark, sf):
    """JOIN-01: by the first URL whose job has no conflicting id."""
    url = lambda n: F.concat(F.lit("url:"), (F.col("k") + n).cast("string"))
    g = _sightings(spark, sf).select("group", F.array_compact(F.array("own", url(0), url(1))).alias("keys"))
    return identity.resolve_ids(g, _alias_index(spark, sf, "url:"))


@query("canonical_ids", f"""
WITH {_ALIAS}, q AS (SELECT event_id, event_id % 3 AS n, (props::JSON ->> '$.k')::BIGINT AS k FROM events),
u AS (SELECT event_id, cid FROM q JOIN idx ON k = alias WHERE n = cid % 3),
o AS (SELECT user_id % 3 AS n, arg_max(user_id, [epoch_us(last_seen), user_id]) AS cid FROM j GROUP BY 1)
SELECT event_id AS "group", CASE WHEN event_id % 5 = 0 THEN concat('greenhouse:e', n) ELSE printf('u%05d', coalesce(u.cid, o.cid)) END AS canonical_id FROM q LEFT JOIN u USING (event_id) JOIN o USING (n)""")
def canonical_ids(spark, sf):
    """JOIN-01, JOIN-02, STA-02: the stored job by URL, by platform id where
    the URL's job has another, else the group's own platform id."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("url:"), F.get_json_object("props", "$.k")).alias("k"))
    jobs = e.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.collect_set("k").alias("ks")).withColumn("canonical_id", F.format_string("u%05d", "user_id"))
    jobs = jobs.withColumn("aliases", F.concat("ks", F.array(F.concat(F.lit("lever:"), (F.col("user_id") % 3).cast("string")))))
    n = (F.col("group") % 3).cast("string")
    known = F.array(F.concat(F.lit("url:"), F.col("k").cast("string")), F.concat(F.lit("lever:"), n))
    keys = F.when(F.col("group") % 5 == 0, F.array(F.lit("feed:none"), F.concat(F.lit("greenhouse:e"), n))).otherwise(known)
    return identity.canonical_ids(_sightings(spark, sf).select("group", keys.alias("keys"), F.lit(None).cast("string").alias("fuzzy")), jobs, now())


# ------------------------------------------------------------------- state
_UPSERT = """e AS (SELECT *, (props::JSON ->> '$.k')::BIGINT AS k FROM events),
o AS (SELECT user_id, arg_max(event_type, [epoch_us(ts), event_id]) AS title, count(*) AS n, max(ts) AS last_seen, concat('firm', user_id % 7) AS company, list(DISTINCT k) AS ks, list(DISTINCT event_type) AS boards, user_id % 4 < 2 AS told, user_id % 3 = 1 AS rotation
  FROM e WHERE ts < TIMESTAMP '2024-01-11' AND user_id % 3 <> 0 GROUP BY user_id),
n AS (SELECT user_id, arg_max(event_type, [epoch_us(ts), event_id]) AS title, count(*) AS n, max(ts) AS last_seen, CASE WHEN user_id % 5 > 0 THEN concat('firm', user_id % 6) END AS company, list(DISTINCT k) AS ks, list(DISTINCT event_type) AS boards, user_id % 2 = 0 AS rotation
  FROM e WHERE ts >= TIMESTAMP '2024-01-11' AND user_id % 3 <> 1 GROUP BY user_id),
j AS (SELECT coalesce(n.user_id, o.user_id) AS id, o.user_id IS NULL AS fresh, n.user_id IS NULL AS gone, o.user_id IS NULL OR (n.user_id IS NOT NULL AND n.n >= o.n) AS taken, o.title AS t0, n.title AS t1, o.company AS c0, n.company AS c1, o.told, o.ks AS k0, n.ks AS k1, o.boards AS b0, n.boards AS b1, o.rotation AS r0, n.rotation AS r1, o.last_seen AS l0, n.last_seen AS l1 FROM o FULL JOIN n ON o.user_id = n.user_id),
m AS (SELECT *, CASE WHEN taken THEN t1 ELSE t0 END AS title, CASE WHEN taken THEN coalesce(c1, c0) ELSE c0 END AS company, taken AND NOT fresh AND t0 <> t1 AS retitled, taken AND NOT fresh AND coalesce(c1, c0) <> c0 AS moved FROM j)"""


@query("upsert_changes", f"""
WITH {_UPSERT} SELECT id AS canonical_id, CASE WHEN fresh THEN 'insert' WHEN gone THEN 'keep' WHEN retitled OR moved THEN 'update' ELSE 'refresh' END AS action, title, company, floor(epoch(coalesce(l1, l0)))::BIGINT AS last_seen,
  least(40, len(list_distinct(list_concat(coalesce(k0, []), coalesce(k1, [])))))::INTEGER AS n_aliases, array_to_string(list_sort(list_distinct(list_concat(coalesce(b0, []), coalesce(b1, [])))), ',') AS boards,
  CASE WHEN fresh THEN r1 WHEN gone THEN r0 ELSE r0 AND r1 END AS from_rotation, coalesce(told, false) AND retitled AS pending_update FROM m""")
def upsert_changes(spark, sf):
    """STA-01, STA-14, JOIN-03, SET-05: half the month's events merged into the
    other half's, with employers left out of some."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k"))
    u = F.col("canonical_id")

    def by(rows):
        g = rows.groupBy(F.col("user_id").alias("canonical_id"))
        return g.agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("title"), F.count("*").alias("priority"), F.max("ts").alias("last_seen"), F.collect_set("k").alias("aliases"), F.collect_set("event_type").alias("board_keys")).withColumn("description", F.lit("x"))

    firm = lambda n: F.concat(F.lit("firm"), (u % n).cast("string"))
    at = F.lit("2024-01-11").cast("timestamp")
    old = by(e.where((F.col("ts") < at) & (F.col("user_id") % 3 != 0))).withColumn("company", firm(7)).withColumn("notified", u % 4 < 2).withColumn("from_rotation", u % 3 == 1)
    old = old.withColumn("first_seen", F.col("last_seen")).withColumn("changes", F.array().cast("array<struct<at:timestamp,fields:array<string>>>"))
    new = by(e.where((F.col("ts") >= at) & (F.col("user_id") % 3 != 1))).withColumn("company", F.when(u % 5 > 0, firm(6)).when(u % 2 == 0, "")).withColumn("from_rotation", u % 2 == 0)
    merged = state.upsert(old, new, now(), ["title", "company", "description"])
    # a company that is first seen empty stays so; the SQL has null for it
    return merged.select("canonical_id", "action", "title", F.nullif(F.col("company"), F.lit("")).alias("company"), F.unix_seconds("last_seen").alias("last_seen"), F.size("aliases").alias("n_aliases"), F.array_join("board_keys", ",").alias("boards"), "from_rotation", "pending_update")


_LAST = "l AS (SELECT user_id, event_type, max(ts) AS last_seen FROM events GROUP BY 1, 2)"


def _last_seen(spark, sf):
    """Each user's events of a type as the sightings of one posting."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max(F.col("ts").cast("timestamp")).alias("last_seen"))


@query("still_listed", f"WITH {_LAST} SELECT user_id, event_type, last_seen >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY * CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 21 ELSE 35 END AS listed FROM l")
def still_listed(spark, sf):
    """FLT-04: a purchase stands for a direct source, a signup for a feed."""
    kind = F.when(F.col("event_type") == "purchase", "ats").when(F.col("event_type") == "signup", "feed").otherwise(F.col("event_type"))
    return _last_seen(spark, sf).select("user_id", "event_type", state.is_listed(F.col("last_seen"), F.array(kind), now()).alias("listed"))


@query("ttl_prune", f"WITH {_LAST} SELECT user_id, event_type FROM l WHERE user_id % 10 = 0 OR last_seen >= TIMESTAMP '{NOW}' + INTERVAL 22 DAY - INTERVAL 1 DAY * CASE WHEN event_type IN ('error', 'signup') THEN 30 ELSE 180 END")
def ttl_prune(spark, sf):
    """STA-03, three weeks on: errors and signups stand for rejected postings."""
    rows = _last_seen(spark, sf).withColumn("tier", F.when(F.col("event_type").isin("error", "signup"), "rejected").otherwise("high")).withColumn("applied", F.col("user_id") % 10 == 0)
    return state.prune(rows, now() + F.make_interval(days=F.lit(22))).select("user_id", "event_type")


@query("dedup_memory", "WITH m AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-05' AND event_type = 'error') SELECT user_id AS id, min(ts)::VARCHAR IS NOT NULL AS fresh FROM events WHERE user_id NOT IN (SELECT user_id FROM m) GROUP BY 1")
def dedup_memory(spark, sf):
    """STA-04, JOIN-14, SRC-38."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "ts", "event_type")
    memory = e.where("ts < '2024-01-05' and event_type = 'error'").select("id").distinct()
    return state.new_items(e, memory).select("id", F.col("ts").isNotNull().alias("fresh"))


@query("text_memory", """
SELECT canonical_id, length(t)::INTEGER AS size FROM (SELECT coalesce(b.doc_id, a.doc_id) AS canonical_id,
  CASE WHEN b.doc_id IS NOT NULL AND (a.doc_id IS NULL OR length(b.t) >= 0.8 * length(a.t)) THEN b.t ELSE a.t END AS t, coalesce(b.doc_id, a.doc_id) AS seen
FROM (SELECT doc_id, text AS t FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, substr(text, 1, 6000) AS t FROM documents WHERE doc_id % 3 <> 1) b ON a.doc_id = b.doc_id) ORDER BY canonical_id DESC LIMIT 2500""")
def text_memory(spark, sf):
    """STA-06, SNK-09, TOP-07."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("canonical_id"), "text", F.timestamp_seconds("doc_id").alias("seen"))
    kept = state.remember_text(d.where("canonical_id % 3 <> 0"), d.where("canonical_id % 3 <> 1"))
    return kept.select("canonical_id", F.length("text").alias("size"))


@query("page_refetch", "SELECT page_id FROM pages WHERE page_id % 4 = 0 OR page_id % 5 = 0 OR page_id % 7 = 0")
def page_refetch(spark, sf):
    """JOIN-12, JOIN-13, OPT-04: unknown, stale and changed pages."""
    p = table(spark, sf, "pages")
    queue = p.select("page_id", F.concat("url", F.lit("!"), F.col("page_id").cast("string")).alias("url"), F.when(F.col("page_id") % 7 == 0, "new").otherwise("old").alias("lastmod"))
    cache = queue.where("page_id % 4 <> 0").select("url", F.lit("old").alias("lastmod"), F.when(F.col("page_id") % 5 == 0, F.lit("2023-01-01")).otherwise(F.lit("2024-01-20")).cast("timestamp").alias("fetched_at"))
    return state.pages_to_fetch(queue, cache, now()).select("page_id")


@query("error_streaks", """
WITH d AS (SELECT user_id, ts, event_type = 'error' AS failed FROM events), o AS (SELECT user_id, max(ts) FILTER (NOT failed) AS ok FROM d GROUP BY 1)
SELECT d.user_id, count(*) FILTER (failed AND (ok IS NULL OR ts > ok)) AS streak FROM d JOIN o USING (user_id) GROUP BY 1""")
def error_streaks(spark, sf):
    """WIN-07, STA-08."""
    return state.failure_streak(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "error")


@query("follow_ups", """
SELECT o_orderkey, stage::INTEGER AS stage FROM (SELECT o_orderkey, CASE WHEN d >= 21 THEN 21 WHEN d >= 7 THEN 7 ELSE 0 END AS stage, CASE WHEN o_orderkey % 5 = 0 THEN 7 END AS reminded FROM (
  SELECT o_orderkey, o_orderstatus, floor(epoch(TIMESTAMP '1998-08-01' - o_orderdate) / 86400) AS d FROM orders) WHERE o_orderstatus = 'O') WHERE stage > coalesce(reminded, 0)""")
def follow_ups(spark, sf):
    """STA-09, JOIN-17."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("applied_at"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), F.when(F.col("o_orderkey") % 5 == 0, 7).alias("reminded"))
    return state.follow_ups(o, F.lit("1998-08-01").cast("timestamp")).select("o_orderkey", "stage")


@query("board_selection", """
SELECT slug, rank::INTEGER AS rank FROM (SELECT c_custkey AS slug, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 100 END NULLS FIRST, c_nationkey % 3, c_custkey) AS rank, c_custkey FROM customer) WHERE rank <= 25""")
def board_selection(spark, sf):
    """WIN-04, SRC-42, STA-13."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("ats"), F.col("c_custkey").alias("slug"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 100).alias("last_checked"), (F.col("c_nationkey") % 3).alias("origin_rank"))
    return state.select_boards(c, 25).select("slug", "rank")


@query("rotation_batch", "WITH n AS (SELECT count(*) AS n FROM pages), r AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS k FROM pages) SELECT page_id, ((k - 240 % n + n) % n)::BIGINT AS turn FROM r, n WHERE (k - 240 % n + n) % n < least(40, n)")
def rotation_batch(spark, sf):
    """WIN-03, STA-12, OPT-10."""
    return state.rotate(table(spark, sf, "pages").select("page_id"), "page_id", 240, 40)[0].select("page_id", "turn")


@query("host_caps", f"SELECT page_id FROM (SELECT page_id, page_id % 9 AS priority, row_number() OVER (PARTITION BY host ORDER BY page_id % 9 DESC, page_id) AS r FROM (SELECT page_id, {_HOST} AS host FROM pages)) WHERE r <= 3 ORDER BY priority DESC, page_id LIMIT 100")
def host_caps(spark, sf):
    """WIN-05, TOP-08, SRC-32."""
    q = table(spark, sf, "pages").select("page_id", F.col("page_id").alias("seq"), (F.col("page_id") % 9).alias("priority"), urls.host_of(F.col("url")).alias("host"))
    return select.host_caps(q, 3, 100).select("page_id")


@query("budget_caps", """
WITH a AS (SELECT event_id AS seq, user_id AS board, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 4 END AS rank, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type ELSE 'generic' END AS kind FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY board, kind ORDER BY seq) AS g FROM a), c AS (SELECT * FROM b WHERE kind <> 'generic' OR g <= 8)
SELECT seq, board FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY rank, seq) AS t FROM c) WHERE t <= 20""")
def budget_caps(spark, sf):
    """WIN-06."""
    k = F.col("event_type")
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("board"), F.when(k == "purchase", 0).when(k == "signup", 1).otherwise(4).alias("rank"), F.when(k.isin("purchase", "signup"), k).otherwise("generic").alias("kind"))
    return select.detail_budget(e, 20).select("seq", "board")


@query("source_due", f"SELECT user_id, last_seen + INTERVAL 1 HOUR * (24 + least(fails, 24)) <= TIMESTAMP '{NOW}' AS due FROM (SELECT user_id, max(ts) AS last_seen, count(*) FILTER (event_type = 'error') AS fails FROM events GROUP BY 1)")
def source_due(spark, sf):
    """FLT-17, STA-11."""
    h = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_attempt"), F.count_if(F.col("event_type") == "error").alias("consecutive_failures"))
    wait = 24 + F.least("consecutive_failures", F.lit(24))
    return h.select("user_id", (F.unix_micros("last_attempt") + wait * 3_600_000_000 <= F.unix_micros(now())).alias("due"))


# --------------------------------------------------------------- selection
_CAND = """c AS (SELECT event_id AS id, CASE WHEN value > 60 THEN 'high' WHEN value > 30 THEN 'possible' ELSE 'rejected' END AS tier, floor(value)::INTEGER AS score, ts, concat(user_id % 40, '|', event_type) AS posting FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY posting ORDER BY CASE tier WHEN 'high' THEN 0 WHEN 'possible' THEN 1 ELSE 2 END, score DESC, ts DESC, id) AS copy FROM c WHERE tier <> 'rejected')"""


def _candidates(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.when(v > 60, "high").when(v > 30, "possible").otherwise("rejected").alias("tier"), F.floor(v).cast("int").alias("score"),
        F.col("ts").cast("timestamp").alias("posted_at"), F.concat(F.lit("user"), (F.col("user_id") % 40).cast("string")).alias("company"), F.col("event_type").alias("title"), F.lit("").alias("country"),
    ).where("tier <> 'rejected'")


@query("alert_select", f"WITH {_CAND} SELECT id, tier, score FROM r WHERE copy = 1 ORDER BY CASE tier WHEN 'high' THEN 0 ELSE 1 END, score DESC, ts DESC, id LIMIT 20")
def alert_select(spark, sf):
    """WIN-01, TOP-01, SET-03."""
    return select.rank_alerts(_candidates(spark, sf), now()).select("id", "tier", "score")


@query("alert_counts", f"WITH {_CAND} SELECT count(*) AS candidates, count(*) FILTER (copy = 1) AS postings, least(count(*) FILTER (copy = 1), 20) AS sent, greatest(count(*) FILTER (copy = 1) - 20, 0) AS deferred FROM r")
def alert_counts(spark, sf):
    """TOP-01."""
    return select.alert_counts(_candidates(spark, sf))


@query("waiting_set", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def waiting_set(spark, sf):
    """JOIN-16, SET-04."""
    return select.exclude(table(spark, sf, "documents"), table(spark, sf, "labels"), key="doc_id").select("doc_id")


#: (company as written, the watched name that it holds) for a list of three names
_WATCHED = [
    ("Acme Survey GmbH", "acme survey"), ("The ACME Survey of Peru", "acme survey"), ("Acmes Survey", None), ("Survey Acme", None), ("Nordic Geo, Ltd.", "geo"), ("Nordic Geophysics", None), ("Geo Acme Survey", "acme survey"), ("", None), ("Été Géo", "geo"),
]


@query("watch_contains", "SELECT * FROM (SELECT s_suppkey AS job_id, " + _golden("s_suppkey", _WATCHED, lambda c: f"'{c[1]}'" if c[1] else "NULL") + " AS watch FROM supplier) WHERE watch IS NOT NULL")
def watch_contains(spark, sf):
    """JOIN-10: whole words of the normalised name, in order."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("job_id"), _said(F.col("s_suppkey"), _WATCHED).alias("company"))
    return select.watched(s, spark.createDataFrame([("Acme Survey Inc",), ("GEO",), ("Nobody",)], "name string"))


_HEADS = """n AS (SELECT DISTINCT w[1] || ' ' || w[2] AS name FROM (SELECT string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents) WHERE len(w) > 1),
t AS (SELECT DISTINCT array_to_string(w[1:12], ' ') AS text FROM (SELECT string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM conversations) WHERE w[1] <> '')"""


@query("name_containment", f"WITH {_HEADS} SELECT name, text FROM n JOIN t ON list_has_all(string_split(text, ' '), string_split(name, ' '))")
def name_containment(spark, sf):
    """JOIN-10, JOIN-11: which of the documents' first two words stand both
    among a conversation's first twelve; words are few and very frequent."""
    words = lambda t: F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    heads = lambda name, n, to: table(spark, sf, name).select(F.array_join(F.slice(words("text"), 1, n), " ").alias(to))
    return select.contained(heads("documents", 2, "name").where(F.contains("name", F.lit(" "))), heads("conversations", 12, "text"))


@query("same_company", "SELECT a.s_suppkey AS x, b.s_suppkey AS y, a.s_suppkey % 10 = b.s_suppkey % 10 AS same FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 10 OR b.s_suppkey = a.s_suppkey + 1")
def same_company(spark, sf):
    """JOIN-21: each supplier with its next and its tenth; names differ in a
    legal form, in case, or in the name proper."""
    k = F.col("s_suppkey")
    form = F.when(k % 20 < 10, " GmbH").when(k % 3 == 0, ", Inc.").otherwise("")
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.when(k % 40 < 20, "Maker ").otherwise("MAKER "), F.format_string("name%d", k % 10), form).alias("name"))
    pairs = s.select(k.alias("x"), F.col("name").alias("a"), F.explode(F.array(k + 10, k + 1)).alias("y")).join(s.select(k.alias("y"), F.col("name").alias("b")), "y")
    return pairs.select("x", "y", select.same_company(F.col("a"), F.col("b")).alias("same"))


@query("status_report", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_report(spark, sf):
    """AGG-15, AGG-20, AGG-21, VIEW-12."""
    return insights.tally(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")), "status")


# ---------------------------------------------------------------- insights
@query("daily_volume", "SELECT ts::DATE AS day, event_type AS source, count(*) AS raw FROM events GROUP BY 1, 2")
def daily_volume(spark, sf):
    """AGG-07, STA-05."""
    return insights.daily_volume(table(spark, sf, "events"), source="event_type")


_YIELD = f"""j AS (SELECT user_id, props::JSON ->> '$.k' AS k, CASE WHEN avg(value) > 25 THEN 'high' WHEN avg(value) > 15 THEN 'possible' ELSE 'rejected' END AS tier, min(ts) AS first_seen, list_distinct(list(event_type)) AS g, user_id % 5 = 0 AS applied FROM events GROUP BY ALL),
f AS (SELECT * FROM j WHERE tier <> 'rejected' AND first_seen >= TIMESTAMP '{NOW}' - INTERVAL 40 DAY),
b AS (SELECT s AS source, count(*) AS found, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (len(g) = 1) AS only_here, count(*) FILTER (applied) AS applied FROM (SELECT *, unnest(g) AS s FROM f) GROUP BY 1),
v AS (SELECT event_type AS source, count(*) AS raw FROM events WHERE ts::DATE >= (TIMESTAMP '{NOW}' - INTERVAL 40 DAY)::DATE GROUP BY 1),
y AS (SELECT coalesce(b.source, v.source) AS source, coalesce(raw, 0)::BIGINT AS raw, coalesce(found, 0)::BIGINT AS found, coalesce(high, 0)::BIGINT AS high, coalesce(only_here, 0)::BIGINT AS only_here, coalesce(applied, 0)::BIGINT AS applied FROM b FULL JOIN v ON b.source = v.source)"""


def _yield(spark, sf):
    """A user's events of a number are one job's sightings."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    jobs = e.groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.avg("value").alias("v"), F.min("ts").alias("first_seen"), F.collect_set("event_type").alias("sources"))
    jobs = jobs.withColumn("id", F.concat_ws("|", "user_id", "k")).withColumn("tier", F.when(F.col("v") > 25, "high").when(F.col("v") > 15, "possible").otherwise("rejected")).withColumn("applied", F.col("user_id") % 5 == 0)
    return insights.source_yield(jobs, insights.daily_volume(e, source="event_type"), now(), 40)


@query("source_yield", f"WITH {_YIELD} SELECT * FROM y")
def source_yield(spark, sf):
    """AGG-08, VIEW-08, WIN-10."""
    return _yield(spark, sf)


@query("yield_verdicts", f"WITH {_YIELD} SELECT source, CASE WHEN raw >= 150 AND found = 0 THEN 'noise' WHEN found >= 5 AND only_here = 0 THEN 'redundant' WHEN source = 'error' AND only_here = 0 AND raw >= 50 THEN 'costly' END AS verdict FROM y")
def yield_verdicts(spark, sf):
    """AGG-09."""
    return _yield(spark, sf).select("source", insights.yield_verdict(F.col("raw"), F.col("found"), F.col("only_here"), F.col("source") == "error").alias("verdict"))


@query("radar_shares", f"{_SCORED}, a AS (SELECT doc_id, string_split(terms, ',') AS s FROM scored WHERE tier <> 'rejected'), t AS (SELECT count(*) AS total FROM a), m AS (SELECT unnest(s) AS skill FROM a WHERE s <> ['']) SELECT skill, count(*) AS mentions, round_even(100.0::DOUBLE * count(*) / any_value(total), 0)::INTEGER AS share, skill IN ('that', 'dans') AS owned FROM m, t GROUP BY skill")
def radar_shares(spark, sf):
    """AGG-10, ARR-06, VIEW-09."""
    jobs = scored(spark, sf).select(F.col("doc_id").alias("id"), "tier", F.transform("hits", lambda h: h["canonical"]).alias("skills"), now().alias("last_seen"))
    return insights.radar(jobs, ["that", "dans"], now())


def _terms_of(spark, sf):
    return _hits(spark, sf).select(F.col("doc_id").alias("id"), F.explode(F.transform("hits", lambda h: h["canonical"])).alias("feature"))


def _label_weights(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, -1).when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("weight"))


_LEARN = f"""{_SCORED}, l AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN -1 WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS w FROM labels), u AS (SELECT * FROM l WHERE w <> 0),
t AS (SELECT coalesce(sum(w) FILTER (w > 0), 0)::DOUBLE AS p, coalesce(-sum(w) FILTER (w < 0), 0)::DOUBLE AS n, count(*) AS k FROM u),
f AS (SELECT doc_id AS id, unnest(string_split(terms, ',')) AS feature FROM scored WHERE terms <> ''),
g AS (SELECT feature, sum(greatest(w, 0))::BIGINT AS positives, sum(greatest(-w, 0))::BIGINT AS negatives, count(*) AS support FROM f JOIN u USING (id) GROUP BY 1),
h AS (SELECT feature, positives, negatives, (positives + 2 * (p / (p + n))) / (positives + negatives + 2) AS rate, p / (p + n) AS base FROM g, t WHERE k >= 4 AND support >= 2),
w AS (SELECT feature, positives, negatives, round_even(60 * ((rate - base) / CASE WHEN rate > base THEN 1 - base ELSE base END), 0) / 10 AS weight FROM h), weights AS (SELECT * FROM w WHERE abs(weight) >= 1)"""


@query("learned_weights", f"{_LEARN} SELECT * FROM weights")
def learned_weights(spark, sf):
    """AGG-11, MAT-05, PRJ-04, TOP-14."""
    return adjust.learned_weights(_label_weights(spark, sf), _terms_of(spark, sf))


@query("learned_adjust", f"{_LEARN}, s AS (SELECT id, sum(weight) AS x FROM f JOIN weights USING (feature) GROUP BY 1) SELECT doc_id AS id, greatest(-8, least(6, round_even(coalesce(x, 0), 0)))::INTEGER AS nudge FROM documents LEFT JOIN s ON s.id = doc_id")
def learned_adjust(spark, sf):
    """ADJ-03."""
    terms = _terms_of(spark, sf)
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return adjust.learned_nudge(rows, terms, adjust.learned_weights(_label_weights(spark, sf), terms))


@query("repost_waves", """
WITH RECURSIVE p AS (SELECT event_id AS id, concat(user_id, '|', event_type) AS posting, floor(epoch(ts))::BIGINT AS s FROM events),
n AS (SELECT a.posting, a.s, min(b.s) AS next FROM (SELECT DISTINCT posting, s FROM p) a JOIN (SELECT DISTINCT posting, s FROM p) b ON b.posting = a.posting AND b.s >= a.s + 864000 GROUP BY 1, 2),
w(posting, s) AS (SELECT posting, min(s) FROM p GROUP BY 1 UNION ALL SELECT w.posting, n.next FROM w JOIN n ON n.posting = w.posting AND n.s = w.s)
SELECT id, count(w.s)::INTEGER AS earlier FROM p LEFT JOIN w ON w.posting = p.posting AND p.s - w.s >= 864000 GROUP BY id""")
def repost_waves(spark, sf):
    """WIN-02, JOIN-07."""
    jobs = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("posting"), F.col("ts").cast("timestamp").alias("first_seen"))
    return insights.repost_waves(jobs, 10).select("id", "earlier")


@query("source_groups", "SELECT CASE WHEN source IN ('src0', 'src1') THEN source ELSE 'other' END AS g, count(*) AS n FROM documents GROUP BY 1")
def source_groups(spark, sf):
    """SCR-12, AGG-06."""
    g = insights.source_group(F.col("source"))
    return insights.tally(table(spark, sf, "documents").select(F.when(g.isin("src0", "src1"), g).otherwise("other").alias("g")), "g")


@query("signal_kinds", "SELECT p_partkey, CASE WHEN NOT regexp_matches(t, 'data') OR regexp_matches(t, 'vehicle') THEN NULL WHEN regexp_matches(t, 'awarded to') THEN 'award' WHEN regexp_matches(t, 'consult') THEN 'consultancy' ELSE 'tender' END AS kind FROM (SELECT p_partkey, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' data awarded to X' WHEN 1 THEN ' data consulting' WHEN 2 THEN ' data' ELSE ' vehicle data' END) AS t FROM part)")
def signal_kinds(spark, sf):
    """SCR-11, FLT-09, TOP-12."""
    k = F.col("p_partkey") % 4
    t = F.concat("p_name", F.when(k == 0, " data awarded to X").when(k == 1, " data consulting").when(k == 2, " data").otherwise(" vehicle data"))
    return table(spark, sf, "part").select("p_partkey", insights.signal_kind(t, "data", "vehicle").alias("kind"))


# --------------------------------------------------- registers and routes
@query("register_aggregate", f"SELECT 'reg' AS register, {_sql_company(_NAME)} AS name_key, min({_NAME}) AS name, sum(s_nationkey)::BIGINT AS positions, max(s_nationkey > 12) AS strong FROM supplier GROUP BY 2")
def register_aggregate(spark, sf):
    """AGG-12, SRC-37."""
    s = _suppliers(spark, sf).select(F.lit("reg").alias("register"), "name", F.col("s_nationkey").alias("positions"), F.lit("o").alias("occupation"), (F.col("s_nationkey") > 12).alias("strong"))
    return adjust.aggregate_register(s).drop("occupations")


@query("register_match", f"""
WITH r AS (SELECT {_sql_company(_NAME)} AS k, {_NAME} AS name, s_nationkey > 12 AS strong, s_suppkey FROM supplier),
j AS (SELECT s_suppkey AS job_id, CASE WHEN s_suppkey % 3 = 0 THEN concat(replace(s_name, '#', ' '), ' Group') ELSE {_NAME} END AS company FROM supplier),
e AS (SELECT job_id, name, true AS exact, strong FROM j JOIN r ON {_sql_company('company')} = r.k),
c AS (SELECT {_CORE % 'k'} AS core, arg_min(name, k) AS name, arg_min(strong, k) AS strong FROM r GROUP BY 1),
n AS (SELECT job_id, name, false AS exact, strong FROM j JOIN c ON {_CORE % _sql_company('company')} = c.core WHERE job_id NOT IN (SELECT job_id FROM e) AND length(replace(core, ' ', '')) >= 4)
SELECT * FROM e UNION ALL SELECT * FROM n""")
def register_match(spark, sf):
    """JOIN-04."""
    s = _suppliers(spark, sf)
    register = s.select(F.lit("reg").alias("register"), text.normalize_company(F.col("name")).alias("name_key"), "name", (F.col("s_nationkey") > 12).alias("strong"))
    jobs = s.select(F.col("s_suppkey").alias("job_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.replace(F.col("s_name"), F.lit("#"), F.lit(" ")), F.lit(" Group"))).otherwise(F.col("name")).alias("company"))
    return adjust.match_register(jobs, register).select("job_id", "name", "exact", "strong")


_ROUTES = "(VALUES (1, 0, 'blue', 4000.0::DOUBLE, 3000.0::DOUBLE, true, false), (1, 1, 'green', NULL, NULL, false, false), (2, 0, 'red', 6000.0::DOUBLE, NULL, true, false), (2, 1, 'grey', 1000.0::DOUBLE, NULL, false, true), (3, 0, 'white', 2000.0::DOUBLE, 1000.0::DOUBLE, false, false)) x(country, ordinal, route, minimum, reduced, needs_sponsor, hard)"
_ASSESS = f"""j AS (SELECT c_custkey AS job_id, c_nationkey % 5 AS country, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS low, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal + 1500 END AS high, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS sponsor FROM customer),
b AS (SELECT j.*, x.ordinal, x.route, x.needs_sponsor, x.hard, x.minimum, CASE WHEN high IS NULL OR minimum IS NULL THEN 'unknown' WHEN low >= minimum THEN 'above' WHEN high >= minimum THEN 'reaches' WHEN reduced IS NOT NULL AND high >= reduced THEN 'reduced' ELSE 'below' END AS band FROM j JOIN {_ROUTES} ON j.country = x.country),
k AS (SELECT *, CASE WHEN minimum IS NULL THEN true WHEN band = 'unknown' THEN NULL ELSE band <> 'below' END AS pay_ok, CASE WHEN NOT needs_sponsor THEN true ELSE sponsor END AS sponsor_ok FROM b),
v AS (SELECT *, CASE WHEN hard THEN 'hard' WHEN NOT coalesce(pay_ok, true) OR NOT coalesce(sponsor_ok, true) THEN 'blocked' WHEN coalesce(pay_ok, false) AND coalesce(sponsor_ok, false) THEN 'strong' ELSE 'open' END AS verdict FROM k),
z AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE verdict WHEN 'strong' THEN 1 WHEN 'open' THEN 2 WHEN 'hard' THEN 3 ELSE 4 END, ordinal) AS choice FROM v)"""


def _assessed(spark, sf):
    c = table(spark, sf, "customer")
    known, k = F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 3
    jobs = c.select(F.col("c_custkey").alias("job_id"), (F.col("c_nationkey") % 5).alias("country"), F.when(known, F.col("c_acctbal")).alias("low"), F.when(known, F.col("c_acctbal") + 1500).alias("high"), F.when(k == 0, True).when(k == 1, False).alias("sponsor"))
    rules = spark.createDataFrame([(1, 0, "blue", 4000.0, 3000.0, True, False), (1, 1, "green", None, None, False, False), (2, 0, "red", 6000.0, None, True, False), (2, 1, "grey", 1000.0, None, False, True), (3, 0, "white", 2000.0, 1000.0, False, False)], "country int, ordinal int, route string, minimum double, reduced double, needs_sponsor boolean, hard boolean")
    return adjust.assess_routes(jobs, rules)


@query("route_assess", f"WITH {_ASSESS} SELECT job_id, route, band, verdict, choice::INTEGER AS choice FROM z WHERE choice <= 3")
def route_assess(spark, sf):
    """JOIN-06, JOIN-08, ADJ-11, WIN-11."""
    return _assessed(spark, sf).select("job_id", "route", "band", "verdict", "choice")


@query("route_best", f"WITH {_ASSESS} SELECT job_id, route, verdict, CASE WHEN verdict = 'blocked' OR (verdict = 'hard' AND NOT coalesce(sponsor_ok, false)) THEN -12 ELSE 0 END::INTEGER AS penalty FROM z WHERE choice = 1")
def route_best(spark, sf):
    """JOIN-08, ADJ-06, AGG-21, VIEW-06."""
    return _assessed(spark, sf).where("choice = 1").select("job_id", "route", "verdict", adjust.visa_penalty(F.col("verdict"), F.col("sponsor_ok")).alias("penalty"))


@query("adjustment_chain", f"{_SCORED} SELECT doc_id, s AS score, CASE WHEN hard <> [] THEN 'rejected' WHEN s >= 70 THEN 'high' WHEN s >= 55 THEN 'possible' ELSE 'rejected' END AS tier FROM (SELECT doc_id, hard, greatest(0, least(100, score + CASE WHEN lang = 'fr' THEN 4 ELSE 0 END + CASE WHEN source = 'src0' THEN -12 ELSE 0 END))::INTEGER AS s FROM scored)")
def adjustment_chain(spark, sf):
    """ADJ-01, ADJ-02, ADJ-06: all adjustments once, over the base score."""
    rows = scored(spark, sf).withColumn("base_score", F.col("score")).withColumn("hard_reasons", F.array_remove("reasons", "LOW_SCORE"))
    return adjust.apply_adjustments(rows, {"register": F.when(F.col("lang") == "fr", 4).otherwise(0), "route": F.when(F.col("source") == "src0", -12).otherwise(0)}).select("doc_id", "score", "tier")


# -------------------------------------------------------------- procedural
#: (end of a text, country, deadline as of 31 January 2024)
_DEADLINES = [
    ("Closing date: 30 March 2024 at 5pm", None, "2024-03-30"), ("Date limite de candidature : 05/04/2024", "France", "2024-04-05"), ("Closes: 4 Mar 2024", None, "2024-03-04"), ("This vacancy closes on 12 March 2024.", None, "2024-03-12"), ("Please apply by Mar 2nd.", None, "2024-03-02"),
    ("Applications close 03/30/2024", "United States", "2024-03-30"), ("Merci d'envoyer votre CV avant le 15 mars 2024.", "France", "2024-03-15"), ("Poste à pourvoir avant le 1er mars 2024.", "France", None), ("Our office closes on 24 February and reopens.", None, None), ("Closing date: ongoing. Posted 01/02/2024", None, None),
    ("Closing date: 11/12/2023", "Canada", "2023-12-11"), ("Apply by 10/01/2024", None, None), ("Bewerbungsfrist: 30.04.2024", "Germany", "2024-04-30"), ("Our office closes on 4 March 2024. Apply by 10 March 2024", None, "2024-03-10"), ("<p>Closing Date:</p><p>25 Feb 2024</p>", None, "2024-02-25"), ("Nothing to say", None, None),
]


@query("deadline_find", "SELECT doc_id, " + _golden("doc_id", _DEADLINES, lambda c: f"DATE '{c[2]}'" if c[2] else "NULL") + " AS deadline FROM documents")
def deadline_find(spark, sf):
    """DAT-04, DAT-05: whole texts that end in sentences with and without one."""
    import datetime as dt

    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(". "), _said(F.col("doc_id"), _DEADLINES)).alias("t"), _said(F.col("doc_id"), _DEADLINES, 1).cast("string").alias("country"))
    return d.select("doc_id", dates.find_deadline(dt.date(2024, 1, 31))("t", "country").alias("deadline"))


#: (end of a text, country, scope, remote, reading, rights needed, sponsorship offered) for someone at home in France
_RIGHTS = [
    ("Visa sponsorship is available.", None, None, False, "offer", False, True), ("We are unable to offer sponsorship.", None, None, False, "refusal", True, False), ("You must have the right to work here.", "Germany", None, False, "demand", True, False), ("You must have the right to work here.", "France", None, False, "demand", False, False),
    ("US citizens only.", "United States", None, False, "demand", True, False), ("US citizenship is not required.", "United States", None, False, "neutral", False, False), ("EU citizens and non-EU nationals alike.", None, None, False, "neutral", False, False), ("Must be authorized to work; sponsorship can be provided.", None, None, False, "offer", False, True),
    ("No visa sponsorship, work from home.", None, "Worldwide", True, "refusal", False, False), ("Candidates from any country can apply. You must have a work permit.", None, None, False, "neutral", False, False), ("Security clearance desirable.", None, None, False, "neutral", False, False), ("This role is not eligible for visa sponsorship.", None, None, False, "refusal", True, False), ("Great team.", None, None, False, "neutral", False, False),
]


@query("work_auth", "SELECT doc_id, " + ", ".join(_golden("doc_id", _RIGHTS, (lambda k: lambda c: repr(c[k]) if k == 4 else str(c[k]).lower())(k)) + f" AS {name}" for k, name in ((4, "reading"), (5, "required"), (6, "offered"))) + " FROM documents")
def work_auth(spark, sf):
    """SCR-03: what whole texts say at their ends, and what it means where."""
    i = F.col("doc_id")
    t = F.concat("text", F.lit(". "), _said(i, _RIGHTS))
    said = F.col("said")
    required = scoring.rights_needed(said, _said(i, _RIGHTS, 1).cast("string"), _said(i, _RIGHTS, 2).cast("string"), _said(i, _RIGHTS, 3), ("France",))
    read = scoring.settled(table(spark, sf, "documents").select("doc_id", scoring.work_rights(t).alias("said")), "said")
    return read.select("doc_id", scoring.work_authorisation(said).alias("reading"), required.alias("required"), scoring.sponsorship_offered(said).alias("offered"))


#: (place as written, city, region, country, work mode, shown)
_PLACES = [
    ("Paris, France", "Paris", None, "France", None, "Paris, France"), ("Remote - Germany", None, None, "Germany", "remote", "Remote, Germany"), ("Toronto, ON, CA", "Toronto", "Ontario", "Canada", None, "Toronto, Ontario, Canada"), ("San Francisco, CA", "San Francisco", "California", "United States", None, "San Francisco, California, United States"),
    ("FR-Lyon", "Lyon", None, "France", None, "Lyon, France"), ("Hybrid, Berlin", "Berlin", None, "Germany", "hybrid", "Berlin, Germany"), ("CA", None, None, "Canada", None, "Canada"), ("", None, None, None, None, ""),
]


@query("location_parse", "SELECT c_custkey, " + ", ".join(_golden("c_custkey", _PLACES, (lambda k: lambda c: "NULL" if c[k] is None else f"'{c[k]}'")(k)) + f" AS {name}" for k, name in ((1, "city"), (2, "region"), (3, "country"), (4, "work_mode"), (5, "shown"))) + " FROM customer")
def location_parse(spark, sf):
    """LOC-01 to LOC-04."""
    c = table(spark, sf, "customer").select("c_custkey", _said(F.col("c_custkey"), _PLACES).alias("raw")).select("c_custkey", places.parse_location()("raw", F.lit(None).cast("boolean"), F.lit(None).cast("string")).alias("l"))
    return c.select("c_custkey", "l.city", "l.region", "l.country", "l.work_mode", places.display(F.col("l")).alias("shown"))


@query("digest_pack", """
WITH RECURSIVE l AS (SELECT conv_id || '/' || role AS recipient, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, length(text) AS n FROM conversations),
p(recipient, k, part, size) AS (SELECT recipient, k, 0, n FROM l WHERE k = 1 UNION ALL
  SELECT l.recipient, l.k, CASE WHEN p.size > 0 AND p.size + 1 + l.n > 1000 THEN p.part + 1 ELSE p.part END, CASE WHEN p.size > 0 AND p.size + 1 + l.n > 1000 THEN l.n WHEN p.size > 0 THEN p.size + 1 + l.n ELSE l.n END FROM p JOIN l ON l.recipient = p.recipient AND l.k = p.k + 1)
SELECT recipient, part::INTEGER AS part, max(size)::INTEGER AS size FROM p GROUP BY 1, 2""")
def digest_pack(spark, sf):
    """TOP-11, STR-13: a recipient's lines in parts."""
    c = table(spark, sf, "conversations").select(F.col("role").alias("role"), F.concat(F.col("conv_id").cast("string"), F.lit("/"), "role").alias("recipient"), F.col("turn").alias("ordinal"), F.col("text").alias("line"))
    return select.digest(c, 1000).select("recipient", "part", F.length("text").alias("size"))


@query("command_view", f"{_SCORED} SELECT id, title, score, tier FROM (SELECT doc_id AS id, title, score, tier FROM scored) WHERE tier = 'high' ORDER BY score DESC, id LIMIT 7")
def command_view(spark, sf):
    """VIEW-01, VIEW-17, UDX-06: a free text compiled to its view."""
    jobs = scored(spark, sf).select(F.col("doc_id").alias("id"), "title", F.lit("").alias("company"), F.lit("").alias("country"), "score", "tier", "reasons", now().alias("posted_at"), now().alias("last_seen"))
    return commands.run("show me the best 7", commands.Tables(jobs, commands.Preferences())).select("id", "title", "score", "tier")


# --------------------------------------------------------------- streaming
@query("stream_daily_volume", "SELECT ts::DATE AS day, event_type AS source, count(*) AS raw FROM events GROUP BY 1, 2")
def stream_daily_volume(spark, sf):
    """STA-05 as a stream run once, as schedules do (STA-15)."""
    s = pipelines.read_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return pipelines.collect_stream(pipelines.daily_volume(s, "ts", "event_type"), "complete")


@query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf):
    """STA-04 as a stream run once."""
    s = pipelines.read_events(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return pipelines.collect_stream(pipelines.first_seen(s, "user_id", "ts"), "append").select("user_id")


@query("stream_upsert", "SELECT user_id, floor(epoch(min(ts)))::BIGINT AS first_seen, floor(epoch(max(ts)))::BIGINT AS last_seen, count(*) AS sightings FROM events GROUP BY 1")
def stream_upsert(spark, sf):
    """STA-01 as micro-batches."""
    s = pipelines.read_events(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return pipelines.stream_upsert(s, "user_id", "ts").select("user_id", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"), "sightings")


__all__ = ["ORACLE_SQL", "QUERIES"]
