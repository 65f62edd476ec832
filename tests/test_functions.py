"""Golden rows of the scalar functions."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylark.functions import dates, money, places, text, urls

TODAY = dt.date(2026, 9, 16)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or ("",)], [*values] or ["x"]) if None not in values.values() else spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("r")).first().r


def many(spark, f, said, kind="string"):
    df = spark.createDataFrame(list(enumerate(said)), f"k long, x {kind}")
    return [r.r for r in df.select("k", f(F.col("x")).alias("r")).orderBy("k").collect()]


def test_fold(spark):
    said = ["  Élan\tÉTÉ ", None, "", "ÀÇñ ß", "Ŵ ő"]
    assert many(spark, text.fold, said) == ["elan ete", None, "", "acn ß", "w o"]
    assert many(spark, text.fold_exact, ["ﬁne ½ É", None]) == ["fine 1⁄2 e", None]


def test_names(spark):
    assert many(spark, text.normalize_company, ["Acme, Inc.", "ACME GmbH & Co. KG", "É.D.F. SA", "", None, "The Co"]) == ["acme", "acme", "edf", "", None, "the"]
    assert many(spark, text.normalize_title, ["GIS Engineer (m/f/d)", "C++ / C# Dev", "Analyst – Senior"]) == ["gis engineer", "c++ / c# dev", "analyst senior"]
    assert many(spark, text.core_name, ["The Acme Group Ltd", "Services Group"]) == ["acme", ""]
    assert many(spark, text.slug_candidates, ["Blue Sky Maps Ltd"]) == [["blueskymaps", "blue-sky-maps", "blue"]]
    assert many(spark, text.job_code, ["x"]) == ["11f6a"]
    assert many(spark, lambda c: text.truncate(c, 5), ["abcdef", "abc", "abc def"]) == ["abcd…", "abc", "abc…"]
    assert many(spark, text.prettify_slug, ["blue-sky_maps"]) == ["Blue Sky Maps"]


def test_patterns(spark):
    p = text.phrase_pattern("remote sensing")
    assert many(spark, lambda c: c.rlike(p), ["remote sensing", "remote and active sensing", "remotes sensing", "remote a b c sensing"]) == [True, True, False, False]
    assert many(spark, lambda c: text.has_word(c, "gis"), ["gis", "a gis-b", "gist", "logis"]) == [True, True, False, False]
    assert many(spark, text.arabic_plain, ["أَحمد"]) == ["احمد"] and many(spark, text.has_arabic, ["abc", "نظم"]) == [False, True]
    df = spark.createDataFrame([("One. Two here! Three", 6)], "t string, k int")
    assert df.select(text.sentence_around(F.col("t"), F.col("k"))).first()[0] == "Two here"
    assert text.closest_word("sponser", ["sponsor", "search"]) == "sponsor" and text.closest_word("zebra", ["sponsor"]) is None
    assert many(spark, text.guess_language, ["the cat and the dog", "der Hund und die Katze", "qqq", None]) == ["en", "de", None, None]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab\n ", max_size=200), st.integers(5, 40))
def test_split_message(body, limit):
    parts = text.split_message(body, limit)
    assert all(len(p) <= limit for p in parts)
    assert "".join("".join(parts).split()) == "".join(body.split())


def test_repair_entities():
    from xml.etree import ElementTree

    fixed = text.repair_entities("<a>R&D &eacute; &amp; &nope; &#233;</a>")
    assert ElementTree.fromstring(fixed).text == "R&D é & &nope; é"


def test_urls(spark):
    said = ["HTTP://www.Example.com:80//a//b/?utm_source=x&b=2&a=1#top", "https://x.co.uk/", "ftp://x.com/a", "nonsense", None, "https://a.com?ref=1", "https://a.com:8443/x", "https://a.com/?utm_x=1&pk_c=2&q=a%20b&p=a+b&empty=&flag", "https://a.com/x?q=%zz"]
    assert many(spark, urls.canonical_url, said) == ["https://example.com/a/b?a=1&b=2", "https://x.co.uk/", None, None, None, "https://a.com/", "https://a.com:8443/x", "https://a.com/?p=a+b&q=a+b", "https://a.com/x?q=%25zz"]
    assert many(spark, urls.registrable_domain, ["https://jobs.x.co.uk/a", "https://www.a.b.com", "https://b.com"]) == ["x.co.uk", "b.com", "b.com"]
    df = spark.createDataFrame([("https://a.com/b/c", "../d#x"), ("https://a.com", "mailto:x"), (None, None)], "b string, x string")
    assert [r.r for r in df.select(urls.absolutize(F.col("b"), F.col("x")).alias("r")).collect()] == ["https://a.com/d", None, None]


_ID = "0123abcd-0123-0123-0123-0123456789ab"
BOARDS = [
    ("https://boards.greenhouse.io/Acme/jobs/123", ("greenhouse", "acme", "greenhouse:123")), ("https://job-boards.eu.greenhouse.io/acme", ("greenhouse", "acme", None)), ("https://boards-api.greenhouse.io/v1/boards/acme/jobs/123?x=1", ("greenhouse", "acme", "greenhouse:123")),
    ("https://boards.greenhouse.io/embed/job_app?for=acme&token=123", ("greenhouse", "acme", "greenhouse:123")), ("https://boards.greenhouse.io/embed/job_app?token=5&for=Acme", ("greenhouse", "acme", "greenhouse:5")), ("https://boards.greenhouse.io/embed/job_board?for=acme", ("greenhouse", "acme", None)),
    ("https://www.acme.com/careers?gh_jid=123", ("greenhouse", None, "greenhouse:123")), ("https://acme.com/careers?gh_jid=12x", None), ("https://boards.greenhouse.io/acme?gh_jid=7", ("greenhouse", "acme", "greenhouse:7")),
    ("https://jobs.lever.co/acme", ("lever", "acme", None)), (f"https://jobs.eu.lever.co/Acme/{_ID.upper()}/apply", ("lever", "acme", f"lever:{_ID}")), (f"https://api.lever.co/v0/postings/acme/{_ID}", ("lever", "acme", f"lever:{_ID}")),
    (f"https://jobs.ashbyhq.com/acme/{_ID}", ("ashby", "acme", f"ashby:{_ID}")), ("https://api.ashbyhq.com/posting-api/job-board/acme", ("ashby", "acme", None)),
    ("https://jobs.smartrecruiters.com/Acme/744000", ("smartrecruiters", "acme", "smartrecruiters:744000")), ("https://api.smartrecruiters.com/v1/companies/acme/postings/744000", ("smartrecruiters", "acme", "smartrecruiters:744000")),
    ("https://apply.workable.com/acme/j/ab12cd", ("workable", "acme", "workable:AB12CD")), ("https://apply.workable.com/api/v1/widget/accounts/acme", ("workable", "acme", None)),
    ("https://acme.recruitee.com/o/dev", ("recruitee", "acme", "recruitee:acme:dev")), ("https://acme.jobs.personio.de/job/9", ("personio", "acme", "personio:acme:9")), ("https://acme.jobs.personio.com", ("personio", "acme", None)),
    ("https://acme.wd3.myworkdayjobs.com/en-US/Site/job/X/Dev_R-1", ("workday", "acme", "workday:acme:R-1")), ("https://acme.wd3.myworkdayjobs.com/Site/job/Paris/Data-Lead_jr_0042-1/", ("workday", "acme", "workday:acme:0042-1")), ("https://acme.wd3.myworkdayjobs.com/Site", ("workday", "acme", None)),
    ("https://acme.fa.em2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX/job/77", ("oracle", "acme.fa.em2", "oracle:acme.em2:77")), ("https://acme.fa.em2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX", ("oracle", "acme.fa.em2", None)),
    ("https://example.com/jobs/1", None),
]


def test_boards(spark):
    assert [tuple(b) if b else None for b in many(spark, urls.detect_board, [u for u, _ in BOARDS])] == [b for _, b in BOARDS]
    assert many(spark, urls.boards_in_text, ["see https://jobs.lever.co/acme and https://jobs.lever.co/acme, (https://acme.recruitee.com)"]) == [["lever:acme", "recruitee:acme"]]
    assert many(spark, urls.workday_parts, ["https://acme.wd3.myworkdayjobs.com/en-US/Site/job/x"])[0].site == "Site"


def test_datetimes(spark):
    said = ["2026-09-16T12:00:00Z", "2026-09-16T12:00:00.123+02:00", "1757937600", "1757937600000", "16 September 2026", "Wed, 16 Sep 2026 12:00:00 +0000", "16.09.2026", "no", None]
    got = many(spark, lambda c: dates.to_iso(dates.parse_datetime(c)), said)
    assert got == ["2026-09-16T12:00:00Z", "2026-09-16T10:00:00Z", "2025-09-15T12:00:00Z", "2025-09-15T12:00:00Z", "2026-09-16T00:00:00Z", "2026-09-16T12:00:00Z", "2026-09-16T00:00:00Z", None, None]
    assert many(spark, dates.french_date, ["le 1er août 2026", "3 mars 2026", "x"]) == [dt.date(2026, 8, 1), dt.date(2026, 3, 3), None]
    assert many(spark, dates.days_window, [1, 24, 25, 0], "int") == [1, 1, 2, 1]


DEADLINES = [
    ("Application deadline: 30 September 2026.", dt.date(2026, 9, 30)), ("Apply by Oct 5, 2026", dt.date(2026, 10, 5)), ("Bewerbungsfrist: 15.10.2026", dt.date(2026, 10, 15)), ("Bewerbungsfrist: 01.10.2026", None), ("Date limite : 12 octobre 2026", dt.date(2026, 10, 12)),
    ("Closing date 2026-10-01", dt.date(2026, 10, 1)), ("Posted 30 September 2026.", None), ("Deadline. Start date 1 October 2026", None), ("Deadline: 1 October 2030", None), ("", None), (None, None), ("applications close 9/25/2026", dt.date(2026, 9, 25)),
]


@pytest.mark.parametrize("said,expected", DEADLINES)
def test_deadlines(said, expected):
    assert dates.deadline_in(said, TODAY) == expected


#: (text, country, deadline as of 20 September 2026)
MORE_DEADLINES = [
    ("Closing date: 4 March", "United Kingdom", dt.date(2027, 3, 4)), ("Apply by 14 September", None, dt.date(2026, 9, 14)), ("Applications must be received by 1st of October 2026", None, dt.date(2026, 10, 1)), ("Send your CV before October 3", None, dt.date(2026, 10, 3)),
    ("This position is open until 5 October 2026", None, dt.date(2026, 10, 5)), ("The shop closes on 5 October 2026", None, None), ("Dossier de candidature au plus tard le 3 novembre 2026", "France", dt.date(2026, 11, 3)), ("Contrat jusqu'au 3 novembre 2026", "France", None),
    ("Closing date: 03/11/2026", "United States", None), ("Closing date: 03/11/2026", "United Kingdom", dt.date(2026, 11, 3)), ("Closing date: 10/08/2026", "Canada", None), ("Deadline:\n\u2022 12 Oct", None, dt.date(2026, 10, 12)), ("Deadline: at 12 noon on 12 October", None, dt.date(2026, 10, 12)),
    ("The vacancy shuts soon. Published 2 September 2026", None, None), ("Closing date: until filled, updated 02/09/2026", None, None), ("Apply by post; we begin on 1 October 2026", None, None), ("Remplacement CDD jusqu'au 30/09/2026", "France", None), ("The survey ends on 30 September 2026", None, None),
    ("Your application will be reviewed by 3 October 2026", None, None), ("Applications close at noon on 3 October 2026", None, dt.date(2026, 10, 3)), ("About us.\nCloses: 3 Oct 2026", None, dt.date(2026, 10, 3)), ("Job posting end date: Oct. 3, 2026", None, dt.date(2026, 10, 3)), ("Contract end date: 3 October 2026", None, None),
    ("Candidatures acceptées jusqu'au 2 octobre 2026", "France", dt.date(2026, 10, 2)), ("Bewerbungen bitte bis 30. September 2026", "Germany", dt.date(2026, 9, 30)), ("Closing date: 12/11/2026", "Canada", dt.date(2026, 11, 12)), ("Closing date: 12/11/2026", "Poland", dt.date(2026, 11, 12)), ("Closing date 2026/10/02", None, dt.date(2026, 10, 2)),
    ("Deadline: 31 February 2027", None, None), ("Closing date: see website. Interviews 12 October 2026", None, None),
]


@pytest.mark.parametrize("said,country,expected", MORE_DEADLINES)
def test_deadlines_by_place_and_subject(said, country, expected):
    assert dates.deadline_in(said, dt.date(2026, 9, 20), country) == expected


def test_ambiguous_dates():
    assert dates.resolve_numeric(3, 4, 2026, "France", TODAY) == dt.date(2026, 4, 3) and dates.resolve_numeric(3, 4, 2026, "US", TODAY) == dt.date(2026, 3, 4)
    assert dates.resolve_numeric(10, 9, 2026, None, TODAY) is None and dates.resolve_numeric(31, 12, 2026, None, TODAY) == dt.date(2026, 12, 31)


SALARIES = [
    ("€50k - 60k", None, (50000, 60000, "EUR", "year")), ("$25/hour", None, (25, 25, "USD", "hour")), ("£400 per day", None, (400, 400, "GBP", "day")), ("up to 70,000 EUR", None, (None, 70000, "EUR", "year")), ("3000 EUR monthly", None, (3000, 3000, "EUR", "month")),
    ("C$90 000 a year", None, (90000, 90000, "CAD", "year")), ("competitive", None, None), ("2500 chf", None, (2500, 2500, "CHF", "month")), ("45.000 - 55.000 EUR", None, (45000, 55000, "EUR", "year")), ("40000 academic year", None, None), ("40000 academic year", "France", (40000, 40000, "EUR", "year")),
    ("£31,250.50 per annum", None, (31250, 31250, "GBP", "year")), ("45-55k EUR", None, (45000, 55000, "EUR", "year")), ("$90,000", "Canada", (90000, 90000, "CAD", "year")), ("$90,000", "France", (90000, 90000, "USD", "year")), ("€240 an hour", None, (240, 240, "EUR", "hour")), ("EUR 240", None, (240, 240, "EUR", "hour")),
    ("€40k plus 10% bonus, 37-hour week, 25 days leave", None, (40000, 40000, "EUR", "year")), ("2 800 € sur 13 mois", None, (2800, 2800, "EUR", "month")), ("AED 25,000", None, (25000, 25000, "AED", "month")), ("€3 a year", None, None), ("EUR 9,000,000 per year", None, None), ("CHF 120'000 - 130'000", None, (120000, 130000, "CHF", "year")),
    ("$120k 401(k) match", None, (120000, 120000, "USD", "year")), ("A$100,000 + 11.5% super", None, (100000, 100000, "AUD", "year")), ("max. 60k€", None, (None, 60000, "EUR", "year")), ("jusqu'à 45 k€ /an", None, (None, 45000, "EUR", "year")), ("€3.500,75 pro Monat x 13", None, (3500, 3500, "EUR", "month")), ("GBP 12.75/h for 20 hours a week", None, (12.75, 12.75, "GBP", "hour")), ("", None, None), (None, "France", None),
    ("Salaire : 38 000 à 42 000 € par an, payé par mois", None, (38000, 42000, "EUR", "year")), ("15,50 € de l'heure", None, (15.5, 15.5, "EUR", "hour")),
]


def test_salaries(spark):
    df = spark.createDataFrame([(k, s, c) for k, (s, c, _) in enumerate(SALARIES)], "k int, t string, c string")
    got = [r.s for r in df.select("k", money.parse_salary(F.col("t"), F.col("c")).alias("s")).orderBy("k").collect()]
    assert [tuple(g) if g else None for g in got] == [e for _, _, e in SALARIES]
    assert many(spark, lambda c: money.per_year(F.lit(100.0), c, F.lit("Netherlands")), ["month", "year", "day"]) == [1296.0, 100.0, 26000.0]
    assert many(spark, lambda c: money.in_euros(F.lit(5.0), c), [2.0, 0.0, None], "double") == [2.0, None, None]


def test_coverage(spark):
    rows = [(0, 0, True), (0, 0, False), (0, 5, True), (25, 0, True), (10, 10, True), (5, 15, False)]
    df = spark.createDataFrame(rows, "h int, l int, d boolean")
    assert [r[0] for r in df.select(money.coverage_points(F.col("h"), F.col("l"), F.col("d"))).collect()] == [round(x) for x in (6, 0, 0, 25, 25 * 0.5 * 0.8, 25 * 0.25 * 0.6)]


PLACES = [
    ("Paris, France", ("Paris", None, "France", None)), ("San Francisco, CA", ("San Francisco", "California", "United States", None)), ("Toronto, ON, CA", ("Toronto", "Ontario", "Canada", None)),
    ("FR-Lyon", ("Lyon", None, "France", None)), ("Remote - Germany", (None, None, "Germany", "remote")), ("Hybrid, Berlin", ("Berlin", None, "Germany", "hybrid")), ("", (None, None, None, None)), ("CA", (None, None, "Canada", None)),
]


@pytest.mark.parametrize("said,expected", PLACES)
def test_places(said, expected):
    p = places.parse_location_text(said, None, None)
    assert (p["city"], p["region"], p["country"], p["work_mode"]) == expected


def test_place_columns(spark):
    df = spark.createDataFrame([("Remote - Germany",), ("Paris, France",), (None,)], "raw string")
    rows = df.select(places.parse_location()("raw", F.lit(None).cast("boolean"), F.lit(None).cast("string")).alias("l")).select(places.display(F.col("l")).alias("d"), "l.remote_scope").collect()
    assert [tuple(r) for r in rows] == [("Remote, Germany", "Germany"), ("Paris, France", None), ("", None)]
    assert many(spark, places.work_mode, ["Hybrid remote", "remote", "on-site", "x"]) == ["hybrid", "remote", "onsite", None]
    assert many(spark, places.scope_from_text, ["Anywhere", "EMEA only", "x"]) == ["worldwide", "europe", None]


def test_language_guess_takes_a_text_apart_once(spark):
    """Each language had folded and split the text anew."""
    said = [None, "", "12 ...", "Que", "the que el los", "Der Hund und die Katze", "LE chat ÉST dans l'eau", "zebra"]
    df = spark.createDataFrame(list(enumerate(said)), "id long, s string").select("id", text.guess_language(F.col("s")).alias("k"))
    assert [r.k for r in df.orderBy("id").collect()] == [None, None, None, "es", "es", "de", "fr", None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == plan.count("translate(") == 1


@pytest.mark.parametrize("end", ["jañ", "at the mar", "jañ,", "ends in may", "the year 12 of sept"])
def test_a_sentence_may_end_in_the_name_of_a_month(end):
    """The point was taken for that of an abbreviation, so the next sentence
    was none of its own."""
    assert dates.deadline_in(f"Words {end}. Closes: 4 Mar 2024", dt.date(2024, 1, 31)) == dt.date(2024, 3, 4)
    assert dates.deadline_in(f"Apply {end}. Our office closes on 24 February", dt.date(2024, 1, 31)) is None


def test_points_between_day_and_month_end_no_clause():
    for said in ("apply by 4. Mar. 2024", "apply by Mar. 4, 2024", "Apply before the 4 mar. 2024 please"):
        assert dates.deadline_in(said, dt.date(2024, 1, 31)) == dt.date(2024, 3, 4), said


def test_deadline_find_beside_a_text_that_ends_in_a_month(spark, tmp_path):
    from quarrylark.plans import catalog

    spark.createDataFrame([(k, "Words does jañ" + "." * (k > 15)) for k in range(32)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.deadline for r in catalog.QUERIES["deadline_find"](spark, str(tmp_path)).collect()}
    assert got == {k: (d := catalog._DEADLINES[k % 16][2]) and dt.date.fromisoformat(d) for k in range(32)}


@given(st.text(alphabet="aZéİ́ﬁ…．’'nt.;<>\n 09/-", max_size=40))
@settings(max_examples=300, deadline=None)
def test_plain_is_its_definition(said):
    import unicodedata

    from quarrylark.functions.clauses import plain

    bare = "".join(c for c in unicodedata.normalize("NFKD", said) if not unicodedata.combining(c)).lower()
    assert plain(said) == bare.replace("’", "'").replace("n't", " not").replace("cannot", "can not")


def test_says_any(spark):
    from quarrylark.functions.clauses import says_any

    assert many(spark, lambda c: says_any(c, ["visa", "from any"]), [None, "", "a VISA", "From Any place", "from  any", "revision"]) == [False, False, True, True, False, False]
