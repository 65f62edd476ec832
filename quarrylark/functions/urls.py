"""URL functions as Column -> Column (URL-01 to URL-03, FLT-11, EXT-11, EXT-12)."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylark.functions.text import column_udf

#: Query parameters that only track, and prefixes of such.
TRACKING = [
    "gh_src", "lever-source", "lever-origin", "source", "src", "ref", "referrer", "referer",
    "trk", "trackingid", "refid", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_hsenc",
    "_hsmi", "iis", "iisn", "ccuid", "jobpipeline", "sourcetype", "campaign", "medium",
    "share", "shared", "codes", "ashby_jid_source",
]
TRACKING_PREFIXES = ["utm_", "_ga", "hsa_", "pk_"]


def host_of(url: Column) -> Column:
    """Lower-case host without www. and port; empty if there is none (URL-02)."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


#: Suffixes of two labels under which registries sell names, by country.
PUBLIC_SUFFIXES = {
    "uk": ["co", "org", "me", "ltd", "plc", "net", "sch", "ac", "gov", "nhs", "police"], "au": ["com", "net", "org", "edu", "gov", "asn", "id"], "nz": ["co", "net", "org", "ac", "govt", "school", "iwi"],
    "jp": ["co", "ne", "or", "ac", "go", "ed"], "kr": ["co", "ne", "or", "ac", "go"], "in": ["co", "net", "org", "ac", "gov", "edu"], "za": ["co", "net", "org", "ac", "gov"], "br": ["com", "net", "org", "edu", "gov"],
    "mx": ["com", "net", "org", "edu", "gob"], "ar": ["com", "net", "org", "edu", "gob"], "cn": ["com", "net", "org", "ac", "edu", "gov"], "hk": ["com", "net", "org", "edu", "gov"], "tw": ["com", "net", "org", "edu", "gov"],
    "sg": ["com", "net", "org", "edu", "gov"], "my": ["com", "net", "org", "edu", "gov"], "th": ["co", "ac", "go", "or", "in"], "id": ["co", "or", "ac", "go", "web"], "ph": ["com", "net", "org", "edu", "gov"], "il": ["co", "org", "ac", "gov", "net"],
    "tr": ["com", "net", "org", "edu", "gov"], "ae": ["co", "net", "org", "ac", "gov"], "sa": ["com", "net", "org", "edu", "gov"], "qa": ["com", "net", "org", "edu", "gov"], "kw": ["com", "net", "org", "edu", "gov"], "eg": ["com", "net", "org", "edu", "gov"],
    "ma": ["co", "net", "org", "ac", "gov"], "ng": ["com", "net", "org", "edu", "gov"], "ke": ["co", "or", "ac", "go", "ne"], "pl": ["com", "net", "org", "edu", "gov"], "pt": ["com", "org", "edu", "gov"], "fr": ["gouv", "asso"], "at": ["co", "or", "ac", "gv"],
}


def registrable_domain(url: Column) -> Column:
    """The last two labels, three under a public suffix of two (URL-02)."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    suffixes = F.array(*[F.lit(f"{second}.{top}") for top, names in PUBLIC_SUFFIXES.items() for second in names])
    deep = (n >= 3) & F.array_contains(suffixes, F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."))
    take = F.least(n, F.when(deep, 3).otherwise(2))
    return F.array_join(F.slice(labels, n - take + 1, take), ".")


def _parameters(query: Column) -> Column:
    """name=value pairs that have a value and don't track, encoded one way, sorted."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(plain(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), plain(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    tracks = lambda k: F.lower(k).isin(TRACKING) | F.lower(k).rlike("^(?:" + "|".join(TRACKING_PREFIXES) + ")")
    kept = F.array_sort(F.filter(pairs, lambda p: (F.length(p["v"]) > 0) & ~tracks(p["k"])))
    return F.transform(kept, lambda p: F.concat_ws("=", F.url_encode(p["k"]), F.url_encode(p["v"])))


def canonical_url(url: Column) -> Column:
    """https, no www. or default port, single slashes, no trailing slash but
    the root's, no fragment, no tracking or empty parameters, sorted query with
    one encoding (URL-01). Text that is no http URL gives null."""
    rest = F.regexp_replace(F.trim(url), "#.*$", "")
    port = F.regexp_extract(F.lower(rest), r"^https?://(?:[^/?#@]*@)?[^/?#:]*(:[0-9]+)", 1)
    path = F.regexp_extract(rest, r"^[A-Za-z]+://[^/?#]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    kept = _parameters(F.regexp_extract(rest, r"\?(.*)$", 1))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    host = host_of(rest)
    whole = F.concat(F.lit("https://"), host, F.when(port.isin(":80", ":443"), "").otherwise(port), F.when(path == "", "/").otherwise(path), tail)
    return F.when(is_http_url(rest) & (F.length(host) > 0), whole)


def is_http_url(url: Column) -> Column:
    return F.lower(url).rlike("^https?://")


def is_aggregator(url: Column, domains: list[str]) -> Column:
    return registrable_domain(url).isin(domains)


#: Path words of pages that hold one posting.
JOB_PATH = r"/(?:jobs?|careers?|positions?|vacanc(?:y|ies)|openings?|emplois?|offres?|stellen)(?:[/?-]|$)"


def looks_like_job_url(url: Column) -> Column:
    return F.lower(url).rlike(JOB_PATH)


def _absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b, x):
        try:
            full = urljoin(b or "", (x or "").strip()).split("#")[0]
            return full if urlsplit(full).scheme in ("http", "https") else None
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def absolutize(base: Column, link: Column) -> Column:
    """Links resolved against their page, http only, without fragment (URL-03)."""
    return column_udf(_absolute, "string")(base, link)


_UUID = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_SLUG = "([A-Za-z0-9][A-Za-z0-9_.%-]*)"
_END = "(?=[/?#]|$)"
#: (platform, pattern of the URL after the scheme with the board in group 1 and
#: the posting, if any, in group 2, how its native id is written). Hosts and
#: paths are the platforms' public ones: pages first, then their interfaces.
PLATFORMS = [
    ("greenhouse", rf"^boards-api(?:\.[a-z]+)?\.greenhouse\.io/v1/boards/{_SLUG}(?:/jobs/([0-9]+){_END})?", "id"),
    ("greenhouse", rf"^[a-z0-9.-]*greenhouse\.io/(?!embed{_END}|v1/){_SLUG}(?:/jobs/([0-9]+){_END})?", "id"),
    ("lever", rf"^jobs(?:\.eu)?\.lever\.co/{_SLUG}(?:/({_UUID}){_END})?", "id"),
    ("lever", rf"^api(?:\.eu)?\.lever\.co/v0/postings/{_SLUG}(?:/({_UUID}){_END})?", "id"),
    ("ashby", rf"^jobs\.ashbyhq\.com/{_SLUG}(?:/({_UUID}){_END})?", "id"),
    ("ashby", rf"^api\.ashbyhq\.com/posting-api/job-board/{_SLUG}()", "id"),
    ("smartrecruiters", rf"^(?:jobs|careers)\.smartrecruiters\.com/{_SLUG}(?:/([0-9]{{6,}}))?", "id"),
    ("smartrecruiters", rf"^api\.smartrecruiters\.com/v1/companies/{_SLUG}(?:/postings/([0-9]+){_END})?", "id"),
    ("workable", rf"^apply\.workable\.com/api/[^/]+/[^/]+/accounts/{_SLUG}()", "upper"),
    ("workable", rf"^apply\.workable\.com/(?!api/){_SLUG}(?:/j/([0-9A-Za-z]{{6,12}}){_END})?", "upper"),
    ("recruitee", r"^([a-z0-9-]+)\.recruitee\.com(?:/o/([^/?#]+))?", "slug"),
    ("personio", rf"^([a-z0-9-]+)\.jobs\.personio\.(?:de|com)(?:/job/([0-9]+){_END})?", "slug"),
    ("workday", r"^([a-z0-9-]+)\.wd[0-9]+\.myworkdayjobs\.com(?:/[^?#]*/job/[^?#]*_([A-Za-z0-9-]*[0-9][A-Za-z0-9-]*)/?(?=[?#]|$))?", "slug_upper"),
    ("oracle", rf"^([a-z0-9-]+\.fa\.[a-z0-9-]+)\.oraclecloud\.com(?:/[^?#]*/(?:job|preview)/([A-Za-z0-9_.-]+){_END})?", "oracle"),
]


def _native(ats: str, slug: Column, native: Column, kind: str) -> Column:
    """ats:id, or ats:board:id where ids are unique on a board only."""
    tenant = F.regexp_replace(slug, r"\.fa\.", ".")
    value = {"id": F.concat_ws(":", F.lit(ats), F.lower(native)), "upper": F.concat_ws(":", F.lit(ats), F.upper(native)), "slug": F.concat_ws(":", F.lit(ats), slug, F.lower(native)), "slug_upper": F.concat_ws(":", F.lit(ats), slug, F.upper(native)), "oracle": F.concat_ws(":", F.lit(ats), tenant, native)}[kind]
    return F.when(F.length(native) > 0, value)


def detect_board(url: Column, platforms=PLATFORMS) -> Column:
    """STRUCT<ats, slug, native_id> of a posting or board URL (EXT-11, EXT-12);
    null for other URLs. slug is lower case. Embedded boards name board and
    posting in the query; on an employer's own page, gh_jid is the posting and
    the board is null."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z]+://(?:www\.)?", "")
    rest = F.concat(F.lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*(.*)$", 1))
    board = lambda ats, slug, native: F.struct(F.lit(ats).alias("ats"), slug.alias("slug"), native.alias("native_id"))
    asked = lambda name, kind: F.nullif(F.regexp_extract(rest, rf"[?&]{name}=({kind})(?:[&#]|$)", 1), F.lit(""))
    posting, token = asked("gh_jid", "[0-9]+"), asked("token", "[0-9]+")
    out = F.when(rest.rlike(rf"^[a-z0-9.-]*greenhouse\.io/embed{_END}"), board("greenhouse", F.lower(asked("for", "[A-Za-z0-9_-]+")), F.concat(F.lit("greenhouse:"), F.coalesce(token, posting))))
    for ats, pattern, kind in platforms:
        slug, native = F.lower(F.regexp_extract(rest, pattern, 1)), F.regexp_extract(rest, pattern, 2)
        value = _native(ats, slug, native, kind)
        if ats == "greenhouse":
            value = F.coalesce(value, F.concat(F.lit("greenhouse:"), posting))
        out = out.when(rest.rlike(pattern), board(ats, slug, value))
    return out.when(posting.isNotNull(), board("greenhouse", F.lit(None).cast("string"), F.concat(F.lit("greenhouse:"), posting)))


def workday_parts(url: Column) -> Column:
    """STRUCT<tenant, host, site, path> of a Workday URL (EXT-12)."""
    pattern = r"^https?://([a-z0-9-]+)\.(wd[0-9]+)\.myworkdayjobs\.com/(?:[a-z]{2}-[A-Z]{2}/)?([^/?#]+)(/[^?#]*)?"
    return F.when(url.rlike(pattern), F.struct(*[F.regexp_extract(url, pattern, k + 1).alias(n) for k, n in enumerate(["tenant", "host", "site", "path"])]))


def boards_in_text(text: Column, limit: int = 50) -> Column:
    """Distinct boards named in a text, the first `limit` (EXT-10)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>)]+)"), 1), lambda u: detect_board(F.regexp_replace(u, "[.,;:!?]+$", "")))
    boards = F.transform(F.filter(found, lambda b: b["slug"].isNotNull()), lambda b: F.concat_ws(":", b["ats"], b["slug"]))
    return F.slice(F.array_distinct(boards), 1, limit)
