"""Extraction from landed pages (EXT-01 to EXT-09, EXT-13, EXT-15, EXT-16,
EXT-17, EXT-19, FLT-20). Parsers are pure functions over one page; Arrow
batches carry them (UDX-03)."""

from __future__ import annotations

import email
import email.policy
import html as htmllib
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.session import bounded_batches

_SKIP = {"script", "style", "noscript", "template"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "header", "footer"}


def page_title(page: Column) -> Column:
    """The first h1, else the title, without tags (part of EXT-05)."""
    h1 = F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return unescape(F.trim(F.regexp_replace(F.regexp_replace(F.when(F.length(h1) > 0, h1).otherwise(title), r"<[^>]*>", " "), r"\s+", " ")))


def unescape(text: Column) -> Column:
    """The five entities of XML, and no-break spaces; &amp; last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_text(page: Column) -> Column:
    """Text of a page with built-in functions (EXT-07): no scripts, styles or
    comments; block ends break lines; white space is tidied."""
    t = F.regexp_replace(page, r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer)\b|br)[^>]*>", "\n")
    t = unescape(F.regexp_replace(t, r"<[^>]*>", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def page_links(page: Column, limit: int = 400) -> Column:
    """Distinct href values in order, without fragments, the first `limit`
    (EXT-06)."""
    found = F.regexp_extract_all(page, F.lit(r"""(?i)<a\b[^>]*?\bhref=["']([^"'#]+)"""), 1)
    return F.slice(F.array_distinct(found), 1, limit)


def sitemap_entries(body: Column) -> Column:
    """ARRAY<STRUCT<kind, loc, lastmod>> of a sitemap or index (EXT-13)."""
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)(<(?:url|sitemap)>.*?</(?:url|sitemap)>)"), 1)
    one = lambda b: F.struct(F.regexp_extract(b, r"<(url|sitemap)>", 1).alias("kind"), unescape(F.trim(F.regexp_extract(b, r"(?is)<loc>(.*?)</loc>", 1))).alias("loc"), F.nullif(F.trim(F.regexp_extract(b, r"(?is)<lastmod>(.*?)</lastmod>", 1)), F.lit("")).alias("lastmod"))
    return F.filter(F.transform(blocks, one), lambda e: F.length(e["loc"]) > 0)


def split_header(line: Column) -> Column:
    """STRUCT<company, role, location> of `Company | Role | Location` (EXT-16,
    SRC-16); null with fewer than two parts."""
    parts = F.filter(F.transform(F.split(line, r"\|"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    role = F.get(F.filter(F.slice(parts, 2, 20), lambda p: p.rlike(r"(?i)engineer|developer|analyst|manager|scientist|designer|lead")), F.lit(0))
    place = F.get(F.filter(F.slice(parts, 2, 20), lambda p: p.rlike(r"(?i)remote|onsite|hybrid|,")), F.lit(0))
    return F.when(F.size(parts) >= 2, F.struct(F.get(parts, F.lit(0)).alias("company"), F.coalesce(role, F.get(parts, F.lit(1))).alias("role"), place.alias("location")))


def place_from_title(title: Column) -> Column:
    """STRUCT<city, department> of `… - City (75)` (EXT-17)."""
    pattern = r"[-–(] ?([A-ZÀ-Ý][A-Za-zÀ-ÿ' -]+?) ?\(([0-9]{2,3}|2[AB])\)"
    return F.when(title.rlike(pattern), F.struct(F.regexp_extract(title, pattern, 1).alias("city"), F.regexp_extract(title, pattern, 2).alias("department")))


def salary_text(low: Column, high: Column, currency: Column, unit: Column) -> Column:
    """EXT-08."""
    bounds = F.concat_ws("-", low, F.when(~high.eqNullSafe(low), high))
    return F.nullif(F.concat_ws(" ", currency, F.nullif(bounds, F.lit("")), F.when(unit.isNotNull(), F.concat(F.lit("per "), F.lower(unit)))), F.lit(""))


def address_text(street: Column, city: Column, region: Column, country: Column) -> Column:
    """EXT-09: without the street if there is a city."""
    return F.concat_ws(", ", F.when(city.isNull(), street), city, region, country)


class _Tree(HTMLParser):
    """The text, title, links, JSON scripts and attributed elements of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.scripts, self.links, self.props, self.meta = [], [], [], [], {}
        self.skip, self.script_kind, self.h1, self.in_h1, self.container = 0, None, [], False, {}
        self.stack: list[tuple[str, str | None]] = []
        self.link: str | None = None
        self.link_text: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "script":
            self.script_kind = (a.get("type") or "", a.get("id") or "")
            self.scripts.append([self.script_kind, ""])
        if tag in _SKIP:
            self.skip += 1
        if tag in _BLOCK:
            self.text.append("\n")
        if tag == "h1":
            self.in_h1 = True
        if tag == "meta" and (a.get("property") or a.get("name")):
            self.meta[(a.get("property") or a.get("name")).lower()] = a.get("content") or ""
        if tag == "a" and a.get("href"):
            self.link, self.link_text = a["href"], []
        if a.get("property") and tag != "meta" or a.get("itemprop"):
            self.props.append([(a.get("property") or a.get("itemprop")).split(":")[-1], a.get("content") or a.get("datetime") or "", len(self.stack), not (a.get("content") or a.get("datetime"))])
        if tag not in ("br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "param", "track", "wbr"):
            self.stack.append((tag, None))

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skip:
            self.skip -= 1
        if tag == "script":
            self.script_kind = None
        if tag in _BLOCK:
            self.text.append("\n")
        if tag == "h1":
            self.in_h1 = False
        if tag == "a" and self.link:
            self.links.append((self.link, " ".join("".join(self.link_text).split())))
            self.link = None
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break
        for p in self.props[-8:]:
            p[3] = p[3] and len(self.stack) > p[2]

    def handle_data(self, data):
        if self.script_kind is not None and self.scripts:
            self.scripts[-1][1] += data
        if self.skip:
            return
        self.text.append(data)
        if self.in_h1:
            self.h1.append(data)
        if self.link is not None:
            self.link_text.append(data)
        for p in self.props[-8:]:
            if p[3]:
                p[1] += data


def tidy(text: str) -> str:
    text = re.sub(r"[ \t\r\f\v]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text)).strip()


def html_to_text(value: str | None) -> str:
    """EXT-07, exactly."""
    t = _Tree()
    t.feed(htmllib.unescape(value) if value and "&lt;" in value and "<" not in value else value or "")
    t.close()
    return tidy("".join(t.text))


def repair_json(text: str):
    """JSON with comments or trailing commas; None if it stays broken (ARR-05)."""
    for fix in (lambda x: x, lambda x: re.sub(r",\s*([}\]])", r"\1", re.sub(r"/\*.*?\*/|^\s*//[^\n]*", "", x, flags=re.S | re.M))):
        try:
            return json.loads(fix(text.strip().removeprefix("<!--").removesuffix("-->")), strict=False)
        except ValueError:
            continue
    return None


def walk(node, depth: int = 12, budget: int = 20_000) -> Iterator[dict]:
    """All dicts of a nested value, parents first, to a depth and a number."""
    todo, seen = [(node, 0)], 0
    while todo and seen < budget:
        x, d = todo.pop()
        seen += 1
        if isinstance(x, dict):
            yield x
        if d < depth:
            todo += [(v, d + 1) for v in reversed(list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else [])]


def _one(x):
    return x[0] if isinstance(x, list) and x else None if isinstance(x, list) else x


def _name(x) -> str | None:
    x = _one(x)
    return x.get("name") if isinstance(x, dict) else x


def jsonld_postings(t: _Tree, url: str, today: str) -> list[dict]:
    """JobPosting objects that have not expired (EXT-02)."""
    out = []
    for (kind, _), body in t.scripts:
        if "ld+json" not in kind:
            continue
        for d in walk(repair_json(body)):
            types = d.get("@type") if isinstance(d.get("@type"), list) else [d.get("@type")]
            if "JobPosting" not in types or not d.get("title") or str(d.get("validThrough") or "9999")[:10] < today:
                continue
            address = _one(d.get("jobLocation")) or {}
            address = address.get("address", address) if isinstance(address, dict) else address
            place = ", ".join(str(v) for k in ("addressLocality", "addressRegion", "addressCountry") if (v := _name(address.get(k)))) if isinstance(address, dict) else str(address or "")
            pay = _one(d.get("baseSalary")) or {}
            value = pay.get("value", {}) if isinstance(pay, dict) else {}
            amount = value if not isinstance(value, dict) else value.get("value") or "-".join(str(value[k]) for k in ("minValue", "maxValue") if value.get(k))
            out.append({"title": str(d["title"]), "company": _name(d.get("hiringOrganization")), "location": place or None, "remote": True if "TELECOMMUTE" in str(d.get("jobLocationType")) else None, "description": html_to_text(str(d.get("description") or "")), "salary": f"{pay.get('currency', '')} {amount}".strip() if amount else None, "posted": str(d.get("datePosted") or "") or None, "url": urljoin(url, _one(d.get("url")) or url), "method": "jsonld"})
    return out


def rdfa_postings(t: _Tree, url: str, today: str) -> list[dict]:
    """EXT-03."""
    found: dict[str, str] = {}
    for k, v, _, _ in t.props:
        found.setdefault(k, tidy(v))
    if not found.get("title") or not (found.get("description") or found.get("hiringOrganization")):
        return []
    return [{"title": found["title"], "company": found.get("hiringOrganization") or found.get("name"), "location": found.get("jobLocation") or found.get("addressLocality"), "remote": None, "description": found.get("description", ""), "salary": found.get("baseSalary"), "posted": found.get("datePosted"), "url": url, "method": "rdfa"}]


def embedded_postings(t: _Tree, url: str, today: str) -> list[dict]:
    """Objects with a title and a description over 200 characters in a page's
    JSON; of several the one that the page's title names (EXT-04)."""
    title, found = tidy("".join(t.h1)), []
    for (kind, ident), body in t.scripts:
        if ("json" not in kind and ident != "__NEXT_DATA__") or "ld+json" in kind:
            continue
        for d in walk(repair_json(body)):
            name = d.get("title") or d.get("jobTitle")
            text = d.get("description") or d.get("content") or d.get("jobDescription")
            if isinstance(name, str) and isinstance(text, str) and len(text) > 200:
                found.append({"title": name, "company": _name(d.get("company") or d.get("organization")), "location": _name(d.get("location")), "remote": None, "description": html_to_text(text), "salary": None, "posted": d.get("datePosted") or d.get("publishedAt"), "url": url, "method": "embedded_json"})
    return found if len(found) < 2 else [f for f in found if title and f["title"].lower() in title.lower()]


JOB_WORDS = re.compile(r"\b(?:responsibilities|requirements|apply|experience|qualifications|salary|we offer|candidature|missions|profil|aufgaben)\b", re.I)


def html_postings(t: _Tree, url: str, today: str) -> list[dict]:
    """The last resort (EXT-05): a title, a long text with job words, and an
    address like a posting's."""
    title, text = tidy("".join(t.h1)) or t.meta.get("og:title", ""), tidy("".join(t.text))
    if not title or len(text) < 300 or not JOB_WORDS.search(text) or not re.search(r"/(?:jobs?|careers?|positions?|vacanc|openings?|emplois?|offres?|stellen)", url or "", re.I):
        return []
    return [{"title": title, "company": t.meta.get("og:site_name"), "location": None, "remote": None, "description": text, "salary": None, "posted": None, "url": url, "method": "html"}]


#: Own extractors by host pattern; register_site_adapter adds to it (UDX-03).
SITE_ADAPTERS: list[tuple[re.Pattern, Callable[[_Tree, str, str], list[dict]]]] = []
LADDER = [jsonld_postings, rdfa_postings, embedded_postings, html_postings]
POSTING = "title string, company string, location string, remote boolean, description string, salary string, posted string, url string, method string"
_FIELDS = [c.split()[0] for c in POSTING.split(", ")]


def register_site_adapter(host: str, extract: Callable[[_Tree, str, str], list[dict]]) -> None:
    SITE_ADAPTERS.append((re.compile(host), extract))


def extract_jobs(page: str | None, url: str, today: str, adapters=None) -> list[dict]:
    """The first step of the ladder that finds postings (EXT-01); a step that
    fails counts as empty."""
    t = _Tree()
    t.feed(page or "")
    t.close()
    host = urlsplit(url or "").netloc
    for step in [f for p, f in (SITE_ADAPTERS if adapters is None else adapters) if p.search(host)] + LADDER:
        try:
            if found := step(t, url or "", today):
                return found
        except (ValueError, TypeError, AttributeError, KeyError, IndexError):
            continue
    return []


def extract_pages(pages: DataFrame, today: str) -> DataFrame:
    """One row per posting of landed pages (page_id, url, html)."""
    adapters = list(SITE_ADAPTERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"page_id": k, **{f: j.get(f) for f in _FIELDS}} for k, u, h in zip(b.page_id, b.url, b.html, strict=True) for j in extract_jobs(h, u, today, adapters)]
            yield pd.DataFrame(rows, columns=["page_id", *_FIELDS])

    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id long, {POSTING}")


def probable_job_link(url: Column, anchor: Column, pattern: str | None = None) -> Column:
    """FLT-20."""
    if pattern:
        return url.rlike(pattern)
    from quarrylark.functions.urls import detect_board, looks_like_job_url

    return detect_board(url)["native_id"].isNotNull() | (looks_like_job_url(url) & (F.length(F.trim(anchor)) >= 4))


def mail_text(raw: bytes) -> tuple[str, str]:
    """(subject, text) of a message, plain parts first (EXT-19)."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    part = m.get_body(preferencelist=("plain", "html"))
    body = part.get_content() if part else ""
    return str(m["subject"] or ""), html_to_text(body) if part and part.get_content_type() == "text/html" else tidy(body)


def alert_rows(text: str) -> list[dict]:
    """Title, employer and place of the blocks of an alert mail, each ending in
    a link (EXT-15, SRC-35)."""
    out, lines = [], []
    for line in tidy(text).split("\n"):
        line = line.strip()
        link = re.search(r"https?://\S+", line)
        if link and lines:
            head = lines[-3:]
            out.append({"title": head[0], "company": head[1] if len(head) > 1 else None, "location": head[2] if len(head) > 2 else None, "url": link[0].rstrip(">).,")})
            lines = []
        elif not line:
            lines = lines if link else []
        elif not link:
            lines.append(line)
    return out


def mail_alerts(mails: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of alert mails (SRC-35): the keys, pos, title, company,
    location, url. mails: the keys and raw, the message's bytes."""
    fields = ["title", "company", "location", "url"]
    schema = ", ".join(f"`{k}` {mails.schema[k].dataType.simpleString()}" for k in keys) + ", pos int, " + ", ".join(f"{f} string" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{**{k: getattr(r, k) for k in keys}, "pos": i, **x} for r in b.itertuples() for i, x in enumerate(alert_rows(mail_text(bytes(r.raw))[1]))]
            yield pd.DataFrame(rows, columns=[*keys, "pos", *fields])

    bounded_batches(mails.sparkSession)
    return mails.select(*keys, "raw").mapInPandas(run, schema)


REPLIES = [("rejected", r"unfortunately|not (?:be )?moving forward|regret|other candidates|ne pas donner suite|leider"), ("interview", r"interview|schedule a call|entretien|gesprach|availability"), ("offer", r"pleased to offer|offer letter|job offer|proposition d.embauche"), ("received", r"received your application|thank you for applying|bien recu|eingegangen")]


def reply_kind(text: Column) -> Column:
    """Kind of an employer's reply (EXT-18); folded text."""
    out = None
    for kind, p in REPLIES:
        out = F.when(text.rlike(p), kind) if out is None else out.when(text.rlike(p), kind)
    return out


def match_replies(mails: DataFrame, applications: DataFrame) -> DataFrame:
    """The application each mail answers (EXT-18): the company's first word is
    in the mail; whole names, then titles, score higher. mails: mail_id, text
    (folded); applications: id, company, title (folded)."""
    words = mails.select("mail_id", "text", F.explode(F.array_distinct(F.split("text", "[^a-z0-9]+"))).alias("word"))
    a = applications.withColumn("word", F.get(F.split("company", "[^a-z0-9]+"), F.lit(0))).where(F.length("word") > 2)
    hit = words.join(a, "word").withColumn("points", F.lit(1) + F.when(F.contains("text", "company"), 3).otherwise(0) + F.when(F.contains("text", "title"), 2).otherwise(0))
    return hit.groupBy("mail_id").agg(F.max_by("id", F.struct("points", -F.col("id"))).alias("id"), F.max("points").alias("points"))
