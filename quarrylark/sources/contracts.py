"""Contracts with what runs outside the engine (EXX-01 to EXX-09, UDX-02,
UDX-04, FLT-19, T25). Fetching, model calls and sending happen elsewhere;
their outcomes are rows that the engine takes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.operators.scoring import Taxonomy, Term
from quarrylark.session import bounded_batches

#: Outcomes of a fetch (EXX-01), and what a source's status is then.
FETCH_KINDS = {
    "OK": "SUCCESS", "NOT_MODIFIED": "SUCCESS", "INVALID_URL": "FAILED", "ROBOTS_DISALLOWED": "SKIPPED", "TIMEOUT": "FAILED", "CONNECTION_ERROR": "FAILED", "REQUEST_ERROR": "FAILED", "TOO_LARGE": "PARTIAL",
    "BLOCKED": "FAILED", "RATE_LIMITED": "PARTIAL", "SERVER_ERROR": "FAILED", "AUTH_REQUIRED": "DISABLED", "NOT_FOUND": "FAILED", "HTTP_ERROR": "FAILED", "BAD_JSON": "FAILED",
}
FETCHES = "source string, url string, kind string, http_status int, attempts int, fetched_at timestamp, etag string"
REVIEWS = "canonical_id string, fit int, summary string, concerns string, years int, sponsorship string, languages array<string>, requirements array<string>, restricted boolean, deadline date, veto boolean, lift boolean, second_chance boolean, at timestamp, model string"
DELIVERIES = "canonical_id string, ok boolean, tries int, error string"


def fetch_kind(status: Column, error: Column) -> Column:
    """The kind of a response's status code or error name (EXX-01)."""
    return (
        F.when(error.isNotNull(), F.upper(error)).when(status == 304, "NOT_MODIFIED").when(status.between(200, 299), "OK").when(status.isin(401, 407), "AUTH_REQUIRED").when(status == 403, "BLOCKED")
        .when(status.isin(404, 410), "NOT_FOUND").when(status == 429, "RATE_LIMITED").when(status >= 500, "SERVER_ERROR").otherwise("HTTP_ERROR")
    )


def source_status(fetches: DataFrame) -> DataFrame:
    """(source, status, n, last_error): SUCCESS if all went well, PARTIAL if
    some did, else the worst kind's status (AGG-17, SRC-30)."""
    table = F.create_map(*[F.lit(x) for kv in FETCH_KINDS.items() for x in kv])
    rows = fetches.withColumn("status", F.coalesce(F.try_element_at(table, F.col("kind")), F.lit("FAILED")))
    by = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "SUCCESS").alias("good"), F.max("status").alias("other"), F.max_by("kind", F.when(F.col("status") != "SUCCESS", F.col("fetched_at"))).alias("last_error"))
    return by.select("source", F.when(F.col("good") == F.col("n"), "SUCCESS").when(F.col("good") > 0, "PARTIAL").when(F.col("other") == "SUCCESS", "PARTIAL").otherwise(F.col("other")).alias("status"), "n", "last_error")


def retry_after(kind: str, attempt: int, said: int | None = None) -> int | None:
    """Seconds before another try: 2, 4, 8, or what the server said up to a
    minute; None for no more (EXX-01)."""
    if attempt >= 3 or kind not in ("TIMEOUT", "CONNECTION_ERROR", "SERVER_ERROR", "RATE_LIMITED"):
        return None
    return min(said, 60) if said is not None else 2 ** (attempt + 1)


def parse_robots(body: str | None, status: int | None, agent: str = "*") -> dict:
    """rules, delay and sitemaps of an origin (EXX-02): a 4xx answer allows
    all, no answer or a 5xx allows nothing."""
    if status is None or status >= 500:
        return {"rules": [("disallow", "/")], "delay": None, "sitemaps": []}
    out: dict = {"rules": [], "delay": None, "sitemaps": []}
    if status >= 400:
        return out
    groups: dict[str, list] = {}
    names, open_ = [], False
    for line in (body or "").splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "sitemap":
            out["sitemaps"].append(value)
        elif key == "user-agent":
            names = [*names, value.lower()] if open_ else [value.lower()]
            open_ = True
        elif key in ("allow", "disallow", "crawl-delay"):
            open_ = False
            for n in names:
                groups.setdefault(n, []).append((key, value))
    mine = groups.get(agent.lower(), groups.get("*", []))
    out["rules"] = [(k, v) for k, v in mine if k != "crawl-delay" and v]
    out["delay"] = next((float(v) for k, v in mine if k == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", v)), None)
    return out


def robots_allow(robots: dict, path: str) -> bool:
    """The longest matching rule decides, allow in a tie."""

    def fits(rule: str) -> bool:
        pattern = "".join(".*" if c == "*" else "$" if c == "$" and i == len(rule) - 1 else re.escape(c) for i, c in enumerate(rule))
        return re.match(pattern, path) is not None

    best = max(((len(v), k == "allow") for k, v in robots["rules"] if fits(v)), default=(0, True))
    return best[1]


def robots_column(robots: dict):
    """robots_allow of one origin as a column function of paths."""
    @F.pandas_udf("boolean")
    def allow(path: pd.Series) -> pd.Series:
        return path.map(lambda p: robots_allow(robots, p))

    return allow


#: Shapes of secrets that must not reach tables or logs (EXX-09).
SECRETS = [r"(?i)\b(?:api[_-]?key|token|secret|password)\b\s*[=:]\s*[\"']?[^\s\"'&]+", r"\b[0-9]{8,10}:[A-Za-z0-9_-]{30,}\b", r"(?i)bearer\s+[a-z0-9._-]{16,}"]


def redact_secrets(text: Column) -> Column:
    for p in SECRETS:
        text = F.regexp_replace(text, p, "[redacted]")
    return text


def read_review(text: str) -> dict | None:
    """The JSON object in a model's answer, its values in bounds (EXX-03,
    EXX-04, ADJ-12); None if there is none."""
    m = re.search(r"\{.*\}", text or "", re.S)
    try:
        d = json.loads(m[0]) if m else None
    except ValueError:
        return None
    if not isinstance(d, dict):
        return None
    number = lambda x, low, high: max(low, min(high, int(x))) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    words = lambda x: [str(v)[:80] for v in x][:8] if isinstance(x, list) else []
    return {"fit": number(d.get("fit"), 0, 100), "years": number(d.get("years"), 0, 40), "summary": str(d.get("summary") or "")[:400], "concerns": str(d.get("concerns") or "")[:400], "languages": words(d.get("languages")), "requirements": words(d.get("requirements")), "restricted": d.get("restricted") is True, "veto": d.get("veto") is True, "lift": d.get("lift") is True}


def reviews(answers: DataFrame) -> DataFrame:
    """(id, fit, years, summary, veto) of models' answers (EXX-03); answers
    without an object give no row. answers: id, text."""
    kind = answers.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            read = [(k, read_review(t)) for k, t in zip(b.id, b.text, strict=True)]
            yield pd.DataFrame([{"id": k, **{f: r[f] for f in ("fit", "years", "summary", "veto")}} for k, r in read if r], columns=["id", "fit", "years", "summary", "veto"]).astype({"fit": "Int64", "years": "Int64"})

    bounded_batches(answers.sparkSession)
    return answers.select("id", "text").mapInPandas(run, f"id {kind}, fit int, years int, summary string, veto boolean")


def invented_codes(answer: str, known: set[str]) -> list[str]:
    """Codes in a model's text that no row has (EXX-04)."""
    return sorted({c for c in re.findall(r"\b[0-9a-f]{5}\b", answer or "") if re.search(r"\d", c)} - known)


#: Board parsers by platform; register_platform adds to it (UDX-02).
PLATFORM_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_platform(name: str, parse: Callable[[DataFrame], DataFrame]) -> None:
    PLATFORM_PARSERS[name] = parse


#: Terms that a taxonomy holds at most.
MOST_TERMS = 100_000


def load_taxonomy(spark: SparkSession, terms: DataFrame, **lists) -> Taxonomy:
    """A taxonomy from a table of terms (UDX-04): kind, canonical, weight,
    pattern, family, requires, in the order of their names. A configuration
    table: beyond MOST_TERMS rows it is refused, none is dropped."""
    rows = terms.select("kind", "canonical", "weight", "pattern", "family", "requires").take(MOST_TERMS + 1)
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a taxonomy has at most {MOST_TERMS} terms")
    return Taxonomy(terms=[Term(r.kind, r.canonical, int(r.weight), r.pattern, r.family, r.requires) for r in rows], **lists)


def employer_targets(names: DataFrame, domain: str, trades: str) -> DataFrame:
    """Names of the domain that aren't of an excluded trade (FLT-19)."""
    n = F.lower("name")
    return names.where(n.rlike(domain) & ~n.rlike(trades))


def keep_last(items: Column, most: int) -> Column:
    """The last `most` of a history (WIN-09)."""
    return F.slice(items, F.greatest(F.size(items) - most + 1, F.lit(1)), most)


def union_distinct(frames: list[DataFrame], key: str) -> DataFrame:
    """Results of several queries, each key once, the first query's row
    (SET-02)."""
    out = None
    for k, f in enumerate(frames):
        g = f.withColumn("_turn", F.lit(k))
        out = g if out is None else out.unionByName(g)
    rest = [c for c in frames[0].columns if c != key]
    return out.groupBy(key).agg(F.min_by(F.struct(*rest), "_turn").alias("r")).select(key, "r.*")
