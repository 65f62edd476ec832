"""The query language: commands and free text (VIEW-01 to VIEW-17, UDX-05,
UDX-06, STR-12). A text becomes a Command; its view compiles to a DataFrame
over the tables it is given."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylark.functions.text import closest_word, fold, normalize_company
from quarrylark.operators import insights, report, scoring, select

MOST = 50


@dataclass(frozen=True)
class Command:
    name: str
    args: str = ""


@dataclass
class Preferences:
    """What users set (T19, VIEW-14); every write gives a new version."""

    version: int = 0
    paused: bool = False
    threshold: int = 55
    muted: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()
    watch: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    applied: dict[str, str] = field(default_factory=dict)
    interns: bool = False
    possible: bool = True
    learning: bool = True


@dataclass(frozen=True)
class Tables:
    """jobs: id, title, company, country, score, tier, reasons, posted_at,
    last_seen, skills, verdict, fit, and for explanations what report.explain
    needs; others as their operators say. signals may have winner, boards:
    those of winners (winner, boards)."""

    jobs: DataFrame
    prefs: Preferences
    yields: DataFrame | None = None
    signals: DataFrame | None = None
    prospects: DataFrame | None = None
    boards: DataFrame | None = None
    now: str = "2024-01-31 00:00:00"


def personal_scores(rows: DataFrame, tax: scoring.Taxonomy, prefs: Preferences) -> DataFrame:
    """Scores by what a user has set (UDX-05): their skills in place of the
    taxonomy's, their places, their bound for possible matches (which high ones
    reach at least), and internships only if they want them. rows: title and
    body (folded), country, remote, scope."""
    negative = tax.negative if prefs.interns else [*tax.negative, (r"\b(?:intern|internship|trainee|stagiaire|stage)\b", False, None)]
    own = replace(tax, owned=frozenset(prefs.skills) or tax.owned, negative=negative)
    points = scoring.location_points(F.col("remote"), F.col("scope"), list(prefs.locations), F.lower("country"), bool(prefs.locations))
    scored = scoring.score(rows.withColumn("location_points", points), own, max(scoring.HIGH, prefs.threshold), prefs.threshold)
    return scored if prefs.possible else scored.where(F.col("tier") != "possible")


def _number(text: str, default: int, most: int = MOST) -> int:
    m = re.search(r"\d+", text or "")
    return max(1, min(most, int(m[0]))) if m else default


def _visible(t: Tables) -> DataFrame:
    p = t.prefs
    rows = t.jobs.where(F.col("tier") != "rejected")
    gone = [*p.hidden, *p.applied]
    if gone:
        rows = rows.where(~F.col("id").cast("string").isin(gone))
    return rows.where(~select.muted(F.col("title"), F.col("company"), list(p.muted)))


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(select.tier_rank(F.col("tier")), F.desc("score"), F.desc("posted_at"), "id").limit(n)


def view_jobs(t: Tables, args: str) -> DataFrame:
    return _ranked(_visible(t), _number(args, 10))


def view_high(t: Tables, args: str) -> DataFrame:
    return _ranked(_visible(t).where(F.col("tier") == "high"), _number(args, 10))


def view_range(t: Tables, args: str) -> DataFrame:
    low, high = (list(map(int, re.findall(r"\d+", args))) + [0, 100])[:2] if re.findall(r"\d+", args) else (0, 100)
    return _ranked(select.in_range(t.jobs, low, high), MOST)


def view_search(t: Tables, args: str) -> DataFrame:
    return _ranked(select.search(t.jobs, args, ["title", "company", "country"]), MOST)


_CODE = re.compile(r"[0-9a-f]{5}|[0-9]+")


def view_why(t: Tables, args: str) -> DataFrame:
    """The lines of an explanation; the bare row where the jobs table lacks the
    columns for one."""
    rows = select.code_lookup(t.jobs, args.strip())
    if not {"breakdown", "evidence", "skills", "deadline", "earlier"} <= set(rows.columns):
        return rows
    return report.explain(rows, list(t.prefs.skills), F.to_date(F.lit(t.now))).orderBy("id", "ordinal")


def view_sponsors(t: Tables, args: str) -> DataFrame:
    return t.jobs.where(F.col("tier") != "rejected").orderBy(F.when(F.col("sponsor") == "posting", 0).when(F.col("sponsor") == "local", 1).otherwise(2), F.desc("score"), "id").limit(_number(args, 10))


def view_visa(t: Tables, args: str) -> DataFrame:
    rows = t.jobs.where(F.col("verdict").isNotNull())
    if _CODE.fullmatch(args.strip()):
        return select.code_lookup(rows, args.strip())
    if args.strip():
        rows = rows.where(F.lower("country") == args.strip().lower())
    return rows.orderBy(F.array_position(F.array(*[F.lit(v) for v in ("strong", "open", "hard", "blocked")]), F.col("verdict")), F.desc("score"), "id").limit(MOST)


def view_ai(t: Tables, args: str) -> DataFrame:
    return t.jobs.where(F.col("fit").isNotNull()).orderBy(F.desc("fit"), F.desc("score"), "id").limit(_number(args, 10))


def view_sources(t: Tables, args: str) -> DataFrame:
    return t.yields.orderBy(F.desc("only_here"), F.desc("found"), F.desc("raw"), "source")


def view_radar(t: Tables, args: str) -> DataFrame:
    rows = insights.radar(t.jobs, list(t.prefs.skills), F.lit(t.now).cast("timestamp"))
    return rows.where(F.col("owned") | (F.col("share") >= 5)).orderBy(F.desc("share"), "skill").limit(MOST)


def view_signals(t: Tables, args: str) -> DataFrame:
    return t.signals.orderBy(F.array_position(F.array(F.lit("award"), F.lit("consultancy"), F.lit("tender")), F.col("kind")), F.desc("date"), "id").limit(_number(args, 10))


def view_prospects(t: Tables, args: str) -> DataFrame:
    return t.prospects.orderBy("priority", F.desc("relevant"), "name").limit(_number(args, 20))


def view_approach(t: Tables, args: str) -> DataFrame:
    """Winners of awards, those with boards first (VIEW-10); with a firm's name
    only its rows."""
    rows = t.signals.where((F.col("kind") == "award") & F.col("winner").isNotNull())
    rows = insights.winner_boards(rows, t.boards) if t.boards is not None else rows.withColumn("boards", F.lit(None).cast("array<string>"))
    if args.strip() and not args.strip().isdigit():
        rows = rows.where(F.contains(normalize_company(F.col("winner")), normalize_company(F.lit(args.strip()))))
    return rows.orderBy(F.col("boards").isNull(), F.desc("date"), "id").limit(_number(args, 10))


def view_weekly(t: Tables, args: str) -> DataFrame:
    """(section, name, n, best): the week's first postings by tier, what is
    still open among the best, applications by status, signals by kind
    (VIEW-11)."""
    now = F.lit(t.now).cast("timestamp")
    week = now - F.make_interval(days=F.lit(7))
    part = lambda df, section, name, best: df.groupBy(F.col(name).cast("string").alias("name")).agg(F.count("*").alias("n"), F.max(best).cast("int").alias("best")).select(F.lit(section).alias("section"), "name", "n", "best")
    visible = _visible(t)
    new = select.first_postings(visible.where(F.col("posted_at") >= week)).where(F.col("copy") == 1)
    out = part(new, "new", "tier", F.col("score")).unionByName(part(visible.where((F.col("tier") == "high") & (F.col("posted_at") < week)), "open", "tier", F.col("score")))
    if t.prefs.applied:
        applied = t.jobs.sparkSession.createDataFrame(sorted(t.prefs.applied.items()), "id string, status string")
        scores = t.jobs.select(F.col("id").cast("string").alias("id"), "score")
        out = out.unionByName(part(applied.join(scores, "id", "left"), "applied", "status", F.col("score")))
    if t.signals is not None:
        out = out.unionByName(part(t.signals.where(F.col("date") >= F.to_date(week)), "signals", "kind", F.lit(None)))
    return out


def view_context(t: Tables, args: str) -> DataFrame:
    """(id, line): the facts that a model's text may use (VIEW-15, PRJ-05,
    PRJ-06): of the job that a code names, else of the best rows that hold any
    word of the question. The model is called outside."""
    words = [w for w in re.findall(r"[a-z0-9+#]{3,}", args.lower()) if not _CODE.fullmatch(w)]
    code = next((w for w in args.lower().split() if _CODE.fullmatch(w)), None)
    if code:
        rows = select.code_lookup(t.jobs, code)
    else:
        hay = fold(F.concat_ws(" ", "title", "company", "country"))
        hits = F.aggregate(F.array(*map(F.lit, words)).cast("array<string>"), F.lit(0), lambda n, w: n + F.contains(hay, w).cast("int"))
        rows = _visible(t).withColumn("hits", hits).orderBy(F.desc("hits"), F.desc("score"), "id").limit(_number("", 12))
    extras = F.array(F.concat(F.lit("tier "), "tier"), F.when(F.size("reasons") > 0, F.concat(F.lit("rejected for "), F.array_join("reasons", ", "))))
    return rows.select("id", select.fact_line(F.col("title"), F.nullif("company", F.lit("")), F.nullif("country", F.lit("")), F.col("score"), extras).alias("line"))


def view_status(t: Tables, args: str) -> DataFrame:
    return t.jobs.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("fit").isNotNull()).alias("reviewed"), F.max("last_seen").alias("last_seen"))


def view_muted(t: Tables, args: str) -> DataFrame:
    return t.jobs.sparkSession.createDataFrame([(m,) for m in t.prefs.muted], "term string")


def view_help(t: Tables, args: str) -> DataFrame:
    """(name, kind): the commands (VIEW-19); /start shows the same."""
    rows = [(n, "view") for n in sorted(VIEWS)] + [(n, "write") for n in sorted(WRITES)]
    return t.jobs.sparkSession.createDataFrame(rows, "name string, kind string")


def usage(messages: DataFrame) -> DataFrame:
    """(name, kind, n, users) of every command of the help view: how often and
    by how many people it was given (VIEW-19). messages: who, text. Names that
    mean another command count for that one."""
    known = [(n, "view") for n in sorted(VIEWS)] + [(n, "write") for n in sorted(WRITES)]
    meant = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    said = F.lower(F.regexp_extract("text", r"^\s*/([A-Za-z_]+)(?:@\w+)?(?:\s|$)", 1))
    given = messages.select("who", F.coalesce(F.try_element_at(meant, said), said).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("who").alias("users"))
    help_ = messages.sparkSession.createDataFrame(known, "name string, kind string")
    return help_.join(given, "name", "left").select("name", "kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("users", F.lit(0)).alias("users"))


VIEWS: dict[str, Callable[[Tables, str], DataFrame]] = {
    "jobs": view_jobs, "high": view_high, "range": view_range, "search": view_search, "why": view_why, "sponsors": view_sponsors, "visa": view_visa, "ai": view_ai,
    "sources": view_sources, "radar": view_radar, "signals": view_signals, "prospects": view_prospects, "approach": view_approach, "ask": view_context, "pitch": view_context, "prep": view_context, "weekly": view_weekly, "help": view_help, "status": view_status, "muted": view_muted,
}
ALIASES = {"start": "help", "top": "jobs", "find": "search", "explain": "why", "skills": "radar", "yield": "sources", "stats": "status", "review": "ai"}


def _with(old: tuple[str, ...], x: str) -> tuple[str, ...]:
    return old if x in old or not x else (*old, x)


def _without(old: tuple[str, ...], x: str) -> tuple[str, ...]:
    return tuple(o for o in old if o != x)


WRITES: dict[str, Callable[[Preferences, str], dict]] = {
    "mute": lambda p, a: {"muted": _with(p.muted, a.lower())}, "unmute": lambda p, a: {"muted": _without(p.muted, a.lower())},
    "hide": lambda p, a: {"hidden": _with(p.hidden, a)}, "unhide": lambda p, a: {"hidden": _without(p.hidden, a)},
    "watch": lambda p, a: {"watch": _with(p.watch, a.lower())}, "unwatch": lambda p, a: {"watch": _without(p.watch, a.lower())},
    "pause": lambda p, a: {"paused": True}, "resume": lambda p, a: {"paused": False},
    "threshold": lambda p, a: {"threshold": max(0, min(100, _number(a, p.threshold, 100)))}, "locations": lambda p, a: {"locations": tuple(x.strip().lower() for x in a.split(",") if x.strip())},
    "applied": lambda p, a: {"applied": {**p.applied, a.split()[0]: "open"}} if a.split() else {}, "outcome": lambda p, a: {"applied": {**p.applied, a.split()[0]: a.split()[1]}} if len(a.split()) > 1 and a.split()[0] in p.applied and a.split()[1] in STATUSES else {},
    "interns": lambda p, a: {"interns": a.strip().lower() != "off"}, "possible": lambda p, a: {"possible": a.strip().lower() != "off"}, "learning": lambda p, a: {"learning": a.strip().lower() != "off"},
    "skills": lambda p, a: {"skills": tuple(x.strip().lower() for x in a.split(",") if x.strip())},
}
STATUSES = {"open", "interview", "offer", "rejected", "ghosted", "withdrawn"}


def write(prefs: Preferences, command: Command, expected: int) -> Preferences:
    """Preferences after a write, if they are still at the expected version."""
    if prefs.version != expected:
        raise ValueError(f"preferences are at version {prefs.version}, not {expected}")
    changes = WRITES[command.name](prefs, command.args.strip())
    return Preferences(**{**prefs.__dict__, **changes, "version": prefs.version + 1})


#: Ordered rules of free text, English and French; the first that fits wins.
#: Writes need their verb at the start.
INTENTS: list[tuple[str, str, str]] = [
    (r"^(?:please )?(?:mute|masque[rz]?) (.+)$", "mute", r"\1"),
    (r"^(?:please )?(?:unmute|reaffiche[rz]?) (.+)$", "unmute", r"\1"),
    (r"^(?:please )?(?:hide|cache[rz]?) ([0-9a-f]{5}|[0-9]+)$", "hide", r"\1"),
    (r"^i (?:have )?applied (?:to|for) ([0-9a-f]{5}|[0-9]+)$|^j.ai postule a ([0-9a-f]{5}|[0-9]+)$", "applied", r"\1\2"),
    (r"^(?:pause|stop)(?: alerts| les alertes)?$", "pause", ""),
    (r"^(?:resume|continue|reprends?)(?: alerts| les alertes)?$", "resume", ""),
    (r"between ([0-9]+) and ([0-9]+)|entre ([0-9]+) et ([0-9]+)", "range", r"\1\3 \2\4"),
    (r"(?:why|pourquoi|explain).*?\b([0-9a-f]{5}|[0-9]+)\b", "why", r"\1"),
    (r"\b(?:best|top|high|meilleure?s?)\b(?:\D*([0-9]+))?", "high", r"\1"),
    (r"\b(?:sponsors?|sponsorship|parrain\w*)\b", "sponsors", ""),
    (r"\bvisa\b(?:.* (?:for|in|pour|en) ([a-z ]+))?", "visa", r"\1"),
    (r"\b(?:skills?|radar|competences?)\b", "radar", ""),
    (r"\b(?:sources?|yield)\b", "sources", ""),
    (r"\b(?:tenders?|awards?|signals?|marches)\b", "signals", ""),
    (r"\b(?:weekly|this week|cette semaine|summary)\b", "weekly", ""),
    (r"\b(?:status|how are you|etat)\b", "status", ""),
    (r"\b(?:search|find|look for|cherche[rz]?|trouve[rz]?)(?: for| me)? (.+)$", "search", r"\1"),
    (r"\b(?:jobs?|offers?|postings?|offres?|emplois?)\b(?:\D*([0-9]+))?", "jobs", r"\1"),
]
_WORDS = sorted({w for p, _, _ in INTENTS for w in re.findall(r"[a-z]{5,}", p)} | set(VIEWS) | set(WRITES))


def parse(text: str) -> Command | None:
    """A slash command, or the command of a free text; None if there is none.
    Typos in known words are repaired for reads only: a write has to be
    spelled."""
    t = " ".join((text or "").split())
    if t.startswith("/"):
        name, _, args = t[1:].partition(" ")
        name = ALIASES.get(name.lower(), name.lower())
        if name == "skills" and args:
            return Command("skills", args)
        return Command(name, args.strip()) if name in VIEWS or name in WRITES else None
    low = t.lower().translate(str.maketrans("éèêàâôûùîïç", "eeeaaouuiic")).rstrip("?!. ")
    for attempt in (low, " ".join(w if w in _WORDS or len(w) < 4 else closest_word(w, _WORDS) or w for w in low.split())):
        for pattern, name, args in INTENTS:
            if (m := re.search(pattern, attempt)) and (attempt == low or name in VIEWS):
                return Command(name, m.expand(args).strip() if args else "")
    return None


def valid(command: Command, codes: set[str] | None = None) -> bool:
    """Known command; a code it names exists (B3)."""
    if command.name not in VIEWS and command.name not in WRITES:
        return False
    return not (codes is not None and command.name in ("why", "hide", "applied") and command.args.split()[0:1] and command.args.split()[0] not in codes)


def run(text: str, tables: Tables) -> DataFrame | None:
    """The view of a command as a DataFrame; None for writes and unknown text."""
    command = parse(text)
    return VIEWS[command.name](tables, command.args) if command and command.name in VIEWS else None
