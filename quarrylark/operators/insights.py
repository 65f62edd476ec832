"""Windowed analytics over the state (AGG-05 to AGG-11, AGG-15 to AGG-21,
WIN-02, WIN-10, SCR-11, SCR-12, JOIN-07, JOIN-11, EXT-14, FLT-09, FLT-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.functions.text import normalize_company


def daily_volume(events: DataFrame, at: str = "ts", source: str = "source") -> DataFrame:
    """(day, source, raw) — AGG-07, STA-05."""
    return events.groupBy(F.to_date(at).alias("day"), F.col(source).alias("source")).agg(F.count("*").alias("raw"))


def source_yield(jobs: DataFrame, raw: DataFrame, now: Column, days: int = 28) -> DataFrame:
    """(source, raw, found, high, only_here, applied) — AGG-08. jobs: id,
    tier, first_seen, sources (array), applied; raw: day, source, raw. Jobs
    count once for each distinct source."""
    low = now - F.make_interval(days=F.lit(days))
    fresh = jobs.where((F.col("tier") != "rejected") & (F.col("first_seen") >= low)).withColumn("groups", F.array_distinct("sources"))
    by = fresh.select("tier", "applied", F.size("groups").alias("k"), F.explode("groups").alias("source")).groupBy("source").agg(
        F.count("*").alias("found"), F.count_if(F.col("tier") == "high").alias("high"), F.count_if(F.col("k") == 1).alias("only_here"), F.count_if(F.col("applied")).alias("applied")
    )
    volume = raw.where(F.col("day") >= F.to_date(low)).groupBy("source").agg(F.sum("raw").alias("raw"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return by.join(volume, "source", "full_outer").select("source", *[zero(c) for c in ("raw", "found", "high", "only_here", "applied")])


def yield_verdict(raw: Column, found: Column, only_here: Column, quota: Column) -> Column:
    """noise, redundant, costly or null (AGG-09)."""
    return F.when((raw >= 150) & (found == 0), "noise").when((found >= 5) & (only_here == 0), "redundant").when(quota & (only_here == 0) & (raw >= 50), "costly")


def radar(jobs: DataFrame, have: list[str], now: Column, days: int = 45) -> DataFrame:
    """(skill, mentions, share, owned) over accepted rows seen lately, share in
    whole percent (AGG-10). jobs: id, tier, last_seen, skills (array)."""
    low = now - F.make_interval(days=F.lit(days))
    fresh = jobs.where((F.col("tier") != "rejected") & (F.col("last_seen") >= low))
    total = fresh.agg(F.count("*").alias("total"))
    by = fresh.select(F.explode(F.array_distinct("skills")).alias("skill")).groupBy("skill").agg(F.count("*").alias("mentions"))
    return by.crossJoin(F.broadcast(total)).select("skill", "mentions", F.rint(100.0 * F.col("mentions") / F.col("total")).cast("int").alias("share"), F.col("skill").isin(have).alias("owned"))


def skill_gap(skills: Column, have: list[str]) -> Column:
    """STRUCT<have, lack> (ARR-06)."""
    own = F.array(*[F.lit(h) for h in have]).cast("array<string>")
    return F.struct(F.array_intersect(skills, own).alias("have"), F.array_except(skills, own).alias("lack"))


def repost_waves(jobs: DataFrame, days: int = 21) -> DataFrame:
    """Rows with earlier waves of the same posting (WIN-02, JOIN-07). jobs:
    id, posting, first_seen. A wave starts `days` after the last one's start,
    so it is a fold over the posting's dates, not a frame. Adds earlier (count)
    and since (the first wave's date)."""
    seconds = days * 86400
    dates = F.array_sort(F.array_distinct(F.collect_list(F.unix_seconds("first_seen"))))
    step = lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(F.concat(F.array(F.lit(0).cast("bigint")), acc), -1) >= seconds), F.concat(acc, F.array(t))).otherwise(acc)
    waves = jobs.groupBy("posting").agg(dates.alias("dates")).select("posting", F.aggregate("dates", F.array().cast("array<bigint>"), step).alias("waves"))
    rows = jobs.join(waves, "posting")
    before = F.filter("waves", lambda w: F.unix_seconds(F.col("first_seen")) - w >= seconds)
    return rows.withColumn("earlier", F.size(before)).withColumn("since", F.timestamp_seconds(F.get(before, F.lit(0)))).drop("waves")


def tally(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by columns (AGG-05, AGG-15, AGG-20, AGG-21)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def board_relevance(jobs: DataFrame) -> DataFrame:
    """(board, relevant) of accepted jobs (AGG-06)."""
    return jobs.where(F.col("tier") != "rejected").select(F.explode(F.array_distinct("board_keys")).alias("board")).groupBy("board").agg(F.count("*").alias("relevant"))


AWARD = r"(?:contract award|awarded to|winner)"
RELEVANT, NOISE = r"(?:survey|mapping|cadast|geo|remote sensing|data)", r"(?:catering|furniture|cleaning|vehicle)"


def signal_kind(title: Column, relevant: str = RELEVANT, noise: str = NOISE) -> Column:
    """award, consultancy or tender; null for what is off topic (SCR-11, FLT-09)."""
    t = F.lower(title)
    return F.when(~t.rlike(relevant) | t.rlike(noise), None).when(t.rlike(AWARD), "award").when(t.rlike("consult"), "consultancy").otherwise("tender")


def award_fields(text: Column) -> Column:
    """STRUCT<winner, country, price> of an award notice (EXT-14)."""
    return F.struct(
        F.nullif(F.trim(F.regexp_extract(text, r"(?i)(?:awarded to|winner):? ([^,(\n]+)", 1)), F.lit("")).alias("winner"),
        F.nullif(F.trim(F.regexp_extract(text, r"(?i)(?:awarded to|winner):? [^,(\n]+[,(] ?([A-Za-z ]+)", 1)), F.lit("")).alias("country"),
        F.nullif(F.regexp_extract(text, r"((?:EUR|USD|GBP) ?[0-9][0-9,. ]*[0-9])", 1), F.lit("")).alias("price"),
    )


def procurement(codes: Column, prefixes: list[str], country: Column, countries: list[str]) -> Column:
    """Code prefix and country filter (FLT-10)."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.exists(codes, _starts(p))
    return hit & country.isin(countries)


def _starts(prefix: str):
    return lambda c: c.startswith(prefix)


SOURCE_GROUPS = {"ats": ["greenhouse", "lever", "ashby", "workday", "oracle", "personio", "recruitee", "workable", "smartrecruiters"], "search": ["searxng", "duckduckgo", "common_crawl"], "official": ["eures", "job_bank", "usajobs", "france_travail", "bundesagentur"]}


def source_group(name: Column) -> Column:
    """SCR-12."""
    out = None
    for group, names in SOURCE_GROUPS.items():
        hit = F.lower(name).isin(names)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise(F.lower(name))


def winner_boards(signals: DataFrame, boards: DataFrame) -> DataFrame:
    """Award winners with the boards of the same company (JOIN-11)."""
    s = signals.withColumn("company_key", normalize_company(F.col("winner")))
    b = boards.withColumn("company_key", normalize_company(F.col("company"))).groupBy("company_key").agg(F.array_sort(F.collect_set("board")).alias("boards"))
    return s.join(b, "company_key", "left").drop("company_key")


def prospects(targets: list[tuple[int, DataFrame]], book: DataFrame, budget: int) -> DataFrame:
    """Employers to look up next: union of targets by priority, each company
    once, not in the book, the first `budget` (JOIN-18, AGG-16, TOP-15)."""
    union = None
    for priority, df in targets:
        part = df.select("name", "kind", F.lit(priority).alias("priority"))
        union = part if union is None else union.unionByName(part)
    best = union.withColumn("key", normalize_company(F.col("name"))).where(F.length("key") > 0).groupBy("key").agg(F.min_by(F.struct("name", "kind", "priority"), F.struct("priority", "name")).alias("t")).select("key", "t.*")
    return best.join(book.select("key"), "key", "left_anti").orderBy("priority", "key").limit(budget)
