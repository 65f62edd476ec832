"""Selection, ranking and read model (FLT-02 to FLT-13, FLT-18, JOIN-10,
JOIN-15 to JOIN-18, JOIN-20, WIN-01, WIN-05, WIN-06, TOP-01 to TOP-15,
PRJ-02 to PRJ-06, AGG-18)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylark.functions.text import fold, job_code, normalize_company, normalize_title
from quarrylark.session import cut

TIER_RANK = {"high": 0, "possible": 1, "rejected": 2}
CAP, INDEX_ROWS, INDEX_MISSES = 20, 900, 100


def tier_rank(tier: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIER_RANK.items() for x in kv]), tier)


def block_reason(deadline: Column, posted: Column, limit_hours: Column, now: Column) -> Column:
    """closed, stale or null (FLT-02)."""
    age = (F.unix_seconds(now) - F.unix_seconds(posted)) / 3600
    return F.when(deadline < F.to_date(now), "closed").when(age > limit_hours, "stale")


def age_limit_hours(source_types: Column, direct: int = 720, feed: int = 336, other: int = 168) -> Column:
    """The longest limit of the kinds of source (FLT-03)."""
    has = lambda *k: F.exists(source_types, lambda s: s.isin(*k))
    return F.greatest(F.when(has("ats", "employer_page"), direct), F.when(has("feed", "government"), feed), F.lit(other))


def muted(title: Column, company: Column, terms: list[str]) -> Column:
    """Whether a muted term stands as whole words in title or company (FLT-05)."""
    hay = fold(F.concat_ws(" ", title, company))
    if not terms:
        return F.lit(False)
    words = "|".join(re.escape(t) for t in terms)
    return hay.rlike(rf"(?:^|[^a-z0-9])(?:{words})(?:$|[^a-z0-9])")


def search(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold every folded word somewhere in the columns (FLT-12)."""
    hay = fold(F.concat_ws(" ", *columns))
    words = [w for w in query.lower().split() if w]
    return rows.where(F.forall(F.array(*[fold(F.lit(w)) for w in words]), lambda w: F.contains(hay, w)) if words else F.lit(True))


def in_range(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Scores between bounds, either order; of rejected rows only LOW_SCORE
    ones (FLT-13)."""
    low, high = sorted((low, high))
    soft = (F.col("tier") != "rejected") | (F.size(F.array_except("reasons", F.array(F.lit("LOW_SCORE")))) == 0)
    return rows.where(F.col("score").between(low, high) & soft)


def contained(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, text): the names all of whose words stand in a text, both given
    as distinct or repeated normalised words (JOIN-10, JOIN-11, JOIN-21).

    A name is looked for by the one of its words that the fewest texts have,
    so words that all names open with cost nothing; a name with a word that no
    text has is not looked for. Equal texts are one, so copies are not paired
    again; candidates are a row for each text that has a name's rarest word."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    asked = names.select("name").where(F.length("name") > 0).distinct()
    held = cut(texts.select("text").where(F.length("text") > 0).distinct().select("text", F.explode(words(F.col("text"))).alias("word")))
    # cut, so that the joins have exchanges of their own, which are split where a word is hot
    counts = cut(held.groupBy("word").agg(F.count("*").alias("n")))
    rarest = asked.select("name", F.explode(words(F.col("name"))).alias("word")).join(counts, "word", "left").groupBy("name")
    rarest = rarest.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).where("r.n > 0").select("name", F.col("r.word").alias("word"))
    pairs = rarest.join(held, "word")
    return pairs.where(F.size(F.array_except(words(F.col("name")), words(F.col("text")))) == 0).select("name", "text")


def watched(jobs: DataFrame, watch: DataFrame) -> DataFrame:
    """Jobs whose normalised company holds a watched name as whole words in a
    row (JOIN-10): job_id, the first such name."""
    names = watch.select(normalize_company(F.col("name")).alias("name"))
    j = jobs.select("job_id", normalize_company(F.col("company")).alias("company_key"))
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    hit = contained(names, j.select(F.col("company_key").alias("text"))).where(F.contains(spaced("text"), spaced("name")))
    # a row for each company, cut, so that a company of very many jobs is split
    first = cut(hit.groupBy(F.col("text").alias("company_key")).agg(F.min("name").alias("watch")))
    return j.join(first, "company_key").groupBy("job_id").agg(F.min("watch").alias("watch"))


def company_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): names of two tables that are the same company by same_company
    (JOIN-21), found without comparing all: by containment either way, or by
    what is left without blanks. Both have name."""
    key = lambda df, c: df.select(F.col("name").alias(c), normalize_company(F.col("name")).alias(f"{c}_key")).where(F.length(f"{c}_key") > 0).distinct()
    x, y = key(left, "a"), key(right, "b")
    keys = lambda df, c, to: df.select(F.col(f"{c}_key").alias(to))
    one = contained(keys(x, "a", "name"), keys(y, "b", "text")).select(F.col("name").alias("a_key"), F.col("text").alias("b_key"))
    other = contained(keys(y, "b", "name"), keys(x, "a", "text")).select(F.col("text").alias("a_key"), F.col("name").alias("b_key"))
    joined = lambda df, c: df.select(f"{c}_key", F.replace(F.col(f"{c}_key"), F.lit(" "), F.lit("")).alias("bare")).distinct()
    same = joined(x, "a").join(joined(y, "b"), "bare").select("a_key", "b_key")
    pairs = one.unionByName(other).unionByName(same).distinct().where(same_company(F.col("a_key"), F.col("b_key")))
    return pairs.join(x, "a_key").join(y, "b_key").select("a", "b").distinct()


def exclude(rows: DataFrame, *others: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in none of the others (FLT-06, JOIN-15)."""
    for o in others:
        rows = rows.join(o.select(key), key, "left_anti")
    return rows


def first_postings(rows: DataFrame) -> DataFrame:
    """Adds copy: 1 for the best posting of each company, title and country,
    higher for later ones; rows without a company are their own (WIN-01)."""
    key = F.when(F.length(F.coalesce("company", F.lit(""))) > 0, F.concat_ws("|", normalize_company(F.col("company")), normalize_title(F.col("title")), fold(F.coalesce("country", F.lit(""))))).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    w = Window.partitionBy("posting").orderBy(tier_rank(F.col("tier")), F.desc("score"), F.desc("posted_at"), "id")
    return rows.withColumn("posting", key).withColumn("copy", F.row_number().over(w))


def rank_alerts(candidates: DataFrame, now: Column, cap: int = CAP) -> DataFrame:
    """The `cap` best first postings, high tier, score, date (TOP-01)."""
    rows = first_postings(candidates.withColumn("posted_at", F.coalesce("posted_at", now))).where(F.col("copy") == 1)
    return rows.orderBy(tier_rank(F.col("tier")), F.desc("score"), F.desc("posted_at"), "id").limit(cap)


def alert_counts(candidates: DataFrame, cap: int = CAP) -> DataFrame:
    """candidates, postings, sent and deferred of a selection."""
    rows = first_postings(candidates)
    return rows.agg(F.count("*").alias("candidates"), F.count_if(F.col("copy") == 1).alias("postings")).select("candidates", "postings", F.least("postings", F.lit(cap)).cast("long").alias("sent"), F.greatest(F.col("postings") - cap, F.lit(0)).cast("long").alias("deferred"))


def alert_candidates(state: DataFrame, seen: DataFrame, now: Column, age_hours: int) -> DataFrame:
    """Seen this run, or accepted, not notified and young (SET-03, JOIN-16)."""
    waiting = state.join(seen.select("id"), "id", "left_anti").where((F.col("tier") != "rejected") & ~F.col("notified") & (F.unix_seconds("first_seen") >= F.unix_seconds(now) - age_hours * 3600))
    return state.join(seen.select("id").distinct(), "id", "left_semi").unionByName(waiting)


def drop_reason(tier_ok: Column, is_watched: Column, tier: Column, hidden: Column, muted_: Column, notified: Column, pending: Column, verdict: Column, tries: Column, blocked: Column) -> Column:
    """Why a candidate isn't sent, in the order of the rules; null if it is."""
    return (
        F.when(~tier_ok & ~(is_watched & (tier == "possible")), "tier").when(hidden, "hidden").when(muted_, "muted").when(notified & ~pending, "notified")
        .when(verdict.isin("hard", "blocked") & ~is_watched, "route").when(tries >= 5, "attempts").when(blocked.isNotNull(), blocked)
    )


def index_rows(rows: DataFrame, most: int = INDEX_ROWS, misses: int = INDEX_MISSES) -> DataFrame:
    """The read model: accepted rows and the best near misses (TOP-03, PRJ-02,
    FLT-18)."""
    columns = [F.col("id"), job_code(F.col("id").cast("string")).alias("code"), "title", "tier", "score"]
    good = rows.where(F.col("tier") != "rejected").orderBy(tier_rank(F.col("tier")), F.desc("score"), "id").limit(most - misses)
    near = rows.where((F.col("tier") == "rejected") & (F.col("score") >= 35) & (F.size(F.array_except("reasons", F.array(F.lit("LOW_SCORE")))) == 0)).orderBy(F.desc("score"), "id").limit(misses)
    return good.select(*columns).unionByName(near.select(*columns))


def work_queue(rows: DataFrame, budget: int = 40) -> DataFrame:
    """Pending accepted rows, then near misses, then the rest (TOP-04)."""
    turn = F.when(F.col("tier") != "rejected", 0).when(F.col("near_miss"), 1).otherwise(2)
    return rows.withColumn("turn", turn).orderBy("turn", F.desc("score"), "id").limit(budget)


def host_caps(queue: DataFrame, per_host: int, total: int) -> DataFrame:
    """Queue rows (seq, priority, host) in order, capped per host and in all
    (WIN-05, TOP-08)."""
    turn = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("priority"), "seq"))
    return queue.withColumn("turn", turn).where(F.col("turn") <= per_host).orderBy(F.desc("priority"), "seq").limit(total)


def detail_budget(rows: DataFrame, budget: int, generic: int = 8) -> DataFrame:
    """Rows of a board (board, rank, kind, seq) within its budget, generic
    titles capped (WIN-06)."""
    g = F.row_number().over(Window.partitionBy("board", "kind").orderBy("seq"))
    kept = rows.withColumn("g", g).where((F.col("kind") != "generic") | (F.col("g") <= generic)).drop("g")
    return kept.withColumn("turn", F.row_number().over(Window.partitionBy("board").orderBy("rank", "seq"))).where(F.col("turn") <= budget)


def same_posting(rows: DataFrame) -> DataFrame:
    """(posting, n, best): rows of one company and title (AGG-18)."""
    key = F.concat_ws("|", normalize_company(F.col("company")), normalize_title(F.col("title")))
    return rows.withColumn("posting", key).groupBy("posting").agg(F.count("*").alias("n"), F.min("id").alias("best"))


def pack_digest(limit: int = 4096):
    """Lines in order into parts of at most `limit` characters (TOP-11); a
    recipient's lines are one group. Input: recipient, ordinal, line."""

    def pack(table: pa.Table) -> pa.Table:
        rows, out, size, part = table.sort_by("ordinal").to_pylist(), [], 0, 0
        for r in rows:
            n = len(r["line"])
            if size and size + 1 + n > limit:
                size, part = 0, part + 1
            size += n + (1 if size else 0)
            out.append(part)
        t = pa.Table.from_pylist(rows, schema=table.schema)
        return t.append_column("part", pa.array(out, pa.int32()))

    return pack


def digest(lines: DataFrame, limit: int = 4096) -> DataFrame:
    """(recipient, part, text)."""
    packer = pack_digest(limit)

    def apply(table: pa.Table) -> pa.Table:
        return packer(table)

    packed = lines.select("recipient", "ordinal", "line").groupBy("recipient").applyInArrow(apply, "recipient string, ordinal long, line string, part int")
    return packed.groupBy("recipient", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("text"))


def diagnostics(rows: DataFrame, needle: str | None = None) -> DataFrame:
    """Evaluated rows, best first, kept if their JSON holds the needle
    (FLT-14, PRJ-03)."""
    if needle:
        rows = rows.where(F.contains(F.lower(F.to_json(F.struct(*rows.columns))), F.lit(needle.lower())))
    return rows


def fact_line(title: Column, company: Column, place: Column, score: Column, extras: Column) -> Column:
    """PRJ-05, PRJ-06."""
    return F.concat_ws(" | ", title, company, place, F.concat(F.lit("score "), score.cast("string")), F.array_join(F.filter(extras, lambda x: x.isNotNull()), "; "))


def code_lookup(rows: DataFrame, code: str, key: str = "id") -> DataFrame:
    """By code prefix or whole id (JOIN-20)."""
    return rows.where((job_code(F.col(key).cast("string")) == code.lower()) | (F.col(key).cast("string") == code))


def same_company(a: Column, b: Column) -> Column:
    """Token rules for the employer a board reports (JOIN-21): equal joined
    names, or one's words all in the other, two at least or a long one."""
    x, y = F.split(normalize_company(a), " "), F.split(normalize_company(b), " ")
    common = F.size(F.array_intersect(x, y))
    return (F.array_join(x, "") == F.array_join(y, "")) | ((common == F.least(F.size(x), F.size(y))) & ((common >= 2) | (F.length(F.get(F.array_intersect(x, y), F.lit(0))) >= 6)))
