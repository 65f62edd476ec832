"""Reference joins and the adjustment chain (JOIN-04, JOIN-06, JOIN-08,
JOIN-09, ADJ-01 to ADJ-12, WIN-11, PRJ-07, PRJ-08, AGG-12, AGG-21).

Every adjustment is one entry of the map `adjusted` and is computed from the
base score, so applying the chain twice gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylark.functions.text import core_name, distinctive, normalize_company

HIGH, POSSIBLE = 70, 55
VERDICTS = ["strong", "open", "hard", "blocked"]


def aggregate_register(rows: DataFrame) -> DataFrame:
    """(register, name_key, name, positions, occupations, strong) of a raw
    register: register, name, positions, occupation, strong (AGG-12)."""
    keyed = rows.withColumn("name_key", normalize_company(F.col("name"))).where(F.length("name_key") > 0)
    return keyed.groupBy("register", "name_key").agg(F.min("name").alias("name"), F.sum("positions").cast("long").alias("positions"), F.array_sort(F.collect_set("occupation")).alias("occupations"), F.max("strong").alias("strong"))


def match_register(jobs: DataFrame, register: DataFrame) -> DataFrame:
    """jobs (job_id, company) with a register's rows: by normalised name, else
    by distinctive core name, of which the first name counts (JOIN-04). Adds
    register, name, exact, strong. Spark broadcasts the register where its
    size allows."""
    j = jobs.withColumn("name_key", normalize_company(F.col("company"))).withColumn("core", core_name(F.col("company")))
    r = register.select("register", "name_key", "name", "strong")
    exact = j.join(r, "name_key").withColumn("exact", F.lit(True))
    cores = r.withColumn("core", core_name(F.col("name_key"))).where(distinctive(F.col("core"))).groupBy("register", "core").agg(F.min_by("name", "name_key").alias("name"), F.min_by("strong", "name_key").alias("strong"))
    rest = j.join(exact.select("job_id", F.col("register").alias("had")).distinct(), "job_id", "left")
    near = rest.join(cores, "core").where(F.col("had").isNull() | (F.col("had") != F.col("register"))).withColumn("exact", F.lit(False))
    columns = [*jobs.columns, "register", "name", "exact", "strong"]
    return exact.select(*columns).unionByName(near.select(*columns)).distinct()


def register_bonus(hits: Column, country: Column, remote: Column) -> Column:
    """4, and 2 more on a strong row: only an exact name in the job's own
    country, or a remote job of unknown country (ADJ-02). hits:
    ARRAY<STRUCT<country, exact, strong>>."""
    own = F.filter(hits, lambda h: h["exact"] & ((h["country"] == country) | (remote & country.isNull())))
    return F.when(F.size(own) > 0, F.when(F.exists(own, lambda h: h["strong"]), 6).otherwise(4)).otherwise(0)


def sponsor_badge(hits: Column, country: Column) -> Column:
    """The register of the job's own country, else the first (PRJ-08)."""
    return F.coalesce(F.get(F.filter(hits, lambda h: h["country"] == country), F.lit(0))["register"], F.get(hits, F.lit(0))["register"])


def salary_band(low: Column, high: Column, minimum: Column, reduced: Column) -> Column:
    """How pay meets a route's minimum (JOIN-06): above, reaches, reduced,
    below, unknown."""
    lo, hi = F.coalesce(low, high), F.coalesce(high, low)
    return F.when(hi.isNull() | minimum.isNull(), "unknown").when(lo >= minimum, "above").when(hi >= minimum, "reaches").when(reduced.isNotNull() & (hi >= reduced), "reduced").otherwise("below")


def route_applies(rule_language: Column, languages: Column, rule_home: Column, homes: Column, excluded: Column, region: Column) -> Column:
    """Language, nationality and region conditions of a route (FLT-15); a rule
    without a condition applies."""
    language = rule_language.isNull() | F.array_contains(languages, rule_language)
    home = rule_home.isNull() | F.array_contains(homes, rule_home)
    return F.coalesce(language, F.lit(False)) & F.coalesce(home, F.lit(False)) & ~F.coalesce(F.array_contains(excluded, region), F.lit(False))


def assess_routes(jobs: DataFrame, rules: DataFrame, top: int = 3) -> DataFrame:
    """The `top` routes of each job, best verdict first, then rule order
    (JOIN-08, ADJ-11, WIN-11). jobs: job_id, country, low, high, sponsor;
    rules: country, ordinal, route, minimum, reduced, needs_sponsor, hard.
    Checks are three-valued: a hard rule is hard, any failed check blocks, all
    passed is strong, else open."""
    j = jobs.join(F.broadcast(rules) if rules.count() <= 10_000 else rules, "country")
    band = salary_band(F.col("low"), F.col("high"), F.col("minimum"), F.col("reduced"))
    pay_ok = F.when(F.col("minimum").isNull(), True).when(band == "unknown", None).otherwise(band != "below")
    sponsor_ok = F.when(~F.col("needs_sponsor"), True).otherwise(F.col("sponsor"))
    j = j.withColumn("band", band).withColumn("pay_ok", pay_ok.cast("boolean")).withColumn("sponsor_ok", sponsor_ok.cast("boolean"))
    failed = (F.coalesce("pay_ok", F.lit(True)) == False) | (F.coalesce("sponsor_ok", F.lit(True)) == False)  # noqa: E712
    passed = F.coalesce("pay_ok", F.lit(False)) & F.coalesce("sponsor_ok", F.lit(False))
    j = j.withColumn("verdict", F.when(F.col("hard"), "hard").when(failed, "blocked").when(passed, "strong").otherwise("open"))
    rank = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict")).cast("int")
    order = F.row_number().over(Window.partitionBy("job_id").orderBy(rank, "ordinal"))
    return j.withColumn("choice", order).where(F.col("choice") <= top)


def visa_penalty(verdict: Column, sponsor_ok: Column, penalty: int = 12) -> Column:
    """ADJ-06: none for a hard route with a known sponsor."""
    return F.when((verdict == "blocked") | ((verdict == "hard") & ~F.coalesce(sponsor_ok, F.lit(False))), -penalty).otherwise(0)


def visa_line(verdict: Column, route: Column, band: Column) -> Column:
    """One line of text (PRJ-07)."""
    said = F.when(verdict == "strong", "likely").when(verdict == "open", "possible").when(verdict == "hard", "difficult").otherwise("unlikely")
    return F.concat_ws(" · ", route, said, F.when(band != "unknown", F.concat(F.lit("pay "), band)))


def learned_weights(labels: DataFrame, features: DataFrame, least_labels: int = 4, least_support: int = 2) -> DataFrame:
    """(feature, positives, negatives, weight) from labels (id, weight: above
    0 liked, below disliked, 0 ignored) and features (id, feature) — AGG-11.
    With one kind of label only, features of more than half the labels say
    nothing."""
    used = labels.where(F.col("weight") != 0)
    total = used.agg(F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("weight"))), F.lit(0)).alias("P"), F.coalesce(F.sum(F.when(F.col("weight") < 0, -F.col("weight"))), F.lit(0)).alias("N"), F.count("*").alias("n_labels"))
    by = features.distinct().join(used, "id").groupBy("feature").agg(F.sum(F.greatest("weight", F.lit(0))).alias("positives"), F.sum(F.greatest(-F.col("weight"), F.lit(0))).alias("negatives"), F.count("*").alias("support"))
    rows = by.crossJoin(F.broadcast(total))  # one row
    base = F.col("P") / (F.col("P") + F.col("N"))
    rate = (F.col("positives") + 2 * base) / (F.col("positives") + F.col("negatives") + 2)
    lift = (rate - base) / F.when(rate > base, 1 - base).otherwise(base)
    one_kind = (F.col("P") == 0) | (F.col("N") == 0)
    alone = F.when(F.col("support") * 2 > F.col("n_labels"), 0.0).otherwise((F.col("positives") - F.col("negatives")) / (F.col("positives") + F.col("negatives") + 2))
    tenths = F.rint(60 * F.when(one_kind, alone).otherwise(lift))
    rows = rows.where((F.col("n_labels") >= least_labels) & (F.col("support") >= least_support))
    return rows.withColumn("weight", tenths / 10).where(F.abs(F.col("weight")) >= 1).select("feature", "positives", "negatives", "weight")


def learned_nudge(rows: DataFrame, features: DataFrame, weights: DataFrame, low: int = -8, high: int = 6) -> DataFrame:
    """Adds nudge: the clamped sum of the weights of a row's features (ADJ-03)."""
    total = features.distinct().join(weights.select("feature", "weight"), "feature").groupBy("id").agg(F.sum("weight").alias("w"))
    return rows.join(total, "id", "left").withColumn("nudge", F.greatest(F.lit(low), F.least(F.lit(high), F.rint(F.coalesce("w", F.lit(0.0))))).cast("int")).drop("w")


def apply_adjustments(rows: DataFrame, parts: dict[str, Column], high: int = HIGH, possible: int = POSSIBLE) -> DataFrame:
    """base_score plus all adjustments, each once, and the tier anew; rows
    rejected for hard reasons stay so. The map `adjusted` says what was added
    (ADJ-01: a row with an old rule version is just computed again)."""
    made = rows.withColumn("adjusted", F.map_filter(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("int"))]), lambda k, v: v != 0))
    total = F.aggregate(F.map_values("adjusted"), F.lit(0), lambda a, v: a + v)
    made = made.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("base_score") + total)).cast("int"))
    return made.withColumn("tier", F.when(F.size("hard_reasons") > 0, "rejected").when(F.col("score") >= high, "high").when(F.col("score") >= possible, "possible").otherwise("rejected"))


def forget_learned(adjusted: Column) -> Column:
    """ADJ-04."""
    return F.map_filter(adjusted, lambda k, v: k != "learned")


def review_lift(fit: Column, lift: Column, tier: Column) -> Column:
    """A near miss that a review finds fit is lifted (ADJ-05)."""
    return F.when(F.coalesce(lift, F.lit(False)) & (fit >= 70) & (tier == "rejected"), F.greatest(F.lit(0), F.lit(10))).otherwise(0)


def review_veto(tier: Column, veto: Column, restricted: Column) -> Column:
    """The last word: a veto or a restriction rejects (ADJ-07, ADJ-08)."""
    return F.when(F.coalesce(veto, F.lit(False)) | F.coalesce(restricted, F.lit(False)), "rejected").otherwise(tier)


def clean_review(fit: Column, years: Column, deadline: Column) -> dict[str, Column]:
    """Values of a review within bounds, or null (ADJ-12)."""
    return {"fit": F.greatest(F.lit(0), F.least(F.lit(100), F.expr("1") * fit.try_cast("int"))), "years": F.when(years.try_cast("int").between(0, 40), years.try_cast("int")), "deadline": F.try_to_date(deadline)}


def deadline_state(deadline: Column, today: Column) -> Column:
    """closed, soon, open or null (ADJ-09)."""
    left = F.datediff(deadline, today)
    return F.when(deadline.isNull(), None).when(left < 0, "closed").when(left <= 3, "soon").otherwise("open")


def with_euros(rows: DataFrame, rates: DataFrame, amount: str = "amount", currency: str = "currency") -> DataFrame:
    """Adds euros, null without a rate (JOIN-09, ADJ-10)."""
    r = rates.select(F.col("currency").alias(currency), "per_eur")
    return rows.join(r, currency, "left").withColumn("euros", F.rint(F.col(amount) / F.when(F.col("per_eur") > 0, F.col("per_eur")))).drop("per_eur")
