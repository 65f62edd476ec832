"""The engine's inputs bound to the driver's tables: observations are
documents, sightings are events, names and pay come from suppliers, customers,
parts and orders. The taxonomy is made of words that the texts hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.functions.text import fold, whole_word
from quarrylark.operators.scoring import HIGH, POSSIBLE, Taxonomy, Term, score

NOW = "2024-01-31 00:00:00"


word = whole_word


def sql_pattern(pattern: str) -> str:
    """The same whole word in the subset of regular expressions that DuckDB
    has; other patterns stay."""
    w = pattern.split("(?!")[0]
    return rf"(^|[^a-z0-9]){w}($|[^a-z0-9])" if "(?!" in pattern else pattern


TAXONOMY = Taxonomy(
    terms=[
        Term("tech", "that", 5, word("that"), "links"), Term("tech", "with", 4, word("with"), "places"), Term("tech", "from", 6, word("from"), "places", "with"),
        Term("tech", "nicht", 5, word("nicht"), "links"), Term("tech", "dans", 4, word("dans"), "places"), Term("tech", "para", 4, word("para"), "places"),
        Term("domain", "was", 8, word("was"), "past"), Term("domain", "eine", 7, word("eine"), "things"), Term("domain", "pour", 9, word("pour"), "aims"), Term("domain", "una", 6, word("una"), "things"),
        Term("resp", "this", 4, word("this"), "links"), Term("resp", "sich", 3, word("sich"), "links"), Term("resp", "avec", 5, word("avec"), "places", "dans"), Term("resp", "los", 4, word("los"), "things"),
    ],
    direct=[word("the")], adjacent=[word("der"), word("les")], domain=[word("is"), word("est"), word("una")], roles=[word("la"), word("in")], generic=[word("de"), word("and"), word("of")],
    negative=[(r"scum|trash|!!", False, None), (word("un"), True, word("une"))],
    owned=frozenset({"that", "nicht", "dans"}), implies={"that": ["with"], "dans": ["para"]},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def title() -> Column:
    return F.regexp_extract("text", r"^[^.\n]*", 0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with title, body and all columns of score()."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", fold(title()).alias("title"), fold(F.col("text")).alias("body"))
    d = d.withColumn("location_points", F.when(F.col("lang") == "en", 5).when(F.col("lang") == "fr", 3).otherwise(1))
    return score(d, TAXONOMY)


def sql_fold(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents({x})), '\s+', ' ', 'g'))"


SQL_TITLE = r"regexp_extract(text, '^[^.\n]*')"


def _sql_any(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{sql_pattern(p)}')" for p in patterns) + ")"


def sql_scored(t: Taxonomy = TAXONOMY, points: str = "CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 3 ELSE 1 END", possible: int = POSSIBLE, high: int = HIGH) -> str:
    """CTEs that end in `scored`, with the columns of scored()."""
    domain = _sql_any("title", t.domain)
    negative = " OR ".join(f"(regexp_matches(title, '{sql_pattern(p)}')" + (f" AND NOT {domain}" if o else "") + (f" AND NOT regexp_matches(title, '{sql_pattern(b)}')" if b else "") + ")" for p, o, b in t.negative)
    hits = ", ".join(f"regexp_matches(body, '{sql_pattern(x.pattern)}') AS r{k}" for k, x in enumerate(t.terms))
    at = {x.canonical: k for k, x in enumerate(t.terms)}
    kept = ", ".join(f"(r{k}" + (f" AND r{at[x.requires]}" if x.requires else "") + f") AS t{k}" for k, x in enumerate(t.terms))
    have = t.have()
    total = lambda chosen: "(" + (" + ".join(f"CASE WHEN t{k} THEN {x.weight} ELSE 0 END" for k, x in enumerate(t.terms) if chosen(x)) or "0") + ")"
    order = sorted(range(len(t.terms)), key=lambda k: (-t.terms[k].weight, k))
    names = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN t{k} THEN '{t.terms[k].canonical}' END" for k in order) + "], lambda x: x IS NOT NULL), ',')"
    fams = sorted({x.family for x in t.terms})
    fam_list = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"t{k}" for k, x in enumerate(t.terms) if x.family == f) + f" THEN '{f}' END" for f in fams) + "], lambda x: x IS NOT NULL)"
    return f"""
d0 AS (SELECT doc_id, lang, source, {sql_fold(SQL_TITLE)} AS title, {sql_fold('text')} AS body, {points} AS location_points FROM documents),
d1 AS (SELECT *, length(body) >= 300 AS described, ({negative}) AS negative,
  CASE WHEN {_sql_any('title', t.direct)} THEN 'direct' WHEN {_sql_any('title', t.adjacent)} THEN 'adjacent' WHEN {domain} AND {_sql_any('title', t.roles)} THEN 'domain_title' WHEN {domain} THEN 'domain_term' WHEN {_sql_any('title', t.generic)} THEN 'generic' ELSE 'none' END AS kind, {hits} FROM d0),
d2 AS (SELECT *, {kept} FROM d1),
d3 AS (SELECT *, {names} AS terms, array_to_string({fam_list}, ',') AS families, len({fam_list}) AS n_families,
  {total(lambda x: x.kind == 'tech' and x.canonical in have)} AS have_weight, {total(lambda x: x.kind == 'tech' and x.canonical not in have)} AS lack_weight,
  least({total(lambda x: x.kind == 'domain')}, 20) AS domain_points, least({total(lambda x: x.kind == 'resp')}, 10) AS resp_points FROM d2),
d4 AS (SELECT *, kind = 'generic' AND n_families < 2 AS weak,
  CASE WHEN have_weight + lack_weight = 0 THEN CASE WHEN described THEN 6 ELSE 0 END WHEN have_weight = 0 THEN 0
    ELSE round_even(have_weight / (have_weight + lack_weight) * least(1.0::DOUBLE, 0.4::DOUBLE + have_weight / 25.0::DOUBLE) * 25, 0)::INTEGER END AS tech_points FROM d3),
d5 AS (SELECT *, CASE WHEN weak OR negative THEN 0 ELSE CASE kind WHEN 'direct' THEN 40 WHEN 'adjacent' THEN 34 WHEN 'domain_title' THEN 34 WHEN 'domain_term' THEN 28 WHEN 'generic' THEN 12 ELSE 0 END END AS title_points,
  list_filter([CASE WHEN negative THEN 'NEGATIVE_TITLE' END, CASE WHEN kind = 'none' THEN 'NO_RELEVANT_TITLE' END, CASE WHEN weak THEN 'INSUFFICIENT_SIGNALS' END], lambda x: x IS NOT NULL) AS hard FROM d4),
d6 AS (SELECT *, title_points + tech_points + domain_points + resp_points + location_points AS raw, NOT described AND len(hard) = 0 AND title_points >= 34 AS title_only FROM d5),
d7 AS (SELECT *, greatest(0, least(100, CASE WHEN title_only THEN greatest(raw, {possible}) ELSE raw END))::INTEGER AS score FROM d6),
d8 AS (SELECT *, CASE WHEN len(hard) > 0 THEN 'rejected' WHEN score >= {high} THEN 'high' WHEN score >= {possible} THEN 'possible' ELSE 'rejected' END AS tier FROM d7),
scored AS (SELECT *, CASE WHEN tier = 'rejected' AND len(hard) = 0 THEN 'LOW_SCORE' ELSE array_to_string(hard, ',') END AS reasons FROM d8)
"""
