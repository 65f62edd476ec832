"""Queries of gates, reminders, adjustments, reports and views over rows that
are made from the tables."""

from __future__ import annotations

import contextlib
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from quarrylark.functions.text import fold
from quarrylark.operators import adjust, identity, insights, report, scoring, select, state
from quarrylark.plans import commands
from quarrylark.plans.bindings import TAXONOMY, now, scored, sql_scored, table, title
from quarrylark.plans.registry import query
from quarrylark.session import shared_folder
from quarrylark.sources import contracts, feeds

_SCORED = f"WITH {sql_scored()}"


# ------------------------------------------------------------ gates
@query("age_gates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderdate::DATE + 20 < DATE '1998-07-01' THEN 'closed' WHEN epoch(TIMESTAMP '1998-07-01') - epoch(o_orderdate) > 3600 * CASE o_orderkey % 3 WHEN 0 THEN 720 WHEN 1 THEN 336 ELSE 168 END THEN 'stale' END AS gate FROM orders""")
def age_gates(spark, sf):
    """FLT-02, FLT-03: deadlines, and ages by kinds of sources."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    kinds = F.when(k % 3 == 0, F.array(F.lit("ats"), F.lit("aggregator"))).when(k % 3 == 1, F.array(F.lit("feed"))).otherwise(F.array(F.lit("search")))
    closes = F.when(k % 5 == 0, F.date_add(F.to_date("o_orderdate"), 20))
    return table(spark, sf, "orders").select("o_orderkey", select.block_reason(closes, at, select.age_limit_hours(kinds), F.lit("1998-07-01").cast("timestamp")).alias("gate"))


@query("route_conditions", "SELECT c_custkey, c_custkey % 2 = 0 AND (c_custkey % 3 > 0) AND c_custkey % 5 > 0 AS applies FROM customer")
def route_conditions(spark, sf):
    """FLT-15: language, nationality and excluded regions."""
    k = F.col("c_custkey")
    of = lambda x: F.lit(x)
    language, home = F.when(k % 2 == 0, F.when(k % 4 == 0, of("fr"))).otherwise("de"), F.when(k % 3 == 0, "Peru").otherwise("Chad")
    return table(spark, sf, "customer").select("c_custkey", adjust.route_applies(language, F.array(of("fr"), of("en")), home, F.array(of("Chad")), F.array(of("north")), F.when(k % 5 == 0, "north").otherwise("south")).alias("applies"))


@query("held_back", "SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1 AND c_custkey % 100 + 12 >= 55 AND c_custkey % 3 > 0")
def held_back(spark, sf):
    """FLT-08."""
    k = F.col("c_custkey")
    reasons = F.when(k % 3 > 0, F.array(F.lit("LOW_SCORE"))).otherwise(F.array(F.lit("LOW_SCORE"), F.lit("WRONG_PLACE")))
    adjusted = F.create_map(F.lit("route"), F.when(k % 4 == 1, -12).otherwise(0))
    rows = table(spark, sf, "customer")
    return rows.where(report.held_back(F.lit("rejected"), reasons, (k % 100).cast("int"), adjusted)).select("c_custkey")


@query("tender_gate", "SELECT p_partkey, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS kept FROM part")
def tender_gate(spark, sf):
    """FLT-10."""
    k = F.col("p_partkey")
    codes = F.when(k % 3 == 0, F.array(F.lit("45000000"), F.lit("71355000"))).otherwise(F.array(F.lit("45713550")))
    return table(spark, sf, "part").select("p_partkey", insights.procurement(codes, ["7135", "38"], F.when(k % 2 == 0, "FRA").otherwise("USA"), ["FRA", "DEU"]).alias("kept"))


@query("employer_targets", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 IN (0, 1)")
def employer_targets(spark, sf):
    """FLT-19."""
    k = F.col("s_suppkey") % 4
    name = F.concat(F.lit("Firm "), F.when(k == 0, "Survey").when(k == 1, "mapping ltd").when(k == 2, "Survey Catering").otherwise("Bakery"))
    return contracts.employer_targets(table(spark, sf, "supplier").select("s_suppkey", name.alias("name")), "survey|mapping", "catering").select("s_suppkey")


# ------------------------------------------------------------ state
@query("merged_sources", """
WITH e AS (SELECT user_id, event_type, ts < TIMESTAMP '2024-01-11' AS early, min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l FROM events GROUP BY 1, 2, 3),
j AS (SELECT user_id, event_type, min(f) FILTER (early) AS f0, max(l) FILTER (early) AS l0, min(f) FILTER (NOT early) AS f1, max(l) FILTER (NOT early) AS l1 FROM e GROUP BY 1, 2)
SELECT user_id, string_agg(concat(event_type, ':', coalesce(f0, f1), ':', coalesce(l1, l0)), ',' ORDER BY coalesce(l1, l0) DESC) AS sources FROM j GROUP BY 1""")
def merged_sources(spark, sf):
    """JOIN-05."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.lit("2024-01-11").cast("timestamp")
    one = F.struct(F.col("event_type").alias("name"), F.lit("u").alias("url"), F.col("f").alias("first_seen"), F.col("l").alias("last_seen"))
    part = lambda rows, name: rows.groupBy("user_id", "event_type").agg(F.min("ts").alias("f"), F.max("ts").alias("l")).groupBy("user_id").agg(F.collect_list(one).alias(name))
    both = part(e.where(F.col("ts") < at), "old").join(part(e.where(F.col("ts") >= at), "new"), "user_id", "full_outer")
    none = F.array().cast("array<struct<name:string,url:string,first_seen:timestamp,last_seen:timestamp>>")
    merged = state.merge_sources(F.coalesce("old", none), F.coalesce("new", none))
    said = F.transform(merged, lambda s: F.concat_ws(":", s["name"], F.unix_micros(s["first_seen"]).cast("string"), F.unix_micros(s["last_seen"]).cast("string")))
    return both.select("user_id", F.array_join(said, ",").alias("sources"))


@query("outbox", "SELECT c_custkey AS canonical_id FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 4 < 3")
def outbox(spark, sf):
    """STA-07, SNK-07: not acknowledged, with tries left."""
    k = F.col("canonical_id")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("canonical_id"))
    failed = c.where(k % 4 > 0).select("canonical_id", F.lit(False).alias("ok"), F.when(k % 4 == 3, 3).otherwise(2).alias("tries"))
    again = c.where(k % 4 == 3).select("canonical_id", F.lit(False).alias("ok"), F.lit(2).alias("tries"))
    sent = failed.unionByName(again).unionByName(c.where(k % 3 == 0).select("canonical_id", F.lit(True).alias("ok"), F.lit(1).alias("tries")))
    return state.outbox(c, sent)


@query("deadline_reminders", "SELECT o_orderkey FROM orders WHERE date_diff('day', DATE '1998-07-01', o_orderdate::DATE) BETWEEN 0 AND 3 AND o_orderkey % 2 = 0")
def deadline_reminders(spark, sf):
    """STA-10."""
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("deadline"), F.when(F.col("o_orderkey") % 2 == 1, True).when(F.col("o_orderkey") % 4 == 0, False).alias("reminded"))
    return state.deadline_reminders(o, F.lit("1998-07-01").cast("date")).select("o_orderkey")


@query("health_events", """
WITH d AS (SELECT user_id, ts, event_type = 'error' AS failed FROM events), o AS (SELECT user_id, max(ts) FILTER (NOT failed) AS ok FROM d GROUP BY 1),
s AS (SELECT d.user_id, count(*) FILTER (failed AND (ok IS NULL OR ts > ok)) AS streak FROM d JOIN o USING (user_id) GROUP BY 1)
SELECT user_id, CASE WHEN streak >= 2 AND user_id % 2 = 1 THEN 'down' WHEN streak = 0 AND user_id % 2 = 0 THEN 'recovered' END AS event FROM s""")
def health_events(spark, sf):
    """STA-08: one alert when a streak reaches the limit, one when it ends."""
    streak = state.failure_streak(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "error")
    known = streak.where("user_id % 2 = 0").select("user_id", F.lit(True).alias("alerted_down"))
    return state.health_events(streak, known, "user_id", 2).select("user_id", "event")


@query("boards_due", """
SELECT user_id, last_checked + INTERVAL 1 SECOND * wait <= TIMESTAMP '2024-02-01' AS due FROM (SELECT user_id, date_trunc('second', max(ts)) AS last_checked,
  (86400 * CASE WHEN user_id % 11 = 0 THEN 60 WHEN user_id % 4 > 0 THEN least(power(2, user_id % 4), 30) WHEN user_id % 8 = 0 THEN 0 ELSE 1 END)::BIGINT AS wait FROM events GROUP BY user_id)""")
def boards_due(spark, sf):
    """STA-13, SRC-42: hot, daily, failing and invalid boards."""
    u = F.col("user_id")
    b = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_checked"))
    due = state.board_due(F.col("last_checked"), F.when(u % 11 == 0, "INVALID").otherwise("OK"), u % 4, F.when(u % 8 == 0, 3).otherwise(0), F.lit("2024-02-01").cast("timestamp"))
    return b.select("user_id", due.alias("due"))


@query("watchdog", f"""
WITH j AS (SELECT c_custkey, (c_custkey % 12)::DOUBLE AS age, c_custkey % 4 AS k, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 5)::DOUBLE END AS since, c_custkey % 6 = 0 AS busy, c_custkey % 2 = 0 AS told FROM customer),
n AS (SELECT *, CASE WHEN since IS NOT NULL AND age < since THEN 0 ELSE k END AS kicks FROM j),
o AS (SELECT *, CASE WHEN age < {state.FILL_HOURS} THEN 'fresh' WHEN busy THEN 'running' WHEN kicks >= {state.MAX_KICKS} THEN 'gave_up' WHEN kicks > 0 AND since < power(2, kicks - 1) - 0.25 THEN 'waiting' ELSE 'kick' END AS outcome FROM n)
SELECT c_custkey, outcome, (kicks + (outcome = 'kick')::INTEGER)::INTEGER AS kicks, CASE WHEN told AND age < {state.STALE_HOURS} THEN 'recovered' WHEN NOT told AND age >= {state.STALE_HOURS} THEN 'down' END AS alert FROM o""")
def watchdog(spark, sf):
    """STA-17."""
    k = F.col("c_custkey")
    back = lambda h: now() - F.make_interval(hours=h.cast("int"))
    jobs = table(spark, sf, "customer").select("c_custkey", back(k % 12).alias("ran_at"), F.when(k % 4 > 0, back(k % 5)).alias("kicked_at"), (k % 4).cast("int").alias("kicks"), (k % 6 == 0).alias("busy"), (k % 2 == 0).alias("alerted"))
    return state.watchdog(jobs, now()).select("c_custkey", "outcome", "kicks", "alert")


@query("view_help", """
WITH said AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'jobs' WHEN 'click' THEN 'why' WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN 'help' ELSE 'nonsense' END AS name FROM events)
SELECT name, kind, count(user_id) AS n, count(DISTINCT user_id) AS users FROM (VALUES ('jobs', 'view'), ('why', 'view'), ('applied', 'write'), ('help', 'view'), ('mute', 'write')) c(name, kind) LEFT JOIN said USING (name) GROUP BY ALL""")
def view_help(spark, sf):
    """VIEW-19: the commands of the language and how often people gave them;
    here events are messages, and five commands are shown."""
    kinds = {"view": "/Jobs 5", "click": "/why@bot 12", "purchase": "/applied x", "signup": "/start"}
    said = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    messages = table(spark, sf, "events").select(F.col("user_id").alias("who"), F.coalesce(F.try_element_at(said, F.col("event_type")), F.lit("hello")).alias("text"))
    return commands.usage(messages).where(F.col("name").isin("jobs", "why", "applied", "help", "mute"))


@query("page_eviction", "SELECT event_id::VARCHAR AS url FROM events ORDER BY ts DESC, event_id::VARCHAR LIMIT 30000")
def page_eviction(spark, sf):
    """TOP-06: events as fetched pages."""
    return state.keep_pages(table(spark, sf, "events").select(F.col("event_id").cast("string").alias("url"), F.col("ts").cast("timestamp").alias("fetched_at"))).select("url")


@query("kept_history", "SELECT user_id, len(k)::INTEGER AS n, k[1] AS oldest FROM (SELECT user_id, (list(event_id ORDER BY event_id))[-10:] AS k FROM events GROUP BY 1)")
def kept_history(spark, sf):
    """WIN-09."""
    h = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("h")).select("user_id", contracts.keep_last(F.col("h"), 10).alias("k"))
    return h.select("user_id", F.size("k").alias("n"), F.get("k", F.lit(0)).alias("oldest"))


@query("first_query_wins", "SELECT user_id AS id, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'error') THEN 'error' ELSE 'rest' END AS found FROM events GROUP BY 1")
def first_query_wins(spark, sf):
    """SET-02."""
    e = table(spark, sf, "events")
    part = lambda rows, name: rows.select(F.col("user_id").alias("id"), F.lit(name).alias("found")).distinct()
    return contracts.union_distinct([part(e.where("event_type = 'purchase'"), "purchase"), part(e.where("event_type = 'error'"), "error"), part(e, "rest")], "id")


@query("key_spaces", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('lever:', doc_id, ',feed:', doc_id) ELSE concat('feed:', doc_id) END AS strong, CASE WHEN doc_id % 2 = 0 THEN concat('lever:', doc_id) ELSE '' END AS platform FROM documents")
def key_spaces(spark, sf):
    """ARR-03: ids by what issued them, without URLs, hashes and guids that are
    URLs."""
    n = F.col("doc_id").cast("string")
    keys = F.array_compact(F.array(F.concat(F.lit("url:"), n), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("lever:"), n)), F.concat(F.lit("feed:"), n), F.concat(F.lit("https://guid/"), n), F.concat(F.lit("hash:"), n)))
    return table(spark, sf, "documents").select("doc_id", F.array_join(identity.strong_ids(keys), ",").alias("strong"), F.array_join(identity.platform_ids(keys), ",").alias("platform"))


@query("versioned_state", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def versioned_state(spark, sf):
    """SNK-01, SNK-05, SNK-08, SRC-41, STA-16: two commits, a third from the
    first's state that is refused, and what a reader gets then."""
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    t = state.VersionedTable(spark, f"{shared_folder(spark)}/table-{uuid.uuid4().hex}")
    t.commit(counts.where("user_id % 2 = 0"), 0)
    t.commit(counts, 1, ["user_id", "n"])
    with contextlib.suppress(state.Conflict):
        t.commit(counts.limit(0), 1)
    return t.load()


@query("raw_snapshots", "SELECT doc_id, '2024-01-0' || (doc_id % 5 + 1) AS day, source, substr(text, 1, 80) AS description FROM documents WHERE doc_id % 5 >= 2")
def raw_snapshots(spark, sf):
    """SNK-03, SNK-04, PRJ-01: observations by day, run and source, without the
    days before a cutoff."""
    folder = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    day = F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 5 + 1).cast("string"))
    state.write_snapshots(table(spark, sf, "documents").select("doc_id", F.col("text").alias("description"), day.alias("day"), F.lit("r1").alias("run"), "source"), folder, 80)
    state.drop_days_before(spark, folder, "2024-01-03")
    return spark.read.json(folder).select("doc_id", F.col("day").cast("string").alias("day"), F.col("source").cast("string").alias("source"), "description")


@query("report_artifact", """
WITH r AS (SELECT 'action' AS section, CASE WHEN o_orderkey % 5 = 0 THEN 'insert' ELSE 'refresh' END AS name, count(*) AS value FROM orders GROUP BY 2 UNION ALL SELECT 'tier', CASE o_orderkey % 3 WHEN 0 THEN 'high' ELSE 'rejected' END, count(*) FROM orders GROUP BY 2)
SELECT concat('- ', name, ': ', value) AS line FROM r UNION ALL SELECT DISTINCT concat('## ', section) FROM r""")
def report_artifact(spark, sf):
    """SNK-02, SNK-10: a report as a gzipped text, put if there is none yet."""
    k = F.col("o_orderkey")
    jobs = table(spark, sf, "orders").select(F.when(k % 3 == 0, "high").otherwise("rejected").alias("tier"), F.when(k % 5 == 0, "insert").otherwise("refresh").alias("action"))
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}.txt.gz"
    report.write_artifact(spark, path, report.report_markdown(report.run_report(jobs, spark.createDataFrame([], "source string, status string, n long"))), None)
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("line"))


@query("query_grid", """
WITH g AS (SELECT n_name AS country, t.term, n_nationkey * 3 + t.k AS i FROM nation, (VALUES (0, 'gis'), (1, 'lidar'), (2, 'sig')) t(k, term)), m AS (SELECT count(*) AS n FROM g)
SELECT country, term FROM g, m WHERE (i - 70 + n) % n < 12""")
def query_grid(spark, sf):
    """JOIN-23: the next queries of the grid after a cursor, over its end."""
    countries = table(spark, sf, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("country"))
    return feeds.query_grid(countries, ["gis", "lidar", "sig"], 70, 12)[0]


@query("configured_terms", f"{_SCORED} SELECT doc_id, terms FROM scored")
def configured_terms(spark, sf):
    """UDX-04, SRC-40: a taxonomy read from a configuration's table."""
    said = "\n".join(f"[[term]]\nkind = '{t.kind}'\ncanonical = '{t.canonical}'\nweight = {t.weight}\npattern = '{t.pattern}'\nfamily = '{t.family}'" + (f"\nrequires = '{t.requires}'" if t.requires else "") for t in TAXONOMY.terms)
    terms = feeds.load_toml(spark, said, "term", "kind string, canonical string, weight int, pattern string, family string, requires string")
    # rows of a small table may come in any order; ordinals decide ties
    order = {t.canonical: k for k, t in enumerate(TAXONOMY.terms)}
    loaded = contracts.load_taxonomy(spark, terms)
    loaded = replace(loaded, terms=sorted(loaded.terms, key=lambda t: order[t.canonical]))
    rows = scoring.with_hits(table(spark, sf, "documents").select("doc_id", fold(F.col("text")).alias("body")), "body", loaded)
    return rows.select("doc_id", F.array_join(F.transform("hits", lambda h: h["canonical"]), ",").alias("terms"))


@query("model_reviews", """
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 7 END::INTEGER AS fit, CASE c_custkey % 4 WHEN 0 THEN 5 END::INTEGER AS years, CASE c_custkey % 4 WHEN 2 THEN '' ELSE 'fine' END AS summary, c_custkey % 4 = 1 AS veto FROM customer WHERE c_custkey % 4 < 3""")
def model_reviews(spark, sf):
    """EXX-03, EXX-04, ADJ-12: objects in models' answers, their values in
    bounds; an answer without one gives no row."""
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, 'Sure: {"fit": 150, "years": 5, "summary": "fine"} bye').when(k == 1, '{"fit": 7, "summary": "fine", "veto": true}').when(k == 2, '{"fit": "high"}').otherwise("no object {")
    return contracts.reviews(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), said.alias("text")))


# ------------------------------------------------------------ adjustments
@query("register_bonus", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 5 = 0 THEN 6 ELSE 4 END ELSE 0 END AS bonus, CASE WHEN s_suppkey % 2 = 0 THEN 'home' ELSE 'other' END AS badge FROM supplier")
def register_bonus(spark, sf):
    """ADJ-02, PRJ-08: exact names in the job's own country."""
    k = F.col("s_suppkey")
    hit = lambda country, register, exact: F.struct(F.lit(country).alias("country"), F.lit(register).alias("register"), exact.alias("exact"), (k % 5 == 0).alias("strong"))
    hits = F.array(hit("Peru", "other", F.lit(True)), hit("Chad", "home", k % 3 == 0))
    country = F.when(k % 2 == 0, "Chad").otherwise("Togo")
    return table(spark, sf, "supplier").select("s_suppkey", adjust.register_bonus(hits, country, F.lit(False)).alias("bonus"), adjust.sponsor_badge(hits, country).alias("badge"))


@query("review_effects", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 101 >= 70 THEN 10 ELSE 0 END AS lift, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'rejected' WHEN c_custkey % 3 = 0 THEN 'rejected' ELSE 'high' END AS tier,
  least(100, c_custkey % 150)::INTEGER AS fit, CASE WHEN c_custkey % 60 <= 40 THEN c_custkey % 60 END::INTEGER AS years FROM customer""")
def review_effects(spark, sf):
    """ADJ-05, ADJ-07, ADJ-08, ADJ-12: lifts, vetoes and bounds of a review."""
    k = F.col("c_custkey")
    tier = F.when(k % 3 == 0, "rejected").otherwise("high")
    clean = adjust.clean_review((k % 150).cast("string"), (k % 60).cast("string"), F.lit("2024-02-30"))
    return table(spark, sf, "customer").select("c_custkey", adjust.review_lift(k % 101, F.lit(True), tier).alias("lift"), adjust.review_veto(tier, k % 7 == 0, F.when(k % 11 == 0, True)).alias("tier"), clean["fit"].alias("fit"), clean["years"].alias("years"))


@query("forgotten", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'visa:-12' ELSE '' END AS left_over FROM customer")
def forgotten(spark, sf):
    """ADJ-04."""
    adjusted = F.map_filter(F.create_map(F.lit("learned"), F.lit(3), F.lit("visa"), F.when(F.col("c_custkey") % 2 == 0, -12).otherwise(0)), lambda k, v: v != 0)
    left = F.transform(F.map_entries(adjust.forget_learned(adjusted)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(left, ",").alias("left_over"))


@query("deadline_states", "SELECT o_orderkey, CASE WHEN d < 0 THEN 'closed' WHEN d <= 3 THEN 'soon' ELSE 'open' END AS state FROM (SELECT o_orderkey, date_diff('day', DATE '1995-06-01', o_orderdate::DATE) AS d FROM orders)")
def deadline_states(spark, sf):
    """ADJ-09."""
    return table(spark, sf, "orders").select("o_orderkey", adjust.deadline_state(F.to_date("o_orderdate"), F.lit("1995-06-01").cast("date")).alias("state"))


@query("route_lines", "SELECT c_custkey, concat_ws(' · ', 'blue', CASE c_custkey % 4 WHEN 0 THEN 'likely' WHEN 1 THEN 'possible' WHEN 2 THEN 'difficult' ELSE 'unlikely' END, CASE WHEN c_custkey % 3 > 0 THEN 'pay above' END) AS line FROM customer")
def route_lines(spark, sf):
    """PRJ-07."""
    k = F.col("c_custkey")
    verdict = F.get(F.array(*map(F.lit, adjust.VERDICTS)), (k % 4).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", adjust.visa_line(verdict, F.lit("blue"), F.when(k % 3 > 0, "above").otherwise("unknown")).alias("line"))


@query("skill_gaps", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'gis' ELSE '' END AS have, 'sql,qgis' AS lack FROM documents")
def skill_gaps(spark, sf):
    """ARR-06."""
    skills = F.array_compact(F.array(F.lit("sql"), F.when(F.col("doc_id") % 2 == 0, "gis"), F.lit("qgis")))
    gap = insights.skill_gap(skills, ["gis", "cad"])
    return table(spark, sf, "documents").select("doc_id", F.array_join(gap["have"], ",").alias("have"), F.array_join(gap["lack"], ",").alias("lack"))


@query("years_and_terms", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 2 END AS years, doc_id % 3 = 0 AS short_term FROM documents")
def years_and_terms(spark, sf):
    """SCR-04, SCR-05: asked at the ends of whole texts."""
    k = F.col("doc_id")
    said = F.concat(F.lower("text"), F.when(k % 4 == 0, ". 5+ years of experience").when(k % 4 == 1, ". 2-4 years experience and 10 years experience").when(k % 4 == 2, ". we have over 20 years of experience").otherwise("."), F.when(k % 3 == 0, " fixed-term").when(k % 3 == 1, " temporary or permanent").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", scoring.experience_years(said).alias("years"), scoring.temporary(said).alias("short_term"))


# ------------------------------------------------------------ insights
@query("award_boards", "SELECT p_partkey, concat('Firm ', p_partkey % 9) AS winner, 'Kenya' AS country, CASE WHEN p_partkey % 9 < 4 THEN concat('lever:b', p_partkey % 9) END AS boards FROM part")
def award_boards(spark, sf):
    """EXT-14, JOIN-11: winners read from notices, with the boards of the same
    company under another legal form."""
    n = (F.col("p_partkey") % 9).cast("string")
    notice = F.concat(F.lit("Contract for mapping awarded to: Firm "), n, F.lit(" (Kenya) for EUR 1,200,000"))
    signals = table(spark, sf, "part").select("p_partkey", insights.award_fields(notice).alias("f")).select("p_partkey", "f.winner", "f.country")
    boards = spark.createDataFrame([(f"FIRM {i} GmbH", f"lever:b{i}") for i in range(4)], "company string, board string")
    return insights.winner_boards(signals, boards).select("p_partkey", "winner", "country", F.array_join("boards", ",").alias("boards"))


@query("prospect_list", """
WITH t AS (SELECT s_suppkey % 50 AS k, 1 AS priority FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey % 50, 2 FROM supplier)
SELECT concat('firm ', k) AS key, min(priority)::INTEGER AS priority FROM t WHERE k % 7 > 0 GROUP BY k ORDER BY 2, 1 LIMIT 25""")
def prospect_list(spark, sf):
    """JOIN-18, AGG-16, TOP-15: two kinds of targets, without known ones."""
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).cast("string").alias("k"), "s_suppkey")
    names = lambda rows, kind: rows.select(F.concat(F.lit("Firm "), "k", F.lit(" Ltd")).alias("name"), F.lit(kind).alias("kind"))
    book = s.where(F.col("k").cast("int") % 7 == 0).select(F.concat(F.lit("firm "), "k").alias("key")).distinct()
    return insights.prospects([(1, names(s.where("s_suppkey % 3 = 0"), "winner")), (2, names(s, "register"))], book, 25).select("key", "priority")


@query("relevant_boards", f"{_SCORED} SELECT source AS board, count(*) AS relevant FROM scored WHERE tier <> 'rejected' GROUP BY 1")
def relevant_boards(spark, sf):
    """AGG-06."""
    return insights.board_relevance(scored(spark, sf).select("tier", F.array("source", "source").alias("board_keys")))


@query("recent_labels", "SELECT id, kind FROM (SELECT doc_id AS id, quality::VARCHAR AS kind, row_number() OVER (PARTITION BY quality ORDER BY doc_id % 97 DESC, doc_id) AS r FROM labels WHERE quality IS NOT NULL) WHERE r <= 6")
def recent_labels(spark, sf):
    """TOP-13."""
    rows = table(spark, sf, "labels").where("quality is not null").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("kind"), (F.col("doc_id") % 97).alias("at"))
    return report.recent_labels(rows).select("id", "kind")


@query("run_report", """
SELECT 'tier' AS section, CASE o_orderkey % 3 WHEN 0 THEN 'high' ELSE 'rejected' END AS name, count(*) AS value FROM orders GROUP BY 2
UNION ALL SELECT 'action', CASE WHEN o_orderkey % 5 = 0 THEN 'insert' ELSE 'refresh' END, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'sources', CASE n_nationkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'SKIPPED' ELSE 'SUCCESS' END, count(*) FROM nation GROUP BY 2
UNION ALL SELECT 'failing', n_name, n_nationkey FROM nation WHERE n_nationkey % 4 < 2""")
def run_report(spark, sf):
    """SNK-10."""
    k, n = F.col("o_orderkey"), F.col("n_nationkey")
    jobs = table(spark, sf, "orders").select(F.when(k % 3 == 0, "high").otherwise("rejected").alias("tier"), F.when(k % 5 == 0, "insert").otherwise("refresh").alias("action"))
    sources = table(spark, sf, "nation").select(F.col("n_name").alias("source"), F.when(n % 4 == 0, "FAILED").when(n % 4 == 1, "PARTIAL").when(n % 4 == 2, "SKIPPED").otherwise("SUCCESS").alias("status"), n.alias("n"))
    return report.run_report(jobs, sources)


# ------------------------------------------------------------ views
def _jobs(spark, sf):
    """Scored documents as the jobs of the views."""
    k = F.col("doc_id")
    return scored(spark, sf).select(
        k.alias("id"), "title", F.concat(F.lit("Firm "), (k % 5).cast("string")).alias("company"), F.when(k % 2 == 0, "Chad").otherwise("Peru").alias("country"), "score", "tier", "reasons", (now() - F.make_interval(days=(k % 20).cast("int"))).alias("posted_at"), now().alias("last_seen"),
        F.when(k % 3 == 0, "posting").when(k % 3 == 1, "local").otherwise("none").alias("sponsor"), F.when(k % 4 > 0, F.get(F.array(*map(F.lit, adjust.VERDICTS)), (k % 4).cast("int"))).alias("verdict"), F.when(k % 5 > 0, k % 101).alias("fit"),
    )


_SET = commands.Preferences(threshold=45, locations=("en", "de"), skills=("from", "nicht"), possible=True)
_OWN = replace(TAXONOMY, owned=frozenset(_SET.skills), negative=[*TAXONOMY.negative, ("(^|[^a-z0-9])(intern|internship|trainee|stagiaire|stage)($|[^a-z0-9])", False, None)])


@query("preferred_scores", f"WITH {sql_scored(_OWN, "CASE WHEN lang IS NULL THEN 1 WHEN lang IN ('en', 'de') THEN 5 ELSE 0 END", 45, 70)} SELECT doc_id, score, tier FROM scored")
def preferred_scores(spark, sf):
    """UDX-05, SCR-07: one user's skills, places and bound."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("country"), fold(title()).alias("title"), fold(F.col("text")).alias("body"), F.lit(False).alias("remote"), F.lit(None).cast("string").alias("scope"))
    return commands.personal_scores(d, TAXONOMY, _SET).select("doc_id", "score", "tier")


@query("view_sponsors", f"{_SCORED} SELECT doc_id AS id, score FROM scored WHERE tier <> 'rejected' ORDER BY doc_id % 3, score DESC, doc_id LIMIT 8")
def view_sponsors(spark, sf):
    """VIEW-05, TOP-09."""
    return commands.run("/sponsors 8", commands.Tables(_jobs(spark, sf), commands.Preferences())).select("id", "score")


@query("view_visa", f"{_SCORED} SELECT doc_id AS id FROM scored WHERE doc_id % 4 > 0 AND doc_id % 2 = 1 ORDER BY doc_id % 4, score DESC, doc_id LIMIT 50")
def view_visa(spark, sf):
    """VIEW-06, TOP-10: by verdict in one country."""
    return commands.run("/visa Peru", commands.Tables(_jobs(spark, sf), commands.Preferences())).select("id")


@query("view_visa_code", "SELECT doc_id AS id, 'open' AS verdict FROM documents WHERE doc_id = 5")
def view_visa_code(spark, sf):
    """VIEW-06, JOIN-20: one job's verdict."""
    return commands.run("/visa 5", commands.Tables(_jobs(spark, sf), commands.Preferences())).select("id", "verdict")


@query("view_reviews", f"{_SCORED} SELECT doc_id AS id, doc_id % 101 AS fit FROM scored WHERE doc_id % 5 > 0 ORDER BY doc_id % 101 DESC, score DESC, doc_id LIMIT 12")
def view_reviews(spark, sf):
    """VIEW-07, TOP-10."""
    return commands.run("/ai 12", commands.Tables(_jobs(spark, sf), commands.Preferences())).select("id", "fit")


def _signals(spark, sf):
    k = F.col("p_partkey")
    kind = F.get(F.array(F.lit("award"), F.lit("consultancy"), F.lit("tender")), (k % 3).cast("int"))
    return table(spark, sf, "part").select(k.alias("id"), kind.alias("kind"), F.date_sub(F.to_date(now()), (k % 40).cast("int")).alias("date"), F.when(k % 2 == 0, F.concat(F.lit("Firm "), (k % 9).cast("string"))).alias("winner"))


@query("view_signals", f"SELECT p_partkey AS id FROM part ORDER BY p_partkey % 3, p_partkey % 40, p_partkey LIMIT 15")
def view_signals(spark, sf):
    """VIEW-10, TOP-12."""
    return commands.run("/signals 15", commands.Tables(_jobs(spark, sf), commands.Preferences(), signals=_signals(spark, sf))).select("id")


@query("view_approach", "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 < 4 THEN concat('lever:b', p_partkey % 9) END AS boards FROM part WHERE p_partkey % 6 = 0 ORDER BY p_partkey % 9 >= 4, p_partkey % 40, p_partkey LIMIT 12")
def view_approach(spark, sf):
    """VIEW-10, JOIN-11: winners to approach, those with boards first."""
    boards = spark.createDataFrame([(f"Firm {i} Inc.", f"lever:b{i}") for i in range(4)], "company string, board string")
    t = commands.Tables(_jobs(spark, sf), commands.Preferences(), signals=_signals(spark, sf), boards=boards)
    return commands.run("/approach 12", t).select("id", F.array_join("boards", ",").alias("boards"))


@query("view_prospects", "SELECT s_suppkey AS id FROM supplier ORDER BY s_suppkey % 3, s_suppkey % 10 DESC, concat('Firm ', s_suppkey) LIMIT 20")
def view_prospects(spark, sf):
    """VIEW-10, TOP-15."""
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("priority"), (F.col("s_suppkey") % 10).alias("relevant"), F.concat(F.lit("Firm "), F.col("s_suppkey").cast("string")).alias("name"))
    return commands.run("/prospects", commands.Tables(_jobs(spark, sf), commands.Preferences(), prospects=p)).select("id")


@query("view_weekly", f"""
{_SCORED}, j AS (SELECT doc_id, title, score, tier, doc_id % 20 AS age, concat(doc_id % 5, '|', doc_id % 2, '|', trim(regexp_replace(title, '[^a-z0-9+/#]+', ' ', 'g'))) AS posting FROM scored WHERE tier <> 'rejected' AND doc_id NOT IN (7, 8)),
w AS (SELECT *, row_number() OVER (PARTITION BY posting ORDER BY CASE tier WHEN 'high' THEN 0 ELSE 1 END, score DESC, age, doc_id) AS copy FROM j WHERE age <= 7)
SELECT 'new' AS section, tier AS name, count(*) AS n, max(score)::INTEGER AS best FROM w WHERE copy = 1 GROUP BY 2
UNION ALL SELECT 'open', tier, count(*), max(score)::INTEGER FROM j WHERE tier = 'high' AND age > 7 GROUP BY 2
UNION ALL SELECT 'applied', CASE WHEN doc_id = 7 THEN 'open' ELSE 'interview' END, count(*), max(score)::INTEGER FROM scored WHERE doc_id IN (7, 8) GROUP BY 2
UNION ALL SELECT 'signals', CASE p_partkey % 3 WHEN 0 THEN 'award' WHEN 1 THEN 'consultancy' ELSE 'tender' END, count(*), NULL FROM part WHERE p_partkey % 40 <= 7 GROUP BY 2""")
def view_weekly(spark, sf):
    """VIEW-11."""
    t = commands.Tables(_jobs(spark, sf), commands.Preferences(applied={"7": "open", "8": "interview"}), signals=_signals(spark, sf))
    return commands.run("/weekly", t)


@query("view_context", f"{_SCORED} SELECT doc_id AS id, concat(title, ' | Firm ', doc_id % 5, ' | ', CASE WHEN doc_id % 2 = 0 THEN 'Chad' ELSE 'Peru' END, ' | score ', score, ' | tier ', tier) AS line FROM scored WHERE tier <> 'rejected' ORDER BY (doc_id % 2 = 1)::INTEGER + (doc_id % 5 = 3)::INTEGER DESC, score DESC, doc_id LIMIT 12")
def view_context(spark, sf):
    """VIEW-15, PRJ-05, PRJ-06: facts of the rows that a question is about."""
    # words that no title holds, so that the SQL can tell the hits by company and country
    return commands.run("/ask peru jobs at firm3?", commands.Tables(_jobs(spark, sf).withColumn("company", F.when(F.col("id") % 5 == 3, "Firm3").otherwise(F.col("company"))), commands.Preferences())).select("id", F.regexp_replace("line", "Firm3", "Firm 3").alias("line"))


@query("explained", """
WITH c AS (SELECT c_custkey AS id, c_custkey % 60 AS p FROM customer)
SELECT id, 0 AS ordinal, concat('Role ', id, ' — Firm') AS line FROM c UNION ALL SELECT id, 1, concat('score ', p, '/100 · high') FROM c
UNION ALL SELECT id, 2, concat('title ', p, ' · tech 0 · domain 0 · resp 0 · location 3') FROM c UNION ALL SELECT id, 3, 'adjusted: learned +2, route -12' FROM c WHERE id % 2 = 0
UNION ALL SELECT id, 3 + (id % 2 = 0)::INTEGER, '• gis' FROM c UNION ALL SELECT id, 4 + (id % 2 = 0)::INTEGER, 'have: gis' FROM c UNION ALL SELECT id, 5 + (id % 2 = 0)::INTEGER, 'lack: sql' FROM c
UNION ALL SELECT id, 6 + (id % 2 = 0)::INTEGER, 'rejected: LOW_SCORE' FROM c WHERE id % 3 = 0 UNION ALL SELECT id, 6 + (id % 2 = 0)::INTEGER + (id % 3 = 0)::INTEGER, 'closes in 4 days' FROM c WHERE id % 5 = 0
UNION ALL SELECT id, 6 + (id % 2 = 0)::INTEGER + (id % 3 = 0)::INTEGER + (id % 5 = 0)::INTEGER, 'posted 2 times before' FROM c WHERE id % 7 = 0""")
def explained(spark, sf):
    """VIEW-04: the lines of an explanation, for every job."""
    k = F.col("c_custkey")
    points = F.create_map(F.lit("title"), (k % 60).cast("int"), F.lit("location"), F.lit(3), F.lit("route"), F.when(k % 2 == 0, -12).otherwise(0), F.lit("learned"), F.when(k % 2 == 0, 2).otherwise(0))
    jobs = table(spark, sf, "customer").select(
        k.alias("id"), F.concat(F.lit("Role "), k.cast("string")).alias("title"), F.lit("Firm").alias("company"), (k % 60).alias("score"), F.lit("high").alias("tier"), F.when(k % 3 == 0, F.array(F.lit("LOW_SCORE"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        points.alias("breakdown"), F.array(F.lit("gis")).alias("evidence"), F.array(F.lit("sql"), F.lit("gis")).alias("skills"), F.when(k % 5 == 0, F.date_add(F.to_date(now()), 4)).alias("deadline"), F.when(k % 7 == 0, 2).otherwise(0).alias("earlier"),
    )
    return report.explain(jobs, ["gis"], F.to_date(now()))


@query("review_coverage", f"{_SCORED} SELECT tier, count(*) AS n, count(*) FILTER (doc_id % 5 > 0) AS reviewed FROM scored GROUP BY 1")
def review_coverage(spark, sf):
    """AGG-19, AGG-20, VIEW-12."""
    return commands.run("/status", commands.Tables(_jobs(spark, sf), commands.Preferences())).select("tier", "n", "reviewed")


