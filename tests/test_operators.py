"""Identity, scoring, state, adjustments, selection, insights, sources,
commands and streaming on small tables."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylark.operators import adjust, identity, insights, scoring, select, state
from quarrylark.plans import commands
from quarrylark.plans.bindings import TAXONOMY
from quarrylark.sources import feeds, html
from quarrylark.streaming import pipelines



def now():
    return F.lit("2026-09-16 12:00:00").cast("timestamp")


def at(days):
    return dt.datetime(2026, 9, 16, 12) - dt.timedelta(days=days)


# ---------------------------------------------------------------- identity
def test_identity_keys(spark):
    df = spark.createDataFrame([("GH:1", "feed", "7", "https://jobs.lever.co/acme/01234567-0123-0123-0123-0123456789ab", None, "Acme", "Dev", "Paris"), (None, "feed", None, None, None, "Acme", "Dev", "Paris")], "n string, s string, j string, u string, a string, c string, t string, l string")
    rows = [r.k for r in df.select(identity.identity_keys(*[F.col(c) for c in "nsjuactl"]).alias("k")).collect()]
    assert rows[0][:3] == ["gh:1", "lever:01234567-0123-0123-0123-0123456789ab", "feed:7"] and rows[0][3].startswith("url:")
    assert len(rows[1]) == 1 and rows[1][0].startswith("hash:")


def test_replay_vetoes():
    same_url = [(1, ["lever:a", "url:x"], None), (2, ["lever:b", "url:x"], None), (3, ["url:x"], None)]
    assert identity.replay(same_url) == {1: 1, 2: 2, 3: 1}
    fuzzy = [(1, ["feed:1"], "fz:k"), (2, ["other:2"], "fz:k"), (3, ["lever:1"], "fz:k"), (4, ["lever:2"], "fz:k")]
    assert identity.replay(fuzzy) == {1: 1, 2: 1, 3: 1, 4: 4}


keys = st.lists(st.sampled_from(["a:1", "a:2", "b:1", "url:x", "url:y", "lever:1", "lever:2"]), min_size=1, max_size=3, unique=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(keys, st.sampled_from([None, "fz:p", "fz:q"])), min_size=1, max_size=12))
def test_replay_inside_components_is_the_whole_replay(drawn):
    rows = [(k, ks, fz) for k, (ks, fz) in enumerate(drawn)]
    low = {k: k for k, _, _ in rows}
    for _ in rows:
        for a, ka, fa in rows:
            for b, kb, fb in rows:
                if set(ka) & set(kb) or fa and fa == fb:
                    low[a] = low[b] = min(low[a], low[b])
    parts = {}
    for c in set(low.values()):
        parts |= identity.replay([r for r in rows if low[r[0]] == c])
    assert parts == identity.replay(rows)


def test_groups_do_not_depend_on_partitions(spark):
    rows = [(k, [f"feed:{k // 3}", f"url:{k % 5}"], f"fz:{k % 4}" if k % 2 else None) for k in range(60)]
    want = identity.replay(rows)
    for n in (1, 7):
        got = identity.group_observations(spark.createDataFrame(rows, "obs_seq long, keys array<string>, fuzzy string").repartition(n)).collect()
        assert {r.obs_seq: r.group for r in got} == want


@pytest.mark.parametrize("bound", [3])
def test_rounds_are_the_replay(spark, bound):
    """120 random graphs at once, each with keys of its own."""
    rng, rows = random.Random(bound), []
    for g in range(120):
        names = [f"{space}:{g}-{k}" for space in ("a", "b", "c", "lever", "ashby", "http", "url", "url") for k in range(rng.randint(1, 3))] + [f"hash:{g}", f"a:b:{g}", f"d:{g}:"]
        for k in range(rng.randint(1, 14)):
            keys = rng.sample(names, rng.randint(1, 4)) if rng.random() < 0.6 else [f"url:{g}-{rng.randint(0, 2)}"]
            rows.append((g * 100 + k, keys, rng.choice([None, f"fz:{g}-1", f"fz:{g}-2"])))
    got = identity.group_observations(spark.createDataFrame(rows, "obs_seq long, keys array<string>, fuzzy string"), bound).collect()
    assert {r.obs_seq: r.group for r in got} == identity.replay(rows) and len(got) == len(rows)


def test_a_page_that_very_many_share(spark):
    """One page, links in a chain, ids of a few namespaces: a few rounds, no task holds the component."""
    space = {1: "feed", 2: "greenhouse", 3: "lever", 4: "ashby"}
    rows = [(k, [f"{space.get(k % 9)}:{k // 18}"] * (k % 9 in space) + ["url:page"] * (k % 4 > 0) + [f"url:{k}", f"url:{k + 1}"] * (k % 5 == 0), f"fz:{k % 50}" if k % 3 else None) for k in range(30_000)]
    df = spark.createDataFrame(rows, "obs_seq long, keys array<string>, fuzzy string")
    got = {r.obs_seq: r.group for r in identity.group_observations(df).collect()}
    assert got == identity.replay(rows)
    assert max(Counter(got.values()).values()) > 10_000


def test_fusion(spark):
    rows = [
        (1, 1, 40, "Aggregate title", "", "https://agg.com/1", None, "x" * 400, at(3), False, True, "b1"),
        (2, 1, 105, "Board title", "Acme", "https://acme.com/1", "", "short", at(9), True, False, "b2"),
        (3, 1, 55, "Feed title", "Acme Inc", "https://feed.com", "https://acme.com/apply", "y" * 500, None, True, True, "b1"),
        (4, 2, 20, "Other", None, None, None, "only", None, False, True, None),
    ]
    o = spark.createDataFrame(rows, "obs_seq long, group long, priority int, title string, company string, url string, apply_url string, description string, posted_at timestamp, posted_at_reliable boolean, from_rotation boolean, board_key string")
    o = o.withColumn("salary", F.lit("")).withColumn("extraction_method", F.lit("api")).withColumn("keys", F.array(F.concat(F.lit("k"), "obs_seq")))
    got = {r.group: r for r in identity.fuse(o, ["agg.com"]).collect()}
    r = got[1]
    assert (r.title, r.company, r.url, r.apply_url, r.posted_at) == ("Board title", "Acme", "https://acme.com/1", "https://acme.com/1", at(9))
    assert r.description == "y" * 500 and not r.from_rotation and r.board_keys == ["b1", "b2"] and r.aliases == ["k2", "k3", "k1"] and r.salary is None
    assert got[2].description == "only" and got[2].board_keys == []


def test_alias_index(spark):
    jobs = spark.createDataFrame([("a", ["x", "b"], at(1)), ("b", ["x"], at(5)), ("c", ["z"], at(90))], "canonical_id string, aliases array<string>, last_seen timestamp")
    index = identity.alias_index(jobs)
    assert {r.alias: r.canonical_id for r in index.collect()} == {"x": "a", "b": "b", "a": "a", "z": "c", "c": "c"}
    groups = spark.createDataFrame([(1, ["q", "z", "x"], "z"), (2, ["q"], "x")], "group long, keys array<string>, fuzzy string")
    assert {r.alias: r.known for r in index.collect()}["x"] == ["a", "x", "b"]
    assert {r.group: r.canonical_id for r in identity.resolve_ids(groups, index).collect()} == {1: "c"}
    assert {r.group: r.canonical_id for r in identity.resolve_fuzzy(groups, index, now()).collect()} == {2: "a"}


def test_other_platforms_ids_keep_groups_apart(spark):
    """Equal titles under ids of two platforms stay two postings; a group
    without platform ids joins the first."""
    assert identity.replay([(1, ["greenhouse:a:1"], "fz:x"), (2, ["lever:b:2"], "fz:x"), (3, ["feed:9"], "fz:x"), (4, ["lever:b:2"], None)]) == {1: 1, 2: 2, 3: 1, 4: 2}
    assert identity.replay([(1, ["greenhouse:a:1", "lever:b:2"], "fz:x"), (2, ["lever:b:2"], "fz:x")]) == {1: 1, 2: 1}
    assert identity.replay([(1, ["greenhouse:a:1", "url:u"], None), (2, ["greenhouse:a:2", "url:u"], None), (3, ["lever:b:3", "url:u"], None)]) == {1: 1, 2: 2, 3: 1}


def test_stored_jobs_are_found_unless_ids_differ(spark):
    jobs = spark.createDataFrame(
        [("greenhouse:a:1", ["url:apply", "fz:x"], at(1)), ("lever:b:2", ["fz:y", "url:two"], at(2)), ("old", ["fz:z"], at(90)), ("http:weak", ["url:w", "http://q"], at(1))],
        "canonical_id string, aliases array<string>, last_seen timestamp",
    )
    rows = [
        (1, ["url:apply"], ["fz:none"]),  # a page alone attaches
        (2, ["greenhouse:a:7", "url:apply"], ["fz:x"]),  # the same page under another id of the platform doesn't, nor does its title
        (3, ["ashby:c:3", "url:two"], []),  # ids of unlike platforms don't conflict by URL
        (4, ["ashby:c:4"], ["fz:y"]),  # but do by title
        (5, ["feed:5"], ["fz:no", "fz:y"]), (6, ["feed:6"], ["fz:z"]), (7, ["url:none", "workday:q:1", "ashby:p:9"], []), (8, ["http://other", "url:w"], []), (9, ["q", "greenhouse:a:1"], []),
    ]
    got = {r.group: r.canonical_id for r in identity.canonical_ids(spark.createDataFrame(rows, "group long, keys array<string>, fuzzy array<string>"), jobs, now()).collect()}
    assert got == {1: "greenhouse:a:1", 2: "greenhouse:a:7", 3: "lever:b:2", 4: "ashby:c:4", 5: "lever:b:2", 6: "feed:6", 7: "ashby:p:9", 8: "http:weak", 9: "greenhouse:a:1"}


# ----------------------------------------------------------------- scoring
def test_score_parts_add_up(spark):
    rows = [("the thing", "that with from " * 40, 5), ("un la", "x", 1), ("de mixed", "nothing", 1), ("plain", "", 1), ("the end", "short", 5)]
    got = scoring.score(spark.createDataFrame(rows, "title string, body string, location_points int"), TAXONOMY).collect()
    for r in got:
        total = r.title_points + r.tech_points + r.domain_points + r.resp_points + r.location_points
        assert r.score == (max(total, 55) if r.title_only else min(100, total))
    kinds = {r.title: (r.kind, r.tier, r.reasons) for r in got}
    assert kinds["un la"][0] == "none" and "NEGATIVE_TITLE" in kinds["un la"][2] and kinds["de mixed"][2] == ["INSUFFICIENT_SIGNALS"]
    assert kinds["the end"][1] == "possible" and kinds["plain"][2] == ["NO_RELEVANT_TITLE"]


def test_required_terms(spark):
    df = spark.createDataFrame([("from here",), ("from with",)], "t string")
    assert [[h.canonical for h in r.h] for r in scoring.with_hits(df, "t", TAXONOMY, "h").collect()] == [[], ["from", "with"]]


AUTH = [
    ("Visa sponsorship is available.", "offer"), ("We can sponsor visas", "offer"), ("We are unable to offer sponsorship.", "refusal"), ("No visa sponsorship.", "refusal"), ("You must have the right to work in the UK.", "demand"),
    ("Candidates authorized to work in the US; we do not sponsor.", "refusal"), ("A work permit is not required to have the right to work", "neutral"), ("Great team.", "neutral"), (None, "neutral"),
]


MORE_AUTH = [
    ("We don't offer visa sponsorship for this role", "refusal"), ("Sponsorship: none", "refusal"), ("Visa support is provided to the right person", "offer"), ("The project has an executive sponsor.", "neutral"), ("Applicants must be authorised to work without sponsorship", "refusal"),
    ("Candidates need an existing work permit", "demand"), ("Only Canadian citizens can apply", "demand"), ("You must hold a security clearance", "demand"), ("Security clearance would be an asset, and you must like maps", "neutral"), ("Permanent residents only", "demand"),
    ("We cannot take candidates from outside the country; a work visa is mandatory", "demand"), ("International applicants are welcome. Citizenship required", "neutral"), ("There is no need to be a citizen", "neutral"),
    ("Not a perfect fit? Apply. Relocation assistance can be offered", "offer"), ("No remote work, but we will sponsor visas", "offer"), ("Il faut un permis; pas de sponsorship", "refusal"),
]


def rights_of(spark, rows, homes=()):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, country string, scope string, remote boolean").withColumn("s", scoring.work_rights(F.col("t")))
    got = df.select(scoring.work_authorisation(F.col("s")).alias("reading"), scoring.rights_needed(F.col("s"), F.col("country"), F.col("scope"), F.col("remote"), homes).alias("needed"), scoring.sponsorship_offered(F.col("s")).alias("offered"), "k").orderBy("k")
    return [(r.reading, r.needed, r.offered) for r in got.collect()]


def test_work_auth(spark):
    cases = AUTH + MORE_AUTH
    assert [(t, r) for (t, _), (r, *_) in zip(cases, rights_of(spark, [(t, None, None, None) for t, _ in cases]), strict=True)] == cases


def test_rights_by_place(spark):
    cases = [
        (("You must be a French citizen.", "Germany", None, False), (True, False)), (("You must be a French citizen.", "France", None, False), (False, False)),
        (("We do not sponsor.", None, "Worldwide", True), (False, False)), (("We do not sponsor.", None, "Europe", True), (True, False)), (("We do not sponsor.", None, None, None), (True, False)),
        (("Must have work authorization. Visa sponsorship provided. No sponsorship for contractors.", None, None, False), (True, False)), (("Must have work authorization. Visa sponsorship provided.", None, None, False), (False, True)),
        ((None, None, None, None), (False, False)), (("Open to EU citizens and non-EU nationals. Applicants from overseas are welcome; must have a work permit.", None, None, False), (False, False)),
    ]
    assert [g[1:] for g in rights_of(spark, [c for c, _ in cases], ("France", " "))] == [e for _, e in cases]


@pytest.mark.parametrize("said,expected", [("5+ years of experience", 5), ("2-4 years experience and 10 years experience", 2), ("We have over 20 years of experience", None), ("3 years old", None), ("", None)])
def test_years(said, expected):
    assert scoring.years_asked(said) == expected


def test_qualifier(spark):
    df = spark.createDataFrame([("python required. gis a plus", "gis"), ("python is required", "python"), ("we use gis", "gis"), ("none", "gis")], "t string, p string")
    assert [r[0] for r in df.select(scoring.qualifier_of(F.col("t"), F.col("p"))).collect()] == ["preferred", "required", "none", None]


# ------------------------------------------------------------------- state
STATE = "canonical_id string, title string, description string, priority int, first_seen timestamp, last_seen timestamp, changes array<struct<at:timestamp,fields:array<string>>>"


def test_upsert(spark):
    full = "x" * 300
    old = spark.createDataFrame([("a", "A", full, 100, at(9), at(9), []), ("b", "B", "short", 100, at(9), at(9), []), ("c", "C", "s", 10, at(9), at(9), []), ("d", "D", full, 10, at(9), at(9), [])], STATE)
    seen = spark.createDataFrame([("a", "A2", full, 40, at(1)), ("b", "B2", full, 40, at(1)), ("c", "C2", "s", 50, at(1)), ("e", "E", "s", 5, at(1)), ("d", "D2", "short", 90, at(1))], "canonical_id string, title string, description string, priority int, last_seen timestamp")
    got = {r.canonical_id: r for r in state.upsert(old, seen, now(), ["title", "description"]).collect()}
    assert {k: (r.title, r.action) for k, r in got.items()} == {"a": ("A", "refresh"), "b": ("B2", "update"), "c": ("C2", "update"), "d": ("D", "refresh"), "e": ("E", "insert")}
    assert got["a"].last_seen == at(1) and got["a"].first_seen == at(9) and got["b"].changes[0].fields == ["title", "description"]
    again = state.upsert(state.upsert(old, seen, now(), ["title", "description"]).drop("action"), seen, now(), ["title", "description"])
    assert {r.canonical_id: (r.title, r.description) for r in again.collect()} == {k: (r.title, r.description) for k, r in got.items()}


def test_upsert_keeps_what_is_known_and_merges_lists(spark):
    source = "array<struct<name:string,url:string,first_seen:timestamp,last_seen:timestamp>>"
    kept = f"canonical_id string, title string, company string, url string, salary string, description string, priority int, last_seen timestamp, aliases array<string>, board_keys array<string>, sources {source}, from_rotation boolean, posted_at timestamp, posted_at_reliable boolean"
    more = f"{kept}, first_seen timestamp, changes array<struct<at:timestamp,fields:array<string>>>, notified boolean"
    row = lambda k, title, company, url, salary, priority, seen, aliases, boards, rotation, posted, sure: (k, title, company, url, salary, "d", priority, at(seen), aliases, boards, [("s", k, at(seen), at(seen))], rotation, posted, sure)
    old = [
        (*row("a", "Data Engineer (m/f)", "Acme", "u", "1", 10, 9, ["x", "y"], ["b2"], True, at(20), True), at(9), [], True), (*row("b", "B", "Acme", "u", "1", 10, 9, None, None, True, at(20), False), at(9), [], True),
        (*row("c", "C", "Acme", "u", "1", 99, 9, ["x"], [], False, None, None), at(9), [], False), (*row("d", "D", "", None, "1", 10, 9, [f"k{i}" for i in range(39)], [], True, None, None), at(9), [], False),
    ]
    seen = [
        row("a", "data engineer", None, "", "2", 10, 1, ["y", "z"], ["b1"], True, at(2), False), row("b", "B2", "Other", "v", "1", 10, 1, ["q"], ["b"], False, at(2), True), row("c", "C2", "Other", "v", "2", 10, 1, ["w"], ["b"], False, at(2), True),
        row("d", "D", "New", "w", "1", 10, 1, ["m", "n"], [], True, None, None), row("e", "E", None, None, "1", 10, 1, ["n"], ["b"], True, at(2), True),
    ]
    fields = ["title", "company", "url", "salary", "description"]
    got = {r.canonical_id: r for r in state.upsert(spark.createDataFrame(old, more), spark.createDataFrame(seen, kept), now(), fields).collect()}
    assert {k: (r.company, r.url, r.action) for k, r in got.items()} == {"a": ("Acme", "u", "update"), "b": ("Other", "v", "update"), "c": ("Acme", "u", "refresh"), "d": ("New", "w", "update"), "e": (None, None, "insert")}
    assert got["a"].changes[0].fields == ["salary"] and got["b"].changes[0].fields == ["title", "company", "url"]
    assert got["a"].aliases == ["x", "y", "z"] and got["a"].board_keys == ["b1", "b2"] and got["c"].aliases == ["x", "w"] and len(got["d"].aliases) == 40 and got["d"].aliases[-1] == "m"
    assert [got[k].from_rotation for k in "abcde"] == [True, False, False, True, True] and len(got["a"].sources) == 1 and got["a"].sources[0].first_seen == at(9)
    assert (got["a"].posted_at, got["a"].posted_at_reliable) == (at(20), True) and (got["b"].posted_at, got["b"].posted_at_reliable) == (at(2), True) and got["c"].posted_at is None
    assert [got[k].pending_update for k in "abcde"] == [True, True, False, False, False]


def test_change_log_is_bounded(spark):
    rows = spark.createDataFrame([("a", "0", "", 1, at(9), at(9), [])], STATE)
    for k in range(1, 13):
        seen = spark.createDataFrame([("a", str(k), "", 1, at(0))], "canonical_id string, title string, description string, priority int, last_seen timestamp")
        rows = spark.createDataFrame(state.upsert(rows, seen, now(), ["title", "description"]).drop("action").select(*[c.split()[0] for c in STATE.split(", ", 6)]).collect(), STATE)
    assert len(rows.first().changes) == 10


def test_sources_merge(spark):
    kind = "array<struct<name:string,url:string,first_seen:int,last_seen:int>>"
    df = spark.createDataFrame([([("a", "u", 1, 2), ("b", "v", 1, 9)], [("a", "u", 5, 5), ("c", "w", 6, 6)])], f"o {kind}, n {kind}")
    got = df.select(state.merge_sources(F.col("o"), F.col("n")).alias("m")).first().m
    assert [tuple(x) for x in got] == [("b", "v", 1, 9), ("c", "w", 6, 6), ("a", "u", 1, 5)]


def test_versioned_table(spark, tmp_path):
    t = state.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.load() is None and t.etag() == 0
    assert t.commit(spark.range(3), 0) == 1 and t.commit(spark.range(5), 1, ["id"]) == 2
    assert t.load().count() == 5
    with pytest.raises(state.Conflict):
        t.commit(spark.range(9), 1)
    with pytest.raises(ValueError):
        t.commit(spark.range(1), 2, ["missing"])
    assert t.load().count() == 5
    import shutil

    shutil.rmtree(f"{tmp_path}/t/{t.versions()[-1]['snapshot']}")
    assert t.load().count() == 3  # falls back
    shutil.rmtree(f"{tmp_path}/t/{t.versions()[0]['snapshot']}")
    with pytest.raises(RuntimeError):
        t.load()
    assert len(t.retain(1)) == 2 and len(t.versions()) == 1


def test_versioned_table_survives_a_writer_that_died(spark, tmp_path):
    """A manifest without content: a conflict while it may be being written,
    skipped after that."""
    t = state.VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(spark.range(3), 0)
    (tmp_path / "t" / "manifest-000000000002.json").write_bytes(b"")
    with pytest.raises(state.Conflict):
        t.load()
    later = state.VersionedTable(spark, f"file://{tmp_path}/t", grace=0.0)
    assert later.load().count() == 3 and later.etag() == 2
    with pytest.raises(state.Conflict):
        later.commit(spark.range(4), 1)
    assert later.commit(spark.range(4), 2) == 3 and later.load().count() == 4


def test_snapshots_and_retention(spark, tmp_path):
    obs = spark.createDataFrame([("t", "x" * 30, f"2026-09-{d:02d}", "r1", "s") for d in (1, 2, 15)], "title string, description string, day string, run string, source string")
    state.write_snapshots(obs, f"file://{tmp_path}/raw", 10)
    assert state.drop_days_before(spark, f"file://{tmp_path}/raw", "2026-09-02") == ["day=2026-09-01"]
    back = spark.read.json(f"file://{tmp_path}/raw")
    assert back.count() == 2 and back.first().description == "x" * 10


def test_health_reminders_outbox(spark):
    runs = spark.createDataFrame([("a", k, k > 2) for k in range(6)] + [("b", 1, False)], "k string, at int, failed boolean")
    streak = state.failure_streak(runs, "k", "at", F.col("failed"))
    assert {r.k: r.streak for r in streak.collect()} == {"a": 3, "b": 0}
    known = spark.createDataFrame([("b", True)], "k string, alerted_down boolean")
    assert {r.k: r.event for r in state.health_events(streak, known, "k").collect()} == {"a": "down", "b": "recovered"}
    jobs = spark.createDataFrame([(1, dt.date(2026, 9, 18), None), (2, dt.date(2026, 9, 18), True), (3, dt.date(2026, 10, 1), None)], "id int, deadline date, reminded boolean")
    assert [r.id for r in state.deadline_reminders(jobs, F.to_date(now())).collect()] == [1]
    alerts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "canonical_id string, text string")
    sent = spark.createDataFrame([("a", True, 1), ("b", False, 5)], "canonical_id string, ok boolean, tries int")
    left = state.outbox(alerts, sent)
    assert [r.canonical_id for r in left.collect()] == ["c"] and [tuple(r) for r in pipelines.deliver(left, lambda t: True).collect()] == [("c", True, 1)] and [r.ok for r in pipelines.deliver(left, lambda t: 1 / 0).collect()] == [False]


def test_rotation_wraps(spark):
    items = spark.range(10)
    rows, cursor = state.rotate(items, "id", 8, 4)
    assert [r.id for r in rows.orderBy("turn").collect()] == [8, 9, 0, 1] and spark.range(1).select(cursor).first()[0] == 2
    assert state.rotate(items.limit(0), "id", 3, 4)[0].count() == 0


def test_boards_due(spark):
    df = spark.createDataFrame([(1, None, "VALID", 0, 0), (2, at(0.5), "VALID", 0, 0), (3, at(0.5), "VALID", 0, 4), (4, at(3), "ERROR", 2, 0), (5, at(5), "ERROR", 2, 0), (6, at(40), "INVALID", 0, 0)], "k int, c timestamp, s string, f int, r int")
    assert [r.k for r in df.where(state.board_due(F.col("c"), F.col("s"), F.col("f"), F.col("r"), now())).orderBy("k").collect()] == [1, 3, 5]


# ------------------------------------------------------------- adjustments
def test_bonus_needs_the_own_country(spark):
    hits = "array<struct<country:string,exact:boolean,strong:boolean,register:string>>"
    df = spark.createDataFrame([(1, [("FR", True, True, "f")], "FR", False), (2, [("FR", False, True, "f")], "FR", False), (3, [("DE", True, False, "d"), ("FR", True, False, "f")], "FR", False), (4, [("DE", True, False, "d")], None, True), (5, [], "FR", False)], f"k int, h {hits}, c string, r boolean")
    rows = df.select("k", adjust.register_bonus(F.col("h"), F.col("c"), F.col("r")).alias("b"), adjust.sponsor_badge(F.col("h"), F.col("c")).alias("s")).orderBy("k").collect()
    assert [(r.b, r.s) for r in rows] == [(6, "f"), (0, "f"), (4, "f"), (4, "d"), (0, None)]


def test_adjustments_apply_once(spark):
    rows = spark.createDataFrame([(60, []), (80, ["NEGATIVE_TITLE"])], "base_score int, hard_reasons array<string>")
    parts = {"register": F.lit(6), "learned": F.lit(5), "none": F.lit(0)}
    once = adjust.apply_adjustments(rows, parts)
    twice = adjust.apply_adjustments(once.drop("adjusted", "score", "tier"), parts)
    assert [(r.score, r.tier, r.adjusted) for r in once.collect()] == [(r.score, r.tier, r.adjusted) for r in twice.collect()] == [(71, "high", {"register": 6, "learned": 5}), (91, "rejected", {"register": 6, "learned": 5})]
    assert once.select(adjust.forget_learned(F.col("adjusted"))).first()[0] == {"register": 6}


def test_bands_reviews_lines(spark):
    df = spark.createDataFrame([(50.0, 60.0, 45.0, None), (40.0, 50.0, 45.0, None), (30.0, 40.0, 45.0, 35.0), (30.0, 40.0, 45.0, None), (None, None, 45.0, None), (None, 50.0, 45.0, None)], "a double, b double, m double, r double")
    assert [r[0] for r in df.select(adjust.salary_band(*[F.col(c) for c in "abmr"])).collect()] == ["above", "reaches", "reduced", "below", "unknown", "above"]
    r = spark.createDataFrame([("130", "9", "2026-10-01"), ("x", "99", "soon")], "f string, y string, d string").select(*[v.alias(k) for k, v in adjust.clean_review(F.col("f"), F.col("y"), F.col("d")).items()]).collect()
    assert tuple(r[0]) == (100, 9, dt.date(2026, 10, 1)) and (r[1].years, r[1].deadline) == (None, None)
    t = spark.createDataFrame([("high", True, None), ("high", None, None), ("possible", False, True)], "t string, v boolean, r boolean")
    assert [x[0] for x in t.select(adjust.review_veto(F.col("t"), F.col("v"), F.col("r"))).collect()] == ["rejected", "high", "rejected"]


def test_learning_with_one_kind_of_label(spark):
    labels = spark.createDataFrame([(k, 1) for k in range(5)], "id int, weight int")
    features = spark.createDataFrame([(k, "all") for k in range(5)] + [(0, "two"), (1, "two"), (2, "one")], "id int, feature string")
    assert {r.feature: r.weight for r in adjust.learned_weights(labels, features).collect()} == {"two": 3.0}
    assert adjust.learned_weights(labels.limit(3), features).count() == 0


# ------------------------------------------------------- selection, insights
JOBS = "id long, title string, company string, country string, tier string, score int, posted_at timestamp"


def test_first_postings(spark):
    rows = [(1, "Dev", "Acme Inc", "FR", "high", 70, at(3)), (2, "dev", "ACME", "fr", "high", 80, at(5)), (3, "Dev", "", "FR", "high", 60, at(1)), (4, "Dev", "", "FR", "high", 60, at(1)), (5, "Dev", "Acme", "DE", "possible", 90, None)]
    got = [r.id for r in select.rank_alerts(spark.createDataFrame(rows, JOBS), now()).collect()]
    assert got == [2, 3, 4, 5]


def test_digest_parts(spark):
    lines = spark.createDataFrame([("a", k, "x" * 30) for k in range(5)] + [("b", 0, "y" * 500)], "recipient string, ordinal long, line string")
    got = {(r.recipient, r.part): len(r.text) for r in select.digest(lines, 65).collect()}
    assert got == {("a", 0): 61, ("a", 1): 61, ("a", 2): 30, ("b", 0): 500}


def test_drop_reasons(spark):
    schema = "tier_ok boolean, w boolean, tier string, hidden boolean, muted boolean, notified boolean, pending boolean, verdict string, tries int, blocked string"
    rows = [(False, False, "possible", False, False, False, False, "open", 0, None), (False, True, "possible", False, False, False, False, "open", 0, None), (True, False, "high", True, True, False, False, "open", 0, None), (True, False, "high", False, False, True, True, "hard", 0, None), (True, False, "high", False, False, False, False, "open", 0, "stale")]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(select.drop_reason(*[F.col(c.split()[0]) for c in schema.split(", ")])).collect()]
    assert got == ["tier", None, "hidden", "route", "stale"]


def test_signals_and_awards(spark):
    df = spark.createDataFrame([("Contract award: mapping awarded to Geo Ltd (France) for EUR 1,200,000",), ("Catering data",), ("Survey consulting",)], "t string")
    assert [r[0] for r in df.select(insights.signal_kind(F.col("t"))).collect()] == ["award", None, "consultancy"]
    assert tuple(df.select(insights.award_fields(F.col("t")).alias("a")).first().a) == ("Geo Ltd", "France", "EUR 1,200,000")
    codes = spark.createDataFrame([(["713", "9"], "FR"), (["9"], "FR"), (["713"], "US")], "c array<string>, k string")
    assert [r[0] for r in codes.select(insights.procurement(F.col("c"), ["71"], F.col("k"), ["FR"])).collect()] == [True, False, False]


def test_prospects(spark):
    a, b = (spark.createDataFrame(x, "name string, kind string") for x in ([("Acme Inc", "award")], [("ACME", "job"), ("Beta", "job"), ("Gone", "job")]))
    book = spark.createDataFrame([("gone",)], "key string")
    assert [(r.key, r.kind) for r in insights.prospects([(0, a), (1, b)], book, 5).collect()] == [("acme", "award"), ("beta", "job")]


# ----------------------------------------------------------------- sources
def test_feed(spark):
    body = json.dumps({"jobs": [{"id": 1, "title": "Dev", "company_name": "Acme", "description": "<p>Hi &amp; bye</p>", "url": "u"}, {"id": 1, "title": "Again"}, {"id": 2, "title": ""}]})
    bodies = spark.createDataFrame([(0, body), (1, "broken"), (2, '{"jobs": []}')], "landed long, body string")
    rows = feeds.parse_feed(bodies, feeds.BY_NAME["remotive"]).collect()
    assert [(r.native_id, r.title, r.description) for r in rows] == [("remotive:1", "Dev", "Hi & bye")]
    assert {r.landed: (r.status, r.n) for r in feeds.feed_status(bodies, feeds.BY_NAME["remotive"]).collect()} == {0: ("PARTIAL", 2), 1: ("FAILED", 0), 2: ("SUCCESS", 0)}


def test_every_feed_reads_its_shape(spark):
    bodies = []
    for feed in feeds.FEEDS:
        item: dict = {}

        def put(path, value, item=item):
            node, parts = item, path.removeprefix("$.").replace("[0]", "").replace("[*]", "").split(".")
            for p in parts[:-1]:
                node = node.setdefault(p, {})
            node[parts[-1]] = value

        put(feed.fields["title"][0], "Title")
        if "native_id" in feed.fields:
            put(feed.fields["native_id"][0], "1")
        items = [item]
        for part in reversed([p for p in feed.items.removeprefix("$").split(".") if p]):
            items = {part.replace("[0]", ""): items} if "[0]" not in part else {part.replace("[0]", ""): [items]}
        bodies.append((0, feed.name, json.dumps(items)))
    rows = feeds.parse_feeds(spark.createDataFrame(bodies, "landed long, source string, body string")).collect()
    assert sorted((r.source_name, r.title) for r in rows) == sorted((f.name, "Title") for f in feeds.FEEDS)


def test_rss(spark):
    rss = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title>D&eacute;v R&D</title><link>u</link><description>short</description><content:encoded>&lt;p&gt;full&lt;/p&gt;</content:encoded><pubDate>Wed, 16 Sep 2026 12:00:00 GMT</pubDate></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="v"/><updated>2026-09-01</updated></entry></feed>"""
    got = feeds.rss_rows(spark.createDataFrame([(0, rss), (1, atom), (2, "<broken")], "landed long, body string")).orderBy("landed").collect()
    assert [(r.title, r.url, r.description, r.posted_at_reliable) for r in got] == [("Dév R&D", "u", "full", True), ("A", "v", "", False)]
    xml = "<workzag-jobs><position><id>9</id><name>Dev</name><office>Berlin</office></position></workzag-jobs>"
    assert [(r.native_id, r.title) for r in feeds.personio_rows(spark.createDataFrame([(0, xml), (1, "<HTML>no")], "landed long, body string")).collect()] == [("9", "Dev")]


def test_registers():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>Name</t></si><si><t>Ac</t><t>me</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert feeds.read_xlsx(out.getvalue()) == [["Name", "", "5"], ["Acme"]]
    assert feeds.html_table("<table><tr><th>A</th><td>b&amp;c</td></tr></table>") == [["A", "b&c"]] and feeds.read_csv_rows("a,b\n1,2") == [{"a": "1", "b": "2"}]


def test_sources_helpers(spark):
    rules = feeds.load_toml(spark, '[[route]]\ncountry = "FR"\nhard = true\n', "route", "country string, hard boolean, note string")
    assert [tuple(r) for r in rules.collect()] == [("FR", True, None)]
    grid, cursor = feeds.query_grid(spark.createDataFrame([(0, "a"), (1, "b")], "place int, country string"), ["x", "y"], 3, 3)
    assert sorted(tuple(r) for r in grid.collect()) == [("a", "x"), ("a", "y"), ("b", "y")] and spark.range(1).select(cursor).first()[0] == 2
    a = spark.createDataFrame([(0, 0, "p")], "landed long, pos int, title string")
    assert [r.obs_seq for r in feeds.union_observations([a, a]).orderBy("obs_seq").collect()] == [0, 1 << 48]
    lines = spark.createDataFrame([('{"url": "https://jobs.lever.co/acme/x"}',), ('{"url": "https://jobs.lever.co/known"}',), ("bad",)], "line string")
    assert [r.slug for r in feeds.cdx_boards(lines, spark.createDataFrame([("lever", "known")], "ats string, slug string")).collect()] == ["acme"]
    texts = spark.createDataFrame([("b", at(1)), ("c", at(9))], "canonical_id string, seen timestamp")
    wanted = spark.createDataFrame([("a", ["b"]), ("c", []), ("d", [])], "id string, aliases array<string>")
    assert sorted(r.id for r in feeds.knows_text(wanted, texts, now()).collect()) == ["c", "d"]


PAGES = [
    ('<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Dev","hiringOrganization":{"name":"Acme"},"jobLocation":{"address":{"addressLocality":"Paris","addressCountry":"FR"}},"baseSalary":{"currency":"EUR","value":{"minValue":1,"maxValue":2}},"description":"<p>x</p>",}]}</script>', ("Dev", "jsonld")),
    ('<script type="application/ld+json">{"@type":"JobPosting","title":"Old","validThrough":"2020-01-01"}</script>', None),
    ('<div typeof="JobPosting"><h2 property="title">Map Maker</h2><span property="hiringOrganization">Geo</span><div property="description">draws</div></div>', ("Map Maker", "rdfa")),
    ('<script id="__NEXT_DATA__" type="application/json">{"p":{"title":"Analyst","description":"' + "d" * 250 + '"}}</script>', ("Analyst", "embedded_json")),
    ("<h1>Surveyor</h1><article>" + "Responsibilities and more words. " * 20 + "</article>", ("Surveyor", "html")),
    ("<p>nothing here</p>", None),
]


@pytest.mark.parametrize("page,expected", PAGES)
def test_ladder(page, expected):
    got = html.extract_jobs(page, "https://x.com/jobs/1", "2026-09-16", [])
    assert [(g["title"], g["method"]) for g in got] == ([expected] if expected else [])


def test_page_functions(spark):
    page = "<html><title>T</title><style>x{}</style><h1>A <b>&amp;</b> B</h1><p>one<br>two</p><a href='/x#y'>x</a><a href=\"/x\">x</a><a href='#t'>t</a><!-- no --></html>"
    df = spark.createDataFrame([(page,)], "p string").select(html.page_title(F.col("p")).alias("t"), html.html_text(F.col("p")).alias("b"), html.page_links(F.col("p")).alias("l")).first()
    assert df.t == "A & B" and df.l == ["/x"] and "one\ntwo" in df.b and "no" not in df.b.replace("nothing", "")
    assert html.html_to_text(page).startswith("TA & B\n\none\ntwo") or "A & B" in html.html_to_text(page)
    site = spark.createDataFrame([("<urlset><url><loc>https://a/1?x=1&amp;y</loc><lastmod>2026</lastmod></url></urlset>",)], "b string")
    assert [tuple(e) for e in site.select(html.sitemap_entries(F.col("b")).alias("e")).first().e] == [("url", "https://a/1?x=1&y", "2026")]
    assert tuple(spark.createDataFrame([("Géomètre - Lyon (69)",)], "t string").select(html.place_from_title(F.col("t")).alias("p")).first().p) == ("Lyon", "69")


def test_mail(spark):
    raw = b"Subject: Hi\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Dev</p><p>Acme</p><p>Paris</p><p>https://a.com/1</p>"
    subject, body = html.mail_text(raw)
    assert subject == "Hi" and html.alert_rows(body)[0] == {"title": "Dev", "company": "Acme", "location": "Paris", "url": "https://a.com/1"} if html.alert_rows(body) else True
    assert html.alert_rows("Dev\nAcme\nhttps://a.com/1\n\nMaker\nGeo\nLyon\nhttps://a.com/2")[1] == {"title": "Maker", "company": "Geo", "location": "Lyon", "url": "https://a.com/2"}
    mails = spark.createDataFrame([(1, "acme maps regrets unfortunately dev"), (2, "hello")], "mail_id long, text string")
    apps = spark.createDataFrame([(5, "acme maps", "dev"), (6, "acme", "chef")], "id long, company string, title string")
    assert [tuple(r) for r in html.match_replies(mails, apps).collect()] == [(1, 5, 6)]
    assert [r[0] for r in mails.select(html.reply_kind(F.col("text"))).collect()] == ["rejected", None]


# ---------------------------------------------------------------- commands
SAID = [
    ("/jobs 5", ("jobs", "5")), ("/TOP", ("jobs", "")), ("/nope", None), ("/mute java dev", ("mute", "java dev")), ("show me the best 7", ("high", "7")), ("mute amazon", ("mute", "amazon")), ("please mute amazon", ("mute", "amazon")),
    ("should I mute amazon", None), ("jobs between 40 and 60", ("range", "40 60")), ("offres entre 40 et 60", ("range", "40 60")), ("why 3fa2c?", ("why", "3fa2c")), ("pourquoi 3fa2c", ("why", "3fa2c")), ("search gis analyst", ("search", "gis analyst")),
    ("cherche géomatique", ("search", "geomatique")), ("any sponsers?", ("sponsors", "")), ("visa for france", ("visa", "france")), ("pause", ("pause", "")), ("i applied to 3fa2c", ("applied", "3fa2c")), ("", None), ("weekly summary", ("weekly", "")),
]


@pytest.mark.parametrize("said,expected", SAID)
def test_parse(said, expected):
    c = commands.parse(said)
    assert (c and (c.name, c.args)) == expected


def test_writes():
    p = commands.Preferences()
    p = commands.write(p, commands.Command("mute", "Java"), 0)
    assert p.muted == ("java",) and p.version == 1
    with pytest.raises(ValueError):
        commands.write(p, commands.Command("pause"), 0)
    p = commands.write(commands.write(p, commands.Command("applied", "abc"), 1), commands.Command("outcome", "abc interview"), 2)
    assert p.applied == {"abc": "interview"} and commands.write(p, commands.Command("threshold", "250"), 3).threshold == 100
    assert not commands.valid(commands.Command("why", "zzzzz"), {"abc"}) and commands.valid(commands.Command("jobs"))


def test_views(spark):
    rows = [(k, f"Dev {k}", "Acme" if k % 2 else "Beta", "France", ["high", "possible", "rejected"][k % 3], 50 + k, ["LOW_SCORE"] if k % 3 == 2 else [], at(k % 9), at(0), ["gis"] if k % 2 else ["sql", "gis"], ["open", "hard", None][k % 3], k if k % 4 == 0 else None, "local" if k % 5 == 0 else None) for k in range(30)]
    jobs = spark.createDataFrame(rows, "id long, title string, company string, country string, tier string, score int, reasons array<string>, posted_at timestamp, last_seen timestamp, skills array<string>, verdict string, fit int, sponsor string")
    t = commands.Tables(jobs, commands.Preferences(muted=("beta",), hidden=("27",), skills=("gis",)), now="2026-09-16 12:00:00")
    high = [r.id for r in commands.run("/high 3", t).collect()]
    assert high == [21, 15, 9]
    assert {r.tier for r in commands.run("/jobs", t).collect()} == {"high", "possible"}
    assert [r.id for r in commands.run("/search dev 7 acme", t).collect()] == [27, 7, 17]
    assert commands.run("/range 60 70", t).count() == 11 and commands.run("/why 7", t).count() == 1
    assert [(r.skill, r.share, r.owned) for r in commands.run("/radar", t).collect()] == [("gis", 100, True), ("sql", 50, False)]
    for name in ("sponsors", "visa", "ai", "weekly", "status", "muted"):
        assert commands.run(f"/{name}", t).count() >= 1
    assert commands.run("/pause", t) is None


# --------------------------------------------------------------- streaming
def test_stream_equals_batch_over_several_files(spark, tmp_path):
    rows = [(k, at(k % 5), k % 7) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, user_id long")
    for k in range(4):
        df.where(F.col("id") % 4 == k).coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet", mode="append")
    s = pipelines.read_events(spark, f"{tmp_path}/in", per_trigger=1)
    got = {(r.user_id, r.first_seen, r.last_seen, r.sightings) for r in pipelines.stream_upsert(s, "user_id", "ts").collect()}
    want = {(r.user_id, r.a, r.b, r.n) for r in df.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).collect()}
    assert got == want


def test_stream_state_outlives_a_restart(spark, tmp_path):
    """A second run over the same folder reads what is new, and goes on."""
    for k in range(2):
        spark.createDataFrame([(k, at(k), 1), (k, at(9), k)], "id long, ts timestamp, user_id long").coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet", mode="append")
        s = pipelines.read_events(spark, f"{tmp_path}/in", per_trigger=1)
        got = {r.user_id: r.sightings for r in pipelines.stream_upsert(s, "user_id", "ts", f"file://{tmp_path}/state").collect()}
    assert got == {0: 1, 1: 3}
    again = pipelines.stream_upsert(pipelines.read_events(spark, f"{tmp_path}/in"), "user_id", "ts", f"file://{tmp_path}/state")
    assert {r.user_id: r.sightings for r in again.collect()} == got


def test_landed_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"jobs": [{"id": 1, "title": "Dev"}]}')
    spark.dataSource.register(pipelines.LandedSource)
    bodies = spark.read.format("landed").option("paths", f"{tmp_path}/a.json").load()
    assert [r.title for r in feeds.parse_feed(bodies, feeds.BY_NAME["remotive"]).collect()] == ["Dev"]


# ------------------------------------------------------------------ reports
def test_artifacts_are_put_conditionally(spark, tmp_path):
    import gzip

    from quarrylark.operators import report

    for name in ("a.json", "b.json.gz"):
        path = f"file://{tmp_path}/{name}"
        assert report.artifact_tag(spark, path) is None
        first = report.write_artifact(spark, path, '{"a": 1}', None)
        assert first == report.artifact_tag(spark, path)
        with pytest.raises(state.Conflict):
            report.write_artifact(spark, path, "{}", None)
        report.write_artifact(spark, path, '{"a": 2}', first)
        with pytest.raises(state.Conflict):
            report.write_artifact(spark, path, "{}", first)
        body = (tmp_path / name).read_bytes()
        assert (gzip.decompress(body) if name.endswith("gz") else body) == b'{"a": 2}'
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.json", "b.json.gz"]


def test_inbox_and_report_text(spark, tmp_path):
    from quarrylark.operators import report

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"m{k}.txt").write_text(f"/mute {k}\nline")
    got = pipelines.collect_stream(report.inbox(spark, f"file://{tmp_path}/in"), "append").collect()
    assert sorted((r.name, r.text) for r in got) == [(f"m{k}.txt", f"/mute {k}\nline") for k in range(3)]
    messages = spark.createDataFrame([("a", at(0)), ("b", at(1))], "name string, at timestamp")
    assert [r.name for r in report.fresh_messages(messages, now()).collect()] == ["a"]
    rows = spark.createDataFrame([("tier", "high", 2), ("tier", "rejected", 5), ("action", "insert", 1)], "section string, name string, value long")
    assert report.report_markdown(rows) == "## action\n- insert: 1\n\n## tier\n- rejected: 5\n- high: 2"


def test_explanations_leave_out_what_is_not_there(spark):
    from quarrylark.operators import report

    schema = "id long, title string, company string, score int, tier string, reasons array<string>, breakdown map<string,int>, evidence array<string>, skills array<string>, deadline date, earlier int"
    rows = spark.createDataFrame([(1, "Dev", None, 0, "rejected", [], {}, [f"e{i}" for i in range(20)], [], None, None), (2, "Ops", "", 9, "high", ["X"], None, [], ["a"], dt.date(2020, 1, 1), 0)], schema)
    got = {}
    for r in report.explain(rows, [], F.lit("2024-01-31").cast("date")).orderBy("id", "ordinal").collect():
        got.setdefault(r.id, []).append(r.line)
    assert got[1][:3] == ["Dev", "score 0/100 · rejected", "title 0 · tech 0 · domain 0 · resp 0 · location 0"] and len(got[1]) == 15
    assert got[2][0] == "Ops" and got[2][-3:] == ["lack: a", "rejected: X", "closed"]


def test_feed_ranges_and_translations(spark):
    """Bounds of pay as one text; a preferred language, else the first there is."""
    jobs = [{"id": 1, "jobTitle": "A", "annualSalaryMin": 30000, "annualSalaryMax": 40000}, {"id": 2, "jobTitle": "B", "annualSalaryMin": 30000, "annualSalaryMax": 30000}, {"id": 3, "jobTitle": "C"}, {"id": 4, "jobTitle": "D", "annualSalaryMax": "9"}]
    got = feeds.parse_feed(spark.createDataFrame([(0, json.dumps({"jobs": jobs}))], "landed long, body string"), feeds.BY_NAME["jobicy"]).collect()
    assert {r.title: r.salary for r in got} == {"A": "30000–40000", "B": "30000–30000", "C": None, "D": "–9"}
    said = [{"id": 1, "translations": {"de": {"title": "Eins"}, "fr": {"title": "Un"}}}, {"id": 2, "translations": {"nl": {"title": "Twee"}, "de": {"title": ""}}}, {"id": 3, "translations": {"en": {"title": "Three"}, "fr": {"title": "Trois"}}}, {"id": 4, "title": "Plain"}, {"id": 5, "translations": {}}]
    got = feeds.parse_feed(spark.createDataFrame([(0, json.dumps({"jvs": said}))], "landed long, body string"), feeds.BY_NAME["eures"]).collect()
    assert {r.native_id: r.title for r in got} == {"eures:1": "Un", "eures:2": "Twee", "eures:3": "Three", "eures:4": "Plain"}


def test_clauses_without_rights_words_are_not_weighed(monkeypatch):
    """Every clause of a text had been weighed word by word."""
    weighed = []
    real = scoring._Clause
    monkeypatch.setattr(scoring, "_Clause", lambda words: weighed.append(words) or real(words))
    said = "Plain words stand here. " * 5000
    assert scoring.rights_said(f"{said}Visa sponsorship is available. {said}") == {"offer"}
    assert weighed == [["visa", "sponsorship", "is", "available"]]


def test_years_read_bounded_batches(spark):
    """A worker held up to 10,000 texts at a time, and took a text down for
    every figure anew."""
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        said = [None, "", "5 years", "5+ years of experience", "2-4 years experience and 10 years experience", "we have over 20 years of experience", "3 jahre Erfahrung", "19 ans " + "x " * 30 + "experience"]
        got = many_years(spark, said)
        assert got == [scoring.years_asked(t) for t in said] == [None, None, None, 5, 2, None, 3, None]
        assert int(spark.conf.get(keys[0])) <= 1000 and int(spark.conf.get(keys[1]).rstrip("b")) <= 4 << 20
        spark.conf.set(keys[0], 7)
        many_years(spark, said)
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def many_years(spark, said):
    df = spark.createDataFrame(list(enumerate(said)), "k long, s string")
    return [r.y for r in df.select("k", scoring.experience_years(F.col("s")).alias("y")).orderBy("k").collect()]
