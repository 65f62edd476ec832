"""Entity resolution over observations: keys, groups, fusion (AGG-01 to
AGG-04, JOIN-01, JOIN-02, ARR-01 to ARR-03).

Observations carry obs_seq, which fixes the input order that ties depend on.
Groups are built in three passes (strong keys; URL keys unless the groups'
ids conflict; fuzzy keys unless both groups have platform ids and share
none). Components over all keys hold every group whole. Those in which
nothing can conflict are the groups; in the others of at most `bound`
observations the passes are replayed; larger ones are settled by rounds over
all tasks.

After the first pass an id belongs to one group only. So two groups conflict
over a URL if they know a namespace in common, and over a fuzzy key if both
have platform ids, and those that conflict once always will. A round drops
the links that conflict and settles those that no earlier link can change:
the first remaining link of both its groups, and the first one of a group
without ids, which never conflicts. The rest waits for the next round. A page
that very many share takes a round for each namespace that its group learns.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.functions.text import fold, normalize_company, normalize_title, short_hash
from quarrylark.functions.urls import canonical_url, detect_board, is_aggregator
from quarrylark.operators.graph import components
from quarrylark.session import cut

FULL_TEXT, MAX_ALIASES, FUZZY_TTL_DAYS = 300, 25, 60
#: Observations of a component that one task replays at most.
MOST_REPLAYED = 10_000
#: Namespaces that say nothing about identity, the platforms'
#: namespaces, and the authority of a source type and of an extraction method.
WEAK_NAMESPACES = {"http", "https", "urn", "tag", "mailto"}
PLATFORM_NAMESPACES = {"greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee", "personio", "workday", "oracle"}
AUTHORITY = {"ats": 100, "employer_page": 80, "government": 75, "feed": 55, "aggregator": 40, "search": 20, "unknown": 10}
EXTRACTION = {"api": 5, "jsonld": 3, "rdfa": 3, "embedded_json": 0, "html": -15}


def priority(source_type: Column, method: Column) -> Column:
    table = lambda m, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c), F.lit(0))
    return F.coalesce(table(AUTHORITY, source_type), F.lit(10)) + table(EXTRACTION, method)


def identity_keys(native_id: Column, source_name: Column, source_job_id: Column, url: Column, apply_url: Column, company: Column, title: Column, location: Column) -> Column:
    """Ordered distinct keys, strongest first (ARR-02): the native id, the ids
    in the two URLs, the source's id, the canonical URLs; without any of them
    one hash of company, title and place."""
    source = F.when(source_job_id.contains(":"), source_job_id).otherwise(F.concat_ws(":", source_name, source_job_id))
    url_key = lambda u: F.concat(F.lit("url:"), short_hash(canonical_url(u)))
    keys = F.array(F.lower(native_id), F.lower(detect_board(url)["native_id"]), F.lower(detect_board(apply_url)["native_id"]), F.when(F.length(source_job_id) > 0, F.lower(source)), url_key(url), url_key(apply_url))
    kept = F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (F.length(k) > 0)))
    lone = F.concat(F.lit("hash:"), short_hash(F.concat_ws("|", normalize_company(company), normalize_title(title), fold(location))))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(lone))


def fuzzy_key(company: Column, title: Column, city: Column, country: Column) -> Column:
    """fz: and a hash of company, title and place; null without company or title."""
    c, t = normalize_company(company), normalize_title(title)
    place = F.coalesce(F.nullif(fold(city), F.lit("")), F.nullif(fold(country), F.lit("")), F.lit("remote"))
    return F.when((F.length(c) > 0) & (F.length(t) > 0), F.concat(F.lit("fz:"), short_hash(F.concat_ws("|", c, t, place))))


def ids_by_namespace(keys: list[str]) -> dict[str, set[str]]:
    """Native ids by namespace, without weak ones (ARR-03)."""
    out: dict[str, set[str]] = defaultdict(set)
    for key in keys:
        space, _, rest = key.partition(":")
        if rest and space not in WEAK_NAMESPACES | {"url", "hash", "fz"}:
            out[space].add(rest)
    return out


def conflicting(a: dict[str, set[str]], b: dict[str, set[str]]) -> bool:
    """Whether a namespace that both know has disjoint ids."""
    return any(a[s].isdisjoint(b[s]) for s in a.keys() & b.keys())


def other_posting(a: dict[str, set[str]], b: dict[str, set[str]]) -> bool:
    """Whether both have ids of platforms, of any, and share none."""
    x, y = ({(s, i) for s in ids.keys() & PLATFORM_NAMESPACES for i in ids[s]} for ids in (a, b))
    return bool(x) and bool(y) and x.isdisjoint(y)


def replay(rows: list[tuple[int, list[str], str | None]]) -> dict[int, int]:
    """obs_seq -> the group's first obs_seq, by the three ordered passes over
    (obs_seq, keys, fuzzy key)."""
    rows = sorted(rows)
    parent = {seq: seq for seq, _, _ in rows}
    ids = {seq: ids_by_namespace(keys) for seq, keys, _ in rows}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(a: int, b: int) -> None:
        a, b = sorted((find(a), find(b)))
        if a != b:
            parent[b] = a
            for space, known in ids.pop(b).items():
                ids[a][space] |= known

    owner: dict[str, int] = {}
    for seq, keys, _ in rows:
        for key in keys:
            if not key.startswith("url:"):
                union(owner.setdefault(key, seq), seq)
    for seq, keys, _ in rows:
        for key in keys:
            if key.startswith("url:"):
                first = owner.setdefault(key, seq)
                if not conflicting(ids[find(first)], ids[find(seq)]):
                    union(first, seq)
    for seq, _, fuzzy in rows:
        if fuzzy:
            first = owner.setdefault(fuzzy, seq)
            if not other_posting(ids[find(first)], ids[find(seq)]):
                union(first, seq)
    return {seq: find(seq) for seq, _, _ in rows}


def _first_links(tagged: DataFrame) -> DataFrame:
    """tagged (obs_seq, ordinal, key) -> (a, b, at): each observation and the
    first that has its key; at is the link's place in the order."""
    first = cut(tagged.groupBy("key").agg(F.min("obs_seq").alias("first")))
    return tagged.join(first, "key").where(F.col("obs_seq") != F.col("first")).select(F.col("first").alias("a"), F.col("obs_seq").alias("b"), F.struct("obs_seq", "ordinal").alias("at"))


def _renamed(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """Columns of df replaced by their (node -> component), if they have one."""
    for c in columns:
        to = names.select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"_to_{c}"))
        df = df.join(to, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_to_{c}", c)).drop(f"_{c}", f"_to_{c}")
    return df


def settle(marks: DataFrame, links: DataFrame) -> DataFrame:
    """marks: node, mark (one row a mark, null for none); links: a, b, at.
    Links are followed in order, unless the groups of their ends have a mark
    in common. (node, component) of every node that is not its group's least."""
    known = cut(marks.distinct())
    merged = None
    while True:
        sets = known.groupBy("node").agg(F.collect_set("mark").alias("marks"))
        ends = links
        for c in ("a", "b"):
            ends = ends.join(sets.select(F.col("node").alias(c), F.col("marks").alias(f"{c}_marks")), c)
        ends = ends.where((F.col("a") != F.col("b")) & ~F.arrays_overlap("a_marks", "b_marks"))
        bare = [F.size(f"{c}_marks") == 0 for c in ("a", "b")]
        low = F.col("a") < F.col("b")
        ends = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "at", F.when(low, bare[0]).otherwise(bare[1]).alias("a_bare"), F.when(low, bare[1]).otherwise(bare[0]).alias("b_bare"))
        links = cut(ends.groupBy("a", "b", "a_bare", "b_bare").agg(F.min("at").alias("at")))
        if links.isEmpty():
            return merged if merged is not None else known.select("node", F.col("node").alias("component")).limit(0)
        first = links.select(F.col("a").alias("node"), "at").unionByName(links.select(F.col("b").alias("node"), "at"))
        first = cut(first.groupBy("node").agg(F.min("at").alias("first")))
        asked = links
        for c in ("a", "b"):
            asked = asked.join(first.select(F.col("node").alias(c), F.col("first").alias(f"{c}_first")), c)
        is_a, is_b = F.col("at") == F.col("a_first"), F.col("at") == F.col("b_first")
        stars = components(asked.where(F.col("a_bare") & is_a | F.col("b_bare") & is_b | is_a & is_b), "a", "b").where("node <> component")
        stars = cut(stars)
        known = cut(_renamed(known, stars, "node").distinct())
        # a null mark says that a node exists; it is no mark
        links = _renamed(links.select("a", "b", "at"), stars, "a", "b")
        merged = stars if merged is None else cut(_renamed(merged, stars, "component").unionByName(stars))


def resolve_large(rows: DataFrame) -> DataFrame:
    """rows (obs_seq, keys, fuzzy) -> (obs_seq, group) by rounds."""
    tagged = cut(rows.select("obs_seq", F.posexplode("keys").alias("ordinal", "key")))
    is_url = F.col("key").startswith("url:")
    strong = cut(components(_first_links(tagged.where(~is_url)), "a", "b").where("node <> component"))
    ids = rows.select(F.col("obs_seq").alias("node"), F.explode_outer(strong_ids(F.col("keys"))).alias("id"))
    spaces = cut(_renamed(ids.select("node", _space(F.col("id")).alias("mark")), strong, "node").distinct())
    by_url = settle(spaces, _renamed(_first_links(tagged.where(is_url)), strong, "a", "b"))
    platforms = _renamed(spaces, by_url, "node").select("node", F.when(F.col("mark").isin(*PLATFORM_NAMESPACES), F.col("mark")).isNotNull().alias("p")).groupBy("node").agg(F.when(F.max("p"), "platform").alias("mark"))
    said = rows.where(F.col("fuzzy").isNotNull()).select("obs_seq", F.lit(0).alias("ordinal"), F.col("fuzzy").alias("key"))
    by_fuzzy = settle(platforms, _renamed(_renamed(_first_links(said), strong, "a", "b"), by_url, "a", "b"))
    out = rows.select("obs_seq", F.col("obs_seq").alias("group"))
    for names in (strong, by_url, by_fuzzy):
        out = _renamed(out, names, "group")
    return out


def group_observations(obs: DataFrame, bound: int = MOST_REPLAYED) -> DataFrame:
    """obs (obs_seq, keys, fuzzy) -> (obs_seq, group), AGG-01, JOIN-01."""
    rows = cut(obs.select("obs_seq", "keys", "fuzzy"))
    tagged = rows.select("obs_seq", F.posexplode(F.concat("keys", F.when(F.col("fuzzy").isNotNull(), F.array("fuzzy")).otherwise(F.array().cast("array<string>")))).alias("ordinal", "key"))
    placed = cut(rows.join(components(_first_links(tagged), "a", "b").withColumnRenamed("node", "obs_seq"), "obs_seq", "left"))
    linked = placed.where(F.col("component").isNotNull())
    # at odds: two ids in a namespace, or of platforms
    ids = linked.select("component", F.explode(strong_ids(F.col("keys"))).alias("id"))
    spaces = ids.groupBy("component", _space(F.col("id")).alias("space")).agg((F.min("id") < F.max("id")).alias("several"))
    platform = F.count_if(F.col("space").isin(*PLATFORM_NAMESPACES))
    at_odds = spaces.groupBy("component").agg((F.bool_or("several") | (platform > 1)).alias("odd")).where("odd").select("component")
    sizes = linked.join(at_odds, "component", "left_semi").groupBy("component").agg(F.count("*").alias("n"))
    sizes = cut(sizes)
    marked = placed.join(sizes, "component", "left")

    def each(key: tuple, table: pa.Table) -> pa.Table:
        found = replay([(r["obs_seq"], r["keys"], r["fuzzy"]) for r in table.to_pylist()])
        return pa.table({"obs_seq": pa.array(list(found), pa.int64()), "group": pa.array(list(found.values()), pa.int64())})

    whole = marked.where(F.col("n").isNull()).select("obs_seq", F.coalesce("component", "obs_seq").alias("group"))
    small = marked.where(F.col("n") <= bound).select("component", "obs_seq", "keys", "fuzzy")
    out = whole.unionByName(small.groupBy("component").applyInArrow(each, "obs_seq long, group long"))
    if not sizes.where(F.col("n") > bound).isEmpty():
        out = out.unionByName(resolve_large(cut(marked.where(F.col("n") > bound).select("obs_seq", "keys", "fuzzy"))))
    return out


def fuse(obs: DataFrame, aggregators: list[str] | None = None) -> DataFrame:
    """One row per group (AGG-02 to AGG-04): members by priority, then
    obs_seq; the top's title and method; first non-empty company, url, salary;
    the first description of FULL_TEXT characters, else the longest; the first
    link off the aggregators; reliable dates first; all boards and aliases."""
    rank = F.struct((-F.col("priority")).alias("p"), F.col("obs_seq").alias("s"))
    text = F.coalesce("description", F.lit(""))
    off = lambda c: F.when(~is_aggregator(F.col(c), aggregators or []) & (F.length(c) > 0), F.col(c))
    best = lambda value, cond=None: F.min_by(value, F.when((value.isNotNull() if cond is None else cond), rank))
    truthy = lambda c: best(F.nullif(F.col(c), F.lit("")))
    return obs.groupBy("group").agg(
        F.min_by("title", rank).alias("title"),
        F.max("priority").alias("priority"),
        F.min_by("extraction_method", rank).alias("extraction_method"),
        truthy("company").alias("company"),
        truthy("url").alias("url"),
        truthy("salary").alias("salary"),
        F.coalesce(best(F.col("description"), F.length(text) >= FULL_TEXT), F.max_by("description", F.struct(F.length(text), -F.col("priority"), -F.col("obs_seq")))).alias("description"),
        F.coalesce(best(F.coalesce(off("apply_url"), off("url"))), truthy("apply_url"), truthy("url")).alias("apply_url"),
        F.coalesce(best(F.col("posted_at"), F.col("posted_at_reliable") & F.col("posted_at").isNotNull()), best(F.col("posted_at"))).alias("posted_at"),
        F.bool_and("from_rotation").alias("from_rotation"),
        F.array_sort(F.collect_set("board_key")).alias("board_keys"),
        F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(rank, "keys"))), lambda x: x["keys"]))), 1, MAX_ALIASES).alias("aliases"),
        F.count("*").alias("n_observations"),
    )


def alias_index(jobs: DataFrame) -> DataFrame:
    """(alias, canonical_id, last_seen, known): an own id beats aliases, else
    the job seen last (WIN-08, STA-02); known are the job's id and aliases.
    jobs: canonical_id, aliases, last_seen."""
    known = F.array_distinct(F.concat(F.array(F.lower("canonical_id")), "aliases"))
    named = jobs.select("canonical_id", "last_seen", known.alias("known")).withColumn("alias", F.explode("known"))
    job = F.struct("canonical_id", "last_seen", "known")
    return named.groupBy("alias").agg(F.max_by(job, F.struct(F.col("alias") == F.lower("canonical_id"), "last_seen", "canonical_id")).alias("j")).select("alias", "j.*")


def _space(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def strong_ids(keys: Column) -> Column:
    """The keys that a source issued: no URL, hash or fuzzy key."""
    return F.filter(keys, lambda k: k.contains(":") & (F.length(k) > F.length(_space(k)) + 1) & ~_space(k).isin(*WEAK_NAMESPACES, "url", "hash", "fz"))


def platform_ids(keys: Column) -> Column:
    return F.filter(keys, lambda k: k.contains(":") & _space(k).isin(*PLATFORM_NAMESPACES))


def ids_conflict(a: Column, b: Column) -> Column:
    """Whether a namespace that both key arrays know has disjoint ids."""
    x, y = strong_ids(a), strong_ids(b)
    spaces = F.array_intersect(F.transform(x, _space), F.transform(y, _space))
    return F.size(F.array_except(spaces, F.transform(F.array_intersect(x, y), _space))) > 0


def platforms_differ(a: Column, b: Column) -> Column:
    """Whether both key arrays have platform ids and share none."""
    x, y = platform_ids(a), platform_ids(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def resolve_ids(groups: DataFrame, index: DataFrame) -> DataFrame:
    """(group, canonical_id) by the first key that the index knows (JOIN-01);
    groups: group, keys (ordered). A URL, which postings can share, doesn't
    attach a group to a job whose ids conflict with the group's."""
    asked = groups.select("group", "keys", F.posexplode("keys").alias("ordinal", "alias"))
    found = asked.join(index, "alias").where(~F.col("alias").startswith("url:") | ~ids_conflict(F.col("keys"), F.col("known")))
    return found.groupBy("group").agg(F.min_by("canonical_id", "ordinal").alias("canonical_id"))


def resolve_fuzzy(groups: DataFrame, index: DataFrame, now: Column, ttl_days: int = FUZZY_TTL_DAYS) -> DataFrame:
    """(group, canonical_id) by the first fuzzy key among jobs seen lately, or
    at an unknown time, without other platform ids (JOIN-02); groups: group,
    keys, fuzzy (a key or an ordered array of keys)."""
    fuzzy = F.col("fuzzy") if groups.schema["fuzzy"].dataType.typeName() == "array" else F.array("fuzzy")
    asked = groups.select("group", "keys", F.posexplode(fuzzy).alias("ordinal", "alias"))
    fresh = index.where(F.col("last_seen").isNull() | (F.col("last_seen") >= now - F.make_interval(days=F.lit(ttl_days))))
    found = asked.join(fresh, "alias").where(~platforms_differ(F.col("keys"), F.col("known")))
    return found.groupBy("group").agg(F.min_by("canonical_id", "ordinal").alias("canonical_id"))


def canonical_ids(groups: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """(group, canonical_id) of every group: the stored job's by keys, else by
    fuzzy key, else the group's first platform id in order, else its first
    key. Groups that get one id are one job."""
    index = alias_index(jobs)
    by_key = resolve_ids(groups, index).withColumnRenamed("canonical_id", "by_key")
    by_fuzzy = resolve_fuzzy(groups, index, now).withColumnRenamed("canonical_id", "by_fuzzy")
    own = F.coalesce(F.array_min(platform_ids(F.col("keys"))), F.get("keys", F.lit(0)))
    return groups.join(by_key, "group", "left").join(by_fuzzy, "group", "left").select("group", F.coalesce("by_key", "by_fuzzy", own).alias("canonical_id"))
