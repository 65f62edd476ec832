"""Keyed state: upsert, TTLs, memories, versioned tables (STA-01 to STA-16,
SNK-01 to SNK-11, JOIN-03, JOIN-05, JOIN-12 to JOIN-14, SET-05)."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylark.functions.text import normalize_title
from quarrylark.session import cut

FULL_TEXT, KEEP_CHANGES, KEEP_SOURCES, KEEP_ALIASES, KEEP_ITEMS = 300, 10, 12, 40, 80
FIELDS = ["title", "company", "country", "url", "salary", "description"]
#: Fields that an empty new value doesn't overwrite, and those whose change is worth an alert.
KEPT_FIELDS, ALERT_FIELDS = {"company", "url", "apply_url"}, {"title", "location_raw", "salary", "remote"}
TTL_DAYS = {"fuzzy": 60, "text": 7, "rejected": 30, "kept": 180, "page": 30}
#: Fixed value: pages that the cache keeps.
MAX_PAGES = 30_000
#: Days that a posting counts as listed by what its sources are.
LISTED_DAYS = {"ats": 5, "employer_page": 5, "feed": 21, "other": 35}


#: Fixed values of the watchdog: hours until a missing run is started, until it is told, and starts in a row.
FILL_HOURS, STALE_HOURS, MAX_KICKS = 1.75, 6, 4


def better(new_text: Column, old_text: Column) -> Column:
    """The new text is full where the stored one isn't."""
    return (F.coalesce(F.length(new_text), F.lit(0)) >= FULL_TEXT) & (F.coalesce(F.length(old_text), F.lit(0)) < FULL_TEXT)


def upsert(state: DataFrame, seen: DataFrame, now: Column, fields: list[str] | None = None) -> DataFrame:
    """Merge a run's fused jobs into the state (STA-01, STA-14, JOIN-03). Both:
    canonical_id, the fields, priority, last_seen; state also first_seen and
    changes. New ids are inserted. Known ids are refreshed; their fields are
    overwritten if the new row has the authority and not less text, or more
    text; company and links stay where the new row has none. Changed fields
    are logged, the last KEEP_CHANGES; titles that are equal when normalised
    haven't changed. Adds action.

    Of these, what both frames have is merged at every sighting: aliases (the
    first KEEP_ALIASES), board_keys, sources, from_rotation (only if both).
    posted_at with posted_at_reliable is taken with the fields, but never an
    unreliable date for a reliable one. With notified in the state, a changed
    ALERT_FIELDS of a job that was notified sets pending_update."""
    fields = fields or FIELDS
    old, new = state.alias("o"), seen.alias("n")
    shared = set(state.columns) & set(seen.columns)
    both = old.join(new, F.col("o.canonical_id") == F.col("n.canonical_id"), "full_outer")
    is_new, gone = F.col("o.canonical_id").isNull(), F.col("n.canonical_id").isNull()
    better_, worse = better(F.col("n.description"), F.col("o.description")), better(F.col("o.description"), F.col("n.description"))
    take = is_new | (~gone & (((F.col("n.priority") >= F.col("o.priority")) & ~worse) | better_))

    def value(f: str) -> Column:
        given = F.col(f"n.{f}")
        return F.when(take, F.coalesce(F.nullif(given, F.lit("")), F.col(f"o.{f}")) if f in KEPT_FIELDS else given).otherwise(F.col(f"o.{f}"))

    same = lambda f: (normalize_title(F.col(f"o.{f}")) if f == "title" else F.col(f"o.{f}")).eqNullSafe(normalize_title(value(f)) if f == "title" else value(f))
    changed = F.filter(F.array(*[F.when(~same(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    logged = F.when(take & ~is_new, changed).otherwise(F.array().cast("array<string>"))
    entry = F.array(F.struct(now.alias("at"), logged.alias("fields")))
    kind = "array<struct<at:timestamp,fields:array<string>>>"
    history = F.coalesce(F.col("o.changes"), F.array().cast(kind))
    lists = lambda c: (F.coalesce(F.col(f"o.{c}"), F.array().cast(state.schema[c].dataType)), F.coalesce(F.col(f"n.{c}"), F.array().cast(state.schema[c].dataType)))
    more = []
    if "aliases" in shared:
        more.append(F.slice(F.array_distinct(F.concat(*lists("aliases"))), 1, KEEP_ALIASES).alias("aliases"))
    if "board_keys" in shared:
        more.append(F.array_sort(F.array_union(*lists("board_keys"))).alias("board_keys"))
    if "sources" in shared:
        more.append(merge_sources(*lists("sources")).alias("sources"))
    if "from_rotation" in shared:
        more.append(F.when(is_new | gone, F.coalesce("n.from_rotation", "o.from_rotation")).otherwise(F.col("o.from_rotation") & F.col("n.from_rotation")).alias("from_rotation"))
    if {"posted_at", "posted_at_reliable"} <= shared:
        dated = take & F.col("n.posted_at").isNotNull() & (F.coalesce("n.posted_at_reliable", F.lit(False)) | ~F.coalesce("o.posted_at_reliable", F.lit(False)))
        more += [F.when(dated, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("posted_at", "posted_at_reliable")]
    if "notified" in state.columns:
        told = F.coalesce("o.notified", F.lit(False))
        waiting = F.coalesce("o.pending_update", F.lit(False)) if "pending_update" in state.columns else F.lit(False)
        more += [told.alias("notified"), (waiting | (told & F.arrays_overlap(logged, F.array(*map(F.lit, sorted(ALERT_FIELDS)))))).alias("pending_update")]
    return both.select(
        F.coalesce("n.canonical_id", "o.canonical_id").alias("canonical_id"),
        *[value(f).alias(f) for f in fields],
        F.when(take, F.col("n.priority")).otherwise(F.col("o.priority")).alias("priority"),
        F.coalesce("o.first_seen", "n.last_seen").alias("first_seen"),
        F.greatest("n.last_seen", "o.last_seen").alias("last_seen"),
        F.when(F.size(logged) > 0, F.slice(F.concat(history, entry.cast(kind)), F.greatest(F.size(history) + 2 - KEEP_CHANGES, F.lit(1)), KEEP_CHANGES)).otherwise(history).alias("changes"),
        *more,
        F.when(is_new, "insert").when(gone, "keep").when(F.size(logged) > 0, "update").otherwise("refresh").alias("action"),
    )


def merge_sources(old: Column, new: Column) -> Column:
    """Sources by (name, url), first_seen kept, the most recent KEEP_SOURCES
    (JOIN-05). Both ARRAY<STRUCT<name, url, first_seen, last_seen>>."""
    known = lambda s, xs: F.filter(xs, lambda x: (x["name"] == s["name"]) & (x["url"] == s["url"]))
    fresh = F.transform(new, lambda s: F.struct(s["name"].alias("name"), s["url"].alias("url"), F.coalesce(F.get(known(s, old), F.lit(0))["first_seen"], s["first_seen"]).alias("first_seen"), s["last_seen"].alias("last_seen")))
    rest = F.filter(old, lambda s: F.size(known(s, new)) == 0)
    ordered = F.reverse(F.array_sort(F.transform(F.concat(fresh, rest), lambda s: F.struct(s["last_seen"].alias("last_seen"), s["name"].alias("name"), s["url"].alias("url"), s["first_seen"].alias("first_seen")))))
    return F.slice(F.transform(ordered, lambda s: F.struct(s["name"].alias("name"), s["url"].alias("url"), s["first_seen"].alias("first_seen"), s["last_seen"].alias("last_seen"))), 1, KEEP_SOURCES)


def within_days(at: Column, now: Column, days: int) -> Column:
    return at >= now - F.make_interval(days=F.lit(days))


def prune(state: DataFrame, now: Column) -> DataFrame:
    """Rows that outlive their TTL stay (STA-03): rejected rows 30 days, others
    180, and rows someone applied to for ever. Needs tier, applied, last_seen."""
    return state.where(F.col("applied") | F.when(F.col("tier") == "rejected", within_days(F.col("last_seen"), now, TTL_DAYS["rejected"])).otherwise(within_days(F.col("last_seen"), now, TTL_DAYS["kept"])))


def listed_days(source_types: Column) -> Column:
    """Days by the most authoritative kind of source (FLT-04)."""
    has = lambda *k: F.exists(source_types, lambda s: s.isin(*k))
    return F.when(has("ats", "employer_page"), LISTED_DAYS["ats"]).when(has("feed", "government"), LISTED_DAYS["feed"]).otherwise(LISTED_DAYS["other"])


def is_listed(last_seen: Column, source_types: Column, now: Column) -> Column:
    return F.unix_micros(last_seen) >= F.unix_micros(now) - listed_days(source_types).cast("long") * 86_400_000_000


def remember_text(old: DataFrame, new: DataFrame, cap: int = 2500, size: int = 6000) -> DataFrame:
    """(canonical_id, text, seen): the longer text wins, or an edited one of at
    least 0.8 of the length; the `cap` rows seen last stay (STA-06, SNK-09,
    TOP-07)."""
    b = old.alias("o").join(new.alias("n"), F.col("o.canonical_id") == F.col("n.canonical_id"), "full_outer")
    cut_ = F.substring(F.col("n.text"), 1, size)
    take = F.col("o.text").isNull() | (F.length(cut_) >= 0.8 * F.length("o.text"))
    rows = b.select(F.coalesce("n.canonical_id", "o.canonical_id").alias("canonical_id"), F.when(F.col("n.text").isNotNull() & take, cut_).otherwise(F.col("o.text")).alias("text"), F.greatest("n.seen", "o.seen").alias("seen"))
    return rows.orderBy(F.desc("seen"), "canonical_id").limit(cap)


def new_items(items: DataFrame, memory: DataFrame, key: str = "id") -> DataFrame:
    """Items not in the memory, each key once (JOIN-14)."""
    return items.dropDuplicates([key]).join(memory.select(key), key, "left_anti")


def grow_memory(memory: DataFrame, items: DataFrame, key: str = "id", at: str = "at", cap: int = 3000) -> DataFrame:
    """The `cap` keys seen last (STA-04)."""
    rows = memory.select(key, at).unionByName(items.select(key, at)).groupBy(key).agg(F.max(at).alias(at))
    return rows.orderBy(F.desc(at), key).limit(cap)


def keep_pages(cache: DataFrame, cap: int = MAX_PAGES) -> DataFrame:
    """The `cap` pages fetched last; equal times by url (TOP-06)."""
    return cache.orderBy(F.desc("fetched_at"), "url").limit(cap)


def pages_to_fetch(queue: DataFrame, cache: DataFrame, now: Column, days: int = TTL_DAYS["page"]) -> DataFrame:
    """Queue rows whose page is unknown, stale or changed since (JOIN-12,
    JOIN-13). Both have url and lastmod; the cache has fetched_at."""
    c = cache.select("url", F.col("lastmod").alias("known"), "fetched_at")
    return queue.join(c, "url", "left").where(F.col("fetched_at").isNull() | ~within_days(F.col("fetched_at"), now, days) | (F.col("lastmod").isNotNull() & ~F.col("lastmod").eqNullSafe(F.col("known")))).select(*queue.columns)


def failure_streak(runs: DataFrame, key: str, at: str, failed: Column) -> DataFrame:
    """(key, streak): how many of the key's last runs in a row failed (WIN-07,
    STA-08)."""
    # two aggregates with partial sums, not a window: one key may have most of the runs
    last_ok = F.max(F.when(~failed, F.col(at)))
    ends = runs.groupBy(key).agg(last_ok.alias("ok"))
    return runs.join(ends, key).groupBy(key).agg(F.count_if(failed & (F.col("ok").isNull() | (F.col(at) > F.col("ok")))).alias("streak"))


def health_events(streak: DataFrame, known: DataFrame, key: str, limit: int = 3) -> DataFrame:
    """One `down` when a streak reaches the limit, one `recovered` after it
    ends (STA-08); known: key, alerted_down."""
    rows = streak.join(known, key, "left").withColumn("alerted_down", F.coalesce("alerted_down", F.lit(False)))
    return rows.withColumn("event", F.when((F.col("streak") >= limit) & ~F.col("alerted_down"), "down").when((F.col("streak") == 0) & F.col("alerted_down"), "recovered"))


def follow_ups(applications: DataFrame, now: Column, stages=(7, 21)) -> DataFrame:
    """Open applications due for a reminder, each stage once (STA-09): needs
    applied_at, status, reminded (the last stage sent)."""
    days = F.floor((F.unix_seconds(now) - F.unix_seconds(F.col("applied_at"))) / 86400)
    stage = F.lit(0)
    for s in stages:
        stage = F.when(days >= s, s).otherwise(stage)
    return applications.where(F.col("status") == "open").withColumn("stage", stage).where(F.col("stage") > F.coalesce("reminded", F.lit(0)))


def deadline_reminders(jobs: DataFrame, today: Column, days: int = 3) -> DataFrame:
    """Jobs whose deadline is at most `days` ahead, once (STA-10)."""
    left = F.datediff(F.col("deadline"), today)
    return jobs.where(left.between(0, days) & ~F.coalesce("reminded", F.lit(False)))


def source_due(health: DataFrame, now: Column, interval_hours: Column) -> Column:
    """Interval, plus an hour for each failure up to a day (FLT-17, STA-11)."""
    wait = interval_hours + F.least(F.col("consecutive_failures"), F.lit(24))
    return F.col("last_attempt").isNull() | (F.unix_seconds(F.col("last_attempt")) + wait * 3600 <= F.unix_seconds(now))


def watchdog(jobs: DataFrame, now: Column, fill_hours: float = FILL_HOURS, stale_hours: float = STALE_HOURS, most: int = MAX_KICKS) -> DataFrame:
    """What to do about jobs that should have run (STA-17): adds outcome
    (fresh, running, gave_up, waiting or kick), kicks as counted now, and alert
    (down once a job is silent for too long, recovered once it is back). Kicks
    wait 1, 2, 4 … hours after one another, a quarter hour less for a clock
    that runs unevenly; a run that got through clears them. Needs ran_at,
    kicked_at, kicks, busy, alerted; a job that never ran is silent for ever."""
    hours = lambda since: (F.unix_seconds(now) - F.unix_seconds(since)) / 3600.0
    age = F.coalesce(hours(F.col("ran_at")), F.lit(float("inf")))
    through = F.coalesce(F.col("ran_at") > F.col("kicked_at"), F.lit(False))
    kicks = F.when(through, 0).otherwise(F.coalesce("kicks", F.lit(0)))
    waits = (kicks > 0) & F.coalesce(hours(F.col("kicked_at")) < F.pow(F.lit(2.0), kicks - 1) - 0.25, F.lit(False))
    rows = jobs.withColumn("outcome", F.when(age < fill_hours, "fresh").when(F.col("busy"), "running").when(kicks >= most, "gave_up").when(waits, "waiting").otherwise("kick"))
    alerted = F.coalesce("alerted", F.lit(False))
    rows = rows.withColumn("alert", F.when(alerted & (age < stale_hours), "recovered").when(~alerted & (age >= stale_hours), "down"))
    return rows.withColumn("kicks", kicks + (F.col("outcome") == "kick").cast("int"))


def board_due(last_checked: Column, status: Column, failures: Column, relevant: Column, now: Column) -> Column:
    """Hot boards every run, others daily, failing ones at powers of two of a
    day up to 30, invalid ones after 60 (STA-13, SRC-42)."""
    wait = F.when(status == "INVALID", 60.0).when(failures > 0, F.least(F.pow(F.lit(2.0), failures), F.lit(30.0))).when(relevant > 0, 0.0).otherwise(1.0)
    return last_checked.isNull() | (F.unix_seconds(last_checked) + wait * 86400 <= F.unix_seconds(now))


def select_boards(boards: DataFrame, budget: int) -> DataFrame:
    """Per platform: never checked first, then least recently checked, then
    origin (WIN-04)."""
    rank = F.row_number().over(Window.partitionBy("ats").orderBy(F.col("last_checked").asc_nulls_first(), "origin_rank", "slug"))
    return boards.withColumn("rank", rank).where(F.col("rank") <= budget)


def rotate(items: DataFrame, order: str, cursor: int, budget: int) -> tuple[DataFrame, Column]:
    """The next `budget` items after a stored cursor, wrapping (WIN-03,
    STA-12). Ordinals are given by range partitions, not in one task; the
    partitions are cut, as their bounds are sampled anew when they are made
    again."""
    ranged = cut(items.repartitionByRange(F.col(order)).sortWithinPartitions(order)).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row a partition
    total, before, base = sum(sizes.values()), {}, 0
    for p in sorted(sizes):
        before[p], base = base, base + sizes[p]
    if not total:
        return items.limit(0).withColumn("turn", F.lit(0).cast("long")), F.lit(0)
    starts = F.create_map(*[F.lit(x) for p, b in before.items() for x in (p, b)])
    ordinal = F.element_at(starts, F.col("_p")) + F.col("_k") - F.shiftleft(F.col("_p").cast("long"), 33)
    turn = F.pmod(ordinal - F.lit(cursor % total), F.lit(total))
    return ranged.withColumn("turn", turn.cast("long")).where(F.col("turn") < min(budget, total)).drop("_p", "_k"), F.lit((cursor + min(budget, total)) % total)


class Conflict(RuntimeError):
    """Another writer committed first."""


class VersionedTable:
    """Immutable snapshots and a manifest that names the current one (SNK-01,
    SNK-08, SRC-41, STA-16). A commit writes a new snapshot, reads it back,
    and makes the next version's manifest if nobody has; else the snapshot
    stays as a conflict copy. Reads fall back to the version before if the
    current one can't be read, and refuse to start empty when a manifest
    exists.

    Making a manifest and writing it are two steps. One that can't be read is
    being written, and a conflict, for `grace` seconds; after that its writer
    is taken for dead: reads skip it, and its number stays used."""

    def __init__(self, spark: SparkSession, folder: str, grace: float = 600.0):
        self.spark, self.folder, self.grace = spark, folder.rstrip("/"), grace
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[int, str, float]]:
        """(version, name, time of the last write in seconds)."""
        root = self._path(self.folder)
        found = self._fs.listStatus(root) if self._fs.exists(root) else []
        names = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in found]
        return sorted((int(n[9:21]), n, at) for n, at in names if n.startswith("manifest-") and n.endswith(".json"))

    def _read(self, name: str) -> dict | None:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def versions(self) -> list[dict]:
        """The manifests that can be read."""
        return [m for _, name, _ in self._manifests() if (m := self._read(name))]

    def etag(self) -> int:
        """The current version, 0 before the first commit."""
        last = self._manifests()[-1:]
        for version, name, at in last:
            if self._read(name) is None and time.time() - at < self.grace:
                raise Conflict(f"version {version} is being written")
        return last[0][0] if last else 0

    def load(self) -> DataFrame | None:
        self.etag()
        for m in reversed(self.versions()):
            try:
                df = self.spark.read.parquet(f"{self.folder}/{m['snapshot']}")
                if df.count() == m["rows"]:
                    return df
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "FAILED_READ_FILE" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
        if self._manifests():
            raise RuntimeError(f"no version of {self.folder} can be read")
        return None

    def commit(self, df: DataFrame, expected: int, required: list[str] | None = None) -> int:
        if missing := set(required or []) - set(df.columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{snapshot}")
        rows = self.spark.read.parquet(f"{self.folder}/{snapshot}").count()
        return self._publish({"snapshot": snapshot, "rows": rows}, expected)

    def _publish(self, body: dict, expected: int) -> int:
        """Make the next version's manifest, unless there is one."""
        content = json.dumps({**body, "version": expected + 1, "at": time.time()}).encode()
        try:  # creating without overwriting is the compare-and-set
            out = self._fs.create(self._path(f"{self.folder}/manifest-{expected + 1:012d}.json"), False)
        except Exception as e:
            raise Conflict(f"version {expected + 1} exists; what was written is kept") from e
        out.write(bytearray(content))
        out.close()
        return expected + 1

    def retain(self, versions: int = 5) -> list[str]:
        """Drop old snapshots and manifests (SNK-04)."""
        dropped = []
        for m in self.versions()[:-versions]:
            for name in (m["snapshot"], f"manifest-{m['version']:012d}.json"):
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)
                dropped.append(name)
        return dropped


def write_snapshots(observations: DataFrame, folder: str, size: int = 20_000) -> None:
    """Raw observations as JSON lines by day, run and source (SNK-03, PRJ-01)."""
    observations.withColumn("description", F.substring("description", 1, size)).write.mode("append").partitionBy("day", "run", "source").json(folder, compression="gzip")


def drop_days_before(spark: SparkSession, folder: str, cutoff: str) -> list[str]:
    """Remove day=… partitions older than the cutoff (SNK-04)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("day=") and s.getPath().getName()[4:] < cutoff]
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old)


def outbox(alerts: DataFrame, sent: DataFrame, attempts: int = 5) -> DataFrame:
    """Alerts still to deliver: not acknowledged, attempts left (STA-07,
    SNK-07). sent: canonical_id, ok, tries."""
    s = sent.groupBy("canonical_id").agg(F.bool_or("ok").alias("ok"), F.sum("tries").alias("tries"))
    rows = alerts.join(s, "canonical_id", "left")
    return rows.where(~F.coalesce("ok", F.lit(False)) & (F.coalesce("tries", F.lit(0)) < attempts)).select(*alerts.columns)
