"""Conversation structure repair: the cheapest edits that make a conversation
one of a system turn, if any, and pairs of user and assistant turns.

A place in the repair is (turns read, grammar state); the edits are its edges
(keep, rerole, delete, insert). Dijkstra runs on this lattice as it unfolds,
by (cost, audit), where the audit is the edits' initials so far, and stops at
the first accepting end that it takes from the queue. Of two audits of equal
cost to one place none begins with the other (the letters after it would be
inserts, which cost), so the one that is less stays less however both go on.

Conversations are dealt by id and read in order, one at a time. Those of more
than `long_rows` rows or `long_chars` characters are not gathered: their rows
are ranged over all tasks by turn, cut into blocks of `block` rows, and each
block gives its cheapest way from each grammar state to each other. A block's
ways are chained in order, one block at a time: that keeps four audits and
four running hashes; a SHA-256 has to be computed in order. Counts of such a
conversation are aggregations.

Faults: a row's first of blank, duplicate (role and text seen earlier in the
conversation, whatever was wrong with the row that had them), truncated. Roles
count by their first letter; a null role or text is one space, a null turn
comes first, a null conv_id is a conversation. Repeated rows are duplicates of
the first. Rows of one turn are ordered by role and text. A conversation
without rows has no faults, cost 0, an empty audit and the hash of the empty
string. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.llm.shared import bounded_batches, cut, table

LONG_ROWS, LONG_CHARS, BLOCK = 4096, 32 << 20, 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
#: Grammar states: nothing yet, after system, after user, after assistant.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ACCEPTING = (START, AFTER_ASSISTANT)
#: What a state asks for next: the state after it and the role.
ASKS = {START: (AFTER_USER, "user"), AFTER_SYSTEM: (AFTER_USER, "user"), AFTER_USER: (AFTER_ASSISTANT, "assistant"), AFTER_ASSISTANT: (AFTER_USER, "user")}
OK, CUT_OFF, MUST_GO = 0, 1, 2
_FAULTS = ["blank", "duplicate", "truncated"]


class Turn(NamedTuple):
    role: str
    text: str
    fault: str  # one of blank, duplicate, truncated or empty


def weight(turn: Turn) -> tuple[str, int]:
    """The turn's initial and what its fault does to it."""
    return turn.role[:1], MUST_GO if turn.fault in ("blank", "duplicate") else CUT_OFF if turn.fault else OK


def edits(state: int, initial: str, fault: int) -> Iterator[tuple[int, str, int]]:
    """cost, letter and state after of what can be done with the next turn."""
    yield DELETE, "D", state
    if fault != MUST_GO:
        extra = TRUNCATED if fault == CUT_OFF else 0
        after, role = ASKS[state]
        if initial == role[0]:
            yield KEEP + extra, "K", after
        elif state == START and initial == "s":
            yield KEEP + extra, "K", AFTER_SYSTEM
        yield REROLE + extra, "R", after


def cheapest(turns: list[tuple[str, int]], start: int = START, ends: tuple[int, ...] | None = ACCEPTING) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) to the first end state taken; with no ends, to
    every state after the last turn."""
    queue, settled, found = [(0, "", 0, start)], set(), {}
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in settled:
            continue
        settled.add((at, state))
        if at == len(turns):
            if ends is None:
                found[state] = cost, audit
            elif state in ends:
                return {state: (cost, audit)}
        else:
            for more, letter, after in edits(state, *turns[at]):
                if (at + 1, after) not in settled:
                    heapq.heappush(queue, (cost + more, audit + letter, at + 1, after))
        after = ASKS[state][0]
        if (at, after) not in settled:
            heapq.heappush(queue, (cost + INSERT, audit + "I", at, after))
    return found


def repaired(turns: list[Turn], audit: str, state: int = START) -> tuple[list[tuple[str, str]], int]:
    """The role and text of each turn that the audit leaves, and the state."""
    out, at = [], 0
    for letter in audit:
        after, role = ASKS[state]
        if letter == "K":
            if turns[at].role[:1] != role[0]:
                after = AFTER_SYSTEM
            role = turns[at].role
        if letter != "D":
            out.append((role, "" if letter == "I" else turns[at].text))
            state = after
        at += letter != "I"
    return out, state


def _normal(talks: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows, nulls as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return talks.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role"), said("text"))


def damaged(talks: DataFrame) -> DataFrame:
    """The rows after the fixed damage, by crc32 of `conv_id:turn` modulo 20."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = _normal(talks).withColumn("harm", F.crc32(key) % 20).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("harm") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit("\t\n\x0b\x0c\r "))


def _order(*first: str) -> list[Column]:
    return [*[F.asc_nulls_first(c) for c in (*first, "turn")], F.asc("role"), F.asc("text")]


def _reports(kind: str) -> str:
    return f"conv_id {kind}, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired array<struct<role:string,text:string>>"


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_READ = pa.list_(pa.field("element", pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])))
_WAYS = pa.list_(pa.field("element", pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))


def _short(rows: DataFrame, texts: bool) -> DataFrame:
    """The reports of conversations that fit in a task, read one at a time."""

    def report(conv, turns: list[tuple]) -> tuple:
        seen, counts, read = set(), dict.fromkeys(_FAULTS, 0), []
        for _, role, text, bare in turns:
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare in ".!?" else "truncated"
            seen.add((role, text))
            read.append(Turn(role, text, fault))
            if fault:
                counts[fault] += 1
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a.role[:1] + b.role[:1] not in LEGAL for a, b in pairwise(read))
        ((_, (cost, audit)),) = cheapest([weight(t) for t in read]).items()
        said, _ = repaired(read, audit)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        return (conv, len(turns), gaps, *counts.values(), illegal, cost, audit, digest, [{"role": r, "text": t} for r, t in said] if texts else None)

    kind = rows.schema["conv_id"].dataType
    names = ["conv_id", "n_rows", "gaps", *_FAULTS, "illegal", "cost", "audit", "repaired_sha256", "repaired"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, out, conv_type = None, [], [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [conv_type, *[pa.int64()] * 7, pa.string(), pa.string(), _TURNS]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for now, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and now != conv:
                    out.append(report(conv, turns))
                    turns = []
                conv = now
                turns.append(tuple(turn))
            if len(out) >= 256:
                yield flush()
        if turns:
            out.append(report(conv, turns))
        if out:
            yield flush()

    bounded_batches(rows.sparkSession)
    dealt = rows.repartition("conv_id").sortWithinPartitions(*_order("conv_id"))
    return dealt.select("conv_id", "turn", "role", "text", F.right(_bare(F.col("text")), F.lit(1)).alias("bare")).mapInArrow(scan, _reports(kind.simpleString()))


def _long(rows: DataFrame, block: int, texts: bool) -> DataFrame:
    """The reports of conversations of any length, by blocks of rows."""
    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    ranged = rows.repartitionByRange(*_order("conv_id"), F.rand(7)).sortWithinPartitions(*_order("conv_id"))
    # places in conv_id's order: the task's number and the row's number in it
    placed = cut(ranged.withColumn("place", F.monotonically_increasing_id()))
    key = F.struct(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.sha2("text", 256).alias("d"))
    bare = F.right(_bare(F.col("text")), F.lit(1))
    keyed = placed.withColumn("key", key)
    first = cut(keyed.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    fault = F.when(bare == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~bare.isin(".", "!", "?"), "truncated").otherwise("")
    marked = keyed.join(first, "key", "left").select("conv_id", "turn", "role", "text", "place", fault.alias("fault"), F.shiftright("place", 33).alias("task"))
    # a block: rows of one conversation in one task, by place
    marked = cut(marked.withColumn("block", F.floor(F.col("place") / block)))

    def ways(keys: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        turns = [Turn(*t) for t in zip(*(group[c].to_pylist() for c in ("role", "text", "fault")), strict=True)]
        weights = [weight(t) for t in turns]
        found = [(s, e, *way) for s in range(4) for e, way in cheapest(weights, s, None).items()]
        initials = [w[0] for w in weights]
        return pa.table({
            "conv_id": group["conv_id"][:1], "place": group["place"][:1],
            "ways": pa.array([[dict(zip(("enter", "leave", "cost", "audit"), w, strict=True)) for w in found]], _WAYS),
            "turns": pa.array([[t._asdict() for t in turns]], _READ), "illegal": pa.array([sum(a + b not in LEGAL for a, b in pairwise(initials))]),
            "opens": pa.array([initials[0]]), "closes": pa.array([initials[-1]]),
        })

    shape = "ways array<struct<enter:int,leave:int,cost:long,audit:string>>, turns array<struct<role:string,text:string,fault:string>>, illegal long, opens string, closes string"
    blocks = marked.groupBy("conv_id", "block").applyInArrow(ways, f"conv_id {kind}, place long, {shape}")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, live, illegal, closed, conv_type, opened = None, None, 0, "", None, False

        def end() -> pa.RecordBatch:
            state = min((s for s in live if s in ACCEPTING), key=lambda s: live[s][:2])
            cost, audit, _, digest, said = live[state]
            row = [conv, cost, audit, digest.hexdigest(), illegal, said if texts else None]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [conv_type, pa.int64(), pa.string(), pa.string(), pa.int64(), _TURNS], strict=True)], names=["conv_id", "cost", "audit", "repaired_sha256", "illegal", "repaired"])

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for k in range(batch.num_rows):
                now, _, ways, turns, bad, opens, closes = (c[k].as_py() for c in batch.columns)
                if not opened or now != conv:
                    if opened:
                        yield end()
                    conv, live, illegal, opened, closed = now, {START: (0, "", True, hashlib.sha256(), [])}, 0, True, None
                illegal += bad + (closed is not None and closed + opens not in LEGAL)
                closed = closes
                best: dict[int, tuple] = {}
                for w in ways:
                    if w["enter"] in live:
                        cost, audit = live[w["enter"]][:2]
                        way = cost + w["cost"], audit + w["audit"], w["enter"], w["audit"]
                        if w["leave"] not in best or way[:2] < best[w["leave"]][:2]:
                            best[w["leave"]] = way
                turns, following = [Turn(**t) for t in turns], {}
                for leave, (cost, audit, enter, letters) in best.items():
                    _, _, empty, digest, said = live[enter]
                    digest, (lines, _) = digest.copy(), repaired(turns, letters, enter)
                    for role, text in lines:
                        digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                        empty = False
                    following[leave] = cost, audit, empty, digest, said + [{"role": r, "text": t} for r, t in lines] if texts else said
                live = following
        if opened:
            yield end()

    bounded_batches(spark)
    chained = blocks.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place").mapInArrow(chain, f"conv_id {kind}, cost long, audit string, repaired_sha256 string, illegal long, repaired array<struct<role:string,text:string>>")
    # distinct turns in two steps, so that one conversation's are counted by many tasks
    turns = marked.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), *[F.count_if(F.col("fault") == f).alias(f) for f in _FAULTS])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy(F.col("conv_id").alias("counted")).agg(F.sum("n").alias("n_rows"), gaps.alias("gaps"), *[F.sum(f).alias(f) for f in _FAULTS])
    return chained.join(counts, F.col("conv_id").eqNullSafe(F.col("counted"))).select("conv_id", "n_rows", "gaps", *_FAULTS, "illegal", "cost", "audit", "repaired_sha256", "repaired")


def repair(talks: DataFrame, texts: bool = True, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, block: int = BLOCK) -> DataFrame:
    """One row for every conversation that has rows: conv_id, n_rows, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the
    repaired `role:text` lines) and, with texts, the repaired turns. Without
    them a long conversation's texts are only hashed."""
    rows = _normal(talks)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    long = cut(sizes.where((F.col("n") > long_rows) | (F.col("c") > long_chars)).select(F.col("conv_id").alias("long_id"), F.lit(True).alias("is_long")))
    marked = rows.join(long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left").drop("long_id")
    out = _short(marked.where("is_long IS NULL").drop("is_long"), texts)
    if not long.isEmpty():
        out = out.unionByName(_long(marked.where("is_long").drop("is_long"), block, texts))
    return out if texts else out.drop("repaired")


def op13(spark, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    report = repair(damaged(talks), texts=False).withColumnRenamed("conv_id", "found")
    ids = talks.select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *_FAULTS, "illegal", "cost")}
    return ids.join(report, F.col("conv_id").eqNullSafe(F.col("found")), "left").select(
        "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


#: The same by another way: the crc in SQL, and one row after the other the
#: least (cost, audit) of each grammar state, with up to two inserts before it.
SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k FROM conversations),
keyed AS (
    SELECT source.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS harm
    FROM source, crc),
harmed AS (
    SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
        CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM keyed, range(2) d(i) WHERE harm <> 0 AND (i = 0 OR harm = 3)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM harmed),
faulted AS (
    SELECT conv_id, turn, role, text, pos, role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
        CASE WHEN bare = '' THEN 'blank' WHEN pos > min(pos) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN bare[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM placed),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS last
    FROM faulted GROUP BY conv_id),
inserts AS (
    SELECT unnest([0, 0, 0, 1, 1, 1, 2, 2, 3, 3]) AS state, unnest([0, 2, 3, 1, 2, 3, 2, 3, 3, 2]) AS reached, unnest(['', 'I', 'II', '', 'I', 'II', '', 'I', '', 'I']) AS letters,
        unnest([[], ['user:'], ['user:', 'assistant:'], [], ['user:'], ['user:', 'assistant:'], [], ['assistant:'], [], ['user:']]) AS lines),
moves AS (
    SELECT unnest([0, 1, 2, 3, 0, 1, 3, 2, 0]) AS state, unnest(['', '', '', '', 'u', 'u', 'u', 'a', 's']) AS wants, unnest([0, 1, 2, 3, 2, 2, 2, 3, 1]) AS following),
way AS (
    SELECT conv_id, 1 AS pos, 0 AS state, 0 AS cost, '' AS audit, []::varchar[] AS said FROM counted
    UNION ALL
    SELECT conv_id, pos, state, best.cost, best.audit, best.said FROM (
        SELECT w.conv_id, w.pos + 1 AS pos, m.following AS state,
            min(struct_pack(
                cost := w.cost + 2 * length(i.letters) + e.price + CASE WHEN e.letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, audit := w.audit || i.letters || e.letter,
                said := w.said || i.lines || CASE e.letter WHEN 'D' THEN []::varchar[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE m.wants WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] END)) AS best
        FROM way w JOIN inserts i USING (state) JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos
            JOIN moves m ON m.state = i.reached
            JOIN (SELECT unnest(['D', 'K', 'R']) AS letter, unnest([3, 0, 2]) AS price) e
            ON CASE e.letter WHEN 'D' THEN m.wants = '' WHEN 'K' THEN m.wants = f.initial AND m.wants <> '' AND f.fault NOT IN ('blank', 'duplicate') ELSE m.wants IN ('u', 'a') AND f.fault NOT IN ('blank', 'duplicate') END
        GROUP BY 1, 2, 3)),
done AS (
    SELECT w.conv_id, min(struct_pack(cost := w.cost + 2 * length(i.letters), audit := w.audit || i.letters, said := w.said || i.lines)) AS best
    FROM way w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = c.last + 1 JOIN inserts i USING (state) WHERE i.reached IN (0, 3) GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(best.cost, 0)::bigint AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
