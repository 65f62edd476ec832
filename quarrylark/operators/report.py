"""What a run leaves behind and takes in: reports, artifacts, the inbox
(SNK-02, SNK-10, SNK-11, FLT-08, TOP-13)."""

from __future__ import annotations

import gzip
import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylark.operators.state import Conflict

#: Labels shown of each kind, hours that a message waits.
LABELS, INBOX_HOURS = 6, 6


def held_back(tier: Column, reasons: Column, score: Column, adjusted: Column, possible: int = 55) -> Column:
    """Rejected only because the route's penalty took the score below the
    bound (FLT-08); adjusted: the map of adjustments."""
    penalty = F.coalesce(F.try_element_at(adjusted, F.lit("route")), F.lit(0))
    return (penalty < 0) & (tier == "rejected") & (F.size(F.array_except(reasons, F.array(F.lit("LOW_SCORE")))) == 0) & (score - penalty >= possible)


def recent_labels(labels: DataFrame, n: int = LABELS) -> DataFrame:
    """The n latest labels of each kind (TOP-13): id, kind, at. Equal times go
    by id. Ranks are kept while partitions are read, so no kind is gathered."""
    return labels.withColumn("turn", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("at"), "id"))).where(F.col("turn") <= n)


def run_report(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """(section, name, value) of a run (SNK-10): jobs by tier and action,
    sources by status, and the failing sources with their errors' counts.
    jobs: tier, action; sources: source, status, n."""
    row = lambda df, section, name: df.groupBy(name).agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), "value")
    failing = sources.where(~F.col("status").isin("SUCCESS", "SKIPPED", "DISABLED")).select(F.lit("failing").alias("section"), F.col("source").alias("name"), F.col("n").cast("long").alias("value"))
    return row(jobs, "tier", "tier").unionByName(row(jobs, "action", "action")).unionByName(row(sources, "sources", "status")).unionByName(failing)


def report_markdown(report: DataFrame) -> str:
    """The report as a text for people: a heading for each section, a line for
    each row. The report has a row for each tier, action, status and failing
    source, so it is small."""
    lines, section = [], None
    for r in report.orderBy("section", F.desc("value"), "name").collect():
        if r.section != section:
            lines += [*([""] if lines else []), f"## {r.section}"]
            section = r.section
        lines.append(f"- {r.name}: {r.value}")
    return "\n".join(lines)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def artifact_tag(spark: SparkSession, path: str) -> str | None:
    """The tag of a file's content; None if there is none."""
    p, fs = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return hashlib.sha256(bytes(stream.readAllBytes())).hexdigest()
    finally:
        stream.close()


def write_artifact(spark: SparkSession, path: str, text: str, expected: str | None) -> str:
    """Put a small text, gzipped if the path ends in .gz, if the file still has
    the expected tag (SNK-02): it is written aside and renamed, so readers see
    the old content or the new. Returns the new tag. Stores without a
    conditional rename leave a moment between check and put; shared state
    belongs in a VersionedTable."""
    if artifact_tag(spark, path) != expected:
        raise Conflict(f"{path} has changed")
    body = gzip.compress(text.encode(), mtime=0) if path.endswith(".gz") else text.encode()
    target, fs = _file(spark, path)
    aside, _ = _file(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(aside, False)
    out.write(bytearray(body))
    out.close()
    if expected is not None:
        fs.delete(target, False)
    if not fs.rename(aside, target):
        fs.delete(aside, False)
        raise Conflict(f"{path} has changed")
    return hashlib.sha256(body).hexdigest()


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of a folder as a stream (SNK-11), one a file: name, text, at.
    Files go once their batch is done."""
    files = spark.readStream.schema("value string").option("wholetext", True).option("cleanSource", "delete").format("text").load(folder)
    return files.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("at"))


def fresh_messages(messages: DataFrame, now: Column, hours: int = INBOX_HOURS) -> DataFrame:
    """Messages that have not expired (SNK-11)."""
    return messages.where(F.unix_seconds("at") >= F.unix_seconds(now) - hours * 3600)


#: Parts of a score in the order that they are told.
SCORE_PARTS = ["title", "tech", "domain", "resp", "location"]


def explain(rows: DataFrame, have: list[str], today: Column) -> DataFrame:
    """(id, ordinal, line): why rows scored as they did (VIEW-04). Needs id,
    title, company, score, tier, reasons, breakdown (map of points), evidence
    and skills (arrays), deadline, earlier (postings before this one). Lines
    that have nothing to say are left out."""
    part = lambda k: F.coalesce(F.try_element_at("breakdown", F.lit(k)), F.lit(0)).cast("string")
    rest = F.array_sort(F.map_entries(F.map_filter("breakdown", lambda k, v: ~k.isin(SCORE_PARTS) & (v != 0))))
    signed = F.transform(rest, lambda e: F.concat(e["key"], F.lit(" "), F.when(e["value"] > 0, "+").otherwise(""), e["value"].cast("string")))
    list_of = lambda name, values: F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(values, ", ")))
    own = F.array(*map(F.lit, have)).cast("array<string>")
    left = F.datediff("deadline", today)
    lines = F.array_compact(F.concat(
        F.array(
            F.concat_ws(" — ", "title", F.nullif("company", F.lit(""))), F.concat(F.lit("score "), F.col("score").cast("string"), F.lit("/100 · "), "tier"),
            F.concat_ws(" · ", *[F.concat(F.lit(f"{k} "), part(k)) for k in SCORE_PARTS]), list_of("adjusted", signed),
        ),
        F.transform(F.slice("evidence", 1, 12), lambda e: F.concat(F.lit("• "), e)),
        F.array(
            list_of("have", F.array_intersect("skills", own)), list_of("lack", F.array_except("skills", own)), list_of("rejected", F.col("reasons")),
            F.when(left.isNotNull(), F.when(left < 0, "closed").otherwise(F.concat(F.lit("closes in "), left.cast("string"), F.lit(" days")))),
            F.when(F.col("earlier") > 0, F.concat(F.lit("posted "), F.col("earlier").cast("string"), F.lit(" times before"))),
        ),
    ))
    return rows.select("id", F.posexplode(lines).alias("ordinal", "line"))
