"""A trigram index for keyword search (FLT-12, VIEW-03).

A posting says that a row's folded text has a gram of three characters. The
postings are a KeyedTable in buckets by gram, so a search reads the buckets of
its words' grams only, and a changed row writes the grams that it has gained
and deletes those that it has lost. What a row has gained and lost is told by
its texts side by side, so postings are never compared nor shuffled. A search intersects the postings of all
grams of all its words by counting them; the rows that are left are looked up
by their keys and checked against the whole words, as a row can have the grams
of a word apart. A search whose words are all shorter than three characters
has no grams, it checks every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.functions.text import fold
from quarrylark.operators.keyed import KeyedTable
from quarrylark.operators.scoring import settled

SIZE, BUCKETS = 3, 64


def grams_of(text: Column) -> Column:
    """The distinct grams of a folded text; empty for null and short ones. The
    text is taken apart once: a substring walks over all that is before it."""
    none = F.array().cast("array<string>")

    def of(chars: Column) -> Column:
        starts = F.when(F.size(chars) >= SIZE, F.sequence(F.lit(0), F.size(chars) - SIZE)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda k: F.concat(*[F.get(chars, k + i) for i in range(SIZE)])))

    return F.coalesce(F.flatten(F.transform(F.array(F.split(text, "")), of)), none)


def words_of(query: str) -> list[str]:
    return [w for w in query.lower().split() if w]


class GramIndex:
    """Postings in a folder. Rows have id and text, which is folded here."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark = spark
        self.table = KeyedTable(spark, folder, ["gram", "id"], buckets, bucket_by=["gram"])

    @staticmethod
    def _folded(rows: DataFrame, name: str) -> DataFrame:
        """Rows with texts, folded. An id that is null or stands twice is
        refused, so no posting stands twice."""
        rows = rows.where(F.col("text").isNotNull())
        bad = rows.groupBy("id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("id").isNull()).count()
        if bad:
            raise ValueError(f"{bad} ids are null or stand twice")
        return rows.select("id", fold(F.col("text")).alias(name))

    def update(self, new: DataFrame, old: DataFrame | None = None) -> int:
        """Rows as they are now, and as they were when they were indexed last;
        rows of `old` that `new` has not are taken out. The new version."""
        rows = self._folded(new, "now").withColumn("before", F.lit(None).cast("string"))
        if old is not None:
            rows = rows.drop("before").join(self._folded(old, "before"), "id", "full_outer").where(~F.col("now").eqNullSafe(F.col("before")))
        rows = settled(rows.select("id", grams_of(F.col("now")).alias("now"), grams_of(F.col("before")).alias("before")), "now", "before")
        marked = lambda grams, deleted: F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(deleted).alias("deleted")))
        changes = F.concat(marked(F.array_except("now", "before"), False), marked(F.array_except("before", "now"), True))
        return self.table.commit_marked(rows.select("id", F.inline(changes)), self.table.etag())

    def candidates(self, query: str) -> DataFrame | None:
        """The ids of the rows that have all grams of the words; null if the
        words have none."""
        folded = self.spark.createDataFrame([(w,) for w in words_of(query)], "w string").select(F.explode(grams_of(fold(F.col("w")))).alias("g")).distinct()
        grams = sorted(r.g for r in folded.collect())  # of a query
        if not grams:
            return None
        found = self.table.where_in("gram", grams)
        if found is None:
            return self.spark.createDataFrame([], "id long").limit(0)
        return found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")

    def search(self, rows: DataFrame, query: str) -> DataFrame:
        """The rows (id, text and any other columns) that hold every word."""
        words = [fold(F.lit(w)) for w in words_of(query)]
        found = self.candidates(query) if words else None
        left = rows if found is None else rows.join(found, "id", "left_semi")
        # folded behind the look-up, as the rows that it leaves are few
        left = settled(left.withColumn("_said", fold(F.col("text"))), "_said")
        for w in words:
            left = left.where(F.contains("_said", w))
        return left.drop("_said")
