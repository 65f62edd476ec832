"""Personal data: bootstrapped contextual extraction, DataFrame functions only.

Base spans are the leftmost non-overlapping matches of one pattern per kind,
checked afterwards (address parts, Luhn, digit counts). They are found once
per text; places come from the lengths of what lies between the matches.

Candidate instances are words that hold a digit or an @, joined with groups
of digits that follow over single spaces, and mails spelled with "at" and
"dot". A name that is tied to its value by = or : is context, not part of
it. The lexical patterns of a candidate are the word before it, the two
words before, and the word before with the word after, whole and in lower
case; words that are candidates themselves read <id>.

Seeds are candidates that pass the base rules of their kind. Two kinds have
no base pattern: a secret's seeds are long mixed words after a word for a
credential, a national number's are of the form 000-00-0000. Seeds weigh the
graph of patterns and instances: in each round a pattern's score for a kind
is the confidence of its instances over their number (smoothed), and an
instance's confidence is the score of its best good pattern. Patterns of
high score and support mark candidates that have the kind's wider shape and
overlap no base span: those are the spans that the method adds.

A null text counts as empty: no spans, and the digest of an empty string.
Rows are read one by one; equal rows get equal results, rows that share a
doc_id but differ in text get their own. Other columns are ignored. Counts
and base_sha256 are of base spans; spans holds all, n_spans counts them and
n_added those of the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylark.llm.shared import cut

KINDS = ["email", "ip", "card", "phone"]
#: Kinds by rank; the last two are the method's alone.
ALL_KINDS = [*KINDS, "secret", "national"]
ROUNDS, MIN_SUPPORT, MIN_SCORE, GOOD_PATTERN = 2, 3, 0.8, 0.7
_OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Possessive forms of the base patterns: they match the same strings, in
#: linear time and without recursion. The look-behinds skip starts inside a
#: run whose first start has failed for the same reason.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = (rf"(?:\x20?[\[({{<]\x20?{w}\x20?[\])}}>]\x20?|\x20{w}\x20)" for w in ("at", "dot"))
_SPELLED = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?i:{_AT})[A-Za-z0-9-]++(?:(?i:{_DOT}|\.)[A-Za-z0-9-]++)++"
_TOKEN = rf"{_SPELLED}|(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[(+]?[0-9][0-9().-]*+(?![A-Za-z0-9@]))*+"
_BLOCK = 128


def _last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once. A column that only a lambda
    uses would be moved into it by the optimizer, and computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, join) -> Column:
    """Running sums or maxima of an array of numbers from 0 on; by blocks, so
    that long arrays don't take quadratic time."""
    none = F.array().cast("array<bigint>")

    def scan(array: Column) -> Column:
        return F.aggregate(array, none, lambda acc, x: F.concat(acc, F.array(join(F.coalesce(_last(acc), F.lit(0)), x.cast("bigint")))))

    def blocks(v: Column) -> Column:
        many = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / _BLOCK).cast("int") - 1, F.lit(0)))
        return F.transform(many, lambda b: scan(F.slice(v, b * _BLOCK + 1, _BLOCK)))

    def whole(within: Column) -> Column:
        upto = scan(F.transform(within, lambda b: F.coalesce(_last(b), F.lit(0))))
        return _let(upto, lambda u: F.flatten(F.transform(within, lambda w, k: F.transform(w, lambda x: join(F.coalesce(F.get(u, k - 1), F.lit(0)), x)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), whole)).otherwise(none))


def running_sum(values: Column) -> Column:
    return _running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return _running(values, lambda a, b: F.greatest(a, b))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    digits = F.reverse(_digits(text))
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, d).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(text)
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def _gate(kind: str, text: Column) -> Column:
    if kind == "email":
        return text.contains("@")
    return text.contains("+") if kind == "phone" else F.col("has_digit")


_SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _found(docs: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """Adds <name>: the matches m, what lies between them (gap) and their starts (at)."""

    def placed(m: Column) -> Column:
        def starts(gap: Column) -> Column:
            steps = F.transform(m, lambda x, i: F.length(F.get(gap, i)) + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0)))
            return F.struct(m.alias("m"), gap.alias("gap"), running_sum(steps).alias("at"))

        return F.when(F.size(m) > 0, _let(F.split("text", pattern, -1), starts))

    return docs.withColumn(name, F.when(gate, _let(F.regexp_extract_all("text", F.lit(pattern), 0), placed)))


def _checked(rank: int, kind: str):
    return lambda m, at: F.when(_valid(kind, m), F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(m)).alias("end")))


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank


def _base(docs: DataFrame) -> DataFrame:
    """Adds base: the checked base spans by start, then kind."""
    docs = docs.withColumn("has_digit", F.col("text").rlike("[0-9]"))
    parts = []
    for rank, kind in enumerate(KINDS):
        docs = _found(docs, kind, PATTERNS[kind], _gate(kind, F.col("text")))
        spans = F.zip_with(F.col(f"{kind}.m"), F.col(f"{kind}.at"), _checked(rank, kind))
        parts.append(F.coalesce(F.filter(spans, lambda s: s.isNotNull()).cast(_SPAN), F.array().cast(_SPAN)))
    return docs.withColumn("base", F.array_sort(F.concat(*parts)))


_LEAD, _TRAIL = r"^[(\"'\[<{|]*+(?:[A-Za-z_][A-Za-z_-]*+[=:])?[(\"'\[<{|]*+", r"[)\"'\].,;:!?*#%$&>}|]++$"
_TIED = r"^[(\"'\[<{|]*+([A-Za-z_][A-Za-z_-]*+[=:])"
_CREDENTIAL = r"(?:^|[^a-z])(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth|bearer|credential)s?[\"']?(?:\s?[=:])?$"


def _nth(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(F.length(found) > 0, F.lower(found))


def _candidates(docs: DataFrame) -> DataFrame:
    """Adds tokens: candidate instances with start, end, text, patterns and seed kind."""
    gate = F.col("has_digit") | F.col("text").contains("@") | F.col("text").rlike(r"(?i)[\x20\[({<]dot[\x20\])}>]")
    docs = _found(docs, "token", _TOKEN, gate)

    def describe(m: Column, i: Column, found: Column) -> Column:
        gap = found["gap"]
        bare = F.regexp_replace(m, _LEAD, "")
        inner = F.regexp_replace(bare, _TRAIL, "")
        start = F.get(found["at"], i) + F.length(m) - F.length(bare)
        # read backwards, so that only the last words of what lies before are scanned
        other = F.when(i > 0, F.lit("<id>"))
        near = _let(F.reverse(F.get(gap, i)), lambda back: F.struct(F.reverse(_nth(back, r"^\s++(\S++)")).alias("one"), F.reverse(_nth(back, r"^\s++\S++\s++(\S++)")).alias("two")))
        after = F.coalesce(_nth(F.get(gap, i + 1), r"^\S*+\s++(\S++)"), F.when(i + 1 < F.size(found["m"]), F.lit("<id>")))

        def told(near: Column) -> Column:
            one, two = F.coalesce(near["one"], other), F.when(near["one"].isNotNull(), F.coalesce(near["two"], other))
            tied = _nth(m, _TIED)
            return F.struct(F.coalesce(tied, one).alias("before"), F.when(tied.isNull(), two).otherwise(one).alias("far"), after.alias("after"))

        def result(c: Column) -> Column:
            patterns = F.array(F.concat(F.lit("L1 "), c["before"]), F.concat(F.lit("L2 "), c["far"], F.lit(" "), c["before"]), F.concat(F.lit("LR "), c["before"], F.lit(" "), c["after"]))
            said = lambda x: F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("said"), F.array_compact(patterns).alias("patterns"), _seed(x, F.concat_ws(" ", c["far"], c["before"])).alias("seed"))
            return _let(inner, said)

        return _let(_let(near, told), result)

    tokens = _let(F.col("token"), lambda found: F.transform(found["m"], lambda m, i: describe(m, i, found)))
    return docs.withColumn("tokens", F.filter(tokens, lambda t: t["end"] > t["start"]))


def _mixed(token: Column, least: int) -> Column:
    return token.rlike(rf"^[A-Za-z0-9_+/=.-]{{{least},}}$") & token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def _seed(token: Column, before: Column) -> Column:
    return (
        F.when(token.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"), "email")
        .when(token.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(token.rlike("^[0-9](?:[ -]?[0-9])++$") & _luhn(token), "card")
        .when(token.rlike(r"^\+[0-9][ ().0-9-]*[0-9]$") & F.length(_digits(token)).between(9, 15), "phone")
        .when(_mixed(token, 20) & before.rlike(_CREDENTIAL), "secret")
        .when(token.rlike("^(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "national")
    )


def _shape(kind: Column, token: Column) -> Column:
    n = F.length(_digits(token))
    return (
        F.when(kind == "email", token.rlike(r"^[^@\s]++@[^@\s]++$") | token.rlike(rf"^{_SPELLED}$"))
        .when(kind == "ip", token.rlike(r"^[0-9]{1,3}(?:[.:_-][0-9]{1,3}){3}$") | token.rlike("^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}$"))
        .when(kind == "card", token.rlike("^[0-9](?:[ ./_-]?[0-9])++$") & n.between(12, 19))
        .when(kind == "phone", token.rlike("^[+(]?[0-9][ ()./0-9-]++$") & n.between(7, 15))
        .when(kind == "secret", _mixed(token, 8))
        .otherwise(token.rlike("^[0-9](?:[ ./-]?[0-9])++$") & n.between(8, 12))
    )


def good_patterns(edges: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE) -> DataFrame:
    """(pattern, kind, score) of the trusted patterns. edges: distinct (pattern, said, seed)."""
    seeds = edges.where(F.col("seed").isNotNull()).groupBy("said", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("conf"))
    size = edges.groupBy("pattern").agg(F.count_distinct("said").alias("n"))
    conf = seeds
    for turn in range(rounds):
        said = edges.select("pattern", "said").distinct()
        scored = said.join(conf, "said").groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"), F.count("*").alias("support"))
        scored = cut(scored.join(size, "pattern").select("pattern", "kind", "support", (F.col("mass") / (F.col("n") + 0.25)).alias("score")))
        if turn + 1 < rounds:
            trusted = scored.where((F.col("support") >= min_support) & (F.col("score") >= GOOD_PATTERN))
            reached = said.join(trusted, "pattern").where(_shape(F.col("kind"), F.col("said"))).groupBy("said", "kind").agg(F.max("score").alias("conf"))
            conf = cut(reached.unionByName(seeds).groupBy("said", "kind").agg(F.max("conf").alias("conf")))
    return scored.where((F.col("support") >= min_support) & (F.col("score") >= min_score)).select("pattern", "kind", "score")


def _free(added: DataFrame, base: DataFrame) -> DataFrame:
    """The added spans (k1, k2, start, rank, end) that overlap no base span."""
    both = added.withColumn("own", F.lit(True)).unionByName(base.withColumn("own", F.lit(False)))
    by_doc = Window.partitionBy("k1", "k2")
    end = F.max(F.when(~F.col("own"), F.col("end"))).over(by_doc.orderBy("start"))
    start = F.min(F.when(~F.col("own"), F.col("start"))).over(by_doc.orderBy(F.desc("start")))
    # the second spans of two that overlap go as well
    earlier = F.max("end").over(by_doc.orderBy("start", "end", "rank").rowsBetween(Window.unboundedPreceding, -1))
    free = both.select("k1", "k2", "start", "rank", "end", "own", end.alias("before"), start.alias("after"))
    free = free.where("own").where((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end"))))
    return free.select("k1", "k2", "start", "rank", "end", earlier.alias("earlier")).where(F.coalesce("earlier", F.lit(0)) <= F.col("start")).drop("earlier")


def _spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with base and added, arrays of spans."""
    docs = docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64("text", F.lit(7)))
    seen = cut(_candidates(_base(docs.select(*keep, "k1", "k2", "text"))).select(*keep, "k1", "k2", "base", "tokens"))
    tokens = seen.select("k1", "k2", F.explode("tokens").alias("t")).select("k1", "k2", "t.*")
    tokens = tokens.withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = cut(tokens.select("pattern", "said", "seed").distinct())
    rank = F.array_position(F.lit(ALL_KINDS), F.col("kind")).cast("int") - 1
    # of a candidate's kinds the best supported one, or the first
    best = F.max(F.struct("score", (-rank).alias("rank")))
    reached = tokens.where(F.col("seed").isNull() | ~F.col("seed").isin(KINDS)).join(good_patterns(edges), "pattern").where(_shape(F.col("kind"), F.col("said")))
    added = cut(reached.groupBy("k1", "k2", "start", "end").agg(best.alias("best")).select("k1", "k2", "start", (-F.col("best.rank")).alias("rank"), "end"))
    base = seen.join(added.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", F.explode("base").alias("s")).distinct()
    free = _free(added, base.select("k1", "k2", "s.start", "s.rank", "s.end"))
    free = free.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
    out = seen.join(free, ["k1", "k2"], "left")
    return out.select(*keep, "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added."""
    spans = _spans(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), ["doc_id"])
    count = [F.size(F.filter("base", _of_rank(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    n_added = F.size("added").cast("long")
    return spans.select("doc_id", *count, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "added"))).alias("spans"), (F.size("base") + n_added).alias("n_spans"), n_added.alias("n_added"))


_CUTS = 64


def _cuts(spans: Column) -> Column:
    """Sorted spans with those that overlap joined to one."""

    def joined(upto: Column) -> Column:
        n = F.size(spans)
        # a span starts a cut where all before it have ended
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0)) <= F.get(spans, i)["start"])
        cut_of = lambda f: lambda s, k: F.struct(F.get(spans, s)["start"].alias("start"), F.get(spans, s)["rank"].alias("rank"), F.get(upto, F.coalesce(F.get(f, k + 1), n) - 1).alias("end"))
        return _let(firsts, lambda f: F.transform(f, cut_of(f)))

    return F.when(F.size(spans) > 0, _let(running_max(F.transform(spans, lambda s: s["end"])), joined)).otherwise(F.array().cast(_SPAN))


def _replaced(text: Column, cuts: Column) -> Column:
    """The text with its cuts replaced. Places count from the start of a
    string, so that many cuts are made in blocks."""
    m = F.size(cuts)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    ended = lambda k: F.coalesce(F.get(cuts, k - 1)["end"], F.lit(0))
    part = lambda t, a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))

    def block(g: Column) -> Column:
        base = ended(g * _CUTS)
        one = lambda b, at: lambda s, j: F.concat(part(b, ended(g * _CUTS + j) - at, s["start"] - at), F.get(tags, s["rank"]))
        return _let(base, lambda at: _let(part(text, at, ended(F.least((g + 1) * _CUTS, m))), lambda b: F.array_join(F.transform(F.slice(cuts, g * _CUTS + 1, _CUTS), one(b, at)), "")))

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(m / _CUTS).cast("int") - 1), block)
    return F.concat(F.array_join(blocks, ""), F.substring(text, (ended(m) + 1).cast("int"), F.length(text)))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with every span of text replaced by its kind in
    brackets; n_chars, if there, counts the new text. Overlapping spans are
    replaced as one, named after the first. A null text stays null."""
    own = {c: c if c in ("doc_id", "text") else f"_{k}" for k, c in enumerate(docs.columns)}
    docs = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in own.items()), F.col("text").isNull().alias("was_null"))
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = _spans(docs, [*own.values(), "was_null"]).withColumn("cuts", _let(F.array_sort(F.concat("base", "added")), _cuts))
    found = found.withColumn("text", F.when(F.col("was_null"), F.lit(None)).otherwise(_let(F.col("cuts"), lambda c: F.when(F.size(c) > 0, _replaced(F.col("text"), c)).otherwise(F.col("text")))))
    m = F.size("cuts")
    return found.select(*(F.when(m > 0, F.length("text").cast(docs.schema[a].dataType)).otherwise(F.col(a)).alias(c) if c == "n_chars" else F.col(a).alias(c) for c, a in own.items()))


def op2(spark, sf_dir: str) -> DataFrame:
    from quarrylark.llm.shared import table

    return find_pii(table(spark, sf_dir, "documents"))
