"""Text functions as Column -> Column (STR-01 to STR-18)."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarrylark.session import bounded_batches


def column_udf(f, kind: str):
    """A pandas UDF of a function over series; made at the call, as that needs
    a session. Its batches are bounded: by default they hold 10,000 texts, so
    a worker would hold more the more texts a task has."""
    if spark := SparkSession.getActiveSession():
        bounded_batches(spark)
    return F.pandas_udf(f, kind)


def _latin() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without them."""
    pairs = []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and c == c.lower():
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _latin()


def fold(text: Column) -> Column:
    """Lower case without Latin accents, white space collapsed (STR-01). Null
    stays null. fold_exact covers all of Unicode."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), r"\s+", " "))


def _fold_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else re.sub(r"\s+", " ", "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))).strip().lower())


def fold_exact(text: Column) -> Column:
    """fold by full compatibility decomposition."""
    return column_udf(_fold_all, "string")(text)


#: Trailing legal forms that don't tell companies apart.
LEGAL_FORMS = ["inc", "llc", "ltd", "limited", "corp", "corporation", "company", "co", "gmbh", "ag", "sa", "sas", "sarl", "bv", "nv", "plc", "oy", "ab", "as", "srl", "spa", "kg"]


def normalize_company(name: Column) -> Column:
    """Folded letters and digits without trailing legal forms (STR-02)."""
    joined = F.regexp_replace(fold(name), r"\b([a-z])\.([a-z])\.", "$1$2")
    plain = F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(plain, f"( ({'|'.join(LEGAL_FORMS)}))+$", ""))


def normalize_title(title: Column) -> Column:
    """Folded title without gender markers; + / # stay (STR-03)."""
    bare = F.regexp_replace(fold(title), r"\(?\b[mfhwdx]( ?/ ?[mfhwdx])+\b\)?", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9+/#]+", " "))


#: Words that many employers' names share.
COMMON_NAME_WORDS = ["the", "of", "and", "group", "services", "solutions", "consulting", "international", "europe", "holding"]


def core_name(name: Column) -> Column:
    """The distinctive words of a normalised company name (STR-04)."""
    common = F.array(*[F.lit(w) for w in COMMON_NAME_WORDS])
    return F.array_join(F.filter(F.split(normalize_company(name), " "), lambda w: ~F.array_contains(common, w)), " ")


def distinctive(core: Column, least: int = 4) -> Column:
    """Whether a core name is long enough to match on alone."""
    return F.length(F.regexp_replace(core, " ", "")) >= least


def slug_candidates(name: Column) -> Column:
    """Distinct page slugs that a company may use, likeliest first (STR-05)."""
    words = F.split(normalize_company(name), " ")
    made = F.array(F.array_join(words, ""), F.array_join(words, "-"), F.get(words, F.lit(0)))
    return F.array_distinct(F.filter(made, lambda s: F.length(s) > 1))


def short_hash(text: Column, size: int = 20) -> Column:
    """Leading hexadecimal digits of SHA-1 (STR-06)."""
    return F.substring(F.sha1(text), 1, size)


def job_code(key: Column) -> Column:
    return short_hash(key, 5)


def truncate(text: Column, size: int) -> Column:
    """At most size characters, an ellipsis as the last where cut (STR-07)."""
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size - 1)), F.lit("…"))).otherwise(text)


def prettify_slug(slug: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(slug, "[-_]+", " ")))


def phrase_pattern(phrase: str, fillers: int = 2) -> str:
    """A pattern of the phrase's words in order, with up to `fillers` words
    between them, as whole words of folded text (STR-08)."""
    gap = rf"(?:[^a-z0-9+#]+[a-z0-9+#]+){{0,{fillers}}}[^a-z0-9+#]+"
    return rf"(?:^|[^a-z0-9+#]){gap.join(re.escape(w) for w in phrase.split())}(?:$|[^a-z0-9+#])"


def whole_word(word: str) -> str:
    """A pattern of one whole word of folded text that starts with the word
    itself, so that the search can skip (OPT-08)."""
    return rf"{re.escape(word)}(?![a-z0-9])(?<![a-z0-9]{re.escape(word)})"


def has_word(text: Column, word: str) -> Column:
    """Whether folded text holds the word or phrase, whole (STR-15)."""
    return text.rlike(rf"(?:^|[^a-z0-9]){re.escape(word)}(?:$|[^a-z0-9])")


#: Arabic vowel signs, tatweel; forms of alef, yeh and teh marbuta.
_ARABIC_MARKS = "[ً-ْٰـ]"


def arabic_plain(text: Column) -> Column:
    """Arabic without vowel signs and with one form of alef (STR-09)."""
    return F.translate(F.regexp_replace(text, _ARABIC_MARKS, ""), "أإآٱىة", "ااااية")


def has_arabic(text: Column) -> Column:
    return text.rlike("[؀-ۿ]")


def _sentences(text: pd.Series, at: pd.Series) -> pd.Series:
    def cut(t, k):
        if t is None or k is None or pd.isna(k):
            return None
        k = int(k)
        start = max(t.rfind(c, 0, k) for c in ".!?\n") + 1
        end = min((i for c in ".!?\n" if (i := t.find(c, k)) >= 0), default=len(t))
        return t[start:end].strip()

    return pd.Series([cut(t, k) for t, k in zip(text, at, strict=True)], dtype=object)


def sentence_around(text: Column, at: Column) -> Column:
    """The sentence around a place in the text (STR-10)."""
    return column_udf(_sentences, "string")(text, at)


#: Function words by language.
FUNCTION_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine", "zu", "den", "von"],
    "en": ["the", "and", "of", "to", "is", "in", "that", "for", "with", "on", "was", "be"],
    "es": ["el", "los", "las", "una", "del", "que", "para", "por", "con", "se", "su", "es"],
    "fr": ["le", "les", "des", "une", "est", "et", "dans", "pour", "que", "pas", "sur", "du"],
}


def guess_language(text: Column) -> Column:
    """The language with most function words, the first by name in a tie,
    null without any (STR-11). The text is taken apart once, and its function
    words are picked out once for all languages."""
    words = F.split(F.regexp_replace(fold(text), "[^a-z]+", " "), " ")
    known = F.filter(words, _in(sorted({w for v in FUNCTION_WORDS.values() for w in v})))

    def best_of(said: Column) -> Column:
        counts = {k: F.size(F.filter(said, _in(v))) for k, v in FUNCTION_WORDS.items()}
        ranked = F.array_sort(F.array(*[F.struct((-n).alias("n"), F.lit(k).alias("k")) for k, n in counts.items()]))
        return F.get(ranked, F.lit(0))

    best = F.get(F.filter(F.transform(F.array(known), best_of), lambda b: b["n"] < 0), F.lit(0))
    return best["k"]


def _in(words: list[str]):
    return lambda w: w.isin(words)


def closest_word(word: str, known: list[str], cutoff: float = 0.8) -> str | None:
    """The known word that a typo stands for: same first letter, length
    differs by one at most (STR-12)."""
    near = [k for k in known if k[:1] == word[:1] and abs(len(k) - len(word)) <= 1]
    found = difflib.get_close_matches(word, near, 1, cutoff)
    return found[0] if found else None


def split_message(text: str, limit: int = 4096) -> list[str]:
    """Parts of at most limit characters, cut at blank lines, else at line
    ends, else anywhere (STR-13)."""
    parts, rest = [], text
    while len(rest) > limit:
        at = rest.rfind("\n\n", 1, limit)
        at = at if at > 0 else rest.rfind("\n", 1, limit)
        at = at if at > 0 else limit
        parts.append(rest[:at].rstrip())
        rest = rest[at:].lstrip("\n")
    return [*parts, rest] if rest or not parts else parts


def repair_entities(xml: str) -> str:
    """Named HTML entities as characters, stray ampersands escaped, so that an
    XML parser takes the text (STR-14)."""
    import html

    def one(m: re.Match) -> str:
        if m[1] in ("amp", "lt", "gt", "quot", "apos") or m[1].startswith("#"):
            return m[0]
        said = html.unescape(m[0])
        return said if said != m[0] else "&amp;" + m[0][1:]

    return re.sub(r"&(?!#?\w+;)", "&amp;", re.sub(r"&(#?\w+);", one, xml))
