"""Texts as clauses of plain words, for readers that weigh words by their
distance instead of matching phrases.

Words are lower-cased letters without accents; numbers and dates in digits
are words of their own. Ends of sentences, lines, bullets and tags end a
clause; a point after a day or a month doesn't.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENDS = re.compile(r"(<[^>]*>|[\r\n•]|[.;!?](?=\s|$))")
_WORDS = re.compile("[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}|[0-9]+|[a-z]+")
#: Where the characters begin that can be marks on others.
_MARKS = re.compile("[\u0300-\U0010ffff]")


def plain(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        for c in set(_MARKS.findall(text)):
            if unicodedata.combining(c):
                text = text.replace(c, "")
    return text.lower().replace("’", "'").replace("n't", " not").replace("cannot", "can not")


def clauses_of(text: str | None, after_point: Iterable[str] = ()) -> list[list[str]]:
    """The clauses' words. A point between one of `after_point` and a number,
    in either order, is part of an abbreviation; behind such a word before
    others it ends a sentence."""
    known = after_point if isinstance(after_point, (set, frozenset)) else set(after_point)
    parts = _ENDS.split(plain(text or ""))  # texts and what ends them, in turn
    out: list[list[str]] = [_WORDS.findall(parts[0])]
    for end, said in zip(parts[1::2], parts[2::2], strict=True):
        words = _WORDS.findall(said)
        if known and end == "." and words and out[-1] and _abbreviated(out[-1][-1], words[0], known):
            out[-1] += words
        else:
            out.append(words)
    return [c for c in out if c]


def _abbreviated(last: str, following: str, known: Iterable[str]) -> bool:
    return last in known and following[0].isdigit() or last.isdigit() and following in known


def says_any(text: Column, stems: list[str]) -> Column:
    """Whether a text holds one of the stems, in either case; faster than one
    pattern of all. The text is lower-cased once."""
    holds = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in stems])
    return F.coalesce(F.get(F.transform(F.array(F.lower(text)), holds), F.lit(0)), F.lit(False))


def lexicon(**classes: str) -> dict[str, str]:
    """word -> class, from one line of words a class."""
    return {word: name for name, words in classes.items() for word in words.split()}


def phrase_at(clause: list[str], at: int, phrases: set[tuple[str, ...]], longest: int) -> int:
    """The length of the longest of the phrases that starts there, or 0."""
    return next((n for n in range(longest, 0, -1) if tuple(clause[at : at + n]) in phrases), 0)
