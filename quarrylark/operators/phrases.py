"""Terms of many words found in one walk over a text's words (AGG-13, SCR-02,
STR-08).

Phrases lie in a trie of words. A walk keeps, for each node that the words so
far have reached, the place of its last word; a node goes on if its next word
comes within the phrase's gap of that place. The latest place of a node reaches
farthest, so one is enough. Words that no term has only count as places. So a
text costs its words and what it matches, however many terms there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column

from quarrylark.functions.text import column_udf, phrase_pattern, whole_word

MOST_FILLERS = 4
#: Letters of words in phrases, and in single words.
_PHRASE_WORDS, _SINGLE_WORDS = re.compile("[a-z0-9+#]+"), re.compile("[a-z0-9]+")


def phrase_of(pattern: str) -> tuple[tuple[str, ...], int] | None:
    """The words and fillers of a phrase's pattern, (word,) and -1 of a whole
    word's; None for other patterns."""
    if (m := _SINGLE_WORDS.match(pattern)) and pattern == whole_word(m[0]):
        return (m[0],), -1
    first, last = phrase_pattern("_").split("_")
    for fillers in range(MOST_FILLERS + 1):
        gap = phrase_pattern("_ _", fillers).removeprefix(f"{first}_").removesuffix(f"_{last}")
        words = tuple(w.replace("\\", "") for w in pattern.removeprefix(first).removesuffix(last).split(gap))
        if all(_PHRASE_WORDS.fullmatch(w) for w in words) and pattern == phrase_pattern(" ".join(words), fillers):
            return words, fillers
    return None


class PhraseIndex:
    """A trie for each number of fillers, and the single words."""

    def __init__(self, phrases: Iterable[tuple[tuple[str, ...], int]]):
        self.single: dict[str, list[int]] = {}
        self.tries: dict[int, list[tuple[dict[str, int], list[int]]]] = {}  # nodes: children, terms that end here
        for k, (words, fillers) in enumerate(phrases):
            if fillers < 0:
                self.single.setdefault(words[0], []).append(k)
                continue
            nodes = self.tries.setdefault(fillers, [({}, [])])
            at = 0
            for w in words:
                if w not in nodes[at][0]:
                    nodes[at][0][w] = len(nodes)
                    nodes.append(({}, []))
                at = nodes[at][0][w]
            nodes[at][1].append(k)
        self.known = {f: {w for children, _ in nodes for w in children} for f, nodes in self.tries.items()}

    def hits(self, text: str) -> list[int]:
        """The numbers of the terms that stand in folded text, sorted."""
        found = set()
        if self.single:
            for word in self.single.keys() & set(_SINGLE_WORDS.findall(text)):
                found.update(self.single[word])
        words = _PHRASE_WORDS.findall(text) if self.tries else []
        for fillers, nodes in self.tries.items():
            known, reached, root = self.known[fillers], {}, nodes[0][0]
            for place, word in enumerate(words):
                if word not in known:
                    continue
                ahead = []
                for node, last in reached.items():
                    if place - last <= fillers + 1 and (child := nodes[node][0].get(word)):
                        ahead.append(child)
                if child := root.get(word):
                    ahead.append(child)
                for child in ahead:
                    reached[child] = place
                    found.update(nodes[child][1])
                if len(reached) > 64:
                    reached = {n: p for n, p in reached.items() if place - p <= fillers}
        return sorted(found)


def phrase_hits(text: Column, phrases: list[tuple[tuple[str, ...], int]]) -> Column:
    """ARRAY<INT> of the numbers of the phrases in folded text; empty for null.
    The index is made once on the driver and goes along with the function."""
    index = PhraseIndex(phrases)

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: index.hits(t) if t else [])

    return column_udf(find, "array<int>")(text)
