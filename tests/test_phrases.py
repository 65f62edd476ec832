"""The phrase index against the patterns of its terms."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarrylark.functions.text import phrase_pattern, whole_word
from quarrylark.operators import scoring
from quarrylark.operators.phrases import PhraseIndex, phrase_hits, phrase_of
from quarrylark.operators.scoring import Taxonomy, Term

VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "c", "r2", "sql") for b in ("", "n", "x+", "#", "3", "zu")] + ["c++", "f#", "a"]


def terms(rng, n):
    out = []
    for _ in range(n):
        if rng.random() < 0.3:
            out.append(whole_word(re.sub("[+#]", "", rng.choice(VOCABULARY))))
        else:
            out.append(phrase_pattern(" ".join(rng.choices(VOCABULARY, k=rng.randint(1, 4))), rng.choice([0, 1, 2, 2, 3])))
    return out


def text(rng, n):
    return rng.choice(["", " ", ". "]) + "".join(rng.choice([*VOCABULARY, "und", "the", "é"]) + rng.choice([" ", " ", ", ", "-", ".\n", "+ ", "/"]) for _ in range(n))


def test_phrases_are_told_from_patterns():
    assert phrase_of(whole_word("gis")) == (("gis",), -1) and phrase_of(phrase_pattern("remote sensing")) == (("remote", "sensing"), 2)
    assert phrase_of(phrase_pattern("c++ and f#", 0)) == (("c++", "and", "f#"), 0) and phrase_of(phrase_pattern("one", 1)) == (("one",), 0)
    assert phrase_of("scum|trash") is None and phrase_of(phrase_pattern("node.js now")) is None and phrase_of("") is None


@pytest.mark.parametrize("seed", range(5))
def test_hits_are_the_patterns(seed):
    rng = random.Random(seed)
    patterns = terms(rng, 2000 if seed else 10_000)
    known = [phrase_of(p) for p in patterns]
    assert None not in known
    index = PhraseIndex(known)
    for n in (0, 1, 3, 40, 150):
        said = text(rng, n)
        assert index.hits(said) == [k for k, p in enumerate(patterns) if re.search(p, said)]


def test_many_terms_cost_what_few_do():
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 50_000)}" for _ in range(400)) for _ in range(300)]
    took = {}
    for n in (100, 10_000):
        index = PhraseIndex([(tuple(f"w{rng.randint(0, 50_000)}" for _ in range(rng.randint(1, 4))), 2) for _ in range(n)])
        began = time.process_time()
        for t in texts:
            index.hits(t)
        took[n] = time.process_time() - began
    assert took[10_000] < 6 * took[100] + 0.5


def test_scoring_by_index_is_scoring_by_patterns(spark, monkeypatch):
    """Guards, order and nulls, whichever way the terms are found."""
    rng = random.Random(3)
    patterns = terms(rng, 60)
    made = [Term(rng.choice(["tech", "domain", "resp"]), f"t{k % 40}", rng.randint(1, 9), p, f"f{k % 5}", rng.choice([None, None, f"t{rng.randint(0, 39)}"])) for k, p in enumerate(patterns)]
    rows = spark.createDataFrame([(k, text(rng, 60) if k else None) for k in range(30)], "k int, t string")
    got = scoring.with_hits(rows, "t", Taxonomy(terms=made), "h").orderBy("k").collect()
    monkeypatch.setattr(scoring, "MOST_LOOKED_UP", 0)
    assert scoring.with_hits(rows, "t", Taxonomy(terms=made), "h").orderBy("k").collect() == got
    monkeypatch.setattr(scoring, "phrase_of", lambda p: None)
    assert scoring.with_hits(rows, "t", Taxonomy(terms=made), "h").orderBy("k").collect() == got
    assert any(r.h for r in got) and not got[0].h
    found = rows.select(phrase_hits(F.col("t"), [(("c++",), 0)]).alias("h")).collect()
    assert {len(r.h) for r in found} == {0, 1}
