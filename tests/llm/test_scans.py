"""Licences, languages, URLs, quality and decontamination against plain code."""

import os
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarrylark.llm import decontaminate, languages, licenses, quality, urls
from quarrylark.llm.bytescan import ALNUM, SPACED, hash_spans, runs, slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, TEXT2 string, n_words string"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, g, "x", "clash") for k, t, g in rows], DOCS)


def test_words_and_hashes():
    texts = ["Ab c", None, "", "é_1 ab", "ab"]
    for _, _, data, offs in slices(pa.array(texts)):
        s, e, at = runs(data, offs, SPACED)
        h = hash_spans(data, s, e)
        assert np.diff(at).tolist() == [2, 0, 0, 2, 1]
        assert h[3] == h[4] != h[0]
    big = np.frombuffer(b"x" * 700_000 + b" y", np.uint8)
    s, e, _ = runs(big, np.array([0, len(big)]), ALNUM)
    assert len(hash_spans(big, s, e)) == 2


EDGE = [(1, None, None), (2, "", "en"), (3, "   ", None), (None, "All Rights  Reserved; CC-BY x General public LICENSE cc by", None), (4, "all rights reserved " * 3, "en"), (4, "all rights reserved " * 3, "en"), (5, "w " * 50_000 + "cc by", "fr"), (6, "Licensed under the Apache License, Version 2.0.", None), (7, "licensed under cc by-nc 4.0", None)]


def test_licenses(spark):
    rows = licenses.scan_licenses(docs_of(spark, EDGE)).collect()
    assert len(rows) == len(EDGE)
    seen = sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in rows)
    expected = []
    for k, t, _ in EDGE:
        w = WORD.findall((t or "").translate(LOWER))
        places, labels = [], set()
        for label, phrase in licenses.BASE:
            p = phrase.split()
            for i in range(len(w)):
                if w[i : i + len(p)] == p:
                    places.append(i), labels.add(label)
        expected.append(repr((k, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))))
    assert seen == sorted(expected)
    by = {r.doc_id: r for r in rows}
    assert by[6].labels == "apache-2.0" and by[6].score == 1.0
    assert by[7].labels == "cc-by,cc-by-nc-4.0" and by[2].labels == "" and by[2].score == 0
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0


def brute_labels(text):
    """Every template at every place, in plain code."""
    w = WORD.findall((text or "").translate(LOWER))
    labels, score = set(), 0.0
    for label, said, keys in [(a, p, [p]) for a, p in licenses.BASE] + licenses.NOTICES:
        t = said.split()
        must = set()
        for key in keys:
            q = key.split()
            i = next(i for i in range(len(t)) if t[i : i + len(q)] == q)
            must |= set(range(i, i + len(q)))
        for start in range(-len(t) + 1, len(w)):
            same = {j for j in range(len(t)) if 0 <= start + j < len(w) and w[start + j] == t[j]}
            if must <= same and len(same) / len(t) >= licenses.MIN_COVERAGE:
                labels.add(label)
                score = max(score, len(same) / len(t))
    return ",".join(sorted(labels)), round(score, 9)


def test_license_labels_and_scores_against_plain_code(spark):
    """Notices whole, cut at an end and with words changed or left out, where
    some words of a notice stand in no document."""
    rng = np.random.default_rng(4)
    notices = [n.split() for _, n, _ in licenses.NOTICES] + [p.split() for _, p in licenses.BASE]
    rows = [(0, "you get permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to xxxx xx the software yyyy zzzz", None)]
    for k in range(1, 260):
        said = []
        for _ in range(int(rng.integers(0, 4))):
            n = list(notices[rng.integers(0, len(notices))])
            for _ in range(int(rng.integers(0, 5))):
                n[int(rng.integers(0, len(n)))] = str(rng.choice(["x", "the", "software", "license", "4"]))
            a = int(rng.integers(0, 4)) if rng.random() < 0.3 else 0
            said += [*n[a:], *rng.choice(["alpha", "license", "public"], int(rng.integers(0, 3))).tolist()]
        rows.append((k, " ".join(said), None))
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert got == {k: brute_labels(t) for k, t, _ in rows}
    assert got[0][0] == "mit" and sum(bool(x) for x, _ in got.values()) > 100


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_licenses_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    q = con.execute(licenses.SQL)
    columns = [c[0] for c in q.description]
    assert sorted(map(repr, q.fetchall())) == sorted(repr(tuple(r)) for r in licenses.op1(spark, "/root/testdata/sf0.001").select(*columns).collect())


def hits_of(items, text, window=10):
    w = WORD.findall((text or "").translate(LOWER))
    hit, named = set(), set()
    for item, t in items:
        q = WORD.findall((t or "").translate(LOWER))
        m = min(window, len(q))
        for k in range(len(q) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == q[k : k + m]:
                    hit.update(range(i, i + m))
                    if item is not None:
                        named.add(str(item))
    return len(w), len(hit), len(named)


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_decontaminate(spark, block):
    rng = np.random.default_rng(0)
    words = ["aa", "bb", "cc", "é", "d1"]
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(1, say(12)), (2, say(3)), (3, "Zz"), (4, None), (5, ""), (None, say(11)), (6, say(10))]
    texts = [None, "", "zz", *[say(int(n)) for n in rng.integers(0, 60, 60)], items[0][1] + ". " + items[6][1], "x " * 30_000 + items[0][1]]
    docs = docs_of(spark, [(k, t, None) for k, t in enumerate(texts)] + [(None, "zz", None), (2, "zz", None)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_hits(docs, bench, block_bytes=block).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: (r.n_words, len(r.hits or []), len(r["items"] or [])) for r in found if r.doc_id is not None}
    for k, t in enumerate(texts[:-1]):
        assert by[k] == hits_of(items, t), t
    assert by[len(texts) - 1][1] >= 12
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, v in by.items() if not v[1]}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_benchmark_tables_are_small_and_complete():
    """The tables of a block take a few times its text; every window is found
    at its place, also where a bucket holds many."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "dddd", "e1"], 60)).encode() for _ in range(3000)]
    body = decontaminate.build_tables(texts)
    assert len(body) < 20 * sum(map(len, texts))
    block = decontaminate.Benchmark(body)
    data = np.frombuffer(b"".join(texts[:20]), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts[:20]])))
    starts, ends, row_at = runs(data, offs, ALNUM)
    found = {(p, i) for p, m, i in block.find(data, hash_spans(data, starts, ends), starts, ends, row_at)}
    assert {(int(row_at[i]) + k, i) for i in range(20) for k in range(51)} <= found
    assert all(b" ".join(data[a:b].tobytes() for a, b in zip(starts[p : p + 10], ends[p : p + 10], strict=True)) in b" ".join(texts[i].split()) for p, i in found)


def test_urls(spark):
    said = ["http://a.com/x?y", "https://WWW.Example.com/en/1", "http://example.com/en/", "http://x.net/es/2#a", "http://net/fr/", "http://xnet/fr/", None, "nothing", "http://a.com", "a://b.example.com/en", "://", "http://example.com/en/ü"]
    pages = spark.createDataFrame(list(enumerate(said)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}

    def judge(u):
        if u is None or "://" not in u:
            host = path = ""
        else:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOWER)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    assert got == {k: judge(u) for k, u in enumerate(said)}
    index = urls.DigestIndex(urls.build_index([]))
    assert urls.judge(index, ["http://a.com/"], "allow")[3] == ["allow"]


def test_languages(spark):
    rng = np.random.default_rng(1)
    stock = {"en": ["the", "thing", "with", "ough"], "fr": ["élan", "eau", "que", "où"], "de": ["über", "und", "ß", "sch"]}
    rows = [(k, " ".join(rng.choice(stock[g], 40)), g) for k, g in enumerate(rng.choice(list(stock), 120).tolist())]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !", None), (903, "¡!", None), (904, "qqqq zzzz", None), (None, "the thing", "en"), (905, "THE THING with", None), (905, "THE THING with", None)]
    out = languages.identify_languages(docs_of(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    truth = dict((k, g) for k, _, g in rows[:120])
    assert all(r.lang_pred == truth[r.doc_id] for r in out if r.doc_id is not None and r.doc_id < 900)
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (900, 901, 902, 903)] == ["und"] * 4 and by[905].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert {r.lang_pred for r in languages.identify_languages(docs_of(spark, [(1, "abc", None)])).collect()} == {"und"}


def test_language_labels_of_held_out_rows_do_not_matter(spark):
    rows = [(k, "aaa bbb ccc" if k % 2 else "xxx yyy zzz", "a" if k % 2 else "x") for k in range(60)]
    swapped = [(k, t, ("wrong" if zlib.crc32(str(k).encode()) % 5 == 0 else g)) for k, t, g in rows]
    one, two = (sorted(map(tuple, languages.identify_languages(docs_of(spark, r)).collect())) for r in (rows, swapped))
    assert one == two


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang")
    rows = languages.op4(spark, TABLES).where("held_out").join(docs, "doc_id").where("lang is not null").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", "quality")
    rows = quality.op7(spark, TABLES).where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    order = np.mean([(p > b) + 0.5 * (p == b) for p in good for b in bad])
    assert len(rows) > 50 and order >= 0.97 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_masks_name_every_language_that_has_a_gram():
    rng = np.random.default_rng(5)
    members = [rng.choice(1 << 20, 3000, replace=False).astype(np.uint32) for _ in range(70)]
    bloom = languages.BitslicedBloom(members)
    for k in (0, 33, 64, 69):
        mask = bloom.languages(members[k])
        assert ((mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
    other = np.arange(1 << 21, (1 << 21) + 20_000).astype(np.uint32)
    hit = np.mean([(bloom.languages(other)[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) for k in range(70)])
    assert abs(hit - bloom.false_positive.mean()) < 0.002


def test_very_long_and_empty_inputs(spark):
    """Texts of many megabytes beside empty ones; tables without rows; null
    keys and clashing columns."""
    long = "the thing with words and sentences. " * 60_000
    rows = [(1, long, "en"), (2, "", "en"), (3, None, None), (4, "le chat est là", "fr"), (None, long[:50], "en")]
    docs = docs_of(spark, rows)
    assert {r.doc_id: r.lang_pred for r in languages.identify_languages(docs).collect()}[1] == "en"
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.score_quality(docs, labels).collect()) == 5
    assert {r.doc_id: r.n_words for r in licenses.scan_licenses(docs).collect()}[1] == 6 * 60_000
    bench = spark.createDataFrame([(1, long[:200])], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, bench).collect() if r.doc_id is not None}
    assert hits[1] > 300_000 and hits[2] == hits[3] == hits[4] == 0
    pages = spark.createDataFrame([(None, "https://a.net/fr/", "x", "y", "z"), (1, None, "x", "y", "z")], "page_id long, url string, host string, path string, rule string")
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()) == Counter([(None, "a.net", "/fr/", "net/fr/", "block"), (1, "", "", None, "allow")])
    for empty in (languages.identify_languages(docs.limit(0)), licenses.scan_licenses(docs.limit(0)), urls.filter_urls(pages.limit(0)), decontaminate.decontaminate(docs.limit(0), bench)):
        assert empty.count() == 0


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 30)) + "."
    bad = lambda: "### ".join(rng.choice(["alpha", "beta"], 30)) + "!!!"
    rows = [(k, good() if k % 3 else bad(), None) for k in range(300)] + [(900, None, None), (901, "", None), (None, "x", None)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs_of(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in out if r.doc_id is not None and r.doc_id < 300)
    kept = quality.keep_good(docs_of(spark, rows), labels)
    assert kept.columns == docs_of(spark, rows).columns and kept.where("doc_id % 3 = 0 and doc_id < 300").count() == 0
    alone = quality.score_quality(docs_of(spark, rows), labels.limit(0)).select("score").distinct().collect()
    assert [round(r.score, 6) for r in alone] == [0.5]
    assert quality.score_quality(docs_of(spark, []), labels).count() == 0


def test_rules_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    values = rng.random((400, len(quality.STATISTICS)))
    model = quality.RuleEnsemble.fit(values, (values[:, 3] + values[:, 5] > 1).astype(float))
    assert 0 < len(model.rules) < 400
    df = spark.createDataFrame(values[:50].tolist(), [f"f_{s}" for s in quality.STATISTICS])
    got = [r.s for r in df.select(model.score().alias("s")).collect()]
    margin = model.bias + sum(w * quality._holds(r, values[:50]) for r, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))
