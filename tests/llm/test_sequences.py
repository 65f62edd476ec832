"""Vector packing, filter audit and conversation repair against plain code."""

import hashlib
import zlib
from collections import defaultdict
from itertools import permutations, product

import duckdb
import numpy as np
import pytest

from quarrylark.llm import filter_audit, repair, vector_packing
from quarrylark.llm.vector_packing import Limits, place
from tests.test_catalog import shape

P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("byte_bpe_50k.json")


# ---- op11


def plain_ids(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_pieces(got, cap):
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= cap and (at == cap or at & (at - 1) == 0)  # no padding


ODD = [
    None, "", " ", "one", "a b  c\n\nd\te \x0bf", "x <|endoftext|> y<|endoftext|>", "nb  sp  em  x", "é è ü ß ñ 漢字 かな 🙂 z", "it's we'll I'm  'tis", "tail  ", "\n", "\u0085 a\u0085 b", "12 345 6.7e8 -- ## a_b",
    "\x7f \x1c x \x01 y", "word " * 9000, "y" * 30_000, "é   x Â  y", "ab" * 3 + " " * 500 + "c",
]


def test_tokens_are_the_tokenizers(spark):
    rows = [(k, t, "en", k) for k, t in enumerate(ODD)] + [(3, "one", "de", 1), (None, "no id", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, sequence_id int")
    limits = Limits(64, 8, 64)
    got = vector_packing.pack_documents(docs, TOKENIZER, limits, shard=7).collect()
    check_pieces(got, 64)
    want, have = defaultdict(list), defaultdict(list)
    for k, t, *_ in rows:
        want[k].append(plain_ids(t).tobytes())
    for r in got:
        have[r.doc_id, r.doc_tokens].append((r.start, r.ids))
        assert len(r.ids) == 4 * r.length
    for k, bodies in want.items():
        n = len(bodies)
        if k == 3:  # a repeated row's pieces are told apart by nothing: each part stands twice
            assert sorted(x for (d, _), v in have.items() if d == 3 for x in v) == sorted([(0, bodies[0])] * n)
            continue
        parts = sorted(have[k, len(bodies[0]) // 4])
        assert b"".join(b for _, b in parts) == bodies[0] and [s for s, _ in parts] == np.cumsum([0, *[len(b) // 4 for _, b in parts]])[:-1].tolist()
    per_sequence = defaultdict(int)
    for r in got:
        per_sequence[r.sequence_id] += 1
    assert max(per_sequence.values()) <= 8


def test_packing_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = vector_packing.op11(spark, str(tmp_path)).collect()
    check_pieces(got, 2048)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(plain_ids(ODD[r.doc_id])[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum(len(plain_ids(t)) for t in ODD)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert vector_packing.pack_documents(empty, TOKENIZER).collect() == []


def by_hand(tokens, loss, limits):
    """The heuristic for examples that stay whole, one sequence after the other, in plain code."""
    left, out = dict(enumerate(zip(tokens, loss, strict=True))), []
    mean = [np.mean([t / limits.tokens for t in tokens]), 1 / limits.segments, np.mean([x / limits.loss for x in loss])]
    while left:
        room, bin_ = [limits.tokens, limits.segments, limits.loss], []
        while room[1]:
            fits = {i: (t, x) for i, (t, x) in left.items() if t <= room[0] and x <= room[2]}
            if not fits:
                break
            closing = [i for i, (t, _) in fits.items() if t == room[0]]
            dot = lambda i: sum(m * r / full * d / full for m, r, d, full in zip(mean, room, (left[i][0], 1, left[i][1]), limits, strict=True))  # noqa: B023, E731
            best = max(map(dot, fits))
            i = closing[0] if closing else next(i for i in fits if dot(i) >= best - 1e-12)
            t, x = left.pop(i)
            bin_.append(i)
            room = [room[0] - t, room[1] - 1, room[2] - x]
            if closing:
                break
        if not bin_:
            bin_.append(i := min(left))
            left.pop(i)
        out.append(bin_)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_whole_examples(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 130, 60) if seed else np.array([7] * 50)
    loss = (tokens * rng.uniform(0, 1.2, len(tokens))).astype(int)
    limits = Limits(100, 5, 60)
    got = place(tokens, loss, limits)
    bins = [got.example[got.sequence == b].tolist() for b in range(int(got.sequence.max()) + 1)]
    assert sorted(i for b in bins for i in b) == list(range(len(tokens)))
    for b in bins:
        if len(b) > 1:
            assert tokens[b].sum() <= 100 and loss[b].sum() <= 60 and len(b) <= 5
    assert bins == by_hand(tokens.tolist(), loss.tolist(), limits)


@pytest.mark.parametrize("seed", range(8))
def test_cut_examples_leave_no_padding(seed):
    rng = np.random.default_rng(seed)
    tokens = [np.array([1] * 200), rng.integers(1, 65, 300), np.array([64] * 9), np.array([63, 1, 5]), np.array([5]), rng.integers(1, 4, 500), rng.integers(50, 65, 40), np.zeros(0, int)][seed]
    limits = Limits(64, 16, 64)
    got = place(tokens, tokens, limits, True)
    for i, n in enumerate(tokens):
        parts = sorted((s, k) for e, s, k in zip(got.example, got.start, got.length, strict=True) if e == i)
        assert parts[0][0] == 0 and sum(k for _, k in parts) == n and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    for b in set(got.sequence.tolist()):
        of = got.sequence == b
        fill = int(got.length[of].sum())
        assert of.sum() <= 16 and fill <= 64 and fill & (fill - 1) == 0


def test_conversations_packed(spark):
    rng = np.random.default_rng(3)
    rows = [(c, t, ("user", "assistant")[t % 2], "word " * int(rng.integers(1, 40))) for c in range(60) for t in range(4)] + [(60, 0, "assistant", "word " * 500), (61, None, None, None), (None, 0, "user", "x")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = vector_packing.pack_conversations(talks, TOKENIZER, Limits(256, 3, 120), shard=20).collect()
    sizes = defaultdict(lambda: [0, 0])
    for c, _, role, text in rows:
        n = len(plain_ids(f"{role or ''}\n{text or ''}"))
        sizes[c][0] += n
        sizes[c][1] += n * (role == "assistant")
    assert {r.conv_id: [r.tokens, r.loss_tokens] for r in got} == dict(sizes)
    groups = defaultdict(list)
    for r in got:
        groups[r.sequence_id].append(r)
        assert r.over == (r.tokens > 256 or r.loss_tokens > 120)
    for g in groups.values():
        assert len(g) == 1 or len(g) <= 3 and sum(r.tokens for r in g) <= 256 and sum(r.loss_tokens for r in g) <= 120


# ---- op12


def plain_audit(facts, names):
    out = {}
    for part in {f["part"] or "" for f in facts}:
        rows = [f for f in facts if (f["part"] or "") == part]
        removals = defaultdict(int)
        lines = []
        for order in permutations(names):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if r[f]]
                left = [r for r in left if not r[f]]
                removals[f] += len(gone)
                lines.append((order, k + 1, f, len(left), len(gone), sum(bool(r[f]) for r in rows) - len(gone), sum(bool(r[f]) and not any(r[g] for g in names if g != f) for r in rows), sum(bool(r["good"]) for r in gone), sum(bool(r["toxic"]) for r in gone)))
        out |= {(part, "".join(o), k, f): (*rest, removals[f]) for o, k, f, *rest in lines}
    return out


@pytest.mark.parametrize("names", ["A", "BAC"])
def test_audit_against_all_orders(spark, names):
    rng = np.random.default_rng(len(names))
    pick = lambda: [None, False, True][rng.integers(0, 3)]
    facts = [{"part": [None, "", "en", "fr"][rng.integers(0, 4)], "good": pick(), "toxic": pick(), **{f: pick() for f in "ABC"}} for _ in range(150)] + [{"part": "de", "good": True, "toxic": None, **dict.fromkeys("ABC", True)}]
    df = spark.createDataFrame([tuple(f.values()) for f in facts], "part string, good boolean, toxic boolean, A boolean, B boolean, C boolean")
    got = {(r["part"], r["filter_order"], r["step"], r["filter"]): tuple(r)[4:] for r in filter_audit.audit(df, list(names)).collect()}
    assert got == plain_audit(facts, sorted(names))


def test_audit_of_odd_documents(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(300))
    texts = [None, "", "  \t\n ", long, long, long + " UPPER" * 20, " " + long + " ", "same " * 400, long + "\x0b$", "Ö" * 10, "é " * 250, "ABC", long.replace(" ", "\r\x0c"), "x" * 100_000, "w " * 50_000, long + " NB"]
    langs = ["en", None, "", "fr"]
    rows = [(k, t, langs[k % 4], 1) for k, t in enumerate(texts)] + [(3, long, "en", 2), (None, long, "en", 3), (40, None, "fr", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, part int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(16)] + [(4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(filter_audit.SQL)
    columns = [c[0] for c in want.description]
    df = filter_audit.op12(spark, str(tmp_path))
    assert shape([tuple(r) for r in df.collect()], df.columns) == shape(want.fetchall(), columns)
    facts = filter_audit.document_facts(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert filter_audit.audit(facts, list("ABCDE")).collect() == []


# ---- op13


def all_repairs(turns, most):
    """Every edit string up to `most` inserts, by brute force: the least (cost, audit)."""
    best = None
    n = len(turns)
    for inserts in range(most + 1):
        for letters in product("DIKR", repeat=n + inserts):
            if letters.count("I") != inserts:
                continue
            state, at, cost, ok = "", 0, 0, True
            for x in letters:
                asks = "a" if state == "u" else "u"
                if x == "I":
                    state, cost = asks, cost + 2
                    continue
                initial, fault = turns[at]
                at += 1
                if x == "D":
                    cost += 3
                    continue
                if fault == repair.MUST_GO or x == "K" and not (initial == asks or state == "" and initial == "s"):
                    ok = False
                    break
                cost += (0 if x == "K" else 2) + (fault == repair.CUT_OFF)
                state = initial if x == "K" else asks
            if ok and state in ("", "a"):
                key = (cost, "".join(letters))
                best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize("seed", range(25))
def test_cheapest_against_all_edits(seed):
    rng = np.random.default_rng(seed)
    turns = [("suaxU"[rng.integers(0, 5)], int(rng.integers(0, 3))) for _ in range(seed % 5)]
    ((_, got),) = repair.cheapest(turns).items()
    assert got == all_repairs(turns, 3)


def talks_of(seed, convs=30, longest=9):
    rng = np.random.default_rng(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "agent"], ["Fine.", "So?", "cut off", " \t", "", None, "Yes!", "é.", "a\nb."]
    rows = []
    for c in range(convs):
        for t in range(rng.integers(1, longest)):
            rows.append((c, int(t) * (1 + (c % 7 == 0)), roles[rng.integers(0, 9)] if c % 3 else roles[t % 2 + 1], texts[rng.integers(0, 9)] if rng.random() < 0.5 else f"{c} {t} text."))
    return [*rows, (None, None, "user", "x."), (None, 1, "assistant", "y."), (convs, None, None, None), (convs + 1, None, "user", "a."), (convs + 1, None, "user", "a."), (convs + 1, 5, "assistant", "b")]


KIND = "conv_id long, turn long, role string, text string, copy string, fault int"


def test_repair_against_sql(spark, tmp_path):
    rows = [(*r, "x", 1) for r in talks_of(1, 150)] + [(k, 0, "user", "only.", None, None) for k in range(1000, 1040)]  # some of the latter lose their only row
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(repair.SQL)
    columns = [c[0] for c in want.description]
    df = repair.op13(spark, str(tmp_path))
    rows = [tuple(r) for r in df.collect()]
    assert shape(rows, df.columns) == shape(want.fetchall(), columns)
    assert any(r[-2] == "" for r in rows)


def plain_repair(rows):
    """Per conversation in plain code: counts, cost, audit, hash of the repair."""
    out = {}
    for conv in {r[0] for r in rows}:
        said = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows if c == conv]
        said.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, turns = [], []
        for _, r, x in said:
            bare = x.strip("\t\n\x0b\x0c\r ")
            turns.append(repair.Turn(r, x, "blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated"))
            seen.append((r, x))
        ((_, (cost, audit)),) = repair.cheapest([repair.weight(t) for t in turns]).items()
        known = [t for t, _, _ in said if t is not None]
        lines = repair.repaired(turns, audit)[0]
        counts = [sum(t.fault == f for t in turns) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out[conv] = (len(said), max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest(), lines)
    return out


@pytest.mark.parametrize(("long_rows", "block"), [(4096, 256), (3, 2), (0, 4)])
def test_long_conversations_by_blocks(spark, long_rows, block):
    rng = np.random.default_rng(5)
    rows = talks_of(2, 12) + [(77, t // 2, ["user", "assistant", "system"][rng.integers(0, 3)], ["Yes.", "no", f"{t} said.", ""][rng.integers(0, 4)]) for t in range(120)] + [(78, 0, "user", "Same.")] * 40
    talks = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)
    got = {r.conv_id: (*tuple(r)[1:-1], [(t.role, t.text) for t in r.repaired]) for r in repair.repair(talks, long_rows=long_rows, block=block).collect()}
    assert got == plain_repair(rows)
    bare = {r.conv_id: tuple(r)[1:] for r in repair.repair(talks, texts=False, long_rows=long_rows, block=block).collect()}
    assert bare == {k: v[:-1] for k, v in got.items()}


def test_repair_of_nothing_and_of_a_very_long_text(spark):
    empty = spark.createDataFrame([], KIND)
    assert repair.repair(empty).collect() == [] and repair.damaged(empty).collect() == []
    far = "word. " * 400_000
    got = repair.repair(spark.createDataFrame([(1, 0, "user", far), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string"), long_chars=1 << 20).first()
    assert (got.audit, got.cost) == ("KK", 0) and got.repaired_sha256 == hashlib.sha256(f"user:{far}\nassistant:Yes.".encode()).hexdigest()


def test_damage_by_the_rows_key(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = defaultdict(list)
    for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r.conv_id, r.turn].append((r.role, r.text))
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, text.replace(".", "").replace("!", "").replace("?", ""))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(harm, [(role, text)])
        assert got[c, t] == want


# ---- op10's filter


def test_near_duplicates_keep_columns_of_any_name(spark):
    """Names with dots, blanks and backticks, and names that the operator uses itself."""
    from quarrylark.llm import minhash

    text = " ".join(f"w{k}" for k in range(40))
    names = ["doc_id", "text", "a.b", "row", "b c", "d`e", "kept"]
    docs = spark.createDataFrame([(1, text, "x", 1, None, "q", True), (2, text + " w40", "y", 2, 2.0, "r", False), (3, "other words here", None, 3, 3.0, "s", None), (None, text, "z", 4, 4.0, "t", True)], "doc_id long, text string, c string, d int, e double, f string, g boolean").toDF(*names)
    got = minhash.drop_near_duplicates(docs)
    assert got.columns == names
    assert sorted(got.collect(), key=lambda r: r["row"]) == sorted((r for r in docs.collect() if r["doc_id"] != 2), key=lambda r: r["row"])
