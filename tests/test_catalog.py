"""Every query of the catalog against its DuckDB equivalent."""

import os

import duckdb
import pytest

from quarrylark.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shape(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 9) if isinstance(x, float) else x
    return [columns[i] for i in order], sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.ORACLE_SQL.get(name)
    if sql is None:
        assert rows
        return
    q = duck.execute(sql)
    columns = [c[0] for c in q.description]
    assert shape(rows, df.columns) == shape(q.fetchall(), columns)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_entry_points():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_title_filter_reaches_below_parsers(spark):
    """OPT-01: the title test stands on the scan's side of a Python stage."""
    from quarrylark.functions.text import fold
    from quarrylark.operators.scoring import title_prefilter
    from quarrylark.plans.bindings import TAXONOMY, table, title

    plan = table(spark, SF, "documents").where(title_prefilter(fold(title()), TAXONOMY)).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


@pytest.fixture()
def long_texts(spark, tmp_path):
    far = "word " * 200
    texts = [far + "No sponsorship", far, far + "Apply by 3 April 2024", far + "Visa sponsorship is available", "short", far + "You must have the right to work", "Apply by 5 March 2024", far + "Deadline: 1 February 2024"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(1, k, "user", t) for k, t in enumerate(["a" * 450, "b" * 450, "c" * 450, "d" * 2500, "e", "f" * 998, "g"])] + [(2, 0, "user", "h" * 1500)]
    spark.createDataFrame(lines, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path), texts, lines


def test_work_auth_reads_whole_texts(spark, long_texts):
    from quarrylark.operators.scoring import rights_said

    sf, texts, _ = long_texts
    got = {r.doc_id: (r.reading, r.required, r.offered) for r in catalog.QUERIES["work_auth"](spark, sf).collect()}
    for k, t in enumerate(texts):
        end, country, scope, remote = catalog._RIGHTS[k][:4]
        said = rights_said(f"{t}. {end}")
        offered = "offer" in said and "refusal" not in said
        needed = "refusal" in said and not (remote and scope == "Worldwide") or "demand" in said and not offered
        reading = "refusal" if "refusal" in said else "offer" if "offer" in said else "demand" if "demand" in said and "everyone" not in said else "neutral"
        assert got[k] == (reading, needed and country != "France" and "everyone" not in said, offered)
    assert got[0][0] == "refusal" and got[3][0] == "offer" and got[4] == ("demand", True, False)


def test_deadline_find_reads_whole_texts(spark, long_texts):
    import datetime as dt

    from quarrylark.functions.dates import deadline_in

    sf, texts, _ = long_texts
    got = {r.doc_id: r.deadline for r in catalog.QUERIES["deadline_find"](spark, sf).collect()}
    ends = [(f"{t}. {catalog._DEADLINES[k][0]}", catalog._DEADLINES[k][1]) for k, t in enumerate(texts)]
    assert got == {k: deadline_in(t, dt.date(2024, 1, 31), c) for k, (t, c) in enumerate(ends)}
    assert got[2] == dt.date(2024, 4, 3) and got[7] == dt.date(2024, 2, 1) and got[3] == dt.date(2024, 3, 12)


def test_digest_pack_keeps_whole_lines(spark, long_texts):
    sf, _, lines = long_texts
    got = {(r.recipient, r.part): r.size for r in catalog.QUERIES["digest_pack"](spark, sf).collect()}
    want, size, part = {}, {}, {}
    for conv, _, role, t in lines:
        to = f"{conv}/{role}"
        if size.get(to, 0) and size[to] + 1 + len(t) > 1000:
            part[to], size[to] = part[to] + 1, 0
        part.setdefault(to, 0)
        size[to] = size.get(to, 0) + len(t) + (1 if size.get(to, 0) else 0)
        want[to, part[to]] = size[to]
    assert got == want and got["1/user", 2] == 2500 and got["2/user", 0] == 1500
