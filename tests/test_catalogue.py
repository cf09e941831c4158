"""Every catalogue query against its SQL in DuckDB, on whole tables."""

import re

import duckdb
import pytest

from quarrylight.functions import code_text
from quarrylight.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(found):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = rows(map(tuple, df.select(*cols).collect()))
    if name not in catalogue.oracle_sql():
        assert got or name in ("bounded_selection",)
        return
    sql = catalogue.oracle_sql()[name]
    assert sorted(duck.sql(sql).columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == rows(duck.sql(f"SELECT {quoted} FROM ({sql})").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_are_pruned(spark, sf_dir):
    plan = catalogue.queries()["kill_rate_wilson"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in plan


def test_categories_of_every_language(spark, sf_dir, duck):
    def category(text, source):
        both = f"{text} {source or ''}".lower() if text is not None else ""
        for name, keys in code_text.CATEGORIES:
            if any(k in both for k in keys):
                return name
        return "complex_loops" if re.search(r"\b(for|while)\b.*\b(for|while)\b", text or "") else "general"

    docs = duck.sql("SELECT doc_id, text, source FROM documents").fetchall()
    want = rows((i, category(t, s)) for i, t, s in docs)
    assert rows(map(tuple, catalogue.queries()["categorise"](spark, sf_dir).collect())) == want
