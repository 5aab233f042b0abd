"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import duckdb
import pytest

from postmill.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(ORACLES[name])
    at = {x[0]: i for i, x in enumerate(found.description)}
    types = {x[0]: str(x[1]) for x in found.description}
    assert sorted(at) == cols
    want = sorted((tuple(plain(r[at[c]]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == want
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields} == types


def test_queries_without_sql(spark, sf):
    rows = {r["doc_id"]: r["guess"] for r in QUERIES["description_language"](spark, sf).collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sum(rows[i] == langs[i] for i in langs) > 0.95 * len(langs)
    learnt = QUERIES["learnt_language"](spark, sf).collect()
    assert sum(r["guess"] == r["lang"] for r in learnt) > 0.95 * len(learnt) > 20
    exact = {r[0] for r in QUERIES["semantic_dedup"](spark, sf).collect()}
    near = {r[0] for r in QUERIES["semantic_dedup_lsh"](spark, sf).collect()}
    assert exact == near
    scored = QUERIES["model_scoring"](spark, sf)
    assert scored.count() == QUERIES["viability_reason"](spark, sf).count()
