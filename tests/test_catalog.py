"""Every registered query against its DuckDB equivalent on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvane.operators import gate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if type(v).__name__.startswith(("int", "uint", "float")):
        return f"{float(v):.9g}"
    return "" if str(v) in ("NaT", "<NA>") else str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(cell, r)) for r in pdf[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    got, want = rows(entry.queries()[name](spark, SF).toPandas()), rows(duck.sql(entry.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 25


def test_parsed_queries(spark):
    units = entry.queries()["q_units"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(units) == docs and set(units["name"].str.startswith("act_")) == {True}
    scores = entry.queries()["q_complexity"](spark, SF).toPandas()
    assert len(scores) == docs and (scores.cc % 3 == 0).all()  # each condition counts 1, and its two operators 1 each


def test_treemap_tiles(spark):
    t = entry.queries()["q_treemap"](spark, SF).toPandas()
    assert len(t) == 25
    for _, box in t.groupby("n_regionkey"):
        assert abs((box.w * box.h).sum() - 600_000) < 1e-6


def test_flagship_plan_prunes_columns_and_joins_by_hash(spark):
    plan = entry.entry(spark)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan


def test_parsed_queries_take_every_sentence(spark):
    n = F.size(gate.sentences(F.col("text")))
    path = F.concat(F.lit("m/"), F.col("doc_id").cast("string"), F.lit(".py"))
    want = {r.path: r.n for r in spark.read.parquet(f"{SF}/documents.parquet").select(path.alias("path"), n.alias("n")).collect()}
    assert max(want.values()) > 200
    units = entry.queries()["q_units"](spark, SF).collect()
    assert {r.path: (r["loc"], r.callees) for r in units} == {p: (1 + k + (k + 1) // 2, ["say"] if k else []) for p, k in want.items()}
    scores = entry.queries()["q_complexity"](spark, SF).collect()
    assert {r.path: r.cc for r in scores} == {p: 3 * ((k + 1) // 2) for p, k in want.items()}
