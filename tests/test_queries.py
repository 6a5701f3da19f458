"""Every registered query of the engine's own operators against DuckDB on the smallest tables, and edge cases."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossalake.functions import text as T
from glossalake.operators import lexical as X
from glossalake.operators import repository as R
from glossalake.plans import queries as plans

SF = "/root/testdata/sf0.001"


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([None if pd.api.types.is_scalar(v) and pd.isna(v) else float(v) if isinstance(v, int | float) else v for v in r]) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_against_duckdb(spark, name):
    got = plans.QUERIES[name](spark, SF)
    if name not in plans.ORACLE_SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    assert _rows(got.toPandas()) == _rows(con.execute(plans.ORACLE_SQL[name]).df())


def test_coordinates(spark):
    rows = [(x,) for x in (None, "", "n/a", "0", "0.0", "-0.0", "12.5", "-3")]
    df = spark.createDataFrame(rows, "c string")
    assert {r.c for r in df.filter(T.valid_coordinates(F.col("c"), F.lit("1"))).collect()} == {"12.5", "-3"}


def test_search_wildcards_and_backslash(spark):
    df = spark.createDataFrame([("a%b",), ("a\\b",), ("ÀB",)], "Name string")
    assert X.search(df, name="\\").count() == 1
    assert X.search(df, name="à_").count() == 1


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0]), ([], []), ([0.6, 0.8], [0.6, 0.8])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]


def test_page_limits(spark):
    with pytest.raises(ValueError):
        X.page(spark.range(3).toDF("ID"), ["ID"], 5001)


def test_matrix_drops_blank_forms_and_null_keys(spark):
    df = spark.createDataFrame([(1, "A", "x"), (1, "A", "y"), (1, "B", " "), (None, "A", "x")], "id int, c string, f string")
    assert [tuple(r) for r in X.binary_matrix(df, ["id"], "c", "f", ["A", "B"]).collect()] == [(1, 1, 0)]


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, R.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c")]


def test_trimmed_odd_texts_against_duckdb(spark, tmp_path):
    """Null, white space beyond ASCII at the ends and at the cut, and dense line numbers."""
    texts = [None, "", "\u00a0x\u00a0", "a\u0085b.\u3000", "u" * 199 + "\u00a0 v w", "".join(f"{i} some words here." for i in range(1, 12)), "In 1990. In 1991. In 1992. In 1993. In 1994. In 1995. x", "\x0b a \x0c", " \U0001f600" * 180]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "src1", "n_chars": 1}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert _rows(plans.QUERIES["trim_context"](spark, str(tmp_path)).toPandas()) == _rows(con.execute(plans.ORACLE_SQL["trim_context"]).df())
