import math
import os

import duckdb
import pytest

from sieveline.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("SIEVELINE_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for t in TABLES:
        d.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return d


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, bool) else round(float(v), 5) if not isinstance(v, str) and hasattr(v, "__float__") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    b = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=str)
    assert a == b


def test_cells_of_a_float_array_are_those_of_single_precision(spark, duck, tmp_path):
    spark.createDataFrame([(1, [0.29] * 24 + [0.57] * 40, 0), (2, [0.1 * k for k in range(64)], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duck.sql(ORACLES["set_operations"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in QUERIES["set_operations"](spark, str(tmp_path)).collect()) == sorted(want)


def test_halves_of_balances_go_to_the_even_number(spark, duck, tmp_path):
    spark.createDataFrame([(1, 25.0), (2, 45.0)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(7, 15.0), (8, 26.0), (9, 65.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    sql = ORACLES["matched_without_reuse"]
    for t in ("supplier", "customer"):
        sql = sql.replace(f" {t}", f" '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["matched_without_reuse"](spark, str(tmp_path)).select("s_suppkey", "c_custkey", "gap").collect())) == sorted(duck.execute(sql).fetchall())
