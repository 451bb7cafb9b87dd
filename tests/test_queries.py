import pytest

import __spark_entry__ as entry
from helixframe.plans import files  # noqa: F401
from helixframe.plans import oracle as sql
from helixframe.plans import queries as own

from .conftest import SF, same, tables

#: Queries on sites of genes have rows on the larger tables only, and the SQL of gene tests is for groups of more than 8; all others are held against SQL on the smallest tables.
LARGER = sorted({n for n, text in own.ORACLES.items() if sql.SITES in text or sql.SITES.lstrip() in text} | {"q_seventeen_metrics", "q_gene_pvalues_bh", "q_utest_exact_small", "q_collapse_chunk_mean", "q_attn_column_sums_qk", "q_gene_utest", "q_gene_metric_table", "q_significant_counts", "q_significant_genes", "q_top_genes", "q_gene_pvalue_file"})
SMALL = SF.replace("sf0.01", "sf0.001")


@pytest.fixture(scope="module")
def small_duck():
    return tables(SMALL)


@pytest.mark.parametrize("name", LARGER)
def test_against_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF).cache()
    same(df, duck, own.ORACLES[name])
    assert df.count() > 0
    if "gene" in df.columns and sql.SITES in own.ORACLES[name]:
        assert df.select("gene").distinct().count() == 4
    df.unpersist()


@pytest.mark.parametrize("name", sorted(set(own.ORACLES) - set(LARGER)))
def test_against_sql_on_small_tables(spark, small_duck, name):
    df = own.QUERIES[name](spark, SMALL).cache()
    same(df, small_duck, own.ORACLES[name])
    assert df.count() > 0
    df.unpersist()


def test_first_rows_of_ties_are_the_first_in_the_files(spark, tmp_path):
    def rows(k, n):
        return spark.range(n).selectExpr("id % 50 AS l_orderkey", "CAST(id % 100 DIV 50 AS INT) AS l_linenumber", f"{k} - id AS l_partkey").coalesce(1)

    # Spark reads large files first.
    for k, n in ((1, 100), (2, 100_000)):
        rows(k, n).write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
        made = next(f for f in (tmp_path / "lineitem.parquet").glob("part-*"))
        made.rename(made.with_name(f"{k}.parquet"))
    found = own.QUERIES["q_first_rows"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(i, 0, 1 - i) for i in range(50)]


def test_every_query_has_sql():
    assert set(own.QUERIES) == set(own.ORACLES)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 52 and df.count() == 4
