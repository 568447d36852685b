"""Plans that must hold at scale, and every query against its SQL twin at the smallest scale."""

import pytest
from pyspark.sql import functions as F

import check
from crawlweave.operators import corpus as C
from crawlweave.operators import limits as L
from crawlweave.operators import page_jobs as P
from crawlweave.operators import quality as Q
from crawlweave.plans import views as V
from crawlweave.plans.catalog import QUERIES, SQL
from crawlweave.plans.q_quality import doc_records
from crawlweave.plans.registry import table


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_jobs_use_no_python(spark, sf):
    for df in (P.extract_pages(table(spark, sf, "pages")), Q.process_records(doc_records(spark, sf)), C.doc_keywords(table(spark, sf, "documents"))):
        plan = physical(df)
        assert "Python" not in plan and "InPandas" not in plan


def test_processing_is_one_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("url", F.lit("https://a.com/")).withColumn("title", F.lit("t"))
    plan = physical(Q.process_records(docs.withColumnRenamed("text", "content").withColumn("links", F.array(F.lit("x")))))
    assert "Exchange" not in plan
    assert plan.count("{2,}, $1") == 1  # the cleaned text is computed once


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = physical(V.tasks(spark, sf).filter("job_id = 7").select("task_id"))
    assert "EqualTo(user_id,7)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in physical(C.keyword_ranking(table(spark, sf, "documents"), "source"))
    assert "WindowGroupLimit" in physical(L.per_minute_allowed(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "ts", "event_id", 2))


def test_no_query_makes_pairs(spark, sf):
    for name in ("list_jobs", "semantic_topk", "robots_filter", "job_report", "content_dedupe"):
        plan = physical(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = check.rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == check.rows(cols, cur.fetchall())
