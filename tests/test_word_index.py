"""Inverted index against a scan of the texts; what a search reads."""

import random
import re

import pytest

from crawlweave.operators import search as SR
from crawlweave.operators import word_index as WX
from crawlweave.session import fresh_path

WORDS = ["the", "cat", "sat", "on", "mat", "Über", "東京", "a"]


@pytest.fixture(scope="module")
def indexed(spark):
    rnd = random.Random(1)
    texts = {i * 37 - 20_000: " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(60))) for i in range(600)}
    texts[10**9] = "the the the the cat, the cat! THE-CAT"
    df = spark.createDataFrame([*texts.items(), (5, None), (6, "")], "doc_id long, text string")
    path = fresh_path(spark, "index")
    WX.build_index(df, path)
    return df, texts, path


def test_search_equals_scan(spark, indexed):
    df, _, path = indexed
    for words in (["the", "cat"], ["MAT"], ["the", "nowhere"], ["über", "東京", "a"]):
        want = {(r["doc_id"], r["hits"]) for r in SR.word_search(df, words).collect()}
        assert {(r["doc_id"], r["hits"]) for r in WX.search(spark, path, words).collect()} == want


@pytest.mark.parametrize("phrase", [["the", "cat"], ["the", "the"], ["the", "the", "cat"], ["sat", "on", "the", "mat"], ["cat"], ["no", "cat"]])
def test_phrases(spark, indexed, phrase):
    _, texts, path = indexed
    want = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W]+", t.lower())
        n = sum(w[k : k + len(phrase)] == phrase for k in range(len(w) - len(phrase) + 1))
        if n:
            want[i] = n
    assert {r["doc_id"]: r["hits"] for r in WX.phrase_search(spark, path, phrase).collect()} == want


def test_a_search_opens_its_buckets_only(spark, indexed):
    _, _, path = indexed
    df = WX.search(spark, path, ["mat"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(term,mat)" in plan or "In(term" in plan


def test_later_documents_are_added(spark, indexed):
    df, _, _ = indexed
    path = fresh_path(spark, "index")
    WX.build_index(df.filter("doc_id % 2 = 0"), path)
    WX.build_index(df.filter("doc_id % 2 <> 0"), path, mode="append")
    want = {(r["doc_id"], r["hits"]) for r in SR.word_search(df, ["the", "on"]).collect()}
    assert {(r["doc_id"], r["hits"]) for r in WX.search(spark, path, ["the", "on"]).collect()} == want
