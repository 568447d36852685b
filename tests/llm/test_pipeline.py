"""The pipeline against a brute-force version over the smallest table."""

import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from crawlweave.llm import byte_bpe, language_id
from tests.llm.test_operators import FOLD, brute_classes, sha

import numpy as np


def test_run_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    table = spark.read.parquet(f"{sf}/documents.parquet")
    known = language_id.learn_dictionaries(table)
    judge = language_id.Judge(known)
    letters = {r[0]: r[1] for r in table.select("doc_id", language_id.letters(table["text"])).collect()}
    live = []
    for i in sorted(docs):
        name, score = judge.judge(letters[i].encode())
        if name != "und" and score >= language_id.MARGIN:
            live.append(i)
    seen = {}
    for i in live:
        seen.setdefault(re.sub("[\x20\x09-\x0d]+", " ", docs[i] or ""), i)
    live = sorted(seen.values())
    classes = brute_classes([docs[i] for i in live], 5, 80)
    live = [i for k, i in enumerate(live) if classes[k][1] == k]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    wins = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = split(r["text"])
        wins |= {tuple(w[s : s + 13]) for s in range(max(1, len(w) - 12))} if w else set()
    assert all(len(w) == 13 for w in wins)
    clean = []
    for i in live:
        w, hit = split(docs[i]), set()
        for s in range(len(w) - 12):
            if tuple(w[s : s + 13]) in wins:
                hit |= set(range(s, s + 13))
        if not hit or 20 * len(hit) < len(w):
            clean.append(i)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(corpus_pipeline.VOCABULARY), special_tokens={})
    want = {i: (sha(np.array(own.encode_ordinary(docs[i]), "<u4").tobytes()), sha(docs[i])) for i in clean}
    got = {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
