"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Learning takes a bounded sample of labelled rows, about ``SAMPLE_ROWS`` chosen by hashed id; only it is joined with
texts, so texts are never shuffled. The lexicon is learned from it: word beginnings of 4 to 6 letters whose documents
are mostly toxic. Features are DataFrame expressions over whole texts: lexicon density and variety, lexicon words near
a word of the second person, capitals, punctuation and obfuscated words. A fifth of the sample is kept from the
trees and calibrates their output.

Defined cases: null and empty texts have zero features and get a score like any other text. Labels without an id or
value are left out; of several labels of an id the largest counts. Without labels of both kinds, all scores are the
share of toxic labels, or 0. Repeated rows get equal scores. Only the id is carried besides the score.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.session import materialize

SAMPLE_ROWS = 12_000
STEM_SIZES = (4, 5, 6)
LEXICON_SIZE = 400
LEAST_DOCUMENTS = 6
TOXIC_SHARE = 0.8
NEAR = 5
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes",
    "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros",
)
FEATURES = [
    "lexicon_density", "lexicon_count", "lexicon_kinds", "second_person_near", "capitals", "punctuation", "exclaims", "obfuscated", "words_log", "word_length",
]


def word_list(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ", -1)


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Stems from (text, toxic) rows; a stem that begins with a shorter one is left out."""
    words = sample.select("toxic", F.explode(F.array_distinct(word_list(F.coalesce("text", F.lit(""))))).alias("w")).filter(F.length("w") >= min(STEM_SIZES))
    stems = words.select("toxic", F.explode(F.array_distinct(F.array(*[F.substring("w", 1, n) for n in STEM_SIZES]))).alias("stem"))
    counts = stems.groupBy("stem").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    # a stem is seen once for each word that has it, so several words of a text strengthen it
    good = counts.filter((F.col("bad") >= LEAST_DOCUMENTS) & (F.col("bad") >= TOXIC_SHARE * F.col("n")))
    chosen: set[str] = set()
    for row in good.orderBy(F.desc("bad"), "stem").limit(20 * LEXICON_SIZE).collect():
        if len(chosen) < LEXICON_SIZE and not any(row["stem"][:n] in chosen for n in STEM_SIZES):
            chosen = {s for s in chosen if not s.startswith(row["stem"])} | {row["stem"]}
    return sorted(chosen)


def features(docs: DataFrame, lexicon: list[str], text: str = "text") -> DataFrame:
    """Input columns (as ``row``) with ``FEATURES`` columns."""
    by_size = {n: [s for s in lexicon if len(s) == n] for n in STEM_SIZES}

    def listed(w: Column) -> Column:
        found = F.lit(False)
        for n, stems in by_size.items():
            if stems:
                found = found | F.substring(w, 1, n).isin(stems)
        return found

    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), value.alias("_t"), word_list(value).alias("_w"))
    # each of these columns is used more than once below, so that Spark makes it once
    rows = rows.withColumn("_hits", F.filter(F.transform("_w", lambda w, i: F.when(listed(w), i)), lambda i: i.isNotNull()))
    size = F.greatest(F.size("_w"), F.lit(1)).cast("double")
    hits = F.size("_hits").cast("double")
    chars = F.greatest(F.length("_t"), F.lit(1)).cast("double")
    near = F.filter(
        "_hits", lambda i: F.exists(F.slice("_w", F.greatest(i + 1 - NEAR, F.lit(1)), F.lit(2 * NEAR + 1)), lambda w: w.isin(list(SECOND_PERSON)))
    )
    kinds = F.array_distinct(F.transform("_hits", lambda i: F.get("_w", i)))
    without = lambda pattern: F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))
    letters = F.aggregate("_w", F.lit(0), lambda total, w: total + F.length(w))
    return rows.select(
        "row",
        (hits / size).alias("lexicon_density"),
        F.log1p(hits).alias("lexicon_count"),
        F.size(kinds).cast("double").alias("lexicon_kinds"),
        (F.size(near) / size).alias("second_person_near"),
        (without(r"\p{Lu}+") / chars).alias("capitals"),
        (without(r"\p{P}+") / chars).alias("punctuation"),
        ((F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))) / chars).alias("exclaims"),
        (without(r"(?<=\p{L})[0-9@$*#]+(?=\p{L})") / size).alias("obfuscated"),
        F.log1p(size).alias("words_log"),
        (letters / size).alias("word_length"),
    )


def score_texts(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``id`` and ``score`` (0 to 1) of every row of ``docs``, learned from the given labels."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1))
    n = known.count()
    share = min(1.0, SAMPLE_ROWS / n) if n else 0.0
    picked = known.filter(F.pmod(F.xxhash64("_key"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), F.col("_id") == F.col("_key"))
    sample = materialize(sample.select("_id", "text", "toxic"), "toxicity-sample")
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    if len(seen) < 2:
        return plain.select("id", F.lit(1.0 if seen.get(1) else 0.0).alias("score"))

    calibrating = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(5)) == 0
    lexicon = learn_lexicon(sample.filter(~calibrating))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    dense = materialize(features(sample, lexicon).select("row.*", *FEATURES).drop("text"), "toxicity-features")
    dense = assembler.transform(dense)
    train, check = dense.filter(~calibrating), dense.filter(calibrating)
    if train.select("toxic").distinct().count() < 2 or check.select("toxic").distinct().count() < 2:
        train = check = dense
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, seed=42).fit(train)
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="score").fit(raw(check).select("raw", F.col("toxic").cast("double").alias("toxic")))
    scored = calibration.transform(raw(assembler.transform(features(plain, lexicon).select("row.id", *FEATURES))))
    return scored.select("id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
