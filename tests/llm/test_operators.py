"""Operators of the training-data part against brute force, and their defined edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlweave.llm import (
    byte_bpe, decontaminate, exact_dedup, jaccard_join, language_id, lm_score, quote_threads, sharding, substring_dedup, toxicity,
)
from crawlweave.llm.queries import VOCABULARY
from crawlweave.llm.words import split_words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, _row string, kept string, `a.b` int"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def made_texts():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ÑU", "x y", "東京"]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    base, passage = words(120), words(45)
    texts = [" ".join(base)] * 4 + [None, None, "", " \n", "one", "One", "a b", "\tA  B\n"]
    for _ in range(12):
        near = list(base)
        near[rnd.randrange(120)] = "changed"
        texts.append(" ".join(near))
    for _ in range(10):
        texts.append("  ".join(words(30) + passage + words(rnd.randrange(60))))
    texts.append(" ".join(["the"] * 500))
    texts.append("long " * 3 + "y" * 300_000 + " " + " ".join(passage))
    return texts


@pytest.fixture(scope="module")
def texts():
    return made_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "src0", "x", "y", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words_of(t, fold=False):
    t = t or ""
    return re.findall("[^\x20\x09-\x0d]+", t.translate(FOLD) if fold else t)


def test_exact_groups(docs, texts, none):
    normal = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, ["doc_id"]).collect()}
    for i, n in enumerate(normal):
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (normal.index(n), normal.count(n), sha(n))
        assert r["kept"] == (normal.index(n) == i)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(normal))
    assert exact_dedup.drop_exact_copies(none).count() == 0


def test_exact_groups_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    rows = exact_dedup.exact_groups(df).collect()
    assert sorted((r["text"] or "", r["kept"], r["group_size"]) for r in rows) == [
        ("", True, 1), ("a", False, 3), ("a", False, 3), ("a", True, 3), ("b", True, 1)
    ]


def test_hot_group_is_salted_with_the_same_result(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = exact_dedup.exact_groups(df, ["doc_id", "text"]).filter("text = 'hot text'").agg(F.sum(F.col("kept").cast("int")), F.min("keep_id"), F.max("keep_id"), F.min("group_size")).first()
    assert tuple(rows) == (1, 0, 0, 1000)


def test_decontamination(spark, docs, texts, none):
    item = " ".join(words_of(texts[-1])[-20:])
    bench = spark.createDataFrame([(7, item), (12, "One"), (None, item.upper()), (3, None), (4, "-- !")], "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    wins = {}
    for i, t in ((7, item), (12, "One"), (None, item.upper())):
        w = split(t)
        for s in range(max(1, len(w) - 12)):
            wins.setdefault(tuple(w[s : s + 13]), set()).add(i)
    got = {r["row"]["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    for i, t in enumerate(texts):
        w, hit, items = split(t), set(), set()
        for win, ids in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    items |= {str(x) for x in ids if x is not None}
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(items)), i
        assert r["contaminated"] == (bool(hit) and 20 * len(hit) >= len(w))
    assert decontaminate.remove_contaminated(docs, bench).columns == docs.columns
    spans = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert spans[8] == "" and spans[0] == texts[0] and spans[4] is None
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0


def test_sharding_table(spark, docs):
    table = sharding.fill_table(("a", "b", "c"), 31)
    assert sorted(set(table)) == [0, 1, 2] and max(map(table.count, (0, 1, 2))) - min(map(table.count, (0, 1, 2))) <= 1
    order = {i: [(o + j * k) % 31 for j in range(31)] for i, s in enumerate("abc") for o, k in [sharding.preference(s, 31)]}
    taken = {}
    turn = 0
    while len(taken) < 31:
        taken[next(x for x in order[turn % 3] if x not in taken)] = turn % 3
        turn += 1
    assert [taken[i] for i in range(31)] == table
    fewer = sharding.fill_table(("a", "b"), 31)
    assert sum(a != b for a, b in zip(table, fewer) if a != 2) <= 8  # rows of shards that stay hardly move
    with pytest.raises(ValueError):
        sharding.fill_table(("a",), 30)
    nulls = spark.createDataFrame([(None, "x"), (None, "y")], "doc_id long, slot string")
    assert sharding.place(nulls).select("slot").distinct().count() == 1
    assert sharding.place(docs).count() == docs.count()


def test_substring_dedup(docs, texts, none):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w, gone = words_of(t), set()
        for s in range(len(w) - 19):
            x = tuple(w[s : s + 20])
            if x in seen:
                gone |= set(range(s, s + 20))
            seen.add(x)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), sha(kept), kept)
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs, with_text=True).collect()}
    assert got == want
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_null_ids_come_last(spark):
    t = " ".join(f"q{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (5, t), (5, t)], "doc_id long, text string")
    assert sorted((r["id"] or 0, r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect()) == [(0, 30), (5, 0), (5, 30)]


def brute_classes(texts, size, percent):
    sets = []
    for t in texts:
        w = words_of(t, fold=True)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_classes(docs, texts, none, size, percent):
    got = {r["id"]: (r["n"], r["class_id"]) for r in jaccard_join.classes(docs, size, percent).collect()}
    want = brute_classes(texts, size, percent)
    assert got == want
    kept = jaccard_join.keep_one(docs, size, percent)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}
    assert jaccard_join.classes(none, size, percent).count() == 0


def test_jaccard_classes_at_crowded_tokens(spark, monkeypatch):
    """Tokens shared by more groups than the first turn pairs: copies of one text that differ in one, two or three words."""
    monkeypatch.setattr(jaccard_join, "NEIGHBOURS", 1)
    base = [f"w{i}" for i in range(90)]
    texts = [" ".join(f"x{k}" if i in {(7 * k + 29 * e) % 90 for e in range(1 + k % 3)} else w for i, w in enumerate(base)) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["n"], r["class_id"]) for r in jaccard_join.classes(df, 3, 90).collect()}
    assert got == brute_classes(texts, 3, 90)


def test_connected_chain(spark):
    edges = spark.range(60).select(F.format_string("%03d", "id").cast("binary").alias("a"), F.format_string("%03d", F.col("id") + 1).cast("binary").alias("b"))
    assert {bytes(r["label"]) for r in jaccard_join.connected(edges).collect()} == {b"000"}


def test_bpe_matches_the_library_and_round_trips(docs, texts, none):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode_texts(docs, VOCABULARY, public_tokenizers.PATTERN)
    for r in coded.collect():
        text = texts[r["row"]["doc_id"]] or ""
        ids = own.encode_ordinary(text) if len(text) < 100_000 else list(np.frombuffer(r["token_ids"], "<u4"))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text))
    back = byte_bpe.decode_ids(coded.select("row.doc_id", "token_ids"), VOCABULARY)
    assert all(r["text"] == (texts[r["row"]["doc_id"]] or "") for r in back.collect())
    assert byte_bpe.encode_texts(none, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    values = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5_000).astype(np.uint64))
    assert sorted(byte_bpe.PerfectHash(values).find(values).tolist()) == list(range(len(values)))


def test_lm_scores(docs, texts, none):
    import collections

    train = docs.filter("doc_id % 5 <> 0")
    counts = collections.Counter()
    for i, t in enumerate(texts):
        if i % 5:
            counts.update(words_of(t, True) + [None])
    n, v = sum(counts.values()), len(counts)
    for common in (1_000_000, 20):
        lm_score.COMMON = common
        for r in lm_score.score_texts(docs, train).collect():
            w = words_of(texts[r["id"]], True) + [None]
            base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    lm_score.COMMON = 1_000_000
    assert lm_score.score_texts(none, train).count() == 0
    assert lm_score.score_texts(docs, none).filter("n_known > 0").count() == 0


@pytest.mark.parametrize("part_bytes", [16 << 20, 300])
def test_lm_scores_follow_the_formula(docs, texts, monkeypatch, part_bytes):
    """Scores are those of the exact counts read to their level, n-grams seen once too, whether the filter has one broadcast or many."""
    import collections

    monkeypatch.setattr(lm_score, "PART_BYTES", part_bytes)
    one, two = collections.Counter(), collections.Counter()
    split = lambda t: ["start", *(f"w {x}" for x in words_of(t, True)), "end"]
    for t in texts:
        w = split(t)
        one.update(w[1:])
        two.update(zip(w, w[1:]))
    total = sum(one.values()) + len(one) + 1
    level = lambda c: int(lm_score.levels(np.array([c]))[0])
    low, high = lambda c: int(lm_score.LOW[level(c)]), lambda c: int(lm_score.HIGH[level(c)])
    false = len(one) / 2**8
    spare, off = 1 + false + 3 * false**0.5, []
    for r in lm_score.score_texts(docs, docs).collect():
        w, want = split(texts[r["id"]]), 0.0
        for v, x in zip(w, w[1:]):
            c = len(texts) if v == "start" else high(one[v])
            least = min(low(two[v, x]), low(one[x]), c if v == "start" else low(one[v]))
            want += math.log10((1 - lm_score.MIX) * (low(one[x]) + 1) / total + lm_score.MIX * least / (c + spare))
        off.append((r["score"] - want) / abs(want))
    assert sum(map(abs, off)) / len(off) < 0.005  # few levels are read too high
    assert sorted(map(abs, off))[len(off) // 4] < 1e-9


def test_lm_probabilities_of_a_context_add_up_to_one_at_most(spark, texts):
    """A context seen 15 times with 15 followers, one seen once, one never seen, and the start; over all words and an unknown one."""
    rows = [(i, f"often x{i}") for i in range(15)] + [(20, "once only"), (21, "x1 x1 x1 x1")] + [(100 + i, t) for i, t in enumerate(texts[:36])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    grams = lm_score.share_filter(lm_score.gather_counts(df, 16, 8), 16, 8)
    t = lm_score.tokens_of(pa.array([x or "" for _, x in rows]))
    words = np.append(np.unique(t.hashes), np.uint64(12345))
    total, distinct = len(t.hashes), len(words) - 1
    own = grams.levels(words)
    assert (own[:-1] > 0).all()
    for k, v in enumerate([*words.tolist(), int(lm_score.START)]):
        at = np.full(len(words) * 2, v, np.uint64)
        at[1::2] = words
        pairs = lm_score.Tokens(at, np.array([0, len(at)])).pairs()[1::2]
        q = own[k] if k < len(own) else None
        before, high = (len(rows), len(rows)) if q is None else (lm_score.LOW[q], lm_score.HIGH[q])
        p = lm_score.smoothed(lm_score.LOW[own], lm_score.LOW[grams.levels(pairs)], np.full(len(words), before), np.full(len(words), high), total + distinct + 1, lm_score.spare_mass(distinct, 8))
        assert 0.5 < p.sum() <= 1, k


def test_language_of_held_out_texts(spark, sf, none):
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.in_fold("doc_id", 3, 1)
    known = language_id.learn_dictionaries(all_docs.filter(~out))
    assert set(known) == {"de", "en", "es", "fr"} and all(len(x) <= language_id.DICT_BYTES for x in known.values())
    right = language_id.identify(all_docs.filter(out), known).select((F.col("row.lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?")], "doc_id long, text string")
    assert {(r["lang_pred"], r["rejected"]) for r in language_id.identify(odd, known).collect()} == {("und", True)}
    assert {r["lang_pred"] for r in language_id.identify(odd.union(spark.createDataFrame([(4, "words")], odd.schema)), {}).collect()} == {"und"}
    assert language_id.keep_identified(none).count() == 0
    assert {r[0]: r[1] for r in all_docs.select("doc_id", out).collect()} == {r[0]: zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in all_docs.select("doc_id").collect()}


def test_a_rare_language_leaves_the_others_their_dictionaries(spark):
    """One short row, or one whose middle has no letter, under a label of its own."""
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    plain = language_id.learn_dictionaries(all_docs)
    out = language_id.in_fold("doc_id", 3, 1)
    for text in ("bonjour le monde", "ein Wort " + "1 " * 3_000 + " noch eins", "x"):
        mixed = all_docs.union(spark.createDataFrame([(10**9, text, "xx")], "doc_id long, text string, lang string"))
        known = language_id.learn_dictionaries(mixed)
        assert {k: v for k, v in known.items() if k != "xx"} == dict(plain) and 0 < len(known["xx"]) <= len(text)
        held = language_id.identify(all_docs.filter(out), language_id.learn_dictionaries(mixed.filter(~out | (F.col("lang") == "xx"))))
        right, lost = held.agg(F.avg((F.col("row.lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
        assert right > 0.95 and lost < 0.05


def test_toxicity_on_held_out_labels(spark, none):
    folder = "/root/testdata/sf0.01"
    all_docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = language_id.in_fold("doc_id", 5, 0)
    scored = toxicity.score_texts(all_docs, labels.filter(~out))
    assert scored.filter("score is null or score < 0 or score > 1").count() == 0 and scored.count() == all_docs.count()
    judged = scored.join(labels.filter(out), F.col("id") == F.col("doc_id"))
    right = judged.select(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.95
    assert {r["score"] for r in toxicity.score_texts(all_docs, labels.limit(0)).select("score").distinct().collect()} == {0.0}


def test_quotes(spark):
    rows = [
        ("t", 1, "Hello there\nfriend"), ("t", 2, "anna wrote:\n> Hello  there\n> FRIEND\nI agree"), ("t", 3, "> I agree\n>> hello there\n> > friend\n\nfine"),
        ("t", 4, ">> I agree\n> a lost mail\nok"), ("u", 1, "> Hello there friend\nother thread"), ("t", 5, None), ("t", 6, ">" * 5000 + "x\nend"),
    ]
    df = spark.createDataFrame(rows, "conv_id string, turn int, text string").withColumn("own", F.lit(1))
    got = {(r["row"]["conv_id"], r["row"]["turn"]): (r["own"], r["parent"], r["root"], r["depth"]) for r in quote_threads.rebuild(df).collect()}
    assert got == {
        ("t", 1): ("Hello there\nfriend", None, 1, 0), ("t", 2): ("I agree", 1, 1, 1), ("t", 3): ("fine", 2, 1, 2), ("t", 4): ("ok", 2, 1, 2),
        ("u", 1): ("other thread", None, 1, 0), ("t", 5): ("", None, 5, 0), ("t", 6): ("end", None, 6, 0),
    }
    assert quote_threads.rebuild(df.limit(0)).count() == 0


def test_quotes_in_part_inline_and_nested(spark):
    rows = [
        ("t", 1, "Alpha one. Alpha two goes\non here. Alpha three.\n\nSecond part\nof the mail"), ("t", 2, "anna wrote:\n> Alpha two goes on\n> here.\nyes"),
        ("t", 3, "bob wrote:\n> anna wrote:\n>> Alpha two goes on\n>> here.\n> yes\nnested"), ("t", 4, "> Second part\n> of the mail\ninline one\n> nested\ninline two"),
        ("t", 5, "> Second part of the mail\ntrimmed"), ("t", 6, "> Alpha one.\n> [...]\n> Alpha three.\ngap"), ("t", 7, "> Alpha one. Alpha nine.\nfalse"), ("t", 8, "> pha three.\nfalse"),
    ]
    df = spark.createDataFrame(rows, "conv_id string, turn int, text string")
    got = {r["row"]["turn"]: (r["parent"], r["depth"]) for r in quote_threads.rebuild(df).collect()}
    assert got == {1: (None, 0), 2: (1, 1), 3: (2, 2), 4: (3, 3), 5: (1, 1), 6: (1, 1), 7: (None, 0), 8: (None, 0)}


def test_words_of_arrow_columns(texts):
    import pyarrow as pa

    column = pa.array(["skip me", *texts]).slice(1)
    w = split_words(column)
    for i, t in enumerate(texts):
        assert w.joined(i).decode() == " ".join(words_of(t))


def test_native_operators_plan_no_python(spark, docs, none):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    talks = spark.createDataFrame([("t", 1, "x")], "conv_id string, turn int, text string")
    for df in (exact_dedup.exact_groups(docs), decontaminate.contamination(docs, bench), sharding.place(docs), quote_threads.rebuild(talks)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def lookalikes(size):
    """Two words of a and b whose polynomial sums modulo 2**64 agree whatever the letters stand for."""
    return tuple("".join("ab"[(bin(i).count("1") + f) % 2] for i in range(size)) for f in (0, 1))


@pytest.mark.parametrize("size", [1024, 4096])
def test_lookalike_words_are_told_apart(spark, size):
    one, other = lookalikes(size)
    assert len(set(split_words(pa.array([f"{one} {other}"])).hashes().tolist())) == 2
    common = [f"w{i}" for i in range(30)]
    rows = [(0, " ".join([*common, one, "x0"])), (1, " ".join([*common, other, "x1"]))]
    gone = {r["id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == {0: 0, 1: 30}
    pair = spark.createDataFrame([(0, f"{one} {one} {one}"), (1, f"{other} {other} {other}")], "doc_id long, text string")
    assert {r["class_id"] for r in jaccard_join.classes(pair, 3, 90).collect()} == {0, 1}
    known = lm_score.score_texts(pair, pair.filter("doc_id = 0"))
    assert {r["id"]: r["n_known"] for r in known.collect()} == {0: 4, 1: 1}
