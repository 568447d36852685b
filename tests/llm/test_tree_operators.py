"""Suffix dedup, prefix trie and Merkle manifest against brute force, and their defined edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from crawlweave.llm import merkle, prefix_trie, suffix_dedup


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_removed(texts, window):
    """Removed bytes per text, in order of the texts."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = True
            seen.add(w)
        out.append((b, gone))
    return out


def byte_texts():
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdé東 \n") for _ in range(n))
    passage, line = word(230), word(70)
    texts = [None, "", "x", "a" * 1000, "ab" * 400, word(400)]
    texts += [word(rnd.randrange(150)) + passage + word(rnd.randrange(150)) for _ in range(6)]
    texts += [word(90) + line + word(90) for _ in range(8)] + [passage[:110] + word(5) + passage[60:]] * 3
    near = list(word(600))
    for i in range(5):
        near[100 * i + 7 * i] = "#"
        texts.append("".join(near))
    return texts + ["z" * 99, "z" * 100, "z" * 101, word(20_000) + passage + word(300)]


@pytest.mark.parametrize("window, gram, first, cell", [(100, 48, 50, 4_000), (100, 32, 25, 1_000), (60, 16, 20, 10**7), (24, 12, 9, 3_000)])
def test_suffix_dedup_equals_brute_force(spark, window, gram, first, cell):
    texts = byte_texts()
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, cell string, bucket string").repartition(3)
    rows = suffix_dedup.remove_repeats(df, window=window, gram=gram, first=first, with_bytes=True, cell_bytes=cell).collect()
    got = {r["id"]: r for r in rows}
    assert len(rows) == len(texts)
    for i, (b, gone) in enumerate(brute_removed(texts, window)):
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, sha(kept)), i
        assert bytes(r["kept"]) == kept


def test_suffix_dedup_null_ids_repeated_rows_and_empty_tables(spark):
    rnd = random.Random(3)
    t = "".join(rnd.choice("pqrst") for _ in range(300))
    df = spark.createDataFrame([(None, t), (2, t), (2, t), (None, None), (1, "short")], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df).collect()
    assert sorted((-1 if r["id"] is None else r["id"], r["n_bytes"], r["n_removed"]) for r in rows) == [(-1, 0, 0), (-1, 300, 300), (1, 5, 0), (2, 300, 0), (2, 300, 300)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def brute_trie(talks):
    own = defaultdict(list)
    for conv, turn, role, text in talks:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, sha("%d:%s%d:%s" % (len((role or "").encode()), role or "", len((text or "").encode()), text or "")), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    total = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        total[p] = (int(not kids[p]) + sum(total[k][0] for k in kids[p]), saved + sum(total[k][1] for k in kids[p]))
        ends = ",".join(str(c) for c in members[p] if len(full[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *total[p], sha(ends)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("band", [2, 8])
def test_prefix_trie_equals_brute_force(spark, band):
    rnd = random.Random(11)
    talks = []
    for c in [*range(40), 1001, 1003]:
        for t in range(rnd.choice([0, 1, 3, 7, 12, 45])):
            talks.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", None]), rnd.choice(["yes", "no", None, "é東", f"own {c}"]) if t > 2 else "hi"))
    talks += [(7, 1, "user", "same")] * 3 + [(None, 0, "user", "nobody"), (502, 0, None, None), (None, None, None, None)]
    df = spark.createDataFrame([(*x, "n", 1) for x in talks], "conv_id long, turn long, role string, text string, node string, place int").repartition(3)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(df), band)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(talks)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(df.limit(0)), band).count() == 0


def test_long_lists_of_ending_conversations_are_cut_to_pieces(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 50 as string)) AS node", "id AS conv_id")
    want = defaultdict(list)
    for i in range(20_000):
        want["hot" if i % 3 == 0 else str(i % 50)].append(str(i))
    assert {r[0]: r[1] for r in prefix_trie.end_digests(df).collect()} == {k: sha(",".join(v)) for k, v in want.items()}


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else "%d:%s" % (len(str(v).encode()), v)
    leaf = lambda r, extra=0: sha("".join(enc(v) for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + extra, r[1])))
    trees = defaultdict(list)
    for n, r in enumerate(rows):
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), n))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {k: levels([x[2] for x in sorted(trees[k])]) for k in names}
    top = levels([built[k][-1][0] for k in names])
    out = []
    for k in names:
        for i, (_, _, own, n) in enumerate(sorted(trees[k])):
            r, way = rows[n], []
            for lv, j in ((built[k], i), (top, names.index(k))):
                for nodes in lv[:-1]:
                    way.append((j, nodes[j ^ 1] if j ^ 1 < len(nodes) else None))
                    j >>= 1
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            x = leaf(r, 1) if bad else own
            for j, s in way:
                x = sha(x if s is None else s + x if j & 1 else x + s)
            out.append((r[0], own, built[k][-1][0], top[-1][0], sha("".join(s for _, s in way if s)), x, x == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("band", [1, 3, 12])
def test_manifest_equals_brute_force(spark, band):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["text %d" % i, None, "é東", ""]), rnd.choice(["en", "en", "en", "fr", None, "", "ü"]), rnd.choice(["s", None]), rnd.choice([None, 3, 99])) for i in range(150)]
    rows += [(7, "again", "en", "s", 1)] * 3 + [(None, "x", "en", None, None), (None, None, None, None, None), (400, "alone", "xx", "s", 2**63 - 1)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree string, place int").repartition(4)
    got = merkle.document_manifest(df, band).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_manifest(rows)
    assert merkle.document_manifest(df.limit(0), band).count() == 0


def test_octopus_union_is_minimal():
    assert merkle.missing_nodes(np.arange(8), 8) == []
    assert merkle.missing_nodes(np.array([2, 3]), 8) == [(1, 0), (2, 1)]
    assert merkle.missing_nodes(np.array([0, 5]), 6) == [(0, 1), (0, 4), (1, 1)]
