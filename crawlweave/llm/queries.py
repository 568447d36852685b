"""The operators' queries over whole tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, language_id, lm_score, merkle, prefix_trie, quote_threads, sharding, substring_dedup, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


_WORDS_1 = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query("op1_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS_1} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_1} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 13 THEN [w] ELSE [w[s:s+12] for s in range(1, len(w) - 11)] END) AS win
       FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, k WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, s, n, item_id FROM (SELECT doc_id, n, s, w[s:s+n-1] AS win FROM dw) JOIN iw USING (win)),
spots AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits),
n_hit AS (SELECT doc_id, count(*) AS n FROM spots GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"), ["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op2_sharding", """
WITH RECURSIVE s AS (SELECT i, md5('shard-' || lpad(i::VARCHAR, 2, '0')) AS h FROM range(16) t(i)),
pref AS (SELECT i, ('0x' || substr(h, 1, 12))::BIGINT % 2039 AS off, ('0x' || substr(h, 13, 12))::BIGINT % 2038 + 1 AS skip FROM s),
fill AS (
  SELECT 0 AS i, repeat('.', 2039) AS free, [0 for x in range(16)] AS nexts, NULL::BIGINT AS slot, NULL::INT AS shard, 0 AS claimed
  UNION ALL
  SELECT CASE WHEN ok THEN (i + 1) % 16 ELSE i END,
         CASE WHEN ok THEN substr(free, 1, spot) || '#' || substr(free, spot + 2) ELSE free END,
         nexts[1:i] || [nexts[i + 1] + 1] || nexts[i + 2:16], CASE WHEN ok THEN spot END, i, claimed + ok::INT
  FROM (SELECT f.*, (off + nexts[f.i + 1] * skip) % 2039 AS spot, substr(free, (off + nexts[f.i + 1] * skip) % 2039 + 1, 1) = '.' AS ok
        FROM fill f JOIN pref ON pref.i = f.i WHERE claimed < 2039)),
tab AS (SELECT slot, shard FROM fill WHERE slot IS NOT NULL)
SELECT doc_id, tab.slot::INT AS slot, shard, 'shard-' || lpad(shard::VARCHAR, 2, '0') AS shard_name
FROM documents JOIN tab ON tab.slot = ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 2039
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.place(read(spark, folder, "documents"))
    return placed.select("row.doc_id", "slot", "shard", "shard_name")


@query("op6_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, folder, "documents"), carry=["doc_id"])


VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op7_byte_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    coded = byte_bpe.encode_texts(read(spark, folder, "documents"), VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False)
    return coded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    held_out = language_id.in_fold("doc_id", 3, 1)
    known = language_id.learn_dictionaries(docs.filter(~held_out))
    found = language_id.identify(docs, known, keep=["doc_id"])
    return found.select(
        "row.doc_id", language_id.in_fold("row.doc_id", 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected"
    )


@query("op9_ngram_jaccard_join", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS x FROM t),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
           FROM n a JOIN n b ON a.x = b.x AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),
reach AS (WITH RECURSIVE r(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, links.b FROM r JOIN links ON links.a = r.other)
          SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT t.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM t JOIN reach ON reach.id = t.doc_id
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.classes(read(spark, folder, "documents"), size=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("class_id").alias("component_id"))


@query("op4_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
left_over AS (SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS t
              FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) k WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = k.doc_id AND p = i)
              GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN left_over USING (doc_id)
""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op8_lm_scoring")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    scored = lm_score.score_texts(docs, docs.filter(~language_id.in_fold("doc_id", 7, 2)))
    return scored.select(
        F.col("id").alias("doc_id"), language_id.in_fold("id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    labels = read(spark, folder, "labels").filter(~language_id.in_fold("doc_id", 5, 0))
    scored = toxicity.score_texts(read(spark, folder, "documents"), labels)
    return scored.select(
        F.col("id").alias("doc_id"), language_id.in_fold("id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def quoting_messages(talks: DataFrame) -> DataFrame:
    """Each turn as a mail: an attribution, the turn before it quoted once with its attribution, the one before that twice, then its own text."""
    said = talks.groupBy("conv_id", "turn").agg(F.min("text").alias("said"), F.min("role").alias("by"))
    before = lambda k: said.select(F.col("conv_id").alias(f"c{k}"), (F.col("turn") + k).alias(f"t{k}"), F.col("said").alias(f"said{k}"), F.col("by").alias(f"by{k}"))
    marked = lambda k: F.concat(F.lit(">" * k + " "), F.replace(F.col(f"said{k}"), F.lit("\n"), F.lit("\n" + ">" * k + " ")))
    rows = talks
    for k in (1, 2):
        rows = rows.join(before(k), (F.col("conv_id") == F.col(f"c{k}")) & (F.col("turn") == F.col(f"t{k}")), "left")
    text = F.concat_ws("\n", F.concat("by1", F.lit(" wrote:")), F.concat(F.lit("> "), "by2", F.lit(" wrote:")), marked(2), marked(1), F.lit(""), F.col("text"))
    return rows.select("conv_id", "turn", "role", text.alias("text"))


@query("op5_chat_formatting", r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS said FROM conversations),
q AS (SELECT a.conv_id, a.turn, coalesce(nullif(b.said, ''), NULL) AS q1, nullif(d.said, '') AS q2
      FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 LEFT JOIN c d ON d.conv_id = a.conv_id AND d.turn = a.turn - 2),
p AS (SELECT q.conv_id, q.turn, coalesce((SELECT min(turn) FROM c WHERE c.conv_id = q.conv_id AND said = q1 AND c.turn < q.turn),
                                         (SELECT min(turn) FROM c WHERE c.conv_id = q.conv_id AND said = q2 AND c.turn < q.turn)) AS parent FROM q),
d AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM p WHERE parent IS NULL
      UNION ALL SELECT p.conv_id, p.turn, d.root, d.depth + 1 FROM p JOIN d ON d.conv_id = p.conv_id AND d.turn = p.parent)
SELECT c.conv_id, c.turn, role, text AS content, p.parent, d.root, d.depth::BIGINT AS depth
FROM c JOIN p USING (conv_id, turn) JOIN d USING (conv_id, turn)
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = quote_threads.rebuild(quoting_messages(read(spark, folder, "conversations")))
    return found.select("row.conv_id", "row.turn", "row.role", F.col("own").alias("content"), "parent", "root", "depth")


def _crc(x: str) -> str:
    """Unsigned CRC-32 of the decimal form of an integer expression in DuckDB."""
    eight = "[0::BIGINT, 0, 0, 0, 0, 0, 0, 0]"
    folded = f"list_reduce([xor(c, b)] || {eight}, lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    letters = f"[ord(y)::BIGINT for y in string_split(({x})::VARCHAR, '')]"
    return f"xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || {letters}, lambda c, b: {folded}))"


def _field(x: str) -> str:
    return f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


_NEXT = "[sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')) for i in range((len(l) + 1) // 2)]"


@query("op13_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
  CASE WHEN {_crc('doc_id')} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS claimed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d),
tree AS (SELECT lang, 0 AS h, list(leaf ORDER BY k) AS l FROM p GROUP BY lang
         UNION ALL SELECT lang, h + 1, {_NEXT} FROM tree WHERE len(l) > 1),
subs AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM tree WHERE len(l) = 1),
top AS (SELECT 0 AS h, list(subroot ORDER BY j) AS l FROM subs UNION ALL SELECT h + 1, {_NEXT} FROM top WHERE len(l) > 1),
way AS (SELECT doc_id, leaf, claimed, p.lang, h, k >> h AS i, l FROM p JOIN tree ON tree.lang IS NOT DISTINCT FROM p.lang WHERE len(l) > 1
        UNION ALL SELECT doc_id, leaf, claimed, p.lang, 1000 + h, j >> h, l FROM p JOIN subs ON subs.lang IS NOT DISTINCT FROM p.lang, top WHERE len(l) > 1),
sib AS (SELECT *, l[xor(i, 1) + 1] AS s, CASE WHEN l[xor(i, 1) + 1] IS NULL THEN 'N' WHEN i % 2 = 1 THEN 'L' || s ELSE 'R' || s END AS e FROM way),
each AS (SELECT doc_id, leaf, claimed, lang, coalesce(string_agg(s, '' ORDER BY h), '') AS proof, list(e ORDER BY h) AS es FROM sib GROUP BY ALL),
folded AS (SELECT *, list_reduce([claimed] || es, lambda x, e: sha256(CASE e[1] WHEN 'N' THEN x WHEN 'L' THEN e[2:] || x ELSE x || e[2:] END)) AS folded_root FROM each)
SELECT doc_id, leaf, subroot, (SELECT l[1] FROM top WHERE len(l) = 1) AS root, sha256(proof) AS proof_sha256, folded_root,
       folded_root = (SELECT l[1] FROM top WHERE len(l) = 1) AS verified
FROM folded JOIN subs ON subs.lang IS NOT DISTINCT FROM folded.lang
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.document_manifest(read(spark, folder, "documents"))


_TURNS = "sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || strlen(coalesce(text, '')) || ':' || coalesce(text, ''))"


@query("op12_prefix_trie", f"""
WITH t AS (SELECT conv_id, strlen(coalesce(text, '')) AS b, {_TURNS} AS said, turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'s': said, 'b': b}} ORDER BY turn NULLS FIRST, said) AS l FROM t GROUP BY conv_id),
h AS (SELECT *, {_crc('conv_id')} % 9 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(base.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN c AS base ON base.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(l) AS n, [x.s for x in l[1:d]] AS path, coalesce(l[d].b, 0) AS b FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
                sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY path, d),
kid AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
own AS (SELECT node.*, coalesce(kid.n, 0) AS n_children, (n_convs - 1) * b AS saved FROM node LEFT JOIN kid ON kid.d = node.d AND kid.path = node.path),
up AS (SELECT path[1:k] AS path, k AS d, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
       FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM own) GROUP BY ALL)
SELECT own.conv_id, own.d AS depth, mother.conv_id AS parent_conv_id, own.n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, own.ends_sha256
FROM own JOIN up ON up.d = own.d AND up.path = own.path LEFT JOIN node AS mother ON own.d > 0 AND mother.d = own.d - 1 AND mother.path = own.path[1:own.d - 1]
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(read(spark, folder, "conversations")))


@query("op11_suffix_array_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
cut AS (SELECT doc_id, c, substr(h, 400 * c + 1, 598) AS t FROM (SELECT doc_id, h, unnest(range(0, len(h) // 400 + 1)) AS c FROM d)),
win AS (SELECT doc_id, 200 * c + o AS s, md5_number(substr(t, 2 * o + 1, 200)) AS x
        FROM (SELECT *, unnest(range(0, least(200, len(t) // 2 - 99))) AS o FROM cut WHERE len(t) >= 200)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 100)) AS p FROM later),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE p <> before + 1 OR before IS NULL) AS spans
      FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
b AS (SELECT doc_id, 200 * c + o AS p, substr(t, 2 * o + 1, 2) AS x FROM (SELECT *, unnest(range(0, least(200, len(t) // 2))) AS o FROM cut)),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY p) AS k FROM b ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
