"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (archive, chat, hashing, language, lines, mixing, neardup, packing, quality, repeats, spelling, topk,
                           whitening)

KEEP_FROM = 0.3  # score from which a document counts as good
Run = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.digest_archive(archive.read_archive(archive.write_archive(table(spark, sf_dir, "pages"))))


def op3_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = quality.scorer(spark, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score")).select(
        "*", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def op4_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = mixing.free_prefix(docs)
    done = mixing.mix(docs, prefix=own)
    return done.select("doc_id", *(F.col(f"{own}{c}").alias(c) for c in ("source", "lang", "topic", "tokens")),
                       F.round(f"{own}probability", 6).alias("probability"), F.col(f"{own}kept").alias("kept"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_itq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), "turn", "role", "text")
    extra = spark.range(1).select(F.expr("""
        inline(array(struct(-7L AS conv_id, 0 AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text),
                     struct(-7L AS conv_id, 1 AS turn, 'assistant' AS role, '</s>[INST] ok [/INST]' AS text)))"""))
    return chat.digest_conversations(chat.format_conversations(rows.unionByName(extra)))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_lines(table(spark, sf_dir, "documents"))
    left = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return done.select("doc_id", F.size(left).cast("long").alias("lines_left"), F.sha2("text", 256).alias("text_sha256"))


def op9_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predictor(spark, language.fit(docs))
    return docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), found(F.col("text")).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.corpus_words(table(spark, sf_dir, "documents"), one_in=199))


def op13_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Run] = {f.__name__: f for f in (op1_bm25_packing, op2_warc_archive, op3_nbsvm_quality, op4_raked_mixture, op5_exact_topk,
                                                  op6_itq_neardup, op7_chat_format, op8_line_dedup, op9_maximal_repeats,
                                                  op10_minhash_neardup, op11_string_kernel_language, op12_spelling_variants,
                                                  op13_jacobi_davidson_whitening)}

ORACLES: dict[str, str] = {
    "op2_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k""",
    "op5_exact_topk": """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_itq_neardup": """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
         AND len([1 FOR x IN embedding IF x <> 0]) > 0 AS fit FROM embeddings),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.fit AND b.fit AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT m.id AS vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, m.id = m.c AS kept FROM m LEFT JOIN n ON n.a = m.id""",
    "op7_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\|(?:turn|text|more|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g')) AS n,
             coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS opens FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN opens THEN 24 + length(role) ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op4_raked_mixture": mixing.mix_sql(),
    "op8_line_dedup": r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, u.i, u.l, regexp_extract_all(u.l, '[^\x20\x09-\x0D]+') AS w FROM (
    SELECT doc_id, unnest([{'i': k, 'l': s[k]} FOR k IN range(1, len(s) + 1)]) AS u
    FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
d AS MATERIALIZED (SELECT w, len(w) AS n, min({'d': doc_id, 'i': i}) AS p FROM l WHERE len(w) > 0 GROUP BY w),
h AS (
  SELECT w, n, p, unnest([{'m': n, 's': 0, 'k': w[:n // 2]}, {'m': n, 's': 1, 'k': w[n // 2 + 1:]}]) AS k FROM d WHERE n >= 8
  UNION ALL
  SELECT w, n, p, unnest([{'m': n - 1, 's': 0, 'k': w[:(n - 1) // 2]}, {'m': n - 1, 's': 1, 'k': w[(n - 1) // 2 + 2:]}])
  FROM d WHERE n >= 9),
c AS MATERIALIZED (
  SELECT DISTINCT a.w AS a, b.w AS b, a.n AS m, b.n AS n FROM h a JOIN h b ON a.k = b.k AND a.p > b.p AND abs(a.n - b.n) <= 1),
q AS (SELECT *, coalesce(list_position([a[i] = b[i] FOR i IN range(1, least(m, n) + 1)], false), least(m, n) + 1) AS q FROM c),
near AS (SELECT DISTINCT a AS w FROM q WHERE CASE WHEN m = n THEN a[q + 1:] = b[q + 1:] WHEN m > n THEN a[q + 1:] = b[q:] ELSE a[q:] = b[q + 1:] END),
j AS (
  SELECT l.*, len(l.w) > 0 AND (near.w IS NOT NULL OR d.p.d <> l.doc_id
                                OR row_number() OVER (PARTITION BY l.doc_id, l.w ORDER BY l.i) > 1) AS bad
  FROM l LEFT JOIN d ON d.w = l.w LEFT JOIN near ON near.w = l.w)
SELECT doc_id, count(*) FILTER (NOT bad AND len(w) > 0) AS lines_left, sha256(string_agg(l, chr(10) ORDER BY i) FILTER (NOT bad)) AS text_sha256
FROM j GROUP BY doc_id HAVING count(*) FILTER (bad) = 0 OR count(*) FILTER (NOT bad AND len(w) > 0) > 0""",
    "op10_minhash_neardup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (
  SELECT doc_id AS id, doc_id AS c FROM s
  UNION SELECT k.y, r.c FROM r JOIN (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l) k ON k.x = r.id WHERE r.c < k.y),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN m ON m.id = s.doc_id""",
    "op12_spelling_variants": r"""
WITH RECURSIVE
tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
    FROM range(256) t(i))),
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
         unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
u AS MATERIALIZED (
  SELECT d, w, count(*) AS n FROM (
    SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM r WHERE length(run) >= 6)
  GROUP BY d, w),
b AS (
  SELECT w, n, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END
                        FOR c IN string_split(d || ':' || w, '')]) AS b FROM u),
h AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab.tab[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM b, tab),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS MATERIALIZED (SELECT word, i, left(word, i - 1) AS a, substr(word, i + 1) AS z
                   FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS MATERIALIZED (
  SELECT DISTINCT v.word AS a, w.word AS b FROM x v JOIN w ON w.word = v.a || v.z
  UNION ALL
  SELECT v.word, y.word FROM x v JOIN x y ON v.i = y.i AND v.a = y.a AND v.z = y.z AND v.word < y.word),
s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
f AS MATERIALIZED (
  SELECT a AS word, count(*) AS n_near, min({'m': -n, 'f': b}) AS best FROM s JOIN w ON w.word = b GROUP BY a),
j AS MATERIALIZED (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * n THEN best.f END AS form,
         CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n FROM w LEFT JOIN f ON f.word = w.word),
e AS (SELECT word, word AS at, 0 AS k FROM j UNION ALL SELECT e.word, j.form, k + 1 FROM e JOIN j ON j.word = e.at AND j.form IS NOT NULL)
SELECT j.word, form, arg_max(e.at, k) AS root, n, n_near, form_n FROM j JOIN e ON e.word = j.word GROUP BY ALL""",
}
