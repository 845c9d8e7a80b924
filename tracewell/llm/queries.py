"""The queries of this folder: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.bpe import encode_documents, token_counts
from tracewell.llm.common import read
from tracewell.llm.divergence import source_divergence
from tracewell.llm.embedding_dedup import near_vectors
from tracewell.llm.line_dedup import line_dedup
from tracewell.llm.minhash import near_duplicates
from tracewell.llm.mixing import mix
from tracewell.llm.packing import pack
from tracewell.llm.pii import pseudonymise
from tracewell.llm.quality import quality_verdicts
from tracewell.llm.substring_dedup import substring_dedup
from tracewell.llm.token_counts import length_table
from tracewell.llm.url_filter import url_verdicts
from tracewell.llm.whitening import whiten

URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Target weights of the mixture; the other sources share the rest equally.
WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.08}
#: Stands for the secret key, which an operator's user passes in.
PSEUDONYM_KEY = "key for tests only"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return verdicts.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"), texts=False)


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(documents, PSEUDONYM_KEY).select("doc_id", "n_found", "n_replaced", "text")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), RANKS, PATTERN, ["doc_id"])


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mix(read(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)
    return placed.select("doc_id", "source", "block", "slot", F.col("offset").alias("in_block"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(token_counts(read(spark, sf_dir, "documents"), RANKS, PATTERN))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_chunks", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5")
    )


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"), URL_RULES)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"), min_docs=30, top=50)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"), ["vec_id"])


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), TOKENIZER, PATTERN, ["doc_id"], end=1, ids=False)


OP10_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, verdict, h, q) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/'))
SELECT page_id, host, path,
       (SELECT rule FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) ORDER BY length(rule) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) ORDER BY length(rule) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""

#: Deadlines are computed here from the target weights, place by place: of the blocks that are released
#: (block j of a source with q of F places from floor(j * F / q) on), the one due first, before ceil((j + 1) * F / q).
OP6_SQL = """
WITH RECURSIVE s AS (
  SELECT source, row_number() OVER (ORDER BY source) AS i, count(*) OVER () - 3 AS others
  FROM (SELECT DISTINCT source FROM documents)),
w AS (
  SELECT source, i, 100 * others AS f,
         CASE source WHEN 'src0' THEN 15 * others WHEN 'src1' THEN 10 * others WHEN 'src2' THEN 8 * others ELSE 67 END AS q
  FROM s),
all_of AS (SELECT any_value(f) AS f, count(*) AS n, list(q ORDER BY i) AS q FROM w),
run AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(range(n), lambda i: CAST(0 AS BIGINT)) AS taken, CAST(0 AS BIGINT) AS p FROM all_of
  UNION ALL
  SELECT t + 1, list_transform(range(1, n + 1), lambda i: taken[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (
    SELECT t, taken, n, f,
           list_min(list_transform(range(1, n + 1), lambda i:
             CASE WHEN taken[i] < q[i] AND taken[i] * f // q[i] <= t + 1 THEN ((taken[i] + 1) * f + q[i] - 1) // q[i] * 1000 + i END)) % 1000 AS pick
    FROM run, all_of WHERE t + 1 < f)),
pattern AS (SELECT w.source, taken[p] - 1 AS b, t AS place, q, f FROM run JOIN w ON w.i = p WHERE t >= 0),
d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS n
  FROM documents)
SELECT doc_id, d.source, n // 16 AS block, (n // 16) // q * f + place AS slot, n % 16 AS in_block
FROM d JOIN pattern p ON p.source = d.source AND p.b = (n // 16) % q
"""

OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, max(i) OVER (PARTITION BY doc_id) AS last FROM lines),
ends AS (
  SELECT *, CASE WHEN (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4 = 0 OR i = last THEN 1 ELSE 0 END AS ended
  FROM hashed),
numbered AS (
  SELECT *, coalesce(sum(ended) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM ends),
chunks AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS chunk,
         count(*) FILTER (regexp_matches(line, '[^ 	

]')) >= 2 AS counts
  FROM numbered GROUP BY doc_id, k),
judged AS (
  SELECT *, counts AND row_number() OVER (PARTITION BY chunk, counts ORDER BY doc_id, k) > 1 AS removed FROM chunks)
SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (removed) AS n_removed,
       md5(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT removed), '')) AS kept_md5
FROM judged GROUP BY doc_id
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ \t\n\x0b\x0c\r]+') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
                 ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS s
  FROM w),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, y FROM reach r JOIN links ON x = r.other)
SELECT r.doc_id, any_value(n) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r JOIN sizes ON sizes.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, y FROM reach r JOIN links ON x = r.other)
SELECT r.vec_id, (SELECT count(*) FROM links WHERE x = r.vec_id) AS n_links, min(other) AS component_id,
       r.vec_id = min(other) AS kept
FROM reach r GROUP BY r.vec_id
"""

OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\x0c\r]+') AS words FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(words[s:s + 49], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM windows JOIN least USING (k) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM hit),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n
         FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
each AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
         1 + CAST(1000000000 * CAST(coalesce(c, 0) + 5 AS HUGEINT) // (coalesce(n, 0) + 5 * v) AS BIGINT) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
       LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
       LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
  SELECT lang, term, 1 + CAST(1000000000 * CAST(sum(c) + 5 AS HUGEINT) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS BIGINT) AS q
  FROM counts JOIN v USING (lang) GROUP BY lang, term),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(p.p - q.p)), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN shares p ON p.lang = a.lang AND p.source = a.source
       LEFT JOIN shares q ON q.lang = p.lang AND q.source = b.source AND q.term = p.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_packing": op13_packing,
}
ORACLES = {"op2_substring_dedup": OP2_SQL, "op9_embedding_near_dedup": OP9_SQL, "op5_minhash_near_dedup": OP5_SQL, "op6_source_mixing": OP6_SQL, "op8_line_dedup": OP8_SQL, "op10_url_filters": OP10_SQL, "op11_source_divergence": OP11_SQL}
