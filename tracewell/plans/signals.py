"""Sample, text and url queries: vectors stand for PCM frames, documents for logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.scalar import milli, redact_mail, redact_query, url_host, url_path
from tracewell.operators import audio
from tracewell.queries import query, table


def frames(spark, sf_dir):
    samples = F.transform("embedding", lambda x: F.round(x.cast("double") * 32767).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", samples.alias("pcm"))


PCM = "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 32767) AS INTEGER)) AS pcm FROM embeddings)"


@query(
    "q47_uncentred_correlation",
    PCM
    + """,
h AS (SELECT vec_id, unnest(pcm[1:32]) AS l, unnest(pcm[33:64]) AS r FROM s)
SELECT vec_id, CAST(round(1000 * sum(CAST(l AS DOUBLE) * r) / sqrt(sum(CAST(l AS DOUBLE) * l) * sum(CAST(r AS DOUBLE) * r))) AS BIGINT) AS correlation FROM h GROUP BY vec_id
""",
)
def q47(spark, sf_dir):
    half = frames(spark, sf_dir).withColumn("l", F.slice("pcm", 1, 32)).withColumn("r", F.slice("pcm", 33, 32))
    return half.select("vec_id", audio.correlation(F.col("l"), F.col("r")).alias("correlation"))


@query(
    "q48_pcm_levels",
    PCM
    + """
SELECT vec_id, list_max(list_transform(pcm, lambda x: abs(x))) AS peak,
       CAST(round(sqrt(list_sum(list_transform(pcm, lambda x: CAST(x AS DOUBLE) * x)) / len(pcm)) * 1000) AS BIGINT) AS rms_milli,
       len(list_filter(pcm, lambda x: abs(x) <= 328)) AS silent,
       len(list_filter(range(2, 65), lambda i: (pcm[i] >= 0) <> (pcm[i - 1] >= 0))) AS crossings
FROM s
""",
)
def q48(spark, sf_dir):
    return frames(spark, sf_dir).select("vec_id", *audio.levels(F.col("pcm")))


@query(
    "q49_spectrum_rolloff",
    """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 32767) AS BIGINT)) AS p FROM embeddings),
w AS (SELECT vec_id, list_transform(range(0, len(p)), lambda i: p[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / (len(p) - 1)))) AS x FROM f WHERE len(p) > 1),
s AS (SELECT vec_id, k, len(x) AS n, pow(list_sum(list_transform(range(0, len(x)), lambda i: x[i + 1] * cos(2 * pi() * k * i / len(x)))), 2)
        + pow(list_sum(list_transform(range(0, len(x)), lambda i: x[i + 1] * sin(2 * pi() * k * i / len(x)))), 2) AS e FROM w, range(0, 33) r(k)),
c AS (SELECT *, sum(e) OVER (PARTITION BY vec_id ORDER BY k) AS below, sum(e) OVER (PARTITION BY vec_id) AS total FROM s)
SELECT vec_id, max_by(k, e) * 8000 // any_value(n) AS peak_hz, min(k) FILTER (below >= 0.85 * total) * 8000 // any_value(n) AS rolloff_hz,
       CAST(floor(sum(k * 8000.0 / n * e) / any_value(total)) AS BIGINT) AS centroid_hz
FROM c GROUP BY vec_id
""",
)
def q49(spark, sf_dir):
    return audio.spectrum(frames(spark, sf_dir), "vec_id", 8000)


LOG_PATTERNS = {"license": "Licensed under", "copyright": "Copyright", "token": "token =", "the": " the ", "pipe": " | "}


@query(
    "q51_log_pattern_count",
    "WITH p(kind, pattern) AS (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in LOG_PATTERNS.items())
    + """)
SELECT kind, count(*) AS n, min(doc_id) AS first FROM documents JOIN p ON contains(text, pattern) GROUP BY kind
""",
)
def q51(spark, sf_dir):
    kinds = F.array_compact(F.array(*[F.when(F.col("text").contains(v), F.lit(k)) for k, v in LOG_PATTERNS.items()]))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.explode(kinds).alias("kind"))
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    )


@query("q52_url_redact", "SELECT page_id, regexp_replace(url, '=[^&#]*', '=***', 'g') AS url FROM pages")
def q52(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", redact_query(F.col("url")).alias("url"))


@query(
    "q52b_mail_redact",
    "SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '***@***', 'g')) AS text_md5 FROM documents",
)
def q52b(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redact_mail(F.col("text"))).alias("text_md5"))


@query(
    "q53_url_parse",
    """
SELECT page_id, regexp_extract(url, '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
       starts_with(url, 'https') AS secure FROM pages
""",
)
def q53(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", url_host(url).alias("host"), url_path(url).alias("path"), url.startswith("https").alias("secure")
    )
