"""One query per operator, with production parameters over the whole tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densefold.llm import bpe, embeddings, fingerprints, jaccard, langid, licenses, packing, substrings, tokenfile, warc

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark, _table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(_table(spark, sf_dir, "documents"), _path())
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return done.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentences", ",").alias("sentences"), F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, _table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.write(spark, _table(spark, sf_dir, "documents"), _path(), end_id=0)
    return tokenfile.digests(tokenfile.read(spark, folder))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(spark, _table(spark, sf_dir, "documents"), length=50)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(spark, _table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), _path(), end_id=2, cap=1024)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark, _table(spark, sf_dir, "embeddings"), least=0.98)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(spark, _table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_bpe_round_trip, op3_license_scan, op4_language_id, op5_token_files, op6_substring_dedup, op7_warc, op8_best_fit_packing, op9_embedding_dedup, op10_fingerprints, pipeline,
)}
#: SQL that says the same, where no tokenizer, trained model or hash of ours is involved.
ORACLES = {
    "op1_ngram_jaccard": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
 items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
 links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
   GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
 SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
    "op6_substring_dedup": """WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 wins AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(strlen(h) // 2 - 49)) AS i FROM h WHERE strlen(h) >= 100)),
 first AS (SELECT x, min(doc_id) AS d FROM wins GROUP BY x HAVING count(*) > 1 AND min(doc_id) < max(doc_id)),
 hit AS (SELECT doc_id, i FROM wins JOIN first USING (x) WHERE doc_id > d),
 runs AS MATERIALIZED (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(CASE WHEN i <= prev + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r
   FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM hit)) GROUP BY doc_id, r),
 gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs UNION ALL SELECT doc_id, max(b), 1000000000 FROM runs GROUP BY doc_id),
 kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM gaps JOIN h USING (doc_id) GROUP BY doc_id),
 n AS (SELECT doc_id, sum(b - a) AS g, count(*) AS s FROM runs GROUP BY doc_id)
 SELECT doc_id, strlen(h) // 2 AS n_bytes, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM h LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
 r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY s, n) ELSE page_id END AS holder FROM d)
 SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN holder = page_id THEN NULL ELSE holder END AS refers_to FROM r""",
    "op9_embedding_dedup": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 ok AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
 SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM v JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) USING (vec_id)
 LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)""",
}
