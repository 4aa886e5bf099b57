"""The queries op1 to op10 and pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm import langid

    docs, path = table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken")
    model = langid.fit(docs, ~langid.held_out(), path)
    return langid.predict(docs, model, path).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm import warc

    pages = table(spark, sf_dir, "pages")
    return warc.lookup(pages, warc.write_archives(pages, least=0), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm import id_files

    manifest = id_files.write_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return id_files.digests(id_files.read_manifest(manifest))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm import secrets

    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm import decontaminate

    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.sharding import sharded

    return sharded(table(spark, sf_dir, "documents")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SQL = {
    # base32 of a digest is its 160 bits five at a time; the digest's 40 hex digits are 32 fives
    "op4_warc_index": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h),
z AS (SELECT h, string_agg(substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * CAST(position(substr(h, CAST(j AS INT), 1) IN '0123456789abcdef') AS INT) - 3, 4), '' ORDER BY j) AS bits FROM f, (SELECT unnest(range(1, 41)) AS j) k GROUP BY h),
l AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum([CAST(substr(bits, CAST(5 * g + b + 1 AS INT), 1) AS INT) * CAST(power(2, 4 - b) AS INT) for b in range(5)]) AS INT), 1), '' ORDER BY g) AS label
      FROM z, (SELECT unnest(range(32)) AS g) k GROUP BY h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, l.label AS payload_digest, CASE WHEN d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> f.first THEN f.first END AS refers_to FROM d JOIN f ON d.h = f.h JOIN l ON d.h = l.h""",
    # every window of an item's size in every document that shares a shingle with the item; of each pair the best window
    "op9_decontamination": """
WITH d AS (SELECT DISTINCT doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') if x <> ''] AS w FROM documents),
i AS (SELECT row_number() OVER () AS k, item_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') if x <> ''] AS w FROM benchmark),
s AS (SELECT k, item_id, w, len(w) AS n, least(5, len(w)) AS g FROM i WHERE len(w) > 0),
ig AS (SELECT k, n, g, array_to_string(w[CAST(p AS INT):CAST(p + g - 1 AS INT)], ' ') AS t, count(*) AS b FROM (SELECT *, unnest(range(1, n - g + 2)) AS p FROM s) x GROUP BY ALL),
dg AS (SELECT doc_id, len(w) AS len, g, p, array_to_string(w[CAST(p AS INT):CAST(p + g - 1 AS INT)], ' ') AS t FROM (SELECT doc_id, w, g, unnest(range(1, len(w) - g + 2)) AS p FROM d, (SELECT DISTINCT g FROM s) y) x),
h AS (SELECT dg.doc_id, dg.len, dg.p, dg.t, ig.k, ig.n, ig.g, ig.b, least(ig.n, dg.len) - ig.g + 1 AS m FROM dg JOIN ig ON dg.t = ig.t AND dg.g = ig.g),
c AS (SELECT doc_id, len, k, n, g, m, t, b, start, count(*) AS a FROM (SELECT *, unnest(range(greatest(0, p - m), least(p - 1, greatest(0, len - n)) + 1)) AS start FROM h) x GROUP BY ALL),
v AS (SELECT doc_id, k, start, least(n, len) AS n_words, sum(least(a, b)) AS shared, m + n - g + 1 AS total FROM c GROUP BY doc_id, k, start, n, g, m, len),
r AS (SELECT *, CAST(shared AS DOUBLE) / CAST(total - shared AS DOUBLE) AS similarity, row_number() OVER (PARTITION BY doc_id, k ORDER BY CAST(shared AS DOUBLE) / CAST(total - shared AS DOUBLE) DESC, start) AS best FROM v)
SELECT r.doc_id, s.item_id, CAST(r.start AS INT) AS start, CAST(r.n_words AS INT) AS n_words, r.similarity FROM r JOIN s ON r.k = s.k WHERE best = 1 AND similarity >= 0.8""",
    "op5_exact_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_sharding": "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
