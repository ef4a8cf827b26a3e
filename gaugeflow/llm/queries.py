"""The registered queries opN_<name> and pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(mod: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod == rest


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"), min_words=50, similarity=0.8)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_docs import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op6_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_main import extract_main

    return extract_main(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, learn_profiles

    docs = table(spark, sf_dir, "documents")
    model = learn_profiles(docs.where(~_held_out(5, 0)))
    return identify(docs, model).select("doc_id", F.coalesce(_held_out(5, 0), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, learn_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"), ~_held_out(3, 1))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(_held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, joined

    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest, proof_digest, verified_against

    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    more = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)")).cast("string")
    found = manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": more})
    return verified_against(found).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whiten import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=16)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived, described

    return described(archived(table(spark, sf_dir, "pages"), min_bytes=0))


QUERIES = {f.__name__: f for f in (
    op1_bpe, op2_substring_dedup, op3_sharding, op4_minhash, op5_pivot_index, op6_html_main, op7_language_id, op8_toxicity, op9_secret_scan, op10_decontamination,
    op11_merkle, op12_whitening, op13_warc)}

_SPLIT = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Whole tables by brute force, where SQL can express the operator.
ORACLE_SQL: dict[str, str] = {
    "op5_pivot_index": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT a AS vec_id, min(b) AS low FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
 SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op10_decontamination": f"""WITH d AS (SELECT doc_id, coalesce({_SPLIT}, []) AS w FROM documents), i AS (SELECT item_id, coalesce({_SPLIT}, []) AS w FROM benchmark),
 q AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
 g AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
 h AS (SELECT doc_id, item_id, n, p FROM g JOIN q USING (n, k)), x AS (SELECT doc_id, count(DISTINCT z) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS z FROM h) GROUP BY 1),
 y AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)""",
    "op13_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages),
 b AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || h[5 * i + 1 : 5 * i + 5] AS BIGINT)) AS q FROM p)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, list_reduce(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((q[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)]), lambda x, y: x || y) AS payload_digest,
 CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to FROM b""",
}
