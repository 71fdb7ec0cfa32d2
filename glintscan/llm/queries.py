"""The registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, fill_in_middle, jaccard_join, line_frequency, mixing, near_dedup, secret_scan, simple8b, spelling, token_counts, top_k, toxicity, warc

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Longest input of the model that documents are cut for.
MAX_TOKENS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), JSON)
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive(table(spark, sf_dir, "pages"))
    page = lambda part: F.get_json_object(f"{part}.fields_json", "$.page-id").cast("long")
    return captures.select(
        page("metadata").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), page("original_metadata").alias("refers_to"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_files(table(spark, sf_dir, "documents"), JSON)


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(table(spark, sf_dir, "documents")).drop("text_key", "removed")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    number = [F.size(F.filter("base", secret_scan.of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *number, F.sha2(secret_scan.shown("base"), 256).alias("base_sha256"), secret_scan.shown("spans").alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), RANKS, PATTERN, digests=True)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), typo_every=199))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_mix, op3_warc, op4_token_files, op5_line_frequency, op6_secret_scan, op7_toxicity, op8_byte_bpe, op9_top_k, op10_near_dedup, op11_spelling, op12_jaccard_join, op13_fill_in_middle)
}
#: Twins of the queries that SQL can express over whole tables; the tests hold the others against brute force.
ORACLE: dict[str, str] = {
    "op3_warc": """
        SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last_id END AS refers_to
        FROM (SELECT *, coalesce(octet_length(encode(html)) >= 1000 AND page_id < last_id, false) AS again
              FROM (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id FROM pages))""",
    "op9_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', doc_id)) AS hex FROM documents),
             h AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS unit,
                          CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
                          CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4 FROM d),
             c AS (SELECT *, CAST(len(unit) AS BIGINT) AS n, least(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS low,
                          greatest(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS high,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                               WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
             p AS (SELECT doc_id, text, n, form, array_to_string(unit[1:low], '') AS prefix,
                          array_to_string(unit[low + 1:high], '') AS middle, array_to_string(unit[high + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
