"""The registered queries of this package: thin digests of its operators, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, lm, media, packing, substring, token_counts, toxicity, url_filter, warc
from .common import documents


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = documents(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.score(documents(spark, sf_dir), labels).drop("evidence")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(documents(spark, sf_dir, "pages"))
    return warc.read_archives(archives).drop("target_uri")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("rid")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary())


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).drop("rid", "root")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = documents(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter.judge(documents(spark, sf_dir, "pages"), outcomes)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, strlen(x)::BIGINT AS payload_bytes, sha1(x) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top > page_id THEN top END AS refers_to
FROM m"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC_SQL, "op5_decontamination": decontam.sql(), "op6_substring_dedup": substring.sql(), "op10_url_filter": url_filter.sql()}
