"""The registered queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import archive, binary_packing, chat, class_ngrams, exact_dedup, gumbel_segments, html_wrapper, near_dedup, novelty, packing, quality, runs, whitening
from rillwork.llm.common import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation as read back from its formatted windows."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(probe)
    return chat.read_back(chat.chat_windows(rows))


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices as read back from the files that the tasks wrote."""
    return binary_packing.write_sequences(binary_packing.binary_sequences(_table(spark, sf_dir, "documents")), new_folder(spark, "sequences"))


def op4_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ngrams.class_scores(_table(spark, sf_dir, "documents"))


def op5_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archive")
    archive.write_archive(_table(spark, sf_dir, "pages"), folder)
    return archive.read_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_gumbel_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's sampled segmentations, and of the texts that they decode to."""
    return gumbel_segments.sample_segmentations(_table(spark, sf_dir, "documents"), k=3, with_text=True).select(
        "doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_texts(_table(spark, sf_dir, "pages"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="max")


def op11_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.found_secrets(_table(spark, sf_dir, "documents"))


def op12_subspace_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_partition_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents' words, after the tails of every tenth document were made to repeat."""
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), places=runs.planted_tails)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_chat_windows, op2_nnls_packing, op3_binary_packing, op4_class_ngrams, op5_content_archive, op6_gumbel_segments, op7_superminhash, op8_wrapper_text, op9_line_quality, op10_exact_dedup,
        op11_zstd_novelty, op12_subspace_whitening, op13_partition_runs,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_content_archive": """
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            g AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest)
            SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
            FROM p JOIN g USING (payload_digest)""",
        "op10_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    }
