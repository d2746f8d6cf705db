"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, langid, licenses, oracles, sketches, spelling, warc
from .common import table
from .exact import exact_dedup
from .minhash import near_duplicates
from .packing import pack
from .substring import remove_repeated_bytes, remove_repeated_words
from .tokens import count_tokens, token_pieces


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(table(spark, sf_dir, "documents"), 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"), 200)
    n_spans = (F.size("removed") / 2).cast("long").alias("n_spans")
    return out.select("doc_id", "n_bytes", "n_removed", n_spans, F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketches.fingerprints(table(spark, sf_dir, "documents"))
    mine, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        sketches.text_of("sketch").alias("fingerprint"),
        sketches.text_of("edited_sketch").alias("edited_fingerprint"),
        sketches.resemblance(mine, edited).alias("near_edited"),
        sketches.resemblance(mine, following).alias("near_next"),
        sketches.distinct_shingles(mine).alias("n_shingles_estimate"),
        sketches.containment(edited, mine).alias("edited_contained"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return pack(pieces, 2048)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    back = bpe.decode_ids(coded, ranks)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op11_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, groups=3, seed="3")


def op12_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_packages(table(spark, sf_dir, "pages"), least=0)
    return warc.page_records(warc.read_packages(packages))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_token_counts": op2_token_counts,
    "op3_language_mixture": op3_language_mixture,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_yinyang_clusters": op11_yinyang_clusters,
    "op12_zip_warc": op12_zip_warc,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.oracle_sql(),
    "op4_exact_dedup": """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       row_number() over (partition by norm order by doc_id desc) = 1 as kept, sha256(norm) as text_sha256
from d window w as (partition by norm)
""",
    "op11_yinyang_clusters": oracles.clusters_sql(),
    "op12_zip_warc": oracles.WARC_SQL,
    "op13_spelling_variants": oracles.SPELLING_SQL,
}
