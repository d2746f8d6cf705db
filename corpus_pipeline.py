"""Corpus preparation in five stages, each of which calls one operator of arggraph_spark.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arggraph_spark.llm import exact, langid, minhash
from arggraph_spark.llm.common import materialize, table
from arggraph_spark.llm.packing import pack
from arggraph_spark.llm.substring import remove_repeated_bytes
from arggraph_spark.llm.tokens import token_pieces


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, in which no language can be recognised, go; null and empty texts among them."""
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.keep_languages(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z the row of the largest doc_id stays."""
    return exact.keep_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked at 0.8 on five-word shingles, that of the least doc_id stays."""
    return minhash.keep_documents(docs, size=5, percent=80)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a repeated 200-byte string go from each text; n_chars follows. No document goes.

    A removed range that starts or ends inside a character leaves the rest of that character, which is dropped too.
    """
    names = ("_bytes", "_removed", "_kept", "_ranges")
    columns = [c for c in docs.columns if c != "text"]
    out = remove_repeated_bytes(docs, 200, columns=columns, names=names, as_text=True).withColumnRenamed("_kept", "text")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in as few sequences of at most 2048 as the search finds."""
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048), 2048)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("suffix-array dedup", suffix_stage),
    ("best-fit packing", packing_stage),
]

#: Language estimates, components of links and tokens aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
