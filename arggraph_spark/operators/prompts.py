"""User prompts of the passes of an extraction, built by DataFrame plans; their system prompts and schemas are the caller's.

Every builder gives (doc_id, call, user); ``with_hash`` adds the hash by which recorded replies are looked up.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words between the parts of the prompts, which the requests' hashes depend on.
NAMED = "Document: {}\n\n"
ASK_STATEMENTS = "\n\nExtract the candidate statements from the paragraphs above."
CANDIDATES = "Candidate statements (id [mode]: text):\n"
ASK_MERGES = "\n\nPropose merges of near-duplicate statements, or an empty list."
AVAILABLE = "\n\nStatements available for this section (id [mode]: text):\n"
ASK_ARGUMENTS = "\n\nExtract the arguments the author makes in the paragraphs above, using only these statement ids."
ALL_STATEMENTS = "All statements (id [mode]: text):\n"
RECORDED = "\n\nArguments already recorded (id: premises => conclusions):\n"
ASK_LINKS = "\n\nPropose the missing cross-section arguments, or an empty list."


def _header(name: Column | None) -> Column:
    before, after = NAMED.split("{}")
    return F.lit("") if name is None else F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(before), name, F.lit(after))).otherwise("")


def _line() -> Column:
    return F.concat("id", F.lit(" ["), "mode", F.lit("]: "), "text")


def _listed(rows: DataFrame, line: Column, keys: list[str], order: str) -> DataFrame:
    """(keys, listed): the lines of each group in order."""
    return rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))["line"], "\n").alias("listed"))


def statement_prompts(chunks: DataFrame, name: Column | None = None) -> DataFrame:
    """A prompt for each chunk (doc_id, chunk, text)."""
    return chunks.select("doc_id", F.col("chunk").alias("call"), F.concat(_header(name), "text", F.lit(ASK_STATEMENTS)).alias("user"))


def merge_prompts(statements: DataFrame, name: Column | None = None) -> DataFrame:
    """A prompt for each batch of candidate statements (doc_id, batch, seq, id, mode, text)."""
    rows = _listed(statements, _line(), ["doc_id", "batch"], "seq")
    return rows.select("doc_id", F.col("batch").alias("call"), F.concat(_header(name), F.lit(CANDIDATES), "listed", F.lit(ASK_MERGES)).alias("user"))


def argument_prompts(chunks: DataFrame, shown: DataFrame, statements: DataFrame, name: Column | None = None) -> DataFrame:
    """A prompt for each chunk with the statements (doc_id, seq, id, mode, text) that ``shown`` (doc_id, chunk, id) gives it."""
    rows = _listed(shown.join(statements.select("doc_id", "id", "seq", "mode", "text"), ["doc_id", "id"]), _line(), ["doc_id", "chunk"], "seq")
    all_ = chunks.join(rows, ["doc_id", "chunk"], "left")
    return all_.select("doc_id", F.col("chunk").alias("call"), F.concat(_header(name), "text", F.lit(AVAILABLE), F.coalesce("listed", F.lit("")), F.lit(ASK_ARGUMENTS)).alias("user"))


def link_prompts(statements: DataFrame, arguments: DataFrame, name: Column | None = None) -> DataFrame:
    """A prompt for each document with all its statements and its arguments (doc_id, ord, id, premises, conclusions)."""
    all_ = _listed(statements, _line(), ["doc_id"], "seq").withColumnRenamed("listed", "s")
    premises = F.when(F.size("premises") > 0, F.array_join("premises", ", ")).otherwise("(none)")
    made = _listed(arguments, F.concat("id", F.lit(": "), premises, F.lit(" => "), F.array_join("conclusions", ", ")), ["doc_id"], "ord").withColumnRenamed("listed", "a")
    rows = all_.join(made, "doc_id", "left")
    return rows.select("doc_id", F.lit(0).alias("call"), F.concat(_header(name), F.lit(ALL_STATEMENTS), "s", F.lit(RECORDED), F.coalesce("a", F.lit("(none)")), F.lit(ASK_LINKS)).alias("user"))


def _quoted(text: Column) -> Column:
    """A JSON string as Python writes it, characters beyond ASCII as they are."""
    boxed = F.to_json(F.struct(text.alias("x")))
    return F.substr(boxed, F.lit(6), F.char_length(boxed) - 6)


def with_hash(prompts: DataFrame, system: str, schema: dict) -> DataFrame:
    """``prompts`` with request_hash: SHA-256 of {"schema", "system", "user"} as JSON with sorted keys."""
    before = '{"schema": ' + json.dumps(schema, sort_keys=True, ensure_ascii=False) + ', "system": ' + json.dumps(system, ensure_ascii=False) + ', "user": '
    return prompts.withColumn("request_hash", F.sha2(F.concat(F.lit(before), _quoted(F.col("user")), F.lit("}")), 256))
