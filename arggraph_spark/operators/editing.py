"""Search, filters and edits, each a plan over the corpus tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import Corpus
from . import graph


def _has(c: str, query: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.strip().lower()))


def filter_statements(corpus: Corpus, query: str = "", mode: str | None = None, foundations_only: bool = False, cyclic_only: bool = False, ungrounded_only: bool = False) -> DataFrame:
    """Statements that meet all conditions, with their columns."""
    out = corpus.statements
    if mode:
        out = out.filter(F.col("mode") == mode)
    if query.strip():
        out = out.filter(_has("id", query) | _has("text", query))
    if foundations_only:
        out = out.join(graph.foundations(corpus).select("doc_id", "id"), ["doc_id", "id"], "left_semi")
    if cyclic_only:
        out = out.join(graph.components(corpus).filter("cyclic").select("doc_id", "id"), ["doc_id", "id"], "left_semi")
    if ungrounded_only:
        out = out.join(graph.well_founded(corpus).filter("not grounded").select("doc_id", "id"), ["doc_id", "id"], "left_semi")
    return out


def filter_arguments(corpus: Corpus, query: str) -> DataFrame:
    """Arguments whose id, rule, justification or an end's id contains the query."""
    ends = F.exists(F.concat("premises", "conclusions"), lambda x: F.contains(F.lower(x), F.lit(query.strip().lower())))
    return corpus.arguments.filter(_has("id", query) | _has("rule", query) | _has("justification", query) | ends)


def search_statements(corpus: Corpus, query: str, exclude: list[str] | None = None, limit: int = 20) -> DataFrame:
    """(doc_id, rank, score, id): id equal 0, begins 1, contains 2, text contains 3, any for a blank query 4; ties in file order; a document's first ``limit``."""
    q = F.lit(query.strip().lower())
    ident = F.lower("id")
    score = F.when(q == "", 4).when(ident == q, 0).when(F.startswith(ident, q), 1).when(F.contains(ident, q), 2).when(_has("text", query), 3)
    rows = corpus.statements.withColumn("score", score).filter(F.col("score").isNotNull())
    if exclude:
        rows = rows.filter(~F.col("id").isin(exclude))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("score", "ord"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("score").cast("long").alias("score"), "id")


def drawable(corpus: Corpus, keep: DataFrame) -> Corpus:
    """The part of the corpus within ``keep`` (doc_id, id): those statements, and arguments all of whose ends are among them."""
    statements = corpus.statements.join(keep.select("doc_id", "id"), ["doc_id", "id"], "left_semi")
    ends = corpus.arguments.select("doc_id", F.col("id").alias("arg"), F.explode(F.concat("premises", "conclusions")).alias("id"))
    outside = ends.join(statements.select("doc_id", "id"), ["doc_id", "id"], "left_anti").select("doc_id", F.col("arg").alias("id"))
    return replace(corpus, statements=statements, arguments=corpus.arguments.join(outside, ["doc_id", "id"], "left_anti"))


def fresh_ids(items: DataFrame, prefix: str) -> DataFrame:
    """(doc_id, id): the least prefix<number> above all that a document has."""
    number = F.regexp_extract("id", f"^{prefix}([0-9]{{1,18}})$", 1).cast("long")
    return items.groupBy("doc_id").agg(F.concat(F.lit(prefix), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")).alias("id"))


def add_statements(corpus: Corpus, new: DataFrame) -> Corpus:
    """Appends (doc_id, id, text, mode) rows at their documents' ends; ids that are taken are left out."""
    return replace(corpus, statements=_append(corpus.statements, new))


def add_arguments(corpus: Corpus, new: DataFrame) -> Corpus:
    """Appends (doc_id, id, premises, conclusions, justification, rule) rows."""
    return replace(corpus, arguments=_append(corpus.arguments, new))


def _append(items: DataFrame, new: DataFrame) -> DataFrame:
    last = items.groupBy("doc_id").agg(F.max("ord").alias("_last"))
    fresh = new.join(items.select("doc_id", "id"), ["doc_id", "id"], "left_anti").join(last, "doc_id", "left")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))
    fresh = fresh.withColumn("ord", (F.coalesce("_last", F.lit(-1)) + nth).cast(items.schema["ord"].dataType))
    return items.unionByName(fresh.drop("_last"), allowMissingColumns=True)


def update(items: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """``items`` with the columns of the rows of ``changes`` (doc_id, id, columns); a null there changes nothing."""
    new = changes.select("doc_id", "id", *(F.col(c).alias(f"_{c}") for c in columns))
    out = items.join(new, ["doc_id", "id"], "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in items.columns))


def rename_statements(corpus: Corpus, names: DataFrame) -> Corpus:
    """Renames (doc_id, id, new_id) everywhere; a name that the document has already is refused."""
    free = names.join(corpus.statements.select("doc_id", F.col("id").alias("new_id")), ["doc_id", "new_id"], "left_anti")
    as_map = free.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "new_id"))).alias("_names"))
    renamed = lambda c: F.transform(c, lambda x: F.coalesce(F.element_at("_names", x), x))
    s = corpus.statements.join(as_map, "doc_id", "left").withColumn("id", F.coalesce(F.element_at("_names", F.col("id")), F.col("id"))).select(*corpus.statements.columns)
    a = corpus.arguments.join(as_map, "doc_id", "left")
    a = a.withColumns({c: F.when(F.col("_names").isNull(), F.col(c)).otherwise(renamed(c)) for c in ("premises", "conclusions")}).select(*corpus.arguments.columns)
    return replace(corpus, statements=s, arguments=a)


def delete_statements(corpus: Corpus, gone: DataFrame) -> Corpus:
    """Removes (doc_id, id) with all references; arguments left without a conclusion go too."""
    lost = gone.groupBy("doc_id").agg(F.collect_set("id").alias("_gone"))
    a = corpus.arguments.join(lost, "doc_id", "left")
    a = a.withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)).otherwise(F.array_except(c, "_gone")) for c in ("premises", "conclusions")}).filter(F.size("conclusions") > 0)
    return replace(corpus, statements=corpus.statements.join(gone.select("doc_id", "id"), ["doc_id", "id"], "left_anti"), arguments=a.select(*corpus.arguments.columns))


def delete_arguments(corpus: Corpus, gone: DataFrame) -> Corpus:
    return replace(corpus, arguments=corpus.arguments.join(gone.select("doc_id", "id"), ["doc_id", "id"], "left_anti"))


def move(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Puts the item of each (doc_id, id, to) at place ``to`` of its document; the others keep their order."""
    out = items.join(moves.select("doc_id", "id", "to"), ["doc_id", "id"], "left").withColumn("_from", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1)
    key = F.coalesce(F.when(F.col("to") > F.col("_from"), F.col("to") + 0.5).when(F.col("to").isNotNull(), F.col("to") - 0.5), F.col("_from").cast("double"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_key", "_from")) - 1
    return out.withColumn("_key", key).withColumn("ord", place.cast(items.schema["ord"].dataType)).select(*items.columns)


def set_header(corpus: Corpus, changes: DataFrame, columns: list[str]) -> Corpus:
    """``docs`` with the columns of (doc_id, columns); a null there changes nothing."""
    new = changes.select("doc_id", *(F.col(c).alias(f"_{c}") for c in columns))
    out = corpus.docs.join(new, "doc_id", "left")
    return replace(corpus, docs=out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in corpus.docs.columns)))
