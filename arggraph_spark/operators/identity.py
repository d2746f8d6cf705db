"""Content-derived identities: proposition ids, justified ids, argument hashes, and hashes of cyclic components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import H, canon, prop_id
from ..sources.corpus import Corpus
from . import large
from .fixpoint import cut
from .graph import divided
from .net import Net


def prop_ids(corpus: Corpus) -> DataFrame:
    """(doc_id, ord, id, prop_id): a projection."""
    return corpus.statements.select("doc_id", "ord", "id", prop_id(F.col("text"), F.col("mode")).alias("prop_id"))


def statement_ids(corpus: Corpus) -> DataFrame:
    """(doc_id, ord, id, prop_id, just_id, scc): scc is the hash of the statement's cyclic component, or null."""

    def kernel(doc: dict):
        net = Net(doc)
        prop, just, _, cycles = net.identities(hashes=False)
        for i, s in enumerate(net.statements):
            yield doc["doc_id"], s["ord"], s["id"], prop[i], just[i], cycles.get(net.comp_of[i])

    return divided(corpus, kernel, "ord long, id string, prop_id string, just_id string, scc string", lambda c: large.identities(c)[0])


def argument_hashes(corpus: Corpus) -> DataFrame:
    """(doc_id, ord, id, arg_hash)."""

    def kernel(doc: dict):
        net = Net(doc)
        for a, h in zip(net.arguments, net.identities()[2], strict=True):
            yield doc["doc_id"], a["ord"], a["id"], h

    return divided(corpus, kernel, "ord long, id string, arg_hash string", lambda c: large.identities(c)[1])


def layered_identities(corpus: Corpus, layer_of: DataFrame | Column, layers: int) -> tuple[DataFrame, DataFrame]:
    """Justified ids (doc_id, id, ord, prop, just_id) and argument hashes (doc_id, arg, arg_hash) of an acyclic corpus: a join and two aggregates a layer.

    ``layer_of`` (doc_id, id, layer), or a column of the statements: every argument's premises lie in lower layers than
    its conclusions; without it see ``large.identities``. What an aggregate gathers comes to it with the row it belongs
    to, so nothing is joined back; every argument is hashed once, in its layer. Keys begin with what tells rows apart, as
    sorts compare a document's id first otherwise, which is the same in all of a large document's rows.
    """
    prop = prop_id(F.col("text"), F.col("mode")).alias("prop")
    if isinstance(layer_of, Column):
        statements = corpus.statements.select("doc_id", "id", "ord", prop, layer_of.alias("layer"))
    else:
        statements = corpus.statements.select("doc_id", "id", "ord", prop).join(layer_of, ["id", "doc_id"])
    statements = cut(statements)
    concluded = corpus.conclusions.select("doc_id", F.col("arg_id").alias("arg"), F.col("stmt_id").alias("id")).join(statements.select("doc_id", "id", "prop", "layer"), ["id", "doc_id"])
    own = corpus.arguments.select("doc_id", F.col("id").alias("arg"), F.struct("premises", F.array_distinct("conclusions").alias("conclusions"), canon(F.col("justification")).alias("why")).alias("own"))
    ends = concluded.select("doc_id", "arg", "prop", "layer").unionByName(own, allowMissingColumns=True).repartition("arg", "doc_id").groupBy("arg", "doc_id")
    args = ends.agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("prop")).alias("props"), F.max("layer").alias("layer"))
    args = cut(args.filter("own is not null and layer is not null").select("doc_id", "arg", "own.*", "props", "layer").sortWithinPartitions("layer"))
    just: DataFrame | None = None
    hashes: list[DataFrame] = []
    for k in range(layers):
        mine = args.filter(F.col("layer") == k)
        met = mine.select("doc_id", "arg", F.struct("conclusions", "why", "props").alias("own"))
        if just is not None:
            used = mine.select("doc_id", "arg", F.explode("premises").alias("id")).join(just.select("doc_id", "id", "just_id"), ["id", "doc_id"])
            met = met.unionByName(used.select("doc_id", "arg", "just_id"), allowMissingColumns=True)
        else:
            met = met.withColumn("just_id", F.lit(None).cast("string"))
        lists = met.repartition("arg", "doc_id").groupBy("arg", "doc_id").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("just_id")).alias("justs"))
        hashes.append(cut(lists.select("doc_id", "arg", "own.conclusions", H("arg", F.col("own.why"), (F.col("justs"),), (F.col("own.props"),)).alias("arg_hash"))))
        level = statements.filter(F.col("layer") == k).select("doc_id", "id", F.struct("ord", "prop").alias("own"))
        level = level.unionByName(hashes[-1].select("doc_id", F.explode("conclusions").alias("id"), "arg_hash"), allowMissingColumns=True)
        level = level.repartition("id", "doc_id").groupBy("id", "doc_id").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("arg_hash")).alias("args")).filter("own is not null")
        new = cut(level.select("doc_id", "id", "own.ord", "own.prop", H("just", F.col("own.prop"), (F.col("args"),)).alias("just_id")))
        just = new if just is None else just.unionByName(new)
    return just, reduce(DataFrame.unionByName, hashes).select("doc_id", "arg", "arg_hash")
