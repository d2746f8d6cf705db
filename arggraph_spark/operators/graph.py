"""Edges, reachability and components over a corpus.

``components``, ``closure_pairs`` and ``well_founded`` take documents up to ``LARGE`` statements one row each, in one pass
without shuffles between steps, and larger ones by the joins of ``large``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import Corpus, per_document
from . import large
from .fixpoint import cut, fixpoint, some
from .net import Net

#: Statements of a document beyond which joins take over from the kernel.
LARGE = 50_000
#: Steps from seeds that are taken one by one before the rest of their ways is doubled.
STEPS = 12


def edges(corpus: Corpus) -> DataFrame:
    return corpus.edges


def self_loops(corpus: Corpus) -> DataFrame:
    return corpus.edges.filter("src = dst").select("doc_id", F.col("src").alias("id"))


def foundations(corpus: Corpus) -> DataFrame:
    """Statements that no argument concludes, with their columns."""
    concluded = corpus.arguments.select("doc_id", F.explode("conclusions").alias("id"))
    return corpus.statements.join(concluded, ["doc_id", "id"], "left_anti").select("doc_id", "ord", "id", "text", "mode")


def terminals(corpus: Corpus) -> DataFrame:
    """Statements that are no argument's premise."""
    used = corpus.arguments.select("doc_id", F.explode("premises").alias("id"))
    return corpus.statements.join(used, ["doc_id", "id"], "left_anti").select("doc_id", "ord", "id", "text", "mode")


def _divided(corpus: Corpus) -> tuple[Corpus | None, Corpus | None]:
    """The corpus of documents up to ``LARGE`` statements and that of larger ones, each if there are any; of two, the larger ones' is written."""
    sizes = corpus.statements.groupBy("doc_id").count().filter(F.col("count") > LARGE).select("doc_id")
    if not some(sizes):
        return corpus, None
    sizes = cut(sizes)
    side = lambda how: [t.join(sizes, "doc_id", how) for t in (corpus.docs, corpus.statements, corpus.arguments)]
    large_ = Corpus(*map(cut, side("left_semi")))
    return (Corpus(*side("left_anti")) if some(corpus.docs.join(sizes, "doc_id", "left_anti")) else None), large_


def divided(corpus: Corpus, kernel: Callable[[dict], Iterator[tuple]], rest: str, beyond: Callable[[Corpus], DataFrame], nested: Callable[[Corpus], DataFrame] = Corpus.nested) -> DataFrame:
    """Rows (doc_id, ``rest``) by ``kernel`` over the rows that ``nested`` makes and, for documents of more than ``LARGE`` statements, those of ``beyond``."""
    small, large_ = _divided(corpus)
    if large_ is None:
        return per_document(nested(small), kernel, _schema(corpus, rest))
    out = beyond(large_)
    return out if small is None else per_document(nested(small), kernel, _schema(corpus, rest)).unionByName(out)


def closure(edges: DataFrame, seeds: DataFrame | None = None, stop: DataFrame | None = None, up: bool = True, rounds: int | None = None) -> DataFrame:
    """(doc_id, src, dst, hops): what each seed (doc_id, id; default: every end of an edge) reaches; by joins.

    The seed itself is reached only on a cycle. ``stop`` (doc_id, src, id: for a seed) is reached but not left.
    ``hops`` is the least number of arguments between; ``rounds`` bounds it. Without seeds distances are doubled, so a
    chain of n takes log2(n) rounds. From seeds a round is a step, as long as few; then the rest of the way is doubled in
    the documents that aren't done, unless ``stop`` tells where each seed's way ends.
    """
    if seeds is None and stop is None:
        pairs = large.closure(edges, rounds)
        return pairs.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "hops") if up else pairs
    step = edges.select("doc_id", F.col("dst" if up else "src").alias("dst"), F.col("src" if up else "dst").alias("next"))
    seeds = seeds.select("doc_id", F.col("id").alias("src")) if seeds is not None else step.select("doc_id", F.col("dst").alias("src")).distinct()
    first = seeds.select("doc_id", "src", F.col("src").alias("dst")).join(step, ["doc_id", "dst"]).select("doc_id", "src", F.col("next").alias("dst")).distinct()

    def follow(new: DataFrame) -> DataFrame:
        if stop is not None:
            new = new.join(stop.select("doc_id", "src", F.col("id").alias("dst")), ["doc_id", "src", "dst"], "left_anti")
        return new.join(step, ["doc_id", "dst"]).select("doc_id", "src", F.col("next").alias("dst"))

    keys = ["doc_id", "src", "dst"]
    if stop is not None or (rounds is not None and rounds <= STEPS):
        return fixpoint(first, follow, keys, rounds, "hops")
    near = fixpoint(first, follow, keys, STEPS, "hops")
    last = near.filter(F.col("hops") == STEPS)
    if not some(last):
        return near
    rest = edges.join(last.select("doc_id").distinct(), "doc_id", "left_semi")
    far = large.closure(rest if not up else rest.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst")), None if rounds is None else rounds - STEPS)
    beyond = last.select("doc_id", "src", F.col("dst").alias("mid")).join(far.select("doc_id", F.col("src").alias("mid"), "dst", F.col("hops").alias("h")), ["doc_id", "mid"])
    found = beyond.groupBy(*keys).agg((F.min("h") + STEPS).alias("hops"))
    return near.unionByName(found.join(near.select(*keys), keys, "left_anti"))


def closure_pairs(corpus: Corpus, up: bool = True) -> DataFrame:
    """(doc_id, src, dst): every statement with what it reaches, by the kernel or, for large documents, by joins."""

    def kernel(doc: dict):
        net = Net(doc)
        for s in range(len(net.statements)):
            src = net.statements[s]["id"]
            for t in net.ids(net.reach(s, up)):
                yield doc["doc_id"], src, t

    return divided(corpus, kernel, "src string, dst string", lambda c: closure(c.edges, up=up).drop("hops"), Corpus.outlines)


def _schema(corpus: Corpus, rest: str) -> str:
    return f"doc_id {dict(corpus.statements.dtypes)['doc_id']}, {rest}"


def components(corpus: Corpus) -> DataFrame:
    """(doc_id, comp, pos, id, cyclic): every component in topological order, members in file order.

    Where several orders are possible that of documents beyond ``LARGE`` statements is another; see ``large.components``.
    """

    def kernel(doc: dict):
        net = Net(doc)
        for k, comp in enumerate(net.components()):
            for pos, s in enumerate(comp):
                yield doc["doc_id"], k, pos, net.statements[s]["id"], net.cyclic(comp)

    return divided(corpus, kernel, "comp int, pos int, id string, cyclic boolean", large.components, Corpus.outlines)


def components_by_joins(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, id, comp): membership alone, comp the least id; by forward and backward reachability, see ``large.strong``."""
    numbers = cut(nodes.select("doc_id", "id").withColumn("v", F.monotonically_increasing_id()))
    end = lambda old, new: numbers.select("doc_id", F.col("id").alias(old), F.col("v").alias(new))
    found = large.strong(cut(edges.join(end("src", "s"), ["doc_id", "src"]).join(end("dst", "t"), ["doc_id", "dst"]).select("doc_id", "s", "t")))
    members = numbers.join(found, ["doc_id", "v"], "left").withColumn("comp", F.coalesce("comp", "v"))
    least = members.groupBy("doc_id", "comp").agg(F.min("id").alias("least"))
    return members.join(least, ["doc_id", "comp"]).select("doc_id", "id", F.col("least").alias("comp"))


def focus(corpus: Corpus, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(doc_id, src, dst, hops): statements within ``depth`` arguments of each seed (doc_id, id), itself at 0."""

    def kernel(doc: dict):
        near: dict[str, set[str]] = {}
        for a in doc["arguments"] or []:
            for there, back in (("conclusions", "premises"), ("premises", "conclusions")):
                if direction == "both" or (direction == "up") == (back == "premises"):
                    for x in a[there]:
                        near.setdefault(x, set()).update(a[back])
        for s in doc["seeds"]:
            seen, last = {s: 0}, [s]
            for hops in range(1, depth + 1):
                last = [y for y in {y for x in last for y in near.get(x, ())} if y not in seen]
                seen.update(dict.fromkeys(last, hops))
            for t, hops in seen.items():
                yield doc["doc_id"], s, t, hops

    _, large_ = _divided(corpus)
    few = seeds if large_ is None else seeds.join(large_.docs.select("doc_id"), "doc_id", "left_anti")
    frame = few.groupBy("doc_id").agg(F.collect_set("id").alias("seeds")).join(corpus.outlines(), "doc_id", "left")
    found = per_document(frame.select("doc_id", "seeds", "arguments"), kernel, _schema(corpus, "src string, dst string, hops int"))
    if large_ is None:
        return found
    return found.unionByName(_focus_by_joins(large_, seeds.join(large_.docs.select("doc_id"), "doc_id", "left_semi"), depth, direction))


def _focus_by_joins(corpus: Corpus, seeds: DataFrame, depth: int, direction: str) -> DataFrame:
    own = seeds.select("doc_id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("hops"))
    if direction == "both":
        reverse = corpus.edges.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = closure(corpus.edges.unionByName(reverse), seeds, up=True, rounds=depth) if depth else own.limit(0)
    else:
        found = closure(corpus.edges, seeds, up=direction == "up", rounds=depth) if depth else own.limit(0)
    return own.unionByName(found).groupBy("doc_id", "src", "dst").agg(F.min("hops").alias("hops"))


def well_founded(corpus: Corpus) -> DataFrame:
    """(doc_id, ord, id, foundation, grounded) of every statement."""

    def kernel(doc: dict):
        net = Net(doc)
        done = net.grounded()
        for i, s in enumerate(net.statements):
            yield doc["doc_id"], s["ord"], s["id"], not net.incoming[i], i in done

    def beyond(c: Corpus) -> DataFrame:
        first = foundations(c).select("doc_id", "id", F.lit(True).alias("f"))
        done = large.grounded(c).withColumn("g", F.lit(True))
        rows = c.statements.join(first, ["doc_id", "id"], "left").join(done, ["doc_id", "id"], "left")
        return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), "id", F.coalesce("f", F.lit(False)).alias("foundation"), F.coalesce("g", F.lit(False)).alias("grounded"))

    return divided(corpus, kernel, "ord long, id string, foundation boolean, grounded boolean", beyond, Corpus.outlines)


def grounded_by_joins(corpus: Corpus) -> DataFrame:
    """(doc_id, id) of grounded statements by counters of open premises; see ``large.grounded``."""
    return large.grounded(corpus)
