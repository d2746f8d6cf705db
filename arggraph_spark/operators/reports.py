"""Structural queries, lints and statistics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canon, collapse, mean3, prop_id
from ..sources.corpus import Corpus, UnknownIdError, per_document
from . import graph, large
from .net import Net


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False)


# Queries.


def cycles(corpus: Corpus) -> DataFrame:
    """(doc_id, comp, members, self_loops, internal_arguments, boundary_arguments) of each cyclic component, in order."""

    def kernel(doc: dict):
        for k, c in enumerate(Net(doc).cycles()):
            yield doc["doc_id"], k, c["members"], c["self_loops"], c["internal_arguments"], c["boundary_arguments"]

    lists = ", ".join(f"{c} array<string>" for c in ("members", "self_loops", "internal_arguments", "boundary_arguments"))
    return per_document(corpus.outlines(), kernel, graph._schema(corpus, f"comp int, {lists}"))


def _with_targets(corpus: Corpus, targets: DataFrame | None, given: DataFrame | None, texts: bool = True) -> DataFrame:
    frame = corpus.nested() if texts else corpus.outlines()
    if targets is not None:
        frame = frame.join(targets.groupBy("doc_id").agg(F.collect_list("id").alias("targets")), "doc_id")
    else:
        frame = frame.withColumn("targets", F.transform(F.coalesce("statements", F.array().cast(frame.schema["statements"].dataType)), lambda s: s["id"]))
    accepted = F.array().cast("array<string>").alias("given")
    if given is not None:
        return frame.join(given.groupBy("doc_id").agg(F.collect_list("id").alias("given")), "doc_id", "left").withColumn("given", F.coalesce("given", accepted))
    return frame.withColumn("given", accepted)


def _places(net: Net, ids: list[str]) -> list[int]:
    for i in ids:
        if i not in net.at:
            raise UnknownIdError(f"no statement {i!r}")
    return [net.at[i] for i in ids]


def _report(corpus: Corpus, targets: DataFrame | None, up: bool, depth: int | None, report: bool) -> DataFrame:
    def kernel(doc: dict):
        net = Net(doc)
        for t in _places(net, doc["targets"]):
            r = net.report(t, up, depth, tree=report)
            row = doc["doc_id"], r["statement"], r["closure"]["statements"], r["closure"]["arguments"], r["sccs"]
            yield (*row, _dump(r)) if report else row

    rest = "statement string, closure_statements array<string>, closure_arguments array<string>, sccs array<array<string>>"
    return per_document(_with_targets(corpus, targets, None, report), kernel, graph._schema(corpus, rest + ", report string" * report))


def rests_on(corpus: Corpus, targets: DataFrame | None = None, depth: int | None = None, report: bool = True) -> DataFrame:
    """What each target (doc_id, id; default: every statement) rests on; ``report`` is the whole report as JSON.

    Trees and JSON are most of the work, and texts most of the rows: without ``report`` neither is made.
    """
    return _report(corpus, targets, True, depth, report)


def supports(corpus: Corpus, targets: DataFrame | None = None, depth: int | None = None, report: bool = True) -> DataFrame:
    """What each target supports."""
    return _report(corpus, targets, False, depth, report)


def plan(corpus: Corpus, targets: DataFrame | None = None, given: DataFrame | None = None, report: bool = True) -> DataFrame:
    """(doc_id, statement, given, must_establish, must_grant, arguments, sccs, report) for an audience that accepts ``given`` (doc_id, id)."""

    def kernel(doc: dict):
        net = Net(doc)
        accepted = _places(net, doc["given"])
        if not report:
            for t in _places(net, doc["targets"]):
                yield doc["doc_id"], net.statements[t]["id"], *net.needs(t, set(accepted)).values()
            return
        for t in _places(net, doc["targets"]):
            r = net.plan(t, accepted)
            yield doc["doc_id"], r["statement"], r["given"], [s["id"] for s in r["must_establish"]], [s["id"] for s in r["must_grant"]], r["arguments"], r["sccs"], _dump(r)

    rest = "statement string, given array<string>, must_establish array<string>, must_grant array<string>, arguments array<string>, sccs array<array<string>>"
    return per_document(_with_targets(corpus, targets, given, report), kernel, graph._schema(corpus, rest + ", report string" * report))


def tree_rows(corpus: Corpus, targets: DataFrame | None = None, up: bool = True, depth: int | None = None) -> DataFrame:
    """Trees flat, in pre-order: (doc_id, target, seq, parent_seq, depth, via_arg, stmt, scc, given, seen, truncated)."""

    def kernel(doc: dict):
        net = Net(doc)
        for t in _places(net, doc["targets"]):
            stop = set(_places(net, doc["given"])) - {t}
            todo, seq = [(net.tree(t, up, depth, stop), None, 0, None)], 0
            while todo:
                node, parent, d, via = todo.pop()
                yield doc["doc_id"], net.statements[t]["id"], seq, parent, d, via, node["statement"], node.get("scc"), "given" in node, "seen" in node, "truncated" in node
                for a in reversed(node.get("arguments", [])):
                    todo += [(x, seq, d + 1, a["argument"]) for x in reversed(a["premises" if up else "conclusions"])]
                seq += 1

    rest = "target string, seq int, parent_seq int, depth int, via_arg string, stmt string, scc array<string>, given boolean, seen boolean, truncated boolean"
    return per_document(_with_targets(corpus, targets, None), kernel, graph._schema(corpus, rest))


def scc_arguments(corpus: Corpus, components: DataFrame) -> DataFrame:
    """(doc_id, comp, arg_ord, arg_id, internal) of the arguments that touch cyclic components; by joins."""
    ends = corpus.arguments.select("doc_id", F.col("ord").alias("arg_ord"), F.col("id").alias("arg_id"), F.array_union("premises", "conclusions").alias("ends"))
    each = ends.select("doc_id", "arg_ord", "arg_id", F.size("ends").alias("all"), F.explode("ends").alias("id"))
    inside = each.join(components.filter("cyclic").select("doc_id", "comp", "id"), ["doc_id", "id"])
    return inside.groupBy("doc_id", "comp", "arg_ord", "arg_id").agg((F.count(F.lit(1)) == F.first("all")).alias("internal"))


def identities(corpus: Corpus) -> DataFrame:
    """(doc_id, report): all identities of a document as JSON; a statement on a cycle has its component's members as scc."""

    def kernel(doc: dict):
        net = Net(doc)
        prop, just, hashes, rings = net.identities()
        comps = net.components()
        statements = []
        for i, s in enumerate(net.statements):
            ring = {"scc": net.ids(comps[net.comp_of[i]])} if net.comp_of[i] in rings else {}
            statements.append({"id": s["id"], "prop_id": prop[i], "just_id": just[i], **ring})
        yield doc["doc_id"], _dump({"statements": statements, "arguments": [{"id": a["id"], "arg_hash": h} for a, h in zip(net.arguments, hashes, strict=True)]})

    return per_document(corpus.nested(), kernel, graph._schema(corpus, "report string"))


# Lints.


def duplicates(corpus: Corpus) -> DataFrame:
    """(doc_id, ord, prop_id, text, ids): statements of one proposition, text as the first has it, canonical; ord the first's place."""
    rows = corpus.statements.withColumn("prop_id", prop_id(F.col("text"), F.col("mode")))
    groups = rows.groupBy("doc_id", "prop_id").agg(F.min("ord").alias("ord"), F.min_by("text", "ord").alias("text"), F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("all"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.select("doc_id", "ord", "prop_id", canon(F.col("text")).alias("text"), F.col("all.id").alias("ids"))


def unused(corpus: Corpus) -> DataFrame:
    """Statements in no argument."""
    ends = corpus.arguments.select("doc_id", F.explode(F.array_union("premises", "conclusions")).alias("id"))
    return corpus.statements.join(ends, ["doc_id", "id"], "left_anti").select("doc_id", "ord", "id")


def empty_justifications(corpus: Corpus) -> DataFrame:
    """Arguments whose justification is blank; composition changes nothing there, so no NFC is needed."""
    return corpus.arguments.filter(collapse(F.col("justification")) == "").select("doc_id", "ord", "id")


def is_ought_gaps(corpus: Corpus) -> DataFrame:
    """(doc_id, ord, argument, ought_conclusions, premises): arguments to an ought without a premise that is one."""
    a = corpus.arguments.select("doc_id", F.col("ord").alias("arg_ord"), F.col("id").alias("argument"), "premises", F.posexplode(F.concat("premises", "conclusions")).alias("pos", "id"))
    side = a.withColumn("premise", F.col("pos") < F.size("premises")).join(corpus.statements.select("doc_id", "id", "mode"), ["doc_id", "id"])
    ought = F.col("mode") == "ought"
    found = side.groupBy("doc_id", "arg_ord", "argument", "premises").agg(
        F.bool_or(ought & F.col("premise")).alias("from_ought"), F.sort_array(F.collect_list(F.when(ought & ~F.col("premise"), F.struct("pos", "id")))).alias("to")
    )
    return found.filter("not from_ought and size(to) > 0").select("doc_id", F.col("arg_ord").alias("ord"), "argument", F.col("to.id").alias("ought_conclusions"), "premises")


def lint_all(corpus: Corpus) -> DataFrame:
    """(doc_id, report): all lints of a document as JSON."""

    def kernel(doc: dict):
        from ..functions.text import canon_py

        net = Net(doc)
        done = net.grounded()
        n = range(len(net.statements))
        props: dict[str, list[int]] = {}
        for i, p in enumerate(net.identities()[0]):
            props.setdefault(p, []).append(i)
        ought = lambda s: net.statements[s]["mode"] == "ought"
        yield doc["doc_id"], _dump({
            "well_founded": {"foundations": net.ids(i for i in n if not net.incoming[i]), "grounded": net.ids(i for i in n if i in done), "ungrounded": net.ids(i for i in n if i not in done)},
            "duplicates": [{"prop_id": p, "text": canon_py(net.statements[g[0]]["text"]), "mode": net.statements[g[0]]["mode"], "ids": net.ids(g)} for p, g in props.items() if len(g) > 1],
            "unused": net.ids(i for i in n if not net.incoming[i] and not net.outgoing[i]),
            "empty_justifications": [a["id"] for a in net.arguments if not canon_py(a["justification"])],
            "is_ought_gaps": [
                {"argument": a["id"], "ought_conclusions": net.ids(c for c in cs if ought(c)), "premises": a["premises"]}
                for a, ps, cs in zip(net.arguments, net.premises, net.conclusions, strict=True) if any(map(ought, cs)) and not any(map(ought, ps))
            ],
        })

    return per_document(corpus.nested(), kernel, graph._schema(corpus, "report string"))


# Statistics.


def counts(corpus: Corpus) -> DataFrame:
    """One row a document of the counts that need no walk: statements, arguments, modes, sizes of sides, zero-premise arguments."""
    is_ = F.count_if(F.col("mode") == "is").alias("mode_is")
    s = corpus.statements.groupBy("doc_id").agg(F.count(F.lit(1)).alias("statements"), is_, F.count_if(F.col("mode") == "ought").alias("mode_ought"))
    p, c = F.size("premises"), F.size("conclusions")
    sides = [f(x).cast("long").alias(f"{n}_{k}") for n, x in (("premises", p), ("conclusions", c)) for k, f in (("min", F.min), ("max", F.max), ("sum", F.sum))]
    a = corpus.arguments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("arguments"), *sides, F.count_if(p == 0).alias("zero_premise_arguments"))
    out = corpus.docs.select("doc_id").join(s, "doc_id", "left").join(a, "doc_id", "left").na.fill(0)
    for n in ("premises", "conclusions"):
        out = out.withColumn(f"{n}_mean", mean3(F.col(f"{n}_sum"), F.col("arguments"))).drop(f"{n}_sum")
    return out


def stats(corpus: Corpus, top: int = 5) -> DataFrame:
    """(doc_id, statements, arguments, foundations, terminals, unused, ungrounded, cycles, ..., report): one row a document; report is the whole as JSON."""

    def side(sizes: list[int]) -> dict:
        return {"min": min(sizes, default=0), "max": max(sizes, default=0), "mean": round(sum(sizes) / len(sizes), 3) if sizes else 0.0}

    def kernel(doc: dict):
        net = Net(doc)
        n = range(len(net.statements))
        rings = [c for c in net.components() if net.cyclic(c)]
        down, up = ([len(net.reach(i, d)) for i in n] for d in (False, True))
        ought = sum(s["mode"] == "ought" for s in net.statements)
        r = {
            "statements": len(n),
            "arguments": len(net.arguments),
            "modes": {"is": len(n) - ought, "ought": ought},
            "foundations": sum(not a for a in net.incoming),
            "terminals": sum(not a for a in net.outgoing),
            "unused": sum(not a and not b for a, b in zip(net.incoming, net.outgoing, strict=True)),
            "ungrounded": len(n) - len(net.grounded()),
            "cycles": len(rings),
            "largest_cycle": max(map(len, rings), default=0),
            "statements_in_cycles": sum(map(len, rings)),
            "premises": side([len(p) for p in net.premises]),
            "conclusions": side([len(c) for c in net.conclusions]),
            "zero_premise_arguments": sum(not p for p in net.premises),
            "longest_chain": net.longest_chain(),
            "most_supporting": [{"id": net.statements[i]["id"], "downstream": down[i]} for i in net.top(down, top)],
            "most_supported": [{"id": net.statements[i]["id"], "upstream": up[i]} for i in net.top(up, top)],
        }
        yield doc["doc_id"], *(r[k] for k in _COUNTS), _dump(r)

    return per_document(corpus.nested(), kernel, graph._schema(corpus, ", ".join(f"{k} long" for k in _COUNTS) + ", report string"))


def longest_chains(corpus: Corpus) -> DataFrame:
    """(doc_id, longest_chain): the most arguments in a row, a cycle counting as one step; one walk over a document, or by joins."""
    return graph.divided(corpus, lambda doc: iter([(doc["doc_id"], Net(doc).longest_chain())]), "longest_chain long", large.longest_chains, Corpus.outlines)


_COUNTS = ("statements", "arguments", "foundations", "terminals", "unused", "ungrounded", "cycles", "largest_cycle", "statements_in_cycles", "zero_premise_arguments", "longest_chain")


def top_supporting(corpus: Corpus, top: int = 5, up: bool = False) -> DataFrame:
    """(doc_id, rank, id, n): the statements that reach most others, ties in file order."""
    n = graph.closure_pairs(corpus, up).groupBy("doc_id", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    ranked = n.join(corpus.statements.select("doc_id", "id", "ord"), ["doc_id", "id"])
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "ord")))
    return ranked.filter(F.col("rank") <= top).select("doc_id", F.col("rank").cast("long").alias("rank"), "id", "n")
