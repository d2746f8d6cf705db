"""Documents as DOT, Mermaid and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canon_py, wrap
from ..sources.corpus import Corpus, per_document
from . import graph
from .net import Net
from .reports import _places, _with_targets

# The renderers' templates.
DOT_HEAD = ["digraph worldview {", "  rankdir={};", '  node [fontname="Helvetica", fontsize=10];', "  edge [arrowsize=0.7];"]
MERMAID_CLASS = "  classDef ought stroke-width:3px,stroke-dasharray:4 2;"


def _labels(corpus: Corpus, ids: bool, width: int, escape, joint: str) -> tuple[DataFrame, DataFrame]:
    """Statements and arguments with their label; all but the wrapping stays in the JVM."""
    if width < 1:
        raise ValueError("lines are at least one character wide")
    # Only texts that need it cross to Python.
    plain = ~F.col("text").rlike("[^\\x20-\\x7e]|^ | $|  ") & (F.length("text") <= width)
    lines = F.when(plain, F.array("text")).otherwise(wrap(F.when(~plain, F.col("text")), F.lit(width)))
    head = F.array("id") if ids else F.array().cast("array<string>")
    join = lambda parts: F.array_join(F.transform(parts, escape), joint)
    statements = corpus.statements.withColumn("label", join(F.concat(head, lines)))
    rule = F.when(F.coalesce(F.col("rule"), F.lit("")) != "", F.array("rule")).otherwise(F.array().cast("array<string>"))
    return statements, corpus.arguments.withColumn("label", join(F.concat(head, rule)))


def _links(corpus: Corpus) -> DataFrame:
    """(doc_id, a, pos, s, forth): an argument's premises, then its conclusions; a and s are places in file order."""
    a = corpus.arguments.select("doc_id", F.col("ord").alias("a"), F.size("premises").alias("k"), F.posexplode(F.concat("premises", "conclusions")).alias("pos", "id"))
    place = corpus.statements.select("doc_id", "id", F.col("ord").alias("s"))
    return a.join(place, ["doc_id", "id"]).select("doc_id", "a", "pos", "s", (F.col("pos") < F.col("k")).alias("forth"))


def _line(section: int, ord_: Column, pos: Column, line: Column) -> list[Column]:
    return [F.col("doc_id"), F.lit(section).alias("section"), ord_.cast("long").alias("ord"), pos.cast("long").alias("pos"), line.alias("line")]


def _name(kind: str, ord_: str) -> Column:
    return F.concat(F.lit(kind), F.col(ord_).cast("string"))


def dot_lines(corpus: Corpus, ids: bool = True, width: int = 36) -> DataFrame:
    """(doc_id, section, ord, pos, line): the nodes and edges; ord must count from 0 within a document for valid names."""
    quote = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    s, a = _labels(corpus, ids, width, quote, "\\n")
    border = F.when(F.col("mode") == "ought", ", peripheries=2").otherwise("")
    z = F.lit(0)
    nodes = s.select(*_line(1, F.col("ord"), z, F.concat(F.lit("  "), _name("s", "ord"), F.lit(' [shape=box, style=rounded, label="'), "label", F.lit('"'), border, F.lit("];"))))
    hubs = a.select(*_line(2, F.col("ord"), z, F.concat(F.lit("  "), _name("a", "ord"), F.lit(' [shape=diamond, fontsize=8, label="'), "label", F.lit('"];'))))
    ends = F.when(F.col("forth"), F.concat(_name("s", "s"), F.lit(" -> "), _name("a", "a"))).otherwise(F.concat(_name("a", "a"), F.lit(" -> "), _name("s", "s")))
    return nodes.unionByName(hubs).unionByName(_links(corpus).select(*_line(3, F.col("a"), F.col("pos"), F.concat(F.lit("  "), ends, F.lit(";")))))


def _gathered(corpus: Corpus, lines: DataFrame, head: Column, foot: Column) -> DataFrame:
    heads = corpus.docs.select("doc_id", F.struct(head.alias("head"), foot.alias("foot")).alias("doc"))
    rows = heads.unionByName(lines.select("doc_id", F.struct("section", "ord", "pos", "line").alias("row")), allowMissingColumns=True)
    body = rows.repartition("doc_id").groupBy("doc_id").agg(F.first("doc", ignorenulls=True).alias("doc"), F.sort_array(F.collect_list("row")).alias("rows")).filter("doc is not null")
    text = F.array_join(F.concat("doc.head", F.col("rows.line"), F.col("doc.foot")), "\n")
    return body.select("doc_id", F.concat(text, F.lit("\n")).alias("text"))


def to_dot(corpus: Corpus, ids: bool = True, width: int = 36, rankdir: str = "LR") -> DataFrame:
    """(doc_id, text): Graphviz source; an ought has two borders."""
    name = F.coalesce(F.col("name"), F.lit(""))
    quoted = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    title = F.when(name != "", F.array(F.concat(F.lit('  label="'), quoted, F.lit('"; labelloc=t;')))).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.array(*(F.lit(x.replace("{}", rankdir)) for x in DOT_HEAD)), title)
    return _gathered(corpus, dot_lines(corpus, ids, width), head, F.array(F.lit("}")))


def mermaid_lines(corpus: Corpus, ids: bool = True, width: int = 36) -> DataFrame:
    """(doc_id, section, ord, pos, line): the nodes and edges."""
    s, a = _labels(corpus, ids, width, lambda x: F.replace(x, F.lit('"'), F.lit("#quot;")), "<br/>")
    z = F.lit(0)
    nodes = s.select(*_line(1, F.col("ord"), z, F.concat(F.lit("  "), _name("s", "ord"), F.lit('["'), "label", F.lit('"]'))))
    label = F.when(F.col("label") == "", " ").otherwise(F.col("label"))
    hubs = a.select(*_line(2, F.col("ord"), z, F.concat(F.lit("  "), _name("a", "ord"), F.lit('{{"'), label, F.lit('"}}'))))
    ends = F.when(F.col("forth"), F.concat(_name("s", "s"), F.lit(" --> "), _name("a", "a"))).otherwise(F.concat(_name("a", "a"), F.lit(" --> "), _name("s", "s")))
    return nodes.unionByName(hubs).unionByName(_links(corpus).select(*_line(3, F.col("a"), F.col("pos"), F.concat(F.lit("  "), ends))))


def to_mermaid(corpus: Corpus, ids: bool = True, width: int = 36, direction: str = "LR") -> DataFrame:
    """(doc_id, text): a Mermaid flowchart; an ought has a class."""
    oughts = corpus.statements.filter("mode = 'ought'").groupBy("doc_id").agg(F.sort_array(F.collect_list("ord")).alias("oughts"))
    named = F.array_join(F.transform("oughts", lambda o: F.concat(F.lit("s"), o.cast("string"))), ",")
    marked = F.when(F.col("oughts").isNotNull(), F.array(F.lit(MERMAID_CLASS), F.concat(F.lit("  class "), named, F.lit(" ought;")))).otherwise(F.array(F.lit(MERMAID_CLASS)))
    with_oughts = Corpus(corpus.docs.join(oughts, "doc_id", "left"), corpus.statements, corpus.arguments)
    return _gathered(with_oughts, mermaid_lines(corpus, ids, width), F.array(F.lit(f"flowchart {direction}")), marked)


def _case(net: Net, root: dict) -> list[str]:
    """The tree as nested bullet points."""
    out: list[str] = []
    todo: list[tuple] = [(root, 0)]
    while todo:
        node, level = todo.pop()
        pad = "  " * level
        if isinstance(node, str):
            out.append(pad + node)
            continue
        s = net.statements[net.at[node["statement"]]]
        notes = [say for key, say in (("given", "given"), ("seen", "see above"), ("truncated", "not expanded further")) if key in node]
        if node.get("arguments") == []:
            notes.append("foundation")
        note = f" — *{'; '.join(notes)}*" if notes else ""
        out.append(f"{pad}- **{canon_py(s['text'])}** (`{s['id']}`, {s['mode']}){note}")
        below: list[tuple] = []
        named = {a["id"]: a for a in (net.arguments[i] for i in net.incoming[net.at[s["id"]]])}
        for entry in node.get("arguments", []):
            a = named[entry["argument"]]
            rule = f" [{a['rule']}]" if a["rule"] else ""
            also = ", ".join(f"`{c}`" for c in entry["co_conclusions"])
            also = f" (jointly concludes {also})" if also else ""
            below.append((f"- via `{a['id']}`{rule}{also}: {canon_py(a['justification']) or '(no justification given)'}", level + 1))
            below += [(p, level + 2) for p in entry["premises"]] or [("- *no premises*", level + 2)]
        todo += reversed(below)
    return out


def present(corpus: Corpus, targets: DataFrame | None = None, given: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(doc_id, statement, text): the case for each target in Markdown; with ``given``, what the audience must grant, and no depth."""

    def kernel(doc: dict):
        net = Net(doc)
        accepted = _places(net, doc["given"])
        tick = lambda ids: ", ".join(f"`{x}`" for x in ids)
        bullets = lambda rows, none: [f"- `{net.statements[s]['id']}`: {canon_py(net.statements[s]['text'])}" for s in rows] or [none]
        for t in _places(net, doc["targets"]):
            s = net.statements[t]
            r = net.plan(t, accepted) if accepted else net.report(t, True, depth)
            tags = [f"`{s['id']}`", s["mode"], *([f"in cycle: {tick(r['tree']['scc'])}"] if "scc" in r["tree"] else [])]
            parts = [[f"# {canon_py(s['text'])}"], [" · ".join(tags)]]
            if accepted:
                parts.append([f"Taken as given: {tick(r['given']) or 'nothing in this statement' + chr(39) + 's closure'}."])
            parts += [["## The case"], _case(net, r["tree"])]
            if accepted:
                grant = bullets((net.at[x["id"]] for x in r["must_grant"]), "Nothing: every foundation reached is already given.")
                parts += [["## What the audience must grant"], grant]
            else:
                first = [t] if not net.incoming[t] else []
                rest = [net.at[x] for x in r["closure"]["statements"] if not net.incoming[net.at[x]]]
                parts += [["## Foundations reached"], bullets([*first, *rest], "None: every statement in the closure has an argument for it (the closure is cyclic).")]
            if r["sccs"]:
                parts += [["## Cycles involved"], [f"- {tick(c)}" for c in r["sccs"]]]
            yield doc["doc_id"], s["id"], "\n\n".join("\n".join(p) for p in parts).rstrip() + "\n"

    return per_document(_with_targets(corpus, targets, given), kernel, graph._schema(corpus, "statement string, text string"))
