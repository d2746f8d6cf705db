"""Golden vectors, read as data where they are present."""

import json

import pytest
from fixtures import VECTORS, inputs
from pyspark.sql import functions as F

from arggraph_spark.functions.text import H, canon, canon_py, hash_py
from arggraph_spark.operators import graph, identity, rendering, reports, versions
from arggraph_spark.sources import documents
from arggraph_spark.sources.corpus import corpus_of

pytestmark = pytest.mark.skipif(not VECTORS.exists(), reason="no vectors here")


def load(kind):
    return [json.loads(p.read_text()) for p in sorted((VECTORS / kind).glob("*.json"))]


def by_doc(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r if not cols else tuple(r[c] for c in cols))
    return out


@pytest.fixture(scope="module")
def cases(spark):
    found = {c["name"]: c for c in load("cases")}
    return found, corpus_of(spark, {n: c["input"] for n, c in found.items()}).cached()


def test_primitives(spark):
    p = json.loads((VECTORS / "primitives.json").read_text())
    rows = spark.createDataFrame([(x["input"], x["output"]) for x in p["canon"]], "a string, b string")
    assert all(r[0] == r[1] for r in rows.select(canon(F.col("a")), "b").collect())
    assert all(canon_py(x["input"]) == x["output"] for x in p["canon"])
    one = spark.range(1)
    for x in p["H"]:
        assert hash_py(*x["parts"]) == x["output"]
        if x["parts"]:
            got = one.select(H(*((F.array(*map(F.lit, q)).cast("array<string>"),) if isinstance(q, list) else F.lit(q) for q in x["parts"]))).first()[0]
            assert got == x["output"]


def test_cases(cases):
    found, corpus = cases
    ids = {r.doc_id: json.loads(r.report) for r in reports.identities(corpus).collect()}
    props = by_doc(identity.prop_ids(corpus).orderBy("ord"), "id", "prop_id")
    roots = by_doc(graph.foundations(corpus).orderBy("ord"), "id", "text", "mode")
    rings = by_doc(reports.cycles(corpus).orderBy("comp"), "members", "self_loops", "internal_arguments", "boundary_arguments")
    ground = by_doc(graph.well_founded(corpus).orderBy("ord"), "id", "foundation", "grounded")
    joined = {k: {r[0] for r in v} for k, v in by_doc(graph.grounded_by_joins(corpus), "id").items()}
    walks = {(up, depth): {(r.doc_id, r.statement): json.loads(r.report) for r in f(corpus, depth=depth).collect()} for up, f in ((True, reports.rests_on), (False, reports.supports)) for depth in (None, 1)}
    for n, c in found.items():
        e = c["expected"]
        assert ids[n] == e["ids"], n
        assert [x["prop_id"] for x in e["ids"]["statements"]] == [p for _, p in props.get(n, [])]
        assert [dict(zip(("id", "text", "mode"), r, strict=True)) for r in roots.get(n, [])] == e["foundations"]
        assert [dict(zip(("members", "self_loops", "internal_arguments", "boundary_arguments"), r, strict=True)) for r in rings.get(n, [])] == e["sccs"]
        g = ground.get(n, [])
        assert e["well_founded"] == {"foundations": [i for i, f, _ in g if f], "grounded": [i for i, _, x in g if x], "ungrounded": [i for i, _, x in g if not x]}
        assert joined.get(n, set()) == set(e["well_founded"]["grounded"])
        for key, up, depth in (("rests_on", True, None), ("supports", False, None), ("rests_on_depth_1", True, 1), ("supports_depth_1", False, 1)):
            assert {s: walks[up, depth][n, s] for s in e[key]} == e[key], (n, key)


def test_closure_by_joins_equals_the_kernel(cases):
    _, corpus = cases
    for up in (True, False):
        pairs = lambda df: {(r.doc_id, r.src, r.dst) for r in df.collect()}
        assert pairs(graph.closure_pairs(corpus, up)) == pairs(graph.closure(corpus.edges, up=up))
    ring = {(r.doc_id, r.id, r.comp) for r in graph.components_by_joins(corpus.edges, corpus.statements).collect()}
    parts = {}
    for r in graph.components(corpus).collect():
        parts.setdefault((r.doc_id, r.comp), []).append(r.id)
    assert ring == {(d, i, min(ids)) for (d, _), ids in parts.items() for i in ids}


def test_extras(spark, cases):
    found, corpus = cases
    extras = {x["name"]: x["expected"] for x in load("extras")}
    lint = {r.doc_id: json.loads(r.report) for r in reports.lint_all(corpus).collect()}
    stat = {r.doc_id: json.loads(r.report) for r in reports.stats(corpus).collect()}
    texts = {key: {r.doc_id: r.text for r in f.collect()} for key, f in (
        ("dot", rendering.to_dot(corpus)), ("dot_no_ids_tb", rendering.to_dot(corpus, ids=False, rankdir="TB")),
        ("mermaid", rendering.to_mermaid(corpus)), ("mermaid_no_ids_tb", rendering.to_mermaid(corpus, ids=False, direction="TB")),
    )}
    plain = {(r.doc_id, r.statement): r.text for r in rendering.present(corpus).collect()}
    depth = {(r.doc_id, r.statement): r.text for r in rendering.present(corpus, depth=1).collect()}
    for n, e in extras.items():
        assert lint[n] == e["lint_all"], n
        assert stat[n] == e["stats"], n
        for key, got in texts.items():
            assert got[n] == e[key], (n, key)
        for s, p in e["present"].items():
            assert (plain[n, s], depth[n, s]) == (p["plain"], p["depth_1"]), (n, s)
    # Each combination of a target and what is given becomes a document of its own, so one job answers all.
    asked, docs, targets, given = {}, {}, [], []
    for n, e in extras.items():
        for s in e["plan"]:
            shown = [p["given"]] if (p := e["present"].get(s)) else []
            for k, x in enumerate([*e["plan"][s], *shown]):
                key = f"{n}|{s}|{k}"
                asked[key], docs[key] = x, found[n]["input"]
                targets.append((key, s))
                given += [(key, g) for g in x["given"]]
    many = corpus_of(spark, docs)
    t = spark.createDataFrame(targets, "doc_id string, id string")
    g = spark.createDataFrame(given, "doc_id string, id string")
    plans = {r.doc_id: json.loads(r.report) for r in reports.plan(many, t, g).collect()}
    shown = {r.doc_id: r.text for r in rendering.present(many, t, g).collect()}
    assert len(asked) > 200
    for key, x in asked.items():
        if "markdown" in x:
            assert shown[key] == x["markdown"], key
        else:
            assert plans[key] == x["result"], key


def test_invalid(spark):
    rows = [(p.stem, json.dumps(json.loads(p.read_text())["input"])) for p in sorted((VECTORS / "invalid").glob("*.json"))]
    corpus = documents.parse(spark.createDataFrame(rows, "doc_id string, json string"))
    assert {r.doc_id for r in corpus.problems.collect()} == {n for n, _ in rows}
    assert corpus.docs.count() == 0


def test_round_trip_of_cases(spark, cases):
    found, _ = cases
    rows = [(n, json.dumps(c["input"])) for n, c in found.items()]
    corpus = documents.parse(spark.createDataFrame(rows, "doc_id string, json string"))
    assert corpus.problems.count() == 0
    assert {r.doc_id: json.loads(r.json) for r in documents.to_json(corpus).collect()} == {n: c["input"] for n, c in found.items()}


def test_diffs(spark):
    docs = inputs()
    pairs = [d for d in load("diffs") if d["a"] in docs and d["b"] in docs]
    assert len(pairs) == 11
    name = lambda d: f"{d['a']}--{d['b']}"
    a, b = (corpus_of(spark, {name(d): docs[d[s]] for d in pairs}) for s in "ab")
    got = {r.doc_id: json.loads(r.report) for r in versions.diff_report(a, b).collect()}
    for d in pairs:
        want = {k: v for k, v in d["expected"].items() if k not in "ab"}
        assert got[name(d)] == want, name(d)


def test_merges(spark):
    docs = inputs()
    triples = load("merges")
    name = lambda m: "--".join(m[k] for k in ("base", "ours", "theirs"))
    sides = [corpus_of(spark, {name(m): docs[m[k]] for m in triples}) for k in ("base", "ours", "theirs")]
    got = {r.doc_id: json.loads(r.report) for r in versions.merge_report(*sides).collect()}
    for m in triples:
        assert got[name(m)] == m["expected"], name(m)
