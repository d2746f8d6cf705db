import json
import random

import pytest
from fixtures import cycle, doc, edited
from pyspark.sql import functions as F

from arggraph_spark import cli
from arggraph_spark.functions import text
from arggraph_spark.operators import editing, extraction, graph, identity, rendering, reports, versions
from arggraph_spark.operators.net import Net
from arggraph_spark.sources import documents
from arggraph_spark.sources.corpus import UnknownIdError, corpus_of
from arggraph_spark.streaming import changes


def net(d):
    return Net({"statements": d["statements"], "arguments": [{"rule": None, **a} for a in d["arguments"]]})


def random_doc(seed, n=12, m=14):
    rng = random.Random(seed)
    ids = [f"s{i}" for i in range(n)]
    statements = [(i, rng.choice(["rain", "wet roads", "Rain", "cold  night"]), rng.choice(["is", "ought"])) for i in ids]
    return doc(statements, [(f"a{k}", rng.sample(ids, rng.randrange(4)), rng.sample(ids, rng.choice([1, 1, 2])), rng.choice(["j", "k", " "])) for k in range(m)])


# Text.


def test_whitespace_and_canon(spark):
    assert len(text.WHITESPACE) == 29
    rows = [f"{c}a{c}{c}b{c}" for c in text.WHITESPACE] + ["﻿a​b", "é ", "", "plain"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(text.canon(F.col("t"))).collect()] == ["a b"] * 29 + ["﻿a​b", "é", "", "plain"]
    assert [text.canon_py(r) for r in rows] == ["a b"] * 29 + ["﻿a​b", "é", "", "plain"]


def test_rounding_is_pythons(spark):
    pairs = [(1, 16), (5, 3), (0, 0), (2675, 1000), (1, 8000)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(text.mean3(F.col("a"), F.col("b"))).collect()]
    assert got == [round(a / b, 3) if b else 0.0 for a, b in pairs]


@pytest.mark.parametrize("s, want", [("Hello, World!", "hello-world"), ("Ünïcode Straße", "unicode-strae"), ("日本", "s"), ("x" * 60, "x" * 48), ("ab " * 30, ("ab-" * 16)[:-1]), ("a" * 47 + " bcd", "a" * 47)])
def test_slugs(s, want):
    assert text.slug_py(s) == want


def test_slug_of_a_text():
    assert text.slug_from_text_py("One two three four five six") == "one-two-three-four-five"
    assert text.slug_from_text_py("日本") == "statement"


# Identity.


@pytest.mark.parametrize("seed", range(8))
def test_identities_ignore_order_and_names(seed):
    d = random_doc(seed)
    rng = random.Random(seed)
    other = json.loads(json.dumps(d))
    for items in (other["statements"], other["arguments"]):
        rng.shuffle(items)
    for s in other["statements"]:
        s["id"] = "new-" + s["id"]
    for a in other["arguments"]:
        a["premises"], a["conclusions"] = (rng.sample(["new-" + x for x in a[k]], len(a[k])) for k in ("premises", "conclusions"))
    one, two = net(d), net(other)
    ids = lambda n: {s["id"].removeprefix("new-"): (p, j) for s, p, j in zip(n.statements, *n.identities()[:2], strict=True)}
    assert ids(one) == ids(two)


def test_edits_ripple_downstream_only():
    before, after = net(cycle()), net(edited(cycle(), 4, "Q2"))
    changed = [a != b for a, b in zip(before.identities()[1], after.identities()[1], strict=True)]
    assert changed == [False, False, False, False, True]
    after = net(edited(cycle(), 2, "Y2"))
    changed = [a != b for a, b in zip(before.identities()[1], after.identities()[1], strict=True)]
    assert changed == [False, True, True, True, True]


def test_long_chain():
    n = 5000
    d = doc([(f"s{i}", str(i)) for i in range(n)], [(f"a{i}", [f"s{i}"], [f"s{i + 1}"]) for i in range(n - 1)])
    chain = net(d)
    assert chain.longest_chain() == n - 1
    assert len(set(chain.identities()[1])) == n
    assert len(chain.reach(n - 1)) == n - 1
    assert chain.tree(n - 1, True, None, set())["statement"] == f"s{n - 1}"


def test_layered_identities_equal_the_kernel(spark):
    rng = random.Random(5)
    layer = {f"s{i}": i % 3 for i in range(12)}
    arguments = []
    for k in range(15):
        top = rng.choice([1, 2])
        arguments.append((f"a{k}", [s for s in layer if layer[s] < top and rng.random() < 0.3], rng.sample([s for s in layer if layer[s] == top], 1)))
    d = doc([(s, f"text {s}") for s in layer], arguments)
    c = corpus_of(spark, {"d": d})
    layers = spark.createDataFrame([("d", s, v) for s, v in layer.items()], "doc_id string, id string, layer int")
    just, hashes = identity.layered_identities(c, layers, 3)
    assert {r.id: r.just_id for r in just.collect()} == {r.id: r.just_id for r in identity.statement_ids(c).collect()}
    assert {r.arg: r.arg_hash for r in hashes.collect()} == {r.id: r.arg_hash for r in identity.argument_hashes(c).collect()}


# Graph.


def test_components_in_order():
    arguments = [(f"{a}{b}", [a], [b]) for a, b in ("ra", "ab", "ba", "bc", "cd", "dc", "dd")] + [("cde", ["c", "d"], ["e"])]
    n = net(doc([(x, x) for x in "abcder"], arguments))
    assert [n.ids(c) for c in n.components()] == [["r"], ["a", "b"], ["c", "d"], ["e"]]
    assert n.cycles()[1] == {"members": ["c", "d"], "self_loops": ["d"], "internal_arguments": ["cd", "dc", "dd"], "boundary_arguments": ["bc", "cde"]}


def test_unknown_ids_and_lookup(spark):
    c = corpus_of(spark, {"d": cycle()})
    assert c.statement("d", "x").text == "X" and c.argument("d", "z-q").justification == "z gives q"
    with pytest.raises(UnknownIdError):
        c.statement("d", "nope")
    with pytest.raises(Exception, match="nope"):
        reports.rests_on(c, spark.createDataFrame([("d", "nope")], "doc_id string, id string")).collect()


def test_stop_and_rounds_of_closure(spark):
    c = corpus_of(spark, {"d": cycle()})
    seed = spark.createDataFrame([("d", "q")], "doc_id string, id string")
    stop = spark.createDataFrame([("d", "q", "y")], "doc_id string, src string, id string")
    reach = lambda df: sorted(r.dst for r in df.collect())
    assert reach(graph.closure(c.edges, seed)) == ["p", "x", "y", "z"]
    assert reach(graph.closure(c.edges, seed, stop)) == ["y", "z"]
    assert reach(graph.closure(c.edges, seed, rounds=2)) == ["y", "z"]
    assert {(r.dst, r.hops) for r in graph.focus(c, seed, 2, "up").collect()} == {("q", 0), ("z", 1), ("y", 2)}


def test_tree_rows_are_the_trees(spark):
    c = corpus_of(spark, {"d": cycle()})
    rows = [r for r in reports.tree_rows(c).orderBy("target", "seq").collect() if r.target == "q"]
    assert [(r.stmt, r.depth, r.via_arg, r.seen) for r in rows] == [("q", 0, None, False), ("z", 1, "z-q", False), ("y", 2, "y-z", False), ("x", 3, "x-y", False), ("p", 4, "p-x", False), ("z", 4, "z-x", True)]


# Documents.


def test_problems_in_words():
    assert documents.problems_of([]) == ["document: must be a JSON object"]
    d = cycle()
    d["statements"].append({"id": "x", "text": "again", "mode": "is"})
    d["arguments"][0]["premises"] = ["ghost"]
    assert documents.problems_of(d) == ["statements[5]: duplicate statement id 'x'", "arguments[0] (p-x): premises references unknown statement 'ghost'"]
    d["arguments"][0]["conclusions"] = []
    d["version"] = "0.1\n"
    assert documents.problems_of(d) == ["document: 'version' must be a string like \"0.1\", got '0.1\\n'", "arguments[0] (p-x): 'conclusions' must have at least 1 item(s)"]
    with pytest.raises(documents.ValidationError):
        documents.validate(d, strict=True)


def test_reading_files(spark, tmp_path):
    good = cycle() | {"meta": {"b": 1, "a": 1.50, "c": 1e2}}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_bytes(b'{"format": "\xff"}')
    (tmp_path / "nan.json").write_text('{"format": NaN}')
    (tmp_path / "broken.json").write_text(json.dumps(doc([("a", "A"), ("a", "B")], [("x", ["ghost"], ["a"]), ("y", [], ["ghost"])])))
    c = documents.read(spark, str(tmp_path))
    assert {r.doc_id.rsplit("/", 1)[1] for r in c.problems.collect()} == {"bad.json", "nan.json", "broken.json"}
    (row,) = documents.to_json(c).collect()
    assert json.loads(row.json) == good and list(json.loads(row.json)["meta"]) == ["b", "a", "c"]
    mild = documents.read(spark, str(tmp_path / "broken.json"), permissive=True)
    assert [(r.id, r.text) for r in mild.statements.collect()] == [("a", "A")]
    assert [(r.id, r.premises) for r in mild.arguments.collect()] == [("x", [])]
    with pytest.raises(documents.LoadError):
        documents.read(spark, str(tmp_path / "nan.json"), strict=True)


def test_schema_names_all_fields():
    s = documents.json_schema()
    assert set(s["properties"]) == set(documents.DOCUMENT_FIELDS)
    assert set(s["properties"]["statements"]["items"]["properties"]) == set(documents.STATEMENT_FIELDS)


# Versions.


@pytest.mark.parametrize("seed", range(3))
def test_difference_with_itself_and_merge_of_one_side(spark, seed):
    d, e = random_doc(seed), edited(random_doc(seed), 3, "edited")
    a, b = corpus_of(spark, {"d": d}), corpus_of(spark, {"d": e})
    r = json.loads(versions.diff_report(a, a).first().report)
    assert r["summary"]["statements"] == {"identical": len(d["statements"]), "rejustified": 0, "added": 0, "removed": 0}
    m = json.loads(versions.merge_report(a, a, b).first().report)
    assert m["merged"] == e and m["conflicts"] == []
    assert m["summary"]["statements"]["changed"] == 1


def test_json_values_compare_as_the_format_says():
    same = [("{}", "[]"), ("true", "1"), ("1", "1.0"), ('{"a":1,"b":2}', '{"b":2,"a":1}')]
    other = [("[1,2]", "[2,1]"), ('"1"', "1"), ("null", "0")]
    key = lambda x: json.dumps(versions._freeze(json.loads(x)))
    assert all(key(a) == key(b) for a, b in same) and all(key(a) != key(b) for a, b in other)


# Edits and search.


def test_edits(spark):
    c = corpus_of(spark, {"d": cycle()})
    one = lambda *r: spark.createDataFrame([r], "doc_id string, id string, new_id string" if len(r) == 3 else "doc_id string, id string")
    renamed = editing.rename_statements(c, one("d", "x", "xx"))
    assert {(tuple(r.premises), tuple(r.conclusions)) for r in renamed.arguments.collect()} == {(("p",), ("xx",)), (("xx",), ("y",)), (("y",), ("z",)), (("z",), ("xx",)), (("z",), ("q",))}
    assert [r.id for r in editing.rename_statements(c, one("d", "x", "y")).statements.orderBy("ord").collect()] == list("pxyzq")
    gone = editing.delete_statements(c, one("d", "q"))
    assert gone.statements.count() == 4 and gone.arguments.count() == 4
    assert [r.id for r in editing.fresh_ids(c.statements.withColumn("id", F.concat(F.lit("s"), "ord")), "s").collect()] == ["s5"]
    new = spark.createDataFrame([("d", "n", "New", "is"), ("d", "x", "taken", "is")], "doc_id string, id string, text string, mode string")
    assert [r.id for r in editing.add_statements(c, new).statements.orderBy("ord").collect()] == [*"pxyzq", "n"]
    changed = editing.update(c.statements, spark.createDataFrame([("d", "y", "Why")], "doc_id string, id string, text string"), ["text"])
    assert {r.id: r.text for r in changed.collect()}["y"] == "Why"
    moved = editing.move(c.statements, spark.createDataFrame([("d", "q", 1)], "doc_id string, id string, to int"))
    assert [r.id for r in moved.orderBy("ord").collect()] == list("pqxyz")
    assert editing.set_header(c, spark.createDataFrame([("d", "N")], "doc_id string, name string"), ["name"]).docs.first().name == "N"
    assert editing.delete_arguments(c, one("d", "z-q")).arguments.count() == 4
    part = editing.drawable(c, spark.createDataFrame([("d", "x"), ("d", "y")], "doc_id string, id string"))
    assert [r.id for r in part.arguments.collect()] == ["x-y"]


def test_filters_and_search(spark):
    c = corpus_of(spark, {"d": cycle()})
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(editing.filter_statements(c, cyclic_only=True)) == ["x", "y", "z"]
    assert ids(editing.filter_statements(c, foundations_only=True)) == ["p"]
    assert ids(editing.filter_statements(c, ungrounded_only=True)) == []
    assert ids(editing.filter_arguments(c, "GIVES X")) == ["p-x", "z-x"]
    assert [r.id for r in editing.search_statements(c, "Z").orderBy("rank").collect()] == ["z"]
    assert len(editing.search_statements(c, "", limit=3).collect()) == 3


# Extraction.


def segmented(spark, text):
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    seg = extraction.segmentation(docs).first()
    rows = extraction.paragraphs(docs).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(seg.paragraphs))
    return seg.mode, [(r.key, r.text, r.heading) for r in rows], seg.skipped


def test_segmentation(spark):
    assert segmented(spark, "one\ntwo\n\n  three") == ("untagged", [("p1", "one two", None), ("p2", "three", None)], 0)
    assert segmented(spark, "\ufeffone\r\ntwo\rthree")[1] == [("p1", "one", None), ("p2", "two", None), ("p3", "three", None)]
    tagged = "# Head\n[a.1] first\nline\n[a.1] second\n\nstray\n\n# \n[b]\n\n[c] last"
    assert segmented(spark, tagged) == ("tagged", [("a.1", "first line", "Head"), ("a.1.2", "second", "Head"), ("c", "last", "Head")], 3)
    assert segmented(spark, "[a] one\n\nb\n\nc\n\nd")[0] == "untagged"
    assert [k for k, _, _ in segmented(spark, "[a] x\n[a.2] y\n[a] z\n[a] w")[1]] == ["a", "a.2", "a.3", "a.4"]
    for text in (None, "", " \n\n\t", "# only"):
        assert segmented(spark, text) == ("untagged", [], 0)


def test_chunks(spark):
    docs = spark.createDataFrame([("d", "# H\n\n" + "x" * 35 + "\n\n" + "y" * 35 + "\n\n# K\n\n" + "z" * 7 + "\n\n" + "w" * 350)], "doc_id string, text string")
    rows = extraction.chunks(extraction.paragraphs(docs), 30).orderBy("chunk").collect()
    assert [(r["keys"], r["tokens"], r["headings"]) for r in rows] == [(["p1", "p2"], 20, ["H"]), (["p3"], 2, ["K"]), (["p4"], 100, ["K"])]
    assert rows[0].text.startswith("[p1] xxx")
    assert extraction.oversize(extraction.chunks(extraction.paragraphs(docs), 30), 30).first().key == "p4"
    assert extraction.dry_run(docs, 30).first().chunks == 3


def test_consolidation(spark):
    reply = lambda *rows: json.dumps({"statements": [dict(zip(("text", "mode", "sources", "role", "note", "slug"), r, strict=True)) for r in rows]})
    replies = spark.createDataFrame([
        ("d", 0, reply((" Rain   falls ", "is", ["[p1]", "zz"], "implied", "", "rain"), ("", "is", [], "stated", "", ""))),
        ("d", 1, reply(("Rain falls", "is", ["p2", "p1"], "stated", "a note", "other"), ("Rain falls", "ought", [], "stated", "", "rain"))),
    ], "doc_id string, chunk int, response string")
    keys = spark.createDataFrame([("d", "p1"), ("d", "p2")], "doc_id string, key string")
    one = extraction.consolidate_exact(extraction.candidates(replies, keys))
    rows = extraction.assign_ids(one).orderBy("seq").collect()
    assert [(r.id, r.mode, r.sources, r.chunks, r.note, r.role) for r in rows] == [("rain", "is", ["p1", "p2"], [0, 1], "a note", "stated"), ("rain-2", "ought", [], [1], "", "stated")]


def test_merge_mapping_and_absorption(spark):
    rows = [("d", i, f"s{i}", f"t{i}", "is" if i < 5 else "ought", [f"p{i}"], [i], "n" if i == 2 else "", "implied", 0) for i in range(6)]
    s = spark.createDataFrame(rows, "doc_id string, seq long, id string, text string, mode string, sources array<string>, chunks array<int>, note string, role string, batch int")
    asked = [("d", 0, 0, "s0", ["s1", "s0", "s5", "ghost"]), ("d", 1, 0, "s1", ["s2"]), ("d", 2, 0, "s2", ["s0"]), ("d", 3, 0, "s3", ["s1"]), ("d", 4, 0, "nope", ["s3"])]
    mapping = extraction.merge_mapping(s, spark.createDataFrame(asked, "doc_id string, seq int, batch int, keep string, drop array<string>"))
    assert {(r.dropped, r.kept) for r in mapping.collect()} == {("s1", "s0"), ("s2", "s0")}
    left = {r.id: r for r in extraction.absorb(s, mapping).collect()}
    assert set(left) == {"s0", "s3", "s4", "s5"} and left["s0"].sources == ["p0", "p1", "p2"] and left["s0"].note == "n"
    seen = extraction.visible(s, spark.createDataFrame([("d", 0), ("d", 9)], "doc_id string, chunk int"), 3)
    assert {(r.chunk, r.id) for r in seen.collect()} == {(0, "s0"), (0, "s1"), *((9, f"s{i}") for i in range(6))}


def mend(spark, d, merged=()):
    s = spark.createDataFrame([("d", x["id"]) for x in d["statements"]], "doc_id string, id string")
    a = spark.createDataFrame([("d", i, x["id"], x["premises"], x["conclusions"]) for i, x in enumerate(d["arguments"])], "doc_id string, ord int, id string, premises array<string>, conclusions array<string>")
    m = spark.createDataFrame([("d", *x) for x in merged], "doc_id string, dropped string, kept string") if merged else None
    out, log = extraction.repaired(s, a, m)
    return out.orderBy("ord").collect(), [x for r in log.orderBy("ord").collect() for x in r.lines]


def test_repair(spark):
    d = doc([("rain", "R"), ("wet", "W"), ("cold", "C")], [
        ("a", ["Rain!", "old", "rain"], ["wet"]), ("b", ["rain", "cold"], ["wet"]), ("a", ["nope"], ["wet", "wet"]), ("c", [], ["nope"]),
    ])
    out, log = mend(spark, d, [("old", "older"), ("older", "cold")])
    assert [(a["id"], a["premises"], a["conclusions"]) for a in out] == [("a", ["rain", "cold"], ["wet"]), ("a-2", [], ["wet"])]
    assert log == [
        "argument a: premise Rain! normalised to rain", "argument a: premise old merged into cold", "argument a: collapsed duplicate ids",
        "argument b: dropped (same premises and conclusions as an earlier argument)",
        "argument a: dropped unknown premise(s) nope", "argument a: collapsed duplicate ids", "argument a: renamed to a-2 (duplicate id)",
        "argument c: dropped unknown conclusion(s) nope", "argument c: dropped (no valid conclusion left)",
    ]
    assert out[1].repairs == ["dropped unknown premise(s) nope", "collapsed duplicate ids", "renamed from a (duplicate id)"]


def test_repeats_on_both_sides_are_told_once_after_the_conclusions(spark):
    notes = lambda p, c: [x.removeprefix("argument a: ") for x in mend(spark, doc([("x", "X"), ("c", "C")], [("a", p, c)]))[1]]
    assert notes(["x", "x"], ["c", "C"]) == ["conclusion C normalised to c", "collapsed duplicate ids"]
    assert notes(["x", "x"], ["c", "zz", "zz"]) == ["collapsed duplicate ids", "dropped unknown conclusion(s) zz, zz"]
    assert notes(["X!", "x", "y"], ["c"]) == ["premise X! normalised to x", "dropped unknown premise(s) y", "collapsed duplicate ids"]
    assert notes([], ["c"]) == []


def test_chains_and_rings_of_merges(spark):
    d = doc([("end", "E"), ("b", "B")], [("a", ["one", "Three"], ["end"]), ("x", ["r1"], ["b"])])
    out, log = mend(spark, d, [("one", "two"), ("two", "three"), ("three", "end"), ("r1", "r2"), ("r2", "r1")])
    assert [a["premises"] for a in out] == [["end"], []]
    assert log == ["argument a: premise one merged into end", "argument a: premise Three normalised and merged into end", "argument a: collapsed duplicate ids", "argument x: dropped unknown premise(s) r1"]


def test_recording_and_replay(spark):
    ask = spark.createDataFrame([("d", 0, "h0", "first prompt"), ("d", 1, "h1", "x" * 200)], "doc_id string, call_index int, request_hash string, user string")
    got = spark.createDataFrame([("d", 0, "m", '{"statements": [1, {"a": "b"}]}', (3, 4)), ("d", 1, "m", "{}", (5, 6))], "doc_id string, call_index int, model string, response string, usage struct<input_tokens: long, output_tokens: long>")
    lines = extraction.record(ask, got)
    rows = [json.loads(r.value) for r in lines.orderBy("call_index").collect()]
    assert rows[0] == {"index": 0, "request_hash": "h0", "model": "m", "user_preview": "first prompt", "usage": {"input_tokens": 3, "output_tokens": 4}, "response": {"statements": [1, {"a": "b"}]}}
    assert len(rows[1]["user_preview"]) == 160
    back = extraction.recorded(lines)
    assert [r.agrees for r in extraction.replay(ask, back, strict=True).collect()] == [True, True]
    assert extraction.usage(back).first().output_tokens == 10
    other = ask.withColumn("request_hash", F.lit("other"))
    assert not any(r.agrees for r in extraction.replay(other, back).collect())
    for bad, what in ((other, "differs"), (ask.withColumn("call_index", F.lit(7)), "no response")):
        with pytest.raises(documents.LoadError, match=what):
            extraction.replay(bad, back, strict=True)


def test_extraction_end_to_end(spark):
    docs = spark.createDataFrame([("d", "# H\n\nIt rains.\n\nStreets are wet.")], "doc_id string, text string")
    statement = lambda text, slug: {"text": text, "mode": "is", "sources": ["p1"], "role": "stated", "note": "", "slug": slug}
    argument = lambda p, c, slug: {"premises": p, "conclusions": c, "justification": "so", "rule": "", "sources": ["p2"], "slug": slug}
    a = spark.createDataFrame([("d", 0, json.dumps({"statements": [statement("It rains", "rain"), statement("Rain falls", "falls"), statement("Streets are wet", "wet")]}))], "doc_id string, chunk int, response string")
    b = spark.createDataFrame([("d", 0, json.dumps({"arguments": [argument(["falls"], ["Wet"], "x")]}))], "doc_id string, seq int, response string")
    c = spark.createDataFrame([("d", 0, json.dumps({"arguments": [argument([], ["rain"], "y")]}))], "doc_id string, seq int, response string")
    merges = spark.createDataFrame([("d", 0, 0, "rain", ["falls"])], "doc_id string, seq int, batch int, keep string, drop array<string>")
    row = extraction.extract(docs, a, b, merges, c, budget=100, about={"tool": "t"}, header=lambda k: {"name": k}).first()
    out = json.loads(row.json)
    assert documents.problems_of(out) == []
    assert [(x["id"], x["premises"], x["conclusions"], x["meta"].get("origin")) for x in out["arguments"]] == [("x", ["rain"], ["wet"], None), ("y", [], ["rain"], "link")]
    told = out["meta"]["extraction"]
    assert told["repairs"] == row.log == ["argument x: premise falls merged into rain", "argument x: conclusion Wet normalised to wet"]
    assert told["merged"] == {"falls": "rain"} and told["link_pass"] and told["chunking"]["paragraphs"] == 2


def test_assembly(spark):
    s = spark.createDataFrame([("d", 0, "a", "A", "is", ["p1"], "stated", "")], "doc_id string, seq long, id string, text string, mode string, sources array<string>, role string, note string")
    reply = json.dumps({"arguments": [{"premises": [], "conclusions": ["a "], "justification": " because  so", "rule": "", "sources": ["[p1]", "x"], "slug": ""}]})
    keys = spark.createDataFrame([("d", "p1")], "doc_id string, key string")
    a = extraction.to_arguments(spark.createDataFrame([("d", 0, reply)], "doc_id string, seq int, response string"), keys)
    row = extraction.assemble(s, a, header=lambda key: {"name": key}).first()
    out = json.loads(row.json)
    assert documents.problems_of(out) == [] and out["name"] == "d" and row.log == []
    assert out["arguments"] == [{"id": "to-a", "premises": [], "conclusions": ["a"], "justification": "because so", "meta": {"sources": ["p1"]}}]


def test_reply_schemas():
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "l": {"type": "array", "items": {"enum": ["x"]}}}, "required": ["n"], "additionalProperties": False}
    assert extraction.schema_problems({"n": 1, "l": ["x"]}, schema) == []
    assert extraction.schema_problems({"n": True, "l": ["y"], "z": 1}, schema) == ["$.n: expected integer, got bool", "$.l[0]: 'y' is not one of ['x']", "$: unexpected field 'z'"]
    assert extraction.schema_problems({}, schema) == ["$: missing required field 'n'"]


# Rendering, commands, streams.


def test_labels_are_wrapped_and_quoted(spark):
    d = doc([("a", 'say "hi" \\ and ' + "long words " * 6, "ought"), ("b", "  spaced  text\tx")], [("x", ["a"], ["b"])])
    c = corpus_of(spark, {"d": d})
    dot = rendering.to_dot(c, width=20).first().text
    assert 'label="a\\nsay \\"hi\\" \\\\ and long\\nwords long words\\n' in dot and "peripheries=2" in dot
    assert "#quot;hi#quot;" in rendering.to_mermaid(c).first().text
    with pytest.raises(ValueError):
        rendering.to_dot(c, width=0)


def test_commands(spark, tmp_path, capsys):
    a, b, bad, out = (str(tmp_path / f"{n}.json") for n in ("a", "b", "bad", "out"))
    for path, d in ((a, cycle()), (b, edited(cycle(), 4, "Q2")), (bad, {"format": "x"})):
        with open(path, "w") as f:
            json.dump(d, f)

    def run(*args):
        code = cli.main(list(args), spark)
        got = capsys.readouterr()
        return code, got.out, got.err

    assert run("validate", a)[0] == 0
    assert run("validate", bad)[0] == 1 and "missing required field 'version'" in run("validate", bad)[2]
    assert run("rests-on", a, "ghost")[0] == 2
    code, text_, _ = run("rests-on", a, "q", "--depth", "1")
    assert code == 0 and text_ == "q: Q\n  <- z-q\n      z: Z  [cycle: x, y, z; depth limit]\n\nclosure: 4 statements, 5 arguments\ncycle: x, y, z\n"
    assert json.loads(run("--json", "sccs", a)[1])[0]["members"] == ["x", "y", "z"]
    assert run("foundations", a)[1] == "p [is]: P\n"
    assert "must grant (1 foundations)" in run("plan", a, "q", "--given", "x,y")[1] or run("plan", a, "q", "--given", "x,y")[0] == 0
    assert run("lint", "all", a)[1].startswith("well-founded: 0 ungrounded\nduplicates: 0 group(s)\n")
    assert run("stats", a)[1].startswith("statements: 5 (5 is, 0 ought)\n")
    assert "  + q: Q2\n  - q: Q\n" in run("diff", a, b)[1]
    assert run("merge", a, a, b, "-o", out)[0] == 0 and json.load(open(out))["statements"][4]["text"] == "Q2"
    assert run("export", a, "--format", "mermaid")[1].startswith("flowchart LR\n")
    assert run("present", a, "q")[1].startswith("# Q\n")
    assert run("ids", a)[1].startswith("statements  (id  prop_id  just_id)\n  p  ")
    assert json.loads(run("schema")[1])["type"] == "object"


def test_stream_of_versions(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [("d", 1, cycle()), ("d", 2, edited(cycle(), 4, "Q2")), ("e", 1, {"format": "x"})]
    for i, (k, v, d) in enumerate(rows):
        (source / f"{i}.json").write_text(json.dumps({"doc_id": k, "version": v, "json": json.dumps(d)}) + "\n")
    stream = changes.read_documents(spark, str(source))
    query = changes.document_changes(stream).writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    got = {(r.doc_id, r.version, r.status, r.kind, r.id) for r in spark.table("changes").collect()}
    assert ("d", 2, "added", "statement", "q") in got and ("d", 2, "removed", "statement", "q") in got
    assert ("d", 2, "identical", "statement", "p") in got and ("e", 1, "invalid", "document", None) in got
    assert not any(x[1] == 1 and x[2] == "rejustified" for x in got)


def test_late_versions_are_ignored():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, step = State(), lambda v, d: list(changes._step(("d",), iter([pd.DataFrame({"version": [v], "json": [json.dumps(d)]})]), state))[0]
    assert len(step(3, cycle())) == 10
    assert len(step(2, edited(cycle(), 0, "late"))) == 0
    assert set(step(4, edited(cycle(), 0, "P2"))["status"]) == {"added", "removed", "rejustified"}
    assert state.get[0] == 4
