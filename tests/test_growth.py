"""What grows with the input is dealt out once: plans without joins back, kernels without what nobody asked for."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from arggraph_spark.operators import extraction, graph, identity, large, rendering, reports, versions
from arggraph_spark.plans import registry  # noqa: F401  before mapping
from arggraph_spark.sources import corpus as corpora
from arggraph_spark.sources.mapping import orders_corpus


def _doc(n: int) -> dict:
    s = [{"id": f"s{i}", "text": f"T{i % 3}", "mode": "is"} for i in range(n)]
    a = [{"id": f"a{i}", "premises": [f"s{i}"], "conclusions": [f"s{i + 1}", f"s{(i + 2) % n}"], "justification": "j", "rule": None} for i in range(n - 1)]
    return {"statements": s, "arguments": a}


def _corpus(spark):
    return corpora.corpus_of(spark, {"x": _doc(4), "y": _doc(7), "z": {"statements": [{"id": "s0", "text": "T", "mode": "is"}], "arguments": []}})


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_of_a_document_meet_in_one_shuffle(spark):
    plan = _plan(_corpus(spark).nested())
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


def test_corpora_are_made_of_the_tables_once(spark):
    assert "lineitem.parquet" not in "".join(orders_corpus(spark, "/root/testdata/sf0.001").nested().inputFiles())


def test_arrow_values_by_columns():
    rows = [{"a": [{"b": "x", "c": 1, "d": ["p", None]}, None], "e": None}, {"a": None, "e": 2}, {"a": [], "e": 3}, {"a": [{"b": None, "c": 4, "d": None}], "e": 4}]
    t = pa.RecordBatch.from_pylist(rows).to_struct_array()
    assert corpora._values(t) == rows and corpora._values(t[1:3]) == rows[1:3] and corpora._values(t[3:]) == rows[3:] and corpora._values(t[:0]) == []


def test_components_of_many_documents_at_once():
    rows = pd.DataFrame({"doc_id": ["x", "x", "y", "y"], "s": [1, 2, 1, 2], "t": [2, 1, 2, 3], "key": ["x", "x", "y", "y"]})
    out = large._strong_arrays(rows)
    assert {tuple(r) for r in out.itertuples(index=False)} == {("x", 1, 2), ("x", 2, 2), ("y", 1, 1), ("y", 2, 2), ("y", 3, 3)}


def test_walks_without_reports_are_the_same(spark):
    c = _corpus(spark)
    given = c.statements.filter("ord = 2").select("doc_id", "id")
    pairs = [(f(c), f(c, report=False)) for f in (reports.rests_on, reports.supports)] + [(reports.plan(c, given=given), reports.plan(c, given=given, report=False))]
    for told, bare in pairs:
        assert "report" not in bare.columns
        assert sorted(map(str, told.drop("report").collect())) == sorted(map(str, bare.collect()))


def test_focus_by_the_kernel_equals_joins(spark):
    c = _corpus(spark)
    seeds = c.statements.select("doc_id", "id").union(spark.createDataFrame([("none", "lost")], "doc_id string, id string"))
    for direction in ("up", "down", "both"):
        for depth in (0, 1, 3):
            found = graph.focus(c, seeds, depth, direction)
            assert sorted(found.collect()) == sorted(graph._focus_by_joins(c, seeds, depth, direction).collect())


def test_sides_of_a_merge_meet_without_joins(spark):
    c = _corpus(spark)
    for items in versions.merge_items(c, c, c, plain=True):
        assert "Join" not in _plan(items)


def test_versions_are_matched_without_joins(spark):
    c = _corpus(spark)
    ids = identity.statement_ids(c)
    found = versions.diff_statements(c, c, ids, ids)
    assert "Join" not in _plan(found)
    assert found.filter("status <> 'identical' or id_a is null").count() == 0 and found.count() == c.statements.count()


def test_what_has_no_key_is_matched_with_nothing(spark):
    t = spark.createDataFrame([("x", "s", 0, None), ("x", "t", 1, "k")], "doc_id string, id string, ord int, k string")
    out = versions._status(versions._matched(versions._sided(t, t, "k"), "k"), "same", rest=True)
    assert sorted((r.status, r.id_a, r.id_b) for r in out.collect()) == [("added", None, "s"), ("removed", "s", None), ("same", "t", "t")]


def test_layers_by_a_column(spark):
    d = {"statements": [{"id": f"s{i}", "text": f"T{i}", "mode": "is"} for i in range(6)], "arguments": [{"id": "a", "premises": ["s0", "s1"], "conclusions": ["s2", "s3"], "justification": " j"}, {"id": "b", "premises": ["s2"], "conclusions": ["s4"], "justification": ""}, {"id": "c", "premises": [], "conclusions": ["s1"], "justification": "k"}]}
    c = corpora.corpus_of(spark, {"x": d})
    just, hashes = identity.layered_identities(c, F.floor(F.col("ord") / 2).cast("int"), 3)
    assert {(r.id, r.ord, r.just_id) for r in just.collect()} == {(r.id, r.ord, r.just_id) for r in identity.statement_ids(c).collect()}
    assert {(r.arg, r.arg_hash) for r in hashes.collect()} == {(r.id, r.arg_hash) for r in identity.argument_hashes(c).collect()}
    assert "Join" not in _plan(hashes)


def test_statements_near_a_chunk_need_no_distinct(spark):
    s = spark.createDataFrame([("x", "s", [0, 1, 1]), ("x", "t", [5]), ("x", "u", [])], "doc_id string, id string, chunks array<int>")
    chunks = spark.createDataFrame([("x", k) for k in range(9)], "doc_id string, chunk int")
    out = extraction.visible(s, chunks, 2)
    assert not [x for x in _plan(out).splitlines() if "Aggregate" in x and "chunk" in x]
    everything = {(k, i) for k in (3, 7, 8) for i in "stu"}
    assert sorted((r.chunk, r.id) for r in out.collect()) == sorted({(0, "s"), (1, "s"), (2, "s"), (4, "t"), (5, "t"), (6, "t")} | everything)


def test_lines_of_a_drawing_meet_without_joins(spark):
    c = _corpus(spark)
    lines = rendering.dot_lines(c).localCheckpoint()
    assert "Join" not in _plan(rendering._gathered(c, lines, F.array(F.lit("head")), F.array(F.lit("foot"))))
    assert rendering.to_dot(c).count() == 3


def test_documents_are_written_after_one_shuffle(spark):
    from pyspark.sql.functions import col

    from arggraph_spark.sources import documents

    c = _corpus(spark)
    out = documents.to_json(c, None)
    assert "Join" not in _plan(out) and _plan(out).count("RepartitionByExpression") == 1
    back = documents.parse(out)
    assert sorted(r.id for r in back.statements.filter(col("doc_id") == "y").collect()) == [f"s{i}" for i in range(7)] and not back.problems.count()
