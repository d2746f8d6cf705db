"""The data source: files and lines, stretches, overwriting, aborted writes."""

import json

import pytest

from arggraph_spark.sources import datasource


@pytest.fixture
def source(spark):
    datasource.register(spark)
    return lambda path, **o: {r.doc_id: json.loads(r.json) for r in spark.read.format(datasource.NAME).options(**o).load(str(path)).collect()}


def test_lines_in_stretches(spark, source, tmp_path):
    rows = [(f"d{i}", json.dumps({"n": i, "x": "é" * i})) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id string, json string").repartition(3)
    frame.write.format(datasource.NAME).mode("append").save(f"file://{tmp_path}/out")
    want = {k: json.loads(v) for k, v in rows}
    for stretch in (30, 101, 10**6):
        assert source(f"file:{tmp_path}/out", stretch=stretch) == want
    frame.limit(2).write.format(datasource.NAME).mode("overwrite").save(str(tmp_path / "out"))
    assert len(source(tmp_path / "out")) == 2
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_files_and_nothing(spark, source, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    assert source(tmp_path / "in") == {}
    (tmp_path / "in" / "sub" / "a.json").write_text('{"a": 1}\n')
    (tmp_path / "in" / "_skip.json").write_text("{}")
    (tmp_path / "in" / "note.txt").write_text("x")
    assert source(tmp_path / "in") == {f"{tmp_path}/in/sub/a.json": {"a": 1}}
    assert source(tmp_path / "in" / "sub" / "a.json") == {f"{tmp_path}/in/sub/a.json": {"a": 1}}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    datasource.register(spark)
    frame = spark.createDataFrame([("a", "{}"), ("b", "no json")], "doc_id string, json string").repartition(2)
    with pytest.raises(Exception, match="Expecting value|JSONDecodeError|aborted"):
        frame.write.format(datasource.NAME).mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
