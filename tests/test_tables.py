from pyspark.sql import functions as F

from sluice.operators import tables as T
from sluice.sources import documents, sinks
from sluice.streaming import lines


def test_group_and_unique(spark):
    rows = spark.createDataFrame([(1, "b", 2), (2, "a", 1), (3, "b", 1), (4, None, 5)], "i int, k string, v int")
    groups = {r["k"]: [x["i"] for x in r["rows"]] for r in T.group_by(rows, ["k"], ["i"]).collect()}
    assert groups == {"a": [2], "b": [1, 3], None: [4]}
    assert {r["i"] for r in T.unique_by(rows, ["k"], ["i"]).collect()} == {1, 2, 4}
    assert {r["i"] for r in T.extreme_by(rows, ["k"], "v", ["i"], greatest=True).collect()} == {1, 2, 4}


def test_histogram_edges(spark):
    same = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert [tuple(r) for r in T.histogram(same, "v", 5).collect()] == [(0, 2.0, 2.0, 2)]
    wide = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    assert [r["count"] for r in T.histogram(wide, "v", 4).orderBy("bin").collect()] == [1, 0, 0, 1]
    assert T.histogram(same.where("v > 9"), "v", 4).count() == 0


def test_index_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")
    indexed = T.index(a, "k", ["v"])
    assert {r["key"]: r["row"]["v"] for r in indexed.collect()} == {"1": "y", None: "z"}
    assert [r["match"] for r in T.join_index(a.where("k IS NULL"), indexed, "k").collect()] == [None]
    twice = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    assert sorted(str(r["k"]) for r in T.difference(twice, spark.createDataFrame([(1,)], "k int")).collect()) == ["2", "2", "None"]


def test_recurse(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (9, 8)], "p int, c int")
    found = T.recurse(edges, spark.createDataFrame([(1,)], "n int"), "p", "c")
    assert {(r["node"], r["depth"]) for r in found.collect()} == {(1, 0), (2, 1), (3, 1)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("kind: A\nat: 2024-01-02\n---\n---\nkind: B\n")
    docs = documents.read_yaml(spark, str(tmp_path / "a.yaml")).orderBy("doc_idx").collect()
    assert [r["doc"] for r in docs] == ['{"kind":"A","at":"2024-01-02"}', "null", '{"kind":"B"}']
    (tmp_path / "a.toml").write_text('x = 1.50\n[t]\nd = 2024-01-02\n')
    assert documents.read_toml(spark, str(tmp_path / "a.toml")).first()["doc"] == '{"x":1.50,"t":{"d":"2024-01-02"}}'
    (tmp_path / "a.json").write_text('﻿[1, {"a": 1.0}]\n')
    assert documents.read_json(spark, str(tmp_path / "a.json")).first()["doc"] == '[1,{"a":1.0}]'
    (tmp_path / "a.csv").write_text('a,"b ""c""\nd",\n1,2,3\n')
    assert [r["row"] for r in documents.read_csv(spark, str(tmp_path / "a.csv"), 3).collect()] == [["a", 'b "c"\nd', ""], ["1", "2", "3"]]
    (tmp_path / "a.tsv").write_text("a\\tb\t\\\\n\n")
    assert documents.read_tsv(spark, str(tmp_path / "a.tsv")).first()["row"] == ["a\tb", "\\n"]
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert documents.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    cells = spark.createDataFrame([("1",), ("x",), ("{}",), ("true",)], "c string")
    assert [r[0] for r in cells.select(documents.inferred("c")).collect()] == ["1", '"x"', '"{}"', "true"]


def test_format_of():
    assert documents.format_of("a.ndjson") == "jsonl"
    assert documents.format_of("a", '{"a":1}\n{"a":2}\n') == "jsonl"
    assert documents.format_of("a.csv", '{"a":1}', "sniff") == "json"
    assert documents.format_of("a", "k: v") == "yaml"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a"b', None)], "n int, s string, m double")
    assert sinks.to_jsonl(rows).first()["value"] == '{"n":1,"s":"a\\"b","m":null}'
    assert sinks.to_csv(rows).first()["value"] == '1,"a""b",'
    assert sinks.to_tsv(rows).first()["value"] == '1\ta"b\t'
    assert sinks.table(rows).splitlines()[0] == "n | s   | m"
    sinks.write_lines(sinks.to_tsv(rows), str(tmp_path / "out"), "\0")
    assert b'1\ta"b\t\0' in b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    docs = spark.createDataFrame([('{"b":1,"a":[1.5,null]}',)], "doc string")
    assert sinks.to_yaml(docs).first()["value"] == "---\nb: 1\na:\n- 1.5\n- null\n"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"a":1}\n\n{"a":2}\nnot json\n')
    stream = lines.stream_jsonl(spark, str(tmp_path / "in"), "a int")
    run = lines.write_stream(stream.select("a", "bad_line"), sinks.to_jsonl, str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination()
    out = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert out == ['{"a":1,"bad_line":null}', '{"a":2,"bad_line":null}', '{"a":null,"bad_line":"not json"}']


def test_any_all(spark):
    rows = spark.createDataFrame([(1, True), (1, None), (2, True)], "k int, v boolean")
    assert {tuple(r) for r in T.any_all(rows, ["k"], F.col("v")).collect()} == {(1, True, False), (2, True, True)}
