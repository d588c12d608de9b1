import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from sluice.functions import arrays, dates, documents, formats, numbers, paths, strings
from sluice.operators import tables as T
from sluice.plans import queries
from sluice.sources import documents as readers
from sluice.sources import sinks

DIR = "/root/testdata/sf0.001"


def test_updates(one):
    doc = ("string", '{"foo":[0,1,2,3,4,5],"b":{"c":1.5}}')
    assert one(documents.update("d", ["foo", ...], lambda v: v if v % 2 == 0 else documents.GONE), d=doc) == '{"foo":[0,2,4],"b":{"c":1.5}}'
    assert one(documents.assign("d", ["foo", slice(1, -1)], []), d=doc) == '{"foo":[0,5],"b":{"c":1.5}}'
    assert one(documents.compound("d", ["b", "c"], "+", 1), d=doc) == '{"foo":[0,1,2,3,4,5],"b":{"c":2.5}}'
    assert one(documents.compound("d", ["foo"], "-", [1, 2, 3, 4]), d=doc) == '{"foo":[0,5],"b":{"c":1.5}}'
    assert one(documents.compound("d", ["b"], "*", {"c": None, "x": {"y": 1}}), d=doc) == '{"foo":[0,1,2,3,4,5],"b":{"c":null,"x":{"y":1}}}'
    assert one(documents.compound("d", ["new"], "//", "x"), d=("string", "{}")) == '{"new":"x"}'
    assert one(documents.update("d", ["a"], lambda _: documents.GONE), d=("string", '{"a":1,"b":2}')) == '{"b":2}'
    assert one(documents.update("d", ["a"], lambda v: v), d=("string", None)) is None
    for path, value in ((["x", 999999999], 1), ([-1], 0), (["foo", "x"], 1)):
        with pytest.raises(PythonException):
            one(documents.assign("d", path, value), d=doc if path[0] != -1 else ("string", "[]"))


def test_operators_on_values():
    assert documents.plus(None, 1) == 1 and documents.plus("a", "b") == "ab" and documents.plus({"a": 1}, {"a": 2}) == {"a": 2}
    assert documents.times("ab", 2) == "abab" and documents.times("ab", 0) is None and documents.over("a,b", ",") == ["a", "b"]
    assert documents.modulo(-7, 3) == -1 and documents.minus([1, "1", None], [None]) == [1, "1"]
    for f, a, b in ((documents.plus, {}, []), (documents.over, 1, 0), (documents.minus, "a", "b"), (documents.modulo, 1, 0)):
        with pytest.raises(ValueError):
            f(a, b)


def test_order_of_values(spark):
    order = ["null", "false", "true", "-1e300", "-2", "0", "0.5", "3", "1e17", '""', '"a"', '"a\\u0000"', '"ab"', '"é"', '"🙂"', "[]", "[null]", "[1]", "[1,0]", '["a"]', "{}", '{"a":1}', '{"a":2}', '{"a":0,"b":0}', '{"b":0}']
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(order)], "i int, d string").repartition(4)
    assert [r["i"] for r in rows.orderBy(documents.order_key("d")).collect()] == list(range(len(order)))
    same = spark.createDataFrame([('{"a":1,"b":2.0}',), ('{"b":2,"a":1.0}',)], "d string")
    assert same.select(documents.order_key("d").alias("k")).distinct().count() == 1


def test_containment_and_keys(one):
    doc = ("string", '{"user":{"name":"alice","active":true},"tags":["ops","prod"]}')
    assert one(documents.contains("d", {"user": {"name": "lic"}, "tags": ["pro"]}), d=doc) is True
    assert one(documents.contains("d", {"user": {"name": "bob"}}), d=doc) is False
    assert one(documents.contains("d", F.lit('{"tags":[]}')), d=doc) is True
    assert documents.holds(1, 1.0) and not documents.holds(1, True) and not documents.holds([1], 1)
    assert one(documents.has("d", "tags"), d=doc) is True
    for key, is_in in ((1.0, True), (1.5, False), (float("nan"), False), (3, False), (-1, False)):
        assert one(documents.has("d", key), d=("string", "[0,1,2]")) is is_in
    assert one(documents.type_of("d"), d=("string", ' "x"')) == "string" and one(documents.type_of("d"), d=("string", None)) is None


def test_shapes(one):
    doc = ("string", '{"old":1,"new":2,"keep":3,"items":[{"old":4},{"k":6}]}')
    assert one(documents.rename("d", ["old"], "new"), d=doc) == '{"new":1,"keep":3,"items":[{"old":4},{"k":6}]}'
    assert one(documents.rename("d", ["items", ..., "old"], "x"), d=doc) == '{"old":1,"new":2,"keep":3,"items":[{"x":4},{"k":6}]}'
    assert one(documents.pick("d", ["items", 1], ["none"]), d=doc) == '{"items":[null,{"k":6}],"none":null}'
    assert one(documents.omit("d", ["items", slice(0, 1)], ["none"]), d=doc) == '{"old":1,"new":2,"keep":3,"items":[{"k":6}]}'
    for depth, out in ((3, "[0,1,2,3]"), (2, "[0,1,2,[3]]"), (1, "[0,1,[2],[[3]]]"), (0, "[0,[1],[[2]],[[[3]]]]")):
        assert one(documents.flatten("d", depth), d=("string", "[0,[1],[[2]],[[[3]]]]")) == out
    with pytest.raises(ValueError):
        documents.flatten("d", -1)
    events = ("array<string>", ['[[0],"a"]', '[[1,0],"b"]', "[[1,0]]", "[[1]]"])
    assert one(documents.from_stream(documents.truncate_stream("e", 1)), e=events) == ['["b"]']
    assert one(documents.from_stream("e"), e=("array<string>", ["[[],3]", "[[0],1]", "[[0]]"])) == ["3", "[1]"]
    assert one(documents.indented("d"), d=("string", '{"a":[1,{}],"b":[]}')) == '{\n  "a": [\n    1,\n    {}\n  ],\n  "b": []\n}'
    assert one(paths.set_path("d", ["é", 1], 2), d=("string", "null")) == '{"é":[null,2]}'


def test_patterns(one):
    assert one(strings.scan("s", "(a)|(b)"), s=("string", "ab")) == [["a", None], [None, "b"]]
    assert one(strings.capture("s", "(?<x>a*)(?<y>c)?"), s=("string", "bb")).asDict() == {"x": "", "y": None}
    assert one(strings.sub("s", "(?<=a)b", "X"), s=("string", "ab ab")) == "aX ab"
    assert one(strings.sub("s", r"(\w)\1", "<$1$0>"), s=("string", "x aa bb")) == "x <aaa> bb"
    assert one(strings.sub("s", "z", "y"), s=("string", "none")) == "none"
    assert [m["string"] for m in one(strings.match("s", r"\p{L}+", "g"), s=("string", "é1ü"))] == ["é", "ü"]
    assert one(strings.slug("s"), s=("string", "Ünïcode Text")) == "ünïcode-text"
    assert one(strings.words("s"), s=("string", "HTTPServer42x éÀ漢字A")) == ["HTTP", "Server", "42", "x", "é", "À漢字A"]
    assert one(strings.index("s", "zz"), s=("string", "a")) is None and one(strings.rindex("s", "a"), s=("string", "aba")) == 2
    for version, part, out in (("1.2.3-rc.1", "patch", "1.2.4"), ("1.2.3", "prerelease", "1.2.3-rc.1"), ("1.2.3-rc", "prerelease", "1.2.3-rc.1"), ("1.2.3-rc.9", "prerelease", "1.2.3-rc.10"), ("x", "major", None)):
        assert one(strings.semver_bump("s", part), s=("string", version)) == out


def test_values(one):
    assert one(arrays.difference("a", F.array(F.lit(None).cast("int"))), a=("array<int>", [1, 2, None])) == [1, 2]
    assert one(arrays.alternative(F.lit("false"), F.lit("x"))) == "false" and one(arrays.alternative(F.lit(False), F.lit(True))) is True
    assert one(arrays.indices("a", F.array(F.lit(1), F.lit(1))), a=("array<int>", [1, 1, 1])) == [0, 1]
    assert one(arrays.flatten_to("a", 0), a=("array<array<int>>", [[1]])) == [[1]]
    assert one(numbers.trigonometric("acos", F.lit(2.0))) is None and abs(one(numbers.trigonometric("tan", F.lit(2.0))) + 2.185039863261519) < 1e-14
    assert one(numbers.exp2(F.lit(3.0))) == 8 and one(numbers.log10(F.lit(0.0))) == -1.7976931348623157e308 and one(numbers.modulo(F.lit(float("nan")), F.lit(2))) is None
    assert one(formats.filled("uri", "x={}&y={}", F.lit("a b"), F.lit("c/d"))) == "x=a%20b&y=c%2Fd"
    assert one(formats.sh_words("a"), a=("array<string>", ["a b", "it's"])) == "'a b' 'it'\\''s'"


def test_dates_in_any_time_zone(spark, one):
    for zone in ("America/New_York", "Asia/Kolkata", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for s in (1425599621, 1520749800, 0, -1, 253402300799):  # the second one is in an hour that New York leaves out
                text = one(dates.todate("x"), x=("long", s))
                assert one(dates.fromdate("t"), t=("string", text)) == s
                assert one(dates.strftime("x", "%Y-%m-%dT%H:%M:%SZ"), x=("long", s)) == text
                assert one(dates.mktime(dates.gmtime("x")), x=("long", s)) == s
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert one(dates.strftime("x", "%a %e %p %D"), x=("long", 0)) == "Thu  1 AM 01/01/70"


def test_exact_percentiles(spark):
    rows = spark.createDataFrame([(k, v) for k in ("a", None) for v in [5.0, 1.0, 1.0, 1e9, -3.0, None] + [2.0] * 300] + [("one", 7.0), ("none", None)], "k string, v double").repartition(4)
    exact = {r["k"]: (r["p"], r["q"]) for r in rows.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("p"), F.percentile("v", F.lit(0.995)).alias("q")).collect()}
    got = T.statistics(rows, ["k"], "v", (50, 99.5))
    assert {r["k"]: (r["p50"], r["p99.5"]) for r in got.collect()} == exact


def test_deep_recursion_and_ranges(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(13)], "p int, c int")
    found = T.recurse(edges, spark.createDataFrame([(0,)], "n int"), "p", "c")
    assert {(r["node"], r["depth"]) for r in found.collect()} == {(i, i) for i in range(14)}
    assert T.recurse(edges, spark.createDataFrame([(0,)], "n int"), "p", "c", rounds=2).count() == 3
    points, ranges = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 9.99, 10.0, 35.0)], "x double"), spark.createDataFrame([(0.0, 10.0), (-5.0, 100.0), (3.0, 3.0)], "lo double, hi double")
    assert sorted((r["x"], r["lo"]) for r in T.range_join(points, "x", ranges, "lo", "hi", 7).collect()) == [(-1.0, -5.0), (0.0, -5.0), (0.0, 0.0), (9.99, -5.0), (9.99, 0.0), (10.0, -5.0), (35.0, -5.0)]


def test_tsv_and_tables(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("a\\\\t\\x\t\0\n")
    assert readers.read_tsv(spark, str(tmp_path / "a.tsv")).first()["row"] == ["a\\t\\x", "\0"]
    (tmp_path / "b.tsv").write_text("ok\\\\\ta\\\n")
    with pytest.raises(Exception, match="trailing escape"):
        readers.read_tsv(spark, str(tmp_path / "b.tsv")).collect()
    with pytest.raises(Exception, match="NUL"):
        sinks.write_lines(spark.createDataFrame([("a\0b",)], "value string"), str(tmp_path / "nul"), "\0")
    assert sinks.table(spark.range(5), 2).splitlines()[-1] == "(the first 2 rows)"
    assert readers.format_of("a", "1\n2\n") == "yaml" and readers.format_of("a", "a,b\n1,2\n") == "csv" and readers.format_of("a", "a\tb\n1\t2\n") == "tsv"
    assert readers.format_of("a", "x = 1\n") == "toml" and readers.format_of("a.json", '{"a":1}\n{"b":2}\n') == "jsonl" and readers.format_of("a.json", "no json", "extension") == "json"
    docs = spark.createDataFrame([('{"a":1}',)], "doc string")
    assert sinks.to_json(docs).first()["value"] == '{\n  "a": 1\n}' and sinks.to_json(docs, width=None).first()["value"] == '{"a":1}'


def test_all_hours_of_a_stream(spark, tmp_path):
    """Events that all lie in one hour, whose window never closes."""
    spark.createDataFrame([(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 10:59:00", "a")], "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in queries.stream_counts(spark, str(tmp_path)).collect()] == [("2024-01-01 10:00:00", "a", 2)]


def test_every_part_and_toml(spark, one):
    import tomllib

    doc = '{"a":[1.5,true],"t":{"x":"q\\"\\n","e":{},"u":[{"n":1},{"n":2}]},"é":[],"m":[{"k":1},2]}'
    text = one(documents.toml("d"), d=("string", doc))
    assert tomllib.loads(text) == {"a": [1.5, True], "t": {"x": 'q"\n', "e": {}, "u": [{"n": 1}, {"n": 2}]}, "é": [], "m": [{"k": 1}, 2]}
    for wrong in ("[1]", '{"a":null}'):
        with pytest.raises(PythonException):
            one(documents.toml("d"), d=("string", wrong))
    assert one(documents.values("d"), d=("string", "[1,[]]")) == ["[1,[]]", "1", "[]"]
    assert one(documents.parse("s", "tsv"), s=("string", "a\t\n\nb\n")) == ['["a",""]', '["b"]']
    rows = spark.createDataFrame([(2, ["x", "1"]), (1, ["k", "v"]), (3, ["y"])], "i int, row array<string>")
    assert sorted(r["doc"] for r in readers.csv_header(rows, ["i"]).collect()) == ['{"k":"x","v":"1"}', '{"k":"y","v":null}']
    numbers_ = spark.createDataFrame([(i,) for i in range(7)], "i int")
    assert sorted(r["i"] for r in T.skip(numbers_, 5, ["i"]).collect()) == [5, 6] and T.skip(numbers_, 9, ["i"]).count() == 0 and T.nth(numbers_, 9, F.asc("i")).count() == 0
    assert one(strings.cut("s", -2, None), s=("string", "é🙂x")) == "🙂x" and one(strings.cut("s", 2, 1), s=("string", "abc")) == ""
    assert one(arrays.cut("a", 0.5, 1.5), a=("array<int>", [1, 2, 3])) == [1, 2] and one(arrays.cut("a", F.lit(-1)), a=("array<int>", [1, 2, 3])) == [3]
    assert one(strings.capture_all("s", "(?<x>a)|(?<y>b)"), s=("string", "ab")) == [{"x": "a", "y": None}, {"x": None, "y": "b"}]


def test_equal_documents_of_a_batch_are_worked_on_once(spark):
    seen = []
    assert paths.each_once(["a", None, "b", "a", None, "a"], lambda t: seen.append(t) or t + "!") == ["a!", None, "b!", "a!", None, "a!"]
    assert seen == ["a", "b"]
    rows = spark.range(0, 2000, 1, 1).selectExpr("id", "if(id % 7 = 0, null, array('{\"k\":{\"a\":' || id % 3 || '}}', null, '{\"k\":{\"b\":1.50}}')) docs")
    for r in rows.select("id", documents.merge_all("docs").alias("deep"), documents.merge_all("docs", deep=False).alias("shallow")).collect():
        assert r["deep"] == (None if r["id"] % 7 == 0 else f'{{"k":{{"a":{r["id"] % 3},"b":1.50}}}}')
        assert r["shallow"] == (None if r["id"] % 7 == 0 else '{"k":{"b":1.50}}')
