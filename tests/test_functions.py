from pyspark.sql import functions as F

from sluice.functions import arrays, dates, formats, numbers, paths, strings


def test_strings(one):
    s = ("string", " aXbxa ")
    assert one(strings.trim("s"), s=s) == "aXbxa"
    assert one(strings.indices("s", "aa"), s=("string", "aaa")) == [0, 1]
    assert one(strings.indices("s", ""), s=("string", "aaa")) == []
    assert one(strings.split_on("s", "."), s=("string", "a.b.")) == ["a", "b", ""]
    assert one(strings.split_on("s", "."), s=("string", "")) == []
    assert one(strings.join_values("a", ","), a=("array<string>", ["a", None, "2"])) == "a,,2"
    assert one(strings.rtrimstr("s", ".json"), s=("string", "a.json")) == "a"
    assert one(strings.from_code_points("a"), a=("array<int>", [8364, 65, 0xD800])) == "€A�"
    assert one(strings.code_points("s"), s=("string", "€A")) == [8364, 65]
    assert one(strings.repeat("s", F.col("n")), s=("string", "ab"), n=("double", 1.5)) == "ab"
    assert one(strings.repeat("s", F.col("n")), s=("string", "ab"), n=("double", -1.0)) is None


def test_regex(one):
    s = ("string", "foo bar foo")
    assert one(strings.sub("s", "fo+", "<$0>"), s=s) == "<foo> bar foo"
    assert one(strings.sub("s", "FO+", "", "gi"), s=s) == " bar "
    assert one(strings.scan("s", "(f)(o+)"), s=s) == [["f", "oo"], ["f", "oo"]]
    assert one(strings.capture("s", "(?<a>b)(?<b>z)?"), s=s).asDict() == {"a": "b", "b": None}
    found = one(strings.match("s", "(?<x>o+)", "g"), s=s)
    assert [(m["offset"], m["length"], m["captures"][0]["name"]) for m in found] == [(1, 2, "x"), (9, 2, "x")]
    assert one(strings.splits("s", "o+ ?"), s=s) == ["f", "bar f", ""]


def test_cases(one):
    s = ("string", "HTTPServer errorCode42 x")
    assert one(strings.kebab_case("s"), s=s) == "http-server-error-code-42-x"
    assert one(strings.camel_case("s"), s=s) == "httpServerErrorCode42X"
    assert one(strings.slug("s"), s=("string", " A  b! ")) == "a-b"


def test_semver_order(spark):
    versions = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0"]
    frame = spark.createDataFrame([(v,) for v in reversed(versions)], "v string")
    assert [r["v"] for r in frame.orderBy(strings.semver_key("v")).collect()] == versions


def test_formats(one):
    assert one(formats.csv_row("a"), a=("array<string>", ['a"b', None])) == '"a""b",'
    assert one(formats.tsv_row("a"), a=("array<string>", ["a\tb\\", "\n"])) == "a\\tb\\\\\t\\n"
    assert one(formats.html("s"), s=("string", "<&'\">")) == "&lt;&amp;&apos;&quot;&gt;"
    assert one(formats.uri("s"), s=("string", "a b*~/é")) == "a%20b%2A~%2F%C3%A9"
    assert one(formats.from_uri("s"), s=("string", "a+b%20")) == "a+b "
    assert one(formats.sh("s"), s=("string", "it's")) == "'it'\\''s'"
    assert one(formats.shell_escape("s"), s=("string", "")) == "''"
    text = "x" * 100
    assert one(formats.from_base64(formats.base64("s", urlsafe=True, pad=False)), s=("string", text)) == text


def test_numbers(one):
    assert one(numbers.modulo("x", F.lit(-3)), x=("double", -7.9)) == -1
    assert one(numbers.log("x"), x=("double", 0.0)) == -1.7976931348623157e308
    assert one(numbers.sqrt("x"), x=("double", -1.0)) is None
    assert one(numbers.to_number("s"), s=("string", " 4")) is None
    assert one(numbers.to_number("s"), s=("string", "-1.5e3")) == -1500.0


def test_arrays(one):
    a = ("array<int>", [3, 1, 2, 1])
    assert one(arrays.cut("a", -3, -1), a=a) == [1, 2]
    assert one(arrays.cut("a", 3, 1), a=a) == []
    assert one(arrays.difference("a", F.array(F.lit(2))), a=a) == [3, 1, 1]
    assert one(arrays.sort_by_desc("a", lambda x: x % 2), a=a) == [3, 1, 1, 2]
    assert one(arrays.unique_by("a", lambda x: x % 2), a=a) == [2, 3]
    assert one(arrays.min_by("a", lambda x: x % 2), a=a) == 2 and one(arrays.max_by("a", lambda x: x % 2), a=a) == 1
    assert one(arrays.running("a", F.lit(0.0), lambda s, x: s + x), a=a) == [3, 4, 6, 7]
    assert one(arrays.numbers(5, 0, -2)) == [5, 3, 1] and one(arrays.numbers(1, 1)) == []
    assert one(arrays.bsearch("a", F.lit(4)), a=("array<int>", [1, 3, 5])) == -3
    assert one(arrays.transpose("a"), a=("array<array<int>>", [[1], [2, 3]])) == [[1, 2], [None, 3]]
    assert one(arrays.take_while("a", lambda x: x != 2), a=a) == [3, 1]
    assert one(arrays.add("a", 0), a=("array<int>", [])) is None
    assert len(one(arrays.combinations("a", "a"), a=a)) == 16
    m = ("map<string,int>", {"b": 1, "a": None})
    assert one(arrays.drop_nulls("m"), m=m) == {"b": 1}
    assert list(one(arrays.sort_keys("m"), m=m)) == ["a", "b"]
    assert one(arrays.merge("m", F.create_map(F.lit("b"), F.lit(9))), m=m) == {"a": None, "b": 9}
    assert one(arrays.rename_key("m", "b", "c"), m=m) == {"c": 1, "a": None}


def test_dates(one):
    assert one(dates.todate("x"), x=("double", 1425599621.678)) == "2015-03-05T23:53:41Z"
    assert one(dates.mktime("a"), a=("array<double>", [2024.0, 8.0, 21.0])) == 1726876800
    assert one(dates.gmtime("x"), x=("double", 1425599621.25)) == [2015, 2, 5, 23, 53, 41.25, 4, 63]
    assert one(dates.to_datetime("s").cast("string"), s=("string", "2024-02-03T04:05")) == "2024-02-03 04:05:00"
    assert one(dates.to_datetime("s"), s=("string", "soon")) is None


def test_paths(one):
    doc = ("string", '{"a":[{"b":1.50},null],"c":{}}')
    assert one(paths.get_path("d", ["a", 0, "b"]), d=doc) in ("1.5", "1.50")
    assert one(paths.set_path("d", ["a", 2, "x"], 7), d=doc) == '{"a":[{"b":1.50},null,{"x":7}],"c":{}}'
    assert one(paths.delete_paths("d", ["a", 0], ["a", -1], ["c", "none"]), d=doc) == '{"a":[],"c":{}}'
    assert one(paths.drop_nulls("d"), d=doc) == '{"a":[{"b":1.50}],"c":{}}'
    assert one(paths.merge("d", F.lit('{"c":{"z":1}}')), d=doc) == '{"a":[{"b":1.50},null],"c":{"z":1}}'
    assert [p["path"] for p in one(paths.paths("d"), d=doc)] == ['["a"]', '["a",0]', '["a",0,"b"]', '["a",1]', '["c"]']
    stream = [paths.load(e) for e in one(paths.to_stream("d"), d=doc)]
    assert paths.dump(paths.from_events(stream)) == doc[1]
    assert one(paths.walk("d", lambda v: v if not isinstance(v, list) else v[:1]), d=doc) == '{"a":[{"b":1.50}],"c":{}}'
    assert one(paths.set_path("d", ["a"], 1), d=("string", None)) is None
