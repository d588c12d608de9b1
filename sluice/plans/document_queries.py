"""Queries on JSON documents of any shape, made of the event table, and on files of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import documents, formats, paths
from sluice.functions.documents import GONE
from sluice.operators import tables as T
from sluice.operators.scratch import new_folder
from sluice.plans.registry import query
from sluice.sources import documents as readers
from sluice.sources import sinks

#: The number in each event's properties, in SQL.
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
MIXED = f"""CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN CAST({K} AS VARCHAR) WHEN 3 THEN '"' || event_type || '"' WHEN 4 THEN '[' || {K} || ']' ELSE '{{"k":' || {K} || '}}' END"""


def k() -> Column:
    return paths.get_path("props", ["k"]).cast("long")


def mixed() -> Column:
    """Documents of all types."""
    kinds = [F.lit("null"), F.lit("true"), k().cast("string"), F.to_json(F.array("event_type")), F.to_json(F.array(k())), F.to_json(F.struct(k().alias("k")))]
    kinds[3] = F.regexp_replace(kinds[3], r"^\[|\]$", "")
    return F.element_at(F.array(*kinds), (F.col("event_id") % 6 + 1).cast("int"))


def four() -> Column:
    return F.to_json(F.array(F.col("event_id") % 3, F.col("user_id") % 3, k() % 3, F.lit(7)))


FOUR = f"[event_id % 3, user_id % 3, {K} % 3, 7]"


@query(f"""SELECT event_id, '{{"k":' || ({K} + 1) || '}}' AS doc FROM events""")
def update_with_function(t):
    return t("events").select("event_id", documents.update("props", ["k"], lambda v: v + 1).alias("doc"))


@query(f"""SELECT event_id, '[' || array_to_string(list_filter({FOUR}, lambda x: x <> 0), ',') || ']' AS doc FROM events""")
def update_takes_out(t):
    return t("events").select("event_id", documents.update(four(), [...], lambda v: v or GONE).alias("doc"))


@query(f"""SELECT event_id, '{{"k":' || {K} * 3 || ',"n":1}}' AS product, '{{"k":' || {K} % 7 || '}}' AS rest, '{{"k":' || {K} || ',"z":"none"}}' AS other FROM events""")
def compound_assignment(t):
    product = documents.compound(documents.compound("props", ["k"], "*", 3), ["n"], "+", 1)
    return t("events").select("event_id", product.alias("product"), documents.compound("props", ["k"], "%", 7).alias("rest"), documents.compound("props", ["z"], "//", "none").alias("other"))


@query("""SELECT event_id, '[' || event_id % 3 || ',"x",7]' AS doc FROM events""")
def slice_assignment(t):
    return t("events").select("event_id", documents.assign(four(), [slice(1, 3)], ["x"]).alias("doc"))


@query(f"""SELECT event_id, {K} = 7 AS same, event_type LIKE '%ew%' AS part, event_id % 3 = 2 OR user_id % 3 = 2 OR {K} % 3 = 2 AS element, {K} = 5 AS within FROM events""")
def contains_inside(t):
    kind = F.regexp_replace(F.to_json(F.array("event_type")), r"^\[|\]$", "")
    return t("events").select("event_id", documents.contains("props", {"k": 7}).alias("same"), documents.contains(kind, "ew").alias("part"), documents.contains(four(), [2]).alias("element"), documents.inside("props", {"k": 5, "z": 1}).alias("within"))


@query("""SELECT event_id, true AS k, false AS z, true AS third, false AS fifth, true AS named FROM events""")
def has_in(t):
    return t("events").select("event_id", documents.has("props", "k").alias("k"), documents.has("props", "z").alias("z"), documents.has(four(), 2).alias("third"), documents.has(four(), 4).alias("fifth"), documents.in_(F.lit("k"), "props").alias("named"))


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN {K} < 50 ELSE false END AS below FROM events""")
def document_order(t):
    return t("events").select("event_id", (documents.order_key(mixed()) < documents.order_key(F.lit("50"))).alias("below"))


@query(f"""SELECT doc, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, {MIXED} AS doc FROM events) GROUP BY doc""")
def unique_documents(t):
    rows = t("events").select("event_id", mixed().alias("doc"))
    return rows.groupBy(documents.order_key("doc").alias("key")).agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")).drop("key")


@query(f"""SELECT event_id, ['null', 'boolean', 'number', 'string', 'array', 'object'][event_id % 6 + 1] AS type, event_id % 6 < 4 AS scalar FROM events""")
def document_types(t):
    return t("events").select("event_id", documents.type_of(mixed()).alias("type"), documents.of_type(mixed(), "scalars").alias("scalar"))


@query(f"""SELECT event_id, '[1,' || {K} || ',[2],[3,4]]' AS once, '[1,' || {K} || ',2,3,4]' AS every FROM events""")
def flatten_documents(t):
    doc = F.concat(F.lit("[1,["), k().cast("string"), F.lit(",[2]],[[3,4]]]"))
    return t("events").select("event_id", documents.flatten(doc, 1).alias("once"), documents.flatten(doc).alias("every"))


@query(f"""SELECT event_id, '{{"a":10,"b":' || {K} * 10 || '}}' AS doc FROM events""")
def map_values_documents(t):
    doc = F.to_json(F.struct(F.lit(1).alias("a"), k().alias("b")))
    return t("events").select("event_id", documents.map_values(doc, lambda v: v * 10).alias("doc"))


def nested() -> Column:
    """{a, c: {d, e}, items: [{x, y}, {x, y}]}"""
    item = lambda v: F.struct(v.alias("x"), F.lit("s").alias("y"))
    return F.to_json(F.struct(F.lit(1).alias("a"), F.struct(k().alias("d"), F.lit(None).cast("int").alias("e")).alias("c"), F.array(item(k()), item(k() + 1)).alias("items")), {"ignoreNullFields": "false"})


@query(f"""SELECT event_id, '{{"c":{{"d":' || {K} || '}},"items":[{{"x":' || {K} || '}},{{"x":' || ({K} + 1) || '}}]}}' AS picked,
'{{"a":1,"c":{{"d":' || {K} || '}},"items":[{{"x":' || {K} || '}},{{"x":' || ({K} + 1) || '}}]}}' AS rest,
'{{"a":1,"c":{{"depth":' || {K} || ',"e":null}},"items":[{{"x":' || {K} || ',"why":"s"}},{{"x":' || ({K} + 1) || ',"why":"s"}}]}}' AS renamed FROM events""")
def pick_omit_rename(t):
    doc = nested()
    picked, rest = documents.pick(doc, ["c", "d"], ["items", ..., "x"]), documents.omit(doc, ["c", "e"], ["items", ..., "y"])
    return t("events").select("event_id", picked.alias("picked"), rest.alias("rest"), documents.rename(documents.rename(doc, ["c", "d"], "depth"), ["items", ..., "y"], "why").alias("renamed"))


@query(f"""SELECT event_id, '{{"c":{{"d":' || {K} || '}},"items":[{{"x":' || {K} || '}},{{"x":' || ({K} + 1) || '}}]}}' AS large, '{{"a":1,"c":{{"e":null}},"items":[{{"y":"s"}},{{"y":"s"}}]}}' AS rest FROM events WHERE {K} > 50""")
def pick_where_omit_where(t):
    large = lambda path, v: not isinstance(v, (dict, list, str, bool)) and v is not None and v > 50
    doc = nested()
    return t("events").where(k() > 50).select("event_id", documents.pick_where(doc, large).alias("large"), documents.omit_where(doc, large).alias("rest"))


@query(f"""SELECT event_id, '{{"a":1,"items":[{{"x":' || {K} || ',"y":"s"}},{{"x":' || ({K} + 1) || ',"y":"s"}}]}}' AS without, '{{"a":1,"c":{{"d":' || {K} || '}},"items":[{{"x":' || {K} || ',"y":"s"}},{{"x":' || ({K} + 1) || ',"y":"s"}}]}}' AS dense,
'{{"a":"1","c":{{"d":"' || {K} || '","e":null}},"items":[{{"x":"' || {K} || '","y":"s"}},{{"x":"' || ({K} + 1) || '","y":"s"}}]}}' AS walked, '{{"k":' || {K} || ',"z":2}}' AS sorted FROM events""")
def delete_drop_walk_sort(t):
    doc = nested()
    walked = paths.walk(doc, lambda v: str(v) if isinstance(v, int) else v)
    backwards = F.concat(F.lit('{"z":2,"k":'), k().cast("string"), F.lit("}"))
    return t("events").select("event_id", paths.delete_paths(doc, ["c"]).alias("without"), paths.drop_nulls(doc).alias("dense"), walked.alias("walked"), paths.sort_keys(backwards).alias("sorted"))


@query(f"""SELECT event_id, '{{"k":' || {K} || ',"l":[1,{{}}]}}' AS back, '[1,{{}}]' AS below FROM events""")
def stream_round_trip(t):
    doc = F.concat(F.lit('{"k":'), k().cast("string"), F.lit(',"l":[1,{}]}'))
    events = paths.to_stream(doc)
    return t("events").select("event_id", F.get(documents.from_stream(events), F.lit(0)).alias("back"), F.get(documents.from_stream(documents.truncate_stream(events, 1)), F.lit(0)).alias("below"))


@query(f"""SELECT event_id, '{{"k":{{"b":2}},"z":' || {K} || '}}' AS shallow, '{{"k":{{"a":' || {K} || ',"b":2}},"z":' || {K} || '}}' AS deep FROM events""")
def merge_all_documents(t):
    parts = F.array(F.concat(F.lit('{"k":{"a":'), k().cast("string"), F.lit("}}")), F.lit('{"k":{"b":2}}'), F.concat(F.lit('{"z":'), k().cast("string"), F.lit("}")))
    return t("events").select("event_id", documents.merge_all(parts, deep=False).alias("shallow"), documents.merge_all(parts).alias("deep"))


@query(f"""SELECT event_id, '{{' || chr(10) || '  "k": ' || {K} || chr(10) || '}}' AS doc FROM events""")
def indented_documents(t):
    return t("events").select("event_id", documents.indented("props").alias("doc"))


@query(f"""SELECT event_id, '{{"kind":"List","items":[{{"metadata":{{"labels":{{"k":' || {K} || '}},"name":"n"}},"spec":1}}]}}' AS doc FROM events""")
def clean_manifests(t):
    doc = F.concat(F.lit('{"kind":"List","items":[{"metadata":{"uid":"u","name":"n","labels":{"k":'), k().cast("string"), F.lit('},"creationTimestamp":null},"spec":1}]}'))
    return t("events").select("event_id", documents.clean_k8s_metadata(doc).alias("doc"))


@query("""SELECT event_id, event_type AS kind, '{"kind":"' || event_type || '"}' AS every FROM events""")
def xml_attributes(t):
    doc = F.to_json(F.struct(F.lit("e").alias("name"), F.struct(F.col("event_type").alias("kind")).alias("attributes")))
    return t("events").select("event_id", documents.xml_attr(doc, "kind").alias("kind"), documents.xml_attr(doc).alias("every"))


@query("""SELECT event_id, 'e=' || event_type || '&u=' || user_id AS link, '<b>' || event_type || '</b>' AS html, 'id ' || event_id || ' "' || event_type || '"' AS quoted FROM events""")
def format_strings(t):
    quoted = formats.filled("json", "id {} {}", "event_id", "event_type")
    return t("events").select("event_id", formats.filled("uri", "e={}&u={}", "event_type", "user_id").alias("link"), formats.filled("html", "<b>{}</b>", "event_type").alias("html"), quoted.alias("quoted"))


# Files


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def jsonl_round_trip(t):
    rows = t("customer").select("c_custkey", "c_name", "c_acctbal")
    at = new_folder(rows.sparkSession, "files")
    sinks.write_lines(sinks.to_jsonl(rows), at)
    return readers.read_jsonl(rows.sparkSession, at, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', \"' || p_type || '\"' AS name FROM part")
def csv_round_trip(t):
    rows = t("part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("name"))
    at = new_folder(rows.sparkSession, "files")
    sinks.write_lines(sinks.to_csv(rows), at)
    return readers.with_header(readers.read_csv(rows.sparkSession, at), ["id", "name"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || chr(9) || chr(92) || 't' || chr(10) || p_type || chr(92) AS name FROM part")
def tsv_round_trip(t):
    rows = t("part").select("p_partkey", F.concat("p_name", F.lit("\t\\t\n"), "p_type", F.lit("\\")).alias("name"))
    at = new_folder(rows.sparkSession, "files")
    sinks.write_lines(sinks.to_tsv(rows), at)
    return readers.with_header(readers.read_tsv(rows.sparkSession, at), ["id", "name"])


@query("SELECT n_name, n_regionkey FROM nation")
def json_files(t):
    """A file for each nation, on several lines, read whole."""
    rows = t("nation").select(F.to_json(F.struct("n_name", "n_regionkey")).alias("doc"))
    at = new_folder(rows.sparkSession, "files")
    for part, value in enumerate(rows.orderBy("doc").collect()):  # 25 rows
        sinks.write_lines(sinks.to_json(rows.sparkSession.createDataFrame([(value["doc"],)], "doc string")).coalesce(1), f"{at}/n={part}")
    docs = readers.read_json(rows.sparkSession, f"{at}/*")
    return docs.select(paths.get_path("doc", ["n_name"]).alias("n_name"), paths.get_path("doc", ["n_regionkey"]).cast("int").alias("n_regionkey"))


@query("SELECT n_regionkey, '[' || string_agg('{\"n\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS doc FROM nation GROUP BY ALL")
def slurped_documents(t):
    rows = t("nation").select("n_regionkey", "n_nationkey", F.to_json(F.struct(F.col("n_name").alias("n"))).alias("doc"))
    return T.slurp(rows, ["n_regionkey"], ["n_nationkey"])


@query("SELECT CAST(r_regionkey AS BIGINT) AS file_idx, r_name FROM region")
def files_in_order(t):
    rows = t("region").select(F.col("r_regionkey").alias("place"), "r_name")
    docs = rows.select(F.concat(F.lit("f"), F.col("place").cast("string")).alias("src_file"), "r_name")
    return readers.with_file_order(docs).select(F.col("file_idx").cast("long").alias("file_idx"), "r_name")


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST({K} AS VARCHAR) WHEN 1 THEN 'true' WHEN 2 THEN '"' || event_type || '"' ELSE '"0' || {K} || '"' END AS cell FROM events""")
def inferred_cells(t):
    cell = F.element_at(F.array(k().cast("string"), F.lit("true"), F.col("event_type"), F.concat(F.lit("0"), k().cast("string"))), (F.col("event_id") % 4 + 1).cast("int"))
    return t("events").select("event_id", readers.inferred(cell).alias("cell"))


@query(f"""SELECT event_id, ['{{"a":[' || {K} || ',{{"b":1}}]}}', '[' || {K} || ',{{"b":1}}]', CAST({K} AS VARCHAR), '{{"b":1}}', '1'] AS every, CASE WHEN {K} > 50 THEN ['["a",0]'] ELSE [] END AS large,
'{{"a":["a.0=' || {K} || '",{{"b":"a.1.b=1"}}]}}' AS walked FROM events""")
def every_part_of_documents(t):
    doc = F.concat(F.lit('{"a":['), k().cast("string"), F.lit(',{"b":1}]}'))
    large = documents.find_paths(doc, lambda path, v: isinstance(v, int) and v > 50)
    walked = documents.walk_paths(doc, lambda path, v: f"{'.'.join(map(str, path))}={v}" if isinstance(v, int) else v)
    return t("events").select("event_id", documents.values(doc).alias("every"), large.alias("large"), walked.alias("walked"))


@query(f"""SELECT event_id, [props, '[1]'] AS parsed, '{{"k":' || {K} || '}}' || chr(10) || '[1]' || chr(10) AS lines, '{{' || chr(10) || '  "k": ' || {K} || chr(10) || '}}' || chr(10) AS pretty, '["' || event_type || '","x"]' AS cells FROM events""")
def parse_and_render(t):
    parsed = documents.parse(F.concat("props", F.lit("\n\n [1] \n")), "jsonl")
    cells = documents.parse(F.concat("event_type", F.lit("\tx\n")), "tsv")
    return t("events").select("event_id", parsed.alias("parsed"), documents.render(parsed, "jsonl").alias("lines"), documents.render(documents.parse("props", "json"), "json").alias("pretty"), F.get(cells, F.lit(0)).alias("cells"))


@query(f"""SELECT event_id, 'k = ' || {K} || chr(10) || 'l = [1, 2]' || chr(10) || '[t]' || chr(10) || '"a b" = "' || event_type || '"' || chr(10) || '[[t.r]]' || chr(10) || 'x = true' AS doc FROM events""")
def toml_documents(t):
    doc = F.concat(F.lit('{"k":'), k().cast("string"), F.lit(',"t":{"a b":"'), F.col("event_type"), F.lit('","r":[{"x":true}]},"l":[1,2]}'))
    return t("events").select("event_id", documents.toml(doc).alias("doc"))


@query("""SELECT n_nationkey, '{"id":"' || n_nationkey || '","name":"' || n_name || '"}' AS doc FROM nation""")
def csv_headers(t):
    rows = t("nation").select((F.col("n_nationkey") + 1).alias("line"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("row"))
    head = rows.sparkSession.createDataFrame([(0, ["id", "name"])], "line int, row array<string>")
    docs = readers.csv_header(head.unionByName(rows), ["line"])
    return docs.select(paths.get_path("doc", ["id"]).cast("int").alias("n_nationkey"), "doc")


@query("SELECT 'page ' || page_id || ' at ' || url AS line FROM pages WHERE page_id % 3 <> 0")
def raw_lines(t):
    rows = t("pages").where("page_id % 3 <> 0").select(F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(" at "), "url").alias("value"))
    at = new_folder(rows.sparkSession, "files")
    sinks.write_lines(rows, at)
    return readers.read_lines(rows.sparkSession, at).select("line")


@query(f"""SELECT event_id, '{{"k":{{"z":1}},"t":"' || event_type || '"}}' AS shallow, '{{"a":{{"x":' || {K} || ',"y":2}},"b":3}}' AS deep FROM events""")
def merge_documents(t):
    right = F.concat(F.lit('{"k":{"z":1},"t":"'), "event_type", F.lit('"}'))
    left = F.concat(F.lit('{"a":{"x":'), k().cast("string"), F.lit('},"b":1}'))
    return t("events").select("event_id", paths.merge("props", right, deep=False).alias("shallow"), paths.merge(left, F.lit('{"a":{"y":2},"b":3}')).alias("deep"))


@query(f"""SELECT event_id, unnest(['["a"]', '["a",0]', '["a",1]', '["a",1,"b"]']) AS path, unnest(['[' || {K} || ',{{"b":null}}]', CAST({K} AS VARCHAR), '{{"b":null}}', 'null']) AS value FROM events""")
def all_paths(t):
    doc = F.concat(F.lit('{"a":['), k().cast("string"), F.lit(',{"b":null}]}'))
    return t("events").select("event_id", F.explode(paths.paths(doc)).alias("p")).select("event_id", "p.path", "p.value")
