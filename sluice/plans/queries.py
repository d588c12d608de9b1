"""The library's queries over the star schema and event tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import arrays, dates, formats, numbers, paths, strings
from sluice.operators import tables as T
from sluice.operators.scratch import new_folder
from sluice.plans import document_queries, function_queries  # noqa: F401  enter their own
from sluice.plans.registry import ORACLE_SQL, QUERIES, query
from sluice.sources import documents, sinks
from sluice.streaming import lines


# Aggregates, groups, statistics


@query("""SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue,
          round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    rows = t("lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n"),
    )


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS \"count\" FROM events GROUP BY ALL")
def count_by_property(t):
    return T.count_by(t("events").select("event_type", (paths.get_path("props", ["k"]).cast("long") % 10).alias("bucket")), "event_type", "bucket")


@query("SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS members FROM customer GROUP BY ALL")
def group_rows(t):
    return T.group_by(t("customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"]).select("c_nationkey", F.transform("rows", lambda r: r["c_custkey"]).alias("members"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""")
def unique_by_customer(t):
    return T.unique_by(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def least_by(t):
    return T.extreme_by(t("lineitem"), ["l_suppkey"], "l_quantity", ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1""")
def greatest_by(t):
    return T.extreme_by(t("lineitem"), ["l_suppkey"], "l_quantity", ["l_orderkey", "l_linenumber"], greatest=True).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS deviation,
          round(quantile_cont(value, 0.5), 6) AS middle, round(quantile_cont(value, 0.9), 6) AS high FROM events GROUP BY ALL""")
def value_statistics(t):
    s = T.statistics(t("events"), ["event_type"], "value", (50, 90))
    return s.select("event_type", F.col("count").alias("n"), F.round("avg", 6).alias("mean"), F.col("min").alias("least"), F.col("max").alias("most"), F.round("stddev", 6).alias("deviation"), F.round("p50", 6).alias("middle"), F.round("p90", 6).alias("high"))


@query("""WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
c AS (SELECT CAST(least(floor((l_quantity - lo) * 8 / (hi - lo)), 7) AS INT) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(lo + i * (hi - lo) / 8, 6) AS "start", round(lo + (i + 1) * (hi - lo) / 8, 6) AS "end", coalesce(n, 0) AS "count"
FROM b, range(8) r(i) LEFT JOIN c ON c.bin = i""")
def quantity_histogram(t):
    return T.histogram(t("lineitem"), "l_quantity", 8).select("bin", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "count")


@query("SELECT k AS \"key\", min(event_id) AS first_seen FROM (SELECT unnest(json_keys(props)) AS k, event_id FROM events) GROUP BY k")
def property_columns(t):
    return T.object_keys(t("events"), "props", "event_id")


@query("SELECT l_orderkey, bool_or(l_discount > 0.09) AS \"any\", bool_and(l_tax >= 0.02) AS \"all\" FROM lineitem GROUP BY ALL")
def any_all_lines(t):
    rows = t("lineitem").groupBy("l_orderkey")
    return rows.agg(F.bool_or(F.col("l_discount") > 0.09).alias("any"), F.bool_and(F.col("l_tax") >= 0.02).alias("all"))


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value FROM orders")
def add_all(t):
    return T.reduce_sum(t("orders"), F.col("o_totalprice").cast("decimal(18,2)"))


# Keyed joins and sets


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_index_nation(t):
    indexed = T.index(t("nation"), "n_nationkey", ["n_nationkey"])
    return T.join_index(t("customer"), indexed, "c_nationkey").select("c_custkey", F.col("match.n_name").alias("n_name"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def members_in(t):
    return T.members(t("customer"), "c_custkey", t("orders").where("o_totalprice > 400000"), "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def members_missing(t):
    return T.members(t("customer"), "c_custkey", t("orders"), "o_custkey", inside=False).select("c_custkey")


@query("SELECT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def difference_keeps_repeats(t):
    return T.difference(t("lineitem").select("l_partkey"), t("part").where("p_size < 40").select("p_partkey"))


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("nationkey")).unionByName(t("supplier").select(F.col("s_nationkey").alias("nationkey"))).distinct()


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def lookup_chain(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return T.count_by(rows, "n_name", "r_name").withColumnRenamed("count", "customers")


# Order, top-k and windows


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(t):
    return T.top(t("orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def top_each_customer(t):
    return T.top_each(t("orders"), ["o_custkey"], 2, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events")
def running_maximum(t):
    return T.running(t("events"), ["user_id"], ["ts", "event_id"], F.max("value")).select("user_id", "event_id", "state")


@query("""SELECT user_id, first, second FROM (SELECT user_id, event_id AS first, lead(event_id) OVER w AS second, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n % 2 = 1""")
def paired_events(t):
    return T.pairs(t("events"), ["user_id"], ["ts", "event_id"], "event_id")


# Navigation, predicates, construction


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 AND event_type <> 'view'")
def select_by_path(t):
    k = paths.get_path("props", ["k"]).cast("long")
    return t("events").where((k > 90) & (F.col("event_type") != "view")).select("event_id", k.alias("k"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'in debt') AS segment FROM customer")
def alternative_operator(t):
    return t("customer").select("c_custkey", arrays.alternative(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.lit("in debt")).alias("segment"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS class FROM orders""")
def if_elif_else(t):
    price = F.col("o_totalprice")
    return t("orders").select("o_orderkey", F.when(price > 300000, "large").when(price > 100000, "middle").otherwise("small").alias("class"))


@query("SELECT event_id, unnest(['event_type', 'user_id']) AS name, unnest([event_type, CAST(user_id AS VARCHAR)]) AS value FROM events")
def iterate_entries(t):
    m = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))
    return t("events").select("event_id", F.explode(arrays.entries(m)).alias("e")).select("event_id", F.col("e.key").alias("name"), F.col("e.value").alias("value"))


@query("""SELECT l_orderkey, list(l_linenumber ORDER BY l_quantity DESC, l_linenumber) AS lines FROM lineitem GROUP BY ALL""")
def sort_by_desc_lines(t):
    rows = T.group_by(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_quantity"])
    return rows.select("l_orderkey", F.transform(arrays.sort_by_desc("rows", lambda r: r["l_quantity"]), lambda r: r["l_linenumber"]).alias("lines"))


@query("""SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS total FROM lineitem GROUP BY ALL""")
def array_reducers(t):
    rows = T.group_by(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_quantity", "l_returnflag"])
    quantities = F.transform("rows", lambda r: r["l_quantity"])
    return rows.select("l_orderkey", F.size(arrays.unique_by("rows", lambda r: r["l_returnflag"])).cast("long").alias("kinds"), arrays.add(quantities, 0.0).alias("total"))


@query("""SELECT p_partkey, w[1] AS first, w[-1] AS last, array_to_string(list_reverse(w), ' ') AS reversed, len(w) AS n FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def array_navigation(t):
    w = strings.split_on("p_name", " ")
    return t("part").select("p_partkey", arrays.at(w, 0).alias("first"), arrays.at(w, -1).alias("last"), strings.join_values(F.reverse(w), " ").alias("reversed"), F.size(w).cast("long").alias("n"))


# Strings, formats, numbers, dates


@query("""SELECT c_custkey, translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS down, replace(c_name, 'Customer#', '') AS number,
          lower(replace(c_mktsegment, ' ', '-')) AS slug, starts_with(c_mktsegment, 'B') AS b FROM customer""")
def string_functions(t):
    return t("customer").select("c_custkey", strings.ascii_downcase("c_name").alias("down"), strings.ltrimstr("c_name", "Customer#").alias("number"), strings.slug("c_mktsegment").alias("slug"), F.col("c_mktsegment").startswith("B").alias("b"))


@query(r"""SELECT p_partkey, regexp_extract(p_brand, '([0-9])([0-9])', 1) AS maker, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS line, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS masked,
          regexp_matches(p_type, 'steel$', 'i') AS steel, len(regexp_extract_all(p_name, '[a-z]+')) AS words FROM part""")
def regex_functions(t):
    c = strings.capture("p_brand", "(?<maker>[0-9])(?<line>[0-9])")
    return t("part").select(
        "p_partkey", F.coalesce(c["maker"], F.lit("")).alias("maker"), F.coalesce(c["line"], F.lit("")).alias("line"), strings.sub("p_type", "[AEIOU]", "_", "g").alias("masked"),
        strings.test("p_type", "steel$", "i").alias("steel"), F.size(strings.scan("p_name", "[a-z]+")).cast("long").alias("words"),
    )


@query("""SELECT page_id, base64(encode(url)) AS b64, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, url_encode(url) AS uri, sha256(url) AS sha, strlen(html) AS bytes FROM pages""")
def text_formats(t):
    return t("pages").select("page_id", formats.base64("url").alias("b64"), formats.html("url").alias("escaped"), formats.uri("url").alias("uri"), formats.digest("url").alias("sha"), F.octet_length("html").cast("long").alias("bytes"))


@query("""SELECT r_regionkey, '"' || r_name || '"' || ',' || r_regionkey AS csv, r_name || chr(9) || r_regionkey AS tsv FROM region""")
def row_formats(t):
    cells = F.concat_ws(",", formats.csv_row(F.array("r_name")), formats.csv_row(F.array("r_regionkey"), text=False))
    return t("region").select("r_regionkey", cells.alias("csv"), formats.tsv_row(F.array("r_name", F.col("r_regionkey").cast("string"))).alias("tsv"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN round(sqrt(s_acctbal), 9) END AS root, CAST(trunc(s_acctbal) AS BIGINT) % 7 AS rest, floor(s_acctbal) AS low, abs(s_acctbal) AS size FROM supplier""")
def number_functions(t):
    return t("supplier").select("s_suppkey", F.round(numbers.sqrt("s_acctbal"), 9).alias("root"), numbers.modulo("s_acctbal", F.lit(7)).alias("rest"), F.floor("s_acctbal").cast("double").alias("low"), F.abs("s_acctbal").alias("size"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts, '%A, %B %d, %Y') AS long_date, dayofyear(ts) - 1 AS yday FROM events""")
def date_functions(t):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = t("events").select("event_id", seconds.alias("s"))
    back = dates.fromdate(dates.todate("s"))
    return rows.select("event_id", dates.todate("s").alias("iso"), back.alias("seconds"), dates.strftime("s", "%A, %B %d, %Y").alias("long_date"), F.get(dates.gmtime("s"), F.lit(7)).cast("long").alias("yday"))


# Documents of any shape


@query("""SELECT event_id, '["' || k || '"]' AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def leaf_paths(t):
    rows = t("events").select("event_id", F.explode(paths.paths("props", leaves_only=True)).alias("p"))
    return rows.select("event_id", "p.path", "p.value")


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"user":{"seen":true}}' AS doc FROM events""")
def set_path_in_documents(t):
    return t("events").select("event_id", paths.set_path("props", ["user", "seen"], True).alias("doc"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY ALL""")
def conversation_roles(t):
    rows = T.group_by(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])
    return rows.select("conv_id", F.size("rows").cast("long").alias("turns"), strings.join_values(F.transform("rows", lambda r: r["role"]), ",").alias("roles"))


# Streams


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour and type, read as a stream until all files are taken in; the hour of the last event counts too."""
    folder = new_folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    counts = lines.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "0 seconds", "event_type")
    counts = counts.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
    return lines.all_counts(counts, folder)


QUERIES["stream_counts"] = stream_counts
ORACLE_SQL["stream_counts"] = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS "start", event_type, count(*) AS n FROM events GROUP BY ALL"""


def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON Lines written to a folder, filtered record by record as a stream, and read back."""
    folder, schema = new_folder(spark, "stream"), "event_id long, event_type string, user_id long"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id")
    sinks.write_lines(sinks.to_jsonl(events), f"{folder}/in")
    some = lines.stream_jsonl(spark, f"{folder}/in", schema).where("user_id % 2 = 0 AND bad_line IS NULL").select("event_id", "event_type")
    lines.write_stream(some, sinks.to_jsonl, f"{folder}/out", f"{folder}/state").awaitTermination()
    return documents.read_jsonl(spark, f"{folder}/out", "event_id long, event_type string")


QUERIES["stream_records"] = stream_records
ORACLE_SQL["stream_records"] = "SELECT event_id, event_type FROM events WHERE user_id % 2 = 0"
