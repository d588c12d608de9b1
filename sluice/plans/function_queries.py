"""Queries on the columns of the star schema: texts, patterns, arrays, numbers, dates, and tables of the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import arrays, dates, formats, numbers, strings
from sluice.operators import tables as T
from sluice.plans.registry import query

# Texts and patterns


@query("""SELECT p_partkey, CAST(strpos(p_name, ' ') - 1 AS INT) AS first, CAST(length(p_name) - strpos(reverse(p_name), ' ') AS INT) AS last, length(p_name) - length(replace(p_name, ' ', '')) AS n FROM part""")
def index_rindex(t):
    return t("part").select("p_partkey", strings.index("p_name", " ").alias("first"), strings.rindex("p_name", " ").alias("last"), F.size(strings.indices("p_name", " ")).cast("long").alias("n"))


@query("""SELECT p_partkey, string_split(p_name, ' ') AS texts, CAST(strpos(p_name, ' ') AS INT) AS second FROM part""")
def match_offsets(t):
    found = strings.match("p_name", r"\p{L}+", "g")
    return t("part").select("p_partkey", F.transform(found, lambda m: m["string"]).alias("texts"), F.get(found, F.lit(1))["offset"].alias("second"))


@query("""SELECT p_partkey, 'Brand' AS named, CAST(NULL AS VARCHAR) AS absent, '' AS empty FROM part""")
def capture_empty_and_absent(t):
    c = strings.capture("p_brand", "(?<named>Brand)(?<absent>z)?(?<empty>q*)")
    return t("part").select("p_partkey", c["named"].alias("named"), c["absent"].alias("absent"), c["empty"].alias("empty"))


@query("""SELECT p_partkey, length(regexp_replace(p_brand, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(p_brand, '[^A-Z]', '', 'g')) AS capitals FROM part""")
def scan_absent_groups(t):
    found = strings.scan("p_brand", "([A-Z])|([0-9])")
    count = lambda i: F.size(F.filter(found, lambda g: F.get(g, F.lit(i)).isNotNull())).cast("long")
    return t("part").select("p_partkey", count(1).alias("digits"), count(0).alias("capitals"))


@query("""SELECT p_partkey, substr(p_brand, 1, 1) || '_' || substr(p_brand, 3) AS behind, '<' || substr(p_brand, 1, 5) || '>' || substr(p_brand, 6) AS whole, regexp_replace(p_brand, '([a-z])([a-z])', '\\2\\1') AS swapped FROM part""")
def sub_first_match(t):
    return t("part").select("p_partkey", strings.sub("p_brand", "(?<=[A-Z])[a-z]", "_").alias("behind"), strings.sub("p_brand", "BRAND", "<$0>", "i").alias("whole"), strings.sub("p_brand", "([a-z])([a-z])", "$2$1").alias("swapped"))


@query("""SELECT c_custkey, 'customer-' || regexp_extract(c_name, '[0-9]+') || '-über-größe' AS slug, 'customer_' || regexp_extract(c_name, '[0-9]+') || '_über_größe' AS snake,
          'customer' || regexp_extract(c_name, '[0-9]+') || 'ÜberGröße' AS camel, 'Customer ' || regexp_extract(c_name, '[0-9]+') || ' Über Größe' AS title FROM customer""")
def word_cases(t):
    text = F.concat(F.col("c_name"), F.lit(" überGröße!"))
    return t("customer").select("c_custkey", strings.slug(text).alias("slug"), strings.snake_case(text).alias("snake"), strings.camel_case(text).alias("camel"), strings.title_case(text).alias("title"))


@query("""SELECT c_custkey, replace(c_name, '#', '\\#') || '\\.\\(x\\)' AS escaped, true AS found FROM customer""")
def regex_escaped(t):
    text = F.concat("c_name", F.lit(".(x)"))
    escaped = strings.regex_escape(text)
    return t("customer").select("c_custkey", escaped.alias("escaped"), F.regexp_like(text, escaped).alias("found"))


@query("""SELECT p_partkey, string_split(p_name, ' ') AS by_pattern, regexp_split_to_array(p_type, '[AEIOU]+') AS by_vowels, string_split(p_name, 'e') AS by_text, trim(p_name) AS bare FROM part""")
def splits_and_trim(t):
    spaced = F.concat(F.lit(" \t "), F.col("p_name"), F.lit("\n "))
    return t("part").select("p_partkey", strings.splits("p_name", " ").alias("by_pattern"), strings.splits("p_type", "[AEIOU]+").alias("by_vowels"), strings.split_on("p_name", "e").alias("by_text"), strings.trim(spaced).alias("bare"))


@query("""SELECT r_regionkey, list_transform(string_split(r_name, ''), lambda x: CAST(unicode(x) AS INT)) AS points, r_name AS back, repeat(r_name, CAST(r_regionkey AS INT)) AS again FROM region""")
def explode_implode_repeat(t):
    points = strings.code_points("r_name")
    again = strings.repeat("r_name", F.col("r_regionkey").cast("double") + 0.5)
    return t("region").select("r_regionkey", points.alias("points"), strings.from_code_points(points).alias("back"), again.alias("again"))


@query("""SELECT p_partkey, p_size || '.2.' || (p_size + 1) AS patch, p_size || '.3.0' AS minor, (p_size + 1) || '.0.0' AS major, p_size || '.2.' || p_size || '-rc.5' AS rc, p_size || '.2.' || p_size || '-beta.1' AS beta, CAST(p_size AS BIGINT) AS whole FROM part""")
def semantic_versions(t):
    v = F.concat_ws(".", F.col("p_size").cast("string"), F.lit("2"), F.concat(F.col("p_size").cast("string"), F.lit("-rc.4+build")))
    bumped = [strings.semver_bump(v, part).alias(part) for part in ("patch", "minor", "major")]
    return t("part").select("p_partkey", *bumped, strings.semver_bump(v, "prerelease").alias("rc"), strings.semver_bump(v, "prerelease", "beta").alias("beta"), strings.semver(v)["major"].alias("whole"))


@query("""SELECT page_id, base64(from_hex(sha256(url))) AS sha, base64(from_hex(md5(url))) AS md5, url AS back, url AS decoded, '''' || replace(url, '''', '''\\''''') || '''' AS quoted FROM pages""")
def digests_and_decoding(t):
    back = formats.from_base64(formats.base64("url", urlsafe=True, pad=False))
    return t("pages").select("page_id", formats.digest("url", "sha256", "base64").alias("sha"), formats.digest("url", "md5", "base64").alias("md5"), back.alias("back"), formats.from_uri(formats.uri("url")).alias("decoded"), formats.sh("url").alias("quoted"))


# Numbers and dates


@query("""SELECT s_suppkey, round(sin(s_acctbal), 9) AS sine, round(atan(s_acctbal), 9) AS arc, CASE WHEN abs(s_acctbal / 5000) <= 1 THEN round(asin(s_acctbal / 5000), 9) END AS domain, round(log2(abs(s_acctbal)), 9) AS two,
          round(log10(abs(s_acctbal)), 9) AS ten, round(exp(s_acctbal / 1000), 6) AS e, round(pow(2, s_acctbal / 1000), 6) AS power FROM supplier""")
def trigonometry_and_logarithms(t):
    x, size = F.col("s_acctbal"), F.abs("s_acctbal")
    return t("supplier").select(
        "s_suppkey", F.round(numbers.trigonometric("sin", x), 9).alias("sine"), F.round(numbers.trigonometric("atan", x), 9).alias("arc"), F.round(numbers.trigonometric("asin", x / 5000), 9).alias("domain"),
        F.round(numbers.log2(size), 9).alias("two"), F.round(numbers.log10(size), 9).alias("ten"), F.round(numbers.exp(x / 1000), 6).alias("e"), F.round(numbers.exp2(x / 1000), 6).alias("power"),
    )


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS number, CAST(NULL AS DOUBLE) AS spaced, p_size > 25 AS flag, p_size / 4.0 AS quarter, CASE WHEN p_size % 2 = 0 THEN 1.7976931348623157e308 ELSE CAST(p_size AS DOUBLE) END AS bounded FROM part""")
def numbers_from_text(t):
    text = F.col("p_size").cast("string")
    infinite = F.when(F.col("p_size") % 2 == 0, F.lit(float("inf"))).otherwise(F.col("p_size"))
    return t("part").select("p_partkey", numbers.to_number(text).alias("number"), numbers.to_number(F.concat(F.lit(" "), text)).alias("spaced"), numbers.to_boolean((F.col("p_size") > 25).cast("string")).alias("flag"), numbers.divide("p_size", F.lit(4.0)).alias("quarter"), numbers.finite(infinite).alias("bounded"))


@query("""SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, strftime(o_orderdate, '%d/%m/%y %I %p %j %b %a') AS text, CAST(epoch(o_orderdate) AS BIGINT) AS again, CAST(month(o_orderdate) - 1 AS DOUBLE) AS month FROM orders""")
def broken_down_times(t):
    seconds = dates.seconds("o_orderdate")
    parts = dates.gmtime(seconds)
    text = dates.strftime(seconds, "%d/%m/%y %I %p %j %b %a")
    return t("orders").select("o_orderkey", seconds.alias("seconds"), text.alias("text"), dates.mktime(parts).alias("again"), F.get(parts, F.lit(1)).alias("month"))


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS later, 129600.0::DOUBLE AS apart, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday,
          CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS parsed FROM orders""")
def date_arithmetic(t):
    day = F.col("o_orderdate")
    later = day + dates.timedelta(days=1, hours=12)
    parsed = dates.strptime(F.date_format(day.cast("date"), "dd.MM.yyyy"), "%d.%m.%Y")
    return t("orders").select("o_orderkey", F.substring(later.cast("string"), 1, 19).alias("later"), dates.total_seconds(later, day).alias("apart"), F.substring(dates.truncated(day, "month").cast("string"), 1, 10).alias("month"), dates.parts(day)["weekday"].alias("weekday"), parsed.alias("parsed"))


# Arrays and maps


def letters():
    return F.split("r_name", "")


@query("""SELECT r_regionkey, list_filter(list_transform(range(1, len(r_name)), lambda i: CASE WHEN r_name[i : i + 1] = 'AS' OR r_name[i : i + 1] = 'RI' THEN CAST(i - 1 AS INT) END), lambda x: x IS NOT NULL) AS places FROM region""")
def indices_of_arrays(t):
    found = F.sort_array(F.concat(*[arrays.indices(letters(), F.array(*map(F.lit, part))) for part in ("AS", "RI")]))
    return t("region").select("r_regionkey", found.alias("places"))


@query("""SELECT r_regionkey, [r_name[1:1], NULL] AS rest, ['x', NULL] AS kept FROM region""")
def difference_with_nulls(t):
    first = F.substring("r_name", 1, 1)
    return t("region").select("r_regionkey", arrays.difference(F.array(first, F.lit(None), F.lit("x")), F.array(F.lit("x"))).alias("rest"), arrays.difference(F.array(F.lit("x"), F.lit(None), first), F.array(first)).alias("kept"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'false' ELSE event_type END AS text, event_id % 2 = 0 AS flag FROM events WHERE event_id % 5 <> 0""")
def truthy_values(t):
    text = F.when(F.col("event_id") % 3 == 0, "false").otherwise(F.col("event_type"))
    rows = T.select_truthy(T.select_truthy(t("events"), text), F.col("event_id") % 5 != 0)
    return rows.select("event_id", arrays.alternative(text, F.lit("none")).alias("text"), arrays.alternative((F.col("event_id") % 2 == 0), F.lit(False)).alias("flag"))


@query("""SELECT n_nationkey, [[n_nationkey, n_regionkey], [1, 2], [NULL, 3]] AS columns, CASE WHEN n_nationkey < 5 THEN -1 WHEN n_nationkey = 5 THEN 0 WHEN n_nationkey < 10 THEN -2 WHEN n_nationkey = 10 THEN 1 ELSE -3 END AS place FROM nation""")
def transpose_and_search(t):
    rows = F.array(F.array(F.col("n_nationkey"), F.lit(1)), F.array(F.col("n_regionkey"), F.lit(2), F.lit(3)))
    return t("nation").select("n_nationkey", arrays.transpose(rows).alias("columns"), arrays.bsearch(F.array(F.lit(5), F.lit(10)), F.col("n_nationkey")).cast("int").alias("place"))


@query("""SELECT r_regionkey, ['a' || r_regionkey || 'x', 'a' || r_regionkey || 'y', 'b' || r_regionkey || 'x', 'b' || r_regionkey || 'y'] AS products FROM region""")
def combinations_of_arrays(t):
    own = F.array(F.col("r_regionkey").cast("string"))
    each = arrays.product(F.array(F.lit("a"), F.lit("b")), own, F.array(F.lit("x"), F.lit("y")))
    return t("region").select("r_regionkey", F.transform(each, lambda p: F.array_join(p, "")).alias("products"))


@query("""SELECT p_partkey, w[2:] AS rest, w[:2] AS start, w[-1:] AS tail, list_filter(w, lambda x: list_position(w, x) < coalesce(list_position(list_transform(w, lambda y: y LIKE '%e%'), true), 99)) AS before FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def cuts_of_arrays(t):
    w = strings.split_on("p_name", " ")
    return t("part").select("p_partkey", arrays.cut(w, 1).alias("rest"), arrays.cut(w, 0, 2).alias("start"), arrays.cut(w, -1).alias("tail"), arrays.take_while(w, lambda x: ~x.contains("e")).alias("before"))


@query("""SELECT n_nationkey, [n_nationkey, n_nationkey + 2, n_nationkey + 5] AS sums, [n_nationkey, n_nationkey + 2] AS flat, ['a', 'k', 'z'] AS names, CAST(n_nationkey AS INT) AS least FROM nation""")
def folds_and_maps(t):
    n = F.col("n_nationkey")
    m = arrays.merge(F.create_map(F.lit("z"), n, F.lit("a"), n), F.create_map(F.lit("k"), n))
    sums = arrays.running(F.array(n, F.lit(2), F.lit(3)), F.lit(0), lambda s, x: s + x, "int")
    flat = arrays.flatten_to(F.array(F.array(F.array(n)), F.array(F.array(n + 2))), 2)
    return t("nation").select("n_nationkey", sums.alias("sums"), flat.alias("flat"), arrays.keys(m).alias("names"), arrays.min_by(F.array(n + 1, n), lambda x: x).alias("least"))


@query("""SELECT p_partkey, CAST(pow(2, ceil(log2(p_size))) AS BIGINT) AS doubled, list_transform(range(0, CAST(floor(log2(p_size)) AS INT) + 1), lambda i: CAST(p_size AS BIGINT) // CAST(pow(2, i) AS BIGINT)) AS halves FROM part""")
def until_and_while(t):
    size = F.col("p_size").cast("long")
    doubled = arrays.until(F.lit(1).cast("long"), lambda s: s >= size, lambda s: s * 2, 64)
    return t("part").select("p_partkey", doubled.alias("doubled"), arrays.while_(size, lambda s: s > 0, lambda s: F.floor(s / 2), "long", 64).alias("halves"))


# Tables


@query("""SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer""")
def recursive_descent(t):
    node = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    edges = t("nation").select(node("r", "n_regionkey").alias("parent"), node("n", "n_nationkey").alias("child"))
    edges = edges.unionByName(t("customer").select(node("n", "c_nationkey").alias("parent"), node("c", "c_custkey").alias("child")))
    return T.recurse(edges, t("region").select(node("r", "r_regionkey")), "parent", "child")


@query("""SELECT p_partkey, band FROM part JOIN (SELECT i AS band, 900 + i * 60.0 AS lo, 1000 + i * 60.0 AS hi FROM range(30) r(i)) ON p_retailprice >= lo AND p_retailprice < hi""")
def range_join_bands(t):
    parts = t("part").select("p_partkey", "p_retailprice")
    bands = parts.sparkSession.range(30).select(F.col("id").alias("band"), (900 + F.col("id") * 60.0).alias("lo"), (1000 + F.col("id") * 60.0).alias("hi"))
    return T.range_join(parts, "p_retailprice", bands, "lo", "hi", 100).select("p_partkey", "band")


@query("""SELECT p_partkey, i - 1 AS place, w[i] AS word FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))""")
def index_iteration(t):
    return t("part").select("p_partkey", F.posexplode(strings.split_on("p_name", " ")).alias("place", "word")).select("p_partkey", F.col("place").cast("long").alias("place"), "word")


@query("""SELECT c_nationkey AS nationkey, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""")
def union_all_balances(t):
    named = lambda rows, p: rows.select(F.col(f"{p}_nationkey").alias("nationkey"), F.col(f"{p}_acctbal").alias("balance"))
    return named(t("customer"), "c").unionByName(named(t("supplier"), "s"))


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders GROUP BY ALL""")
def percentiles_by_priority(t):
    rows = T.statistics(t("orders"), ["o_orderpriority"], "o_totalprice", (25, 99))
    return rows.select("o_orderpriority", F.round("p25", 6).alias("p25"), F.round("p99", 6).alias("p99"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 9""")
def nth_order(t):
    return T.nth(t("orders").select("o_orderkey", "o_totalprice"), 9, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("""SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS n FROM customer) WHERE n > 100""")
def skipped_customers(t):
    return T.skip(t("customer").select("c_custkey", "c_acctbal"), 100, ["c_acctbal", "c_custkey"])


@query("""SELECT count(*) = 0 AS empty FROM orders WHERE o_totalprice < 0""")
def is_empty(t):
    return T.is_empty(t("orders").where("o_totalprice < 0"))


@query("""SELECT p_partkey, p_name[2:4] AS middle, p_name[-3:] AS tail, p_name[:-3] AS start FROM part""")
def cuts_of_texts(t):
    return t("part").select("p_partkey", strings.cut("p_name", 1, 4).alias("middle"), strings.cut("p_name", -3).alias("tail"), strings.cut("p_name", None, -2).alias("start"))


@query("""SELECT p_partkey, list_transform(regexp_extract_all(p_name, '[a-z]+'), lambda w: w[1]) AS heads, list_transform(regexp_extract_all(p_name, '[a-z]+'), lambda w: w[2:]) AS rests FROM part""")
def capture_every_match(t):
    found = strings.capture_all("p_name", "(?<head>[a-z])(?<rest>[a-z]*)")
    return t("part").select("p_partkey", F.transform(found, lambda m: m["head"]).alias("heads"), F.transform(found, lambda m: m["rest"]).alias("rests"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(NULL AS VARCHAR) AS none FROM orders""")
def dates_from_texts(t):
    text = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm")
    return t("orders").select("o_orderkey", F.date_format(dates.to_datetime(text), "yyyy-MM-dd").alias("day"), F.date_format(dates.to_datetime(F.lit("soon")), "yyyy-MM-dd").alias("none"))


@query("""SELECT event_id, '"' || event_type || '"' AS json, event_type AS text, CAST(user_id AS VARCHAR) AS number, 'sh ''' || event_type || ''' ''x y''' AS shell FROM events""")
def text_and_json(t):
    shell = F.concat(F.lit("sh "), formats.sh_words(F.array("event_type", F.lit("x y"))))
    return t("events").select("event_id", formats.filled("json", "{}", "event_type").alias("json"), formats.text("event_type").alias("text"), formats.text("user_id").alias("number"), shell.alias("shell"))


@query("""SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 30""")
def theta_join(t):
    """An equal key and a condition: the key deals the rows, the condition is checked where they meet."""
    return t("customer").join(t("orders"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 30)).select("c_custkey", "o_orderkey")


@query("""SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY ALL""")
def joined_names(t):
    rows = T.group_by(t("nation").select("n_regionkey", "n_name"), ["n_regionkey"], ["n_name"])
    return rows.select("n_regionkey", strings.join_values(F.transform("rows", lambda r: r["n_name"]), "|").alias("names"), F.size("rows").cast("long").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS state FROM lineitem""")
def foreach_running_sum(t):
    return T.running(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], F.sum(F.col("l_quantity").cast("long"))).select("l_orderkey", "l_linenumber", "state")
