"""The filter language's array operators on whole tables: grouping, statistics, keyed joins, order, sets, windows.

A table has no order of its own; where order counts, the caller names the columns that give it. Groups are aggregated
with partial sums before they are shuffled; operators that put a group's rows into one array say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.functions.arrays import truthy
from sluice.operators.scratch import checkpoints


def _named(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def group_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and `rows`, each group's rows in order. A group becomes one array: for groups that fit in a row."""
    rest = [c for c in df.columns if c not in order]
    rows = F.sort_array(F.collect_list(F.struct(*order, *rest)))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in df.columns])).alias("rows"))


def count_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def unique_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Rows are aggregated to their minimum, so that a frequent key is no bottleneck."""
    rest = [c for c in df.columns if c not in order]
    if not any(df.schema[c].dataType.typeName() in ("map", "variant") for c in df.columns):
        least = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(F.struct(*order, *rest)).alias("r"))
        return least.select("r.*").select(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(_named(df), F.struct(*order, *[F.col(c) for c in rest if df.schema[c].dataType.typeName() not in ("map", "variant")])).alias("r")).select("r.*")


def extreme_by(df: DataFrame, keys: list[str], value: str, order: list[str], greatest: bool = False) -> DataFrame:
    """The row with the least value of each group, the first among ties; or with the greatest, the last among ties."""
    pick = F.max_by if greatest else F.min_by
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(pick(_named(df), F.struct(value, *order)).alias("r")).select("r.*")


def statistics(df: DataFrame, keys: list[str], value: str, percentiles: tuple = (50,)) -> DataFrame:
    """count, sum, avg, min, max, stddev (of the population) and percentiles (interpolated) of a column."""
    v = F.col(value)
    keys = list(keys)
    out = [F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("stddev")]
    base = df.groupBy(*keys).agg(*out)
    found = percentile_rows(df, keys, value, percentiles).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).pivot("percentile", [float(p) for p in percentiles]).agg(F.first("result"))
    found = found.toDF(*[f"__{k}" for k in keys], *[f"p{p:g}" for p in percentiles])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return base.join(found, same, "left").drop(*[f"__{k}" for k in keys])


#: Parts that the span of a group's values is divided into for percentiles.
PARTS = 1024


def percentile_rows(df: DataFrame, keys: list[str], value: str, percentiles: tuple) -> DataFrame:
    """keys, percentile, result: exact percentiles (0 to 100, interpolated), without a group's values in one place.

    Equal values are counted first. The span of a group's values is divided into PARTS equal parts, whose counts tell
    in which parts the two ranks lie that a percentile is between; only the values of those parts are ranked.
    """
    own = {k: f"__{i}" for i, k in enumerate(keys)}
    rows = df.select(*[F.col(k).alias(n) for k, n in own.items()], F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    rows = rows.groupBy(*own.values(), "v").agg(F.count(F.lit(1)).alias("c"))

    def beside(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
        right = right.select(*[F.col(n).alias(f"r{n}") for n in (*own.values(), *also)], *[c for c in right.columns if c not in (*own.values(), *also)])
        same = F.lit(True)
        for n in (*own.values(), *also):
            same = same & F.col(n).eqNullSafe(F.col(f"r{n}"))
        return left.join(right, same).drop(*[f"r{n}" for n in (*own.values(), *also)])

    spans = rows.groupBy(*own.values()).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0)).cast("int")
    placed = beside(rows, spans.drop("n")).withColumn("part", part).drop("lo", "hi")
    till = F.sum("m").over(Window.partitionBy(*own.values()).orderBy("part"))  # PARTS rows a group
    sums = placed.groupBy(*own.values(), "part").agg(F.sum("c").alias("m")).withColumn("till", till).withColumn("before", F.col("till") - F.col("m"))
    ranks = spans.select(*own.values(), F.explode(F.array(*[F.lit(float(p)) for p in percentiles])).alias("percentile"), (F.col("n") - 1).alias("last"))
    place = F.col("percentile") / 100 * F.col("last")
    ranks = ranks.select(*own.values(), "percentile", (place - F.floor(place)).alias("share"), F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank"))
    wanted = beside(ranks, sums.drop("m")).where("rank >= before AND rank < till").drop("till")
    inside = beside(placed, wanted.select(*own.values(), "part", "before").distinct(), "part")
    ahead = F.sum("c").over(Window.partitionBy(*own.values(), "part").orderBy("v"))
    ranked = inside.withColumn("end", F.col("before") + ahead).withColumn("begin", F.col("end") - F.col("c")).drop("before", "c")
    picked = beside(wanted.drop("before"), ranked, "part").where("rank >= begin AND rank < end")
    low, high = F.min("v"), F.max("v")
    out = picked.groupBy(*own.values(), "percentile").agg((low + (high - low) * F.first("share")).alias("result"))
    return out.select(*[F.col(n).alias(k) for k, n in own.items()], "percentile", "result")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, start, end, count of equal bins from the least to the greatest value, empty ones too; the last includes
    its end. Values that are all equal make one bin. The bounds are one row, which is broadcast."""
    rows = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    bounds = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("bins", F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins))
    where = F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))), F.col("bins") - 1))
    counts = rows.join(F.broadcast(bounds)).groupBy(where.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = bounds.where("lo IS NOT NULL").select("lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    start = F.col("lo") + F.col("bin") * width
    return every.join(counts, "bin", "left").select("bin", start.alias("start"), F.when(F.col("bin") == F.col("bins") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("end"), F.coalesce("count", F.lit(0)).alias("count"))


def object_keys(df: DataFrame, doc: str, order: str) -> DataFrame:
    """The keys of JSON objects with the least `order` at which each is seen."""
    return df.select(F.explode(F.json_object_keys(doc)).alias("key"), order).groupBy("key").agg(F.min(order).alias("first_seen"))


def index(df: DataFrame, key: Column | str, order: list[str]) -> DataFrame:
    """`key` as text and `row`: the last row of each key."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.cast("string").alias("key")).agg(F.max_by(_named(df), F.struct(*order)).alias("row"))


def join_index(df: DataFrame, indexed: DataFrame, key: Column | str) -> DataFrame:
    """df with `match`, the index's row of the key or null. Spark broadcasts the index if its size allows it."""
    key = (F.col(key) if isinstance(key, str) else key).cast("string")
    own = indexed.select(F.col("key").alias("__key"), F.col("row").alias("match"))
    return df.join(own, key == F.col("__key"), "left").drop("__key")


def members(df: DataFrame, column: str, of: DataFrame, among: str, inside: bool = True) -> DataFrame:
    """Rows whose value is (or is not) among another table's values; null equals null."""
    other = of.select(F.col(among).alias("__of")).distinct()
    return df.join(other, F.col(column).eqNullSafe(F.col("__of")), "left_semi" if inside else "left_anti")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows: sorted in each task, of which n go on."""
    return df.orderBy(*order).limit(n)


def nth(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The row at place n (from 0) in an order; none if there are fewer."""
    return df.orderBy(*order).offset(n).limit(1)


def skip(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The rows after the first n in an order of columns, which tells all rows apart: those that lie beyond the n-th."""
    if n <= 0:
        return df
    place = F.struct(*[F.col(f"`{c}`") for c in order])
    first = df.select(*order).orderBy(*order).limit(n).agg(F.max(place).alias("__cut"), F.count(F.lit(1)).alias("__n"))
    return df.join(F.broadcast(first)).where((F.col("__n") == n) & (place > F.col("__cut"))).drop("__cut", "__n")  # one row


def is_empty(df: DataFrame) -> DataFrame:
    """`empty`: whether there are no rows; one row is looked for."""
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))


def top_each(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; tasks keep n of a group before they shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "state") -> DataFrame:
    """A fold's states within each group, for an aggregate such as sum or max."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, value.over(w))


def pairs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Consecutive values of a group two by two: keys, first, second (null for an odd last one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, F.col(value).alias("first"), F.lead(value).over(w).alias("second"), F.row_number().over(w).alias("__n"))
    return rows.where("__n % 2 = 1").drop("__n")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b, column by column, has not; repeated rows of a stay, null equals null."""
    other = b.toDF(*[f"__{i}" for i in range(len(b.columns))]).distinct()
    same = F.lit(True)
    for i, c in enumerate(a.columns):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"__{i}"))
    return a.join(other, same, "left_anti")


def reduce_sum(df: DataFrame, value: Column) -> DataFrame:
    """`value`: the sum over all rows, null for none."""
    return df.agg(F.sum(value).alias("value"))


def any_all(df: DataFrame, keys: list[str], holds: Column) -> DataFrame:
    """keys, `any` and `all`; null counts as false."""
    holds = F.coalesce(holds, F.lit(False))
    return df.groupBy(*keys).agg(F.bool_or(holds).alias("any"), F.bool_and(holds).alias("all"))


def select_truthy(df: DataFrame, value: Column) -> DataFrame:
    """Rows whose value is neither null nor the boolean false."""
    return df.where(truthy(value))


def recurse(edges: DataFrame, roots: DataFrame, parent: str, child: str, rounds: int | None = None) -> DataFrame:
    """`node`, `depth`: what is reached from roots (one column) along edges; a node has the depth first met.

    A round is a join of the last level alone, which is checkpointed; every tenth round the levels become one, so plans
    stay short. It ends when no new node is met, or after `rounds` rounds.
    """
    checkpoints(edges.sparkSession)
    found = roots.toDF("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    last, depth = found, 0
    while rounds is None or depth < rounds:
        depth += 1
        step = last.join(edges, F.col("node") == F.col(parent)).select(F.col(child).alias("node")).distinct()
        last = step.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if last.isEmpty():
            break
        found = found.unionByName(last)
        if depth % 10 == 0:
            found = found.checkpoint()
    return found


def range_join(points: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """Every pair of a point and a range that holds it (lo <= value < hi), as an equi-join: a range is in all bins of
    `width` that it touches, a point in one. A width near the ranges' own keeps both sides small."""
    bins = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    spread = ranges.where(F.col(lo) < F.col(hi)).withColumn("__bin", F.explode(bins))
    own = points.withColumn("__at", F.floor(F.col(value) / width))
    return own.join(spread, F.col("__at") == F.col("__bin")).where((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))).drop("__at", "__bin")


def slurp(docs: DataFrame, keys: list[str], order: list[str], doc: str = "doc") -> DataFrame:
    """keys and `doc`: a JSON array of the documents of each key, as of each file, in order. For keys whose documents
    fit in a row."""
    return group_by(docs.select(*keys, *order, doc), keys, order).select(*keys, F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r[doc]), ","), F.lit("]")).alias("doc"))
