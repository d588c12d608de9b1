"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Sources by code point, null last, weigh 3, 1, 2, repeating. They share `share` (150 %) of all words; no source's
target passes `most` (2) times its size, and what is cut off goes to the others by weight. A source whose target is
k whole sizes and a fraction is taken k times whole first; the fraction is then filled with documents in ascending
order of an exponential key, -ln(u) / weight, so that heavier documents tend to come first. u is a hash of doc_id, so
that reruns agree. A document is in while the words before it and half its own fit in the fraction; the words taken
thus differ from the target by half a document at most.

The documents of a source that are in are the first ones in the order (key, doc_id, size), so a source comes down to
one cut. It is found on narrow rows, stored once, without sorting any source in one place: the span of keys that holds
the cut is divided into BINS equal spans, whose sums say which of them holds it, again and again until that span has
RANGE_ROWS documents at most, or one key. Only these are sorted, equal rows as one with their number. Each document is
then held against its source's cut where it lies; a text is never moved to be weighed or ordered.

Defined cases. Null or empty text has size 0; such a document is taken 0 words. A null source is a source of its own,
the last. Rows with the same doc_id are ordered by size, and are otherwise alike: among equal rows it does not matter
which is taken, and as many are taken; those that equal the cut are numbered in one task a source. An empty table gives an
empty result. A weight that is null or not above 0 counts as 1. A very long text counts with all its words; its source's
taken words may then miss the target by half of it. Columns beyond those named are not looked at by mix() and are kept
by sample(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.llm.shared import drop_folder, stored, table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: As many documents of a source are sorted together at most, and into how many spans a wider span is divided.
RANGE_ROWS, BINS = 4096, 1024
#: Sources, and documents with weights of their own, that are broadcast to the documents at most. More are joined by
#: a shuffle.
SENT_SOURCES, SENT_WEIGHTS = 100_000, 500_000
#: Weights of documents by their quality label; without a label 1.
QUALITY = {1: 2.0, 0: 0.5}


def words(text: Column | str) -> Column:
    """The number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column | str) -> Column:
    """A number above 0 and below 1 from the first 48 bits of the MD5 of the key written as text."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes has one row a source: source, source_size, n. Adds target.

    With capacities c = most * size, the targets are min(c, level * weight), where the level makes them add up to
    the budget. Sources are filled up in the order of c / weight; the level is that which follows the last full one.
    """
    all_of = Window.partitionBy(F.lit(0))
    by_name = all_of.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights)).cast("int") + 1).cast("long")
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_ratio = all_of.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(all_of) * share
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    w = w.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # once a source is not full none after it is
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(all_of)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), final * F.col("weight")))
    return w.select("source", "source_size", "n", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, share: float = SHARE, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    quality: doc_id and weight, one row an id; documents without one weigh 1.
    """
    rows = _keyed(docs, quality)
    plan = _plan(rows, share, most, range_rows)
    out = _counted(_beside(rows, plan, "source"), plan, F.struct("key", "doc_id", "size"), "doc_id", "source", "size", "source_size", "target", "epochs")
    return out.select("doc_id", "source", "size", "source_size", "target", ((F.col("epochs") + F.col("more")) * F.col("size")).cast("long").alias("taken"))


def _key(doc_id: Column | str, weight: Column) -> Column:
    return -F.log(uniform(doc_id)) / F.when(weight > 0, weight).otherwise(1.0)


def _keyed(docs: DataFrame, quality: DataFrame | None) -> DataFrame:
    """doc_id, source, size, key of all documents, stored: texts are read and their words counted once."""
    rows = docs.select("doc_id", "source", words("text").alias("size"))
    if quality is None:
        return stored(rows.withColumn("key", _key("doc_id", F.lit(1.0))), "mix")
    rows = rows.join(quality.select("doc_id", "weight"), "doc_id", "left")
    return stored(rows.select("doc_id", "source", "size", _key("doc_id", F.col("weight")).alias("key")), "mix")


def _plan(rows: DataFrame, share: float, most: int, range_rows: int) -> DataFrame:
    """A row a source: s (the source), source_size, target, epochs, and the cut: cut (key, doc_id, size; null if all
    are in) and copies, how many of the rows that equal the cut are in."""
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    plan = targets(each.select("source", "source_size", "n"), share=share, most=most)
    plan = plan.withColumn("epochs", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    spans = each.select(F.col("source").alias("e"), "lo", "hi", F.lit(0).cast("long").alias("base"))
    plan = stored(plan.join(spans, F.col("source").eqNullSafe(F.col("e"))).select(F.col("source").alias("s"), "source_size", "n", "target", "epochs", "rest", "lo", "hi", "base"), "mix-plan")
    sources = plan.count()
    while plan.where((F.col("n") > range_rows) & (F.col("lo") < F.col("hi"))).limit(1).count():
        plan = stored(_narrowed(rows, plan, range_rows, sources), "mix-plan")
    inside = _beside(rows, plan, "source", sources).where(F.col("key").between(F.col("lo"), F.col("hi")))
    equal = inside.groupBy("s", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    before = Window.partitionBy("s").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - (F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(before), F.lit(0)) + F.col("size") / 2)
    # Of equal rows those whose half is reached by what is left; a row without words is in while anything is left.
    fit = F.when(room < 0, 0).when(F.col("size") == 0, F.col("rows")).otherwise(F.least(F.floor(room / F.greatest("size", F.lit(1))) + 1, "rows"))
    cuts = equal.withColumn("copies", fit.cast("long")).where("copies < rows").groupBy("s").agg(F.min(F.struct(F.struct("key", "doc_id", "size").alias("cut"), "copies")).alias("c"))
    cuts = cuts.select(F.col("s").alias("k"), "c.cut", "c.copies")
    return stored(plan.join(cuts, F.col("s").eqNullSafe(F.col("k")), "left").select("s", "source_size", "target", "epochs", "cut", "copies"), "mix-cuts")


def _narrowed(rows: DataFrame, plan: DataFrame, range_rows: int, sources: int) -> DataFrame:
    """plan with the span of keys (lo to hi) of each source that has too many documents in it narrowed to the one of
    its BINS parts in which the cut lies; n and base are those of that part."""
    wide = plan.where((F.col("n") > range_rows) & (F.col("lo") < F.col("hi")))
    inside = _beside(rows, wide.select("s", "lo", "hi", "base", "rest"), "source", sources).where(F.col("key").between(F.col("lo"), F.col("hi")))
    part = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
    sums = inside.groupBy("s", part.alias("part")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("m"), F.min("key").alias("low"), F.max("key").alias("high"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    till = F.sum("words").over(Window.partitionBy("s").orderBy("part"))  # BINS rows a source
    sums = sums.withColumn("till", F.col("base") + till).withColumn("last", F.max("part").over(Window.partitionBy("s")))
    found = sums.where((F.col("till") > F.col("rest")) | (F.col("part") == F.col("last"))).groupBy("s").agg(F.min_by(F.struct("low", "high", "m", (F.col("till") - F.col("words")).alias("before")), "part").alias("f"))
    joined = plan.join(found.select(F.col("s").alias("k"), "f"), F.col("s").eqNullSafe(F.col("k")), "left")
    here = F.col("f").isNotNull()
    return joined.select("s", "source_size", F.when(here, F.col("f.m")).otherwise(F.col("n")).alias("n"), "target", "epochs", "rest", F.when(here, F.col("f.low")).otherwise(F.col("lo")).alias("lo"), F.when(here, F.col("f.high")).otherwise(F.col("hi")).alias("hi"), F.when(here, F.col("f.before")).otherwise(F.col("base")).cast("long").alias("base"))


def _beside(rows: DataFrame, plan: DataFrame, source: str, sources: int | None = None) -> DataFrame:
    """Rows with their source's row of plan, which is broadcast if it has SENT_SOURCES rows at most."""
    sources = plan.count() if sources is None else sources
    plan = F.broadcast(plan) if sources <= SENT_SOURCES else plan.hint("shuffle_merge")
    return rows.join(plan, F.col(source).eqNullSafe(F.col("s")))


def _counted(rows: DataFrame, plan: DataFrame, place: Column, *columns: str) -> DataFrame:
    """The columns of rows, which have their source's cut, and more: 1 if the row is in the fraction, else 0."""
    rows = rows.withColumn("__place", place)
    at_cut = F.col("__place") == F.col("cut")
    single = F.when(F.col("cut").isNull() | (F.col("__place") < F.col("cut")), 1).otherwise(0)
    if not plan.where("copies > 0").limit(1).count():  # no rows equal a cut and are to be told apart
        return rows.select(*columns, single.alias("more"))
    ties = F.coalesce(at_cut & (F.col("copies") > 0), F.lit(False))
    some = rows.where(ties).withColumn("__n", F.row_number().over(Window.partitionBy("s").orderBy(F.lit(0))))
    out = rows.where(~ties).select(*columns, single.alias("more"))
    return out.unionByName(some.select(*columns, F.when(F.col("__n") <= F.col("copies"), 1).otherwise(0).alias("more")))


def label_weights(labels: DataFrame) -> DataFrame:
    """doc_id and weight by the quality label; of several labels the highest counts."""
    best = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.lit(1.0)
    for label, value in QUALITY.items():
        weight = F.when(F.col("quality") == label, value).otherwise(weight)
    return best.select("doc_id", weight.alias("weight"))


def sample(docs: DataFrame, quality: DataFrame | None = None, share: float = SHARE, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix itself: docs' columns, each document as many times as it is taken (0 to `most`).

    Documents are held against their source's cut where they lie. Only where more than SENT_WEIGHTS documents have
    weights of their own, texts are dealt once, by doc_id, to bring the weights to them.
    """
    narrow = _keyed(docs, quality)
    plan = _plan(narrow, share, most, range_rows)
    drop_folder(docs.sparkSession, narrow.stored_at)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"))
    if quality is None:
        rows = rows.withColumn("__key", _key("row.doc_id", F.lit(1.0)))
    else:
        heavy = quality.where("weight > 0 AND weight != 1").select(F.col("doc_id").alias("__id"), "weight")
        heavy = F.broadcast(heavy) if heavy.count() <= SENT_WEIGHTS else heavy.hint("shuffle_merge")
        rows = rows.join(heavy, F.col("row.doc_id") == F.col("__id"), "left").select("row", _key("row.doc_id", F.col("weight")).alias("__key"))
    rows = _beside(rows.where(F.col("row.text").rlike(r"[^\x20\x09-\x0D]")), plan, "row.source")
    # Words are counted only where the key and the id do not tell the sides of the cut apart.
    near = (F.col("__key") == F.col("cut.key")) & F.col("row.doc_id").eqNullSafe(F.col("cut.doc_id"))
    place = F.struct(F.col("__key").alias("key"), F.col("row.doc_id").alias("doc_id"), F.when(near, words("row.text")).otherwise(F.lit(0)).cast("long").alias("size"))
    times = (F.col("epochs") + F.col("more")).cast("int")
    taken = _counted(rows, plan, place, "row", "epochs").select("row", times.alias("times")).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), label_weights(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = {
    "op9_mixing_sources": r"""
WITH q AS (SELECT doc_id AS q_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)
             / CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
      FROM documents LEFT JOIN q ON doc_id = q_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS cap FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight FROM s),
l AS (SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5 - coalesce(CAST(sum(cap) OVER b AS BIGINT), 0)) / CAST(sum(weight) OVER o AS BIGINT) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, (SELECT level FROM l WHERE cap > level * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), final * weight) END AS target FROM f),
e AS (SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS epochs FROM t),
a AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN ahead + size / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM a""",
}
QUERIES = {"op9_mixing_sources": op9_mixing_sources}
