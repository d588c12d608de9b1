"""MinHash near-duplicates with circulant signatures, banding, and confirmation on full shingle sets.

A document's set holds its distinct runs of SHINGLE words (words are runs of characters other than ASCII white space,
after lower-casing A-Z); fewer words make one shingle, no words an empty set, which is linked with nothing.

Signatures take two permutations of the 32-bit numbers: the first scatters a shingle's hash, the second, shifted
circularly by k, gives coordinate k; the least value over the set is kept. BANDS bands of ROWS coordinates are hashed
to buckets. Two sets that overlap by 0.85 miss each other in all 20 bands of 4 with probability (1 - 0.85^4)^20 =
4e-7; closer ones less often. The least overlap is a parameter; at 0.8 the bands miss a pair with probability 2.6e-5.

Linking, in steps that each move little and never gather an unbounded group:

1. Equal sets (by size and a 128-bit hash) stand for one: the smallest doc_id. All below is about such classes; copies
   get their class's component at the end, by the set. A class with very many copies is told to all tasks then.
2. Buckets are counted by hash; those with one class go. Buckets with the same members (by count and a hash of the
   members) are one.
3. What is left joins the classes' sets. A bucket of over 2 * BLOCK classes is dealt into parts of about BLOCK classes,
   with the bucket's least class in each. A class is sent once for each of its buckets, so this grows with the number
   of classes, not with the square of a bucket's.
4. In a group, pairs whose signatures agree enough and that are not yet connected are confirmed on the full sets, a
   class against many at once, and if linked become edges. A group of n classes yields n - 1 edges at most, whatever
   the number of its pairs. The agreement asked for (min_agree(), 50 coordinates of 80 at 0.85) is
   missed by a pair at the least overlap with probability MISS at most.
5. Components are found by passing the smallest id along edges and shortcutting, until nothing changes.
6. Large buckets whose classes are all in one component by now, as those of many near copies, are done. The others'
   classes meet in another way that misses no link: shingles are put in the order of the number of these classes that
   have them, and of two linked sets the first (1 - overlap) of each, and one more, share a shingle. Texts that share
   what all have, and no more, share none of these. Where so rare a shingle is still in classes of several components,
   they meet in groups as in 4, in which every two blocks of BLOCK classes come together.

Defined cases. Null and empty texts have n_shingles 0 and are their own component. Repeated rows and equal texts are
in one component; rows that share a doc_id count as that document, each keeps its own n_shingles. A null doc_id is
left alone and kept, with a null component. A very long text is one row of 8 bytes a word wherever its set is sent, and
is worked on whole. An empty table gives an empty result. Only the named columns are read, whatever the others are
called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.shared import beside_groups, drop_folder, handing_back, stored, table

SHINGLE, BANDS, ROWS = 5, 20, 4
COORDS = BANDS * ROWS
#: The least overlap where none is named, as a fraction of integers: 100 * both >= 85 * either.
RATIO = (85, 100)
#: How likely a pair at the least overlap may be missed for too few equal coordinates.
MISS = 5e-7
#: About as many classes of a larger bucket meet in one group, or in one half of it.
BLOCK = 256

V = np.uint32


def min_agree(ratio: tuple[int, int]) -> int:
    """The largest number of coordinates that a pair overlapping by ratio falls short of with probability MISS at most."""
    p, below = ratio[0] / ratio[1], 0.0
    for k in range(COORDS + 1):
        below += math.comb(COORDS, k) * p**k * (1 - p) ** (COORDS - k)
        if below > MISS:
            return k
    return COORDS


def _first(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit numbers."""
    x = (x ^ (x >> V(16))) * V(0x7FEB352D)
    x = (x ^ (x >> V(15))) * V(0x846CA68B)
    return x ^ (x >> V(16))


def _second(x: np.ndarray) -> np.ndarray:
    """The second one; x is overwritten."""
    x *= V(0x9E3779B1)
    x ^= x >> V(15)
    x *= V(0x85EBCA77)
    x ^= x >> V(13)
    x *= V(0xC2B2AE3D)
    x ^= x >> V(16)
    return x


def signatures(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of COORDS coordinates for each of the sets that lie one after another, none empty, in shingles."""
    out = np.empty((len(first), COORDS), V)
    if not len(first):
        return out
    scattered = _first((shingles >> W.U(32)).astype(V))
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat(_second(scattered + V(k)), first)
    return out


def shingle_sets(b: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a block, ascending, one text's after another's, and how many each has."""
    counts = b.counts
    hashes = b.hashes()
    g = W.grams(hashes, SHINGLE)
    ok = b.words_left()[: len(g)] >= SHINGLE
    text = np.repeat(np.arange(len(b)), counts)
    g, owner = g[ok], text[: len(g)][ok]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        one = np.array([W.grams(hashes[b.first[i] : b.first[i + 1]], int(counts[i]))[0] for i in short], W.U)
        g, owner = np.concatenate([g, one]), np.concatenate([owner, short])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    if len(g):
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])])
        g, owner = g[new], owner[new]
    return g, np.bincount(owner, minlength=len(b)).astype(np.int64)


_SKETCH = "doc_id long, n_shingles long, set1 long, set2 long, sig binary, bands array<long>"


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, a 128-bit hash of the set, the signature (16 bits a coordinate), the bands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.blocks(batch.column(1), W.NOT_SPACE, lower=True):
                g, n = shingle_sets(b)
                has = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[has]
                s1, s2 = np.zeros(len(n), W.U), np.zeros(len(n), W.U)
                if len(has):
                    s1[has] = np.add.reduceat(W.mix(g ^ W.U(0x5851F42D4C957F2D)), first)
                    s2[has] = np.add.reduceat(W.mix(g + W.U(0x14057B7EF767814F)), first)
                sig = signatures(g, first)
                wide = sig.astype(W.U).reshape(len(has), BANDS, ROWS)
                band = np.full((len(has), BANDS), 0x2545F4914F6CDD1D, W.U) + np.arange(BANDS, dtype=W.U)
                for r in range(ROWS):
                    band = W.mix(band ^ wide[:, :, r])
                low = (sig & V(0xFFFF)).astype(np.uint16)
                sig_out, band_out = [None] * len(n), [None] * len(n)
                for k, row in enumerate(has.tolist()):
                    sig_out[row] = low[k].tobytes()
                    band_out[row] = band[k].astype(np.int64)
                ids = batch.column(0).slice(b.rows[0], len(b))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(s1.astype(np.int64)), pa.array(s2.astype(np.int64)), pa.array(sig_out, pa.binary()), pa.array(band_out, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set1", "set2", "sig", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(handing_back(each), _SKETCH)


def _buckets(classes: DataFrame) -> DataFrame:
    """doc_id, buckets: for each class that shares a bucket with another, struct(bucket, size, head) of those it is in;
    head is the bucket's least class."""
    rows = classes.select("doc_id", F.explode("bands").alias("bucket"))
    member = F.xxhash64("doc_id")
    by_bucket = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("head"), F.sum(F.shiftrightunsigned(member, 20)).alias("m1"), F.bit_xor(member).alias("m2"))
    distinct = by_bucket.where("size > 1").groupBy("size", "head", "m1", "m2").agg(F.min("bucket").alias("bucket"))
    kept = rows.join(distinct.select("bucket", "size", "head"), "bucket")
    return kept.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "size", "head")).alias("buckets"))  # BANDS at most


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wanted (doc_id, set1, set2, sig, more) with the document's shingles as bytes; of rows that share a doc_id those
    with the class's own set."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = texts.join(wanted, "doc_id").select("doc_id", "set1", "set2", "sig", "more", "text")
    schema = f"doc_id long, sig binary, more {wanted.schema['more'].dataType.simpleString()}, shingles binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2 = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            for b in W.blocks(batch.column(5), W.NOT_SPACE, lower=True):
                g, n = shingle_sets(b)
                first = np.cumsum(n) - n
                rows, out = [], []
                for k in np.flatnonzero(n).tolist():
                    own = g[first[k] : first[k] + n[k]]
                    row = b.rows[0] + k
                    if np.add.reduce(W.mix(own ^ W.U(0x5851F42D4C957F2D))).astype(np.int64) == s1[row] and np.add.reduce(W.mix(own + W.U(0x14057B7EF767814F))).astype(np.int64) == s2[row]:
                        rows.append(row)
                        out.append(own.tobytes())
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(3).take(at), batch.column(4).take(at), pa.array(out, pa.binary())], ["doc_id", "sig", "more", "shingles"])

    return joined.mapInArrow(handing_back(each), schema)


def spanning_links(ids: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, ratio: tuple[int, int] = RATIO) -> list[tuple[int, int]]:
    """Edges that connect what the links between left and right rows (indexes) connect.

    Both may be the same rows. A row's set is held against those of all rows at once that it is not yet connected with
    and whose signatures agree enough with its own.
    """
    (num, den), least = ratio, min_agree(ratio)
    size = np.array([len(s) for s in sets])
    flat, first = np.concatenate(sets), np.cumsum(size) - size
    label, out = np.arange(len(ids)), []
    for i in left.tolist():
        others = right[right > i] if left is right else right[ids[right] != ids[i]]
        fit = others[(label[others] != label[i]) & (den * np.minimum(size[others], size[i]) >= num * np.maximum(size[others], size[i]))]
        fit = fit[(sigs[fit] == sigs[i]).sum(axis=1) >= least]
        if not len(fit):
            continue
        begin = np.cumsum(size[fit]) - size[fit]
        theirs = flat[np.arange(int(size[fit].sum())) + np.repeat(first[fit] - begin, size[fit])]
        at = np.minimum(np.searchsorted(sets[i], theirs), size[i] - 1)
        both = np.add.reduceat((sets[i][at] == theirs).astype(np.int64), begin)
        for j in fit[den * both >= num * (size[fit] + size[i] - both)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def _meet(ids: list, sigs: list, sets: list, half: list, ratio: tuple[int, int]) -> list[tuple[int, int]]:
    ids, half = np.array(ids, np.int64), np.array(half, np.int64)
    sigs = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(ids), COORDS)
    sets = [np.frombuffer(s, W.U) for s in sets]
    if half.min() == half.max():
        every = np.arange(len(ids))
        return spanning_links(ids, sigs, sets, every, every, ratio)
    return spanning_links(ids, sigs, sets, np.flatnonzero(half == half.min()), np.flatnonzero(half == half.max()), ratio)


def parted(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Groups of sets (doc_id, sig, more: buckets, shingles): buckets, or parts of about `block` classes of a larger one
    and its head. A class is in as many groups as it has buckets, a head in all parts of its own."""
    rows = sets.select("doc_id", "sig", "shingles", F.explode("more").alias("in")).select("doc_id", "sig", "shingles", "in.*")
    parts = F.when(F.col("size") > 2 * block, F.ceil(F.col("size") / block)).otherwise(1).cast("long")
    every = F.sequence(F.lit(0).cast("long"), parts - 1)
    one = F.array(F.pmod(F.xxhash64("doc_id", "bucket"), parts))
    rows = rows.withColumn("i", F.explode(F.when(F.col("doc_id") == F.col("head"), every).otherwise(one)))
    return rows.select("bucket", "i", F.col("i").alias("j"), F.col("i").alias("half"), "doc_id", "sig", "shingles")


def paired(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Groups in which every two classes of a bucket (more: buckets) meet: of two blocks each if it is larger."""
    rows = sets.select("doc_id", "sig", "shingles", F.explode("more").alias("in")).select("doc_id", "sig", "shingles", "in.bucket", F.ceil(F.col("in.size") / block).cast("long").alias("blocks"))
    rows = rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("bucket", F.least("half", "with").alias("i"), F.greatest("half", "with").alias("j"), "half", "doc_id", "sig", "shingles")


def links(groups: DataFrame, ratio: tuple[int, int] = RATIO) -> DataFrame:
    """Edges (a, b) between classes that connect all that links within groups (bucket, i, j) connect.

    Rows come sorted by group, and a group has about two blocks of rows, so a group is held while it streams by.
    """
    key = ["bucket", "i", "j"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, ([], [], [], [])
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(7)]
            a, b = [], []
            for *own, half, doc, sig, shingles in zip(*cols):
                if own != at:
                    _close(at, group, a, b, ratio)
                    at, group = own, ([], [], [], [])
                for column, x in zip(group, (doc, sig, shingles, half)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = [], []
        _close(at, group, a, b, ratio)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.repartition(*key).sortWithinPartitions(*key).mapInArrow(handing_back(each), "a long, b long")


def _close(at: list | None, group: tuple, a: list, b: list, ratio: tuple[int, int]) -> None:
    ids, _, _, half = group
    if len(ids) < 2 or (at[1] != at[2] and len(set(half)) < 2):  # nothing to meet; a block meets itself elsewhere
        return
    for x, y in _meet(*group, ratio):
        a.append(x)
        b.append(y)


def components(edges: DataFrame) -> DataFrame:
    """doc_id, component_id for every end of an edge but the smallest of its component: that smallest id.

    Rounds of two steps on edges from larger to smaller ids: every vertex sends all its larger neighbours to its
    least neighbour, then every vertex sends all its smaller neighbours to the least of them. A star around each
    component's least vertex is what stays. Edges are counted and hashed to see that they have stayed. A vertex with
    many neighbours is only ever aggregated to its minimum and joined, so no list of neighbours is gathered.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now = stored(both, "edges")
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (found["n"], found["h"]) == state or not found["n"]:
            out = now.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
            out.stored_at = now.stored_at
            return out
        state = (found["n"], found["h"])
        # large star: larger neighbours of u go to the least of u and its neighbours
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, now = now, stored(small.where("u != v").distinct(), "edges")
        drop_folder(last.sparkSession, last.stored_at)


def _unsettled(buckets: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """doc_id, component_id of the classes in large buckets whose classes are in several components."""
    rows = buckets.select("doc_id", F.explode("buckets").alias("in")).where(F.col("in.size") > 2 * block).select("doc_id", "in.bucket")
    rows = rows.join(found, "doc_id", "left").select("doc_id", "bucket", F.coalesce("component_id", "doc_id").alias("component_id"))
    several = rows.groupBy("bucket").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo != hi")
    return rows.join(several.select("bucket"), "bucket", "left_semi").select("doc_id", "component_id").distinct()


def rare_shingles(sets: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """doc_id, buckets: struct(bucket: a shingle, size: how many classes meet there) for each set (doc_id, more: its
    component, shingles). Any two sets that overlap by ratio and are in different components meet."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, component, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                g = np.frombuffer(own.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), doc)), pa.array(np.full(len(g), component)), pa.array(np.full(len(g), len(g))), pa.array(g)], ["doc_id", "component_id", "n", "shingle"])

    num, den = ratio
    rows = sets.select("doc_id", F.col("more").alias("component_id"), "shingles").mapInArrow(handing_back(each), "doc_id long, component_id long, n long, shingle long")
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("df > 1")
    shared = rows.join(held, "shingle").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle", (F.col("lo") != F.col("hi")).alias("open")))).alias("held"))
    # Shingles of one class come first; what is left of the prefix is filled with the rarest of the others.
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - (F.col("n") - F.size("held"))
    first = F.filter(F.slice("held", 1, F.greatest(prefix, F.lit(0)).cast("int")), lambda x: x["open"])
    first = shared.select("doc_id", F.explode(first).alias("first")).select("doc_id", F.col("first.shingle").alias("bucket"))
    sizes = first.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return first.join(sizes, "bucket").groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "size")).alias("buckets"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, ratio: tuple[int, int] = RATIO) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id). ratio is the least overlap.

    The result is stored; all tables that led to it are dropped.
    """
    spark = docs.sparkSession
    same = ["n_shingles", "set1", "set2"]
    rows = stored(sketches(docs, id_col, text_col), "sketches")
    own = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class's first member brings the signature; equal sets have equal ones.
    first = F.min_by(F.struct("doc_id", "sig", "bands"), "doc_id").alias("x")
    classes = stored(own.groupBy(*same).agg(first, F.count(F.lit(1)).alias("copies")).select(*same, "copies", "x.*"), "classes")
    buckets = stored(_buckets(classes), "buckets")
    meet = classes.select("doc_id", "set1", "set2", "sig").join(buckets.withColumnRenamed("buckets", "more"), "doc_id")
    edges = links(parted(_sets(docs, meet, id_col, text_col), block), ratio)
    # Rows that share a doc_id but have different sets connect their classes; other members need no edge.
    ids = own.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi")).where("lo != hi").select("doc_id")
    shared = own.join(ids, "doc_id").select("doc_id", *same).distinct().join(classes.select(F.col("doc_id").alias("b"), *same), same).select(F.col("doc_id").alias("a"), "b")
    found = components(edges.unionByName(shared))
    used = [rows, classes, buckets, found]
    if buckets.where(F.exists("buckets", lambda x: x["size"] > 2 * block)).limit(1).count():
        left = stored(_unsettled(buckets, found, block), "unsettled")
        meet = classes.select("doc_id", "set1", "set2", "sig").join(left.withColumnRenamed("component_id", "more"), "doc_id")
        sets = stored(_sets(docs, meet, id_col, text_col), "unsettled-sets")
        rare = stored(rare_shingles(sets, ratio), "rare")
        more = links(paired(sets.drop("more").join(rare.withColumnRenamed("buckets", "more"), "doc_id"), block), ratio)
        found = components(found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionByName(more))
        used += [left, sets, rare, found]
    # A class's component is that of its first member, which is brought to the rows by the set, not by the member.
    of = classes.join(found, "doc_id", "left").select(*same, "copies", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = beside_groups(own.select("doc_id", *same), of, same, "copies", rows.count(), how="left").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.unionByName(alone)
    out = stored(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "components")
    for x in used:
        drop_folder(spark, x.stored_at)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: tuple[int, int] = RATIO) -> DataFrame:
    """docs, all columns, one document of each component; of rows that share a kept doc_id the one whose columns have
    the least hash stays. Rows without a doc_id stay. Texts are dealt once, by doc_id, to meet what is kept."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keyed = docs.withColumn("__row", F.xxhash64(*hashed))
    kept = near_duplicates(docs, id_col, text_col, ratio=ratio).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    least = keyed.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("__row").alias("__least"))
    kept = kept.join(least, F.col("__kept") == F.col("__id")).select("__kept", "__least")
    out = keyed.join(kept, (F.col(id_col) == F.col("__kept")) & (F.col("__row") == F.col("__least")), "left_semi").dropDuplicates([id_col, "__row"])
    return out.drop("__row").unionByName(docs.where(F.col(id_col).isNull()))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
