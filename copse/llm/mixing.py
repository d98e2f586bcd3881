"""Mixing sources to target weights by a low-discrepancy schedule (native: DataFrame functions only).

A source's documents are laid end to end in a hashed order and cut into blocks
of equally many words. Each source gets as many slots as its target has blocks;
slot i of the schedule has the van der Corput point bitreverse(i), which the
cumulative slot counts map to a source, and the k-th slot of a source takes its
k-th block (a second pass over the source follows the first).

No step gathers a source in one task: positions come from prefix sums on three
levels (rows in a bucket, buckets on a shelf, shelves of a source, of which each
stands for some eight million documents), and the rank of a slot within its source is a closed form
of the slot number (a sum over its set bits), not a window.

Defined cases: null text has no words; null source is a source of its own, last
in order; null or repeated doc_ids are separate rows, each placed by itself
(``mixed_documents`` draws the rows of one doc_id alike, by their shares together);
ties in the hashed order go by doc_id and size, and rows equal in these are
interchangeable; a very long text spans several blocks; an empty table gives an
empty result; other columns, whatever their names, are ignored by the mix and
kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.llm.common import free_name, stored, word_count

#: Documents per bucket of the hashed order, buckets per shelf, and schedule points per chunk (the last two as powers of 2).
BUCKET_ROWS, SHELF_BITS, CHUNK_BITS = 2048, 12, 12


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share=1.5, cap=2.0) -> DataFrame:
    """(source, sid, source_size, source_rows, target) from rows (source, size).

    Water filling: with sources sorted by cap/weight, the level is that of the
    first source which the level of the rest doesn't push above its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    s = s.withColumn("sid", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1))
    s = s.withColumn("top", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("top") / F.col("weight"))
    total, weight = F.sum("source_size").over(every) * F.lit(float(share)), F.sum("weight").over(every)
    s = s.withColumn("level", (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(every)["level"])
    return s.select("source", "sid", "source_size", "source_rows", F.least("top", F.coalesce(F.col("level") * F.col("weight"), F.col("top"))).alias("target"))


def _set(i: Column, bit: int) -> Column:
    return F.shiftright(i, bit).bitwiseAND(F.lit(1))


def bit_reverse(i: Column, bits: int) -> Column:
    """The van der Corput point of i, times 2**bits."""
    out = F.lit(0).cast("long")
    for t in range(bits):
        out = out + F.shiftleft(_set(i, t), bits - 1 - t)
    return out


def rank_below(i: Column, point: Column, c: Column, bits: int) -> Column:
    """How many slots before i have a point below c; point is i's own."""
    out = F.lit(0).cast("long")
    for t in range(bits):
        fixed = point.bitwiseAND(F.lit((1 << (bits - 1 - t)) - 1))
        n = F.shiftright(c - fixed + F.lit((1 << (bits - t)) - 1), bits - t)
        out = out + _set(i, t) * F.greatest(n, F.lit(0))
    return out


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """(slot, sid, block): the order in which blocks are drawn."""
    spark = targets.sparkSession
    t = targets.select("sid", F.ceil(F.rint("target") / block_words).cast("long").alias("n")).filter("n > 0")
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("hi", F.sum("n").over(upto)).withColumn("lo", F.col("hi") - F.col("n"))
    slots = t.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0]  # one number
    bits = max(1, (slots - 1).bit_length()) if slots else 1
    chunks = t.select("sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CHUNK_BITS), F.shiftright(F.col("hi") - 1, CHUNK_BITS))).alias("chunk"))
    points = spark.range(1 << bits).select(F.col("id").alias("slot")).withColumn("point", bit_reverse(F.col("slot"), bits)).filter(F.col("point") < slots)
    points = points.withColumn("chunk", F.shiftright("point", CHUNK_BITS))
    found = points.join(chunks, "chunk").filter("point >= lo and point < hi")
    i, v = F.col("slot"), F.col("point")
    return found.select("slot", "sid", (rank_below(i, v, F.col("hi"), bits) - rank_below(i, v, F.col("lo"), bits)).alias("block"))


def mix(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", weights=(5, 2, 1), share=1.5, cap=2.0, block_words=512, seed=17) -> DataFrame:
    """One row per drawn piece of a document: (row, doc_id, source, size, source_size, target, slot, pass, start, words).

    row tells apart repeated doc_ids; a document that isn't drawn has one row with null slot and no words.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    d = stored(d, "mix-sizes")
    targets = stored(source_targets(d, weights, share, cap), "mix-targets")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    t = targets.withColumnRenamed("source", "src")
    d = d.join(t, d["source"].eqNullSafe(t["src"])).drop("src")
    d = d.withColumn("h", h).withColumn("bucket", F.pmod(F.xxhash64("h"), F.ceil(F.col("source_rows") / BUCKET_ROWS).cast("long")))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("n", F.count("*").over(inside))
    offsets = d.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).withColumn("shelf", F.shiftright("bucket", SHELF_BITS))
    shelves = offsets.groupBy("sid", "shelf").agg(F.sum("words").alias("shelf_words"))
    shelves = shelves.select("sid", "shelf", F.coalesce(F.sum("shelf_words").over(Window.partitionBy("sid").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    over = Window.partitionBy("sid", "shelf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.join(shelves, ["sid", "shelf"]).select("sid", "bucket", (F.col("base") + F.coalesce(F.sum("words").over(over), F.lit(0))).alias("offset"))
    d = d.join(offsets, ["sid", "bucket"]).withColumn("pos", F.col("offset") + F.col("local"))
    d = d.withColumn("row", F.struct("sid", "bucket", "n"))

    goal = F.rint("target").cast("long")

    def blocks(p: int) -> Column:
        a = F.col("pos") + p * F.col("source_size")
        b = F.least(a + F.col("size"), goal)
        own = F.transform(F.sequence(F.floor(a / block_words), F.floor((b - 1) / block_words)), lambda k: F.struct(F.lit(p).alias("pass"), k.alias("block"), F.greatest(a, k * block_words).alias("from"), F.least(b, (k + 1) * block_words).alias("to")))
        return F.when(b > a, own).otherwise(F.expr("cast(array() as array<struct<pass:int,block:bigint,from:bigint,to:bigint>>)"))

    passes = [blocks(p) for p in range(int(-(-cap // 1)))]
    d = d.withColumn("piece", F.explode_outer(F.concat(*passes)))
    d = d.select("row", "doc_id", "source", "sid", "size", "source_size", "target", "pos", "piece.*")
    plan = schedule(targets, block_words)
    d = d.join(plan, ["sid", "block"], "left")
    start = F.col("from") - F.col("pos") - F.col("pass") * F.col("source_size")
    return d.select("row", "doc_id", "source", "size", "source_size", "target", "slot", "pass", start.alias("start"), F.when(F.col("slot").isNotNull(), F.col("to") - F.col("from")).otherwise(F.lit(0)).cast("long").alias("words"))


def taken(pieces: DataFrame) -> DataFrame:
    """Per document row: (doc_id, size, source_size, target, taken)."""
    keys = ["row", "doc_id", "size", "source_size", "target"]
    return pieces.groupBy(*keys).agg(F.sum("words").alias("taken")).drop("row")


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """docs with each row repeated as often as the mix draws it, counted to the nearest whole document."""
    ident = kw.get("doc_id", "doc_id")
    i, n, k = (free_name(docs, x) for x in ("drawn_id", "drawn_copies", "drawn_copy"))
    drawn = taken(mix(docs, **kw)).groupBy("doc_id").agg(F.sum("taken").alias("words"), F.sum("size").alias("size"))
    drawn = drawn.select(F.col("doc_id").alias(i), F.rint(F.col("words") / F.greatest("size", F.lit(1))).cast("int").alias(n)).filter(F.col(n) > 0)
    out = docs.join(drawn, docs[ident].eqNullSafe(F.col(i)))
    return out.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[c] for c in docs.columns])
