"""Benchmark decontamination: prefix-filtered set join with positional checks.

Items are cut into windows of ``width`` words. A window must be contained whole,
so of its shingles (``SHINGLE`` words, fewer in shorter items) any one is a
sufficient prefix; shingles are ordered by rarity, which is the number of
documents that hold them, and the rarest one of each window is its key.

Two passes read the documents: the first counts the documents of each benchmark
shingle, the second writes, per document, its words' number and the places of
keys with the words around them. Each pass asks a Bloom filter of at most
``BLOOM_BITS`` bits, whatever the benchmark's size, which shingles may matter; what
passes it by chance finds no partner later. Places and windows are then joined
by key (equi-join; windows are broadcast where there are few, by a check of
their number and bytes), with the window's length and the key's offset in it as
bounds: the words before and after the place have to be the window's. Hits are
summed up per document row.

Nothing of the benchmark but the filter passes through the driver.

Defined cases: null or wordless text has no words and no hits; items without
words are never found; an item id that repeats counts once; a null item id
reads as the empty string; shingles of equal rarity go by hash, then by place,
which no result shows; repeated or null doc_ids are kept row by row; very long
texts are read whole; empty tables give empty results; other columns, whatever
their names, are ignored by the report and kept by ``clean_documents``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.common import free_name, stored

SHINGLE, BLOOM_BITS, BLOOM_PROBES = 3, 1 << 26, 2
BROADCAST_WINDOWS, BROADCAST_BYTES, BROADCAST_TEXTS, KEPT_WORDS = 200_000, 32 << 20, 500_000, 200_000
_MULT = np.uint64(0x9E3779B97F4A7C15)

#: Lower-cases A-Z, keeps 0-9, a-z and every byte above 0x7F, blanks the rest.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Shingles:
    """Hashes of runs of words."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > KEPT_WORDS:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def runs(h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the runs of k words from each place."""
        n = max(0, len(h) - k + 1)
        out = np.full(n, k, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                out = (out ^ h[i : i + n]) * _MULT
                out ^= out >> np.uint64(29)
        return out


def _item_windows(width: int):
    def run(batches):
        for b in batches:
            rows = []
            for item, text in zip(b["item"], b["text"], strict=True):
                w = words_of(text)
                rows += [(item, x) for x in {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if x]
            yield pd.DataFrame(rows, columns=["item", "win"])

    return run


def _window_shingles(batches):
    """Each window's shingles, with what has to stand before and after one."""
    hashes = Shingles()
    for b in batches:
        rows = []
        for win in b["win"]:
            w = win.split()
            k = min(SHINGLE, len(w))
            for o, h in enumerate(Shingles.runs(hashes.words(w), k).view(np.int64).tolist()):
                rows.append((win, len(w), k, o, h, b" ".join([b"", *w[:o], b""]) if o else b" ", b" ".join([*w[o:], b""])))
        yield pd.DataFrame(rows, columns=["win", "n", "k", "o", "sh", "before", "after"])


# --- Bloom filters ---------------------------------------------------------


def _probes(h: np.ndarray, bits: int):
    for p in range(BLOOM_PROBES):
        yield (h >> np.uint64(p * 23)) & np.uint64(bits - 1)


def _set_words(bits: int):
    def run(batches):
        for b in batches:
            h = b["sh"].to_numpy(np.int64).view(np.uint64)
            at = np.unique(np.concatenate(list(_probes(h, bits))))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pd.DataFrame({"word": word.astype(np.int64), "value": value.view(np.int64)})

    return run


def bloom(shingles: DataFrame) -> np.ndarray:
    """The filter of the column sh, as 64-bit words: at most BLOOM_BITS bits reach the driver."""
    bits = min(BLOOM_BITS, max(64, 1 << (16 * shingles.count()).bit_length()))
    out = np.zeros(bits // 64, np.uint64)
    rows = shingles.select("sh").mapInPandas(_set_words(bits), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    for r in rows.collect():  # a row a word of the filter
        out[r["word"]] = np.int64(r["value"]).view(np.uint64)
    return out


def passes(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for at in _probes(h, 64 * len(filter_)):
        ok &= (filter_[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


# --- the two passes --------------------------------------------------------


def _counts(filter_, sizes: list[int]):
    """Documents of each shingle that the filter passes, by batch."""

    def run(batches):
        hashes = Shingles()
        for b in batches:
            got = []
            for text in b.column("text"):
                h = hashes.words(words_of(text.as_py()))
                for k in sizes:
                    runs = Shingles.runs(h, k)
                    got.append(np.unique(runs[passes(filter_.value, runs)]))
            sh, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(n.astype(np.int64))], names=["sh", "docs"])

    return run


def _places(filter_, sizes: list[int], width: int):
    """Each row with its number of words and the places of possible keys."""

    def run(batches):
        hashes, row = Shingles(), TaskContext.get().partitionId() << 40
        for b in batches:
            counts, cuts, sh, pos, before, after = [], [0], [], [], [], []
            for text in b.column("text"):
                w = words_of(text.as_py())
                h = hashes.words(w)
                for k in sizes:
                    runs = Shingles.runs(h, k)
                    for p in np.flatnonzero(passes(filter_.value, runs)).tolist():
                        sh.append(int(runs[p : p + 1].view(np.int64)[0]))
                        pos.append(p)
                        before.append(b" ".join([b"", *w[max(0, p - width) : p], b""]) if p else b" ")
                        after.append(b" ".join([*w[p : p + width], b""]))
                counts.append(len(w))
                cuts.append(len(sh))
            parts = [pa.array(sh, pa.int64()), pa.array(pos, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
            places = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(parts, names=["sh", "pos", "pre", "post"]))
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(counts)), pa.int64()), b.column("doc"), pa.array(counts, pa.int64()), places], names=["row", "doc", "n_words", "places"])
            row += len(counts)

    return run


def keyed_windows(benchmark: DataFrame, texts: DataFrame, item_id: str, item_text: str, width: int) -> DataFrame:
    """Each distinct window with its items, its key (the shingle that fewest of the texts hold), and the words around the key."""
    spark = benchmark.sparkSession
    b = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    w = b.mapInPandas(_item_windows(width), "item string, win binary").groupBy("win").agg(F.collect_set("item").alias("items"))
    w = stored(w, "benchmark-windows")
    every = stored(w.select("win").mapInPandas(_window_shingles, "win binary, n int, k int, o int, sh long, before binary, after binary"), "benchmark-shingles")
    distinct = every.select("k", "sh").distinct()
    sizes = sorted(r["k"] for r in distinct.select("k").distinct().collect())  # at most SHINGLE numbers
    seen = texts.select("text").mapInArrow(_counts(spark.sparkContext.broadcast(bloom(distinct)), sizes), "sh long, docs long")
    seen = seen.groupBy("sh").agg(F.sum("docs").alias("docs"))
    rarity = F.struct(F.coalesce("docs", F.lit(0)), "sh", "o")
    key = F.min_by(F.struct("sh", "o", "n", "k", "before", "after"), rarity).alias("key")
    return stored(every.join(seen, "sh", "left").groupBy("win").agg(key).select("win", "key.*").join(w, "win").drop("win"), "benchmark-keys")


def _union_length(spans: Column) -> Column:
    """Places inside any of the (start, end) of an array."""
    start = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("total"))

    def add(s: Column, x: Column) -> Column:
        reach = F.greatest(s["reach"], x["end"])
        return F.struct(reach.alias("reach"), (s["total"] + reach - F.least(F.greatest(s["reach"], x["start"]), reach)).alias("total"))

    return F.aggregate(F.array_sort(spans), start, add)["total"]


def found_in(texts: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, width: int, broadcast_windows: int) -> DataFrame:
    """(doc, n_words, n_hit, items) for each row of texts (doc, text)."""
    spark = texts.sparkSession
    keys = keyed_windows(benchmark, texts, item_id, item_text, width)
    size = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("before") + F.length("after") + F.size("items") * 64), F.lit(0)).alias("bytes")).first()
    sizes = [r["k"] for r in keys.select("k").distinct().collect()]  # at most SHINGLE numbers
    filter_ = spark.sparkContext.broadcast(bloom(keys))
    kind = texts.schema["doc"].dataType.simpleString()
    rows = texts.mapInArrow(_places(filter_, sizes, width), f"row long, doc {kind}, n_words long, places array<struct<sh:long,pos:long,pre:binary,post:binary>>")
    rows = stored(rows, "contamination-places")
    few = size["n"] <= broadcast_windows and size["bytes"] <= BROADCAST_BYTES
    hit = rows.select("row", F.explode("places").alias("p")).select("row", "p.*").join(F.broadcast(keys) if few else keys, "sh")
    hit = hit.filter(F.startswith("post", "after") & F.endswith("pre", "before"))
    start = F.col("pos") - F.col("o")
    hit = hit.groupBy("row").agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("n")).alias("end"))).alias("spans"), F.collect_set("items").alias("items"))
    hit = hit.select("row", _union_length(F.col("spans")).alias("hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("found"))
    none = F.expr("cast(array() as array<string>)")
    return rows.drop("places").join(hit, "row", "left").select("doc", "n_words", F.coalesce("hit", F.lit(0)).alias("n_hit"), F.coalesce("found", none).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", item_text="text", width=10, broadcast_windows=BROADCAST_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit and the sorted items whose windows occur."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return found_in(d, benchmark, item_id, item_text, width, broadcast_windows).withColumnRenamed("doc", "doc_id")


def report(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text="text", item_id="item_id", item_text="text", width=10, broadcast_windows=BROADCAST_WINDOWS) -> DataFrame:
    """docs, all columns, without the rows that hold a window of the benchmark; texts are told apart by their SHA-256.

    No shuffle of docs while at most BROADCAST_TEXTS texts have hits; beyond, an anti-join by digest.
    """
    digest = F.sha2(F.col(text).cast("binary"), 256)
    found = found_in(docs.select(digest.alias("doc"), F.col(text).alias("text")), benchmark, item_id, item_text, width, broadcast_windows)
    name = free_name(docs, "digest")
    dirty = stored(found.filter("n_hit > 0").select(F.col("doc").alias(name)).distinct(), "contaminated-texts")
    dirty = F.broadcast(dirty) if dirty.count() <= BROADCAST_TEXTS else dirty
    return docs.join(dirty, digest == F.col(name), "left_anti")
