"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 3-word shingles hashed with XXH64, a bit is set where more than
half of the hashes have it. Equal fingerprints collapse first; what follows
works on distinct ones.

Linking within ``distance`` d: bits are dealt to m parts with thresholds t_i
whose sum is d - m + 1, so two linked fingerprints agree to within t_i in some
part i. Parts group bits that agree with each other in the corpus (correlated
bits share a part, which keeps the others selective), and a dynamic programme
over estimated candidate counts shares the thresholds out unequally. A part
with t_i = 1 is probed with one bit masked at a time. Members of one key are
candidates and are verified on the whole fingerprint.

A key with more than ``LIMIT`` members is never compared all with all: its
members differ in the remaining bits only, so the principle applies to those
bits again (distance + 1 smaller parts, one of which must be equal), until keys are
small. This ends, as members are distinct. Links are handed on as a spanning
forest of each key's members, and components are found by alternating star
contraction on tables, with checkpoints; nothing is collected.

Defined cases: null, empty and wordless texts have fingerprint zero and link
like any other; texts under three words are hashed whole; repeated doc_ids and
rows each get a row; component_id is the smallest non-null doc_id reachable
(null if there is none); ties between links don't matter, as all are followed;
a very long text is hashed whole; empty tables give empty results; other
columns, whatever their names, are ignored by the report and kept by the
deduplication.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.common import free_name, let_go, shared_dir, stored

LIMIT, SEED = 1024, 42


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text; bytes.lower folds A-Z alone, split cuts at the same six spaces."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        return _majority(np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64))
    ends = list(itertools.accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64))


def _prints(batches):
    let_go()
    for b in batches:
        fp = np.array([fingerprint(t) for t in b["text"]], np.uint64)
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h": b["h"], "fp": fp.view(np.int64)})


def fingerprints(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, h, fp): a hash of the text, and the fingerprint's 64 bits as a signed long."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    return d.mapInPandas(_prints, "doc_id long, h long, fp long")


# --- parts and thresholds --------------------------------------------------


def _bit(k: int):
    return F.shiftrightunsigned(F.col("fp"), k).bitwiseAND(F.lit(1))


def bit_order(fps: DataFrame) -> tuple[list[int], np.ndarray, int]:
    """Bits ordered so that correlated ones are neighbours, the share of ones of each, and the number of fingerprints.

    64 counts of ones and 2,016 of agreements, over all fingerprints, from one aggregation.
    """

    def tally(batches):
        ones, both, n = np.zeros(64), np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            ones += x.sum(axis=0)
            both += x.T @ x
            n += len(x)
        yield pd.DataFrame({"k": np.arange(64 + 4096 + 1), "v": np.concatenate([ones, both.ravel(), [n]])})

    got = fps.select("fp").mapInPandas(tally, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(64 + 4096 + 1)
    for r in got:
        v[r["k"]] = r["v"]
    n = int(v[-1])
    if n < 2:
        return list(range(64)), np.full(64, 0.5), n
    p, both = v[:64] / n, v[64:-1].reshape(64, 64) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    order, left = [int(np.argmax(corr.sum(axis=1)))], set(range(64))
    left.discard(order[0])
    while left:
        nxt = max(sorted(left), key=lambda k: corr[order[-1], k])
        order.append(nxt)
        left.discard(nxt)
    return order, p, n


def candidates(bits: list[int], p: np.ndarray, n: int, t: int) -> float:
    """Estimated rows to probe and pairs to verify of a part at threshold t, were its bits independent."""
    if t < 0:
        return 0.0
    same = p[bits] ** 2 + (1 - p[bits]) ** 2
    hit = float(np.prod(same))
    keys = 1
    if t == 1:
        hit, keys = hit * (1 + float(np.sum((1 - same) / np.maximum(same, 1e-9)))), len(bits)
    elif t > 1:
        return float("inf")
    return n * keys * 4.0 + n * n * hit / 2


def plan_parts(order: list[int], p: np.ndarray, n: int, distance: int = 3) -> list[tuple[list[int], int]]:
    """[(bits, threshold)]: the cheapest split into up to distance + 1 parts, thresholds by dynamic programming."""
    best: tuple = (float("inf"), [])
    for m in range(1, distance + 2):
        cuts = [round(64 * k / m) for k in range(m + 1)]
        parts = [order[a:b] for a, b in itertools.pairwise(cuts)]
        # total over parts of (t_i + 1) is distance + 1
        cost: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in parts:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in cost.items():
                for t in range(-1, 2):
                    if used + t + 1 <= distance + 1:
                        new = c + candidates(bits, p, n, t)
                        if new < step.get(used + t + 1, (float("inf"),))[0]:
                            step[used + t + 1] = (new, [*ts, t])
            cost = step
        if distance + 1 in cost and cost[distance + 1][0] < best[0]:
            best = (cost[distance + 1][0], list(zip(parts, cost[distance + 1][1], strict=True)))
    return best[1]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def probes(parts: list[tuple[list[int], int]]) -> list[int]:
    """Masks whose bits must agree: one per part at threshold 0, one per masked bit at threshold 1."""
    out = []
    for bits, t in parts:
        if t == 0:
            out.append(_mask(bits))
        elif t == 1:
            out += [_mask(bits) & ~(1 << b) for b in bits]
    return out


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fp) for each fingerprint and mask: members of one (mask, key) agree in all bits of mask."""
    m = F.explode(F.array(*[F.lit(_signed(x)).cast("long") for x in masks])).alias("mask")
    return fps.select("fp", m).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def refined(rows: DataFrame, distance: int = 3) -> DataFrame:
    """Rows of too large keys, each under distance + 1 longer masks: parts of the bits still free, one of which must agree."""

    def longer(batches):
        for b in batches:
            parts = []
            for mask, own in b.groupby("mask"):
                free = [k for k in range(64) if not (int(mask) >> k) & 1]
                for q in range(distance + 1):
                    new = _signed((int(mask) & (2**64 - 1)) | _mask(free[q :: distance + 1]))
                    fp = own["fp"].to_numpy(np.int64)
                    parts.append(pd.DataFrame({"fp": fp, "mask": np.int64(new), "key": fp & np.int64(new)}))
            yield pd.concat(parts) if parts else pd.DataFrame({"fp": [], "mask": [], "key": []})

    return rows.select("fp", "mask").mapInPandas(longer, "fp long, mask long, key long")


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) joining all of fp that are linked, by breadth-first search in blocks."""
    left = np.arange(len(fp))
    src, dst = [], []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), 256):
                near |= (np.bitwise_count(fp[front[at : at + 256], None] ^ fp[None, left]) <= distance).any(axis=0)
            front, left = left[near], left[~near]
            src.append(fp[front])
            dst.append(np.full(len(front), fp[root]))
    if not src:
        return fp[:0], fp[:0]
    return np.concatenate(src), np.concatenate(dst)


def _verify(distance: int):
    """Over rows sorted by (mask, key): edges of each key's forest; small keys of a batch go together, by offset."""

    def run(batches):
        rest = None
        for b in itertools.chain(batches, [None]):
            cur = rest if b is None else b if rest is None else pd.concat([rest, b], ignore_index=True)
            if cur is None or not len(cur):
                continue
            mask, key, fp = (cur[c].to_numpy(np.int64) for c in ("mask", "key", "fp"))
            new = np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
            starts = np.flatnonzero(new)
            cut = len(cur) if b is None else starts[-1]
            rest = None if b is None else cur.iloc[cut:]
            starts = starts[starts < cut]
            sizes = np.diff(np.r_[starts, cut])
            u = fp.view(np.uint64)
            out_a, out_b = [], []
            small = sizes <= 24
            left = np.repeat(np.where(small, sizes, 0), sizes)[:cut] - (np.arange(cut) - np.repeat(starts, sizes))
            at = np.flatnonzero(left > 1)
            d = 1
            while len(at):
                at = at[left[at] > d]
                near = np.bitwise_count(u[at] ^ u[at + d]) <= distance
                out_a.append(u[at + d][near])
                out_b.append(u[at][near])
                d += 1
            for s, n in zip(starts[~small], sizes[~small], strict=True):
                x, y = forest(u[s : s + n], distance)
                out_a.append(x)
                out_b.append(y)
            if out_a:
                yield pd.DataFrame({"a": np.concatenate(out_a).view(np.int64), "b": np.concatenate(out_b).view(np.int64)})

    return run


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) with a != b: enough links between distinct fingerprints to join all that are within distance."""
    spark = fps.sparkSession
    order, p, n = bit_order(fps)
    schema = "a long, b long"
    if n < 2:
        return spark.createDataFrame([], schema)
    rows, found = keyed(fps, probes(plan_parts(order, p, n, distance))), None
    while True:
        counts = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        rows = rows.join(counts, ["mask", "key"])
        own = rows.filter(F.col("n") <= LIMIT).repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        edges = stored(own.select("mask", "key", "fp").mapInPandas(_verify(distance), schema).distinct(), "simhash-links")
        found = edges if found is None else found.unionByName(edges)
        large = rows.filter(F.col("n") > LIMIT)
        if counts.filter(F.col("n") > LIMIT).isEmpty():
            return found
        rows = stored(refined(large, distance).distinct(), "simhash-refined")


# --- components ------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable; alternating large-star and small-star contraction."""
    shared_dir(edges.sparkSession)
    e = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct()
    e = e.checkpoint()
    before = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = small.select(F.col("v").alias("lo"), F.col("u").alias("hi")).checkpoint()
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0))).first()
        if before == now:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", distance=3) -> DataFrame:
    """Per document row: (doc_id, h, fp, component_id, root): the component's smallest doc_id and its least fingerprint."""
    d = stored(fingerprints(docs, doc_id=doc_id, text=text), "simhash-fingerprints")
    fps = stored(d.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    comp = components(links(fps.select("fp"), distance))
    fps = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = fps.groupBy("root").agg(F.min("first").alias("component_id"))
    fps = fps.join(least, "root").select("fp", "root", "component_id")
    return d.join(fps, "fp").select("doc_id", "h", "fp", "component_id", "root")


def report(found: DataFrame) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, *, doc_id="doc_id", text="text", **kw) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id, null last; of rows that share it, that of the least hash of the text, and then of the whole row."""
    found = stored(near_duplicates(docs, doc_id=doc_id, text=text, **kw), "simhash-components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("head")
    i, h = free_name(docs, "head_id"), free_name(docs, "head_hash")
    heads = found.groupBy("root").agg(first).select(F.col("head.doc_id").alias(i), F.col("head.h").alias(h))
    kept = docs.join(heads, F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(h)), "left_semi")
    if found.groupBy("doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return kept.select(*docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])  # rows equal in id and text: one stays
    kept = kept.groupBy(F.col(doc_id).alias(i), F.xxhash64(F.col(text)).alias(h)).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(free_name(docs, "head_row")))
    return kept.select(F.col(free_name(docs, "head_row") + ".*"))
