"""Suffix-array deduplication: bytes covered by a 50-byte string that also starts in a smaller doc_id.

1. Documents are packed into chunks of about ``CHUNK_BYTES`` and written once to
   a bucketed table, so that later steps join it by chunk without moving text.
   Whole copies of a smaller doc_id's text are found by digest, go whole if they
   have 50 bytes, and add nothing to the steps below.
   Each chunk keeps its anchors: starts of ``GRAM``-byte strings whose hash is
   least in some 50-byte window (every window has one, and equal windows have
   the same ones).
2. Anchor hashes, once per chunk, are shuffled and sorted; those of two chunks
   or of two documents of one chunk are candidates. A 50-byte window that holds
   a 16-byte anchor reaches 17 bytes beyond it on one side at least, so the same
   is done once more with candidates' 33-byte strings to either side.
3. The text around each candidate anchor (the 50-byte windows whose least gram
   it is), once per chunk with its smallest and largest doc_id, is shuffled by the
   anchor's hash, so equal windows meet in a shard. Each shard's distinct
   segments get a suffix array by induced sorting; runs of neighbours whose
   capped common prefix reaches 50 are equal windows, and their smallest doc_id
   goes back to the chunks that have a larger one. Anchor hashes of more than
   ``CROWDED`` segments stay out of the shards: their segments are cut into the
   50-byte windows, whose smallest doc_id is an aggregate by window, joined back
   to one row per window and chunk.
4. Chunks mark covered bytes and cut them out.

A passage that a third of all documents share costs a row per chunk in the
shuffles of hashes. Of segments there is a row per chunk and surrounding text, so
anchors near the edges of such a passage have a row per document; their groups
are the crowded ones, aggregated by window and never held. A shard has at most
``SHARD_ROWS`` segments, ``CROWDED`` more and an Arrow batch. Matches are exact:
hashes only propose.

Defined cases: null and empty texts have no bytes; texts under 50 bytes lose
nothing; equal doc_ids are one document here (neither removes from the other);
a null doc_id counts as larger than all others and removes from none; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.common import shared_dir, shuffles_let_go, stored
from copse.llm.suffix_array import permuted_prefixes, suffix_array
from copse.sources.frames import dropped

WIDTH, GRAM, CHUNK_BYTES, SHARD_ROWS, CROWDED, DIGEST = 50, 16, 1 << 20, 60_000, 5_000, 16
NULL_ID = 2**63 - 1
_SPAN = WIDTH - GRAM + 1  # grams in a window
REACH = (WIDTH - GRAM + 1) // 2  # a window reaches so far beyond its gram on one side


# --- anchors ---------------------------------------------------------------


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + w], for every i that has w values; by doubling."""
    have, n = 1, len(x) - w + 1
    while have * 2 <= w:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[:n], x[w - have : w - have + n])


def _mixed(v: np.ndarray) -> np.ndarray:
    """Orders of 16-byte grams, never 0, from the 4-byte words that start at each place (along the last axis)."""
    for have in (4, 8):
        v = v * np.uint32(0x9E3779B1)
        v ^= v >> np.uint32(15)
        v = v[..., :-have] + v[..., have:] * np.uint32(0x85EBCA77)
        v ^= v >> np.uint32(13)
    return v | np.uint32(1)


def gram_orders(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same orders at some places only."""
    if not len(at):
        return np.zeros(0, np.uint32)
    b = np.lib.stride_tricks.sliding_window_view(text, GRAM)[at].astype(np.uint32)
    with np.errstate(over="ignore"):
        return _mixed(b[:, :-3] | b[:, 1:-2] << np.uint32(8) | b[:, 2:-1] << np.uint32(16) | b[:, 3:] << np.uint32(24))[:, 0]


def window_runs(at: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows whose leftmost least gram is each anchor (first > last: none)."""
    first, last = at - (_SPAN - 1), at.copy()
    for k in range(1, len(at)):
        near = at[k:] - at[:-k] < _SPAN
        if not near.any():
            break
        a, b = np.flatnonzero(near), np.flatnonzero(near) + k
        earlier = order[a] <= order[b]
        np.maximum.at(first, b[earlier], at[a[earlier]] + 1)
        np.minimum.at(last, a[~earlier], at[b[~earlier]] - _SPAN)
    return first, last


def anchors(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of grams that are least in a window; ends are the documents' ends in text."""
    n = len(text)
    if n < WIDTH:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        b = text.astype(np.uint32)
        v = _mixed(b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24))
    least = _slide(v, _SPAN, np.minimum)  # for every window start
    starts = np.r_[0, ends[:-1]]
    for s, e in zip(starts, ends, strict=True):  # windows that leave their document have none
        least[max(s, e - WIDTH + 1) : e] = 0
    pad = np.zeros(_SPAN - 1, np.uint32)
    most = _slide(np.concatenate([pad, least, pad]), _SPAN, np.maximum)
    return np.flatnonzero(most[: len(v)] == v)


def hashes_at(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the width bytes from each place."""
    h = np.full(len(at), width, np.uint64)
    if not len(at):
        return h
    own = np.lib.stride_tricks.sliding_window_view(text, width)[at]
    own = np.pad(own, ((0, 0), (0, -width % 8)))
    with np.errstate(over="ignore"):
        for w in np.ascontiguousarray(own).view(np.uint64).T:
            h = (h + w) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
    return h


def _shared_by_docs(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that two documents of a chunk have."""
    order = np.lexsort((doc, h))
    h, d = h[order], doc[order]
    return np.unique(h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])])


def _pack(batches):
    part, seq = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0
    squeeze = zstandard.ZstdCompressor(level=3).compress

    def chunk():
        lens = np.array([len(t) for t in texts], np.int64)
        blob = b"".join(texts)
        at = anchors(np.frombuffer(blob, np.uint8), np.cumsum(lens))
        gaps = np.diff(at, prepend=0).astype(np.int32)
        return pd.DataFrame([((part << 32) + seq, np.array(ids, np.int64).tobytes(), lens.tobytes(), squeeze(blob), squeeze(gaps.tobytes()), b"".join(hashlib.blake2b(t, digest_size=DIGEST).digest() for t in texts))], columns=["chunk", "ids", "lens", "text", "at", "digests"])

    for b in batches:
        for doc, text in zip(b["doc_id"], b["text"], strict=True):
            t = text.encode("utf-8", "surrogatepass") if text else b""
            if ids and size + len(t) > CHUNK_BYTES:
                yield chunk()
                ids, texts, size, seq = [], [], 0, seq + 1
            ids.append(NULL_ID if pd.isna(doc) else int(doc))
            texts.append(t)
            size += len(t)
    if ids:
        yield chunk()


class Chunk:
    def __init__(self, row):
        wide = zstandard.ZstdDecompressor().decompress
        self.raw = wide(row["text"])
        self.text = np.frombuffer(self.raw, np.uint8)
        self.ids, self.lens = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.at = np.cumsum(np.frombuffer(wide(row["at"]), np.int32), dtype=np.int64)
        self.copy = np.zeros(len(self.ids), bool)
        if row["copies"] is not None:
            self.copy[np.array(row["copies"], np.int64)] = True
        self.at = self.at[~self.copy[np.searchsorted(self.ends, self.at, side="right")]]
        self.hash = hashes_at(self.text, self.at, GRAM)
        self.doc = np.searchsorted(self.ends, self.at, side="right")  # place of the document in the chunk
        first, last = window_runs(self.at, gram_orders(self.text, self.at))
        self.low = np.maximum(self.starts[self.doc], first)
        self.high = np.minimum(self.ends[self.doc], last + WIDTH)

    def candidates(self, far, mask: int) -> np.ndarray:
        """Anchors whose hash another chunk or document has."""
        wanted = np.array([] if far is None else far, np.int64).view(np.uint64)
        here = _shared_by_docs(self.hash, self.doc)
        return np.flatnonzero((np.isin(self.hash & np.uint64(mask), wanted) | np.isin(self.hash, here)) & (self.high - self.low >= WIDTH))

    def sides(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, anchor, document) of the longer strings to the left and to the right of anchors k."""
        left = k[self.at[k] - REACH >= self.starts[self.doc[k]]]
        right = k[self.at[k] + GRAM + REACH <= self.ends[self.doc[k]]]
        h = np.r_[hashes_at(self.text, self.at[left] - REACH, GRAM + REACH), hashes_at(self.text, self.at[right], GRAM + REACH)]
        both = np.r_[left, right]
        return h, both, self.doc[both]


def _hashes(mask: int):
    def run(batches):
        for b in batches:
            for r in b.to_dict("records"):
                h = np.unique(Chunk(r).hash & np.uint64(mask))
                yield pd.DataFrame({"h": h.view(np.int64), "chunk": np.int64(r["chunk"])})

    return run


def _side_hashes(mask: int):
    def run(batches):
        for b in batches:
            for r in b.to_dict("records"):
                c = Chunk(r)
                h = np.unique(c.sides(c.candidates(r["hashes"], mask))[0] & np.uint64(mask))
                yield pd.DataFrame({"h": h.view(np.int64), "chunk": np.int64(r["chunk"])})

    return run


def _shared(batches):
    """Rows sorted by h: those whose h a neighbour has too."""
    rest_h, rest_c, told = None, None, False  # the last row isn't judged until the next batch
    for b in batches:
        h, c = b["h"].to_numpy(np.int64), b["chunk"].to_numpy(np.int64)
        if not len(h):
            continue
        if rest_h is not None:
            h, c = np.r_[rest_h, h], np.r_[rest_c, c]
        same = h[1:] == h[:-1]
        keep = np.r_[told, same] | np.r_[same, False]
        if len(h) > 1 or told:
            yield pd.DataFrame({"h": h[:-1][keep[:-1]], "chunk": c[:-1][keep[:-1]]})
        told = bool(same[-1]) if len(same) else told
        rest_h, rest_c = h[-1:], c[-1:]
    if rest_h is not None and told:
        yield pd.DataFrame({"h": rest_h, "chunk": rest_c})


# --- segments and shards ---------------------------------------------------


def _segments(mask: int):
    def run(batches):
        for b in batches:
            for r in b.to_dict("records"):
                c = Chunk(r)
                h, anchor, doc = c.sides(c.candidates(r["hashes"], mask))
                wanted = np.array([] if r["longer"] is None else r["longer"], np.int64).view(np.uint64)
                good = np.isin(h & np.uint64(mask), wanted) | np.isin(h, _shared_by_docs(h, doc))
                found: dict[tuple[int, bytes], list[int]] = {}
                for k in np.unique(anchor[good]).tolist():
                    own_id = int(c.ids[c.doc[k]])
                    own = found.setdefault((int(c.hash[k]), c.raw[c.low[k] : c.high[k]]), [int(c.at[k]), own_id, own_id, int(c.at[k] - c.low[k])])
                    own[1], own[2] = min(own[1], own_id), max(own[2], own_id)
                if found:
                    yield pd.DataFrame({"h": np.array([h for h, _ in found], np.uint64).view(np.int64), "data": [d for _, d in found], "chunk": np.int64(r["chunk"]), "at": [x[0] for x in found.values()], "lead": [x[3] for x in found.values()], "lo": [x[1] for x in found.values()], "hi": [x[2] for x in found.values()]})

    return run


def least_ids(segments: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each segment and each 50-byte window in it, the smallest id of a segment that holds that window."""
    lens = np.array([len(x) for x in segments], np.int64)
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    starts = np.cumsum(lens + 1) - lens - 1
    s = raw.astype(np.int16) + 1
    s[starts + lens] = 0
    own = np.repeat(np.arange(len(segments)), lens + 1)
    left = starts[own] + lens[own] - np.arange(len(raw))
    sa = suffix_array(s, 257, WIDTH // 2 + 1)  # leftmost-smaller suffixes are two bytes apart at least
    sa = sa[left[sa] >= WIDTH]
    group = np.r_[0, np.cumsum(permuted_prefixes(raw, sa, WIDTH)[sa[1:]] < WIDTH)] if len(sa) else np.zeros(0, np.int64)
    best = np.full(int(group[-1]) + 1 if len(group) else 0, NULL_ID, np.int64)
    np.minimum.at(best, group, ids[own[sa]])
    out = np.zeros(len(raw), np.int64)
    out[sa] = best[group]
    return [out[a : a + n - WIDTH + 1] for a, n in zip(starts, lens, strict=True)]


def _resolve(rows: pd.DataFrame) -> pd.DataFrame:
    codes, distinct = pd.factorize(rows["data"])
    least = np.full(len(distinct), NULL_ID, np.int64)
    np.minimum.at(least, codes, rows["lo"].to_numpy(np.int64))
    best = least_ids(list(distinct), least)
    lowest = np.array([x.min() for x in best])
    told = np.flatnonzero(lowest[codes] < rows["hi"].to_numpy(np.int64))
    packed = {k: (best[k][:1] if (best[k] == best[k][0]).all() else best[k]).tobytes() for k in np.unique(codes[told])}
    own = rows.iloc[told]
    return pd.DataFrame({"chunk": own["chunk"], "at": own["at"], "best": [packed[k] for k in codes[told]]})


def _shards(batches):
    """Rows sorted by h, in runs of about SHARD_ROWS cut where h changes."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= SHARD_ROWS:
            rows = pd.concat(held, ignore_index=True)
            h = rows["h"].to_numpy(np.int64)
            cut = int(np.searchsorted(h, h[-1], side="left"))
            if cut:
                yield _resolve(rows.iloc[:cut])
                rows = rows.iloc[cut:]
            held, size = [rows], len(rows)
    if size:
        yield _resolve(pd.concat(held, ignore_index=True))


def _crowded_windows(rows: DataFrame) -> DataFrame:
    """(chunk, at, best, h, least): windows that a smaller doc_id has too, by a place of theirs in each chunk."""
    windows = F.expr(f"transform(sequence(1, length(data) - {WIDTH - 1}), k -> substring(data, k, {WIDTH}))")
    each = rows.select("h", "chunk", (F.col("at") - F.col("lead")).alias("low"), "lo", "hi", F.posexplode(windows).alias("k", "window"))
    own = each.groupBy("h", "window", "chunk").agg(F.min(F.col("low") + F.col("k")).alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = stored(own, "crowded-windows")
    least = own.groupBy("window").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).filter("most > least").select("window", "least")
    return own.join(least, "window").filter("hi > least").select("chunk", "at", F.lit(None).cast("binary").alias("best"), "h", "least")


# --- cutting ---------------------------------------------------------------


def _cut(batches):
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            c = Chunk(r)
            n = len(c.text)
            edge = np.zeros(n + 1, np.int64)
            if r["found"] is not None and len(r["found"]):
                where = {int(a): k for k, a in enumerate(c.at)}
                best, single, crowded = {}, {}, set()
                for x in r["found"]:
                    if x["best"] is None:
                        single[c.raw[x["at"] : x["at"] + WIDTH]] = x["least"]
                        crowded.add(x["h"])
                        continue
                    k = where[int(x["at"])]
                    best[int(c.hash[k]), c.raw[c.low[k] : c.high[k]]] = np.frombuffer(x["best"], np.int64)
                for k in np.flatnonzero(np.isin(c.hash, np.array([h for h, _ in best], np.uint64))):
                    lo, hi = int(c.low[k]), int(c.high[k])
                    ids = best.get((int(c.hash[k]), c.raw[lo:hi]))
                    if ids is None:
                        continue
                    doc = int(c.ids[c.doc[k]])
                    if len(ids) == 1:
                        if ids[0] < doc:
                            edge[lo] += 1
                            edge[hi] -= 1
                    else:
                        j = lo + np.flatnonzero(ids < doc)
                        np.add.at(edge, j, 1)
                        np.add.at(edge, j + WIDTH, -1)
                for k in np.flatnonzero(np.isin(c.hash.view(np.int64), np.array(list(crowded), np.int64))):
                    doc = int(c.ids[c.doc[k]])
                    for j in range(int(c.low[k]), int(c.high[k]) - WIDTH + 1):
                        if single.get(c.raw[j : j + WIDTH], NULL_ID) < doc:
                            edge[j] += 1
                            edge[j + WIDTH] -= 1
            gone = np.cumsum(edge[:n]) > 0
            for doc, s, e, copy in zip(c.ids, c.starts, c.ends, c.copy, strict=True):
                own = gone[s:e]
                if copy and e - s >= WIDTH:
                    out.append((None if doc == NULL_ID else int(doc), int(e - s), int(e - s), 1, b""))
                    continue
                k = int(own.sum())
                kept = c.raw[s:e] if not k else c.text[s:e][~own].tobytes()
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if k else 0
                out.append((None if doc == NULL_ID else int(doc), int(e - s), k, spans, kept))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
        yield frame.astype({"doc_id": "Int64"})


def _digests(batches):
    for b in batches:
        for r in b.to_dict("records"):
            ids, d = np.frombuffer(r["ids"], np.int64), r["digests"]
            yield pd.DataFrame({"digest": [d[i : i + DIGEST] for i in range(0, len(d), DIGEST)], "id": ids, "chunk": np.int64(r["chunk"]), "place": np.arange(len(ids), dtype=np.int32)})


def _copies(rows: DataFrame) -> DataFrame:
    """(chunk, copies): places of documents whose text a smaller doc_id has too."""
    d = stored(rows.mapInPandas(_digests, "digest binary, id long, chunk long, place int"), "digests")
    least = d.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("most > least").select("digest", "least")
    own = d.join(least, "digest").filter("id > least").groupBy("chunk").agg(F.collect_list("place").alias("copies"))
    own = stored(own, "copies")
    dropped(d)
    return own


def deduplicated(docs: DataFrame, *, doc_id="doc_id", text="text", crowded: int = CROWDED) -> DataFrame:
    """Per document row: (doc_id, n_bytes, n_removed, n_spans, kept): kept is the remaining bytes.

    Anchor hashes of more than crowded segments are resolved by window; the result is the same for any value.
    """
    with shuffles_let_go(docs.sparkSession):
        return _deduplicated(docs, doc_id, text, crowded)


def _deduplicated(docs: DataFrame, doc_id: str, text: str, crowded: int) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    name = f"chunks_{uuid.uuid4().hex}"
    packed = d.mapInPandas(_pack, "chunk long, ids binary, lens binary, text binary, at binary, digests binary").repartition(parts, "chunk")
    packed.write.bucketBy(parts, "chunk").option("compression", "none").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    packed = spark.table(name)
    chunks = packed.drop("digests").join(_copies(packed.select("chunk", "ids", "digests")).hint("shuffle_hash"), "chunk", "left")

    mask = (1 << min(63, max(34, (packed.count() * CHUNK_BYTES // 18).bit_length() + 8))) - 1  # so many bits that chance matches stay rare

    def shared(keys: DataFrame, name: str) -> DataFrame:
        rows = keys.repartition("h").sortWithinPartitions("h").mapInPandas(_shared, "h long, chunk long")
        return rows.groupBy("chunk").agg(F.collect_list("h").alias(name))  # a chunk's own keys: bounded by its size

    far = stored(shared(chunks.mapInPandas(_hashes(mask), "h long, chunk long"), "hashes"), "shared-anchors")
    asked = chunks.join(far.hint("shuffle_hash"), "chunk", "left")
    longer = shared(asked.mapInPandas(_side_hashes(mask), "h long, chunk long"), "longer")
    asked = asked.join(longer.hint("shuffle_hash"), "chunk", "left")
    rows = stored(asked.mapInPandas(_segments(mask), "h long, data binary, chunk long, at int, lead int, lo long, hi long"), "segments")
    dropped(far)
    many = stored(rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("h"), "crowded")
    some = not many.isEmpty()
    few = rows.join(F.broadcast(many), "h", "left_anti") if some else rows  # many has at most a row per CROWDED segments
    found = few.drop("lead").repartition("h").sortWithinPartitions("h").mapInPandas(_shards, "chunk long, at int, best binary")
    found = found.select("chunk", "at", "best", F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("least"))  # nulls would make doubles of them
    if some:
        found = found.unionByName(_crowded_windows(rows.join(F.broadcast(many), "h", "left_semi")))
    found = found.groupBy("chunk").agg(F.collect_list(F.struct("at", "best", "h", "least")).alias("found"))
    told = chunks.join(found.hint("shuffle_hash"), "chunk", "left")
    return told.mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple]:
    """The same, by a table of all windows; for tests."""
    first: dict[bytes, int] = {}
    raw = [(NULL_ID if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in sorted(raw):
        for j in range(len(b) - width + 1):
            first.setdefault(b[j : j + width], i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - width + 1):
            if first[b[j : j + width]] < i:
                gone[j : j + width] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out.append((None if i == NULL_ID else i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
