"""Token ids as binary shards with a minimal perfect hash index.

File format. A store is a Parquet folder, so that it can live in any store
Spark writes to and is committed as a whole; one row is one shard:

part, shard      place in the ascending order of doc_id
first            ids before the shard within its part
lo, hi           smallest and largest doc_id (null where it holds null ids only)
n_docs, n_tokens
width            bytes per id: 2 or 4
payload          the raw ids, little-endian, documents in order
seeds            int32 per bucket: seed of its keys, or -1 - slot of its one key
keys             by slot: doc_id (int64, 0 for null), occurrence (int32, -1 - k for null ids)
prints, starts   by slot: 32-bit fingerprint of the key; int64 start and length in the payload

A key is a doc_id and its occurrence within the shard. Lookup hashes the key to
a bucket, the bucket's seed (or slot) gives the key's slot, the slot's stored
fingerprint and its one stored key are compared, and the slot holds the offset:
constant time. A lookup reads the index columns of the shards whose range of
doc_ids holds the key, and then the bytes of that document alone leave the scan.

Words between ASCII spaces never merge in the tokenizer (its rules stop at
white space), nor do a word of letters and the mark behind it, so a worker process
encodes a distinct word once and joins whole texts from a word table of at most
``CACHE_BYTES`` (and the words of its last window), kept for the tasks of the stage
(``words.py``).
Words of plain letters are one pre-token each and are encoded by the tokenizer's
model behind a cut at spaces, without its normalizer and regular expression,
where that gives the same ids. A worker keeps the tokenizer itself for good.

Defined cases: null and empty texts hold the end id only; null ids sort first;
repeated ids are separate documents, in an order fixed by their text; a very
long text is one document, in a shard of its own if need be; an empty table
gives an empty store; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copse.llm.common import give_back, held, shared_dir
from copse.llm.words import MARKS, WordTable, flags, letter_before

END_ID, SHARD_TOKENS, LINE_WORDS, DOCS = 1, 1 << 20, 500, 1024
#: Bytes of text that are cut into words at a time.
WINDOW = 1 << 22
#: Bound of a word table, and what an entry takes beside its two byte strings.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 170

SCHEMA = "part int, shard int, first long, lo long, hi long, n_docs long, n_tokens long, width int, payload binary, keys binary, seeds binary, prints binary, starts binary"

TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


# --- minimal perfect hash --------------------------------------------------


def key_bytes(doc_id: int, occurrence: int) -> bytes:
    return int(doc_id).to_bytes(8, "little", signed=True) + int(occurrence).to_bytes(4, "little", signed=True)


def mph_build(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(seeds by bucket, slot of each key): buckets of about four keys, large ones first, each by the first seed that fits."""
    n = len(keys)
    buckets: list[list[int]] = [[] for _ in range(max(1, n // 4))]
    for i, k in enumerate(keys):
        buckets[xxhash.xxh64_intdigest(k, 0) % len(buckets)].append(i)
    seeds, slots, used = np.zeros(len(buckets), np.int32), np.zeros(n, np.int64), bytearray(n)
    order = sorted(range(len(buckets)), key=lambda b: -len(buckets[b]))
    free = 0
    for b in order:
        own = buckets[b]
        if len(own) > 1:
            seed = 1
            while True:
                at = [xxhash.xxh64_intdigest(keys[i], seed) % n for i in own]
                if len(set(at)) == len(at) and not any(used[s] for s in at):
                    break
                seed += 1
            seeds[b] = seed
        elif own:
            while used[free]:
                free += 1
            at = [free]
            seeds[b] = -1 - free
        else:
            continue
        for i, s in zip(own, at, strict=True):
            slots[i], used[s] = s, 1
    return seeds, slots


def mph_slot(key: bytes, seeds, n: int) -> int:
    seed = int(seeds[xxhash.xxh64_intdigest(key, 0) % len(seeds)])
    return -1 - seed if seed < 0 else xxhash.xxh64_intdigest(key, seed) % n


# --- encoding --------------------------------------------------------------


#: The tokenizer's own cut into pre-tokens; it only counts them here, and a wrong count is noticed.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Letters that neither normalizing nor lower-casing changes, UTF-8.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: White space that parts words, and marks, by byte.
WHITE, MARK = flags(b" \t\n\r\x0b\x0c"), flags(MARKS.encode())
#: By byte: white space as a space; and A-Z lower-cased, too.
SPACED = np.where(WHITE, 0x20, np.arange(256)).astype(np.uint8)
FOLDED = np.frombuffer(SPACED.tobytes().lower(), np.uint8)
PROBE = [chr(c) + w for c in (*range(97, 123), *range(0xDF, 0x100)) if c != 0xF7 for w in ("", "the", "ändern", "ing\u00e9")]


def n_cuts(word: str) -> int:
    if word.isalpha() and word.lower().isalpha():
        return 1
    return len(CUT.findall(unicodedata.normalize("NFC", word).lower()))


def core_of(word: bytes) -> bytes:
    """The word without a last mark, if the rest are letters only; else the word."""
    if MARK[word[-1]]:
        core = word[:-1]
        if core.isalpha() or not core.isascii() and core.decode("utf-8", "replace").lower().isalpha():
            return core
    return word


@cache
def loaded(path: str):
    """(tokenizer, bytes per id, which ids end a word, special tokens, folds case, splits off marks, its model for plain words): once a worker process, as a load isn't given back whole."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    if resize := getattr(tok.model, "_resize_cache", None):
        resize(0)  # a word comes once: the model's own word cache is only looked up in vain
    lite = Tokenizer(tok.model)
    lite.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocab = tok.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    one = lambda x: tok.encode(x, add_special_tokens=False).ids
    splits = all(one(w + m + r) == one(w) + one(m + r) for m in MARKS for w in ("word", "\u00e9") for r in ("", "word"))
    return tok, 2 if len(ends) <= 1 << 16 else 4, ends, [t.content for t in tok.get_added_tokens_decoder().values()], one("ABC Xyz") == one("abc xyz"), splits, lite if all(lite.encode(x, add_special_tokens=False).ids == one(x) for x in (*PROBE, " ".join(PROBE))) else None


class WordEncoder(WordTable):
    """Ids of whole texts, word by word.

    A word begins with white space, or with a mark after a letter; the table has
    words as they are written but for white space and, as the tokenizer folds case
    anyway, A-Z. New words are encoded a line at a time. Where every pre-token ends
    in an id marked as a word's end, the marks cut the line's ids back into words;
    lines whose marks don't add up, and tokenizers without marks, go word by word.
    """

    def __init__(self, path: str):
        self.tok, self.width, self.ends, self.special, self.folds, self.splits, self.lite = loaded(path)
        super().__init__(f"<u{self.width}", ENTRY_BYTES)

    @property
    def cache(self) -> dict[bytes, bytes]:
        return self.known

    def cuts(self, raw, bounds, lo, hi):
        own = raw[lo:hi]
        begin = WHITE[own]
        begin[1:] &= ~begin[:-1]
        if self.splits:
            at = lo + np.flatnonzero(MARK[own])
            begin[at[letter_before(raw, at)] - lo] = True
        a, b = np.searchsorted(bounds, (lo, hi))
        begin[bounds[a:b] - lo] = True
        begin[0] = True
        return lo + np.flatnonzero(begin)

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(self.tok.encode(w, add_special_tokens=False).ids, self.dtype).tobytes() for w in words]

    def _line(self, words: list[str], plain: bool) -> list[bytes]:
        line = " ".join(words)
        if not self.ends.any() or any(t in line for t in self.special):
            return self._alone(words)
        ids = np.array((self.lite if plain else self.tok).encode_batch_fast([line], add_special_tokens=False)[0].ids, self.dtype)
        marks = np.flatnonzero(self.ends[ids]) + 1
        counts = np.arange(1, len(words) + 1) if plain else np.cumsum([1 if w.isascii() and w.isalpha() else n_cuts(w) for w in words])
        if not len(marks) or len(marks) != counts[-1] or marks[-1] != len(ids) or (np.diff(counts, prepend=0) == 0).any():
            return self._alone(words)
        raw, cuts = ids.tobytes(), (marks[counts - 1] * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def learn(self, fresh):
        bare = [w.lstrip() for w in fresh]
        plain, other = set(), set()
        for w in filter(None, bare):
            if self.lite and (w.isalpha() and w.islower() or PLAIN.fullmatch(w)):
                plain.add(w)
            else:
                core = core_of(w) if self.splits else w
                other.update((core, w[len(core) :]))
        other.discard(b"")
        ids = {b"": b""}
        for words, one_cut in ((list(plain), True), (list(other), False)):
            for at in range(0, len(words), LINE_WORDS):
                own = words[at : at + LINE_WORDS]
                ids.update(zip(own, self._line(b" ".join(own).decode().split(" "), one_cut), strict=True))
        self.keep(fresh, [ids[w] if w in ids else ids[w[:-1]] + ids[w[-1:]] for w in bare])

    def encode_array(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (and the last's end)."""
        # a special token is told by its case
        self.fold = FOLDED if self.folds and not pc.any(pc.match_substring(text, "<|")).as_py() else SPACED
        return self.ids_of(text, WINDOW, CACHE_BYTES)

    def encode(self, texts) -> list[bytes]:
        ids, starts = self.encode_array(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _shard_row(part: int, shard: int, first: int, docs: list, width: int, end: bytes):
    seen: dict = {}
    keys, bodies = [], []
    for doc, body in docs:
        k = seen[doc] = seen.get(doc, -1) + 1
        keys.append((0, -1 - k) if doc is None else (doc, k))
        bodies.append(body + end)
    raw = [key_bytes(*k) for k in keys]
    seeds, slots = mph_build(raw)
    n = len(raw)
    lengths = np.array([len(b) // width for b in bodies], np.int64)
    starts, prints = np.zeros((n, 2), "<i8"), np.zeros(n, "<u4")
    starts[slots, 0], starts[slots, 1] = np.cumsum(lengths) - lengths, lengths
    prints[slots] = [xxhash.xxh32_intdigest(k, 7) for k in raw]
    by_slot = [raw[i] for i in np.argsort(slots)]
    ids = [d for d, _ in docs if d is not None]
    return (part, shard, first, min(ids, default=None), max(ids, default=None), n, int(lengths.sum()), width, b"".join(bodies), b"".join(by_slot), seeds.astype("<i4").tobytes(), prints.tobytes(), starts.tobytes())


def _write(path: str, shard_tokens: int):
    def run(batches):
        enc = held(f"words of {path}", lambda: WordEncoder(path))
        end = np.array([END_ID], enc.dtype).tobytes()
        part, shard, first, docs, size = TaskContext.get().partitionId(), 0, 0, [], 0
        kinds = [(name, TYPES[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))]

        def frame(row):
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(row, kinds, strict=True)], names=[name for name, _ in kinds])

        try:
            for b in (b.slice(at, DOCS) for b in batches for at in range(0, b.num_rows, DOCS)):
                ids, starts = enc.encode_array(b.column("text"))
                starts = starts.tolist()
                for doc, at, to in zip(b.column("doc_id").to_pylist(), starts[:-1], starts[1:], strict=True):
                    n = to - at + 1
                    if docs and size + n > shard_tokens:
                        yield frame(_shard_row(part, shard, first, docs, enc.width, end))
                        shard, first, docs, size = shard + 1, first + size, [], 0
                    docs.append((doc, ids[at:to].tobytes()))
                    size += n
            if docs:
                yield frame(_shard_row(part, shard, first, docs, enc.width, end))
        finally:
            del docs
            give_back()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, *, doc_id="doc_id", text="text", shard_tokens=SHARD_TOKENS) -> None:
    """Encodes whole texts in ascending doc_id order and writes the shards to the folder path."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    d = d.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    d.select("doc_id", "text").mapInArrow(_write(tokenizer, shard_tokens), SCHEMA).write.parquet(path)


# --- reading ---------------------------------------------------------------


def place(key: bytes, row) -> tuple[int, int] | None:
    """(start, length) in ids of one key of a shard row's index, or None where the slot's fingerprint or key says that it isn't there."""
    prints, seeds = np.frombuffer(row["prints"], "<u4"), np.frombuffer(row["seeds"], "<i4")
    if not len(prints):
        return None
    slot = mph_slot(key, seeds, len(prints))
    if prints[slot] != xxhash.xxh32_intdigest(key, 7) or bytes(row["keys"][12 * slot : 12 * slot + 12]) != key:
        return None
    start, n = np.frombuffer(row["starts"], "<i8", 2, 16 * slot)
    return int(start), int(n)


def _read(batches):
    for b in batches:
        for k in range(b.num_rows):  # one shard at a time, its payload not copied
            r = {c: b.column(c)[k] for c in b.schema.names}
            n, first, part, width = (r[c].as_py() for c in ("n_docs", "first", "part", "width"))
            index = {c: r[c].as_py() for c in ("seeds", "prints", "starts", "keys")}
            ids = np.frombuffer(r["payload"].as_buffer(), f"<u{width}")
            rows = []
            for key in (index["keys"][i : i + 12] for i in range(0, 12 * n, 12)):
                found = place(key, index)
                if found is None:
                    raise ValueError("a stored key isn't found through its index")
                start, size = found
                occurrence = int.from_bytes(key[8:], "little", signed=True)
                doc = None if occurrence < 0 else int.from_bytes(key[:8], "little", signed=True)
                rows.append((doc, part, first + start, size, zlib.crc32(ids[start : start + size].astype("<u4"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "part", "local", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document, through the index: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = shards.drop("shard", "lo", "hi", "n_tokens").mapInArrow(_read, "doc_id long, part int, local long, n_tokens long, ids_crc32 long")
    return found.join(parts, "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def ids_of(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Keyed access: the ids of every document with this doc_id, by the index of the shards whose range holds it and a byte range of each."""
    shards = spark.read.parquet(path).filter((F.col("lo") <= doc_id) & (F.col("hi") >= doc_id))
    out = []
    for r in shards.select("part", "shard", "width", "seeds", "prints", "starts", "keys").orderBy("part", "shard").toLocalIterator():
        k = 0
        while (found := place(key_bytes(doc_id, k), r)) is not None:
            start, n = found
            w = r["width"]
            own = shards.filter((F.col("part") == r["part"]) & (F.col("shard") == r["shard"]))
            body = own.select(F.substring("payload", start * w + 1, n * w)).first()[0]
            out.append(np.frombuffer(body, f"<u{w}").tolist())
            k += 1
    return out


def new_store(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
