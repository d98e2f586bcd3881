"""Packing of documents into training sequences of a fixed number of tokens.

A document's ids and its end id are one piece, or, where they are over the
capacity, pieces of exactly the capacity after a shorter first one. A full piece
is a sequence. How the others are put together depends on how many pieces there
are of each length, so it is planned on these counts alone, at most ``capacity``
numbers however large the corpus: see ``plan``. The plan gives each length's
pieces, by rank, places in sequences; Spark ranks the pieces (within a task as
they are written, across tasks by sums of their counts) and looks up the places.

Texts are encoded in words cut where the tokenizer's own rules cut too, and a word
table of at most ``CACHE_BYTES`` keeps what was met (``words.py``). Windows of
``RUN_CHARS`` bytes bound the memory of a very long text's words; a batch's ids are
held whole (two bytes each).

Defined cases: null and empty texts are the end id alone; a null id stays null;
repeated rows and ids are separate documents, each with pieces of its own; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.llm.common import give_back, held, stored
from copse.llm.words import MARKS, WordTable, flags, letter_before

CAPACITY, END_ID, LINE_WORDS, ROWS = 1024, 2, 500, 4096
#: Bytes of text that are cut into words at a time.
RUN_CHARS = 1 << 24
#: Bound of a word table, and what an entry takes beside its two strings.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 150

PIECES = "doc_id long, piece int, start long, length int, ids binary, width int, ids_crc32 long, task int, nth long"


# --- the plan --------------------------------------------------------------


@dataclass
class Bins:
    """Sequences that are filled alike: how many, what is free in each, and (length, copies) of what they hold."""

    count: int
    gap: int
    parts: tuple[tuple[int, int], ...]


@dataclass
class Planner:
    """Consumes counts of lengths into bins.

    Pieces of over half the capacity open a bin each. Then the longest length left
    leads exact combinations for the smallest gap that suffices for it: alone, or
    with one or two others whose lengths add up to the rest (an index of single
    lengths and of pair sums, so of triples), each taken as often as the counts
    allow, which uses up a length or the bins. What is left goes, longest first,
    into the smallest sufficient gap or else a new bin, and a gap that then has an
    exact combination of up to three takes it.
    """

    counts: dict[int, int]
    capacity: int = CAPACITY
    closed: list[Bins] = field(default_factory=list)
    open: dict[int, list[Bins]] = field(default_factory=lambda: defaultdict(list))
    pairs: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def __post_init__(self):
        self.lengths = sorted((n for n, c in self.counts.items() if c > 0), reverse=True)

    def _times(self, combination: tuple[int, ...]) -> int:
        """How often the counts allow it."""
        return min(self.counts[n] // combination.count(n) for n in combination)

    def _pair(self, total: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths with this sum that are there beside those held, the longest first; pairs that are used up leave the index."""
        if total not in self.pairs:
            self.pairs[total] = [(n, total - n) for n in reversed(self.lengths) if total - n <= n < total and total - n in self.counts]
        found = self.pairs[total]
        for i in range(len(found) - 1, -1, -1):
            if not self._times(found[i]):
                del found[i]
            elif self._times((*held, *found[i])):
                return found[i]
        return None

    def exact(self, gap: int, held: tuple[int, ...] = (), most: int = 3) -> tuple[int, ...] | None:
        """One, two or three (at most so many) lengths that are there beside those held and fill the gap, the longest first."""
        if gap in self.counts and self._times((*held, gap)):
            return (gap,)
        if found := self._pair(gap, held):
            return found
        for n in self.lengths if most > 2 else ():
            if n < gap - 1 and self._times((*held, n)) and (found := self._pair(gap - n, (*held, n))):
                return n, *found
        return None

    def _gap(self, n: int) -> int | None:
        """The smallest gap of open bins that a piece of length n fits."""
        return next((g for g in range(n, self.capacity) if self.open.get(g)), None)

    def _use(self, combination, times: int) -> None:
        for n in combination:
            self.counts[n] -= times

    def _exactly(self, bins: Bins) -> Bins | None:
        """Closes as many of the bins as exact combinations allow; returns the others."""
        while bins.count and bins.gap and (c := self.exact(bins.gap)):
            times = min(bins.count, self._times(c))
            self._use(c, times)
            self.closed.append(Bins(times, 0, (*bins.parts, *((n, 1) for n in c))))
            bins = Bins(bins.count - times, bins.gap, bins.parts)
        if bins.count and not bins.gap:
            self.closed.append(bins)
            return None
        return bins if bins.count else None

    def begin(self) -> None:
        """Pieces of over half the capacity: each needs a sequence of its own."""
        for n in self.lengths:
            if 2 * n > self.capacity:
                bins = Bins(self.counts[n], self.capacity - n, ((n, 1),))
                (self.open[bins.gap] if bins.gap else self.closed).append(bins)
                self.counts[n] = 0

    def _led_by(self, n: int, gap: int) -> tuple[int, ...] | None:
        """An exact combination of at most three lengths for the gap, n the first."""
        if gap == n:
            return (n,)
        found = self.exact(gap - n, (n,), 2)
        return found and (n, *found)

    def complements(self) -> None:
        """Exact complements, led by the longest length left, of the smallest gap that suffices for it."""
        for n in self.lengths:
            while self.counts[n] and (gap := self._gap(n)) and (found := self._led_by(n, gap)):
                bins = self.open[gap].pop()
                times = min(bins.count, self._times(found))
                self._use(found, times)
                self.closed.append(Bins(times, 0, (*bins.parts, *((x, 1) for x in found))))
                if bins.count > times:
                    self.open[gap].append(Bins(bins.count - times, gap, bins.parts))
            while self.counts[n] and not self._gap(n) and (found := self.exact(self.capacity - n, (n,))):
                times = self._times((n, *found))
                self._use((n, *found), times)
                self.closed.append(Bins(times, 0, tuple((x, 1) for x in (n, *found))))

    def residuals(self) -> None:
        """Best fit, longest first; a gap that then has an exact combination takes it."""
        for n in self.lengths:
            while left := self.counts[n]:
                gap = self._gap(n)
                bins = self.open[gap].pop() if gap else Bins(left, self.capacity, ())
                copies = bins.gap // n  # the next best fit of as long a piece is the same bin
                times = min(bins.count, left // copies)
                if not times:
                    times, copies = 1, left
                if gap and bins.count > times:
                    self.open[gap].append(Bins(bins.count - times, gap, bins.parts))
                self.counts[n] -= times * copies
                rest = self._exactly(Bins(times, bins.gap - copies * n, (*bins.parts, (n, copies))))
                if rest:
                    self.open[rest.gap].append(rest)

    def run(self) -> list[Bins]:
        self.begin()
        self.complements()
        self.residuals()
        return self.closed + [b for bins in self.open.values() for b in bins]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Bins that hold all pieces, from the number of pieces of each length; the number of kinds of bins follows the lengths, not the pieces."""
    return Planner(dict(counts), capacity).run()


def places(bins: list[Bins]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, copies in a bin, first sequence, offset), by rank: ranks go to the bins of a kind in turn."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for b in bins:
        offset = 0
        for n, copies in b.parts:
            out[n].append((used[n], copies, sequence, offset))
            used[n] += b.count * copies
            offset += n * copies
        sequence += b.count
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


# --- pieces ----------------------------------------------------------------


@cache
def loaded(path: str):
    """(tokenizer, type of an id, pattern of special tokens, which ids begin with a space, id of a line break if that parts words, marks that it cuts before): once a worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    if resize := getattr(tok.model, "_resize_cache", None):
        resize(0)  # a word comes once: the model's own word cache is only looked up in vain
    added = sorted(tok.get_added_tokens_decoder().values(), key=lambda t: -len(t.content))
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
        raise ValueError("added tokens that take in or ask for their surroundings aren't supported")
    special = re.compile("(" + "|".join(re.escape(t.content) for t in added) + ")") if added else None
    vocab = tok.get_vocab()
    begins = np.zeros(max(vocab.values()) + 1, bool)
    begins[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # the byte-level sign of a space
    one = lambda x: tok.encode(x, add_special_tokens=False).ids
    line = one("\n")
    line = line[0] if len(line) == 1 and one("word\nWord,\n'") == [*one("word"), *line, *one("Word,"), *line, *one("'")] else None
    marks = flags(ord(m) for m in MARKS + "\n" if all(one(w + m + r) == one(w) + one(m + r) for w in ("word", "\u00e9") for r in ("", "word")))
    return tok, "<u2" if len(begins) <= 1 << 16 else "<u4", special, begins, line, marks


#: Printable ASCII, and lead bytes that white space may have.
PRINTED, WIDE = flags(range(0x21, 0x7F)), flags((0xC2, 0xE1, 0xE2, 0xE3))


class TextEncoder(WordTable):
    """Ids of whole texts, through a table of words with the space before them, if any.

    A word begins with a space that other than white space follows, with a mark or
    a line break after a letter, or after a line break between printed characters.
    New words are encoded a line at a time: an id that begins with a space begins a
    word of the line, and words without one are parted by line breaks. Where these
    don't add up, and where white space is in a word, words are encoded one by one.
    """

    def __init__(self, path: str):
        self.tok, dtype, self.special, self.begins, self.line, self.marks = loaded(path)
        super().__init__(dtype, ENTRY_BYTES)

    def cuts(self, raw, bounds, lo, hi):
        own, begin = raw[lo:hi], np.zeros(hi - lo, bool)
        at = lo + np.flatnonzero(own == 0x20)
        after = raw[np.minimum(at + 1, len(raw) - 1)]
        at = at[after > 0x20]
        if len(wide := np.flatnonzero(WIDE[raw[np.minimum(at + 1, len(raw) - 1)]])):  # white space is U+85, U+A0, U+1680, U+20.., U+3000
            one, two = raw[at[wide] + 1], raw[at[wide] + 2]
            white = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) | (one == 0xE2) & (two < 0x82) | (one == 0xE3) & (two == 0x80)
            at = np.delete(at, wide[white])
        begin[at - lo] = True
        a, b = np.searchsorted(bounds, (lo, hi), side="right")
        begin[bounds[a:b] - 1 - lo] = False  # nothing follows a text's last space
        at = lo + np.flatnonzero(self.marks[own])
        begin[at[letter_before(raw, at)] - lo] = True
        if self.line is not None:
            at = lo + np.flatnonzero(own[:-1] == 0x0A) + 1
            at = at[at > 1]
            begin[at[PRINTED[raw[at - 2]] & PRINTED[raw[at]]] - lo] = True
        a, b = np.searchsorted(bounds, (lo, hi))
        begin[bounds[a:b] - lo] = True
        begin[0] = True
        return lo + np.flatnonzero(begin)

    def _each(self, words: list[bytes]) -> list[bytes]:
        found = self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _line(self, words: list[bytes], spaced: bool) -> list[bytes]:
        line = (b"" if spaced else b"\n").join(words).decode()
        ids = np.array(self.tok.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.dtype)
        first = np.flatnonzero(self.begins[ids]) if spaced else np.append(0, np.flatnonzero(ids == self.line) + 1)
        if len(first) != len(words) or first[0]:
            return self._each(words)
        raw, size = ids.tobytes(), ids.itemsize
        ends = np.append(first[1:] - (not spaced), len(ids))
        return [raw[a:b] for a, b in zip((first * size).tolist(), (ends * size).tolist(), strict=True)]

    def learn(self, fresh):
        kinds: tuple[list[bytes], ...] = [], [], []
        for w in fresh:
            spaced = w[0] == 0x20
            bare = w[spaced:]
            text = bare.decode()
            whole = text.isalpha() or text.split(None, 1) == [text]
            kinds[spaced if whole and (spaced or self.line is not None) else 2].append(w)
        for spaced, words in enumerate(kinds):
            for at in range(0, len(words), LINE_WORDS):
                own = words[at : at + LINE_WORDS]
                self.keep(own, self._each(own) if spaced == 2 else self._line(own, bool(spaced)))

    def encode_array(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (and the last's end)."""
        if not self.special or not pc.any(pc.match_substring_regex(text, self.special.pattern)).as_py():
            return self.ids_of(text, RUN_CHARS, CACHE_BYTES)
        # the tokenizer takes special tokens out first, too
        parts = [self.special.split(t or "") for t in text.to_pylist()]
        ids, starts = self.ids_of(pa.array([x for p in parts for x in p[::2]], pa.large_string()), RUN_CHARS, CACHE_BYTES)
        out, at, ends = [], 0, [0]
        for p in parts:
            for j, x in enumerate(p):
                if j % 2:
                    out.append(np.array(self.tok.encode(x, add_special_tokens=False).ids, self.dtype))
                else:
                    out.append(ids[starts[at] : starts[at + 1]])
                    at += 1
            ends.append(ends[-1] + sum(map(len, out[len(out) - len(p) :])))
        return np.concatenate([*out, ids[:0]]), np.array(ends)

    def encode(self, text: str) -> bytes:
        return self.encode_array(pa.array([text], pa.large_string()))[0].tobytes()


def _cut(path: str, capacity: int, end_id: int):
    """Kernel: pieces of documents, with the task that wrote them and their number among its pieces of that length."""

    def run(batches):
        enc = held(f"packing words of {path}", lambda: TextEncoder(path))
        width, task, seen = enc.dtype.itemsize, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        names = [c.split()[0] for c in PIECES.split(", ")]
        try:
            for b in batches:
                ids, starts = enc.encode_array(b.column("text"))
                ids = np.insert(ids, starts[1:], end_id)
                starts += np.arange(len(starts))
                size = np.diff(starts)
                n = -(-size // capacity)
                head = size - (n - 1) * capacity
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                start = np.where(piece, head[doc] + (piece - 1) * capacity, 0)
                edges = np.append(starts[doc] + start, len(ids))
                length = np.diff(edges)
                order = np.argsort(length, kind="stable")
                own = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) + (seen - np.cumsum(own) + own)[length[order]]
                seen += own
                for i in range(0, len(doc), ROWS):
                    k = slice(i, min(i + ROWS, len(doc)))
                    at = edges[i : k.stop + 1] - edges[i]
                    body = ids[edges[i] : edges[k.stop]]
                    wide = body.astype("<u4")
                    body = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(body)])
                    crcs = [zlib.crc32(wide[x:y]) for x, y in itertools.pairwise(at.tolist())]
                    columns = (b.column("doc_id").take(pa.array(doc[k])), piece[k].astype(np.int32), start[k], length[k].astype(np.int32), body, np.full(len(crcs), width, np.int32), np.array(crcs, np.int64), np.full(len(crcs), task, np.int32), nth[k])
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)
        finally:
            give_back()

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of whole texts, written once: PIECES. task and nth number the pieces of a length."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(d.mapInArrow(_cut(tokenizer, capacity, end_id), PIECES), "pieces")


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    at = cut.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = [c for c in cut.columns if c not in ("task", "nth")]

    def run(batches):
        for pdf in batches:
            rank, length = (pdf["before"] + pdf["nth"]).to_numpy(np.int64), pdf["length"].to_numpy()
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                rows = at.value[n]
                first, copies, base, start = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1].T
                k = rank[own] - first
                sequence[own], offset[own] = base + k // copies, start + k % copies * n
            yield pdf[names].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"
    return cut.join(offsets, ["task", "length"]).mapInPandas(run, schema)


def sequences(found: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids): each sequence's pieces in place; a group has at most as many pieces as the capacity."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids", "length")))
    g = found.groupBy("sequence_id").agg(own.alias("p"))
    joined = F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return g.select("sequence_id", F.aggregate("p", F.lit(0), lambda a, x: a + x["length"]).alias("n_tokens"), F.col("p.doc_id").alias("doc_ids"), joined.alias("ids"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; packed(cut.drop("ids")) will do, and moves no ids."""
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
