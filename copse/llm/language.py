"""Language identification by segmentation-marginalised unigram piece models.

The vocabulary is a public one (sentencepiece pieces; the file is a parameter).
Each language has a unigram distribution over its pieces, learned from piece
counts in a bounded sample of labelled documents: ``SAMPLE_DOCS`` a language
in expectation, chosen by a hash of doc_id against each language's row count.
A text's likelihood is the product over its words of the sum over all ways to
cut the word into pieces (forward algorithm, all languages at once, many short
words per NumPy call; a long word by itself, in runs of ``RUN`` characters that
carry the last sums on, so its length is bounded by nothing). Control, unknown,
unused and byte pieces of the vocabulary, as the processor types them, stand
for no text and are left out. score is the posterior of the winner under equal
priors. A worker process holds one model and at most ``CACHE_WORDS`` words of at
most ``WORD`` characters for the tasks of the stage.

Defined cases: null text, or one without a letter, is ``und`` with score 0;
ties go to the first language by name; with no labelled rows every text is
``und``; repeated and null doc_ids are kept row by row; a very long text, or a
very long word, is scored whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.common import give_back, held

SAMPLE_DOCS, SMOOTH, UNKNOWN = 1000, 0.1, 1e-7
WORD, RUN, CACHE_WORDS, RUN_WORDS = 48, 1 << 16, 100_000, 50_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _counts(path: str):
    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        apart = {i for i in range(sp.vocab_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        for b in batches:
            n: dict = {}
            for lang, text in zip(b["lang"], b["text"], strict=True):
                for i in sp.encode(text, num_threads=1):
                    if i not in apart:
                        n[lang, i] = n.get((lang, i), 0) + 1
            yield pd.DataFrame([(*k, sp.id_to_piece(k[1]), v) for k, v in n.items()], columns=["lang", "id", "piece", "n"])

    return run


def train(labelled: DataFrame, vocabulary: str, *, doc_id="doc_id", text="text", lang="lang", sample_docs=SAMPLE_DOCS) -> tuple[list[str], dict[str, np.ndarray]]:
    """(languages, piece -> probability by language) from rows with text and language."""
    d = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["rows"] for r in d.groupBy("lang").agg(F.count("*").alias("rows")).collect()}  # a row for each label
    if not sizes:
        return [], {}
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    chance = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(sample_docs / n))])
    sample = d.filter(share < chance[F.col("lang")]).select("lang", "text")
    got = sample.mapInPandas(_counts(vocabulary), "lang string, id int, piece string, n long").groupBy("lang", "id", "piece").agg(F.sum("n").alias("n")).collect()  # languages x vocabulary at most
    langs = sorted({r["lang"] for r in got})
    table: dict[str, np.ndarray] = {}
    for r in got:
        table.setdefault(r["piece"], np.zeros(len(langs)))[langs.index(r["lang"])] += r["n"]
    if table:
        total = sum(table.values()) + SMOOTH * len(table)
        table = {p: (c + SMOOTH) / total for p, c in table.items()}
    return langs, table


class Forward:
    """Log-probabilities of words, by language, marginal over all cuts into known pieces."""

    def __init__(self, langs: list[str], table: dict[str, np.ndarray]):
        self.langs = langs
        by_len: dict[int, list[str]] = {}
        for p in table:
            by_len.setdefault(len(p), []).append(p)
        pieces = list(itertools.chain.from_iterable(by_len.values()))
        keys = np.concatenate([self._keys(self._codes("".join(own)).reshape(len(own), n)) for n, own in by_len.items()]) if pieces else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.probs = np.array([table[p] for p in pieces]).reshape(len(pieces), len(langs))[order]
        self.longest = max(by_len, default=1)
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)

    @staticmethod
    def _keys(codes: np.ndarray) -> np.ndarray:
        h = np.full(len(codes), 7, np.uint64)
        with np.errstate(over="ignore"):
            for c in codes.T:
                h = (h ^ c) * _MULT
        return h

    def _steps(self, codes: np.ndarray):
        """For each length l, (places in the table, whether known) of the pieces of l characters from each start."""
        m, n = codes.shape
        h = np.full((m, n), 7, np.uint64)
        with np.errstate(over="ignore"):
            for l in range(1, min(self.longest, n) + 1):
                h = (h[:, : n - l + 1] ^ codes[:, l - 1 :]) * _MULT
                at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
                yield at, self.keys[at] == h if len(self.keys) else np.zeros(h.shape, bool)

    def words(self, words: list[str]) -> np.ndarray:
        """Rows of log-probabilities of words."""
        out = np.zeros((len(words), len(self.langs)))
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > WORD:
                out[i] = self.long_word(w)
            else:
                by_len.setdefault(len(w) + 1, []).append(i)
        for n, at in by_len.items():
            run = max(1, 300_000 // n)
            for k in range(0, len(at), run):
                own = at[k : k + run]
                out[own] = self._forward(self._codes("".join("▁" + words[i] for i in own)).reshape(len(own), n))
        return out

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        m, n = codes.shape
        a = np.zeros((n + 1, m, len(self.langs)))
        a[0] = 1.0
        scale = np.zeros(m)
        step = list(self._steps(codes))
        for j in range(1, n + 1):
            for l in range(1, min(len(step), j) + 1):
                at, hit = step[l - 1]
                r = np.flatnonzero(hit[:, j - l])
                if len(r):
                    a[j, r] += a[j - l, r] * self.probs[at[r, j - l]]
            lone = np.flatnonzero(~step[0][1][:, j - 1]) if step else np.arange(m)
            a[j, lone] += a[j - 1, lone] * UNKNOWN
            if j % 8 == 0 and j < n:  # rescale the window still in use, so nothing underflows
                top = np.maximum(a[j].max(axis=1), 1e-300)
                lo = max(0, j - self.longest)
                a[lo : j + 1] /= top[None, :, None]
                scale += np.log(top)
        return np.log(np.maximum(a[n], 1e-300)) + scale[:, None]

    def long_word(self, word: str) -> np.ndarray:
        """The same for one word of any length: known pieces are listed a run at a time, sums of the last few places carried on."""
        codes, keep = self._codes("▁" + word), self.longest
        n, scale = len(codes), 0.0
        a = np.zeros((keep + 1, len(self.langs)))  # sums at places done - keep .. done
        a[keep] = 1.0
        for done in range(0, n, RUN):
            lo, hi = max(0, done - keep), min(n, done + RUN)
            start, end, piece, known = [], [], [], np.zeros(hi - lo, bool)
            for l, (at, hit) in enumerate(self._steps(codes[None, lo:hi]), 1):
                s = np.flatnonzero(hit[0])
                if l == 1:
                    known[s] = True
                s = s[s + l + lo > done]
                start.append(s)
                end.append(s + l)
                piece.append(at[0, s])
            start, end, piece = map(np.concatenate, (start, end, piece))
            order = np.argsort(end, kind="stable")
            start, end, piece = start[order], end[order], piece[order]
            cuts = np.searchsorted(end, np.arange(done - lo + 1, hi - lo + 2))
            shift = keep - (done - lo)  # of a place within lo..hi to its row
            a = np.concatenate([a, np.zeros((hi - done, len(self.langs)))])
            for k in range(hi - done):
                own, j = slice(cuts[k], cuts[k + 1]), keep + k + 1
                if cuts[k + 1] > cuts[k]:
                    a[j] = (a[start[own] + shift] * self.probs[piece[own]]).sum(axis=0)
                if not known[done - lo + k]:
                    a[j] += a[j - 1] * UNKNOWN
                if k % 8 == 7 or k == hi - done - 1:
                    top = max(a[j].max(), 1e-300)
                    a[max(0, j - keep) : j + 1] /= top
                    scale += np.log(top)
            a = a[-keep - 1 :].copy()
        return np.log(np.maximum(a[keep], 1e-300)) + scale

    def learn(self, words: set[str]) -> None:
        """Scores words not in the table."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.rows = {}, self.rows[:0]
        new = [w for w in words if len(w) <= WORD and w not in self.cache]
        self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, self.words(new)]) if new else self.rows

    def texts(self, texts) -> np.ndarray:
        """Summed log-probabilities of whole texts, in runs of about RUN_WORDS words."""
        out, run, size = [], [], 0

        def settle():
            nonlocal size
            self.learn(set().union(*run))
            at = self.cache.__getitem__
            for ws in run:
                short = [w for w in ws if len(w) <= WORD]
                own = self.rows[np.fromiter(map(at, short), np.int64, len(short))].sum(axis=0)
                out.append(own if len(short) == len(ws) else own + self.words([w for w in ws if len(w) > WORD]).sum(axis=0))
            run.clear()
            size = 0

        for t in texts:
            run.append(t.split())
            size += len(run[-1])
            if size >= RUN_WORDS:
                settle()
        settle()
        return np.array(out).reshape(len(out), len(self.langs))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _predict(model):
    def run(batches):
        f = held("language model", lambda: Forward(*model.value))
        try:
            for b in batches:
                texts = [t if t and has_letter(t) else None for t in b["text"]]
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
                own = [i for i, t in enumerate(texts) if t is not None] if f.langs else []
                if own:
                    s = f.texts(texts[i] for i in own)
                    top = s.argmax(axis=1)
                    post = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, k, p in zip(own, top, post, strict=True):
                        pred[i], score[i] = f.langs[k], p
                out = b.drop(columns=["text"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out.assign(lang_pred=pred, score=score)
        finally:
            give_back()

    return run


def identify(docs: DataFrame, model, *, doc_id="doc_id", text="text") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return d.mapInPandas(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def learnable(docs: DataFrame, *, doc_id="doc_id", lang="lang") -> DataFrame:
    """The rows that may be learned from."""
    return docs.filter((F.crc32(F.col(doc_id).cast("string")) % 3 != 1) & F.col(lang).isNotNull())


def _keep(model, text: str, least: float):
    predict = _predict(model)

    def run(batches):
        import pyarrow as pa

        held = []  # the batch whose texts are being judged

        def texts():
            for b in batches:
                held.append(b)
                yield pd.DataFrame({"doc_id": pd.array([0] * b.num_rows, "Int64"), "text": b.column(text).to_pylist()})

        for got in predict(texts()):
            yield held.pop().filter(pa.array(((got["lang_pred"] != "und") & (got["score"] >= least)).to_numpy(bool), pa.bool_()))

    return run


def accepted(docs: DataFrame, model, *, text="text", least=0.5) -> DataFrame:
    """docs, all columns, without texts that have no letters or no language of score least or more; no shuffle."""
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), text, least), docs.schema)
