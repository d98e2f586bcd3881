"""Personal data: pattern spans plus spans found by a semi-Markov conditional random field.

Four kinds have fixed patterns (their spans always stay). The field segments the
white-space tokens of the whole text: a segment is one token of no kind, or 1 to
``MAX_LEN`` tokens of a kind. Features describe the whole candidate span (shape,
length, mix of characters, runs, groups of digits, key words in or before it;
none of them asks a pattern), weights are per feature and kind, and transitions
per pair of labels. A segment of a kind must hold a marked token (one with a
digit, any of ``@=_+:`` or a piece of a key word), so tokens ``MAX_LEN`` or more
away from all marked ones can only be of no kind, and the best segmentation of
the text is that of its *islands*, each between segments of no kind. The dynamic
programme, bounded by MAX_LEN, chooses boundaries and kinds together; over long
islands it keeps its state at every root-of-length-th token and retraces one
block at a time, so it is exact at any length.

Weights come from gradient ascent on the conditional log-likelihood (forward
and backward sums over segments and label pairs) over islands of a bounded sample
of documents: ``TRAIN_DOCS`` in expectation, by a hash of doc_id, and of their
distinct islands, in runs of ``TRAIN_TOKENS`` tokens, those of least hash, up to
``TRAIN_ISLANDS`` for each set of kinds in them. The tables have no labels of
personal data: the patterns and the seed forms of secrets label the sample, and
the field has to tell the kinds by its own features.

Positions are code points, end exclusive. A span of the field that overlaps a
pattern's, or an earlier one, is left out. Defined cases: null is the empty
text and has no spans; of segmentations that tie, that with the earlier label
and shorter last segment is taken; a very long text is searched whole;
repeated and null doc_ids are kept row by row; an empty table gives an empty
result (and untrained weights); other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The contract's patterns and kinds, in its order.
KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MAX_LEN, TRAIN_DOCS, TRAIN_ISLANDS, TRAIN_TOKENS, EPOCHS, RATE, SPANS_KEPT = 5, 6000, 300, 24, 8, 0.4, 50_000
LABELS = ("none", *KINDS, "secret")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(t: str):
    """Leftmost matches of the email pattern, looked for around each ``@`` only."""
    at, last = t.find("@"), 0
    while at >= 0:
        s = at
        while s > last and t[s - 1] in _LOCAL_CHARS:
            s -= 1
        if s < at and (m := DOMAIN.match(t, at)):
            yield s, m.end()
            last = m.end()
        at = t.find("@", max(at + 1, last))


def base_spans(t: str) -> list[tuple[int, int, str]]:
    out = [(s, e, "email") for s, e in emails(t)]
    for m in IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return out


# --- the semi-Markov field -------------------------------------------------

MARK = re.compile(r"[0-9@=_+:]+|(?i:passw|pwd|token|secret|api|login|key)")
KEYWORD = re.compile(r"(?i)\W*\w*(?:passw|pwd|token|secret|api_?key|login|access_?key)")
TOKEN = re.compile(r"\S+")
RUNS = re.compile(r"[A-Za-z0-9]+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
EDGE = ".,;:!?\"'()#*$%&|<>"
#: Forms of secrets that label the training sample; no feature looks at them.
SEED = re.compile(r"""\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|pwd|token|secret|api_?key)\s*[=:]\s*"?[^\s"]{8,}"?""", re.I)


def islands(t: str):
    """Tokens of each island as (start, end, marked): marked ones and up to MAX_LEN - 1 others to either side."""
    own: list[tuple[int, int, bool]] = []
    end, plain = 0, 0  # where the island ends so far, and how many unmarked tokens end it
    at = 0
    while m := MARK.search(t, at):
        s, e = m.span()
        while s > end and not t[s - 1].isspace():
            s -= 1
        if x := TOKEN.match(t, e):
            e = x.end()
        before, k = [], s  # unmarked tokens before it, nearest first
        while len(before) < 2 * MAX_LEN:
            while k > end and t[k - 1].isspace():
                k -= 1
            if k <= end:
                break
            q = k
            while k > end and not t[k - 1].isspace():
                k -= 1
            before.append((k, q, False))
        if own and len(before) >= 2 * MAX_LEN - 2:  # too far from the last marked token: two islands
            for q in TOKEN.finditer(t, end):
                own.append((*q.span(), False))
                if len(own) - plain >= MAX_LEN - 1:
                    break
            yield own
            own = []
        own += [x for x in before[::-1] if own or x in before[: MAX_LEN - 1]]
        own.append((s, e, True))
        plain, end, at = len(own), e, e
    if own:
        for q in TOKEN.finditer(t, end):
            if len(own) - plain >= MAX_LEN - 1:
                break
            own.append((*q.span(), False))
        yield own


def shape(s: str) -> str:
    s = re.sub(r"[0-9]+", "9", s)
    s = re.sub(r"[a-z]+", "a", s)
    return re.sub(r"[A-Z]+", "A", s)[:12]


def features(s: str, tokens: int, after_key: bool) -> list[str]:
    """Features of the whole span s."""
    core = s.strip(EDGE) or s
    n, digits = len(core), sum(c.isdigit() for c in core)
    upper, own = sum(c.isupper() for c in core), RUNS.findall(core)
    run = max(own, key=len, default="")
    form = shape(core)
    f = ["any", f"tokens{tokens}", f"long{min(n // 4, 12)}", f"digits{min(digits, 20)}", f"share{digits * 4 // n}", f"upper{upper * 4 // n}", f"shape:{form}", f"head:{form[:2]}", f"tail:{form[-2:]}"]
    f += [f"has:{c}" for c in "@.-=:_+/ \"" if c in core]
    f += [f"dots{min(core.count('.'), 5)}", f"run{min(len(run) // 6, 7)}", f"kinds:{''.join(sorted(set(form)))}"]
    if not run.isdigit() and any(c.isdigit() for c in run):
        f.append("mixed run")
        f.append(f"mixed{min(len(run) // 8, 5)}")
    if QUAD.fullmatch(core):
        f.append("quad" if all(len(p) <= 3 and int(p) <= 255 for p in core.split(".")) else "large quad")
    if digits >= 12 and digits + core.count(" ") + core.count("-") == n:
        f.append("luhn" if luhn("".join(c for c in core if c.isdecimal() and c.isascii())) else "no luhn")
    if KEYWORD.match(s):
        f.append("key")
        f.append(f"key{min(n // 8, 6)}")
    if after_key:
        f.append("after key")
    return f


NONE, ENTITY = 0, len(LABELS) - 1
_NEVER = [-math.inf] * ENTITY


class SemiMarkov:
    """Segment weights by feature and kind, and transitions by pair of labels; no kind is the zero of both."""

    def __init__(self, weights: dict | None = None):
        self.w: dict[str, list[float]] = dict((weights or {}).get("features", {}))
        self.move: list[list[float]] = (weights or {}).get("moves") or [[0.0] * len(LABELS) for _ in LABELS]
        self.seen: dict[tuple[str, int, bool], list[float]] = {}

    def segment(self, t: str, toks, i: int, j: int) -> list[float]:
        """Scores of tokens i..j-1 as one segment of each kind."""
        if not any(x[2] for x in toks[i:j]):
            return _NEVER
        key = t[toks[i][0] : toks[j - 1][1]], j - i, i > 0 and KEYWORD.match(t[toks[i - 1][0] : toks[i - 1][1]]) is not None
        found = self.seen.get(key)
        if found is None:
            rows = [self.w[f] for f in features(*key) if f in self.w]
            found = [sum(c) for c in zip(*rows, strict=True)] if rows else [0.0] * ENTITY
            if len(self.seen) > SPANS_KEPT:
                self.seen.clear()
            if len(key[0]) <= 200:
                self.seen[key] = found
        return found

    def _block(self, t, toks, top: dict, lo: int, hi: int, back: dict | None) -> dict:
        """Best scores by label at lo+1..hi, from those at the MAX_LEN places up to lo; back gets the choices."""
        size, come = len(LABELS), {}
        top = dict(top)
        for j in range(lo + 1, hi + 1):
            here = [-math.inf] * size
            for i in range(j - 1, max(-1, j - MAX_LEN - 1), -1):
                if i not in come:
                    come[i] = [max((top[i][x] + self.move[x][y], -x) for x in range(size)) for y in range(size)]
                s = self.segment(t, toks, i, j)
                for y in range(size):
                    own = 0.0 if y == NONE and i == j - 1 else -math.inf if y == NONE else s[y - 1]
                    if come[i][y][0] + own > here[y]:
                        here[y] = come[i][y][0] + own
                        if back is not None:
                            back[j, y] = i, -come[i][y][1]
            top[j] = here
        return {k: v for k, v in top.items() if k > hi - MAX_LEN}

    def best(self, t: str, toks) -> list[tuple[int, int, int]]:
        """The best segmentation of an island: (first token, end token, label)."""
        n = len(toks)
        step = max(128, math.isqrt(n))
        states = {0: {0: [0.0] + [-math.inf] * (len(LABELS) - 1)}}
        for lo in range(0, n - step, step):
            states[lo + step] = self._block(t, toks, states[lo], lo, lo + step, None)
        out, j, y = [], n, None
        for lo in sorted(states, reverse=True):
            back: dict = {}
            top = self._block(t, toks, states[lo], lo, min(n, lo + step), back)
            if y is None:
                y = max(range(len(LABELS)), key=lambda y: (top[n][y] + self.move[y][NONE], -y))
            while j > lo:
                i, before = back[j, y]
                out.append((i, j, y))
                j, y = i, before
        return out[::-1]

    def learn(self, examples, epochs=EPOCHS, rate=RATE):
        """Gradient ascent on the log-likelihood of gold segmentations of (text, tokens, gold); steps shrink by each weight's past gradients."""
        names: dict[str, int] = {}
        made = []
        for t, toks, gold in examples:
            segs = []
            for i in range(len(toks)):
                for j in range(i + 1, min(len(toks), i + MAX_LEN) + 1):
                    if any(x[2] for x in toks[i:j]):
                        f = features(t[toks[i][0] : toks[j - 1][1]], j - i, i > 0 and KEYWORD.match(t[toks[i - 1][0] : toks[i - 1][1]]) is not None)
                        segs.append((i, j, np.array([names.setdefault(x, len(names)) for x in f])))
            made.append((len(toks), segs, gold))
        w, move = np.zeros((len(names), ENTITY)), np.zeros((len(LABELS), len(LABELS)))
        past_w, past_m = np.full(w.shape, 1e-2), np.full(move.shape, 1e-2)
        for _ in range(epochs):
            for n, segs, gold in made:
                scores = [w[f].sum(axis=0) for _, _, f in segs]
                p_seg, p_move, _ = expected(n, [(i, j) for i, j, _ in segs], scores, move)
                last = NONE
                for i, j, y in sorted(gold):
                    p_move[last, y] -= 1
                    last = y
                p_move[last, NONE] -= 1
                p_move[NONE, NONE] = 0.0
                past_m += p_move**2
                move -= rate * p_move / np.sqrt(past_m)
                for (i, j, f), p in zip(segs, p_seg, strict=True):
                    for y in range(1, len(LABELS)):
                        if (i, j, y) in gold:
                            p[y - 1] -= 1
                    if np.abs(p).max() > 1e-4:
                        past_w[f] += p**2
                        w[f] -= rate * p / np.sqrt(past_w[f])
        self.w = {x: w[k].tolist() for x, k in names.items()}
        self.move = move.tolist()
        return self

    @property
    def weights(self) -> dict:
        return {"features": self.w, "moves": self.move}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = np.maximum(x.max(axis=axis, keepdims=True), -1e300)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def expected(n: int, segs: list[tuple[int, int]], scores: list[np.ndarray], move: np.ndarray):
    """(expectations of each segment by kind, of each label pair, log of the partition function) over n tokens."""
    with np.errstate(divide="ignore"):
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(segs):
            by_end[j].append(k)
            by_start[i].append(k)
        ahead, come = np.full((n + 1, len(LABELS)), -np.inf), np.zeros((n + 1, len(LABELS)))
        ahead[0, NONE] = 0.0
        for j in range(n + 1):
            if j:
                ahead[j, NONE] = come[j - 1, NONE]
                if by_end[j]:
                    ahead[j, 1:] = _lse(np.array([come[segs[k][0], 1:] + scores[k] for k in by_end[j]]), 0)
            come[j] = _lse(ahead[j][:, None] + move, 0)
        rest, go = np.zeros((n + 1, len(LABELS))), np.full((n + 1, len(LABELS)), -np.inf)
        rest[n] = move[:, NONE]
        for i in range(n - 1, -1, -1):
            go[i, NONE] = rest[i + 1, NONE]
            if by_start[i]:
                go[i, 1:] = _lse(np.array([rest[segs[k][1], 1:] + scores[k] for k in by_start[i]]), 0)
            rest[i] = _lse(move + go[i][None, :], 1)
        total = come[n, NONE]
        p_seg = [np.exp(come[i, 1:] + s + rest[j, 1:] - total) for (i, j), s in zip(segs, scores, strict=True)]
        p_move = np.exp(ahead[:n, :, None] + move[None] + go[:n, None, :] - total).sum(axis=0)
        p_move[:, NONE] += np.exp(ahead[n] + move[:, NONE] - total)
    return p_seg, p_move, float(total)


def gold_segments(t, toks) -> set[tuple[int, int, int]]:
    """What the patterns and the seed forms of secrets say about an island."""
    spans = [(*m.span(), "secret") for m in SEED.finditer(t)] + base_spans(t)
    out, i = set(), 0
    while i < len(toks):
        kind = None
        for j in range(min(len(toks), i + MAX_LEN), i, -1):
            s, e = toks[i][0], toks[j - 1][1]
            low, high = s + len(t[s:e]) - len(t[s:e].lstrip(EDGE)), s + len(t[s:e].rstrip(EDGE))  # the core of the tokens
            kind = next((k for a, b, k in spans if s <= a <= low and high <= b <= e and any(x[2] for x in toks[i:j])), None)
            if kind:
                break
        out.add((i, j if kind else i + 1, LABELS.index(kind) if kind else NONE))
        i = j if kind else i + 1
    return out


def marked(t: str) -> list[tuple[int, int, bool]]:
    """All tokens of t."""
    return [(*m.span(), MARK.search(m[0]) is not None) for m in TOKEN.finditer(t)]


def train(docs: DataFrame, *, doc_id="doc_id", text="text", train_docs=TRAIN_DOCS, train_islands=TRAIN_ISLANDS) -> dict:
    """Weights from the islands of a bounded sample; the driver sees the islands' text only."""

    def cut(batches):
        for b in batches:
            rows = []
            for t in b["text"]:
                for toks in islands(t):
                    for at in range(0, len(toks), TRAIN_TOKENS):
                        own = t[toks[at][0] : toks[at : at + TRAIN_TOKENS][-1][1]]
                        rows.append((own, " ".join(sorted({LABELS[y] for *_, y in gold_segments(own, marked(own))}))))
            yield pd.DataFrame(rows, columns=["island", "kinds"])

    share = F.pmod(F.xxhash64(F.col(doc_id), F.lit("pii")), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.filter(share < train_docs / max(1, docs.count())).select(F.col(text).alias("text")).filter("text is not null")
    found = sample.mapInPandas(cut, "island string, kinds string").distinct()
    rank = F.row_number().over(Window.partitionBy("kinds").orderBy(F.xxhash64("island"), "island"))
    got = found.withColumn("rank", rank).filter(F.col("rank") <= train_islands).orderBy("rank", "kinds").collect()  # train_islands a set of kinds
    examples = []
    for r in got:
        toks = marked(r["island"])
        examples.append((r["island"], toks, gold_segments(r["island"], toks)))
    return SemiMarkov().learn(examples).weights


def added_spans(model: SemiMarkov, t: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Segments of a kind, cut to their core, that no pattern span overlaps."""
    out, taken, k = [], sorted(base), 0
    for toks in islands(t):
        for i, j, y in model.best(t, toks):
            if y == NONE:
                continue
            s, e = toks[i][0], toks[j - 1][1]
            edge = EDGE.replace('"', "") if LABELS[y] == "secret" else EDGE  # a quoted secret keeps its quotes
            e -= len(t[s:e]) - len(t[s:e].rstrip(edge))
            s += len(t[s:e]) - len(t[s:e].lstrip(edge))
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if s < e and not any(a < e and s < b for a, b, _ in taken[max(0, k - 4) : k + 8] + out[-2:]):
                out.append((s, e, LABELS[y]))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    rank = {k: i for i, k in enumerate((*KINDS, "secret"))}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], rank[x[2]], x[1])))


def _find(weights):
    def run(batches):
        model = SemiMarkov(weights.value)
        for b in batches:
            rows = []
            for doc, t in zip(b["doc_id"], b["text"], strict=True):
                t = t or ""
                base = base_spans(t)
                own = [sum(x[2] == k for x in base) for k in KINDS]
                more = added_spans(model, t, base)
                rows.append((doc, *own, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), sum(x[2] == "secret" for x in more), len(base) + len(more)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_spans"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def find(docs: DataFrame, *, doc_id="doc_id", text="text", weights: dict | None = None) -> DataFrame:
    """Per document: counts of the four patterns, a digest of their spans, all spans, n_secret, n_spans, and whether there are any."""
    w = docs.sparkSession.sparkContext.broadcast(train(docs, doc_id=doc_id, text=text) if weights is None else weights)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = d.mapInPandas(_find(w), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long")
    return found.withColumn("has_personal_data", F.col("n_spans") > 0)
