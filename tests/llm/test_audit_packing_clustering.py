"""Filter audit, packing and clustering: against SQL, enumeration, whole-text encoding and plain best fit, and on awkward rows."""

import bisect
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("copse.llm")

from test_operators import LONG, ODD, documents, in_sql  # noqa: E402

from copse.llm import clustering, filter_audit, packing  # noqa: E402
from copse.llm.queries import ORACLE_SQL, PACKING_TOKENIZER, QUERIES, vocabulary_path  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- 11 filter audit -------------------------------------------------------

AWKWARD = [*ODD, (8, "SHOUT " * 3, "en", "a"), (9, "a", "de", "c"), (10, "a", None, "c"), (6, "a", "en", "c"), (11, "x $ y", "en", "b"), (None, "a", "en", "b"), (12, " ".join(f"w{k}" for k in range(150)), "fr", "b")]
LABELS = [(1, 1, 0), (1, 0, 1), (8, 1, 1), (9, None, 1), (None, 1, 1), (10, 1, None), (12, 1, 0), (999, 1, 1)]


def labels(spark):
    return spark.createDataFrame([(i, q, t, "z", 5) for i, q, t in LABELS], "doc_id long, quality int, toxic int, lang string, n int")


def audit_by_hand(rows, label_rows):
    """Each order, each document, one filter after the other."""
    least = {}
    for i, t, *_ in rows:
        if i is not None and (t or "") not in least or i is not None and i < least[t or ""]:
            least[t or ""] = i
    tags = {i: (any(q == 1 for j, q, _ in label_rows if j == i), any(x == 1 for j, _, x in label_rows if j == i)) for i, *_ in label_rows if i is not None}
    by_part = defaultdict(list)
    for i, t, g, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        by_part[g or ""].append((fails, *tags.get(i, (False, False))))
    out, shares = [], Counter()
    for part, docs in by_part.items():
        for order in itertools.permutations("ABCDE"):
            here = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in here if d[0][f]]
                here = [d for d in here if not d[0][f]]
                failing = sum(d[0][f] for d in docs)
                shares[part, f] += len(gone)
                out.append([part, "".join(order), step, len(here), len(gone), failing - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)])
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_of_odd_rows(spark):
    got = filter_audit.audit(filter_audit.mask_counts(documents(spark, AWKWARD), labels(spark)))
    assert sorted(map(tuple, got.collect())) == audit_by_hand(AWKWARD, LABELS)
    none = filter_audit.audit(filter_audit.mask_counts(documents(spark, AWKWARD).limit(0), labels(spark)))
    assert none.collect() == [] and none.columns == got.columns
    unlabelled = filter_audit.audit(filter_audit.mask_counts(documents(spark, AWKWARD), labels(spark).limit(0))).collect()
    assert sorted(map(tuple, unlabelled)) == audit_by_hand(AWKWARD, [])


def test_audit_of_random_parts(spark):
    r = random.Random(4)
    words = ["a", "B", "c", "$", "dd", "E"]
    rows = [(r.randint(0, 60), " ".join(r.choice(words) for _ in range(r.choice([0, 2, 3, 120]))) or None, r.choice(["p", "q", None]), "s") for _ in range(200)]
    tags = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 60, 2)]
    tables = spark.createDataFrame(tags, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.mask_counts(documents(spark, rows), tables))
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, tags)


def test_removal_polynomials():
    """Corners count, and the integral is the mean over orders, for any number of filters."""
    r = random.Random(1)
    for k in (1, 2, 3, 4, 6):
        counts = {m: r.randint(0, 9) for m in range(1 << k)}
        a = filter_audit.removal_polynomial(counts, k)
        hit = lambda s: sum(n for m, n in counts.items() if m & s)  # noqa: B023, E731
        assert all(filter_audit.corner(a, s) == hit(s) for s in range(1 << k))
        orders = list(itertools.permutations(range(k)))
        for i in range(k):
            total = 0
            for o in orders:
                before = sum(1 << j for j in o[: o.index(i)])
                total += hit(before | 1 << i) - hit(before)
            assert filter_audit.shapley(a, i) == Fraction(total, len(orders))


# --- 12 packing ------------------------------------------------------------


def best_fit(counts, capacity=1024):
    """Plain best fit, longest first, piece by piece."""
    gaps, n = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = bisect.bisect_left(gaps, length)
            if i == len(gaps):
                n += 1
                bisect.insort(gaps, capacity - length)
            else:
                bisect.insort(gaps, gaps.pop(i) - length)
    return n


def check_plan(counts, capacity=1024):
    bins = packing.plan(counts, capacity)
    held = Counter()
    for b in bins:
        assert b.count > 0 and b.gap >= 0 and sum(n * c for n, c in b.parts) + b.gap == capacity
        for n, c in b.parts:
            held[n] += b.count * c
    assert held == Counter({n: c for n, c in counts.items() if c})
    return bins


KINDS = {
    "uniform": lambda r: r.randint(1, 1024), "middle": lambda r: r.randint(100, 700), "short": lambda r: r.randint(5, 100), "long": lambda r: r.randint(400, 1024),
    "log-normal": lambda r: min(1024, int(r.lognormvariate(5.5, 1)) + 1), "few": lambda r: r.choice([100, 300, 333, 341, 700]),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [40, 3000])
def test_plan_is_no_worse_than_best_fit(kind, n):
    r = random.Random(n)
    counts = Counter(KINDS[kind](r) for _ in range(n))
    bins = sum(b.count for b in check_plan(counts))
    tokens = sum(n * c for n, c in counts.items())
    least = max(-(-tokens // 1024), sum(c for n, c in counts.items() if n > 512))
    assert least <= bins <= max(best_fit(counts) * 1.005, best_fit(counts) + 1)


def test_plan_of_exact_combinations():
    """Singles, pairs and triples fill gaps to the last token; availability binds them."""
    for counts, want in (({1000: 3, 24: 3}, 3), ({900: 2, 100: 2, 24: 2}, 2), ({900: 1, 60: 1, 40: 1, 24: 1}, 1), ({512: 4}, 2), ({1024: 7}, 7), ({256: 8}, 2), ({700: 2, 300: 1, 24: 1}, 2), ({1: 2048}, 2), ({}, 0)):
        assert sum(b.count for b in check_plan(counts)) == want
    assert all(b.gap == 0 for b in check_plan({900: 10**9, 100: 10**9, 24: 10**9}))


def test_plan_follows_lengths_not_pieces():
    r = random.Random(2)
    counts = Counter(r.randint(1, 1023) for _ in range(5000))
    few, many = check_plan(counts), check_plan({n: c * 1_000_000 for n, c in counts.items()})
    assert len(many) < 4 * 1024 and sum(b.count for b in many) < 1_000_000 * sum(b.count for b in few)


def test_random_plans():
    r = random.Random(7)
    for _ in range(300):
        capacity = r.choice([1, 2, 7, 16, 50])
        check_plan({r.randint(1, capacity): r.randint(0, 6) for _ in range(r.randint(0, 12))}, capacity)


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(PACKING_TOKENIZER))


@pytest.mark.parametrize("run_chars", [1 << 20, 7])
def test_texts_encode_as_by_the_tokenizer(byte_bpe, monkeypatch, run_chars):
    monkeypatch.setattr(packing, "RUN_CHARS", run_chars)
    e, r = packing.TextEncoder(vocabulary_path(PACKING_TOKENIZER)), random.Random(3)
    letters = [*"aZé́İß fi'st ½.,!Σ中😀\n\t\x1c\x85\xa0 ", " ", " ", "  ", "<|endoftext|>", "n't", "'s", "word, ", " ÀÉ. ", "123", " \n"]
    for _ in range(4000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 16)))
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == byte_bpe.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_table_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    e = packing.TextEncoder(vocabulary_path(PACKING_TOKENIZER))
    first = e.encode("one two three four")
    for k in range(300):
        e.encode(f"w{k} x{k} y{k}")
        assert e.size < 1600 and len(e.older) < 20
    assert e.encode("one two three four") == first


def test_words_are_encoded_once_whatever_mark_follows(byte_bpe):
    """A table of words and marks, not of their combinations: what a new word costs is most of the query."""
    e, r = packing.TextEncoder(vocabulary_path(PACKING_TOKENIZER)), random.Random(4)
    words = ["".join(r.choices("abcdeéßüñ", k=7)) for _ in range(60)]
    text = "x" + "".join(f" {w}{m}" for m in ("", *".,;:!?") for w in words)
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == byte_bpe.encode(text, add_special_tokens=False).ids
    assert len(e.known) < 80


@pytest.mark.parametrize("window", [1 << 20, 40])
def test_texts_side_by_side_keep_to_themselves(byte_bpe, monkeypatch, window):
    """Many texts of one batch, cut into words where they lie; ends, starts and empty texts included."""
    monkeypatch.setattr(packing, "RUN_CHARS", window)
    e, r = packing.TextEncoder(vocabulary_path(PACKING_TOKENIZER)), random.Random(9)
    letters = [*"aZé́İß×÷fi'st½.,!?;:Σ中😀\n\t\r\x1c\x85\xa0\u2003\u2028\u3000\u1680¿—Ā", " ", " ", "  ", "n't", "word, ", "\nAn", ".\nÀÉ", "12", " \n", "\n\n"]
    for odd in ([], ["<|endoftext|>", "<|endoftext"]):
        texts = [None if r.random() < 0.05 else "".join(r.choice(letters + odd) for _ in range(r.randint(0, 12))) for _ in range(6000)]
        ids, starts = e.encode_array(pa.array(["cut off", *texts])[1:])
        for t, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
            assert ids[a:b].tolist() == byte_bpe.encode(t or "", add_special_tokens=False).ids, repr(t)


def check_packed(got, rows, tok, capacity):
    """Every document whole, in pieces as agreed, and each sequence gapless."""
    ids = {t: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in {t for _, t in rows}}
    want = Counter()
    for i, t in rows:
        x = ids[t]
        cuts = [0, *range(len(x) % capacity or capacity, len(x) + 1, capacity)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    counts = Counter(r["length"] for r in got)
    assert len(held) <= max(best_fit(counts, capacity) * 1.01, best_fit(counts, capacity) + 1)


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing_odd_rows(spark, byte_bpe, capacity):
    df = documents(spark, AWKWARD).repartition(5)
    cut = packing.pieces(df, vocabulary_path(PACKING_TOKENIZER), capacity)
    found = packing.packed(cut, capacity)
    check_packed(packing.report(found).collect(), [(i, t) for i, t, *_ in AWKWARD], byte_bpe, capacity)
    ids = {(r["sequence_id"], r["offset"]): r["ids"] for r in found.collect()}
    for s in packing.sequences(found).collect():
        assert bytes(s["ids"]) == b"".join(bytes(ids[k]) for k in sorted(k for k in ids if k[0] == s["sequence_id"]))
        assert len(s["ids"]) == 2 * s["n_tokens"] and len(s["doc_ids"]) == sum(k[0] == s["sequence_id"] for k in ids)
    none = packing.packed(packing.pieces(df.limit(0), vocabulary_path(PACKING_TOKENIZER), capacity), capacity)
    assert none.collect() == []


def test_packing_query(spark, sf_dir, byte_bpe):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op12_pack_sequences"](spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    check_packed(got.collect(), rows, byte_bpe, 1024)


# --- 13 clustering ---------------------------------------------------------

NAN, INF = float("nan"), float("inf")


def embeddings(spark, rows):
    return spark.createDataFrame([(i, x, 0, "q", 1) for i, x in rows], "vec_id long, embedding array<float>, label int, q string, cluster int")


def lloyd(rows, k=16, rounds=3, seed=1, dimensions=64):
    kept = [(i, [max(min(int(np.floor(np.float64(np.float32(v)) * 64)), clustering.BOUND), -clustering.BOUND) for v in x]) for i, x in rows if x is not None and len(x) == dimensions and all(v is not None and np.isfinite(v) for v in x)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [q for _, q in sorted(kept, key=key)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, q in kept:
            by[near(q)[1]].append(q)
        centroids = [[sum(v) // len(by[n]) for v in zip(*by[n], strict=True)] if by[n] else c for n, c in enumerate(centroids)]
    found = [(i, *near(q)) for i, q in kept]
    inertia = Counter()
    for _, d, n in found:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), clustering.digest(centroids[n])) for i, d, n in found), key=str)


def random_vectors(n, seed=0):
    r = np.random.RandomState(seed)
    return [(i, r.choice([-1, 1]) * r.rand(64).round(2)) for i in range(n)]


def vectors_with_oddities():
    base = [(i, [float(v) for v in x]) for i, x in random_vectors(60)]
    odd = [(100, None), (101, []), (102, base[0][1][:63]), (103, [*base[0][1], 1.0]), (104, [*base[0][1][:63], None]), (105, [*base[0][1][:63], NAN]), (106, [-INF, *base[0][1][1:]])]
    return [*base, *odd, base[3], (3, base[5][1]), (None, base[2][1]), (107, [0.0] * 64), (108, [-0.0] * 64), (109, [3e38, -3e38, *[0.0] * 62])]


@pytest.mark.parametrize("rows", [vectors_with_oddities(), [(i, [float(v) for v in x]) for i, x in random_vectors(5)], [(i, [0.5] * 64) for i in range(40)]], ids=["odd", "few", "equal"])
def test_clusters_by_hand(spark, rows):
    for parts in (1, 7):
        got = clustering.report(*clustering.clustered(embeddings(spark, rows).repartition(parts))).collect()
        assert sorted(map(tuple, got), key=str) == lloyd(rows)


def test_clusters_of_none(spark):
    got = clustering.report(*clustering.clustered(embeddings(spark, [(1, None), (2, [1.0])])))
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_nearest_takes_the_lowest_number():
    q = np.array([[0, 0], [4, 0], [2, 0]])
    at, d = clustering.nearest(q, np.array([[0, 0], [4, 0], [0, 0]]))
    assert at.tolist() == [0, 1, 0] and d.tolist() == [0, 0, 4]


# --- SQL -------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_audit_filters", "op13_cluster_embeddings"])
def test_odd_tables_match_sql(spark, tmp_path, name):
    documents(spark, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    embeddings(spark, vectors_with_oddities()).write.parquet(f"{tmp_path}/embeddings.parquet")
    tables = {t: f"{tmp_path}/{t}.parquet/*.parquet" for t in ("documents", "labels", "embeddings")}
    names, want = in_sql(tables, ORACLE_SQL[name])
    df = QUERIES[name](spark, str(tmp_path))
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_very_long_text(spark, byte_bpe):
    """A text of many runs is one document; its words are met once."""
    text = LONG * 20
    cut = packing.pieces(documents(spark, [(1, text, "en", "a")]), vocabulary_path(PACKING_TOKENIZER))
    rows = cut.orderBy("piece").collect()
    assert b"".join(bytes(r["ids"]) for r in rows) == np.array([*byte_bpe.encode(text, add_special_tokens=False).ids, 2], "<u2").tobytes()
