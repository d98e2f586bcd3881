"""Which filter removes what, in every order: removal polynomials of a corpus's parts.

Each document gets a mask of the filters it fails; of a part only the number of
documents by mask matters. Let x_i say how far filter i is applied. A document
with mask m stays with chance prod(1 - x_i, i in m), so the part's removals are
the multilinear polynomial

    R(x) = sum over m of N[m] (1 - prod over i in m of (1 - x_i)),

kept as one coefficient for each set of filters. Its corners count: R at the
corner of a set S is what the filters S remove together, in any order; survivors
are the rest. Filter i's Shapley share is the integral of its partial derivative
along the diagonal, sum over T with i of a[T] / |T|, in exact rationals; times
the number of orders it is the sum of the filter's removals over all orders.
Polynomials of documents of good quality and of toxic ones say what is lost.

Texts are read once. What goes on is a narrow row for each document; equal texts
are told by their sha256, counts by digest are combined before they are
shuffled, and no text's rows meet in one task, however many copies it has.

Defined cases: a null text is empty, and equal to other empty ones; a document
without words fails A only (and E, C never); a null doc_id has no label, and
is neither smaller nor larger than another id, so such a row never fails E and
makes no other fail; repeated rows count each by itself, and equal texts under one id aren't
copies of a smaller one; several labels of a document count as any of them; null
parts are the empty string; very long texts are read whole; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.llm.common import SPACE, stored

FILTERS = "ABCDE"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failing(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that a document's own text decides."""
    words = F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+"), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def marked(docs: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, own, digest): own has bit k where filter k of A to D fails."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    own = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failing(F.col("text")).values())), F.lit(0))
    return d.select("doc_id", "part", own.cast("int").alias("own"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail; bit 4 says that a smaller id has the same text."""
    rows = stored(marked(docs, part).withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1024))).otherwise(0)), "audit-masks")
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    keys = ["digest", "part", "own", "good", "toxic"]
    d = rows.join(known.withColumn("spread", F.lit(0)), ["doc_id", "spread"], "left").na.fill(0, ["good", "toxic"])  # null ids, spread, find no label
    by_id = d.groupBy("doc_id", "spread", *keys).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    by_text = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least)
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    later = F.col("n") - F.col("nameless") - F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = by_text.withColumn("later", F.coalesce(later, F.lit(0)))
    both = F.array(F.struct(F.col("own").alias("mask"), (F.col("n") - F.col("later")).alias("n")), F.struct((F.col("own") + 16).alias("mask"), F.col("later").alias("n")))
    flat = split.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    return flat.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def removal_polynomial(counts: dict[int, int], k: int) -> list[int]:
    """Coefficients a[T] of R by set of variables T: (-1)**(|T| + 1) times the documents that fail all of T."""
    a = [0] * (1 << k)
    for mask, n in counts.items():
        sub = mask
        while sub:  # the non-empty subsets of mask
            a[sub] += n if sub.bit_count() % 2 else -n
            sub = (sub - 1) & mask
    return a


def corner(a: list[int], applied: int) -> int:
    """R where the applied filters' variables are 1 and the others 0."""
    return sum(v for t, v in enumerate(a) if t & ~applied == 0)


def shapley(a: list[int], i: int) -> Fraction:
    """The integral over [0, 1] of filter i's partial derivative along the diagonal: t**(|T| - 1) integrates to 1 / |T|."""
    return sum((Fraction(v, t.bit_count()) for t, v in enumerate(a) if t >> i & 1), Fraction(0))


def audit_rows(part: str, counts: dict[int, tuple[int, int, int]], names: str = FILTERS) -> list[tuple]:
    """Rows of SCHEMA of one part from its (all, good, toxic) counts by mask."""
    k, orders = len(names), factorial(len(names))
    polynomials = [removal_polynomial({m: n[j] for m, n in counts.items()}, k) for j in range(3)]
    total = sum(n[0] for n in counts.values())
    gone, good, toxic = ([corner(a, s) for s in range(1 << k)] for a in polynomials)
    every = (1 << k) - 1
    share = [shapley(polynomials[0], i) * orders for i in range(k)]
    if any(s.denominator != 1 for s in share):
        raise ArithmeticError("a share times the number of orders isn't whole")
    out = []
    for order in permutations(range(k)):
        done = 0
        for step, i in enumerate(order, 1):
            now = done | 1 << i
            removed = gone[now] - gone[done]
            out.append((part, "".join(names[j] for j in order), step, total - gone[now], removed, gone[1 << i] - removed, gone[every] - gone[every ^ 1 << i], good[now] - good[done], toxic[now] - toxic[done], int(share[i])))
            done = now
    return out


def audit(counts: DataFrame) -> DataFrame:
    """The audit of each part, from (part, mask, n, good, toxic): a part is one row of at most 32 counts, and gives 600 rows."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def run(batches):
        for pdf in batches:
            for part, own in zip(pdf["part"], pdf["counts"], strict=True):
                yield pd.DataFrame(audit_rows(part, {r["mask"]: (r["n"], r["good"], r["toxic"]) for r in own}), columns=columns)

    return by_part.mapInPandas(run, SCHEMA)
