"""Quality rules (native: DataFrame functions only): counts, and divergence from a language's reference.

Base counts come from the words ``[^\\x20\\x09-\\x0D]+`` of the whole text. A text's
8-word windows are hashed in three doubling steps (1, 2, 4, 8 words) as array
functions inside the row, so nothing is exploded or shuffled; only rows whose
hashes repeat go on to sort them with their positions.

The method compares two histograms of a text, its character classes and its
common words (``COMMON_WORDS``, the rest being one bin), with those of its
language, summed over all texts of the language that pass the base rules, and
with those of all languages together, and, for texts in two languages,
common words of all languages are also one bin; the nearest counts. A text is kept while both Jensen-Shannon distances (base 2) stay at or under
their limits; texts under ``MIN_CHARS`` characters or ``MIN_WORDS`` words are
too short for a histogram to say anything and aren't judged by it.

Defined cases: null text has no words and fails the base rules; a null or
unreferenced language is compared with the reference of all languages
alone; repeated rows each get a row; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.common import SPACE, stored

# Frequent function words of four languages.
COMMON_WORDS = (
    "the of and to in a is that it for "
    "der die und den von zu das mit sich auf "
    "le la les et des du en une que qui "
    "el los las y un por con una su para"
).split()
CLASSES = {"space": SPACE, "upper": r"\p{Lu}", "digit": r"\p{Nd}", "symbol": r"#*$%&|<>=+~^@\\/_{}\[\]", "point": r".,;:!?'()\x22\-", "beyond": r"[^\x00-\x7F]&&[^\p{Lu}\p{Nd}]"}

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED, MAX_CLASS_DISTANCE = 300, 80, 0.31
#: The word histogram of a short text is coarse: its limit is this much plus this much by the root of its words.
MAX_WORD_DISTANCE, WORD_DISTANCE_SPREAD = 0.10, 2.0


def _without(text: Column, chars: str) -> Column:
    """Characters left when those of a class are taken out."""
    return F.char_length(F.regexp_replace(text, f"[{chars}]+", ""))


def doubled(h: Column, apart: int) -> Column:
    """Hashes of runs twice as long: each hash with the one ``apart`` places on."""
    n = F.greatest(F.size(h) - apart, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + apart), n), lambda a, b: F.xxhash64(a, b))


def with_covered(d: DataFrame, width: int = 8) -> DataFrame:
    """Adds n_repeat_words: places under windows (hashes h8) that repeat.

    Only where some hash repeats are (hash, place) sorted; those that equal a
    neighbour are kept and their runs joined. Each step is a column, so none is
    evaluated twice; they are null in all other rows.
    """
    def tail(c: str) -> Column:
        return F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))

    repeats = F.size(F.array_distinct("h8")) < F.size("h8")
    d = d.withColumn("pair", F.when(repeats, F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("same", F.filter(F.zip_with("pair", tail("pair"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    d = d.withColumn("at", F.array_sort(F.array_distinct(F.flatten("same"))))
    gaps = F.zip_with("at", tail("at"), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))


def measures(docs: DataFrame, *, doc_id="doc_id", text="text", lang="lang") -> DataFrame:
    """Per document: base counts, chars (by class) and commons (by common word, then the rest)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("words", F.filter(F.split("t", f"[{SPACE}]+"), lambda w: w != ""))
    t, words = F.col("t"), F.col("words")
    size = F.char_length(t)
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    d = d.select(
        "doc_id", "lang", F.size(words).cast("long").alias("n_words"), size.alias("n_chars"), words.alias("words"),
        (size - _without(t, r"#*$%&|<>")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        *[(size - _without(t, c)).alias(f"c_{k}") for k, c in CLASSES.items()],
        F.transform(words, lambda w: F.xxhash64(w)).alias("h1"),
        F.filter(F.transform(words, lambda w: F.array_position(F.array(*[F.lit(x) for x in COMMON_WORDS]), w)), lambda k: k > 0).alias("common"),
    )
    for apart in (1, 2, 4):  # a column each, so that no step is evaluated twice
        d = d.withColumn(f"h{2 * apart}", doubled(F.col(f"h{apart}"), apart))
    d = with_covered(d)
    rest = F.col("n_chars")
    for k in CLASSES:
        rest = rest - F.col(f"c_{k}")
    bins = F.transform(F.sequence(F.lit(1), F.lit(len(COMMON_WORDS))), lambda b: F.size(F.filter("common", lambda k: k == b)).cast("long"))
    return d.select(
        "doc_id", "lang", "n_words", (F.col("n_chars") - F.col("c_space")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", "n_chars",
        F.array(*[F.col(f"c_{k}").cast("long") for k in CLASSES], F.greatest(rest, F.lit(0)).cast("long")).alias("chars"),
        F.concat(bins, F.array((F.col("n_words") - F.size("common")).cast("long"))).alias("commons"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def references(measured: DataFrame) -> DataFrame:
    """(ref_lang, ref_chars, ref_commons): summed counts of each language, and of all under an empty name."""
    m = measured.filter(~base_failed())
    both = m.select("lang", "chars", "commons").filter("lang <> ''").unionByName(m.select(F.lit("").alias("lang"), "chars", "commons"))
    width = len(CLASSES) + 1
    sums = [F.sum(F.element_at("chars", k + 1)).alias(f"a{k}") for k in range(width)] + [F.sum(F.element_at("commons", k + 1)).alias(f"b{k}") for k in range(len(COMMON_WORDS) + 1)]
    s = both.groupBy("lang").agg(*sums)
    return s.select(F.col("lang").alias("ref_lang"), F.array(*[f"a{k}" for k in range(width)]).alias("ref_chars"), F.array(*[f"b{k}" for k in range(len(COMMON_WORDS) + 1)]).alias("ref_commons"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts."""
    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(_shares(p), _shares(q), lambda a, b: term(a, (a + b) / 2) / 2 + term(b, (a + b) / 2) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _two_bins(commons: Column) -> Column:
    """Common words of any language together, and the rest: what a text that changes its language keeps."""
    rest = F.element_at(commons, -1)
    return F.array(F.aggregate(commons, F.lit(0).cast("long"), lambda s, x: s + x) - rest, rest)


def judge(docs: DataFrame, *, doc_id="doc_id", text="text", lang="lang", max_class=MAX_CLASS_DISTANCE, max_word=MAX_WORD_DISTANCE, spread=WORD_DISTANCE_SPREAD) -> DataFrame:
    """Per document: the base counts, base_failed, class_distance, word_distance, kept."""
    m = stored(measures(docs, doc_id=doc_id, text=text, lang=lang), "quality-measures")
    ref = references(m)
    pooled = ref.filter("ref_lang = ''").select(F.lit(1).alias("one"), F.col("ref_chars").alias("all_chars"), F.col("ref_commons").alias("all_commons"))
    found = m.join(ref, m["lang"] == ref["ref_lang"], "left").withColumn("one", F.lit(1)).join(F.broadcast(pooled), "one", "left")  # one row
    own, every = F.coalesce("ref_chars", "all_chars", "chars"), F.coalesce("all_chars", "chars")
    c = F.least(js_distance(F.col("chars"), own), js_distance(F.col("chars"), every))
    own, every = F.coalesce("ref_commons", "all_commons", "commons"), F.coalesce("all_commons", "commons")
    w = F.least(js_distance(F.col("commons"), own), js_distance(F.col("commons"), every), js_distance(_two_bins(F.col("commons")), _two_bins(own)))
    found = found.withColumn("base_failed", base_failed()).withColumn("class_distance", c).withColumn("word_distance", w)
    fits = ((F.col("n_chars") < MIN_CHARS_JUDGED) | (F.col("class_distance") <= max_class)) & ((F.col("n_words") < MIN_WORDS_JUDGED) | (F.col("word_distance") <= max_word + spread / F.sqrt(F.col("n_words"))))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
