"""URL filters: fixed host/path rules, and association rules mined with FP-growth.

Labels are the verdicts of the fixed rules. A labelled URL is a basket of its
tokens (scheme, host suffixes, path words, query keys, fragment; numbers are
one token) and its verdict. Tokens of fewer labelled URLs than the support asks
for can be in no rule and leave the baskets. Tokens that just the same labelled
URLs hold count as one (``same_rows``): a rule with one of them is as good with
any other, and one with two is beaten by one with either. Spark's FP-growth finds
frequent baskets while none has more than ``BASKET_TOKENS`` tokens, since it
follows all subsets of a basket; where one is longer, ``levels`` finds the sets of
at most ``MAX_TOKENS`` tokens, size by size. Both count all tokens of all baskets
and lead to the same rules.

Most labels have the same verdict, so a token says something only if it moves the
share of a verdict away from that of all labels, the base rate: rules
``tokens -> verdict`` of at most ``MAX_TOKENS`` tokens are kept where support
and confidence reach their limits, the odds of the verdict are at least
``MIN_ODDS`` times those of the base rate (of all labels and one more that isn't
known), and confidence reaches the base rate even at its lower bound (Wilson's, at ``SURE`` standard deviations), and dropped where a rule with fewer of the same
tokens is at least as confident. An inverted index from each rule's rarest token
finds the rules of a URL, whose other tokens are then checked; the most
confident rule decides (ties: the better supported one, then allow). A URL that
no rule matches is allowed.

The index is broadcast while it holds at most ``BROADCAST_RULES`` rules, and
joined by anchor beyond. The table of frequent tokens is broadcast: there are at
most 1 / support times the mean tokens of a labelled URL. Pages have row
numbers, so no step joins pages by their tokens.

Defined cases: null, or no ``://``: host and path are empty, no rule fits and
the verdict is allow unless a mined rule matches; very long URLs are read whole;
repeated rows each get a row; without labelled URLs nothing is mined; empty
tables give empty results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.common import stored

# The contract's rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_ODDS, SURE, MAX_TOKENS = 0.002, 0.6, 4.0, 1.0, 3
BASKET_TOKENS, BROADCAST_RULES = 12, 100_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        own = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, own) if out is None else out.when(fits, own)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""
    lower = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)

    def words(kind: str, text: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(r"[^/._\-=&?#:]+"), F.lit(0))
        return F.transform(parts, lambda w: F.concat(F.lit(kind), F.regexp_replace(w, "[0-9]+", "0")))

    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(3))), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(lower, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)), lambda k: F.concat(F.lit("q:"), k))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(lower, "^([a-z0-9]+)://", 1)))
    fragment = words("f:", F.regexp_extract(lower, "#(.*)$", 1))
    return F.array_distinct(F.concat(scheme, suffixes, words("p:", F.translate(path, UPPER, LOWER)), keys, fragment))


def same_rows(labelled: DataFrame, min_support: float) -> DataFrame:
    """(token, same): the frequent tokens of rows (row, tokens), each with the first token that just the same rows hold, told by 128 bits of their hashes."""
    need = math.ceil(min_support * labelled.count())
    each = labelled.select("row", F.explode("tokens").alias("token"))
    rows = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    seen = each.groupBy("token").agg(*rows).filter(F.col("n") >= need)
    first = seen.groupBy("n", "x", "y").agg(F.min("token").alias("same"))
    return stored(seen.join(first, ["n", "x", "y"]).select("token", "same"), "url-words")


def merged(urls: DataFrame, same: DataFrame) -> DataFrame:
    """(row, verdict, tokens) with the tokens of same_rows in place of theirs, and no others."""
    each = urls.select("row", "verdict", F.explode_outer("tokens").alias("token")).join(F.broadcast(same), "token", "left")
    return stored(each.groupBy("row", "verdict").agg(F.collect_set("same").alias("tokens")), "url-baskets")


def fp_growth(labelled: DataFrame, min_support: float, max_tokens: int) -> DataFrame:
    """(tokens, label, freq): frequent sets of tokens, each with a label's rows and (label null) with all."""
    items = F.concat("tokens", F.array(F.concat(F.lit("="), "verdict")))
    model = FPGrowth(itemsCol="items", minSupport=min_support).fit(labelled.select(items.alias("items")))
    sets = model.freqItemsets.filter(F.size("items") <= max_tokens + 1)
    verdict = F.filter("items", lambda x: F.startswith(x, F.lit("=")))
    plain = F.array_sort(F.filter("items", lambda x: ~F.startswith(x, F.lit("="))))
    return sets.select(plain.alias("tokens"), F.substring(F.get(verdict, F.lit(0)), 2, 1 << 30).alias("label"), "freq").filter(f"size(tokens) between 1 and {max_tokens}")


def levels(labelled: DataFrame, min_support: float, max_tokens: int) -> DataFrame:
    """As fp_growth, for baskets of any length, less the sets that have just the rows of a smaller set (whose rules the smaller set's beat).

    Equal baskets are one. A basket keeps its frequent sets as stems with the tokens that each goes on with; a longer set is a stem with two of them.
    """
    need = math.ceil(min_support * labelled.count())
    live = labelled.groupBy(F.array_sort("tokens").alias("tails"), "verdict").agg(F.count("*").alias("n"))
    live = stored(live.select(F.monotonically_increasing_id().alias("basket"), F.array().cast("array<string>").alias("stem"), "tails", "verdict", "n"), "url-level")
    out, smaller = [], None
    for k in range(1, max_tokens + 1):
        each = live.select("basket", "verdict", "n", "stem", F.explode("tails").alias("tail")).withColumn("tokens", F.concat("stem", F.array("tail")))
        own = stored(each.groupBy("tokens", "verdict").agg(F.sum("n").alias("freq")), "url-level")
        whole = own.groupBy("tokens").agg(F.sum("freq").alias("freq"), F.max("freq").alias("most")).filter(F.col("most") >= need).select("tokens", "freq")
        if smaller is not None:
            less = F.array(*[F.array(*[F.get("tokens", F.lit(j)) for j in range(k) if j != i]) for i in range(k)])
            subs = whole.select("tokens", "freq", F.explode(less).alias("sub")).join(smaller.select(F.col("tokens").alias("sub"), F.col("freq").alias("above")), "sub")
            whole = subs.groupBy("tokens", "freq").agg(F.count("*").alias("subs"), F.min("above").alias("above")).filter((F.col("subs") == k) & (F.col("above") > F.col("freq"))).select("tokens", "freq")
        smaller = stored(whole, "url-level")
        out += [smaller.select("tokens", F.lit(None).cast("string").alias("label"), "freq")]
        out += [own.filter(F.col("freq") >= need).join(smaller.select("tokens"), "tokens").select("tokens", F.col("verdict").alias("label"), "freq")]
        if k < max_tokens:
            kept = each.join(smaller.select("tokens"), "tokens").groupBy("basket", "verdict", "n", "stem").agg(F.array_sort(F.collect_list("tail")).alias("all"))
            on = kept.select("basket", "verdict", "n", "stem", "all", F.posexplode("all").alias("at", "tail")).filter("at + 1 < size(all)")
            live = stored(on.select("basket", F.concat("stem", F.array("tail")).alias("stem"), F.slice("all", F.col("at") + 2, F.size("all")).alias("tails"), "verdict", "n"), "url-level")
    return reduce(DataFrame.unionByName, out)


def wilson_lower(p: Column, n: Column, z: float) -> Column:
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine(labelled: DataFrame, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE, max_tokens=MAX_TOKENS, min_odds=MIN_ODDS, sure=SURE) -> DataFrame:
    """(tokens, verdict, confidence, support, anchor) from rows (tokens, verdict)."""
    spark = labelled.sparkSession
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double, anchor string")
    longest = labelled.agg(F.max(F.size("tokens"))).first()[0]
    sets = stored((fp_growth if longest <= BASKET_TOKENS else levels)(labelled, min_support, max_tokens), "url-sets")
    base = labelled.groupBy("verdict").agg((F.count("*") / F.lit(float(n + 1))).alias("base"))  # a row for each verdict; one label is left open
    with_label, bare = sets.filter("label is not null").withColumnRenamed("label", "verdict"), sets.filter("label is null").select("tokens", F.col("freq").alias("all"))
    rules = with_label.join(bare, "tokens").join(F.broadcast(base), "verdict")
    rules = rules.select("tokens", "verdict", (F.col("freq") / F.col("all")).alias("confidence"), (F.col("freq") / F.lit(float(n))).alias("support"), "base", "all")
    odds = F.col("confidence") * (1 - F.col("base")) >= min_odds * (1 - F.col("confidence")) * F.col("base")
    rules = rules.filter((F.col("confidence") >= min_confidence) & odds & (wilson_lower(F.col("confidence"), F.col("all"), sure) >= F.col("base") - 1e-9))
    # prune by shorter rules: each rule meets its sub-rules by their token lists (all proper subsets: at most 2 ** max_tokens)
    kept = [F.array_compact(F.array(*[F.get("tokens", F.lit(k)) for k in range(max_tokens) if m >> k & 1])) for m in range(1, 2**max_tokens)]
    subs = rules.filter("size(tokens) > 1").select("tokens", "verdict", "confidence", F.explode(F.array_distinct(F.array(*kept))).alias("sub")).filter("size(sub) > 0 and size(sub) < size(tokens)")
    short = rules.select(F.col("tokens").alias("sub"), "verdict", F.col("confidence").alias("other"))
    beaten = subs.join(short, ["sub", "verdict"]).filter("other >= confidence").select("tokens", "verdict").distinct()
    rules = rules.join(beaten, ["tokens", "verdict"], "left_anti")
    one = bare.filter("size(tokens) = 1").select(F.element_at("tokens", 1).alias("token"), F.col("all").alias("seen"))
    rare = rules.select("tokens", "verdict", F.explode("tokens").alias("token")).join(one, "token").groupBy("tokens", "verdict").agg(F.min_by("token", F.struct("seen", "token")).alias("anchor"))
    return stored(rules.join(rare, ["tokens", "verdict"]).select("tokens", "verdict", "confidence", "support", "anchor"), "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, method_verdict) for each of urls (row, tokens) that a rule matches."""
    own = rules.select("anchor", F.col("tokens").alias("own"), "verdict", "confidence", "support")
    own = F.broadcast(own) if rules.count() <= BROADCAST_RULES else own
    hit = urls.withColumn("anchor", F.explode("tokens")).join(own, "anchor")
    hit = hit.filter(F.size(F.array_except("own", "tokens")) == 0)
    best = F.struct("confidence", "support", (F.col("verdict") == "allow").alias("allow"), "verdict")
    return hit.groupBy("row").agg(F.max(best)["verdict"].alias("method_verdict"))


def judge(pages: DataFrame, *, page_id="page_id", url="url", rules=RULES, **mining) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, mined (whether a mined rule decided)."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    p = p.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    p = p.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    p = p.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    p = stored(p.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", "fixed.rule", "fixed.verdict", "tokens"), "url-tokens")
    baskets = merged(p, same_rows(p.filter("verdict is not null"), mining.get("min_support", MIN_SUPPORT)))
    found = mine(baskets.filter("verdict is not null").select("tokens", "verdict"), **mining)
    p = p.join(matched(baskets.filter("verdict is null").select("row", "tokens"), found), "row", "left")
    return p.select("page_id", "host", "path", "rule", F.coalesce("verdict", "method_verdict", F.lit("allow")).alias("verdict"), (F.col("verdict").isNull() & F.col("method_verdict").isNotNull()).alias("mined"))
