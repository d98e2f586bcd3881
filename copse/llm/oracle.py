"""DuckDB SQL of the numbered operators that SQL can express: the same rows by plain windows and joins."""

from __future__ import annotations

from copse.llm import clustering, quality
from copse.llm.common import SPACE

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def contamination_sql(width: int = 10) -> str:
    """op9: windows of items joined with all runs of as many document words."""
    return f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_FOLD.format("text")}, '{_WORD}') as w from documents),
i as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({_FOLD.format("text")}, '{_WORD}') as w from benchmark),
cut as (select item, w, least(len(w), {width}) as n, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) as k from i where len(w) > 0),
wins as (select distinct item, n, w[k:k + n - 1] as win from cut),
lens as (select distinct n from wins),
word as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as k from d),
run as (select r, k, list(x) over (partition by r order by k rows between current row and {width - 1} following) as g from word),
hits as (select distinct r, item, n, k from (select r, n, k, g[1:n] as win from run, lens where len(g) >= n) join wins using (n, win)),
hit_words as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from hits) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (r) left join items using (r)"""


def substring_sql(width: int = 50) -> str:
    """op6: every window of bytes with the smallest doc_id that holds it; gaps between removed runs are joined."""
    return f"""
with d as (select row_number() over () as r, coalesce(doc_id, 9223372036854775807) as own, doc_id, encode(coalesce(text, '')) as x from documents),
begin_at as (select r, own, x, unnest(range(0, octet_length(x) - {width - 1})) as j from d where octet_length(x) >= {width}),
win as (select r, own, j, x[j + 1:j + {width}] as s from begin_at),
least_id as (select s, min(own) as first from win group by s having count(*) > 1),
gone as (select r, j, lag(j) over (partition by r order by j) as before from win join least_id using (s) where first < own),
run as (select r, j, sum(case when before is null or j > before + {width} then 1 else 0 end) over (partition by r order by j) as k from gone),
span as (select r, k, min(j) as a, max(j) + {width} as b from run group by r, k),
part as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as free from span),
cut as (select r, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last, string_agg(hex(x[free + 1:a]), '' order by a) as head from part join d using (r) group by r)
select doc_id, cast(octet_length(x) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(head, '') || hex(x[coalesce(last, 0) + 1:octet_length(x)]))) as kept_sha256
from d left join cut using (r)"""


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance, base 2, of two lists of counts."""
    share = "list_transform({0}, lambda v: v / greatest(list_sum({0}), 1))"

    def term(v: str) -> str:
        return f"case when {v} > 0 then {v} * log2({v} / ((z[1] + z[2]) / 2)) / 2 else 0 end"

    return f"sqrt(greatest(coalesce(list_sum(list_transform(list_zip({share.format(p)}, {share.format(q)}), lambda z: {term('z[1]')} + {term('z[2]')})), 0), 0))"


def quality_sql() -> str:
    """op4: counts by regular expressions and a table of 8-word windows; references summed by language."""
    words = ", ".join(f"'{w}'" for w in quality.COMMON_WORDS)
    n = len(quality.COMMON_WORDS)

    def count(chars: str) -> str:
        return f"len(t) - len(regexp_replace(t, '[{chars}]+', '', 'g'))"

    bounds = {k: count(c.replace("'", "''")) for k, c in quality.CLASSES.items() if k != "beyond"}
    bounds["beyond"] = r"len(regexp_replace(t, '[\p{Lu}\p{Nd}]+', '', 'g')) - len(regexp_replace(t, '[\p{Lu}\p{Nd}]+|[^\x00-\x7F]+', '', 'g'))"
    classes = ", ".join(f"{v} as c_{k}" for k, v in bounds.items())
    names = [f"c_{k}" for k in quality.CLASSES]
    chars, commons = len(names) + 1, n + 1
    sums = lambda c, size: "[" + ", ".join(f"sum({c}[{k + 1}])" for k in range(size)) + "]"
    two = "[list_sum({0}) - {0}[-1], {0}[-1]]"
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(cast(lang as varchar), '') as lang, coalesce(text, '') as t from documents),
c as (select r, doc_id, lang, len(t) as n_chars, regexp_extract_all(t, '[^{SPACE}]+') as w, {count("#*$%&|<>")} as n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{SPACE}]')) as lines, {classes} from d),
word as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as k from c),
win as (select r, k, list(x) over (partition by r order by k rows between current row and 7 following) as g from word),
twice as (select r, g from win where len(g) = 8 group by r, g having count(*) > 1),
rep as (select r, count(distinct p) as n_repeat_words from (select r, unnest(range(k, k + 8)) as p from win join twice using (r, g)) group by r),
bin as (select r, list_position([{words}], x) as b from word),
com as (select r, [{", ".join(f"count(*) filter (b = {k + 1})" for k in range(n))}, count(*) filter (b is null or b = 0)] as commons from bin group by r),
m as (select r, doc_id, lang, n_chars, cast(len(w) as bigint) as n_words, cast(n_chars - c_space as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  [{", ".join(names)}, greatest(n_chars - {" - ".join(names)}, 0)] as chars, coalesce(commons, list_transform(range({commons}), lambda z: 0)) as commons
  from c left join rep using (r) left join com using (r)),
f as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from m),
one as (select lang, {sums("chars", chars)} as rc, {sums("commons", commons)} as rw from f where not base_failed and lang <> '' group by lang),
every as (select {sums("chars", chars)} as ac, {sums("commons", commons)} as aw from f where not base_failed having count(*) > 0),
j as (select f.*, coalesce(rc, ac, chars) as oc, coalesce(ac, chars) as ec, coalesce(rw, aw, commons) as ow, coalesce(aw, commons) as ew
  from f left join one using (lang) left join every on true),
v as (select *, least({_distance("chars", "oc")}, {_distance("chars", "ec")}) as cd,
  least({_distance("commons", "ow")}, {_distance("commons", "ew")}, {_distance(two.format("commons"), two.format("ow"))}) as wd from j)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (n_chars < {quality.MIN_CHARS_JUDGED} or cd <= {quality.MAX_CLASS_DISTANCE})
    and (n_words < {quality.MIN_WORDS_JUDGED} or wd <= {quality.MAX_WORD_DISTANCE} + {quality.WORD_DISTANCE_SPREAD} / sqrt(n_words)) as kept,
  round(cd, 6) as class_distance, round(wd, 6) as word_distance
from v"""


def audit_sql() -> str:
    """op11: the five filters applied in every order, one after the other, to the counts of documents by what they fail."""
    names = "ABCDE"
    fails = ", ".join(f"({c}) as f{n}" for n, c in zip(names, ("len(w) < 100", "100 * len(list_distinct(w)) < 80 * len(w)", "100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t)", "regexp_matches(t, '[#$%&*|]')", "coalesce(first < doc_id, false)"), strict=True))
    fail = "case f " + " ".join(f"when '{n}' then f{n}" for n in names) + " end"
    earlier = " or ".join(f"(f{n} and strpos(before, '{n}') > 0)" for n in names)
    alone = " and ".join(f"(f{n} or '{n}' = f) = ('{n}' = f)" for n in names)
    return rf"""
with d as (select doc_id, coalesce(cast(lang as varchar), '') as part, coalesce(text, '') as t from documents),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
s as (select t, min(doc_id) as first from d group by t),
x as (select d.*, first, coalesce(good, false) as good, coalesce(toxic, false) as toxic, regexp_extract_all(d.t, '[^{SPACE}]+') as w from d join s using (t) left join l using (doc_id)),
m as (select part, good, toxic, {fails} from x),
c as (select *, count(*) as n from m group by all),
k(f) as (values {", ".join(f"('{n}')" for n in names)}),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from k a join k b on b.f <> a.f join k c on c.f not in (a.f, b.f) join k d on d.f not in (a.f, b.f, c.f) join k e on e.f not in (a.f, b.f, c.f, d.f)),
p as (select filter_order, cast(s.step as int) as step, substr(filter_order, s.step, 1) as f, substr(filter_order, 1, s.step - 1) as before from o, range(1, 6) s(step)),
q as (select part, n, good, toxic, filter_order, step, f, {fail} as fails, ({earlier}) as gone, ({alone}) and {fail} as sole from c, p),
r as (select part, filter_order, step, f, sum(case when gone or fails then 0 else n end) as kept, sum(case when fails and not gone then n else 0 end) as removed,
  sum(case when fails and gone then n else 0 end) as redundant, sum(case when sole then n else 0 end) as unique_fails,
  sum(case when fails and not gone and good then n else 0 end) as good_lost, sum(case when fails and not gone and toxic then n else 0 end) as toxic_lost
  from q group by all)
select part, filter_order, step, {", ".join(f"cast({v} as bigint) as {v}" for v in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  cast(sum(removed) over (partition by part, f) as bigint) as shapley from r"""


def clustering_sql(k: int = 16, rounds: int = 3, seed: int = 1, dimensions: int = 64) -> str:
    """op13: the rounds written out over a table of components."""
    cut = clustering.BOUND
    out = [
        f"v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(greatest(least(floor(cast(x as double) * {clustering.SCALE}), {cut}), -{cut}) as bigint)) as q from embeddings where len(embedding) = {dimensions} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dimensions})",
        f"s as (select q, row_number() over (order by sha256('{seed}:' || cast(vec_id as varchar)) nulls last, q) - 1 as c from v qualify c < {k})",
        f"d as (select r, unnest(q) as x, unnest(range(1, {dimensions + 1})) as j from v)",
        f"c0 as (select c, unnest(q) as x, unnest(range(1, {dimensions + 1})) as j from s)",
    ]
    for n in range(rounds + 1):
        out.append(f"a{n} as (select r, c, sum((d.x - m.x) * (d.x - m.x)) as far from d join c{n} m using (j) group by r, c qualify row_number() over (partition by r order by far, c) = 1)")
        if n < rounds:
            out.append(f"m{n} as (select c, j, floor_div(sum(x), count(*)) as x from a{n} join d using (r) group by c, j)")
            out.append(f"c{n + 1} as (select c, j, cast(coalesce(m{n}.x, c{n}.x) as bigint) as x from c{n} left join m{n} using (c, j))")
    floor_div = "(cast(sum(x) as hugeint) - ((cast(sum(x) as hugeint) % count(*) + count(*)) % count(*))) // count(*)"
    sql = ", ".join(f"{x.split(' as (', 1)[0]} as materialized ({x.split(' as (', 1)[1]}" for x in out).replace("floor_div(sum(x), count(*))", floor_div)
    return f"""with {sql},
h as (select c, sha256(string_agg(cast(x as varchar), ',' order by j)) as centroid_sha256 from c{rounds} group by c)
select vec_id, cast(c as int) as cluster, cast(far as bigint) as distance, cast(sum(far) over (partition by c) as bigint) as cluster_inertia, cast(sum(far) over () as bigint) as inertia, centroid_sha256
from a{rounds} join v using (r) join h using (c)"""


ORACLE_SQL = {"op4_quality_rules": quality_sql(), "op6_suffix_array_dedup": substring_sql(), "op9_decontaminate": contamination_sql(), "op11_audit_filters": audit_sql(), "op13_cluster_embeddings": clustering_sql()}
