"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .license_scan import BASE_PHRASES, needed, template_sets
from .quality_rules import FENCE, MIN_GROUP, RULES

_SPACE = r"[\x20\x09-\x0D]"

#: word arrays, 1-based positions
_ALNUM_WORDS = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), "
                r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
_SPACE_WORDS = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), "
                r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                r"'[\x20\x09-\x0D]+'), lambda x: x <> '')")

DECONTAMINATION = f"""
with d as (select doc_id, {_ALNUM_WORDS} w from documents),
b as (select item_id, {_ALNUM_WORDS} w from benchmark),
bw as (
  select distinct item_id, k, list_slice(w, i, i + k - 1) win
  from (select item_id, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
sizes as (select distinct k from bw),
dw as (
  select doc_id, k, i, list_slice(w, i, i + k - 1) win
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, sizes where len(w) >= k)),
m as (select distinct dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw using (k, win)),
hit as (select doc_id, count(distinct p) n_hit
        from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, i, k from m)) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) items
       from (select distinct doc_id, cast(item_id as varchar) s from m) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""

LINE_DEDUP = rf"""
with d as (select doc_id, text, string_split(text, chr(10)) l from documents),
w as (select doc_id, i, l[i] a, l[i + 1] b, l[i + 2] c
      from (select doc_id, l, unnest(range(1, len(l) - 1)) i from d where len(l) >= 3)
      where regexp_matches(l[i] || l[i + 1] || l[i + 2], '[^\x20\x09-\x0D]')),
r as (select *, row_number() over (partition by a, b, c order by doc_id, i) k from w),
lost as (select distinct doc_id, unnest(range(i, i + 3)) i from r where k > 1),
n as (select doc_id, count(*) n_removed, list(i) gone from lost group by doc_id)
select doc_id, coalesce(len(l), 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed,
       case when n_removed is null then text
            else array_to_string(list_filter(l, lambda x, i: not list_contains(gone, i)), chr(10)) end clean_text
from d left join n using (doc_id)
"""


def _quality() -> str:
    cell = "case when v < 64 then v else v - v % (1::bigint << (length(bin(v)) - 6)) end"
    quart = ", ".join(
        f"min(case when measure = '{m}' and 4 * below >= {q} * al then cell end) {m}_{q}" for m in RULES for q in (1, 3))
    levels = []
    for tag, keys in (("own", "lang, source"), ("bylang", "lang"), ("corpus", "one")):
        levels.append(f"""
{tag} as (select {keys}, max(al) {tag}_n, {quart} from (
  select {keys}, measure, cell, sum(n) over (partition by {keys}, measure order by cell) below,
         sum(n) over (partition by {keys}, measure) al
  from (select {keys}, measure, cell, sum(n) n from sk group by all)) group by {keys})""")
    tests = []
    for m, (below, above) in RULES.items():
        q = {k: (f"(case when own_n >= {MIN_GROUP} then own.{m}_{k} when bylang_n >= {MIN_GROUP} then bylang.{m}_{k} "
                 f"else corpus.{m}_{k} end)") for k in (1, 3)}
        if below is not None:
            tests.append(f"{m} < {q[1]} - greatest({FENCE} * ({q[3]} - {q[1]}), {below})")
        if above is not None:
            tests.append(f"{m} > {q[3]} + greatest({FENCE} * ({q[3]} - {q[1]}), {above})")
    union = " union all ".join(f"select lang, source, '{m}' measure, {m} v from m where not base_failed" for m in RULES)
    return rf"""
with t as (
  select doc_id, coalesce('=' || lang, '') lang, coalesce('=' || source, '') source, coalesce(text, '') t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l
  from documents),
rep as (
  select doc_id, count(distinct p) n from (
    select doc_id, unnest(range(i, i + 8)) p from (
      select doc_id, i, count(*) over (partition by doc_id, win) c
      from (select doc_id, i, list_slice(w, i, i + 7) win
            from (select doc_id, w, unnest(range(1, len(w) - 6)) i from t where len(w) >= 8)))
    where c > 1) group by doc_id),
c as (
  select t.doc_id, lang, source, len(w)::bigint n_words, len(l)::bigint n_lines,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint n_upper,
         (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words
  from t left join rep using (doc_id)),
m as (
  select *, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) symbol_share,
         coalesce(n_upper * 1000 // nullif(word_chars, 0), 0) upper_share,
         coalesce(word_chars * 1000 // nullif(n_words, 0), 0) word_length,
         coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) repeat_share,
         coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) dup_line_share,
         n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed
  from c),
v as ({union}),
sk as (select lang, source, 1 one, measure, {cell} cell, count(*) n from v group by all),
{",".join(levels)}
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce({" or ".join(tests)}, false) kept
from m left join own using (lang, source) left join bylang using (lang) left join corpus on true
"""


def _licenses() -> str:
    places = " union all ".join(
        f"select doc_id, i - 1 pos, '{label}' label from (select doc_id, w, unnest(range(1, len(w) + 1)) i from d) "
        f"where list_slice(w, i, i + {len(phrase.split()) - 1}) = {phrase.split()}"
        for phrase, label in BASE_PHRASES.items())
    met = []
    for label, words in template_sets():
        listed = sorted(w.decode() for w in words)
        met.append(f"select doc_id, '{label}' label, len(list_intersect(w, {listed})) / {len(listed)} c "
                   f"from l where len(list_intersect(w, {listed})) >= {needed(len(listed))}")
    return f"""
with d as (select doc_id, {_ALNUM_WORDS} w from documents),
l as (select doc_id, list_distinct({_ALNUM_WORDS}) w
      from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) text from documents)),
p as ({places}),
b as (select doc_id, count(*) n, min(pos) f, max(pos) t, string_agg(distinct label, ',' order by label) s from p group by doc_id),
m as ({" union all ".join(met)}),
a as (select doc_id, string_agg(distinct label, ',' order by label) s
      from (select doc_id, label from p union all select doc_id, label from m) group by doc_id),
c as (select doc_id, max(c) c from m group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(b.n, 0)::bigint n_base, b.f::bigint first_word, b.t::bigint last_word,
       coalesce(b.s, '') base_labels, coalesce(a.s, '') labels,
       case when b.n > 0 then 1.0 else coalesce(c.c, 0.0) end::double score
from d left join b using (doc_id) left join a using (doc_id) left join c using (doc_id)
"""


#: Links by counting common shingles of all pairs, components by reachability.
NEAR_DEDUP = f"""
with recursive d as (select doc_id, {_SPACE_WORDS} w from documents),
s as (select distinct doc_id, unnest(case when len(w) < 4 then [w] else
        list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3)) end) x from d where len(w) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
common as (select a.doc_id u, b.doc_id v, count(*) c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by all),
e as (select u, v from common join n nu on nu.doc_id = u join n nv on nv.doc_id = v where 100 * c >= 80 * (nu.n + nv.n - c)),
r as (select doc_id u, doc_id v from d union select r.u, e.v from r join e on r.v = e.u)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, m.c component_id, d.doc_id = m.c kept
from d left join n using (doc_id) join (select u, min(v) c from r group by u) m on m.u = d.doc_id
"""


LEXICAL_SEARCH = f"""
with d as (select row_number() over () k, doc_id, {_ALNUM_WORDS} w from documents),
c as (select count(*) n_docs, sum(len(w))::bigint n_terms from d where len(w) > 0),
i as (select row_number() over () item, item_id, {_ALNUM_WORDS} w from (select distinct item_id, text from benchmark)),
it as (select distinct item, item_id, unnest(w) term from i),
tf as (select k, doc_id, n, term, count(*) tf from (select k, doc_id, len(w) n, unnest(w) term from d)
       where term in (select term from it) group by all),
df as (select term, count(*) df from tf group by term),
s as (
  select item, item_id, k, doc_id,
         sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))))::bigint score
  from it join tf using (term) join df using (term) cross join c group by all),
r as (select *, row_number() over (partition by item order by score desc, doc_id nulls last)::int rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""


SQL: dict[str, str] = {
    "op1_benchmark_decontamination": DECONTAMINATION,
    "op2_line_dedup": LINE_DEDUP,
    "op8_minhash_near_dedup": NEAR_DEDUP,
    "op9_license_scan": _licenses(),
    "op10_quality_rules": _quality(),
    "op12_lexical_search": LEXICAL_SEARCH,
}
