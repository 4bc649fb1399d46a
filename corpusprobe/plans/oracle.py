"""DuckDB oracle SQL for the registered queries (same column names).

Written independently of the Spark plans: substring tests use ``contains`` and
a brute-force overlapping count over every start position.
"""

from __future__ import annotations

import re

from corpusprobe.plans.queries import CHAR_LOWER_BOUND, TILE_WORDS, WORD_LOWER_BOUND

L = TILE_WORDS
# Fixed value: Python's whitespace class as an RE2 pattern.
WS = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]+"

PROMPTS = f"""
p AS (SELECT 'task_' || CAST(item_id % 4 AS VARCHAR) AS task, item_id AS prompt_id, text
      FROM benchmark),
pw AS (SELECT task, prompt_id, text,
              list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '') AS w
       FROM p)"""

TILES = PROMPTS + f""",
tl AS (SELECT task, prompt_id, w, len(w) AS n, unnest(range(0, len(w), {L})) AS s
       FROM pw WHERE len(w) > 0),
tiles AS (SELECT task, prompt_id, CAST(s // {L} AS BIGINT) AS tile_idx,
                 array_to_string(CASE WHEN s + {L} >= n THEN w[greatest(n - {L}, 0) + 1 : n]
                                      ELSE w[s + 1 : s + {L}] END, ' ') AS tile
          FROM tl),
tile_hit AS (SELECT t.*, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, t.tile)) AS hit
             FROM tiles t)"""


def _overlap(t: str, q: str) -> str:
    return (f"len(list_filter(range(1, greatest(length({t}) - length({q}) + 1, 0) + 1), "
            f"lambda i: substr({t}, i, length({q})) = {q}))")


def _exp(lower_bound: int) -> int:
    e = 0
    while (1 << e) < lower_bound:
        e += 1
    return e


SQL: dict[str, str] = {}

SQL["count_occurrences"] = f"""
WITH {TILES},
qs AS (SELECT DISTINCT tile AS query FROM tiles),
h AS (SELECT q.query, d.text FROM qs q JOIN documents d ON contains(d.text, q.query))
SELECT q.query, CAST(coalesce(sum({_overlap('h.text', 'q.query')}), 0) AS BIGINT) AS n
FROM qs q LEFT JOIN h ON h.query = q.query
GROUP BY q.query
"""

SQL["prompt_is_contaminated"] = f"""
WITH {TILES},
f AS (SELECT task, prompt_id, bool_or(hit) AS flagged FROM tile_hit GROUP BY task, prompt_id)
SELECT p.task, p.prompt_id, coalesce(f.flagged, false) AS flagged
FROM p LEFT JOIN f ON f.task = p.task AND f.prompt_id = p.prompt_id
"""

SQL["word_tiles"] = f"""
WITH {TILES}
SELECT task, prompt_id, tile_idx, tile FROM tiles
"""

SQL["fixed_length_matches"] = f"""
WITH {TILES}
SELECT task, prompt_id, CAST(count(*) AS BIGINT) AS n_tiles,
       array_to_string(list(tile ORDER BY tile_idx), ' | ') AS tiles
FROM tile_hit WHERE hit GROUP BY task, prompt_id
"""

SQL["flagged_per_task_fixed"] = f"""
WITH {TILES},
f AS (SELECT task, prompt_id, bool_or(hit) AS flagged FROM tile_hit GROUP BY task, prompt_id)
SELECT p.task, CAST(count(*) FILTER (WHERE f.flagged) AS BIGINT) AS flagged
FROM p LEFT JOIN f ON f.task = p.task AND f.prompt_id = p.prompt_id
GROUP BY p.task
"""

# ---------------------------------------------------------------- halving, chars
_CE = _exp(CHAR_LOWER_BOUND)
CHAR_TILES = PROMPTS + f""",
cs AS (SELECT task, prompt_id, text,
              unnest(generate_series(CAST(ceil(ln(length(text)) / ln(2)) AS BIGINT), {_CE}, -1)) AS e
       FROM p WHERE length(text) > 0),
ct AS (SELECT task, prompt_id, text, CAST(2 ** e AS BIGINT) AS scale,
              unnest(range(0, length(text), CAST(2 ** e AS BIGINT))) AS i
       FROM cs),
ctiles AS (SELECT task, prompt_id, scale, CAST(i // scale AS BIGINT) AS k,
                  substr(text, i + 1, scale) AS tile FROM ct),
chit AS (SELECT c.*, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, c.tile)) AS hit
         FROM ctiles c),
hc AS (SELECT p.task, p.prompt_id, p.text, CAST(length(p.text) AS BIGINT) AS n_chars,
              CAST(coalesce(3 * max(c.scale) FILTER (WHERE c.hit), {CHAR_LOWER_BOUND}) AS BIGINT) AS longest
       FROM p LEFT JOIN chit c ON c.task = p.task AND c.prompt_id = p.prompt_id
       GROUP BY p.task, p.prompt_id, p.text)"""

SQL["char_tiles"] = f"""
WITH {CHAR_TILES}
SELECT task, prompt_id, scale, k, tile FROM ctiles
"""

SQL["halving_chars"] = f"""
WITH {CHAR_TILES}
SELECT task, prompt_id, n_chars, longest, longest > {CHAR_LOWER_BOUND} AS flagged FROM hc
"""

SQL["halving_chars_flagged"] = f"""
WITH {CHAR_TILES}
SELECT task, prompt_id, longest FROM hc WHERE longest > {CHAR_LOWER_BOUND}
"""

SQL["flagged_per_task_halving_chars"] = f"""
WITH {CHAR_TILES}
SELECT task, CAST(count(DISTINCT CASE WHEN longest > {CHAR_LOWER_BOUND} THEN text END) AS BIGINT) AS flagged
FROM hc GROUP BY task
"""

# ---------------------------------------------------------------- halving, words
_WB = WORD_LOWER_BOUND
_WE = _exp(WORD_LOWER_BOUND)
WORD_TILES = PROMPTS + f""",
ws AS (SELECT task, prompt_id, w, len(w) AS n,
              unnest(generate_series(CAST(ceil(ln(len(w)) / ln(2)) AS BIGINT), {_WE}, -1)) AS e
       FROM pw WHERE len(w) > 0),
wt AS (SELECT task, prompt_id, w, n, CAST(2 ** e AS BIGINT) AS scale,
              unnest(range(0, n, CAST(2 ** e AS BIGINT))) AS i
       FROM ws),
wt2 AS (SELECT task, prompt_id, CAST(n AS BIGINT) AS n, scale, CAST(i // scale AS BIGINT) AS k,
               least(scale, n - i) AS tw, array_to_string(w[i + 1 : i + scale], ' ') AS tile,
               (n + scale - 1) // scale AS nt,
               CAST(2 ** ceil(ln(n) / ln(2)) AS BIGINT) // 2 AS cut
        FROM wt),
wtiles AS (SELECT task, prompt_id, n AS n_words, scale, k, tile,
                  CAST(CASE WHEN k = 0 THEN 2 * scale WHEN k = nt - 1 THEN 2 * tw ELSE 3 * scale END
                       AS BIGINT) AS score1,
                  CAST(CASE WHEN (k + 1) * scale <= cut THEN
                         CASE WHEN k = 0 THEN 2 * scale WHEN k = cut // scale - 1 THEN 2 * scale
                              ELSE 3 * scale END END AS BIGINT) AS score2
           FROM wt2),
whit AS (SELECT t.*, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, t.tile)) AS hit
         FROM wtiles t),
s1 AS (SELECT task, prompt_id, max(scale) AS s1 FROM whit WHERE hit GROUP BY task, prompt_id),
s2 AS (SELECT task, prompt_id, max(scale) AS s2 FROM whit WHERE hit AND score2 IS NOT NULL
       GROUP BY task, prompt_id),
top AS (SELECT h.task, h.prompt_id, max(h.score1) AS top1 FROM whit h
        JOIN s1 ON s1.task = h.task AND s1.prompt_id = h.prompt_id AND h.scale = s1.s1
        WHERE h.hit GROUP BY h.task, h.prompt_id),
low AS (SELECT h.task, h.prompt_id, max(h.score2) AS low2 FROM whit h
        JOIN s2 ON s2.task = h.task AND s2.prompt_id = h.prompt_id AND h.scale = s2.s2
        WHERE h.hit AND h.score2 IS NOT NULL GROUP BY h.task, h.prompt_id),
hw AS (SELECT pw.task, pw.prompt_id, pw.text, CAST(len(pw.w) AS BIGINT) AS n_words,
              CAST(CASE WHEN top.top1 IS NULL THEN {_WB} WHEN top.top1 > {_WB} THEN top.top1
                        WHEN low.low2 IS NULL THEN {_WB} ELSE low.low2 END AS BIGINT) AS longest,
              coalesce(top.top1 <= {_WB}, false) AS rump
       FROM pw LEFT JOIN top ON top.task = pw.task AND top.prompt_id = pw.prompt_id
               LEFT JOIN low ON low.task = pw.task AND low.prompt_id = pw.prompt_id)"""

SQL["halving_word_tiles"] = f"""
WITH {WORD_TILES}
SELECT task, prompt_id, scale, k, tile, score1, score2 FROM wtiles
"""

# The search as the loop it is defined by, one row a step: halve the scale while no tile hits; a hit that is
# no longer than the bound is a rump, and the prompt is cut to half its power of two.
WORD_LOOP = PROMPTS + f""",
steps(task, prompt_id, n_words, w, scale, rump, found) AS (
  SELECT task, prompt_id, CAST(len(w) AS BIGINT), w, CAST(2 ** ceil(ln(len(w)) / ln(2)) AS BIGINT), false, CAST(NULL AS BIGINT)
  FROM pw WHERE len(w) > 0
  UNION ALL
  SELECT task, prompt_id, n_words,
         CASE WHEN best <= {_WB} THEN w[1 : CAST(2 ** ceil(ln(len(w)) / ln(2)) AS BIGINT) // 2] ELSE w END,
         CASE WHEN best IS NULL THEN scale // 2 ELSE scale END,
         rump OR coalesce(best <= {_WB}, false), CASE WHEN best > {_WB} THEN best END
  FROM (SELECT t.task, t.prompt_id, t.n_words, t.w, t.scale, t.rump,
               CAST(max(CASE WHEN NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, t.tile)) THEN NULL
                             WHEN i = 0 THEN 2 * scale WHEN i + scale >= len(w) THEN 2 * (len(w) - i)
                             ELSE 3 * scale END) AS BIGINT) AS best
        FROM (SELECT *, array_to_string(w[i + 1 : i + scale], ' ') AS tile
              FROM (SELECT *, unnest(range(0, len(w), scale)) AS i FROM steps WHERE found IS NULL AND scale >= {_WB})) t
        GROUP BY t.task, t.prompt_id, t.n_words, t.w, t.scale, t.rump)),
hl AS (SELECT pw.task, pw.prompt_id, CAST(len(pw.w) AS BIGINT) AS n_words, coalesce(max(s.found), {_WB}) AS longest,
              coalesce(bool_or(s.rump), false) AS rump
       FROM pw LEFT JOIN steps s ON s.task = pw.task AND s.prompt_id = pw.prompt_id GROUP BY pw.task, pw.prompt_id, pw.w)"""

SQL["halving_words"] = f"""
WITH RECURSIVE {WORD_LOOP}
SELECT task, prompt_id, n_words, CAST(longest AS BIGINT) AS longest, rump, longest > {_WB} AS flagged FROM hl
"""

SQL["halving_words_rump"] = f"""
WITH RECURSIVE {WORD_LOOP}
SELECT task, prompt_id, n_words, CAST(longest AS BIGINT) AS longest FROM hl WHERE rump
"""

SQL["halving_words_flagged"] = f"""
WITH {WORD_TILES}
SELECT task, text, longest, n_words FROM hw WHERE longest > {_WB}
"""

SQL["flagged_per_task_halving"] = f"""
WITH {WORD_TILES}
SELECT task, CAST(count(DISTINCT CASE WHEN longest > {_WB} THEN text END) AS BIGINT) AS flagged
FROM hw GROUP BY task
"""

# ---------------------------------------------------------------- corpus, lines, n-grams
NL = "chr(10)"
LINES = f"""
ls AS (SELECT doc_id, string_split(text, {NL}) AS parts FROM documents WHERE text IS NOT NULL),
lt AS (SELECT doc_id, CASE WHEN len(parts) > 1 AND parts[len(parts)] = '' THEN parts[1 : len(parts) - 1]
                           ELSE parts END AS parts FROM ls),
lines AS (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_no,
                 unnest(parts) AS line FROM lt)"""
GRAMS = LINES + f""",
lw AS (SELECT doc_id, line_no, list_filter(string_split_regex(line, '{WS}'), lambda x: x <> '') AS w
       FROM lines),
grams AS (SELECT doc_id, line_no, CAST(i - 1 AS BIGINT) AS pos,
                 array_to_string(w[i : i + 4], ' ') AS ngram
          FROM (SELECT doc_id, line_no, w, unnest(range(1, len(w) - 3)) AS i FROM lw WHERE len(w) >= 5))"""
TOKS = f"""
dt AS (SELECT doc_id, list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '') AS w
       FROM documents WHERE text IS NOT NULL),
dtok AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM dt),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS BIGINT) AS token_id
          FROM (SELECT DISTINCT token FROM dtok))"""

SQL["corpus_scan"] = "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents"

SQL["corpus_lines"] = f"WITH {LINES} SELECT doc_id, line_no, line FROM lines"

SQL["lines_scanned"] = f"WITH {LINES} SELECT CAST(count(*) AS BIGINT) AS lines FROM lines"

SQL["newline_count"] = f"""
SELECT CAST(coalesce(sum(length(text) - length(replace(text, {NL}, ''))), 0) AS BIGINT) AS newlines
FROM documents"""

SQL["ws_tokens"] = f"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '') AS w
           FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w, ' ') AS tokens FROM t"""

SQL["power_log"] = f"""
WITH {PROMPTS},
x AS (SELECT prompt_id, len(w) AS nw, length(text) AS nc FROM pw)
SELECT prompt_id, CAST(nw AS BIGINT) AS n_words,
       CASE WHEN nw > 0 THEN CAST(2 ** ceil(ln(nw) / ln(2)) AS BIGINT) END AS pl_words,
       CAST(nc AS BIGINT) AS n_chars,
       CASE WHEN nc > 0 THEN CAST(2 ** ceil(ln(nc) / ln(2)) AS BIGINT) END AS pl_chars
FROM x"""

SQL["ngram_multiset"] = f"WITH {GRAMS} SELECT doc_id, line_no, pos, ngram FROM grams"

SQL["ngram_set"] = f"""
WITH {GRAMS},
firsts AS (SELECT doc_id, line_no, ngram, min(pos) AS p0 FROM grams GROUP BY doc_id, line_no, ngram)
SELECT doc_id, line_no,
       CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY p0) - 1 AS BIGINT) AS pos, ngram
FROM firsts"""

SQL["distinct_ngrams"] = f"WITH {GRAMS} SELECT DISTINCT ngram FROM grams"

SQL["ngram_cardinality"] = f"""
WITH {GRAMS} SELECT CAST(count(DISTINCT ngram) AS BIGINT) AS n_ngrams FROM grams"""

SQL["ngram_index"] = f"""
WITH {GRAMS}
SELECT ngram, CAST(row_number() OVER (ORDER BY ngram) - 1 AS BIGINT) AS ngram_id
FROM (SELECT DISTINCT ngram FROM grams)"""

SQL["ngram_index_extended"] = f"""
WITH {GRAMS},
seen AS (SELECT g.ngram, bool_or(coalesce(d.lang = 'en', false)) AS early
         FROM grams g JOIN documents d ON d.doc_id = g.doc_id GROUP BY g.ngram)
SELECT ngram, CAST(row_number() OVER (ORDER BY early DESC, ngram) - 1 AS BIGINT) AS ngram_id FROM seen"""

SQL["token_ids"] = f"WITH {TOKS} SELECT token, token_id FROM vocab"

SQL["token_lines"] = f"""
WITH {TOKS}
SELECT a.doc_id, coalesce(string_agg(CAST(v.token_id AS VARCHAR), ' ' ORDER BY d.pos), '') AS line
FROM documents a LEFT JOIN dtok d ON d.doc_id = a.doc_id LEFT JOIN vocab v ON v.token = d.token GROUP BY a.doc_id"""

SQL["count_occurrences_tokens"] = f"""
WITH {TILES},
qs AS (SELECT DISTINCT tile AS query FROM tiles),
dj AS (SELECT ' ' || array_to_string(list_filter(string_split_regex(text, '{WS}'), lambda x: x <> ''), ' ')
              || ' ' AS t FROM documents),
h AS (SELECT q.query, dj.t, ' ' || q.query || ' ' AS pq FROM qs q JOIN dj ON contains(dj.t, ' ' || q.query || ' '))
SELECT q.query, CAST(coalesce(sum({_overlap('h.t', 'h.pq')}), 0) AS BIGINT) AS n
FROM qs q LEFT JOIN h ON h.query = q.query GROUP BY q.query"""

_DJ = f"""dj AS (SELECT ' ' || array_to_string(list_filter(string_split_regex(text, '{WS}'), lambda x: x <> ''), ' ')
              || ' ' AS t FROM documents)"""

SQL["count_occurrences_vocabulary"] = f"""
WITH {TILES}, {_DJ},
rare AS (SELECT w FROM (SELECT unnest(string_split(t, ' ')) AS w FROM dj) WHERE w <> '' GROUP BY w HAVING count(*) < 2),
qs AS (SELECT tile AS query, bool_or(r.w IS NOT NULL) AS unknown
       FROM (SELECT tile, unnest(string_split(tile, ' ')) AS w FROM (SELECT DISTINCT tile FROM tiles)) q
       LEFT JOIN rare r ON r.w = q.w GROUP BY tile),
h AS (SELECT q.query, dj.t, ' ' || q.query || ' ' AS pq FROM qs q JOIN dj
      ON NOT q.unknown AND contains(dj.t, ' ' || q.query || ' '))
SELECT q.query, CAST(coalesce(sum({_overlap('h.t', 'h.pq')}), 0) AS BIGINT) AS n
FROM qs q LEFT JOIN h ON h.query = q.query GROUP BY q.query"""

for _name, _base in (("prompt_is_contaminated_tokens", "prompt_is_contaminated"), ("halving_words_tokens", "halving_words")):
    SQL[_name] = re.sub("WITH (RECURSIVE )?", lambda m: f"{m[0]}{_DJ}, ", SQL[_base], count=1).replace(
        "FROM documents d WHERE contains(d.text, t.tile)", "FROM dj d WHERE contains(d.t, ' ' || t.tile || ' ')")

# ---------------------------------------------------------------- words and transforms
WORDS = f"""
fw AS (SELECT unnest(list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '')) AS word
       FROM documents),
freq AS (SELECT word, CAST(count(*) AS BIGINT) AS n FROM fw GROUP BY word),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, word) - 1 AS BIGINT) AS rank, word, n FROM freq),
tw AS (SELECT CAST(row_number() OVER (ORDER BY rank) - 1 AS BIGINT) AS idx, word
       FROM (SELECT rank, word FROM ranked WHERE length(word) BETWEEN 5 AND 14 ORDER BY rank LIMIT 10000)),
wk AS (SELECT word, unnest(range(1, 6)) AS k FROM tw)"""


def _draw(k: str, p: str) -> str:
    return f"md5(word || ':' || CAST({k} AS VARCHAR) || ':' || CAST({p} AS VARCHAR))"


def _shuffle(mid: str) -> str:
    return (f"CASE WHEN length({mid}) > 0 THEN array_to_string(list_transform(list_sort(list_transform("
            f"range(1, length({mid}) + 1), lambda p: {_draw('k', 'p')} || substr({mid}, p, 1))), "
            f"lambda y: substr(y, 33, 1)), '') ELSE '' END")


def _anagram(keep: int) -> str:
    mid = f"substr(word, {keep + 1}, greatest(length(word) - {2 * keep}, 0))"
    return f"left(word, {keep}) || {_shuffle(mid)} || right(word, {keep})"


_SEPS = "[',', '.', '!', '/', '\\', ':', ';', ' ']"
_INSERT = (f"CASE WHEN length(word) > 0 THEN array_to_string(list_transform(range(1, length(word) + 1), "
           f"lambda p: substr(word, p, 1) || CASE WHEN p < length(word) THEN "
           f"{_SEPS}[((strpos('0123456789abcdef', substr({_draw('k', 'p')}, 1, 1)) - 1) % 8) + 1] "
           f"ELSE '' END), '') ELSE '' END")

TRANSFORM_SQL = WORDS + f""",
t_reverse AS (SELECT 'reverse' AS transform, word, reverse(word) AS query FROM tw),
t_anagram_hard AS (SELECT DISTINCT 'anagram_hard' AS transform, word, {_anagram(1)} AS query FROM wk),
t_anagram_easy AS (SELECT DISTINCT 'anagram_easy' AS transform, word, {_anagram(2)} AS query FROM wk),
t_insertion AS (SELECT DISTINCT 'insertion' AS transform, word, {_INSERT} AS query FROM wk),
t_cycles AS (SELECT DISTINCT 'cycles' AS transform, word,
                    unnest(list_transform(range(0, length(word)),
                                          lambda i: substr(word, i + 1) || substr(word, 1, i))) AS query
             FROM tw),
tq AS (SELECT DISTINCT transform, word, query FROM (
         SELECT * FROM t_reverse UNION ALL SELECT * FROM t_anagram_hard UNION ALL
         SELECT * FROM t_anagram_easy UNION ALL SELECT * FROM t_insertion UNION ALL
         SELECT * FROM t_cycles) WHERE query <> word)"""

COUNTED = TRANSFORM_SQL + f""",
dq AS (SELECT DISTINCT query FROM tq),
tok AS (SELECT t, count(*) AS f FROM (SELECT unnest(string_split(text, ' ')) AS t FROM documents) GROUP BY t),
lens AS (SELECT DISTINCT length(query) AS l FROM dq WHERE NOT contains(query, ' ')),
pos AS (SELECT t, f, l, unnest(range(1, length(t) - l + 2)) AS i FROM tok JOIN lens ON length(tok.t) >= lens.l),
c1 AS (SELECT dq.query, sum(pos.f) AS n FROM dq JOIN pos ON substr(pos.t, pos.i, pos.l) = dq.query
       WHERE NOT contains(dq.query, ' ') GROUP BY dq.query),
c2 AS (SELECT dq.query, sum({_overlap('d.text', 'dq.query')}) AS n
       FROM dq JOIN documents d ON contains(d.text, dq.query)
       WHERE contains(dq.query, ' ') GROUP BY dq.query),
cnt AS (SELECT tq.transform, tq.word, tq.query, CAST(coalesce(c1.n, c2.n, 0) AS BIGINT) AS n
        FROM tq LEFT JOIN c1 ON c1.query = tq.query LEFT JOIN c2 ON c2.query = tq.query)"""

SQL["word_frequencies"] = f"WITH {WORDS} SELECT rank, word, n FROM ranked"
SQL["test_words"] = f"WITH {WORDS} SELECT idx, word FROM tw"
SQL["word_slice"] = f"WITH {WORDS} SELECT idx, word FROM tw WHERE idx >= 0 AND idx < 10"
for _t in ("reverse", "anagram_hard", "anagram_easy", "insertion", "cycles"):
    SQL[f"transform_{_t}"] = f"WITH {TRANSFORM_SQL} SELECT word, query FROM tq WHERE transform = '{_t}'"

SQL["transform_combined"] = f"""
WITH {TRANSFORM_SQL},
r AS (SELECT word, query AS t FROM tq WHERE transform = 'reverse')
SELECT DISTINCT 'reverse' AS transform, word, unnest([word || ', ' || t, word || ' ' || t, word || ' = ' || t,
       word || '=' || t, t || ', ' || word, t || ' ' || word, t || ' = ' || word, t || '=' || word]) AS query
FROM r"""

SQL["transform_counts"] = f"WITH {COUNTED} SELECT transform, word, query, n FROM cnt"
SQL["transform_avg_count"] = f"WITH {COUNTED} SELECT transform, avg(n) AS avg_n FROM cnt GROUP BY transform"

# Every combined query has more than eight characters: positions are looked up by the first eight.
COMBINED = TRANSFORM_SQL + """,
cq AS (SELECT DISTINCT transform, word, unnest([word || ', ' || query, word || ' ' || query, word || ' = ' || query,
              word || '=' || query, query || ', ' || word, query || ' ' || word, query || ' = ' || word,
              query || '=' || word]) AS query FROM tq),
dq AS (SELECT query, left(query, 8) AS k FROM (SELECT DISTINCT query FROM cq)),
pos AS (SELECT text, i, substr(text, i, 8) AS k FROM (SELECT text, unnest(range(1, length(text) - 6)) AS i FROM documents)),
found AS (SELECT dq.query, count(*) AS n FROM pos JOIN dq ON dq.k = pos.k
          WHERE substr(pos.text, pos.i, length(dq.query)) = dq.query GROUP BY dq.query),
cnt AS (SELECT cq.transform, cq.word, cq.query, CAST(coalesce(found.n, 0) AS BIGINT) AS n
        FROM cq LEFT JOIN found ON found.query = cq.query)"""
SQL["transform_counts_combined"] = f"WITH {COMBINED} SELECT transform, word, query, n FROM cnt"
SQL["transform_avg_count_combined"] = f"WITH {COMBINED} SELECT transform, avg(n) AS avg_n FROM cnt GROUP BY transform"

SQL["transform_counts_tokens"] = f"""
WITH {TRANSFORM_SQL}, {_DJ},
dq AS (SELECT query, array_to_string(list_filter(string_split_regex(query, '{WS}'), lambda x: x <> ''), ' ') AS nq
       FROM (SELECT DISTINCT query FROM tq)),
one AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(t, ' ')) AS w FROM dj) WHERE w <> '' GROUP BY w),
pairs AS (SELECT query, nq, len(string_split(nq, ' ')) AS k, array_to_string(string_split(nq, ' ')[1:2], ' ') AS start
          FROM dq WHERE contains(nq, ' ')),
spots AS (SELECT w, i, w[i] || ' ' || w[i + 1] AS start
          FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(trim(t, ' '), ' ') AS w FROM dj))),
more AS (SELECT pairs.query, count(*) AS n FROM pairs JOIN spots ON spots.start = pairs.start
         WHERE array_to_string(w[i : i + k - 1], ' ') = nq GROUP BY pairs.query)
SELECT tq.transform, tq.word, tq.query, CAST(coalesce(one.n, more.n, 0) AS BIGINT) AS n
FROM tq JOIN dq ON dq.query = tq.query LEFT JOIN one ON one.w = dq.nq LEFT JOIN more ON more.query = tq.query"""

# ---------------------------------------------------------------- natural-prompt regex
_NW = r"[^\p{L}\p{N}_]"
_UNIT = ("'(^|{nw}+)\\Q' || {a} || '\\E{nw}+\\Q' || {b} || '\\E($|{nw}+)|(^|{nw}+)\\Q' || {b} || "
         "'\\E{nw}+\\Q' || {a} || '\\E($|{nw}+)'")
NATURAL = WORDS + "," + LINES + f""",
pairs AS (SELECT idx, word, reverse(word) AS t FROM tw WHERE idx < 10),
pat AS (SELECT string_agg({_UNIT.format(nw=_NW, a='word', b='t')}, '|' ORDER BY idx) AS p FROM pairs),
cand AS (SELECT DISTINCT l.doc_id, l.line_no FROM lines l
         JOIN pairs ON contains(l.line, pairs.word) AND contains(l.line, pairs.t)),
hitl AS (SELECT l.doc_id, l.line_no,
                len(regexp_extract_all(l.line, (SELECT p FROM pat))) AS n
         FROM lines l SEMI JOIN cand ON cand.doc_id = l.doc_id AND cand.line_no = l.line_no),
nc AS (SELECT l.doc_id, l.line_no, 'reverse' AS transform, CAST(coalesce(h.n, 0) AS BIGINT) AS n
       FROM lines l LEFT JOIN hitl h ON h.doc_id = l.doc_id AND h.line_no = l.line_no)"""

SQL["word_pairs"] = f"WITH {WORDS} SELECT word, reverse(word) AS transformed FROM tw WHERE idx < 10"
SQL["natural_prompt_counts"] = f"WITH {NATURAL} SELECT doc_id, line_no, transform, n FROM nc WHERE n > 0"
SQL["natural_prompt_docs"] = f"""
WITH {NATURAL}
SELECT transform, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS matching_lines,
       CAST(sum(n) AS BIGINT) AS matches
FROM nc GROUP BY transform"""

# Pairs of plain words: a match takes two neighbouring runs and what stands
# behind them, so the next one starts three runs later at the earliest.
FOUND = NATURAL + """,
runs AS (SELECT doc_id, line_no, list_filter(string_split_regex(line, '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS r FROM lines),
near AS (SELECT doc_id, line_no, i, r[i] AS a, r[i + 1] AS b
         FROM (SELECT doc_id, line_no, r, unnest(range(1, len(r))) AS i FROM runs)),
common AS (SELECT a, b FROM near GROUP BY a, b ORDER BY count(*) DESC, a, b LIMIT 300),
both_ways AS (SELECT a, b FROM common UNION SELECT b, a FROM common),
places AS (SELECT doc_id, line_no, list(i ORDER BY i) AS spots FROM near SEMI JOIN both_ways USING (a, b) GROUP BY doc_id, line_no),
found AS (SELECT doc_id, line_no, 'common' AS transform,
                 list_reduce(list_prepend(0, spots), lambda s, i: CASE WHEN i >= s % 1000000
                     THEN (s // 1000000 + 1) * 1000000 + i + 3 ELSE s END) // 1000000 AS n FROM places
          UNION ALL SELECT doc_id, line_no, transform, n FROM nc WHERE n > 0)"""
SQL["natural_pairs_found"] = f"WITH {FOUND} SELECT doc_id, line_no, transform, CAST(n AS BIGINT) AS n FROM found"
SQL["natural_pairs_report"] = f"""
WITH {FOUND}
SELECT t.transform, CAST((SELECT count(*) FROM lines) AS BIGINT) AS lines, CAST(count(f.n) AS BIGINT) AS matching_lines,
       CAST(coalesce(sum(f.n), 0) AS BIGINT) AS matches
FROM (SELECT unnest(['common', 'reverse']) AS transform) t LEFT JOIN found f ON f.transform = t.transform
GROUP BY t.transform"""

# ---------------------------------------------------------------- failed lookups
CHECKED = f"""
raw AS (SELECT 'task_' || CAST(item_id % 4 AS VARCHAR) AS task, item_id AS prompt_id, encode(text)[1:60] AS raw FROM benchmark
        UNION ALL SELECT role, conv_id, encode(text)[1:60] FROM conversations),
ck AS (SELECT task, prompt_id, try(decode(raw)) AS text,
              CASE WHEN raw IS NULL THEN 'null text' WHEN try(decode(raw)) IS NULL THEN 'invalid utf-8'
                   WHEN octet_length(raw) = 0 THEN 'empty text' END AS error
       FROM raw),
cn AS (SELECT q.query, sum({_overlap('d.text', 'q.query')}) AS n
       FROM (SELECT DISTINCT text AS query FROM ck WHERE error IS NULL) q JOIN documents d ON contains(d.text, q.query)
       GROUP BY q.query),
checked AS (SELECT ck.task, ck.prompt_id, CASE WHEN ck.error IS NULL THEN CAST(coalesce(cn.n, 0) AS BIGINT) END AS n, ck.error
            FROM ck LEFT JOIN cn ON cn.query = ck.text)"""
SQL["prompt_counts_checked"] = f"WITH {CHECKED} SELECT task, prompt_id, n, error FROM checked"
SQL["lookup_report"] = f"""
WITH {CHECKED}
SELECT task, CAST(count(*) AS BIGINT) AS prompts, CAST(count(error) AS BIGINT) AS failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS n
FROM checked GROUP BY task"""

# ---------------------------------------------------------------- MinHash and containment
from corpusprobe.operators.minhash import PRIME, permutations  # noqa: E402

_PERM = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(permutations()))


def _shingles(src: str, key: str) -> str:
    return f"""(SELECT DISTINCT {key} AS key, array_to_string(w[i : i + 4], ' ') AS shingle
        FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i
              FROM (SELECT {key}, list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '') AS w
                    FROM {src}) WHERE len(w) >= 5))"""


SETS = f"""
dsh AS {_shingles('documents', 'doc_id')},
qsh AS {_shingles('benchmark', 'item_id')},
perm AS (SELECT * FROM (VALUES {_PERM}) t(i, a, b)),
dmin AS (SELECT key, i, min((a * (CAST('0x' || substr(md5(shingle), 1, 8) AS BIGINT) % {PRIME}) + b) % {PRIME}) AS m
         FROM dsh, perm GROUP BY key, i),
qmin AS (SELECT key, i, min((a * (CAST('0x' || substr(md5(shingle), 1, 8) AS BIGINT) % {PRIME}) + b) % {PRIME}) AS m
         FROM qsh, perm GROUP BY key, i),
qsz AS (SELECT key AS qkey, count(*) AS q_size FROM qsh GROUP BY key),
ov AS (SELECT q.key AS qkey, d.key, count(*) AS overlap FROM qsh q JOIN dsh d ON d.shingle = q.shingle
       GROUP BY q.key, d.key),
cx AS (SELECT ov.qkey, ov.key, CAST(overlap AS BIGINT) AS overlap, CAST(q_size AS BIGINT) AS q_size,
              overlap / q_size AS containment
       FROM ov JOIN qsz ON qsz.qkey = ov.qkey WHERE overlap / q_size >= 0.8)"""

SQL["minhash_signatures"] = f"""
WITH {SETS},
sz AS (SELECT key, CAST(count(*) AS BIGINT) AS size FROM dsh GROUP BY key)
SELECT dmin.key, sz.size, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS sig
FROM dmin JOIN sz ON sz.key = dmin.key GROUP BY dmin.key, sz.size"""

SQL["containment_exact"] = f"WITH {SETS} SELECT qkey, key, overlap, q_size, containment FROM cx"

SQL["index_membership"] = f"""
WITH {SETS}
SELECT l.doc_id AS key, EXISTS (SELECT 1 FROM dsh WHERE dsh.key = l.doc_id) AS member FROM labels l"""

SQL["minhash_estimate"] = f"""
WITH {SETS}
SELECT cx.qkey, cx.key, count(*) FILTER (WHERE qm.m = dm.m) / 128 AS jaccard_est
FROM cx JOIN qmin qm ON qm.key = cx.qkey JOIN dmin dm ON dm.key = cx.key AND dm.i = qm.i
GROUP BY cx.qkey, cx.key"""

# The parts are cut by the same dynamic program, as a recursion over the number of parts (ties go to the
# left cut), then walked back; a row of the index is a run of eight signature values in hex.
LSH = f"""
sz AS (SELECT key, CAST(count(*) AS BIGINT) AS size FROM dsh GROUP BY key),
cells AS (SELECT CASE WHEN size < 64 THEN size ELSE size - size % (1::BIGINT << (length(bin(size)) - 6)) END AS cell, size FROM sz),
h AS (SELECT row_number() OVER (ORDER BY cell) AS j, max(size) AS u, sum(count(*)) OVER (ORDER BY cell) AS n,
             sum(sum(size)) OVER (ORDER BY cell) AS total FROM cells GROUP BY cell),
cut(p, j, c, i) AS (
  SELECT 1, j, (u * n - total) * 1000 // u, 0 FROM h
  UNION ALL
  SELECT p, j, best.c, best.i FROM (
    SELECT x.p + 1 AS p, b.j, min({{'c': x.c + (b.u * (b.n - a.n) - (b.total - a.total)) * 1000 // b.u, 'i': a.j}}) AS best
    FROM cut x JOIN h a ON a.j = x.j JOIN h b ON b.j > a.j WHERE x.p < 32 GROUP BY x.p, b.j)),
ends(p, j) AS (
  SELECT max(p), max(j) FROM cut
  UNION ALL
  SELECT e.p - 1, cut.i FROM ends e JOIN cut ON cut.p = e.p AND cut.j = e.j WHERE e.p > 1),
bounds AS (SELECT e.p - 1 AS part, h.u AS hi, coalesce(lag(h.u) OVER (ORDER BY e.p), 0) AS lo FROM ends e JOIN h ON h.j = e.j),
dx AS (SELECT key, i, printf('%08x', m) AS x FROM dmin),
ix AS (SELECT CAST(b.part AS INTEGER) AS part, CAST(t.i AS INTEGER) AS tree, t.path, t.key
       FROM (SELECT key, i, string_agg(x, '') OVER (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS path
             FROM dx) t
       JOIN sz ON sz.key = t.key JOIN bounds b ON sz.size > b.lo AND sz.size <= b.hi)"""

SQL["lsh_ensemble_bands"] = f"WITH RECURSIVE {SETS}, {LSH} SELECT part, tree, path, key FROM ix"

SQL["containment_lsh"] = f"""
WITH RECURSIVE {SETS}, {LSH},
qt AS (SELECT key AS qkey, i AS tree,
              string_agg(printf('%08x', m), '') OVER (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS path
       FROM qmin),
ps AS (SELECT b.part, q.qkey, 0.8::DOUBLE / (b.hi / (1::BIGINT << (length(bin(q.q_size)) - 1)) + 1.0::DOUBLE - 0.8::DOUBLE) AS s
       FROM bounds b JOIN qsz q ON b.hi >= 0.8::DOUBLE * (1::BIGINT << (length(bin(q.q_size)) - 1))),
need AS (SELECT part, qkey, r, CASE WHEN s >= 1 THEN 1 ELSE ceil(ln(1 - 0.98::DOUBLE) / ln(1 - pow(s, r))) END AS trees
         FROM ps, (SELECT unnest(range(1, 9)) AS r)),
plan AS (SELECT part, qkey, coalesce(max(r) FILTER (WHERE trees <= 128 // r), 1) AS r,
                coalesce(arg_max(trees, r) FILTER (WHERE trees <= 128 // r), 128) AS trees
         FROM need GROUP BY part, qkey),
cand AS (SELECT DISTINCT qt.qkey, ix.key
         FROM ix JOIN qt ON qt.tree = ix.tree AND substr(qt.path, 1, 8) = substr(ix.path, 1, 8)
         JOIN plan ON plan.part = ix.part AND plan.qkey = qt.qkey
         WHERE ix.tree % r = 0 AND ix.tree < trees * r AND starts_with(ix.path, substr(qt.path, 1, 8 * r)))
SELECT cx.qkey, cx.key, overlap, q_size, containment FROM cx JOIN cand ON cand.qkey = cx.qkey AND cand.key = cx.key"""

# ---------------------------------------------------------------- prompt sets, tasks, embedding
LISTED = "SELECT DISTINCT 'task_' || CAST(item_id % 12 AS VARCHAR) AS task FROM benchmark"
AVAIL = """SELECT DISTINCT 'task_' || CAST(doc_id % 10 AS VARCHAR) AS task,
       CASE WHEN quality = 1 AND toxic = 0 THEN 'test' WHEN quality = 0 THEN 'validation' ELSE 'train' END AS split
FROM labels"""

SQL["prompts_by_task"] = f"WITH {PROMPTS} SELECT task, prompt_id, text FROM p"
SQL["task_list"] = f"WITH {PROMPTS} SELECT DISTINCT task FROM p"
SQL["typed_projection"] = """
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(quality AS INTEGER) AS quality, CAST(toxic AS BOOLEAN) AS toxic
FROM labels"""
SQL["decoded_prompts"] = "SELECT item_id AS prompt_id, decode(encode(text)) AS text FROM benchmark"
SQL["split_fallback"] = f"""
WITH t AS ({LISTED}), a AS ({AVAIL}),
b AS (SELECT task, min(CASE split WHEN 'test' THEN 1 WHEN 'validation' THEN 2 END) AS p
      FROM a WHERE split IN ('test', 'validation') GROUP BY task)
SELECT t.task, CASE b.p WHEN 1 THEN 'test' WHEN 2 THEN 'validation' END AS split
FROM t LEFT JOIN b ON b.task = t.task"""
SQL["pending_tasks"] = f"""
WITH t AS ({LISTED}),
done AS (SELECT task FROM ({AVAIL}) WHERE split = 'test')
SELECT task FROM t WHERE task NOT IN (SELECT task FROM done)"""
SQL["prompt_counts_by_task"] = f"""
WITH {PROMPTS},
qs AS (SELECT DISTINCT text AS query FROM p WHERE length(text) > 0),
h AS (SELECT q.query, sum({_overlap('d.text', 'q.query')}) AS n
      FROM qs q JOIN documents d ON contains(d.text, q.query) GROUP BY q.query)
SELECT p.task, p.prompt_id, CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM p LEFT JOIN h ON h.query = p.text"""

_EMB = f"""
et AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '{WS}'), lambda x: x <> ''),
              lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64) AS b FROM documents),
ec AS (SELECT doc_id, list_transform(range(0, 64), lambda j: len(list_filter(b, lambda x: x = j))) AS c FROM et),
en AS (SELECT doc_id, c, sqrt(CAST(list_sum(list_transform(c, lambda x: CAST(x AS BIGINT) * x)) AS DOUBLE)) AS nrm
       FROM ec),
emb AS (SELECT doc_id, list_transform(c, lambda x: CAST(CASE WHEN nrm > 0 THEN x / nrm ELSE 0.0 END AS FLOAT))
               AS embedding FROM en)"""
SUB = "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '1066') LIMIT 100"
SQL["seeded_subset"] = SUB
SQL["embed_documents"] = f"WITH {_EMB} SELECT doc_id, embedding FROM emb"
SQL["embed_subset"] = f"WITH {_EMB} SELECT doc_id, embedding FROM emb WHERE doc_id IN ({SUB})"

# ---------------------------------------------------------------- search options
SQL["prompt_is_contaminated_normalized"] = f"""
WITH nd AS (SELECT regexp_replace(text, '{WS}', ' ', 'g') AS text FROM documents),
{TILES.replace("FROM documents d WHERE contains(d.text, t.tile)", "FROM nd d WHERE contains(d.text, t.tile)")},
f AS (SELECT task, prompt_id, bool_or(hit) AS flagged FROM tile_hit GROUP BY task, prompt_id)
SELECT p.task, p.prompt_id, coalesce(f.flagged, false) AS flagged
FROM p LEFT JOIN f ON f.task = p.task AND f.prompt_id = p.prompt_id"""

SQL["halving_words_ignore_rump"] = f"""
WITH {WORD_TILES},
sr AS (SELECT task, prompt_id, max(scale) AS sr FROM whit WHERE hit AND score1 > {_WB} GROUP BY task, prompt_id),
br AS (SELECT h.task, h.prompt_id, max(h.score1) AS best FROM whit h
       JOIN sr ON sr.task = h.task AND sr.prompt_id = h.prompt_id AND h.scale = sr.sr
       WHERE h.hit GROUP BY h.task, h.prompt_id)
SELECT pw.task, pw.prompt_id, CAST(coalesce(br.best, {_WB}) AS BIGINT) AS longest,
       coalesce(br.best, {_WB}) > {_WB} AS flagged
FROM pw LEFT JOIN br ON br.task = pw.task AND br.prompt_id = pw.prompt_id"""
