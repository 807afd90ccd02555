"""DuckDB SQL for the registered queries. Fragments that several share are spelt out once and put in by name."""

from __future__ import annotations

from tamarack.functions.text import STOP_TOKENS
from tamarack.operators.snippets import GETTER_TERMS, HIGH_SIGNAL_TERMS, NUMERIC_OUTPUT_TERMS, WIDE_CONTEXT_TERMS, WIDEST_CONTEXT_TERMS


def tokens(x: str) -> str:
    camel = f"string_split(regexp_replace(r, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' ')"
    return f"flatten(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda r: list_concat([lower(r)], list_filter(list_transform({camel}, lambda p: lower(p)), lambda p: p <> lower(r)))))"


def lines(x: str) -> str:
    parts = f"string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"(CASE WHEN {x} = '' THEN [] WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+', ''), '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+$', '')"


FILE = "'doc/' || lpad(cast(doc_id AS VARCHAR), 9, '0')"
DOCS = f"docs AS (SELECT {FILE} AS file, source, lang, coalesce(text, '') AS text, {tokens("coalesce(text, '')")} AS toks FROM documents)"
ASKED = f"asked AS (SELECT item_id AS query_id, coalesce(text, '') AS text, {tokens("coalesce(text, '')")} AS toks FROM benchmark)"


def ranked(name: str, b: float, k: int, asked: str = "asked") -> str:
    return f"""
{name}_post AS (SELECT file, len(toks) AS dl, t AS term, count(*) AS tf FROM (SELECT file, toks, unnest(toks) AS t FROM docs) GROUP BY file, dl, t),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_post GROUP BY term),
{name}_q AS (SELECT query_id, t AS term, count(*) AS qtf FROM (SELECT query_id, unnest(toks) AS t FROM {asked}) GROUP BY query_id, t),
{name}_score AS (
  SELECT query_id, file, round(sum(qtf * (ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl)))), 6) AS score
  FROM {name}_q JOIN {name}_post USING (term) JOIN {name}_df USING (term), (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs) GROUP BY query_id, file),
{name} AS (
  SELECT * FROM (
    SELECT a.query_id, d.file, coalesce(s.score, 0) AS score, row_number() OVER (PARTITION BY a.query_id ORDER BY coalesce(s.score, 0) DESC, d.file)::INTEGER AS rank
    FROM {asked} a CROSS JOIN docs d LEFT JOIN {name}_score s ON s.query_id = a.query_id AND s.file = d.file)
  WHERE rank <= {k})"""


TRUTH = "truth AS (SELECT query_id, file FROM asked a JOIN docs d ON contains(d.text, a.text))"
BASE = f"WITH {DOCS}, {ASKED}, {ranked('bm', 0.75, 50)}"
BOTH = f"{BASE}, {ranked('flat', 0.0, 50)}, {TRUTH}"


def per(name: str, source: str, depth: int) -> str:
    return f"{name} AS (SELECT a.query_id, min(r.rank) AS correct_rank, coalesce(1.0::DOUBLE / min(r.rank), 0) AS rr FROM asked a LEFT JOIN (SELECT {source}.* FROM {source} JOIN truth USING (query_id, file) WHERE rank <= {depth}) r ON r.query_id = a.query_id GROUP BY a.query_id)"


HINTED = """hint AS (SELECT query_id, (list_sort(list_transform(list_distinct(toks), lambda t: {'n': -len(t), 't': t})))[1].t AS hint FROM asked),
holds AS (SELECT DISTINCT query_id, file FROM hint JOIN bm_post ON term = hint),
hinted AS (SELECT bm.*, holds.file IS NOT NULL AS direct FROM bm LEFT JOIN holds USING (query_id, file)),
seen AS (SELECT query_id, max(CASE WHEN rank = 1 THEN file END) AS top1_file, max(CASE WHEN rank = 2 THEN file END) AS top2_file, max(CASE WHEN rank = 1 THEN score END) AS s1,
  max(CASE WHEN rank = 2 THEN score END) AS s2, bool_or(rank = 1 AND direct) AS d1, min(CASE WHEN direct THEN rank END) AS first_direct_rank, count(*) FILTER (WHERE direct) AS n_direct FROM hinted GROUP BY query_id),
chosen AS (SELECT query_id, top1_file, top2_file, CASE WHEN s2 > 0 THEN round(s1 / s2, 9) END AS score_ratio, first_direct_rank, n_direct,
  list_filter([CASE WHEN s2 > 0 AND s1 / s2 <= 1.02 THEN 'low_score_ratio<=1.02' END, CASE WHEN NOT d1 THEN 'top1_without_direct_hint' END, CASE WHEN n_direct >= 7 THEN 'many_direct_hints>=7' END], lambda x: x IS NOT NULL) AS reasons FROM seen),
low AS (SELECT query_id FROM chosen WHERE list_contains(reasons, 'low_score_ratio<=1.02'))"""

HIT = lambda k, r="correct_rank": f"coalesce({r} <= {k}, false)"


def summary(by: str, depth: int = 10) -> str:
    cap = f"coalesce(correct_rank, {depth + 1})::DOUBLE"
    spread = lambda x, n: f"round(quantile_cont({x}, 0.5), 9) AS {n}_median, round(coalesce(stddev_samp({x}), 0), 9) AS {n}_sd, round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 9) AS {n}_iqr"
    hits = ", ".join(f"count(*) FILTER (WHERE {HIT(k)}) AS hits_{k}, round(avg({HIT(k)}::INTEGER), 9) AS accuracy_{k}" for k in (1, 3, 5, 10))
    return f"SELECT {by}, count(*) AS n, count(*) FILTER (WHERE correct_rank IS NULL) AS misses, round(avg(rr), 9) AS mrr, {spread('rr', 'rr')}, {spread(cap, 'rank')}, {hits}"


def mcnemar(b: str, c: str) -> str:
    terms = f"list_transform(range(0, least({b}, {c}) + 1), lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2)))"
    return f"CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum({terms})) END"


TRACE = """traces AS (SELECT conv_id, turn, concat_ws(chr(10), '--- turn::' || role, coalesce(text, ''), f, array_to_string(list_transform(range(0, (turn % 6)::BIGINT), lambda i: f), chr(10)),
  '  at java.util.List.get(List.java)', ' ', 'at junit.framework.Run.run(Run.java)') AS trace FROM (SELECT *, chr(9) || 'at org.app.' || role || '.Say.run(Say.java:' || turn || ')' AS f FROM conversations))"""
OUTPUT = """output AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, event_type AS file FROM events),
pool AS (SELECT DISTINCT user_id AS query_id, p.place, p.file FROM events, (VALUES (0, 'purchase'), (1, 'click'), (2, 'view'), (3, 'refund')) p(place, file))"""


def counters(depth: int) -> str:
    return f"""WITH {OUTPUT},
marked AS (SELECT o.*, p.file IS NOT NULL AS known, row_number() OVER (PARTITION BY o.query_id, o.file ORDER BY position) AS nth FROM output o LEFT JOIN pool p ON p.query_id = o.query_id AND p.file = o.file),
run AS (SELECT *, coalesce(sum((known AND nth = 1)::INTEGER) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM marked),
counted AS (SELECT query_id, count(*) AS returned, count(*) FILTER (WHERE so_far < {depth} AND known AND nth = 1) AS valid, count(*) FILTER (WHERE so_far < {depth} AND NOT known) AS invalid,
  count(*) FILTER (WHERE so_far < {depth} AND known AND nth > 1) AS duplicates FROM run GROUP BY query_id),
whole AS (SELECT query_id, returned, valid, invalid, duplicates, least({depth}, 4) - valid AS added FROM counted)"""


USAGE = "count(*) AS calls, coalesce(sum(tokens), 0)::BIGINT AS total_tokens, round(coalesce(avg(tokens), 0), 2) AS average_tokens, round(coalesce(sum(seconds), 0), 3) AS total_seconds, round(coalesce(avg(seconds), 0), 3) AS average_seconds FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS tokens, round(value, 2) AS seconds FROM events)"
JOINED = "regexp_replace(coalesce(text, ''), '[ \\n]', '', 'g')"
CAMEL = f"list_filter(string_split_regex(regexp_replace({JOINED}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda p: p <> '')"
STOPS = ", ".join(f"'{x}'" for x in STOP_TOKENS)
PASCAL = "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), '')"
PACKAGE = "regexp_replace(lower(p_type), '[^a-z]+', '.', 'g')"
NAME = f"regexp_replace({PASCAL}, '[^A-Za-z]', '', 'g') || (['Test', 'Tests', 'TestCase', '', ''])[p_partkey % 5 + 1]"
BOOSTED = f"""{BASE}, own AS (SELECT query_id, file, list_sort(list(DISTINCT term)) AS hits FROM bm_q JOIN bm_post USING (term) WHERE len(term) >= 4 GROUP BY query_id, file),
first AS (SELECT file FROM docs ORDER BY file LIMIT 50),
scored AS (SELECT query_id, file, score FROM bm_score UNION ALL SELECT query_id, file, 0 FROM asked CROSS JOIN first WHERE NOT EXISTS (FROM bm_score s WHERE s.query_id = asked.query_id AND s.file = first.file)),
boosted AS (SELECT query_id, file, score, coalesce(hits, []) AS hits, coalesce(hits, [])[1:8] AS both_ FROM scored LEFT JOIN own USING (query_id, file))"""


def retained(cap: str, resort: bool, boost: float) -> str:
    head = f"""{BASE}, pool AS (SELECT query_id, rank, file, score AS total, right(file, 1) = '7' AS prot FROM bm),
n AS (SELECT *, count(*) FILTER (WHERE rank <= 10 AND NOT prot) OVER e AS n_free, count(*) FILTER (WHERE rank > 10 AND prot) OVER e AS n_come,
  count(*) FILTER (WHERE rank <= 10 AND NOT prot) OVER (PARTITION BY query_id ORDER BY rank DESC) AS i_free, count(*) FILTER (WHERE rank > 10 AND prot) OVER (PARTITION BY query_id ORDER BY rank) AS i_come
  FROM pool WINDOW e AS (PARTITION BY query_id)),
m AS (SELECT *, rank <= 10 AND NOT prot AND i_free <= least(n_free, n_come{cap}) AS leaves, rank > 10 AND prot AND i_come <= least(n_free, n_come{cap}) AS enters FROM n)"""
    if resort:
        return f"{head} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY total + CASE WHEN enters THEN {boost}::DOUBLE ELSE 0 END DESC, file)::INTEGER AS rank, file, round(total + CASE WHEN enters THEN {boost}::DOUBLE ELSE 0 END, 6) AS total FROM m WHERE (rank <= 10 AND NOT leaves) OR enters"
    return f"""{head}, slots AS (SELECT query_id, rank AS slot, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM m WHERE leaves)
SELECT query_id, rank, file, round(total, 6) AS total FROM m WHERE rank <= 10 AND NOT leaves UNION ALL
SELECT m.query_id, slot, file, round(total + {boost}::DOUBLE, 6) FROM m JOIN slots s ON s.query_id = m.query_id AND s.i = m.i_come WHERE enters"""


WORDS = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
PLAIN = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', ' ', 'g')"
CODE = f"""code AS (
  SELECT {FILE} AS file, 'import org.app.' || coalesce(source, 'none') || ';' || chr(10) || regexp_replace(replace({PLAIN}, ', ', '( '), '\\. ([A-Z][a-z]+)', '.' || chr(10) || 'new \\1( ', 'g') AS text,
         list_filter(regexp_extract_all({PLAIN}, '[A-Za-z]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{{6,}}$')) AS w FROM documents),
firsts AS (SELECT file, x AS name, min(i) AS i FROM (SELECT file, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM code) GROUP BY file, x),
declared AS (SELECT file, name FROM firsts QUALIFY row_number() OVER (PARTITION BY file ORDER BY i) <= 3)"""


def tests(context: int, numbered: bool) -> str:
    line = "i || ': ' || l[i]" if numbered else "l[i]"
    return f"""{BASE}, {CODE},
classes AS (SELECT query_id, 'org.app.D' || string_split(file, '/')[-1] AS class, file FROM bm WHERE rank <= 3),
methods AS (SELECT DISTINCT query_id, unnest(list_filter(toks, lambda t: len(t) >= 8)) AS method FROM asked),
src AS (SELECT file, {lines('text')} AS l, text, regexp_extract_all(text, '(?m)^\\s*import\\s+((?:[A-Za-z_][A-Za-z0-9_]*[.])+[A-Za-z_][A-Za-z0-9_]*);', 1) AS imports,
  (['src/test/java/org/app', 'lib/test', 'main'])[right(file, 1)::INTEGER % 3 + 1] || '/D' || string_split(file, '/')[-1] || '.java' AS path FROM code),
hits AS (SELECT query_id, class, file, method, contains(text, method) AS occurs, l, list_filter(range(1, len(l) + 1), lambda i: contains(l[i], method) AND regexp_matches(l[i], '[A-Za-z0-9_>\\]]\\s+\\w+\\s*\\('))[1] AS spot
  FROM classes JOIN methods USING (query_id) JOIN src USING (file)),
cut AS (SELECT query_id, class, method, occurs, CASE WHEN spot IS NULL THEN '' ELSE array_to_string(list_transform(range(greatest(spot - {context // 3}, 1), least(spot + {context}, len(l) + 1)), lambda i: {line}), chr(10)) END AS cutout FROM hits)"""


def pooled(hints: str) -> str:
    """A pool of ten with direct reasons, and found (query_id, file, total, reason): what the hints bring in."""
    return f"""{BASE}, {HINTED}, {CODE},
every AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS rank FROM (
  SELECT query_id, file, score FROM bm_score UNION ALL SELECT query_id, file, 0 FROM asked CROSS JOIN (FROM docs ORDER BY file LIMIT 50) d WHERE NOT EXISTS (FROM bm_score s WHERE s.query_id = asked.query_id AND s.file = d.file))),
allr AS (SELECT e.query_id, e.file, e.score AS total, e.rank, CASE WHEN h.file IS NULL THEN '' ELSE 'direct_class_hint:' END AS reasons, h.file IS NOT NULL AS prot FROM every e LEFT JOIN holds h USING (query_id, file)),
pool AS (SELECT * FROM allr WHERE rank <= 10), {hints},
come AS (SELECT f.query_id, f.file, coalesce(a.total, 0) + boost AS total, concat_ws('|', nullif(a.reasons, ''), reason) AS reasons, row_number() OVER (PARTITION BY f.query_id ORDER BY coalesce(a.total, 0) + boost DESC, f.file) AS i
  FROM found f LEFT JOIN allr a USING (query_id, file) WHERE coalesce(a.rank, 11) > 10),
leave AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS i FROM pool WHERE NOT prot)"""


MENTIONED = f"""named AS (SELECT DISTINCT file, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_]{{2,}})', 1)) AS name FROM code),
mentioned AS (SELECT file, name FROM named n WHERE name IN (SELECT name FROM declared) AND NOT EXISTS (FROM declared d WHERE d.file = n.file AND d.name = n.name)),
hints AS (SELECT DISTINCT query_id, name FROM pool JOIN mentioned USING (file) WHERE rank <= 4),
met AS (SELECT query_id, file, list(DISTINCT name ORDER BY name) AS names FROM hints JOIN declared USING (name) GROUP BY query_id, file),
found AS (SELECT query_id, file, 260.0::DOUBLE AS boost, 'reference_class_hint:' || array_to_string(names[1:4], ',') AS reason FROM met)"""
CHAINED = f"""built AS (SELECT DISTINCT file, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])new\\s+([A-Z][A-Za-z0-9_]*)\\s*\\(', 1)) AS name FROM code WHERE file IN (SELECT file FROM declared WHERE name LIKE '%ing')),
mentioned AS (SELECT file, name FROM built n WHERE name IN (SELECT name FROM declared) AND NOT EXISTS (FROM declared d WHERE d.file = n.file AND d.name = n.name)),
terms AS (SELECT query_id, list_filter(list_distinct(toks), lambda t: len(t) >= 4) AS terms FROM asked),
hints AS (SELECT query_id, name, list(DISTINCT string_split(file, '/')[-1] ORDER BY string_split(file, '/')[-1]) AS origins,
    700.0::DOUBLE + max(CASE WHEN lower(name) IN ('being', 'nothing') AND list_has_any(terms, ['that', 'with']) THEN 160.0::DOUBLE ELSE 0 END) AS boost
  FROM pool JOIN mentioned USING (file) JOIN terms USING (query_id) WHERE len(terms) > 0 AND (list_contains(terms, lower(name)) OR lower(name) IN ('pass', 'peephole')) GROUP BY query_id, name),
met AS (SELECT query_id, d.file, list('pass_chain_hint:' || array_to_string(origins[1:3], ',') || '->' || name ORDER BY name) AS told, max(boost) AS boost FROM hints JOIN declared d USING (name) GROUP BY query_id, d.file),
found AS (SELECT query_id, file, boost, array_to_string(told[1:4], '|') AS reason FROM met)"""
SNIPPETS = f"""{BASE},
asks AS (SELECT query_id, query, {tokens("query")} AS toks FROM (SELECT query_id, text || (['', ' ComparisonFailure expected 1', ' a Button loading', ' -0'])[query_id % 4 + 1] AS query FROM asked)),
t AS (SELECT query_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM asks), u AS (SELECT query_id, t, min(i) AS i FROM t WHERE len(t) >= 3 AND t NOT IN ({STOPS}) GROUP BY query_id, t),
k AS (SELECT query_id, list(t ORDER BY i) AS lead_ FROM (FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 40) GROUP BY query_id),
q AS (SELECT a.query_id, CASE WHEN regexp_matches(query, '(?:^|[^A-Za-z0-9])-0') OR (regexp_matches(query, '\\d') AND (
    ((list_contains(s, 'codeprinter') OR (list_contains(s, 'code') AND list_contains(s, 'printer'))) AND list_has_any(s, ['expected', 'numeric', 'number', 'keys'])) OR (contains(lower(query), 'comparisonfailure') AND list_contains(s, 'expected'))))
    THEN list_concat(s, {WORDS(NUMERIC_OUTPUT_TERMS)}) ELSE s END AS terms FROM asks a, LATERAL (SELECT coalesce((SELECT lead_ FROM k WHERE k.query_id = a.query_id), []) AS s)),
d AS (SELECT file, {lines("replace(replace(text, '. ', '.' || chr(10)), ' the ', ' the (')")} AS l FROM docs WHERE file IN (SELECT file FROM bm WHERE rank <= 10)),
n AS (SELECT file, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) AS spot FROM d), o AS (SELECT *, list_distinct({tokens('line')}) AS own, regexp_matches({strip('line')}, '^(\\*|/\\*|//)') OR {strip('line')} = '' AS comment FROM n),
m AS (SELECT query_id, file, n, spot, line, own, terms, comment, list_intersect(own, list_distinct(terms)) AS hit FROM bm JOIN q USING (query_id) JOIN o USING (file) WHERE rank <= 10),
s AS (SELECT *, len(hit) + 3.0::DOUBLE * len(list_intersect(hit, {WORDS(HIGH_SIGNAL_TERMS)})) + CASE WHEN list_has_any(terms, {WORDS(GETTER_TERMS)}) THEN 6.0 * len(list_intersect(own, {WORDS(GETTER_TERMS)})) ELSE 0 END
    + CASE WHEN list_contains(terms, 'button') AND regexp_matches(line, '<\\s*[bB]utton\\b') THEN 14 ELSE 0 END
    + CASE WHEN list_has_any(terms, ['loading', 'isloading', 'ispending', 'issubmitting']) AND regexp_matches(line, '\\bis(?:Loading|Pending|Submitting)\\b') THEN 6 ELSE 0 END
    + CASE WHEN list_has_any(terms, ['currency', 'usd', 'eur', 'euro']) AND regexp_matches(line, '\\bcurrency\\s*:|\\b(?:USD|EUR)\\b') THEN 10 ELSE 0 END
    + CASE WHEN list_contains(terms, 'confirm') AND regexp_matches(lower(line), 'confirm|continue|create invoice|yes, i confirm') THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(line, '\\b(?:class|interface|enum|record)\\s+[A-Za-z_][A-Za-z0-9_]*') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(line, '[A-Za-z_][A-Za-z0-9_]*\\s*\\(') THEN 0.5::DOUBLE ELSE 0 END AS score,
    CASE WHEN list_has_any(terms, {WORDS(WIDEST_CONTEXT_TERMS)}) THEN 8 WHEN list_has_any(terms, {WORDS(WIDE_CONTEXT_TERMS)}) THEN 4 ELSE 1 END AS wide
  FROM m WHERE len(hit) > 0 AND NOT (comment AND NOT list_has_any(hit, {WORDS(HIGH_SIGNAL_TERMS)}))),
r AS (SELECT query_id, file, n, spot, wide, row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, spot) AS nth FROM s),
e AS (SELECT query_id, file, n, nth, step, spot + CASE WHEN step <= wide THEN step ELSE wide - step END AS spot FROM (SELECT *, unnest(range(0, 2 * wide + 1)) AS step FROM r)),
f AS (SELECT query_id, file, spot, min((nth, step)) AS first FROM e WHERE spot BETWEEN 1 AND n GROUP BY query_id, file, spot),
c AS (SELECT query_id, file, f.spot, line, lag(f.spot) OVER (PARTITION BY query_id, file ORDER BY f.spot) AS before FROM (FROM f QUALIFY row_number() OVER (PARTITION BY query_id, file ORDER BY first) <= 12) f JOIN n USING (file, spot)),
x AS (SELECT query_id, file, string_agg(CASE WHEN spot > before + 1 THEN '...' || chr(10) ELSE '' END || spot || ': ' || line, chr(10) ORDER BY spot) AS found FROM c GROUP BY query_id, file)
SELECT query_id, b.file, CASE WHEN b.rank % 4 = 0 AND len(l) > 0 THEN array_to_string(list_transform(range(1, least(len(l), 7) + 1), lambda i: i || ': ' || l[i]), chr(10)) ELSE coalesce(found, array_to_string(l[1:12], chr(10))) END AS snippet
FROM bm b JOIN d USING (file) LEFT JOIN x USING (query_id, file) WHERE b.rank <= 10"""


SIGNALS = f"""{BASE}, {HINTED},
top AS (SELECT query_id, list({{'rank': rank, 'name': right(file, 1), 'direct': direct}} ORDER BY rank) FILTER (WHERE rank <= 35) AS files, max(right(file, 1)) FILTER (WHERE rank = 1) AS top1, coalesce(bool_or(direct) FILTER (WHERE rank = 1), false) AS top1_direct FROM hinted GROUP BY query_id),
sig AS (SELECT c.*, files, top1, top1_direct, a.toks AS terms FROM chosen c JOIN top USING (query_id) JOIN asked a USING (query_id) WHERE len(reasons) > 0),
pat AS (SELECT *, list_filter([
  CASE WHEN list_has_any(terms, ['the', 'der', 'les', 'el']) AND len(list_filter(files, lambda f: f.rank <= 3 AND f.name IN ('3', '4'))) > 0 AND coalesce(score_ratio >= 1.05, true) THEN 'pattern:words_and_files' END,
  CASE WHEN len(list_filter(files, lambda f: f.direct AND f.rank BETWEEN 3 AND 20 AND f.name NOT IN ('0', '1', '2'))) > 0 AND top1 IN ('0', '1', '2', '5', '6', '7', '8', '9') AND coalesce(score_ratio <= 1.5, true) THEN 'pattern:deep_direct' END,
  CASE WHEN coalesce(first_direct_rank >= 2, false) OR n_direct >= 9 THEN 'pattern:type_cycle' END], lambda x: x IS NOT NULL) AS patterns FROM sig)"""


def unpivoted(part: str, rows: str, name: str | None) -> str:
    """A row for each number of ``rows``, named by the column ``name``."""
    numbers = f"COLUMNS(* EXCLUDE ({name}))" if name else "COLUMNS(*)"
    held = f"SELECT {name + ', ' if name else ''}{numbers}::DOUBLE FROM ({rows})"
    return f"SELECT '{part}' AS part, {name or repr('')} AS row, metric, value FROM ({held}) UNPIVOT INCLUDE NULLS (value FOR metric IN ({numbers}))"


ORACLE_SQL: dict[str, str] = {
    "T01_tokenize": f"SELECT {FILE} AS file, len({tokens(JOINED)}) AS n_tokens, md5(array_to_string({tokens(JOINED)}, ' ')) AS tokens_md5 FROM documents",
    "T02_split_camel": f"SELECT {FILE} AS file, len({CAMEL}) AS n_parts, md5(array_to_string({CAMEL}, ' ')) AS parts_md5 FROM documents",
    "T03_runtime_context": f"WITH {TRACE} SELECT conv_id, turn, array_to_string(list_filter(list_transform({lines('trace')}, lambda x: {strip('x')}), lambda x: x <> '' AND NOT (starts_with(x, 'at ') AND (starts_with({strip('substr(x, 4)')}, 'java.') OR starts_with({strip('substr(x, 4)')}, 'junit.framework.')))), chr(10)) AS context FROM traces",
    "T05_focused_trace": f"WITH {TRACE} SELECT conv_id, coalesce(string_agg(array_to_string({lines('trace')}, chr(10)), chr(10) ORDER BY turn) FILTER (WHERE starts_with(trace, '--- turn::user' || chr(10))), string_agg(trace, chr(10) ORDER BY turn)) AS trace FROM traces GROUP BY conv_id",
    "T06_triggering_classes": "WITH firsts AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role), every AS (SELECT * FROM firsts UNION ALL SELECT conv_id, 'user', 9999999 FROM conversations GROUP BY conv_id HAVING bool_and(role <> 'user')) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS classes FROM every GROUP BY conv_id",
    "T07_stack_frames": "SELECT conv_id, turn, 1::BIGINT AS n_frames, 'org.app.' || role || '.Say' AS first_class FROM conversations",
    "T08_names": f"SELECT p_partkey, n AS simple, CASE WHEN n LIKE '%_Test' THEN left(n, len(n) - 4) WHEN n LIKE '%_Tests' THEN left(n, len(n) - 5) WHEN n LIKE '%_TestCase' THEN left(n, len(n) - 8) END AS stripped, CASE WHEN n LIKE '%_Test' THEN left(n, len(n) - 4) WHEN n LIKE '%_Tests' THEN left(n, len(n) - 5) WHEN n LIKE '%_TestCase' THEN left(n, len(n) - 8) WHEN n LIKE 'Test_%' THEN substr(n, 5) END AS hint FROM (SELECT p_partkey, {NAME} AS n FROM part)",
    "T09_class_terms": f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat([lower(n)], list_transform(string_split(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda p: lower(p))))), ' ') AS terms FROM (SELECT p_partkey, regexp_replace({PASCAL}, '[^A-Za-z]', '', 'g') AS n FROM part)",
    "T11_relevant_terms": f"WITH {DOCS}, t AS (SELECT file, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM docs), f AS (SELECT file, t, min(i) AS i FROM t WHERE len(t) >= 3 AND t NOT IN ({STOPS}) GROUP BY file, t), k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) AS k FROM f) SELECT d.file, coalesce(string_agg(t, ' ' ORDER BY i) FILTER (WHERE k <= 40), '') AS terms FROM docs d LEFT JOIN k ON k.file = d.file GROUP BY d.file",
    "T12_comment_lines": f"WITH l AS (SELECT {FILE} AS file, unnest({lines("coalesce(text, '')")}) AS line FROM documents) SELECT file, count(*) AS n_lines, count(*) FILTER (WHERE {strip('line')} = '' OR regexp_matches({strip('line')}, '^(\\*|/\\*|//)')) AS n_comment FROM l GROUP BY file",
    "T13_truncate": f"SELECT {FILE} AS file, CASE WHEN length(coalesce(text, '')) > 220 THEN regexp_replace(left(text, 205), '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+$', '') || ' ...[truncated]' ELSE coalesce(text, '') END AS text FROM documents",
    "T14_json_object": "SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN json_extract_string(props, '$.k') END AS k FROM events",
    "T15_whole_number": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) END AS n FROM events",
    "T16_base_name": "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages",
    "T17_json_keys": "SELECT event_id, array_to_string(list_sort(list_concat(['outer'], json_keys(props))), ',') AS keys FROM events",
    "S05_skipped": "SELECT page_id, page_id % 8 <> 0 AS skipped FROM pages",
    "S06_class_names": f"SELECT {FILE} AS file, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(coalesce(text, ''), '\\b(of|de|der|que) ', 'class ', 'g'), '(?:^|[^\\pL\\pN_])(?:class|interface|enum|record)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1))), ',') AS classes FROM documents",
    "S08_package_name": f"SELECT p_partkey, {PACKAGE} AS package FROM part",
    "S09_document_text": f"SELECT doc_id, md5(concat_ws(chr(10), {FILE}, source, lang, coalesce(text, ''))) AS text_md5 FROM documents",
    "S11_lookup": "SELECT w.doc_id, d.source, d.lang, d.doc_id IS NOT NULL AS found FROM (SELECT DISTINCT user_id * 7 AS doc_id FROM events) w LEFT JOIN documents d ON d.doc_id = w.doc_id",
    "S21_manifest": f"WITH m AS (SELECT doc_id AS i, 'bugs' AS kind, doc_id AS p FROM documents UNION ALL SELECT doc_id, 'method:' || lang, unnest([doc_id + 1, doc_id * 3]) FROM documents UNION ALL SELECT doc_id, 'selection', doc_id * 2 FROM documents WHERE n_chars > 500) SELECT 'doc/' || lpad(i::VARCHAR, 9, '0') AS dataset, kind, 'doc/' || lpad(p::VARCHAR, 9, '0') AS path, p IN (SELECT doc_id FROM documents) AS exists FROM m",
    "S12_id_ranges": "SELECT l_orderkey, l_linenumber, unnest([l_linenumber, l_linenumber + 2, l_linenumber + 3, l_linenumber + 4])::BIGINT AS id FROM lineitem",
    "S13_selected_ids": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "S14_class_file": f"SELECT p_partkey, 'src/' || replace({PACKAGE}, '.', '/') || '/Main.java' AS file FROM part",
    "S15_export_lines": f"SELECT conv_id, turn, array_to_string(list_filter(list_transform(list_concat({lines("coalesce(text, '')")}, [role]), lambda x: {strip('x')}), lambda x: x <> ''), '|') AS lines FROM conversations",
    "S17_repeated_keys": "SELECT doc_id, count(*) + count(*) FILTER (WHERE toxic = 1) AS n FROM labels GROUP BY doc_id HAVING n > 1",
    "S20_markdown_rows": "SELECT '| ' || c_mktsegment || ' | ' || count(*) || ' | ' || printf('%.4f', round(avg(c_acctbal), 6)) || ' | NA |' AS row FROM customer GROUP BY c_mktsegment",
    "S22_checksums": "SELECT source, sha256(string_agg(doc_id || chr(0) || sha256(coalesce(text, '')), chr(0) ORDER BY doc_id)) AS sha256 FROM documents GROUP BY source",
    "R01_index": f"WITH {DOCS} SELECT t AS term, count(DISTINCT file) AS df, count(*) AS cf FROM (SELECT file, unnest(toks) AS t FROM docs) GROUP BY t",
    "R01_lengths": f"WITH {DOCS} SELECT file, len(toks) AS dl FROM docs",
    "R02_rank": f"{BASE} SELECT query_id, rank, file, score FROM bm WHERE rank <= 10",
    "R03_build_query": "SELECT doc_id, concat_ws(chr(10), cast(doc_id AS VARCHAR), source, nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, '')) AS query FROM documents",
    "R04_scores": f"{BASE} SELECT query_id, file, score FROM bm_score",
    "R09_identifier_terms": f"WITH {ASKED}, t AS (SELECT query_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM asked), f AS (SELECT query_id, t, min(i) AS i FROM t WHERE len(t) >= 4 GROUP BY query_id, t) SELECT a.query_id, coalesce(string_agg(t, ' ' ORDER BY i), '') AS terms FROM asked a LEFT JOIN f ON f.query_id = a.query_id GROUP BY a.query_id",
    "R10_R11_boosts": f"{BOOSTED} SELECT query_id, file, 90.0::DOUBLE * len(hits) AS direct_boost, least(32.0, 4.0 * len(both_))::DOUBLE AS identifier_boost, array_to_string(list_transform(hits, lambda h: 'direct_class_hint:' || h), '|') AS reasons, CASE WHEN len(both_) > 0 THEN 'identifier_overlap:' || array_to_string(both_, ',') END AS reason FROM boosted",
    "R07_test_contexts": f"""{tests(9, False)},
w AS (SELECT query_id, class, bool_or(occurs) AS occurs, list(cutout ORDER BY method) FILTER (WHERE cutout <> '') AS parts FROM cut GROUP BY query_id, class),
told AS (SELECT query_id, class, array_to_string(list_filter(list_concat([array_to_string(imports, chr(10))], coalesce(parts, []), CASE WHEN coalesce(occurs, false) THEN [] ELSE [array_to_string(l[1:5], chr(10))] END), lambda p: p <> ''), chr(10)) AS told
  FROM classes JOIN src USING (file) LEFT JOIN w USING (query_id, class))
SELECT query_id, string_agg(told, chr(10) ORDER BY class) AS context FROM told GROUP BY query_id""",
    "E03_shown_contexts": f"""{tests(44, True)},
w AS (SELECT query_id, class, string_agg('method: ' || method || chr(10) || cutout, chr(10) || chr(10) ORDER BY method) AS parts FROM cut WHERE cutout <> '' GROUP BY query_id, class),
told AS (SELECT query_id, class, concat_ws(chr(10), 'file: ' || path, 'class: ' || class, CASE WHEN len(imports) > 0 THEN 'imports:' || chr(10) || array_to_string(imports[1:30], chr(10)) END, 'snippets:' || chr(10) || parts) AS told
  FROM classes JOIN src USING (file) LEFT JOIN w USING (query_id, class)),
a AS (SELECT query_id, string_agg(told, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY class) AS a FROM told GROUP BY query_id)
SELECT query_id, CASE WHEN length(a) <= 2000 THEN a ELSE left(a, 2000) || chr(10) || '...[truncated]' END AS context FROM a""",
    "R13_hybrid_rank": f"""{tests(9, False)},
w AS (SELECT query_id, class, bool_or(occurs) AS occurs, list(cutout ORDER BY method) FILTER (WHERE cutout <> '') AS parts FROM cut GROUP BY query_id, class),
told AS (SELECT query_id, class, array_to_string(list_filter(list_concat([array_to_string(imports, chr(10))], coalesce(parts, []), CASE WHEN coalesce(occurs, false) THEN [] ELSE [array_to_string(l[1:5], chr(10))] END), lambda p: p <> ''), chr(10)) AS told
  FROM classes JOIN src USING (file) LEFT JOIN w USING (query_id, class)),
around AS (SELECT query_id, {tokens('c')} AS toks FROM (SELECT query_id, string_agg(told, chr(10) ORDER BY class) AS c FROM told GROUP BY query_id)), {ranked('cx', 0.75, 50, 'around')},
{BOOSTED[len(BASE) + 2:]},
z AS (SELECT query_id, file, coalesce(b.score, 0) + 0.55::DOUBLE * coalesce(c.score, 0) + coalesce(90.0::DOUBLE * len(hits) + least(32.0, 4.0 * len(both_))::DOUBLE, 0) AS total, round(0.55::DOUBLE * coalesce(c.score, 0), 6) AS context FROM boosted b FULL JOIN cx_score c USING (query_id, file)),
r AS (SELECT query_id, file, context, round(total, 6) AS total, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, file)::INTEGER AS rank FROM z)
SELECT * FROM r WHERE rank <= 10""",
    "R14_retention": retained("", True, 0.0),
    "R15_reference_retention": f"""{pooled(MENTIONED)},
m AS (SELECT a.query_id, least(coalesce(n, 0), coalesce(c, 0)) AS m FROM (SELECT DISTINCT query_id FROM pool) a LEFT JOIN (SELECT query_id, count(*) AS n FROM leave GROUP BY query_id) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS c FROM come GROUP BY query_id) USING (query_id)),
kept AS (SELECT query_id, file, total, reasons FROM pool p WHERE NOT EXISTS (FROM leave l JOIN m ON m.query_id = l.query_id WHERE l.query_id = p.query_id AND l.rank = p.rank AND l.i <= m) UNION ALL SELECT query_id, file, total, reasons FROM come JOIN m USING (query_id) WHERE i <= m)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, file)::INTEGER AS rank, file, round(total, 6) AS total, reasons FROM kept""",
    "R16_slot_retention": f"""{pooled(CHAINED)},
m AS (SELECT a.query_id, least(coalesce(n, 0), coalesce(c, 0), 2) AS m FROM (SELECT DISTINCT query_id FROM pool) a LEFT JOIN (SELECT query_id, count(*) AS n FROM leave GROUP BY query_id) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS c FROM come GROUP BY query_id) USING (query_id)),
slots AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM leave JOIN m USING (query_id) WHERE i <= m)
SELECT query_id, rank::INTEGER AS rank, file, round(total, 6) AS total, reasons FROM pool p WHERE NOT EXISTS (FROM slots s WHERE s.query_id = p.query_id AND s.rank = p.rank)
UNION ALL SELECT query_id, s.rank::INTEGER, file, round(total, 6), reasons FROM come c JOIN slots s USING (query_id, i)""",
    "E02_snippets": SNIPPETS,
    "R17_predictions": f"{BASE} SELECT query_id, string_agg(file, ',' ORDER BY rank) AS ranked_files FROM bm WHERE rank <= 10 GROUP BY query_id",
    "E12_prompts": f"""{BASE}, pool AS (SELECT query_id, list(file ORDER BY rank) AS files FROM bm WHERE rank <= 10 GROUP BY query_id)
        SELECT query_id, CAST(to_json({{'query': coalesce(text, ''), 'candidates': files, 'top_output': 10}}) AS VARCHAR) AS prompt FROM pool JOIN benchmark ON item_id = query_id""",
    "L10_select": f"{BASE}, {HINTED} SELECT query_id, top1_file, top2_file, score_ratio, first_direct_rank, n_direct, array_to_string(reasons, ',') AS reasons FROM chosen WHERE len(reasons) > 0",
    "L11_selection_summary": f"{BASE}, {HINTED}, r AS (SELECT unnest(list_append(reasons, '*')) AS reason FROM chosen WHERE len(reasons) > 0) SELECT reason, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM asked), 9) AS fraction FROM r GROUP BY reason",
    "E08_search": f"""{BASE}, q AS (SELECT query_id, list_filter(list_distinct(toks), lambda t: len(t) >= 3) AS terms FROM asked),
s AS (SELECT file, {tokens("concat_ws('/', source, lang)")} AS p, {tokens("left(text, 20000)")} AS t, text FROM docs),
l AS (SELECT file, {tokens(strip('line'))} AS own FROM (SELECT file, unnest({lines('text')}) AS line FROM docs) WHERE NOT ({strip('line')} = '' OR regexp_matches({strip('line')}, '^(\\*|/\\*|//)'))),
h AS (SELECT query_id, file, least(4, count(*) FILTER (WHERE list_has_any(own, terms))) AS hits FROM bm JOIN q USING (query_id) JOIN l USING (file) WHERE rank <= 20 GROUP BY query_id, file),
x AS (SELECT query_id, file, 8.0::DOUBLE * len(list_intersect(terms, p)) + len(list_intersect(terms, t)) AS base, coalesce(hits, 0) AS hits FROM bm JOIN q USING (query_id) JOIN s USING (file) LEFT JOIN h USING (query_id, file) WHERE rank <= 20),
r AS (SELECT query_id, file, round(base + 2.0 * hits, 3) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(base + 2.0 * hits, 3) DESC, file)::INTEGER AS rank FROM x WHERE base > 0)
SELECT * FROM r WHERE rank <= 10""",
    "E09_line_hits": f"""{BASE}, q AS (SELECT query_id, list_filter(list_distinct(toks), lambda t: len(t) >= 3) AS terms FROM asked),
l AS (SELECT file, i AS line, {strip('line')} AS raw FROM (SELECT file, unnest({lines('text')}) AS line, generate_subscripts({lines('text')}, 1) AS i FROM docs)),
m AS (SELECT query_id, file, line, raw, len(list_intersect(list_distinct({tokens('raw')}), terms)) AS n_terms FROM bm JOIN q USING (query_id) JOIN l USING (file) WHERE rank <= 10 AND NOT (raw = '' OR regexp_matches(raw, '^(\\*|/\\*|//)'))),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY line) AS k FROM m WHERE n_terms > 0)
SELECT query_id, file, line::INTEGER AS line, CASE WHEN length(raw) > 220 THEN regexp_replace(left(raw, 205), '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+$', '') || ' ...[truncated]' ELSE raw END AS text, n_terms::INTEGER AS n_terms FROM k WHERE k <= 4""",
    "E13_complete": f"WITH {OUTPUT}, v AS (SELECT o.query_id, o.file, min(position) AS spot FROM output o JOIN pool p ON p.query_id = o.query_id AND p.file = o.file GROUP BY o.query_id, o.file), u AS (SELECT query_id, file, 0 AS late, spot FROM v UNION ALL SELECT p.query_id, p.file, 1, p.place FROM pool p WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.query_id = p.query_id AND v.file = p.file)), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY late, spot, file)::INTEGER AS rank, file, CASE WHEN late = 0 THEN 'llm' ELSE 'fallback' END AS source FROM u) SELECT * FROM r WHERE rank <= 4",
    "E13_counters": f"{counters(2)} SELECT * FROM whole",
    "V01_merge": f"{BOTH}, {HINTED} SELECT query_id, rank, file, 'rerank' AS origin FROM flat WHERE rank <= 10 AND query_id IN (SELECT query_id FROM low) UNION ALL SELECT query_id, rank, file, 'baseline' FROM bm WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM low)",
    "V02_evaluate_predictions": f"{BOTH}, {per('p', 'bm', 50)} SELECT count(*) AS bugs, {', '.join(f'round(avg({HIT(k)}::INTEGER), 9) AS top_{k}_accuracy' for k in (1, 3, 5))}, round(avg(rr), 9) AS mrr FROM p",
    "V03_correct_ranks": f"{BOTH}, {per('p', 'bm', 50)} SELECT query_id, correct_rank, round(rr, 9) AS rr FROM p",
    "V03_coverage": "SELECT item_id AS query_id, 'missing' AS problem FROM (SELECT item_id FROM benchmark EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT item_id FROM benchmark)",
    "V04_V05_distributions": f"{BOTH}, {per('p', 'bm', 10)}, {per('f', 'flat', 10)}, u AS (SELECT 'bm25' AS method, * FROM p UNION ALL SELECT 'flat', * FROM f) {summary('method')} FROM u GROUP BY method",
    "V06_mcnemar": f"WITH x AS (SELECT l_suppkey AS pair, count(*) FILTER (WHERE l_quantity > 45) AS b, count(*) FILTER (WHERE l_discount < 0.01) AS c FROM lineitem GROUP BY l_suppkey) SELECT pair, b, c, round({mcnemar('b', 'c')}, 9) AS p FROM x",
    "V07_wilcoxon": f"{BOTH}, {per('p', 'bm', 10)}, {per('f', 'flat', 10)}, d AS (SELECT f.rr - p.rr AS delta FROM p JOIN f USING (query_id)), z AS (SELECT delta, round(abs(delta), 12) AS s FROM d WHERE delta <> 0), r AS (SELECT delta, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM z), w AS (SELECT count(*) AS n, coalesce(sum(rk) FILTER (WHERE delta > 0), 0)::DOUBLE AS w_plus, coalesce(sum(rk) FILTER (WHERE delta < 0), 0)::DOUBLE AS w_minus FROM r) SELECT n, w_plus, w_minus, CASE WHEN n > 0 THEN round((least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE), 9) END AS z FROM w",
    "V08_paired": f"{BOTH}, {per('p', 'bm', 10)}, {per('f', 'flat', 10)}, d AS (SELECT p.correct_rank AS r0, f.correct_rank AS r1, f.rr - p.rr AS delta FROM p JOIN f USING (query_id)), a AS (SELECT count(*) AS n, round(avg(delta), 9) AS mean_delta, round(quantile_cont(delta, 0.5), 9) AS median_delta, count(*) FILTER (WHERE delta > 0) AS improved, count(*) FILTER (WHERE delta < 0) AS degraded, count(*) FILTER (WHERE delta = 0) AS unchanged, {', '.join(f'count(*) FILTER (WHERE NOT {HIT(k, chr(114) + chr(48))} AND {HIT(k, chr(114) + chr(49))}) AS gained_{k}, count(*) FILTER (WHERE {HIT(k, chr(114) + chr(48))} AND NOT {HIT(k, chr(114) + chr(49))}) AS lost_{k}' for k in (1, 3, 5, 10))} FROM d) SELECT *, {', '.join(f'round({mcnemar(f"gained_{k}", f"lost_{k}")}, 9) AS mcnemar_p_{k}' for k in (1, 3, 5, 10))} FROM a",
    "V09_subsets": f"{BOTH}, {HINTED}, {per('p', 'bm', 10)}, u AS (SELECT p.*, CASE WHEN query_id IN (SELECT query_id FROM low) THEN 'selected' ELSE 'unselected' END AS subset FROM p) {summary('subset')} FROM u GROUP BY subset",
    "V09_false_negatives": f"{BOTH}, {HINTED}, {per('p', 'bm', 10)} SELECT query_id, correct_rank FROM p WHERE query_id NOT IN (SELECT query_id FROM low) AND (correct_rank IS NULL OR correct_rank > 10)",
    "V10_recall": f"{BOTH}, {per('p', 'bm', 50)} SELECT k, count(*) AS n, CASE WHEN k <= 50 THEN count(*) FILTER (WHERE correct_rank <= k) END AS hits, CASE WHEN k <= 50 THEN round(count(*) FILTER (WHERE correct_rank <= k)::DOUBLE / count(*), 9) END AS recall FROM p, (VALUES (10), (20), (50), (100)) v(k) GROUP BY k",
    "V12_usage": f"SELECT {USAGE}",
    "A01_usage_by_setting": f"SELECT event_type, coalesce(sum(tokens // 2), 0)::BIGINT AS total_prompt_tokens, coalesce(sum(tokens - tokens // 2), 0)::BIGINT AS total_completion_tokens, count(*) FILTER (WHERE seconds > 50) AS invalid_count, {USAGE} GROUP BY event_type",
    "A02_cost_table": "WITH r AS (SELECT o_orderpriority AS dataset, CASE o_orderstatus WHEN 'F' THEN 'r' WHEN 'O' THEN 'f' ELSE 's' END AS s, round(avg(1.0::DOUBLE / (1 + o_orderkey % 10)), 9) AS mrr, count(*) AS calls, sum(floor(o_totalprice)::BIGINT) AS tokens FROM orders GROUP BY 1, 2), w AS (SELECT dataset, max(mrr) FILTER (WHERE s = 'r') AS rm, max(mrr) FILTER (WHERE s = 'f') AS fm, max(mrr) FILTER (WHERE s = 's') AS sm, max(calls) FILTER (WHERE s = 'f') AS fc, max(calls) FILTER (WHERE s = 's') AS sc, max(tokens) FILTER (WHERE s = 'f') AS ft, max(tokens) FILTER (WHERE s = 's') AS st FROM r GROUP BY dataset) SELECT dataset, round(fm - rm, 9) AS full_gain, round(sm - rm, 9) AS selective_gain, round(CASE WHEN fm - rm > 0 THEN (sm - rm) / (fm - rm) END, 9) AS retention, round(1 - sc::DOUBLE / fc, 9) AS call_saving, round(1 - st::DOUBLE / ft, 9) AS token_saving FROM w",
    "A03_transitions": f"{BOTH}, {per('p', 'bm', 10)}, {per('f', 'flat', 10)}, d AS (SELECT coalesce(p.correct_rank, 1073741824) AS a, coalesce(f.correct_rank, 1073741824) AS b FROM p JOIN f USING (query_id)) SELECT count(*) FILTER (WHERE b < a) AS improved, count(*) FILTER (WHERE b > a) AS degraded, count(*) FILTER (WHERE b = a) AS unchanged, count(*) FILTER (WHERE a > 5 AND b <= 5) AS into_5, count(*) FILTER (WHERE a <= 5 AND b > 5) AS out_of_5, count(*) FILTER (WHERE a > 10 AND b <= 10) AS into_10, count(*) FILTER (WHERE a <= 10 AND b > 10) AS out_of_10 FROM d",
    "A04_variance": "WITH r AS (SELECT l_returnflag, l_linenumber, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) AS runs, round(avg(discount), 9) AS discount_mean, round(coalesce(stddev_samp(discount), 0), 9) AS discount_sd, min(discount) AS discount_min, max(discount) AS discount_max, round(avg(tax), 9) AS tax_mean, round(coalesce(stddev_samp(tax), 0), 9) AS tax_sd, min(tax) AS tax_min, max(tax) AS tax_max FROM r GROUP BY l_returnflag",
    "A05_scopes": f"{BOTH}, {HINTED}, {per('p', 'bm', 10)}, {per('f', 'flat', 10)}, u AS (SELECT 'bm25' AS variant, * FROM p UNION ALL SELECT 'flat', * FROM f), s AS (SELECT *, 'all' AS scope FROM u UNION ALL SELECT *, 'selected' FROM u WHERE query_id IN (SELECT query_id FROM low)) SELECT variant, scope, count(*) AS n, round(avg(rr), 9) AS mrr, {', '.join(f'count(*) FILTER (WHERE {HIT(k)}) AS hits_{k}' for k in (1, 3, 5, 10))} FROM s GROUP BY variant, scope",
    "A06_output_validity": f"{counters(4)} SELECT count(*) AS records, sum(returned)::BIGINT AS returned, sum(valid)::BIGINT AS valid, sum(invalid)::BIGINT AS invalid, sum(duplicates)::BIGINT AS duplicates, sum(added)::BIGINT AS added, (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT 'model ' || event_type[1] AS m FROM events)) AS models FROM whole",
    "A08_key_audit": "SELECT event_type, count(*) AS records, count(*) FILTER (WHERE list_contains(json_keys(props), 'k')) AS with_k, count(*) FILTER (WHERE list_contains(json_keys(props), 'missing')) AS with_missing FROM events GROUP BY ROLLUP (event_type)",
    "R06_locate": f"WITH n AS (SELECT {NAME} AS name, p_partkey % 6 AS f FROM part), files AS (SELECT DISTINCT name, (['src/test/java/a', 'lib/Test', 'src/test/a', 'main', 'zoo', 'test/b'])[f + 1] || '/' || name || '.java' AS file, ([0, 3, 1, 4, 4, 3])[f + 1] AS r FROM n) SELECT 'a.' || name AS class, arg_min(file, (r, file)) AS file FROM files GROUP BY name",
    "E05_E07_briefs": f"{BASE}, w AS (SELECT file, source AS package, list_sort(list_distinct(toks)) AS w FROM docs) SELECT query_id, rank, score, file, package, kind, array_to_string(w[1:c], ',') AS classes, array_to_string(w[1:m], ',') AS methods FROM bm JOIN w USING (file), (VALUES ('rerank', 10, 40), ('agent', 8, 20), ('verifier', 10, 35)) k(kind, c, m) WHERE rank <= 15",
    "E10_windows": f"""{BASE}, a AS (SELECT query_id, CASE WHEN rank = 9 THEN 'doc/none' ELSE file END AS file, greatest(1, rank * 3 - 5) AS s, rank * rank - 2 AS e FROM bm WHERE rank <= 10),
l AS (SELECT file, {lines("regexp_replace(text, '[.] ', '.' || chr(10), 'g')")} AS l FROM docs),
b AS (SELECT query_id, a.file, l, len(l) AS n, s, least(greatest(s, e), s + 11) AS e FROM a LEFT JOIN l USING (file)),
c AS (SELECT query_id, file, l, n, CASE WHEN n = 0 THEN 1 ELSE least(s, n) END::INTEGER AS s, CASE WHEN n = 0 THEN 0 ELSE least(e, n) END::INTEGER AS e FROM b)
SELECT query_id, file, l IS NOT NULL AS ok, CASE WHEN l IS NULL THEN 'file is not in the candidate pool' END AS error, CASE WHEN l IS NOT NULL THEN s END AS start_line, CASE WHEN l IS NOT NULL THEN e END AS end_line,
  array_to_string(list_transform(range(s, e + 1), lambda i: i || ': ' || l[i]), chr(10)) AS content FROM c""",
    "E14_dry_run": f"{BASE.replace('rank <= 50', 'rank <= 20')} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS position, file FROM bm",
    "R08_direct_hints": f"WITH n AS (SELECT p_partkey, replace(p_brand, '#', '') AS b, {NAME} AS n FROM part), h AS (SELECT p_partkey, b, CASE WHEN n LIKE '%_Test' THEN left(n, len(n) - 4) WHEN n LIKE '%_Tests' THEN left(n, len(n) - 5) WHEN n LIKE '%_TestCase' THEN left(n, len(n) - 8) WHEN n LIKE 'Test_%' THEN substr(n, 5) ELSE n END AS h FROM n) SELECT p_partkey, array_to_string(list_sort(list_distinct([b, h, b || 'Helper', 'Some'])), ',') AS hints FROM h",
    "R12_type_boost": f"WITH {DOCS}, t AS (SELECT file, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM docs), f AS (SELECT file, t, min(i) AS i FROM t WHERE len(t) >= 3 AND t NOT IN ({STOPS}) GROUP BY file, t), k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) AS k FROM f) SELECT file, CASE right(file, 1) WHEN '1' THEN 130.0::DOUBLE WHEN '2' THEN 55.0::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM docs",
    "L05_strong_candidates": f"{BASE} SELECT query_id, count(*) FILTER (WHERE score - 10 > 0) AS n, count(*) FILTER (WHERE score - 10 >= 5 AND rank <= 25) AS n_strong FROM bm GROUP BY query_id",
    "L06_rule_signals": f"""WITH {DOCS}, {ASKED}, t AS (SELECT query_id AS rule, unnest(toks) AS term, generate_subscripts(toks, 1) AS i FROM asked),
f AS (SELECT rule, term, row_number() OVER (PARTITION BY rule ORDER BY min(i)) - 1 AS k FROM t GROUP BY rule, term), parts AS (SELECT rule, count(DISTINCT k % 3) AS parts FROM f GROUP BY rule),
h AS (SELECT file AS id, rule, k % 3 AS part FROM (SELECT DISTINCT file, unnest(toks) AS term FROM docs) JOIN f USING (term) GROUP BY file, rule, part HAVING count(*) >= 4),
m AS (SELECT id, rule, count(*) AS n FROM h GROUP BY id, rule) SELECT id, rule FROM m JOIN parts USING (rule) WHERE n = parts""",
    "L07_pattern_reasons": f"{SIGNALS} SELECT query_id, array_to_string(patterns, ',') AS patterns FROM pat",
    "L08_L09_kept_reasons": f"""{SIGNALS}, w AS (SELECT *, list_concat(reasons, patterns) AS r FROM pat)
SELECT query_id, array_to_string(list_concat(
  list_filter(r, lambda x: x LIKE 'low_score_ratio<=%' AND NOT top1_direct), list_filter(r, lambda x: x = 'top1_without_direct_hint' AND NOT top1_direct AND coalesce(first_direct_rank >= 3, true)),
  list_filter(r, lambda x: x LIKE 'many_direct_hints>=%' AND n_direct >= 7), list_filter(r, lambda x: x = 'pattern:type_cycle' AND NOT top1_direct)), ',') AS reasons,
  array_to_string(list_concat(list_filter(r, lambda x: x <> 'pattern:type_cycle'), list_filter(r, lambda x: x = 'pattern:type_cycle' AND (NOT top1_direct OR coalesce(score_ratio <= 1.02, true)))), ',') AS tight FROM w""",
    "E04_semantic_terms": f"""{BASE}, {CODE}, c AS (SELECT file, list(name ORDER BY i) AS classes FROM firsts WHERE (file, name) IN (SELECT (file, name) FROM declared) GROUP BY file),
p AS (SELECT query_id, file, a.toks AS q, list_concat(['getThe', 'Nothing'], coalesce(classes, [])) AS names, code.text AS text FROM bm JOIN asked a USING (query_id) JOIN code USING (file) LEFT JOIN c USING (file) WHERE bm.rank <= 5),
w AS (SELECT *, list_concat(CASE WHEN list_has_any(q, ['and', 'die']) THEN ['the', 'of', 'none', 'und'] ELSE [] END, CASE WHEN list_has_any(q, ['the', 'les']) AND list_has_any(q, ['of', 'la']) THEN ['org', 'app', 'les'] ELSE [] END,
  CASE WHEN list_contains(q, 'the') AND right(file, 1) IN ('1', '2', '3') THEN ['import'] ELSE [] END) AS wanted FROM p),
o AS (SELECT *, {tokens("concat_ws(' ', array_to_string(names, ' '), file, left(text, 4000))")} AS own FROM w),
n AS (SELECT query_id, file, unnest(names) AS name, wanted FROM o), m AS (SELECT query_id, file, list_append({tokens('name')}, lower(name)) AS more FROM n WHERE list_has_any({tokens('name')}, wanted)),
t AS (SELECT query_id, file, unnest(list_filter(wanted, lambda x: list_contains(own, x))) AS term FROM o UNION SELECT query_id, file, unnest(more) FROM m)
SELECT query_id, file, string_agg(term, ',' ORDER BY term) AS terms FROM t GROUP BY query_id, file""",
    "S23_run_rows": f"""WITH c AS (SELECT event_type AS run, round(sum(round(value, 2)), 2) AS seconds, count(*) AS n_files, max(ts) AS m FROM events GROUP BY event_type)
SELECT run, seconds, n_files, epoch_us(m::TIMESTAMP) AS finished, epoch_us(m::TIMESTAMP) - round(seconds * 1000000)::BIGINT AS started, false AS missing FROM c""",
    "A07_mini_benchmark": f"""{BOTH}, {per('p', 'bm', 50)}, {per('f', 'flat', 50)}
SELECT a.query_id, CASE WHEN a.query_id % 2 = 0 THEN 'bm25' ELSE 'flat' END AS source, 'category ' || (a.query_id % 3) AS category,
  CASE WHEN a.query_id % 2 = 0 THEN p.correct_rank ELSE f.correct_rank END AS best_rank, CASE WHEN a.query_id % 2 = 0 THEN p.correct_rank ELSE f.correct_rank END IS NOT NULL AS in_first
FROM asked a JOIN p USING (query_id) JOIN f USING (query_id)""",
    "T04_compact_trace": f"""WITH {TRACE}, l AS (SELECT conv_id, turn, unnest({lines('trace')}) AS x, generate_subscripts({lines('trace')}, 1) AS i FROM traces),
b AS (SELECT *, CASE WHEN starts_with({strip('x')}, 'at ') AND x = lag(x) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 0 ELSE i END AS begins FROM l),
r AS (SELECT *, max(begins) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM b),
o AS (SELECT conv_id, turn, run, x, count(*) AS n FROM r GROUP BY conv_id, turn, run, x)
SELECT conv_id, turn, string_agg(array_to_string(list_concat(list_transform(range(least(n, 3)), lambda k: x), CASE WHEN n > 3 THEN [chr(9) || '... repeated identical frame omitted ' || (n - 3) || ' time(s)'] ELSE [] END), chr(10)), chr(10) ORDER BY run) AS trace FROM o GROUP BY conv_id, turn""",
    "T10_method_window": f"""WITH p AS (SELECT page_id, {lines("replace(html, '>', '>' || chr(10))")} AS l FROM pages),
w AS (SELECT page_id, l, list_filter(range(1, len(l) + 1), lambda i: contains(l[i], 'track') AND regexp_matches(l[i], '[A-Za-z0-9_>\\]]\\s+[A-Za-z0-9_]+\\s*\\('))[1] AS spot FROM p)
SELECT page_id, CASE WHEN spot IS NULL THEN '' ELSE array_to_string(list_transform(range(greatest(spot - 2, 1), least(spot + 6, len(l) + 1)), lambda i: l[i]), chr(10)) END AS window FROM w""",
    "S07_method_names": """WITH p AS (SELECT page_id, html, regexp_replace(html, '<p>', chr(10) || 'def f(', 'g') AS py FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(py, '(?m)^[ \\t]*(?:async\\s+)?def\\s+([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1))), ',') AS functions,
  array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?:^|[^\\pL\\pN_])(?:function\\s+|const\\s+|let\\s+|var\\s+|async\\s+function\\s+)([A-Za-z_][A-Za-z0-9_]*)\\s*(?:=|\\()', 1))), ',') AS scripted FROM p""",
    "R05_common_package": f"""WITH p AS (SELECT p_brand, string_split('org.app.core.' || {PACKAGE}, '.') AS w FROM part), m AS (SELECT p_brand, min(w) AS a, max(w) AS b FROM p GROUP BY p_brand)
SELECT p_brand, array_to_string(a[1:coalesce(list_filter(range(1, len(a) + 1), lambda i: a[i] IS DISTINCT FROM b[i])[1], len(a) + 1) - 1], '.') AS package FROM m""",
    "T06_triggering_methods": """WITH m AS (SELECT conv_id, turn::VARCHAR AS m, turn AS o FROM conversations WHERE turn % 3 < 2 UNION ALL SELECT DISTINCT conv_id, '0', 9999999 FROM conversations),
f AS (SELECT conv_id, m, min(o) AS o FROM m GROUP BY conv_id, m) SELECT conv_id, string_agg(m, ',' ORDER BY o) AS methods FROM f GROUP BY conv_id""",
    "L06_stack_terms": f"""WITH n AS (SELECT p_partkey, {NAME} || '$1' AS n, 'run' || replace(p_brand, '#', '') AS m FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat({tokens('n')}, {tokens('m')}))), ',') AS terms FROM n""",
    "L01_direct_candidates": f"{pooled(MENTIONED)} SELECT query_id, rank::INTEGER AS rank, file, reasons FROM allr WHERE prot",
    "R17_records": f"""{BASE} SELECT query_id, 'bm25+reference-hint-include' AS method, '{{"query_id":' || query_id || ',"method":"bm25+reference-hint-include","direct-hint-include":false,"reference-hint-include":true,"ranked_files":[' ||
  string_agg('{{"rank":' || rank || ',"file":"' || file || '","score":' || score || ',"reasons":["rank ' || rank || '"]}}', ',' ORDER BY rank) || ']}}' AS record FROM bm WHERE rank <= 5 GROUP BY query_id""",
    "A03_selector_recall": f"""{BOTH}, {HINTED}, {per('p', 'bm', 50)}, x AS (SELECT k, count(*) FILTER (WHERE correct_rank IS NULL OR correct_rank > k) AS failures, count(*) FILTER (WHERE (correct_rank IS NULL OR correct_rank > k) AND query_id IN (SELECT query_id FROM low)) AS selected
  FROM p, (VALUES (1), (5), (10)) v(k) GROUP BY k) SELECT *, CASE WHEN failures > 0 THEN round(selected::DOUBLE / failures, 9) END AS recall FROM x""",
    "A05_case_ranks": f"""{BOTH}, {per('p', 'bm', 10)}, {per('f', 'flat', 10)}, u AS (SELECT 'bm25' AS variant, * FROM p UNION ALL SELECT 'flat', * FROM f), d AS (SELECT u.query_id, variant, u.correct_rank AS rank, round(u.rr, 9) AS rr, round(p.rr, 9) AS base FROM u JOIN p USING (query_id))
SELECT query_id, variant, rank, rr, round(rr - base, 9) AS delta, CASE WHEN round(rr - base, 9) <> 0 THEN query_id || ':RR ' || printf('%.4f', base) || '->' || printf('%.4f', rr) END AS note FROM d""",
    "S01_S02_json_lines": "SELECT event_id, event_type, props, round(value, 2) AS value FROM events",
    "S02b_append_new": "WITH c AS (SELECT user_id AS key, min(event_id) AS event_id, 'click' AS event_type FROM events WHERE event_type = 'click' GROUP BY user_id), p AS (SELECT user_id AS key, min(event_id) AS event_id, 'purchase' AS event_type FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT key FROM c) GROUP BY user_id) FROM c UNION ALL FROM p",
    "S16_selected_ids": "SELECT DISTINCT event_id::VARCHAR AS query_id FROM events WHERE event_type IN ('purchase', 'refund')",
    "S18_csv": "SELECT doc_id::VARCHAR AS doc_id, regexp_replace(left(coalesce(text, 'NA'), 40), '[\\n\"\\\\]', ',', 'g') AS head, 'NA' AS absent, CASE WHEN doc_id % 5 > 0 THEN source ELSE 'NA' END AS source FROM documents",
    "R02_stream": f"{BASE} SELECT query_id, rank, file, score FROM bm WHERE rank <= 10",
    "E01_stack_snippet": f"WITH d AS (SELECT {FILE} AS file, {lines("replace(coalesce(text, ''), '. ', '.' || chr(10))")} AS l FROM documents), n AS (SELECT file, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM d), w AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) AS k, lag(i) OVER (PARTITION BY file ORDER BY i) AS p FROM n WHERE i IN (1, 2, 3, 6, 7, 8)) SELECT file, string_agg(CASE WHEN i > p + 1 THEN '...' || chr(10) ELSE '' END || i || ': ' || x, chr(10) ORDER BY i) AS snippet FROM w WHERE k <= 5 GROUP BY file",
    "E16_usage_add": "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) + 1 AS k, event_id AS calls FROM events",
}

ORACLE_SQL["E05_full_candidates"] = f"""SELECT s.query_id, b.rank, s.file, array_to_string(w[1:12], ',') AS classes, s.snippet AS relevant_snippet, least(len(w), 40)::INTEGER AS n_methods,
  '{{"bm25_score":' || score || ',"reasons":["rank ' || b.rank || '"]}}' AS evidence
FROM ({SNIPPETS.replace('b.rank % 4 = 0 AND len(l) > 0', 'false')}) s
JOIN ({BASE} SELECT query_id, file, rank, score FROM bm) b USING (query_id, file)
JOIN (WITH {DOCS} SELECT file, list_sort(list_distinct({tokens("replace(text, '. ', '.' || chr(10))")})) AS w FROM docs) d ON d.file = s.file"""
ORACLE_SQL["E15_observations"] = """WITH RECURSIVE o AS (
  SELECT conv_id AS query_id, turn AS place, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, to_json({'action': role, 'content': text, 'results': string_split(text, ' ')[1:9]})::VARCHAR AS whole,
    to_json({'action': role, 'content': CASE WHEN length(text) > 200 THEN regexp_replace(left(text, 185), '\\s+$', '') || ' ...[truncated]' ELSE text END, 'results': string_split(text, ' ')[1:5], '_truncated': true})::VARCHAR AS cut FROM conversations),
t AS (SELECT query_id, sum(length(whole) + 1) + 1 <= 1500 AS fits FROM o GROUP BY query_id),
r AS (
  SELECT query_id, 0::BIGINT AS i, 1500::BIGINT AS remaining, ''::VARCHAR AS observation FROM t
  UNION ALL
  SELECT o.query_id, o.i, r.remaining - CASE WHEN length(whole) <= least(r.remaining, 750) THEN length(whole) ELSE length(cut) END, CASE WHEN length(whole) <= least(r.remaining, 750) THEN whole ELSE cut END
  FROM r JOIN o ON o.query_id = r.query_id AND o.i = r.i + 1 WHERE r.remaining > 0)
SELECT o.query_id, place, CASE WHEN fits THEN whole ELSE observation END AS observation FROM o JOIN t USING (query_id) LEFT JOIN r ON r.query_id = o.query_id AND r.i = o.i WHERE fits OR r.i IS NOT NULL"""
ORACLE_SQL["V11_supplement"] = f"""{BOTH}, {HINTED}, {per('p', 'bm', 10)}, {per('f', 'flat', 10)}, {per('deep', 'bm', 50)},
u AS (SELECT 'first' AS method, * FROM p UNION ALL SELECT 'second', * FROM f), sub AS (SELECT p.*, CASE WHEN query_id IN (SELECT query_id FROM low) THEN 'selected' ELSE 'unselected' END AS subset FROM p)
{unpivoted('summary', summary('method') + ' FROM u GROUP BY method', 'method')}
UNION ALL {unpivoted('paired', ORACLE_SQL["V08_paired"], None)}
UNION ALL SELECT 'recall', k::VARCHAR, unnest(['n', 'hits', 'recall']), unnest([n::DOUBLE, hits::DOUBLE, recall]) FROM (
  SELECT k, count(*) AS n, count(*) FILTER (WHERE correct_rank <= k) AS hits, round(count(*) FILTER (WHERE correct_rank <= k)::DOUBLE / count(*), 9) AS recall FROM deep, (VALUES (10), (20), (50)) v(k) GROUP BY k)
UNION ALL {unpivoted('subsets', summary('subset') + ' FROM sub GROUP BY subset', 'subset')}"""
