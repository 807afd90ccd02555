"""The queries of this folder over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import read
from .classifier import classify
from .collocations import collocations
from .compact_windows import repeated_passages
from .conversation_repair import repair
from .exact_dedup import exact_groups
from .minhash import near_groups
from .mixing import curriculum
from .packing import pack
from .pii import personal_data
from .quality_rules import quality_rules
from .secret_scan import scan
from .suffix_dedup import remove_repeats
from .warc import derivatives, responses


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(read(spark, sf_dir, "documents"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(read(spark, sf_dir, "pages")))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), width=4)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_mixing": op3_mixing,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_compact_windows": op5_compact_windows,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_minhash": op10_minhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_collocations": op12_collocations,
    "op13_personal_data": op13_personal_data,
}

def _edited(state: str, cost: str, letter: str) -> str:
    """SQL of a path to ``state`` (12 digits of cost, then its edits) that goes on by one edit."""
    return f"lpad((substr({state}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({state}, 13) || '{letter}'"


def _inserted(rows: str) -> str:
    """SQL of rows (who, i, s0 .. s3) with the paths that insertions open, one or two at a place."""
    for _ in range(2):
        user = ", ".join(_edited(s, "5", "Iu") for s in ("s0", "s1", "s3"))
        rows = f"(SELECT who, i, s0, s1, least(s2, {user}) AS s2, least(s3, {_edited('s2', '5', 'Ia')}) AS s3 FROM {rows})"
    return rows


#: Repair of conversations as a recursion over their rows; a path's letters I and R are followed by the role they give.
_REPAIR = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, x)) AS t),
keyed AS (
  SELECT coalesce(conv_id::VARCHAR, 'null') AS who, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (
  SELECT k, xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT k FROM keyed), crc),
changed AS (
  SELECT who, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed JOIN kinds USING (k) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY who ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text), copy) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM changed),
marked AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY who, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY who ORDER BY i), 1) AS before FROM placed),
counts AS (
  SELECT who, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY who),
arcs AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM marked),
paths AS (
  SELECT * FROM {_inserted("(SELECT DISTINCT who, 0::BIGINT AS i, '000000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM keyed)")}
  UNION ALL
  SELECT * FROM {_inserted(f'''(
    SELECT p.who, a.i, {_edited("s0", "2", "D")} AS s0,
           least({_edited("s1", "2", "D")}, CASE WHEN NOT must AND initial = 's' THEN {_edited("s0", "more", "K")} END) AS s1,
           least({_edited("s2", "2", "D")}, {", ".join(f"CASE WHEN NOT must AND initial = 'u' THEN {_edited(s, 'more', 'K')} END, CASE WHEN NOT must THEN {_edited(s, '1 + more', 'Ru')} END" for s in ("s0", "s1", "s3"))}) AS s2,
           least({_edited("s3", "2", "D")}, CASE WHEN NOT must AND initial = 'a' THEN {_edited("s2", "more", "K")} END, CASE WHEN NOT must THEN {_edited("s2", "1 + more", "Ra")} END) AS s3
    FROM paths p JOIN arcs a ON a.who = p.who AND a.i = p.i + 1)''')}),
best AS (
  SELECT who, least(s0, s3) AS path FROM paths QUALIFY row_number() OVER (PARTITION BY who ORDER BY i DESC) = 1),
edits AS (
  SELECT who, o, e, count(*) FILTER (e[1] <> 'I') OVER (PARTITION BY who ORDER BY o) AS i
  FROM (SELECT who, unnest(es) AS e, unnest(range(len(es))) AS o FROM (SELECT who, regexp_extract_all(substr(path, 13), '[DK]|[IR][ua]') AS es FROM best))),
texts AS (
  SELECT d.who, string_agg(CASE WHEN e = 'K' THEN role WHEN e[2] = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e[1] = 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS whole
  FROM edits d LEFT JOIN arcs a ON a.who = d.who AND a.i = d.i WHERE e <> 'D' GROUP BY d.who)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, substr(path, 1, 12)::BIGINT AS cost, regexp_replace(substr(path, 13), '[ua]', '', 'g') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'null') AS who FROM conversations) c JOIN best USING (who) LEFT JOIN counts USING (who) LEFT JOIN texts USING (who)
"""

ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": _REPAIR,
    "op3_mixing": """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(cast(doc_id AS VARCHAR), '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM totals),
weighed AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size::DOUBLE * 3 AS cap FROM ranked),
levels AS (
  SELECT *, row_number() OVER o AS place,
         (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv
  FROM weighed WINDOW o AS (ORDER BY cap / w, r)),
targets AS (
  SELECT source, r, source_size, least(cap, w * (SELECT arg_min(lv, place) FROM levels WHERE cap / w >= lv)) AS target FROM levels),
run AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.r,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
part AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE round(target)::BIGINT // source_size END AS whole,
         CASE WHEN target = 0 THEN 0::DOUBLE ELSE before::DOUBLE / target END AS u FROM run),
placed AS (
  SELECT *, CASE r % 3
    WHEN 0 THEN CASE WHEN u < 0.625 THEN 2 * u / (1.5 + sqrt(2.25 + u * -2.0)) WHEN u < 1 THEN 0.5 + 2 * (u - 0.625) / (1.0 + sqrt(1.0 + (u - 0.625) * -2.0)) ELSE u END
    WHEN 1 THEN u
    ELSE CASE WHEN u < 0.375 THEN 2 * u / (0.5 + sqrt(0.25 + u * 2.0)) WHEN u < 1 THEN 0.5 + 2 * (u - 0.375) / (1.0 + sqrt(1.0 + (u - 0.375) * 2.0)) ELSE u END
    END AS p
  FROM part)
SELECT doc_id, size, source_size, target,
       (whole * size + least(greatest(round(target)::BIGINT - whole * source_size - before, 0), size))::BIGINT AS taken,
       round(p, 9) AS position
FROM placed
""",
    "op10_minhash": """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY u, v),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) ON u = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
""",
    "op12_collocations": """
WITH pieces AS (
  SELECT lang, d, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang HAVING sum(len(w)) > 0),
grams AS (
  SELECT lang, m, w[i:i + m - 1] AS g, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.m, c.g, c.f AS a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM grams WHERE m > 1) c
  JOIN grams l ON l.lang = c.lang AND l.g = c.g[1:c.k]
  JOIN grams r ON r.lang = c.lang AND r.g = c.g[c.k + 1:c.m]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT b.lang, b.g
  FROM (SELECT lang, m, f, s, e, g[s:e] AS part FROM grams, (SELECT unnest(range(1, 5)) AS s), (SELECT unnest(range(1, 5)) AS e)
        WHERE m > 2 AND e > s AND e <= m AND e - s + 1 < m) x
  JOIN best b ON b.lang = x.lang AND b.g = x.part WHERE 100 * x.f >= 80 * b.a),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM best WHERE (lang, g) NOT IN (SELECT (lang, g) FROM inside))
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang))
WHERE rank <= 2000
""",
    "op9_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
""",
}
