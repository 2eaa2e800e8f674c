"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tarnflow.llm.sharding import SHARDS, SLOTS, lookup_table



#: The level of the targets is found by trying each number of full sources.
_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS r,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
  FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(k % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
tries AS (
  SELECT a.cap / a.w AS full_to,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
          - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w), 0))
         / sum(b.w) FILTER (b.cap / b.w >= a.cap / a.w) AS level
  FROM (SELECT DISTINCT cap, w FROM w) a, w b GROUP BY a.cap / a.w),
best AS (SELECT arg_min(level, full_to) AS level FROM tries WHERE level < full_to),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM best) * w, cap)) AS target,
             ('0x' || substr(md5('17:' || coalesce(source, '')), 1, 7))::BIGINT % 1073741824 AS u
      FROM w),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 1073741824)::BIGINT ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.r, d.doc_id) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (((i * rate + u) >> 30) - (((i - 1) * rate + u) >> 30)) AS taken
FROM p
"""

_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE r > 1),
a AS (SELECT doc_id, p FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN r USING (doc_id, p)),
k AS (SELECT a.doc_id, string_agg(d.w[a.p], ' ' ORDER BY a.p) AS t FROM a JOIN d USING (doc_id) GROUP BY a.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Escaping lengthens a text by one for each backslash, bracket and angle; marks take 13 and 4 characters a turn.
_OP4 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, length(role) + length(text) + 17
             + length(regexp_replace(role || text, '[^\\\[<]', '', 'g')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(n) + 3)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

#: Words of op7: A-Z lower-cased, runs of anything but ASCII punctuation, white space and control.
_OP7 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines, count(*) AS n_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > 3 * n_words
            OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""


_OP12 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.x, r.x)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""


def _op6() -> str:
    """The table is given as a list: SQL states the placement, tests compare the filling with a plain one."""
    table = lookup_table([f"shard-{k:05d}" for k in range(SHARDS)], SLOTS)
    return f"""
WITH t AS (SELECT {table} AS shards),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, shards[slot + 1] AS shard FROM d, t
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": _OP1,
        "op2_substrings": _OP2,
        "op4_chat": _OP4,
        "op6_sharding": _op6(),
        "op7_decontamination": _OP7,
        "op9_quality": _OP9,
        "op12_topk": _OP12,
    }
