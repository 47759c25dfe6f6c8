"""SQL for the corpus queries that SQL can state."""

OP2 = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 w AS (SELECT r, p, md5(raw[p + 1 : p + 200]) AS k FROM (SELECT r, raw, unnest(range(0, n - 199)) AS p FROM d)),
 twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
 hit AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS opens FROM w WHERE k IN (SELECT k FROM twice)),
 runs AS (SELECT r, g, min(p) AS s, max(p) + 200 AS e FROM (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS g FROM hit) GROUP BY r, g),
 gaps AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM runs
   UNION ALL SELECT d.r, coalesce(m.e, 0), d.n FROM d LEFT JOIN (SELECT r, max(e) AS e FROM runs GROUP BY r) m ON m.r = d.r),
 kept AS (SELECT g.r, string_agg(x[2 * a + 1 : 2 * b], '' ORDER BY a) AS x FROM gaps g JOIN d ON d.r = g.r GROUP BY g.r),
 sums AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept ON kept.r = d.r LEFT JOIN sums ON sums.r = d.r"""


def _sweep(k: int) -> str:
    """Rows that sweep k takes: in the order of u while the words stay within what is left."""
    return f""", s{k} AS (SELECT *, CASE WHEN NOT t{k - 1} AND size > 0 AND size <= left{k} AND sum(CASE WHEN NOT t{k - 1} AND size > 0 AND size <= left{k} THEN size ELSE 0 END)
     OVER (PARTITION BY k ORDER BY u RANGE UNBOUNDED PRECEDING) <= left{k} THEN true ELSE t{k - 1} END AS t{k} FROM s{k - 1}x),
 s{k}x AS (SELECT *, left{k} - sum(CASE WHEN t{k} AND NOT t{k - 1} THEN size ELSE 0 END) OVER (PARTITION BY k) AS left{k + 1} FROM s{k})"""


OP9 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS k FROM documents),
 m AS (SELECT doc_id, k, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
   CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text), 1, 13) AS BIGINT) AS u FROM d),
 per AS (SELECT k, sum(size) AS source_size, CAST(CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM m GROUP BY k),
 lev AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
 top AS (SELECT arg_min(level, cap / w) AS level FROM lev WHERE cap >= level * w),
 tar AS (SELECT k, source_size, least(cap, (SELECT level FROM top) * w) AS target FROM lev),
 s0x AS (SELECT m.*, source_size, target, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole,
   CAST(floor(target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size) AS BIGINT) AS left1, false AS t0 FROM m JOIN tar ON tar.k = m.k)""" + "".join(
    _sweep(k) for k in (1, 2, 3)) + """
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST((whole + CASE WHEN t3 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM s3x"""


def _plus(state: str, cost, edit: str) -> str:
    """A state (six digits of cost, then the audit) after one more edit."""
    return f"lpad(CAST(CAST(substr({state}, 1, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr({state}, 7) || '{edit}'"


def _keep(initial: str, *states: str) -> str:
    """K from any of the states, where the row's initial and fault allow it."""
    return ", ".join(f"CASE WHEN i = '{initial}' AND f < 2 THEN {_plus(s, '3 * f', 'K')} END" for s in states)


def _rerole(*states: str) -> str:
    return ", ".join(f"CASE WHEN f < 2 THEN {_plus(s, '3 + 3 * f', 'R')} END" for s in states)


#: Insertions before the next row: a state as text, least() passes over states that are not reached.
_INSERTED = f"SELECT *, least(b3, {_plus('b2', 3, 'I')}) AS b3i FROM (SELECT *, a0 AS b0, a1 AS b1, a3 AS b3, least(a2, {_plus('a0', 3, 'I')}, {_plus('a1', 3, 'I')}, {_plus('a3', 3, 'I')}) AS b2 FROM dp)"
OP11 = f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
 codes AS (SELECT k, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda ch: CAST(unicode(ch) AS UBIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 20 AS code FROM (SELECT DISTINCT k FROM c)),
 d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM c JOIN codes ON codes.k = c.k),
 o AS (SELECT *, substr(role, 1, 1) AS ini, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM d),
 m AS (SELECT *, CASE WHEN seen = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 3 WHEN right(seen, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS f,
    CASE WHEN lag(ini) OVER (PARTITION BY conv_id ORDER BY p) || ini IN ('su', 'ua', 'au') OR lag(ini) OVER (PARTITION BY conv_id ORDER BY p) IS NULL THEN 0 ELSE 1 END AS bad FROM o),
 per AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 2) AS blank, count(*) FILTER (f = 3) AS duplicate, count(*) FILTER (f = 1) AS truncated, sum(bad) AS illegal,
    string_agg(CASE WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'o' END || f, '' ORDER BY p) AS s FROM m GROUP BY conv_id),
 dp AS (SELECT s, 0 AS p, '000000' AS a0, NULL::VARCHAR AS a1, NULL::VARCHAR AS a2, NULL::VARCHAR AS a3 FROM (SELECT DISTINCT s FROM per)
   UNION ALL SELECT s, p + 1, {_plus('b0', 4, 'D')}, least({_plus('b1', 4, 'D')}, {_keep('s', 'b0')}), least({_plus('b2', 4, 'D')}, {_keep('u', 'b0', 'b1', 'b3i')}, {_rerole('b0', 'b1', 'b3i')}),
     least({_plus('b3i', 4, 'D')}, {_keep('a', 'b2')}, {_rerole('b2')})
   FROM (SELECT *, substr(s, 2 * p + 1, 1) AS i, CAST(substr(s, 2 * p + 2, 1) AS INT) AS f FROM ({_INSERTED}) WHERE 2 * p < length(s))),
 best AS (SELECT s, least(b0, b3i) AS r FROM ({_INSERTED}) WHERE 2 * p = length(s)),
 done AS (SELECT per.*, CAST(substr(r, 1, 6) AS BIGINT) AS cost, substr(r, 7) AS audit FROM per JOIN best ON best.s = per.s),
 edits AS (SELECT conv_id, e, k, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS p, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS j FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS k FROM done WHERE audit <> '')
    WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
 said AS (SELECT x.*, role, CASE WHEN e = 'I' THEN '' ELSE text END AS text, max(CASE WHEN j = 1 AND e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS opens
    FROM edits x LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM x.conv_id AND m.p = x.p WHERE e <> 'D'),
 whole AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - opens) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS t FROM said GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM c) a LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM a.conv_id"""
