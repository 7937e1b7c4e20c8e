"""DuckDB SQL for the operators that SQL can express."""

_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
          ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _crc32(text: str) -> str:
    """DuckDB expression: unsigned crc32 of the UTF-8 bytes of the SQL expression ``text`` (bit by bit, from the polynomial)."""
    def table(i: int) -> int:
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        return i

    step = "(c >> 8)"
    for k in range(8):
        step = f"xor({step}, ((xor(c, y) >> {k}) & 1) * {table(1 << k)})"
    hexes = f"hex(encode({text}))"
    codes = f"list_transform(range(length({hexes}) // 2), lambda i: CAST(('0x' || {hexes}[2 * i + 1:2 * i + 2]) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, y: {step}), 4294967295)"


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in _RULES)

ORACLE = {
    "op3_digest_url_filter": rf"""
WITH rules(verdict, rh, rp) AS (VALUES {_VALUES}),
parts AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(regexp_replace(substr(url, strpos(url, '://') + 3), '^[^/?#]*', ''),
      '^[^?#]*') ELSE '' END AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path,
    (SELECT max_by(struct_pack(rule := rh || rp, verdict := verdict), length(rh || rp) * 10000 + length(rh))
     FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS r
  FROM parts)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM judged
""",
    "op4_line_runs": r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, n, lines[n] AS line,
    translate(trim(lines[n], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM split)),
held AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.n, l.line, h.key IS NOT NULL AND h.last_doc <> l.doc_id AS gone
  FROM lines l LEFT JOIN held h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_interleaved_shards": f"""
WITH texts AS (SELECT text, {_crc32("coalesce(text, '')")} AS text_crc32 FROM (SELECT DISTINCT text FROM documents)),
rows AS (
  SELECT d.doc_id, CAST(coalesce(octet_length(encode(d.text)), 0) + 1 AS BIGINT) AS size, t.text_crc32,
    CASE WHEN d.source IS NULL THEN '-' ELSE '+' || d.source END AS src,
    CAST('0x' || substr(md5('interleave-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents d JOIN texts t ON d.text IS NOT DISTINCT FROM t.text),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY k, doc_id) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM rows),
placed AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * r + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), src) - 1 AS place, count(*) OVER () AS total
  FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 16 // total AS INT) AS shard,
  CAST(row_number() OVER (PARTITION BY place * 16 // total ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed
""",
    "op12_variable_grams": f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT *, {_crc32("id || ':' || run")} AS h FROM counted),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(c) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3),
cuts AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.rest, a.word, a.n FROM cuts a JOIN words w ON w.word = a.rest
  UNION SELECT a.word, a.rest, w.n FROM cuts a JOIN words w ON w.word = a.rest),
best AS (
  SELECT word, count(DISTINCT near) AS n_near, min_by(near, near) FILTER (near_n = top) AS near, any_value(top) AS near_n
  FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word),
told AS (
  SELECT w.word, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS root, 0 AS steps FROM told
  UNION ALL SELECT c.word, t.form, c.steps + 1 FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL)
SELECT t.word, t.form, (SELECT arg_max(c.root, c.steps) FROM chain c WHERE c.word = t.word) AS root, CAST(t.n AS BIGINT) AS n,
  CAST(t.n_near AS BIGINT) AS n_near, CAST(t.form_n AS BIGINT) AS form_n
FROM told t
""",
    "op13_secondary_sort_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
""",
}
