"""DuckDB SQL for the queries that SQL can express, written independently of
the Spark code: exact, without MinHash, hashing or archives. The learned
operators, the random field and the hash draws have no SQL form; tests/llm
holds their plain versions."""

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
tri AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) AS t(j) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(list_distinct(w))::BIGINT AS n_distinct_words
  FROM d LEFT JOIN cov ON cov.rid = d.rid),
f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
      + 4 * (100 * n_symbols > 40 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 60 * n_lines)::BIGINT
      + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 25 * n_words)::BIGINT
      + 64 * (100 * n_distinct_words < 8 * least(n_words, 500))::BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits = 0 AS kept, fail_bits
FROM f
"""

JACCARD_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM d),
c AS (SELECT min(doc_id) AS class_id, s, count(*) AS size FROM sets WHERE len(s) > 0 GROUP BY s),
sh AS (SELECT class_id, unnest(s) AS x FROM c),
pairs AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.x = b.x AND a.class_id < b.class_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN c ca ON ca.class_id = a JOIN c cb ON cb.class_id = b
  WHERE common >= 0.8 * (len(ca.s) + len(cb.s) - common)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
n AS (SELECT a AS class_id, sum(size) AS n_docs, count(*) AS n_texts FROM sym JOIN c ON c.class_id = b GROUP BY a),
reach AS (SELECT a AS class_id, a AS r FROM sym UNION SELECT reach.class_id, sym.b FROM reach JOIN sym ON sym.a = reach.r),
grp AS (SELECT class_id, min(r) AS group_id FROM reach GROUP BY class_id)
SELECT sets.doc_id, coalesce(c.class_id, sets.doc_id) AS class_id, coalesce(c.size, 1) AS class_size,
  (coalesce(c.size, 1) - 1 + coalesce(n.n_docs, 0))::BIGINT AS n_links, coalesce(n.n_texts, 0) AS n_linked_texts,
  coalesce(grp.group_id, c.class_id, sets.doc_id) AS group_id
FROM sets LEFT JOIN c ON c.s = sets.s LEFT JOIN n ON n.class_id = c.class_id LEFT JOIN grp ON grp.class_id = c.class_id
"""

WARC_INDEX = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest, coalesce(url, '') AS url,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^#]*)', 1) AS tail
  FROM pages),
r AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first,
    CASE WHEN url = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')'
      || CASE WHEN tail LIKE '/%' THEN tail ELSE '/' || tail END END AS url_key,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 31536000), '%Y-%m-%dT%H:%M:%SZ') AS capture_time
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, url_key, capture_time,
  row_number() OVER (ORDER BY url_key, capture_time, page_id) - 1 AS position
FROM r
"""

BENCHMARK_LEAKS = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT side, row_number() OVER () AS rid, id,
    list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM texts),
s AS (SELECT side, rid, id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS x FROM w),
q AS (SELECT rid, id AS item_id, count(*) AS n FROM s WHERE side = 'i' GROUP BY ALL),
hit AS (SELECT a.id AS doc_id, a.rid AS drid, b.rid AS rid, count(*) AS n_shared
  FROM s a JOIN s b ON a.x = b.x AND a.side = 'd' AND b.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_shared::INTEGER AS n_shared, n::INTEGER AS item_shingles, n_shared / n AS containment
FROM hit JOIN q ON q.rid = hit.rid WHERE n_shared >= 0.8 * n
"""

HARD_NEGATIVES = r"""
WITH e AS (
  SELECT row_number() OVER () AS uid, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.uid AS a, a.vec_id AS anchor_id, b.uid AS b, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.uid <> b.uid),
p AS (
  SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS k
  FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id, s.b) AS rank
  FROM p JOIN s ON s.a = p.a
  WHERE p.k <= 5 AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def _merkle_manifest(levels: int = 10) -> str:
    """Unrolled over ``levels`` levels of eight children (8^levels leaves a
    tree); a tree that has one node keeps it."""
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), "
           "lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))")
    code = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(code, ("doc_id", "source", "lang", "n_chars")), code(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # p0: a row for each leaf: tree, place of its ancestor, its proof so far, its folded node so far
    sql = [f"""d AS (SELECT *, {leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS changed FROM documents),
n0 AS (SELECT row_number() OVER () AS rid, doc_id, lang, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM d),
a0 AS (SELECT t, i, leaf AS h FROM n0),
p0 AS (SELECT rid, t, i, changed AS cur, '' AS proof FROM n0)"""]

    def up(a: str, p: str, k: int) -> str:
        """From level k to k + 1 of the nodes in tables a and the rows in p."""
        return f"""{a}{k + 1} AS (SELECT t, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
    FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {a}{k}) GROUP BY t, i // 8),
{p}{k + 1} AS (SELECT rid, p.t, p.i // 8 AS i, CASE WHEN s.n > 1 THEN sha256(l || cur || r) ELSE cur END AS cur, proof || l || r AS proof
    FROM {p}{k} p JOIN (SELECT t, i, count(*) OVER (PARTITION BY t) AS n,
        coalesce(string_agg(h, '') OVER (PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(h, '') OVER (PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM {a}{k}) s ON s.t = p.t AND s.i = p.i)"""

    sql += [up("a", "p", k) for k in range(levels)]
    sql += [f"b0 AS (SELECT 0 AS t, t AS i, h FROM a{levels})", f"q0 AS (SELECT rid, 0 AS t, t AS i, cur, proof FROM p{levels})"]
    sql += [up("b", "q", k) for k in range(levels)]
    return "WITH " + ",\n".join(sql) + f"""
SELECT n0.doc_id, n0.leaf, s.h AS subroot, r.h AS root, sha256(q.proof) AS proof_sha256, q.cur AS folded_root, q.cur = r.h AS verified
FROM n0 JOIN q{levels} q ON q.rid = n0.rid JOIN a{levels} s ON s.t = n0.t, b{levels} r
"""


ORACLES = {
    "op2_quality_rules": QUALITY_RULES,
    "op3_jaccard_join": JACCARD_JOIN,
    "op8_warc_index": WARC_INDEX,
    "op9_benchmark_leaks": BENCHMARK_LEAKS,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_merkle_manifest": _merkle_manifest(),
}
