"""DuckDB SQL for the registered queries that SQL can express."""

from sentrail.llm import divergence



def _op2() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    classes = "[" + ", ".join(f"len(regexp_extract_all(t, {quoted(c)}))" for c in divergence.CLASSES) + "]"
    common = "CASE lang " + " ".join(f"WHEN '{k}' THEN list_transform([{', '.join(map(quoted, v))}], lambda c: len(list_filter(lw, lambda x: x = c)))" for k, v in divergence.COMMON.items()) + " END"
    known = ", ".join(f"'{k}'" for k in divergence.COMMON)
    refs = lambda table: f"""(SELECT lang, list(s ORDER BY i) AS q FROM (SELECT lang, i, sum(h[i]) AS s FROM (SELECT lang, {{h}} AS h, unnest(range(1, len({{h}}) + 1)) AS i FROM {table} WHERE lang IS NOT NULL) GROUP BY ALL) GROUP BY lang)"""
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    jsd = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: (({part(f'({p}[i] / list_sum({p}))', f'({q}[i] / list_sum({q}))')}) + ({part(f'({q}[i] / list_sum({q}))', f'({p}[i] / list_sum({p}))')})) / 2))))"
    limits = f"coalesce(dc, 0) > {divergence.CLASS_LIMIT} OR coalesce(dw, 0) > {divergence.WORD_LIMIT}"

    def measured(table: str) -> str:
        return f"""SELECT b.*, CASE WHEN word_chars >= {divergence.MIN_CHARS_JUDGED} THEN {jsd('hc', 'rc.q')} END AS dc,
          CASE WHEN n_words >= {divergence.MIN_WORDS_JUDGED} THEN {jsd('hw', 'rw.q')} END AS dw
        FROM b LEFT JOIN {refs(table).format(h='hc')} rc USING (lang) LEFT JOIN {refs(table).format(h='hw')} rw USING (lang)"""

    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, CASE WHEN lang IN ({known}) THEN lang END AS lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents
), win AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM win JOIN (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {classes} AS cl, list_transform(w, lambda x: lower(x)) AS lw,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), b AS MATERIALIZED (
  SELECT doc_id, lang, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(cl[3] AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
         n_words < {divergence.MIN_WORDS} OR 100 * n_repeat_words > {divergence.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         list_append(cl, word_chars - list_sum(cl)) AS hc, list_append(cm, n_words - list_sum(cm)) AS hw
  FROM (SELECT *, {common} AS cm FROM c)
), b1 AS (SELECT * FROM b WHERE NOT base_failed),
m1 AS MATERIALIZED ({measured('b1')}),
b2 AS (SELECT * FROM m1 WHERE NOT base_failed AND NOT ({limits})),
m2 AS ({measured('b2')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({limits}) AS kept FROM m2
"""


OP3 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (g) WHERE doc_id > first),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), h AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

_OP11_FIRST = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS k, x AS c FROM v ORDER BY k LIMIT 40)
"""


def _op11(rounds: int = 5) -> str:
    """One pair of tables for each round: assignments and the centroids that follow from them."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT row, vec_id, x, min(struct_pack(d := d, k := k)) AS best
  FROM (SELECT v.*, k, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM v, c{t}) GROUP BY ALL)""")
        if t < rounds:
            steps.append(f"""m{t} AS (SELECT k, list(s ORDER BY i) AS c FROM (SELECT best.k AS k, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS s FROM a{t}, range(1, 65) r(i) GROUP BY ALL) GROUP BY k)""")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT k, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (k))")
    return _OP11_FIRST + "".join(f", {s}" for s in steps) + f"""
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.k = best.k
"""


OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS a FROM (
    SELECT lang, s AS size, array_to_string(w[i : i + s - 1], ' ') AS phrase FROM g, range(1, 5) r(s) WHERE i + s - 1 <= len(w)
  ) GROUP BY ALL HAVING count(*) >= 30
), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
q AS (SELECT *, string_split(phrase, ' ') AS u FROM f WHERE size >= 2),
cut AS (
  SELECT q.lang, q.phrase, k, q.a, l.a AS l, r.a AS r, CAST(2000000 * q.a::HUGEINT // (l.a + r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM q) q
  JOIN f l ON l.lang = q.lang AND l.phrase = array_to_string(u[1 : k], ' ') JOIN f r ON r.lang = q.lang AND r.phrase = array_to_string(u[k + 1 : q.size], ' ')
), s AS (SELECT lang, phrase, a, l, r, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(u[i : i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, u, a, size, unnest(range(1, size)) AS i FROM q), range(2, 4) r(m) WHERE m < size AND i + m - 1 <= size GROUP BY ALL
), kept AS (SELECT s.* FROM s LEFT JOIN inner_ USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) JOIN n USING (lang) WHERE rank <= 2000
"""

OP13 = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha, payload_bytes) AS best,
         array_to_string(list_transform(string_split(sha, ''), lambda x: lpad(bin(strpos('0123456789abcdef', x) - 1), 4, '0')), '') AS bits FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, 5 * i + j, 1) AS INTEGER) << (5 - j)))::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM b
"""

ORACLE_SQL = {
    "op2_divergence": _op2(),
    "op3_superkmer_windows": OP3,
    "op10_minhash_bayes": OP10,
    "op6_decontamination": OP6,
    "op11_centroids": _op11(),
    "op12_toivonen_phrases": OP12,
    "op13_warc_index": OP13,
}
