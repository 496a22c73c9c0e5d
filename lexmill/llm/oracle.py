"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from .licenses import COVER, GRAM, SHARE, SHIFT, STRETCH, TEMPLATES

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS win FROM p),
c AS (SELECT win FROM k WHERE win IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT r, i, word, max(CASE WHEN c.win IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM k LEFT JOIN c ON k.win = c.win),
s AS (SELECT r, count(*) AS n, sum(gone) AS lost, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM g GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""

OP3 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, doc_id, h, unnest(range(CAST(length(h) / 2 AS BIGINT))) AS i FROM d),
k AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 100 <= length(h) THEN substr(h, 2 * i + 1, 100) END AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM k WHERE win IS NOT NULL GROUP BY 1),
g AS (SELECT r, i, b, max(CASE WHEN f.first < k.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM k LEFT JOIN f ON k.win = f.win),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) = 0 AS opens FROM g),
s AS (SELECT r, count(*) AS n, sum(gone) AS lost, count(*) FILTER (WHERE opens) AS spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM e GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""

OP6 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND q.vec_id % 20 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= 20
"""


def op5() -> str:
    """The license scan, with words compared as text where the operator compares hashes."""
    words = lambda c: f"list_filter(string_split_regex(regexp_replace(lower_az({c}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fix = lambda s: s.replace("lower_az(coalesce(text, ''))", lower.format("coalesce(text, '')")).replace("lower_az(body)", lower.format("body"))
    quoted = ", ".join("({}, '{}', '{}')".format(i, label, t.replace("'", "''")) for i, (label, t) in enumerate(TEMPLATES))
    k = GRAM
    return fix(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT template, label, {words('body')} AS w FROM (VALUES {quoted}) x(template, label, body)),
tg AS (SELECT template, label, len(w) AS tw, i - 1 AS tpos, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {k} + 2)) AS i FROM t)),
dg AS (SELECT r, i - 1 AS pos, array_to_string(w[i:i + {k - 1}], ' ') AS g, array_to_string(w[i:i + 1], ' ') AS two, array_to_string(w[i:i + 2], ' ') AS three FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
base AS (SELECT r, pos, CASE WHEN two = 'mit license' THEN 'mit' WHEN two = 'apache license' THEN 'apache' ELSE 'gpl' END AS label FROM dg WHERE two IN ('mit license', 'apache license') OR three = 'general public license'),
bs AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS own FROM base GROUP BY 1),
v AS (SELECT r, template, label, tw, pos - tpos AS diag, min(pos) AS lo, max(pos) + {k} AS hi, list(DISTINCT tpos) AS tp FROM dg JOIN tg USING (g) GROUP BY 1, 2, 3, 4, 5),
vc AS (SELECT *, len(list_distinct(flatten(list_transform(tp, lambda p: range(p, p + {k}))))) / tw AS own_cover FROM v),
n AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, template ORDER BY diag) > least({SHIFT}, greatest(1, CAST(floor(tw * {SHARE}) AS INT))) THEN 1 ELSE 0 END AS new FROM vc),
m AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diag ROWS UNBOUNDED PRECEDING) AS grp FROM n),
q AS (SELECT r, template, label, tw, min(lo) AS lo, max(hi) AS hi, max({{'cover': own_cover, 'before': -lo, 'lo': lo, 'hi': hi}}) AS single, list_distinct(flatten(list_transform(flatten(list(tp)), lambda p: range(p, p + {k})))) AS covered FROM m GROUP BY r, template, label, tw, grp),
qc AS (SELECT r, label, tw, CASE WHEN f THEN lo ELSE single.lo END AS lo, CASE WHEN f THEN hi ELSE single.hi END AS hi, CASE WHEN f THEN len(covered) / tw ELSE single.cover END AS cover FROM (SELECT *, hi - lo <= {STRETCH} * tw + {k} AS f FROM q)),
ev AS (SELECT r, label, tw, lo, hi, cover FROM qc WHERE cover >= {COVER}),
ok AS (SELECT r, label, cover FROM ev m WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.r = m.r AND o.label <> m.label AND (o.cover > m.cover OR (o.cover = m.cover AND o.tw > m.tw)) AND (least(o.hi, m.hi) - greatest(o.lo, m.lo)) * 2 >= least(o.hi - o.lo, m.hi - m.lo))),
by_doc AS (SELECT r, list(DISTINCT label) AS more, max(cover) AS best FROM ok GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(own, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
  greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN by_doc USING (r)
""")




OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(p) AS piece FROM d)),
g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) t(k))),
f AS MATERIALIZED (SELECT lang, k, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM g GROUP BY lang, k, array_to_string(g, ' ') HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, j, a.f AS l, b.f AS r, CAST(1000 AS HUGEINT) * c.f * n.n // (CAST(a.f AS HUGEINT) * b.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN n USING (lang)
  JOIN f a ON a.lang = c.lang AND a.phrase = array_to_string(c.g[1:j], ' ') JOIN f b ON b.lang = c.lang AND b.phrase = array_to_string(c.g[j + 1:c.k], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(g[i:i + m - 1], ' ') AS phrase, max(f) AS f FROM (SELECT lang, g, f, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) t(m) WHERE m < k) GROUP BY 1, 2),
o AS (SELECT c.lang, c.phrase, c.f AS a, l, r, n.n, score FROM c JOIN best USING (lang, phrase) JOIN n USING (lang) LEFT JOIN inside ON inside.lang = c.lang AND inside.phrase = c.phrase WHERE inside.f IS NULL OR 100 * inside.f < 100 * c.f)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000
"""


def op13() -> str:
    """Centroids by rounds: every vector against every centroid."""
    quoted = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
    parts = [f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {quoted} AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), e) - 1 AS INTEGER) AS c, e AS z FROM v WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), e) <= 40)"""]
    near = """
a{0} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (e[i] - z[i]) * (e[i] - z[i]))) AS d FROM v, z{0})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
    for i in range(5):
        parts += [near.format(i), f"""
z{i + 1} AS MATERIALIZED (SELECT c, coalesce(f, z) AS z FROM z{i} LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS f
  FROM (SELECT c, i, sum(e[i]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) t(i) GROUP BY c, i) GROUP BY c) USING (c))"""]  # fmt: skip
    parts.append(near.format(5))
    return ",".join(parts) + """
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a5 JOIN v USING (r) JOIN z5 USING (c)
"""


ORACLE = {"op2_substring_dedup": OP2, "op3_suffix_dedup": OP3, "op5_license_scan": op5(), "op6_top_k": OP6, "op11_collocations": OP11, "op13_centroids": op13()}
