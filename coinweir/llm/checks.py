"""DuckDB SQL of the contracts that SQL can express, over the same tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOP_PRODUCTS = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {USABLE}),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 20"""


def near_duplicates(words: int, percent: int) -> str:
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i : i + {words} - 1], ' ')) END) AS shingle FROM t),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
  e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= {percent} * (nx.n + ny.n - i)),
  ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
  r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT ways.y, r.c FROM r JOIN ways ON r.doc_id = ways.x),
  m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY ALL)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)"""


_WORDS = r"""regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')""".format(LOWER)
BENCHMARK_HITS = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
  f AS (SELECT item_id, least(10, len(w)) AS width, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
  d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  g AS (SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS pos FROM d, (SELECT DISTINCT width FROM f) WHERE len(w) >= width),
  h AS (SELECT doc_id, item_id, width, pos FROM (SELECT doc_id, width, pos, array_to_string(w[pos : pos + width - 1], ' ') AS win FROM g) JOIN f USING (width, win)),
  places AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + width)) AS place FROM h) GROUP BY ALL),
  items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM h GROUP BY ALL)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


def clusters(k: int, rounds: int) -> str:
    """Each round is two tables: the centroids by component, and the assignment to them."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
          FROM embeddings WHERE len(embedding) = 64 AND {USABLE})""",
        "q AS MATERIALIZED (SELECT row, vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM v)",
        f"""c0 AS MATERIALIZED (SELECT p.c, i, x FROM q JOIN (SELECT row, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c
          FROM (SELECT DISTINCT row, vec_id FROM q) QUALIFY c < {k}) p USING (row))""",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT row, vec_id, min(d) AS d, arg_min(c, d * {k} + c) AS c FROM (
              SELECT row, vec_id, c{n}.c, sum((q.x - c{n}.x) * (q.x - c{n}.x)) AS d FROM q JOIN c{n} USING (i) GROUP BY ALL) GROUP BY ALL)"""
        )
        if n < rounds:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.x, c{n}.x) AS x FROM c{n} LEFT JOIN (
                  SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
                  FROM q JOIN a{n} USING (row) GROUP BY ALL) m USING (c, i))"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h.s AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY ALL) h USING (c)"""


COLLOCATIONS = f"""
WITH p AS (SELECT lang, row_number() OVER () AS piece, w FROM (SELECT lang, regexp_extract_all(unnest(string_split_regex({LOWER}, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents))),
  g AS (SELECT lang, k AS words, array_to_string(w[pos : pos + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
  f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL),
  n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY ALL),
  c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= 10),
  cuts AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 :], ' ')),
  best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.words = 3 AND c.lang = b.lang AND 100 * c.a >= 50 * b.a
    AND (array_to_string(c.w[1:2], ' ') = b.phrase OR array_to_string(c.w[2:3], ' ') = b.phrase))),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
