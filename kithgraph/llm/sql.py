"""The same results in SQL."""

_W = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_PAIRS = f"""latest AS (SELECT repo.id AS repo_id, arg_max(CASE WHEN languages IS NULL THEN MAP {{}} ELSE languages END, line_no) AS m FROM languages WHERE repo.id IS NOT NULL GROUP BY repo.id),
has AS (SELECT DISTINCT repo_id, lower(regexp_replace(e.key, '^[{_W}]+|[{_W}]+$', '', 'g')) AS lang FROM (SELECT repo_id, unnest(map_entries(m)) AS e FROM latest) WHERE e.value > 0),
one AS (SELECT lang, count(*) AS n FROM has WHERE lang <> '' GROUP BY lang),
total AS (SELECT count(DISTINCT repo_id) AS n FROM has WHERE lang <> ''),
pairs AS (SELECT a.lang AS item_a, b.lang AS item_b, count(*) AS n_ab FROM has a JOIN has b ON a.repo_id = b.repo_id AND a.lang < b.lang AND a.lang <> '' GROUP BY ALL),
counted AS (SELECT item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, total.n AS n FROM pairs JOIN one x ON x.lang = item_a JOIN one y ON y.lang = item_b CROSS JOIN total)"""


def _current(field: str, table: str, full: str) -> str:
    return f"""SELECT id, '{field}' AS field, arg_max({field}, o) AS value, arg_max(line_no, o) AS line_no
  FROM (SELECT *, struct_pack(u := coalesce(updated_at, TIMESTAMP '0001-01-01'), f := item = '{full}', l := line_no) AS o FROM {table}) WHERE id IS NOT NULL AND regexp_matches({field}, '[^{_W}]') GROUP BY id"""


_TERMS = f"""records AS ({_current('description', 'repository', 'Repository')}),
docs AS (SELECT id AS repo_id, regexp_extract_all(lower(value), '[\\p{{L}}\\p{{N}}]+') AS terms FROM records),
tf AS (SELECT repo_id, term, count(*) AS tf FROM (SELECT repo_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS n_records FROM tf GROUP BY term),
total AS (SELECT count(*) AS n, avg(len(terms)) AS average FROM docs)"""

_FIELDS = {"account": ("Account", ("name", "company", "blog", "location", "email")), "repository": ("Repository", ("description", "homepage", "language", "default_branch"))}
_SURVIVORS = " UNION ALL ".join(
    f"SELECT '{t}' AS entity, id, field, line_no FROM ({_current(f, t, full)}) WHERE id IN (SELECT id FROM {t} GROUP BY id HAVING count(*) > 1)" for t, (full, fs) in _FIELDS.items() for f in fs
)

SQL = {
    "p1_found": f"WITH {_PAIRS} SELECT item_a AS language_a, item_b AS language_b FROM counted WHERE n_ab >= 5 AND n_ab * 200 >= n AND n_ab * n >= 2 * n_a * n_b",
    "p1_pairs": f"""WITH {_PAIRS} SELECT item_a, item_b, n_ab, n_a, n_b, n, round(n_ab * CAST(n AS DOUBLE) / (n_a * CAST(n_b AS DOUBLE)), 6) AS lift,
  round((n_ab + 0.5::DOUBLE) * (n - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)), 6) AS odds_ratio FROM counted""",
    "p6_found": f"""WITH {_TERMS}, scores AS (SELECT repo_id, term, round(tf * ln(CAST(n AS DOUBLE) / n_records), 9) AS score FROM tf JOIN df USING (term) CROSS JOIN total WHERE n_records >= 2)
SELECT repo_id, term FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, term) AS r FROM scores) WHERE r = 1""",
    "p6_bm25": f"""WITH {_TERMS} SELECT repo_id, term, tf, n_records, round(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(terms) / average)) * ln(1 + (n - n_records + 0.5::DOUBLE) / (n_records + 0.5::DOUBLE)), 6) AS score
FROM tf JOIN docs USING (repo_id) JOIN df USING (term) CROSS JOIN total""",
    "p7_found": _SURVIVORS,
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": """WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT eval_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
spans AS (SELECT DISTINCT eval_id, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT eval_id, w, unnest(range(1, len(w) - 11)) AS i FROM items WHERE len(w) >= 13)),
grams AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13))
SELECT DISTINCT doc_id, eval_id FROM grams JOIN spans USING (s)""",
    "p9_spans": """WITH words AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w, regexp_split_to_array(text, '[\\p{L}\\p{N}]+') AS gaps FROM documents WHERE text IS NOT NULL),
items AS (SELECT eval_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w, array_to_string(regexp_extract_all(lower(coalesce(answer, '')), '[\\p{L}\\p{N}]+'), ' ') AS said FROM eval_items WHERE eval_id IS NOT NULL),
runs AS (SELECT DISTINCT eval_id, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT eval_id, w, unnest(range(1, len(w) - 11)) AS i FROM items WHERE len(w) >= 13)),
grams AS (SELECT doc_id, i, lower(array_to_string(w[i:i + 12], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
hits AS (SELECT doc_id, eval_id, i, i - row_number() OVER (PARTITION BY doc_id, eval_id ORDER BY i) AS island FROM grams JOIN runs USING (s)),
found AS (SELECT doc_id, eval_id, min(i) AS a, max(i) + 12 AS b FROM hits GROUP BY doc_id, eval_id, island)
SELECT doc_id, eval_id, CAST(len(array_to_string(gaps[1:a], '')) + len(array_to_string(words.w[1:a - 1], '')) AS INTEGER) AS start,
  CAST(len(array_to_string(gaps[1:b], '')) + len(array_to_string(words.w[1:b], '')) AS INTEGER) AS "end", CAST(b - a + 1 AS INTEGER) AS n_words,
  items.said <> '' AND contains(' ' || lower(array_to_string(words.w, ' ')) || ' ', ' ' || items.said || ' ') AS answer
FROM found JOIN words USING (doc_id) JOIN items USING (eval_id)""",
}
