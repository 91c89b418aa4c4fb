"""The same results in SQL."""

from kithgraph.operators.edge_features import REPOSITORY_KEYS, USER_KEYS
from kithgraph.operators.features import STOP_WORDS
from kithgraph.plans.graphs_sql import SQL as GRAPHS
from kithgraph.plans.recommenders import STEPS
from kithgraph.plans.relations import CONTRIBUTOR, FOLLOW, LATEST, QUERY_IDS, REPOS_MERGED, SPLIT, USERS_MERGED

_LANGUAGES = f"{LATEST}, language_features AS (SELECT repo_id AS row, language AS col, CAST(bytes AS DOUBLE) AS w FROM language_bytes WHERE bytes > 0)"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TFIDF = f"""texts AS ({GRAPHS['nonfork_descriptions']}),
term_counts AS (SELECT repo_id AS row, col, count(*) AS n FROM (SELECT repo_id, unnest(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS col FROM texts) WHERE col NOT IN ({_STOP}) GROUP BY ALL),
term_df AS (SELECT col, count(*) AS df FROM term_counts GROUP BY col),
weighed AS (SELECT row, col, n * (ln((2.0::DOUBLE + (SELECT count(*) FROM texts)) / (1.0::DOUBLE + df)) + 1) AS w FROM term_counts JOIN term_df USING (col)),
tfidf_features AS (SELECT row, col, w / sqrt(sum(w * w) OVER (PARTITION BY row)) AS w FROM weighed)"""
_M = """m AS (SELECT "user" AS row, item AS col, 1.0::DOUBLE AS w FROM train)"""


def _l2(name: str, rows: str) -> str:
    return f"{name} AS (SELECT row, col, CASE WHEN s > 0 THEN w / s ELSE w END AS w FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY row)) AS s FROM ({rows})))"


def _sides(features: str, side: str) -> str:
    if side == "target":
        source, target = f"SELECT m.row, f.col, sum(f.w) AS w FROM m JOIN {features} f ON f.row = m.col GROUP BY ALL", f"SELECT row, col, w FROM {features}"
    else:
        source, target = f"SELECT row, col, w FROM {features}", f"SELECT m.col AS row, f.col, sum(f.w) AS w FROM m JOIN {features} f ON f.row = m.row GROUP BY ALL"
    return f"{_l2('source', source)}, {_l2('target', target)}"


def _dot(a: str, b: str) -> str:
    return f"SELECT x.row AS a, y.row AS b, round(sum(x.w * y.w), 6) AS sim FROM {a} x JOIN {b} y USING (col) WHERE x.row % {QUERY_IDS} = 0 GROUP BY ALL"


_TOP = f"""some_users AS (SELECT "user" FROM users WHERE "user" % {QUERY_IDS} = 0),
grid AS (SELECT "user", item FROM some_users CROSS JOIN items WHERE ("user", item) NOT IN (SELECT ("user", item) FROM train))"""


def _top(scores: str, n: int) -> str:
    return f"""SELECT "user", item, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 9) DESC, item) AS rank FROM ({scores})) WHERE rank <= {n}"""


def _content(ctes: str, features: str, side: str) -> str:
    return f"""WITH {SPLIT}, {_M}, {ctes}{_sides(features, side)}, {_TOP},
scores AS (SELECT x.row AS "user", y.row AS item, sum(x.w * y.w) AS score FROM source x JOIN target y USING (col) WHERE x.row % {QUERY_IDS} = 0 GROUP BY ALL)
{_top('SELECT "user", item, coalesce(score, 0) AS score FROM grid LEFT JOIN scores USING ("user", item)', 10)}"""


def _standard(columns: tuple[str, ...]) -> str:
    return ", ".join(f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE {c} - avg({c}) OVER () END, 6) AS {c}" for c in columns)


def _numbers(columns: tuple[str, ...]) -> str:
    return ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in columns)


def _neighbours(s: str, t: str) -> str:
    return f"""e AS (SELECT {s} AS s, {t} AS t FROM train), sets AS (SELECT s, count(*) AS size FROM e GROUP BY s),
sims AS (SELECT x.s AS a, y.s AS b, count(*) AS shared FROM e x JOIN e y ON x.t = y.t WHERE x.s <> y.s GROUP BY ALL),
sim AS (SELECT a, b, shared / CAST(p.size + q.size - shared AS DOUBLE) AS sim FROM sims JOIN sets p ON p.s = a JOIN sets q ON q.s = b),
near AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS r FROM sim) WHERE r <= 50)"""


_UNSEEN = """WHERE ("user", item) NOT IN (SELECT ("user", item) FROM train)"""
_USER_CF = f"""{SPLIT}, {_neighbours('"user"', 'item')}, recs AS ({_top(f'SELECT * FROM (SELECT near.a AS "user", train.item, sum(sim) AS score FROM near JOIN train ON train."user" = near.b GROUP BY ALL) {_UNSEEN}', 20)})"""


def _walk(more: str) -> str:
    steps = "".join(
        f""", y{k} AS MATERIALIZED (SELECT seed, node, sum(y) AS y FROM (SELECT seed, l.dst AS node, 0.85::DOUBLE * sum(x * p) AS y FROM x{k - 1} x JOIN links l ON l.src = x.node GROUP BY ALL
  UNION ALL SELECT DISTINCT seed, seed, 0.15::DOUBLE FROM x{k - 1}) GROUP BY ALL),
s{k} AS MATERIALIZED (SELECT seed, node, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM x{k - 1} FULL JOIN y{k} USING (seed, node)),
x{k} AS MATERIALIZED (SELECT seed, node, CASE WHEN stop THEN x ELSE y END AS x FROM s{k} JOIN (SELECT seed, max(abs(y - x)) < 0.01 AS stop FROM s{k} GROUP BY seed) USING (seed) WHERE CASE WHEN stop THEN x ELSE y END <> 0)"""
        for k in range(1, STEPS + 1)
    )
    return f"""{SPLIT}, {FOLLOW}, pairs AS (SELECT 'U' || "user" AS u, 'R' || item AS v FROM train {more}),
ways AS (SELECT u AS src, v AS dst FROM pairs UNION SELECT v, u FROM pairs), links AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS p FROM ways), {_TOP},
x0 AS (SELECT 'U' || "user" AS seed, 'U' || "user" AS node, 1.0::DOUBLE AS x FROM some_users){steps}"""


_FOLLOWING = "UNION SELECT 'U' || src, 'U' || dst FROM follow_edges"


def _walk_recs(more: str) -> str:
    return f"""WITH {_walk(more)}, scores AS (SELECT CAST(substr(seed, 2) AS BIGINT) AS "user", CAST(substr(node, 2) AS BIGINT) AS item, x AS score FROM x{STEPS} WHERE node LIKE 'R%')
{_top('SELECT "user", item, coalesce(score, 0) AS score FROM grid LEFT JOIN scores USING ("user", item)', 10)}"""


_FREQ = f"""{_USER_CF}, evaluable AS (SELECT DISTINCT "user" FROM train WHERE "user" IN (SELECT "user" FROM test)),
freq AS (SELECT "user", k, tp, n_items - n_train - pos - (n_truth - tp) AS tn, pos - tp AS fp, n_truth - tp AS fn FROM (
  SELECT e."user", k, count(*) FILTER (WHERE r.rank <= k) AS pos, count(*) FILTER (WHERE r.rank <= k AND t.item IS NOT NULL) AS tp FROM evaluable e CROSS JOIN (SELECT unnest([5, 10, 20]) AS k)
  LEFT JOIN recs r ON r."user" = e."user" LEFT JOIN test t ON t."user" = r."user" AND t.item = r.item GROUP BY ALL)
  JOIN (SELECT "user", count(*) AS n_truth FROM test GROUP BY "user") USING ("user") JOIN (SELECT "user", count(*) AS n_train FROM train GROUP BY "user") USING ("user") CROSS JOIN (SELECT count(*) AS n_items FROM items)),
rates AS (SELECT k, sum(tp) / nullif(CAST(sum(tp) + sum(fp) AS DOUBLE), 0) AS precision, sum(tp) / nullif(CAST(sum(tp) + sum(fn) AS DOUBLE), 0) AS recall, sum(fp) / nullif(CAST(sum(fp) + sum(tn) AS DOUBLE), 0) AS fallout FROM freq GROUP BY k),
hits AS (SELECT r."user", rank, t.item IS NOT NULL AS hit FROM recs r LEFT JOIN test t USING ("user", item)),
precisions AS (SELECT "user", sum(p) AS p FROM (SELECT "user", hit, CAST(sum(CAST(hit AS INT)) OVER (PARTITION BY "user" ORDER BY rank) AS DOUBLE) / rank AS p FROM hits) WHERE hit GROUP BY "user"),
ap AS (SELECT "user", coalesce(p / n, 0) AS ap FROM evaluable JOIN (SELECT "user", count(*) AS n FROM test GROUP BY "user") USING ("user") LEFT JOIN precisions USING ("user")),
points AS (SELECT fallout AS x, recall AS y FROM rates UNION ALL SELECT 0, 0 WHERE NOT EXISTS (SELECT 1 FROM rates WHERE fallout = 0) UNION ALL SELECT 1, 1 WHERE NOT EXISTS (SELECT 1 FROM rates WHERE fallout = 1)),
auc AS (SELECT sum(a) AS auc FROM (SELECT (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM points WINDOW w AS (ORDER BY x, y)))"""
_RATES = "round(precision, 6) AS precision, round(recall, 6) AS recall"

SQL = {
    "language_share": f"WITH {_LANGUAGES} SELECT row AS repo_id, col AS language, round(w / sum(w) OVER (PARTITION BY row), 6) AS share FROM language_features",
    "tfidf": f"WITH {_TFIDF} SELECT row AS repo_id, col AS term, round(w, 6) AS w FROM tfidf_features",
    "follower_features": f"WITH {CONTRIBUTOR}, {FOLLOW} SELECT dst AS row, src AS col FROM follow_edges WHERE dst IN (SELECT src FROM contributor_edges)",
    "followee_features": f"WITH {CONTRIBUTOR}, {FOLLOW} SELECT src AS row, dst AS col FROM follow_edges WHERE src IN (SELECT src FROM contributor_edges)",
    **{
        f"bigraph_similarity_{k}": f"WITH {SPLIT}, {_M}, {_LANGUAGES}, {_sides('language_features', 'target')} {_dot(a, b)}"
        for k, a, b in (("ss", "source", "source"), ("st", "source", "target"), ("tt", "target", "target"))
    },
    "edge_features_constant": f"WITH {CONTRIBUTOR} SELECT src, dst, 1.0::DOUBLE AS constant FROM contributor_edges",
    "edge_features_attribute": f"WITH {CONTRIBUTOR} SELECT src, dst, {_standard(('contributions',))} FROM (SELECT src, dst, CAST(coalesce(contributions, 1) AS DOUBLE) AS contributions FROM contributor_edges)",
    "edge_features_user": f"WITH {CONTRIBUTOR}, {USERS_MERGED} SELECT src, dst, {_standard(USER_KEYS)} FROM (SELECT src, dst, {_numbers(USER_KEYS)} FROM contributor_edges LEFT JOIN accounts_merged ON id = src)",
    "edge_features_repository": f"WITH {CONTRIBUTOR}, {REPOS_MERGED} SELECT src, dst, {_standard(REPOSITORY_KEYS)} FROM (SELECT src, dst, {_numbers(REPOSITORY_KEYS)} FROM contributor_edges LEFT JOIN repositories_merged ON id = dst)",
    "edge_features_language": f"""WITH {CONTRIBUTOR}, {_LANGUAGES}, share AS (SELECT row, col, w / sum(w) OVER (PARTITION BY row) AS w FROM language_features),
each AS (SELECT src, dst, col, w FROM contributor_edges JOIN share ON row = dst), total AS (SELECT count(*) AS n FROM contributor_edges),
scale AS (SELECT col, sum(w) / n AS m, sqrt(greatest(sum(w * w) / n - (sum(w) / n) * (sum(w) / n), 0)) AS s FROM each CROSS JOIN total GROUP BY col, n)
SELECT src, dst, col, round((w - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS w FROM each JOIN scale USING (col)""",
    "edge_features_similarity": f"""WITH {CONTRIBUTOR}, m AS (SELECT src AS row, dst AS col FROM contributor_edges), {_LANGUAGES}, {_sides('language_features', 'target')},
own AS (SELECT col, w FROM source WHERE row = (SELECT min(row) FROM source)),
both_sims AS (SELECT c.src, c.dst, coalesce(a.s, 0) AS sim_src, coalesce(b.s, 0) AS sim_dst FROM contributor_edges c
  LEFT JOIN (SELECT row, sum(own.w * x.w) AS s FROM own JOIN source x USING (col) GROUP BY row) a ON a.row = c.src
  LEFT JOIN (SELECT row, sum(own.w * x.w) AS s FROM own JOIN target x USING (col) GROUP BY row) b ON b.row = c.dst)
SELECT src, dst, {_standard(('sim_src', 'sim_dst'))} FROM both_sims""",
    "edge_features_combined": f"""WITH {CONTRIBUTOR}, {USERS_MERGED} SELECT src, dst, 1.0::DOUBLE AS constant, {_standard(('contributions', 'followers'))} FROM
  (SELECT src, dst, CAST(coalesce(contributions, 1) AS DOUBLE) AS contributions, {_numbers(('followers',))} FROM contributor_edges LEFT JOIN accounts_merged ON id = src)""",
    "rec_user_cf": f"""WITH {_USER_CF} SELECT * FROM recs""",
    "rec_item_cf": f"""WITH {SPLIT}, {_neighbours('item', '"user"')} {_top(f'SELECT * FROM (SELECT train."user", near.b AS item, sum(sim) AS score FROM train JOIN near ON near.a = train.item GROUP BY ALL) {_UNSEEN}', 20)}""",
    "rec_random": f"""WITH {SPLIT}, {_TOP} SELECT "user", item, rank, 0.0::DOUBLE AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY md5('42:' || "user" || ':' || item), item) AS rank FROM grid) WHERE rank <= 10""",
    "rec_language": _content(f"{_LANGUAGES}, ", "language_features", "target"),
    "rec_description": _content(f"{_TFIDF}, ", "tfidf_features", "target"),
    "rec_quasi_user": _content("", "m", "source"),
    "rec_quasi_item": _content("mt AS (SELECT col AS row, row AS col, w FROM m), ", "mt", "target"),
    "rec_follower": _content(f"{FOLLOW}, ff AS (SELECT dst AS row, src AS col, 1.0::DOUBLE AS w FROM follow_edges WHERE dst IN (SELECT \"user\" FROM users)), ", "ff", "source"),
    "rec_followee": _content(f"{FOLLOW}, ff AS (SELECT src AS row, dst AS col, 1.0::DOUBLE AS w FROM follow_edges WHERE src IN (SELECT \"user\" FROM users)), ", "ff", "source"),
    "personal_rank": f"WITH {_walk('')} SELECT seed, node, round(x, 6) AS x FROM x{STEPS}",
    "rec_random_walk": _walk_recs(""),
    "rec_random_walk_other_graph": _walk_recs(_FOLLOWING),
    "frequencies": f'WITH {_FREQ} SELECT "user", k, tp, tn, fp, fn FROM freq',
    "precision_recall": f"WITH {_FREQ} SELECT k, {_RATES}, round(fallout, 6) AS fallout FROM rates",
    "pr_curve": f"WITH {_FREQ} SELECT {_RATES} FROM rates",
    "roc_curve": f"WITH {_FREQ} SELECT round(fallout, 6) AS fallout, round(recall, 6) AS recall FROM rates UNION ALL VALUES (0.0::DOUBLE, 0.0::DOUBLE), (1.0::DOUBLE, 1.0::DOUBLE)",
    "average_precision": f'WITH {_FREQ} SELECT "user", round(ap, 6) AS ap FROM ap',
    "mean_average_precision": f"WITH {_FREQ} SELECT round(avg(ap), 6) AS map FROM ap",
    "roc_auc": f"WITH {_FREQ} SELECT round(auc, 6) AS auc FROM auc",
    "metric_report": f"WITH {_FREQ} SELECT k, {_RATES}, (SELECT round(avg(ap), 6) FROM ap) AS map, (SELECT round(auc, 6) FROM auc) AS auc FROM rates",
}


def _whole(sql: str) -> str:
    """The same with all neighbours and whole lists, for the query set's users."""
    asked = f'"user" % {QUERY_IDS} = 0'
    sql = sql.replace(" WHERE r <= 50)", ")").replace(" WHERE rank <= 20", "").replace("""IN (SELECT "user" FROM test)),""", f"""IN (SELECT "user" FROM test) AND {asked}),""")
    return sql.replace(_UNSEEN, f"{_UNSEEN} AND {asked}")


SQL |= {f"{n}_whole": _whole(SQL[n]) for n in ("rec_user_cf", "rec_item_cf", "frequencies", "precision_recall", "pr_curve", "roc_curve", "average_precision", "mean_average_precision", "roc_auc", "metric_report")}


def _family(name: str, features: str, side: str) -> str:
    near = " UNION ALL ".join(
        f"""SELECT 'U' || x.row AS "user", '{name}' AS family, '{letter}' || y.row AS node, round(sum(x.w * y.w), 6) AS sim FROM source x JOIN {other} y USING (col) WHERE x.row % {QUERY_IDS} = 0 GROUP BY x.row, y.row"""
        for letter, other in (("U", "source"), ("R", "target"))
    )
    return f"SELECT * FROM (WITH {_sides(features, side)} {near})"


_KNOWN = '(SELECT "user" FROM train)'
_FAMILIES = {
    "contributed repository": ("m", "source"), "contributor": ("mt", "target"), "language": ("language_features", "target"), "description": ("tfidf_features", "target"),
    "follower": ("fr", "source"), "followee": ("fe", "source"),
}
SQL["supervised_similarities"] = f"""WITH {SPLIT}, {_M}, {_LANGUAGES}, {_TFIDF}, {FOLLOW}, mt AS (SELECT col AS row, row AS col, w FROM m),
fr AS (SELECT dst AS row, src AS col, 1.0::DOUBLE AS w FROM follow_edges WHERE dst IN {_KNOWN}), fe AS (SELECT src AS row, dst AS col, 1.0::DOUBLE AS w FROM follow_edges WHERE src IN {_KNOWN})
{' UNION ALL '.join(_family(name, *of) for name, of in _FAMILIES.items())}"""
