"""All queries of the core."""

from kithgraph.plans import crawling, crawling_sql, files, files_sql, graphs, graphs_sql, models, problems, problems_sql, recommenders, recommenders_sql, responses, responses_sql

QUERIES = {**problems.QUERIES, **graphs.QUERIES, **recommenders.QUERIES, **crawling.QUERIES, **responses.QUERIES, **files.QUERIES, **models.QUERIES}
SQL = {**problems_sql.SQL, **graphs_sql.SQL, **recommenders_sql.SQL, **crawling_sql.SQL, **responses_sql.SQL, **files_sql.SQL}
FLAGSHIP = "metric_report"
