"""Queries against their SQL on the smallest tables, and the rest against other tools."""

from pathlib import Path

import pytest
from compare import same

from kithgraph.llm import queries
from kithgraph.sources.tables import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name], FOLDER)


def test_every_query_runs_and_has_its_columns(spark):
    want = {"p1_found": ["language_a", "language_b"], "p5_found": ["line_no", "field", "ref_id"], "p6_found": ["repo_id", "term"], "p7_found": ["entity", "id", "field", "line_no"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "eval_id"], "p10_found": ["doc_id"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, FOLDER).columns == columns


def test_every_value_of_an_account_gets_one_row(spark):
    from pyspark.sql import functions as F

    from kithgraph.functions.text import has_text

    rows = table(spark, FOLDER, "account")
    got = {r.field: r.n for r in queries.p5_found(spark, FOLDER).groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {f: rows.where(has_text(F.col(f))).count() for f in ("location", "company")}


def test_ids_as_the_tokenizers_library_gives_them(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in queries.p8_ids(spark, FOLDER).collect()}
    assert got == {k: t.encode(v or "", add_special_tokens=False).ids for k, v in docs.items()}


def test_every_claimed_field_of_both_entities_is_fused(spark):
    from pyspark.sql import functions as F

    from kithgraph.functions.text import has_text

    got = {(r.entity, r.id, r.field) for r in queries.p7_fused(spark, FOLDER).collect()}
    want = set()
    for entity, fields in queries.FIELDS.items():
        rows = table(spark, FOLDER, entity).where(F.col("id").isNotNull())
        for f in fields:
            want |= {(entity, r.id, f) for r in rows.where(has_text(F.col(f))).select("id").distinct().collect()}
    assert got == want and {e for e, *_ in got} == {"account", "repository"}
