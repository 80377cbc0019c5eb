"""Registered queries of the subpackage on the smallest tables, and the pipeline stage by stage."""

import os
import re
import sys
import zlib

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from check import compare, connect  # noqa: E402
from recquarry.llm import queries, url_filter  # noqa: E402
from recquarry.llm.common import table  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql_twins(spark, con, name):
    assert compare(queries.QUERIES[name](spark, SF), con, queries.SQL[name]) is None


def test_names():
    numbers = {re.match(r"op(\d+)_", n).group(1) for n in queries.QUERIES if n != "pipeline"}
    assert numbers == {str(i) for i in range(1, 14)} and "pipeline" in queries.QUERIES


def test_native_plans(spark):
    for name in ("op3_decontamination", "op7_line_dedup", "op9_url_filter"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan), name


@pytest.mark.parametrize("name, columns", [("op2_toxicity", ["doc_id", "held_out", "score", "predicted"]), ("op10_language_id", ["doc_id", "held_out", "lang_pred", "score"])])
def test_learned_queries(spark, name, columns):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count() and rows[0].__fields__ == columns
    modulus, rest = (5, 0) if name.startswith("op2") else (4, 2)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1
    if name.startswith("op10"):
        truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
        held = [r for r in rows if r.held_out]
        assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_url_query_keeps_every_page(spark):
    rows = queries.QUERIES["op9_url_filter"](spark, SF).collect()
    assert len(rows) == table(spark, SF, "pages").count()
    assert {r.verdict for r in rows} <= {"allow", "block"}
    assert url_filter.ORDER == 4


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows = out.collect()
        left = {r.doc_id for r in rows}
        assert len(rows) == len(left) and left <= ids, name
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns, name
        else:
            assert left == ids
        docs, ids = spark.createDataFrame(rows, out.schema), left
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_removes_what_its_operators_find(spark):
    docs = table(spark, SF, "documents")
    exact = {r.doc_id for r in corpus_pipeline.keep_one_copy(spark, docs, SF).collect()}
    assert exact == {r.doc_id for r in queries.QUERIES["op8_exact_dedup"](spark, SF).where("kept").collect()}
    near = {r.doc_id for r in corpus_pipeline.keep_one_near_copy(spark, docs, SF).collect()}
    assert near == {r.class_id for r in queries.QUERIES["op6_minhash_dedup"](spark, SF).collect()}
    clean = {r.doc_id for r in corpus_pipeline.keep_uncontaminated(spark, docs, SF).collect()}
    assert clean == {r.doc_id for r in queries.QUERIES["op3_decontamination"](spark, SF).where("not contaminated").collect()}
