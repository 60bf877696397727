"""The pipeline's stages in order on the small tables, and the catalogue with and without the subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract
import corpus_pipeline
from tidepanel.llm.common import table

REPO = Path(__file__).parents[2]


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == columns and dict(kept.dtypes) == dict(docs.dtypes), name
        before, docs = docs.count(), kept.cache()
        assert 0 < docs.count() <= before
    packed = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_take_an_empty_table(spark, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, sf, "documents").limit(0), sf).count() == 0


def test_all_dealt_queries_are_registered():
    names = contract.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_catalogue_without_the_subpackage():
    code = (
        "import importlib.util as u, sys\n"
        "find = u.find_spec\n"
        "u.find_spec = lambda name, *a: None if name in ('tidepanel.llm', 'corpus_pipeline') else find(name, *a)\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op6_') for n in q) and 'asof_7d' in q\n"
        "assert not any(n.startswith('tidepanel.llm') for n in sys.modules); e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
