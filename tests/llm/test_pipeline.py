"""The pipeline's stages against their operators and plain Python."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        from sluice.llm.common import durable

        docs = durable(stage(spark, docs, SF), name)
        out.append((name, docs))
    return out


def test_columns_and_rows(spark, stages):
    docs = stages[0][1]
    for name, df in stages[1:-1]:
        assert df.columns == docs.columns, name
        assert [f.dataType for f in df.schema.fields] == [f.dataType for f in docs.schema.fields]
    ids = [{r["doc_id"] for r in df.select("doc_id").distinct().collect()} for _, df in stages]
    for before, after in zip(ids, ids[1:], strict=False):
        assert after <= before
    assert ids[2] == ids[3] and ids[4] == ids[5]


def test_line_stage_keeps_n_chars(stages):
    for r in stages[3][1].collect():
        assert r["n_chars"] == len(r["text"])


def test_good_documents_stay(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in df.collect()} for _, df in stages[1:3])
    clean = [k for k in before if labels.get(k) == 1]
    assert len([k for k in clean if k in after]) >= 0.95 * len(clean)


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[-1][1].collect()))


def test_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as score", "2 as lang_pred", "3 as predicted", "4 as n_lines", "5 as fp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).count() > 0, name


def test_entry_without_the_subpackage(monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("sluice.llm", "corpus_pipeline")) else real(name, *a))
    names = __spark_entry__.queries()
    assert "flagship" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
