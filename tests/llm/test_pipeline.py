"""The pipeline, stage by stage, against plain versions; and the registered queries."""

import importlib
import os
from collections import Counter

import duckdb
import pytest

from loomframe.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        after = out.collect()
        assert {r.doc_id for r in after} <= set(before)
        if name == "quality_rules":
            good = {r.doc_id for r in queries.quality.quality(docs).collect() if r.kept}
            assert {r.doc_id for r in after} == good
        if name == "near_dedup":
            from test_near import brute

            keep = {c for _, c in brute([(r.doc_id, r.text) for r in before.values()])[0]}
            assert {r.doc_id for r in after} == keep
        if name == "decontaminate":
            hit = {r.doc_id for r in queries.decontamination.contaminated(docs, queries.table(spark, SF, "benchmark")).collect()}
            assert {r.doc_id for r in after} == set(before) - hit
        if name == "shard":
            assert len(after) == docs.count() and set(out.columns) == {*columns, "slot", "shard"}
        else:
            assert out.columns == columns
        docs = out
    assert docs.count() == corpus_pipeline.run(spark, SF).count()


def test_registered(spark):
    assert {q.split("_")[0] for q in queries.QUERIES} == {*(f"op{n}" for n in range(1, 11)), "pipeline"}
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_results_outlive_the_next_stage_and_tables_are_owned(spark):
    """A stage's lazy result can be read after later stages; nothing is left once its owner has cleared up."""
    import corpus_pipeline
    from loomframe.llm import common

    common.clear_cuts(spark)
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = queries.table(spark, SF, "documents")
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    once = corpus_pipeline.near_dedup(spark, docs, SF)
    assert 0 < good.count() < docs.count() and 0 < once.count() < docs.count()
    common.clear_cuts(spark)
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(common.cuts(spark)) <= 2
    common.clear_cuts(spark)
    assert set(os.listdir(folder)) <= before


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, odd, none, stage):
    """Nulls, repeated rows, empty and long texts, clashing columns; and no rows at all."""
    import corpus_pipeline

    name, fn = corpus_pipeline.STAGES[stage]
    bench = "/root/testdata/sf0.001"
    out, empty = fn(spark, odd, bench), fn(spark, none, bench)
    assert empty.count() == 0
    rows = out.collect()
    if name == "shard":
        assert out.columns == [*odd.columns, "slot", "shard"] and len(rows) == odd.count()
    else:
        assert out.columns == odd.columns and rows
        given = Counter(map(repr, odd.collect()))
        assert all(n <= (3 if name == "mix_sources" else 1) * given[r] for r, n in Counter(map(repr, rows)).items())
    if name == "near_dedup":
        assert len({r.text or "" for r in rows}) == len(rows)
    if name in ("quality_rules", "mix_sources"):
        assert all(r.text and r.text.split() for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found, out = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(out.columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(out.project(", ".join(columns)).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["op1_robust_quality", "op9_spaced_seed_decontamination"])
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_has_them():
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.QUERIES) <= set(entry.queries())
