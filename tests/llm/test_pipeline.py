import os

import corpus_pipeline as cp
from quernstone.llm import repetition
from quernstone.llm.decontaminate import find_contamination
from tests.llm.test_line_align import brute as brute_lines
from tests.llm.test_near_dup import brute as brute_groups


def test_stages_one_after_the_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r for r in after.collect()}
        assert rows and set(rows) <= set(before)
        if name != "mixture":
            assert after.columns == columns
            assert after.dtypes == docs.dtypes
        if name == "quality_rules":
            kept = {r.doc_id for r in repetition.repetition_rules(docs).filter("kept").collect()}
            assert set(rows) == kept and len(kept) < len(before)
        elif name == "line_dedup":
            left = {i: t for i, _, _, t in brute_lines([(i, r.text) for i, r in before.items()])}
            assert {i: r.text for i, r in rows.items()} == {i: t for i, t in left.items() if t.encode().split()}
            assert all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "near_dedup":
            assert set(rows) == {g[0] for g in brute_groups([(i, r.text) for i, r in before.items()]) if g[3]}
        elif name == "decontamination":
            bad = find_contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").select("doc_id")
            assert set(rows) == set(before) - {r.doc_id for r in bad.collect()}
        else:
            assert set(rows) == set(before) and all(r.rate >= 0 for r in rows.values())
            assert all(r.text == before[i].text for i, r in rows.items())
        docs = after


def test_run_is_the_stages(spark, sf):
    got = cp.run(spark, sf)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "domain", "posterior", "rate"] and got.count() > 50
    folder = got.inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
    assert os.listdir(folder) == ["4-mixture"]


PLAIN = "a b c d e f g h i j k l m"


def test_awkward_rows_in_every_stage(spark, sf):
    schema = "doc_id long, text string, kept_id string, lines string, rate string, n_chars long"
    rows = [(None, PLAIN, "x", "l", "r", 1), (1, PLAIN, "y", "l", "r", 1), (2, PLAIN, "z", None, None, None), (2, PLAIN, "z", None, None, None), (3, None, "n", "l", "r", 0), (4, "", "e", "l", "r", 0)]
    docs = spark.createDataFrame(rows, schema)
    ids = lambda name: sorted(str(r.doc_id) for r in dict(cp.STAGES)[name](spark, docs, sf).collect())
    assert ids("quality_rules") == ["1", "2", "2", "None"]
    assert ids("line_dedup") == ["1", "None"]
    assert ids("near_dedup") == ["1", "3", "4", "None"]
    assert ids("decontamination") == ids("mixture") == ["1", "2", "2", "3", "4", "None"]
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []
        got = stage(spark, docs, sf)
        assert set(docs.columns) <= set(got.columns)
