"""Each stage on its own input, and all of them in a row."""

import corpus_pipeline
import pytest

from benchlight.llm import exact, mixing, packing, rules, simhash

SF = "/root/testdata/sf0.001"


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "simhash_dedup", "source_mix", "packing_plan"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage(spark, texts, tmp_path):
    docs = texts
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing_plan":
            assert after.dtypes == texts.dtypes
        seen[name] = (docs, after)
        docs = after
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())

    before, after = seen["quality_rules"]
    assert ids(after) == sorted(r["doc"]["doc_id"] for r in rules.judge(before).filter("kept").collect())
    before, after = seen["exact_dedup"]
    assert ids(after) == sorted({r["keep_id"] for r in exact.groups(before).collect()})
    before, after = seen["simhash_dedup"]
    assert ids(after) == sorted({r["component_id"] for r in simhash.near_duplicates(before).collect()})
    before, after = seen["source_mix"]
    assert ids(after) == sorted(r["doc_id"] for r in mixing.taken(before).collect() for _ in range(r["copies"]))
    before, after = seen["packing_plan"]
    total = sum(len(r["text"].split()) + 1 for r in before.collect())
    assert sum(r["length"] for r in after.collect()) == total

    key = lambda df: sorted((r["doc_id"], r["start"], r["length"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(after)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_odd_rows(spark, request, which, tmp_path):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {"doc_id", "sequence", "capacity"} <= set(docs.columns)
    assert packing.CAPACITIES[0] == 512
