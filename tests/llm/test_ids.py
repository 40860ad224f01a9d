"""Ids keep their value and type: above 2^53 beside NULL, and as text."""

import pytest

from benchlight.llm import exact, packing, quality, simhash

BIG = [2**60 + 1, None, 2**60 + 3, -(2**62) - 1]


@pytest.fixture(scope="module", params=["bigint", "string"])
def docs(request, spark, tmp_path_factory):
    ids = BIG if request.param == "bigint" else ["x9", None, "ä-1", "007"]
    texts = ["some words of a text.", "other words of a text.", "some  words of a text.", None]
    path = str(tmp_path_factory.mktemp("ids") / request.param)
    rows = list(zip(ids, texts, strict=True))
    spark.createDataFrame(rows, f"doc_id {request.param}, text string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def ids(frame, name="doc_id"):
    return sorted((r[name] for r in frame.collect()), key=repr)


def test_ids(spark, docs):
    wanted, kind = ids(docs), dict(docs.dtypes)["doc_id"]
    labels = docs.selectExpr("doc_id", "1 AS label")
    scored, packed, groups = quality.classify(docs, labels), packing.pack_documents(docs), exact.groups(docs)
    for frame in (scored, packed, groups, simhash.near_duplicates(docs)):
        assert ids(frame) == wanted
        assert dict(frame.dtypes)["doc_id"] == kind
    best = {r["doc_id"]: r["keep_id"] for r in groups.collect()}
    first = next(r["doc_id"] for r in docs.collect() if r["text"] and "  " in r["text"])
    assert {k for k, v in best.items() if v == first and k != first} == {next(r[0] for r in docs.collect())}
    assert best[None] is None
