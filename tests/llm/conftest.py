import pytest

LONG = " ".join(f"word{i % 977} thing{i % 13}." for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Documents of every awkward sort, with columns that clash with names used inside."""
    rows = [
        (1, "The cat sat on the mat and looked at the dog. It was warm.", "en", "a", 10, "x", 1.0, "k"),
        (2, "The cat sat on the mat and looked at the dog. It was warm.", "en", "b", 10, "y", 2.0, "k"),
        (3, None, "en", "a", None, "x", None, None),
        (4, "", "en", "a", 0, "x", 1.0, None),
        (5, " \t\n\x0b\x0c\r ", None, None, 7, "x", 1.0, "k"),
        (6, "one", "de", "a", 3, "x", 1.0, "k"),
        (6, "one", "de", "a", 3, "x", 1.0, "k"),
        (7, LONG, "en", "c", len(LONG), "x", 1.0, "k"),
        (8, LONG + " More words at the end.", "en", "c", len(LONG) + 23, "x", 1.0, "k"),
        (None, "one", "de", "a", 3, "x", 1.0, "k"),
        (None, "Große Füße, élan vital; 日本語 text.\nSecond line here.", "de", None, 3, "x", 1.0, "k"),
        (-9, "o n\te", "de", "a", 5, "x", 1.0, "k"),
    ]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint,"
        " row string, size double, doc string"
    )
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
