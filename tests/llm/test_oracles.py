"""Published queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest
from test_queries import SF, _rows

from benchlight.llm.oracle import ORACLES
from benchlight.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(SF, name)}.parquet'")
    return con


def test_names():
    assert set(ORACLES) < set(QUERIES)
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    expected = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert _rows(got) == _rows(expected)


OTHER_TABLES = {"op12_shared_search", "op13_prefix_trie"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - OTHER_TABLES))
def test_odd_documents(spark, odd, name, tmp_path):
    """The same on awkward rows, with and without any."""
    for part, docs in (("some", odd), ("none", odd.limit(0))):
        folder = str(tmp_path / part)
        docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        got = QUERIES[name](spark, folder).toPandas()
        expected = con.execute(ORACLES[name]).df()
        if name == "op10_exact_index":  # two rows alike: either may stay
            got, expected = got.drop(columns="kept"), expected.drop(columns="kept")
            rank = ["text_sha256", "group_size"]
            got, expected = got[got.keep_id.notna()][rank], expected[expected.keep_id.notna()][rank]
        assert _rows(got) == _rows(expected)


def test_rules_in_other_scripts(spark, tmp_path):
    """Query and SQL count alike where no blanks stand between words, and fold the same letters."""
    lines = ["今天的天气非常好，我们一起去公园散步", "首页", "ホーム", "彼は「もう帰ります」と言った。", "增加率は5%で、A=Bとなる", "วันนี้อากาศดีมาก",
             "हम जाते हैं।", "هل أنت بخير اليوم", "هل أنت؟", "ສະບາຍດີ", "မင်္ဂလာပါ ခင်ဗျာ", "한국어 문장입니다.", "𠀀𠀁𠀂𠀃 𠮷野家", "ꦱꦸꦒꦼꦁ", "Log in",
             "LOG İN", "log in!", "design in", "ﬁ log in é", "éread more", "read more", "Ꙁ|Ꙃ|Ꙅ|Ꙇ", "Sıgn in", "terms of use"]
    body = "\n".join(lines)
    texts = [body, *[f"{line}\n" * 3 + "word " * 30 for line in lines], *[" ".join(f"{x}{i}" for i in range(30)) for x in lines]]
    folder = str(tmp_path / "scripts")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    name = "op5_line_first_rules"
    assert _rows(QUERIES[name](spark, folder).toPandas()) == _rows(con.execute(ORACLES[name]).df())
