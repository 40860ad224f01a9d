import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from benchlight.llm import rules


def repeated(words):
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)})


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "dd"]), max_size=40), min_size=1, max_size=30))
def test_repeated_words(spark, lists):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, w array<string>")
    got = {r["i"]: r["n"] for r in df.select("i", rules.repeated_words(F.col("w")).alias("n")).collect()}
    assert got == {i: repeated(w) for i, w in enumerate(lists)}


def test_lines(spark):
    prose = "This is a plain sentence that says something of use to a reader."
    lines = {
        prose: True,
        "Home | About | Contact | Help": False,
        "WIN!! BIG!! NOW!! HERE!!": False,
        "a### b%%% c$$$ d*** e&&&": False,
        "Menu": False,
        "Yes.": True,
        "Please ENABLE JavaScript to go on reading this page here.": False,
        "All Rights Reserved.": False,
        "A line of more than four words without any stop": True,
    }
    for line, stays in lines.items():
        body = "\n".join([prose, prose + " Really.", line])
        row = rules.judge(spark.createDataFrame([(body,)], "text string")).first()
        assert (row["lines_removed"] == 0) == stays, line
        assert (line in row["cleaned"].split("\n")) == stays


def test_prose_with_the_letters_of_phrases(spark):
    """Phrases are whole words in short lines; prompts end no sentence."""
    prose = [
        "We came back to the design in question before the meeting was over.",
        "Each dialog in the novel shows how little the two of them understand.",
        "The bakers bread more often when the mill is busy, or so they say.",
        "She learned to read more every day.",
        "He asked her to log in.",
        "The long letter, which nobody had asked him for, explained to all of us what the privacy policy of the firm was worth.",
    ]
    docs = spark.createDataFrame([("\n".join(prose),)], "text string")
    row = rules.judge(docs).first()
    assert row["kept"] and row["lines_removed"] == 0 and row["cleaned"].split("\n") == prose
    for line in ("Log in", "Sign in to your account", "Please read more", "See our Privacy Policy.", "SKIP TO CONTENT"):
        row = rules.judge(spark.createDataFrame([("\n".join([*prose, line]),)], "text string")).first()
        assert row["lines_removed"] == 1, line


def test_losing_too_much(spark):
    prose = " ".join(f"word{i}" for i in range(30)) + "."
    menu = " | ".join(f"Item{i}" for i in range(20))
    docs = spark.createDataFrame([(1, prose + "\n" + menu), (2, menu + "\n" + prose + "\n" + menu)], "id int, text string")
    kept = {r["doc"]["id"]: (r["kept"], r["base_failed"]) for r in rules.judge(docs).collect()}
    assert kept[1][0] is False and kept[2][0] is False
    docs = spark.createDataFrame([(1, prose + "\n" + "Home | Help | Menu")], "id int, text string")
    row = rules.clean(docs, length=None).first()
    assert row["text"] == prose


def test_text_without_blanks_stays(spark):
    for line in ("今天的天气非常好，我们一起去公园散步。", "彼は「もう帰ります」と言った。", "増加率は5%で、A=Bとなる。",
                 "他问：“你去哪里？”", "วันนี้อากาศดีมากเราไปเดินเล่นกัน"):
        body = "\n".join(f"{i}{line}" for i in range(25))
        docs = spark.createDataFrame([(body, len(body))], "text string, n_chars bigint")
        assert [r["text"] for r in rules.clean(docs).collect()] == [body], line


def test_short_lines_of_other_scripts(spark):
    prose = "This is a plain sentence that says something of use to a reader."
    lines = {"मैं जाता हूँ।": True, "هل أنت؟": True, "首页": False, "ホーム": False, "मैं जाता हूँ": False}
    for line, stays in lines.items():
        row = rules.judge(spark.createDataFrame([(f"{prose}\n{line}",)], "text string")).first()
        assert (row["lines_removed"] == 0) == stays, line


def test_lines_without_a_word_stay(spark):
    prose = " ".join(f"word{i}" for i in range(30)) + "."
    other = prose.replace("word", "thing")
    bodies = {f"{prose}\n\n \n{other}\n": None, f"\n{prose}\n\nMenu\n\n{other}": "Menu\n"}
    for body, gone in bodies.items():
        row = rules.clean(spark.createDataFrame([(body, 0)], "text string, n_chars bigint")).first()
        assert row["text"] == (body.replace(gone, "") if gone else body)
        assert row["n_chars"] == len(row["text"])


def test_clean_keeps_columns(odd, none):
    for docs in (odd, none):
        cleaned = rules.clean(docs)
        assert cleaned.dtypes == docs.dtypes
        rows = cleaned.collect()
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        assert all(len(re.findall(r"\S+", r["text"])) >= rules.MIN_WORDS for r in rows)


def test_no_python(odd):
    plan = rules.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
