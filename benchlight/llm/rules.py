"""Quality rules, lines first: drop failing lines, then documents that lose too much.

Built from DataFrame functions alone. Each document is judged in its own row, so there
is no shuffle and a hot source or a pile of copies costs what its rows cost.

Text NULL or without a word: zero words, ``base_failed``. Rows that repeat, ids that
repeat or are NULL: each row gets its own verdict. A very long text is judged whole, in its
row's memory. An empty table gives an empty result. Other columns pass through ``clean``
untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlight.llm.texts import BLANKS, WORD, let, n_words, packed, whole, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

# A line may lose its place for one of three reasons.
# Punctuation: no sentence ends it although it is short, or marks crowd its words.
SENTENCE_END = (
    ".!?…:;\"'”»)]"
    "。．｡！？：；︒‥‼⁇⁈⁉」』】〕〗〉》）］｝｣’"  # Chinese, Japanese, Korean
    "؟؛۔։׃।॥።፧፨។៕།༎၊။᠃꓿꘎"  # Arabic, Armenian, Hebrew, Indic, Ethiopic, Khmer, Tibetan, Burmese, ...
    "\u037e\u0387"  # Greek
)
SHORT_LINE_WORDS = 4
# Scripts without blanks between words, by ranges that every pattern syntax knows: Thai, Lao,
# Tibetan, Burmese, Khmer, Tai, Balinese, Kana, Bopomofo, Chinese characters, Yi, Javanese.
# So many of their code points are taken for a word.
UNSPACED = (
    r"[\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{1950}-\x{19FF}\x{1A20}-\x{1AAF}\x{1B00}-\x{1B7F}"
    r"\x{3005}-\x{3007}\x{3040}-\x{312F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{A980}-\x{A9DF}"
    r"\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
)
UNSPACED_PER_WORD = 2
CROWDING = r"[#*$%&<>!?~^_=+{}\\]"
# Navigation: items with separators between them.
SEPARATOR = "[|»›•·>]"
MIN_SEPARATORS = 2
# Boilerplate: stock phrases of pages, as whole words in a short line. Prose can hold the
# prompts too, so those count only in a line that doesn't end as a sentence does.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "use of cookies",
    "accept all cookies",
    "enable javascript",
    "javascript is disabled",
    "javascript is required",
    "lorem ipsum",
    "subscribe now",
    "skip to content",
    "skip to main content",
    "back to top",
)
PROMPTS = ("click here", "sign in", "log in", "subscribe to", "read more", "follow us")
BOILERPLATE_WORDS = 12
PROMPT_WORDS = 6
MAX_LOST_PERCENT = 50


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside a window of eight that the text holds twice or more, the first too.

    A window is known by a 64-bit hash, built by doubling: of words, pairs, fours and
    eights. Only a text in which some hash repeats is sorted, to find which positions
    the repeated windows cover.
    """
    if window != 8:
        raise ValueError("windows are built by doubling up to eight words")

    def joined(hashes: Column, step: int) -> Column:
        return let(
            hashes,
            lambda a: F.transform(
                F.slice(a, F.lit(1), F.greatest(F.size(a) - step, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(a, i + step)),
            ),
        )

    def covered(eights: Column) -> Column:
        pairs = F.sort_array(F.transform(eights, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda p: F.filter(
                p,
                lambda x, k: F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))
                | ((k > 0) & F.coalesce(F.get(p, F.greatest(k - 1, F.lit(0)))["h"] == x["h"], F.lit(False))),
            ),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(
            starts,
            lambda s: F.aggregate(
                F.transform(
                    s,
                    lambda q, k: F.least(F.lit(window), F.coalesce(F.get(s, k + 1) - q, F.lit(window))),
                ),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
        )

    ones = F.transform(tokens, lambda w: F.xxhash64(w))
    eights = joined(joined(joined(ones, 1), 2), 4)
    return let(
        eights,
        lambda e: F.when(F.size(F.array_distinct(e)) < F.size(e), covered(e)).otherwise(
            F.lit(0).cast("long")
        ),
    )


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """A pattern for any of the phrases as whole words, in small letters."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(phrases) + r")([^\p{L}\p{N}_]|$)"


def may_hold_phrase(text: Column) -> Column:
    """Whether the letters of a stock phrase stand in the text: a cheap test before its lines'."""
    return let(
        F.lower(text),
        lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE + PROMPTS]),
    )


def line_fails(line: Column, suspect: Column) -> Column:
    """Whether a line with a word breaks a punctuation, navigation or boilerplate rule.

    Phrases are looked for only in the lines of a ``suspect`` text, one that holds the letters
    of such a phrase. Where a script sets no blanks between words, code points stand in for them.
    """
    unspaced = F.when(
        F.octet_length(line) > F.char_length(line), F.regexp_count(line, F.lit(UNSPACED))
    ).otherwise(F.lit(0))
    n = F.regexp_count(line, F.lit(WORD)) + F.floor(unspaced / UNSPACED_PER_WORD)
    last = F.substring(F.rtrim(line, F.lit(BLANKS)), -1, 1)
    unended = ~last.isin(*SENTENCE_END)
    marks = F.regexp_count(line, F.lit(CROWDING))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    crowded = (marks > 0) & (marks * 2 > n)
    navigation = (separators >= MIN_SEPARATORS) & (separators * 4 > n)
    low = F.translate(line, ascii_uppercase, ascii_lowercase)
    stock = (n <= BOILERPLATE_WORDS) & low.rlike(phrase_pattern(BOILERPLATE))
    prompt = unended & (n <= PROMPT_WORDS) & low.rlike(phrase_pattern(PROMPTS))
    return (unended & (n < SHORT_LINE_WORDS)) | crowded | navigation | (suspect & (stock | prompt))


def judge(docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The rows as ``doc`` beside ``cleaned``, what remains of the text, and the verdict.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``
    describe the whole text; ``kept_words`` counts those of the lines that stay.
    ``kept`` is false for a text that fails the base rules or loses more than
    ``max_lost_percent`` of its words with its lines. Lines without a word stay in place.
    """
    body = whole(text)
    split = packed(docs, body=body, tokens=words(body))
    lines = F.split(F.col("body"), "\n", -1)
    counted = split.select(
        "doc",
        F.size("tokens").cast("long").alias("n_words"),
        F.char_length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("body"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_words(F.col("tokens")).alias("n_repeat_words"),
        lines.alias("lines"),
        may_hold_phrase(F.col("body")).alias("suspect"),
    )
    verdicts = counted.withColumn(
        "staying", F.filter("lines", lambda x: ~x.rlike(WORD) | ~line_fails(x, F.col("suspect")))
    ).withColumn("worded", F.filter("lines", lambda x: x.rlike(WORD)))
    removed = (F.size("lines") - F.size("staying")).cast("long")
    measured = verdicts.select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        removed.alias("lines_removed"),
        F.array_join("staying", "\n").alias("cleaned"),
    ).withColumn(
        "kept_words",
        F.when(F.col("lines_removed") == 0, F.col("n_words")).otherwise(n_words(F.col("cleaned"))),
    )
    base = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    lost = (F.col("n_words") - F.col("kept_words")) * 100 > F.col("n_words") * max_lost_percent
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & ~lost)


def clean(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents that stay, with the lines that stay; the columns are those of ``docs``.

    ``length`` names a column that holds the text's length, if the table has one.
    """
    # The row's number keeps the filter above the verdict, which is costly. Moved below it,
    # as Spark would otherwise do, it would work out the verdict a second time.
    judged = judge(docs, text).withColumn("row", F.monotonically_increasing_id())
    rows = judged.filter("kept AND row >= 0")
    new = {text: F.col("cleaned"), length: F.char_length("cleaned").cast("long")}
    return rows.select(
        *[
            (new[f.name].cast(f.dataType) if f.name in new else F.col("doc").getField(f.name)).alias(f.name)
            for f in docs.schema.fields
        ]
    )
