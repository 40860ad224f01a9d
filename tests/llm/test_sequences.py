import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from benchlight.llm import sequences  # noqa: E402
from benchlight.session import shared_folder  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("which", ["odd", "texts"])
def test_round_trip(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0]))
    got = sorted(map(tuple, sequences.round_trip(docs, PATH, 1).collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_no_rows(none):
    assert sequences.round_trip(none, PATH, 1).collect() == []


@pytest.mark.parametrize(
    "text",
    ["It's x's,'s 'S, DON'T. don't.", "A<|startoftext|>B <|STARTOFTEXT|> <|endoftext|>", "«éa,» é. é, 3.14, a.b, .a ,",
     "ΑΣ, ΣΑΣ. İI ſt ﬁ", "a\x1cb\x85c d e", "日本, 語。 🙂. x̸, ̸. ...,,, a.,", "﻿a, \x00b."],
)
def test_words_make_up_texts(text):
    """Word by word the ids are those of the whole text."""
    encode = sequences.encoder(PATH, True)
    ids = np.frombuffer(encode.encode([text.encode()], 1)[0], encode.kind)
    whole = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == [*whole, 1]


def test_capitals_with_marks():
    """Letters are lowered after they are composed: of some only the small one composes."""
    encode, tokenizer = sequences.encoder(PATH, True), Tokenizer.from_file(PATH)
    named = ["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c", "H\u0331ASAN said Mut\u0323T\u0308a, J\u030c."]
    marked = [a + chr(m) for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in range(0x300, 0x370)]
    texts = named + marked
    for text, got in zip(texts, encode.encode([t.encode() for t in texts], 1), strict=True):
        whole = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, encode.kind).tolist() == [*whole, 1], ascii(text)


def test_files_hold_equal_sequences(spark, texts):
    folder = shared_folder(spark)
    manifest = sequences.write(texts, folder, PATH, 1, sequence=128).orderBy("part").collect()
    tokenizer = Tokenizer.from_file(PATH)
    rows = sorted((r["doc_id"], r["text"]) for r in texts.collect())
    at = 0
    for m in manifest:
        batches = list(sequences.open_file(folder, m["file"]))
        assert len({b.num_rows for b in batches[:-1]}) <= 1
        flat = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=True) for b in batches])
        mask = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in batches])
        assert len(flat) == 128 * m["n_sequences"] and mask.sum() == m["n_tokens"]
        assert mask[: m["n_tokens"]].all() and not flat[m["n_tokens"] :].any()
        # Any sequence by its number, without a copy of the file.
        third = sequences.open_file(folder, m["file"]).read_all().slice(2, 1)
        assert third.column(0).chunk(0).flatten().to_pylist() == flat[256:384].tolist()
        ids = [i for _, t in rows[at : at + m["n_docs"]] for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 1]]
        assert flat[: m["n_tokens"]].tolist() == ids
        at += m["n_docs"]
    assert at == len(rows)


def test_file_urls():
    for folder in ("file:///tmp/a/b", "file:/tmp/a/b", "/tmp/a/b"):
        assert re.fullmatch("/tmp/a/b", sequences._place(folder)[1])


def test_random_words():
    """Letters of all scripts, some that lowering takes apart, before and after marks."""
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x80, 0x2FA20) if unicodedata.category(chr(c))[0] in "LMN"]
    cased = [c for c in letters if c.lower() != c or c.upper() != c]
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def word():
        of = rng.choice([letters, cased, "aeiouDIİıßKÅΣς", "abcdefghIJKS's"])
        body = "".join(rng.choice(of) for _ in range(rng.randint(1, 5)))
        body += rng.choice(["", "", chr(rng.randint(0x300, 0x36F))])
        return body + "".join(rng.choice(marks) for _ in range(rng.choice([0, 1, 1, 2])))

    texts = ["BELKİ!", "DENİZLİ, ve", *[c + m for c in cased for m in "!'<"]]
    texts += [rng.choice([" ", "\n", " \t"]).join(word() for _ in range(rng.randint(1, 4))) for _ in range(10_000)]
    encode, tokenizer = sequences.Encoder(PATH, True), Tokenizer.from_file(PATH)
    whole = tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, got, ids in zip(texts, encode.encode([t.encode() for t in texts], 1), whole, strict=True):
        assert np.frombuffer(got, encode.kind).tolist() == [*ids.ids, 1], ascii(text)


def test_words_in_use_are_not_forgotten_early(monkeypatch):
    """Only words that are new count towards those a worker remembers; forgotten ones get their ids again."""
    monkeypatch.setattr(sequences, "REMEMBERED", 300)
    encode, tokenizer = sequences.Encoder(PATH, True), Tokenizer.from_file(PATH)
    first = " ".join(f"{a}{b}{a}" for a in "abcdefghij" for b in "klmnopqrstuvwxyzàéö")
    texts = [first, first, first.replace("a", "e") + " ab, Ab. é!", first + " ab, ab; é?", first]
    for i, text in enumerate(texts):
        got = np.frombuffer(encode.encode([text.encode()], 1)[0], encode.kind)
        assert got.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert i > 1 or not encode.older


def test_the_manifest_is_one_file(spark, texts):
    """However many tasks write sequences, and however few rows each adds to the manifest."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = sequences.write(texts, shared_folder(spark), PATH, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1
    assert len(manifest.inputFiles()) == 1


def test_words_known_are_not_gone_through(monkeypatch):
    """A text with a new word looks up its own words, each once, and not all that a worker remembers."""
    encode = sequences.Encoder(PATH, True)
    encode.encode([" ".join(f"{a}{b}{c}{d}" for a in "abcdefgh" for b in "klmnopqr" for c in "aeiouy" for d in "stvwz").encode()], 1)
    looked_up = []

    class Known(dict):
        def __iter__(self):
            raise AssertionError("all known words are gone through")

        def get(self, word, *other):
            looked_up.append(word)
            return super().get(word, *other)

    encode.known = Known(encode.known)
    text = " akas, Quixotic! akas\n\tquixotic zebra " + "akas " * 1000
    for _ in range(2):
        got = np.frombuffer(encode.encode([text.encode()], 1)[0], encode.kind)
        assert got.tolist() == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1]
    assert len(looked_up) == 2 * len({b"", *text.lower().encode().split()})


def test_texts_are_encoded_some_at_a_time(monkeypatch):
    """However few bytes are taken at once, a text's ids are those of the whole text."""
    texts = [None, "", " \t", " a  b ", "Ab. é! İ, BELKİ!", "x" * 100, "<|endoftext|> A", "H\u0331ASAN said"] * 3
    tokenizer = Tokenizer.from_file(PATH)
    for size in (0, 10, 1 << 20):
        monkeypatch.setattr(sequences, "ENCODED_BYTES", size)
        encode = sequences.Encoder(PATH, True)
        for text, got in zip(texts, encode.encode([t and t.encode() for t in texts], 1), strict=True):
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(got, encode.kind).tolist() == [*ids, 1]
