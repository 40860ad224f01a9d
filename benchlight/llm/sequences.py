"""Token ids as equal-length sequences in Arrow stream files.

Documents are dealt out by ranges of their id, so that file after file, and sequence
after sequence inside a file, follow the ids in ascending order. Each task writes one
file: record batches of one size whose columns are

* ``input_ids``: a fixed-size list of the narrowest unsigned type the vocabulary fits,
* ``mask``: a fixed-size list of booleans, false on the padding that ends a file,
* ``doc_ids`` and ``doc_starts``: the documents that start in the sequence, and where.

A memory-mapped file is read without a copy, and any sequence or mask is a slice.

A task writes under a name of its own attempt and renames the file when it is complete;
a repeated task puts the same contents in the same place. The manifest is a table with
one row per file.

NULL and empty texts have the end id alone; a very long text is encoded whole. Ids are whole
numbers; NULL ids come first, rows of one id in the table's order. An empty table gives no
files and no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchlight.llm.texts import row_number
from benchlight.session import settle, shared_folder

SEQUENCE = 2048
BATCH_SEQUENCES = 256
# Bytes of whole texts whose words are looked up at once; words whose ids a worker remembers, twice;
# words encoded as one text.
ENCODED_BYTES = 1 << 21
REMEMBERED = 400_000
JOINED = 256

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MANIFEST = "part int, file string, n_docs bigint, n_tokens bigint, n_sequences bigint"
_DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class Encoder:
    """Ids of whole texts, word by word.

    White space separates what the tokenizer's own splitting never joins again, so a
    text's ids are those of its words in a row, and words come again and again. A-Z are
    lowered beforehand, which the tokenizer does too, but not in words other than ASCII of a
    text with marks that compose with them, nor where a special token might stand: it composes
    letters with their marks before it lowers them, and some compose in small letters alone. Marks in ASCII after letters alone are a word of
    their own; what a letter is, is asked of the tokenizer, of the word as it has composed and
    lowered it, since lowering can leave a letter with a mark that the next mark joins.
    """

    def __init__(self, path: str, lowers: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = lowers
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {b"": b""}  # what splitting finds before a blank, or after
        self.older: dict[bytes, bytes] = {}
        self.letters: dict[str, bool] = {}
        self.kept: set[str] = set()
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.in_lines = bool(self.ends.any())

    def encode(self, texts: list[bytes | None], end: int) -> list[bytes]:
        """The ids of each text with the end id, as bytes of ``kind``."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(self._lowered(text or b""))
            size += len(some[-1])
            if size > ENCODED_BYTES:
                out += self._encode(some, end)
                some, size = [], 0
        return out + self._encode(some, end) if some else out

    def _encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Different words are looked up once, and their ids are put where the words stand."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.binary()).to_pylist()
        ids = list(map(self.known.get, words))
        gaps = [i for i, found in enumerate(ids) if found is None]
        if len(self.known) + len(gaps) > REMEMBERED:
            self.known, self.older = {b"": b""}, self.known  # what is used goes on being known
        self._learn({words[i] for i in gaps})
        for i in gaps:
            ids[i] = self.known[words[i]]
        which = numbered.indices.to_numpy()
        n_of = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        n = n_of[which]
        ends = np.concatenate([[0], n.cumsum()])
        place = np.arange(ends[-1]) + np.repeat((n_of.cumsum() - n_of)[which] - ends[:-1], n)
        placed = np.frombuffer(b"".join(ids), self.kind)[place]
        last = self.kind.type(end).tobytes()
        edges = ends[split.offsets.to_numpy()].tolist()
        return [placed[b:e].tobytes() + last for b, e in zip(edges[:-1], edges[1:], strict=True)]

    def _lowered(self, text: bytes) -> bytes:
        if not self.lowers or b"<|" in text:
            return text
        if b"\xcc" not in text and b"\xcd" not in text:  # the first bytes of marks that compose with A-Z
            return text.lower()
        return b" ".join([w.lower() if w.isascii() else w for w in text.split()])

    def _learn(self, words: set[bytes]) -> None:
        words = words - self._again(words)
        stems = {w: s for w in words if w[-1] in _MARKS and self._all_letters(s := w.rstrip(_MARKS))}
        marks = [w[len(s) :] for w, s in stems.items()]
        single = words - stems.keys()
        single.update(stems.values(), marks)
        single = set(filterfalse(self.known.__contains__, single))  # looks up these, not all that are known
        single -= self._again(single)
        plain = [w for w in single if w.isalpha() or not w.isascii() and w.decode().isalpha()] if self.in_lines else []
        rest = list(single.difference(plain))
        lines = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for line, ids in zip(lines, self._ids([b" ".join(x) for x in lines]), strict=True):
            edges = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(edges) == len(line):
                self.known.update(zip(line, map(ids.tobytes().__getitem__, map(slice, [0, *edges[:-1]], edges)), strict=True))
            else:
                rest += line
        self.known.update(zip(rest, (x.tobytes() for x in self._ids(rest)), strict=True))
        for (word, stem), mark in zip(stems.items(), marks, strict=True):
            self.known[word] = self.known[stem] + self.known[mark]

    def _again(self, words: set[bytes]) -> set[bytes]:
        """Those of the words that were known before, and now are again."""
        again = self.older.keys() & words
        self.known.update((w, self.older[w]) for w in again)
        return again

    def _all_letters(self, stem: bytes) -> bool:
        """Whether the tokenizer's splitting keeps a word together, and apart from a mark after it."""
        if stem.isascii():
            return stem.isalpha()
        text = stem.decode()
        # Letters compose into letters, so one is asked for at a time.
        return text.isalpha() and (self.kept.issuperset(text) or all(map(self._is_letter, set(text))))

    def _is_letter(self, c: str) -> bool:
        if c not in self.letters:
            lowered = self.tokenizer.normalizer.normalize_str(c)
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.letters[c] = all(len(pieces(f"a{x}")) == 1 for x in lowered)
            if self.letters[c]:
                self.kept.add(c)
        return self.letters[c]

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(x.ids, self.kind) for x in found]


@lru_cache(maxsize=2)
def encoder(path: str, lowers: bool) -> Encoder:
    """One per worker, kept from task to task."""
    return Encoder(path, lowers)


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def schema(kind: np.dtype, sequence: int) -> pa.Schema:
    return pa.schema(
        [
            ("input_ids", pa.list_(pa.from_numpy_dtype(kind), sequence)),
            ("mask", pa.list_(pa.bool_(), sequence)),
            ("doc_ids", pa.list_(pa.int64())),
            ("doc_starts", pa.list_(pa.int32())),
        ]
    )


class _Batches:
    """Collects documents and cuts them into batches of equal sequences."""

    def __init__(self, kind: np.dtype, sequence: int):
        self.kind, self.sequence, self.schema = kind, sequence, schema(kind, sequence)
        self.parts: list[bytes] = []
        self.ids: list[int | None] = []
        self.starts: list[int] = []
        self.filled = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.filled)
        self.parts.append(ids)
        self.filled += len(ids) // self.kind.itemsize

    def cut(self, sequences: int) -> pa.RecordBatch:
        """The first sequences, padded if they are not full."""
        size = sequences * self.sequence
        flat = np.frombuffer(b"".join(self.parts), self.kind)
        mask = np.zeros(size, bool)
        mask[: len(flat)] = True
        taken = np.zeros(size, self.kind)
        taken[: len(flat)] = flat[:size]
        starts = np.array(self.starts, np.int64)
        inside = int(np.searchsorted(starts, size))
        edges = np.searchsorted(starts[:inside], np.arange(sequences + 1) * self.sequence).astype(np.int32)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.FixedSizeListArray.from_arrays(pa.array(taken), self.sequence),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence),
                pa.ListArray.from_arrays(pa.array(edges), pa.array(self.ids[:inside], pa.int64())),
                pa.ListArray.from_arrays(
                    pa.array(edges), pa.array((starts[:inside] % self.sequence).astype(np.int32))
                ),
            ],
            schema=self.schema,
        )
        self.parts = [flat[size:].tobytes()]
        self.ids, self.starts = self.ids[inside:], (starts[inside:] - size).tolist()
        self.filled = max(0, self.filled - size)
        return batch


def _write(folder: str, tokenizer: str, end: int, lowers: bool, sequence: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encode = encoder(tokenizer, lowers)
        store, path = _place(folder)
        store.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{path}/part-{part:06d}.arrows"
        trial = f"{name}.{uuid.uuid4().hex}"
        n_docs = n_tokens = n_sequences = 0
        pending = _Batches(encode.kind, sequence)
        with store.open_output_stream(trial) as out, pa.ipc.new_stream(out, pending.schema) as writer:

            def put(sequences: int) -> None:
                nonlocal n_sequences
                writer.write_batch(pending.cut(sequences))
                n_sequences += sequences

            def add(rows: pa.RecordBatch) -> None:
                nonlocal n_docs, n_tokens
                texts = rows.column(1).cast(pa.binary()).to_pylist()
                for at in range(0, len(texts), 500):
                    some = encode.encode(texts[at : at + 500], end)
                    for doc_id, ids in zip(rows.column(0).slice(at, 500).to_pylist(), some, strict=True):
                        pending.add(doc_id, ids)
                        n_tokens += len(ids) // encode.kind.itemsize
                    n_docs += len(some)
                    while pending.filled >= BATCH_SEQUENCES * sequence:
                        put(BATCH_SEQUENCES)

            add(first)
            for rows in batches:
                add(rows)
            if pending.filled:
                put(-(-pending.filled // sequence))
        store.move(trial, name)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()),
                "file": [name.rsplit("/", 1)[1]],
                "n_docs": [n_docs],
                "n_tokens": [n_tokens],
                "n_sequences": [n_sequences],
            }
        )

    return run


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end: int,
    text: str = "text",
    key: str = "doc_id",
    lowers: bool = True,
    sequence: int = SEQUENCE,
) -> DataFrame:
    """Writes the files into a shared folder and returns their manifest, written too.

    ``lowers`` says that the tokenizer lowers A-Z itself.
    """
    rows = docs.select(
        F.col(key).cast("bigint").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        row_number(docs).alias("row"),
    )
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    written = ordered.drop("row").mapInArrow(_write(folder, tokenizer, end, lowers, sequence), _MANIFEST)
    # A row per file, which one task writes: else every task would write a table file of one row.
    return settle(written.repartition(1))


def open_file(folder: str, file: str) -> pa.ipc.RecordBatchStreamReader:
    """A file's batches; on a local file system they are views of the mapped file."""
    store, path = _place(folder)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return pa.ipc.open_stream(pa.memory_map(f"{path}/{file}"))
    return pa.ipc.open_stream(store.open_input_stream(f"{path}/{file}"))


def _read(folder: str) -> Callable:
    def run(manifest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in manifest:
            for file, base in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                yield from _documents(folder, file, base)

    return run


def _documents(folder: str, file: str, base: int) -> Iterator[pa.RecordBatch]:
    """Position, length and checksum of each document, from a file's columns alone."""
    current: list | None = None  # id, start, ids so far, checksum so far
    seen = 0
    for batch in open_file(folder, file):
        done = []
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
        n = batch.column(1).flatten().true_count
        raw = memoryview(ids[:n].astype("<u4").tobytes())
        width = batch.schema.field(0).type.list_size
        per_sequence = np.diff(batch.column(2).offsets.to_numpy())
        starts = np.repeat(np.arange(batch.num_rows), per_sequence) * width + batch.column(3).flatten().to_numpy()
        edges = [0, *starts.tolist(), n]
        for i, doc_id in enumerate([None, *batch.column(2).flatten().to_pylist()]):
            begin, finish = edges[i], edges[i + 1]
            if i:
                if current:
                    done.append(current)
                current = [doc_id, base + seen + begin, 0, 0]
            if current and finish > begin:
                current[2] += finish - begin
                current[3] = zlib.crc32(raw[4 * begin : 4 * finish], current[3])
        seen += n
        if done:
            yield _as_rows(done)
    if current:
        yield _as_rows([current])


def _as_rows(done: list[list]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    columns = [pa.array(c, pa.int64()) for c in zip(*done, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document its ``start`` in the whole run of ids, ``n_tokens`` and ``ids_crc32``."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    files = max(1, manifest.count())
    return placed.repartition(files, "file").mapInArrow(_read(folder), _DOCS)


def round_trip(docs: DataFrame, tokenizer: str, end: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes the documents' sequences to a new shared folder and reads them back."""
    folder = shared_folder(docs.sparkSession)
    return read(write(docs, folder, tokenizer, end, text, key), folder)
