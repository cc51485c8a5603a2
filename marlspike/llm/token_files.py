"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back memory-mapped.

Layout, below one folder: ``ids-PPPPP.bin`` (ids of all documents of part P, each of the smallest unsigned width that
holds the vocabulary), ``docs-PPPPP.bin`` (doc_id and length of each document, two little-endian 64-bit integers), and after
all parts are known ``offsets-PPPPP.bin`` (64-bit start of each document over all parts, and the end). Parts are ranges of
ascending doc_id; the base of each part is the prefix sum of the token counts of the parts before it. A task writes to a
name of its own and then renames, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import re
import uuid
import zlib
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Bounded, cut, read_table, scratch, slices, text_of
from .token_counts import PATTERN, VOCABULARY, byte_symbols, vocabulary

END_ID = 0
WORDS, PIECES = 250_000, 30_000  # that a worker's memos hold, in each of two generations
#: Texts are cut into parts of PART_BYTES, and into MOST_PARTS at most: then parts grow, and a part streams through its task.
PART_BYTES, MOST_PARTS = 8 << 20, 16_384
#: Characters below this one are in scripts whose letters, digits and spaces are fixed; the pattern cuts these texts here.
EDGE = "\u0250"
FIND = regex.compile(PATTERN).findall
#: A comma or full stop between a letter or number and a space is a piece of its own, whatever is around it. ALONE says so in the
#: word's key; LOOSE finds those that follow something else.
ALONE = "\x01"
MARK, LOOSE = re.compile(r"(?<=[^\W_])([,.])(?= )"), re.compile(rf"[\W_] {ALONE}")
#: Where a text may be cut so that the parts' ids, joined, are those of the whole: between two non-space characters, before
#: a single space, and on both sides of a single line feed. The byte-level pattern starts a piece at each of these.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")


class OtherSpace(Exception):
    """A text has white space other than single spaces and line feeds between words."""


def _fs(folder: str):
    u = urlparse(folder)
    if u.scheme in ("", "file"):
        return pafs.LocalFileSystem(), u.path
    return pafs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, data) -> None:
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        for x in data:
            f.write(x)
    fs.move(own, f"{path}/{name}")


@contextmanager
def _mapped(folder: str, name: str):
    """The file's bytes: memory-mapped on a file system, else as one read buffer."""
    fs, path = _fs(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(f"{path}/{name}") as f:
            yield f.read_buffer()
    else:
        with fs.open_input_file(f"{path}/{name}") as f:
            yield f.read_buffer()


class Ids:
    """Ids of texts as raw bytes, by the library's model.

    Texts are cut at single spaces into words, which recur; their ids are kept in a memo of two generations, so that frequent
    words stay and memory is bounded. A word that is not in it is cut into the pattern's pieces, which the library's model
    turns into ids; pieces are in the same memo. Words with characters beyond EDGE go through the whole library, so no class of
    characters is judged here that Unicode still extends. A text with a special string, or other white space where the cut may
    differ, is encoded whole by the library.
    """

    def __init__(self, path: str, width: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t, self.width = Tokenizer.from_file(path), np.dtype(width)
        self.end = np.array([end_id], width).tobytes()
        self.special = [t.content for t in self.t.get_added_tokens_decoder().values()]
        self.tokenize = self.t.model.tokenize
        self.symbols = dict(enumerate(byte_symbols()))
        self.raw = [i.to_bytes(self.width.itemsize, "little") for i in range(self.t.get_vocab_size())]
        self.pieces = Bounded(self.piece, PIECES)
        self.words = Bounded(self.word, WORDS)

    def whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def piece(self, piece: str) -> bytes:
        raw = self.raw
        mapped = piece.encode("utf-8").decode("latin-1").translate(self.symbols)
        return b"".join([raw[t.id] for t in self.tokenize(mapped)])

    def word(self, word: str) -> bytes:
        """The ids of a word and the space before it; a line feed, which leads a word, takes the space's place, and ALONE stands
        for nothing."""
        near = word.isascii() or max(word) < EDGE
        if near and word.isalpha():
            return self.piece(f" {word}")
        if word[:1] == ALONE:
            return self.piece(word[1:])
        if word[:1] != "\n":
            word = " " + word
        body = word[1:]
        if body.split() != [body]:
            raise OtherSpace
        return b"".join(map(self.pieces.__getitem__, FIND(word))) if near else self.whole(word)

    def encode(self, text: str) -> bytes:
        """The ids of a text, with the end id."""
        if not text:
            return self.end
        if any(x in text for x in self.special):
            return self.whole(text) + self.end
        if ALONE in text:
            return self.plain(text) + self.end
        spaced = text.replace("\n", " \n")
        marked = spaced.replace(", ", f" {ALONE}, ").replace(". ", f" {ALONE}. ")
        if LOOSE.search(marked):
            marked = MARK.sub(f" {ALONE}\\1", spaced)
        words = marked.split(" ")
        first = words[0]
        try:
            if first.split() != [first] or max(first) >= EDGE:
                raise OtherSpace
            del words[0]
            return b"".join((*map(self.pieces.__getitem__, FIND(first)), *map(self.words.__getitem__, words), self.end))
        except OtherSpace:
            return self.plain(text) + self.end

    def plain(self, text: str) -> bytes:
        if max(text) >= EDGE:
            return b"".join(np.array(e.ids, self.width).tobytes() for e in self.t.encode_batch_fast(CUT.split(text), add_special_tokens=False))
        return b"".join(map(self.pieces.__getitem__, FIND(text)))


_IDS: dict[tuple, Ids] = {}


def ids_of(name: str, width: str, end_id: int) -> Ids:
    """One encoder per worker process, with its memos. Tasks must ask for it here: what a task's own code names is sent with it."""
    key = (name, width, end_id)
    if key not in _IDS:
        _IDS[key] = Ids(vocabulary(name), width, end_id)
    return _IDS[key]


def write_token_files(df: DataFrame, folder: str, text: str = "text", name: str = VOCABULARY, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the files of ``df`` (doc_id, text) and return one row per part: part, n_docs, n_tokens, base, width, parts.

    Null texts are empty and give the end id alone. Documents lie in ascending doc_id order, null ids first; rows that repeat
    a doc_id follow one another by their texts. An empty table gives no part. Other columns are left out of the files. Very
    long texts are rows like any other: a task holds one slice of rows and the ids of these. Nothing reaches the driver but the
    input's size; bases are prefix sums over the table of parts, MOST_PARTS rows at most.
    """
    spark = df.sparkSession
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    width = "<u2" if max(t.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    size = df.select(F.sum(F.octet_length(text)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, min(MOST_PARTS, -(-((size["b"] or 0) + 16 * size["n"]) // part_bytes)))
    rows = df.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        from pyspark import TaskContext

        ids = ids_of(name, width, end_id)
        part = TaskContext.get().partitionId()
        docs: list[np.ndarray] = []
        total = 0

        def coded():
            nonlocal total
            for b in slices(batches):
                got = list(map(ids.encode, b.column(1).to_pylist()))
                n = np.array([len(x) for x in got], "<i8") // np.dtype(width).itemsize
                i = b.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype("<i8")
                docs.append(np.stack([i, n], 1))
                total += int(n.sum())
                yield b"".join(got)

        _write(folder, f"ids-{part:05}.bin", coded())
        if docs:
            _write(folder, f"docs-{part:05}.bin", (x.tobytes() for x in docs))
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sum(map(len, docs))]), pa.array([total])], names=["part", "n_docs", "n_tokens"])

    found = cut(rows.mapInArrow(run, "part long, n_docs long, n_tokens long"), "parts")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    table = found.withColumns({"base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")), "width": F.lit(width), "parts": F.lit(parts)})
    return cut(table, "bases")


def _per_part(parts: DataFrame) -> DataFrame:
    """One task for a few parts."""
    n = parts.select("parts").first()
    return parts.repartition(min(n[0] if n else 1, 4096), "part")


def write_offsets(parts: DataFrame, folder: str) -> None:
    """The global 64-bit offsets of each part, from its base and its documents' lengths."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                with _mapped(folder, f"docs-{r['part']:05}.bin") as buf:
                    n = np.frombuffer(buf, "<i8").reshape(-1, 2)[:, 1]
                    start = np.concatenate(([0], np.cumsum(n))) + r["base"]
                    _write(folder, f"offsets-{r['part']:05}.bin", [start.astype("<u8").tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]])], names=["part"])

    _per_part(parts).mapInArrow(run, "part long").count()


def read_token_files(parts: DataFrame, folder: str) -> DataFrame:
    """Each document from the mapped files: doc_id, start, n_tokens, ids_crc32 (of its ids as unsigned 32-bit integers)."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                p = f"{r['part']:05}.bin"
                with _mapped(folder, f"ids-{p}") as raw, _mapped(folder, f"docs-{p}") as docs, _mapped(folder, f"offsets-{p}") as offs:
                    ids = np.frombuffer(raw, r["width"])
                    who = np.frombuffer(docs, "<i8").reshape(-1, 2)[:, 0]
                    start = np.frombuffer(offs, "<u8").astype(np.int64)
                    for at in range(0, len(who), 4096):
                        s = start[at : min(at + 4096, len(who)) + 1]
                        crc = [zlib.crc32(ids[x - r["base"] : y - r["base"]].astype("<u4").tobytes()) for x, y in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
                        w = who[at : at + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array(w, mask=w == -(2**63)), pa.array(s[:-1]), pa.array(s[1:] - s[:-1]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _per_part(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    folder = scratch(spark, "tokens")
    parts = write_token_files(docs, folder)
    write_offsets(parts, folder)
    return read_token_files(parts, folder)
