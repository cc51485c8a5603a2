"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made.

A text is cut at added special tokens, then by the byte-level pattern into pieces. In each piece the adjacent pair of the
lowest rank (the leftmost among equals) is merged until none is left; its count is the symbols at the start minus the
merges. Pieces recur, so each worker keeps a bounded memo of their counts.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Bounded, extended, read_table, slices, text_of

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts of one vocabulary file (tokenizers' JSON with a byte-level BPE model)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.prefix = pre["add_prefix_space"]
        added = [t for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens with lstrip, rstrip or single_word aren't supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.symbols = byte_symbols()
        self.find = regex.compile(PATTERN).findall
        self.memo = Bounded(self.piece, MEMO)

    def piece(self, text: str) -> int:
        """Tokens of one piece: initial symbols minus merges."""
        if len(text) == 1 and text < "\x80":
            return 1
        sym = [self.symbols[b] for b in text.encode("utf-8", "surrogatepass")]
        n = len(sym)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = self.ranks
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or sym[i] != a or sym[j] != b:  # a symbol of this pair has been merged since
                continue
            sym[i], sym[j] = a + b, ""
            k = after[i] = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (r := ranks.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return n - merges

    def _plain(self, text: str) -> int:
        if self.prefix and text and text[0] != " ":
            text = " " + text
        return sum(map(self.memo.__getitem__, self.find(text)))

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and the empty text have none. A special string inside counts as one token."""
        if not text:
            return 0
        if not self.special or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(x) for x in parts if x)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def count_tokens(df: DataFrame, text: str = "text", name: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of its text column.

    Null texts count as empty: 0 bytes, 0 tokens. Each row is counted by itself, so repeated rows and ids are of no concern;
    other columns stay, and columns of the three new names are replaced.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    df = df.drop(*new)
    names = df.columns
    where = names.index(text)

    def run(batches):
        c = counter(vocabulary(name))
        for b in slices(batches):
            texts = [s.as_py() or "" for s in b.column(where)]
            n = [c.count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[*names, *new])

    return df.mapInArrow(run, extended(df, "n_bytes long, n_tokens long, over_limit boolean"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
