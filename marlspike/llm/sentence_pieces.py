"""SentencePiece encoding by Unigram Viterbi over a double-array trie, and decoding.

A model file is read without the library: pieces, scores, types and normaliser flags. The trie over the pieces' UTF-8
bytes is built once on the driver and broadcast; its size is that of the vocabulary, not of the data. Where no piece holds
a whitespace marker after another character, the best path of a text is the joined best paths of its marker-led segments,
so each worker keeps a bounded memo of segments and the result stays exact. Segments that aren't in it are searched together: one
step of the search is one array operation over all of them.

Scores: a Unigram model's own log-probabilities; a BPE model holds merge ranks instead, which are turned into
log-probabilities by Zipf's law (``-log(rank + 1) - log(H)``), as no tokenizer is trained here.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Bounded, extended, read_table, slices, text_of
from .token_counts import vocabulary

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: How much below the lowest score a character without a piece lies (fixed value of the format's Unigram encoder).
UNKNOWN_PENALTY = 10.0
MEMO = 450_000  # of each generation
LONG = 64  # segments of more characters aren't kept in the memo, and are searched one by one
TOGETHER = 4096  # segments that are searched together


def _fields(buf: bytes):
    """(number, value) of each field of a protocol buffer message; value: an integer, or the raw bytes."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = buf[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, buf[at : at + n]
        at += n


class Model:
    """Pieces with scores and types, and the flags that encoding needs."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2):
            raise ValueError("models with a character map aren't supported")
        self.unigram = trainer.get(3, 1) == 1
        self.dummy_prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.unk = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.in_trie = [i for i, t in enumerate(self.types) if t in (NORMAL, USER_DEFINED, UNUSED) and self.pieces[i]]
        if not self.unigram:
            order = {i: n for n, i in enumerate(sorted((i for i in self.in_trie if self.types[i] == NORMAL), key=lambda i: (-self.scores[i], i)))}
            total = math.log(sum(1 / (n + 1) for n in range(len(order))) or 1)
            self.scores = [-math.log(order[i] + 1) - total if i in order else s for i, s in enumerate(self.scores)]
        self.lowest = min((self.scores[i] for i in self.in_trie if self.types[i] == NORMAL), default=0.0)


class DoubleArray:
    """A trie as two arrays: from state s, byte c leads to base[s] + c + 1 if check there is s. value: a piece, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 1 << 16
        gaps = (1 << size) - 2  # bit i: state i is free
        place: dict[int, tuple[int, int]] = {}
        value: dict[int, int] = {}
        todo, top = [(0, 0, len(keys), 0)], 1
        while todo:
            state, lo, hi, depth = todo.pop()
            while lo < hi and len(keys[lo][0]) == depth:
                value[state] = keys[lo][1]
                lo += 1
            if lo >= hi:
                continue
            groups, at = [], lo
            while at < hi:
                c, start = keys[at][0][depth], at
                while at < hi and keys[at][0][depth] == c:
                    at += 1
                groups.append((c + 1, start, at))
            while top + 600 > size:
                gaps, size = gaps | ((1 << size) - 1) << size, 2 * size
            fits = gaps >> groups[0][0]
            for c, _, _ in groups[1:]:
                fits &= gaps >> c
            base = (fits & -fits).bit_length() - 1
            place[state] = (base, place[state][1]) if state in place else (base, -2)
            for c, a, b in groups:
                gaps &= ~(1 << base + c)
                place[base + c] = (0, state)
                todo.append((base + c, a, b, depth + 1))
            top = max(top, base + groups[-1][0] + 1)
        n = top + 257
        self.base, self.check, self.value = [0] * n, [-1] * n, [-1] * n
        for s, (x, y) in place.items():
            self.base[s], self.check[s] = x, y
        for s, v in value.items():
            self.value[s] = v

    def get(self, key: bytes) -> int:
        s = 0
        for c in key:
            t = self.base[s] + c + 1
            if self.check[t] != s:
                return -1
            s = t
        return self.value[s]


class Encoder:
    def __init__(self, model: Model, trie: DoubleArray):
        self.model, self.trie = model, trie
        self.unk_score = model.lowest - UNKNOWN_PENALTY
        multi = [model.pieces[i] for i in model.in_trie if len(model.pieces[i]) > 1]
        split = not any(MARK in p.lstrip(MARK) for p in multi)
        alone = "\n" if not any("\n" in p for p in multi) else ""  # a character that is in no longer piece ends a segment too
        body = rf"[^{MARK}{alone}]+"
        self.segments = re.compile(rf"{MARK}*{body}|{MARK}+" + (f"|{alone}" if alone else "")).findall if split else lambda s: [s]
        self.memo = Bounded(self.packed, MEMO)
        self.np_steps, self.np_check, self.np_value = (np.array(x, np.int32) for x in ([b + 1 for b in trie.base], trie.check, trie.value))
        self.np_gain = np.array([model.scores[v] if v >= 0 else -math.inf for v in trie.value], np.float32)
        self.byte_of = {i: b for b, i in model.bytes.items()}
        self.is_byte = np.isin(np.arange(len(model.pieces)), list(self.byte_of))
        # What each piece adds to a path's score: a character without a piece counts once, with its first byte.
        self.scores = np.array([(0.0 if 0x80 <= self.byte_of[i] < 0xC0 else self.unk_score) if i in self.byte_of else self.unk_score if i == model.unk else x for i, x in enumerate(model.scores)])
        self.steps, self.check, self.value = self.np_steps.tolist(), trie.check, trie.value
        self.gain = [g if v >= 0 else None for g, v in zip(self.np_gain, trie.value, strict=True)]
        self.shown = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else p for p, k in zip(model.pieces, model.types, strict=True)]

    def normal(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def packed(self, segment: str) -> bytes:
        return self._alone(segment)

    def _alone(self, segment: str) -> bytes:
        """``_together`` of one segment, step by step: what long ones take, where arrays over one row would be slow."""
        data = segment.encode("utf-8", "surrogatepass")
        n = len(data)
        steps, check, value, gain, unknown = self.steps, self.check, self.value, self.gain, np.float32(self.unk_score)
        none = np.float32(-math.inf)
        top, start, piece = [none] * (n + 5), [0] * (n + 5), [-1] * (n + 5)
        top[0], at = np.float32(0), 0
        while at < n:
            c = data[at]
            end = at + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            here, s, p, single = top[at], 0, at, False
            while p < n:
                t = steps[s] + data[p]
                if check[t] != s:
                    break
                s, p = t, p + 1
                g = gain[s]
                if g is not None:
                    score = here + g
                    if score > top[p]:
                        top[p], start[p], piece[p] = score, at, value[s]
                    if p == end:
                        single = True
            if not single and here + unknown > top[end]:
                top[end], start[end], piece[end] = here + unknown, at, -1
            at = end
        return self._spelled(data, start, piece)

    def _together(self, segments: list[str]) -> list[bytes]:
        """The pieces of each segment's best path, packed. Scores add up in 32 bits, as in the format's own encoder; of equal paths the
        one found first stays: that with the longer last piece."""
        raw = [x.encode("utf-8", "surrogatepass") for x in segments]
        n = np.array([len(x) for x in raw])
        rows, longest = len(raw), int(n.max())
        data = np.zeros((rows, longest), np.uint8)
        data[np.arange(longest) < n[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        begins = ((data & 0xC0) != 0x80) & (np.arange(longest) < n[:, None])
        top = np.full((rows, longest + 5), -math.inf, np.float32)
        start, piece = np.zeros((rows, longest + 5), np.int32), np.full((rows, longest + 5), -1, np.int32)
        top[:, 0] = 0.0
        for at in range(longest):
            mine = np.flatnonzero(begins[:, at])
            if not len(mine):
                continue
            end = at + width[mine, at]
            single = np.zeros(rows, bool)
            r, state, here, stop, p = mine, np.zeros(len(mine), np.int32), top[mine, at], end, at
            while len(r):
                t = self.np_steps[state] + data[r, p]
                on = self.np_check[t] == state
                r, state, here, stop, p = r[on], t[on], here[on], stop[on], p + 1
                score = here + self.np_gain[state]
                found = score > -math.inf
                single[r[found & (stop == p)]] = True
                better = np.flatnonzero(score > top[r, p])
                k = r[better]
                top[k, p], start[k, p], piece[k, p] = score[better], at, self.np_value[state[better]]
                more = n[r] > p
                if not more.all():
                    r, state, here, stop = r[more], state[more], here[more], stop[more]
            lone = ~single[mine]
            if lone.any():
                k, to, score = mine[lone], end[lone], top[mine[lone], at] + np.float32(self.unk_score)
                better = score > top[k, to]
                k, to = k[better], to[better]
                top[k, to], start[k, to], piece[k, to] = score[better], at, -1
        ids, count, place, plain = np.zeros((rows, longest + 1), np.int32), np.zeros(rows, np.int64), n.copy(), np.ones(rows, bool)
        live = np.arange(rows)
        while len(live):
            v = piece[live, place[live]]
            plain[live[v < 0]] = False  # a character without a piece
            count[live] += 1
            ids[live, longest + 1 - count[live]] = v
            place[live] = start[live, place[live]]
            live = live[place[live] > 0]
        return [ids[i, longest + 1 - c :].tobytes() if ok else self._spelled(raw[i], start[i], piece[i]) for i, (c, ok) in enumerate(zip(count.tolist(), plain.tolist(), strict=True))]

    def _spelled(self, data: bytes, start, piece) -> bytes:
        """A path on which characters without a piece become their bytes, or the unknown piece."""
        ids: list[int] = []
        p = len(data)
        while p:
            q, v = int(start[p]), int(piece[p])
            ids += [v] if v >= 0 else [self.model.bytes[b] for b in reversed(data[q:p])] if self.model.bytes else [self.model.unk]
            p = q
        return array("i", reversed(ids)).tobytes()

    def learn(self, segments: set[str]) -> None:
        """Put these segments into the memo: from its old generation, or searched together. Longer ones than LONG are left out."""
        memo = self.memo
        if len(memo) + len(segments) > memo.most:
            memo.turn()
        old, new = memo.old, []
        for x in segments:
            if x in old:
                memo[x] = old[x]
            elif len(x) <= LONG:
                new.append(x)
        new.sort(key=len)
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            memo.update(zip(part, self._together(part), strict=True))

    def encode_many(self, texts: list[str | None]) -> list[tuple[np.ndarray, float]]:
        """Piece numbers and score of each text; none and 0 for null and the empty text."""
        cut_up = [self.segments(self.normal(t or "")) for t in texts]
        memo = self.memo
        self.learn({x for segments in cut_up for x in segments if x not in memo})
        out = []
        for segments in cut_up:
            try:
                got = b"".join(map(memo.get, segments))
            except TypeError:  # segments that the memo doesn't take, or that are in its old generation by now
                got = b"".join([memo[x] if len(x) <= LONG else self._alone(x) for x in segments])
            ids = np.frombuffer(got, np.int32)
            out.append((ids, float(self.scores[ids].sum())))
        return out

    def encode_array(self, text: str | None) -> tuple[np.ndarray, float]:
        return self.encode_many([text])[0]

    def encode(self, text: str | None) -> tuple[list[int], float]:
        ids, score = self.encode_array(text)
        return ids.tolist(), score

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of these pieces: bytes joined (U+FFFD where they are no UTF-8), markers to spaces, first marker dropped."""
        ids = np.asarray(ids, np.int64)
        if not self.is_byte[ids].any():
            text = "".join(map(self.shown.__getitem__, ids.tolist()))
        else:
            out: list[str] = []
            held = bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(self.shown[i])
            text = "".join(out) + held.decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(own: str, parts) -> Encoder:
    """One encoder per worker process, with its memo, of the broadcast ``parts``; that of another run goes. Tasks must ask for it
    here: what a task's own code names is sent with it, and would start empty each time."""
    if own not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[own] = Encoder(*parts.value)
    return _ENCODERS[own]


def load(path: str) -> tuple[Model, DoubleArray]:
    with open(path, "rb") as f:
        model = Model(f.read())
    return model, DoubleArray([(model.pieces[i].encode(), i) for i in model.in_trie])


def encode_pieces(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with piece_ids, n_pieces, n_byte_pieces, score and round_trip (decoding gives the normalised text back).

    Null and empty texts have no pieces and a score of 0, and round-trip. A text with the marker U+2581 itself decodes to a
    space there, so round_trip is false. Rows are encoded one by one; other columns stay, those of the new names are replaced.
    """
    new = ("piece_ids", "n_pieces", "n_byte_pieces", "score", "round_trip")
    df = df.drop(*new)
    names = df.columns
    where = names.index(text)
    parts, own = df.sparkSession.sparkContext.broadcast(load(path or vocabulary(MODEL))), uuid.uuid4().hex

    def run(batches):
        e = encoder_of(own, parts)
        squeeze = e.model.squeeze
        for b in slices(batches):
            ids, n_bytes, scores, same = [], [], [], []
            texts = [t or "" for t in b.column(where).to_pylist()]
            for t, (got, score) in zip(texts, e.encode_many(texts), strict=True):
                ids.append(got)
                n_bytes.append(int(e.is_byte[got].sum()))
                scores.append(round(float(score), 4))
                same.append(e.decode(got) == (re.sub(" +", " ", t).strip(" ") if squeeze else t))
            size = [len(x) for x in ids]
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            flat = pa.array(np.concatenate(ids) if ids else np.array([], np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(offsets, flat), pa.array(size, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(scores, pa.float64()), pa.array(same, pa.bool_())],
                names=[*names, *new],
            )

    return df.mapInArrow(run, extended(df, "piece_ids array<int>, n_pieces long, n_byte_pieces long, score double, round_trip boolean"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every text, encoded and decoded. ids_crc32: of the piece numbers as little-endian unsigned 32-bit integers."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    coded = encode_pieces(docs).drop("text")

    def crc(batches):
        for b in slices(batches):
            ids = b.column(b.schema.names.index("piece_ids"))
            out = [zlib.crc32(np.asarray(x.values, "<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i, n in enumerate(b.schema.names) if n != "piece_ids"), pa.array(out, pa.int64())], names=[*(n for n in b.schema.names if n != "piece_ids"), "ids_crc32"])

    return coded.mapInArrow(crc, extended(coded.drop("piece_ids"), "ids_crc32 long"))
