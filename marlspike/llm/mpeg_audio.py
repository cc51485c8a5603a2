"""Media columns: MPEG audio streams in a binary column.

``encode`` stores any bytes losslessly as a valid, silent MPEG-1 Layer III stream: the bytes travel as the frames'
ancillary data. ``parse`` reads any MPEG-1/2/2.5 Layer I-III stream: it skips tags, resynchronises on frame headers,
reads variable-bitrate tables (Xing, Info, VBRI) with the encoder's delay and padding, verifies the frames' CRC-16 and gives the
exact duration and the offset of each frame. Both work on one row at a time, so memory is bounded by the longest row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import extended, read_table, slices, text_of

UNIT = 192  # payload bytes in a frame
FILL = 32  # what the payload's last unit is filled up with

#: Bitrates in kbit/s by index 1-14, of the MPEG audio standards (fixed values).
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: What starts the extension of a Xing or Info table that holds the encoder's delay and padding (fixed values).
ENCODERS = (b"LAME", b"Lavf", b"Lavc")
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


class Frame:
    """What a four-byte header says."""

    __slots__ = ("size", "samples", "rate", "kbps", "layer", "version", "mono", "crc", "side")

    def __init__(self, size, samples, rate, kbps, layer, version, mono, crc, side):
        self.size, self.samples, self.rate, self.kbps, self.layer = size, samples, rate, kbps, layer
        self.version, self.mono, self.crc, self.side = version, mono, crc, side


@lru_cache(4096)
def header(word: bytes) -> Frame | None:
    """The frame that these four bytes announce; None if they are no header. Free-format streams aren't read."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer_bits, crc = word[1] >> 3 & 3, word[1] >> 1 & 3, not word[1] & 1
    rate_index, rate_kind, pad = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1
    if version == 1 or layer_bits == 0 or rate_index in (0, 15) or rate_kind == 3 or word[3] & 3 == 2:
        return None
    layer, first, rate = 4 - layer_bits, version == 3, RATES[version][rate_kind]
    kbps = BITRATES[(1, layer) if first else (2, min(layer, 2))][rate_index - 1]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    mono = word[3] >> 6 == 3
    side = ((17 if mono else 32) if first else (9 if mono else 17)) if layer == 3 else 0
    return Frame(size, samples, rate, kbps, layer, 1 if first else 2, mono, crc, side)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


@lru_cache(65536)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ CRC_TABLE[c >> 8 ^ b]
    return c


def _protected(data: bytes, at: int, f: Frame) -> int:
    """How many bits after the CRC of the frame at ``at`` it covers: side information, or Layers I and II's bit allocation
    and, in Layer II, the selection of scale factors (two bits for each allocated band of a channel)."""
    if f.layer == 3:
        return 8 * f.side
    joint = 4 * (data[at + 3] >> 4 & 3) + 4 if data[at + 3] >> 6 == 1 else 32  # from this band on both channels share bits
    if f.layer == 1:
        return 128 if f.mono else 4 * (32 + joint)
    kbps = f.kbps if f.mono else f.kbps // 2
    if f.version == 2:
        widths = (4,) * 4 + (3,) * 7 + (2,) * 19
    elif kbps < 56:
        widths = (4,) * 2 + (3,) * (10 if f.rate == 32000 else 6)
    else:
        widths = (4,) * 11 + (3,) * 12 + (2,) * (7 if kbps >= 96 and f.rate != 48000 else 4)
    bits, size = int.from_bytes(data[at + 6 : at + f.size], "big"), 8 * (f.size - 6)
    used = chosen = 0
    for band, width in enumerate(widths):
        for _ in range(1 if f.mono or band >= joint else 2):
            used += width
            if used <= size and bits >> size - used & (1 << width) - 1:
                chosen += 4 if not f.mono and band >= joint else 2
    return used + chosen


def crc_fits(data: bytes, at: int, f: Frame) -> bool:
    """Whether the CRC-16 of the protected frame at ``at`` is right."""
    n = _protected(data, at, f)
    if n > 8 * (f.size - 6):
        return False
    c = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + n // 8])
    for i in range(n % 8):
        bit = data[at + 6 + n // 8] >> 7 - i & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c == data[at + 4] << 8 | data[at + 5]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


_HEAD = bytes((0xFF, 0xFA, 0x64, 0xC0))  # MPEG-1 Layer III, CRC, 80 kbit/s, 48 kHz, mono: 240 bytes, 24 ms
_INFO_HEAD = bytes((0xFF, 0xFB, 0x64, 0xC0))
_SIZE, _SIDE, _MARK = 240, 17, b"ANC1"


def encode(payload: bytes, length: int | None = None) -> bytes:
    """An MPEG stream that carries ``payload`` (a positive multiple of 192 bytes); ``length`` is kept in a tag."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    n = len(payload) // UNIT
    body = b"\0PAYLOAD_BYTES\0" + str(len(payload) if length is None else length).encode()
    tag = b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body
    id3 = b"ID3\3\0\0" + _synchsafe(len(tag)) + tag
    toc = bytes(min(255, 256 * (_SIZE * (1 + n * i // 100)) // (_SIZE * (n + 1))) for i in range(100))
    info = _INFO_HEAD + bytes(_SIDE) + b"Info" + struct.pack(">III", 7, n, _SIZE * (n + 1)) + toc
    frames = np.zeros((n, _SIZE), np.uint8)
    side = bytes(_SIDE)
    frames[:, :4] = np.frombuffer(_HEAD, np.uint8)
    frames[:, 4:6] = np.frombuffer(struct.pack(">H", crc16(_HEAD[2:] + side)), np.uint8)
    frames[:, 23:27] = np.frombuffer(_MARK, np.uint8)
    frames[:, 27:31] = np.arange(n, dtype=">u4").view(np.uint8).reshape(n, 4)
    frames[:, _SIZE - UNIT :] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return id3 + info.ljust(_SIZE, b"\0") + frames.tobytes()


def _synchsafe_value(raw: bytes) -> int:
    n = 0
    for b in raw:
        n = n << 7 | b & 127
    return n


def _joined(data: bytes) -> bytes:
    """Bytes of a tag with unsynchronisation undone: a zero after 0xFF was put there by the writer."""
    return data.replace(b"\xff\x00", b"\xff")


def _text_frames(major: int, flags: int, body: bytes) -> dict:
    """The text fields of a tag's body. Major 2 has short frame headers, 3 an extended header without its own size in it and
    unsynchronisation as a whole, 4 synchsafe sizes, and unsynchronisation by frame."""
    tags: dict[str, str] = {}
    if flags & 0x80 and major < 4:
        body = _joined(body)
    p = 0
    if flags & 0x40 and major == 3:
        p = 4 + int.from_bytes(body[:4], "big")
    elif flags & 0x40 and major == 4:
        p = _synchsafe_value(body[:4])
    head = 6 if major == 2 else 10
    while p + head <= len(body) and body[p : p + 1].isalnum():
        if major == 2:
            name, n, own = body[p : p + 3].decode("latin-1"), int.from_bytes(body[p + 3 : p + 6], "big"), 0
        else:
            name, raw, own = body[p : p + 4].decode("latin-1"), body[p + 4 : p + 8], body[p + 9]
            n = int.from_bytes(raw, "big") if major == 3 else _synchsafe_value(raw)
        value = body[p + head : p + head + n]
        p += head + n
        if major == 4:
            if own & 2 or flags & 0x80:
                value = _joined(value)
            if own & 1:  # the length without unsynchronisation comes first
                value = value[4:]
        if name[0] == "T" and value and not own & (0xC0 if major == 3 else 0x0C):  # neither compressed nor encrypted
            text = value[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(value[0], 3)], "replace")
            key, _, rest = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            tags[key] = rest.rstrip("\0")
    return tags


def _tags(data: bytes) -> tuple[int, int, dict]:
    """Where audio may start and must end, and the tags' text fields."""
    at, end, tags = 0, len(data), {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        major, flags, size = data[at + 3], data[at + 5], _synchsafe_value(data[at + 6 : at + 10])
        if major in (2, 3, 4):
            tags |= _text_frames(major, flags, data[at + 10 : min(at + 10 + size, end)])
        at = min(at + 10 + size + (10 if major == 4 and flags & 0x10 else 0), end)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    return at, end, tags


def _agrees(data: bytes, at: int, f: Frame) -> Frame | None:
    """The frame at ``at``, if it is like ``f`` in version, layer and rate."""
    g = header(data[at : at + 4])
    return g if g is not None and (g.version, g.layer, g.rate) == (f.version, f.layer, f.rate) else None


def _stands(data: bytes, at: int, f: Frame, end: int) -> bool:
    """Whether a frame that follows another one counts although what comes after it is damaged: no run of frames starts in it."""
    p = data.find(b"\xff", at + 1, at + f.size)
    while p >= 0:
        g = _agrees(data, p, f)
        if g and (p + g.size == end or p + g.size < end and _agrees(data, p + g.size, f)):
            return False
        p = data.find(b"\xff", p + 1, at + f.size)
    return True


def _runs_out(data: bytes, at: int, f: Frame) -> bool:
    """Whether frames like ``f`` follow each other from ``at`` to the very last byte."""
    while at < len(data):
        g = _agrees(data, at, f)
        if g is None:
            return False
        at += g.size
    return at == len(data)


def _table(data: bytes, at: int, f: Frame) -> dict | None:
    """The variable-bitrate table in the frame at ``at``, if it holds one."""
    p = at + 4 + f.side
    if f.layer == 3 and data[p : p + 4] in (b"Xing", b"Info") and len(data) >= p + 8:
        out, flags, p = {"kind": data[p : p + 4].decode()}, int.from_bytes(data[p + 4 : p + 8], "big"), p + 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit and len(data) >= p + 4:
                out[key], p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out["toc"], p = list(data[p : p + 100]), p + 100
        p += 4 if flags & 8 else 0
        if data[p : p + 4] in ENCODERS and len(data) >= p + 24:
            gap = int.from_bytes(data[p + 21 : p + 24], "big")
            out["delay"], out["padding"] = gap >> 12, gap & 4095
        return out
    p = at + 36
    if f.layer == 3 and data[p : p + 4] == b"VBRI" and len(data) >= p + 18:
        out = {"kind": "VBRI", "bytes": int.from_bytes(data[p + 10 : p + 14], "big"), "frames": int.from_bytes(data[p + 14 : p + 18], "big")}
        if len(data) >= p + 26:
            entries, scale, size, step = struct.unpack(">HHHH", data[p + 18 : p + 26])
            if entries and size and len(data) >= p + 26 + entries * size:
                out["toc"] = [scale * int.from_bytes(data[q : q + size], "big") for q in range(p + 26, p + 26 + entries * size, size)]
                out["frames_per_entry"] = step
        return out
    return None


def parse(data: bytes | None) -> dict:
    """Everything about a stream. Null or no frame: zero frames and a duration of 0.

    A header counts if the next one, where it says, agrees in version, layer and rate, or the stream ends there; right behind a
    frame that it agrees with, it also counts if what follows is damaged, unless a run of frames starts within it. All other
    bytes are skipped and counted in ``skipped``. "TAG" 128 bytes before the end is a tag unless it lies within a frame of a run
    that ends with the stream. ``duration_num / duration_den`` is the duration in seconds, exact; the delay and padding that the
    encoder names are no part of it, but of ``n_samples``.
    """
    data = data or b""
    at, end, tags = _tags(data)
    offsets: list[int] = []
    skipped = samples = crc_ok = crc_bad = kbits = 0
    table = first = last = None
    rates: dict[int, int] = {}
    anc: list[bytes] = []
    while at < end:
        f = header(data[at : at + 4])
        if f is not None and at + f.size > end and end < len(data) and _runs_out(data, at, f):
            end = len(data)
        if f is None or at + f.size > end or f.size < 4 + 2 * f.crc + f.side:
            f = None
        elif at + f.size < end and last is not f and _agrees(data, at + f.size, f) is None and not (last and _agrees(data, at, last) and _stands(data, at, f, end)):
            f = None
        if f is None:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped, at, last = skipped + nxt - at, nxt, None
            continue
        if first is None:
            first, table = f, _table(data, at, f)
            if table:
                at, last = at + f.size, f
                continue
        if f.crc:
            if crc_fits(data, at, f):
                crc_ok += 1
            else:
                crc_bad += 1
        if f.layer == 3 and data[at + 23 : at + 27] == _MARK and f.size == _SIZE:
            anc.append(data[at + _SIZE - UNIT : at + _SIZE])
        offsets.append(at)
        samples += f.samples
        kbits += f.kbps
        rates[f.rate] = rates.get(f.rate, 0) + f.samples
        at, last = at + f.size, f
    if end < len(data):
        tags.setdefault("ID3V1_TITLE", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    num, den = 0, 1
    silent = table.get("delay", 0) + table.get("padding", 0) if table else 0
    if first and silent <= rates.get(first.rate, 0):
        rates[first.rate] -= silent
    for rate, n in sorted(rates.items()):
        num, den = num * rate + n * den, den * rate
        d = gcd(num, den)
        num, den = num // d, den // d
    return {
        "version": first.version if first else None, "layer": first.layer if first else None, "sample_rate": first.rate if first else None,
        "channels": (1 if first.mono else 2) if first else None, "n_frames": len(offsets), "n_samples": samples, "duration_num": num, "duration_den": den,
        "mean_kbps": kbits / len(offsets) if offsets else None, "crc_ok": crc_ok, "crc_bad": crc_bad, "skipped": skipped, "table": table,
        "tags": tags, "offsets": offsets, "ancillary": b"".join(anc),
    }


PARSED = (
    "mpeg_version int, layer int, sample_rate int, channels int, n_frames long, n_samples long, duration_num long, duration_den long, "
    "crc_ok long, crc_bad long, skipped_bytes long, table_kind string, table_frames long, table_bytes long, encoder_delay long, encoder_padding long, tags map<string,string>, "
    "seek_offsets array<long>, payload binary"
)


def encode_column(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` with a binary column ``out``: the text (null: empty) as UTF-8, filled up with spaces, as an MPEG stream.

    All columns of ``df`` stay; one of the name ``out`` is replaced. An empty table gives an empty table.
    """
    df = df.drop(out)
    names = df.columns
    where = names.index(text)

    def run(batches):
        for b in slices(batches):
            media = []
            for s in b.column(where):
                raw = (s.as_py() or "").encode("utf-8", "surrogatepass")
                media.append(encode(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, bytes([FILL])), len(raw)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(media, pa.binary())], names=[*names, out])

    return df.mapInArrow(run, extended(df, f"{out} binary"))


def parse_column(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what ``parse`` finds in the binary column ``media`` (null: no frames), in columns named as in PARSED.

    Columns of those names that ``df`` has already are replaced.
    """
    new = StructType.fromDDL(PARSED).fields
    df = df.drop(*(f.name for f in new))
    names = df.columns
    where = names.index(media)
    arrow = [
        pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
        pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.binary(),
    ]

    def run(batches):
        for b in slices(batches, 64):
            rows = [parse(x.as_py()) for x in b.column(where)]
            cols = [
                [r[k] for r in rows]
                for k in ("version", "layer", "sample_rate", "channels", "n_frames", "n_samples", "duration_num", "duration_den", "crc_ok", "crc_bad", "skipped")
            ]
            cols += [[(r["table"] or {}).get(k) for r in rows] for k in ("kind", "frames", "bytes", "delay", "padding")]
            cols += [[list(r["tags"].items()) for r in rows], [r["offsets"] for r in rows], [r["ancillary"] for r in rows]]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, arrow, strict=True))], names=[*names, *(f.name for f in new)])

    return df.mapInArrow(run, extended(df, PARSED))


def digests(df: DataFrame) -> DataFrame:
    """The digest columns of a parsed table (with n_bytes and media)."""

    def run(batches):
        for b in slices(batches, 64):
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            rows = []
            for i in range(b.num_rows):
                v = {n: c[i].as_py() for n, c in at.items()}
                seek = zlib.crc32(np.array(v["seek_offsets"], "<i8").tobytes())
                us = v["duration_num"] * 1_000_000 // v["duration_den"]
                feature = (
                    f"mpeg{v['mpeg_version']};layer{v['layer']};{v['sample_rate']}Hz;ch={v['channels']};{v['table_kind']}={v['table_frames']};"
                    f"frames={v['n_frames']};samples={v['n_samples']};us={us};crc={v['crc_ok']}/{v['crc_bad']};skipped={v['skipped_bytes']};seek={seek:08x}"
                )
                p, m = v["payload"], v["media"]
                rows.append((v["doc_id"], int(v["tags"] and dict(v["tags"])["PAYLOAD_BYTES"]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, us, v["n_frames"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, n_frames long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]
    return df.mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """Every text as an MPEG stream, read back: digests of payload, stream and features."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    return digests(parse_column(encode_column(docs).select("doc_id", "media")))
