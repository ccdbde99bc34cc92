"""MPEG audio as a media column: writing streams, and reading them back frame by frame.

write_stream() makes an ID3v2 tag, a variable-bitrate table frame and protected Layer III frames whose bodies
carry a payload as ancillary data (the side information says that no bits are audio). read_stream() takes any
MPEG 1, 2 or 2.5 stream: it reads tags, finds the first header that a second one confirms, follows the chain,
resynchronises after damage, checks every protected frame's checksum against its header and side information
(Layer III) and gives exact durations (samples and sample rate, both whole numbers), the offset of each frame,
and the variable-bitrate table.

Defined results: null text counts as empty and gives one padded block; rows are handled one by one, so repeated
rows and ids give repeated results and equal texts give equal streams; extra columns are ignored. A stream is
read whole, whatever its length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, record_batch, with_text, written

# Fixed values of the format. Bitrates in kbit/s by header index, and sample rates by version.
BITRATES_V1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
BITRATES_V2 = {
    1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {10: (44100, 48000, 32000), 20: (22050, 24000, 16000), 25: (11025, 12000, 8000)}

BLOCK = 64
#: The written form: MPEG 1 Layer III, 48 kHz, one channel; side information of 17 bytes, checksum of 2.
RATE, SIDE, HEAD = 48000, 17, 4 + 2 + 17
SIZES = {index: 3 * kbit for index, kbit in enumerate(BITRATES_V1[3]) if index}


def crc16(rows: np.ndarray) -> np.ndarray:
    """The format's checksum (polynomial 0x8005, start 0xFFFF) of each row of bytes."""
    crc = np.full(rows.shape[0], 0xFFFF, dtype=np.uint32)
    for column in rows.T:
        crc = ((crc << 8) ^ CRC_TABLE[((crc >> 8) ^ column) & 0xFF]) & 0xFFFF
    return crc


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table.astype(np.uint32)


CRC_TABLE = _crc_table()


@dataclass(frozen=True)
class Header:
    version: int  # 10, 20 or 25: tenths
    layer: int
    kbit: int
    rate: int
    channels: int
    protected: bool
    length: int  # bytes of the whole frame
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        return (17 if self.channels == 1 else 32) if self.version == 10 else (9 if self.channels == 1 else 17)


def parse_header(word: bytes) -> Header | None:
    """The header that four bytes are, or None. Free-format and reserved values count as no header."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 25, 2: 20, 3: 10}.get(word[1] >> 3 & 3)
    layer, index, rate_index, pad = 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    kbit = (BITRATES_V1 if version == 10 else BITRATES_V2)[layer][index]
    rate = SAMPLE_RATES[version][rate_index]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 10 else 576
    length = (12000 * kbit // rate + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // rate + pad
    return Header(version, layer, kbit, rate, 1 if word[3] >> 6 == 3 else 2, not word[1] & 1, length, samples)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _header_bytes(index: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA | (not protected), index << 4 | 1 << 2, 0xC0))


def _frame_head(index: int) -> bytes:
    """Header, checksum and empty side information."""
    head = _header_bytes(index, True)
    covered = np.frombuffer(head[2:] + bytes(SIDE), np.uint8)[None, :]
    return head + struct.pack(">H", int(crc16(covered)[0])) + bytes(SIDE)


HEADS = {index: _frame_head(index) for index in SIZES}
FULL = SIZES[14] - HEAD


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of 64."""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


def write_stream(data: bytes) -> bytes:
    """data padded to blocks and stored losslessly; the lengths stand in the tag."""
    payload = padded(data)
    full, rest = divmod(len(payload), FULL)
    frames = np.empty((full, SIZES[14]), dtype=np.uint8)
    frames[:, :HEAD] = np.frombuffer(HEADS[14], np.uint8)
    frames[:, HEAD:] = np.frombuffer(payload, np.uint8, full * FULL).reshape(full, FULL)
    audio = frames.tobytes()
    if rest:
        index = next(k for k, size in SIZES.items() if size - HEAD >= rest)
        audio += HEADS[index] + payload[full * FULL :].ljust(SIZES[index] - HEAD, b"\0")
    count = full + bool(rest)
    # the table frame: 48 kbit/s, no checksum; seek points in 256ths of the stream's bytes
    total = SIZES[3] + len(audio)
    toc = bytes(min(255, 256 * (SIZES[3] + (k * count // 100) * SIZES[14]) // total) for k in range(100))
    table = (_header_bytes(3, False) + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, count, total) + toc).ljust(SIZES[3], b"\0")
    texts = b"".join(_text_frame(k, v) for k, v in (("n_bytes", len(data)), ("payload_bytes", len(payload))))
    return b"ID3\x04\x00\x00" + _syncsafe(len(texts)) + texts + table + audio


def _text_frame(key: str, value: int) -> bytes:
    body = b"\x03" + key.encode() + b"\0" + str(value).encode()
    return b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] | None = None  # frames and bytes as the table says
    toc: bytes = b""
    audio_start: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    headers: list[Header] = field(default_factory=list)
    protected: int = 0
    crc_ok: int = 0
    skipped: int = 0  # bytes that belong to no frame and no tag

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0


def read_tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2 tag at the start, and where it ends."""
    tags: dict[str, str] = {}
    if data[:3] != b"ID3" or len(data) < 10:
        return tags, 0
    unsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at = min(len(data), 10 + unsafe(data[6:10])), 10
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        size = unsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        at += 10 + size
    return tags, end


def read_stream(data: bytes) -> Stream:
    """Everything about a stream but its audio."""
    out = Stream()
    out.tags, pos = read_tags(data)
    known: dict[bytes, Header | None] = {}

    def header(at: int) -> Header | None:
        word = data[at : at + 4]
        if word not in known:
            known[word] = parse_header(word)
        return known[word]

    end, offsets, chained = len(data), [], False
    while pos < end:
        h = header(pos)
        # a header counts if its frame ends at another header or at the end, or if the chain leads to it and it is like the one before
        like = chained and h and (h.version, h.layer, h.rate, h.channels) == (out.headers[-1].version, out.headers[-1].layer, out.headers[-1].rate, out.headers[-1].channels)
        if h and pos + h.length <= end and (like or pos + h.length == end or header(pos + h.length)):
            offsets.append(pos)
            out.headers.append(h)
            pos += h.length
            chained = True
        elif end - pos == 128 and data[pos : pos + 3] == b"TAG":  # an ID3v1 tag ends the file
            out.tags.setdefault("TIT2", data[pos + 3 : pos + 33].decode("latin-1").strip("\0 "))
            break
        else:
            chained = False
            found = data.find(b"\xff", pos + 1)
            out.skipped += (end if found < 0 else found) - pos
            pos = end if found < 0 else found
    if offsets:
        _read_table(data, out, offsets)
    out.offsets = np.array(offsets, dtype=np.int64)
    _verify(data, out)
    return out


def _read_table(data: bytes, out: Stream, offsets: list[int]) -> None:
    """Takes the first frame off the list if it is a variable-bitrate table."""
    out.audio_start, at = offsets[0], offsets[0] + 4 + out.headers[0].side
    if data[at : at + 4] in (b"Xing", b"Info"):
        flags, at, out.table = int.from_bytes(data[at + 4 : at + 8], "big"), at + 8, {}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out.table[key] = int.from_bytes(data[at : at + 4], "big")
                at += 4
        out.toc = data[at : at + 100] if flags & 4 else b""
        del offsets[0], out.headers[0]


def _verify(data: bytes, out: Stream) -> None:
    raw = np.frombuffer(data, np.uint8)
    sides = np.array([h.side if h.protected and h.layer == 3 and h.length >= 6 + h.side else 0 for h in out.headers], dtype=np.int64)
    for side in np.unique(sides[sides > 0]).tolist():
        at = out.offsets[sides == side][:, None]
        stored = raw[at + 4].astype(np.uint32)[:, 0] << 8 | raw[at + 5][:, 0]
        covered = raw[np.hstack((at + 2, at + 3, at + 6 + np.arange(side)))]
        out.protected += len(at)
        out.crc_ok += int((crc16(covered) == stored).sum())


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes that write_stream() stored, read out of the frames' bodies."""
    size = int(stream.tags["payload_bytes"])
    parts = [data[at + HEAD : at + h.length] for at, h in zip(stream.offsets.tolist(), stream.headers)]
    return b"".join(parts)[:size]


def seek(stream: Stream, sample: int) -> int:
    """Offset of the frame that holds a sample."""
    ends = np.cumsum([h.samples for h in stream.headers])
    return int(stream.offsets[min(int(np.searchsorted(ends, sample, side="right")), len(ends) - 1)])


def feature(stream: Stream) -> str:
    """The stream's figures in one line; toc counts the table's seek points that stand at their frame."""
    n, total = len(stream.headers), (stream.table or {}).get("bytes", 0)
    right = sum(b == min(255, 256 * (int(stream.offsets[min(k * n // 100, n - 1)]) - stream.audio_start) // total) for k, b in enumerate(stream.toc)) if n and total else 0
    kbits = sorted({h.kbit for h in stream.headers})
    return f"frames={n};samples={stream.samples};rate={stream.rate};kbit={','.join(map(str, kbits))};vbr_frames={(stream.table or {}).get('frames', -1)};toc={right};crc={stream.crc_ok}/{stream.protected};skipped={stream.skipped};tags={len(stream.tags)}"


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, media binary."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record_batch(schema, doc_id=batch.column(0), media=[write_stream(x) for x in batch.column(1).cast(pa.binary()).to_pylist()])

    return arrow_map(with_text(docs), work, "doc_id long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """Digests, exact duration, seek offsets and feature of each stored stream (null media: none of its rows)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
        + [("feature", pa.string()), ("duration_samples", pa.int64()), ("sample_rate", pa.int32()), ("seek_offsets", pa.list_(pa.int64()))]
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: dict[str, list] = {f.name: [] for f in schema}
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            stream = read_stream(data)
            payload = payload_of(data, stream)
            row = (doc_id, int(stream.tags["n_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest())
            row += (feature(stream), stream.samples, stream.rate, stream.offsets)
            for name, value in zip(cols, row):
                cols[name].append(value)
        return record_batch(schema, **cols)

    return arrow_map(
        media.where("media is not null").select("doc_id", "media"),
        work,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate int, seek_offsets array<long>",
    )


def store_and_read(docs: DataFrame) -> DataFrame:
    """Writes every text as a stream to a media table, then reads the table's bytes back."""
    return decode(written(encode(docs), "media"))
