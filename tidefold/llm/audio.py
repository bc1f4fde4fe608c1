"""Media columns: telephony audio in WAV containers.

Mu-law and A-law codes are expanded by tables of 256 entries; IMA ADPCM blocks, each
of which starts anew from its header, are decoded side by side: one numpy step per
sample of a block, over all blocks of a batch of rows. Decoded sound is resampled to
a common rate as 16-bit PCM and stored, packed without loss as samples alone allow it:
those that lie between two others as what differs from their mean, the others by their
place in the table of a law that has them all, else as steps from one to the next.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import words as W
from tidefold.llm.shared import packed, table, text_batches, tidy

UNIT = 192
READ_BYTES = 1 << 20
RATE, OUT_RATE = 8000, 16000
CODECS = ("mulaw", "alaw", "adpcm")
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 0x11}
#: Fixed values of the IMA ADPCM format: quantiser steps and index changes.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
TURNS = [-1, -1, -1, -1, 2, 4, 6, 8]


def _law_tables() -> dict[str, np.ndarray]:
    code = np.arange(256)
    u = ~code & 255
    mu = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    a = code ^ 0x55
    power, low = (a >> 4) & 7, ((a & 15) << 4) + 8
    al = np.where(power > 0, (low + 256) << np.maximum(power - 1, 0), low)
    return {"mulaw": np.where(u & 128, -mu, mu).astype(np.int16), "alaw": np.where(a & 128, al, -al).astype(np.int16)}


LAWS = _law_tables()


def _changes() -> np.ndarray:
    step, code = np.array(STEPS)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    return np.where(code & 8, -size, size).astype(np.int32).ravel()


_CHANGES, _TURNS = _changes(), np.array(TURNS * 2, np.int32)


def wav(codec: str, data: bytes, rate: int = RATE, align: int = 1, samples: int = 0) -> bytes:
    bits = {"adpcm": 4, "pcm": 16}.get(codec, 8)
    align = 2 if codec == "pcm" else align
    extra = struct.pack("<HH", 2, samples) if codec == "adpcm" else b"\0\0" if codec != "pcm" else b""
    a_second = rate * align // samples if samples else rate * align
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, a_second, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, int, int, bytes]:
    """(codec, rate, bytes of a block, data)."""
    at, codec, rate, align = 12, "", 0, 1
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
            codec = next(c for c, t in TAGS.items() if t == tag)
        elif kind == b"data":
            return codec, rate, align, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data in this container")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Rows are blocks of bytes: first sample (2 bytes), index, 0, then two codes a byte, the low one first. Rows of samples."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * codes.shape[0], blocks.shape[0]), np.int16)
    out[0] = value
    for t in range(codes.shape[0]):
        for half, code in ((1, codes[t] & 15), (2, codes[t] >> 4)):
            value += _CHANGES[index * 16 + code]
            np.clip(value, -32768, 32767, out=value)
            index += _TURNS[code]
            np.clip(index, 0, 88, out=index)
            out[2 * t + half] = value
    return out.T


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if not len(x) or rate == to:
        return x
    if to == 2 * rate:
        out = np.empty(2 * len(x), np.int16)
        out[0::2] = x
        out[1:-1:2] = (x[:-1].astype(np.int32) + x[1:]) >> 1
        out[-1] = x[-1]
        return out
    at = np.arange(len(x) * to // rate, dtype=np.int64) * rate
    i, part = at // to, at % to
    left, right = x[i].astype(np.int64), x[np.minimum(i + 1, len(x) - 1)].astype(np.int64)
    return (left + (right - left) * part // to).astype(np.int16)


def _tables() -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each law: its different samples in order, and for every 16-bit number its place among them or -1."""
    out = []
    for law in LAWS.values():
        values = np.unique(law)
        place = np.full(1 << 16, -1, np.int16)
        place[values.view(np.uint16)] = np.arange(len(values))
        out.append((values, place))
    return out


_LAW_VALUES = _tables()


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """The means of samples and those that follow them; the last is held."""
    return ((even.astype(np.int32) + np.append(even[1:], even[-1:])) >> 1).astype(np.int16)[:n].view(np.uint16)


def pack_pcm(x: np.ndarray) -> bytes:
    """16-bit samples as bytes: how many, how those at even places are written, these, then the others less the mean of their neighbours."""
    x = x.astype(np.int16)
    even, odd = np.ascontiguousarray(x[0::2]), np.ascontiguousarray(x[1::2])
    for kind, (_, place) in enumerate(_LAW_VALUES, 1):
        at = place[even.view(np.uint16)]
        if (at >= 0).all():
            body = at.astype(np.uint8).tobytes()
            break
    else:
        kind, body = 0, np.diff(even.view(np.uint16), prepend=np.uint16(0)).astype("<u2").tobytes()
    return struct.pack("<IB", len(x), kind) + body + (odd.view(np.uint16) - _between(even, len(odd))).astype("<u2").tobytes()


def unpack_pcm(data: bytes) -> np.ndarray:
    """The samples that pack_pcm() was given."""
    n, kind = struct.unpack_from("<IB", data)
    half = (n + 1) // 2
    if kind:
        even, at = _LAW_VALUES[kind - 1][0][np.frombuffer(data, np.uint8, half, 5)], 5 + half
    else:
        even, at = np.cumsum(np.frombuffer(data, "<u2", half, 5), dtype=np.uint16).view(np.int16), 5 + 2 * half
    out = np.empty(n, np.int16)
    out[0::2], out[1::2] = even, (np.frombuffer(data, "<u2", n // 2, at).astype(np.uint16) + _between(even, n // 2)).view(np.int16)
    return out


def decoded(media: list[bytes]) -> list[tuple[str, bytes, np.ndarray]]:
    """(codec, data, samples at OUT_RATE) of each container; all ADPCM blocks of one size are decoded together."""
    parts = [read_wav(m) for m in media]
    sounds: list[np.ndarray | None] = [LAWS[c][np.frombuffer(d, np.uint8)] if c in LAWS else np.frombuffer(d, "<i2") if c == "pcm" else None for c, _, _, d in parts]
    for align in {p[2] for p in parts if p[0] == "adpcm"}:
        rows = [i for i, p in enumerate(parts) if p[0] == "adpcm" and p[2] == align]
        found = decode_adpcm(np.frombuffer(b"".join(parts[i][3] for i in rows), np.uint8).reshape(-1, align))
        at = 0
        for i in rows:
            n = len(parts[i][3]) // align
            sounds[i] = found[at : at + n].ravel()
            at += n
    return [(p[0], p[3], resample(s, p[1], OUT_RATE)) for p, s in zip(parts, sounds)]


def payload(codec: str, data: bytes, align: int) -> bytes:
    """What store() was given: of ADPCM blocks all but their headers."""
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes() if codec == "adpcm" else data


def store(data: bytes) -> bytes:
    """A payload of a multiple of UNIT bytes as a container: 8-bit codes, or pairs of 4-bit codes in ADPCM blocks. Its checksum chooses the codec."""
    codec = CODECS[zlib.crc32(data) % 3]
    if codec != "adpcm":
        return wav(codec, data)
    blocks = np.zeros((len(data) // UNIT, UNIT + 4), np.uint8)
    blocks[:, 4:] = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    return wav(codec, blocks.tobytes(), align=UNIT + 4, samples=1 + 2 * UNIT)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        for rows, texts in W.batches(batch, "text", 1 << 20):
            texts = [x or b"" for x in texts]
            media = [store(x.ljust(max(1, -(-len(x) // UNIT)) * UNIT)) for x in texts]
            yield pa.RecordBatch.from_pydict({"id": ids.slice(rows.start, rows.stop - rows.start), "n_bytes": pa.array(list(map(len, texts)), pa.int64()), "media": pa.array(media, pa.binary())})
    tidy()


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text's UTF-8, filled up with spaces to a positive multiple of 192, as telephony audio.

    Null and empty texts are 192 spaces; rows without an id and repeated rows stay, of
    whatever length; other columns are not looked at. An empty table gives an empty
    table. Sets the session's Arrow batches to 1000 rows at most.
    """
    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_stored, "id long, n_bytes long, media binary")


def feature(codec: str, x: np.ndarray) -> str:
    """Codec, samples, peak, root mean square, changes of sign."""
    wide = x.astype(np.int32)
    power = float(np.square(wide, dtype=np.int64).sum() / len(x)) ** 0.5 if len(x) else 0.0
    turns = int(np.count_nonzero((x[1:] ^ x[:-1]) < 0))
    return f"{codec} {len(x)} {int(np.abs(wide).max()) if len(x) else 0} {power:.1f} {turns}"


def _sounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, media in W.batches(batch, "media", READ_BYTES):
            part = batch.slice(at.start, at.stop - at.start)
            yield part.append_column("pcm", pa.array([pack_pcm(x) for _, _, x in decoded(media)], pa.binary()))
    tidy()


def with_sound(stored: DataFrame) -> DataFrame:
    """(id, n_bytes, media, pcm) from (id, n_bytes, media): pcm is the sound at 16 kHz as pack_pcm() writes it.

    Rows are decoded about a MB of media at a time, a longer one by itself, in up to 20 times
    its bytes. All rows stay, other columns are not looked at; an empty table gives an
    empty table. Sets the session's Arrow batches to 1000 rows at most.
    """
    text_batches(stored.sparkSession)
    return stored.select("id", "n_bytes", "media").mapInArrow(_sounds, "id long, n_bytes long, media binary, pcm binary")


def media_and_sound(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """with_sound(media_column(docs)) in one pass."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(lambda it: _sounds(_stored(it)), "id long, n_bytes long, media binary, pcm binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, media in W.batches(batch, "media", READ_BYTES):
            part = batch.slice(at.start, at.stop - at.start)
            rows = []
            for m, packed_sound in zip(media, part.column(3)):
                codec, _, align, data = read_wav(m)
                own = payload(codec, data, align)
                rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(codec, unpack_pcm(packed_sound.as_py()))))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "n_bytes", *NAMES])
    tidy()


NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def read_media(sounds: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from (id, n_bytes, media, pcm), the feature from the sound.

    All rows stay, other columns are not looked at; an empty table gives an empty table.
    Sets the session's Arrow batches to 1000 rows at most.
    """
    text_batches(sounds.sparkSession)
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return sounds.select("id", "n_bytes", "media", "pcm").mapInArrow(_read, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Coded media and the resampled sound are stored and read back; digests are those of the media, features those of the sound."""
    return read_media(packed(media_and_sound(table(spark, sf_dir, "documents")), "media")).withColumnRenamed("id", "doc_id")
