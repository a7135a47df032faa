"""Telephony audio as a column: G.711 and IMA ADPCM in WAV containers, decoded to resampled PCM.

mu-law and A-law bytes are expanded by tables of 256 entries built from their laws.
ADPCM is decoded by numpy across blocks: all blocks of a batch take their n-th nibble
together, each with its own predictor and step index. PCM at 8 kHz becomes 16 kHz by a
half-band filter and is stored as 16-bit samples.

`pack` keeps a payload losslessly: its bytes are the coded samples (or blocks), so that
what `unpack` reads from the container is the payload, byte for byte. An ADPCM block is any
`BLOCK` bytes; a step index beyond the table counts as the last one.

`of_texts` takes texts as UTF-8 (null: no bytes), filled with bytes 255 to a positive
multiple of `BLOCK`; the codec follows from the payload's CRC, so equal texts have equal
media. Every row is handled by itself and whole; PCM of a batch is made in slices of at most `SLICE`
bytes of payload, or one document. Repeated rows give repeated results; an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK = 576
RATE = 8000
SLICE = 1 << 20
MULAW, ALAW, ADPCM = "mulaw", "alaw", "adpcm"
CODECS = (MULAW, ALAW, ADPCM)
#: WAVE format tags.
TAGS = {MULAW: 7, ALAW: 6, ADPCM: 17}
#: Fixed values of IMA ADPCM: how an index moves by the low three bits of a code.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


#: Fixed values of IMA ADPCM: the step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    mantissa, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(segment == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def pack(payload: bytes, codec: str) -> bytes:
    """A mono WAV file at 8 kHz whose data are the payload."""
    align = BLOCK if codec == ADPCM else 1
    per_block = 2 * (BLOCK - 4) + 1
    rate = RATE * BLOCK // per_block if codec == ADPCM else RATE
    extra = struct.pack("<HH", 2, per_block) if codec == ADPCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, rate, align, 4 if codec == ADPCM else 8) + extra
    samples = len(payload) // BLOCK * per_block if codec == ADPCM else len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload) & 0xFFFFFFFF) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body) & 0xFFFFFFFF) + body


def unpack(wav: bytes) -> tuple[str, memoryview]:
    """The codec and the stored data of a WAV file, found by walking its chunks."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, view = 12, 0, memoryview(wav)
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", wav, at + 8)[0]
        if name == b"data":
            return next(c for c, t in TAGS.items() if t == tag), view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Blocks x bytes to blocks x samples: one pass over the nibbles of a block, all blocks side by side."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value = head
    for k, code in enumerate(codes, 1):
        value = np.clip(value + CHANGE.take(index * 16 + code), -32768, 32767)
        index = np.clip(index + INDEX_MOVES.take(code & 7), 0, 88)
        out[k] = value
    return out.T


def _changes() -> np.ndarray:
    """What a code adds to the predictor, for each step index: index * 16 + code."""
    step, code = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    return np.where(code & 8, -size, size).astype(np.int32).ravel()


CHANGE = _changes()


def expand(payloads: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """PCM at 8 kHz of each (codec, data); the ADPCM blocks of all go through the decoder together."""
    out: list = [None] * len(payloads)
    coded = [i for i, (c, _) in enumerate(payloads) if c == ADPCM]
    if coded:
        blocks = np.frombuffer(b"".join(payloads[i][1] for i in coded), np.uint8).reshape(-1, BLOCK)
        pcm, at = adpcm_blocks(blocks), 0
        for i in coded:
            n = len(payloads[i][1]) // BLOCK
            out[i] = pcm[at : at + n].ravel()
            at += n
    for i, (c, data) in enumerate(payloads):
        if c != ADPCM:
            out[i] = TABLES[c].take(np.frombuffer(data, np.uint8))
    return out


def resample(pcm: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz: every sample stays, and between two stands the filter (-1, 9, 9, -1) / 16, rounded down; ends repeat."""
    x = pcm.astype(np.int32)
    left, right = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    far = np.concatenate([right[1:], right[-1:]])
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x + right) - left - far) >> 4, -32768, 32767)
    return out


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, root mean square, sign changes and CRC of resampled PCM: all from integers."""
    x = pcm.astype(np.int64)
    rms = int(np.sqrt(float((x * x).sum()) / max(len(x), 1)))
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec}:{len(pcm)}:{int(np.abs(x).max(initial=0))}:{rms}:{turns}:{zlib.crc32(pcm.tobytes()):08x}"


OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("codec", T.StringType()), T.StructField("media", T.BinaryType()), T.StructField("pcm", T.BinaryType()), T.StructField("feature", T.StringType()),
])
DIGESTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("pcm_bytes", T.LongType()), T.StructField("pcm_sha256", T.StringType()),
])


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def media_of(texts: list[str | None]) -> Iterator[tuple[int, str, bytes, memoryview, np.ndarray]]:
    """For each text: bytes without filling, codec, container, data read back from it, resampled PCM."""
    at = 0
    while at < len(texts):
        made, held = [], 0
        while at < len(texts) and (not made or held < SLICE):
            n, payload = payload_of(texts[at])
            wav = pack(payload, CODECS[zlib.crc32(payload) % 3])
            made.append((n, wav, *unpack(wav)))
            held += len(payload)
            at += 1
        for (n, wav, codec, data), pcm in zip(made, expand([(c, d) for _, _, c, d in made])):
            yield n, codec, wav, data, resample(pcm)


def of_texts(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, codec, media (WAV), pcm (16-bit, 16 kHz), feature; with `digests`, sizes and digests of the media, of the payload read back from it, and of the PCM."""
    schema = DIGESTS if digests else OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for n, codec, wav, data, pcm in media_of(part.column(1).to_pylist()):
                    if digests:
                        rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(wav), hashlib.sha256(wav).hexdigest(), feature(codec, pcm), 2 * len(pcm), hashlib.sha256(pcm.astype("<i2").tobytes()).hexdigest()))
                    else:
                        rows.append((n, codec, wav, pcm.tobytes(), feature(codec, pcm)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] if digests else [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
