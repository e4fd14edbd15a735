"""Telephony audio columns: mu-law and A-law by lookup tables, ADPCM blocks decoded side by side, PCM resampled.

Companded audio is stored as WAV with one byte a sample (format tags 6 and 7), so any byte string is
stored without loss. ADPCM (format tag 17) is decoded from blocks of equal size: step by step within a
block, over all blocks of the batch at once. Batches bound memory: blocks and samples are handled in
slices of SLICE_BYTES payload, and one longer payload in pieces of whole blocks.

Null payload counts as empty. Null ids, repeated rows and clashing columns pass through or are ignored; an empty
table gives no rows. A payload is padded with zero bytes to a positive multiple of the block.
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

from tidemill.llm.kernels import slices, text_column

RATE = 8000
BLOCK = 64
#: Format tags of WAV, fixed values.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
PIECE = 1 << 18


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law code: inverted bits; sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law code: even bits inverted; sign, 3-bit exponent, 4-bit mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


# Fixed values of the ADPCM format: step sizes, and the index change of each code's low three bits.
_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
_MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]

MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Signed difference and next index for each (index, code)."""
    step = np.array(_STEPS, dtype=np.int32)[:, None]
    code = np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    move = np.clip(np.arange(89)[:, None] + np.array(_MOVES)[code & 7], 0, 88)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (move * 16).astype(np.int32).ravel()


_DIFFERENCE, _NEXT = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, bytes) of uint8 to (blocks, 1 + 2 * (bytes - 4)) of int16.

    A block holds its first sample (16 bits, little endian), the first step index (above 88 counts as
    88), an unused byte, then two codes a byte, the low one first.
    """
    n, width = blocks.shape
    out = np.empty((2 * width - 7, n), dtype=np.int16)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out[0] = sample
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k, packed in enumerate(columns):
        for half in (0, 1):
            at = index + (packed >> 4 if half else packed & 15)
            sample += _DIFFERENCE[at]
            np.clip(sample, -32768, 32767, out=sample)
            index = _NEXT[at]
            out[1 + 2 * k + half] = sample
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, up: int = 2, down: int = 1) -> np.ndarray:
    """Linear interpolation at up/down times the rate; the last sample is held."""
    n = len(pcm) * up // down
    if up == 2 and down == 1:
        out = np.empty(n, dtype=np.int16)
        out[::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1:] = pcm[-1:]
        return out
    at = np.arange(n, dtype=np.int64) * down
    left, part = at // up, at % up
    right = np.minimum(left + 1, len(pcm) - 1)
    return ((pcm[left].astype(np.int64) * (up - part) + pcm[right].astype(np.int64) * part) // up).astype(np.int16)


def write_wav(data: bytes, tag: int, rate: int = RATE, bits: int = 8, block: int | None = None) -> bytes:
    """A one-channel WAV file around encoded sample data."""
    align = block or bits // 8
    extra = struct.pack("<HH", 2, 2 * block - 7) if tag == ADPCM and block else b"" if tag == PCM else b"\0\0"
    per_second = rate * align if tag != ADPCM else rate * align // (2 * align - 7)
    form = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, 4 if tag == ADPCM else bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block, encoded sample data) by walking the file's chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None:
                raise ValueError("data before format")
            return form[0], form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(tag: int, block: int, data: bytes) -> np.ndarray:
    """16-bit PCM of encoded sample data."""
    codes = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return MULAW_TABLE[codes]
    if tag == ALAW:
        return ALAW_TABLE[codes]
    if tag == ADPCM:
        return decode_adpcm(codes[: len(codes) // block * block].reshape(-1, block)).reshape(-1)
    if tag == PCM:
        return np.frombuffer(data, "<i2")
    raise ValueError(f"unknown format tag {tag}")


def to_pcm_wav(media: bytes, up: int = 2, down: int = 1) -> bytes:
    """The media decoded, resampled and stored as 16-bit PCM WAV."""
    tag, rate, block, data = read_wav(media)
    return write_wav(resample(decode(tag, block, data), up, down).astype("<i2").tobytes(), PCM, rate * up // down, 16)


def padded(payload: bytes, block: int = BLOCK) -> bytes:
    return payload + b"\0" * (max(block, -(-len(payload) // block) * block) - len(payload))


def _loudness(pcm: np.ndarray) -> str:
    """Root mean square, peak and zero crossings."""
    wide = pcm.astype(np.float64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{np.sqrt(np.dot(wide, wide) / len(wide)):.3f}/{int(np.abs(pcm.astype(np.int32)).max())}/{crossings}"


def features(payloads: list[bytes], stored: list[bytes]) -> list[str]:
    """Of each payload: loudness as mu-law and as A-law, CRC and loudness of its stored PCM and of its samples as ADPCM blocks. stored: the PCM files."""
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    step = PIECE // BLOCK
    adpcm = np.concatenate([decode_adpcm(blocks[k : k + step]) for k in range(0, len(blocks), step)])
    out, at = [], 0
    for payload, wav in zip(payloads, stored, strict=True):
        codes, n = np.frombuffer(payload, np.uint8), len(payload) // BLOCK
        tag, _, block, data = read_wav(wav)
        samples, resampled = adpcm[at : at + n].reshape(-1), decode(tag, block, data)
        at += n
        out.append(f"mulaw={_loudness(MULAW_TABLE[codes])};alaw={_loudness(ALAW_TABLE[codes])};pcm16k={zlib.crc32(resampled):08x}/{_loudness(resampled)};adpcm={zlib.crc32(samples):08x}/{_loudness(samples)}")
    return out


def store(payload: bytes) -> bytes:
    """The payload's bytes as mu-law samples."""
    return write_wav(padded(payload), MULAW)


def media_column(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), payload: str = "text") -> DataFrame:
    """The columns in keep, `media` (mu-law WAV of the UTF-8 or binary payload) and `pcm` (its resampled 16-bit PCM WAV)."""
    source = docs.select(*keep, F.col(payload).cast("binary").alias("__payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__payload"):
            media = [store(x or b"") for x in b.column("__payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(media, pa.binary()), pa.array([to_pcm_wav(m) for m in media], pa.binary())], names=[*keep, "media", "pcm"])

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, media binary, pcm binary")


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's stored form, of the payload read back from it, and of the resampled PCM stored from that; see features, which reads the stored PCM."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
         ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm_bytes", pa.int64()), ("pcm_sha256", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            texts = [t.encode() for t in text_column(b).to_pylist()]
            media = [store(t) for t in texts]
            read = [read_wav(m)[3] for m in media]
            pcm = [to_pcm_wav(m) for m in media]
            columns = [
                b.column("doc_id").to_pylist(), [len(t) for t in texts], [len(r) for r in read], [hashlib.sha256(r).hexdigest() for r in read],
                [zlib.crc32(r[-BLOCK:]) for r in read], [len(m) for m in media], [hashlib.sha256(m).hexdigest() for m in media], features(read, pcm),
                [len(p) for p in pcm], [hashlib.sha256(p).hexdigest() for p in pcm],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kind, strict=True)], schema=kind)

    return source.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string")
