"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE containers, resampled PCM out.

mu-law and A-law expand by 256-entry tables that are computed from the rules of G.711.  ADPCM is decoded a
step at a time across all blocks of a batch: every block carries its own predictor, so numpy advances all
blocks together and the loop runs over the samples of one block only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearframe.llm.common import add_columns, position, prepare

UNIT = 64
RATE = 8000
# WAVE format tags, and the index adjustments and step sizes of IMA ADPCM.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima": 17}
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
     118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
     1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
     6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
     32767], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, shift = (code & 15) << 4, (code >> 4) & 7
    size = np.where(shift == 0, part + 8, (part + 264) << np.maximum(shift - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def wave(data: bytes, codec: str = "mulaw", rate: int = RATE, block: int = 256) -> bytes:
    """A mono WAVE file around coded bytes; every codec's bytes are stored as they are."""
    bits = {"pcm": 16, "ima": 4}.get(codec, 8)
    align = {"pcm": 2, "ima": block}.get(codec, 1)
    per_s = rate * align if codec != "ima" else rate * block // ((block - 4) * 2 + 1)
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if codec == "ima" else b"" if codec == "pcm" else b"\0\0"
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, per_s, align, bits) + extra
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    body += b"fact" + struct.pack("<II", 4, len(data)) if codec != "pcm" else b""
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def unwave(blob: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and coded bytes of a WAVE file; ValueError if it isn't one of those known."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate, align, data = 12, "", 0, 1, None
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        body = blob[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("the file is cut short")
        if name == b"fmt ":
            if size < 16:
                raise ValueError("the format is cut short")
            tag, channels, rate, _, align = struct.unpack_from("<HHIIH", body)
            codec = {v: k for k, v in TAGS.items()}.get(tag, "")
            if not codec or channels != 1:
                raise ValueError(f"format {tag} with {channels} channels is not supported")
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if data is None or not codec:
        raise ValueError("no format or no data")
    if rate <= 0 or codec == "ima" and align <= 4:
        raise ValueError("no sample rate, or blocks without samples")
    return codec, rate, align, data


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks, (blocks, bytes) uint8 to (blocks, samples) int16, all blocks at a time."""
    n, width = blocks.shape
    out = np.empty((n, (width - 4) * 2 + 1), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for half in (0, 1):
            nibble = (codes[k] >> (4 * half)) & 15
            step = STEPS[index]
            size = nibble & 7
            diff = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
            value = np.clip(value + np.where(nibble & 8, -diff, diff), -32768, 32767)
            index = np.clip(index + INDEX_STEP[nibble], 0, 88)
            out[:, 1 + 2 * k + half] = value
    return out


def encode_ima(samples: np.ndarray, block: int = 256) -> bytes:
    """IMA ADPCM blocks of int16 samples (the last block is filled with its last sample), across blocks."""
    per = (block - 4) * 2 + 1
    n = max(1, -(-len(samples) // per))
    padded = np.pad(samples.astype(np.int32), (0, n * per - len(samples)), mode="edge" if len(samples) else "constant")
    x = padded.reshape(n, per)
    out = np.zeros((n, block), np.uint8)
    value, index = x[:, 0].copy(), np.zeros(n, np.int32)
    out[:, :2] = value.astype("<i2")[:, None].view(np.uint8).reshape(n, 2)
    for k in range(1, per):
        step, gap = STEPS[index], x[:, k] - value
        nibble, rest, diff = np.where(gap < 0, 8, 0), np.abs(gap), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = rest >= part
            nibble, rest, diff = nibble + bit * take, rest - part * take, diff + part * take
        value = np.clip(value + np.where(nibble & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + INDEX_STEP[nibble], 0, 88)
        out[:, 4 + (k - 1) // 2] |= (nibble << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def decode(blob: bytes) -> tuple[int, np.ndarray]:
    """Rate and int16 samples of a WAVE file; ValueError if it can't be read."""
    return _expand(*unwave(blob))


def _expand(codec: str, rate: int, align: int, data: bytes) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    if codec == "pcm":
        return rate, raw[: len(raw) // 2 * 2].view("<i2").astype(np.int16)
    if codec == "ima":
        return rate, decode_ima(raw[: len(raw) // align * align].reshape(-1, align)).reshape(-1)
    return rate, (MULAW if codec == "mulaw" else ALAW)[raw]


def parse(blob: bytes | None) -> tuple[str, int, int, bytes] | None:
    """What ``unwave`` finds, or None."""
    try:
        return None if blob is None else unwave(blob)
    except (ValueError, struct.error):
        return None


def decode_all(blobs: list[bytes | None]) -> list[tuple[int, np.ndarray] | None]:
    """Rate and samples of each blob (None if null or unreadable); ADPCM blocks of one size are decoded across blobs."""
    found = [parse(b) for b in blobs]
    out = [None if p is None or p[0] == "ima" else _expand(*p) for p in found]
    for align in {p[2] for p in found if p and p[0] == "ima"}:
        of = [i for i, p in enumerate(found) if p and p[0] == "ima" and p[2] == align]
        raws = [np.frombuffer(found[i][3], np.uint8) for i in of]
        blocks = [r[: len(r) // align * align].reshape(-1, align) for r in raws]
        samples = np.split(decode_ima(np.concatenate(blocks)), np.cumsum([len(b) for b in blocks])[:-1])
        for i, x in zip(of, samples, strict=True):
            out[i] = (found[i][1], x.reshape(-1))
    return out


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers: the same samples on every machine."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    n = len(samples) * to // rate
    if to == 2 * rate:
        x = samples.astype(np.int32)
        nxt = np.append(x[1:], x[-1])
        out = np.empty(n, np.int16)
        out[0::2], out[1::2] = x, (x + nxt) >> 1
        return out
    at = np.arange(n, dtype=np.int64) * rate
    low, part = at // to, at % to
    high = np.minimum(low + 1, len(samples) - 1)
    x = samples.astype(np.int64)
    return ((x[low] * (to - part) + x[high] * part) // to).astype(np.int16)


def pack_pcm(samples: np.ndarray) -> bytes:
    """Samples without loss in a form that compresses well: those at even places, then how far each other one is from
    the mean of its neighbours (modulo 2^16; the last one's right neighbour is its left one)."""
    x = samples.astype(np.int32)
    even = x[0::2]
    mean = (even + np.append(even[1:], even[-1:])) >> 1
    return np.concatenate([even, x[1::2] - mean[: len(x) // 2]]).astype("<u2").tobytes()


def unpack_pcm(packed: bytes) -> np.ndarray:
    """The int16 samples of ``pack_pcm``."""
    raw = np.frombuffer(packed, "<u2")
    even = raw[: (len(raw) + 1) // 2].astype(np.int16).astype(np.int32)
    mean = (even + np.append(even[1:], even[-1:])) >> 1
    out = np.empty(len(raw), np.int16)
    out[0::2] = even
    out[1::2] = (raw[len(even) :].astype(np.int32) + mean[: len(raw) - len(even)]).astype(np.uint16).astype(np.int16)
    return out


def store_text(df: DataFrame, text_col: str = "text", codec: str = "mulaw") -> DataFrame:
    """Adds ``media`` binary: each whole text (null: empty) as telephony samples of a WAVE file.

    The payload is the text's UTF-8 with zero bytes up to a positive multiple of 64, stored unchanged as coded
    samples (mu-law or A-law: a byte a sample; ima: blocks of 64 bytes); n_bytes is the unpadded length. Added columns
    replace those of the same name; repeated rows are stored each; an empty table gives an empty table.
    """
    prepare(df.sparkSession)
    at = position(df, text_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        raw = [(t or "").encode("utf-8", "replace") for t in batch.column(at).to_pylist()]
        media = [wave(b + b"\0" * (-len(b) % UNIT or (0 if b else UNIT)), codec, block=UNIT) for b in raw]
        return [pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())]

    return add_columns(df, [T.StructField("n_bytes", T.LongType(), False), T.StructField("media", T.BinaryType(), False)], run)


def pcm(df: DataFrame, media_col: str = "media", rate: int = 16000, packed: bool = False) -> DataFrame:
    """Adds ``pcm`` binary: little-endian 16-bit samples at `rate`, decoded from any codec of WAVE blobs.

    packed: as ``pack_pcm`` stores them. A null blob, and one that is not a readable WAVE file, give null; a column pcm is
    replaced; repeated rows are decoded each; an empty table gives an empty table. All ADPCM blocks of up to 64 blobs
    are decoded together.
    """
    prepare(df.sparkSession)
    at = position(df, media_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        blobs, out = batch.column(at).to_pylist(), []
        for lo in range(0, len(blobs), 64):
            for found in decode_all(blobs[lo : lo + 64]):
                made = None if found is None else resample(found[1], found[0], rate)
                out.append(None if made is None else pack_pcm(made) if packed else made.astype("<i2").tobytes())
        return [pa.array(out, pa.binary())]

    return add_columns(df, [T.StructField("pcm", T.BinaryType(), True)], run)


def read_back(df: DataFrame, media_col: str = "media", rate: int = 16000, pcm_col: str | None = None, packed: bool = False) -> DataFrame:
    """Digests and features from stored bytes: payload_*, tail_crc32, media_*, feature.

    Null media, and media that are no readable WAVE file, give null values; added columns replace those of the same name;
    repeated rows are read each; an empty table gives an empty table.

    feature: rms, peak and sign changes of the resampled PCM, and the rms of the same bytes read as A-law and,
    in blocks of 64, as ADPCM; ADPCM blocks of a batch are decoded together. pcm_col: the resampled PCM as it was stored
    (see pcm, packed or not), instead of resampling here.
    """
    prepare(df.sparkSession)
    at, ready = position(df, media_col), None if pcm_col is None else position(df, pcm_col)
    kinds = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
             ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]

    def rms(x: np.ndarray) -> int:
        y = x.astype(np.int64)
        return int((y * y).sum() // max(1, len(y)))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows: list[tuple | None] = []
        blobs = batch.column(at).to_pylist()
        pcms = [None] * len(blobs) if ready is None else batch.column(ready).to_pylist()
        for lo in range(0, len(blobs), 64):
            group = blobs[lo : lo + 64]
            parsed = [parse(b) for b in group]
            blocks = [np.frombuffer(p[3], np.uint8)[: len(p[3]) // UNIT * UNIT].reshape(-1, UNIT) if p else np.empty((0, UNIT), np.uint8) for p in parsed]
            adpcm = decode_ima(np.concatenate(blocks)) if blocks else np.empty((0, 121), np.int16)
            start = 0
            for blob, p, mine, made in zip(group, parsed, blocks, pcms[lo : lo + 64], strict=True):
                if p is None:
                    rows.append(None)
                    continue
                data = p[3]
                if made is None:
                    own, samples = decode(blob)
                    out = resample(samples, own, rate)
                else:
                    out = unpack_pcm(made) if packed else np.frombuffer(made, "<i2")
                signs = int(np.count_nonzero((out[1:] < 0) != (out[:-1] < 0)))
                peak = int(np.abs(out.astype(np.int32)).max(initial=0))
                third = rms(adpcm[start : start + len(mine)].reshape(-1))
                start += len(mine)
                feature = f"{p[0]};n={len(out)};ms={rms(out)};peak={peak};zc={signs};alaw={rms(ALAW[np.frombuffer(data, np.uint8)])};ima={third}"
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
        cols = list(zip(*[r or (None,) * 6 for r in rows], strict=True)) or [()] * 6
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return [pa.array(c, t) for c, t in zip(cols, types, strict=True)]

    return add_columns(df, [T.StructField(n, t, True) for n, t in kinds], run)
