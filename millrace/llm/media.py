"""Media columns: telephony audio.

Payload bytes are stored without loss in a WAV container as mu-law, A-law or IMA ADPCM and
read back from it. Decoding expands mu-law and A-law by lookup tables; ADPCM is decoded step
by step inside a block, but with numpy across all blocks of a batch at once. Decoded 8 kHz
samples are resampled to 16-bit PCM of any rate by a windowed sinc filter, whose integer products
and sums are exact in double precision, so that PCM is the same on every machine.

Media and PCM are columns of one table, which is stored and read back before anything is reported
of it. That is done for a part of the documents at a time, and a part's table goes when its digests
are stored, so that the disk never holds the PCM of all.

Defined results: a null text is empty; an empty payload becomes one padded unit; equal
payloads give equal media, PCM and features; repeated rows are repeated; an empty table
gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, dropped, held, pick, stored, text_slices, trim, utf8

UNIT = 192  # payload bytes are padded to a multiple of this
PAD = 32
RATE = 8000
ALAW, MULAW, ADPCM = 6, 7, 17  # fixed values: format tags of the WAV container
#: Parts of the documents whose media and PCM are stored one after another.
PARTS = 8
BLOCK = 4 + UNIT  # an ADPCM block: predictor, step index, reserved byte, then the nibbles

# Step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    power, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(power == 0, low, (low + 256) << np.maximum(power - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()
#: What one nibble adds to the predictor, by step index, and the index after it.
_NIBBLE = np.arange(16)
_DELTA = (STEPS[:, None] >> 3) + np.where(_NIBBLE & 4, STEPS[:, None], 0) + np.where(_NIBBLE & 2, STEPS[:, None] >> 1, 0) + np.where(_NIBBLE & 1, STEPS[:, None] >> 2, 0)
_DELTA = np.where(_NIBBLE & 8, -_DELTA, _DELTA).astype(np.int32).ravel()
_NEXT = (np.clip(np.arange(89)[:, None] + CHANGES[None, :], 0, 88) * 16).astype(np.int32).ravel()


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % UNIT or (0 if text else UNIT))


def to_wav(payload: bytes, tag: int) -> bytes:
    """The payload as the data chunk of a mono 8 kHz WAV file; for ADPCM, each unit is a block's nibbles."""
    if tag == ADPCM:
        units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data = np.concatenate([np.zeros((len(units), BLOCK - UNIT), np.uint8), units], axis=1).tobytes()
        per_block = 2 * UNIT + 1
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(units) * per_block
    else:
        data, samples = payload, len(payload)
        fmt = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Format tag and data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag = 12, 0
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif kind == b"data":
            return tag, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def payload_of(media: bytes) -> bytes:
    tag, data = read_wav(media)
    return np.frombuffer(data, np.uint8).reshape(-1, BLOCK)[:, BLOCK - UNIT :].tobytes() if tag == ADPCM else data


def adpcm_pcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (one a row, as bytes) to 16-bit samples, one row a block."""
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.int32)
    nibbles = blocks[:, 4:].T
    codes[0::2], codes[1::2] = nibbles & 15, nibbles >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88) * 16
    out[0] = value
    for k in range(len(codes)):
        index += codes[k]
        value += _DELTA[index]
        np.minimum(value, 32767, out=value)
        np.maximum(value, -32768, out=value)
        out[k + 1] = value
        index = _NEXT[index]
    return out.T


def decode(media: list[bytes]) -> list[np.ndarray]:
    """8 kHz 16-bit samples of each file; all ADPCM blocks of the list are decoded together."""
    out: list = [None] * len(media)
    waiting, blocks = [], []
    for i, m in enumerate(media):
        tag, data = read_wav(m)
        if tag == ADPCM:
            waiting.append(i)
            blocks.append(np.frombuffer(data, np.uint8).reshape(-1, BLOCK))
        elif tag in (MULAW, ALAW):
            out[i] = (MULAW_PCM if tag == MULAW else ALAW_PCM)[np.frombuffer(data, np.uint8)]
        else:
            raise ValueError(f"format {tag} isn't telephony audio")
    if waiting:
        pcm, at = adpcm_pcm(np.concatenate(blocks)), 0
        for i, b in zip(waiting, blocks):
            out[i] = pcm[at : at + len(b)].reshape(-1)
            at += len(b)
    return out


#: Zero crossings of the filter on each side, and the sum of a phase's coefficients.
CROSSINGS, UNITY = 4, 1 << 15


@functools.cache
def phases(rate: int) -> tuple[int, int, np.ndarray]:
    """up, down (rate / RATE in lowest terms) and the filter: a row of coefficients for each of `up` phases."""
    up, down = rate // math.gcd(rate, RATE), RATE // math.gcd(rate, RATE)
    wide = max(up, down)
    side = -(-CROSSINGS * wide // up)
    at = (np.arange(-side, side + 1)[None, :] * up + (np.arange(up) * down % up)[:, None]) / wide
    h = np.where(np.abs(at) < CROSSINGS, np.sinc(at) * (0.5 + 0.5 * np.cos(np.pi * at / CROSSINGS)), 0.0)
    h = np.rint(h / h.sum(axis=1, keepdims=True) * UNITY)
    h[:, side] += UNITY - h.sum(axis=1)
    return up, down, h[:, ::-1].copy()


def resample(pcm: list[np.ndarray], rate: int) -> list[np.ndarray]:
    """8 kHz samples at another rate, each file by itself; beyond its ends there is silence."""
    up, down, h = phases(rate)
    side = h.shape[1] // 2
    # files stand apart by silence, at places where the phases begin anew
    rooms = [-(-(len(x) + 2 * side) // down) * down for x in pcm]
    starts = np.cumsum([0, *rooms])
    whole = np.zeros(int(starts[-1]) + 2 * side + down, np.float64)
    for a, x in zip(starts.tolist(), pcm):
        whole[a + side : a + side + len(x)] = x
    n = int(starts[-1]) // down * up
    out = np.empty(n, np.int16)
    windows = np.lib.stride_tricks.sliding_window_view(whole, 2 * side + 1)
    for p in range(up):
        some = windows[p * down // up :: down][: -(-(n - p) // up)]
        for a in range(0, len(some), 1 << 16):
            sums = some[a : a + (1 << 16)] @ h[p]
            out[p::up][a : a + (1 << 16)] = np.clip(np.floor(sums / UNITY + 0.5), -32768, 32767)
    return [out[a // down * up :][: -(-len(x) * up // down)] for a, x in zip(starts.tolist(), pcm)]


def features(pcm: np.ndarray) -> str:
    """Samples, root mean square, peak, zero crossings and checksum of PCM."""
    x = pcm.astype(np.float64)
    rms = float(np.sqrt(x @ x / len(x))) if len(x) else 0.0
    peak = int(np.abs(pcm.astype(np.int32)).max()) if len(x) else 0
    sign = pcm < 0
    return f"n={len(pcm)};rms={rms:.3f};peak={peak};zc={int(np.count_nonzero(sign[1:] != sign[:-1]))};crc={zlib.crc32(pcm.tobytes())}"


def codec_of(payload: bytes) -> int:
    """The payload's own checksum picks its codec, so that equal texts get equal media."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def media_columns(docs: DataFrame, rate: int = 16000) -> DataFrame:
    """doc_id, n_bytes, codec, media (WAV), rate and pcm (resampled, 16-bit little-endian) of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("codec", pa.int32()), ("media", pa.binary()), ("rate", pa.int32()), ("pcm", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for b in text_slices(batches, most=1 << 20):
            trim()
            texts = utf8(b.column(1))
            payloads = [padded(t) for t in texts]
            media = [to_wav(p, codec_of(p)) for p in payloads]
            pcm = resample(decode(media), rate)
            yield batch(schema, b.column(0), [len(t) for t in texts], [read_wav(m[:64])[0] for m in media], media, [rate] * len(media), [x.astype("<i2").tobytes() for x in pcm])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, codec int, media binary, rate int, pcm binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Reads stored media and PCM back: digests of the payload and of the stored form, and features of the PCM."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for b in text_slices(batches, "media", 2 << 20):
            trim()
            files = b.column(2).to_pylist()
            payloads = [payload_of(m) for m in files]
            told = [features(np.frombuffer(x, "<i2")) for x in b.column(4).to_pylist()]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield batch(schema, b.column(0), b.column(1), [len(p) for p in payloads], [sha(p) for p in payloads], [zlib.crc32(p[-16:]) for p in payloads], [len(m) for m in files], [sha(m) for m in files], told, b.column(3))

    return pick(media, "doc_id", "n_bytes", "media", "codec", "pcm").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec int")


def stored_digests(docs: DataFrame, rate: int = 16000) -> DataFrame:
    """media_digests() of every document, from media and PCM that are stored and read back a part at a time."""
    part = F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(PARTS))
    found = []
    for k in range(PARTS):
        media = stored(media_columns(docs.where(part == k), rate), "media", level=6)
        found.append(stored(media_digests(media), "digests"))
        dropped(media)
    return functools.reduce(DataFrame.union, found)
