"""Media columns: telephony audio in WAV containers.

mu-law and A-law samples are expanded through 256-entry tables, IMA ADPCM blocks are decoded with
numpy across all blocks of a slice of rows at once (a loop over the position inside a block only), channels are
averaged, and the result is resampled and stored as 16-bit PCM. store_payload() keeps any bytes losslessly as mu-law
samples; media_columns() reads the stored bytes back, decodes them by all three rules, and keeps the PCM.

Defined cases: null and empty texts are a payload of 64 zero bytes; a payload is padded to a positive
multiple of 64; equal texts give equal values; a null doc_id stays; repeated rows repeat; files that can't be
read (no samples, rate or channels of 0, blocks without room for their heads, other formats) decode to null.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import docs_text, map_texts

#: WAV format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
#: Changes of the IMA ADPCM step index by the low three bits of a sample.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
#: The 89 IMA ADPCM step sizes.
STEP_SIZES = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int64)


@functools.cache
def mulaw_table() -> np.ndarray:
    """G.711 mu-law by its rule: complemented bits, sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype("<i2")


@functools.cache
def alaw_table() -> np.ndarray:
    """G.711 A-law by its rule: even bits inverted, sign bit set for positive values."""
    code = np.arange(256) ^ 0x55
    mantissa, exponent = (code & 0x0F) << 4, code >> 4 & 7
    size = np.where(exponent == 0, mantissa + 8, mantissa + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype("<i2")


def _adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono blocks (rows of bytes), a row each: the head's and two for each further byte."""
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int64), 0, 88)
    body = blocks[:, 4:]
    codes = np.stack([body & 15, body >> 4], axis=2).reshape(len(blocks), -1).astype(np.int64)
    out = np.empty((len(blocks), codes.shape[1] + 1), "<i2")
    out[:, 0] = value
    for i in range(codes.shape[1]):
        code = codes[:, i]
        value = np.clip(value + adpcm_changes()[index, code], -32768, 32767)
        index = np.clip(index + INDEX_STEPS[code & 7], 0, 88)
        out[:, i + 1] = value
    return out


@functools.cache
def adpcm_changes() -> np.ndarray:
    """Change of the value by step index and code, by the rule of shifted step sizes."""
    step, code = STEP_SIZES[:, None], np.arange(16)
    size = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
    return np.where(code & 8, -size, size).astype(np.int32)


def decode_adpcm(data: bytes, block_bytes: int, channels: int = 1) -> np.ndarray:
    """IMA ADPCM blocks: a 4-byte head for each channel, then words of 4 bytes by turns; channels are averaged.

    Of a short last block the bytes that are there count, if its heads are whole.
    """
    if channels < 1 or block_bytes < 4 * channels:
        raise ValueError("no room for the heads of a block")
    n = len(data) // block_bytes
    parts = [np.frombuffer(data, "u1", n * block_bytes).reshape(n, block_bytes)] if n else []
    short = np.frombuffer(data, "u1", offset=n * block_bytes)
    if len(short) >= 4 * channels:
        parts.append(short[None])
    out = [np.zeros(0, "<i2")]
    for blocks in parts:
        if channels > 1:
            words = (blocks.shape[1] - 4 * channels) // (4 * channels)
            heads, body = blocks[:, : 4 * channels].reshape(-1, channels, 4), blocks[:, 4 * channels : 4 * channels * (words + 1)]
            body = body.reshape(-1, words, channels, 4).transpose(0, 2, 1, 3).reshape(-1, channels, 4 * words)
            each = _adpcm_blocks(np.concatenate([heads, body], axis=2).reshape(len(blocks) * channels, -1))
            out.append(mono(each.reshape(len(blocks), channels, -1).transpose(0, 2, 1).ravel(), channels))
        else:
            out.append(_adpcm_blocks(blocks).ravel())
    return np.concatenate(out)


def mono(samples: np.ndarray, channels: int) -> np.ndarray:
    """The mean of interleaved channels, rounded down; an incomplete last moment goes."""
    if channels == 1:
        return samples.astype("<i2")
    whole = samples[: len(samples) // channels * channels].reshape(-1, channels).astype(np.int64)
    return (whole.sum(axis=1) // channels).astype("<i2")


def wav(data: bytes, tag: int, rate: int = 8000, bits: int = 8, block: int | None = None, channels: int = 1) -> bytes:
    block = block or bits // 8 * channels
    per = (block // channels - 4) * 2 + 1 if tag == IMA_ADPCM else 1
    head = struct.pack("<HHIIHH", tag, channels, rate, rate * block // per, block, bits)
    if tag == IMA_ADPCM:
        head += struct.pack("<HH", 2, per)
    elif tag != PCM:
        head += struct.pack("<H", 0)
    pad = b"\0" * (len(data) % 2)
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> dict:
    """tag, rate, bits, block, channels and the bytes of the data chunk; raises ValueError on other files."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, out = 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            out |= {"tag": tag, "rate": rate, "bits": bits, "block": block, "channels": channels}
        elif name == b"data":
            out["data"] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if "tag" not in out or "data" not in out:
        raise ValueError("no samples")
    return out


def samples(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit PCM and its rate, from any of the four formats."""
    w = read_wav(media)
    tag, rate, channels = w["tag"], w["rate"], w["channels"]
    if not rate or not channels:
        raise ValueError("no rate or no channels")
    if tag == IMA_ADPCM:
        return decode_adpcm(w["data"], w["block"], channels), rate
    if tag == PCM and w["bits"] == 16:
        return mono(np.frombuffer(w["data"][: len(w["data"]) // 2 * 2], "<i2"), channels), rate
    if tag == PCM and w["bits"] == 8:  # unsigned
        return mono((np.frombuffer(w["data"], "u1").astype(np.int16) - 128) << 8, channels), rate
    table = {MULAW: mulaw_table, ALAW: alaw_table}.get(tag)
    if table is None or w["bits"] != 8:
        raise ValueError(f"format {tag} of {w['bits']} bits")
    return mono(table()[np.frombuffer(w["data"], "u1")], channels), rate


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integer arithmetic, so that every machine gives the same samples."""
    if not len(pcm) or rate == to:
        return pcm.astype("<i2")
    n = (len(pcm) * to + rate - 1) // rate
    place = np.arange(n, dtype=np.int64) * rate
    left, part = np.minimum(place // to, len(pcm) - 1), place % to
    right = np.minimum(left + 1, len(pcm) - 1)
    wide = pcm.astype(np.int64)
    return ((wide[left] * (to - part) + wide[right] * part + to // 2) // to).astype("<i2")


def decode_media(media: bytes | None, to: int = 16_000) -> bytes | None:
    """Any supported file as a PCM WAV at the target rate; null for null and for what can't be read."""
    try:
        pcm, rate = samples(media or b"")
    except (ValueError, struct.error):
        return None
    return wav(resample(pcm, rate, to).tobytes(), PCM, to, 16)


def store_payload(text: str) -> tuple[int, bytes]:
    """(bytes of the text, WAV file that holds them as mu-law samples, zero-padded)."""
    raw = text.encode()
    return len(raw), wav(raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)), MULAW)


def describe(pcm: np.ndarray) -> str:
    """Integer features of decoded audio: samples, peak, mean energy, changes of sign."""
    wide = pcm.astype(np.int64)
    crossings = np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0))
    return f"n={len(pcm)},peak={np.abs(wide).max()},energy={(wide * wide).sum() // len(wide)},crossings={crossings}"


#: Bytes of an ADPCM block in payloads, which are multiples of it.
UNIT = 64


def media_columns(docs: DataFrame, with_media: bool = False, to: int = 16_000) -> DataFrame:
    """Digests and features of every text's stored file; the file and its resampled PCM file if asked for.

    The payload that is read back is decoded as mu-law, which is what the file says, and as A-law and
    ADPCM blocks; feature names all three. pcm is the mu-law audio at the target rate.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"]

    def rows(ids: list, texts: list[str]) -> dict:
        out: dict[str, list] = {k: [] for k in [*names, "media", "pcm"]}
        files = [store_payload(t) for t in texts]
        payloads = [read_wav(media)["data"] for _, media in files]
        blocks = decode_adpcm(b"".join(payloads), UNIT).reshape(-1, 2 * UNIT - 7)  # of all rows at once
        at = 0
        for (n, media), payload in zip(files, payloads, strict=True):
            pcm, rate = samples(media)
            alaw = alaw_table()[np.frombuffer(payload, "u1")]
            adpcm = blocks[at : at + len(payload) // UNIT].ravel()
            at += len(payload) // UNIT
            stored = wav(resample(pcm, rate, to).tobytes(), PCM, to, 16)
            values = (
                n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(),
                f"mulaw:{describe(pcm)};alaw:{describe(alaw)};adpcm:{describe(adpcm)}", len(stored), hashlib.sha256(stored).hexdigest(),
            )
            for k, v in zip(names, values, strict=True):
                out[k].append(v)
            if with_media:
                out["media"].append(media)
                out["pcm"].append(stored)
        return {"doc_id": ids} | out

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "feature string, pcm_bytes long, pcm_sha256 string"
    )
    return map_texts(docs_text(docs), schema + ", media binary, pcm binary" * with_media, rows, 64)
