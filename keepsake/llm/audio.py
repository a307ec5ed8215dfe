"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded to PCM and resampled."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.staging import few_rows, staged_parts

#: WAVE format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
#: Level of compression of stored files: PCM at twice the rate is four times as large as its samples.
LEVEL = 6
#: The IMA step sizes and index moves of the public ADPCM recommendation.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    """The 256 linear values of G.711 mu-law: code bits inverted, 3 exponent and 4 mantissa bits, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """The 256 linear values of G.711 A-law: even bits inverted, first segment linear."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent, 1) - 1)
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def wav(samples: bytes, tag: int, rate: int = 8000, bits: int = 8, block: int = 1, extra: bytes = b"") -> bytes:
    """A mono WAV file around ``samples``; chunks are padded to even lengths as the container asks."""
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * block if block < 4 else rate // 2, block, bits) + (struct.pack("<H", len(extra)) + extra if tag != PCM else b"")
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, sample bytes) by walking the chunks; ValueError if it is no WAV of one channel."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    at, tag, rate, block = 12, 0, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            if channels != 1:
                raise ValueError(f"{channels} channels")
        elif name == b"data":
            return tag, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """IMA ADPCM mono blocks to PCM: the steps of a block follow each other, all blocks go side by side.

    Each block: a first sample (int16), a step index, a zero byte, then two 4-bit codes a byte, low half
    first. Whole blocks only: ``to_pcm`` decodes a shorter last one by itself.
    """
    n = len(data) // block if block > 4 else 0
    if not n:
        return np.zeros(0, dtype=np.int16)
    raw = np.frombuffer(data, dtype=np.uint8, count=n * block).reshape(n, block)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2].astype(np.int32), 88)
    codes = np.stack([raw[:, 4:] & 15, raw[:, 4:] >> 4], axis=2).reshape(n, -1)
    out = np.empty((n, codes.shape[1] + 1), dtype=np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code, step = codes[:, k].astype(np.int32), STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, 88)
        out[:, k + 1] = value
    return out.reshape(-1)


def to_pcm(media: bytes) -> tuple[np.ndarray, int]:
    """(int16 samples, rate) of a WAV file in any of the four formats."""
    tag, rate, block, data = read_wav(media)
    if tag in TABLES:
        return TABLES[tag][np.frombuffer(data, dtype=np.uint8)], rate
    if tag == IMA_ADPCM:
        if block <= 4:
            raise ValueError(f"ADPCM blocks of {block} bytes")
        rest = data[len(data) - len(data) % block :]
        if len(rest) > 4:
            last = decode_adpcm(rest, len(rest))
        else:  # no codes: the first sample is all there is
            last = np.frombuffer(rest[:2] if len(rest) >= 2 else b"", dtype="<i2").astype(np.int16)
        return np.concatenate([decode_adpcm(data, block), last]), rate
    if tag == PCM:
        return np.frombuffer(data[: len(data) & ~1], dtype="<i2").astype(np.int16), rate
    raise ValueError(f"format {tag}")


def adpcm_together(files: list[bytes | None]) -> dict[int, np.ndarray]:
    """The samples of those files, by place, that are whole ADPCM blocks: the blocks of all files side by side."""
    by_size: dict[int, list[tuple[int, bytes]]] = {}
    for k, x in enumerate(files):
        try:
            tag, _, block, data = read_wav(x or b"")
        except (ValueError, struct.error):
            continue
        if tag == IMA_ADPCM and block > 4 and data and len(data) % block == 0:
            by_size.setdefault(block, []).append((k, data))
    found = {}
    for block, own in by_size.items():
        samples = decode_adpcm(b"".join(data for _, data in own), block)
        ends = np.cumsum([len(data) // block * (2 * (block - 4) + 1) for _, data in own])
        found |= {k: part for (k, _), part in zip(own, np.split(samples, ends[:-1]), strict=True)}
    return found


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation on the new clock; as many samples as the duration holds."""
    if rate == to or not len(pcm) or not rate:
        return pcm
    at = np.arange(len(pcm) * to // rate, dtype=np.float64) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def features(pcm: np.ndarray, rate: int) -> str:
    """Duration, peak, loudness and zero crossings, as one line; equal samples give equal lines."""
    if not len(pcm):
        return "samples=0"
    x = pcm.astype(np.int64)
    signs = pcm >= 0
    return f"samples={len(x)} ms={len(x) * 1000 // max(rate, 1)} peak={int(np.abs(x).max())} energy={int((x * x).sum()) // len(x)} mean={int(x.sum()) // len(x)} crossings={int((signs[1:] != signs[:-1]).sum())}"


def container(samples: bytes, tag: int, rate: int = 8000, block: int = 64) -> bytes:
    """A telephony WAV file whose data bytes are ``samples``, unchanged, in the format ``tag``.

    ADPCM takes ``block`` bytes as one block: a header of four, then two codes a byte.
    """
    if tag == IMA_ADPCM:
        return wav(samples, tag, rate, 4, block, struct.pack("<H", 2 * (block - 4) + 1))
    return wav(samples, tag, rate)


def store_payloads(df: DataFrame, payload: str, formats: tuple[int, ...] = (MULAW, ALAW), rate: int = 8000, keep: tuple[str, ...] = (), parts: int = 1) -> list[DataFrame]:
    """Store each row's payload bytes unchanged as the sample bytes of a telephony WAV file.

    The format is one of ``formats``, by the payload's crc32, so equal payloads make equal files. The rows
    are written to the shared folder as Parquet, as up to ``parts`` tables that can be released one by one,
    and read back: columns ``keep`` and ``media``. Null payloads store a file without samples. No row is
    dropped and nothing is shuffled.
    """

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            media = [container(x or b"", formats[zlib.crc32(x or b"") % len(formats)], rate) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(media, pa.binary())], names=[*keep, "media"])

    small = df.select(*keep, F.col(payload).cast("binary").alias("_payload"))
    schema = ", ".join(f"`{c}` {t}" for c, t in small.dtypes[:-1]) + (", " if keep else "") + "media binary"
    return staged_parts(small.mapInArrow(wrap, schema), "audio", parts, "zstd", LEVEL)


def decode_audio(df: DataFrame, media: str = "media", to_rate: int = 16000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decode stored telephony audio and resample it to PCM.

    Returns ``keep``, ``samples`` (the stored sample bytes), ``pcm`` (a 16-bit WAV at ``to_rate``),
    ``feature`` and ``error`` (null, or why a file could not be read: then the other three are null).
    Null media count as unreadable. Rows are independent: no shuffle, one batch in memory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            rows, files = [], b.column(len(keep)).to_pylist()
            known = adpcm_together(files)
            for k, x in enumerate(files):
                try:
                    pcm, rate = (known[k], read_wav(x)[1]) if k in known else to_pcm(x or b"")
                    rows.append((read_wav(x)[3], wav(resample(pcm, rate, to_rate).astype("<i2").tobytes(), PCM, to_rate, 16, 2), features(pcm, rate), None))
                except (ValueError, struct.error) as e:
                    rows.append((None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=[*keep, "samples", "pcm", "feature", "error"])

    small = df.select(*keep, F.col(media).alias("_media"))
    schema = ", ".join(f"`{c}` {t}" for c, t in small.dtypes[:-1]) + (", " if keep else "") + "samples binary, pcm binary, feature string, error string"
    return small.mapInArrow(read, schema)


def pcm_features(df: DataFrame, pcm: str = "pcm", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the ``feature`` of stored PCM files; null for a null file. Rows are independent."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            found = [None if x is None else features(*to_pcm(x)) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, pa.string())], names=[*keep, "feature"])

    small = df.select(*keep, F.col(pcm).alias("_pcm"))
    return small.mapInArrow(read, ", ".join(f"`{c}` {t}" for c, t in small.dtypes[:-1]) + (", " if keep else "") + "feature string")
