"""Audio columns: header probes, decoding of WAV and FLAC, resampling. Only the standard library and numpy are needed."""

from __future__ import annotations

import io
import math
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac


def probe(content: bytes | None) -> tuple[int, int, int] | None:
    """(frames, rate, channels) from the header of WAV or FLAC bytes, without decoding; None if unreadable."""
    if not content:
        return None
    if content[:4] == b"fLaC" and len(content) >= 26:
        info = int.from_bytes(content[18:26], "big")
        rate, channels, frames = info >> 44, ((info >> 41) & 7) + 1, info & ((1 << 36) - 1)
        return (frames, rate, channels) if rate and frames else None
    try:
        with wave.open(io.BytesIO(content)) as w:
            return w.getnframes(), w.getframerate(), w.getnchannels()
    except (wave.Error, EOFError):
        return None


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the rate of WAV bytes."""
    with wave.open(io.BytesIO(content)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        data = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        data = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8).astype(np.float32) / float(1 << 23)
    elif width in (2, 4):
        data = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"sample width {width}")
    return data.reshape(-1, channels).mean(axis=1), rate


def resample(samples: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Band-limited resampling by the reduced ratio; ceil(n x up / down) samples."""
    if rate == wanted or not len(samples):
        return samples.astype(np.float32)
    g = math.gcd(rate, wanted)
    up, down = wanted // g, rate // g
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    kernel = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    kernel *= up / kernel.sum()
    count = -(-len(samples) * up // down)
    place = np.arange(count) * down
    first = -(-(place - half) // up)
    taps = np.arange(2 * half // up + 2)
    index = first[:, None] + taps[None, :]
    offset = place[:, None] - index * up + half
    ok = (index >= 0) & (index < len(samples)) & (offset >= 0) & (offset <= 2 * half)
    values = np.where(ok, samples[np.clip(index, 0, len(samples) - 1)] * kernel[np.clip(offset, 0, 2 * half)], 0.0)
    return values.sum(axis=1).astype(np.float32)


def to_mono(field, rate: int) -> np.ndarray:
    """Samples at ``rate`` of WAV or FLAC bytes or of {array, sampling_rate}; empty or non-finite audio is an error."""
    if isinstance(field, (bytes, bytearray)):
        data, own = flac.decode(bytes(field)) if field[:4] == b"fLaC" else decode_wav(bytes(field))
    else:
        data, own = np.asarray(field["array"], dtype=np.float32), int(field["sampling_rate"])
        data = data.mean(axis=tuple(range(1, data.ndim))) if data.ndim > 1 else data
    data = resample(data, own, rate)
    if not len(data) or not np.isfinite(data).all():
        raise ValueError("audio is empty or not finite")
    return data


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM bytes of mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def probe_column(df: DataFrame, key: str, content: str) -> DataFrame:
    """frames, sample_rate, channels and duration of each row's audio bytes; nulls where unreadable."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, c in zip(frame[key], frame[content], strict=True):
                p = probe(c)
                rows.append((k, *p, p[0] / p[1]) if p else (k, None, None, None, None))
            out = pd.DataFrame(rows, columns=[key, "frames", "sample_rate", "channels", "duration"])
            for c in ("frames", "sample_rate", "channels"):
                out[c] = out[c].astype("Int64")
            yield out

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInPandas(run, f"{key} {kind}, frames long, sample_rate long, channels long, duration double")


def decode_column(df: DataFrame, key: str, content: str, rate: int) -> DataFrame:
    """Mono samples at ``rate`` of each row's WAV or FLAC bytes, or the ``reason`` why there are none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, c in zip(frame[key], frame[content], strict=True):
                try:
                    rows.append((k, to_mono(c, rate), None))
                except (ValueError, TypeError, EOFError, wave.Error) as e:
                    rows.append((k, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=[key, "samples", "reason"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInPandas(run, f"{key} {kind}, samples array<float>, reason string")


def stretch(samples: np.ndarray, factor: float, longest: int = 480_000, frame: int = 1024) -> np.ndarray:
    """Faster (factor above 1) or slower audio of the same pitch, by overlapping windows, cut at ``longest`` samples."""
    hop = frame // 2
    if len(samples) < frame or factor <= 0:
        return samples[:longest].astype(np.float32)
    count = max(1, int((len(samples) - frame) / (hop * factor)) + 1)
    out, weight, window = np.zeros(count * hop + frame), np.zeros(count * hop + frame), np.hanning(frame)
    at = 0
    for i in range(count):
        want = int(i * hop * factor)
        if i:  # the nearby offset whose start agrees best with what follows the last window
            tail = samples[at + hop : at + hop + hop]
            lows = range(max(0, want - 128), min(len(samples) - frame, want + 128) + 1, 8)
            want = max(lows, key=lambda o: float(np.dot(samples[o : o + len(tail)], tail)), default=want)
        at = min(want, len(samples) - frame)
        out[i * hop : i * hop + frame] += samples[at : at + frame] * window
        weight[i * hop : i * hop + frame] += window
    return (out / np.maximum(weight, 1e-3))[:longest].astype(np.float32)


def stretch_column(df: DataFrame, key: str, samples: str, factor: float, longest: int = 480_000, frame: int = 1024) -> DataFrame:
    """Each row's samples faster or slower at the same pitch; null samples stay null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            made = [None if x is None else stretch(np.asarray(x, np.float32), factor, longest, frame) for x in part[samples]]
            yield pd.DataFrame({key: part[key].to_numpy(), "samples": made})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, samples).mapInPandas(run, f"{key} {kind}, samples array<float>")


def write_clips(df: DataFrame, path: str, samples: str, rate: int) -> None:
    """One file per row at its ``path`` (FLAC by that suffix, else WAV), on any storage; complete files are left alone.

    A path may be a plain one or name its file system. A file is written beside its place and then moved there.
    """

    def write(rows) -> None:
        for r in rows:
            fs, target = pafs.FileSystem.from_uri(r[path]) if "://" in r[path] else (pafs.LocalFileSystem(), r[path].removeprefix("file:"))
            if fs.get_file_info(target).type != pafs.FileType.NotFound:
                continue
            fs.create_dir(target.rpartition("/")[0], recursive=True)
            part = f"{target}.{uuid.uuid4().hex}"
            data = np.asarray(r[samples], np.float32)
            with fs.open_output_stream(part) as f:
                f.write(flac.encode(data, rate) if target.lower().endswith(".flac") else encode_wav(data, rate))
            fs.move(part, target)

    df.where(F.col(path).isNotNull() & F.col(samples).isNotNull()).select(path, samples).foreachPartition(write)


def missing_files(df: DataFrame, path: str, folder: str) -> DataFrame:
    """Rows whose audio file does not lie under ``folder``; only names are listed, no content is read."""
    listed = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    names = listed.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("_path"))
    return df.join(names, F.regexp_replace(F.col(path), "^[a-z]+:/+", "/") == F.col("_path"), "left_anti")
