"""The WAV format: headers by their chunk list, samples of all PCM and float kinds."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Tags of the format chunk, and the end of a sub-format's GUID that stands for such a tag.
PCM_TAG, FLOAT_TAG, EXTENSIBLE_TAG = 1, 3, 0xFFFE
SUBFORMAT_TAIL = bytes.fromhex("000000001000800000aa00389b71")
#: A size that 32 bits can't hold, or that was unknown when the header was written; then it may be 0 as well.
OPEN_SIZE = 0xFFFFFFFF
#: How much of a file is fetched at a time while its chunk list is followed.
HEAD_BYTES = 4096


@dataclass(frozen=True)
class WavHeader:
    sample_rate: int
    channels: int
    width: int  # bytes of a value
    is_float: bool
    begin: int  # first byte of the samples
    n_bytes: int

    @property
    def frame(self) -> int:
        return self.channels * self.width

    @property
    def n_samples(self) -> int:
        return self.n_bytes // self.frame

    @property
    def duration(self) -> float:
        return self.n_samples / self.sample_rate


def format_of(chunk: bytes) -> tuple[int, int, int, bool] | None:
    """(sample rate, channels, bytes of a value, whether floats) of a format chunk, None if it is another codec's."""
    if len(chunk) < 16:
        return None
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", chunk)
    if tag == EXTENSIBLE_TAG:
        if len(chunk) < 40 or chunk[26:40] != SUBFORMAT_TAIL:
            return None
        tag = struct.unpack_from("<H", chunk, 24)[0]
    width = bits // 8
    known = (tag == PCM_TAG and width in (1, 2, 3, 4)) or (tag == FLOAT_TAG and width in (4, 8))
    return (rate, channels, width, tag == FLOAT_TAG) if known and bits % 8 == 0 and channels and rate else None


def parse_header(read_at: Callable[[int, int], bytes], length: int) -> WavHeader | None:
    """The header of a file of ``length`` bytes, wherever its samples begin; None if it is no PCM or float WAV.

    ``read_at`` gives some bytes from a place.  Chunks other than the format and
    the sizes of a 64-bit file are stepped over, not read.  A data chunk that
    says more than the file holds, or nothing, goes on to the file's end.
    """
    held, held_at = b"", 0

    def get(at: int, n: int) -> bytes:
        nonlocal held, held_at
        if at < held_at or at + n > held_at + len(held):
            held, held_at = read_at(at, max(n, HEAD_BYTES)), at
        return held[at - held_at : at - held_at + n]

    top = get(0, 12)
    if len(top) < 12 or top[:4] not in (b"RIFF", b"RF64") or top[8:] != b"WAVE":
        return None
    at, form, long_size = 12, None, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", get(at, 8))
        if name == b"ds64" and size >= 16:
            long_size = struct.unpack_from("<Q", get(at + 8, 16), 8)[0]
        elif name == b"fmt ":
            form = format_of(get(at + 8, min(size, 40)))
        elif name == b"data":
            if form is None:
                return None
            if size == OPEN_SIZE and long_size is not None:
                size = long_size
            left = max(0, length - at - 8)
            open_ended = size == OPEN_SIZE or (size == 0 and struct.unpack_from("<I", top, 4)[0] in (0, OPEN_SIZE))
            return WavHeader(*form, at + 8, left if open_ended else min(size, left))
        at += 8 + size + size % 2
    return None


def decode_values(raw: bytes, width: int, is_float: bool) -> np.ndarray:
    """Values as doubles, whole numbers scaled to [-1, 1)."""
    raw = raw[: len(raw) // width * width]
    if is_float:
        return np.frombuffer(raw, f"<f{width}").astype(float)
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    if width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return (wide.view("<i4")[:, 0] >> 8) / float(1 << 23)
    return np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))


def mono(raw: bytes, header: WavHeader) -> np.ndarray:
    """The mean of the channels of whole frames."""
    values = decode_values(raw[: len(raw) // header.frame * header.frame], header.width, header.is_float)
    return values.reshape(-1, header.channels).mean(axis=1) if header.channels > 1 else values


def encode_values(samples: np.ndarray, width: int = 2, is_float: bool = False) -> bytes:
    """Little-endian values of samples in [-1, 1], clipped unless they are floats."""
    if is_float:
        return np.asarray(samples).astype(f"<f{width}").tobytes()
    top = (1 << (8 * width - 1)) - 1
    whole = np.clip(np.round(np.asarray(samples, float) * top), -top - 1, top).astype("<i4")
    if width == 3:
        return whole.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return (whole + 128).astype(np.uint8).tobytes() if width == 1 else whole.astype(f"<i{width}").tobytes()


#: Bytes before the samples of a file written here: a chunk is left free for the sizes of a 64-bit file.
WRITTEN_BEGIN = 80


def written_header(n_samples: int, sample_rate: int, width: int = 2, is_float: bool = False) -> bytes:
    """``WRITTEN_BEGIN`` bytes before the samples of a mono file of any size."""
    n_bytes = n_samples * width
    large = WRITTEN_BEGIN + n_bytes + 1 > 0xFFFFFFFF
    whole = WRITTEN_BEGIN - 8 + n_bytes + n_bytes % 2
    sizes = struct.pack("<QQQI", whole, n_bytes, n_samples, 0)
    top = struct.pack("<4sI4s", b"RF64" if large else b"RIFF", 0xFFFFFFFF if large else whole, b"WAVE")
    spare = struct.pack("<4sI", b"ds64" if large else b"JUNK", len(sizes)) + (sizes if large else bytes(len(sizes)))
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, FLOAT_TAG if is_float else PCM_TAG, 1, sample_rate, sample_rate * width, width, 8 * width)
    return top + spare + form + struct.pack("<4sI", b"data", 0xFFFFFFFF if large else n_bytes)
