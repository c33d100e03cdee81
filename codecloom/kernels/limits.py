"""Levels, capacities, output caps, and the errors that the codecs raise."""

from __future__ import annotations

import math

#: Largest output when no cap is given.
MAX_OUTPUT = 256 * 1024 * 1024
#: Default size of a trained dictionary.
MAX_DICTIONARY = 112_640

#: Least level, greatest level, default, and what the error calls them.
LEVELS = {
    "zstd": (-131072, 22, 3, "zstd compression level"),
    "gzip": (0, 9, 6, "gzip compression level"),
    "deflate": (0, 9, 6, "deflate compression level"),
    "brotli": (0, 11, 6, "brotli quality"),
}


class CodecError(Exception):
    """Corrupt or truncated data, or data that a codec cannot make sense of."""


class SizeLimitError(CodecError):
    """The output is longer than its cap."""

    def __init__(self, context: str, limit: int):
        super().__init__(f"{context} exceeded maximum size of {limit} bytes")


class StreamFinishedError(CodecError):
    def __init__(self, name: str):
        super().__init__(f"{name} already finished")


def failed(context: str, why) -> CodecError:
    return CodecError(f"{context} failed: {why}")


def level_of(codec: str, level: int | None) -> int | None:
    """The level to use; ValueError if it is out of the codec's range. LZ4 has none."""
    if codec not in LEVELS:
        return None
    low, high, default, name = LEVELS[codec]
    if level is None:
        return default
    if not low <= level <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return default if codec == "zstd" and level == 0 else int(level)


def capacity_of(value) -> int | None:
    """A capacity given by the caller: a whole number from 0."""
    if value is None:
        return None
    if not math.isfinite(value) or value < 0 or value != int(value) or value > 2**64 - 1:
        raise ValueError("capacity must be a non-negative integer")
    return int(value)


def max_output_of(value) -> int:
    """A cap on a stream's output: finite, not negative; fractions are dropped."""
    if value is None:
        return MAX_OUTPUT
    if not math.isfinite(value) or value < 0:
        raise ValueError("maxOutputSize must be a positive finite number")
    return int(value)
