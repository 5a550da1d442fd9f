"""The one exception of the engine, with the codes of its kinds."""

from __future__ import annotations

# Code, kind.
ZERO_SIZE, SOURCE_TOO_LARGE, DESTINATION_TOO_LARGE, BUFFER_MISMATCH, INVALID_STRIDE, UNSUPPORTED_BIT_DEPTH, UNKNOWN_FILTER = range(1, 8)
OUT_OF_MEMORY, INVALID_SCRATCH, INVALID_SOURCE_SIZE, INVALID_DESTINATION_SIZE, EMPTY_PLAN, GENERIC, CROP_OUT_OF_BOUNDS = range(8, 15)


class ResampleError(ValueError):
    def __init__(self, code: int, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code
