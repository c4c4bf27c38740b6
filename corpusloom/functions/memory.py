"""Memory of Python workers, which live on beside others in their executor."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Give back to the system what this worker no longer needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)
