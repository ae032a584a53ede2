"""What keeps Python workers small."""

from __future__ import annotations

import ctypes

import pyarrow as pa

#: About so many bytes of a batch are held as Python objects at once.
MOST_HELD = 8 << 20


def give_back() -> None:
    """Hands memory that is free in a Python worker back to the machine: workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
