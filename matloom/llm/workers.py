"""Memory of Python workers, which Spark reuses for the stages that follow."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def tidy() -> None:
    """Gives what a task has freed back to the system; on systems without malloc_trim only what Python and Arrow can give."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
