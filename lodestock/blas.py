"""One thread for NumPy's linear algebra.

A process that has started another one (as a Spark driver starts its JVM) can find OpenBLAS waiting for
threads that its fork handlers ended: an inverse of a hundred rows then never returns. What is parallel here
is Spark's; so the library is held at one thread, unless OPENBLAS_NUM_THREADS says otherwise.
"""

from __future__ import annotations

import ctypes
import os

import numpy  # noqa: F401  # loads the library


def one_thread() -> None:
    if "OPENBLAS_NUM_THREADS" in os.environ:
        return
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line.lower() and ".so" in line}
    except OSError:  # not Linux
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break
