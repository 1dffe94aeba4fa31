"""Keeps numpy's linear algebra to one thread in workers that already share the cores."""

from __future__ import annotations

import ctypes
import glob
import os


def one_thread() -> None:
    """Sets the bundled BLAS to one thread; does nothing where it isn't found."""
    import numpy

    for path in glob.glob(os.path.join(os.path.dirname(numpy.__file__), os.pardir, "numpy.libs", "*openblas*")):
        try:
            lib = ctypes.CDLL(path)
        except OSError:
            continue
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break
