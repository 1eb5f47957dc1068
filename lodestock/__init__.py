"""Spark-first mixed models, pedigrees, genomics and selection."""

import os

# dense kernels are small and run beside Spark's own threads: more BLAS threads than free cores only wait for each other
os.environ.setdefault("OMP_NUM_THREADS", "1")

__version__ = "0.1.0"

from lodestock.blas import one_thread

one_thread()
