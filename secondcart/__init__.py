"""Repeat-purchase analytics over order histories, written as Spark jobs."""

import sys

from pyspark import cloudpickle

from secondcart.config import Config

__all__ = ["Config"]

# The few functions that run in Python workers travel inside the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
