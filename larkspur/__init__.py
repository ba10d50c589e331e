"""larkspur: memoized dataflow and data-processing operators on PySpark."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
