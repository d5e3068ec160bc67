"""termloom: full-text search and text-data processing expressed as Spark plans."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python workers get this package's functions with the task, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
