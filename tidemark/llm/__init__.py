"""Operators of a training-data pipeline: mixing, deduplication, scoring, filtering, packing."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions of this package with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
