"""Transcript-stream stabilisation, speech evaluation and latency analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so nothing is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
