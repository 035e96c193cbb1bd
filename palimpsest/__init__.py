"""Batch retrieval analytics over conversational memory, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel with the tasks, so executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
