"""Spark-native analysis of per-sample genome state sequences and rate landscapes."""

import sys

from pyspark import cloudpickle

# grouped functions travel with the job, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
