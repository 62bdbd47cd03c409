"""Chat-record analytics as DataFrame-in, DataFrame-out operators on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the folds and UDFs with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
