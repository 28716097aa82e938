"""glintscan: sensitive-content scanning as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the package's few Arrow functions by value, so executors need no copy
# of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
