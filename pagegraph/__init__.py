"""pagegraph: analytics over web-page snapshots, written for Spark's DataFrame engine."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
