"""Customer-support text triage and label evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
