"""pipelens: what-if analysis of data-preparation pipelines on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
