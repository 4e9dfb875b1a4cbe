"""vectorloom: vector search, clustering and vector preprocessing as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
