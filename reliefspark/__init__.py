"""Relief analytics on Spark: elevation, point-cloud and map-tile operators over DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
