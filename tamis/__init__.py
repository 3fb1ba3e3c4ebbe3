"""Table preparation on Spark: stages with an execution degree, cost and benefit models, plan tables."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
