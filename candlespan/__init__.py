"""candlespan: panel analytics over daily price bars, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Grouped-map functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
