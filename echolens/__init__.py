"""Voice-of-customer analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Tasks receive this package's functions by value, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
