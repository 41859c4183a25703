"""Evidence-and-decision analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions go to executors by value, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
