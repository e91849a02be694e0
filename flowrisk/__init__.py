"""Transaction-network risk analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors with the task, so nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
