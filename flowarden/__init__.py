"""Spark-native network-traffic analytics: sources, flow assembly, detection, evaluation, streaming."""

import sys

from pyspark import cloudpickle

# Worker-side kernels travel with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
