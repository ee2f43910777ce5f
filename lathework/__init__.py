"""Spark-first analytics over benchmark-run records."""

import sys

from pyspark import cloudpickle

# Python operators travel inside the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
