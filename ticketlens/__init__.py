"""Support-desk analytics as PySpark DataFrame and Structured Streaming jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run inside tasks travel with the job, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
