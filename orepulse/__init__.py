"""Fleet telemetry analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from orepulse.session import checkpoint_cut, spark_session

# Functions that run in Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["checkpoint_cut", "spark_session"]
