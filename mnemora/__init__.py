"""Agent-memory analytics on Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Task functions of this package travel with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
