"""Incident analytics over operational logs, expressed as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel with the job, so executors need no installed package.
register_pickle_by_value(sys.modules[__name__])
