"""Haplotype fine-mapping and data preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy of
# this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
