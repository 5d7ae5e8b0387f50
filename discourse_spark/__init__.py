"""Spark-native analysis of group-divisive language in social-media posts."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Scorers and batch functions travel with the job: workers need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
