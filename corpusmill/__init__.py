"""Spark-native engine for curating image-and-caption and text corpora."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
