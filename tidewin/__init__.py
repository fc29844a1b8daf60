"""Analytics on PySpark for long multichannel recordings, and operators for training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks, so executors need no copy of it, however the library is used.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
