"""PySpark-native analytics for multichannel physiological time series."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the job, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
