"""Fleet telemetry and routing analytics on Spark.

Functions of this package are pickled by value, so executors need nothing but
PySpark, numpy, pandas and pyarrow on their path to run them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
