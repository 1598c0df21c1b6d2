"""corrspark: context-based correspondence and corpus preparation on Spark DataFrames.

Functions of this package that run inside Python workers are pickled by value, so executors do not need
the package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
