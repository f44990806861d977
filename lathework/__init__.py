"""lathework: a Spark-native analytics engine for long-form feature matrices and record tables.

Functions handed to Python workers are pickled by value, so executors need no
copy of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
