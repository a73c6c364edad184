"""Tessera: catalog curation, record linkage and corpus preparation on PySpark.

Every operator takes and returns DataFrames.  Functions that run in Python workers are shipped by
value, so executors need the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
