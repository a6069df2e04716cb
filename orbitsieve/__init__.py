"""Mining large orbit catalogs on Spark: filters, geometry, sampling, kernel splits, clusters.

Everything takes and returns DataFrames; hazard class is a ``label`` column (1/0), never a pair
of frames, and a row is identified by ``oid``.
"""

import sys

from pyspark import cloudpickle

# Ship the helpers of this package to Python workers by value, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
