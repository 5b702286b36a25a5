"""Operators for building training corpora, one module per operator.

Functions of this package are sent to the executors by value, so that workers need only the
third-party libraries, not an installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
