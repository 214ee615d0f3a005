"""Marlstone: a PySpark-native analytics engine for package-ecosystem data.

Every operator is a pure function ``DataFrame -> DataFrame``; Catalyst plans the physical strategy.
"""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Functions of this package travel by value, so executors need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
