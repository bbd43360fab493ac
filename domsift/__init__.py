"""Spark-native detection over feeds of newly seen domain names.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL functions, joins, windows and (for the stream-only parts)
``transformWithStateInPandas``.
"""

__version__ = "0.1.0"

import sys as _sys

try:  # ship this package's functions to Python workers by value (no install needed on executors)
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
