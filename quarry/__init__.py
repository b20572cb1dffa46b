"""Spark-native retrieval, context packing, tool-call and alert/deal analytics.

Functions that run inside Python workers (Arrow batches, grouped state) are
pickled by value, so executors need no installed copy of this package.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files
    pass
