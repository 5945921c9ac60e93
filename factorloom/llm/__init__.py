"""Operators for a training-data pipeline over documents, pages and embeddings.

Nothing outside this package imports it. Its functions are sent to executors by value, so
executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
