"""Cloudloom: point-cloud labelling and evaluation operators for PySpark."""

import sys

from pyspark import cloudpickle

# Workers receive the package's functions by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
