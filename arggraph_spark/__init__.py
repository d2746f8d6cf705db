"""Argument-hypergraph analytics over corpora of documents, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions for executors travel with their code, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
