"""Spark-native analytics over corpora, RDF-style graphs and dense vectors."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its functions travel by value with each plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
