"""Spark-native toolkit for measuring text overlap between collections.

Every public function takes and returns DataFrames and stays lazy unless its
docstring says otherwise (a few operators run one small sizing action on the
query side to decide between a broadcast and a shuffle join).

Functions that run in Python tasks travel by value, so executors need no copy
of this package on their path.
"""

import sys

from pyspark import cloudpickle

from corpusprobe.session import ensure_checkpoint_dir, get_spark

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark", "ensure_checkpoint_dir"]
