"""Training-data operators, see queries.py.

Functions that run in Python tasks travel by value, so executors need no copy
of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
